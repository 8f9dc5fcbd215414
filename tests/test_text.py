"""URL and text expressions on hand-made strings."""

from pyspark.sql import functions as F

from newsloom.functions import text as X
from newsloom.sources.clicks import day_list, month_list, parse_page_views


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "v string").select(expr).first()[0]


def test_urls(spark):
    assert one(spark, "https://a.vn/x", X.canonical_url("v")) == "a.vn/x"
    assert one(spark, "a.vn/te-201908121346105rf20190925103622081.chn", X.article_id_from_url("v")) == 201908121346105
    assert one(spark, "a.vn/te-2019.chn", X.article_id_from_url("v")) == 2019
    assert one(spark, "a.vn/te.htm", X.article_id_from_url("v")) is None
    assert one(spark, "https://www.a.vn:80/x", X.url_host("v")) == "a.vn"
    assert one(spark, "http://a/b c+d~e*é%", X.url_encode("v")) == "http%3A//a/b%20c%2Bd~e%2A%C3%A9%25"
    assert one(spark, "a%20b+c%2Fd%zz%", X.url_decode("v")) == "a b+c/d%zz%"


def test_html(spark):
    html = '<p>A&amp;lt; &#233;&#x41;<!-- no --><script>var t="</p>";</script> "b"&nbsp;c; &#999999; &# x</p>'
    assert one(spark, html, X.html_to_text("v")) == 'A&lt; éA "b" c; ' + chr(999999) + ' &# x'
    for html, text in [
            ("<p>5 < 6 and 7 > 3</p>", "5 < 6 and 7 > 3"), ("<a title='x>y'>t</a>", "t"), ("a<br/>b<!DOCTYPE x>c", "abc"),
            ("&oslash;&eacute;&times;&apos;&rarr;&unknown; & b", "\u00f8\u00e9\u00d7'\u2192&unknown; & b"),
            ("&#128512;&#x1F600;&#0;&#xD800;", "\U0001F600\U0001F600\ufffd\ufffd"), ("<a title='x>t</a>", "t"), ("", ""), (None, None)]:
        assert one(spark, html, X.html_to_text("v")) == text
    assert one(spark, "<b>a-b; c</b>", X.html_to_text("v", remove_bad_chars=True)) == "ab c"


def test_clean_text(spark):
    assert one(spark, 'Olá "Mundo"... Veja http://a.b/c e x@y.z em 2019!', X.clean_text("v")) == \
        "olá mundo veja URL e EMAIL em 0000 !"
    assert one(spark, "", X.clean_text("v")) == ""


def test_sentences(spark):
    text = "Saken oppdateres. Dette er en lang setning. Kort. Uten slutt her nå"
    assert one(spark, text, X.first_sentences("v", 8, None)) == "Dette er en lang setning."
    assert one(spark, text, F.array_join(X.sentence_tokens("v"), " ")) == "Dette er en lang setning ."


def test_lists_and_accents(spark):
    assert one(spark, " a, ,b ,", X.split_list("v")) == ["a", "b"]
    assert one(spark, "Đà Nẵng, Ünïcode, Ελλάς ά", X.strip_accents("v")) == "Đa Nang, Unicode, Ελλας α"
    assert one(spark, "BlackBerry Tablet", X.normalize_os("v")) == "BlackBerry OS"


def test_page_views(spark):
    lines = spark.createDataFrame([("u\t1\t2\t3",), ("u\t1\tx\t3",), ("bad",)], "value string")
    good, bad = parse_page_views(lines)
    assert [tuple(r) for r in good.collect()] == [("u", 1, 2, 3)] and bad.count() == 2


def test_day_and_month_lists():
    assert day_list("2019-01-31", "2019-02-01") == ["2019-01-31", "2019-02-01"]
    assert month_list("2019-01-31", "2019-03-01") == ["2019-01", "2019-02", "2019-03"]
