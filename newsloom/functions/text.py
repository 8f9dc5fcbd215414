"""URL and text expressions (regular expressions run JVM-side).

Character classes are spelled out (``\\p{L}`` ...) so that word, digit and space
mean the same for every language, not only ASCII.
"""

import json
import unicodedata
from functools import lru_cache
from html.entities import html5

from pyspark.sql import functions as F


def _col(c):
    return F.col(c) if isinstance(c, str) else c


# ---- URLs ---------------------------------------------------------------

def canonical_url(url):
    return F.regexp_replace(_col(url), "https?://", "")


def article_id_from_url(url):
    """Id between the last '-' and '.chn'; '<id>rf<other>' keeps the first id; else null."""
    found = F.regexp_extract(_col(url), r"-([0-9]+)(rf[0-9]+)?.chn", 1)
    return F.when(found != "", found.cast("long"))


URL_HOST = r"^(?:https?://)?(?:[^@/\n]+@)?(?:www\.)?([^:/\n]+)"  # fixed pattern


def url_host(url, full=False):
    """Host name; ``full=True`` returns the whole match with its scheme."""
    found = F.regexp_extract(_col(url), URL_HOST, 0 if full else 1)
    return F.when(found != "", found)


def url_encode(url):
    """Percent encoding: letters, digits, '_.-~' and '/' stay, a blank is %20."""
    coded = F.replace(F.url_encode(_col(url)), F.lit("+"), F.lit("%20"))
    for done, wanted in [("*", "%2A"), ("%7E", "~"), ("%2F", "/")]:
        coded = F.replace(coded, F.lit(done), F.lit(wanted))
    return coded


def url_decode(url):
    """Undo percent encoding; '+' and a '%' without two digits stay as they are."""
    whole = F.regexp_replace(F.replace(_col(url), F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.url_decode(whole)


# Fixed list: operating-system families that are kept.
OS_FAMILIES = [
    "iOS", "Android", "Windows Phone", "Windows Mobile", "Windows", "Mac OS X", "Mac OS",
    "Samsung", "FireHbbTV", "ATV OS X", "tvOS", "Chrome OS", "Debian", "Symbian OS",
    "BlackBerry OS", "Firefox OS", "Brew MP", "Chromecast", "webOS", "Gentoo", "Solaris",
]


def normalize_os(family, default="Other"):
    c = _col(family)
    return (F.when(c.contains("Symbian"), "Symbian OS")
            .when(c.contains("BlackBerry"), "BlackBerry OS")
            .when(c.isin(OS_FAMILIES), c)
            .otherwise(default))


@lru_cache(maxsize=1)
def _accent_table():
    """Accented letter -> base letter, from the Unicode decomposition rule."""
    src, dst = [], []
    for point in range(0xC0, 0xAC00):
        char = chr(point)
        base = "".join(x for x in unicodedata.normalize("NFD", char)
                       if unicodedata.category(x) != "Mn")
        if base != char and len(base) == 1:
            src.append(char)
            dst.append(base)
    return "".join(src), "".join(dst)


def strip_accents(c):
    src, dst = _accent_table()
    return F.regexp_replace(F.translate(_col(c), src, dst), r"\p{Mn}", "")


# ---- lists --------------------------------------------------------------

def split_list(c, sep=","):
    parts = F.transform(F.split(_col(c), sep), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def semicolons_to_commas(c):
    return F.replace(_col(c), F.lit(";"), F.lit(","))


def join_ids(c, sep=","):
    return F.array_join(_col(c).cast("array<string>"), sep)


# ---- article text -------------------------------------------------------

def assemble_text(cols, sep=" | "):
    """Join the text columns (null = empty), dropping soft hyphens and double quotes."""
    joined = F.concat_ws(sep, *[F.coalesce(_col(c), F.lit("")) for c in cols])
    return F.translate(joined, "­\"", "")


@lru_cache(maxsize=1)
def _named_references():
    """Named character references of HTML as JSON, from the standard library."""
    return json.dumps({name[:-1]: char for name, char in html5.items() if name.endswith(";")})


# Fixed list: characters the portal's text filter names.
BAD_CHARACTERS = "\";:!*(){}/|-_=+&^%$#@<>~"


def _references(c):
    """Decode &name;, &#123; and &#x7b; by splitting on '&' and rebuilding each piece."""
    names = F.from_json(F.lit(_named_references()), "map<string,string>")

    def piece(p):
        head = F.substring_index(p, ";", 1)
        dec = F.regexp_extract(head, r"^#0*([0-9]{1,8})$", 1)
        hexa = F.regexp_extract(head, r"^#[xX]0*([0-9a-fA-F]{1,7})$", 1)
        code = F.when(dec != "", dec.cast("long")).when(hexa != "", F.conv(hexa, 16, 10).cast("long"))
        valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        point = F.when(valid, code).otherwise(0xFFFD)
        char = F.when(code.isNotNull(), F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")).otherwise(names[head])
        closed = F.contains(p, F.lit(";")) & char.isNotNull()
        return F.when(closed, F.concat(char, F.substr(p, F.length(head) + 2))).otherwise(F.concat(F.lit("&"), p))
    pieces = F.split(c, "&")
    tail = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), piece)
    return F.concat(pieces[0], F.array_join(tail, ""))


def html_to_text(c, remove_bad_chars=False):
    """Visible text of an HTML body.

    The upstream job names a list of bad characters but never removes them
    (each character is compared with the whole list); ``remove_bad_chars``
    switches the intended removal on.
    """
    text = F.regexp_replace(_col(c), r"(?s)<!--.*?-->", "")
    text = F.regexp_replace(text, r"(?is)<(script|style)\b.*?</(script|style)>", "")
    # a tag starts with a letter, '/', '!' or '?' and may hold a quoted '>'
    text = F.regexp_replace(text, r"""(?s)<(?:/?[A-Za-z](?:[^>"']++|"[^"]*+"|'[^']*+')*+|[!?][^>]*)>""", "")
    text = F.regexp_replace(text, r"(?s)</?[A-Za-z][^>]*>", "")
    text = F.when(text.contains("&"), _references(text)).otherwise(text)
    if remove_bad_chars:
        text = F.translate(text, BAD_CHARACTERS, "")
    return text


# Punctuation set and the ordered cleaning steps.
PUNCTUATION = r"""!"#%'()*+,./:;<=>?@\[\\\]^_`{|}~"""
_W = r"[\p{L}\p{N}_]"
_NOT_W = r"[^\p{L}\p{N}_]"
SPACE = r"\t\n\x0b\f\r\x1c-\x1f\x{85}\p{Z}"
CLEANING_STEPS = [
    (r"\n", " "),
    ("…", "..."),
    (r"\.\.\.", ""),
    (r"\{.*\}", ""),
    ("–", "-"),
    (r"<(/|\\)?.+?>", " "),
    (r"\p{Nd}", "0"),
    (rf"(http|https)://[^{SPACE}]+", "URL"),
    (rf"[^{SPACE}]+@[^{SPACE}]+", "EMAIL"),
    (rf"(^|{_NOT_W})[‘’′`']", '$1"'),
    (rf"[‘’`′']({_NOT_W}|\z)", '"$1'),
    ("[‘’`′“”]", '"'),
    ('"', ""),
    (r"(?<!\.)\.\.(?!\.)", "."),
    (r'([,";:]){2},', "$1"),
    (r" -(?=\p{L})", " - "),
    (rf"({_W}+)([{PUNCTUATION}])([ {PUNCTUATION}])", "$1 $2 $3"),
    (rf"([ {PUNCTUATION}])([{PUNCTUATION}])({_W}+)", "$1 $2 $3"),
    (rf"({_W}+)([{PUNCTUATION}])\z", "$1 $2"),
    ("''", "'"),
    (" +", " "),
    (rf"^[{SPACE}]+|[{SPACE}]+\z", ""),
]


def clean_text(c):
    """Lower-case and run the ordered cleaning steps; '.' stops only at newlines."""
    text = F.lower(F.replace(_col(c), F.lit("\n"), F.lit(" ")))
    for pattern, replacement in CLEANING_STEPS[1:]:
        text = F.regexp_replace(text, "(?d)" + pattern, replacement)
    return text


def sentences(c):
    return F.split(_col(c), rf"(?<=[.!?])[{SPACE}]+")


def first_sentences(c, n=8, clean=clean_text):
    """Clean the first ``n`` well-formed sentences (3+ blanks, ends with . ! ? ;)."""
    def well_formed(s):
        blanks = F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))
        return (blanks >= 3) & F.substring(s, -1, 1).isin(".", "!", "?", ";")
    kept = F.slice(F.filter(sentences(c), well_formed), 1, n)
    return F.array_join(F.transform(kept, clean) if clean else kept, " ")


TOKEN = rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{SPACE}]"
BOILERPLATE = ["Saken", "oppdateres", "."]  # fixed value: sentence that is dropped


def raw_tokens(c):
    return F.regexp_extract_all(_col(c), F.lit(TOKEN), 0)


def tokenize(c, lower_first=False, max_words=None):
    """Word and punctuation tokens; optionally lower the first word of later sentences."""
    tokens = raw_tokens(c)
    if lower_first:
        stops = [".", "?", "!"]
        previous = F.concat(F.array(F.lit("")), tokens)
        tokens = F.zip_with(
            tokens, F.slice(previous, 1, F.size(tokens)),
            lambda t, p: F.when(p.isin(stops) & ~t.isin(stops), F.lower(t)).otherwise(t))
    return F.slice(tokens, 1, max_words) if max_words else tokens


def sentence_tokens(c, n_sentences=12, max_words=1000):
    """Tokens of the first ``n`` sentences of 3+ tokens that end with . ! ? ;"""
    per_sentence = F.transform(sentences(F.translate(_col(c), "|", ".")), raw_tokens)
    stop = F.array(*[F.lit(x) for x in BOILERPLATE])
    kept = F.filter(
        per_sentence,
        lambda t: (F.size(t) >= 3) & F.element_at(t, -1).isin(".", "!", "?", ";") & (t != stop))
    return F.slice(F.flatten(F.slice(kept, 1, n_sentences)), 1, max_words)
