"""The training-data pipeline: quality rules, line dedup, SimHash near-dedup, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents.
"""

from newsloom.llm.bpe import coded_table, vocabulary
from newsloom.llm.common import ship, staged, table
from newsloom.llm.line_dedup import drop_lines
from newsloom.llm.mixing import mixed_documents
from newsloom.llm.quality_rules import keep_good
from newsloom.llm.simhash import one_of_each


def quality_rules(spark, docs, sf_dir):
    """Documents that the base rules or the learned decision list reject go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark, docs, sf_dir):
    """Lines whose template recurs across documents go, but for the first one."""
    return drop_lines(docs)


def near_dedup(spark, docs, sf_dir):
    """One document of each group stays, linked by SimHash fingerprints or, beyond their bits, by exact Jaccard similarity."""
    ship(spark)
    return one_of_each(docs, most=4)


def mix_sources(spark, docs, sf_dir):
    """Sources are repeated or cut to their targets; one row for each pass over a document."""
    return mixed_documents(docs)


def bpe(spark, docs, sf_dir):
    """Ids of every text, with the digest of their decoding."""
    ship(spark)
    return coded_table(docs, vocabulary())


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
          ("mix_sources", mix_sources), ("bpe", bpe)]
#: The learned list, the components and the ids are beyond plain SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
