"""The corpus pipeline: toxic documents go, recurring lines go, one document of each group
of near copies stays, documents with benchmark passages go, and the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of documents, whatever their names. n_chars follows the text where lines were
dropped. Rows are judged one by one, never by id: ids (integers) may be null or repeated.

A null or empty text is no toxic document, has no lines to drop, no near copies and no
benchmark passage, and is packed as its end id alone. Of equal rows one stays, if they have
words. Ties go to the smallest id, then to the row read first. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm import common, decontamination, jaccard, packing, templates, toxicity
from lexispark.llm.registry import word_tokenizer
from lexispark.session import table

#: Rows of a group of near copies: five words a shingle, similarity 0.8 or more.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def fresh(docs: DataFrame, name: str) -> str:
    """The name, with low lines before it until docs has no such column."""
    while name in docs.columns:
        name = f"_{name}"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar scores below 0.5."""
    scored = toxicity.toxicity(docs, table(spark, sf_dir, "labels"), carry=tuple(docs.columns))
    return scored.where("predicted = 0").select("row.*")


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their recurring lines but the first dropped."""
    counts = tuple(fresh(docs, c) for c in ("n_lines", "n_dropped"))
    out = templates.dedup_lines(docs, counts=counts)
    n = F.when(F.col(counts[1]) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars").cast("long"))
    return out.withColumn("n_chars", n).select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of links one row, with the smallest id (one without an id only if
    none has one); documents without words all stay."""
    found = jaccard.jaccard_components(docs, k=NEAR_WORDS, percent=NEAR_PERCENT, carry=tuple(docs.columns))
    return found.where("first").select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    found = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), carry=tuple(docs.columns))
    return found.where("n_hit = 0").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences with their ids."""
    return packing.pack(docs, word_tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_recurring_lines),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack),
]

#: The grammar is learned and packing is no relation, so no SQL gives these rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
