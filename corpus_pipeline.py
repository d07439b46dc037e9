"""The corpus pipeline: five stages over documents, each on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it to the shared folder as Parquet and
reads it back as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Table, likely, table, written
from tessera.llm.jaccard import jaccard_components
from tessera.llm.packing import pack
from tessera.llm.pii import find_pii
from tessera.llm.quality import judge
from tessera.llm.queries import vocabulary
from tessera.llm.repeats import without_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or their group's robust estimate reject go."""
    return judge(docs).where("kept").select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least doc_id stays, once: rows of one doc_id (or none) and one text are one."""
    more = written(jaccard_components(docs).where("doc_id != component_id").select("doc_id"))
    again = docs.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id")
    # Rows that are alone with their id and linked to no lesser one stay as they are, without a shuffle.
    may = likely(written(more.union(again)), "doc_id")
    looked_at = docs.where(may).join(more, "doc_id", "left_anti").dropDuplicates(["doc_id", "text"]).select(docs.columns)
    return docs.where(~may).unionByName(looked_at)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay in their first place only; n_chars follows the text."""
    cut = without_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by the names of their kinds; n_chars follows the text."""
    clean = find_pii(docs, redact=True)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in sequences of at most 4096."""
    return pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_copies),
    ("suffix-array dedup", repeats),
    ("PII", personal_data),
    ("packing", packed),
]

#: Several stages have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's table goes once the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        after = Table(stage(spark, docs, sf_dir))
        if before is not None:
            before.drop()
        docs, before = after.df, after
    return docs
