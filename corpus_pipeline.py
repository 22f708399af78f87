"""From raw documents to a training mix: five stages over whole tables.

Each stage works on all that its predecessor kept; its result is written as Parquet
and read again.  The last stage returns the mix: the documents that it takes words
from, with the number of words it takes.

All stages take any further columns, whatever they are named, and hand them on as they
are.  An empty table gives an empty table.  Texts are worked on whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracery.llm.common import written
from tracery.llm.decontam import uncontaminated
from tracery.llm.mixing import mix_sources
from tracery.llm.nearcopies import without_near_copies
from tracery.llm.pii import pseudonymise, session_key
from tracery.llm.quality import accepted


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labelled ones among them.

    Null and empty texts are scored like any other; equal texts get equal scores, so
    repeated rows stay or go together.  A score of 0.5 stays.
    """
    return accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard similarity of 0.8 or more), the one with the least id.

    Null and empty texts are copies of each other.  Of rows that repeat an id each
    different text is a document; equal rows are one.  Rows without an id stay.
    """
    return without_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item; null and empty texts stay, repeated rows stay or go together."""
    return uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with private data replaced by pseudonyms under the session's key; null and empty texts stay as they are."""
    return pseudonymise(docs, session_key(spark), counts=False)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: the documents that words are taken from, with the words taken.

    The result is doc_id, size, source_size, target and taken, then the other columns
    of ``docs``.  Where ``docs`` has such a name itself, the mix's column has ``mix_``
    before it.  A null source is a source of its own; null and empty texts give nothing;
    repeated rows are taken from each on its own.
    """
    others = [c for c in docs.columns if c != "doc_id"]
    taken = {c.lower() for c in docs.columns}
    names = {c: f"mix_{c}" if c in taken else c for c in ("size", "source_size", "target", "taken")}
    mixed = mix_sources(docs.select("doc_id", "source", "text", F.struct(*others).alias("others")), carry=("others",)).where(F.col("taken") > 0)
    return mixed.select("doc_id", *[F.col(c).alias(n) for c, n in names.items()], "others.*")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("private_data", private_data),
    ("mixing", mixing),
]

#: SQL can express neither the classifier nor the fingerprints' hash; tests/llm compares the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
