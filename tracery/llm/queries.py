"""The corpus queries: each applies an operator to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import format_conversations, read_conversations
from .decontam import contamination
from .embedding import near_vectors
from .htmltext import page_text
from .licenses import license_scan
from .mixing import mix_sources
from .oracles import ORACLES as ORACLES
from .phrases import collocations
from .pii import pseudonymise, session_key
from .quality import classify
from .simhash import near_duplicates
from .substring import unrepeated
from .suffix import unrepeated_bytes
from .turnrepair import damaged, repair_audit


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents without the repeats of 20-word windows; null and empty texts have no words."""
    out = unrepeated(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors by label and cosine; unusable vectors stand alone."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the probe, formatted, and read back from the formatted text."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    return read_conversations(format_conversations(turns.union(spark.createDataFrame(probe, turns.schema))))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken from each document; a null source is one of its own, null and empty texts give nothing."""
    return mix_sources(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents; null and empty texts have fingerprint zero."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages; null and empty pages have none."""
    return page_text(table(spark, sf_dir, "pages"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, null and empty texts too, learnt from labels that are not held out."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts with private data replaced under the session's key; null stays null."""
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), session_key(spark))


def op9_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents without what lies in repeated strings of 200 bytes; null is empty."""
    out = unrepeated_bytes(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents in windows of benchmark items; null texts and items have no words."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best collocations of each language over all documents; null texts have no words."""
    return collocations(table(spark, sf_dir, "documents"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest repair of all conversations after known damage; null roles and texts are one space."""
    convs = table(spark, sf_dir, "conversations")
    return repair_audit(damaged(convs), ids=convs)


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices in all documents; null texts have none."""
    return license_scan(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_substring": op1_substring,
    "op2_embedding": op2_embedding,
    "op3_chat": op3_chat,
    "op4_mixing": op4_mixing,
    "op5_simhash": op5_simhash,
    "op6_html": op6_html,
    "op7_quality": op7_quality,
    "op8_pii": op8_pii,
    "op9_suffix": op9_suffix,
    "op10_decontam": op10_decontam,
    "op11_phrases": op11_phrases,
    "op12_repair": op12_repair,
    "op13_licenses": op13_licenses,
}
