"""The corpus pipeline: quality, near duplicates, repeated passages, benchmark leaks, token ids.

Each stage works on all that its predecessor kept. All but the last return the
columns of ``documents``; the last adds ``ids`` and ``n_tokens``. Rows with null
texts go with the quality stage, as they have nothing to keep; every stage
accepts empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import bpe, decontam, minhash, quality, substrings
from loomgraph.llm.columns import fresh
from loomgraph.llm.queries import BYTE_BPE
from loomgraph.session import scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Words whose ids a worker keeps: 40 MB.
KEEP_WORDS = 1 << 18


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier accepts."""
    score, accepted = fresh(docs, "quality_score"), fresh(docs, "accepted")
    return quality.score(docs, quality.fit(docs), quality=score, accepted=accepted).where(F.col(accepted)).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates (similarity 0.8).

    Where ids repeat or are null, rows of one id and text are one document; a further text of an id, or one
    without an id, is a document by itself, which gives way to those that have their id.
    """
    counts = docs.groupBy("doc_id").count()
    if counts.where("count > 1 OR doc_id IS NULL").isEmpty():
        return docs.join(_heads(docs, "doc_id"), "doc_id", "left_semi").select(*docs.columns)
    again = counts.where("count > 1 AND doc_id IS NOT NULL").select("doc_id")
    head, key = fresh(docs, "head"), fresh(docs, "key")
    heads = docs.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias(head))
    own = F.col("doc_id").isNotNull() & (F.col(head).isNull() | (F.xxhash64("text") == F.col(head)))
    other = F.xxhash64("doc_id", "text").bitwiseAND((1 << 62) - 1).bitwiseOR(F.lit(1 << 62))
    keyed = docs.join(heads, "doc_id", "left").withColumn(key, F.when(own, F.col("doc_id")).otherwise(other)).drop(head).dropDuplicates([key])
    at = scratch(spark, "keyed")
    keyed.write.parquet(at)
    keyed = spark.read.parquet(at)
    return keyed.join(_heads(keyed, key), key, "left_semi").select(*docs.columns)


def _heads(docs: DataFrame, key: str) -> DataFrame:
    """The ids that stay: the smallest of each group."""
    return minhash.groups_of(docs, doc_id=key).where("id = component_id").select(F.col("id").alias(key))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words and more that a smaller id has; untouched texts stay as they are, emptied ones go."""
    added = tuple(fresh(docs, c) for c in ("n_words", "n_removed", "removed", "kept"))
    n_words, n_removed, kept = (F.col(added[k]) for k in (0, 1, 3))
    found = substrings.remove_repeats(docs, added=added).where((n_removed == 0) | (n_removed < n_words))
    text = F.when(n_removed == 0, F.col("text")).otherwise(kept)
    chars = F.when(n_removed == 0, F.col("n_chars")).otherwise(F.char_length("text").cast("long"))
    return found.withColumn("text", text).withColumn("n_chars", chars).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    matches = fresh(docs, "matches")
    return decontam.contaminated(docs, benchmark, matches=matches).where(F.size(matches) == 0).select(*docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with the other columns of documents; workers keep few words, as executors are full by then."""
    return bpe.encode(docs, BYTE_BPE, keep_words=KEEP_WORDS)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("decontamination", decontamination_stage),
    ("bpe_encoding", encoding_stage),
]

#: SQL cannot express the first stage; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again."""
    docs, at = spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
