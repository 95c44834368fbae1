"""A corpus from raw documents, in stages of the training-data operators.

Each stage takes what its predecessor kept, whole, and all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swarmscope.llm import jaccard_join, lang_id, mixing, packing, quality
from swarmscope.llm.membership import parted, unused
from swarmscope.llm.queries import QUALITY_LEAST, remainder
from swarmscope.llm.storage import drop, save

SURE_LANGUAGE = 0.5
SHINGLE, SIMILAR = 5, 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the operator's threshold go."""
    voter = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), remainder(5) != 0)
    score = unused(docs, "quality_score")
    return quality.score(docs, voter, score).where(F.col(score) >= QUALITY_LEAST).select(docs.columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in no language for sure, go."""
    trees = lang_id.fit(docs, remainder(4) != 2)
    predicted, score = unused(docs, "lang_pred"), unused(docs, "lang_score")
    named = lang_id.predict(docs, trees, predicted, score)
    return named.where((F.col(predicted) != lang_id.UNKNOWN) & (F.col(score) >= SURE_LANGUAGE)).select(docs.columns)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the row with the least id stays, ties by the hash of its text.

    Rows equal in id and text are one document, of which one row stays. Rows with the same id and other texts are
    documents of their own. Rows without an id stay, and so do texts without a word.
    """
    rows = save(jaccard_join.classes_of(docs.select("doc_id", "text"), SHINGLE, SIMILAR), "dedup-rows")
    documents = rows.where("doc_id IS NOT NULL").groupBy("doc_id", "text_hash").agg(F.first("component").alias("component"), F.count("*").alias("copies"))
    documents = save(documents, "dedup-documents")
    drop(rows)
    key = ["doc_id", "text_hash"]
    least = documents.where("component IS NOT NULL").groupBy("component").agg(F.min(F.struct(*key)).alias("stays")).select("stays.*")
    gone = save(documents.where("component IS NOT NULL").select(key).join(least, key, "left_anti"), "dedup-gone")
    stay = save(documents.select(*key, "copies").join(gone, key, "left_anti"), "dedup-stay")
    drop(documents)
    own = [F.col("doc_id").cast("long"), F.xxhash64("text")]
    again, once = stay.where("copies > 1").select(key), stay.where("copies = 1").select(key)
    if again.isEmpty():
        return parted(docs, own, gone, once)[0]
    kept = parted(docs, own, gone.union(again), once)[0]
    repeated = parted(docs, own, again, gone.union(once))[1]
    return kept.union(repeated.dropDuplicates(["doc_id", "text"]))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix_sources(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, each with its sequence and place; a word is a token, and each document has an end."""
    return packing.pack_documents(docs, mixing.word_count("text") + 1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("dedup", dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Neither classifier can be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
