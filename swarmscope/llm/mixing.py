"""Mixing sources to target weights with hash-threshold histograms. DataFrame functions only.

Each source gets a target number of words. A row has a fixed 48-bit hash of its id and text. Per source, words are
summed by the hash's leading 12 bits; the running sum names the bucket in which the budget ends, and only that bucket
is summed again by the next 12 bits, four times in all. Rows below the threshold so found are taken: a filter, without
sorting rows. A larger budget gives a larger threshold, so that selections nest.

Defined results: a null text has size 0; a null source is a source of its own, last in order; a source without words
has target 0; rows equal in id and text share a hash, so are taken together; an empty table gives an empty table;
other columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swarmscope.llm.storage import save

LEVELS, BITS = 4, 12
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def row_hash(doc_id: str = "doc_id", text: str = "text") -> Column:
    """48 bits, the same in every engine that has MD5."""
    key = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text), F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, LEVELS * BITS // 4), 16, 10).cast("long")


def source_targets(sized: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """source, source_size, target: ``share`` of all words by weight, water-filled up to ``most`` times each source."""
    by_source = sized.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    capped = by_source.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier, later = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    # if all sources before this one are full, the rest is shared at this level; the largest such level is the true one
    level = (total - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))) / F.sum("weight").over(later)
    levelled = capped.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return levelled.select("source", "source_size", F.least("cap", F.col("weight") * F.col("level")).alias("target"))


def thresholds(sized: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per source: its size and target, whole copies of every row, and the hash below (or at) which rows get one more.

    ``sized`` has source, size and row_hash.
    """
    targets = save(source_targets(sized, weights, share, most), "mix-targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    edge = targets.withColumn("copies", whole).withColumn("budget", F.col("target") - F.col("copies") * F.col("source_size"))
    edge = edge.withColumn("prefix", F.lit(0).cast("long")).withColumn("last", F.lit(0).cast("long"))
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        bucket = F.shiftright("row_hash", shift)
        open_ = edge.select(F.col("source").alias("edge_source"), "prefix")
        inside = F.col("source").eqNullSafe(F.col("edge_source")) & (F.shiftright("row_hash", shift + BITS) == F.col("prefix"))
        summed = sized.join(open_, inside).groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
        so_far = Window.partitionBy("source").orderBy("bucket")
        summed = summed.withColumn("upto", F.sum("words").over(so_far)).withColumnRenamed("source", "sum_source")
        ends = edge.join(summed, F.col("source").eqNullSafe(F.col("sum_source")) & (F.col("upto") > F.col("budget")), "left")
        found = ends.groupBy("source", "source_size", "target", "copies", "budget").agg(
            F.min_by(F.struct("bucket", "words", "upto"), "bucket").alias("at")
        )
        # a budget that ends in no bucket is met by every row below: nothing to refine
        edge = found.select(
            "source", "source_size", "target", "copies",
            (F.col("budget") - F.coalesce(F.col("at.upto") - F.col("at.words"), F.lit(0))).alias("budget"),
            F.coalesce("at.bucket", F.lit(-1).cast("long")).alias("prefix"), F.coalesce("at.words", F.lit(0).cast("long")).alias("last"),
        )
        edge = save(edge, "mix-edge")
    nearer = F.col("last") - F.col("budget") < F.col("budget")
    return save(edge.select(F.col("source").alias("mix_source"), "source_size", "target", "copies", F.col("prefix").alias("threshold"), nearer.alias("at_threshold")), "mix-thresholds")


def with_copies(sized: DataFrame, limits: DataFrame) -> DataFrame:
    """``sized`` with source_size, target, and mix_copies: how often the mix takes the row."""
    below = (F.col("row_hash") < F.col("threshold")) | ((F.col("row_hash") == F.col("threshold")) & F.col("at_threshold"))
    below &= F.col("target") > F.col("copies") * F.col("source_size")
    joined = sized.join(limits, F.col("source").eqNullSafe(F.col("mix_source")))
    return joined.withColumn("mix_copies", F.col("copies") + F.when(below, 1).otherwise(0)).drop("mix_source", "copies", "threshold", "at_threshold")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, source, ...), each as often as the mix takes it."""
    columns = [F.col(c) for c in docs.columns]
    narrow = save(docs.select("source", word_count("text").alias("size"), row_hash().alias("row_hash")), "mix-sized")
    limits = thresholds(narrow, weights, share, most)
    keyed = docs.select("source", row_hash().alias("row_hash"), F.struct(*columns).alias("mix_row"))
    taken = with_copies(keyed, limits).where("mix_copies > 0")
    return taken.select("mix_row", F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int"))).alias("mix_copy")).select("mix_row.*")
