"""Sinks, work lists and staleness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swarmscope.sources.schema import BUBBLE, TRANSIENT

PARTS = ["placement", "reactor_setting", "replicate"]


def shrink(df: DataFrame) -> DataFrame:
    """To the stored schema's widths, by column; columns it does not know stay."""
    kinds = {f.name: f.dataType for f in BUBBLE.fields}
    return df.select(*[F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in df.columns])


def write_bubbles(df: DataFrame, path: str, mode: str = "append") -> None:
    """zstd Parquet by placement, setting and replicate. The keys also stay in the files, for scans of single files."""
    stored = shrink(df.drop(*TRANSIENT)).withColumns({f"part_{k}": F.translate(k, " /", "__") for k in PARTS})
    stored.write.mode(mode).partitionBy(*[f"part_{k}" for k in PARTS]).option("compression", "zstd").parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    """A derived table, replaced as a whole."""
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """Nested columns as nested objects, an object a line."""
    df.write.mode("overwrite").json(path)


def as_json(df: DataFrame, name: str = "json") -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


def pending(work: DataFrame, done: DataFrame, keys: list[str] = PARTS) -> DataFrame:
    """What of a work list is not yet in the manifest; replicates without detections are in it too."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def newest(spark: SparkSession, path: str, name: str = "*.parquet") -> DataFrame:
    """One row: the latest modification of the files below ``path``; null if there are none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(path)
    return files.agg(F.max("modificationTime").alias("newest"))


def is_stale(spark: SparkSession, source: str, derived: str, force: bool = False) -> bool:
    """Whether a derived table is missing or older than the newest source file. Reads names and times only."""
    if force:
        return True
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(derived)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return True
    made, came = newest(spark, derived).first()[0], newest(spark, source).first()[0]
    return made is None or (came is not None and came > made)
