"""Incremental ingest of bubbles with Structured Streaming; the checkpoint takes the place of looking for outputs."""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from swarmscope.functions.columns import nan_to_null
from swarmscope.operators.rollup import MEASURES, SETTING_KEYS, setting_rollup
from swarmscope.sources.schema import BUBBLE
from swarmscope.sources.sinks import write_bubbles


def stream_bubbles(spark: SparkSession, path: str, schema: T.StructType = BUBBLE, files_per_batch: int = 1000) -> DataFrame:
    return nan_to_null(spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch).parquet(path))


def ingest(source: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append what came since the last run, and stop.

    Each batch of a checkpoint has a folder of its own, written whole, so that one that is run again replaces its rows.
    """
    run = sha256(checkpoint.encode()).hexdigest()[:12]

    def replace(batch: DataFrame, number: int) -> None:
        write_bubbles(batch, f"{target}/part_batch={run}-{number}", "overwrite")

    return source.writeStream.foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_rollup(source: DataFrame, name: str, checkpoint: str, keys: list[str] = SETTING_KEYS, columns: dict[str, str] = MEASURES) -> StreamingQuery:
    """The setting roll-up of all bubbles so far, kept in the table ``name``."""
    rolled = setting_rollup(source, keys, columns)
    return rolled.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
