"""Frame order, bursts and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from swarmscope.functions.settings import is_zero_concentration, natural_key

BURST = 50
REPLICATE = ["placement", "reactor_setting", "replicate"]


def frame_ordinals(images: DataFrame, name: str = "filename", keys: list[str] = REPLICATE) -> DataFrame:
    """frame_no from 0, in natural order of names within each replicate."""
    order = Window.partitionBy(*keys).orderBy(natural_key(name), name)
    return images.withColumn("frame_no", (F.row_number().over(order) - 1).cast("long"))


def bursts(frames: DataFrame, size: int = BURST) -> DataFrame:
    """Without thickener, frames come in bursts of ``size``; else all are burst 0."""
    zero = is_zero_concentration("reactor_setting")
    n = F.col("frame_no")
    return frames.withColumns(
        {
            "burst_index": F.when(zero, F.expr(f"frame_no div {size}") + 1).otherwise(0).cast("int"),
            "image_number_in_burst": F.when(zero, n % size + 1).otherwise(n + 1).cast("int"),
        }
    )


def overlay_sample(frames: DataFrame, mode: str = "every_10th", keys: list[str] = REPLICATE) -> DataFrame:
    """Frames whose pictures are to be kept: all, every_10th, every_5th, first_only, first_last or none."""
    n = F.col("frame_no")
    if mode == "all":
        return frames
    if mode == "none":
        return frames.where(F.lit(False))
    if mode == "first_only":
        return frames.where(n == 0)
    if mode in ("every_10th", "every_5th"):
        return frames.where(n % (10 if mode == "every_10th" else 5) == 0)
    if mode == "first_last":
        last = F.max("frame_no").over(Window.partitionBy(*keys))
        return frames.withColumn("_last", last).where((n == 0) | (n == F.col("_last"))).drop("_last")
    raise ValueError(f"unknown overlay mode: {mode}")
