"""Polygon labels in text files, and flow-curve tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swarmscope.functions.settings import stem


def parse_labels(lines: DataFrame, width: Column, height: Column, text: str = "value") -> DataFrame:
    """class_id, polygon, its box, centre and size of lines ``class x1 y1 x2 y2 ...`` in shares of the picture.

    Lines of under seven tokens hold no polygon and are left out.
    """
    tokens = F.filter(F.split(F.trim(text), r"\s+"), lambda t: t != "")
    parsed = lines.withColumn("_t", tokens).where(F.size("_t") >= 7)
    numbers = F.transform(F.slice("_t", 2, F.size("_t") - 1), lambda t: t.cast("double"))
    parsed = parsed.withColumn("_n", numbers).withColumn("class_id", F.col("_t")[0].cast("int"))
    index = F.sequence(F.lit(0), F.expr("cast(size(_n) div 2 as int)") - 1)
    polygon = F.transform(index, lambda i: F.struct((F.col("_n")[i * 2] * width).alias("x"), (F.col("_n")[i * 2 + 1] * height).alias("y")))
    out = parsed.withColumn("polygon", polygon).where(F.size("polygon") >= 3).drop("_t", "_n")
    xs, ys = F.col("polygon.x"), F.col("polygon.y")
    out = out.withColumns({"x_min": F.array_min(xs), "y_min": F.array_min(ys), "x_max": F.array_max(xs), "y_max": F.array_max(ys)})
    return out.withColumns(
        {"x_center": (F.col("x_min") + F.col("x_max")) / 2, "y_center": (F.col("y_min") + F.col("y_max")) / 2, "box_width": F.col("x_max") - F.col("x_min"), "box_height": F.col("y_max") - F.col("y_min")}
    )


def scan_labels(spark: SparkSession, path: str, width: int, height: int) -> DataFrame:
    """Labels with the stem of their file, which is that of their picture."""
    lines = spark.read.text(path, wholetext=False, pathGlobFilter="*.txt", recursiveFileLookup=True).select("value", stem(F.col("_metadata.file_name")).alias("stem"))
    return parse_labels(lines, F.lit(float(width)), F.lit(float(height)))


def images_with_labels(images: DataFrame, labels: DataFrame) -> DataFrame:
    """All pictures with their labels; a picture without a label file has none."""
    return images.withColumn("stem", stem("filename")).join(labels, "stem", "left")


def series_long(wide: DataFrame, series: dict[str, tuple[str, str, str]]) -> DataFrame:
    """series, shear_rate, viscosity, stress_pa of a wide table: (rate, viscosity, stress) columns by name of series.

    Rows count where rate and stress are both there, so that they never fall out of step.
    """
    parts = [F.struct(F.lit(n).alias("series"), *[F.col(c).try_cast("double").alias(k) for c, k in zip(cols, ("shear_rate", "viscosity", "stress_pa"), strict=True)]) for n, cols in series.items()]
    return wide.select(F.inline(F.array(*parts))).where("shear_rate IS NOT NULL AND stress_pa IS NOT NULL")


def scan_series_csv(spark: SparkSession, path: str, series: dict[str, tuple[int, int, int]], header_rows: int = 2, columns: int = 22) -> DataFrame:
    """Series by column positions of a CSV export with ``header_rows`` rows above the values, which are no numbers."""
    schema = ", ".join(f"c{i} string" for i in range(columns))
    wide = spark.read.schema(schema).csv(path)
    return series_long(wide, {n: tuple(f"c{i}" for i in at) for n, at in series.items()})
