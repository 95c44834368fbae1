"""Picture trees, and the interface of a detector."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swarmscope.functions.settings import is_image

#: placement / setting / replicate / file
TREE = r"([^/]+)/([^/]+)/([^/]+)/([^/]+)$"
DETECTIONS = T.StructType(
    [
        T.StructField(n, T.StringType()) for n in ("placement", "reactor_setting", "replicate", "filename")
    ]
    + [
        T.StructField("inst", T.IntegerType()), T.StructField("score", T.DoubleType()),
        T.StructField("runs", T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("y", "x0", "x1")]))),
        T.StructField("error", T.StringType()),
    ]
)


def tree_parts(df: DataFrame, path: str | Column = "path") -> DataFrame:
    """placement, reactor_setting, replicate and filename of picture paths; others are left out."""
    decoded = F.url_decode(F.replace(F.col(path) if isinstance(path, str) else path, F.lit("+"), F.lit("%2B")))
    named = df.withColumn("_path", decoded).where(is_image("_path") & F.col("_path").rlike(TREE))
    return named.withColumns({n: F.regexp_extract("_path", TREE, i) for i, n in enumerate(("placement", "reactor_setting", "replicate", "filename"), 1)}).drop("_path")


def scan_images(spark: SparkSession, root: str) -> DataFrame:
    """Bytes of all pictures below ``root``, with the keys of their path; empty files are left out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return tree_parts(found).where("length > 0").select("placement", "reactor_setting", "replicate", "filename", "path", "modificationTime", "length", "content")


def list_split(spark: SparkSession, folder: str) -> DataFrame:
    """path and filename of the pictures (jpg and png) right in a split's folder, by path; their bytes are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.{jpg,png}").load(folder)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("filename")).orderBy("path")


def scan_decoded(spark: SparkSession, root: str) -> DataFrame:
    """Decoded pictures; unreadable ones and those that are all zero are left out."""
    found = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(root)
    nonzero = F.length(F.replace(F.hex("image.data"), F.lit("0"), F.lit(""))) > 0
    return tree_parts(found.withColumn("path", F.col("image.origin"))).where(nonzero)


def detect(images: DataFrame, load: Callable[[], Callable[[bytes], list[dict]]]) -> DataFrame:
    """One row per detection. ``load`` runs once in each task and gives a function from a picture's bytes to detections
    of score and runs (y, x0, x1). A picture that fails yields one row with its error; one without detections, one row
    without an instance, so that a work list knows both as done."""
    keys = ["placement", "reactor_setting", "replicate", "filename"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detector = None
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                own = {k: getattr(row, k) for k in keys}
                nothing = {"inst": None, "score": None, "runs": None, "error": None}
                try:
                    detector = detector or load()
                    found = detector(row.content)
                    rows += [own | {"inst": i, "score": float(d["score"]), "runs": d["runs"], "error": None} for i, d in enumerate(found)] or [own | nothing]
                except Exception as e:  # noqa: BLE001  one bad picture must not end the job
                    rows.append(own | nothing | {"error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(rows, columns=DETECTIONS.names).astype({"inst": "Int32"})

    return images.select(*keys, "content").mapInPandas(run, DETECTIONS)
