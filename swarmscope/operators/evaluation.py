"""Detector evaluation: IoU joins, one-to-one matching, precision and recall, average precision, parameter choice.

Predictions: image, pred, score, x1, y1, x2, y2. Ground truth: image, gt, x1, y1, x2, y2. Everything meets by image.
"""

from __future__ import annotations

from collections.abc import Callable
from math import pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swarmscope.functions.columns import ratio
from swarmscope.functions.shapes import box_iou

#: 0.50 to 0.95 in steps of 0.05, as repeated addition in doubles gives them. Fixed values.
THRESHOLDS = [0.5, 0.55, 0.6000000000000001, 0.6500000000000001, 0.7000000000000002, 0.7500000000000002, 0.8000000000000003, 0.8500000000000003, 0.9000000000000004, 0.9500000000000004]
#: Size classes of the equivalent diameter in px, from and below. Fixed values.
SIZES = {"tiny": (0, 10), "small": (10, 50), "medium": (50, 150), "large": (150, 500), "xlarge": (500, 9999)}
BOX = ("x1", "y1", "x2", "y2")


def size_aware_filter(predictions: DataFrame, confidence: float = 0.22, large: float = 0.60, large_share: float = 0.08) -> DataFrame:
    """Predictions on a large share of the picture (``area_share``) need a higher score."""
    return predictions.where(F.col("score") >= F.when(F.col("area_share") >= large_share, large).otherwise(confidence))


def top_detections(predictions: DataFrame, most: int = 2500) -> DataFrame:
    order = Window.partitionBy("image").orderBy(F.col("score").desc(), "pred")
    return predictions.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= most).drop("_rank")


def iou_pairs(predictions: DataFrame, truth: DataFrame, overlap: Callable[[dict[str, Column], dict[str, Column]], Column] = box_iou, shape: tuple[str, ...] = BOX) -> DataFrame:
    """Pairs of an image with an overlap above 0. ``overlap`` makes it of both sides' ``shape`` columns, by name."""
    g = truth.select("image", "gt", *[F.col(c).alias(f"g_{c}") for c in shape])
    iou = overlap({c: F.col(c) for c in shape}, {c: F.col(f"g_{c}") for c in shape})
    return predictions.join(g, "image").select("image", "pred", "score", "gt", iou.alias("iou")).where("iou > 0")


def pairs_at(pairs: DataFrame, thresholds: list[float] = THRESHOLDS) -> DataFrame:
    """Pairs at each threshold they reach, by an array of literals, not by a join."""
    reached = F.filter(F.array(*[F.lit(t) for t in thresholds]), lambda t: F.col("iou") >= t)
    return pairs.withColumn("threshold", F.explode(reached))


def greedy_match(pairs: DataFrame, predictions: DataFrame, threshold: float, order: str = "score") -> DataFrame:
    """image, pred, score, gt: each prediction in turn takes its best free truth of IoU ``threshold`` or more, ties to the
    smaller number; gt is null for those that find none. ``order``: score (then number), or pred for detector order."""
    return greedy_matches(pairs, predictions, [threshold], order).drop("threshold")


def greedy_matches(pairs: DataFrame, predictions: DataFrame, thresholds: list[float] = THRESHOLDS, order: str = "score") -> DataFrame:
    """The matches of ``greedy_match`` at each threshold, each of its own.

    A fold over one image's predictions; images and thresholds are independent.
    """
    options = pairs.where(F.col("iou") >= min(thresholds)).groupBy("image", "pred").agg(F.sort_array(F.collect_list(F.struct((-F.col("iou")).alias("far"), "gt"))).alias("options"))
    key = -F.col("score") if order == "score" else F.col("pred").cast("double")
    listed = predictions.join(options, ["image", "pred"], "left").groupBy("image").agg(F.sort_array(F.collect_list(F.struct(key.alias("key"), "pred", "score", F.coalesce("options", F.expr("cast(array() as array<struct<far: double, gt: bigint>>)")).alias("options")))).alias("turns"))
    listed = listed.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    start = F.expr("struct(cast(array() as array<bigint>) as used, cast(array() as array<struct<pred: bigint, score: double, gt: bigint>>) as found)")

    def turn(state: Column, t: Column) -> Column:
        free = F.filter(t["options"], lambda o: (-o["far"] >= F.col("threshold")) & ~F.array_contains(state["used"], o["gt"]))
        gt = F.when(F.size(free) > 0, F.element_at(free, 1)["gt"])
        used = F.when(gt.isNotNull(), F.concat(state["used"], F.array(gt))).otherwise(state["used"])
        return F.struct(used.alias("used"), F.concat(state["found"], F.array(F.struct(t["pred"].cast("long").alias("pred"), t["score"].alias("score"), gt.alias("gt")))).alias("found"))

    folded = listed.select("threshold", "image", F.aggregate("turns", start, turn)["found"].alias("found"))
    return folded.select("threshold", "image", F.inline("found"))


def unmatched(matches: DataFrame, truth: DataFrame) -> DataFrame:
    """False positives and false negatives, as image, kind, number."""
    fp = matches.where("gt IS NULL").select("image", F.lit("fp").alias("kind"), F.col("pred").alias("number"))
    fn = truth.select("image", "gt").join(matches.where("gt IS NOT NULL").select("image", "gt"), ["image", "gt"], "left_anti")
    return fp.union(fn.select("image", F.lit("fn"), F.col("gt")))


def confusion(flags: DataFrame) -> DataFrame:
    """tp, fp, fn and rates overall, by placement, by xanthan and by image, in one pass over grouping sets.

    ``flags``: one row for each prediction or truth: placement, xanthan, image, is_pred, is_gt, tp. Groups without any
    truth are left out.
    """
    sets = [[], [F.col("placement")], [F.col("xanthan")], [F.col("image")]]
    kind = F.when(F.grouping("placement") == 0, "placement").when(F.grouping("xanthan") == 0, "xanthan").when(F.grouping("image") == 0, "image").otherwise("all")
    name = F.coalesce(F.col("placement").cast("string"), F.col("xanthan").cast("string"), F.col("image").cast("string"))
    out = flags.groupingSets(sets, "placement", "xanthan", "image").agg(
        F.sum("tp").cast("long").alias("tp"), F.sum("is_pred").cast("long").alias("pred_count"), F.sum("is_gt").cast("long").alias("gt_count"), kind.alias("grouped_by")
    )
    out = out.where("gt_count > 0").select("grouped_by", name.alias("name"), "tp", (F.col("pred_count") - F.col("tp")).alias("fp"), (F.col("gt_count") - F.col("tp")).alias("fn"), "gt_count", "pred_count")
    return with_rates(out)


def with_rates(counts: DataFrame) -> DataFrame:
    """precision, recall and f1 of tp, fp, fn; 0 where undefined."""
    out = counts.withColumns({"precision": ratio("tp", F.col("tp") + F.col("fp"), 0.0), "recall": ratio("tp", F.col("tp") + F.col("fn"), 0.0)})
    return out.withColumn("f1_score", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"), 0.0))


def size_class(width: Column, height: Column) -> Column:
    d = 2 * F.sqrt(width * height / pi)
    out = F.lit(None).cast("string")
    for name, (low, high) in SIZES.items():
        out = F.when((d >= low) & (d < high), name).otherwise(out)
    return out


def size_recall(truth: DataFrame) -> DataFrame:
    """Recall by size class of truths with a flag ``found``."""
    classed = truth.withColumn("size_class", size_class(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).where("size_class IS NOT NULL")
    out = classed.groupBy("size_class").agg(F.sum("found").cast("long").alias("tp"), F.count("*").alias("gt_count"))
    return out.select("size_class", "tp", (F.col("gt_count") - F.col("tp")).alias("fn"), "gt_count", (F.col("tp") / F.col("gt_count")).alias("recall"))


def precision_recall(flags: DataFrame, n_gt: Column, keys: list[str]) -> DataFrame:
    """Running precision and recall by falling score, of image, pred, score, tp; ``keys`` part the rankings."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "image", "pred")
    ranked = flags.withColumns({"rank": F.row_number().over(order).cast("long"), "tps": F.sum("tp").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long")})
    return ranked.withColumns({"precision": F.col("tps") / F.col("rank"), "recall": F.col("tps") / n_gt})


def envelope(curve: DataFrame, keys: list[str]) -> DataFrame:
    """The largest precision from each rank on."""
    # backwards, as a frame that ends at the last row is gone through anew for each row
    later = Window.partitionBy(*keys).orderBy(F.col("rank").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return curve.withColumn("envelope", F.max("precision").over(later))


def average_precision(curve: DataFrame, keys: list[str]) -> DataFrame:
    """The mean over 101 recalls of the largest precision at that recall or more, precision 1 at recall 0.

    Each rank answers for the sampled recalls between its predecessor's and its own, so that no row meets every sample.
    """
    order = Window.partitionBy(*keys).orderBy("rank")
    steps = envelope(curve, keys).withColumn("from", F.coalesce(F.lag("recall").over(order), F.lit(0.0)))
    sampled = steps.where(F.col("recall") > F.col("from")).select(*keys, "envelope", "from", "recall", F.explode(F.sequence(F.lit(1), F.lit(100))).alias("k"))
    at = F.col("k") * F.lit(0.01)
    hit = sampled.where((at > F.col("from")) & (at <= F.col("recall"))).groupBy(*keys).agg(F.sum("envelope").alias("s"))
    return curve.select(*keys).distinct().join(hit, keys, "left").select(*keys, ((F.coalesce("s", F.lit(0.0)) + 1.0) / 101).alias("ap"))


def map_table(ap: DataFrame) -> DataFrame:
    """AP50, AP75 and their mean over thresholds; of threshold and ap."""
    at = lambda t: F.max(F.when(F.round("threshold", 2) == t, F.col("ap")))
    return ap.agg(at(0.5).alias("ap50"), at(0.75).alias("ap75"), F.avg("ap").alias("map50_95"))


def best_config(history: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the row of the largest f1_score, the first tried of equals."""
    rows = F.struct(*history.columns)
    best = history.groupBy(*keys).agg(F.max_by(rows, F.struct("f1_score", -F.col("trial"))).alias("best"))
    return best.select("best.*")


def detection_coverage(counts: DataFrame, images: int = 5) -> DataFrame:
    """Detections for each 100 truths on the first images by name."""
    first = counts.orderBy("image").limit(images)
    return first.agg(F.sum("pred_count").alias("pred_count"), F.sum("gt_count").alias("gt_count"), F.avg(ratio(100.0 * F.col("pred_count"), "gt_count", 0.0)).alias("mean_coverage"))
