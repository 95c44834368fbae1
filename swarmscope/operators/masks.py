"""Masks as runs (image, inst, y, x0, x1): area, moments, boxes, axes and overlaps, without dense arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swarmscope.functions.shapes import equivalent_diameter, near_unity

KEYS = ["image", "inst"]
ELLIPSE = ["cx", "cy", "a", "b"]


def ellipse_line(cx: Column, cy: Column, a: Column, b: Column) -> tuple[Column, Column]:
    """x0 and x1 of an ellipse on a line ``y`` that crosses it."""
    u = (F.col("y") - cy) / b
    half = a * F.sqrt(1 - u * u)
    return F.ceil(cx - half).cast("int"), (F.floor(cx + half) + 1).cast("int")


def ellipse_lines(shapes: DataFrame) -> DataFrame:
    """``shapes`` with a row for each of an ellipse's runs (y, x0, x1)."""
    rows = shapes.withColumn("y", F.explode(F.sequence(F.floor(F.col("cy") - F.col("b")).cast("int"), F.ceil(F.col("cy") + F.col("b")).cast("int"))))
    x0, x1 = ellipse_line(*map(F.col, ELLIPSE))
    return rows.where(F.abs(F.col("y") - F.col("cy")) < F.col("b")).withColumns({"x0": x0, "x1": x1}).where("x1 > x0")


def ellipse_runs(shapes: DataFrame) -> DataFrame:
    """Runs of ellipses (image, inst, cx, cy, a, b): semi-axes a along x and b along y."""
    return ellipse_lines(shapes).select(*KEYS, "y", "x0", "x1")


def moments(runs: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Area, centroid and equivalent diameter."""
    n = F.col("x1") - F.col("x0")
    sums = runs.groupBy(*keys).agg(
        F.sum(n).cast("long").alias("area"), F.sum((F.col("x0") + F.col("x1") - 1) * n / 2.0).alias("m10"), F.sum(F.col("y") * n).cast("double").alias("m01")
    )
    return sums.select(*keys, "area", (F.col("m10") / F.col("area")).alias("cx"), (F.col("m01") / F.col("area")).alias("cy"), equivalent_diameter("area").alias("eq_d"))


def boxes(runs: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return runs.groupBy(*keys).agg(F.min("x0").alias("x_min"), F.min("y").alias("y_min"), F.max("x1").alias("x_max"), (F.max("y") + 1).alias("y_max"))


def axis_angle() -> Column:
    """Of the larger principal axis of points x, y; in degrees from 0 to 180."""
    angle = F.degrees(F.atan2(2 * F.covar_samp("x", "y"), F.var_samp("x") - F.var_samp("y")) / 2)
    return F.when(angle < 0, angle + 180).otherwise(angle)


def contour(runs: DataFrame) -> DataFrame:
    """Both end pixels of every run, as points."""
    ends = F.array(F.col("x0").cast("double"), (F.col("x1") - 1).cast("double"))
    return runs.select(*KEYS, F.explode(F.array_distinct(ends)).alias("x"), F.col("y").cast("double").alias("y"))


def principal_axis(points: DataFrame) -> DataFrame:
    return points.groupBy(*KEYS).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), axis_angle().alias("angle_deg"), F.count("*").alias("n"))


def split_fit(points: DataFrame, mm_per_px: float, band: float = 0.15) -> DataFrame:
    """Centre, angle, full axis a and half widths in mm: b1 of the front, b2 of the rear, on the axis' positive and negative side.

    A width is the largest distance from the axis within ``band`` of a around half the extreme, seen from the centre of the
    contour. If either part has no point there, both are 75th percentiles over the halves. Under five points have no fit.
    """
    about = principal_axis(points).where("n >= 5")
    turned = points.join(about, KEYS).withColumn("t", F.radians("angle_deg"))
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    fit = ["cx", "cy", "angle_deg"]
    turned = turned.select(*KEYS, *fit, (dx * F.cos("t") + dy * F.sin("t")).alias("u"), F.abs(dy * F.cos("t") - dx * F.sin("t")).alias("v"))
    ends = turned.groupBy(*KEYS).agg(F.min("u").alias("low"), F.max("u").alias("high"))
    split = turned.join(ends, KEYS).withColumn("a", F.col("high") - F.col("low"))
    near = lambda end: F.max(F.when(F.abs(F.col("u") - F.col(end) / 2) < band * F.col("a") - 1e-9, F.col("v")))
    most = lambda side: F.percentile(F.when(side, F.col("v")), 0.75)
    fitted = split.groupBy(*KEYS).agg(
        *[F.first(c).alias(c) for c in (*fit, "a")], near("high").alias("front"), near("low").alias("rear"), most(F.col("u") >= 0).alias("q_front"), most(F.col("u") < 0).alias("q_rear")
    )
    missing = F.col("front").isNull() | F.col("rear").isNull()
    width = lambda c: (F.when(missing, F.coalesce(f"q_{c}", c)).otherwise(F.col(c)) * mm_per_px)
    return fitted.select(*KEYS, *fit, (F.col("a") * mm_per_px).alias("a_mm"), width("front").alias("b1_mm"), width("rear").alias("b2_mm"))


def mask_iou(left: DataFrame, right: DataFrame) -> DataFrame:
    """Exact IoU of the masks of an image that overlap: runs meet by image and line."""
    r = right.select("image", "y", F.col("inst").alias("gt"), F.col("x0").alias("g0"), F.col("x1").alias("g1"))
    both = left.withColumnRenamed("inst", "pred").join(r, ["image", "y"])
    common = F.greatest(F.lit(0), F.least("x1", "g1") - F.greatest("x0", "g0"))
    shared = both.groupBy("image", "pred", "gt").agg(F.sum(common).cast("long").alias("common")).where("common > 0")
    area = lambda t, name: t.groupBy("image", F.col("inst").alias(name)).agg(F.sum(F.col("x1") - F.col("x0")).alias(f"{name}_area"))
    out = shared.join(area(left, "pred"), ["image", "pred"]).join(area(right, "gt"), ["image", "gt"])
    return out.select("image", "pred", "gt", "common", (F.col("common") / (F.col("pred_area") + F.col("gt_area") - F.col("common"))).alias("iou"))


def ellipse_iou(left: DataFrame, right: DataFrame) -> DataFrame:
    """``mask_iou`` of the runs of ellipses, one for each image and inst. The ellipses of an image meet first, and only the
    lines that two have in common are drawn: runs, of which an ellipse has many, are not moved."""

    def sized(shapes: DataFrame, inst: str, mark: str) -> DataFrame:
        area = ellipse_lines(shapes).groupBy(*KEYS, *ELLIPSE).agg(F.sum(F.col("x1") - F.col("x0")).alias("area"))
        return area.select("image", F.col("inst").alias(inst), *[F.col(c).alias(f"{mark}_{c}") for c in (*ELLIPSE, "area")])

    low = lambda at, half: F.greatest(*(F.col(f"{m}_{at}") - F.col(f"{m}_{half}") for m in "pg"))
    high = lambda at, half: F.least(*(F.col(f"{m}_{at}") + F.col(f"{m}_{half}") for m in "pg"))
    both = sized(left, "pred", "p").join(sized(right, "gt", "g"), "image").where((low("cx", "a") <= high("cx", "a")) & (low("cy", "b") <= high("cy", "b")))
    lines = both.withColumn("y", F.explode(F.sequence(F.floor(low("cy", "b")).cast("int"), F.ceil(high("cy", "b")).cast("int"))))
    lines = lines.where(" AND ".join(f"abs(y - {m}_cy) < {m}_b" for m in "pg"))
    (p0, p1), (g0, g1) = (ellipse_line(*(F.col(f"{m}_{c}") for c in ELLIPSE)) for m in "pg")
    common = F.greatest(F.lit(0), F.least(p1, g1) - F.greatest(p0, g0))
    sums = lines.groupBy("image", "pred", "gt").agg(F.sum(common).cast("long").alias("common"), F.first("p_area").alias("p"), F.first("g_area").alias("g")).where("common > 0")
    return sums.select("image", "pred", "gt", "common", (F.col("common") / (F.col("p") + F.col("g") - F.col("common"))).alias("iou"))


def moment_axes(runs: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Full axes of the ellipse with a mask's second moments, and its angle in degrees from 0 to 180."""
    n = (F.col("x1") - F.col("x0")).cast("double")
    x0, x1, y = (F.col(c).cast("double") for c in ("x0", "x1", "y"))
    squares = (x1 - 1) * x1 * (2 * x1 - 1) / 6 - (x0 - 1) * x0 * (2 * x0 - 1) / 6
    line = (x0 + x1 - 1) * n / 2
    sums = runs.groupBy(*keys).agg(
        F.sum(n).alias("n"), F.sum(line).alias("sx"), F.sum(y * n).alias("sy"), F.sum(squares).alias("sxx"), F.sum(y * y * n).alias("syy"), F.sum(y * line).alias("sxy")
    )
    mean = lambda s: F.col(s) / F.col("n")
    # a pixel is a square, not a point
    vx, vy = mean("sxx") - mean("sx") * mean("sx") + 1 / 12, mean("syy") - mean("sy") * mean("sy") + 1 / 12
    both = mean("sxy") - mean("sx") * mean("sy")
    middle, spread = (vx + vy) / 2, F.sqrt((vx - vy) * (vx - vy) / 4 + both * both)
    angle = F.degrees(F.atan2(2 * both, vx - vy) / 2)
    return sums.select(
        *keys, (4 * F.sqrt(middle + spread)).alias("major"), (4 * F.sqrt(F.greatest(F.lit(0.0), middle - spread))).alias("minor"), F.when(angle < 0, angle + 180).otherwise(angle).alias("angle_deg")
    )


def near_spherical(runs: DataFrame, tolerance: float = 0.10, keys: list[str] = KEYS) -> DataFrame:
    return moment_axes(runs, keys).withColumn("near", near_unity("major", "minor", tolerance))


def polygon_runs(polygons: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Runs of pixels whose centres lie in ``polygon`` (array of x, y), vertices cut to whole pixels, by crossings of
    each line with the edges; even-odd. Crossings are sorted within a mask's row: each line has an even number of them."""
    corner = lambda p: F.struct(p["x"].cast("int").cast("double").alias("x"), p["y"].cast("int").cast("double").alias("y"))
    ring = polygons.select(*keys, F.transform("polygon", corner).alias("p"))
    edges = ring.select(*keys, F.arrays_zip(F.col("p").alias("a"), F.concat(F.slice("p", 2, F.size("p")), F.slice("p", 1, 1)).alias("b")).alias("e"))
    masks = edges.groupBy(*keys).agg(F.flatten(F.collect_list("e")).alias("e"))
    low, high = (lambda e: F.least(e["a"]["y"], e["b"]["y"])), (lambda e: F.greatest(e["a"]["y"], e["b"]["y"]))

    def crossings(e: Column) -> Column:
        a, b = e["a"], e["b"]
        return F.transform(F.sequence(low(e).cast("int"), high(e).cast("int") - 1), lambda y: F.struct(y.alias("y"), (a["x"] + (y + 0.5 - a["y"]) * (b["x"] - a["x"]) / (b["y"] - a["y"])).alias("x")))

    found = masks.select(*keys, F.sort_array(F.flatten(F.transform(F.filter("e", lambda e: low(e) < high(e)), crossings))).alias("c")).where(F.size("c") > 0)
    spans = F.transform(
        F.sequence(F.lit(0), F.expr("cast(size(c) div 2 as int)") - 1),
        lambda i: F.struct(F.col("c")[2 * i]["y"].alias("y"), F.ceil(F.col("c")[2 * i]["x"] - 0.5).cast("int").alias("x0"), F.ceil(F.col("c")[2 * i + 1]["x"] - 0.5).cast("int").alias("x1")),
    )
    return found.select(*keys, F.inline(spans)).where("x1 > x0")
