"""Stand-in tables over the driver's data, as the same expressions in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_BASE = {
    "placement": "concat('placement_', cast(1 + l_suppkey % 6 as string))",
    "rpm_no": "case l_partkey % 4 when 0 then '75' when 1 then '100' when 2 then '125' else '150' end",
    "aer_no": "case l_orderkey % 4 when 0 then '45' when 1 then '55' when 2 then '70' else '90' end",
    "xan_no": "case l_linenumber % 3 when 0 then '000' when 1 then '0125' else '025' end",
    "replicate": "concat('rep_', cast(1 + l_orderkey % 3 as string))",
    "frame_no": "l_orderkey % 200",
    "equivalent_diameter_mm": "l_quantity / 10",
    "model_used": "case l_returnflag when 'A' then 'sphere' when 'N' then 'sphere_fallback' else 'asym_ellipsoid' end",
    "confidence": "l_discount * 5 + cast(0.5 as double)",
    "l_orderkey": "l_orderkey", "l_partkey": "l_partkey", "l_suppkey": "l_suppkey", "l_linenumber": "l_linenumber", "l_extendedprice": "l_extendedprice", "l_quantity": "l_quantity", "l_discount": "l_discount", "l_tax": "l_tax",
}
_DERIVED = {
    "reactor_setting": "concat(rpm_no, ' rpm ', aer_no, ' lmin ', xan_no, ' xanthan')",
    "bubble_volume_mm3": "pi() / 6 * equivalent_diameter_mm * equivalent_diameter_mm * equivalent_diameter_mm",
    "bubble_surface_area_mm2": "pi() * equivalent_diameter_mm * equivalent_diameter_mm",
    "burst_index": "cast(case when xan_no = '000' then (frame_no - frame_no % 50) / 50 + 1 else 0 end as int)",
    "image_number_in_burst": "cast(case when xan_no = '000' then frame_no % 50 + 1 else frame_no + 1 end as int)",
}


def bubbles(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(*[f"{e} as {n}" for n, e in _BASE.items()])
    return base.selectExpr("*", *[f"{e} as {n}" for n, e in _DERIVED.items()])


BUBBLES = (
    "bubbles_base AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _BASE.items()) + " FROM lineitem),\n"
    "bubbles AS (SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in _DERIVED.items()) + " FROM bubbles_base)"
)

_GT_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax"
_TRUTH = {"image": "l_orderkey", "gt": "k", "x1": "cast(l_partkey % 60 as double)", "y1": "cast(l_suppkey % 60 as double)", "x2": "l_partkey % 60 + 20 + l_quantity", "y2": "l_suppkey % 60 + 20 + cast(0.8 as double) * l_quantity"}
_PREDICTION = {
    "image": "l_orderkey", "pred": "k", "score": "l_extendedprice",
    "x1": "l_partkey % 60 + 100 * l_discount", "y1": "l_suppkey % 60 + 100 * l_tax", "x2": "l_partkey % 60 + 100 * l_discount + 20 + l_quantity", "y2": "l_suppkey % 60 + 100 * l_tax + 20 + cast(0.8 as double) * l_quantity",
}
_META = {"placement": "concat('placement_', cast(1 + l_orderkey % 6 as string))", "xanthan": "case l_orderkey % 3 when 0 then '0.00' when 1 then '0.125' else '0.25' end"}


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(spark, sf_dir).selectExpr(*[f"{e} as {n}" for n, e in (_TRUTH | _META).items()])


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(spark, sf_dir).where("k % 7 <> 0").selectExpr(*[f"{e} as {n}" for n, e in (_PREDICTION | _META).items()])


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("*", f"cast(row_number() over (partition by l_orderkey order by {_GT_ORDER}) as bigint) as k")


BOXES = (
    f"numbered AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_GT_ORDER}) AS k FROM lineitem),\n"
    "truth AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in (_TRUTH | _META).items()) + " FROM numbered),\n"
    "predictions AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in (_PREDICTION | _META).items()) + " FROM numbered WHERE k % 7 <> 0)"
)
PAIRS = (
    BOXES + ",\n"
    """met AS (
  SELECT p.image, p.pred, p.score, g.gt,
         greatest(0.0::DOUBLE, least(p.x2, g.x2) - greatest(p.x1, g.x1)) * greatest(0.0::DOUBLE, least(p.y2, g.y2) - greatest(p.y1, g.y1)) AS both_area,
         (p.x2 - p.x1) * (p.y2 - p.y1) + (g.x2 - g.x1) * (g.y2 - g.y1) AS areas
  FROM predictions p JOIN truth g ON p.image = g.image),
pairs AS (SELECT image, pred, score, gt, both_area / (areas - both_area) AS iou FROM met WHERE both_area > 0)"""
)

_ELLIPSE = {"image": "l_orderkey", "inst": "k", "cx": "50 + cast(l_partkey % 40 as double)", "cy": "50 + cast(l_suppkey % 40 as double)", "a": "5 + l_quantity / 2", "b": "4 + l_quantity / 4"}


def ellipses(spark: SparkSession, sf_dir: str, shifted: bool = False) -> DataFrame:
    out = _numbered(spark, sf_dir).selectExpr(*[f"{e} as {n}" for n, e in _ELLIPSE.items()])
    return out.selectExpr("image", "inst", "cx + 3 as cx", "cy - 2 as cy", "a", "b") if shifted else out


def runs_sql(name: str, shifted: bool = False) -> str:
    cx, cy = ("cx + 3", "cy - 2") if shifted else ("cx", "cy")
    return (
        f"{name}_shapes AS (SELECT image, inst, {cx} AS cx, {cy} AS cy, a, b FROM ellipses),\n"
        f"{name}_lines AS (SELECT *, unnest(range(CAST(floor(cy - b) AS BIGINT), CAST(ceil(cy + b) AS BIGINT) + 1)) AS y FROM {name}_shapes),\n"
        f"{name}_all AS (SELECT image, inst, CAST(y AS INT) AS y, CAST(ceil(cx - a * sqrt(greatest(0.0::DOUBLE, 1 - ((y - cy) / b) * ((y - cy) / b)))) AS INT) AS x0,"
        f" CAST(floor(cx + a * sqrt(greatest(0.0::DOUBLE, 1 - ((y - cy) / b) * ((y - cy) / b)))) AS INT) + 1 AS x1 FROM {name}_lines WHERE abs(y - cy) < b),\n"
        f"{name} AS (SELECT * FROM {name}_all WHERE x1 > x0)"
    )


ELLIPSES = BOXES + ",\nellipses AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _ELLIPSE.items()) + " FROM numbered),\n" + runs_sql("runs")

_FLOW = {"series": "concat('series_', cast(o_custkey % 4 as string))", "shear_rate": "cast(1 + o_orderkey % 300 as double)"}
_STRESS = "(cast(0.2 as double) + cast(0.1 as double) * (o_custkey % 4)) * pow(cast(1 + o_orderkey % 300 as double), cast(0.4 as double) + cast(0.1 as double) * (o_custkey % 4)) * (1 + (o_totalprice - floor(o_totalprice)) * cast(0.01 as double))"


def flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.selectExpr(*[f"{e} as {n}" for n, e in _FLOW.items()], f"{_STRESS} as stress_pa")


FLOW = "flow AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _FLOW.items()) + f", {_STRESS} AS stress_pa FROM orders)"
