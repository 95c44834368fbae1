"""Queries over bubbles: scans, settings, frames, roll-ups, reducers, distributions and grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swarmscope.functions import settings as S
from swarmscope.functions.calibration import DEFAULT
from swarmscope.operators import distribution, frames, grids, reducers, rollup
from swarmscope.plans.fixtures import BUBBLES, bubbles
from swarmscope.plans.registry import query, rounded
from swarmscope.sources.bubbles import where_all
from swarmscope.sources.images import tree_parts
from swarmscope.sources.schema import KEYS
from swarmscope.sources.sinks import pending

W = "WITH " + BUBBLES + "\n"
SPHERES = "model_used IN ('sphere', 'sphere_fallback')"
V_OBS = repr(DEFAULT.observed_volume_mm3())


@query(W + "SELECT placement, reactor_setting, replicate, burst_index, image_number_in_burst, equivalent_diameter_mm, model_used FROM bubbles")
def s04_parquet_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bubbles(spark, sf_dir).select(*KEYS, "equivalent_diameter_mm", "model_used")


@query(W + "SELECT placement, CAST(count(*) AS BIGINT) AS n FROM bubbles WHERE strpos(placement, 'placement_1') > 0 OR strpos(placement, 'ment_2') > 0 GROUP BY placement")
def s05_placement_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("placement")
    return bubbles(spark, sf_dir).where(p.contains("placement_1") | p.contains("ment_2")).groupBy("placement").agg(F.count("*").alias("n"))


@query(W + "SELECT reactor_setting, CAST(count(*) AS BIGINT) AS n FROM bubbles WHERE reactor_setting IN ('100 rpm 55 lmin 000 xanthan', '75 rpm 90 lmin 025 xanthan') GROUP BY reactor_setting")
def s06_setting_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bubbles(spark, sf_dir).where(F.col("reactor_setting").isin("100 rpm 55 lmin 000 xanthan", "75 rpm 90 lmin 025 xanthan")).groupBy("reactor_setting").agg(F.count("*").alias("n"))


@query(W + "SELECT reactor_setting, CAST(count(*) AS BIGINT) AS n, round(sum(bubble_volume_mm3), 4) AS volume FROM bubbles WHERE placement = 'placement_3' GROUP BY reactor_setting")
def s07_single_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bubbles(spark, sf_dir).where("placement = 'placement_3'").groupBy("reactor_setting")
    return rounded(out.agg(F.count("*").alias("n"), F.sum("bubble_volume_mm3").alias("volume")), 4)


@query(W + """SELECT placement, replicate, model_used, equivalent_diameter_mm FROM bubbles
WHERE equivalent_diameter_mm >= 2 AND equivalent_diameter_mm < 4 AND placement <> 'placement_2' AND replicate IN ('rep_1', 'rep_2') AND model_used NOT IN ('sphere')""")
def s08_tuple_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    filters = [("equivalent_diameter_mm", ">=", 2.0), ("equivalent_diameter_mm", "<", 4.0), ("placement", "!=", "placement_2"), ("replicate", "in", ["rep_1", "rep_2"]), ("model_used", "not in", ["sphere"])]
    return where_all(bubbles(spark, sf_dir), filters).select("placement", "replicate", "model_used", "equivalent_diameter_mm")


@query("""SELECT page_id, regexp_extract(url, '([^/]+)$', 1) AS filename FROM pages WHERE regexp_matches(lower(url), '\\.(jpg|jpeg|png|html)$')""")
def s02_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.where(S.extension("url").isin(".jpg", ".jpeg", ".png", ".html")).select("page_id", F.regexp_extract("url", "([^/]+)$", 1).alias("filename"))


NAMES = "names AS (SELECT DISTINCT placement, reactor_setting, replicate, concat('img_', CAST(frame_no AS VARCHAR), '.jpg') AS filename FROM bubbles)"


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bubbles(spark, sf_dir).select("placement", "reactor_setting", "replicate", F.concat(F.lit("img_"), F.col("frame_no").cast("string"), F.lit(".jpg")).alias("filename")).distinct()


@query(W + ", " + NAMES + " SELECT placement, reactor_setting, replicate, filename FROM names")
def s01_tree_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = names(spark, sf_dir).select(F.concat_ws("/", F.lit("file:/images"), *[F.replace(c, F.lit(" "), F.lit("%20")) for c in ("placement", "reactor_setting", "replicate", "filename")]).alias("path"))
    return tree_parts(paths).drop("path")


@query(W + """SELECT DISTINCT reactor_setting, concat(rpm_no, ' rpm') AS rpm, concat(aer_no, ' lmin') AS aeration, concat(xan_no, ' xanthan') AS xanthan,
CAST(rpm_no AS DOUBLE) AS rpm_val, CAST(aer_no AS DOUBLE) AS aer_val FROM bubbles""")
def f01_parse_setting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.with_setting_numbers(S.parse_setting(bubbles(spark, sf_dir).select("reactor_setting").distinct()))


FILES = ["place_3_0-00-xanthan_100_rpm_55_l_min_a.jpg", "Placement-12-0-125-xanthan-75rpm-90lmin.png", "x_1-5-xanthan_125-rpm_45-l-min.jpg", "nothing.jpg", "place-2_0-0-xanthan_75rpm.png", "p_0-250-xanthan_90-lmin.png", "PLACEMENT7_0-25-XANTHAN_150RPM_70LMIN.jpeg"]
FILE_VALUES = "files(filename) AS (VALUES " + ", ".join(f"('{f}')" for f in FILES) + ")"


@query("WITH " + FILE_VALUES + r""", parts AS (SELECT filename, nullif(regexp_extract(filename, '(?i)(\d+)-(\d+)-xanthan', 1), '') AS w, nullif(regexp_extract(filename, '(?i)(\d+)-(\d+)-xanthan', 2), '') AS d FROM files)
SELECT filename, coalesce('place_' || nullif(regexp_extract(filename, '(?i)place(?:ment)?[_-]?(\d+)', 1), ''), 'unknown') AS placement,
CASE WHEN w IS NULL THEN 'unknown' WHEN CAST(w || '.' || d AS DOUBLE) = 0 THEN '0.00' WHEN CAST(w || '.' || d AS DOUBLE) = 0.125 THEN '0.125' WHEN CAST(w || '.' || d AS DOUBLE) = 0.25 THEN '0.25' ELSE printf('%.3f', CAST(w || '.' || d AS DOUBLE)) END AS xanthan,
TRY_CAST(nullif(regexp_extract(filename, '(?i)(\d+)[_-]?rpm', 1), '') AS INT) AS rpm, TRY_CAST(nullif(regexp_extract(filename, '(?i)(\d+)[_-]?l[_-]?min', 1), '') AS INT) AS lmin FROM parts""")
def f03_parse_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.file_metadata(spark.createDataFrame([(f,) for f in FILES], "filename string"))


@query(W + r"""SELECT DISTINCT placement, reactor_setting, concat('position ', regexp_extract(placement, '(\d+)$', 1)) AS position,
concat(CASE xan_no WHEN '000' THEN '0.00' WHEN '0125' THEN '0.125' ELSE '0.25' END, ' wt%') AS weight, replace(reactor_setting, ' ', '_') AS safe,
CASE WHEN CAST(rpm_no AS DOUBLE) / 50 = floor(CAST(rpm_no AS DOUBLE) / 50) THEN CAST(CAST(rpm_no AS INT) // 50 AS VARCHAR) ELSE printf('%.2f', CAST(rpm_no AS DOUBLE) / 50) END AS figure FROM bubbles""")
def f05_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = S.with_setting_numbers(bubbles(spark, sf_dir).select("placement", "reactor_setting").distinct())
    return df.select("placement", "reactor_setting", S.placement_label("placement").alias("position"), S.weight_label("xanthan").alias("weight"), S.safe_name("reactor_setting").alias("safe"), S.number_label(F.col("rpm_val") / 50).alias("figure"))


@query("""WITH n(filename) AS (VALUES ('placement_1_a b_rep_2.csv'), ('placement_10_x_rep_11.csv'), ('other.csv'))
SELECT filename, CASE WHEN filename = 'other.csv' THEN NULL ELSE regexp_extract(filename, '^(placement_[0-9]+)_(.+)_(rep_[0-9]+)[.]csv$', 1) END AS placement,
CASE WHEN filename = 'other.csv' THEN NULL ELSE regexp_extract(filename, '^(placement_[0-9]+)_(.+)_(rep_[0-9]+)[.]csv$', 2) END AS setting,
CASE WHEN filename = 'other.csv' THEN NULL ELSE regexp_extract(filename, '^(placement_[0-9]+)_(.+)_(rep_[0-9]+)[.]csv$', 3) END AS replicate FROM n""")
def s17_legacy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.legacy_file_parts(spark.createDataFrame([("placement_1_a b_rep_2.csv",), ("placement_10_x_rep_11.csv",), ("other.csv",)], "filename string"))


ORDINALS = NAMES + ", ordered AS (SELECT *, CAST(row_number() OVER (PARTITION BY placement, reactor_setting, replicate ORDER BY CAST(regexp_extract(filename, '(\\d+)', 1) AS INT)) - 1 AS BIGINT) AS frame_no FROM names)"


@query(W + ", " + ORDINALS + " SELECT * FROM ordered")
def w01_frame_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.frame_ordinals(names(spark, sf_dir))


@query(W + ", " + ORDINALS + " SELECT placement, reactor_setting, replicate, filename, frame_no FROM ordered")
def t01_natural_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.frame_ordinals(names(spark, sf_dir))


@query(W + ", " + ORDINALS + """ SELECT *, CAST(CASE WHEN contains(reactor_setting, '000 xanthan') THEN frame_no // 50 + 1 ELSE 0 END AS INT) AS burst_index,
CAST(CASE WHEN contains(reactor_setting, '000 xanthan') THEN frame_no % 50 + 1 ELSE frame_no + 1 END AS INT) AS image_number_in_burst FROM ordered""")
def w02_burst_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.bursts(w01_frame_ordinal(spark, sf_dir))


@query(W + ", " + ORDINALS + " SELECT * FROM ordered WHERE frame_no % 10 = 0")
def p15_overlay_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.overlay_sample(w01_frame_ordinal(spark, sf_dir), "every_10th")


@query(W + "SELECT CASE WHEN contains(lower(reactor_setting), '000 xanthan') THEN 1 ELSE 0 END AS zero, CAST(count(*) AS BIGINT) AS n FROM bubbles GROUP BY 1")
def p16_zero_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bubbles(spark, sf_dir).groupBy(F.when(S.is_zero_concentration("reactor_setting"), 1).otherwise(0).alias("zero")).agg(F.count("*").alias("n"))


@query(W + "SELECT placement, CAST(regexp_extract(placement, '([0-9]+)$', 1) AS BIGINT) AS number, CAST(row_number() OVER (ORDER BY CAST(regexp_extract(placement, '([0-9]+)$', 1) AS INT) DESC) AS BIGINT) AS place FROM (SELECT DISTINCT placement FROM bubbles)")
def t03_placement_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    df = bubbles(spark, sf_dir).select("placement").distinct().withColumn("number", S.trailing_number("placement"))
    return df.withColumn("place", F.row_number().over(Window.orderBy(F.col("number").desc())).cast("long"))


@query(W + "SELECT xan_no, CAST(CASE xan_no WHEN '025' THEN 1 WHEN '000' THEN 2 ELSE 3 END AS BIGINT) AS place FROM (SELECT DISTINCT xan_no FROM bubbles)")
def t04_soft_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bubbles(spark, sf_dir).select("xan_no").distinct().withColumn("place", S.preference("xan_no", ["025", "000"]).cast("long"))


ROLL = f"""coalesce(sum(bubble_volume_mm3), 0) AS "V_total_mm3", coalesce(sum(bubble_volume_mm3) FILTER ({SPHERES}), 0) AS "V_sphere_mm3",
coalesce(sum(bubble_surface_area_mm2), 0) AS "A_total_mm2", coalesce(sum(bubble_surface_area_mm2) FILTER ({SPHERES}), 0) AS "A_sphere_mm2",
coalesce(sum(equivalent_diameter_mm), 0) AS d_sum_mm, CAST(count(equivalent_diameter_mm) AS BIGINT) AS d_count, CAST(count(*) AS BIGINT) AS n_total, CAST(count(*) FILTER ({SPHERES}) AS BIGINT) AS n_sphere"""
SETTING = f"setting AS (SELECT placement, reactor_setting, {ROLL} FROM bubbles GROUP BY placement, reactor_setting)"
FRAME = f"frame AS (SELECT placement, reactor_setting, replicate, burst_index, image_number_in_burst, {ROLL} FROM bubbles GROUP BY ALL)"
SUMS = 'round("V_total_mm3", 6) AS "V_total_mm3", round("V_sphere_mm3", 6) AS "V_sphere_mm3", round("A_total_mm2", 6) AS "A_total_mm2", round("A_sphere_mm2", 6) AS "A_sphere_mm2"'
RATIOS = """round(d_sum_mm / d_count, 6) AS mean_diameter_mm, round(n_sphere / n_total, 6) AS frac_sphere_count, round("V_sphere_mm3" / nullif("V_total_mm3", 0), 6) AS frac_sphere_volume, round("A_sphere_mm2" / nullif("A_total_mm2", 0), 6) AS frac_sphere_surface"""


@query(W + ", " + SETTING + f" SELECT placement, reactor_setting, {SUMS}, round(d_sum_mm, 6) AS d_sum_mm, d_count, n_total, n_sphere FROM setting")
def a01_setting_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rollup.setting_rollup(bubbles(spark, sf_dir)))


@query(W + ", " + SETTING + f" SELECT placement, reactor_setting, {RATIOS} FROM setting")
def a02_setting_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rollup.setting_ratios(rollup.setting_rollup(bubbles(spark, sf_dir)))
    return rounded(out.select("placement", "reactor_setting", "mean_diameter_mm", "frac_sphere_count", "frac_sphere_volume", "frac_sphere_surface"))


@query(W + f""", t AS (SELECT placement, reactor_setting, sum(bubble_volume_mm3) AS v, count(*) AS n FROM bubbles GROUP BY ALL), s AS (SELECT placement, reactor_setting, sum(bubble_volume_mm3) AS v, count(*) AS n FROM bubbles WHERE {SPHERES} GROUP BY ALL)
SELECT t.placement, t.reactor_setting, round(t.v, 6) AS "V_total_mm3", CAST(t.n AS BIGINT) AS n_total, round(coalesce(s.v, 0), 6) AS "V_sphere_mm3", CAST(coalesce(s.n, 0) AS BIGINT) AS n_sphere FROM t LEFT JOIN s USING (placement, reactor_setting)""")
def j01_sphere_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rollup.sphere_left_join(bubbles(spark, sf_dir)))


@query(W + ", " + FRAME + f""" SELECT placement, reactor_setting, replicate, burst_index, image_number_in_burst, {SUMS}, round(d_sum_mm, 6) AS diameter_sum_mm, d_count AS diameter_count, n_total AS n_bubbles_total, n_sphere AS n_bubbles_sphere, {RATIOS} FROM frame""")
def a03_frame_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rollup.frame_rollup(bubbles(spark, sf_dir)))


def density_sql(count: str, name: str) -> str:
    v, a = '"V_total_mm3"', '"A_total_mm2"'
    liquid = f"({V_OBS} - {v})"
    return f"""round({v} / {V_OBS}, 9) AS epsilon_obs, round({a} / {V_OBS} * 1000, 6) AS a_obs_m2_m3, round({count} / ({V_OBS} / 1000), 6) AS {name},
round(CASE WHEN {v} > 0 THEN {a} / {v} END * 1000, 6) AS a_specific_m2_m3, round({liquid} / 1000, 6) AS "V_liquid_mL", round(CASE WHEN {liquid} > 0 THEN {a} / {liquid} END * 1000, 4) AS "a_L_m2_m3" """


def _densities(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    r = lambda c, d: F.round(c, d).alias(c)
    return df.select(*keys, r("epsilon_obs", 9), r("a_obs_m2_m3", 6), r(name, 6), r("a_specific_m2_m3", 6), r("V_liquid_mL", 6), r("a_L_m2_m3", 4))


@query(W + ", " + SETTING + " SELECT placement, reactor_setting, " + density_sql("n_total", '"n_per_mL"') + " FROM setting")
def g12_setting_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _densities(rollup.densities(rollup.setting_rollup(bubbles(spark, sf_dir))), rollup.SETTING_KEYS, "n_per_mL")


def frame_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frame-level table: roll-up, densities and setting numbers, one aggregation and projections."""
    out = rollup.densities(rollup.frame_rollup(bubbles(spark, sf_dir)), "n_bubbles_total", "n_bubbles_per_mL")
    return S.with_setting_numbers(out)


@query(W + ", " + FRAME + " SELECT placement, reactor_setting, replicate, burst_index, image_number_in_burst, " + density_sql("n_total", '"n_bubbles_per_mL"') + " FROM frame")
def g13_frame_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _densities(frame_table(spark, sf_dir), rollup.FRAME_KEYS, "n_bubbles_per_mL")


FRAMES = FRAME + f""", frames AS (SELECT *, "V_total_mm3" / {V_OBS} AS epsilon_obs, d_sum_mm / d_count AS mean_diameter_mm, CAST(split_part(reactor_setting, ' ', 1) AS DOUBLE) AS rpm_val, CAST(split_part(reactor_setting, ' ', 3) AS DOUBLE) AS aer_val,
concat(split_part(reactor_setting, ' ', 5), ' xanthan') AS xanthan FROM frame)"""


@query(W + ", " + FRAMES + " SELECT placement, xanthan, rpm_val, aer_val, round(avg(epsilon_obs), 9) AS epsilon_obs_mean FROM frames GROUP BY ALL")
def a04_grid_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reducers.grid_aggregate(frame_table(spark, sf_dir), "epsilon_obs"), 9)


NAMED = ["mean", "median", "q05", "q25", "q75", "q95", "std", "cv"]


@query(W + ", " + FRAMES + """ SELECT placement, reactor_setting, round(avg(mean_diameter_mm), 6) AS mean, round(median(mean_diameter_mm), 6) AS median, round(quantile_cont(mean_diameter_mm, 0.05), 6) AS q05, round(quantile_cont(mean_diameter_mm, 0.25), 6) AS q25,
round(quantile_cont(mean_diameter_mm, 0.75), 6) AS q75, round(quantile_cont(mean_diameter_mm, 0.95), 6) AS q95, round(stddev_samp(mean_diameter_mm), 6) AS std, round(stddev_samp(mean_diameter_mm) / nullif(avg(mean_diameter_mm), 0), 6) AS cv FROM frames GROUP BY ALL""")
def a05_reducers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = frame_table(spark, sf_dir).groupBy("placement", "reactor_setting").agg(*[reducers.reduce_column("mean_diameter_mm", n).alias(n) for n in NAMED])
    return rounded(out)


@query(W + ", " + FRAMES + " SELECT placement, reactor_setting, round(median(epsilon_obs), 9) AS epsilon_obs FROM frames GROUP BY ALL")
def a06_setting_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reducers.setting_reduce(frame_table(spark, sf_dir), "epsilon_obs", "median"), 9)


@query(W + "SELECT placement, round(max(equivalent_diameter_mm) - min(equivalent_diameter_mm), 6) AS spread FROM bubbles GROUP BY placement")
def x01_custom_reducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bubbles(spark, sf_dir).groupBy("placement").agg(reducers.reduce_column("equivalent_diameter_mm", lambda x: float(x.max() - x.min())).alias("spread")))


@query(W + "SELECT reactor_setting, burst_index, round(avg(confidence), 6) AS mean_confidence FROM bubbles GROUP BY ALL")
def a07_burst_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rollup.burst_confidence(bubbles(spark, sf_dir)))


@query(W + "SELECT placement, reactor_setting, CAST(count(equivalent_diameter_mm) AS BIGINT) AS count, round(avg(equivalent_diameter_mm), 6) AS mean, round(median(equivalent_diameter_mm), 6) AS median, round(stddev_samp(equivalent_diameter_mm), 6) AS std FROM bubbles GROUP BY ALL")
def a08_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rollup.summary(bubbles(spark, sf_dir)))


CI_PLACEMENTS = ["placement_1", "placement_2", "placement_9"]
CI_SETTINGS = ["100 rpm 55 lmin 000 xanthan", "75 rpm 45 lmin 0125 xanthan", "150 rpm 90 lmin 025 xanthan"]


@query(W + ", " + FRAMES + ", p(placement) AS (VALUES " + ", ".join(f"('{p}')" for p in CI_PLACEMENTS) + "), s(reactor_setting) AS (VALUES " + ", ".join(f"('{s}')" for s in CI_SETTINGS) + """),
m AS (SELECT placement, reactor_setting, avg(epsilon_obs) AS mean, stddev_samp(epsilon_obs) AS sd, count(epsilon_obs) AS n FROM frames GROUP BY ALL)
SELECT placement, reactor_setting, round(mean, 9) AS mean, round(coalesce(1.96 * sd / sqrt(n), 0), 9) AS ci, CAST(coalesce(n, 0) AS BIGINT) AS n FROM p CROSS JOIN s LEFT JOIN m USING (placement, reactor_setting)""")
def a09_mean_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(grids.mean_ci(frame_table(spark, sf_dir), "epsilon_obs", CI_PLACEMENTS, CI_SETTINGS), 9)


BINS = W + ", binned AS (SELECT placement, CAST(least(floor((equivalent_diameter_mm - 0.5) / (4.5 - 0.5) * 40), 39) AS INT) AS bin FROM bubbles WHERE equivalent_diameter_mm >= 0.5 AND equivalent_diameter_mm <= 4.5), counted AS (SELECT placement, bin, count(*) AS n FROM binned GROUP BY ALL)"


@query(BINS + " SELECT placement, bin, CAST(n AS BIGINT) AS n FROM counted")
def a10_histogram_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distribution.histogram(bubbles(spark, sf_dir), "equivalent_diameter_mm", ["placement"], 0.5, 4.5, 40)


@query(BINS + " SELECT placement, bin, round(n / sum(n) OVER (PARTITION BY placement), 9) AS frequency FROM counted")
def a10_histogram_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(distribution.histogram(bubbles(spark, sf_dir), "equivalent_diameter_mm", ["placement"], 0.5, 4.5, 40, relative=True), 9)


def stats_sql(frame: str) -> str:
    return W + f""", s AS (SELECT placement, reactor_setting, min(equivalent_diameter_mm) AS low, max(equivalent_diameter_mm) AS high, avg(equivalent_diameter_mm) AS mean, count(equivalent_diameter_mm) AS n, count(DISTINCT ({frame})) AS n_frames FROM bubbles GROUP BY ALL)
SELECT placement, reactor_setting, low, high, round(mean, 6) AS mean, CAST(n AS BIGINT) AS n, CAST(n_frames AS BIGINT) AS n_frames, round(n / n_frames, 6) AS bubbles_per_frame FROM s"""


@query(stats_sql("burst_index, image_number_in_burst"))
def a11_distribution_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(distribution.distribution_stats(bubbles(spark, sf_dir), "equivalent_diameter_mm", ["placement", "reactor_setting"]))


@query(stats_sql("burst_index, image_number_in_burst, replicate"))
def a12_distinct_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(distribution.distribution_stats(bubbles(spark, sf_dir), "equivalent_diameter_mm", ["placement", "reactor_setting"], with_replicate=True))


@query(W + "SELECT min(equivalent_diameter_mm) AS low, round(quantile_cont(equivalent_diameter_mm, 0.998), 6) AS high FROM bubbles")
def a13_global_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(distribution.global_range(bubbles(spark, sf_dir), "equivalent_diameter_mm", 0.998))


@query(W + ", " + FRAMES + " SELECT placement, round(quantile_cont(epsilon_obs, 0.05), 9) AS vmin, round(quantile_cont(epsilon_obs, 0.95), 9) AS vmax FROM frames GROUP BY placement")
def a14_robust_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(distribution.robust_range(frame_table(spark, sf_dir), "epsilon_obs", ["placement"]), 9)


@query(W + ", " + FRAMES + " SELECT round(min(epsilon_obs), 9) AS vmin, round(max(epsilon_obs), 9) AS vmax FROM frames")
def a15_finite_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(distribution.finite_range(frame_table(spark, sf_dir), "epsilon_obs"), 9)


LEVELS = ["000 xanthan", "0125 xanthan", "025 xanthan"]


@query(W + """, d AS (SELECT DISTINCT concat(rpm_no, ' rpm') AS rpm, concat(aer_no, ' lmin') AS aeration, concat(xan_no, ' xanthan') AS x FROM bubbles)
SELECT rpm, aeration, array_to_string(list_sort(list(x)), ',') AS levels FROM d GROUP BY ALL HAVING count(*) >= 2""")
def a27_xanthan_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = S.parse_setting(bubbles(spark, sf_dir).select("reactor_setting").distinct())
    return grids.xanthan_groups(parsed, LEVELS).withColumn("levels", F.concat_ws(",", "levels"))


@query(W + "SELECT count(DISTINCT placement) AS kinds, CAST(count(placement) AS BIGINT) AS n, round(count(DISTINCT placement) / count(placement), 9) AS share FROM bubbles")
def a28_distinct_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bubbles(spark, sf_dir).agg(F.count_distinct("placement").alias("kinds"), F.count("placement").alias("n"))
    return rounded(out.withColumn("share", F.col("kinds") / F.col("n")), 9)


@query(W + ", " + FRAMES + """, g AS (SELECT placement, xanthan, rpm_val, aer_val, avg(epsilon_obs) AS v FROM frames GROUP BY ALL), axis(aer_val) AS (VALUES (45.0::DOUBLE), (55.0), (70.0), (80.0), (90.0)), k AS (SELECT DISTINCT placement, xanthan FROM g)
SELECT k.placement, k.xanthan, axis.aer_val, round(max(v) FILTER (rpm_val = 75), 9) AS rpm_75, round(max(v) FILTER (rpm_val = 100), 9) AS rpm_100, round(max(v) FILTER (rpm_val = 125), 9) AS rpm_125, round(max(v) FILTER (rpm_val = 150), 9) AS rpm_150
FROM k CROSS JOIN axis LEFT JOIN g ON g.placement = k.placement AND g.xanthan = k.xanthan AND g.aer_val = axis.aer_val GROUP BY ALL""")
def a29_pivot_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = reducers.grid_aggregate(frame_table(spark, sf_dir), "epsilon_obs")
    return rounded(grids.pivot_grid(grid, "epsilon_obs_mean", [75, 100, 125, 150], [45, 55, 70, 80, 90], ["placement", "xanthan"]), 9)


@query(W + "SELECT count(DISTINCT rpm_no) > 1 AS rpm_varies, count(DISTINCT aer_no) > 1 AS aeration_varies, count(DISTINCT xan_no) > 1 AS xanthan_varies FROM bubbles WHERE rpm_no = '100'")
def a30_varying_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.varying_parts(S.parse_setting(bubbles(spark, sf_dir).where("rpm_no = '100'").select("reactor_setting").distinct()))


@query(W + ", " + FRAMES + """ SELECT f.placement, f.reactor_setting, round(f.v, 9) AS epsilon_obs, m.rpm_no FROM (SELECT placement, reactor_setting, avg(epsilon_obs) AS v FROM frames GROUP BY ALL) f
LEFT JOIN (SELECT DISTINCT placement, reactor_setting, rpm_no FROM bubbles) m USING (placement, reactor_setting)""")
def j02_meta_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = reducers.setting_reduce(frame_table(spark, sf_dir), "epsilon_obs")
    meta = bubbles(spark, sf_dir).select("placement", "reactor_setting", "rpm_no")
    return rounded(grids.with_meta(values, meta, ["placement", "reactor_setting"]), 9)


DIMENSION = [("000 xanthan", 75.0, 1.5), ("000 xanthan", 100.0, 2.5), ("025 xanthan", 150.0, 9.5)]


@query(W + ", d(xanthan, rpm_val, visc) AS (VALUES " + ", ".join(f"('{x}', {r}::DOUBLE, {v}::DOUBLE)" for x, r, v in DIMENSION) + "), s AS (SELECT DISTINCT concat(xan_no, ' xanthan') AS xanthan, CAST(rpm_no AS DOUBLE) AS rpm_val FROM bubbles) SELECT xanthan, rpm_val, coalesce(visc, -1) AS visc FROM s LEFT JOIN d USING (xanthan, rpm_val)")
def j03_dimension_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = S.with_setting_numbers(bubbles(spark, sf_dir).select("reactor_setting").distinct()).select("xanthan", "rpm_val").distinct()
    return grids.lookup(settings, spark.createDataFrame(DIMENSION, "xanthan string, rpm_val double, visc double"), ["xanthan", "rpm_val"], "visc", -1.0)


@query(W + """, r AS (SELECT placement, equivalent_diameter_mm AS x, row_number() OVER (PARTITION BY placement ORDER BY equivalent_diameter_mm) AS rn, count(*) OVER (PARTITION BY placement) AS n FROM bubbles),
s AS (SELECT a.placement, a.x AS lo, b.x AS hi, a.rn, row_number() OVER (PARTITION BY a.placement ORDER BY b.x - a.x, a.rn) AS best FROM r a JOIN r b ON a.placement = b.placement AND b.rn = a.rn + CAST(floor(0.95 * a.n) AS BIGINT))
SELECT placement, lo AS hdi_low, hi AS hdi_high, round(hi - lo, 9) AS hdi_width FROM s WHERE best = 1""")
def w08_hdi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(distribution.hdi(bubbles(spark, sf_dir), "equivalent_diameter_mm", ["placement"]), 9)


@query(W + "SELECT placement, replicate, CAST(count(*) AS BIGINT) AS n FROM (SELECT * FROM bubbles WHERE burst_index = 0 UNION ALL SELECT * FROM bubbles WHERE burst_index > 2) GROUP BY ALL")
def u01_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bubbles(spark, sf_dir)
    return b.where("burst_index = 0").unionByName(b.where("burst_index > 2"), allowMissingColumns=True).groupBy("placement", "replicate").agg(F.count("*").alias("n"))


@query(W + "SELECT DISTINCT placement, reactor_setting, replicate FROM bubbles")
def u03_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bubbles(spark, sf_dir).select("placement", "reactor_setting", "replicate").distinct()


@query(W + "SELECT placement, reactor_setting FROM bubbles EXCEPT SELECT placement, reactor_setting FROM bubbles WHERE burst_index > 0")
def u04_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bubbles(spark, sf_dir)
    return b.select("placement", "reactor_setting").subtract(b.where("burst_index > 0").select("placement", "reactor_setting"))


@query(W + "SELECT DISTINCT placement, reactor_setting, replicate FROM bubbles WHERE NOT (placement IN ('placement_1', 'placement_2') AND replicate = 'rep_1')")
def j08_worklist_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = u03_distinct(spark, sf_dir)
    return pending(work, work.where("placement IN ('placement_1', 'placement_2') AND replicate = 'rep_1'"))
