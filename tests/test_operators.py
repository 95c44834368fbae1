"""Operators on hand-computed rows and random tables."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from swarmscope.operators import distribution, evaluation, frames, grids, masks, reducers, rheology, rollup
from swarmscope.plans import evaluations

BUBBLES = "placement string, reactor_setting string, replicate string, burst_index int, image_number_in_burst int, model_used string, equivalent_diameter_mm double, bubble_volume_mm3 double, bubble_surface_area_mm2 double"
S = "100 rpm 55 lmin 000 xanthan"


@pytest.fixture(scope="module")
def bubbles(spark):
    rows = [
        ("placement_1", S, "rep_1", 1, 1, "sphere", 1.0, 2.0, 3.0), ("placement_1", S, "rep_1", 1, 2, "sphere_fallback", 3.0, 4.0, 5.0), ("placement_1", S, "rep_2", 1, 1, "asym_ellipsoid", None, 6.0, None),
        ("placement_2", S, "rep_1", 1, 1, "asym_ellipsoid", None, None, None), (None, S, "rep_1", 1, 1, "sphere", 1.0, 1.0, 1.0),
    ]
    return spark.createDataFrame(rows, BUBBLES)


def test_rollup_forms_agree(bubbles):
    got = {r["placement"]: r for r in rollup.setting_ratios(rollup.setting_rollup(bubbles)).collect()}
    one, two = got["placement_1"], got["placement_2"]
    assert set(got) == {"placement_1", "placement_2"}
    assert (one["V_total_mm3"], one["V_sphere_mm3"], one["d_count"], one["n_total"], one["n_sphere"]) == (12.0, 6.0, 2, 3, 2)
    assert one["mean_diameter_mm"] == 2.0 and one["frac_sphere_volume"] == 0.5 and one["frac_sphere_count"] == pytest.approx(2 / 3)
    assert two["V_total_mm3"] == 0.0 and two["mean_diameter_mm"] is None and two["frac_sphere_volume"] is None and two["n_sphere"] == 0
    joined = {r["placement"]: r for r in rollup.sphere_left_join(bubbles).collect()}
    assert all(joined[p]["V_sphere_mm3"] == got[p]["V_sphere_mm3"] and joined[p]["n_sphere"] == got[p]["n_sphere"] for p in got)


def test_frames_sum_to_settings(bubbles):
    frame = rollup.frame_rollup(bubbles).groupBy("placement").agg(F.sum("V_total_mm3").alias("v"), F.sum("n_bubbles_total").alias("n"))
    whole = rollup.setting_rollup(bubbles).select("placement", F.col("V_total_mm3").alias("v"), F.col("n_total").alias("n"))
    assert sorted(map(tuple, frame.collect())) == sorted(map(tuple, whole.collect()))


def test_densities_guard_their_denominators(spark):
    rows = spark.createDataFrame([(0.0, 0.0, 1), (7000.0, 5.0, 2), (100.0, 50.0, 4)], "V_total_mm3 double, A_total_mm2 double, n_total long")
    none, full, some = rollup.densities(rows).collect()
    assert none["a_specific_mm_inv"] is None and none["a_L_mm_inv"] == 0
    assert full["a_L_mm_inv"] is None and full["epsilon_obs"] > 1
    assert some["a_specific_m2_m3"] == 500 and some["n_per_mL"] == pytest.approx(4 / 6.8328) and some["a_L_mm_inv"] == pytest.approx(50 / 6732.8)


@pytest.mark.parametrize(("ordinal", "zero", "plain"), [(0, (1, 1), (0, 1)), (49, (1, 50), (0, 50)), (50, (2, 1), (0, 51))])
def test_bursts(spark, ordinal, zero, plain):
    df = spark.createDataFrame([(S, ordinal), ("100 rpm 55 lmin 025 xanthan", ordinal)], "reactor_setting string, frame_no long")
    got = [(r["burst_index"], r["image_number_in_burst"]) for r in frames.bursts(df).collect()]
    assert got == [zero, plain]


def test_overlays(spark):
    df = spark.range(23).select(F.lit("p").alias("placement"), F.lit("s").alias("reactor_setting"), F.lit("r").alias("replicate"), F.col("id").alias("frame_no"))
    chosen = {m: sorted(r["frame_no"] for r in frames.overlay_sample(df, m).collect()) for m in ("every_10th", "every_5th", "first_only", "first_last", "none", "all")}
    assert chosen["every_10th"] == [0, 10, 20] and chosen["first_last"] == [0, 22] and chosen["none"] == [] and len(chosen["all"]) == 23 and chosen["first_only"] == [0] and len(chosen["every_5th"]) == 5
    with pytest.raises(ValueError, match="unknown overlay"):
        frames.overlay_sample(df, "sometimes")


def test_histogram_equals_numpy(spark):
    x = np.concatenate([np.random.default_rng(1).uniform(-1, 6, 5000), [0.0, 5.0, 5.0, 2.5]])
    df = spark.createDataFrame([(float(v),) for v in x], "x double").withColumn("k", F.lit(1))
    got = {r["bin"]: r["n"] for r in distribution.histogram(df, "x", ["k"], 0, 5, 16).collect()}
    want, _ = np.histogram(x, 16, (0, 5))
    assert [got.get(i, 0) for i in range(16)] == want.tolist()
    shares = [r["frequency"] for r in distribution.histogram(df, "x", ["k"], 0, 5, 16, relative=True).collect()]
    assert sum(shares) == pytest.approx(1)


def test_hdi(spark):
    x = np.sort(np.random.default_rng(2).normal(size=101))
    rows = [("a", float(v)) for v in x] + [("b", 1.0), ("c", None), ("d", 1.0), ("d", 4.0)]
    got = {r["k"]: r for r in distribution.hdi(spark.createDataFrame(rows, "k string, x double"), "x", ["k"]).collect()}
    k = int(np.floor(0.95 * 101))
    i = int(np.argmin(x[k:] - x[:-k]))
    assert (got["a"]["hdi_low"], got["a"]["hdi_high"]) == (x[i], x[i + k])
    assert got["b"]["hdi_low"] is None and "c" not in got and got["d"]["hdi_width"] == 3


def test_ranges_and_ci(spark):
    df = spark.createDataFrame([("p", S, 1.0), ("p", S, 3.0), ("q", S, 2.0)], "placement string, reactor_setting string, x double")
    assert distribution.robust_range(df.where("placement = 'q'"), "x", ["placement"]).first()["vmax"] == pytest.approx(2 + 1e-6)
    ci = {r["placement"]: r for r in grids.mean_ci(df, "x", ["p", "q", "r"], [S]).collect()}
    assert ci["p"]["ci"] == pytest.approx(1.96) and ci["q"]["ci"] == 0 and ci["q"]["n"] == 1 and ci["r"]["mean"] is None and ci["r"]["ci"] == 0


def test_reducers(spark):
    x = np.random.default_rng(3).normal(5, 2, 57)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    want = {"mean": x.mean(), "median": np.median(x), "q05": np.quantile(x, 0.05), "q95": np.quantile(x, 0.95), "std": x.std(ddof=1), "cv": x.std(ddof=1) / x.mean()}
    got = df.agg(*[reducers.reduce_column("x", k).alias(k) for k in want]).first()
    assert all(got[k] == pytest.approx(v) for k, v in want.items())
    assert df.agg(reducers.reduce_column("x", lambda s: float((s**2).sum()))).first()[0] == pytest.approx((x**2).sum())
    with pytest.raises(ValueError, match="unknown reducer"):
        reducers.reduce_column("x", "mode")


def test_masks_of_an_ellipse(spark):
    shape = spark.createDataFrame([(1, 1, 60.0, 50.0, 30.0, 12.0)], "image long, inst long, cx double, cy double, a double, b double")
    runs = masks.ellipse_runs(shape)
    m = masks.moments(runs).first()
    assert m["area"] == pytest.approx(np.pi * 30 * 12, rel=0.015) and (m["cx"], m["cy"]) == (60, 50)
    fit = masks.split_fit(masks.contour(runs), 1.0).first()
    assert fit["a_mm"] == pytest.approx(60, abs=1) and fit["b1_mm"] == pytest.approx(fit["b2_mm"]) and 10 < fit["b2_mm"] <= 12
    assert masks.principal_axis(masks.contour(runs)).first()["angle_deg"] % 180 == pytest.approx(0, abs=1e-6)
    same = masks.mask_iou(runs, runs).first()
    assert same["iou"] == 1 and same["common"] == m["area"]


def test_ellipses_meet_before_their_lines_are_drawn(spark):
    random = np.random.default_rng(5)
    rows = [(i % 7 or None, i, *map(float, random.uniform([20, 20, 0.2, 0.2], [60, 60, 15, 9]).round(2))) for i in range(90)] + [(8, 1, 5.0, 5.0, 2.0, 2.0), (8, 2, 9.0, 5.0, 2.0, 2.0), (8, 3, 5.3, 5.5, 0.1, 0.1)]
    left = spark.createDataFrame(rows, "image long, inst long, cx double, cy double, a double, b double")
    right = left.withColumn("cx", F.col("cx") + 1.5)
    want = masks.mask_iou(masks.ellipse_runs(left), masks.ellipse_runs(right))
    assert sorted(map(tuple, masks.ellipse_iou(left, right).collect())) == sorted(map(tuple, want.collect())) and want.count() > 100
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        plan = evaluations.g16_mask_iou(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(threshold, before)
    # runs are many times the input: only the rows of lineitem are shuffled
    moved = [line for line in plan.splitlines() if "Exchange " in line]
    assert moved and all("hashpartitioning(l_orderkey" in line for line in moved)


def test_axes_and_polygons(spark):
    shape = spark.createDataFrame([(1, 1, 60.0, 50.0, 30.0, 12.0), (1, 2, 60.0, 50.0, 20.0, 20.0)], "image long, inst long, cx double, cy double, a double, b double")
    axes = {r["inst"]: r for r in masks.near_spherical(masks.ellipse_runs(shape)).collect()}
    assert axes[1]["major"] == pytest.approx(60, rel=0.03) and axes[1]["minor"] == pytest.approx(24, rel=0.03) and not axes[1]["near"] and axes[2]["near"]
    triangle = spark.createDataFrame([(1, 1, [(0.9, 0.2), (10.7, 0.1), (0.3, 10.9)])], "image long, inst long, polygon array<struct<x: double, y: double>>")
    runs = {r["y"]: (r["x0"], r["x1"]) for r in masks.polygon_runs(triangle).collect()}
    # the triangle (0, 0), (10, 0), (0, 10): on line y, pixel centres up to x = 10 - y - 0.5
    assert runs == {y: (0, 9 - y) for y in range(9)}
    concave = spark.createDataFrame([(1, 1, [(0.0, 0.0), (9.0, 0.0), (9.0, 6.0), (6.0, 6.0), (6.0, 3.0), (3.0, 3.0), (3.0, 6.0), (0.0, 6.0)])], "image long, inst long, polygon array<struct<x: double, y: double>>")
    assert masks.moments(masks.polygon_runs(concave)).first()["area"] == 45


def greedy(predictions, truth, iou, threshold):
    used, out = set(), {}
    for p in sorted(predictions, key=lambda p: (-p[1], p[0])):
        best = max(((iou[p[0], g], -g) for g in truth if g not in used and iou[p[0], g] >= threshold), default=None)
        out[p[0]] = None if best is None else -best[1]
        used.add(out[p[0]])
    return out


def test_greedy_match_equals_a_loop(spark):
    rng = np.random.default_rng(4)
    pred, pairs, want, truth = [], [], {}, []
    for image in range(25):
        ps = [(p, float(rng.integers(0, 4))) for p in range(int(rng.integers(0, 7)))]
        gs = list(range(int(rng.integers(0, 6))))
        iou = {(p, g): round(float(rng.random()), 1) for p, _ in ps for g in gs}
        pred += [(image, p, s) for p, s in ps]
        truth += [(image, g) for g in gs]
        pairs += [(image, p, dict(ps)[p], g, v) for (p, g), v in iou.items()]
        want |= {(image, p): g for p, g in greedy(ps, gs, iou, 0.5).items()}
    p = spark.createDataFrame(pred, "image long, pred long, score double")
    out = evaluation.greedy_match(spark.createDataFrame(pairs, "image long, pred long, score double, gt long, iou double"), p, 0.5)
    assert {(r["image"], r["pred"]): r["gt"] for r in out.collect()} == want
    kinds = evaluation.unmatched(out, spark.createDataFrame(truth, "image long, gt long")).groupBy("kind").count().collect()
    counts = {r["kind"]: r["count"] for r in kinds}
    hits = sum(v is not None for v in want.values())
    assert counts == {"fp": len(pred) - hits, "fn": len(truth) - hits}


def test_average_precision(spark):
    rng = np.random.default_rng(5)
    flags = [(0, i, float(s), int(t)) for i, (s, t) in enumerate(zip(rng.permutation(60), rng.random(60) < 0.6, strict=True))]
    df = spark.createDataFrame(flags, "image long, pred long, score double, tp int").withColumn("set", F.lit(1))
    n_gt = 50
    got = evaluation.average_precision(evaluation.precision_recall(df, F.lit(n_gt), ["set"]), ["set"]).first()["ap"]
    tps = np.cumsum([t for _, _, _, t in sorted(flags, key=lambda f: -f[2])])
    precision, recall = tps / np.arange(1, 61), tps / n_gt
    want = np.mean([1.0 if k == 0 else max([p for p, r in zip(precision, recall, strict=True) if r >= k * 0.01], default=0.0) for k in range(101)])
    assert got == pytest.approx(want)


def test_rates_and_choice(spark):
    r = evaluation.with_rates(spark.createDataFrame([(0, 0, 0), (3, 1, 2)], "tp long, fp long, fn long")).collect()
    assert (r[0]["precision"], r[0]["recall"], r[0]["f1_score"]) == (0, 0, 0)
    assert (r[1]["precision"], r[1]["recall"]) == (0.75, 0.6) and r[1]["f1_score"] == pytest.approx(2 / 3)
    truth = spark.createDataFrame([(0.0, 0.0, w, w, f) for w, f in ((5.0, 1), (8.87, 0), (40.0, 1), (500.0, 0))], "x1 double, y1 double, x2 double, y2 double, found int")
    assert {x["size_class"]: x["gt_count"] for x in evaluation.size_recall(truth).collect()} == {"tiny": 1, "small": 2, "xlarge": 1}


def test_size_filter(spark):
    df = spark.createDataFrame([(0.22, 0.01), (0.21, 0.01), (0.59, 0.08), (0.60, 0.08)], "score double, area_share double")
    assert sorted(r["score"] for r in evaluation.size_aware_filter(df).collect()) == [0.22, 0.60]


def test_power_law(spark):
    x = np.linspace(0.5, 300, 40)
    rows = [("a", float(g), float(0.37 * g**0.42)) for g in x] + [("b", 1.0, 2.0)]
    df = spark.createDataFrame(rows, "series string, shear_rate double, stress_pa double")
    fit = rheology.power_law_fit(df).collect()
    assert len(fit) == 1 and fit[0]["k"] == pytest.approx(0.37, rel=1e-8) and fit[0]["n"] == pytest.approx(0.42, rel=1e-8) and fit[0]["k_err"] < 1e-6
    curve = rheology.power_law_curve(rheology.power_law_fit(df)).orderBy("i").collect()
    assert len(curve) == 500 and curve[0]["shear_rate"] == 0.5 and curve[-1]["shear_rate"] == pytest.approx(340)


def test_every_bin(spark):
    x = [0.0, 0.1, 2.0, 2.5, 5.0]
    counted = distribution.histogram(spark.createDataFrame([("k", v) for v in x], "k string, x double"), "x", ["k"], 0, 5, 10)
    out = distribution.every_bin(counted, ["k"], 0, 5, 10).orderBy("bin").collect()
    want, edges = np.histogram(x, 10, (0, 5))
    assert [r["n"] for r in out] == want.tolist()
    assert np.allclose([(r["bin_low"], r["bin_high"]) for r in out], np.stack([edges[:-1], edges[1:]], axis=1))


def test_other_overlap(spark):
    spans = "image long, pred long, score double, low double, high double"
    p = spark.createDataFrame([(1, 0, 0.9, 0.0, 4.0), (1, 1, 0.8, 9.0, 10.0)], spans)
    t = spark.createDataFrame([(1, 0, 2.0, 6.0)], "image long, gt long, low double, high double")
    common = lambda a, b: F.greatest(F.lit(0.0), F.least(a["high"], b["high"]) - F.greatest(a["low"], b["low"])) / 6
    found = evaluation.iou_pairs(p, t, common, ("low", "high")).collect()
    assert [(r["pred"], r["gt"]) for r in found] == [(0, 0)] and found[0]["iou"] == pytest.approx(1 / 3)
