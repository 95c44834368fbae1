"""Dataset average precision matches one to one, held against a loop over the predictions."""

from __future__ import annotations

import os

import duckdb
import numpy as np
import pytest

import __spark_entry__
from swarmscope.operators import evaluation
from swarmscope.plans.fixtures import PAIRS

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def curve():
    """Of a threshold: (image, pred), true positives, precision, recall, and precision from each rank on."""
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{SF}/lineitem.parquet'")
    ask = lambda what: con.sql(f"WITH {PAIRS} {what}").fetchall()
    n_gt = ask("SELECT count(*) FROM truth")[0][0]
    entries = ask("SELECT image, pred FROM predictions ORDER BY score DESC, image, pred")
    options = {}
    for image, pred, gt, iou in ask("SELECT image, pred, gt, iou FROM pairs ORDER BY iou DESC, gt"):
        options.setdefault((image, pred), []).append((gt, iou))

    def of(threshold: float):
        used, tp = set(), []
        for image, pred in entries:
            gt = next((g for g, iou in options.get((image, pred), []) if iou >= threshold and (image, g) not in used), None)
            tp.append(gt is not None)
            used.add((image, gt))
        tps = np.cumsum(tp)
        precision = tps / np.arange(1, len(tp) + 1)
        return entries, tps, precision, tps / n_gt, np.maximum.accumulate(precision[::-1])[::-1]

    return of


def ap(curve) -> float:
    _, _, _, recall, later = curve
    return (1 + sum(later[recall >= k * 0.01].max(initial=0.0) for k in range(1, 101))) / 101


def test_curve_at_one_half(spark, curve):
    entries, tps, precision, recall, later = curve(0.5)
    got = sorted(map(tuple, __spark_entry__.queries()["w05_precision_recall"](spark, SF).select("rank", "image", "pred", "tps", "precision", "recall").collect()))
    assert [(r[1:3], r[3]) for r in got] == [(e, t) for e, t in zip(entries, tps, strict=True)]
    np.testing.assert_allclose([r[4:] for r in got], np.stack([precision, recall], axis=1), atol=1e-6)
    got = sorted(map(tuple, __spark_entry__.queries()["w06_envelope"](spark, SF).select("rank", "image", "pred", "envelope").collect()))
    assert [r[1:3] for r in got] == entries
    np.testing.assert_allclose([r[3] for r in got], later, atol=1e-6)


def test_ap_at_all_thresholds(spark, curve):
    want = [ap(curve(t)) for t in evaluation.THRESHOLDS]
    got = sorted(map(tuple, __spark_entry__.queries()["a19_dataset_ap"](spark, SF).select("threshold", "ap").collect()))
    np.testing.assert_allclose([r[1] for r in got], want, atol=1e-6)
    got = __spark_entry__.queries()["a20_map"](spark, SF).first()
    np.testing.assert_allclose([got["ap50"], got["ap75"], got["map50_95"]], [want[0], want[5], np.mean(want)], atol=1e-6)
