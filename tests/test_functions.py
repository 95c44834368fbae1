"""Column functions on hand-computed rows."""

from __future__ import annotations

from math import pi

import pytest
from pyspark.sql import functions as F

from swarmscope.functions import columns, settings, shapes
from swarmscope.functions.calibration import DEFAULT, Calibration


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_calibration():
    assert DEFAULT.mm_per_px == 0.011416015625
    assert DEFAULT.observed_volume_mm3() == pytest.approx(6832.8)
    assert DEFAULT.observed_volume_mm3(10) == pytest.approx(1708.2)
    assert Calibration(depth_mm=1).observed_volume_mm3() == pytest.approx(170.82)


def test_missing_values(spark):
    df = columns.nan_to_null(spark.createDataFrame([(float("nan"), 1), (2.0, 2), (None, 3)], "x double, y int"))
    assert [r["x"] for r in df.orderBy("y").collect()] == [None, 2.0, None]
    assert one(spark, columns.ratio("a", "b"), a=1.0, b=0.0) is None
    assert one(spark, columns.ratio("a", "b", 0.0), a=1.0, b=0.0) == 0.0
    assert one(spark, columns.number(F.col("a")), a="1.5") == 1.5 and one(spark, columns.number(F.col("a")), a="x") is None


def test_settings(spark):
    rows = [("100 rpm  55 lmin 0125 xanthan",), ("75 rpm 90 lmin",), ("no setting",), (None,)]
    got = settings.with_setting_numbers(settings.parse_setting(spark.createDataFrame(rows, "reactor_setting string"))).collect()
    assert (got[0]["rpm"], got[0]["aeration"], got[0]["xanthan"], got[0]["rpm_val"], got[0]["aer_val"]) == ("100 rpm", "55 lmin", "0125 xanthan", 100.0, 55.0)
    assert got[1]["xanthan"] == "" and got[2]["rpm"] is None and got[3]["rpm"] is None
    with pytest.raises(Exception, match="no rpm and lmin"):
        settings.parse_setting(spark.createDataFrame(rows[2:3], "reactor_setting string"), strict=True).collect()


def test_natural_order(spark):
    names = ["img_10.jpg", "img_2.jpg", "IMG_1.jpg", "img_2b.jpg"]
    out = spark.createDataFrame([(n,) for n in names], "n string").orderBy(settings.natural_key("n")).collect()
    assert [r["n"] for r in out] == ["IMG_1.jpg", "img_2.jpg", "img_2b.jpg", "img_10.jpg"]
    assert one(spark, settings.trailing_number("a"), a="placement_12") == 12 and one(spark, settings.trailing_number("a"), a="none") == 0


def test_names(spark):
    assert one(spark, settings.stem("a"), a="x/y.z/file.tar.gz") == "file.tar"
    assert one(spark, settings.extension("a"), a="x/FILE.JPG") == ".jpg"
    assert one(spark, settings.is_image("a"), a="x/FILE.JPEG") and not one(spark, settings.is_image("a"), a="x.txt")
    assert one(spark, settings.number_label("a"), a=3.0) == "3" and one(spark, settings.number_label("a"), a=3.256) == "3.26"


def test_sphere_and_ellipsoid(spark):
    # a ball of radius 1: the axis is 2, both half widths are 1
    v = one(spark, shapes.ellipsoid_volume("a", "b", "c"), a=2.0, b=1.0, c=1.0)
    assert v == pytest.approx(2 * pi / 3)
    assert one(spark, shapes.ellipsoid_volume("a", "b", "c", True), a=2.0, b=1.0, c=1.0) == pytest.approx(4 * pi / 3)
    assert one(spark, shapes.ellipsoid_surface("a", "b", "c"), a=2.0, b=1.0, c=1.0) == pytest.approx(4 * pi)
    assert one(spark, shapes.ellipsoid_surface("a", "b", "c"), a=2.0, b=0.0, c=0.0) == 0
    assert one(spark, shapes.equivalent_diameter("a"), a=pi) == pytest.approx(2)
    assert one(spark, shapes.equivalent_diameter("a"), a=0.0) is None
    assert one(spark, shapes.volume_diameter("a"), a=pi / 6) == pytest.approx(1)


@pytest.mark.parametrize(
    ("eq_px", "near", "d", "fit", "mode", "want"),
    [
        (100.0, False, 1.0, True, "hybrid", "sphere"), (100.1, False, 1.0, True, "hybrid", "asym_ellipsoid"), (200.0, True, 1.0, True, "hybrid", "sphere"),
        (200.0, True, None, True, "hybrid", "asym_ellipsoid"), (200.0, False, 1.0, False, "hybrid", "sphere_fallback"), (200.0, False, 1.0, False, "sphere_only", "sphere"),
        (50.0, True, 1.0, True, "ellipsoid_only", "asym_ellipsoid"), (50.0, True, 1.0, False, "ellipsoid_only", "sphere_fallback"),
    ],
)
def test_model_choice(spark, eq_px, near, d, fit, mode, want):
    assert one(spark, shapes.model_choice(F.lit(eq_px), F.lit(near), F.lit(d).cast("double"), F.lit(fit), mode)) == want


def test_box_iou(spark):
    box = lambda *v: dict(zip(("x1", "y1", "x2", "y2"), map(F.lit, map(float, v)), strict=True))
    assert one(spark, shapes.box_iou(box(0, 0, 2, 2), box(1, 1, 3, 3))) == pytest.approx(1 / 7)
    assert one(spark, shapes.box_iou(box(0, 0, 1, 1), box(2, 2, 3, 3))) == 0
    assert one(spark, shapes.box_iou(box(0, 0, 0, 0), box(0, 0, 0, 0))) == 0


def test_half_ellipse(spark):
    line = one(spark, shapes.half_ellipse(F.lit(1.0), F.lit(2.0), F.lit(3.0), F.lit(1.0), F.lit(0.0), 5))
    assert len(line) == 5 and line[2]["x"] == pytest.approx(4) and line[2]["y"] == pytest.approx(2) and line[0]["y"] == pytest.approx(1)
