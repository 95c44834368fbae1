"""Sources, sinks, work lists and the incremental ingest."""

from __future__ import annotations

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from swarmscope.sources import bubbles, images, labels, sinks
from swarmscope.sources.schema import BUBBLE, KEYS
from swarmscope.streaming.ingest import ingest, running_rollup, stream_bubbles


def rows(spark, placement="placement_1", replicate="rep 1", n=3):
    base = spark.range(n).select(F.lit(placement).alias("placement"), F.lit("100 rpm 55 lmin 000 xanthan").alias("reactor_setting"), F.lit(replicate).alias("replicate"), F.col("id").cast("int").alias("image_number_in_burst"))
    values = {"burst_index": F.lit(1), "d_mm_chosen": F.when(F.col("image_number_in_burst") == 0, float("nan")).otherwise(1.5), "volume_mm3_chosen": F.lit(2.0), "surface_area_mm2_chosen": F.lit(3.0), "model_used": F.lit("sphere"), "image": F.lit("a.jpg")}
    have = base.withColumns(values)
    return have.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in have.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in BUBBLE.fields])


def test_write_and_scan(spark, tmp_path):
    path = str(tmp_path / "bubbles")
    sinks.write_bubbles(rows(spark).withColumn("mask", F.lit("x")), path)
    sinks.write_bubbles(rows(spark, "placement_10"), path)
    found = bubbles.scan_bubbles(spark, path, ["d_mm_chosen"])
    assert found.columns == [*KEYS, "d_mm_chosen"] and found.count() == 6 and found.where("d_mm_chosen IS NULL").count() == 2
    assert bubbles.scan_placement(spark, path, "placement_1").count() == 3
    assert bubbles.scan_bubbles(spark, path, filters=[("d_mm_chosen", ">", 1.0), ("placement", "in", ["placement_10"])]).count() == 2
    assert bubbles.scan_bubbles(spark, path, settings=["other"]).count() == 0
    plan = bubbles.scan_bubbles(spark, path, ["d_mm_chosen"], placements=["placement_1"])._jdf.queryExecution().executedPlan().toString()
    assert "In(placement" in plan or "EqualTo(placement" in plan
    assert "mask_area" not in plan.split("ReadSchema")[1]
    table = bubbles.bubble_table(bubbles.scan_bubbles(spark, path))
    assert "equivalent_diameter_mm" in table.columns
    with pytest.raises(KeyError):
        bubbles.scan_bubbles(spark, path, ["nothing"])
    with pytest.raises(ValueError, match="unknown operator"):
        bubbles.predicate(("a", "~", 1))


def test_placement_by_file_name(spark, tmp_path):
    for p in ("placement_1", "placement_10", "placement_2"):
        rows(spark, p).coalesce(1).write.parquet(str(tmp_path / p))
        for f in (tmp_path / p).glob("part-*.parquet"):
            f.rename(tmp_path / f"{p}.parquet")
        for f in (tmp_path / p).glob(".*crc"):
            f.unlink()
    found = bubbles.scan_bubbles(spark, str(tmp_path), placements=["placement_1"], by_file_name=True)
    assert {r["placement"] for r in found.select("placement").distinct().collect()} == {"placement_1", "placement_10"}


def test_csv_json_and_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "x int, y string").withColumn("z", F.struct(F.lit(1).alias("q")))
    sinks.write_table(df, str(tmp_path / "t"))
    sinks.write_json(df, str(tmp_path / "j"))
    sinks.write_csv(df.drop("z"), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1
    assert spark.read.json(str(tmp_path / "j")).first()["z"]["q"] == 1
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first()["y"] == "a"
    assert sinks.as_json(df).first()["json"] == '{"x":1,"y":"a","z":{"q":1}}'


def test_pending_and_stale(spark, tmp_path):
    work = spark.createDataFrame([("p", "s", "r1"), ("p", "s", "r2")], ", ".join(f"{k} string" for k in sinks.PARTS))
    assert [r["replicate"] for r in sinks.pending(work, work.where("replicate = 'r1'")).collect()] == ["r2"]
    source, derived = str(tmp_path / "s"), str(tmp_path / "d")
    work.write.parquet(source)
    assert sinks.is_stale(spark, source, derived)
    work.write.parquet(derived)
    assert not sinks.is_stale(spark, source, derived) and sinks.is_stale(spark, source, derived, force=True)
    import os

    for f in (tmp_path / "s").glob("*.parquet"):
        os.utime(f, (2_000_000_000, 2_000_000_000))
    assert sinks.is_stale(spark, source, derived)


def png(width: int, height: int, grey: int) -> bytes:
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = b"".join(b"\0" + bytes([grey]) * width for _ in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def test_pictures_and_detector(spark, tmp_path):
    for name, data in {"b.png": png(4, 3, 9), "zero.png": png(4, 3, 0), "junk.png": b"junk", "note.txt": b"x"}.items():
        at = tmp_path / "placement_1" / "100 rpm 55 lmin 000 xanthan" / "rep_1"
        at.mkdir(parents=True, exist_ok=True)
        (at / name).write_bytes(data)
    found = images.scan_images(spark, str(tmp_path))
    assert {(r["placement"], r["reactor_setting"], r["filename"]) for r in found.collect()} == {("placement_1", "100 rpm 55 lmin 000 xanthan", f) for f in ("b.png", "zero.png", "junk.png")}
    assert [r["filename"] for r in images.scan_decoded(spark, str(tmp_path)).collect()] == ["b.png"]

    zero = png(4, 3, 0)

    def load():
        def detector(content: bytes) -> list[dict]:
            if content == b"junk":
                raise ValueError("no picture")
            return [{"score": 0.5, "runs": [(0, 0, 2), (1, 0, 2)]}] * (content != zero)

        return detector

    got = {r["filename"]: r for r in images.detect(found, load).collect()}
    assert got["b.png"]["score"] == 0.5 and got["b.png"]["runs"][1]["x1"] == 2 and got["b.png"]["inst"] == 0
    assert got["zero.png"]["inst"] is None and got["zero.png"]["error"] is None and got["junk.png"]["error"] == "ValueError: no picture"


def test_labels(spark, tmp_path):
    (tmp_path / "a.txt").write_text("0 0.1 0.2 0.5 0.2 0.5 0.6\n1 0.1 0.2\n\n")
    found = labels.scan_labels(spark, str(tmp_path), 100, 50)
    r = found.first()
    assert found.count() == 1 and r["stem"] == "a" and (r["x_min"], r["x_max"], r["y_max"], len(r["polygon"])) == (10, 50, 30, 3)
    pictures = spark.createDataFrame([("x/a.jpg",), ("b.jpg",)], "filename string")
    assert {r["filename"]: r["class_id"] for r in labels.images_with_labels(pictures, found).collect()} == {"x/a.jpg": 0, "b.jpg": None}


def test_series(spark, tmp_path):
    (tmp_path / "flow.csv").write_text("head,x,y,z\nunits,,1/s,\n,2.0,1.0,5\n,,3.0,6\n,7.0,bad,8\n")
    got = labels.scan_series_csv(spark, str(tmp_path / "flow.csv"), {"s": (2, 3, 1)}, columns=4).collect()
    assert [(r["series"], r["shear_rate"], r["viscosity"], r["stress_pa"]) for r in got] == [("s", 1.0, 5.0, 2.0)]


def test_incremental_ingest(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    rows(spark).write.parquet(source)
    ingest(stream_bubbles(spark, source), target, checkpoint).awaitTermination()
    assert bubbles.scan_bubbles(spark, target).count() == 3
    rows(spark, replicate="rep 2", n=2).write.mode("append").parquet(source)
    ingest(stream_bubbles(spark, source), target, checkpoint).awaitTermination()
    assert bubbles.scan_bubbles(spark, target).count() == 5
    # a batch that failed after its rows were written is run again, and replaces them
    for name in ("1", ".1.crc"):
        (tmp_path / "check" / "commits" / name).unlink()
    ingest(stream_bubbles(spark, source), target, checkpoint).awaitTermination()
    assert bubbles.scan_bubbles(spark, target).count() == 5
    table = stream_bubbles(spark, source).withColumnsRenamed({"d_mm_chosen": "equivalent_diameter_mm", "volume_mm3_chosen": "bubble_volume_mm3", "surface_area_mm2_chosen": "bubble_surface_area_mm2"})
    running_rollup(table, "rolled", str(tmp_path / "check2")).awaitTermination()
    assert spark.table("rolled").first()["n_total"] == 5


def test_split_listing(spark, tmp_path):
    for name in ("b.jpg", "a.png", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    (tmp_path / "inner").mkdir()
    (tmp_path / "inner" / "d.jpg").write_bytes(b"x")
    assert [r["filename"] for r in images.list_split(spark, str(tmp_path)).collect()] == ["a.png", "b.jpg"]
