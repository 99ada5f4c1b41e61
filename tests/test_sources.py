import numpy as np
import pytest
from pyspark.sql import functions as F

from voxframe.sources import metadata
from voxframe.sources.stages import StageStore
from voxframe.sources.tiff import Tiff, TiffSource, encode_tiff
from voxframe.streaming.carry import object_counts


def test_tiff_round_trip_through_the_source(spark, tmp_path):
    stacks = {"a.tif": [np.arange(12, dtype=np.uint16).reshape(3, 4) + k for k in range(3)], "b.tiff": [np.ones((2, 2), np.float32)]}
    for name, pages in stacks.items():
        (tmp_path / name).write_bytes(encode_tiff(pages, "axes=TYX", ((2, 1), (4, 1)), 3))
    spark.dataSource.register(TiffSource)
    df = spark.read.format("tiff_frames").load(str(tmp_path))
    rows = {(r["path"].rsplit("/", 1)[1], r["page"]): r for r in df.collect()}
    assert len(rows) == 4 and df.rdd.getNumPartitions() == 4
    for (name, page), r in rows.items():
        image = np.frombuffer(r["data"], r["dtype"]).reshape(r["height"], r["width"])
        assert (image == stacks[name][page]).all() and r["description"] == "axes=TYX" and r["unit"] == "centimeter"


def test_no_tiff(tmp_path):
    (tmp_path / "x.tif").write_bytes(b"nothing at all")
    with pytest.raises(ValueError):
        Tiff(str(tmp_path / "x.tif"))


@pytest.mark.parametrize("unit,scale", [("centimeter", 1e4), ("inch", 25400.0), (None, 1.0)])
def test_tag_resolution(spark, unit, scale):
    df = spark.createDataFrame([(2, 1, unit), (4, 1, unit), (0, 1, unit)], "n int, d int, u string")
    got = [r[0] for r in df.select(metadata.tag_resolution(F.col("n"), F.col("d"), F.col("u"))).collect()]
    assert got == [0.5 * scale, 0.25 * scale, None]


def test_median_interval(spark):
    rows = [(1, i, s) for i, s in enumerate((0.0, 1.0, 2.2, 3.1))] + [(2, 9, 0.0)]
    got = {r["k"]: r["dt"] for r in metadata.median_interval(spark.createDataFrame(rows, "k int, id int, s double"), ["k"], "s", "id").collect()}
    assert got[1] == pytest.approx(1.0) and got[2] is None


def test_time_range_is_checked(spark):
    df = spark.range(5).select(F.col("id").alias("t"))
    assert [r["t"] for r in metadata.time_range(df, 1, 3, 5).collect()] == [1, 2, 3]
    with pytest.raises(IndexError):
        metadata.time_range(df, 1, 5, 5)


def test_stage_store(spark, tmp_path):
    store = StageStore(spark, str(tmp_path / "run"))
    assert not store.ready("flow")
    store.write("flow", spark.createDataFrame([(0, 1.0), (1, 2.0)], "t int, cost double"))
    store.write("features_image", spark.createDataFrame([(0, 1)], "t int, label int"))
    assert store.ready("flow") and "flow" not in store.missing() and store.read("flow").where("t = 1").count() == 1
    store.export("flow", "cost", str(tmp_path / "csv"), t=0)
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 1
    store.remove_intermediates()
    assert not store.ready("flow") and store.ready("features_image")
    with pytest.raises(KeyError):
        store.path("other")


def test_stream_carries_the_last_frame(spark, tmp_path):
    src = tmp_path / "in"
    schema = "image_id long, t int, labels array<int>"
    spark.createDataFrame([(1, 0, [0, 1, 2]), (1, 1, [1]), (2, 0, [])], schema).coalesce(1).write.parquet(str(src))
    stream = object_counts(spark.readStream.schema(schema).parquet(str(src)))
    q = stream.writeStream.format("memory").queryName("counts").outputMode("append").start()
    try:
        q.processAllAvailable()
        spark.createDataFrame([(1, 2, [1, 2, 3])], schema).coalesce(1).write.mode("append").parquet(str(src))
        q.processAllAvailable()
        got = {(r["image_id"], r["t"]): (r["n"], r["change"]) for r in spark.table("counts").collect()}
    finally:
        q.stop()
    assert got == {(1, 0): (2, None), (1, 1): (1, -1), (2, 0): (0, None), (1, 2): (3, 2)}


def test_tables_of_many_frames_have_few_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("voxframe.sources.stages.MOST_FOLDERS", 10)
    store = StageStore(spark, str(tmp_path / "run"))
    rows = spark.range(1200).selectExpr("cast(id % 300 as int) as t", "cast(id as int) as label")
    saved = store.write("labels", rows)
    assert sorted((r["t"], r["label"]) for r in saved.collect()) == sorted((r["t"], r["label"]) for r in rows.collect())
    assert len(list((tmp_path / "run" / "labels").rglob("*.parquet"))) <= 8 and saved.where("t = 7").count() == 4
