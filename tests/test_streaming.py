"""Flow rows of a stream of markers are those of the batch."""

import numpy as np
from pyspark.sql import functions as F

from voxframe.plans.engine import Config, Engine
from voxframe.streaming.carry import marker_flow

SCHEMA = "image_id long, t int, id long, y double, x double, stats array<double>, hu array<double>"


def markers(seed, frames, n=30):
    rng = np.random.default_rng(seed)
    at = rng.uniform(0, 20, (n, 2))
    out = []
    for t in frames:
        at = at + rng.normal(0, 0.4, at.shape)
        out += [(seed, t, i, *map(float, p), [float(v) for v in rng.random(4)], [float(v) for v in rng.random(6)]) for i, p in enumerate(at)]
    return out


def test_a_stream_over_frames_equals_the_batch(spark, tmp_path):
    rows = markers(1, range(3)) + markers(2, range(4)) + markers(3, (0, 2, 3))
    src, out = tmp_path / "in", tmp_path / "out"
    config = Config(keys=("image_id", "t"), most_speed=1.5)
    for k, times in enumerate(((0,), (1, 2), (3,))):  # three batches, the middle one of two frames
        spark.createDataFrame([r for r in rows if r[1] in times], SCHEMA).coalesce(1).write.mode("append").parquet(str(src))
        stream = marker_flow(spark.readStream.schema(SCHEMA).parquet(str(src)), ("y", "x"), config.gate, config.most_cost)
        query = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    keep = ["image_id", "t", "pre", "post", "y", "x", "dy", "dx", "cost"]
    rounded = lambda df: sorted(tuple(round(v, 8) if isinstance(v, float) else v for v in r) for r in df.select(*keep).collect())
    want = Engine(config).track_markers(spark.createDataFrame(rows, SCHEMA).withColumn("t", F.col("t").cast("int")))
    assert rounded(spark.read.parquet(str(out))) == rounded(want) and want.where("image_id = 3").select("t").distinct().count() == 1


def test_late_frames_are_left_out(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    for times in ((0, 1), (1,)):
        spark.createDataFrame(markers(1, times), SCHEMA).coalesce(1).write.mode("append").parquet(str(src))
        stream = marker_flow(spark.readStream.schema(SCHEMA).parquet(str(src)), ("y", "x"), 1.5)
        query = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    got = spark.read.parquet(str(out))
    assert got.count() > 0 and got.where("t != 0").isEmpty() and got.groupBy("pre", "post").count().where("count > 2").isEmpty()
