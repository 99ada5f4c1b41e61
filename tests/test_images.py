"""Runs over many images, and runs in tiles: each equals the plain run."""

import itertools
import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxframe.operators import kernels, tracking
from voxframe.plans import session
from voxframe.plans.engine import Config, Engine

CONFIG = Config(height=20, width=24, bins=64, least_object=4, least_radius=1.0, most_radius=4.0, least_marker_radius=1.0, most_marker_radius=3.0, most_speed=4.0, match_speed=3.0)


def films(images):
    """image_id, t, y, x, v: two rods that move a cell a frame; films differ in length, first frame, place and noise."""
    rows = []
    for i in images:
        rng = np.random.default_rng(i)
        for t in range(i, i + 2 + i % 3):
            noise = rng.random((20, 24)) * 0.02
            for y, x in itertools.product(range(20), range(24)):
                near = min(math.hypot(y - 5 - t + i, max(0, 4 - x, x - 17 + i)), math.hypot(x - 12 - t + 2 * i, max(0, 12 - y, y - 18)))
                rows.append((i, t, y, x, float(math.exp(-(near**2) / 3) + noise[y, x])))
    return rows


def rounded(v):
    return [rounded(x) for x in v] if isinstance(v, (list, tuple)) else round(v, 6) + 0.0 if isinstance(v, float) else v


def table(df, without=()):
    return sorted(repr(rounded(r)) for r in df.select(*sorted(c for c in df.columns if c not in without)).collect())


def counted(spark, run):
    """The result of run(), how many Spark jobs it took and how many tables it wrote."""
    group, before = f"jobs-{np.random.default_rng().integers(2**60)}", len(session._WRITTEN)
    spark.sparkContext.setJobGroup(group, "")
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)), len(session._WRITTEN) - before
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_a_run_over_four_images_equals_four_runs(spark):
    rows = films(range(4))
    frames = session.checkpointed(spark.createDataFrame(rows, "image_id int, t int, y int, x int, v double"))
    engine = Engine(replace(CONFIG, keys=("image_id", "t")))
    together, jobs, tables = counted(spark, lambda: engine.run(frames))
    for i in (2, 0):  # the longest film first: all four take as many steps as it does
        alone, own_jobs, own_tables = counted(spark, lambda i=i: Engine(CONFIG).run(frames.where(F.col("image_id") == i).drop("image_id")))
        if i == 2:
            assert tables == own_tables and abs(jobs - own_jobs) <= 0.1 * jobs  # adaptive plans may differ by a stage
        assert set(alone) == set(together)
        for name, df in alone.items():
            assert table(together[name].where(F.col("image_id") == i), ("image_id",)) == table(df), (i, name)
    assert together["flow"].count() > 0 and together["reassigned_organelles"].where("label > 0").count() > 0


def test_chains_take_images_from_their_own_first_frame(spark):
    labels = [(i, t, k, 10 * (i + 1) + k) for i in (0, 1) for t in range(3 * i, 3 * i + 3 + i) for k in range(3)]
    moves = [(i, t, k, (k + 1) % 3, 0.1) for i in (0, 1) for t in range(3 * i, 3 * i + 2 + i) for k in range(3)]
    got = tracking.reassign_chain(
        spark.createDataFrame(moves, "image_id int, t int, prev int, next int, distance double"), spark.createDataFrame(labels, "image_id int, t int, id int, label int"), frame=("image_id", "t")
    ).collect()
    want = {(i, t, k): 10 * (i + 1) + (k - (t - 3 * i)) % 3 for i, t, k, _ in labels}
    assert {(r["image_id"], r["t"], r["id"]): r["label"] for r in got} == want


def test_a_step_reads_its_own_frame(spark):
    flow = spark.createDataFrame([(t, float(t), float(i), 1.0, 0.0, -1.0) for t in range(8) for i in range(50)], "t int, y double, x double, dy double, dx double, cost double")
    written = session.checkpointed(flow, "t")
    plan = written.where("t = 3")._jdf.queryExecution().executedPlan().toString()
    assert "(t#" in plan.split("PartitionFilters: ")[1].split("]")[0] and written.columns == flow.columns
    assert sorted(written.collect()) == sorted(flow.collect())


@pytest.mark.parametrize("depth", [0, 7])
def test_tiles_equal_whole_frames(spark, depth):
    rng = np.random.default_rng(4)
    shape = (depth, 26, 30) if depth else (26, 30)
    image = kernels.smooth(rng.random(shape), 1.4)
    axes = ("z", "y", "x")[-len(shape) :]
    rows = [(0, *map(int, c), float(image[tuple(c)])) for c in np.argwhere(image > -1)]
    frames = session.checkpointed(spark.createDataFrame(rows, "t int, " + ", ".join(f"{a} int" for a in axes) + ", v double"))
    config = replace(CONFIG, depth=depth, height=26, width=30, threshold=float(np.median(image)), smooth_mask=True, most_radius=2.5, spacing_z=2.0)
    whole, tiled = Engine(config), Engine(replace(config, tile=9))
    ves = session.checkpointed(whole.vesselness(frames))
    assert table(ves) == table(tiled.vesselness(frames)) and ves.where("v > 0").count() > 50
    labels = session.checkpointed(whole.label(frames))
    assert table(labels) == table(tiled.label(frames))
    for a, b in zip(whole.network(labels, ves), tiled.network(labels, ves), strict=True):
        assert table(a) == table(b)
    marks = whole.markers(labels, frames, ves)
    assert table(marks) == table(tiled.markers(labels, frames, ves)) and marks.count() > 0


def test_stage_tables_are_partitioned_by_image_and_frame(spark, tmp_path):
    from voxframe.sources.stages import StageStore

    engine, store = Engine(replace(CONFIG, keys=("image_id", "t"))), StageStore(spark, f"file://{tmp_path}")
    rows = spark.createDataFrame([(i, t, y, 1, 1) for i in range(2) for t in range(3) for y in range(5)], "image_id int, t int, y int, x int, label int")
    saved = engine.save({"labels": rows, "image": rows.groupBy("image_id", "t").count()}, store)
    assert sorted(p.name for p in (tmp_path / "labels" / "image_id=1").iterdir()) == ["t=0", "t=1", "t=2"]
    assert table(saved["labels"]) == table(rows) and store.ready("features_image")
    assert set(engine.save({"labels": rows, "image": rows.groupBy("image_id", "t").count()}, store, intermediate=False)) == {"image"}


def test_verbs_take_the_frames_that_settings_name(spark):
    config = Config.from_settings({"segmentation_label_num_t": 1, "tracking_num_t": 1, "reassign_num_t": 2}, height=4, width=4, threshold=0.5, least_object=1, smooth_mask=False)
    frames = spark.createDataFrame([(t, 1, 1, 1.0) for t in range(3)], "t int, y int, x int, v double")
    assert [r["t"] for r in Engine(config).label(frames).collect()] == [0]
    assert (config.label_frames, config.track_frames, config.reassign_frames, config.filter_frames) == (1, 1, 2, None)
