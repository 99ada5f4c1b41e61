"""Propagation under quotas: no cut that room could avoid, rounds that are traced, sizes that hold."""

import pytest
from pyspark.sql import functions as F

from voxframe.llm import sharding


def cuts(spark, sizes, free, shards):
    """Cut groups, loads and trace of groups of the given sizes beside so many free rows."""
    total = sum(sizes) + free
    targets = [total // shards + (s < total % shards) for s in range(shards)]
    groups = spark.createDataFrame([(i.to_bytes(4, "big"), n) for i, n in enumerate(sizes)], "g binary, n long")
    trace = []
    state = sharding.propagate(groups, targets, trace).collect()
    members, parts, load = {}, {}, {}
    for r in state:
        members[r["g"]] = members.get(r["g"], 0) + r["n"]
        parts[r["g"]] = parts.get(r["g"], 0) + 1
        load[r["shard"]] = load.get(r["shard"], 0) + r["n"]
    assert sorted(members.values()) == sorted(sizes) and all(n <= targets[s] for s, n in load.items())
    return sum(p > 1 for p in parts.values()), trace


@pytest.mark.parametrize("sizes,free,shards", [([2] * 50 + [6] * 6, 865, 24), ([25] + [2] * 500 + [3] * 80, 8713, 24), ([7] * 429, 3000, 24), ([5] * 20, 0, 4)])
def test_no_group_is_cut_where_there_is_room(spark, sizes, free, shards):
    cut, trace = cuts(spark, sizes, free, shards)
    assert cut == 0
    if sizes == [7] * 429:
        assert trace and {kind for kind, _ in trace} == {"whole"} and sum(n for _, n in trace) >= 10


def test_groups_without_room_are_cut_as_little_as_can_be(spark):
    assert cuts(spark, [3] * 1000, 0, 7)[0] <= 2
    cut, _ = cuts(spark, [100, 3, 3, 3, 3], 8, 4)  # the large one fills shards of 30
    assert cut == 1


def test_repeated_ids_have_slots_of_their_own(spark):
    docs = spark.range(30_000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("one text").alias("text"))
    out = sharding.shard_documents(docs, 7)
    sizes = out.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("slots"), F.max("slot").alias("top")).collect()
    assert all(r["n"] == r["slots"] == r["top"] + 1 and r["n"] in (4285, 4286) for r in sizes) and len(sizes) == 7
