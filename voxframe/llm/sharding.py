"""Sharding by balanced label propagation: linked documents move towards their neighbours' shards under quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxframe.llm.common import blocks_for, drop, written

PER_BLOCK = 4_000
#: Groups of more than PER_BLOCK members, of which there are few, are broadcast if a count finds at most so many.
MOST_LARGE = 10_000


def prefix_sums(df: DataFrame, within: list[str], block: Column, order: list[Column], value: Column, out: str) -> DataFrame:
    """df with `out`: the sum of value over the rows before, in the order of (block, *order), inside each group `within`.

    Sums of blocks are added up first, then rows inside a block, so no task ever holds more than a block.
    """
    rows = df.withColumn("_block", block)
    keys = [*within, "_block"]
    sums = rows.groupBy(*keys).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*within).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # the left side decides the row count: one row of sums for each block
    return rows.join(sums, keys).withColumn(out, F.col("_before") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_block", "_before")


def _quotas(demand: dict[tuple[int, int], int], free: list[int]) -> dict[tuple[int, int], int]:
    """Moves allowed from shard a to b: swaps that leave both sizes as they are, then what b has room for."""
    allowed = {(a, b): min(n, demand.get((b, a), 0)) for (a, b), n in demand.items()}
    left = list(free)
    for (a, b), n in sorted(demand.items(), key=lambda x: (-x[1], x[0])):
        more = min(n - allowed[a, b], left[b])
        allowed[a, b] += more
        left[b] -= more
        left[a] += more if more > 0 else 0
    return {k: n for k, n in allowed.items() if n > 0}


def _links(state: DataFrame) -> float:
    """Links within shards, as ordered pairs of members; a double, as a group of a third of 10**12 rows has 10**23 pairs."""
    return state.agg(F.sum(F.col("n").cast("double") * (F.col("n") - 1))).first()[0] or 0.0


def _moved(state: DataFrame, moves: DataFrame) -> DataFrame:
    """state after moves (g, shard, to, m)."""
    changes = moves.select("g", F.explode(F.array(F.struct("shard", (-F.col("m")).alias("n")), F.struct(F.col("to").alias("shard"), F.col("m").alias("n")))).alias("c")).select("g", "c.shard", "c.n")
    return written(state.unionByName(changes).groupBy("g", "shard").agg(F.sum("n").alias("n")).where("n > 0"), "shard-state")


def _united(cut: DataFrame, free: list[int], block: Column, turn: int) -> DataFrame:
    """Moves (g, shard, to, m) that bring cut groups (g, shard, n, members) together in one shard each.

    A group wishes for the shard that holds most of its members and can take the rest; without one, for any shard that can take it whole, by a hash. A
    shard takes groups, in an order by hash, while they fit as a whole; rows without links make way for them.
    """
    rooms = F.array(*[F.lit(x) for x in free])
    own = F.struct("n", F.xxhash64("g", "shard").alias("tie"), "shard")
    fits = F.get(rooms, F.col("shard")) >= F.col("members") - F.col("n")
    wish = cut.groupBy("g").agg(F.first("members").alias("members"), F.max(F.when(fits, own)).alias("own"))
    others = F.filter(F.transform(rooms, lambda r, s: F.when(r >= F.col("members"), s)), lambda s: s.isNotNull())
    any_one = F.when(F.size(others) > 0, F.get(others, F.pmod(F.xxhash64("g", F.lit(turn)), F.size(others)).cast("int")))
    wish = wish.select("g", F.coalesce("own.shard", any_one).cast("int").alias("to"), (F.col("members") - F.coalesce("own.n", F.lit(0))).alias("need")).where("`to` is not null")
    ranked = prefix_sums(wish, ["to"], block, [F.xxhash64("g", F.lit(turn)), F.col("g")], F.col("need"), "before")
    taken = ranked.where(F.col("before") + F.col("need") <= F.get(rooms, F.col("to"))).select("g", "to")
    return cut.join(taken, "g").where("shard != `to`").select("g", "shard", "to", F.col("n").alias("m"))


def _drawn_together(cut: DataFrame, free: list[int], shards: int, block: Column) -> DataFrame:
    """Moves (g, shard, to, m) of members from shards with fewer of their group to the one that holds most, preferably with room: swaps first, then room."""
    room = F.get(F.array(*[F.lit(x > 0) for x in free]), F.col("shard"))
    # a tie is broken by a hash of group and shard, so wishes go both ways between shards and can be swapped
    own = F.struct("n", F.xxhash64("g", "shard").alias("tie"), "shard")
    best = cut.groupBy("g").agg(F.max(F.when(room, own)).alias("open"), F.max(own).alias("most"))
    goal = F.coalesce("open", "most")
    wishes = cut.join(best, "g").withColumn("to", goal["shard"]).where("`to` != shard").where(own < goal)
    wishes = written(wishes.select("g", "shard", "to", "n"), "shard-wishes")
    demand = {(r["shard"], r["to"]): r["n"] for r in wishes.groupBy("shard", "to").agg(F.sum("n").alias("n")).collect()}  # shards squared at most
    allowed = _quotas(demand, free)
    quota = F.create_map(*[F.lit(x) for (a, b), n in (allowed or {(0, 0): 0}).items() for x in (a * shards + b, n)])
    ranked = prefix_sums(wishes, ["shard", "to"], block, [F.xxhash64("g", F.lit(1)), F.col("g")], F.col("n"), "before")
    give = F.greatest(F.lit(0), F.least(F.col("n"), F.coalesce(F.try_element_at(quota, F.col("shard") * shards + F.col("to")), F.lit(0)) - F.col("before")))
    return ranked.withColumn("m", give).where("m > 0").select("g", "shard", "to", "m")


def propagate(groups: DataFrame, targets: list[int], trace: list[tuple[str, int]] | None = None) -> DataFrame:
    """(g, shard, n): how many members of each linked group every shard gets, at most targets[s] in shard s.

    groups: g, n. Members of a group are linked with one another and alike, so a group's counts by shard are its
    state. All members start in one line of groups by hash, and the shards are filled along it, so groups at a shard's end start cut. In each round
    the cut groups move to their neighbours' shards: as a whole where a shard can take the group, and when no shard can, by drawing members towards
    the shard that holds most of them, within quotas between any two shards. Who moves is decided by running sums over blocks. A round that leaves no more
    links whole is taken back and ends the propagation. `trace` is told each round's kind and rows moved.
    """
    shards = len(targets)
    counted = groups.agg(F.count("*").alias("k"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    many = blocks_for(counted["k"], PER_BLOCK)
    block = F.pmod(F.xxhash64("g"), F.lit(many))
    dealt = prefix_sums(groups, [], block, [F.col("g")], F.col("n"), "first")
    ends = [0]  # shard s takes the places from ends[s] to ends[s + 1]
    for t in targets:
        ends.append(min(counted["n"], ends[-1] + t))
    last = lambda place: F.size(F.filter(F.array(*[F.lit(e) for e in ends[1:]]), lambda e: e <= place))  # noqa: E731  the shard of a place
    each = F.explode(F.sequence(last(F.col("first")), F.least(last(F.col("first") + F.col("n") - 1), F.lit(shards - 1)))).alias("shard")
    limit = lambda k: F.get(F.array(*[F.lit(e) for e in ends]), F.col("shard") + k)
    inside = F.least(F.col("first") + F.col("n"), limit(1)) - F.greatest(F.col("first"), limit(0))
    state = dealt.select("g", "n", "first", each).select("g", F.col("shard").cast("int").alias("shard"), inside.alias("n"))
    state = written(state.where("n > 0"), "shard-state")
    whole, turn = _links(state), 0
    while True:
        turn += 1
        load = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # one row a shard
        free = [t - load.get(s, 0) for s, t in enumerate(targets)]
        cut = state.groupBy("g").agg(F.count("*").alias("parts"), F.sum("n").alias("members")).where("parts > 1").drop("parts")
        cut = written(state.join(cut, "g"), "shard-cut")
        kind, moves = "whole", written(_united(cut, free, block, turn), "shard-moves")
        if moves.isEmpty():
            kind, moves = "part", written(_drawn_together(cut, free, shards, block), "shard-moves")
        drop(cut)
        rows = moves.agg(F.sum("m")).first()[0] or 0
        if not rows:
            break
        fresh = _moved(state, moves)
        drop(moves)
        now = _links(fresh)
        if now <= whole:
            drop(fresh)
            break
        if trace is not None:
            trace.append((kind, rows))
        drop(state)
        state, whole = fresh, now
    return state


def shard_documents(docs: DataFrame, shards: int) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of docs (doc_id, text).

    The law is `rows`: the shards' counts differ by one at most. Documents of equal text are linked; unlinked
    ones fill what propagation leaves. A null text counts as the empty text, and all such are linked; rows
    that are repeated have a slot each; other columns of docs are ignored; an empty table gives no rows.
    """
    empty = F.coalesce("text", F.lit(""))
    rows = written(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(empty) + 8).cast("long").alias("size"), F.crc32(empty.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(empty, 256)).alias("g"), F.monotonically_increasing_id().alias("row")),
        "shard-rows",
    )
    total = rows.count()
    targets = [total // shards + (s < total % shards) for s in range(shards)]
    groups = written(rows.groupBy("g").agg(F.count("*").alias("n")).where("n > 1"), "shard-groups")
    state = propagate(groups, targets)
    load = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    many = blocks_for(total, PER_BLOCK)

    placed = prefix_sums(state, ["shard"], F.pmod(F.xxhash64("g"), F.lit(many)), [F.col("g")], F.col("n"), "offset")
    mine = Window.partitionBy("g").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row a shard
    placed = placed.withColumn("start", F.coalesce(F.sum("n").over(mine), F.lit(0)))
    parts = written(placed.groupBy("g").agg(F.sum("n").alias("members"), F.collect_list(F.struct("start", "n", "shard", "offset")).alias("parts")), "shard-parts")
    large = parts.where(F.col("members") > PER_BLOCK)
    if 0 < large.count() <= MOST_LARGE:  # so no join key has more than PER_BLOCK rows
        others = rows.join(F.broadcast(large.select("g")), "g", "left_anti").join(parts.where(F.col("members") <= PER_BLOCK), "g", "left")
        joined = others.unionByName(rows.join(F.broadcast(large), "g"))
    else:
        joined = rows.join(parts, "g", "left")

    linked = joined.where("parts is not null").withColumn("blocks", F.ceil(F.col("members") / PER_BLOCK))
    order = [F.col("doc_id"), F.col("row")]  # the number of a written row, so repeated ids are spread like others
    linked = prefix_sums(linked, ["g"], F.pmod(F.xxhash64("row"), F.col("blocks")), order, F.lit(1), "rank")
    part = F.element_at(F.filter("parts", lambda p: (p["start"] <= F.col("rank")) & (F.col("rank") < p["start"] + p["n"])), 1)
    linked = linked.withColumn("part", part).select("doc_id", "size", "text_crc32", F.col("part.shard").alias("shard"), (F.col("part.offset") + F.col("rank") - F.col("part.start")).alias("slot"))

    starts, at = [], 0
    for s, t in enumerate(targets):
        starts.append(at)
        at += t - load.get(s, 0)
    single = prefix_sums(joined.where("parts is null").drop("parts", "members"), [], F.pmod(F.xxhash64("g"), F.lit(many)), [F.col("g"), *order], F.lit(1), "rank")
    ends = F.array(*[F.lit(x) for x in [*starts[1:], at]])
    shard = F.size(F.filter(ends, lambda e: e <= F.col("rank"))).cast("int")
    single = single.withColumn("shard", shard).select(
        "doc_id", "size", "text_crc32", "shard",
        (F.get(F.array(*[F.lit(load.get(s, 0)) for s in range(shards)]), F.col("shard")) + F.col("rank") - F.get(F.array(*[F.lit(x) for x in starts]), F.col("shard"))).alias("slot"),
    )
    return linked.unionByName(single).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
