"""Grouped prefix join: near-duplicate documents by exact Jaccard similarity of their word shingles.

1. Texts become sets of shingle hashes; equal sets are one class, so exact copies are never paired.
2. Shingles have one global order, those that many documents share last. Two sets that reach the threshold share a
   shingle within a prefix of each (its length follows from the size). Classes with identical prefix and size are
   collapsed into a group, and only a group's head enters the prefix index.
3. Cells of the index (a shingle and its groups) give group pairs. A short cell gives all its pairs; a long one only
   those with its least head, as members of a large family of copies are then already connected.
4. What is still unconnected within a cell is expanded to members and paired. So no link between two components is
   missed, and no pair is looked at whose ends are known to be connected.
Pairs pass a bound on the symmetric difference (parity bitmaps that grow with the set) before their sets are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxframe.llm.common import drop, slices, written

SHINGLE = 5
#: Similarity of at least NUMERATOR / DENOMINATOR.
NUMERATOR, DENOMINATOR = 4, 5
#: Words of a set's parity bitmap: two bits for each element, a power of two between these.
BITMAP_WORDS, MOST_BITMAP_WORDS = 32, 1024
#: A cell of at most so many groups gives all its pairs at once.
SHORT_CELL = 6
#: Cells of more members are cut into bands of sizes before their members are paired.
BANDED = 64
#: A shingle that so many documents of one task share counts as frequent; at most MOST_FREQUENT are told to all tasks.
FREQUENT, MOST_FREQUENT = 2, 300_000
#: Rounds in which PIVOTS members of each long cell meet all its other members, before what is left is paired;
#: for cells where one component already has a twentieth of the members, as in large families of copies.
ROUNDS, PIVOTS = 1, 8
#: Wanted classes are broadcast only if a count finds at most so many.
MOST_BROADCAST = 300_000

_MULTIPLY = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = np.random.default_rng(5).integers(0, 2**64, 256, np.uint64)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS = np.full(64, _MULTIPLY[0])
_POWERS[0] = 1
_POWERS = np.cumprod(_POWERS)
#: Bytes of a text hashed at once; a longer text goes in parts that end where a word does.
_PART = 2_000_000


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hash of each word, in order: the sum of a number for each byte (one for A and a) times a power for its place."""
    found = []
    at = 0
    while at < len(text):
        end = min(len(text), at + _PART)
        while end < len(text) and not _IS_SPACE[text[end]]:
            end += 1
        raw = np.frombuffer(text, np.uint8, end - at, at)
        at = end
        blank = _IS_SPACE[raw]
        first = ~blank
        first[1:] &= blank[:-1]
        inside = np.flatnonzero(~blank)
        if not len(inside):
            continue
        starts = np.flatnonzero(first[inside])  # among the bytes of words
        place = np.arange(len(inside)) - np.repeat(starts, np.diff(np.append(starts, len(inside))))
        longest = int(place.max()) + 1
        power = _POWERS if longest <= len(_POWERS) else np.cumprod(np.append(np.uint64(1), np.full(longest - 1, _MULTIPLY[0])))
        found.append(_mix(np.add.reduceat(_BYTE[raw[inside]] * power[place], starts)))
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; fewer than 5 words are one shingle, none are the empty set.

    A-Z count as a-z; words are runs of bytes other than the blank and 0x09 to 0x0D.
    """
    h = word_hashes(text or b"")
    if not len(h):
        return h
    if len(h) < SHINGLE:
        return _mix((h * _MULTIPLY[: len(h)]).sum(keepdims=True) + np.uint64(len(h)))
    n = len(h) - SHINGLE + 1
    total = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        total += h[k : k + n] * _MULTIPLY[k]
    return np.unique(_mix(total))


def _texts(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, F.col("text").cast("binary").alias("text"))


def _keyed(docs: DataFrame) -> DataFrame:
    """docs and key, no_id: by which a text is found again; rows without an id have a hash of the text."""
    no_id = F.col("doc_id").isNull()
    return docs.withColumn("no_id", no_id).withColumn("key", F.when(no_id, F.xxhash64("text")).otherwise(F.col("doc_id")))


def _frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several documents of a task share, and how many do: at most MOST_FREQUENT, by a rising bar."""

    def run(batches):
        held = []
        for b in slices(batches):
            held += [shingles(t) for t in b.column(0).to_pylist()]
            if sum(map(len, held)) > 2_000_000:
                yield from count(held)
                held = []
        yield from count(held)

    def count(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if held:
            token, n = np.unique(np.concatenate(held), return_counts=True)
            few = n >= FREQUENT
            yield pa.RecordBatch.from_arrays([pa.array(token[few].view(np.int64)), pa.array(n[few].astype(np.int64))], names=["token", "n"])

    found = written(_texts(docs).mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")), "frequent")
    bars = found.groupBy(F.floor(F.log2(F.col("n").cast("double"))).alias("bar")).count().toPandas().sort_values("bar")  # 63 rows at most
    bar, left = 0, int(bars["count"].sum())
    for b, c in zip(bars["bar"], bars["count"], strict=True):
        if left <= MOST_FREQUENT:
            break
        bar, left = int(b) + 1, left - int(c)
    got = found.where(F.col("n") >= F.lit(2**bar)).toPandas()
    drop(found)
    token = got["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(token)
    return token[order], got["n"].to_numpy(np.int64)[order]


def prefix_length(n: int) -> int:
    return n - -(-NUMERATOR * n // DENOMINATOR) + 1 if n else 0


class PrefixOrder:
    """The global order of shingles: those not told to be frequent by hash, then the others by (count, hash)."""

    def __init__(self, token: np.ndarray, often: np.ndarray):
        self.token, self.often = token, often
        self.may = np.zeros(1 << 22, bool)  # by a hash's first bits, so that few are searched for
        self.may[token >> np.uint64(42)] = True

    def prefix(self, s: np.ndarray) -> np.ndarray:
        """The first prefix_length of the sorted set s in this order."""
        n = prefix_length(len(s))
        rare = ~self.may[s >> np.uint64(42)]
        look = np.flatnonzero(~rare)
        if not len(look):
            return s[:n]
        at = np.minimum(np.searchsorted(self.token, s[look]), len(self.token) - 1)
        found = self.token[at] == s[look]
        rare[look[~found]] = True
        first = s[rare]
        if len(first) >= n:
            return first[:n]
        s, often = s[~rare], self.often[at[found]]
        return np.concatenate((first, s[np.lexsort((s, often))][: n - len(first)]))


def parity_bits(s: np.ndarray) -> np.ndarray:
    """One bit for each value of a hash of the elements: whether an odd number of them has it. The bitmap grows with the set, so that it still tells large sets apart."""
    words = BITMAP_WORDS
    while words * 32 < len(s) and words < MOST_BITMAP_WORDS:
        words *= 2
    odd = np.bincount((s >> np.uint64(20)).astype(np.int64) % (64 * words), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def document_sets(docs: DataFrame) -> DataFrame:
    """doc_id, key, n (set size), d1, d2 (digest of the set), prefix, bits of every row (doc_id, text)."""
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(docs))  # MOST_FREQUENT pairs of numbers at most

    def run(batches):
        order = PrefixOrder(*frequent.value)
        for b in slices(batches):
            n, d1, d2, prefix, bits = [], [], [], [], []
            for text in b.column(2).to_pylist():
                s = shingles(text)
                n.append(len(s))
                d1.append(int(_mix(s).sum().view(np.int64)))
                d2.append(int(_mix(s ^ _MULTIPLY[0]).sum().view(np.int64)))
                prefix.append(order.prefix(s).view(np.int64))
                bits.append(parity_bits(s))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n, pa.int32()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(prefix, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))],
                names=["doc_id", "key", "n", "d1", "d2", "prefix", "bits"],
            )

    return _texts(_keyed(docs), "doc_id", "key").mapInArrow(run, "doc_id long, key long, n int, d1 long, d2 long, prefix array<long>, bits array<long>")


def may_reach(n1: Column, n2: Column, bits1: Column, bits2: Column) -> Column:
    """False only where the sizes or the bitmaps prove the similarity too small.

    Linked sets differ in at most (1 - t) / (1 + t) of n1 + n2 elements, and bitmaps differ in no more bits than that. The bitmaps of sets of
    such sizes are equally long, or one is twice as long: then its halves are laid over each other, which gives the shorter bitmap of the same set.
    """
    xor = lambda a, b: a.bitwiseXOR(b)
    words = F.least(F.size(bits1), F.size(bits2))
    short = lambda bits: F.when(F.size(bits) == 2 * words, F.zip_with(F.slice(bits, F.lit(1), words), F.slice(bits, words + 1, words), xor)).otherwise(bits)
    differ = F.aggregate(F.zip_with(short(bits1), short(bits2), lambda a, b: F.bit_count(xor(a, b))), F.lit(0), lambda acc, x: acc + x)
    sizes = (F.least(n1, n2) * DENOMINATOR >= F.greatest(n1, n2) * NUMERATOR) & (n1 > 0)
    return sizes & (differ * (DENOMINATOR + NUMERATOR) <= (n1 + n2) * (DENOMINATOR - NUMERATOR))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose sets (c, tokens: sorted hashes as bytes) reach the threshold; only the pairs' own sets travel."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct()
    if pairs.count() * 2 <= MOST_BROADCAST:
        ends = F.broadcast(ends)  # 8 bytes a row
    sets = sets.join(ends, "c", "left_semi")
    left, right = sets.select(F.col("c").alias("a"), F.col("tokens").alias("x")), sets.select(F.col("c").alias("b"), F.col("tokens").alias("y"))
    rows = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y")

    def run(batches):
        for batch in slices(batches):
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(DENOMINATOR * both >= NUMERATOR * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep, pa.bool_())), batch.column(1).filter(pa.array(keep, pa.bool_()))], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def connected(edges: DataFrame) -> DataFrame:
    """node, root (least node of its component) for every node of edges (a, b): alternating large and small stars.

    Each round is a few joins on the edges; a hub's edges meet its least neighbour by a join that can be split.
    """
    now = written(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        fresh = written(small.where("u != v").distinct(), "edges")
        mark = fresh.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop(now)
        now = fresh
        if mark == seen:
            break
        seen = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links) of every row of docs (doc_id, text).

    A-Z count as a-z; words are runs without blank or 0x09 to 0x0D. Null and empty texts have no shingle and link with
    nothing: each is a component of its own. Equal sets link; rows that are repeated share their component. A null doc_id is no
    one's least id: texts without one link like others, and a component of such texts alone has none (null). Other
    columns are ignored; an empty table gives no rows; texts are read whole.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    whole = written(document_sets(docs), "sets")
    classes = whole.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"), F.min("key").alias("key"), F.any_value("prefix").alias("prefix"), F.any_value("bits").alias("bits"))
    classes = written(classes.withColumn("c", F.monotonically_increasing_id()), "classes")
    rows = written(whole.select("doc_id", "n", "d1", "d2"), "rows")
    drop(whole)
    facts = classes.select("c", "n", "bits")

    # groups: one prefix and size; the head is the least class
    keyed = classes.select("c", "n", F.xxhash64("prefix", "n").alias("k1"), F.xxhash64(F.lit(1), "prefix").alias("k2"))
    heads = keyed.groupBy("k1", "k2", "n").agg(F.min("c").alias("g"), F.count("*").alias("members")).where("members > 1").drop("members")
    members = written(keyed.join(heads, ["k1", "k2", "n"]).where("c != g").select("g", "c"), "members")
    prefixes = classes.select(F.explode("prefix").alias("token"), "c").join(members.select("c"), "c", "left_anti")
    shared = prefixes.groupBy("token").agg(F.count("*").alias("m"), F.min("c").alias("pivot")).where("m > 1")
    cells = written(prefixes.join(shared, "token"), "cells")

    # members with their head, heads of short cells with one another, heads of long cells with the least
    one, two = cells.select("token", F.col("c").alias("a"), "m"), cells.select("token", F.col("c").alias("b"))
    short = one.where(F.col("m") <= SHORT_CELL).join(two, "token").where("a < b").select("a", "b")
    star = cells.where((F.col("m") > SHORT_CELL) & (F.col("c") != F.col("pivot"))).select(F.col("pivot").alias("a"), F.col("c").alias("b"))
    pairs = short.unionByName(star).unionByName(members.select(F.col("g").alias("a"), F.col("c").alias("b"))).distinct()
    near = written(_bounded(pairs, facts), "near")
    sets = _class_sets(docs, near, classes, None)
    links = written(_verified(near, sets), "links")
    roots = written(connected(links), "roots")

    # what still has several components within a cell or a group: members of different ones meet
    by_head = cells.select("token", F.col("c").alias("g")).join(members, "g").select("token", "c")
    own_group = members.select(F.xxhash64(F.lit("group"), "g").alias("token"), F.explode(F.array("g", "c")).alias("c")).distinct()
    opened = cells.select("token", "c").unionByName(by_head).unionByName(own_group)
    mixed = written(_mixed(opened, roots), "mixed")
    drop(cells)
    for k in range(ROUNDS + 1):
        last = k == ROUNDS
        across = written(_across(mixed, facts) if last else _bounded(_with_pivots(mixed, k).distinct(), facts), "across")
        if across.isEmpty():
            continue
        sets = _class_sets(docs, across, classes, sets)
        more = written(_verified(across, sets), "more")
        roots = written(connected(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)), "roots")
        if not last:
            fresh = written(_mixed(mixed.select("token", "c"), roots), "mixed")
            drop(mixed)
            mixed = fresh
    drop(mixed)

    rooted = classes.join(roots, F.col("c") == F.col("node"), "left").select("d1", "d2", "n", "rep", F.coalesce("root", "c").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = written(rooted.join(least, "root").select("d1", "d2", "n", "component_id"), "named")
    drop(classes)
    out = rows.join(named, ["d1", "d2", "n"], "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _mixed(cells: DataFrame, roots: DataFrame) -> DataFrame:
    """token, c, root, n (members of the cell), major (the root most of them have), k (how many): cells of several roots only."""
    placed = cells.join(roots, F.col("c") == F.col("node"), "left").select("token", "c", F.coalesce("root", "c").alias("root"))
    share = placed.groupBy("token", "root").agg(F.count("*").alias("k"))
    whole = share.groupBy("token").agg(F.sum("k").alias("n"), F.max(F.struct("k", "root")).alias("top"), F.count("*").alias("roots"))
    return placed.join(whole.where("roots > 1").select("token", "n", F.col("top.root").alias("major"), F.col("top.k").alias("k")), "token")


def _with_pivots(mixed: DataFrame, k: int) -> DataFrame:
    """Pairs of each long cell's pivots, members of least hash, with its members of other roots."""
    long = mixed.where((F.col("n") > 4 * SHORT_CELL) & (20 * F.col("k") >= F.col("n")))
    low = [F.min(F.struct(F.xxhash64(F.lit(k * PIVOTS + i), "c").alias("h"), "c", "root")).alias(f"p{i}") for i in range(PIVOTS)]
    pivots = long.groupBy("token").agg(*low).select("token", F.array(*[F.struct(f"p{i}.c", f"p{i}.root") for i in range(PIVOTS)]).alias("pivots"))
    other = F.array_distinct(F.filter("pivots", lambda p: p["root"] != F.col("root")))
    met = long.join(pivots, "token").select("c", F.explode(other).alias("p"))
    return met.select(F.least("c", "p.c").alias("a"), F.greatest("c", "p.c").alias("b"))


def _across(mixed: DataFrame, facts: DataFrame) -> DataFrame:
    """All pairs of different roots within a cell that the bound allows; those of the major root never meet each other.

    A cell of many members is cut into bands of sizes, each 5/4 of the one before: linked sets lie in one band or in two neighbours.
    """
    large = F.col("members") > BANDED
    band = F.when(large, F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(DENOMINATOR / NUMERATOR)))).otherwise(F.lit(0))
    rows = written(mixed.withColumnRenamed("n", "members").join(_folded(facts), "c").withColumn("band", band).withColumn("large", large), "opened")
    x, y = (rows.select("token", "band", "large", *[F.col(k).alias(f"{k}{i}") for k in ("c", "root", "n", "bits")], F.col("major").alias(f"major{i}")) for i in (1, 2))
    beside = F.when(F.col("large"), F.array(*[F.col("band") + d for d in (-1, 0, 1)])).otherwise(F.array("band"))
    x = x.where("root1 != major1").withColumn("band", F.explode(beside)).drop("large")
    y = y.withColumn("is_major", F.col("root2") == F.col("major2")).drop("major2", "large")
    rows = x.join(y, ["token", "band"])
    rows = rows.where((F.col("root1") != F.col("root2")) & (F.col("is_major") | (F.col("c1") < F.col("c2"))))
    rows = rows.where(may_reach(F.col("n1"), F.col("n2"), F.col("bits1"), F.col("bits2")))
    found = rows.select(F.least("c1", "c2").alias("a"), F.greatest("c1", "c2").alias("b"), F.when(F.col("c1") < F.col("c2"), F.col("n1")).otherwise(F.col("n2")).alias("na"))
    return _by_long_bitmaps(found.distinct(), facts)


def _folded(facts: DataFrame) -> DataFrame:
    """facts with bitmaps of BITMAP_WORDS words alone: the parts of a longer one are laid over each other."""
    parts = F.sequence(F.lit(0), (F.size("bits") / BITMAP_WORDS).cast("int") - 1)
    over = lambda i: F.aggregate(parts, F.lit(0).cast("long"), lambda acc, k: acc.bitwiseXOR(F.get("bits", k * BITMAP_WORDS + i)))
    return facts.withColumn("bits", F.when(F.size("bits") > BITMAP_WORDS, F.transform(F.sequence(F.lit(0), F.lit(BITMAP_WORDS - 1)), over)).otherwise(F.col("bits")))


def _met(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """The pairs (a, b) that the bound by the facts' bitmaps allows, and na, the size of a's set."""
    left, right = (facts.select(F.col("c").alias(k), F.col("n").alias(f"n{k}"), F.col("bits").alias(f"bits{k}")) for k in ("a", "b"))
    both = pairs.join(left, "a").join(right, "b")
    return both.where(may_reach(F.col("na"), F.col("nb"), F.col("bitsa"), F.col("bitsb"))).select("a", "b", "na")


def _by_long_bitmaps(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """The pairs (a, b, na), which short bitmaps allow, that long ones allow as well; only pairs of large sets have any and meet them."""
    large = F.col("na") > 32 * BITMAP_WORDS
    held = written(pairs, "bounded")
    return held.where(~large).select("a", "b").unionByName(_met(held.where(large).select("a", "b"), facts).select("a", "b"))


def _bounded(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    return _by_long_bitmaps(_met(pairs, _folded(facts)), facts)


def _class_sets(docs: DataFrame, pairs: DataFrame, classes: DataFrame, held: DataFrame | None) -> DataFrame:
    """held and c, tokens (sorted shingle hashes as bytes) of each other class in pairs (a, b), from a member's text."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct()
    if held is not None:
        wanted = wanted.join(held.select("c"), "c", "left_anti")
    no_id = F.col("rep").isNull()
    wanted = classes.join(wanted, "c", "left_semi").select("c", no_id.alias("no_id"), F.when(no_id, F.col("key")).otherwise(F.col("rep")).alias("key"), "d1")
    wanted = written(wanted, "wanted")
    n = wanted.count()
    if held is not None and n == 0:
        return held
    if n <= MOST_BROADCAST:
        wanted = F.broadcast(wanted)  # 32 bytes a row

    def run(batches):
        for b in slices(batches):
            sets = [shingles(t) for t in b.column(2).to_pylist()]
            keep = pa.array([int(_mix(s).sum().view(np.int64)) == d for s, d in zip(sets, b.column(1).to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), pa.array([s.tobytes() for s in sets], pa.binary()).filter(keep)], names=["c", "tokens"])

    got = written(_texts(_keyed(docs).join(wanted, ["key", "no_id"]), "c", "d1").mapInArrow(run, "c long, tokens binary").dropDuplicates(["c"]), "class-sets")
    return got if held is None else held.unionByName(got)
