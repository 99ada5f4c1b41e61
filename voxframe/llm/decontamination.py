"""Benchmark decontamination by winnowing, in DataFrame functions alone.

Every text keeps the least hash of each W consecutive K-grams. Two texts that share W + K - 1 words in a row keep a
hash in common there, so joining the kept hashes misses no window of that length. Each hit fixes how an item lies
along a document; the words of both are then compared over the item's whole length, and windows that agree are hits.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxframe.llm.common import written

WINDOW = 10
K = 5
W = WINDOW - K + 1
#: A side is broadcast only if a count of its rows (some 40 bytes each) is at most this.
MOST_BROADCAST = 400_000


def words(text: Column) -> Column:
    """A-Z lower-cased, then runs of digits, letters and everything beyond ASCII; null gives no words."""
    low = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.coalesce(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.array().cast("array<string>")), "")


def _rest(a: Column, skip: int) -> Column:
    return F.slice(a, F.lit(skip + 1), F.greatest(F.size(a) - skip, F.lit(0)))


def _trim(a: Column, n: Column) -> Column:
    return F.slice(a, F.lit(1), F.greatest(n, F.lit(0)))


def chained(hashes: DataFrame, word_hashes: str, lengths: list[int], out: str) -> DataFrame:
    """`out`<m> for each of lengths (1 to 9): hash of each m consecutive word hashes, chained word by word."""
    df, now = hashes, word_hashes
    for m in range(1, max(lengths, default=0) + 1):
        if m > 1:
            mixed = F.zip_with(F.col(now), _rest(F.col(word_hashes), m - 1), lambda a, b: F.xxhash64(a, b))
            df = df.withColumn(f"_chain{m}", _trim(mixed, F.size(word_hashes) - (m - 1)))
            now = f"_chain{m}"
        if m in lengths:
            df = df.withColumn(f"{out}{m}", F.col(now))
    return df.drop(*[f"_chain{m}" for m in range(2, 10)])


def kgrams(hashes: DataFrame, word_hashes: str, out: str) -> DataFrame:
    """`out`: hash of each 5 consecutive word hashes, built from pairs and fours."""
    mix = lambda a, b: F.xxhash64(a, b)
    pairs = hashes.withColumn("_2", F.zip_with(F.col(word_hashes), _rest(F.col(word_hashes), 1), mix))
    fours = pairs.withColumn("_4", F.zip_with(F.col("_2"), _rest(F.col("_2"), 2), mix))
    fives = fours.withColumn(out, F.zip_with(F.col("_4"), _rest(F.col(word_hashes), 4), mix))
    return fives.withColumn(out, _trim(F.col(out), F.size(word_hashes) - (K - 1))).drop("_2", "_4")


def window_minima(df: DataFrame, grams: str, out: str) -> DataFrame:
    """`out`: the least of each W consecutive grams (of fewer towards the end), by doubling."""
    least = lambda a, b: F.least(a, b)
    two = df.withColumn("_m2", F.zip_with(F.col(grams), _rest(F.col(grams), 1), least))
    four = two.withColumn("_m4", F.zip_with(F.col("_m2"), _rest(F.col("_m2"), 2), least))
    return four.withColumn(out, F.zip_with(F.col("_m4"), _rest(F.col("_m4"), 2), least)).drop("_m2", "_m4")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def find_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, item_ids (sorted as strings) for every row of docs (doc_id, text); benchmark: item_id, text.

    A window is 10 consecutive words of an item; an item of 1 to 9 words is one window. A word of a document is hit if it
    lies in any occurrence of a window. Null and empty texts have no words; items of equal words share their windows; an item_id with
    several texts has the windows of all, and is named once;
    repeated rows have a row each; rows without a doc_id are read like others; other columns are ignored; empty tables give no hits.
    """
    items = benchmark.select("item_id", words(F.col("text")).alias("item")).where("size(item) > 0")
    items = items.groupBy("item").agg(F.collect_set(F.col("item_id").cast("string")).alias("ids"))
    items = written(items.select(F.monotonically_increasing_id().alias("k"), "item", "ids"), "items")
    lengths = [r["m"] for r in items.select(F.size("item").alias("m")).where(f"m < {WINDOW}").distinct().collect()]  # 9 at most

    # doc_id and h are the key of a text and never null; a text without an id has an h of its own kind
    doc_id = F.col("doc_id").cast("long")
    h = F.when(doc_id.isNull(), F.xxhash64("text", F.lit("no id"))).otherwise(F.xxhash64("text"))
    source = docs.select(F.coalesce(doc_id, F.lit(0)).cast("long").alias("doc_id"), doc_id.isNull().alias("no_id"), "text", h.alias("h"))
    hashed = source.select("doc_id", "no_id", "h", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("w"))
    kept = chained(window_minima(kgrams(hashed, "w", "g"), "g", "kept"), "w", lengths, "short")
    # a mark of a short item is the hash of all its words, so only texts that hold them all are looked at
    marked = F.array_distinct(F.concat(F.col("kept"), *[F.col(f"short{m}") for m in lengths]))
    kept = written(kept.select("doc_id", "no_id", "h", F.size("w").cast("long").alias("n_words"), marked.alias("kept")), "kept")

    in_items = kgrams(items.select("k", F.size("item").alias("m"), F.transform("item", lambda w: F.xxhash64(w)).alias("w")), "w", "g")
    long_items = window_minima(in_items.where(F.col("m") >= WINDOW), "g", "kept")
    whole = chained(in_items.where(F.col("m") < WINDOW), "w", lengths, "short")
    short_items = whole.select("k", "m", F.get(F.coalesce(*[F.when(F.col("m") == m, F.col(f"short{m}")) for m in lengths], F.array().cast("array<bigint>")), F.lit(0)).alias("mark"))
    marks = written(long_items.select("k", F.explode(F.array_distinct("kept")).alias("mark")), "marks")
    wanted = marks.select("mark").unionByName(short_items.select("mark")).distinct()
    touched = kept.select("doc_id", "h", F.explode("kept").alias("mark")).join(_small(wanted), "mark", "left_semi").select("doc_id", "h")
    touched = written(touched.distinct(), "touched")
    near = written(source.join(touched, ["doc_id", "h"]).dropDuplicates(["doc_id", "h"]).select("doc_id", "h", words(F.col("text")).alias("words")), "near")

    # how items lie along documents: place in the document less place in the item
    near_hashed = near.select("doc_id", "h", F.transform("words", lambda w: F.xxhash64(w)).alias("w"))
    near_grams = kgrams(near_hashed, "w", "g").select("doc_id", "h", F.posexplode("g").alias("p", "mark"))
    spots = long_items.select("k", F.posexplode("g").alias("q", "mark")).join(marks, ["k", "mark"])
    lies = near_grams.join(_small(spots), "mark").select("doc_id", "h", "k", (F.col("p") - F.col("q")).alias("d"))
    for m in lengths:
        at = chained(near_hashed, "w", [m], "short").select("doc_id", "h", F.posexplode(f"short{m}").alias("d", "mark"))
        lies = lies.unionByName(at.join(_small(short_items.where(F.col("m") == m).select("k", "mark")), "mark").select("doc_id", "h", "k", "d"))
    lies = lies.distinct().groupBy("doc_id", "h", "k").agg(F.collect_list("d").alias("ds"))

    # compare the words of both over the item's length; a start is a hit if its whole window agrees
    both = near.join(lies, ["doc_id", "h"]).join(_small(items.select("k", "item")), "k")
    size = F.least(F.size("item"), F.lit(WINDOW))
    agrees = lambda d: F.transform("item", lambda x, j: F.coalesce(F.get("words", d + j) == x, F.lit(False)))
    lined = both.select("doc_id", "h", "k", "item", F.transform("ds", lambda d: F.struct(d.alias("d"), agrees(d).alias("eq"))).alias("lines"))
    last = F.size("item") - size
    covered = lambda line: F.transform(
        F.filter(F.sequence(F.lit(0), last), lambda s: F.forall(F.slice(line["eq"], s + 1, size), lambda e: e)),
        lambda s: F.sequence(line["d"] + s, line["d"] + s + size - 1),
    )
    found = lined.select("doc_id", "h", "k", F.array_distinct(F.flatten(F.flatten(F.transform("lines", covered)))).alias("at")).where("size(at) > 0")
    hits = found.join(items.select("k", "ids"), "k").groupBy("doc_id", "h").agg(F.size(F.array_distinct(F.flatten(F.collect_list("at")))).cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("item_ids"))
    return kept.select("doc_id", "no_id", "h", "n_words").join(hits, ["doc_id", "h"], "left").select(
        F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids")
    )
