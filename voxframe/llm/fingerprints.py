"""Canonical exact digests: normal form, case and white space folded, then wide xxhash and a comparison of bytes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxframe.llm.common import blocks_for, free_name, written

_LEAST = -(2**63)
#: Ranges of ids at most, one number each in the plan; beyond MOST_RANGES * 4096 rows a range grows.
MOST_RANGES = 65_536
#: Digests of shared buckets are broadcast only if a count finds at most so many.
MOST_BROADCAST = 200_000


def canonical(text: Column) -> Column:
    """NFKC, full case folding, NFKC again, each run of white space one blank, none at the ends; null counts as empty.

    The normal form and the folding come from the ICU library Spark ships, through the SQL function reflect.
    """
    def icu(cls: str, method: str, x: Column) -> Column:
        return F.reflect(F.lit(f"com.ibm.icu.{cls}"), F.lit(method), x, F.lit(True))

    folded = icu("lang.UCharacter", "foldCase", icu("text.Normalizer", "compose", F.coalesce(text, F.lit(""))))
    return F.trim(F.regexp_replace(icu("text.Normalizer", "compose", folded), r"[\s\p{Z}\x{85}\x1c-\x1f]+", " "))


def digest(canon: Column) -> Column:
    """128 bits of xxhash of a canonical text, 32 hex digits."""
    half = lambda *x: F.lpad(F.lower(F.hex(F.xxhash64(*x))), 16, "0")
    return F.concat(half(canon), half(F.lit(1), canon))


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """docs with `out`, equal for equal canonical texts; rows and other columns stay, a clashing `out` is replaced."""
    canon = free_name([*docs.columns, out], "_canon")
    return docs.withColumn(canon, canonical(F.col(text))).withColumn(out, digest(F.col(canon))).drop(canon)


def likeness(a: Column, b: Column, canon_a: Column, canon_b: Column) -> Column:
    """1.0 where the digests are equal and the canonical bytes as well, else 0.0."""
    return F.when(a == b, F.when(canon_a == canon_b, 1.0).otherwise(0.0)).otherwise(0.0)


def canonical_groups(docs: DataFrame) -> DataFrame:
    """fingerprint, canon_sha256, group_id (least doc_id), n: one row for each set of two or more rows (doc_id, text) with one canonical text.

    Buckets are the wide digests; inside a bucket the grouping goes on by the canonical bytes, so texts that merely
    share a digest stay apart. Digests alone are counted first: texts travel only for buckets of two or more, and
    copies meet before the shuffle, so a hot group is one row a task. Empty and null texts form one group.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), canonical(F.col("text")).alias("canon")).withColumn("fingerprint", digest(F.col("canon")))
    shared = written(rows.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").select("fingerprint"), "buckets")
    if shared.count() <= MOST_BROADCAST:
        shared = F.broadcast(shared)  # 32 bytes a row
    found = rows.join(shared, "fingerprint", "left_semi").groupBy("fingerprint", "canon").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("n"))
    return found.where("n > 1").select("fingerprint", F.unhex(F.sha2("canon", 256)).alias("canon_sha256"), "group_id", "n")


def _bucket_of(id_: Column, tie: Column, ids: Column, ties: Column, count: int) -> Column:
    """Place of the last of `count` bounds (ids, ties) that aren't above (id, tie), 0 if there is none: a binary search in constant arrays."""
    steps = max(1, math.ceil(math.log2(count + 1)))

    def step(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"] + 1) / F.lit(2)).cast("int")
        up = (F.get(ids, mid) < id_) | ((F.get(ids, mid) == id_) & (F.get(ties, mid) <= tie))
        return F.when(acc["lo"] < acc["hi"], F.struct(F.when(up, mid).otherwise(acc["lo"]).alias("lo"), F.when(up, acc["hi"]).otherwise(mid - 1).alias("hi"))).otherwise(acc)

    start = F.struct(F.lit(0).alias("lo"), F.lit(count - 1).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda acc: acc["lo"])


def with_next(docs: DataFrame, columns: list[str], per_block: int = 4_096) -> DataFrame:
    """docs and next_<c> for each column: the values of the next row by ascending doc_id, after the last the first.

    Rows are dealt into ranges of (id, hash of the text) of about per_block rows (more where that would be over MOST_RANGES ranges), whose bounds
    come from a pass over these keys alone and are one constant of the plan; the first row of a range also goes to the range
    before it. So texts are shuffled once and no task orders more than a range, however many rows have one id or none; only rows of one id
    and one text stay together.
    Null ids come first; rows with one id follow each other by a hash of their text.
    """
    docs = docs.withColumn("_key", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST))).withColumn("_tie", F.xxhash64("text"))
    keys = docs.select("_key", "_tie")
    many = min(MOST_RANGES, blocks_for(keys.count(), per_block))
    # two numbers a range come to the driver, and go into the plan as two strings that Spark folds into arrays
    lows = keys.repartitionByRange(many, "_key", "_tie").groupBy(F.spark_partition_id()).agg(F.min(F.struct("_key", "_tie")).alias("low")).collect()
    bounds = sorted((r["low"]["_key"], r["low"]["_tie"]) for r in lows) or [(_LEAST, _LEAST)]
    ids, ties = (F.split(F.lit(",".join(map(str, x))), ",").cast("array<bigint>") for x in zip(*bounds, strict=True))
    own = docs.withColumn("_range", _bucket_of(F.col("_key"), F.col("_tie"), ids, ties, len(bounds)))
    first = (F.col("_key") == F.get(ids, F.col("_range"))) & (F.col("_tie") == F.get(ties, F.col("_range")))
    place = lambda r, halo: F.struct(r.cast("int").alias("range"), F.lit(halo).alias("halo"))
    here = place(F.col("_range"), False)
    before = place(F.pmod(F.col("_range") - 1, F.lit(len(bounds))), True)
    placed = own.withColumn("_place", F.explode(F.when(first, F.array(here, before)).otherwise(F.array(here)))).drop("_range")
    dealt = placed.select("*", F.col("_place.range").alias("_in"), F.col("_place.halo").alias("_halo")).drop("_place")
    line = Window.partitionBy("_in").orderBy("_halo", "_key", "_tie")
    led = dealt.select("*", *[F.lead(c).over(line).alias(f"next_{c}") for c in columns])  # one window, one shuffle
    return led.where("not _halo").drop("_in", "_halo", "_key", "_tie")


def edited_likeness(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, group_id of each row (doc_id, text).

    group_id is the least doc_id of the rows with the same canonical text, by bucket and bytes (a row's own where there is no other;
    null if all of them have none). A null text is empty; a null doc_id comes before all others; rows of one id stand next to
    each other, so a repeated row's next is its copy; a single row's next is itself. Other columns are ignored; an empty
    table gives no rows; texts are read whole.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    groups = written(canonical_groups(docs), "canonical-groups")
    rows = with_next(with_fingerprint(docs), ["text", "fingerprint"])
    n = F.length("text")
    half = F.floor(n / F.lit(2)).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.withColumn("edited", edited).withColumn("edited_canon", canonical(F.col("edited"))).withColumn("edited_fingerprint", digest(F.col("edited_canon")))
    rows = rows.withColumn("mine", canonical(F.col("text")))
    rows = rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), F.col("mine"), F.col("edited_canon")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint"), F.col("mine"), canonical(F.col("next_text"))).alias("near_next"),
        F.unhex(F.sha2("mine", 256)).alias("canon_sha256"),
    )
    placed = rows.join(groups.drop("n"), ["fingerprint", "canon_sha256"], "left")
    return placed.withColumn("group_id", F.coalesce("group_id", "doc_id")).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "group_id")
