"""Removal of passages that occur more than once, by level-wise doubling.

Every window of `window` words is stood for, at a length L, by the least of its runs of L words (by hash, the first if
equal). Equal windows have equal runs at equal places, so a window whose run no other place has is unique, and is let go.
The windows that remain are looked at again at twice the length, up to the window itself, until none remains.

Neighbouring windows that one run stands for make a unit, whose context is all the words of its windows. Units of one context are
repeated as they are and need no longer runs; one of them goes on for the sake of others that share its run in another context.
So families of copies cost one row a unit, and are never paired.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.llm.common import drop, shared_dir, written
from voxframe.llm.words import NO_BLANK, buffers, gram_hashes, hashes, least_places, mixed, portions, span_hashes, spans

#: The first length; words in a row so many that most texts share only what was copied.
BASE = 8
#: A key with more than this share of the rows meets its partner by broadcast; there are at most 1 / HOT such keys.
HOT = 0.001

SURE, LIVE = 1, 2
_KEY = ["t1", "t2"]
_STATE = "t1 long, t2 int, sure array<int>, live array<int>, h array<long>, c array<long>, m array<int>"


def levels(window: int, base: int = BASE) -> list[int]:
    """base, doubled while below window, then window."""
    out = [min(base, window)]
    while out[-1] < window:
        out.append(min(2 * out[-1], window))
    return out


def _text_key(text: Column) -> list[Column]:
    """96 bits of hashes that stand for a text."""
    return [F.xxhash64(text).alias("t1"), F.hash(F.lit(1), text).alias("t2")]


class _Texts:
    """Distinct texts and their numbers of rows, written once in buckets of their key, so that joins by it move no text again."""

    def __init__(self, docs: DataFrame):
        self.spark: SparkSession = docs.sparkSession
        rows = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).select(*_text_key(F.col("text")), "text")
        texts = rows.groupBy(*_KEY).agg(F.first("text").alias("text"), F.count("*").alias("copies"))
        self.name = f"texts_{uuid.uuid4().hex}"
        path = f"{shared_dir(self.spark)}/{self.spark.sparkContext.applicationId}/{self.name}"
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        texts.write.bucketBy(buckets, *_KEY).option("path", path).format("parquet").saveAsTable(self.name)
        self.table = self.spark.table(self.name)
        self.table._written_path = path

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE {self.name}")
        drop(self.table)


def _runs(places: np.ndarray, *kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first and the last of each run of consecutive ascending places of equal kinds."""
    if not len(places):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.diff(places) != 1
    for kind in kinds:
        new |= np.diff(kind) != 0
    new = np.flatnonzero(new) + 1
    return np.concatenate([[0], new]), np.concatenate([new - 1, [len(places) - 1]])


def _within(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All places of the ranges."""
    sizes = last - first + 1
    return np.repeat(first - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the row of each."""
    sizes = np.asarray(column.value_lengths().fill_null(0))
    return np.asarray(column.flatten()), np.repeat(np.arange(len(column)), sizes)


def _lists(row: np.ndarray, values: np.ndarray, rows: int, kind: pa.DataType) -> pa.ListArray:
    """Values, in the order of their rows, as one list a row."""
    ends = np.searchsorted(row, np.arange(rows + 1), "left").astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))


class _Batch:
    """Words of a batch of texts, and the windows that lie in one text."""

    def __init__(self, texts: pa.Array, window: int):
        data, bounds = buffers(texts)
        starts, ends, self.row = spans(data, bounds, NO_BLANK)
        self.window, self.words = window, hashes(data, starts, ends)
        self.first_word = np.searchsorted(self.row, np.arange(len(texts)))

    def windows(self) -> np.ndarray:
        at = np.arange(max(0, len(self.words) - self.window + 1))
        return at[self.row[at] == self.row[at + self.window - 1]]

    def units(self, live: np.ndarray, length: int) -> pd.DataFrame:
        """Row, run hash, context hash, first and last window of each unit of the live windows."""
        if not len(live):
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("row", "h", "c", "first", "last")})
        grams = gram_hashes(self.words, length)
        least = least_places(grams, self.window - length + 1)[live]
        begin, end = _runs(live, least, self.row[live])
        first, last, at = live[begin], live[end], least[begin]
        context = span_hashes(self.words, first, last + self.window)
        context = mixed(mixed(context, (at - first).astype(np.uint64)), (last - first).astype(np.uint64))
        return pd.DataFrame({"row": self.row[first], "h": grams[at].view(np.int64), "c": context.view(np.int64), "first": first, "last": last})


def _advance(window: int, before: int | None, after: int | None):
    """A mapInArrow step: what became of the units of length `before`, and the units of length `after` of the windows that go on."""

    def run(batches):
        for b in portions(batches, "text"):
            batch, n = _Batch(b.column("text"), window), b.num_rows
            no = np.zeros(0, np.int64)
            sure_row, sure = no, no
            if before is None:
                live = batch.windows()
            else:
                ends, row = _flat(b.column("live"))
                ends = ends + batch.first_word[row]
                units = batch.units(_within(ends[::2], ends[1::2]), before)
                h, row = _flat(b.column("reply_h"))
                told = pd.DataFrame({"row": row, "h": h, "c": _flat(b.column("reply_c"))[0], "flag": _flat(b.column("reply_flag"))[0]})
                units = units.merge(told, "inner", ["row", "h", "c"]).sort_values("first", kind="stable")
                is_sure = units[(units["flag"] & SURE) > 0]
                goes_on = units[(units["flag"] & LIVE) > 0]
                live = _within(goes_on["first"].to_numpy(), goes_on["last"].to_numpy())
                sure_row = np.repeat(is_sure["row"].to_numpy(), 2)
                sure = is_sure[["first", "last"]].to_numpy().ravel() - batch.first_word[sure_row]
            first, last = (live[x] for x in _runs(live, batch.row[live]))
            live_row = np.repeat(batch.row[first], 2)
            ranges = np.stack([first, last], 1).ravel() - batch.first_word[live_row]
            if after is None:
                found = pd.DataFrame({c: no for c in ("row", "h", "c", "m")})
            else:
                found = batch.units(live, after).groupby(["row", "h", "c"]).size().reset_index(name="m")
            out = [
                b.column("t1"), b.column("t2"), _lists(sure_row, sure, n, pa.int32()), _lists(live_row, ranges, n, pa.int32()),
                *[_lists(found["row"].to_numpy(), found[c].to_numpy(), n, t) for c, t in (("h", pa.int64()), ("c", pa.int64()), ("m", pa.int32()))],
            ]
            yield pa.RecordBatch.from_arrays(out, names=["t1", "t2", "sure", "live", "h", "c", "m"])

    return run


def _kept(window: int):
    """A mapInArrow step: t1, t2, n_words, n_removed, kept_sha256 of each text, its repeated windows given as ranges."""

    def run(batches):
        for b in portions(batches, "text"):
            out = []
            for text, copies, sure in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("copies").to_pylist(), b.column("sure").to_pylist(), strict=True):
                words = text.split()  # bytes: at blanks and control characters 9 to 13 alone
                n = len(words)
                if copies > 1 and n >= window:
                    gone = n
                    words = []
                elif sure:
                    ends = np.array(sure)
                    change = np.zeros(n + 1, np.int64)
                    np.add.at(change, ends[::2], 1)
                    np.add.at(change, ends[1::2] + window, -1)
                    covered = np.cumsum(change[:-1]) > 0
                    gone = int(covered.sum())
                    words = [w for w, c in zip(words, covered.tolist(), strict=True) if not c]
                else:
                    gone = 0
                out.append((n, gone, hashlib.sha256(b" ".join(words)).hexdigest()))
            cols = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([b.column("t1"), b.column("t2"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=["t1", "t2", "n_words", "n_removed", "kept_sha256"])

    return run


def _met(left: DataFrame, right: DataFrame, keys: list[str], hot: Column) -> DataFrame:
    """left joined with the rows of right, which has each key once; those that are hot, at most 1 / HOT, are broadcast."""
    few = right.where(hot)
    if not few.take(1):
        return left.join(right, keys)
    rest = left.join(F.broadcast(few.select(*keys)), keys, "left_anti").join(right.where(~hot), keys)
    return rest.unionByName(left.join(F.broadcast(few), keys))


def _replies(state: DataFrame, dropped: list[DataFrame]) -> DataFrame | None:
    """t1, t2, reply_h, reply_c, reply_flag: what is known of each unit in state whose run has another place; None if none has."""
    units = state.select(*_KEY, F.explode(F.arrays_zip("h", "c", "m")).alias("u")).select(*_KEY, "u.h", "u.c", "u.m")
    runs = written(units.groupBy("h").agg(F.sum("m").alias("places"), (F.min("c") != F.max("c")).alias("differ")).where("places > 1"), "runs")
    dropped.append(runs)
    total = runs.agg(F.sum("places")).first()[0]
    if not total:
        return None
    known = written(_met(units, runs, ["h"], F.col("places") > HOT * total), "known")
    dropped.append(known)
    differ = known.where("differ").select(*_KEY, "h", "c", "m")
    contexts = written(differ.groupBy("h", "c").agg(F.sum("m").alias("same"), F.min("t1").alias("head")), "contexts")
    dropped.append(contexts)
    goes_on = (F.col("same") == 1) | (F.col("t1") == F.col("head"))
    flag = F.when(F.col("same") > 1, SURE).otherwise(0) + F.when(goes_on, LIVE).otherwise(0)
    told = _met(differ, contexts, ["h", "c"], F.col("same") > HOT * total).select(*_KEY, "h", "c", flag.cast("int").alias("flag"))
    told = told.unionByName(known.where("not differ").select(*_KEY, "h", "c", F.lit(SURE).alias("flag"))).where("flag > 0")
    told = told.groupBy(*_KEY).agg(F.collect_list(F.struct("h", "c", "flag")).alias("r"))
    return told.select(*_KEY, F.col("r.h").alias("reply_h"), F.col("r.c").alias("reply_c"), F.col("r.flag").alias("reply_flag"))


def remove_repeated(docs: DataFrame, window: int = 35, base: int = BASE) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of docs (doc_id, text).

    A word is what blanks and the control characters 9 to 13 set apart. Each word is removed that is covered by a window of `window` words whose
    word sequence also starts anywhere else, in the same text or another one; windows are judged on the input. kept_sha256 is the digest of the
    words that stay, joined by blanks.

    Null and empty texts have no words; texts below `window` words lose nothing; every row of a repeated text loses all its words, the first
    included; rows without a doc_id are treated like others; other columns are ignored; an empty table gives no rows. Texts are read whole: a
    task holds one portion of 4 MB of texts, or one longer text with some 100 bytes a word.
    Runs, contexts and windows are told apart by 64-bit hashes, a window by two of them.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).select("doc_id", *_text_key(F.col("text")))
    texts, dropped, sure = _Texts(docs), [], []
    lengths = levels(window, base)
    narrow = texts.table.select(*_KEY, "text")
    state = written(narrow.mapInArrow(_advance(window, None, lengths[0]), _STATE).where("size(h) > 0"), "units")
    dropped.append(state)
    for before, after in zip(lengths, [*lengths[1:], None], strict=True):
        replies = _replies(state, dropped)
        if replies is None:
            break
        asked = narrow.join(state.select(*_KEY, "live").join(replies, _KEY).hint("shuffle_hash"), _KEY)
        state = written(asked.mapInArrow(_advance(window, before, after), _STATE).where("size(h) > 0 or size(sure) > 0"), "units")
        dropped.append(state)
        sure.append(state.where("size(sure) > 0").select(*_KEY, "sure"))
    found = texts.table.withColumn("sure", F.lit(None).cast("array<int>"))
    if sure:
        ranges = sure[0]
        for more in sure[1:]:
            ranges = ranges.unionByName(more)
        ranges = ranges.groupBy(*_KEY).agg(F.flatten(F.collect_list("sure")).alias("sure"))
        found = texts.table.join(ranges.hint("shuffle_hash"), _KEY, "left")
    kept = "t1 long, t2 int, n_words long, n_removed long, kept_sha256 string"
    result = written(found.select(*_KEY, "text", "copies", "sure").mapInArrow(_kept(window), kept), "kept")
    copies = written(texts.table.where("copies > 1").select(*_KEY, "copies"), "copies")
    total = copies.agg(F.sum("copies")).first()[0] or 0
    texts.drop()
    for df in dropped:
        drop(df)
    out = _met(ids, result.join(copies, _KEY, "left").withColumn("copies", F.coalesce("copies", F.lit(1))), _KEY, F.col("copies") > max(1, HOT * total))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")
