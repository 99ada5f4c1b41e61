"""Sum-of-squares packing of tokenised documents into sequences of a fixed length."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxframe.llm.common import blocks_for, slices, written

_ODD = re.compile(r"<\||[\x1c-\x1f]")


_BEYOND_LATIN = re.compile("[^\x00-\xff]")
_TAIL = ".,"
_SPECIAL = "<|endoftext|>"
_WORD_END = "</w>"


class WordIds:
    """Token ids of whole texts as little-endian uint32 bytes, cached per run of non-space characters.

    The vocabulary's rules never join characters across white space, nor a run of letters with the full stop or comma
    after it, so a text's ids are those of such pieces, one after another. New pieces are encoded together,
    with a special token between them. Texts with the opener of a special token, or with the control characters on
    which white space rules differ, go to the tokenizer whole. The cache is emptied when full.
    """

    def __init__(self, path: str, most: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.cache = Tokenizer.from_file(path), most, {}
        self.special = self.tokenizer.token_to_id(_SPECIAL)
        vocabulary = self.tokenizer.get_vocab()
        self.is_end = np.zeros(1 + max(vocabulary.values()), bool)
        self.is_end[[i for t, i in vocabulary.items() if t.endswith(_WORD_END)]] = True

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _cut(self, pieces: list[str], ids: np.ndarray, ends: np.ndarray, gap: int) -> None:
        """Hold the ids of each piece, those before its end and after the one before; gap ids stand between."""
        raw, at, cache = ids.tobytes(), 0, self.cache
        for p, end in zip(pieces, (4 * ends).tolist(), strict=True):
            cache[p] = raw[at:end]
            at = end + 4 * gap

    def _learn(self, runs: Iterable[str]) -> None:
        cache, whole, cut = self.cache, {}, []
        for r in runs:
            core = r.rstrip(_TAIL)
            if core != r and core.isalpha():
                cut.append((r, core, r[len(core) :]))
                if core not in cache:
                    whole[core] = None
                if r[len(core) :] not in cache:
                    whole[r[len(core) :]] = None
            else:
                whole[r] = None
        plain = [p for p in whole if p.isalpha() and not _BEYOND_LATIN.search(p)]  # one word each, so its last token ends it
        if plain:
            ids = self._ids(" ".join(plain))
            self._cut(plain, ids, np.flatnonzero(self.is_end[ids]) + 1, 0)
        mixed = [p for p in whole if p not in cache]
        if mixed:
            ids = self._ids(_SPECIAL.join(mixed))
            self._cut(mixed, ids, np.append(np.flatnonzero(ids == self.special), len(ids)), 1)
        for r, core, tail in cut:
            cache[r] = cache[core] + cache[tail]

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if _ODD.search(text):
            return self._ids(text).tobytes()
        if not _BEYOND_LATIN.search(text):
            text = text.lower()  # as the vocabulary's own rules do, letter for letter
        runs, cache = text.split(), self.cache
        new = set(runs).difference(cache)
        if new:
            if len(cache) > self.most:
                cache.clear()
                new = set(runs)
            self._learn(new)
        return b"".join(map(cache.__getitem__, runs))


@dataclass
class HeldIds:
    """Broadcast, so a worker process makes its WordIds once and lets it go with the broadcast, before tasks of other queries."""

    path: str

    def __getstate__(self) -> dict:
        return {"path": self.path}

    @cached_property
    def ids(self) -> WordIds:
        return WordIds(self.path)


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and end_id, cut only where longer than capacity.

    A null or empty text is the end id alone; repeated rows give repeated pieces. The path is opened
    where the task runs.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    end = np.array([end_id], "<u4").tobytes()

    held = docs.sparkSession.sparkContext.broadcast(HeldIds(tokenizer_path))

    def run(batches):
        ids_of = held.value.ids
        for b in slices(batches):
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = ids_of(text) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, longest first.

    N[g] open bins have the gap g. An item goes where the sum of N[g]**2 over gaps 1..capacity-1 ends
    smallest: into a bin of some gap or into a new one; ties take the smallest gap left, an open bin first.
    """
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    count = np.zeros(capacity + 1, np.int64)  # a full bin (gap 0) and an unused one (capacity) never count
    open_at: dict[int, list[int]] = {}
    used = 0
    for i in np.argsort(-lengths, kind="stable"):
        s = int(lengths[i])
        now, after = count[s:], count[: capacity - s + 1]
        cost = np.where(now > 0, 2 * (after - now) + 2, np.iinfo(np.int64).max)
        if now[0] > 0:
            cost[0] = 1 - 2 * now[0]
        k = int(cost.argmin())
        fresh = capacity - s
        if cost[k] <= (2 * count[fresh] + 1 if 0 < fresh else 0):
            gap = s + k
            b = open_at[gap].pop()
            count[gap] -= 1
        else:
            gap, b = capacity, used
            used += 1
        bins[i], offsets[i] = b, capacity - gap
        if gap - s > 0:
            count[gap - s] += 1
            open_at.setdefault(gap - s, []).append(b)
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = 4096, block_rows: int = 65_536) -> DataFrame:
    """pieces (with length between 1 and capacity) and sequence_id, offset.

    Pieces are dealt at random, by a hash of a number that each row of the written table has, into blocks of about block_rows pieces, so rows that are
    repeated are spread like others. Each block is packed on its
    own: a task's memory is bounded by the block and the loss is the few bins each block leaves open.
    Columns of these names are replaced; an empty table packs into nothing.
    """
    pieces = pieces.drop("sequence_id", "offset")
    numbered = written(pieces.withColumn("_block", F.monotonically_increasing_id()), "numbered-pieces")
    n = blocks_for(numbered.count(), block_rows)
    dealt = numbered.withColumn("_block", F.pmod(F.xxhash64("_block"), F.lit(n)))
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop(columns="_block").sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        bins, offsets = sum_of_squares(frame["length"].to_numpy(), capacity)
        return frame.assign(sequence_id=int(key[0]) * 2**32 + bins, offset=offsets)

    return dealt.groupBy("_block").applyInPandas(run, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """token_pieces packed; pack writes them, so tokens are computed once and only their lengths and digests are kept.

    Null and empty texts are one token, the end; repeated rows are packed each; an empty table packs into nothing.
    """
    return pack(token_pieces(docs, tokenizer_path, capacity, end_id), capacity)
