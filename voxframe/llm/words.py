"""Words of whole batches of texts as NumPy arrays: byte spans, 64-bit hashes, hashes of runs of words."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words of anything but blanks; words of digits, a to z and all beyond ASCII.
NO_BLANK = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])
LETTERS = np.array([b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)

_CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_BYTES = np.random.default_rng(11).integers(0, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


class _Powers:
    """Powers of an odd number modulo 2**64, made as far as they were asked for, at most up to keep."""

    def __init__(self, base: int, keep: int = 4 * _CHUNK):
        self.base, self.keep, self.held = np.uint64(base), keep, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if n <= len(self.held):
            return self.held[:n]
        made = np.full(n, self.base, np.uint64)
        made[0] = 1
        made = np.cumprod(made, dtype=np.uint64)
        if n <= self.keep:
            self.held = made
        return made


_UP, _DOWN = _Powers(_BASE), _Powers(_INVERSE)


def portions(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The record batches in pieces whose texts have at most so many bytes, or one text."""
    for b in batches:
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(b.column(column)), 0), np.int64))
        at = 0
        while at < b.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most_bytes, "right")))
            yield b.slice(at, to - at)
            at = to


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and where each text begins and the last ends; a null text is empty."""
    texts = texts.cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    return data, bounds - bounds[0]


def spans(data: np.ndarray, bounds: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each run of bytes that are `inside`, and the place in bounds of its text."""
    is_in = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    before = np.zeros(len(data), bool)
    before[1:] = is_in[:-1]
    after = np.zeros(len(data), bool)
    after[:-1] = is_in[1:]
    starts = np.flatnonzero(is_in & (~before | edge[:-1]))
    ends = np.flatnonzero(is_in & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(bounds, starts, "right") - 1


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes in their order."""
    z = a * np.uint64(_BASE) + b
    z ^= z >> np.uint64(32)
    z *= np.uint64(0xD6E8FEB86659FD93)
    z ^= z >> np.uint64(29)
    return z


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans in ascending order. Sums are made over at most a MB of bytes at once, or one longer span."""
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + _CHUNK, "right")))
        low, high = starts[a], ends[b - 1]
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_BYTES[data[low:high]] * _UP.upto(high - low), out=sums[1:])
        s, e = starts[a:b] - low, ends[a:b] - low
        out[a:b] = (sums[e] - sums[s]) * _DOWN.upto(high - low)[s]
        a = b
    return mixed(out, (ends - starts).astype(np.uint64))


def span_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs of word hashes from starts to before ends."""
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * _UP.upto(len(words)), out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * _DOWN.upto(len(words) + 1)[starts], (ends - starts).astype(np.uint64))


def gram_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of each `length` consecutive word hashes, by doubling; the last step overlaps where length isn't a power of two."""
    grams, have = words, 1
    while have < length:
        step = min(have, length - have)
        grams, have = mixed(grams[: max(0, len(grams) - step)], grams[step:]), have + step
    return grams


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the least, first if equal, of each `width` consecutive values."""
    at, have = np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        left, right = at[: max(0, len(at) - step)], at[step:]
        at, have = np.where(values[right] < values[left], right, left), have + step
    return at
