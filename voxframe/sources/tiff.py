"""A Spark data source for TIFF stacks, and a writer, both in plain Python and numpy.

spark.dataSource.register(TiffSource); spark.read.format("tiff_frames").load(path) gives one row a page: path, page,
height, width, description, x_num, x_den, y_num, y_den, unit, data (row-major, little-endian), dtype. Pages are read by ranges, each a
partition with the places of its directories, so a long stack is read by many tasks and a task reads no directory but its own; small files are read
whole, many by a task. Classic and big files; strips and
tiles; uncompressed, deflated or LZW, with or without horizontal differences; 8, 16, 32 bit integers and 32, 64 bit floats; either byte order.
"""

from __future__ import annotations

import glob
import os
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, page int, height int, width int, description string, x_num long, x_den long, y_num long, y_den long, unit string, dtype string, data binary"
#: Fixed values of the TIFF 6.0 format: bytes by field type, and units by code.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 8: 2, 9: 4, 11: 4, 12: 8, 16: 8, 17: 8, 18: 8}
UNITS = {1: None, 2: "inch", 3: "centimeter"}
WIDTH, HEIGHT, BITS, COMPRESSION, DESCRIPTION, OFFSETS, ROWS, COUNTS, X_RES, Y_RES, UNIT, FORMAT = 256, 257, 258, 259, 270, 273, 278, 279, 282, 283, 296, 339
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 317, 322, 323, 324, 325
PLAIN, LZW, DEFLATE = 1, 5, 8
CLEAR, END = 256, 257
#: Partitions of a file at most; one of fewer pages has a partition for each.
MOST_PARTS = 4096
#: Of several files, those smaller than this share of all bytes, or than so many, are read whole and together.
LEAST_SHARE, LEAST_BYTES = 1 / 64, 4 << 20


def lzw_decode(data: bytes) -> bytes:
    """Bytes of a TIFF LZW stream: codes of 9 to 12 bits, high bits first, wider one code before the table is full."""
    out, table, last = [], [], b""
    bits = held = at = 0
    width = 9
    while True:
        while bits < width:
            if at == len(data):
                return b"".join(out)
            held, bits, at = (held << 8 | data[at]) & 0xFFFFFFFF, bits + 8, at + 1
        bits -= width
        code = held >> bits & ((1 << width) - 1)
        if code == END:
            return b"".join(out)
        if code == CLEAR:
            table, width, last = [bytes([b]) for b in range(256)] + [b"", b""], 9, b""
            continue
        if not table:
            raise ValueError("an LZW stream begins with a clear code")
        entry = table[code] if code < len(table) else last + last[:1]
        out.append(entry)
        if last:
            table.append(last + entry[:1])
        last = entry
        width = min(12, max(9, (len(table) + 1).bit_length()))


def lzw_encode(data: bytes) -> bytes:
    out, held, bits = bytearray(), 0, 0

    def put(code: int, width: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 0xFF)
        held &= (1 << bits) - 1

    put(CLEAR, 9)
    table, width, now = {bytes([b]): b for b in range(256)}, 9, b""
    size = 258
    for b in data:
        more = now + bytes([b])
        if more in table:
            now = more
            continue
        put(table[now], width)
        table[more], size = size, size + 1
        width = min(12, max(9, size.bit_length()))
        now = bytes([b])
        if size >= 4094:
            put(table[now], width)
            put(CLEAR, width)
            table, width, size, now = {bytes([b]): b for b in range(256)}, 9, 258, b""
    if now:
        put(table[now], width)
        width = min(12, max(9, (size + 1).bit_length()))
    put(END, width)
    if bits:
        out.append(held << (8 - bits) & 0xFF)
    return bytes(out)



class Tiff:
    def __init__(self, path: str):
        self.path = path
        with open(path, "rb") as f:
            head = f.read(16)
        self.order = {b"II": "<", b"MM": ">"}.get(head[:2])
        magic = struct.unpack(self.order + "H", head[2:4])[0] if self.order and len(head) >= 8 else None
        if magic not in (42, 43):
            raise ValueError(f"{path} is no TIFF file")
        self.big = magic == 43
        self.first = struct.unpack(self.order + ("Q" if self.big else "I"), head[8:16] if self.big else head[4:8])[0]

    def places(self) -> list[int]:
        """Where the directories of all pages lie; only their links are read."""
        out, at = [], self.first
        count, entry, link = ("Q", 20, "Q") if self.big else ("H", 12, "I")
        with open(self.path, "rb") as f:
            while at:
                out.append(at)
                f.seek(at)
                n = struct.unpack(self.order + count, f.read(struct.calcsize(count)))[0]
                f.seek(entry * n, 1)
                at = struct.unpack(self.order + link, f.read(struct.calcsize(link)))[0]
        return out

    def directory(self, at: int) -> dict:
        """Tags of the page whose directory lies there; pixel data stay unread."""
        count, head, offset = ("Q", "HHQ", "Q") if self.big else ("H", "HHI", "I")
        size_of_head, inline = struct.calcsize("=" + head), struct.calcsize(offset)
        tags = {}
        with open(self.path, "rb") as f:
            f.seek(at)
            n = struct.unpack(self.order + count, f.read(struct.calcsize(count)))[0]
            entries = f.read((size_of_head + inline) * n)
            for k in range(n):
                raw = entries[k * (size_of_head + inline) : (k + 1) * (size_of_head + inline)]
                tag, kind, values = struct.unpack(self.order + head, raw[:size_of_head])
                size, raw = SIZES.get(kind, 1) * values, raw[size_of_head:]
                if size > inline:
                    f.seek(struct.unpack(self.order + offset, raw)[0])
                    raw = f.read(size)
                tags[tag] = self._value(kind, values, raw[:size])
        return tags

    def directories(self) -> list[dict]:
        return [self.directory(at) for at in self.places()]

    def _value(self, kind: int, count: int, raw: bytes):
        if kind == 2:
            return raw.rstrip(b"\0").decode("utf-8", "replace")
        if kind == 5:
            return struct.unpack(f"{self.order}{2 * count}I", raw)
        code = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q", 18: "Q"}.get(kind)
        return struct.unpack(f"{self.order}{count}{code}", raw) if code else raw

    def _unpacked(self, raw: bytes, tags: dict) -> bytes:
        method = tags.get(COMPRESSION, (PLAIN,))[0]
        if method in (DEFLATE, 32946):
            return zlib.decompress(raw)
        if method == LZW:
            return lzw_decode(raw)
        if method != PLAIN:
            raise ValueError(f"compression {method} of {self.path} is not supported")
        return raw

    def page(self, tags: dict) -> np.ndarray:
        height, width, bits = tags[HEIGHT][0], tags[WIDTH][0], tags.get(BITS, (8,))[0]
        dtype = np.dtype(f"{self.order}{ {1: 'u', 2: 'i', 3: 'f'}[tags.get(FORMAT, (1,))[0]] }{bits // 8}")
        tiled = TILE_OFFSETS in tags
        high, wide = (tags[TILE_HEIGHT][0], tags[TILE_WIDTH][0]) if tiled else (min(height, tags.get(ROWS, (height,))[0]), width)
        across = -(-width // wide)
        image = np.zeros((height, width), dtype.newbyteorder("<"))
        with open(self.path, "rb") as f:
            for k, (at, size) in enumerate(zip(tags[TILE_OFFSETS if tiled else OFFSETS], tags[TILE_COUNTS if tiled else COUNTS], strict=True)):
                f.seek(at)
                y, x = k // across * high, k % across * wide
                rows = high if tiled else min(high, height - y)
                part = np.frombuffer(self._unpacked(f.read(size), tags), dtype, rows * wide).reshape(rows, wide)
                if tags.get(PREDICTOR, (1,))[0] == 2:
                    part = np.cumsum(part, axis=1, dtype=dtype.newbyteorder("="))
                image[y : y + high, x : x + wide] = part[: height - y, : width - x]
        return image


class _Pages(InputPartition):
    """Pages first .. of a file, by the places of their directories."""

    def __init__(self, path: str, first: int, places: list[int]):
        self.path, self.first, self.places = path, first, places


class _Files(InputPartition):
    """All pages of small files; the task that reads them finds their directories."""

    def __init__(self, paths: list[str]):
        self.paths = paths


class TiffReader(DataSourceReader):
    def __init__(self, options):
        self.root = options.get("path", "").removeprefix("file://")

    def files(self) -> list[str]:
        if os.path.isdir(self.root):
            return sorted(p for end in ("tif", "tiff", "TIF", "TIFF") for p in glob.glob(f"{self.root}/*.{end}"))
        return sorted(glob.glob(self.root)) or [self.root]

    def partitions(self):
        files = self.files()
        sizes = [os.path.getsize(path) for path in files]
        small = min(sum(sizes) * LEAST_SHARE, LEAST_BYTES) if len(files) > 1 else 0
        out, held, together = [], 0, []
        for path, size in zip(files, sizes, strict=True):
            if size < small:
                together.append(path)
                held += size
                if held >= small:
                    out.append(_Files(together))
                    held, together = 0, []
                continue
            places = Tiff(path).places()
            each = max(1, -(-len(places) // MOST_PARTS), int(len(places) * small / size))
            out += [_Pages(path, k, places[k : k + each]) for k in range(0, len(places), each)]
        return out + ([_Files(together)] if together else [])

    def read(self, partition):
        if isinstance(partition, _Files):
            for path in partition.paths:
                yield from self.read(_Pages(path, 0, Tiff(path).places()))
            return
        tiff = Tiff(partition.path)
        for page, at in enumerate(partition.places, partition.first):
            tags = tiff.directory(at)
            image = tiff.page(tags)
            x, y = tags.get(X_RES, (None, None)), tags.get(Y_RES, (None, None))
            unit = UNITS.get(tags.get(UNIT, (2,))[0]) if UNIT in tags else None
            yield (partition.path, page, *image.shape, tags.get(DESCRIPTION), *x, *y, unit, image.dtype.str, image.tobytes())


class TiffSource(DataSource):
    @classmethod
    def name(cls):
        return "tiff_frames"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return TiffReader(self.options)


def encode_tiff(
    pages: list[np.ndarray], description: str = "", resolution: tuple[tuple[int, int], tuple[int, int]] | None = None, unit: int | None = None, big: bool = False, tile: int | None = None, compression: int = PLAIN, differences: bool = False
) -> bytes:
    """A little-endian stack, one strip a page or tiles of a size; resolution as (numerator, denominator) of X and Y."""
    long, count, offset = (16, "Q", "Q") if big else (4, "H", "I")
    out = bytearray(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 0) if big else b"II*\0\0\0\0\0")
    link = 8 if big else 4
    pack = {PLAIN: bytes, DEFLATE: zlib.compress, LZW: lzw_encode}[compression]

    def put(raw: bytes) -> int:
        at = len(out)
        out.extend(raw + b"\0" * (len(raw) % 2))
        return at

    for image in pages:
        image = np.ascontiguousarray(image).astype(image.dtype.newbyteorder("<"))
        height, width = image.shape
        if tile:
            padded = np.pad(image, [(0, -n % tile) for n in image.shape])
            parts = [padded[y : y + tile, x : x + tile] for y in range(0, height, tile) for x in range(0, width, tile)]
        else:
            parts = [image]
        if differences:
            parts = [np.diff(p, axis=1, prepend=np.zeros((len(p), 1), p.dtype)).astype(p.dtype) for p in parts]
        packed = [pack(p.tobytes()) for p in parts]
        at = [put(p) for p in packed]
        fields = [(WIDTH, long, [width]), (HEIGHT, long, [height]), (BITS, 3, [image.dtype.itemsize * 8]), (COMPRESSION, 3, [compression]), (FORMAT, 3, [{"u": 1, "i": 2, "f": 3}[image.dtype.kind]])]
        fields += [(TILE_WIDTH, long, [tile]), (TILE_HEIGHT, long, [tile]), (TILE_OFFSETS, long, at), (TILE_COUNTS, long, [len(p) for p in packed])] if tile else [(OFFSETS, long, at), (ROWS, long, [height]), (COUNTS, long, [len(p) for p in packed])]
        fields += [(PREDICTOR, 3, [2])] * differences + ([(UNIT, 3, [unit])] if unit else [])
        entries = []
        for tag, kind, values in fields:
            raw = struct.pack(f"<{len(values)}{ {3: 'H', 4: 'I', 16: 'Q'}[kind] }", *values)
            entries.append((tag, kind, len(values), raw))
        text = description.encode() + b"\0"
        entries += [(DESCRIPTION, 2, len(text), text)] if description else []
        entries += [(tag, 5, 1, struct.pack("<2I", *r)) for tag, r in zip((X_RES, Y_RES), resolution, strict=True)] if resolution else []
        inline = struct.calcsize(offset)
        written = [struct.pack(f"<HH{offset}", tag, kind, n) + (raw.ljust(inline, b"\0") if len(raw) <= inline else struct.pack("<" + offset, put(raw))) for tag, kind, n, raw in sorted(entries)]
        struct.pack_into("<" + offset, out, link, len(out))
        out += struct.pack("<" + count, len(written)) + b"".join(written)
        link = len(out)
        out += b"\0" * inline
    return bytes(out)


def write_stacks(cells: DataFrame, stack: str, frame: str, value: str, root: str) -> None:
    """One TIFF stack <stack>.tif below root for each value of `stack`: its frames in order as pages of 64 bit floats.

    A stack is one task's input, and is written by that task through the file system its executor sees (file:// paths only).
    """
    folder = root.removeprefix("file://")
    os.makedirs(folder, exist_ok=True)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        name = int(pdf[stack].iloc[0])
        shape = pdf["y"].max() + 1, pdf["x"].max() + 1
        pages = []
        for _, rows in pdf.groupby(frame, sort=True):
            image = np.zeros(shape)
            image[rows["y"], rows["x"]] = rows[value]
            pages.append(image)
        path = f"{folder}/{name:08d}.tif"
        with open(f"{path}.part-{os.getpid()}", "wb") as f:
            f.write(encode_tiff(pages, "axes=TYX"))
        os.replace(f"{path}.part-{os.getpid()}", path)  # whole or not at all, also when a task is run twice
        return pd.DataFrame({"stack": [name], "pages": [len(pages)]})

    cells.select(stack, frame, "y", "x", value).groupBy(stack).applyInPandas(run, "stack long, pages long").collect()  # two numbers a stack


def _cells(pages: list[tuple[str, int, np.ndarray]]) -> pa.RecordBatch:
    sizes = [image.size for _, _, image in pages]
    yx = np.concatenate([np.indices(image.shape, np.int32).reshape(2, -1) for _, _, image in pages], axis=1)
    path = pa.array([path for path, _, _ in pages]).take(pa.array(np.repeat(np.arange(len(pages)), sizes)))
    page = np.repeat(np.array([page for _, page, _ in pages], np.int32), sizes)
    v = np.concatenate([image.ravel().astype(float) for _, _, image in pages])
    return pa.RecordBatch.from_arrays([path, pa.array(page), pa.array(yx[0]), pa.array(yx[1]), pa.array(v)], names=["path", "page", "y", "x", "v"])


def pages_to_cells(pages: DataFrame) -> DataFrame:
    """path, page, y, x, v of every cell of the pages that the source reads."""

    def run(batches):
        for b in batches:
            held, n = [], 0
            for row in b.to_pylist():
                image = np.frombuffer(row["data"], row["dtype"]).reshape(row["height"], row["width"])
                held.append((row["path"], row["page"], image))
                n += image.size
                if n >= 65_536:  # cells of many small pages make one batch
                    yield _cells(held)
                    held, n = [], 0
            if held:
                yield _cells(held)

    return pages.select("path", "page", "height", "width", "dtype", "data").mapInArrow(run, "path string, page int, y int, x int, v double")
