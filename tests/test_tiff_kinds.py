"""TIFF pages of every kind: each is written and read back by the data source."""

import itertools
import random

import numpy as np
import pytest

from voxframe.sources import tiff


def test_lzw_streams():
    rng = random.Random(2)
    for data in (b"", b"a", b"ababab" * 500, bytes(rng.choices(range(256), k=30_000)), bytes(rng.choices(b"abc", k=50_000)), bytes(9000)):
        assert tiff.lzw_decode(tiff.lzw_encode(data)) == data
    # the first codes of a known stream: clear, 7, 258, 8, 8, end
    packed = int("".join(f"{c:09b}" for c in (256, 7, 258, 8, 8, 257)) + "0" * 2, 2).to_bytes(7, "big")
    assert tiff.lzw_decode(packed) == bytes([7, 7, 7, 8, 8])


def test_every_kind_of_page(spark, tmp_path):
    rng = np.random.default_rng(1)
    want = {}
    kinds = list(itertools.product((False, True), (None, 16), (tiff.PLAIN, tiff.LZW, tiff.DEFLATE), ("u1", "u2", "i4", "f4", "f8")))
    for k, (big, tile, compression, dtype) in enumerate(kinds):
        pages = [(rng.random((21, 37)) * 100).cumsum(axis=1).astype(dtype) for _ in range(2)]
        differences = compression != tiff.PLAIN and dtype[0] != "f"
        (tmp_path / f"{k:03d}.tif").write_bytes(tiff.encode_tiff(pages, "axes=TYX", ((2, 1), (4, 1)), 3, big, tile, compression, differences))
        want |= {(k, p): image for p, image in enumerate(pages)}
    spark.dataSource.register(tiff.TiffSource)
    rows = spark.read.format("tiff_frames").load(str(tmp_path)).collect()
    assert len(rows) == len(want)
    for r in rows:
        image = want[int(r["path"][-7:-4]), r["page"]]
        got = np.frombuffer(r["data"], r["dtype"]).reshape(r["height"], r["width"])
        assert got.dtype == image.dtype and (got == image).all()
        assert (r["description"], r["x_num"], r["x_den"], r["y_num"], r["unit"]) == ("axes=TYX", 2, 1, 4, "centimeter")


def test_partitions_are_ranges_of_pages(tmp_path, monkeypatch):
    monkeypatch.setattr(tiff, "MOST_PARTS", 3)
    path = tmp_path / "long.tif"
    path.write_bytes(tiff.encode_tiff([np.full((2, 3), k, np.uint16) for k in range(40)]))
    reader = tiff.TiffReader({"path": str(path)})
    parts = reader.partitions()
    assert [len(p.places) for p in parts] == [14, 14, 12]
    assert [(r[1], int(np.frombuffer(r[-1], r[-2])[0])) for p in parts for r in reader.read(p)] == [(k, k) for k in range(40)]


def test_small_files_share_a_partition(tmp_path):
    for f in range(400):
        (tmp_path / f"{f:03d}.tif").write_bytes(tiff.encode_tiff([np.full((2, 3), 10 * f + k, np.uint16) for k in range(3)]))
    (tmp_path / "long.tif").write_bytes(tiff.encode_tiff([np.full((8, 9), k, np.uint16) for k in range(500)]))
    reader = tiff.TiffReader({"path": str(tmp_path)})
    parts = reader.partitions()
    assert len(parts) < 140
    got = [(r[0][-8:-4].lstrip("/"), r[1], int(np.frombuffer(r[-1], r[-2])[0])) for p in parts for r in reader.read(p)]
    assert sorted(got) == sorted([(f"{f:03d}", k, 10 * f + k) for f in range(400) for k in range(3)] + [("long", k, k) for k in range(500)])


def test_other_files_and_compressions_are_refused(tmp_path):
    path = tmp_path / "no.tif"
    path.write_bytes(b"PK\3\4 no image")
    with pytest.raises(ValueError, match="no TIFF"):
        tiff.Tiff(str(path))
    raw = bytearray(tiff.encode_tiff([np.zeros((2, 2), np.uint8)]))
    at = raw.index((259).to_bytes(2, "little") + (3).to_bytes(2, "little"))
    raw[at + 8] = 7
    path.write_bytes(raw)
    t = tiff.Tiff(str(path))
    with pytest.raises(ValueError, match="compression 7"):
        t.page(t.directories()[0])
