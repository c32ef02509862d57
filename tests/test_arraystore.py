"""Chunked array stores: the documented layout by hand, and what was written read again."""

import json
import os
import zlib

import numpy as np
import pytest

from tessella.operators import pyramid
from tessella.sources import arraystore


def put(folder, shape, chunks, kind, files, **more):
    os.makedirs(folder, exist_ok=True)
    about = {"zarr_format": 2, "shape": shape, "chunks": chunks, "dtype": kind, "compressor": None, "fill_value": 0, "order": "C", "filters": None, **more}
    with open(f"{folder}/.zarray", "w") as f:
        json.dump(about, f)
    for name, data in files.items():
        os.makedirs(os.path.dirname(f"{folder}/{name}"), exist_ok=True)
        with open(f"{folder}/{name}", "wb") as f:
            f.write(data)


def planes(tiles, size):
    out = {}
    for t in tiles.collect():
        plane = out.setdefault((t.level, t.c), np.full((t.height, t.width), 99, t.dtype))
        plane[t.ty * size : t.ty * size + t.h, t.tx * size : t.tx * size + t.w] = np.frombuffer(t.data, t.dtype).reshape(t.h, t.w)
    return out


def test_layouts_made_by_hand(spark, tmp_path):
    a = np.arange(5 * 7).reshape(5, 7)
    full = np.pad(a, ((0, 3), (0, 1)), constant_values=77)  # chunks at the borders hold more than the image
    cut = {f"{i}.{j}": full[4 * i : 4 * i + 4, 4 * j : 4 * j + 4].astype(">i2").tobytes() for i in range(2) for j in range(2)}
    put(f"{tmp_path}/plain", [5, 7], [4, 4], ">i2", cut)
    assert (planes(arraystore.open_store(spark, tmp_path / "plain"), 4)[0, 0] == a).all()
    del cut["0.1"]
    put(f"{tmp_path}/sparse", [5, 7], [4, 4], ">i2", cut, fill_value=-3)
    got = planes(arraystore.read_store(spark, f"{tmp_path}/sparse"), 4)[0, 0]
    assert (got[:4, 4:] == -3).all() and (got[4:] == a[4:]).all()
    many = {f"{t}/{c}/0/0": zlib.compress(np.full((4, 4), 10 * t + c, "<f4").tobytes()) for t in range(2) for c in range(3)}
    put(f"{tmp_path}/group/0", [2, 3, 3, 3], [1, 1, 4, 4], "<f4", many, compressor={"id": "zlib", "level": 1}, dimension_separator="/", fill_value="NaN")
    put(f"{tmp_path}/group/1", [2, 3, 2, 2], [1, 1, 4, 4], "<f4", {}, dimension_separator="/", fill_value="NaN")
    (tmp_path / "group" / ".zgroup").write_text('{"zarr_format": 2}')
    got = planes(arraystore.open_store(spark, f"{tmp_path}/group"), 4)
    assert {k: v.flat[0] for k, v in got.items() if k[0] == 0} == {(0, 3 * t + c): 10 * t + c for t in range(2) for c in range(3)}
    assert all(np.isnan(v).all() and v.shape == (2, 2) for k, v in got.items() if k[0] == 1) and len(got) == 12


def test_only_chosen_chunks_are_opened(spark, tmp_path):
    good = np.ones((4, 4), "<u1").tobytes()
    put(f"{tmp_path}/s", [8, 8], [4, 4], "|u1", {"0.0": good, "0.1": b"broken", "1.0": good, "1.1": b"broken"})
    assert arraystore.read_store(spark, f"{tmp_path}/s", "tx = 0").count() == 2
    with pytest.raises(Exception, match="6 bytes of 16"):
        arraystore.read_store(spark, f"{tmp_path}/s").collect()


@pytest.mark.parametrize("compressor", [None, "zlib", "gzip"])
def test_round_trip(spark, tmp_path, compressor):
    rng = np.random.default_rng(3)
    images = {"a": rng.integers(0, 9, (2, 70, 45)).astype(np.uint16), "b": np.zeros((1, 20, 20), np.uint16)}
    rows = [(n, 0, 0, c, 0, 0, *p.shape, *p.shape, "uint16", p.tobytes()) for n, x in images.items() for c, p in enumerate(x)]
    base = pyramid.retile(spark.createDataFrame(rows, pyramid.TILES.replace("ty long, tx long", "y0 long, x0 long")), 16)
    tiles = base.unionByName(pyramid.reduced(base, 16))
    arraystore.write_store(tiles, f"{tmp_path}/out", 16, compressor)
    for name, x in images.items():
        got = planes(arraystore.open_store(spark, f"{tmp_path}/out/{name}"), 16)
        assert got.keys() == {(k, c) for k in range(2) for c in range(len(x))}
        assert all((got[k, c] == x[c, :: 1 << k, :: 1 << k]).all() for k, c in got)
    assert not [f for _, _, files in os.walk(f"{tmp_path}/out/b") for f in files if not f.startswith(".")]  # nothing but fill value


def test_what_is_no_store(spark, tmp_path):
    tiles = spark.createDataFrame([], pyramid.TILES + ", more int")
    assert arraystore.open_store(spark, tiles).columns == pyramid.NAMES
    tiles.drop("more").write.parquet(f"{tmp_path}/kept/tiles/step=0")
    assert arraystore.open_store(spark, f"{tmp_path}/kept").count() == 0
    for bad in (3, None, b"x", str(tmp_path / "nowhere"), tiles.drop("data")):
        with pytest.raises(ValueError):
            arraystore.open_store(spark, bad)
    put(f"{tmp_path}/other", [4, 4], [4, 4], "|u1", {}, compressor={"id": "blosc"})
    with pytest.raises(NotImplementedError, match="blosc"):
        arraystore.open_store(spark, f"{tmp_path}/other")
