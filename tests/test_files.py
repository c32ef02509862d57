"""Codecs, short data, files written in ranges, Spark's own writing, and blocks cut before the shuffle."""

import glob
import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.operators import codecs, jpeg, packbits, pyramid
from tessella.sinks import ometiff
from tessella.sources import tiff
from tessella.sources.files import Ranges

from .tiff_writer import write_tiff


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(1, 300))).map(lambda x: b"".join(bytes([v]) * n for v, n in x)))
def test_packbits_round_trip(data):
    packed = packbits.encode(data)
    assert packbits.decode(packed) == data and len(packed) <= len(data) + -(-len(data) // 128)


def test_packbits_of_the_format():
    """The example of Apple's note on the format."""
    packed = bytes.fromhex("feaa0280002afdaa0380002a22f7aa")
    assert packbits.decode(packed) == bytes.fromhex("aaaaaa80002aaaaaaaaa80002a22aaaaaaaaaaaaaaaaaaaa") == packbits.decode(b"\x80" + packed)
    for n in (1, 4, len(packed) - 1):
        with pytest.raises(ValueError):
            packbits.decode(packed[:n])


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 15), st.integers(1, 5), st.integers(1, 40), st.integers(0, 2**32 - 1))
def test_bits_round_trip(bits, rows, n, seed):
    values = np.random.default_rng(seed).integers(0, 1 << bits, (rows, n)).astype(codecs.container("uint", bits) if bits != 8 else "uint8")
    packed = codecs.packed(values, bits)
    text = "".join("".join(f"{v:0{bits}b}" for v in row).ljust(-(-n * bits // 8) * 8, "0") for row in values.tolist())
    assert packed == int(text, 2).to_bytes(len(text) // 8, "big") and (codecs.unpacked(packed, rows, n, bits) == values).all()


@pytest.mark.parametrize("kind", ["uint8", "uint16", "int32", "float32", "float64"])
@pytest.mark.parametrize("predictor", [1, 2, 3])
@pytest.mark.parametrize("compression", ["Uncompressed", "LZW", "Deflate", "PackBits"])
def test_block_round_trip(kind, predictor, compression):
    rng = np.random.default_rng(4)
    block = (rng.normal(0, 1000, (16, 24, 3))).astype(kind)
    code = codecs.NAMES[compression]
    if predictor == 3 and not kind.startswith("float"):
        with pytest.raises(ValueError):
            codecs.encode_blocks([block], code, predictor=3)
        return
    (data,) = codecs.encode_blocks([block], code, predictor=predictor)
    assert codecs.decode_block(data, code, predictor, kind, 16, 24, 3, True).tobytes() == block.tobytes()


def test_floating_predictor_of_the_format():
    """Bytes of the same weight stand together, as differences of their neighbours."""
    row = np.array([[[1.0], [1.5], [-2.0]]], np.float32)  # 3f800000 3fc00000 c0000000
    planes = [0x3F, 0x3F, 0xC0, 0x80, 0xC0, 0, 0, 0, 0, 0, 0, 0]
    want = bytes((b - a) % 256 for a, b in zip([0, *planes], planes, strict=False))
    assert codecs.byte_planes(row) == want and (codecs.from_byte_planes(want, 1, 3, 1, "float32") == row).all()


@pytest.mark.parametrize("compression", ["Uncompressed", "LZW", "Deflate", "PackBits", "JPEG"])
def test_short_blocks_are_errors(compression):
    block = np.random.default_rng(1).integers(0, 255, (64, 64, 1)).astype(np.uint8)
    code = codecs.NAMES[compression]
    (data,) = codecs.encode_blocks([block], code)
    assert codecs.decode_block(data + b"\0\0", code, 1, "uint8", 64, 64, 1, True).shape == (64, 64, 1)
    for part in (1 / 100, 1 / 4, 0.9):
        with pytest.raises(ValueError):
            codecs.decode_block(data[: int(len(data) * part)], code, 1, "uint8", 64, 64, 1, True)
    assert not codecs.decode_block(b"", code, 1, "uint8", 64, 64, 1, True).any()  # a block that the file leaves out


def test_files_that_end_early(spark, tmp_path):
    image = np.arange(64 * 64, dtype=np.uint16).reshape(64, 64)
    for name, more in (("a", {"tile": 32}), ("b", {"rows_per_strip": 16, "deflate": True})):
        write_tiff(tmp_path / name, [(image, None)], **more)
        (row,) = tiff.pages_of(str(tmp_path / name))
        page = dict(row, byte_counts=[*row["byte_counts"][:-1], row["byte_counts"][-1] + 10**6])
        frame = spark.createDataFrame([tuple(page[n] for n in tiff.names_of(tiff.PAGES))], tiff.PAGES)
        with pytest.raises(Exception, match="ends within block"):
            tiff.read_blocks(frame).collect()
        cut = dict(row, byte_counts=[*row["byte_counts"][:-1], row["byte_counts"][-1] // 2])
        with pytest.raises(Exception, match="ends after"):
            tiff.read_blocks(spark.createDataFrame([tuple(cut[n] for n in tiff.names_of(tiff.PAGES))], tiff.PAGES)).collect()
        sparse = dict(row, offsets=[0, *row["offsets"][1:]], byte_counts=[0, *row["byte_counts"][1:]])
        blocks = tiff.read_blocks(spark.createDataFrame([tuple(sparse[n] for n in tiff.names_of(tiff.PAGES))], tiff.PAGES)).collect()
        assert sum(not any(b.data) for b in blocks) == 1


def tiles_of(spark, images, size=16):
    rows = [(name, 0, 0, c, 0, 0, *a.shape, *a.shape, a.dtype.name, a.tobytes()) for name, planes in images.items() for c, a in enumerate(planes)]
    schema = pyramid.TILES.replace("ty long, tx long", "y0 long, x0 long")
    base = pyramid.retile(spark.createDataFrame(rows, schema).repartition(4), size)
    return base.unionByName(pyramid.reduced(base.where("height > 60"), size)).where("level < 2")


@pytest.fixture
def images():
    rng = np.random.default_rng(6)
    return {n: [rng.integers(0, 4000, (h, w)).astype(np.uint16) for _ in range(c)] for n, h, w, c in (("a", 90, 70, 3), ("b", 20, 33, 1), ("c", 100, 16, 2))}


def pixels_of(path):
    """Whole levels by channel."""
    out = {}
    with tiff.open_file(path) as file:
        for row in tiff.pages_of(path):
            plane = np.zeros((row["height"], row["width"]), row["dtype"])
            for block, (offset, count) in enumerate(zip(row["offsets"], row["byte_counts"], strict=True)):
                part = tiff.SimpleNamespace(**(row | {"offsets": offset, "byte_counts": count}), block=block)
                for x in tiff.decoded(file, part):
                    plane[x[4] : x[4] + x[6], x[5] : x[5] + x[7]] = np.frombuffer(x[11], x[10]).reshape(x[6], x[7])
            out[row["page"], row["level"]] = plane
    return out


def same(path, planes):
    got = pixels_of(path)
    want = {(c, 0): a for c, a in enumerate(planes)} | ({(c, 1): a[::2, ::2] for c, a in enumerate(planes)} if len(planes[0]) > 60 else {})
    assert got.keys() == want.keys() and all((got[k] == want[k]).all() for k in want)


@pytest.mark.parametrize("big", [False, True])
def test_many_writers_give_the_same_bytes(spark, tmp_path, images, big):
    index = ometiff.write_segments(tiles_of(spark, images), f"{tmp_path}/segments", "Deflate", 16, predictor=2)
    index.write.parquet(f"{tmp_path}/index")
    index = spark.read.parquet(f"{tmp_path}/index")
    raw = {}
    for part_bytes, part_rows in ((ometiff.PART_BYTES, 10**6), (1000, 1), (37, 3)):
        folder = tmp_path / str(part_bytes)
        folder.mkdir()
        own = spark.createDataFrame([(n, 0, f"<OME>{n} µ</OME>", f"{folder}/{n}.tif") for n in images], "path string, series int, xml string, output string")
        done = ometiff.write_images(index, own, "Deflate", 16, 2, part_bytes=part_bytes, part_rows=part_rows, big=big)
        assert sorted(map(tuple, done.drop("finished").collect())) == [(n, 0, f"{folder}/{n}.tif") for n in sorted(images)]
        assert sorted(os.listdir(folder)) == [f"{n}.tif" for n in sorted(images)]
        raw[part_bytes] = [(folder / f"{n}.tif").read_bytes() for n in images]
    assert raw[1000][0][:4] == (b"MM\0\x2b" if big else b"MM\0\x2a")
    assert raw[1000] == raw[37] == raw[ometiff.PART_BYTES]
    for name, planes in images.items():
        same(f"{folder}/{name}.tif", planes)
        (first, *others) = sorted(tiff.pages_of(f"{folder}/{name}.tif"), key=lambda r: (r["level"], r["page"]))
        assert first["tags"]["ImageDescription"] == f"<OME>{name} µ</OME>" and first["predictor"] == 2
        assert not [r for r in others if "ImageDescription" in r["tags"]]


def test_failed_ranges_leave_nothing(spark, tmp_path, images):
    index = ometiff.write_segments(tiles_of(spark, images), f"{tmp_path}/segments", "LZW", 16)
    index.write.parquet(f"{tmp_path}/index")
    (tmp_path / "out").mkdir()
    own = spark.createDataFrame([(n, 0, "<OME/>", f"{tmp_path}/out/{n}.tif") for n in images], "path string, series int, xml string, output string")
    for segment in sorted(glob.glob(f"{tmp_path}/segments/*"))[:1]:
        os.truncate(segment, 20)
    with pytest.raises(Exception, match="ends too early"):
        ometiff.write_images(spark.read.parquet(f"{tmp_path}/index"), own, "LZW", 16, part_bytes=500)
    assert os.listdir(tmp_path / "out") == []
    more = own.unionAll(spark.createDataFrame([("none", 0, "<OME/>", f"{tmp_path}/out/none.tif")], own.schema))
    with pytest.raises(Exception, match="none.tif has"):
        ometiff.write_images(spark.read.parquet(f"{tmp_path}/index").where("path = 'none'"), more.where("path = 'none'"), "LZW", 16)
    assert os.listdir(tmp_path / "out") == []


def test_ranges_where_files_cannot_be_written_in_the_middle(tmp_path):
    target = Ranges(f"{tmp_path}/f", "m")
    target.mounted = False
    for begin, data in ((6, b"world"), (0, b"hello "), (6, b"world")):  # a repeated task
        with target.at(begin) as out:
            out.write(data)
    target.commit(11)
    target.commit(11)
    assert (tmp_path / "f").read_bytes() == b"hello world" and os.listdir(tmp_path) == ["f"]
    with target.at(0) as out:
        out.write(b"x")
    target.drop()
    assert os.listdir(tmp_path) == ["f"]


def test_spark_writes_images(spark, tmp_path, images):
    spark.dataSource.register(ometiff.OmeTiff)
    tiles, folder = tiles_of(spark, images), str(tmp_path / "out")
    write = lambda mode, df=tiles, **more: df.write.format("ome_tiff").mode(mode).options(tile_size=16, compression="LZW", document="<OME/>", **more).save(folder)
    write("append")
    assert sorted(os.listdir(folder)) == ["a.ome.tif", "b.ome.tif", "c.ome.tif"]
    for name, planes in images.items():
        same(f"{folder}/{name}.ome.tif", planes)
    before = {n: open(f"{folder}/{n}", "rb").read() for n in os.listdir(folder)}
    with pytest.raises(Exception, match="a.ome.tif"):
        write("append")

    def broken(frames):
        for i, frame in enumerate(frames):
            yield frame
            raise RuntimeError("a task fails")

    failing = tiles.repartition(3).mapInPandas(broken, tiles.schema)
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="a task fails"):
            write(mode, failing)
    assert {n: open(f"{folder}/{n}", "rb").read() for n in os.listdir(folder)} == before
    own = [(n, 0, f"<OME>{n}</OME>", f"{tmp_path}/named-{n}.tif") for n in images]
    spark.createDataFrame(own, "path string, series int, xml string, output string").write.parquet(f"{tmp_path}/documents")
    write("append", documents=f"{tmp_path}/documents")
    same(f"{tmp_path}/named-c.tif", images["c"])
    assert tiff.pages_of(f"{tmp_path}/named-a.tif")[0]["tags"]["ImageDescription"] == "<OME>a</OME>"
    write("overwrite", tiles.where("level = 0 and path = 'b'"))
    assert sorted(os.listdir(folder)) == ["a.ome.tif", "b.ome.tif", "c.ome.tif"]


def test_blocks_are_cut_before_the_shuffle(spark):
    """No byte goes to more than one square, but for the rims that a filter asks for."""
    strip = np.arange(4 * 8192, dtype=np.uint16).reshape(4, 8192)
    rows = [("s", 0, 0, 0, 4 * i, 0, 4, 8192, 40, 8192, "uint16", strip.tobytes()) for i in range(10)]
    blocks = spark.createDataFrame(rows, pyramid.TILES.replace("ty long, tx long", "y0 long, x0 long"))
    n = lambda df: df.agg(F.sum(F.octet_length("data"))).first()[0]
    assert n(pyramid.cut_parts(blocks, 32)) == n(blocks) == n(pyramid.retile(blocks, 32))
    assert n(blocks) < n(pyramid.cut_parts(blocks, 32, 3)) < 1.6 * n(blocks)
    plan = pyramid.retile(blocks, 32)._jdf.queryExecution().toString()
    assert "Generate" not in plan and plan.count("MapInArrow") >= 2


def java_pictures(spark, pixels, progressive, quality=0.9):
    """JPEG data as the JVM writes it, and its pixels as the JVM reads them."""
    jvm = spark._jvm
    h, w, samples = pixels.shape
    image = jvm.java.awt.image.BufferedImage(w, h, 5 if samples == 3 else 10)
    values = spark.sparkContext._gateway.new_array(jvm.int, h * w * samples)
    for i, v in enumerate(pixels.ravel().tolist()):
        values[i] = v
    image.getRaster().setPixels(0, 0, w, h, values)
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpg").next()
    how = writer.getDefaultWriteParam()
    if progressive:
        how.setProgressiveMode(1)  # the usual scans
    how.setCompressionMode(2)
    how.setCompressionQuality(quality)
    out = jvm.java.io.ByteArrayOutputStream()
    stream = jvm.javax.imageio.ImageIO.createImageOutputStream(out)
    writer.setOutput(stream)
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), how)
    stream.close()
    data = bytes(out.toByteArray())
    raster = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(data))).getRaster()
    none = spark.sparkContext._gateway.jvm.java.lang.reflect.Array.newInstance(jvm.java.lang.Integer.TYPE, h * w * samples)
    return data, np.array(list(raster.getPixels(0, 0, w, h, none))).reshape(h, w, samples)


@pytest.mark.parametrize("samples", [1, 3])
@pytest.mark.parametrize("quality", [0.5, 0.95])
def test_progressive_jpeg_against_another_reader(spark, samples, quality):
    rng = np.random.default_rng(7)
    y, x = np.mgrid[0:45, 0:61]
    pixels = np.stack([128 + 60 * np.sin(x / (5 + k)) + 40 * np.cos(y / 7) + rng.normal(0, 6, x.shape) for k in range(samples)], -1).clip(0, 255).astype(np.uint8)
    data, theirs = java_pictures(spark, pixels, True, quality)
    assert b"\xff\xc2" in data and data.count(b"\xff\xda") > 5
    plain, same_pixels = java_pictures(spark, pixels, False, quality)
    mine, baseline = jpeg.decode(data), jpeg.decode(plain)
    assert (mine == baseline).all()  # the same coefficients in another order
    shown = jpeg.from_ycc(mine) if samples == 3 else mine
    if samples == 1:
        assert np.abs(shown.astype(int) - theirs).max() <= 1
    else:  # colours at half the size are spread otherwise by each reader
        assert np.abs(shown.astype(int) - theirs).mean() < 3 and (theirs == same_pixels).all()
    scans = [i for i in range(len(data)) if data[i : i + 2] == b"\xff\xda"]
    for n in (60, len(data) // 3, len(data) // 2, scans[2], scans[-1], len(data) - 2):
        with pytest.raises(ValueError):
            jpeg.decode(data[:n])
