import json
import tracemalloc
import xml.etree.ElementTree as ET

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions import omexml
from tessella.functions import scalars as S
from tessella.operators import lzw, pyramid
from tessella.operators.profiles import PROFILES, image_features
from tessella.plans.convert import Converter
from tessella.sources import tiff

from .tiff_writer import write_tiff

NS = "{http://www.openmicroscopy.org/Schemas/OME/2016-06}"
SCANNER = (
    '<?xml version="1.0" encoding="utf-16"?><PerkinElmer-QPI-ImageDescription><Name>{}</Name><Secret>SENTINEL-XML</Secret>'
    "<ScanProfile><root><ScanResolution><PixelSizeMicrons>0.49610</PixelSizeMicrons></ScanResolution></root></ScanProfile>"
    "</PerkinElmer-QPI-ImageDescription>"
)
HALO = (
    '<OME xmlns="http://www.openmicroscopy.org/Schemas/OME/2016-06"><Image><Pixels PhysicalSizeX="0.50" PhysicalSizeY="0.25" SizeX="40"'
    ' SizeY="30"><Channel ID="C:7" Name="DAPI" Color="5"/></Pixels></Image></OME>'
)


@settings(max_examples=60, deadline=None)
@given(st.one_of(st.binary(max_size=3000), st.lists(st.integers(0, 3), max_size=20000).map(bytes)))
def test_lzw_round_trip(data):
    assert lzw.decode(lzw.encode_many([data])[0]) == data


def test_lzw_memory_does_not_grow_with_the_tiles():
    """Tables of the lanes of all tiles stood side by side, 64 KB each."""
    rng = np.random.default_rng(4)
    tiles = [rng.integers(0, 7, int(n)).astype(np.uint8).tobytes() for n in rng.integers(0, 300, 4000)]
    tiles[7] = rng.integers(0, 7, 30000).astype(np.uint8).tobytes()
    tracemalloc.start()
    try:
        streams = lzw.encode_many(tiles)
        assert tracemalloc.get_traced_memory()[1] < 120 << 20
    finally:
        tracemalloc.stop()
    assert [lzw.decode(x) for x in streams] == tiles


def test_lzw_long_random():
    data = np.random.default_rng(0).integers(0, 256, 60_000, np.uint8).tobytes()
    assert lzw.decode(lzw.encode_many([data])[0]) == data


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("big", [False, True])
@pytest.mark.parametrize("kind", ["uint8", "uint16", "float32"])
def test_blocks_give_the_pixels_back(spark, tmp_path, order, big, kind):
    rng = np.random.default_rng(1)
    image = (rng.random((37, 53)) * 200).astype(kind)
    options = [{"tile": 16}, {"rows_per_strip": 10, "deflate": True}, {"tile": 32, "deflate": True, "predictor": 1 if kind == "float32" else 2}]
    for k, o in enumerate(options):
        write_tiff(tmp_path / f"{k}.tif", [(image, None)], order, big, **o)
    paths = spark.createDataFrame([(str(tmp_path / f"{k}.tif"),) for k in range(3)], "path string")
    tiles = pyramid.retile(tiff.read_blocks(tiff.read_pages(paths)), 24).collect()
    for k in range(3):
        out = np.zeros_like(image)
        for t in tiles:
            if t.path.endswith(f"{k}.tif"):
                out[t.ty * 24 : t.ty * 24 + t.h, t.tx * 24 : t.tx * 24 + t.w] = np.frombuffer(t.data, kind).reshape(t.h, t.w)
        assert (out == image).all()


def test_reduced_levels(spark, tmp_path):
    image = np.arange(35 * 50, dtype=np.uint16).reshape(35, 50)
    write_tiff(tmp_path / "a.tif", [(image, None)], tile=16)
    pages = tiff.read_pages(spark.createDataFrame([(str(tmp_path / "a.tif"),)], "path string"))
    base = pyramid.retile(tiff.read_blocks(pages), 16)
    for method in ("simple", "area"):
        want = pyramid.halved(image, method)
        out = np.zeros_like(want)
        for t in pyramid.reduced(base, 16, method).collect():
            out[t.ty * 16 : t.ty * 16 + t.h, t.tx * 16 : t.tx * 16 + t.w] = np.frombuffer(t.data, np.uint16).reshape(t.h, t.w)
            assert (t.height, t.width, t.level) == (18, 25, 1)
        assert (out == want).all()
    assert pyramid.level_count(1000, 300) == 3


def test_page_source_groups_series(spark, tmp_path):
    a, b = np.zeros((64, 64), np.uint8), np.zeros((32, 32), np.uint8)
    label = np.zeros((10, 20, 3), np.uint8)
    write_tiff(tmp_path / "a.tif", [(a, "x"), (a, "y"), (label, None), (b, None), (b, None)])
    spark.dataSource.register(tiff.TiffPages)
    df = spark.read.format("tiff_pages").load(str(tmp_path / "a.tif"))
    got = sorted((r.series, r.level, r.page) for r in df.collect())
    assert got == [(0, 0, 0), (0, 0, 1), (0, 1, 0), (0, 1, 1), (1, 0, 0)]
    assert df.where("series = 1").count() == 1
    thumbnail = np.zeros((21, 21), np.uint8)  # in proportion, but no halves of anything
    write_tiff(tmp_path / "b.tif", [(a[:, :, None], "x"), (b, None), (thumbnail, None)])
    assert sorted((r["series"], r["level"], r["height"]) for r in tiff.pages_of(str(tmp_path / "b.tif"))) == [(0, 0, 64), (0, 1, 32), (1, 0, 21)]


def make_mif(path, names=("DAPI", "CD<8> & \"x\" µ")):
    pages = [(np.full((300, 280), i + 1, np.uint8), SCANNER.format(n.replace("&", "&amp;").replace("<", "&lt;"))) for i, n in enumerate(names)]
    write_tiff(path, pages, tile=64, deflate=True)


def test_conversion_keeps_pixels_and_drops_identifiers(spark, tmp_path):
    source, output = str(tmp_path / "in.tif"), str(tmp_path / "out.tif")
    make_mif(source)
    one = Converter(spark, source, "qptiff_mif", rename_channels={"DAPI": "Nuclei", "None": "x"}, tile_size=128)
    report = one.convert(output)
    root = ET.fromstring(report["ome"]["xml_string"].encode())
    pixels = root.find(f"{NS}Image/{NS}Pixels")
    assert pixels.get("PhysicalSizeX") == pixels.get("PhysicalSizeY") == "0.49610"
    assert [c.get("Name") for c in pixels.findall(f"{NS}Channel")] == ["Nuclei", 'CD<8> & "x" µ']
    assert [c.tag.replace(NS, "") for c in pixels] == ["Channel", "Channel", "TiffData"]
    assert root.get("UUID") == "urn:uuid:" + report["ome"]["uuid"]
    assert root.find(f"{NS}StructuredAnnotations/{NS}MapAnnotation") is not None
    assert report["ome"]["xml_is_valid"] is None and report["output_file"]["type_description"] == "OME-TIFF"
    raw = open(output, "rb").read()
    assert b"SENTINEL" not in raw and b"SENTINEL" not in json.dumps(report).encode()
    pages = tiff.read_pages(spark.createDataFrame([(output,)], "path string"))
    assert sorted((r.level, r.page, r.height, r.width) for r in pages.collect()) == [
        (0, 0, 300, 280), (0, 1, 300, 280), (1, 0, 150, 140), (1, 1, 150, 140)]
    got = {(t.c, t.level, t.ty, t.tx): np.frombuffer(t.data, np.uint8) for t in pyramid.retile(tiff.read_blocks(pages), 128).collect()}
    assert all((v == k[0] + 1).all() for k, v in got.items()) and len(got) == 2 * (9 + 4)


def test_conversion_refuses(spark, tmp_path):
    source = str(tmp_path / "in.tif")
    make_mif(source)
    one = Converter(spark, source, "qptiff_mif")
    for arguments in ({"deidentify_ome": False}, {"compression": "Zip"}):
        with pytest.raises(ValueError):
            one.convert(str(tmp_path / "o.tif"), **arguments)
    with pytest.raises(ValueError):
        one.convert(source)
    with pytest.raises(ValueError):
        Converter(spark, source, "component").features()
    with pytest.raises(ValueError):
        Converter(spark, source, "qptiff_mif", series=5).convert(str(tmp_path / "o.tif"))
    assert not (tmp_path / "o.tif").exists()


def test_profiles(spark, tmp_path):
    write_tiff(tmp_path / "h.tif", [(np.zeros((30, 40), np.float32), HALO)])
    make_mif(str(tmp_path / "m.tif"))
    write_tiff(tmp_path / "he.tif", [(np.zeros((30, 40, 3), np.uint8), SCANNER.format("HE"))])
    pages = lambda n: tiff.read_pages(spark.createDataFrame([(str(tmp_path / n),)], "path string"))
    h = image_features(pages("h.tif"), PROFILES["halo_mif"]).first()
    assert (h.size_x, h.size_y, h.physical_size_x, h.physical_size_y, h.type, h.size_c) == ("40", "30", "0.50", "0.25", "float", 1)
    assert [(c.ID, c.Name, c.SamplesPerPixel) for c in h.channels] == [("C:7", "DAPI", 1)]
    he = image_features(pages("he.tif"), PROFILES["qptiff_he"]).first()
    assert [c.Name for c in he.channels] == ["RED", "GREEN", "BLUE"] and he.size_c == he.plane_count == 3
    c = image_features(pages("m.tif"), PROFILES["component"], physical_size_x="0.5", physical_size_y="0.5").first()
    assert c.name == "Component" and c.size_c == 2 and c.channels[0].ID == "Channel:0:0" and c.input_type == "Akoya Component TIFF"


XSD = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema" targetNamespace="http://www.openmicroscopy.org/Schemas/OME/2016-06"
 elementFormDefault="qualified"><xs:element name="OME"><xs:complexType><xs:sequence><xs:element name="Image"><xs:complexType>
 <xs:sequence><xs:any processContents="skip"/></xs:sequence><xs:attribute name="ID" use="required"/><xs:attribute name="Name"/></xs:complexType>
 </xs:element><xs:element name="StructuredAnnotations"><xs:complexType><xs:sequence><xs:any processContents="skip" minOccurs="0"/></xs:sequence>
 </xs:complexType></xs:element></xs:sequence><xs:attribute name="UUID"/></xs:complexType></xs:element></xs:schema>"""


def test_schema_predicate_with_a_subset_schema(spark, tmp_path):
    (tmp_path / "ome.xsd").write_text(XSD)
    make_mif(str(tmp_path / "m.tif"))
    df = Converter(spark, str(tmp_path / "m.tif"), "qptiff_mif").features().select(omexml.ome_document().alias("x"))
    df = df.select("x", F.replace("x", F.lit(" ID=\"Image:0\""), F.lit("")).alias("bad"))
    r = df.select(*(omexml.schema_valid(F.col(c), str(tmp_path / "ome.xsd")).alias(c) for c in ("x", "bad"))).first()
    assert r.x is True and r.bad is False


def test_scalars(spark):
    r = spark.range(1).select(
        S.run_time(F.lit(59.996)).alias("a"), S.run_time(F.lit(360000.5)).alias("b"),
        S.last_wins(F.array(F.lit("k"), F.lit("m"), F.lit("k")), F.array(F.lit("1"), F.lit("2"), F.lit("3"))).alias("m"),
        S.size_ratio(F.lit(1), F.lit(0)).alias("z"), S.tool_version(F.lit("none")).alias("v"),
        S.renamed(F.lit("a"), F.create_map(F.lit("a"), F.lit(None).cast("string"))).alias("n"),
        omexml.first_annotation(F.lit("<OME><StructuredAnnotations/></OME>")).alias("f"),
    ).first()
    assert (r.a, r.b, r.m, r.z, r.v, r.n, r.f) == ("00:00:60.00", "100:00:00.50", {"m": "2", "k": "3"}, None, None, None, None)


def test_entry_and_catalogue(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def smooth(h, w, k=0):
    y, x = np.mgrid[0:h, 0:w]
    return (128 + 60 * np.sin(x / 17 + k) + 50 * np.cos(y / 13)).astype(np.uint8)


def java_image(spark, path, page=0):
    """The pixels of a page as the JVM's own TIFF reader gives them: (h, w, bands)."""
    jvm = spark._jvm
    reader = jvm.javax.imageio.ImageIO.getImageReadersByFormatName("tiff").next()
    reader.setInput(jvm.javax.imageio.ImageIO.createImageInputStream(jvm.java.io.File(path)))
    raster = reader.read(page).getRaster()
    h, w, bands = raster.getHeight(), raster.getWidth(), raster.getNumBands()
    return np.array(list(raster.getPixels(0, 0, w, h, spark.sparkContext._gateway.new_array(jvm.int, h * w * bands)))).reshape(h, w, bands)


@pytest.mark.parametrize("compression", ["Uncompressed", "LZW", "JPEG"])
def test_another_reader_reads_the_output(spark, tmp_path, compression):
    source, output = str(tmp_path / "in.tif"), str(tmp_path / "out.tif")
    pages = [smooth(90, 100), smooth(90, 100, 2)]
    write_tiff(source, [(p, SCANNER.format(f"n{i}")) for i, p in enumerate(pages)], tile=64)
    report = Converter(spark, source, "qptiff_mif", tile_size=64).convert(output, compression=compression)
    for i, want in enumerate(pages):
        off = np.abs(java_image(spark, output, i)[:, :, 0] - want.astype(int))
        assert off.max() <= (6 if compression == "JPEG" else 0)
    root = ET.fromstring(report["ome"]["xml_string"].encode())
    assert root.find(f"{NS}Image/{NS}Pixels").get("BigEndian") == "true" and open(output, "rb").read(2) == b"MM"


def test_jpeg_input_and_interleaved_output(spark, tmp_path):
    """Colour tiles of another encoder, subsampled and with tables apart, in; samples of one channel out."""
    from tessella.operators import jpeg

    rgb = np.stack([smooth(96, 96), smooth(96, 96, 1), smooth(96, 96, 2)], -1)
    source = str(tmp_path / "he.tif")
    write_tiff(source, [(rgb, SCANNER.format("HE"))], tile=32, jpeg=True)
    for compression, most in (("LZW", 0), ("JPEG", 8)):
        output = str(tmp_path / f"{compression}.tif")
        report = Converter(spark, source, "qptiff_he", tile_size=64).convert(output, compression=compression, rgb=True)
        pixels = ET.fromstring(report["ome"]["xml_string"].encode()).find(f"{NS}Image/{NS}Pixels")
        assert [c.get("SamplesPerPixel") for c in pixels.findall(f"{NS}Channel")] == ["3"] and pixels.get("Interleaved") == "true"
        blocks = tiff.read_blocks(tiff.read_pages(spark.createDataFrame([(output,)], "path string")))
        got = {(t.c, t.ty, t.tx): np.frombuffer(t.data, np.uint8).reshape(t.h, t.w) for t in pyramid.retile(blocks, 96).collect()}
        assert all(np.abs(got[c, 0, 0].astype(int) - rgb[:, :, c]).max() <= 6 + most for c in range(3))
    plain = str(tmp_path / "plain.tif")
    report = Converter(spark, source, "qptiff_he", tile_size=64).convert(plain)
    pixels = ET.fromstring(report["ome"]["xml_string"].encode()).find(f"{NS}Image/{NS}Pixels")
    assert [c.get("Name") for c in pixels.findall(f"{NS}Channel")] == ["RED", "GREEN", "BLUE"]
    data = jpeg.encode(rgb[:40, :56], 95)
    cut = data.index(b"\xff\xc0")
    assert (jpeg.decode(data) == jpeg.decode(b"\xff\xd8" + data[cut:], data[:cut] + b"\xff\xd9")).all()
    for broken in (data[: len(data) // 2], b"\xff\xd8\xff\xd9"):
        with pytest.raises(ValueError):
            jpeg.decode(broken)


def test_jpeg_against_another_codec(spark):
    from tessella.operators import jpeg

    jvm = spark._jvm
    grey = smooth(61, 75)
    image = jvm.java.awt.image.BufferedImage(75, 61, 10)  # 8-bit grey
    for y in range(61):
        for x in range(75):
            image.getRaster().setSample(x, y, 0, int(grey[y, x]))
    out = jvm.java.io.ByteArrayOutputStream()
    jvm.javax.imageio.ImageIO.write(image, "jpg", out)
    data = bytes(out.toByteArray())
    raster = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(data))).getRaster()
    theirs = np.array(list(raster.getPixels(0, 0, 75, 61, spark.sparkContext._gateway.new_array(jvm.int, 61 * 75)))).reshape(61, 75)
    assert np.abs(jpeg.decode(data)[:, :, 0].astype(int) - theirs).max() <= 1
    mine = jpeg.encode(grey[:, :, None], 95)
    raster = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(mine))).getRaster()
    theirs = np.array(list(raster.getPixels(0, 0, 75, 61, spark.sparkContext._gateway.new_array(jvm.int, 61 * 75)))).reshape(61, 75)
    assert np.abs(jpeg.decode(mine)[:, :, 0].astype(int) - theirs).max() <= 1 and np.abs(theirs - grey.astype(int)).max() <= 6


def filtered(image):
    """The next level by sums over the whole image, whose last pixels go on beyond it."""
    h, w = image.shape
    wide = np.pad(image.astype(float), 2, mode="edge")
    out = np.zeros(((h + 1) // 2, (w + 1) // 2))
    for dy, a in zip((-1, 0, 1, 2), (1, 3, 3, 1), strict=True):
        for dx, b in zip((-1, 0, 1, 2), (1, 3, 3, 1), strict=True):
            out += a * b / 64 * wide[2 + dy : 2 + dy + h : 2, 2 + dx : 2 + dx + w : 2][: out.shape[0], : out.shape[1]]
    return np.floor(out + 0.5).astype(image.dtype)


def test_levels_without_shuffling_each(spark, tmp_path):
    """All levels of one plan equal those made one by one on the whole image."""
    image = np.random.default_rng(2).integers(0, 65535, (700, 530), np.uint16)
    write_tiff(tmp_path / "a.tif", [(image, None)], tile=64)
    blocks = tiff.read_blocks(tiff.read_pages(spark.createDataFrame([(str(tmp_path / "a.tif"),)], "path string")))
    for method in ("simple", "area", "binomial"):
        for span in (1, 2, 3):
            tiles = pyramid.pyramid(blocks, 32, method, 3, lambda df: df, span).collect()
            want = image
            for level in range(3):
                out = np.zeros_like(want)
                mine = [t for t in tiles if t.level == level]
                assert len(mine) == len({(t.ty, t.tx) for t in mine}) == -(-want.shape[0] // 32) * -(-want.shape[1] // 32)
                for t in mine:
                    out[t.ty * 32 : t.ty * 32 + t.h, t.tx * 32 : t.tx * 32 + t.w] = np.frombuffer(t.data, np.uint16).reshape(t.h, t.w)
                    assert (t.height, t.width) == want.shape
                assert (out == want).all()
                want = pyramid.halved(want, method) if method != "binomial" else filtered(want)
    r = spark.range(1).select(pyramid.levels_of(F.lit(700), F.lit(530)).alias("n"), pyramid.level_sizes(F.lit(700), F.lit(531)).alias("s"),
                              pyramid.levels_of(F.lit(256), F.lit(1)).alias("one"), pyramid.level_sizes(F.lit(20), F.lit(20)).alias("none")).first()
    assert (r.n, r.s, r.one, r.none) == (pyramid.level_count(700, 530), ["266 350", "133 175"], 1, [])


def test_many_images_in_one_job(spark, tmp_path):
    from tessella.plans.convert import TileStore, convert_images

    rows = []
    for i in range(4):
        make_mif(str(tmp_path / f"{i}.tif"), [f"a{i}", "b"][: 1 + i % 2])
        rows.append((str(tmp_path / f"{i}.tif"), str(tmp_path / f"{i}.out.tif"), "qptiff_mif" if i < 3 else "component", None if i < 3 else "0.5", "0.25"))
    manifest = spark.createDataFrame(rows, "path string, output string, image_type string, physical_size_x string, physical_size_y string")
    got = convert_images(manifest, str(tmp_path / "cache"), {"b": "B"}, tile_size=128, reports=str(tmp_path / "reports")).orderBy("path").collect()
    assert [r.path for r in got] == [r[0] for r in rows] and not any((tmp_path / "cache").iterdir())
    assert [r.input_file.type_description for r in got] == ["Akoya MIF QPTIFF"] * 3 + ["Akoya Component TIFF"]
    assert 'PhysicalSizeX="0.5"' in got[3].ome.xml_string and got[3].options.rename_channels == {"b": "B"}
    pages = tiff.read_pages(spark.createDataFrame([(r[1],) for r in rows], "path string")).where("level = 0").groupBy("path").count().collect()
    assert sorted(r["count"] for r in pages) == [1, 1, 2, 2]
    for r in got:
        data = open(r.output_file.path, "rb").read()
        assert (r.output_file.size_bytes, r.output_file.md5_checksum) == (len(data), __import__("hashlib").md5(data).hexdigest())
    store = TileStore.create(manifest, str(tmp_path / "store"), tile_size=128)
    again = TileStore(spark, str(tmp_path / "store"))  # opened anew, and written in another form
    assert again.write_files("Uncompressed").count() == 4 and again.documents().count() == 4
    assert f"{rows[1][0]} series 0\n  level 0 channel 0: 280 x 300, 9 tiles, 84000 bytes\n" in again.tree()
    store.remove()
    assert not (tmp_path / "store").exists()
    same = manifest.withColumn("output", F.lit("x"))
    loop = manifest.withColumn("output", F.col("path"))
    for bad in (same, loop, manifest.withColumn("image_type", F.lit("other")), manifest.withColumn("physical_size_x", F.lit("-1")), manifest.limit(0),
                manifest.withColumn("series", F.lit(3)), manifest.withColumn("physical_size_y", F.lit(None).cast("string"))):
        with pytest.raises(ValueError):
            convert_images(bad, str(tmp_path / "cache"))


def test_several_series_of_one_file(spark, tmp_path):
    a, b = smooth(40, 50), smooth(30, 20, 1)
    write_tiff(tmp_path / "s.tif", [(a, SCANNER.format("x")), (b, SCANNER.format("y"))])
    reports = Converter(spark, str(tmp_path / "s.tif"), "qptiff_mif", series=[0, 1]).convert(str(tmp_path / "o.ome.tif"))
    assert [r["output_file"]["path"][-19:] for r in reports] == ["o.series0.ome.tif"[-19:], "o.series1.ome.tif"[-19:]] or len(reports) == 2
    assert [java_image(spark, r["output_file"]["path"]).shape[:2] for r in reports] == [(40, 50), (30, 20)]


def test_pixel_source_reads_chosen_pages_only(spark, tmp_path):
    a, b = smooth(64, 64), smooth(32, 32, 1)
    write_tiff(tmp_path / "a.tif", [(a, "x"), (a + 1, "y"), (b, None), (b, None), (smooth(10, 20), None)], tile=16)
    spark.dataSource.register(tiff.TiffBlocks)
    load = lambda **options: spark.read.format("tiff_blocks").options(blocks=3, **options).load(str(tmp_path / "a.tif"))
    one = load(series=0, level=0, page=1)
    assert one.count() == 16 and one.rdd.getNumPartitions() == 6
    out = np.zeros_like(a)
    for r in one.collect():
        out[r.y0 : r.y0 + r.h, r.x0 : r.x0 + r.w] = np.frombuffer(r.data, np.uint8).reshape(r.h, r.w)
    assert (out == a + 1).all() and load(level=1).select("page").distinct().count() == 2 and load(series="1,7").count() == 2
    df = load()
    assert df.where("level = 1").count() == 8 and df.where("level = 0").count() == 34 and df.count() == 42 and load(series=9).count() == 0


@pytest.fixture
def plain(spark):
    """A session that has not turned the push-down of filters to Python sources on, as Spark's own sessions."""
    session = spark.newSession()
    session.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    return session


def test_page_structure_in_any_session(spark, plain):
    from tessella.plans import catalogue

    small = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{small}/embeddings.parquet").agg(F.max("vec_id")).first()[0] + 1
    want = []
    for k in range(-(-rows // catalogue.TALL)):
        n = min(catalogue.TALL, rows - k * catalogue.TALL)
        want.append((k, 0, 0, 0, n, 64, "float64", 1, -(-n // 32) * 2, 1, True, "<OME/>"))
        if n > 256:
            want.append((k, 0, 1, 0, (n + 1) // 2, 32, "float64", 1, -(-((n + 1) // 2) // 32), 1, True, None))
    reduced = [r for r in want if r[2] == 1]
    assert 0 < len(reduced) < len(want)
    for session in (plain, spark):
        p = catalogue.tiff_page_structure(session, small)
        assert sorted(map(tuple, p.collect())) == want
        assert sorted(map(tuple, p.where("level = 1").collect())) == reduced
        assert sorted(map(tuple, p.collect())) == want and p.where("level = 0").union(p.where("level = 1")).count() == len(want)


def test_jpeg_pixels_are_compared_in_tasks_by_vectors(spark, monkeypatch):
    """However few bytes they compress to: adaptive execution made one task of them all."""
    from tessella.plans import catalogue

    monkeypatch.setattr(catalogue, "COMPARED", 100, raising=False)
    df = catalogue.tiff_pixels_jpeg(spark, "/root/testdata/sf0.001")
    assert df.rdd.getNumPartitions() == 5
    assert sorted(map(tuple, df.collect())) == [(i, 64, 0) for i in range(500)]


def test_segments_hold_few_tiles_at_once(tmp_path):
    """Of wide numbers as of narrow ones; twice the bytes were held for 64 bits as for 32."""
    from tessella.sinks import ometiff

    rng, n = np.random.default_rng(5), 4096
    data = [rng.normal(size=(32, 32)).tobytes() for _ in range(n)]
    index = ["p"] * n, [0] * n, [0] * n, [0] * n, range(n), [0] * n, [32] * n, [32] * n, [32 * n] * n, [32] * n, ["float64"] * n, data, [1] * n
    tiles = pd.DataFrame(dict(zip([*pyramid.NAMES, "samples"], index, strict=True)))
    segment = ometiff.Segment(str(tmp_path), ometiff.Form("Uncompressed", 32))
    tracemalloc.start()
    try:
        out = segment.add(tiles)
        assert tracemalloc.get_traced_memory()[1] < 40 << 20
    finally:
        tracemalloc.stop()
        segment.close()
    assert out["offset"].tolist() == [8192 * k for k in range(n)] and set(out["length"]) == {8192}
    written = np.fromfile(segment.path, ">f8").astype(np.float64)
    assert written.tobytes() == b"".join(data)


def test_small_parts_are_handed_on_by_their_number(spark):
    """A hundred thousand parts of a few pixels came to no more bytes than a task gathered."""
    class Caught:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return run

    n = 5000
    data = [np.arange(64, dtype=np.float64).tobytes()] * n
    columns = [[str(i) for i in range(n)], *([0] * n for _ in range(5)), *([8] * n for _ in range(4)), ["float64"] * n, data]
    names = ["path", "series", "level", "c", "y0", "x0", "h", "w", "height", "width", "dtype", "data"]
    out = list(pyramid.cut_parts(Caught(), 6)(iter([pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)])))
    assert max(map(len, out)) <= 4096 and sum(map(len, out)) == 4 * n
    rows = [r for b in out for r in b.to_pylist()]
    assert [(r["path"], r["ty"], r["tx"], r["h"], r["w"]) for r in rows] == [(str(i), y, x, (6, 2)[y], (6, 2)[x]) for i in range(n) for y in (0, 1) for x in (0, 1)]


@pytest.mark.parametrize("rows", [1, 256, 257])
def test_pixels_of_level_in_any_session(spark, plain, tmp_path, rows):
    from tessella.plans import catalogue

    v = np.random.default_rng(2).normal(size=(rows, 64)).astype(np.float32)
    table = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(v)], "vec_id long, embedding array<float>")
    table.coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    df = catalogue.tiff_pixels_of_level(plain, str(tmp_path))
    want = {(y, x): v[2 * y, 2 * x] for y in range((rows + 1) // 2) for x in range(32)} if rows > 256 else {}
    for _ in range(2):
        got = df.collect()
        assert len(got) == df.count() == len(want) and {(r.y, r.x): r.v for r in got} == pytest.approx(want, abs=1e-6)


def test_pixel_source_reuses_a_load(spark, plain, tmp_path):
    a, b = smooth(64, 64), smooth(32, 32, 1)
    write_tiff(tmp_path / "a.tif", [(a, None), (b, None)], tile=16)
    for session in (plain, spark):
        session.createDataFrame([], "k int")  # makes it the active one, which Spark looks at to register a source
        session.dataSource.register(tiff.TiffBlocks)
        df = session.read.format("tiff_blocks").load(str(tmp_path / "a.tif"))
        assert df.where("level = 1").count() == 4 and df.count() == 20
        both = df.where("level = 0").union(df.where("level = 1")).groupBy("level").count()
        assert sorted(map(tuple, both.collect())) == [(0, 16), (1, 4)]


def test_a_new_vendor_is_a_subclass(spark, tmp_path):
    from tessella.operators import profiles

    class Numbered(profiles.Profile):
        key, label, image_name = "numbered", "Numbered TIFF", "Slide"

        def description(self):
            return F.lit(None).cast("string")

        def page_name(self):
            return F.concat(F.lit("c"), F.col("page").cast("string"))

        def physical_sizes(self):
            return F.lit("1.5"), F.lit("2.5")

    profiles.register(Numbered())
    try:
        write_tiff(tmp_path / "n.tif", [(smooth(30, 40), None), (smooth(30, 40), None)])
        report = Converter(spark, str(tmp_path / "n.tif"), "numbered").convert(str(tmp_path / "o.tif"))
    finally:
        del profiles.PROFILES["numbered"]
    pixels = ET.fromstring(report["ome"]["xml_string"].encode()).find(f"{NS}Image/{NS}Pixels")
    assert [c.get("Name") for c in pixels.findall(f"{NS}Channel")] == ["c0", "c1"] and pixels.get("PhysicalSizeY") == "2.5"
    assert report["input_file"]["type_description"] == "Numbered TIFF"


def test_a_profile_sets_how_it_is_written(spark, tmp_path):
    from tessella.operators import profiles
    from tessella.plans.convert import convert_images

    class Packed(profiles.Profile):
        key, writer = "packed", {"compression": "PackBits", "predictor": 2}

    profiles.register(Packed())
    try:
        for n in "ab":
            write_tiff(tmp_path / f"{n}.tif", [(smooth(30, 40), SCANNER.format("x"))])
        rows = [(f"{tmp_path}/{n}.tif", f"{tmp_path}/{n}.out.tif", k) for n, k in (("a", "packed"), ("b", "qptiff_mif"))]
        reports = convert_images(spark.createDataFrame(rows, "path string, output string, image_type string"), tile_size=32)
        assert sorted(r.options.compression for r in reports.collect()) == ["LZW", "PackBits"]
    finally:
        del profiles.PROFILES["packed"]
    found = {n: tiff.pages_of(f"{tmp_path}/{n}.out.tif")[0] for n in "ab"}
    assert [(r["compression"], r["predictor"]) for r in found.values()] == [(32773, 2), (5, 1)]
    for n in "ab":
        blocks = tiff.read_blocks(tiff.read_pages(spark.createDataFrame([(f"{tmp_path}/{n}.out.tif",)], "path string"))).collect()
        assert sum(np.frombuffer(b.data, np.uint8).astype(int).sum() for b in blocks) == smooth(30, 40).astype(int).sum()


def test_no_identifier_passes(spark, tmp_path):
    """Sentinels in every text tag, in the vendor's XML and in annotations of an embedded document."""
    halo = HALO.replace("</OME>", '<StructuredAnnotations><MapAnnotation ID="A:1"><Value><M K="owner">SENTINEL-NOTE</M></Value></MapAnnotation></StructuredAnnotations></OME>')
    for name, kind, text in (("m", "qptiff_mif", SCANNER.format("x")), ("h", "halo_mif", halo)):
        tags = {305: "SENTINEL-SOFTWARE", 306: "SENTINEL-TIME", 315: "SENTINEL-ARTIST", 316: "SENTINEL-HOST", 269: "SENTINEL-NAME", 271: "SENTINEL-MAKE"}
        write_tiff(tmp_path / f"{name}.tif", [(smooth(30, 40), text)], texts=tags)
        report = Converter(spark, str(tmp_path / f"{name}.tif"), kind).convert(str(tmp_path / f"{name}.out.tif"))
        assert b"SENTINEL" in open(tmp_path / f"{name}.tif", "rb").read()
        assert b"SENTINEL" not in open(tmp_path / f"{name}.out.tif", "rb").read() and "SENTINEL" not in json.dumps(report)


def test_the_store_holds_no_tag(spark, tmp_path):
    from tessella.plans.convert import TileStore

    tags = {305: "SENTINEL-SOFTWARE", 315: "SENTINEL-ARTIST", 316: "SENTINEL-HOST", 271: "SENTINEL-MAKE"}
    write_tiff(tmp_path / "m.tif", [(smooth(30, 40), SCANNER.format("x"))], texts=tags)
    one = Converter(spark, str(tmp_path / "m.tif"), "qptiff_mif")
    TileStore.create(one.manifest(str(tmp_path / "o.tif")), str(tmp_path / "store"))
    for table in (tmp_path / "store").iterdir():
        rows = spark.read.parquet(str(table)).toPandas()
        assert "SENTINEL" not in repr(rows.to_dict()) and "tags" not in rows.columns
    raw = [f.read_bytes() for f in (tmp_path / "store").rglob("*.parquet")]
    assert len(raw) > 3 and not any(b"SENTINEL" in x for x in raw)


def test_documents_are_made_of_listed_sources_only(spark, tmp_path):
    from tessella.operators import lineage, profiles

    write_tiff(tmp_path / "p.tif", [(smooth(30, 40), SCANNER.format("x"))])
    pages = tiff.read_pages(spark.createDataFrame([(str(tmp_path / "p.tif"),)], "path string"))
    size = "tags.ImageDescription/ScanProfile.root.ScanResolution.PixelSizeMicrons"
    found = lineage.sources_behind(profiles.features_of(pages, profiles.PROFILES["qptiff_mif"], {"a": "b"}))
    assert size in found["physical_size_x"] and "tags.ImageDescription/Name" in found["channels"] and found["size_x"] == {"shaped", "page"}
    assert set().union(*found.values()) <= profiles.PLAIN_SOURCES | profiles.Profile.reads
    for key, profile in profiles.PROFILES.items():
        lineage.check_sources(profiles.features_of(pages, profile), profiles.PLAIN_SOURCES | profile.reads)

    class Curious(profiles.Profile):
        key = "curious"

        def page_name(self):
            return self.extra

    class Wide(profiles.Profile):
        key = "wide"

        def description(self):
            return omexml.parsed(F.col("tags")["ImageDescription"], omexml._struct(**{f.name: f.dataType for f in omexml.SCANNER_XML}, Operator=omexml._S))

    for extra in (F.col("tags")["Artist"], F.element_at("tags", F.lit("Artist")), F.to_json("tags"), F.array_join(F.map_values("tags"), "")):
        Curious.extra = extra
        with pytest.raises(ValueError, match="channels would be made of tags"):
            lineage.check_sources(profiles.features_of(pages, Curious()), profiles.PLAIN_SOURCES | Curious.reads)
    with pytest.raises(ValueError, match="tags.ImageDescription/Operator"):
        lineage.check_sources(profiles.features_of(pages, Wide()), profiles.PLAIN_SOURCES | Wide.reads)
    profiles.register(Wide())
    try:
        write_tiff(tmp_path / "n.tif", [(smooth(30, 40), SCANNER.format("x"))])
        with pytest.raises(ValueError, match="identify"):
            Converter(spark, str(tmp_path / "n.tif"), "wide").convert(str(tmp_path / "o.tif"))
    finally:
        del profiles.PROFILES["wide"]
    assert not (tmp_path / "o.tif").exists()


def test_reason_of_a_rejected_document(spark, tmp_path, caplog):
    (tmp_path / "ome.xsd").write_text(XSD.replace('name="ID" use="required"', 'name="Other" use="required"'))
    make_mif(str(tmp_path / "m.tif"))
    one = Converter(spark, str(tmp_path / "m.tif"), "qptiff_mif", schema_location=str(tmp_path / "ome.xsd"))
    report = one.convert(str(tmp_path / "o.tif"))
    assert report["ome"]["xml_is_valid"] is False and "'ID' is not allowed" in caplog.text
    with pytest.raises(ValueError, match="not allowed"):
        one.convert(str(tmp_path / "strict.tif"), strict=True)
    assert not (tmp_path / "strict.tif").exists()


def test_schema_from_a_url(spark, tmp_path):
    import functools
    import http.server
    import threading

    (tmp_path / "web").mkdir()
    (tmp_path / "web" / "ome.xsd").write_text(XSD)
    handler = functools.partial(http.server.SimpleHTTPRequestHandler, directory=str(tmp_path / "web"))
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        make_mif(str(tmp_path / "m.tif"))
        url = f"http://127.0.0.1:{server.server_port}/ome.xsd"
        report = Converter(spark, str(tmp_path / "m.tif"), "qptiff_mif", schema_location=url).convert(str(tmp_path / "o.tif"))
    finally:
        server.shutdown()
    assert report["ome"]["xml_is_valid"] is True and report["ome"]["schema_location"] == url


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    from tessella import cli

    monkeypatch.setattr(cli, "make_session", lambda: spark)
    make_mif(str(tmp_path / "m.tif"))
    (tmp_path / "names.json").write_text('{"DAPI": "Nuclei"}')
    source, output = str(tmp_path / "m.tif"), str(tmp_path / "o.tif")
    assert cli.main(["--version"]) == 0 and set(json.loads(capsys.readouterr().out)) == {"tessella", "spark"}
    assert cli.main([source, output, "--type", "qptiff_mif", "--omit_uuid", "-v", "--rename_channels_json", str(tmp_path / "names.json"), "--output_json", str(tmp_path / "r.json"),
                     "--cache_directory", str(tmp_path / "cache"), "--series", "0", "--compression", "Uncompressed"]) == 0
    report = json.loads((tmp_path / "r.json").read_text())
    assert report["ome"]["uuid"] is None and "Nuclei" in report["ome"]["xml_string"] and report["options"]["compression"] == "Uncompressed"
    assert report["options"]["rename_channels"] == {"DAPI": "Nuclei"} and set(report["versions"]) == {"tessella", "spark", "java"}
    assert cli.main([source, output, "--type", "component", "--physical_size_x_um", "0.5", "--physical_size_y_um", "0.25"]) == 0
    text = capsys.readouterr().out
    assert json.loads(text[text.index("{") :])["input_file"]["type_description"] == "Akoya Component TIFF"
    with pytest.raises(ValueError):
        cli.main([source, output, "--type", "component"])
    for bad in ([source, output], [source, output, "--type", "none"], [source, output, "--type", "qptiff_mif", "--compression", "Zip"]):
        with pytest.raises(SystemExit):
            cli.main(bad)
    (tmp_path / "many.csv").write_text(f"path,output,image_type\n{source},{tmp_path}/a.tif,qptiff_mif\n")
    assert cli.main(["--manifest", str(tmp_path / "many.csv"), "--output_json", str(tmp_path / "many.json")]) == 0
    assert len(json.loads((tmp_path / "many.json").read_text())) == 1
    spark.sparkContext.setLogLevel("ERROR")


def test_arriving_files_are_converted(spark, tmp_path):
    from tessella.streaming.watch import arriving_files, convert_arriving

    (tmp_path / "in").mkdir()
    (tmp_path / "out").mkdir()
    folders = {"output_folder": str(tmp_path / "out"), "checkpoint": str(tmp_path / "check"), "reports": str(tmp_path / "reports")}
    for round_ in range(2):
        make_mif(str(tmp_path / "in" / f"s{round_}.tif"), ["a"])
        (tmp_path / "in" / "note.txt").write_text("no image")
        convert_arriving(arriving_files(spark, str(tmp_path / "in")), "qptiff_mif", cache_directory=str(tmp_path / "cache"), **folders).awaitTermination()
        assert sorted(p.name for p in (tmp_path / "out").iterdir()) == [f"s{k}.ome.tif" for k in range(round_ + 1)]
    reports = spark.read.parquet(str(tmp_path / "reports"))
    assert sorted(r.batch for r in reports.collect()) == [0, 1] and reports.where("output_file.type_description = 'OME-TIFF'").count() == 2
