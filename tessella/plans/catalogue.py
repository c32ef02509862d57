"""Queries over the driver's tables, through the operators of the engine.

The tables know nothing of images, so they are taken for some: an embedding of 64
numbers is an image of 8 x 8 pixels, or a row of one image of all embeddings; the turns
of a conversation are the pages of an image, with a scanner's description each.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import omexml, xsd
from ..functions import scalars as S
from ..operators import profiles, pyramid
from ..sinks import ometiff
from ..sources import arraystore, tiff
from ..sources.files import filesystem, shared_folder
from .convert import checksums, convert_images

RENAMES = {"NATION_0": "Argentina", "NATION_3": "Canada", "NATION_9": "Indonesia", "NATION_99": "unused"}


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding as a block of 8 x 8 pixels of an image of its own."""
    v = t(spark, sf_dir, "embeddings")
    return pyramid.blocks_of_arrays(v, F.col("vec_id"), F.lit(0), F.lit(8), "embedding", 8, 8, "float64")


def one_image(spark: SparkSession, sf_dir: str, dtype: str = "float32") -> DataFrame:
    """All embeddings as the rows of one image, in blocks of one row."""
    v = t(spark, sf_dir, "embeddings")
    return pyramid.blocks_of_arrays(v, F.lit("all"), F.col("vec_id"), F.lit(v.agg(F.max("vec_id")).first()[0] + 1), "embedding", 1, 64, dtype)


#: Rows of an image of many embeddings.
TALL = 300
#: Vectors whose pixels one task compares.
COMPARED = 2000


def tall_images(spark: SparkSession, sf_dir: str, dtype: str = "float32", pixel=lambda x: x) -> DataFrame:
    """Three hundred embeddings an image, as its rows, in blocks of one row."""
    v = t(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", pixel).alias("embedding"))
    n = v.agg(F.max("vec_id")).first()[0] + 1
    k = F.floor(F.col("vec_id") / TALL)
    return pyramid.blocks_of_arrays(v, k, F.col("vec_id") % TALL, F.least(F.lit(TALL), F.lit(n) - TALL * k), "embedding", 1, 64, dtype)


def pixel_rows(tiles: DataFrame, size: int) -> DataFrame:
    p = pyramid.pixels_of(pyramid.as_blocks(tiles, size))
    return p.select(F.col("path").cast("long").alias("vec_id"), "y", "x", F.round("v", 6).alias("v"))


def pyramid_area(spark, sf_dir):
    """The next level of small images by means of 2 x 2 pixels."""
    return pixel_rows(pyramid.reduced(pyramid.retile(small_images(spark, sf_dir), 4), 4, "area"), 4)


def pyramid_simple(spark, sf_dir):
    """The next level of small images by every second pixel."""
    return pixel_rows(pyramid.reduced(pyramid.retile(small_images(spark, sf_dir), 4), 4, "simple"), 4)


def pyramid_binomial(spark, sf_dir):
    """The next level of small images by a filter that reaches over the tiles' borders."""
    return pixel_rows(pyramid.reduced(pyramid.retile(small_images(spark, sf_dir), 4), 4, "binomial"), 4)


def strip_retile(spark, sf_dir):
    """Strips of 64 embeddings side by side, cut to tiles of 32 x 32 pixels."""
    v = t(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.floor(F.col("vec_id") / 64).alias("row"))
    strips = v.groupBy("row").agg(F.flatten(S.in_order(F.col("embedding"), F.col("vec_id"))).alias("v")).where(F.size("v") == 4096)
    n = strips.count()
    blocks = pyramid.blocks_of_arrays(strips, F.lit("strips"), F.col("row"), F.lit(n), "v", 1, 4096, "float32")
    p = pyramid.pixels_of(pyramid.as_blocks(pyramid.retile(blocks, 32), 32))
    return p.groupBy(F.floor(F.col("y") / 32).alias("ty"), F.floor(F.col("x") / 32).alias("tx")).agg(
        F.count("*").alias("n"), F.round(F.sum("v"), 4).alias("total"), F.round(F.min_by("v", F.struct("y", "x")), 6).alias("first"))


def tile_retile(spark, sf_dir):
    """Small images cut to tiles of 6 x 6 pixels, smaller ones at the borders."""
    tiles = pyramid.retile(small_images(spark, sf_dir), 6)
    own = tiles.select(F.concat_ws("/", "path", "ty", "tx").alias("path"), "series", "level", "c", F.lit(0).alias("y0"), F.lit(0).alias("x0"), "h", "w", "dtype", "data")
    sums = pyramid.pixels_of(own).groupBy("path").agg(
        F.count("*").alias("n"), F.round(F.sum("v"), 4).alias("total"), F.round(F.min_by("v", F.struct("y", "x")), 6).alias("first")
    )
    at = F.split("path", "/")
    return sums.select(at[0].cast("long").alias("vec_id"), at[1].cast("long").alias("ty"), at[2].cast("long").alias("tx"), "n", "total", "first")


def pyramid_levels(spark, sf_dir):
    """All levels of one image of all embeddings, as far as it has levels."""
    blocks = one_image(spark, sf_dir)
    n = t(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0] + 1
    folder = shared_folder(spark)
    steps = iter(range(99))

    def write(df: DataFrame) -> DataFrame:
        at = f"{folder}/step-{next(steps)}"
        df.write.parquet(at)
        return spark.read.parquet(at)

    tiles = pyramid.pyramid(blocks, 16, "simple", pyramid.level_count(n, 64), write)
    return pyramid.pixels_of(pyramid.as_blocks(tiles, 16)).select("level", "y", "x", F.round("v", 6).alias("v"))


def register(spark: SparkSession, source: type) -> None:
    """Makes a source known to this session, and this session the active one, in which Spark looks for it."""
    spark.createDataFrame([], "k int")
    spark.dataSource.register(source)


def written_images(tiles: DataFrame, size: int, compression: str, **options) -> DataFrame:
    """Writes tiles as OME-TIFFs; (path, output) of every image, outputs being called like paths."""
    spark = tiles.sparkSession
    folder = shared_folder(spark)
    forms = {k: v for k, v in options.items() if k in ("predictor", "bits")}
    ometiff.write_segments(tiles, f"{folder}/segments", compression, size, options.pop("rgb", False), **forms).write.parquet(f"{folder}/index")
    index = spark.read.parquet(f"{folder}/index")
    own = index.select("path", "series").distinct().withColumns({"xml": F.lit("<OME/>"), "output": F.concat(F.lit(folder + "/"), "path", F.lit(".tif"))})
    return ometiff.write_images(index, own, compression, size, **options)


def two_levels(spark, sf_dir, dtype: str = "float32") -> DataFrame:
    """Tiles of tall images, with a second level where there are more than 256 rows."""
    base = pyramid.retile(tall_images(spark, sf_dir, dtype), 32)
    return base.unionByName(pyramid.reduced(base.where("height > 256"), 32)).where("level < 2")


def image_number(path: Column) -> Column:
    return F.regexp_extract(path, r"(\d+)(\.ome)?\.tif$", 1).cast("long")


def read_pixels(blocks: DataFrame) -> DataFrame:
    return pyramid.pixels_of(blocks).select(image_number(F.col("path")).alias("image"), "y", "x", F.round("v", 6).alias("v"))


def full_size(images: DataFrame) -> DataFrame:
    """Pixels of the images' full size."""
    return read_pixels(tiff.read_blocks(tiff.read_pages(images.select(F.col("output").alias("path"))).where("level = 0")))


def tiff_pixels_lzw(spark, sf_dir):
    """Pixels of images that were written with LZW and read by their pages' blocks."""
    return full_size(written_images(two_levels(spark, sf_dir), 32, "LZW"))


def tiff_pixels_many_writers(spark, sf_dir):
    """The same with each file written by many tasks, in ranges of 20,000 bytes."""
    return full_size(written_images(two_levels(spark, sf_dir), 32, "Uncompressed", part_bytes=20_000, part_rows=1))


def tiff_pixels_sink(spark, sf_dir):
    """The same written by Spark's own writing, with differences of neighbours as bytes (predictor 3)."""
    folder = shared_folder(spark)
    register(spark, ometiff.OmeTiff)
    tiles = pyramid.retile(tall_images(spark, sf_dir), 32)
    tiles.write.format("ome_tiff").mode("append").options(tile_size=32, compression="Deflate", predictor=3).save(folder)
    return full_size(tiles.select("path").distinct().select(F.concat(F.lit(folder + "/"), "path", F.lit(".ome.tif")).alias("output")))


def tiff_pixels_packbits(spark, sf_dir):
    """Numbers of 8 bits, their neighbours' differences packed by runs of bytes."""
    pixels = tall_images(spark, sf_dir, "uint8", lambda x: F.least(F.greatest(F.floor(128 + 4 * x), F.lit(0)), F.lit(255)))
    return full_size(written_images(pyramid.retile(pixels, 32), 32, "PackBits", predictor=2))


def tiff_pixels_twelve_bits(spark, sf_dir):
    pixels = tall_images(spark, sf_dir, "uint16", lambda x: F.least(F.greatest(F.floor(2048 + 400 * x), F.lit(0)), F.lit(4095)))
    return full_size(written_images(pyramid.retile(pixels, 32), 32, "LZW", bits=12))


def tiff_pixels_one_bit(spark, sf_dir):
    return full_size(written_images(pyramid.retile(tall_images(spark, sf_dir, "uint8", lambda x: (x > 0).cast("int")), 32), 32, "PackBits", bits=1))


def tiff_pixels_rgb(spark, sf_dir):
    """Three channels stored as samples of one, read as channels again."""
    byte = lambda k: lambda x: F.least(F.greatest(F.floor(128 + 30 * x + 10 * k), F.lit(0)), F.lit(255))
    parts = [pyramid.retile(tall_images(spark, sf_dir, "uint8", byte(k)).withColumn("c", F.lit(k)), 32) for k in range(3)]
    images = written_images(reduce(DataFrame.unionAll, parts), 32, "LZW", rgb=True)
    blocks = tiff.read_blocks(tiff.read_pages(images.select(F.col("output").alias("path"))))
    return pyramid.pixels_of(blocks).select(image_number(F.col("path")).alias("image"), "c", "y", "x", "v")


def series_list(spark, sf_dir):
    """Numbers of an order's lines, as a list of series is given."""
    lines = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_linenumber")).alias("n"))
    return lines.select("l_orderkey", S.number_list(F.col("n")).alias("series"))


def remote_locations(spark, sf_dir):
    """Which locations would be downloaded; every third here is a file's."""
    url = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("/schemas/"), "url")).otherwise(F.col("url"))
    return t(spark, sf_dir, "pages").select("page_id", S.is_remote(url).alias("remote"))


def stored_image(spark, sf_dir) -> str:
    """The path of a chunked array store of all embeddings, a chunk 32 x 32 pixels."""
    folder = shared_folder(spark)
    arraystore.write_store(pyramid.retile(one_image(spark, sf_dir), 32), folder, 32)
    return f"{folder}/all"


def store_pixels(spark, sf_dir):
    """Pixels of a chunked array store."""
    p = pyramid.pixels_of(pyramid.as_blocks(arraystore.open_store(spark, stored_image(spark, sf_dir)), 32))
    return p.select("y", "x", F.round("v", 6).alias("v"))


def store_pixels_of_chunks(spark, sf_dir):
    """Pixels of the chunks in the right half of every other row of chunks; no other file is opened."""
    tiles = arraystore.read_store(spark, stored_image(spark, sf_dir), "tx = 1 AND ty % 2 = 1")
    return pyramid.pixels_of(pyramid.as_blocks(tiles, 32)).select("y", "x", F.round("v", 6).alias("v"))


def tiff_pixels_of_level(spark, sf_dir):
    """Pixels of the reduced level, which alone the pixel source reads."""
    images = written_images(two_levels(spark, sf_dir), 32, "Deflate")
    register(spark, tiff.TiffBlocks)
    blocks = spark.read.format("tiff_blocks").option("level", 1).load(",".join(r.output for r in images.select("output").collect()))  # a name for many vectors
    return read_pixels(blocks)


def tiff_pixels_jpeg(spark, sf_dir):
    """Bytes written as JPEG tiles and read again, to within 24 of what they were, at ninety percent quality."""
    byte = lambda x: F.least(F.greatest(F.floor(128 + 20 * x), F.lit(0)), F.lit(255))
    read = full_size(written_images(pyramid.retile(tall_images(spark, sf_dir, "uint8", byte), 32), 32, "JPEG"))
    was = t(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", byte).alias("was"))
    # A row a vector on one side, and tasks by their number: adaptive execution joins tasks by
    # compressed bytes, and equal pixels have next to none.
    n = max(1, min(20_000, -(-was.count() // COMPARED)))
    read = read.withColumn("vec_id", F.col("image") * TALL + F.col("y")).repartition(n, "vec_id")
    both = read.join(was.repartition(n, "vec_id"), "vec_id").where(F.col("x") < F.size("was")).withColumn("was", F.get("was", F.col("x").cast("int")))
    return both.groupBy("vec_id").agg(F.count("*").alias("n"), F.max((F.abs(F.col("v") - F.col("was")) > 24).cast("int")).alias("off"))


def tiff_page_structure(spark, sf_dir):
    """One row a page and level of written images, without pixels, by the page source."""
    images = written_images(two_levels(spark, sf_dir, "float64"), 32, "Uncompressed")
    register(spark, tiff.TiffPages)
    p = spark.read.format("tiff_pages").load(",".join(r.output for r in images.select("output").collect()))
    return p.select(image_number(F.col("path")).alias("image"), "series", "level", "page", "height", "width", "dtype", "samples", F.size("offsets").alias("n_blocks"), "compression", "big_endian",
                    F.col("tags")["ImageDescription"].alias("description"))


SCANNED = (
    "<PerkinElmer-QPI-ImageDescription><Name>%s</Name><Operator>SENTINEL</Operator><ScanProfile><root><ScanResolution><PixelSizeMicrons>0.%d0"
    "</PixelSizeMicrons></ScanResolution></root></ScanProfile></PerkinElmer-QPI-ImageDescription>"
)


def scanned_pages(spark, sf_dir) -> DataFrame:
    """The turns of every conversation as pages of an image, in the shape of ``read_pages``."""
    c = t(spark, sf_dir, "conversations")
    xml = F.format_string(SCANNED, F.concat_ws("-", "role", "turn"), F.col("conv_id"))
    size = lambda n: (F.lit(n) + F.col("turn")).cast("long")
    return c.select(
        F.col("conv_id").cast("string").alias("path"), F.lit(0).alias("series"), F.lit(0).alias("level"), F.col("turn").cast("int").alias("page"),
        F.when(F.col("conv_id") % 3 == 0, "float32").when(F.col("conv_id") % 3 == 1, "uint16").otherwise("float64").alias("dtype"),
        F.array(F.lit(1).cast("long"), F.lit(1).cast("long"), size(300), size(400)).alias("shaped"),
        F.create_map(F.lit("ImageDescription"), xml, F.lit("Artist"), F.lit("SENTINEL")).alias("tags"),
    )


def fields(features: DataFrame) -> DataFrame:
    f = features.select("*", F.array_join(F.transform("channels", lambda c: F.concat_ws(":", c["ID"], c["Name"])), "|").alias("listed"))
    return f.select(
        F.col("path").cast("long").alias("conv_id"), "name", "input_type", "size_c", "plane_count", "size_t", "size_z", "size_x", "size_y", "type",
        "physical_size_x", "physical_size_y", "big_endian", "dimension_order", "significant_bits", "listed",
    )


def features_page_dialect(spark, sf_dir):
    """Features of images whose pages are described one by one, some channels renamed."""
    return fields(profiles.image_features(scanned_pages(spark, sf_dir), profiles.PROFILES["qptiff_mif"], rename={"user-0": "First", "none-1": "unused"}))


def features_constant_channels(spark, sf_dir):
    return fields(profiles.image_features(scanned_pages(spark, sf_dir), profiles.PROFILES["qptiff_he"]))


def features_with_given_sizes(spark, sf_dir):
    return fields(profiles.image_features(scanned_pages(spark, sf_dir), profiles.PROFILES["component"], physical_size_x="0.50", physical_size_y="0.25"))


def features_embedded_document(spark, sf_dir):
    """Features of images whose first page holds an OME document."""
    xml = F.format_string(
        '<OME xmlns="%s"><Image><Pixels PhysicalSizeX="0.%d" PhysicalSizeY="0.5" SizeX="%d"><Channel ID="C:%d" Name="n%d"/><Channel ID="D" Name="m" Color="7"/></Pixels></Image></OME>',
        F.lit(omexml.OME_NAMESPACE), *(F.col("path").cast("long") for _ in range(4)),
    )
    pages = scanned_pages(spark, sf_dir).withColumn("tags", F.create_map(F.lit("ImageDescription"), F.when(F.col("page") == 0, xml).otherwise("no XML")))
    return fields(profiles.image_features(pages, profiles.PROFILES["halo_mif"]))


def ome_document_text(spark, sf_dir):
    """Whole documents, without identifiers of the pages they come from."""
    f = profiles.image_features(scanned_pages(spark, sf_dir), profiles.PROFILES["component"], physical_size_x="0.50", physical_size_y="0.25")
    h, w = F.col("size_y").cast("long"), F.col("size_x").cast("long")
    xml = omexml.ome_document(uuid=F.concat(F.lit("u-"), F.col("path")), level_sizes=pyramid.level_sizes(h, w))
    return f.select(F.col("path").cast("long").alias("conv_id"), xml.alias("xml"), xml.contains("SENTINEL").alias("leaks"))


SMALL_XSD = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="part"><xs:complexType>
<xs:attribute name="size" type="xs:positiveInteger" use="required"/></xs:complexType></xs:element></xs:schema>"""


def schema_predicate(spark, sf_dir):
    """Whether documents satisfy a schema; every third lacks what it asks for."""
    folder = shared_folder(spark)
    files, at = filesystem(folder)
    files.create_dir(at, recursive=True)
    with files.open_output_stream(f"{at}/part.xsd") as out:
        out.write(SMALL_XSD.encode())
    spark.sparkContext.addFile(f"{folder}/part.xsd")
    size = F.when(F.col("p_partkey") % 3 > 0, F.col("p_size"))
    return t(spark, sf_dir, "part").select("p_partkey", omexml.schema_valid(omexml.element("part", {"size": size}), f"{at}/part.xsd").alias("valid"))


ORDER_XSD = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="part"><xs:complexType>
<xs:sequence><xs:element name="name" type="xs:string"/><xs:element name="size" type="xs:positiveInteger" minOccurs="0" maxOccurs="2"/></xs:sequence>
<xs:attribute name="key" type="xs:integer" use="required"/></xs:complexType></xs:element></xs:schema>"""


def schema_reasons(spark, sf_dir):
    """Where documents leave their schema: five of six do, each kind in its own way."""
    name, size = omexml.element("name", {}, omexml.escaped(F.col("p_name"))), omexml.element("size", {}, F.col("p_size").cast("string"))
    kind = F.pmod(F.col("p_partkey"), F.lit(6))
    inner = (
        F.when(kind == 1, F.concat(size, name)).when(kind == 2, F.concat(name, size, size, size))
        .when(kind == 3, F.concat(name, F.lit("<size>0</size>"))).when(kind == 4, F.lit("")).otherwise(F.concat(name, size))
    )
    xml = omexml.element("part", {"key": F.when(kind != 5, F.col("p_partkey"))}, inner)
    return t(spark, sf_dir, "part").select("p_partkey", xsd.schema_reason(xml, ORDER_XSD).alias("reason"))


def file_checksums(spark, sf_dir):
    """Digests and sizes of files, one for each nation, that hold its name."""
    folder = shared_folder(spark)

    def put(frames):
        files, at = filesystem(folder)
        files.create_dir(at, recursive=True)
        for frame in frames:
            for key, name in zip(frame["n_nationkey"], frame["n_name"], strict=True):
                with files.open_output_stream(f"{at}/{key}.txt", compression=None) as out:
                    out.write(name.encode())
            yield frame[["path"]]

    named = t(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.concat(F.lit(folder + "/"), F.col("n_nationkey").cast("string"), F.lit(".txt")).alias("path"))
    named.mapInPandas(put, "path string").write.parquet(f"{folder}/paths")
    sums = checksums(spark.read.parquet(f"{folder}/paths"))
    return sums.select(F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("int").alias("n_nationkey"), "md5_checksum", "size_bytes")


def conversion_report(spark, sf_dir):
    """Reports of one job that converts an image for each region, named after it."""
    folder = shared_folder(spark)
    r = t(spark, sf_dir, "region").select("r_regionkey", "r_name")
    pixels = r.withColumn("v", F.transform(F.sequence(F.lit(0), F.lit(299)), lambda i: (i + F.col("r_regionkey")) % 251))
    path = F.concat(F.lit(folder + "/"), F.col("r_regionkey").cast("string"), F.lit(".tif"))
    blocks = pyramid.blocks_of_arrays(pixels, path, F.lit(0), F.lit(1), "v", 1, 300, "uint8")
    ometiff.write_segments(pyramid.retile(blocks, 64), f"{folder}/segments", "LZW", 64).write.parquet(f"{folder}/index")
    xml = F.format_string(SCANNED, F.col("r_name"), F.col("r_regionkey"))
    own = r.select(path.alias("path"), F.lit(0).alias("series"), xml.alias("xml"), path.alias("output"))
    ometiff.write_images(spark.read.parquet(f"{folder}/index"), own, "LZW", 64).write.parquet(f"{folder}/written")
    manifest = spark.read.parquet(f"{folder}/written").select("path", F.concat("path", F.lit(".ome.tif")).alias("output"), F.lit("qptiff_mif").alias("image_type"))
    rows = convert_images(manifest, rename={"ASIA": "East"}, compression="LZW", tile_size=64, display_uuid=False)
    pixels = omexml.parsed(F.col("ome.xml_string"), omexml.EMBEDDED_XML)["Image"]["Pixels"]
    return rows.select(
        F.regexp_extract("path", r"(\d+)\.tif$", 1).cast("int").alias("r_regionkey"), F.get(pixels["Channel"], 0)["_Name"].alias("channel"),
        pixels["_SizeX"].alias("size_x"), pixels["_PhysicalSizeX"].alias("physical_size_x"), F.col("input_file.type_description").alias("input_type"),
        F.col("output_file.type_description").alias("output_type"), F.col("options.compression").alias("compression"), F.col("ome.uuid").alias("uuid"),
        (F.col("conversion_stats.compression_ratio") > 0).alias("has_ratio"), F.length("output_file.md5_checksum").alias("digits"),
    )


def md5_checksum(spark, sf_dir):
    return t(spark, sf_dir, "documents").select(
        "doc_id", F.md5(F.col("text")).alias("md5_checksum"), F.octet_length("text").cast("long").alias("size_bytes")
    )


def duplicate_file_groups(spark, sf_dir):
    groups = t(spark, sf_dir, "documents").groupBy(F.md5(F.col("text")).alias("md5_checksum"))
    return groups.agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


def channel_rename(spark, sf_dir):
    mapping = F.create_map(*(F.lit(x) for pair in RENAMES.items() for x in pair))
    return t(spark, sf_dir, "nation").select("n_nationkey", S.renamed(F.col("n_name"), mapping).alias("n_name"))


def channel_rename_join(spark, sf_dir):
    """The same as a left join with a table of names, which is of a fixed small size."""
    names = spark.createDataFrame(list(RENAMES.items()), "old string, new string")
    joined = t(spark, sf_dir, "nation").join(F.broadcast(names), F.col("n_name") == F.col("old"), "left")
    return joined.select("n_nationkey", F.coalesce("new", "n_name").alias("n_name"))


def json_metadata_field(spark, sf_dir):
    return t(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


def json_map_parse(spark, sf_dir):
    return t(spark, sf_dir, "events").select("event_id", S.rename_map(F.col("props"))["k"].alias("k"))


def run_time_format(spark, sf_dir):
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    spans = t(spark, sf_dir, "events").groupBy("user_id").agg((F.max(micros) - F.min(micros)).alias("us"))
    return spans.select("user_id", S.run_time(F.col("us") / F.lit(1e6)).alias("run_time"))


def readable_timestamp(spark, sf_dir):
    return t(spark, sf_dir, "events").select("event_id", S.readable_time(F.col("ts")).alias("readable"))


def markup_field_extract(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


def version_probe(spark, sf_dir):
    """The version pattern over made-up tool output: a match for every other part."""
    text = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("  Version = "), F.col("p_size").cast("string"), F.lit(".1 x"))).otherwise("none")
    return t(spark, sf_dir, "part").select("p_partkey", S.tool_version(text).alias("version"))


def channel_element_render(spark, sf_dir):
    made = omexml.element("Channel", {
        "ID": F.format_string("Channel:%d:%d", "conv_id", "turn"), "Name": F.col("role"), "SamplesPerPixel": F.lit(1),
    }, F.lit("<LightPath/>"))
    return t(spark, sf_dir, "conversations").select("conv_id", "turn", made.alias("element"))


def xml_escape(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", omexml.escaped(F.col("html")).alias("escaped"))


def channels_ordered_collect(spark, sf_dir):
    grouped = t(spark, sf_dir, "conversations").groupBy("conv_id")
    return grouped.agg(F.array_join(S.in_order(F.col("role"), F.col("turn")), "|").alias("channels"))


def page_ordinals(spark, sf_dir):
    """Pages paired with their ordinals, as enumerate does."""
    listed = t(spark, sf_dir, "conversations").groupBy("conv_id").agg(S.in_order(F.col("role"), F.col("turn")).alias("roles"))
    return listed.select("conv_id", F.posexplode("roles").alias("i", "role")).withColumn("i", F.col("i").cast("long"))


def series_page_count(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("size_c"), F.count("*").alias("plane_count"))


def compression_ratio(spark, sf_dir):
    lines = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("s"))
    both = t(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return both.select("o_orderkey", F.round(S.size_ratio(F.col("s"), F.col("o_totalprice")), 6).alias("ratio"))


def argument_filter(spark, sf_dir):
    """A command's arguments without those that are null."""
    flag = F.when(F.col("o_orderpriority").startswith("1"), "-p")
    made = S.argument_list(F.lit("run"), flag, F.col("o_orderstatus"))
    return t(spark, sf_dir, "orders").select("o_orderkey", F.array_join(made, " ").alias("command"))


def ome_xml_roundtrip(spark, sf_dir):
    """Documents rendered from parts and parsed again."""
    p = t(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    xml = F.concat(F.lit(f'<OME xmlns="{omexml.OME_NAMESPACE}"><Image>'), omexml.element(
        "Pixels", {"SizeX": F.col("p_size"), "SizeY": F.col("p_size")},
        omexml.element("Channel", {"ID": F.lit("Channel:0:0"), "Name": F.col("p_name"), "SamplesPerPixel": F.lit(1)}),
    ), F.lit("</Image></OME>"))
    q = p.select("p_partkey", omexml.parsed(xml, omexml.EMBEDDED_XML)["Image"]["Pixels"].alias("x"))
    return q.select("p_partkey", F.col("x._SizeX").alias("size_x"), F.get("x.Channel", 0)["_Name"].alias("name"))


def tag_map_last_wins(spark, sf_dir):
    """Of a conversation's turns by role, the last of each role."""
    c = t(spark, sf_dir, "conversations").groupBy("conv_id")
    c = c.agg(S.in_order(F.col("role"), F.col("turn")).alias("names"), S.in_order(F.col("turn").cast("string"), F.col("turn")).alias("turns"))
    tags = S.last_wins(F.col("names"), F.col("turns"))
    return c.select("conv_id", tags["user"].alias("user"), tags["assistant"].alias("assistant"), F.size(F.map_keys(tags)).alias("n_roles"))


def dtype_map(spark, sf_dir):
    """Pixel types under the names of the document."""
    dtype = F.element_at(F.array(*map(F.lit, ("uint8", "uint16", "float32", "float64"))), F.pmod(F.col("p_partkey"), F.lit(4)).cast("int") + 1)
    return t(spark, sf_dir, "part").select("p_partkey", profiles.ome_type(dtype).alias("type"))


def type_dispatch(spark, sf_dir):
    """Labels of image types, of unknown ones null."""
    kind = F.element_at(F.array(*map(F.lit, ("qptiff_mif", "qptiff_he", "halo_mif", "component", "other"))), F.pmod(F.col("event_id"), F.lit(5)).cast("int") + 1)
    return t(spark, sf_dir, "events").select("event_id", profiles.type_label(kind).alias("label"))


def features_annotation_merge(spark, sf_dir):
    """Features joined one to one with the first annotation of a document, kept without one."""
    l = t(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))  # noqa: E741
    note = lambda name: F.format_string('<MapAnnotation ID="%s" Namespace="n"><Value><M K="k">%d</M></Value></MapAnnotation>', F.lit(name), F.col(name))
    notes = F.when(F.col("doc_id") % 2 == 0, F.concat(note("quality"), note("toxic"))).otherwise("")
    xml = F.concat(F.lit("<OME><StructuredAnnotations>"), notes, F.lit("</StructuredAnnotations></OME>"))
    found = profiles.annotated(t(spark, sf_dir, "documents").select("doc_id", "lang"), l.select("doc_id", xml.alias("xml")), ("doc_id",), find=omexml.first_annotation)
    return found.select("doc_id", "lang", F.col("annotation._ID").alias("note_id"), F.get("annotation.Value.M", 0)["_VALUE"].alias("note"))


def annotation_anywhere(spark, sf_dir):
    """The first annotation of documents that hold it deep in their trees, with and without a prefix,
    beside others of a foreign namespace."""
    l = t(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))  # noqa: E741
    deep = '<{0}Image><{0}Plane><{0}MapAnnotation ID="A:%d" Namespace="n"><{0}Value><{0}M K="quality">%d</{0}M></{0}Value></{0}MapAnnotation></{0}Plane></{0}Image>'
    head = '<{1}OME xmlns{0}="' + omexml.OME_NAMESPACE + '"><MapAnnotation xmlns="urn:other" ID="foreign"/>'
    made = lambda prefix, mark: F.format_string(head.format(mark, prefix) + deep.format(prefix) + f"</{prefix}OME>", "doc_id", F.coalesce("quality", F.lit(9)))
    xml = F.when(F.col("doc_id") % 3 == 0, made("o:", ":o")).when(F.col("doc_id") % 3 == 1, made("", "")).otherwise('<OME><MapAnnotation ID="none"/></OME>')
    a = omexml.first_map_annotation(xml)
    return l.select("doc_id", a.alias("a")).select("doc_id", "a.path", F.col("a.attributes")["ID"].alias("note_id"), F.get("a.texts", 0)["value"].alias("note"))


PIXELS = """
p AS (SELECT vec_id, (i - 1) // 8 AS y, (i - 1) % 8 AS x, CAST(embedding[i] AS DOUBLE) AS v
      FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings))"""

ROWS = """
p AS (SELECT vec_id AS y, i - 1 AS x, CAST(embedding[i] AS DOUBLE) AS v
      FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings))"""

TALLS = f"""
p AS (SELECT vec_id // {TALL} AS image, vec_id % {TALL} AS y, i - 1 AS x, CAST(embedding[i] AS DOUBLE) AS v
      FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings)),
n AS (SELECT image, max(y) + 1 AS n FROM p GROUP BY image)"""

_TYPE = "['float', 'uint16', 'double'][conv_id % 3 + 1]"


def _features(name: str, kind: str, size_c: str, px: str, py: str, listed: str, size_x: str = "'400'") -> str:
    return f"""SELECT conv_id, {name} AS name, {kind} AS input_type, CAST({size_c} AS BIGINT) AS size_c, CAST({size_c} AS BIGINT) AS plane_count,
        CAST(1 AS BIGINT) AS size_t, CAST(1 AS BIGINT) AS size_z, {size_x} AS size_x, '300' AS size_y, {_TYPE} AS type, {px} AS physical_size_x, {py} AS physical_size_y,
        'true' AS big_endian, 'XYZCT' AS dimension_order, 8 AS significant_bits, {listed} AS listed FROM conversations GROUP BY conv_id"""


_RENAME = "CASE n_name " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in RENAMES.items()) + " ELSE n_name END"

SQL = {
    "pyramid_area": f"WITH {PIXELS} SELECT vec_id, y // 2 AS y, x // 2 AS x, round(avg(v), 6) AS v FROM p GROUP BY ALL",
    "pyramid_simple": f"WITH {PIXELS} SELECT vec_id, y // 2 AS y, x // 2 AS x, round(v, 6) AS v FROM p WHERE y % 2 = 0 AND x % 2 = 0",
    "tile_retile": f"""WITH {PIXELS} SELECT vec_id, y // 6 AS ty, x // 6 AS tx, count(*) AS n, round(sum(v), 4) AS total,
        round(arg_min(v, y * 8 + x), 6) AS first FROM p GROUP BY vec_id, y // 6, x // 6""",
    "pyramid_binomial": f"""WITH {PIXELS}, k AS (SELECT unnest([-1, 0, 1, 2]) AS d, unnest([1, 3, 3, 1]) AS t)
        SELECT o.vec_id, o.y // 2 AS y, o.x // 2 AS x, round(sum(a.t * b.t * p.v) / 64, 6) AS v FROM p o, k a, k b, p
        WHERE o.y % 2 = 0 AND o.x % 2 = 0 AND p.vec_id = o.vec_id AND p.y = least(greatest(o.y + a.d, 0), 7) AND p.x = least(greatest(o.x + b.d, 0), 7)
        GROUP BY o.vec_id, o.y, o.x""",
    "strip_retile": """WITH p AS (SELECT vec_id // 64 AS y, (vec_id % 64) * 64 + i - 1 AS x, CAST(embedding[i] AS DOUBLE) AS v
          FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings) WHERE vec_id // 64 < (SELECT (max(vec_id) + 1) // 64 FROM embeddings))
        SELECT y // 32 AS ty, x // 32 AS tx, count(*) AS n, round(sum(v), 4) AS total, round(arg_min(v, y * 4096 + x), 6) AS first FROM p GROUP BY y // 32, x // 32""",
    "pyramid_levels": f"""WITH {ROWS}, l AS (SELECT unnest(range(0, 30)) AS level), n AS (SELECT greatest(max(y) + 1, 64) AS n FROM p)
        SELECT CAST(level AS INTEGER) AS level, y // (1 << level) AS y, x // (1 << level) AS x, round(v, 6) AS v FROM p, l, n
        WHERE (level = 0 OR ceil(n / pow(2, level - 1)) > 256) AND y % (1 << level) = 0 AND x % (1 << level) = 0""",
    "tiff_pixels_lzw": f"WITH {TALLS} SELECT image, y, x, round(v, 6) AS v FROM p",
    "tiff_pixels_many_writers": f"WITH {TALLS} SELECT image, y, x, round(v, 6) AS v FROM p",
    "tiff_pixels_sink": f"WITH {TALLS} SELECT image, y, x, round(v, 6) AS v FROM p",
    "tiff_pixels_packbits": f"WITH {TALLS} SELECT image, y, x, least(greatest(floor(128 + 4 * v), 0), 255) AS v FROM p",
    "tiff_pixels_twelve_bits": f"WITH {TALLS} SELECT image, y, x, least(greatest(floor(2048 + 400 * v), 0), 4095) AS v FROM p",
    "tiff_pixels_one_bit": f"WITH {TALLS} SELECT image, y, x, CAST(v > 0 AS DOUBLE) AS v FROM p",
    "tiff_pixels_rgb": f"""WITH {TALLS}, k AS (SELECT CAST(unnest(range(3)) AS INTEGER) AS c)
        SELECT image, c, y, x, least(greatest(floor(128 + 30 * v + 10 * c), 0), 255) AS v FROM p, k""",
    "series_list": "SELECT l_orderkey, string_agg(DISTINCT CAST(l_linenumber AS VARCHAR), ',' ORDER BY CAST(l_linenumber AS VARCHAR)) AS series FROM lineitem GROUP BY l_orderkey",
    "remote_locations": "SELECT page_id, page_id % 3 > 0 AND (starts_with(url, 'https://') OR starts_with(url, 'http:')) AS remote FROM pages",
    "store_pixels": f"WITH {ROWS} SELECT y, x, round(v, 6) AS v FROM p",
    "store_pixels_of_chunks": f"WITH {ROWS} SELECT y, x, round(v, 6) AS v FROM p WHERE x >= 32 AND y // 32 % 2 = 1",
    "tiff_pixels_of_level": f"""WITH {TALLS} SELECT image, y // 2 AS y, x // 2 AS x, round(v, 6) AS v FROM p JOIN n USING (image)
        WHERE y % 2 = 0 AND x % 2 = 0 AND n > 256""",
    "tiff_pixels_jpeg": "SELECT vec_id, CAST(len(embedding) AS BIGINT) AS n, 0 AS off FROM embeddings",
    "tiff_page_structure": f"""WITH {TALLS}, l AS (
        SELECT image, 0 AS level, n AS height, 64 AS width FROM n UNION ALL SELECT image, 1, (n + 1) // 2, 32 FROM n WHERE n > 256)
        SELECT image, 0 AS series, level, 0 AS page, height, CAST(width AS BIGINT) AS width, 'float64' AS dtype, 1 AS samples,
        CAST(ceil(height / 32) * ceil(width / 32) AS INTEGER) AS n_blocks, 1 AS compression, true AS big_endian,
        CASE WHEN level = 0 THEN '<OME/>' END AS description FROM l""",
    "features_page_dialect": _features("'WholeSlideMIF'", "'Akoya MIF QPTIFF'", "count(*)", "'0.' || conv_id || '0'", "'0.' || conv_id || '0'",
        "string_agg('Channel:0:' || turn || ':' || CASE WHEN role = 'user' AND turn = 0 THEN 'First' ELSE role || '-' || turn END, '|' ORDER BY turn)"),
    "features_constant_channels": _features("'WholeSlideHE'", "'Akoya HE QPTIFF'", "3", "'0.' || conv_id || '0'", "'0.' || conv_id || '0'",
        "'Channel:0:0:RED|Channel:0:1:GREEN|Channel:0:2:BLUE'"),
    "features_with_given_sizes": _features("'Component'", "'Akoya Component TIFF'", "count(*)", "'0.50'", "'0.25'",
        "string_agg('Channel:0:' || turn || ':' || role || '-' || turn, '|' ORDER BY turn)"),
    "features_embedded_document": _features("'WholeSlideMIF'", "'Halo MIF TIFF'", "count(*)", "'0.' || conv_id", "'0.5'",
        "'C:' || conv_id || ':n' || conv_id || '|D:m'", "CAST(conv_id AS VARCHAR)"),
    "ome_document_text": f"""SELECT conv_id, '<?xml version=''1.0'' encoding=''utf-8''?>' || chr(10) ||
        '<OME xmlns="{omexml.OME_NAMESPACE}" xmlns:xsi="{omexml.XSI}" xsi:schemaLocation="{omexml.OME_NAMESPACE} {omexml.OME_SCHEMA}" UUID="urn:uuid:u-'
        || conv_id || '"><Image ID="Image:0" Name="Component"><Pixels BigEndian="true" DimensionOrder="XYZCT" ID="Pixels:0" Interleaved="false" PhysicalSizeX="0.50"'
        || ' PhysicalSizeXUnit="µm" PhysicalSizeY="0.25" PhysicalSizeYUnit="µm" SignificantBits="8" SizeC="' || count(*) || '" SizeT="1" SizeX="400" SizeY="300" SizeZ="1" Type="'
        || {_TYPE} || '">' || string_agg('<Channel ID="Channel:0:' || turn || '" Name="' || role || '-' || turn || '" SamplesPerPixel="1"><LightPath/></Channel>', '' ORDER BY turn)
        || '<TiffData IFD="0" PlaneCount="' || count(*) || '"/></Pixels></Image><StructuredAnnotations><MapAnnotation ID="Annotation:Resolution:0"'
        || ' Namespace="{omexml.PYRAMID_NAMESPACE}"><Value><M K="1">200 150</M></Value></MapAnnotation></StructuredAnnotations></OME>' AS xml, false AS leaks
        FROM conversations GROUP BY conv_id""",
    "schema_predicate": "SELECT p_partkey, p_partkey % 3 > 0 AS valid FROM part",
    "schema_reasons": """SELECT p_partkey, CASE p_partkey % 6 WHEN 1 THEN '/part: element ''size'' is not expected, but name'
        WHEN 2 THEN '/part: element ''size'' is not expected' WHEN 3 THEN '/part/size: ''0'' is no positiveInteger'
        WHEN 4 THEN '/part: element ''name'' is missing' WHEN 5 THEN '/part: attribute ''key'' is missing' END AS reason FROM part""",
    "file_checksums": "SELECT n_nationkey, md5(n_name) AS md5_checksum, CAST(strlen(n_name) AS BIGINT) AS size_bytes FROM nation",
    "conversion_report": """SELECT r_regionkey, CASE r_name WHEN 'ASIA' THEN 'East' ELSE r_name END AS channel, '300' AS size_x, '0.' || r_regionkey || '0' AS physical_size_x,
        'Akoya MIF QPTIFF' AS input_type, 'OME-TIFF' AS output_type, 'LZW' AS compression, CAST(NULL AS VARCHAR) AS uuid, true AS has_ratio, 32 AS digits FROM region""",
    "tag_map_last_wins": """SELECT conv_id, CAST(max(turn) FILTER (role = 'user') AS VARCHAR) AS "user", CAST(max(turn) FILTER (role = 'assistant') AS VARCHAR) AS assistant,
        CAST(count(DISTINCT role) AS INTEGER) AS n_roles FROM conversations GROUP BY conv_id""",
    "dtype_map": "SELECT p_partkey, ['uint8', 'uint16', 'float', 'double'][p_partkey % 4 + 1] AS type FROM part",
    "type_dispatch": """SELECT event_id, ['Akoya MIF QPTIFF', 'Akoya HE QPTIFF', 'Halo MIF TIFF', 'Akoya Component TIFF', NULL][event_id % 5 + 1] AS label FROM events""",
    "features_annotation_merge": """SELECT d.doc_id, lang, CASE WHEN d.doc_id % 2 = 0 AND q IS NOT NULL THEN 'quality' END AS note_id,
        CASE WHEN d.doc_id % 2 = 0 THEN CAST(q AS VARCHAR) END AS note FROM documents d
        LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY 1) n ON d.doc_id = n.doc_id""",
    "annotation_anywhere": """SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN '/OME/Image/Plane/MapAnnotation' END AS path, CASE WHEN doc_id % 3 < 2 THEN 'A:' || doc_id END AS note_id,
        CASE WHEN doc_id % 3 < 2 THEN CAST(coalesce(max(quality), 9) AS VARCHAR) END AS note FROM labels GROUP BY doc_id""",
    "md5_checksum": "SELECT doc_id, md5(text) AS md5_checksum, strlen(text) AS size_bytes FROM documents",
    "duplicate_file_groups": "SELECT md5(text) AS md5_checksum, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "channel_rename": f"SELECT n_nationkey, {_RENAME} AS n_name FROM nation",
    "channel_rename_join": f"SELECT n_nationkey, {_RENAME} AS n_name FROM nation",
    "json_metadata_field": "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
    "json_map_parse": "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
    "run_time_format": """WITH s AS (SELECT user_id, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS s FROM events GROUP BY user_id)
        SELECT user_id, printf('%02d:%02d:%05.2f', CAST(floor(s / 3600) AS BIGINT), CAST(floor((s % 3600) / 60) AS BIGINT), s % 60) AS run_time FROM s""",
    "readable_timestamp": "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS readable FROM events",
    "markup_field_extract": "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages",
    "version_probe": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_size || '.1' END AS version FROM part",
    "channel_element_render": """SELECT conv_id, turn, printf('<Channel ID="Channel:%d:%d" Name="%s" SamplesPerPixel="1"><LightPath/></Channel>',
        conv_id, turn, role) AS element FROM conversations""",
    "xml_escape": """SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped FROM pages""",
    "channels_ordered_collect": "SELECT conv_id, string_agg(role, '|' ORDER BY turn) AS channels FROM conversations GROUP BY conv_id",
    "page_ordinals": "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, role FROM conversations",
    "series_page_count": "SELECT l_orderkey, count(*) AS size_c, count(*) AS plane_count FROM lineitem GROUP BY l_orderkey",
    "compression_ratio": """SELECT o_orderkey, round(s / nullif(o_totalprice, 0), 6) AS ratio FROM orders
        JOIN (SELECT l_orderkey, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""",
    "argument_filter": "SELECT o_orderkey, concat_ws(' ', 'run', CASE WHEN o_orderpriority LIKE '1%' THEN '-p' END, o_orderstatus) AS command FROM orders",
    "ome_xml_roundtrip": "SELECT p_partkey, CAST(p_size AS VARCHAR) AS size_x, p_name AS name FROM part",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: globals()[name] for name in SQL}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
