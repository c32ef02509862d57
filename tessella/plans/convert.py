"""From vendor images to de-identified, pyramidal OME-TIFFs and reports.

A manifest, one row an image, is converted as one job: pages, documents and tiles of all
images are tables in a store, a folder that driver and executors share, without the
sources' tags; tiles are compressed and files put together by many tasks. A store can be
kept and written again in another form. ``Converter`` is the same for one file.
"""

from __future__ import annotations

import hashlib
import json
import logging
import os
import re
import time
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__
from ..functions import omexml, xsd
from ..functions import scalars as S
from ..operators import pyramid
from ..operators.lineage import check_sources
from ..operators.profiles import PLAIN_SOURCES, PROFILES, checked_sizes, features_of, type_label
from ..sinks import ometiff
from ..sources import tiff
from ..sources.files import filesystem, remove_folder, shared_folder, size_of, spread

COMPRESSIONS = ("LZW", "JPEG", "Uncompressed")
#: Columns of a manifest; those after the third may be left out.
MANIFEST = {"path": "string", "output": "string", "image_type": "string", "series": "int", "physical_size_x": "string", "physical_size_y": "string"}
KEY = ["path", "series"]
log = logging.getLogger("tessella")


def md5_of_file(path: str) -> str:
    """Streams the file, of any size, through the digest."""
    digest = hashlib.md5()
    with tiff.open_file(path) as file:
        while chunk := file.read(4 << 20):
            digest.update(chunk)
    return digest.hexdigest()


def checksums(paths: DataFrame, path_col: str = "path") -> DataFrame:
    """path, size_bytes, md5_checksum of many files, one task a file (the digest is sequential)."""
    def run(frames):
        for frame in frames:
            frame["size_bytes"] = [size_of(p) for p in frame["path"]]
            frame["md5_checksum"] = [md5_of_file(p) for p in frame["path"]]
            yield frame

    chosen = paths.select(F.col(path_col).alias("path")).distinct()
    return spread(chosen, 1, "path").mapInPandas(run, "path string, size_bytes long, md5_checksum string")


def versions(spark: SparkSession | None = None) -> dict[str, str]:
    """Versions of the engine and of what it runs on; Java's where a session runs."""
    import pyspark

    found = {"tessella": __version__, "spark": pyspark.__version__}
    return found | ({"java": spark.sparkContext._jvm.System.getProperty("java.version")} if spark else {})


def checked_manifest(manifest: DataFrame) -> DataFrame:
    """The manifest with all its columns, or an error for what cannot be converted."""
    for name, kind in MANIFEST.items():
        if name not in manifest.columns:
            manifest = manifest.withColumn(name, F.lit(0 if name == "series" else None).cast(kind))
    m = manifest.select(*(F.col(n).cast(k).alias(n) for n, k in MANIFEST.items()))
    known, needy = list(PROFILES), [k for k, p in PROFILES.items() if p.needs_sizes]
    sizes = [F.col(c) for c in ("physical_size_x", "physical_size_y")]
    lacks = F.col("image_type").isin(needy) & (sizes[0].isNull() | sizes[1].isNull())
    wrong = reduce(or_, (x.isNotNull() & ~F.coalesce(x.try_cast("double") > 0, F.lit(False)) for x in sizes))
    odd = F.when(~F.coalesce(F.col("image_type").isin(known), F.lit(False)), F.coalesce("image_type", F.lit("null")))
    a = m.agg(
        F.min(odd).alias("unknown"), F.min(F.when(lacks, F.col("image_type"))).alias("lacks"), F.max(wrong).alias("wrong"), F.count("*").alias("n"),
        F.count(F.when(F.col("path").isNotNull() & F.col("output").isNotNull() & F.col("series").isNotNull(), 1)).alias("whole"),
        F.count_distinct(*KEY).alias("keys"), F.count_distinct("output").alias("outputs"),
    ).first()
    if a.unknown is not None:
        raise ValueError(f"image type is one of {', '.join(known)}, not {a.unknown}")
    if a.lacks is not None:
        raise ValueError(f"{a.lacks} images need physical_size_x and physical_size_y")
    if a.wrong:
        raise ValueError("physical sizes are positive numbers")
    if not a.n or a.whole < a.n:
        raise ValueError("a manifest has rows, whose path, output and series are not null")
    if min(a.keys, a.outputs) < a.n:
        raise ValueError("an image or an output stands twice in the manifest")
    if not m.select(F.col("output").alias("path")).join(m.select("path"), "path", "left_semi").isEmpty():
        raise ValueError("an output would replace an input")
    return m


@dataclass
class TileStore:
    """Tables of images in a folder: manifest, pages, documents and tiles of all levels."""

    spark: SparkSession
    folder: str

    @classmethod
    def create(
        cls, manifest: DataFrame, folder: str, rename: dict[str, str] | None = None, display_uuid: bool = True, tile_size: int = 512,
        downsample: str = "simple", rgb: bool = False,
    ) -> TileStore:
        spark = manifest.sparkSession
        store = cls(spark, folder)
        m = store.write(checked_manifest(manifest), "manifest")
        read = tiff.read_pages(m.select("path")).join(m.drop("output"), KEY)
        pages = store.write(read.drop("tags"), "pages")  # the store holds no tag of a source
        lost = m.join(pages, KEY, "left_anti").first()
        if lost is not None:
            raise ValueError(f"no series {lost.series} in {lost.path}")
        top = pages.where("level = 0")
        shapes = top.groupBy(*KEY).agg(F.max("height").alias("height"), F.max("width").alias("width"))
        documents = None
        for key in sorted(r.image_type for r in m.select("image_type").distinct().collect()):  # as many as PROFILES at most
            f = features_of(read.where((F.col("level") == 0) & (F.col("image_type") == key)), PROFILES[key], rename)
            check_sources(f, PLAIN_SOURCES | PROFILES[key].reads)
            documents = f if documents is None else documents.unionByName(f)
        uuid = F.uuid() if display_uuid else F.lit(None).cast("string")
        documents = store.write(documents.join(shapes, KEY).withColumn("uuid", uuid), "features")  # one uuid, once and for all
        sizes = pyramid.level_sizes(F.col("height"), F.col("width"))
        if rgb:
            documents = documents.withColumns(omexml.merged_samples({n: F.col(n) for n in ("channels", "interleaved", "plane_count")}))
        xml = omexml.ome_document(uuid=F.col("uuid"), level_sizes=sizes).alias("xml")
        store.write(documents.select(*KEY, "uuid", xml, "found_names", F.lit(tile_size).alias("tile_size"), F.lit(rgb).alias("rgb")), "documents")
        levels = shapes.agg(F.max(pyramid.levels_of(F.col("height"), F.col("width")))).first()[0]
        steps = iter(range(levels))
        pyramid.pyramid(tiff.read_blocks(top), tile_size, downsample, levels, lambda df: store.write(df, f"tiles/step={next(steps)}"))
        return store

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.folder}/{name}")
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def tiles(self) -> DataFrame:
        return self.read("tiles").drop("step")

    def documents(self) -> DataFrame:
        """path, series, uuid, xml of every image."""
        return self.read("documents")

    def summary(self) -> DataFrame:
        """What the store holds: tiles and bytes by image, level and channel."""
        grouped = self.tiles().groupBy(*KEY, "level", "c")
        return grouped.agg(F.count("*").alias("n_tiles"), F.sum(F.octet_length("data")).alias("n_bytes"), F.max("height").alias("height"), F.max("width").alias("width"))

    def tree(self) -> str:
        """The summary as an indented text."""
        lines, last = [], None
        for r in self.summary().orderBy(*KEY, "level", "c").toLocalIterator():
            if (r.path, r.series) != last:
                last = (r.path, r.series)
                lines.append(f"{r.path} series {r.series}")
            lines.append(f"  level {r.level} channel {r.c}: {r.width} x {r.height}, {r.n_tiles} tiles, {r.n_bytes} bytes")
        return "\n".join(lines)

    def write_files(self, compression: str = "LZW", quality: int = 90) -> DataFrame:
        """Writes every image's output; path, series, output and the second at which each was there."""
        if compression not in COMPRESSIONS:
            raise ValueError(f"compression is one of {', '.join(COMPRESSIONS)}")
        documents = self.documents()
        size, rgb = documents.select("tile_size", "rgb").first()
        own = documents.select(*KEY, "xml").join(self.read("manifest").select(*KEY, "output", "image_type"), KEY)
        kinds: dict[tuple, list[str]] = {}  # images that are written alike go together
        for r in own.select("image_type").distinct().collect():  # as many as PROFILES at most
            kinds.setdefault(tuple(sorted(PROFILES[r.image_type].writer.items())), []).append(r.image_type)
        done, apart = [], len(kinds) > 1
        for k, (form, types) in enumerate(sorted(kinds.items())):
            how = {"compression": compression, "quality": quality, "predictor": 1} | dict(form)
            name = f"{how['compression']}-{time.time_ns()}-{k}"
            mine = own.where(F.col("image_type").isin(types)).drop("image_type")
            tiles = self.tiles().join(mine.select(*KEY), KEY, "left_semi") if apart else self.tiles()
            index = ometiff.write_segments(tiles, f"{self.folder}/segments-{name}", how["compression"], size, rgb, how["quality"], how["predictor"])
            made = ometiff.write_images(self.write(index, f"index-{name}"), mine, how["compression"], size, how["predictor"])
            done.append(self.write(made, f"outputs-{name}"))
        return reduce(DataFrame.unionAll, done)

    def remove(self) -> None:
        remove_folder(self.spark, self.folder)


def convert_images(
    manifest: DataFrame, cache_directory: str | None = None, rename: dict[str, str] | None = None, display_uuid: bool = True,
    deidentify_ome: bool = True, compression: str = "LZW", rgb: bool = False, quality: int = 90, schema_location: str | None = None,
    strict: bool = False, tile_size: int = 512, downsample: str = "simple", reports: str | None = None,
) -> DataFrame:
    """Converts all images of a manifest; one row each with the report in columns: path,
    series, ome, input_file, output_file, options, conversion_stats, versions (a map); and
    invalid_reason, where the schema rejects the document.

    ``strict``: an error for a document that the schema rejects, before any file is
    written; otherwise it is reported and a warning logged. ``reports``: a folder in which
    the rows are written as Parquet; without it one beside the intermediate data, which
    stays. An image's run ends when its own file is there.
    """
    started = time.time()
    spark = manifest.sparkSession
    if not deidentify_ome:
        raise ValueError("only de-identified output is supported")
    if compression not in COMPRESSIONS:
        raise ValueError(f"compression is one of {', '.join(COMPRESSIONS)}")
    folder = shared_folder(spark, cache_directory)
    try:
        store = TileStore.create(manifest, folder, rename, display_uuid, tile_size, downsample, rgb)
        if log.isEnabledFor(logging.INFO):
            log.info("tiles:\n%s", store.tree())
            log.info("document:\n%s", omexml.pretty(store.documents().first()["xml"]))
        if rename:
            names = store.documents().select(F.explode("found_names").alias("n")).where(F.col("n").isin(list(rename))).distinct()
            for name in sorted(set(rename) - {r.n for r in names.collect()}):
                log.warning("no channel has the name %s", name)
        valid = validated(store.documents(), schema_location, folder, strict)
        outputs = store.write_files(compression, quality)
        files = outputs.select("path").unionAll(outputs.select(F.col("output").alias("path")))
        sums = store.write(checksums(files), "checksums")
        m = store.read("manifest").join(outputs.select(*KEY, "finished"), KEY)
        struct = F.struct("path", "md5_checksum", "size_bytes")
        found = m.join(sums.select("path", struct.alias("i")), "path").join(sums.select(F.col("path").alias("output"), struct.alias("o")), "output")
        found = found.join(valid, KEY)
        kind = lambda c, label: F.col(c).withField("type_description", label)
        rows = found.select(
            *KEY,
            F.struct(F.col("xml").alias("xml_string"), F.lit(schema_location).cast("string").alias("schema_location"), "xml_is_valid", "uuid").alias("ome"),
            kind("i", type_label(F.col("image_type"))).alias("input_file"), kind("o", F.lit("OME-TIFF")).alias("output_file"),
            F.struct(
                written_with(F.col("image_type"), compression).alias("compression"), F.lit(deidentify_ome).alias("deidentify_ome"), F.lit(display_uuid).alias("display_uuid"),
                "series", F.from_json(F.lit(json.dumps(rename or {})), "map<string,string>").alias("rename_channels"),
            ).alias("options"),
            F.struct(
                S.readable_time(F.timestamp_seconds(F.lit(started))).alias("start_time"), S.readable_time(F.timestamp_seconds("finished")).alias("stop_time"),
                S.run_time(F.col("finished") - F.lit(started)).alias("run_time"), S.size_ratio(F.col("o.size_bytes"), F.col("i.size_bytes")).alias("compression_ratio"),
            ).alias("conversion_stats"),
            "invalid_reason",
            F.create_map(*(F.lit(x) for pair in versions(spark).items() for x in pair)).alias("versions"),
        )
        reports = reports or f"{folder}-reports"
        rows.write.parquet(reports)
        return spark.read.parquet(reports)
    finally:
        remove_folder(spark, folder)


def written_with(image_type: Column, compression: str) -> Column:
    """The compression of an image's file: its profile's own, or what the caller asks for."""
    out = F.lit(compression)
    for key, profile in PROFILES.items():
        out = F.when(image_type == key, profile.writer["compression"]).otherwise(out) if "compression" in profile.writer else out
    return out


def validated(documents: DataFrame, schema_location: str | None, folder: str, strict: bool) -> DataFrame:
    """path, series, uuid, xml, xml_is_valid, which is null if no schema was given (none comes with
    the engine), and invalid_reason, which every document has that the schema rejects."""
    spark = documents.sparkSession
    plain = documents.select(*KEY, "uuid", "xml")
    none = F.lit(None).cast("string").alias("invalid_reason")
    if schema_location is None:
        return plain.select("*", F.lit(None).cast("boolean").alias("xml_is_valid"), none)
    path = local_schema(schema_location, folder)
    spark.sparkContext.addFile(path)
    checked = plain.withColumn("xml_is_valid", omexml.schema_valid(F.col("xml"), path))
    with open(path, encoding="utf-8") as file:
        text = file.read()
    try:
        xsd.Schema(text)
        found = xsd.schema_reason(F.when(~F.col("xml_is_valid"), F.col("xml")), text)
    except NotImplementedError as e:
        log.warning("reasons are not told under this schema: %s", e)
        found = F.lit(None).cast("string")
    unknown = F.when(~F.col("xml_is_valid"), "it does not satisfy the schema")
    checked = checked.withColumn("invalid_reason", F.coalesce(found, unknown))
    checked.write.parquet(f"{folder}/reasons")
    checked = spark.read.parquet(f"{folder}/reasons")
    for r in checked.where("not xml_is_valid").limit(10).collect():  # to the log; all are in the result
        if strict:
            raise ValueError(f"the OME document of {r.path} does not satisfy the schema: {r.invalid_reason}")
        log.warning("the OME document of %s does not satisfy the schema: %s", r.path, r.invalid_reason)
    return checked


def local_schema(location: str, folder: str) -> str:
    """A schema as a file: itself, or what a URL gives, in the store's folder."""
    if not re.match(S.REMOTE, location):
        return location
    import urllib.request

    files, at = filesystem(folder)
    if ":/" in folder and not folder.startswith("file:"):
        raise ValueError("download the schema first: the cache folder is no local one")
    with urllib.request.urlopen(location) as answer:
        data = answer.read()
    with files.open_output_stream(f"{at}/schema.xsd") as out:
        out.write(data)
    return f"{at}/schema.xsd"


def series_rows(path: str, output: str, image_type: str, series: int | Sequence[int], **sizes: str | None) -> list[dict]:
    """Manifest rows of one file. Several series have an output each, named by its number."""
    row = {"path": path, "image_type": image_type, **sizes}
    if isinstance(series, int):
        return [row | {"output": output, "series": series}]
    stem, end = os.path.splitext(output)
    stem, end = (stem[:-4], ".ome" + end) if stem.endswith(".ome") else (stem, end)
    return [row | {"output": f"{stem}.series{n}{end}", "series": int(n)} for n in series]


@dataclass
class Converter:
    """One file to convert. ``series``: which of the file's series, one number or several;
    ``rename_channels``: new names by old; physical sizes in micrometres, for types that do
    not hold them."""

    spark: SparkSession
    path: str
    image_type: str
    series: int | Sequence[int] = 0
    rename_channels: dict[str, str] = field(default_factory=dict)
    physical_size_x: str | None = None
    physical_size_y: str | None = None
    cache_directory: str | None = None
    schema_location: str | None = None
    tile_size: int = 512
    downsample: str = "simple"

    def __post_init__(self):
        if self.image_type not in PROFILES:
            raise ValueError(f"image type is one of {', '.join(PROFILES)}")
        self.profile = PROFILES[self.image_type]

    def manifest(self, output: str = "") -> DataFrame:
        rows = series_rows(self.path, output, self.image_type, self.series, physical_size_x=self.physical_size_x, physical_size_y=self.physical_size_y)
        rows = [tuple(None if r[n] is None else str(r[n]) for n in MANIFEST) for r in rows]
        return self.spark.createDataFrame(rows, ", ".join(f"{n} string" for n in MANIFEST))

    def pages(self) -> DataFrame:
        return tiff.read_pages(self.spark.createDataFrame([(self.path,)], "path string"))

    def features(self) -> DataFrame:
        """The fields of the OME document of every chosen series."""
        checked_sizes(self.profile, self.physical_size_x, self.physical_size_y)
        m = self.manifest().select("path", F.col("series").cast("int"), "physical_size_x", "physical_size_y")
        return features_of(self.pages().where("level = 0").join(F.broadcast(m), KEY), self.profile, self.rename_channels)

    def convert(
        self, output: str, display_uuid: bool = True, deidentify_ome: bool = True, compression: str = "LZW", strict: bool = False,
        rgb: bool = False, quality: int = 90,
    ) -> dict | list[dict]:
        """Writes ``output`` and returns the report, a list of them for several series."""
        if filesystem(output)[0] == filesystem(self.path)[0] and os.path.realpath(output) == os.path.realpath(self.path):
            raise ValueError("the output would replace the input")
        folder = shared_folder(self.spark, self.cache_directory)
        try:
            rows = convert_images(
                self.manifest(output), self.cache_directory, self.rename_channels, display_uuid, deidentify_ome, compression, rgb, quality,
                self.schema_location, strict, self.tile_size, self.downsample, folder,
            ).orderBy("series").collect()
        finally:
            remove_folder(self.spark, folder)
        reports = [report_of(r.asDict(recursive=True)) for r in rows]
        return reports[0] if isinstance(self.series, int) else reports


def report_of(row: dict) -> dict:
    """The report of a row of ``convert_images``; its names are public ones, which must stay."""
    names = ("ome", "input_file", "output_file", "options", "conversion_stats", "versions")
    return {n: row[n] for n in names}


def report_text(report: dict | list[dict]) -> str:
    return json.dumps(report, indent=2)
