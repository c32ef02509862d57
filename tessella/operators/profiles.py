"""Vendor profiles: how each kind of image gives its features.

A profile is a set of column expressions over pages, so that features of any number of
images are one plan. A new vendor is a subclass of ``Profile`` that overrides what
differs, given to ``register``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..functions.omexml import EMBEDDED_XML, SCANNER_XML, first_map_annotation, parsed
from .lineage import leaves

#: Pixel types that OME names otherwise.
OME_TYPES = {"float32": "float", "float64": "double"}


def channel(id_: Column, name: Column, samples: Column, color: Column | None = None) -> Column:
    color = F.lit(None).cast("string") if color is None else color
    return F.struct(id_.alias("ID"), name.alias("Name"), samples.cast("int").alias("SamplesPerPixel"), color.alias("Color"))


def ome_type(dtype: Column) -> Column:
    out = dtype
    for raw, name in OME_TYPES.items():
        out = F.when(dtype == raw, name).otherwise(out)
    return out


def numbered(names: Column) -> Column:
    """Channels of one sample with the given names."""
    return F.transform(names, lambda c, i: channel(F.concat(F.lit("Channel:0:"), i.cast("string")), c, F.lit(1)))


def described(schema: T.StructType) -> frozenset[str]:
    return frozenset(f"tags.ImageDescription/{x}" for x in leaves(schema.jsonValue()))


#: Columns of pages and manifests that documents are made of, beside what a profile reads.
PLAIN_SOURCES = frozenset(("path", "series", "page", "shaped", "dtype", "physical_size_x", "physical_size_y"))


class Profile:
    """The page dialect: every page is a channel and describes itself.

    ``description`` and ``page_name`` see pages (page, tags and their other columns); the
    other methods see one row an image: n_pages, shaped, dtype, d (the description of
    the first page), names (those of the pages, in order), physical_size_x and _y (from
    the caller, or null).
    """

    key = "qptiff_mif"
    label = "Akoya MIF QPTIFF"
    image_name = "WholeSlideMIF"
    needs_sizes = False  # the caller gives physical sizes
    #: What this kind of image is written with, whatever the caller says: compression, quality, predictor.
    writer: dict[str, str | int] = {}

    #: What is read of the first page's description: all that may come from a tag. A profile that
    #: reads other tags or fields has to list them, as tags.Name, or tags.Name/Field of a text.
    reads = described(SCANNER_XML)

    def description(self) -> Column:
        return parsed(F.col("tags")["ImageDescription"], SCANNER_XML)

    def page_name(self) -> Column:
        return F.col("description")["Name"]

    def physical_sizes(self) -> tuple[Column, Column]:
        micrometres = F.col("d")["ScanProfile"]["root"]["ScanResolution"]["PixelSizeMicrons"]
        return micrometres, micrometres

    def sizes(self) -> tuple[Column, Column]:
        return F.get("shaped", 3).cast("string"), F.get("shaped", 2).cast("string")

    def size_c(self) -> Column:
        return F.col("n_pages")

    def channels(self) -> Column:
        return numbered(F.col("names"))


class ConstantChannels(Profile):
    """One page of red, green and blue; only the first page is described."""

    key, label, image_name = "qptiff_he", "Akoya HE QPTIFF", "WholeSlideHE"
    names = ("RED", "GREEN", "BLUE")

    def description(self) -> Column:
        return F.when(F.col("page") == 0, super().description())

    def size_c(self) -> Column:
        return F.lit(len(self.names)).cast("long")

    def channels(self) -> Column:
        return numbered(F.array(*map(F.lit, self.names)))


class EmbeddedDocument(Profile):
    """The first page holds an OME document."""

    key, label, image_name = "halo_mif", "Halo MIF TIFF", "WholeSlideMIF"
    reads = described(EMBEDDED_XML)

    def description(self) -> Column:
        return F.when(F.col("page") == 0, parsed(F.col("tags")["ImageDescription"], EMBEDDED_XML))

    def page_name(self) -> Column:
        return F.lit(None).cast("string")

    def pixels(self) -> Column:
        return F.col("d")["Image"]["Pixels"]

    def physical_sizes(self) -> tuple[Column, Column]:
        return self.pixels()["_PhysicalSizeX"], self.pixels()["_PhysicalSizeY"]

    def sizes(self) -> tuple[Column, Column]:
        x, y = super().sizes()
        return F.coalesce(self.pixels()["_SizeX"], x), F.coalesce(self.pixels()["_SizeY"], y)

    def channels(self) -> Column:
        return F.transform(self.pixels()["Channel"], lambda c: channel(c["_ID"], c["_Name"], F.coalesce(c["_SamplesPerPixel"], F.lit(1)), c["_Color"]))


class Component(Profile):
    """The page dialect without physical sizes."""

    key, label, image_name, needs_sizes = "component", "Akoya Component TIFF", "Component", True

    def physical_sizes(self) -> tuple[Column, Column]:
        return F.col("physical_size_x"), F.col("physical_size_y")


PROFILES: dict[str, Profile] = {}


def register(profile: Profile) -> Profile:
    """Makes a profile known by its key."""
    PROFILES[profile.key] = profile
    return profile


for _kind in (Profile, ConstantChannels, EmbeddedDocument, Component):
    register(_kind())


def type_label(image_type: Column) -> Column:
    """The label of an image type by its key, or null."""
    out = F.lit(None).cast("string")
    for key, profile in PROFILES.items():
        out = F.when(image_type == key, profile.label).otherwise(out)
    return out


def checked_sizes(profile: Profile, *sizes: str | None) -> None:
    if profile.needs_sizes and None in sizes:
        raise ValueError(f"{profile.key} images need physical_size_x and physical_size_y")
    for value in sizes:
        if value is not None and not float(value) > 0:
            raise ValueError("physical sizes are positive numbers")


def features_of(
    pages: DataFrame, profile: Profile, rename: dict[str, str] | None = None, significant_bits: int = 8, by: tuple[str, ...] = ("path", "series"),
) -> DataFrame:
    """One row per image with the fields of the OME document, from the pages of its full
    size (level 0), which may have physical_size_x and physical_size_y columns.

    Channels of a page dialect come in page order. The default of eight significant
    bits holds for every type. ``rename`` maps channel names; names without an entry
    stay, entries without a name do nothing.
    """
    for n in ("physical_size_x", "physical_size_y"):
        if n not in pages.columns:
            pages = pages.withColumn(n, F.lit(None).cast("string"))
    first = lambda c: F.min_by(c, F.col("page")).alias(c)
    df = pages.withColumn("description", profile.description()).withColumn("d", F.col("description"))
    df = df.groupBy(*by).agg(
        F.count("*").alias("n_pages"), *(first(c) for c in ("shaped", "dtype", "d", "physical_size_x", "physical_size_y")),
        S.in_order(F.coalesce(profile.page_name(), F.lit("")), F.col("page")).alias("names"),
    )
    channels, (px, py), (size_x, size_y) = profile.channels(), profile.physical_sizes(), profile.sizes()
    plain = F.transform(channels, lambda c: c["Name"])
    if rename:
        mapping = F.create_map(*(F.lit(x) for pair in rename.items() for x in pair))
        channels = F.transform(channels, lambda c: c.withField("Name", S.renamed(c["Name"], mapping)))
    fixed = {
        "image_id": "Image:0", "big_endian": "true", "dimension_order": "XYZCT", "pixel_id": "Pixels:0",
        "interleaved": "false", "physical_size_x_unit": "µm", "physical_size_y_unit": "µm",
    }
    return df.select(
        *by, F.lit(profile.image_name).alias("name"), F.lit(profile.label).alias("input_type"),
        *(F.lit(v).alias(k) for k, v in fixed.items()), px.alias("physical_size_x"), py.alias("physical_size_y"),
        F.lit(significant_bits).alias("significant_bits"), profile.size_c().alias("size_c"), profile.size_c().alias("plane_count"),
        F.get("shaped", 0).alias("size_t"), F.get("shaped", 1).alias("size_z"), size_y.alias("size_y"), size_x.alias("size_x"),
        ome_type(F.col("dtype")).alias("type"), channels.alias("channels"), plain.alias("found_names"),
    )


def image_features(
    pages: DataFrame, profile: Profile, series: int = 0, physical_size_x: str | None = None,
    physical_size_y: str | None = None, rename: dict[str, str] | None = None, significant_bits: int = 8,
) -> DataFrame:
    """``features_of`` one series, with physical sizes from the caller."""
    checked_sizes(profile, physical_size_x, physical_size_y)
    top = pages.where((F.col("series") == series) & (F.col("level") == 0))
    given = {"physical_size_x": physical_size_x, "physical_size_y": physical_size_y}
    top = top.withColumns({k: F.lit(None if v is None else str(v)).cast("string") for k, v in given.items()})
    return features_of(top, profile, rename, significant_bits)


def annotated(
    features: DataFrame, documents: DataFrame, by: tuple[str, ...] = ("path", "series"), xml_col: str = "xml",
    find: Callable[[Column], Column] = first_map_annotation,
) -> DataFrame:
    """Features with a column ``annotation``, the one that ``find`` gives of an image's document.

    Images without a document, or with one that has no annotation, stay with a null. Of
    repeated documents of an image the least text counts, so that no image is repeated; a
    null key meets none. Only keys and annotations are joined, not the documents.
    """
    own = documents.groupBy(*by).agg(F.min(xml_col).alias(xml_col))
    return features.drop("annotation").join(own.select(*by, find(F.col(xml_col)).alias("annotation")), [*by], "left")
