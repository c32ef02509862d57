"""Reading vendor XML and rendering OME-XML with column functions.

Only the columns named here reach the document: a whitelist, which is what keeps
identifying fields out. Vendor labels, scanner settings and annotations have no
place in it.
"""

from __future__ import annotations

import io
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the OME format.
OME_NAMESPACE = "http://www.openmicroscopy.org/Schemas/OME/2016-06"
OME_SCHEMA = "http://www.openmicroscopy.org/Schemas/OME/2016-06/ome.xsd"
XSI = "http://www.w3.org/2001/XMLSchema-instance"
PYRAMID_NAMESPACE = "openmicroscopy.org/PyramidResolution"

_S = T.StringType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


#: ImageDescription of one page, first dialect. Numbers stay text, so that 0.49610 keeps its last digit.
SCANNER_XML = _struct(Name=_S, ScanProfile=_struct(root=_struct(ScanResolution=_struct(PixelSizeMicrons=_S))))
#: ImageDescription of the first page, second dialect: an OME document.
CHANNEL_XML = _struct(_ID=_S, _Name=_S, _SamplesPerPixel=T.IntegerType(), _Color=_S)
EMBEDDED_XML = _struct(
    Image=_struct(
        Pixels=_struct(_PhysicalSizeX=_S, _PhysicalSizeY=_S, _SizeX=_S, _SizeY=_S, Channel=T.ArrayType(CHANNEL_XML))
    )
)
MAP_XML = _struct(
    StructuredAnnotations=_struct(
        MapAnnotation=T.ArrayType(_struct(_ID=_S, _Namespace=_S, Value=_struct(M=T.ArrayType(_struct(_K=_S, _VALUE=_S)))))
    )
)


def parsed(xml: Column, schema: T.StructType, strict: bool = True) -> Column:
    """XML as a struct; malformed text raises, or gives nulls if not strict."""
    return F.from_xml(xml, schema.simpleString(), {"mode": "FAILFAST" if strict else "PERMISSIVE"})


def first_annotation(xml: Column) -> Column:
    """The first MapAnnotation of an OME document, or null."""
    return F.get(parsed(xml, MAP_XML, strict=False)["StructuredAnnotations"]["MapAnnotation"], 0)


FOUND = "array<struct<path:string,attributes:map<string,string>,texts:array<struct<path:string,key:string,value:string>>>>"


def found_elements(xml: str, name: str, namespace: str | None, most: int | None) -> list[dict]:
    """Elements of a name, wherever they stand and whatever prefix they have, in the order in which
    they begin; of none within another one of them. Read as events, with the names above."""
    above: list[str] = []
    out: list[dict] = []
    inside = 0  # how deep within an element that was found
    wanted = name if namespace is None else f"{{{namespace}}}{name}"
    plain = lambda tag: tag.rpartition("}")[2]
    for event, node in ElementTree.iterparse(io.BytesIO(xml.encode()), ["start", "end"]):
        if event == "start":
            above.append(plain(node.tag))
            if inside:
                inside += 1
            elif (plain(node.tag) if namespace is None else node.tag) == wanted:
                inside = 1
                out.append({"path": "/" + "/".join(above), "attributes": {plain(k): v for k, v in node.attrib.items()}, "texts": []})
            continue
        if inside:
            if node.text and node.text.strip():
                place = "/".join(above[len(above) - inside + 1 :])
                out[-1]["texts"].append({"path": place, "key": node.get("K"), "value": node.text.strip()})
            inside -= 1
            if not inside and len(out) == most:
                break
        else:
            node.clear()  # what lies behind is needed no more
        above.pop()
    return out


def descendants(xml: Column, name: str, namespace: str | None = OME_NAMESPACE, most: int | None = None) -> Column:
    """path, attributes, and texts (path, K and value) of the elements of a name anywhere in a document,
    the first ``most``; in any namespace if that is None. Null for null and malformed documents."""

    @F.pandas_udf(FOUND)
    def find(texts: pd.Series) -> pd.Series:
        def one(text):
            try:
                return None if text is None else found_elements(text, name, namespace, most)
            except ElementTree.ParseError:
                return None

        return texts.map(one)

    return find(xml)


def first_map_annotation(xml: Column) -> Column:
    """The first MapAnnotation of a document, anywhere in its tree, or null."""
    return F.get(descendants(xml, "MapAnnotation", most=1), 0)


def escaped(value: Column) -> Column:
    """Text for an XML attribute or element."""
    out = value.cast("string")
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(name))
    return out


def element(tag: str, attributes: dict[str, Column], inner: Column | None = None) -> Column:
    """<tag a="..">inner</tag>; attributes that are null are left out."""
    parts = [F.lit(f"<{tag}")]
    for name, value in attributes.items():
        parts.append(F.coalesce(F.concat(F.lit(f' {name}="'), escaped(value), F.lit('"')), F.lit("")))
    parts += [F.lit("/>")] if inner is None else [F.lit(">"), inner, F.lit(f"</{tag}>")]
    return F.concat(*parts)


def pyramid_annotation(sizes: Column) -> Column:
    """A MapAnnotation with 'width height' of every reduced level, or '' for none."""
    each = F.transform(sizes, lambda s, i: F.concat(F.lit('<M K="'), (i + 1).cast("string"), F.lit('">'), s, F.lit("</M>")))
    head = f'<MapAnnotation ID="Annotation:Resolution:0" Namespace="{PYRAMID_NAMESPACE}"><Value>'
    full = F.concat(F.lit(head), F.array_join(each, ""), F.lit("</Value></MapAnnotation>"))
    return F.when(F.coalesce(F.size(sizes), F.lit(0)) > 0, full).otherwise(F.lit(""))


def ome_document(f: Column | None = None, uuid: Column | None = None, level_sizes: Column | None = None) -> Column:
    """The document of an ``image_features`` row (columns by name, or of struct f)."""
    get = (lambda name: f[name]) if f is not None else F.col
    channel = lambda c: element(
        "Channel", {"ID": c["ID"], "Name": c["Name"], "SamplesPerPixel": c["SamplesPerPixel"]}, F.lit("<LightPath/>")
    )
    pixels = element(
        "Pixels",
        {
            "BigEndian": get("big_endian"), "DimensionOrder": get("dimension_order"), "ID": get("pixel_id"),
            "Interleaved": get("interleaved"), "PhysicalSizeX": get("physical_size_x"),
            "PhysicalSizeXUnit": get("physical_size_x_unit"), "PhysicalSizeY": get("physical_size_y"),
            "PhysicalSizeYUnit": get("physical_size_y_unit"), "SignificantBits": get("significant_bits"),
            "SizeC": get("size_c"), "SizeT": get("size_t"), "SizeX": get("size_x"), "SizeY": get("size_y"),
            "SizeZ": get("size_z"), "Type": get("type"),
        },
        F.concat(
            F.array_join(F.transform(get("channels"), channel), ""),
            element("TiffData", {"IFD": F.lit("0"), "PlaneCount": get("plane_count")}),
        ),
    )
    image = element("Image", {"ID": get("image_id"), "Name": get("name")}, pixels)
    head = f'<OME xmlns="{OME_NAMESPACE}" xmlns:xsi="{XSI}" xsi:schemaLocation="{OME_NAMESPACE} {OME_SCHEMA}"'
    uuid = F.lit(None).cast("string") if uuid is None else uuid
    mark = F.coalesce(F.concat(F.lit(' UUID="urn:uuid:'), uuid, F.lit('"')), F.lit(""))
    notes = pyramid_annotation(level_sizes) if level_sizes is not None else F.lit("")
    return F.concat(
        F.lit("<?xml version='1.0' encoding='utf-8'?>\n" + head), mark, F.lit(">"), image,
        F.lit("<StructuredAnnotations>"), notes, F.lit("</StructuredAnnotations></OME>"),
    )


def merged_samples(features: dict[str, Column]) -> dict[str, Column]:
    """Features of an image whose three channels are stored as samples of one."""
    first = F.get(features["channels"], 0)
    one = F.array(first.withField("Name", F.lit("RGB")).withField("SamplesPerPixel", F.lit(3)))
    return features | {"channels": one, "interleaved": F.lit("true"), "plane_count": F.lit(1).cast("long")}


def schema_error(spark, xml: str, xsd_path: str) -> str | None:
    """Why a document does not satisfy a schema file, from the JVM's validator; null if it does."""
    from py4j.protocol import Py4JJavaError

    jvm = spark.sparkContext._jvm
    factory = jvm.javax.xml.validation.SchemaFactory.newInstance("http://www.w3.org/2001/XMLSchema")
    try:
        check = factory.newSchema(jvm.java.io.File(xsd_path)).newValidator()
        check.validate(jvm.javax.xml.transform.stream.StreamSource(jvm.java.io.StringReader(xml)))
    except Py4JJavaError as e:
        return e.java_exception.getMessage()
    return None


def pretty(xml: str) -> str:
    """The document with indents, for logs."""
    from xml.dom import minidom

    return minidom.parseString(xml.encode()).toprettyxml(indent="  ")


def schema_valid(xml: Column, xsd_path: str) -> Column:
    """Whether a document satisfies a schema file; false, never an error, if not."""
    checked = F.from_xml(xml, "_bad STRING", {"rowValidationXSDPath": xsd_path, "columnNameOfCorruptRecord": "_bad"})
    return F.coalesce(checked["_bad"].isNull(), F.lit(False))
