"""Reasons of rejected documents, held against the JVM's validator."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.functions import omexml, xsd
from tessella.operators import profiles
from tessella.plans import catalogue

TYPES = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema" targetNamespace="urn:t" xmlns="urn:t" elementFormDefault="qualified">
<xs:simpleType name="Colour"><xs:restriction base="xs:string"><xs:enumeration value="red"/><xs:enumeration value="blue"/></xs:restriction></xs:simpleType>
<xs:simpleType name="Percent"><xs:restriction base="xs:integer"><xs:minInclusive value="0"/><xs:maxInclusive value="100"/></xs:restriction></xs:simpleType>
<xs:simpleType name="Code"><xs:restriction base="xs:string"><xs:pattern value="[A-Z]{2}[0-9]+"/></xs:restriction></xs:simpleType>
<xs:simpleType name="Either"><xs:union memberTypes="Percent Colour"/></xs:simpleType>
<xs:simpleType name="Many"><xs:list itemType="Percent"/></xs:simpleType>
<xs:attributeGroup name="Marked"><xs:attribute name="ID" type="Code" use="required"/><xs:attribute name="kind" type="Colour"/></xs:attributeGroup>
<xs:complexType name="Base"><xs:sequence><xs:element name="a" type="xs:int" minOccurs="0"/></xs:sequence><xs:attributeGroup ref="Marked"/></xs:complexType>
<xs:complexType name="More"><xs:complexContent><xs:extension base="Base"><xs:choice maxOccurs="unbounded"><xs:element name="b" type="Either"/>
<xs:element ref="c"/><xs:sequence><xs:element name="d" type="Many"/><xs:element name="e" type="xs:boolean"/></xs:sequence></xs:choice></xs:extension></xs:complexContent></xs:complexType>
<xs:element name="c"><xs:complexType><xs:simpleContent><xs:extension base="xs:double"><xs:attribute name="unit" type="xs:string" fixed="um"/></xs:extension></xs:simpleContent></xs:complexType></xs:element>
<xs:element name="root"><xs:complexType><xs:sequence><xs:element name="one" type="Base" maxOccurs="3"/><xs:element name="two" type="More" minOccurs="0"/>
<xs:element name="mix"><xs:complexType mixed="true"><xs:all><xs:element name="x" type="xs:date"/><xs:element name="y" type="xs:unsignedByte" minOccurs="0"/></xs:all></xs:complexType></xs:element>
<xs:any minOccurs="0" processContents="skip"/></xs:sequence></xs:complexType></xs:element></xs:schema>"""
GOOD = (
    '<root xmlns="urn:t"><one ID="AB1"><a>5</a></one><one ID="CD22" kind="red"/><two ID="XY3"><a>-1</a><b>70</b><c unit="um">1.5e3</c><b>blue</b>'
    "<d>1 2 100</d><e>true</e></two><mix>text <y>255</y><x>2024-02-28</x></mix><z><q/></z></root>"
)


def variants(n):
    rng = random.Random(8)
    swaps = [("AB1", "ab1"), ("<a>5</a>", "<a>5.0</a>"), ("<a>5</a>", "<a>99999999999</a>"), ("red", "green"), ("70", "101"), ("blue", "black"), ("um", "mm"), ("1.5e3", "x"),
             ("<d>1 2 100</d><e>true</e>", "<d>1 2 100</d>"), ("1 2 100", "1 2 200"), ("true", "yes"), ("255", "256"), ("2024-02-28", "28.2.2024"), ("<x>2024-02-28</x>", ""), ("<y>255</y>", ""),
             ("<y>255</y>", "<y>1</y><y>2</y>"), ("<z><q/></z>", ""), ("<z><q/></z>", "<z/><z/>"), (' ID="CD22"', ""), ("kind", "sort"), ('<one ID="CD22" kind="red"/>', '<one ID="A1"/>'),
             ('<one ID="CD22" kind="red"/>', '<one ID="AA1"/>' * 3), ("text ", ""), ("<a>-1</a>", "words"), ("urn:t", "urn:u"), ("<root", "<other"), ("</root>", ""), ("<b>70</b>", "<a>1</a>"),
             ("<one ID=\"AB1\"><a>5</a></one>", ""), ("<a>5</a>", " <a> 5 </a> "), ("<e>true</e>", "<e> 1 </e>"), ("<one ID=\"AB1\">", "<one ID=\"AB1\" more=\"1\">")]
    yield GOOD
    for a, b in swaps:
        yield GOOD.replace(a, b)
    for _ in range(n):
        out = GOOD
        for a, b in rng.sample(swaps, 2):
            out = out.replace(a, b)
        yield out


def test_verdicts_agree_with_the_jvm(spark, tmp_path):
    (tmp_path / "t.xsd").write_text(TYPES)
    schema, seen = xsd.Schema(TYPES), {True: 0, False: 0}
    for xml in variants(40):
        theirs = omexml.schema_error(spark, xml, str(tmp_path / "t.xsd"))
        mine = next(schema.faults(xml), None)
        assert (mine is None) == (theirs is None), (xml, mine, theirs)
        seen[mine is None] += 1
    assert min(seen.values()) > 5


def test_reasons_say_where():
    schema = xsd.Schema(TYPES)
    reason = lambda a, b: next(schema.faults(GOOD.replace(a, b)), None)
    assert reason("70", "101") == "/root/two/b: '101' is of no member type"
    assert reason(' ID="CD22"', "") == "/root/one: attribute 'ID' is missing"
    assert reason("<e>true</e>", "") == "/root/two: element 'e' is missing"
    assert reason("<b>70</b>", "<a>1</a>") == "/root/two: element 'a' is not expected, but b, c, d"
    assert reason("2024-02-28", "x") == "/root/mix/x: 'x' is no date"
    assert reason("</root>", "").startswith("not well-formed")
    many = list(schema.faults(GOOD.replace("70", "101").replace("red", "green")))
    assert [m.split(":")[0] for m in many] == ["/root/one", "/root/two/b"]


def test_schemas_that_need_more_are_refused():
    for part in ('<xs:element name="a" substitutionGroup="b"/>', '<xs:element name="a" type="xs:gMonth"/>',
                 '<xs:simpleType name="p"><xs:restriction base="xs:string"><xs:pattern value="\\i\\c*"/></xs:restriction></xs:simpleType>'):
        with pytest.raises(NotImplementedError):
            xsd.Schema(f'<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema">{part}</xs:schema>')


def test_reasons_of_many_documents(spark, tmp_path):
    (tmp_path / "o.xsd").write_text(catalogue.ORDER_XSD)
    got = catalogue.schema_reasons(spark, "/root/testdata/sf0.001").collect()
    assert {r.p_partkey % 6: (r.reason or "").split("'")[0] for r in got}[0] == "" and all((r.reason is None) == (r.p_partkey % 6 == 0) for r in got)
    docs = spark.createDataFrame([(x,) for x in ("<part key='1'><name/></part>", "<part/>", None, "<part", "")], "xml string")
    rows = docs.select("xml", xsd.schema_reason(F.col("xml"), catalogue.ORDER_XSD).alias("r")).collect()
    assert [r.r is None for r in rows] == [True, False, True, False, False]


def test_elements_anywhere(spark):
    ns = omexml.OME_NAMESPACE
    xml = (
        f'<p:OME xmlns:p="{ns}"><MapAnnotation xmlns="urn:x" ID="no"/><p:A><p:B><p:MapAnnotation ID="1"><p:Value><p:M K="a"> 5 </p:M><p:M K="b">6</p:M></p:Value>'
        f'<p:MapAnnotation ID="within"/></p:MapAnnotation></p:B></p:A><MapAnnotation xmlns="{ns}" ID="2"/></p:OME>'
    )
    found = omexml.found_elements(xml, "MapAnnotation", ns, None)
    assert [(f["path"], f["attributes"]["ID"]) for f in found] == [("/OME/A/B/MapAnnotation", "1"), ("/OME/MapAnnotation", "2")]
    assert [(x["path"], x["key"], x["value"]) for x in found[0]["texts"]] == [("Value/M", "a", "5"), ("Value/M", "b", "6")]
    assert len(omexml.found_elements(xml, "MapAnnotation", ns, 1)) == 1 and len(omexml.found_elements(xml, "MapAnnotation", None, None)) == 3
    rows = spark.createDataFrame([(xml,), (None,), ("<a",), ("<OME/>",)], "xml string").select(omexml.first_map_annotation(F.col("xml")).alias("a")).collect()
    assert rows[0].a.attributes == {"ID": "1"} and [r.a for r in rows[1:]] == [None] * 3


def test_features_with_annotations(spark):
    """One to one; images without a document or an annotation stay, repeated documents count once."""
    head = f'<o:OME xmlns:o="{omexml.OME_NAMESPACE}"><o:Image>'
    xml = [(p, s, f'{head}<o:MapAnnotation ID="{p}{s}"/></o:Image></o:OME>', 1) for p, s in (("a", 0), ("a", 1), ("d", 0))]
    xml += [xml[0], ("b", 0, f"{head}</o:Image></o:OME>", 2), ("c", 0, None, 3), (None, 0, xml[0][2], 4)]
    documents = spark.createDataFrame(xml, "path string, series int, xml string, annotation int")
    features = spark.createDataFrame([(p, s, "old") for p, s in (("a", 0), ("a", 1), ("b", 0), ("c", 0), ("e", 0), (None, 0))], "path string, series int, annotation string")
    rows = profiles.annotated(features, documents).collect()
    found = {(r.path, r.series): r.annotation and r.annotation.attributes["ID"] for r in rows}
    assert len(rows) == 6 and found == {("a", 0): "a0", ("a", 1): "a1", ("b", 0): None, ("c", 0): None, ("e", 0): None, (None, 0): None}
    assert profiles.annotated(features, documents.limit(0)).where("annotation IS NULL").count() == 6
    assert profiles.annotated(features.limit(0), documents).count() == 0
