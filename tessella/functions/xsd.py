"""Why a document does not satisfy a schema, found where the document is.

A schema is compiled to content models, one a complex type, and documents are read as a
stream of events. A model is followed by its derivatives: what may come after a child is
what its model becomes by that child, until nothing is left that allows the next one. The
first place where a document leaves its schema is told with the path to it.

Read are elements, references, named and unnamed types, sequences, choices and all-groups with
bounds, wildcards, groups, attributes and their groups, extensions and restrictions, and
simple types with facets, lists and unions. Identity constraints (key, unique, keyref), the
substitution of elements and xsi:type are not: a schema that uses more than that is refused.
"""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

XS = "{http://www.w3.org/2001/XMLSchema}"
INSTANCE = "{http://www.w3.org/2001/XMLSchema-instance}"
#: The built-in simple types as patterns, and ranges of whole numbers.
NUMBER = r"[+-]?(\d+(\.\d*)?|\.\d+)"
PATTERNS = {
    "boolean": "true|false|0|1", "decimal": NUMBER, "integer": r"[+-]?\d+", "float": rf"{NUMBER}([eE][+-]?\d+)?|-?INF|NaN",
    "double": rf"{NUMBER}([eE][+-]?\d+)?|-?INF|NaN", "dateTime": r"-?\d{4,}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)?",
    "date": r"-?\d{4,}-\d\d-\d\d(Z|[+-]\d\d:\d\d)?", "time": r"\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)?",
    "NMTOKEN": r"[\w.:-]+", "Name": r"[^\W\d][\w.:-]*", "NCName": r"[^\W\d][\w.-]*", "ID": r"[^\W\d][\w.-]*", "IDREF": r"[^\W\d][\w.-]*",
    "hexBinary": r"([0-9a-fA-F]{2})*", "language": r"[a-zA-Z]{1,8}(-[a-zA-Z0-9]{1,8})*",
}
RANGES = {
    "long": (-(2**63), 2**63 - 1), "int": (-(2**31), 2**31 - 1), "short": (-(2**15), 2**15 - 1), "byte": (-128, 127),
    "nonNegativeInteger": (0, None), "positiveInteger": (1, None), "nonPositiveInteger": (None, 0), "negativeInteger": (None, -1),
    "unsignedLong": (0, 2**64 - 1), "unsignedInt": (0, 2**32 - 1), "unsignedShort": (0, 2**16 - 1), "unsignedByte": (0, 255),
}
FREE = {"string", "normalizedString", "token", "anyURI", "anySimpleType", "anyType", "base64Binary", "QName", "duration"}
KEPT_SPACE = {"string", "normalizedString", "anySimpleType"}

# Content models: tuples, so that equal ones are equal.
NONE, EMPTY = ("none",), ("empty",)


def sequence(first: tuple, rest: tuple) -> tuple:
    if NONE in (first, rest):
        return NONE
    return rest if first == EMPTY else first if rest == EMPTY else ("then", first, rest)


def either(models: list[tuple]) -> tuple:
    found = list(dict.fromkeys(m for m in models if m != NONE))
    return NONE if not found else found[0] if len(found) == 1 else ("either", *found)


def repeated(model: tuple, least: int, most: int | None) -> tuple:
    if most == 0 or model == EMPTY:
        return EMPTY
    return model if (least, most) == (1, 1) else ("repeated", model, least, most)


def may_end(m: tuple) -> bool:
    kind = m[0]
    if kind == "then":
        return may_end(m[1]) and may_end(m[2])
    if kind == "either":
        return any(map(may_end, m[1:]))
    if kind == "repeated":
        return m[2] == 0 or may_end(m[1])
    return kind == "empty" or kind == "all" and all(map(may_end, m[1:]))


def after(m: tuple, name: str) -> tuple:
    """What the model becomes by a child."""
    kind = m[0]
    if kind == "child":
        return EMPTY if m[1] == name else NONE
    if kind == "any":
        return EMPTY
    if kind == "then":
        first = sequence(after(m[1], name), m[2])
        return either([first, after(m[2], name)]) if may_end(m[1]) else first
    if kind == "either":
        return either([after(x, name) for x in m[1:]])
    if kind == "repeated":
        return sequence(after(m[1], name), repeated(m[1], max(0, m[2] - 1), None if m[3] is None else m[3] - 1))
    if kind == "all":
        for i, x in enumerate(m[1:], 1):
            if (y := after(x, name)) != NONE:
                left = tuple(z for j, z in enumerate(m[1:], 1) if j != i)
                return sequence(y, ("all", *left)) if left else y
    return NONE


def expected(m: tuple) -> list[str]:
    """The children that may come next."""
    kind = m[0]
    if kind == "child":
        return [m[1]]
    if kind == "then":
        return expected(m[1]) + (expected(m[2]) if may_end(m[1]) else [])
    if kind == "repeated":
        return expected(m[1])
    return [n for x in m[1:] if kind in ("either", "all") for n in expected(x)]


@dataclass
class Simple:
    """A simple type: its fault, if any, for a text."""

    check: Callable[[str], str | None]
    keeps_space: bool = False

    def fault(self, text: str) -> str | None:
        return self.check(text if self.keeps_space else " ".join(text.split()))


@dataclass
class Complex:
    model: tuple = EMPTY
    children: dict[str, str | object] = field(default_factory=dict)  # name to type, or to its place in the schema
    attributes: dict[str, tuple[object, bool, str | None]] = field(default_factory=dict)  # type, required, fixed
    any_attribute: bool = False
    mixed: bool = False
    text: Simple | None = None
    open: bool = False  # anything goes


def local(name: str) -> str:
    return name.rpartition("}")[2]


class Schema:
    """A compiled schema of one file."""

    def __init__(self, text: str):
        self.root = ET.fromstring(text)
        self.target = self.root.get("targetNamespace", "")
        self.qualified = self.root.get("elementFormDefault") == "qualified"
        self.names = dict(node for _, node in ET.iterparse(io.StringIO(text), ["start-ns"]))
        self.top = {(local(x.tag), x.get("name")): x for x in self.root if isinstance(x.tag, str) and x.get("name")}
        for bad in ("include", "import", "redefine"):
            for x in self.root.iter(XS + bad):
                if x.get("schemaLocation"):
                    raise NotImplementedError(f"xs:{bad}")
        if any(x.get("substitutionGroup") for x in self.root.iter(XS + "element")):
            raise NotImplementedError("substitutionGroup")
        self.known: dict[object, Complex | Simple] = {}
        for (kind, _), x in self.top.items():  # all that is there is compiled, so that nothing fails later
            if kind in ("element", "complexType", "simpleType"):
                self.type_of(x) if kind != "element" else self.element_type(x)

    def element_name(self, node: ET.Element, top: bool) -> str:
        name, form = node.get("name"), node.get("form", "qualified" if self.qualified else "unqualified")
        return f"{{{self.target}}}{name}" if self.target and (top or form == "qualified") else name

    def element_type(self, node: ET.Element) -> Complex | Simple:
        if node.get("type"):
            return self.named_type(node.get("type"))
        inner = [x for x in node if x.tag in (XS + "complexType", XS + "simpleType")]
        return self.type_of(inner[0]) if inner else Complex(open=True)

    def named_type(self, name: str) -> Complex | Simple:
        prefix, _, own = name.rpartition(":")
        if self.names.get(prefix, "") == XS[1:-1]:
            return builtin(own)
        for kind in ("complexType", "simpleType"):
            if (kind, own) in self.top:
                return self.type_of(self.top[kind, own])
        raise NotImplementedError(f"type {name}")

    def type_of(self, node: ET.Element) -> Complex | Simple:
        if node not in self.known:
            if node.tag == XS + "simpleType":
                self.known[node] = self.simple(node)
            else:
                self.known[node] = made = Complex()  # first, as types may hold themselves
                self.fill(made, node)
        return self.known[node]

    def simple(self, node: ET.Element) -> Simple:
        how = next(x for x in node if x.tag != XS + "annotation")
        inner = [self.simple(x) for x in how if x.tag == XS + "simpleType"]
        if how.tag == XS + "union":
            members = [self.named_type(n) for n in how.get("memberTypes", "").split()] + inner
            return Simple(lambda t: None if any(m.fault(t) is None for m in members) else f"'{t}' is of no member type")
        if how.tag == XS + "list":
            item = self.named_type(how.get("itemType")) if how.get("itemType") else inner[0]
            return Simple(lambda t: next((f for x in t.split() if (f := item.fault(x))), None))
        return self.restricted(self.named_type(how.get("base")) if how.get("base") else inner[0], how)

    def restricted(self, base: Simple, node: ET.Element) -> Simple:
        facets: dict[str, list[str]] = {}
        for x in node:
            if isinstance(x.tag, str) and x.get("value") is not None:
                facets.setdefault(local(x.tag), []).append(x.get("value"))
        for p in facets.get("pattern", []):
            if re.search(r"\\[icIC]|\\[pP]\{|-\[", p):
                raise NotImplementedError(f"pattern {p}")
        patterns = [re.compile(p) for p in facets.get("pattern", [])]
        bounds = {k: float(facets[k][0]) for k in ("minInclusive", "maxInclusive", "minExclusive", "maxExclusive") if k in facets}
        sizes = {k: int(facets[k][0]) for k in ("length", "minLength", "maxLength") if k in facets}

        def check(t: str) -> str | None:
            if fault := base.check(t):
                return fault
            if "enumeration" in facets and t not in facets["enumeration"]:
                return f"'{t}' is none of {', '.join(facets['enumeration'])}"
            if patterns and not any(p.fullmatch(t) for p in patterns):
                return f"'{t}' does not match {facets['pattern'][0]}"
            n = len(t)
            if sizes and not (sizes.get("minLength", sizes.get("length", 0)) <= n <= sizes.get("maxLength", sizes.get("length", n))):
                return f"'{t}' has {n} characters"
            if bounds:
                v = float(t.replace("INF", "inf"))
                if not (bounds.get("minInclusive", v) <= v <= bounds.get("maxInclusive", v)) or v <= bounds.get("minExclusive", v - 1) or v >= bounds.get("maxExclusive", v + 1):
                    return f"'{t}' is out of range"
            return None

        return Simple(check, base.keeps_space and facets.get("whiteSpace", ["preserve"])[0] == "preserve")

    def fill(self, made: Complex, node: ET.Element) -> None:
        made.mixed = made.mixed or node.get("mixed") == "true"
        for x in node:
            if x.tag in (XS + "simpleContent", XS + "complexContent"):
                made.mixed = made.mixed or x.get("mixed") == "true"
                how = next(y for y in x if y.tag in (XS + "extension", XS + "restriction"))
                base = self.named_type(how.get("base"))
                extends = how.tag == XS + "extension"
                if isinstance(base, Simple):
                    made.text = base
                elif not base.open:
                    made.text, made.attributes, made.any_attribute = base.text, dict(base.attributes), base.any_attribute
                    if extends:
                        made.model, made.children, made.mixed = base.model, dict(base.children), made.mixed or base.mixed
                if not extends and made.text:
                    made.text = self.restricted(made.text, how)
                self.fill(made, how)
            elif x.tag in (XS + "sequence", XS + "choice", XS + "all", XS + "group"):
                made.model = sequence(made.model, self.particle(x, made.children))
            elif x.tag == XS + "attribute":
                self.attribute(x, made)
            elif x.tag == XS + "attributeGroup" and x.get("ref"):
                self.fill(made, self.top["attributeGroup", x.get("ref").rpartition(":")[2]])
            elif x.tag == XS + "anyAttribute":
                made.any_attribute = True

    def attribute(self, node: ET.Element, made: Complex) -> None:
        if ref := node.get("ref"):
            prefix, _, own = ref.rpartition(":")
            if prefix == "xml":
                made.attributes[f"{{http://www.w3.org/XML/1998/namespace}}{own}"] = (builtin("string"), node.get("use") == "required", None)
                return
            declared, name = self.top["attribute", own], f"{{{self.target}}}{own}" if self.target else own
        else:
            declared, name = node, node.get("name")
        if node.get("use") == "prohibited":
            made.attributes.pop(name, None)
            return
        inner = [self.simple(x) for x in declared if x.tag == XS + "simpleType"]
        kind = self.named_type(declared.get("type")) if declared.get("type") else inner[0] if inner else builtin("string")
        made.attributes[name] = (kind, node.get("use") == "required", declared.get("fixed"))

    def particle(self, node: ET.Element, children: dict) -> tuple:
        most = node.get("maxOccurs", "1")
        least, most = int(node.get("minOccurs", "1")), None if most == "unbounded" else int(most)
        if node.tag == XS + "element":
            declared = self.top["element", node.get("ref").rpartition(":")[2]] if node.get("ref") else node
            name = self.element_name(declared, bool(node.get("ref")))
            children[name] = declared
            model = ("child", name)
        elif node.tag == XS + "any":
            model = ("any",)
        elif node.tag == XS + "group":
            inner = self.top["group", node.get("ref").rpartition(":")[2]] if node.get("ref") else node
            model = next(self.particle(x, children) for x in inner if x.tag in (XS + "sequence", XS + "choice", XS + "all"))
        else:
            parts = [self.particle(x, children) for x in node if x.tag in (XS + k for k in ("element", "any", "group", "sequence", "choice", "all"))]
            if node.tag == XS + "choice":
                model = either(parts) if parts else EMPTY
            elif node.tag == XS + "all":
                model = ("all", *parts) if parts else EMPTY
            else:
                model = EMPTY
                for part in reversed(parts):
                    model = sequence(part, model)
        return repeated(model, least, most)

    def faults(self, xml: str) -> Iterator[str]:
        """Where the document leaves the schema; of what follows not all is told."""
        frames: list[list] = []  # type, model left, texts, path
        try:
            for event, node in ET.iterparse(io.BytesIO(xml.encode()), ["start", "end"]):
                if event == "start":
                    kind = self.entered(frames, node.tag)
                    path = (frames[-1][3] if frames else "") + "/" + local(node.tag)
                    if isinstance(kind, str):
                        yield f"{frames[-1][3] if frames else '/'}: {kind}"
                        kind = Complex(open=True)
                    yield from (f"{path}: {f}" for f in attribute_faults(kind, node.attrib))
                    frames.append([kind, kind.model if isinstance(kind, Complex) else EMPTY, node, path])
                else:
                    kind, model, _, path = frames.pop()
                    text = (node.text or "") + "".join(x.tail or "" for x in node)
                    yield from (f"{path}: {f}" for f in content_faults(kind, model, text))
                    for x in list(node):
                        x.text = None
        except ET.ParseError as e:
            yield f"not well-formed: {e}"

    def entered(self, frames: list[list], tag: str) -> Complex | Simple | str:
        """The type of an element that begins, or why it may not."""
        if not frames:
            declared = self.top.get(("element", local(tag)))
            if declared is None or self.element_name(declared, True) != tag:
                return f"no element '{local(tag)}' is declared"
            return self.element_type(declared)
        kind, model, *_ = frames[-1]
        if isinstance(kind, Simple):
            return f"element '{local(tag)}' is not allowed in a text"
        if kind.open:
            return Complex(open=True)
        left = after(model, tag)
        if left == NONE:
            names = ", ".join(dict.fromkeys(map(local, expected(model))))
            kind_of = f", but {names}" if names else ""
            frames[-1][0] = Complex(open=True)  # what comes after a wrong child cannot be told
            return f"element '{local(tag)}' is not expected{kind_of}"
        frames[-1][1] = left
        declared = kind.children.get(tag)
        return Complex(open=True) if declared is None else self.element_type(declared)


def builtin(name: str) -> Simple | Complex:
    if name == "anyType":
        return Complex(open=True)
    if name in FREE:
        return Simple(lambda t: None, name in KEPT_SPACE)
    if name in RANGES:
        lo, hi = RANGES[name]
        whole = re.compile(PATTERNS["integer"])

        def check(t: str) -> str | None:
            fits = whole.fullmatch(t) and (lo is None or int(t) >= lo) and (hi is None or int(t) <= hi)
            return None if fits else f"'{t}' is no {name}"

        return Simple(check)
    if name in PATTERNS:
        pattern = re.compile(PATTERNS[name])
        return Simple(lambda t: None if pattern.fullmatch(t) else f"'{t}' is no {name}")
    raise NotImplementedError(f"type xs:{name}")


def attribute_faults(kind: Complex | Simple, found: dict[str, str]) -> Iterator[str]:
    given = {k: v for k, v in found.items() if not k.startswith(INSTANCE)}
    if isinstance(kind, Complex) and kind.open:
        return
    allowed = kind.attributes if isinstance(kind, Complex) else {}
    for name, value in given.items():
        if name in allowed:
            simple, _, fixed = allowed[name]
            if fault := simple.fault(value):
                yield f"attribute '{local(name)}': {fault}"
            elif fixed is not None and value != fixed:
                yield f"attribute '{local(name)}' is not '{fixed}'"
        elif not (isinstance(kind, Complex) and kind.any_attribute):
            yield f"attribute '{local(name)}' is not allowed"
    for name, (_, required, _) in allowed.items():
        if required and name not in given:
            yield f"attribute '{local(name)}' is missing"


def content_faults(kind: Complex | Simple, model: tuple, text: str) -> Iterator[str]:
    if isinstance(kind, Simple) or kind.text:
        simple = kind if isinstance(kind, Simple) else kind.text
        if fault := simple.fault(text):
            yield fault
    elif not kind.open:
        if not may_end(model):
            yield f"element '{local(expected(model)[0])}' is missing"
        if text.strip() and not kind.mixed:
            yield "text is not allowed"


def schema_reason(xml: Column, schema: str) -> Column:
    """The first fault of each document under a schema's text; null for none, and for null documents."""
    compiled = []

    @F.pandas_udf("string")
    def reasons(texts: pd.Series) -> pd.Series:
        if not compiled:
            compiled.append(Schema(schema))
        return texts.map(lambda t: None if t is None else next(compiled[0].faults(t), None))

    return reasons(xml)
