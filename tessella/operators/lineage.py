"""Which source columns stand behind a plan's output: what keeps other tags out can be seen before it runs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame


def tree(nodes: list[dict]) -> dict:
    """The first node of a list in preorder, with its children."""
    at = iter(nodes)

    def one() -> dict:
        node = next(at)
        return node | {"children": [one() for _ in range(node["num-children"])]}

    return one()


def kind(node: dict) -> str:
    return node["class"].rpartition(".")[2]


def leaves(schema, prefix: str = "") -> list[str]:
    """Dotted names of a schema's fields that are no structs, as JSON has it."""
    if isinstance(schema, dict) and schema.get("type") == "struct":
        return [x for f in schema["fields"] for x in leaves(f["type"], f"{prefix}.{f['name']}" if prefix else f["name"])]
    if isinstance(schema, dict) and schema.get("type") == "array":
        return leaves(schema["elementType"], prefix)
    return [prefix]


def behind(node: dict, known: dict[int, set[str]]) -> set[str]:
    """Sources of an expression. An entry of a map is its own source (tags.Artist), and so is what a
    schema takes from a text (tags.ImageDescription/Name)."""
    name = kind(node)
    if name == "AttributeReference":
        return known.get(node["exprId"]["id"], {node["name"]})
    if name in ("GetMapValue", "ElementAt") and kind(node["children"][1]) == "Literal":
        return {f"{s}.{node['children'][1]['value']}" for s in behind(node["children"][0], known)}
    below = set().union(*(behind(c, known) for c in node["children"]))
    if name == "XmlToStructs":
        return {f"{s}/{field}" for s in below for field in leaves(node["schema"])}
    return below


def sources_behind(df: DataFrame) -> dict[str, set[str]]:
    """Of every output column the source columns it is made of, from the analysed plan. What no
    projection or aggregate makes counts as a source of its own name."""
    known: dict[int, set[str]] = {}

    def visit(node: dict) -> None:
        for child in node["children"]:
            visit(child)
        for expression in map(tree, node.get("projectList") or node.get("aggregateExpressions") or []):
            if kind(expression) == "Alias":
                known[expression["exprId"]["id"]] = behind(expression["children"][0], known)

    top = tree(json.loads(df._jdf.queryExecution().analyzed().toJSON()))
    visit(top)
    made = top.get("projectList") or top.get("aggregateExpressions")
    if not made:
        raise ValueError("the plan ends with no projection")
    out = {}
    for expression in map(tree, made):
        out[expression["name"]] = known[expression["exprId"]["id"]] if kind(expression) == "Alias" else behind(expression, known)
    return out


def check_sources(df: DataFrame, allowed: set[str]) -> DataFrame:
    """df, or an error that names the columns made of anything else."""
    for column, found in sources_behind(df).items():
        if other := sorted(found - allowed):
            raise ValueError(f"{column} would be made of {', '.join(other)}, which may identify")
    return df
