"""Column functions of the conversion: names, times, ratios, checksums, maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: What a schema's location begins with if it is to be downloaded.
REMOTE = "^(https://|http:)"


def is_remote(location: Column) -> Column:
    return location.rlike(REMOTE)


def number_list(numbers: Column) -> Column:
    """Whole numbers with commas, as the pixel source's options and the command line take them."""
    return F.array_join(F.transform(numbers, lambda n: n.cast("string")), ",")


def renamed(name: Column, mapping: Column) -> Column:
    """The mapped name where there is one, null targets included, else the name itself."""
    return F.when(F.coalesce(F.map_contains_key(mapping, name), F.lit(False)), mapping[name]).otherwise(name)


def rename_map(text: Column) -> Column:
    """A JSON object of strings; of repeated keys the last counts."""
    return F.from_json(text, "map<string,string>")


def run_time(seconds: Column) -> Column:
    """HH:MM:SS.ss; hours are unbounded and seconds may round up to 60.00."""
    hours = F.floor(seconds / 3600).cast("bigint")
    minutes = F.floor((seconds % 3600) / 60).cast("bigint")
    return F.format_string("%02d:%02d:%05.2f", hours, minutes, seconds % 60)


def readable_time(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss")


def size_ratio(output: Column, source: Column) -> Column:
    """Output by input; null for an empty input."""
    return F.try_divide(output.cast("double"), source.cast("double"))


def tool_version(text: Column) -> Column:
    """The token after 'Version = ', or null."""
    return F.nullif(F.regexp_extract(F.trim(text), r"Version = (\S+)", 1), F.lit(""))


def last_wins(names: Column, values: Column) -> Column:
    """A map of paired arrays in which later pairs replace earlier ones, whatever the session's policy."""
    at = F.sequence(F.lit(0), F.size(names) - 1)
    last = F.filter(at, lambda i: ~F.exists(at, lambda j: (j > i) & (F.get(names, j) == F.get(names, i))))
    pairs = F.transform(last, lambda i: F.struct(F.get(names, i), F.get(values, i)))
    return F.when(F.size(names) == 0, F.create_map().cast("map<string,string>")).otherwise(F.map_from_entries(pairs))


def in_order(value: Column, ordinal: Column) -> Column:
    """Aggregate: values as an array by rising ordinal."""
    pairs = F.array_sort(F.collect_list(F.struct(ordinal.alias("i"), value.alias("v"))))
    return F.transform(pairs, lambda x: x["v"])


def argument_list(*arguments: Column) -> Column:
    """Arguments that are not null, in order."""
    return F.filter(F.array(*arguments), lambda x: x.isNotNull())
