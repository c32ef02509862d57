"""Command line: tessella input output --type T, or tessella --manifest FILE."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from contextlib import nullcontext

from .operators.profiles import PROFILES
from .plans.convert import COMPRESSIONS, Converter, convert_images, report_of, report_text, versions
from .session import make_session


def series_of(text: str) -> int | list[int]:
    """One number, or several with commas."""
    found = [int(x) for x in text.split(",")]
    return found[0] if len(found) == 1 else found


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(
        prog="tessella", description="Convert vendor images to de-identified OME-TIFFs.", formatter_class=argparse.ArgumentDefaultsHelpFormatter
    )
    p.add_argument("input", nargs="?", help="vendor image")
    p.add_argument("output", nargs="?", help="OME-TIFF to write")
    p.add_argument("--type", choices=list(PROFILES), help="kind of the image")
    p.add_argument("--series", type=series_of, default=0, help="number of the series, or several with commas")
    p.add_argument("--rename_channels_json", help="file with a JSON object of new names by old")
    p.add_argument("--omit_uuid", action="store_true", help="leave the document without a UUID")
    p.add_argument("--output_json", help="file for the report, instead of standard output")
    p.add_argument("--cache_directory", help="folder for intermediate data, shared by all executors")
    p.add_argument("--compression", choices=COMPRESSIONS, default="LZW")
    p.add_argument("--quality", type=int, default=90, help="of JPEG tiles, 1 to 100")
    p.add_argument("--rgb", action="store_true", help="store three channels as samples of one")
    p.add_argument("--schema_location", help="file or URL of the OME schema")
    p.add_argument("--physical_size_x_um", help="width of a pixel in micrometres, for types that do not hold it")
    p.add_argument("--physical_size_y_um", help="height of a pixel in micrometres, for types that do not hold it")
    p.add_argument("--manifest", help="CSV or Parquet of path, output, image_type and, if need be, series and physical sizes")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("--version", action="store_true", help="print versions and end")
    return p


def main(arguments: list[str] | None = None) -> int:
    arguments = sys.argv[1:] if arguments is None else arguments
    if "--version" in arguments:
        print(json.dumps(versions(), indent=2))
        return 0
    p = parser()
    a = p.parse_args(arguments)
    if not a.manifest and not (a.input and a.output and a.type):
        p.error("give input, output and --type, or --manifest")
    logging.basicConfig(level=logging.INFO if a.verbose else logging.WARNING)
    if a.type == "component" and not a.manifest and (a.physical_size_x_um is None or a.physical_size_y_um is None):
        raise ValueError("component images need --physical_size_x_um and --physical_size_y_um")
    rename = {}
    if a.rename_channels_json:
        with open(a.rename_channels_json, encoding="utf-8") as file:
            rename = json.load(file)
    spark = make_session()
    spark.sparkContext.setLogLevel("INFO" if a.verbose else "WARN")
    if a.manifest:
        many = spark.read.parquet(a.manifest) if a.manifest.endswith(".parquet") else spark.read.option("header", True).csv(a.manifest)
        rows = convert_images(
            many, a.cache_directory, rename, not a.omit_uuid, compression=a.compression, rgb=a.rgb, quality=a.quality, schema_location=a.schema_location
        )
        report = (report_of(r.asDict(recursive=True)) for r in rows.orderBy("path", "series").toLocalIterator())
    else:
        one = Converter(spark, a.input, a.type, a.series, rename, a.physical_size_x_um, a.physical_size_y_um, a.cache_directory, a.schema_location)
        report = one.convert(a.output, display_uuid=not a.omit_uuid, compression=a.compression, rgb=a.rgb, quality=a.quality)
    with open(a.output_json, "w", encoding="utf-8") if a.output_json else nullcontext(sys.stdout) as out:
        if a.manifest:  # one at a time, as there may be many
            print("[", file=out)
            for n, one in enumerate(report):
                print("," * (n > 0), report_text(one), file=out)
            print("]", file=out)
        else:
            print(report_text(report), file=out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
