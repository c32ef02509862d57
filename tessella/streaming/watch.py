"""A landing folder as a stream of image files, converted as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.convert import convert_images


def arriving_files(spark: SparkSession, folder: str, pattern: str = "*.tif*") -> DataFrame:
    """path, length and time of each new file; contents are not read."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).load(folder)
    return files.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "length", "modificationTime")


def convert_arriving(
    files: DataFrame, image_type: str, output_folder: str, checkpoint: str, reports: str, trigger: dict | None = None, **options,
) -> StreamingQuery:
    """Starts converting each batch of ``arriving_files`` as one job. Outputs are called like
    their inputs, with .ome.tif at the end; reports go to a folder a batch. ``trigger`` is
    Spark's: {"processingTime": "1 minute"} goes on as files arrive; without one, what is there
    is converted and the query ends. A batch that is
    repeated after a failure writes the same files again."""
    output = F.concat(F.lit(output_folder.rstrip("/") + "/"), F.regexp_extract("path", r"([^/]+?)(\.\w+)?$", 1), F.lit(".ome.tif"))

    def run(batch: DataFrame, number: int) -> None:
        manifest = batch.select("path", output.alias("output"), F.lit(image_type).alias("image_type"))
        if not manifest.isEmpty():
            rows = convert_images(manifest, **options)
            rows.write.mode("overwrite").parquet(f"{reports}/batch={number}")

    return files.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
