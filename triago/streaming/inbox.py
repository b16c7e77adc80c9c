"""The inbox as a stream: each content is processed once, over all runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from triago.operators.filing import fingerprint
from triago.sources.inbox import FILE, wanted_file

LINES = "value string"


def new_files(spark: SparkSession, folder: str, max_files: int = 10_000) -> DataFrame:
    """A stream of the files in a folder, each content once; what was seen is kept in the query's state."""
    files = spark.readStream.format("binaryFile").schema(FILE).option("maxFilesPerTrigger", max_files).load(folder)
    return files.where(wanted_file(F.col("path"))).withColumn("sha", fingerprint(F.col("content"))).dropDuplicates(["sha"])


def process_new(spark: SparkSession, folder: str, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Hands all new files to ``handle`` in batches and ends. A batch counts as done only after handle returns, so a
    failure repeats it."""
    return new_files(spark, folder).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def new_ocr_pages(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A stream of OCR pages from JSON files as they appear."""
    return spark.readStream.schema(schema).json(folder)
