"""Segments of files as they arrive: the batch plan on a stream; it keeps no state, so it needs no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.catalog import Plugin
from ..plans.extract import extract
from ..sources.files import from_binary

#: The schema of the binary source.
BINARY = "path string, modificationTime timestamp, length bigint, content binary"


def stream_segments(spark: SparkSession, path: str, plugin: Plugin, max_files: int = 1000) -> DataFrame:
    """A streaming table of the segments of every file that appears below ``path``."""
    raw = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files).load(path)
    files = from_binary(raw)
    return extract(files, plugin)
