"""New files of a folder as a stream of detections: an addition to what batch scans do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import detected

FILE = "path string, modificationTime timestamp, length long, content binary"


def detections(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    files = spark.readStream.format("binaryFile").schema(FILE).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(folder)
    return detected(files)
