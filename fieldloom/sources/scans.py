"""Scan sources and table sinks: Parquet or JSON, as a batch or a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import SCAN


def read_scans(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Scans with a fixed schema; nothing is inferred."""
    return spark.read.schema(SCAN).format(fmt).load(path)


def stream_scans(spark: SparkSession, path: str, fmt: str = "parquet", files_per_trigger: int = 16) -> DataFrame:
    """The same files as an unbounded stream of micro-batches."""
    return spark.readStream.schema(SCAN).format(fmt).option("maxFilesPerTrigger", files_per_trigger).load(path)


def first_scans(scans: DataFrame, n: int) -> DataFrame:
    """The first n scans of the sequence: by number, not by whichever rows come first."""
    return scans.where(F.col("scan_id") < n)
