"""Encoded triples (ids) as delimited text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCHEMA = "s long, p long, o long"


def read_encoded(spark: SparkSession, path: str, literal_flag: bool = False) -> DataFrame:
    """Lines of s|p|o, or s|p|o|is_literal."""
    return spark.read.csv(path, sep="|", schema=_SCHEMA + ", is_literal boolean" * literal_flag)


def write_encoded(encoded: DataFrame, path: str) -> None:
    encoded.write.csv(path, sep="|")


def id_range(encoded: DataFrame, low: int, high: int) -> DataFrame:
    """Triples whose subject's id lies in low..high."""
    return encoded.where(F.col("s").between(low, high))
