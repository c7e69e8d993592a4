"""Streams of N-Triples files: the same parsing as for batches, new files as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.ntriples import parse_lines


def stream_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """Triples of the files that appear in a folder; repeated ones aren't removed (that would need endless state)."""
    return parse_lines(spark.readStream.text(path))[0]


def append_triples(triples: DataFrame, path: str, checkpoint: str):
    """A query that appends a stream's triples to a Parquet folder and ends when all present files are read."""
    return triples.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
