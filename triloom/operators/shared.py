"""Tables in a folder that all executors share, to cut the lineage of iterative operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir. Where the session names none, a temporary one, but in local
    mode only: on a cluster other executors would not see it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="triloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{spark.conf.get('spark.app.id', 'triloom')}"


def materialize(df: DataFrame, **options) -> DataFrame:
    """Write df below the shared folder and read it back."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def clustered(df: DataFrame, column: str) -> Iterator[DataFrame]:
    """df, each row once, in the shared folder as a table in buckets of a column: what groups by it or joins on it needs no
    shuffle. The table is gone afterwards.

    Equal rows meet in the shuffle to the buckets, so none is held in a map before it, which large inputs would spill.
    """
    spark = df.sparkSession
    name, parts = f"triloom_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{shared_dir(spark)}/{name}"
    df.repartition(parts, column).distinct().write.bucketBy(parts, column).sortBy(column).options(path=path, compression="zstd").saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")
        delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def release(spark: SparkSession) -> None:
    """Delete all that this application's operators have written to the shared folder; results that read it are lost."""
    delete(spark, shared_dir(spark))
