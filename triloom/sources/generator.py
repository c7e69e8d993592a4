"""Synthetic triples: 80 % random, 20 % in stars of ten, with predicates numbering 5 % of all triples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def synthetic_triples(spark: SparkSession, n: int, seed: int = 0, base: str = "http://synthetic.local/") -> DataFrame:
    """n triples that depend on n and seed alone, however they are partitioned."""
    predicates, randoms = max(1, n // 20), n * 8 // 10

    def pick(name: str, size: int):
        return F.pmod(F.xxhash64("id", F.lit(name), F.lit(seed)), F.lit(size))

    def term(prefix: str, number):
        return F.concat(F.lit(f"<{base}{prefix}"), number.cast("string"), F.lit(">"))

    star = F.floor((F.col("id") - randoms) / 10)
    subject = F.when(F.col("id") < randoms, term("s", pick("s", max(1, n)))).otherwise(term("star", star))
    return spark.range(n).select(subject.alias("s"), term("p", pick("p", predicates)).alias("p"), term("o", pick("o", max(1, n))).alias("o"))
