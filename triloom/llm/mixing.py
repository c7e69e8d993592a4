"""Mixing sources to target weights, with DataFrame functions only.

Words are aggregated per source, sources get targets by water-filling, and each document is taken
floor(rate) times plus once more when its seeded hash falls below the rate's fraction.

Null text counts as no words; a null source is a source of its own, last in order; documents without
words are never taken more than ``cap`` times and count nothing; repeated rows and equal ids get equal
decisions (the hash sees the id); a null id is an id of its own; an empty table gives an empty result.
Extra columns may have any name: they travel as one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, as_row, materialize, whole_text

#: Up to so many sources their targets are broadcast (about 60 bytes each); beyond, Spark joins by key.
BROADCAST_SOURCES = 50_000


def word_count(column: str = "text") -> Column:
    return F.regexp_count(whole_text(column), F.lit(WORD)).cast("long")


def source_targets(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, size: Column | None = None) -> DataFrame:
    """One row per source: source, source_size, weight, target.

    Sources by code point (null last) get the weights in turn. The targets are the fixed point of
    sharing by weight, stopping each source at cap times its size and sharing the excess again: with
    sources ordered by cap per weight, those that stop form a prefix, so running sums find it.
    """
    sums = docs.groupBy(F.col("source").alias("source")).agg(F.coalesce(F.sum(word_count() if size is None else size), F.lit(0)).alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    sums = sums.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    line = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after, everything = line.rowsBetween(Window.unboundedPreceding, -1), line.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy(F.lit(0))
    level = (F.lit(share) * F.sum("source_size").over(everything) - F.lit(cap) * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(after)
    sums = sums.withColumn("_level", level).withColumn("_full", F.col("source_size") * F.lit(cap) <= F.col("_level") * F.col("weight"))
    sums = sums.withColumn("_at", F.max(F.when(~F.col("_full"), F.col("_level"))).over(everything))
    return sums.select("source", "source_size", "weight", F.when(F.col("_full"), F.col("source_size") * F.lit(cap)).otherwise(F.col("_at") * F.col("weight")).alias("target"))


def with_copies(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: str = "mix") -> DataFrame:
    """row (all of docs' columns), doc_id, size, source_size, target and copies (how often each row is taken)."""
    sized = docs.select(as_row(docs).alias("row"), F.col("doc_id").alias("doc_id"), F.col("source").alias("source"), word_count().alias("size"))
    targets = materialize(source_targets(docs, weights, share, cap)).select(F.col("source").alias("of"), "source_size", "target")
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    rate = F.least(F.lit(cap), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0)))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    chance = F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    out = sized.join(targets, F.col("source").eqNullSafe(F.col("of")), "left")
    return out.withColumn("copies", (F.floor(rate) + (chance < rate - F.floor(rate)).cast("int")).cast("int"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: docs' own columns, each row as often as it is taken."""
    taken = with_copies(docs, **options).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return taken.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words the mix takes of it)."""
    return with_copies(docs.select("doc_id", "text", "source"), **options).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


#: DuckDB SQL for mix_report over a relation named by {docs}.
SQL = """
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM {docs}),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM sums),
lined AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
    - 2.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
levels AS (SELECT *, source_size * 2.0::DOUBLE <= level * weight AS full_up FROM lined),
targets AS (SELECT source, source_size, CASE WHEN full_up THEN source_size * 2.0::DOUBLE ELSE weight * max(CASE WHEN NOT full_up THEN level END) OVER () END AS target FROM levels),
rated AS (SELECT s.doc_id, s.size, t.source_size, t.target, least(2.0::DOUBLE, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 1.0::DOUBLE END) AS rate
    FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN CAST(concat('0x', substr(md5('mix:' || doc_id), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rated
"""
