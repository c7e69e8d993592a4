"""Dictionary encoding: terms to ids and back.

Three sequences number terms without holes: vertices upwards from 1, predicates upwards from a start that leaves
room for reserved ids, and terms that occur only as classes (objects of rdf:type) downwards from -1. A term that is
both predicate and vertex has an entry of each role. Ids follow the order of the terms' SHA-1 digests, so they don't
depend on how the data are partitioned; they are given by range partitions and prefix sums of their sizes, never by
one task.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.terms import RDF_TYPE, digest, kind
from .layout import star_rows
from .shared import materialize

#: Reserved predicate ids: rdf:type is 2, others begin with 10.
TYPE_ID, FIRST_PREDICATE = 2, 10


def extract_terms(triples: DataFrame) -> DataFrame:
    """term, role (vertex or predicate), flag (-1: object of rdf:type, else 1), once for each occurrence."""
    flag = F.when(F.col("p") == RDF_TYPE, -1).otherwise(1)
    uses = F.array(F.struct(F.col("s").alias("term"), F.lit("vertex").alias("role"), F.lit(1).alias("flag")), F.struct(F.col("p").alias("term"), F.lit("predicate").alias("role"), F.lit(1).alias("flag")), F.struct(F.col("o").alias("term"), F.lit("vertex").alias("role"), flag.alias("flag")))
    return triples.select(F.explode(uses).alias("x")).select("x.*")


def unique_terms(triples: DataFrame) -> DataFrame:
    """Each term and role once; flag 1 if any of its uses has it. Counted on the map side first."""
    return extract_terms(triples).groupBy("term", "role").agg(F.max("flag").alias("flag")).withColumn("digest", digest(F.col("term"))).withColumn("kind", kind(F.col("term")))


def dense_ids(df: DataFrame, order: list[str], name: str, start: int = 1, step: int = 1) -> DataFrame:
    """df with consecutive ids in the given order: range partitions, each offset by the sizes of those before it."""
    return _numbered(df, [], order, name, F.lit(start), F.lit(step))


def _numbered(df: DataFrame, sequence: list[str], order: list[str], name: str, start: Column, step: Column) -> DataFrame:
    """df with the ids of each sequence in the given order, by one range shuffle for all of them. A task writes one sorted
    file, in which a row's place is known without another shuffle."""
    ranged = df.repartitionByRange(*sequence, *order).sortWithinPartitions(*sequence, *order).withColumn("_part", F.spark_partition_id())
    ranged = materialize(ranged, maxRecordsPerFile=0).withColumn("_row", F.col("_metadata.row_index"))
    sizes = ranged.groupBy("_part", *sequence).agg(F.count("*").alias("count"), F.min("_row").alias("first"))  # a row for each part and sequence
    before = sizes.select("_part", *sequence, (F.sum("count").over(Window.partitionBy(*sequence).orderBy("_part")) - F.col("count") - F.col("first")).alias("_before"))
    out = ranged.join(F.broadcast(before), ["_part", *sequence]).withColumn(name, (start + (F.col("_before") + F.col("_row")) * step).cast("long"))
    return out.select(*df.columns, name)


def build_dictionary(triples: DataFrame, reserved: bool = True) -> DataFrame:
    """term, role, flag, digest, kind, id."""
    terms = unique_terms(triples)
    first = FIRST_PREDICATE if reserved else 1
    kept = (F.col("role") == "predicate") & (F.col("term") == RDF_TYPE) & F.lit(reserved)
    # 0: vertices, 1: classes, 2: predicates, 3: reserved ids
    sequence = F.when(kept, 3).when(F.col("role") == "predicate", 2).when(F.col("flag") == 1, 0).otherwise(1)
    of = F.col("_sequence")
    start = F.when(of == 3, TYPE_ID).when(of == 2, first).when(of == 0, 1).otherwise(-1)
    out = _numbered(terms.withColumn("_sequence", sequence), ["_sequence"], ["digest"], "id", start, F.when(of == 1, -1).otherwise(1))
    return out.drop("_sequence")


#: Hex digits of a digest that a stored dictionary keeps, and bits of it that part the terms when ids are given.
PREFIX, RANGES = 15, 12


def prefix(digest: Column) -> Column:
    """A digest's first 60 bits as a long, in the digests' order."""
    return F.conv(F.substring(digest, 1, PREFIX), 16, 10).cast("long")


def shared_ids(triples: DataFrame) -> DataFrame:
    """term, prefix, kind, id: one id for a term whatever its role, so that predicates join with vertices. A file's rows are in
    the order of their digests.

    Ranges of digests are counted and numbered within; digests are even, so the ranges are. Only terms are shuffled.
    """
    parts = int(triples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = triples.select("s").distinct().union(triples.select(F.col("o"))).union(triples.select("p").distinct())
    terms = ends.toDF("term").distinct().withColumn("_range", F.shiftright(prefix(digest(F.col("term"))), 4 * PREFIX - RANGES).cast("int"))
    sizes = terms.groupBy("_range").agg(F.count("*").alias("_count"))
    before = sizes.select("_range", (F.sum("_count").over(Window.orderBy("_range")) - F.col("_count")).alias("_before"))  # a row a range
    ranged = terms.repartition(parts, "_range").withColumn("_digest", digest(F.col("term")))
    place = F.row_number().over(Window.partitionBy("_range").orderBy("_digest"))
    # a null-safe comparison: a filter on one side would make the distinct terms two shuffles
    out = ranged.withColumn("_place", place).join(F.broadcast(before.withColumnRenamed("_range", "_of")), F.col("_range").eqNullSafe(F.col("_of")))
    return out.select("term", prefix(F.col("_digest")).alias("prefix"), kind(F.col("term")).alias("kind"), (F.col("_before") + F.col("_place")).cast("long").alias("id"))


def encode_ends(triples: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Triples with s and o as ids of a shared dictionary, other columns as they are."""
    ids = dictionary.select(F.col("term").alias("_term"), F.col("id").alias("_id"))
    for c in ("s", "o"):
        triples = triples.join(ids, F.col(c) == F.col("_term")).select(*[F.col("_id").alias(c) if x == c else F.col(x) for x in triples.columns])
    return triples


def encode(triples: DataFrame, dictionary: DataFrame) -> DataFrame:
    """s, p, o as ids. Triples with terms that the dictionary lacks are left out; see missing_terms."""

    def ids(role: str, column: str) -> DataFrame:
        own = dictionary.where(F.col("role") == role) if "role" in dictionary.columns else dictionary
        return own.select(F.col("term").alias(column), F.col("id").alias(f"_{column}"))

    out = triples.join(ids("predicate", "p"), "p").join(ids("vertex", "s"), "s").join(ids("vertex", "o"), "o")
    return out.select(F.col("_s").alias("s"), F.col("_p").alias("p"), F.col("_o").alias("o"))


def decode(encoded: DataFrame, dictionary: DataFrame) -> DataFrame:
    """s, p, o as terms again."""

    def terms(role: str, column: str) -> DataFrame:
        own = dictionary.where(F.col("role") == role) if "role" in dictionary.columns else dictionary
        return own.select(F.col("id").alias(column), F.col("term").alias(f"_{column}"))

    out = encoded.join(terms("predicate", "p"), "p").join(terms("vertex", "s"), "s").join(terms("vertex", "o"), "o")
    return out.select(F.col("_s").alias("s"), F.col("_p").alias("p"), F.col("_o").alias("o"))


def encode_stars(triples: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Star rows (s, predobj) of ids, straight from triples of terms."""
    return star_rows(encode(triples, dictionary))


def missing_terms(triples: DataFrame, dictionary: DataFrame) -> DataFrame:
    """term, role of what triples use and the dictionary lacks."""
    used = extract_terms(triples).select("term", "role").distinct()
    return used.join(dictionary.select("term", "role"), ["term", "role"], "left_anti")


def look_up(dictionary: DataFrame, terms: list[str]) -> dict[str, int]:
    """Ids of a query's constants (few), in one job; absent ones are left out.

    The stored dictionary's files are sorted by digest, so the filter on its prefix skips all pages but a few.
    """
    wanted = list(dict.fromkeys(terms))
    if not wanted:
        return {}
    digests = [hashlib.sha1(t.encode()).hexdigest() for t in wanted]
    found = F.col("prefix").isin([int(d[:PREFIX], 16) for d in digests]) if "prefix" in dictionary.columns else F.col("digest").isin(digests)
    return {r["term"]: r["id"] for r in dictionary.where(found & F.col("term").isin(wanted)).select("term", "id").collect()}


def copy_dictionary(spark: SparkSession, source: str, target: str) -> DataFrame:
    """A stored dictionary written to another store, rows and ids in the order that its files have; the copy."""
    spark.read.parquet(source).write.parquet(target, compression="zstd")
    return spark.read.parquet(target)


def class_only_terms(dictionary: DataFrame) -> DataFrame:
    """How many vertices occur only as classes."""
    return dictionary.where("role = 'vertex' AND flag = -1").agg(F.count("*").alias("class_terms"))
