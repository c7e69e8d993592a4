"""Layouts of triples: by predicate, and one row for each subject."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def star_rows(triples: DataFrame) -> DataFrame:
    """s and predobj, the array of its (p, o); input need not be clustered."""
    return triples.groupBy("s").agg(F.collect_list(F.struct("p", "o")).alias("predobj"))


def from_star(stars: DataFrame) -> DataFrame:
    """Triples of star rows."""
    return stars.select("s", F.explode("predobj").alias("x")).select("s", "x.p", "x.o")


#: Triples of a file of the layout by predicate.
PIECE = 1 << 20


def write_by_predicate(triples: DataFrame, path: str, predicates: DataFrame) -> None:
    """One folder for each predicate's number (p, pid, triples); within a file, rows in the order of s, for min-max pruning."""
    write_pieces(triples.join(pieces(predicates), "p"), path)


def pieces(predicates: DataFrame) -> DataFrame:
    """p, pid, _pieces: how many pieces a predicate's size asks for."""
    return predicates.select("p", "pid", F.greatest(F.ceil(F.col("triples") / PIECE), F.lit(1)).alias("_pieces"))


def write_pieces(triples: DataFrame, path: str) -> None:
    """s, o, pid, _pieces by predicate: rows are dealt by predicate and a hash of the subject."""
    spread = int(triples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = triples.select("s", "o", "pid", F.pmod(F.xxhash64("s"), F.col("_pieces")).cast("int").alias("_piece"))
    df = df.repartition(spread, "pid", "_piece").sortWithinPartitions("pid", "s")
    df.select("s", "o", "pid").write.partitionBy("pid").parquet(path, compression="zstd")


def number_predicates(triples: DataFrame) -> DataFrame:
    """p, triples, pid: how many triples each predicate has, and a stable number (31 bits of a hash are enough for folders;
    ties get ranks)."""
    p = triples.groupBy("p").agg(F.count("*").alias("triples")).withColumn("_h", F.shiftrightunsigned(F.xxhash64("p"), 34))
    tie = F.row_number().over(Window.partitionBy("_h").orderBy("p")) - 1
    return p.select("p", "triples", (F.col("_h") * 8 + tie).alias("pid"))


def write_partitioned_stars(triples: DataFrame, vertex_parts: DataFrame, path: str) -> None:
    """Star rows of each partition's own subjects, one folder for each partition."""
    own = triples.join(vertex_parts.withColumnRenamed("v", "s"), "s")
    own.groupBy("part", "s").agg(F.collect_list(F.struct("p", "o")).alias("predobj")).write.partitionBy("part").parquet(path)


def write_bucketed(triples: DataFrame, table: str, buckets: int) -> None:
    """A table whose joins on subjects need no shuffle."""
    triples.write.bucketBy(buckets, "s").sortBy("s").mode("overwrite").saveAsTable(table)


def read_stars(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def star_triple_count(stars: DataFrame) -> DataFrame:
    """All triples of star rows."""
    return stars.agg(F.coalesce(F.sum(F.size("predobj")), F.lit(0)).alias("triples"))


def star_matches(stars: DataFrame, needed: list[tuple[str | None, str | None]]) -> DataFrame:
    """Star rows that have, for each (p, o), some pair with that predicate and object (None: any)."""

    def has(p, o):
        def test(x):
            found = F.lit(True)
            for name, value in (("p", p), ("o", o)):
                if value is not None:
                    found = found & (x[name] == F.lit(value))
            return found

        return F.exists("predobj", test)

    out = stars
    for p, o in needed:
        out = out.where(has(p, o))
    return out


def match_count(stars: DataFrame, needed: list[tuple[str | None, str | None]]) -> DataFrame:
    """Pairs in the star rows that match: a count of documents' entries, not of bindings."""
    return star_matches(stars, needed).agg(F.coalesce(F.sum(F.size("predobj")), F.lit(0)).alias("results"))
