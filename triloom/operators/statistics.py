"""Statistics of a graph: predicates, degrees, and gaps in ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.terms import RDF_TYPE


def predicate_selectivity(triples: DataFrame) -> DataFrame:
    """p, subjects: how many subjects have each predicate. A predicate with most triples is counted by many tasks."""
    return triples.select("p", "s").distinct().groupBy("p").agg(F.count("*").alias("subjects"))


def distinct_predicates(triples: DataFrame) -> DataFrame:
    return triples.select("p").distinct()


def vertex_degrees(triples: DataFrame, type_term=RDF_TYPE) -> DataFrame:
    """v, degree of the vertices at either end of some rdf:type triple; each triple counts once for each end."""
    is_type = (F.col("p") == F.lit(type_term)).cast("int")
    ends = triples.select(F.explode(F.array("s", "o")).alias("v"), is_type.alias("t"))
    return ends.groupBy("v").agg(F.count("*").alias("degree"), F.max("t").alias("t")).where("t = 1").select("v", "degree")


def degree_statistics(degrees: DataFrame) -> DataFrame:
    """total_vertices, total_degree, average (rounded half up) and sigma, the rounded root mean square distance to the
    rounded average."""
    sums = degrees.agg(F.count("*").alias("total_vertices"), F.coalesce(F.sum("degree"), F.lit(0)).alias("total_degree"), F.sum(F.col("degree") * F.col("degree")).alias("_squares"))
    average = F.floor(F.col("total_degree") / F.greatest(F.col("total_vertices"), F.lit(1)) + 0.5)
    sums = sums.withColumn("average", average.cast("long"))
    spread = F.col("_squares") - 2 * F.col("average") * F.col("total_degree") + F.col("average") * F.col("average") * F.col("total_vertices")
    sigma = F.floor(F.sqrt(F.coalesce(spread, F.lit(0)) / F.greatest(F.col("total_vertices"), F.lit(1))) + 0.5)
    return sums.select("total_vertices", "total_degree", "average", sigma.cast("long").alias("sigma"))


def degree_threshold(degrees: DataFrame) -> DataFrame:
    """Degrees above average + 3 sigma are high."""
    return degree_statistics(degrees).select((F.col("average") + 3 * F.col("sigma")).alias("threshold"))


def edge_count(adjacency: DataFrame) -> DataFrame:
    """Half of all adjacency entries."""
    return adjacency.agg(F.floor(F.coalesce(F.sum(F.size("neighbours")), F.lit(0)) / 2).cast("long").alias("edges"))


def id_gaps(ids: DataFrame, column: str = "id") -> DataFrame:
    """after, before: the ids around each gap in a sequence. Ids are compared within ranges that overlap by one id."""
    width = 1 << 20
    block = F.floor(F.col(column) / width)
    spread = ids.select(F.col(column).alias("id"), block.alias("block")).distinct()
    # the least id of each block also closes the last non-empty block before it
    heads = spread.groupBy("block").agg(F.min("id").alias("head"))
    last = spread.groupBy("block").agg(F.max("id").alias("tail"))
    seam = Window.orderBy("block")  # one row for each million ids
    borders = heads.join(last, "block").select(F.col("tail").alias("after"), F.lead("head").over(seam).alias("before"))
    inner = spread.select(F.col("id").alias("after"), F.lead("id").over(Window.partitionBy("block").orderBy("id")).alias("before"))
    return inner.union(borders).where("before > after + 1")
