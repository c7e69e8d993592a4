"""Preparing a graph for partitions: typed and untyped triples, adjacency, assignment, n-hop expansion, degrees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.terms import RDF_TYPE
from .shared import clustered, materialize


def split_typed(triples: DataFrame, type_term=RDF_TYPE) -> tuple[DataFrame, DataFrame]:
    """(rdf:type triples, all others)."""
    return triples.where(F.col("p") == F.lit(type_term)), triples.where(F.col("p") != F.lit(type_term))


def adjacency(triples: DataFrame, distinct: bool = False) -> DataFrame:
    """v, neighbours in both directions; with distinct each neighbour once."""
    both = triples.select(F.explode(F.array(F.struct(F.col("s").alias("v"), F.col("o").alias("w")), F.struct(F.col("o").alias("v"), F.col("s").alias("w")))).alias("x")).select("x.*")
    collect = F.collect_set if distinct else F.collect_list  # one shuffle either way
    return both.groupBy("v").agg(collect("w").alias("neighbours"))


def out_adjacency(triples: DataFrame, low=None, high=None, type_term=RDF_TYPE) -> DataFrame:
    """v, neighbours along untyped triples, for subjects within low..high."""
    df = triples.where(F.col("p") != F.lit(type_term))
    if low is not None:
        df = df.where(F.col("s") >= F.lit(low))
    if high is not None:
        df = df.where(F.col("s") <= F.lit(high))
    return df.groupBy(F.col("s").alias("v")).agg(F.collect_list("o").alias("neighbours"))


def vertices_and_neighbours(adj: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The vertex column and the neighbour lists as text, aligned by v."""
    return adj.select("v"), adj.select("v", F.concat_ws(" ", F.transform("neighbours", lambda x: x.cast("string"))).alias("line"))


def renumber(adj: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(adjacency over dense ids 1.., the map v, id)."""
    from .dictionary import dense_ids

    ids = materialize(dense_ids(adj.select("v").union(adj.select(F.explode("neighbours"))).distinct(), ["v"], "id"))
    flat = adj.select("v", F.explode("neighbours").alias("w"))
    flat = flat.join(ids, "v").select(F.col("id").alias("v"), "w").join(ids.select(F.col("v").alias("w"), F.col("id").alias("n")), "w")
    return flat.groupBy("v").agg(F.collect_list("n").alias("neighbours")), ids


def restore(df: DataFrame, ids: DataFrame, column: str = "v") -> DataFrame:
    """df with dense ids in column replaced by the vertices that they stand for."""
    names = df.columns
    out = df.join(ids.select(F.col("id").alias(column), F.col("v").alias("_v")), column)
    return out.select(*[F.col("_v").alias(c) if c == column else F.col(c) for c in names])


def fill_isolated(adj: DataFrame, most: int | None = None) -> DataFrame:
    """Adjacency with an empty list for each id from 1 to the largest that has none."""
    if most is None:
        most = adj.agg(F.max("v")).first()[0] or 0
    every = adj.sparkSession.range(1, int(most) + 1).select(F.col("id").alias("v"))
    kind = adj.schema["neighbours"].dataType
    return every.join(adj, "v", "left").select("v", F.coalesce("neighbours", F.array().cast(kind)).alias("neighbours"))


# --- assignment ---------------------------------------------------------------------------------------


def assign_by_hash(vertices: DataFrame, parts: int) -> DataFrame:
    """v, part: the baseline, balanced and deterministic."""
    return vertices.select("v", F.pmod(F.xxhash64(F.col("v")), F.lit(parts)).cast("int").alias("part")).distinct()


def assign_by_neighbours(adj: DataFrame, parts: int, rounds: int = 5, slack: float = 1.1) -> DataFrame:
    """v, part for an adjacency; see assign_by_edges."""
    with clustered(adj.select("v", F.explode("neighbours").alias("w")), "w") as edges:
        return assign_by_edges(edges, materialize(adj.select("v")), parts, rounds, slack)


def assign_by_edges(edges: DataFrame, vertices: DataFrame, parts: int, rounds: int = 5, slack: float = 1.1) -> DataFrame:
    """v, part: hash assignment improved by label propagation with a bound on sizes, in place of an external partitioner.
    edges (v, w) have both directions and are clustered by w, so that only labels and votes of those that may move are shuffled.

    In each round a vertex moves to the part of most of its neighbours. A part takes newcomers, those with the most
    to gain first, only up to slack times the mean size, by thresholds on hashed gain; half of all vertices, by hash, may
    move in a round, so that neighbours don't swap for ever.
    """
    edges = edges.where("v <> w")
    label = vertices.select("v", F.pmod(F.xxhash64(F.col("v")), F.lit(parts)).cast("int").alias("part"))  # as assign_by_hash has it
    total = vertices.count()
    for turn in range(rounds):
        may_move = F.pmod(F.xxhash64("v", F.lit(turn)), F.lit(2)) == 0
        votes = edges.where(may_move).join(label.select(F.col("v").alias("w"), "part"), "w")
        if parts <= WORD:  # a vertex's votes are one row
            found = votes.groupBy("v").agg(*[F.count_if(F.col("part") == k).alias(f"n{k}") for k in range(parts)])
            tops = [F.when(F.col(f"n{k}") > 0, F.struct(F.col(f"n{k}").alias("n"), F.xxhash64("v", F.lit(k)).alias("h"), F.lit(k).alias("part"))) for k in range(parts)]
            best = found.select("v", (F.greatest(*tops) if parts > 1 else tops[0])["part"].alias("to"))
        else:
            votes = votes.groupBy("v", "part").agg(F.count("*").alias("n"))
            best = votes.groupBy("v").agg(F.max(F.struct("n", F.xxhash64("v", "part"), "part")).alias("x")).select("v", F.col("x.part").alias("to"))
        wish = label.join(best, "v", "left").withColumn("to", F.coalesce("to", "part"))
        wish = materialize(wish, compression="zstd")
        size = wish.groupBy("part").agg(F.count("*").alias("size"))
        come = wish.where("to <> part").groupBy(F.col("to").alias("part")).agg(F.count("*").alias("come"))
        room = size.join(come, "part", "full").select(F.col("part").alias("to"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.lit(slack * total / parts) - F.coalesce("size", F.lit(0))) / F.greatest(F.coalesce("come", F.lit(0)), F.lit(1)))).alias("share"))
        room = materialize(room)  # a row for each part
        chance = F.pmod(F.xxhash64("v", F.lit(-1 - turn)), F.lit(1 << 20)) / (1 << 20)
        label = wish.join(F.broadcast(room), "to", "left").select("v", F.when((F.col("to") != F.col("part")) & (chance < F.coalesce("share", F.lit(1.0))), F.col("to")).otherwise(F.col("part")).alias("part"))
    return materialize(label)


def zip_assignment(vertices: DataFrame, parts: DataFrame) -> DataFrame:
    """v, part from two columns aligned by position (line, v) and (line, part); unequal lengths are an error."""
    both = vertices.join(parts, "line", "full")
    return both.select(F.when(F.col("v").isNull() | F.col("part").isNull(), F.raise_error(F.lit("vertex and partition files differ in length"))).otherwise(F.col("v")).alias("v"), F.col("part").cast("int").alias("part"))


def vertices_by_part(vertex_parts: DataFrame) -> DataFrame:
    """part, vertices."""
    return vertex_parts.groupBy("part").agg(F.count("*").alias("vertices"))


def part_triples(triples: DataFrame, vertex_parts: DataFrame) -> DataFrame:
    """s, p, o, part: triples in the partitions that hold their subject."""
    return triples.join(vertex_parts.select(F.col("v").alias("s"), "part"), "s").select("s", "p", "o", "part")


def triples_of_vertices(triples: DataFrame, vertices: DataFrame) -> DataFrame:
    """Triples whose subject is among vertices."""
    return triples.join(vertices.select(F.col("v").alias("s")), "s", "left_semi").select("s", "p", "o")


#: Parts of one word of a vertex's mask.
WORD = 62


class Replicas:
    """Triples with the parts that hold them, as words of bits: what all parts hold is one row, however many they are. Beside
    the parts within reach are those that own the triple's ends."""

    def __init__(self, masked: DataFrame, parts: list, kind):
        self.spark, self._masked, self._parts, self._kind = masked.sparkSession, masked, parts, kind

    def rows(self, owned: str | None = None) -> DataFrame:
        """s, p, o, part; with owned (s or o) only in parts that own this end."""
        bits = []
        for i, part in enumerate(self._parts):
            word = F.col(f"m{i // WORD}") if owned is None else F.col(f"m{i // WORD}").bitwiseAND(F.col(f"{owned}{i // WORD}"))
            bits.append(F.when(word.bitwiseAND(F.lit(1 << i % WORD)) != 0, F.lit(part).cast(self._kind)))
        return self._masked.select("s", "p", "o", F.explode(F.array_compact(F.array(*bits))).alias("part"))


def replicas(triples: DataFrame, vertex_parts: DataFrame, hops: int) -> Replicas:
    """Every triple within so many hops of a partition's vertices, whichever way it points.

    A vertex has one row with the bits of the parts that reach it; a hop joins the triples with it at both ends, so that the
    work follows the triples and not how many parts hold them. Each hop is written to the shared folder.
    """
    spark, kind = triples.sparkSession, vertex_parts.schema["part"].dataType
    parts = sorted(r["part"] for r in vertex_parts.select("part").distinct().collect())  # as many as there are partitions
    places = F.broadcast(spark.createDataFrame([(part, i // WORD, i % WORD) for i, part in enumerate(parts)], "_part long, _word int, _bit int"))
    words = range(max(1, -(-len(parts) // WORD)))
    reached, own = [f"m{w}" for w in words], [f"a{w}" for w in words]
    bit = [F.when(F.col("_word") == w, F.expr("shiftleft(1L, _bit)")).otherwise(F.lit(0).cast("long")) for w in words]

    def united(df: DataFrame) -> DataFrame:
        return df.groupBy("v").agg(*[F.bit_or(c).alias(c) for c in (*reached, *own)])

    placed = vertex_parts.join(places, F.col("part") == F.col("_part"))
    known = materialize(united(placed.select("v", *[x.alias(c) for x, c in zip(bit + bit, reached + own, strict=True)])))
    zero = F.lit(0).cast("long")
    with clustered(triples.select("s", "p", "o"), "s") as edges:
        if not hops:
            return Replicas(materialize(edges.limit(0).select("*", *[zero.alias(c) for c in reached + [e + str(w) for e in "so" for w in words]])), parts, kind)
        for hop in range(hops):
            last, found = hop + 1 == hops, edges
            for end in "so":
                at = known.select(F.col("v").alias("_v"), *[F.col(c).alias(f"_{end}{c}") for c in reached + (own if hop + 1 == hops else [])])
                found = found.join(at, F.col(end) == F.col("_v"), "left").drop("_v")
            mask = [F.coalesce(f"_sm{w}", zero).bitwiseOR(F.coalesce(f"_om{w}", zero)).alias(f"m{w}") for w in words]
            found = found.select("s", "o", *(["p"] if last else []), *mask, *([F.coalesce(f"_{e}a{w}", zero).alias(f"{e}{w}") for e in "so" for w in words] if last else []))
            found = found.where(reduce(lambda a, b: a | b, [F.col(c) != 0 for c in reached]))
            if not last:
                ends = found.select(F.explode(F.array("s", "o")).alias("v"), *reached, *[zero.alias(c) for c in own])
                known = materialize(united(ends.union(known)))
        return Replicas(materialize(found, compression="zstd"), parts, kind)


def expand_hops(triples: DataFrame, vertex_parts: DataFrame, hops: int) -> DataFrame:
    """s, p, o, part: the rows of replicas."""
    return replicas(triples, vertex_parts, hops).rows()


# --- high degrees -------------------------------------------------------------------------------------


def split_by_degree(triples: DataFrame, degrees: DataFrame, threshold: int) -> DataFrame:
    """s, p, o, level: high if either end has a degree of at least threshold, low if some end has a degree at all; triples
    without such an end are left out."""
    ends = degrees.select("v", F.when(F.col("degree") >= threshold, 2).otherwise(1).alias("d"))
    joined = triples.join(ends.select(F.col("v").alias("s"), F.col("d").alias("ds")), "s", "left").join(ends.select(F.col("v").alias("o"), F.col("d").alias("do")), "o", "left")
    level = F.greatest(F.coalesce("ds", F.lit(0)), F.coalesce("do", F.lit(0)))
    return joined.where(level > 0).select("s", "p", "o", F.when(level == 2, "high").otherwise("low").alias("level"))


def high_degree_subjects(split: DataFrame) -> DataFrame:
    """Distinct subjects of high triples."""
    return split.where("level = 'high'").select(F.col("s").alias("v")).distinct()


def place_high_degree(triples: DataFrame, high: DataFrame, vertex_parts: DataFrame) -> DataFrame:
    """v, part: each high-degree vertex goes where most of its neighbours are; ties to the smaller partition."""
    near = triples.select(F.explode(F.array(F.struct(F.col("s").alias("v"), F.col("o").alias("w")), F.struct(F.col("o").alias("v"), F.col("s").alias("w")))).alias("x")).select("x.*").join(high, "v", "left_semi")
    counts = near.join(vertex_parts.select(F.col("v").alias("w"), "part"), "w").groupBy("v", "part").agg(F.count("*").alias("n"))
    return counts.groupBy("v").agg(F.max(F.struct("n", (-F.col("part")).alias("m"))).alias("x")).select("v", (-F.col("x.m")).cast("int").alias("part"))
