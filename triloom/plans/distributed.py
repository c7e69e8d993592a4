"""Queries over n-hop partitions: what partitions answer alone, and joins of the answers where they can't.

Each partition holds every triple within n hops of its own vertices. A sub-query whose patterns all lie within n hops of
a core is answered by each partition for the core's vertices that it owns, so that each match comes once. All partitions
are one table with the partition's number as a join key: one plan, whatever their number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.partitioning import Replicas
from .compiler import component_bindings, condition, join
from .query_graph import covering_cores, split
from .sparql import Pattern, Query


class PartitionedGraph:
    """Replicas' rows s, p, o, part; the parts' numbers are carried along and joined on. Patterns at the core are read only in
    the parts that own it."""

    encoded = False
    carried = ["part"]
    selectivity = None

    def __init__(self, replicas: Replicas, core: str):
        self.spark, self._replicas, self.core = replicas.spark, replicas, core

    def scan_for(self, p: Pattern) -> DataFrame:
        return self._replicas.rows("s" if str(p.s) == self.core else "o" if str(p.o) == self.core else None)


def answer_locally(replicas: Replicas, query: Query, hops: int) -> DataFrame:
    """All variables of a query that partitions answer alone, each match from its core vertex's own partition. A variable
    is preferred as core, that of most patterns: its vertices are spread over the partitions, a constant's is in one."""
    cores = covering_cores(query.patterns, hops)
    if not cores:
        raise ValueError(f"not within {hops} hops of a vertex")
    core = max(cores, key=lambda v: (v.startswith("?"), sum(v in (str(p.s), str(p.o)) for p in query.patterns)))
    return component_bindings(PartitionedGraph(replicas, core), query.patterns).drop("part")


def partitioned_answer(replicas: Replicas, query: Query, hops: int) -> DataFrame:
    """The query's rows: its sub-queries' answers, joined on the variables that they share."""
    parts = [query] if covering_cores(query.patterns, hops) else split(query, hops)
    df = reduce(join, [answer_locally(replicas, q, hops) for q in parts])
    for f in query.filters:
        df = df.where(condition(f, df.columns))
    names = dict.fromkeys(query.select)
    df = df.select(*[(F.col(f"?{v}") if f"?{v}" in df.columns else F.lit(None).cast("string")).alias(v) for v in names])
    return df.distinct() if query.distinct else df
