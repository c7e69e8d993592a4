"""Graphs that can be saved, loaded and asked in SPARQL."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import dictionary, layout, statistics
from .operators.shared import clustered, materialize
from .plans import query_graph
from .plans.compiler import compile_query, count_query
from .plans.ordering import order
from .plans.sparql import Query, parse
from .sources.ntriples import read_ntriples
from .sources.tables import GRAPH, TableGraph


#: Predicates that a query's driver may hold.
MOST_PREDICATES = 50_000


@dataclass
class GraphConfig:
    """Partitions and hops for distribution planning."""

    partitions: int = 8
    hops: int = 2


class FlatGraph:
    """Triples of terms in one DataFrame; equal ones count once."""

    encoded = False

    def __init__(self, triples: DataFrame):
        self.spark, self._raw = triples.sparkSession, triples.select("s", "p", "o")
        self._triples = self._raw.distinct()

    def scan(self, p=None, s=None, o=None) -> DataFrame:
        return self._triples

    def triples(self) -> DataFrame:
        return self._triples

    def raw(self) -> DataFrame:
        """The triples, equal ones perhaps more than once."""
        return self._raw

    @cached_property
    def selectivity(self) -> None:
        return None


class SavedGraph:
    """A saved graph: triples by predicate, statistics, and in encoded graphs the dictionary."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._predicates = spark.read.parquet(f"{path}/predicates")
        self._data = spark.read.parquet(f"{path}/triples")
        self.encoded = dict(self._data.dtypes)["s"] == "bigint"
        self._dictionary = spark.read.parquet(f"{path}/dictionary") if self.encoded else None
        self._known: dict[str, int | None] = {}

    def prepare(self, terms: list[str]) -> None:
        """Look up a query's constants in one job; predicates are known from the statistics."""
        known = {t: x["p"] for t, x in self._rows.items()} if self._rows else {}
        self._known |= {t: known[t] for t in terms if t in known}
        if missing := [t for t in terms if t not in self._known]:
            found = dictionary.look_up(self._dictionary, missing)
            self._known |= {t: found.get(t) for t in missing}

    def constant(self, term: str) -> int | None:
        """The id of a constant; null (which nothing equals) if the graph has no such term."""
        if term not in self._known:
            self.prepare([term])
        return self._known[term]

    def decode(self, df: DataFrame, column: str, predicate: bool = False) -> DataFrame:
        """df with a column's ids as terms. Predicates are few, and theirs are beside the statistics."""
        if predicate:
            names = self._few(self._predicates.select(F.col("p").alias(column), F.col("term").alias("_term")))
        else:
            names = self._dictionary.select(F.col("id").alias(column), F.col("term").alias("_term"))
        return df.join(names, column).select(*[F.col("_term").alias(c) if c == column else F.col(c) for c in df.columns])

    def _few(self, df: DataFrame) -> DataFrame:
        """Rows of the predicates' table, to be sent to all tasks if they are few."""
        return F.broadcast(df) if self._rows is not None else df

    def scan(self, p=None, s=None, o=None) -> DataFrame:
        if p is None:
            return self._data.join(self._few(self._predicates.select("pid", "p")), "pid").select("s", "p", "o")
        own = self.constant(p) if self.encoded else p
        pid = self._pid(p, own)
        if pid is None:
            return self._data.limit(0).select("s", F.lit(own).cast(self._data.schema["s"].dataType).alias("p"), "o")
        return self._data.where(F.col("pid") == pid).select("s", F.lit(own).alias("p"), "o")

    def _pid(self, term: str, own) -> int | None:
        if self._rows is not None:
            return self._rows[term]["pid"] if term in self._rows else None
        row = self._predicates.where(F.col("p") == F.lit(own)).select("pid").first()
        return row and row["pid"]

    @cached_property
    def _rows(self) -> dict | None:
        """The predicates by their terms, if they are few (about 100 bytes each; else None)."""
        rows = self._predicates.limit(MOST_PREDICATES + 1).collect()
        return {r["term"]: r for r in rows} if len(rows) <= MOST_PREDICATES else None

    def triples(self) -> DataFrame:
        df = self._data.select("s", "pid", "o")
        if self.encoded:
            df = self.decode(self.decode(df, "s"), "o")
        return df.join(self._few(self._predicates.select("pid", F.col("term").alias("p"))), "pid").select("s", "p", "o")

    def raw(self) -> DataFrame:
        return self.triples()

    @cached_property
    def selectivity(self) -> dict[str, int] | None:
        return None if self._rows is None else {t: r["subjects"] for t, r in self._rows.items()}


class GraphStore:
    """A graph with its query interface."""

    def __init__(self, graph, config: GraphConfig | None = None):
        self.graph, self.spark, self.config = graph, graph.spark, config or GraphConfig()

    @classmethod
    def from_ntriples(cls, spark: SparkSession, path: str, config: GraphConfig | None = None) -> GraphStore:
        """Malformed lines are left out; read_ntriples gives them."""
        return cls(FlatGraph(read_ntriples(spark, path)[0]), config)

    @classmethod
    def from_tables(cls, spark: SparkSession, sf_dir: str, tables: tuple[str, ...] = GRAPH, config: GraphConfig | None = None) -> GraphStore:
        return cls(TableGraph(spark, sf_dir, tables), config)

    @classmethod
    def from_triples(cls, triples: DataFrame, config: GraphConfig | None = None) -> GraphStore:
        """Triples s, p, o; equal ones count once."""
        return cls(FlatGraph(triples), config)

    @classmethod
    def load(cls, spark: SparkSession, path: str, config: GraphConfig | None = None) -> GraphStore:
        return cls(SavedGraph(spark, path), config)

    def save(self, path: str, encoded: bool = True) -> GraphStore:
        """Write triples by predicate with their statistics, as ids with a dictionary or as terms; the store of the copy.

        The triples are written by subject first: their subjects are counted and encoded without another shuffle.
        """
        with clustered(self.graph.raw(), "s") as triples:
            # written, so that one file of them in the end doesn't make their computation one task
            rows = materialize(layout.number_predicates(triples).join(statistics.predicate_selectivity(triples), "p"))
            few = F.broadcast if rows.count() <= MOST_PREDICATES else lambda df: df
            data = triples.join(few(layout.pieces(rows)), "p").drop("p")
            rows = rows.withColumn("term", F.col("p"))
            if encoded:
                dictionary.shared_ids(triples).write.parquet(f"{path}/dictionary", compression="zstd")
                ids = self.spark.read.parquet(f"{path}/dictionary")
                data = dictionary.encode_ends(data, ids)
                rows = materialize(few(rows.drop("p")).join(ids.select(F.col("id").alias("p"), "term"), "term"))
            rows.select("p", "pid", "subjects", "triples", "term").coalesce(1).write.parquet(f"{path}/predicates")
            layout.write_pieces(data, f"{path}/triples")
        return GraphStore.load(self.spark, path, self.config)

    def triples(self) -> DataFrame:
        return self.graph.triples()

    def sparql(self, text: str) -> DataFrame:
        """One column for each selected variable, in order."""
        return compile_query(self.graph, parse(text))

    def count(self, text: str) -> int:
        """The number of the query's rows."""
        return self.bindings_count(text).first()["bindings"]

    def bindings_count(self, text: str) -> DataFrame:
        """bindings: the number of the query's rows. A product's size is that of its factors, which is never built."""
        return count_query(self.graph, parse(text))

    def match_count(self, text: str) -> DataFrame:
        """component, results: pairs in the star rows that match each component's subjects, joins between stars aside."""
        stars, rows = layout.star_rows(self.triples()), []
        q = parse(text)
        for i, c in enumerate(query_graph.components(q.patterns)):
            for star in query_graph.decompose(c):
                needed = [tuple(None if not isinstance(t, str) else t for t in (p.p, p.o)) for p in star.patterns]
                own = stars if not isinstance(star.patterns[0].s, str) else stars.where(F.col("s") == star.patterns[0].s)
                rows.append(layout.match_count(own, needed).select(F.lit(i).alias("component"), "results"))
        out = rows[0]
        for r in rows[1:]:
            out = out.union(r)
        return out.groupBy("component").agg(F.sum("results").alias("results"))

    def explain(self, text: str) -> str:
        """Components, stars and pipelines, join order, and locality."""
        q: Query = parse(text)
        lines = [f"select {' '.join('?' + v for v in q.select)}" + " distinct" * q.distinct]
        for i, c in enumerate(query_graph.components(q.patterns)):
            lines.append(f"component {i}:")
            for star in query_graph.decompose(c):
                lines.append(f"  {star.kind} {star.subject}: {len(star.patterns)} patterns" + "".join(f"; ?{v} {k.value} {b}" for v, k, b in star.links))
            lines.append("  order: " + " | ".join(map(str, order(c, self.graph.selectivity))))
        where = query_graph.locality(q.patterns)
        lines.append(f"locality: radius {where.radius}, cores {', '.join(where.cores) or 'none'}, answerable with {self.config.hops} hops: {where.answerable(self.config.hops)}")
        return "\n".join(lines)
