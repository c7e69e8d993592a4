"""Relational tables as a virtual graph, after the idea of a direct mapping.

A row is a subject ``<base/table/key>`` of class ``<base/class/table>``; each column is a predicate
``<base/table#column>``; a foreign key's object is the subject it refers to; a null gives no triple. A pattern with a
known predicate reads two columns of one table, and a constant object becomes a filter on that column, which
reaches the Parquet scan.

Keys are unique in these tables, so each triple comes once. lineitem has no key; its rows are told apart by a
digest of all columns.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import RDF_TYPE, XSD

BASE = "http://triloom.local"


@dataclass(frozen=True)
class Mapping:
    """key: columns of the subject; columns: with their XSD type, or the table that they refer to (>table)."""

    table: str
    key: tuple[str, ...]
    columns: dict[str, str]


MAPPINGS = {
    m.table: m
    for m in (
        Mapping("region", ("r_regionkey",), {"r_name": "string"}),
        Mapping("nation", ("n_nationkey",), {"n_name": "string", "n_regionkey": ">region"}),
        Mapping("customer", ("c_custkey",), {"c_name": "string", "c_nationkey": ">nation", "c_acctbal": "double", "c_mktsegment": "string"}),
        Mapping("supplier", ("s_suppkey",), {"s_name": "string", "s_nationkey": ">nation", "s_acctbal": "double"}),
        Mapping("part", ("p_partkey",), {"p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "integer", "p_retailprice": "double"}),
        Mapping("orders", ("o_orderkey",), {"o_custkey": ">customer", "o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": "dateTime", "o_orderpriority": "string"}),
        Mapping("events", ("event_id",), {"user_id": ">customer", "event_type": "string", "value": "double"}),
        Mapping("documents", ("doc_id",), {"lang": "string", "source": "string", "n_chars": "integer"}),
        Mapping("labels", ("doc_id",), {"doc_id": ">documents", "quality": "integer", "toxic": "integer"}),
        Mapping("conversations", ("conv_id", "turn"), {"conv_id": "integer", "turn": "integer", "role": "string"}),
        Mapping("lineitem", (), {"l_orderkey": ">orders", "l_partkey": ">part", "l_suppkey": ">supplier", "l_linenumber": "integer", "l_quantity": "double", "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "dateTime"}),
    )
}
#: The tables of the queries' graph.
GRAPH = ("region", "nation", "customer", "supplier", "part", "orders")


def class_iri(table: str) -> str:
    return f"<{BASE}/class/{table}>"


def predicate_iri(table: str, column: str) -> str:
    return f"<{BASE}/{table}#{column}>"


class TableGraph:
    """Triples of tables, read as patterns ask for them."""

    encoded = False

    def __init__(self, spark: SparkSession, sf_dir: str, tables: tuple[str, ...] = GRAPH):
        self.spark, self.sf_dir, self.tables = spark, sf_dir, tables
        self._of = {predicate_iri(t, c): (t, c) for t in tables for c in MAPPINGS[t].columns}

    def _read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet")

    def _subject(self, table: str, df: DataFrame) -> Column:
        key = [F.col(c).cast("string") for c in MAPPINGS[table].key]
        if not key:
            key = [F.sha1(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in sorted(df.columns)]))]
        return F.concat(F.lit(f"<{BASE}/{table}/"), F.concat_ws("_", *key), F.lit(">"))

    def _object(self, table: str, column: str) -> Column:
        kind, text = MAPPINGS[table].columns[column], F.col(column).cast("string")
        if kind.startswith(">"):
            return F.concat(F.lit(f"<{BASE}/{kind[1:]}/"), text, F.lit(">"))
        if kind == "string":
            text = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
        return F.concat(F.lit('"'), text, F.lit(f'"^^<{XSD}{kind}>'))

    def _can_be(self, table: str, column: str, term: str) -> Column | None:
        """A condition that rows with this object meet, on the stored column where the term is plain enough; None if no
        row can have it."""
        kind = MAPPINGS[table].columns[column]
        head, tail = (f"<{BASE}/{kind[1:]}/", ">") if kind.startswith(">") else ('"', f'"^^<{XSD}{kind}>')
        if not (term.startswith(head) and term.endswith(tail) and len(term) >= len(head) + len(tail)):
            return None
        value = term[len(head) : len(term) - len(tail)]
        if kind.startswith(">") or kind == "integer":
            return F.col(column) == int(value) if value.lstrip("-").isdigit() and len(value) < 19 else None
        return F.col(column) == value if kind == "string" and "\\" not in value else self._object(table, column) == F.lit(term)

    def _only(self, df: DataFrame, table: str, column: str, term: str) -> DataFrame:
        """Rows that can have this object."""
        found = self._can_be(table, column, term)
        return df.limit(0) if found is None else df.where(found)

    def _for_subject(self, df: DataFrame, table: str, term: str) -> DataFrame:
        """Rows that can be this subject, by a filter on a single stored key."""
        head, key = f"<{BASE}/{table}/", MAPPINGS[table].key
        if not term.startswith(head):
            return df.limit(0)
        value = term[len(head) : -1]
        if len(key) != 1:
            return df
        return df.where(F.col(key[0]) == int(value)) if value.lstrip("-").isdigit() and len(value) < 19 else df.limit(0)

    def scan(self, p: str | None = None, s: str | None = None, o: str | None = None) -> DataFrame:
        """s, p, o of the triples that can match; the caller still compares terms."""
        if p == RDF_TYPE:
            parts = [self._class(t, s) for t in self.tables if o in (None, class_iri(t))]
        elif p is not None:
            if p not in self._of:
                parts = []
            else:
                table, column = self._of[p]
                df = self._read(table)
                df = self._for_subject(df, table, s) if s is not None else df
                df = self._only(df, table, column, o) if o is not None else df
                parts = [df.where(F.col(column).isNotNull()).select(self._subject(table, df).alias("s"), F.lit(p).alias("p"), self._object(table, column).alias("o"))]
        else:
            parts = [x for t in self.tables if s is None or s.startswith(f"<{BASE}/{t}/") if (x := self._all(t, s, o)) is not None]
        if not parts:
            return self.spark.createDataFrame([], "s string, p string, o string")
        out = parts[0]
        for x in parts[1:]:
            out = out.union(x)
        return out

    def _class(self, table: str, s: str | None) -> DataFrame:
        df = self._read(table)
        df = self._for_subject(df, table, s) if s is not None else df
        return df.select(self._subject(table, df).alias("s"), F.lit(RDF_TYPE).alias("p"), F.lit(class_iri(table)).alias("o"))

    def _all(self, table: str, s: str | None, o: str | None) -> DataFrame | None:
        """Triples of all columns; with an object, only of the columns and rows that can have it."""
        df = self._read(table)
        df = self._for_subject(df, table, s) if s is not None else df
        columns, typed = list(MAPPINGS[table].columns), o in (None, class_iri(table))
        if o is not None:
            found = {c: x for c in columns if (x := self._can_be(table, c, o)) is not None}
            columns = list(found)
            if not typed:
                if not columns:
                    return None
                df = df.where(reduce(lambda a, b: a | b, found.values()))
        pairs = [(F.lit(RDF_TYPE), F.lit(class_iri(table)))] * typed + [(F.lit(predicate_iri(table, c)), self._object(table, c)) for c in columns]
        both = F.explode(F.array(*[F.struct(p.alias("p"), x.alias("o")) for p, x in pairs]))
        return df.select(self._subject(table, df).alias("s"), both.alias("x")).where("x.o IS NOT NULL").select("s", "x.p", "x.o")

    def _home(self, pattern) -> str | None:
        """The table whose rows answer a pattern with a variable subject and a known predicate."""
        if isinstance(pattern.s, str) or not isinstance(pattern.p, str):
            return None
        if pattern.p == RDF_TYPE:
            return next((t for t in self.tables if pattern.o == class_iri(t)), None)
        return self._of.get(pattern.p, (None,))[0]

    def star_of(self, first, patterns: list) -> list:
        """The patterns that the same rows of one table answer as first."""
        table = self._home(first)
        return [p for p in patterns if table and p.s == first.s and self._home(p) == table]

    def star_bindings(self, star: list) -> DataFrame:
        """A star's bindings by one scan: a row has one value of each column, so no pattern multiplies it."""
        table = self._home(star[0])
        df = self._read(table)
        subject = f"?{star[0].s.name}"
        columns: dict[str, Column] = {subject: self._subject(table, df)}
        for p in star:
            if p.p == RDF_TYPE:
                continue
            column = self._of[p.p][1]
            term = self._object(table, column)
            if isinstance(p.o, str):
                df = self._only(df, table, column, p.o).where(term == F.lit(p.o))
            else:
                name = f"?{p.o.name}"
                df = df.where(F.col(column).isNotNull() if name not in columns else columns[name] == term)
                columns.setdefault(name, term)
        return df.select(*[c.alias(n) for n, c in columns.items()])

    def triples(self) -> DataFrame:
        return self.scan()

    def raw(self) -> DataFrame:
        return self.scan()

    @cached_property
    def selectivity(self) -> dict[str, int]:
        """Subjects of each predicate, from row counts (Parquet footers)."""
        rows = {t: self._read(t).count() for t in self.tables}
        return {RDF_TYPE: sum(rows.values())} | {p: rows[t] for p, (t, _) in self._of.items()}


def mapping_sql(tables: tuple[str, ...] = GRAPH) -> str:
    """SQL for the body of a relation of all triples (s, p, o) of tables with keys."""
    parts = []
    for t in tables:
        m = MAPPINGS[t]
        subject = f"'<{BASE}/{t}/' || " + " || '_' || ".join(f"CAST({c} AS VARCHAR)" for c in m.key) + " || '>'"
        parts.append(f"SELECT {subject} AS s, '{RDF_TYPE}' AS p, '{class_iri(t)}' AS o FROM {t}")
        for c, kind in m.columns.items():
            o = f"'<{BASE}/{kind[1:]}/' || CAST({c} AS VARCHAR) || '>'" if kind.startswith(">") else f"'\"' || CAST({c} AS VARCHAR) || '\"^^<{XSD}{kind}>'"
            parts.append(f"SELECT {subject}, '{predicate_iri(t, c)}', {o} FROM {t} WHERE {c} IS NOT NULL")
    return "\nUNION ALL ".join(parts)
