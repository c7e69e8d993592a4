"""From queries to DataFrames: a filtered scan for each pattern, inner joins on shared variables, cross joins between
components, filters, and the projection. Bindings are a multiset, as SPARQL has it.

In an encoded graph variables hold ids until the end; those that filters or the result need are decoded then.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms
from ..operators.shared import materialize
from .ordering import order
from .query_graph import components
from .sparql import Expr, Pattern, Query, QueryError, Var



def _column(name: str) -> str:
    return f"?{name}"


def pattern_bindings(graph, p: Pattern) -> DataFrame:
    """One column for each variable of a pattern, one row for each triple that matches; and the columns that the graph
    carries along (as partitions do with their number).

    Without variables: one row if the triple exists, else none (a graph is a set of triples).
    """
    const = {k: None if isinstance(t, Var) else t for k, t in (("s", p.s), ("p", p.p), ("o", p.o))}
    carried = getattr(graph, "carried", [])
    df = graph.scan_for(p) if carried else graph.scan(**const)
    for k, t in const.items():
        if t is not None:
            df = df.where(F.col(k) == F.lit(graph.constant(t) if graph.encoded else t))
    seen: dict[str, str] = {}
    for k, t in (("s", p.s), ("p", p.p), ("o", p.o)):
        if isinstance(t, Var):
            if t.name in seen:
                df = df.where(F.col(k) == F.col(seen[t.name]))
            else:
                seen[t.name] = k
    if not seen and not carried:
        return df.select(F.lit(True).alias("_exists")).limit(1)
    return df.select(*[F.col(k).alias(_column(v)) for v, k in seen.items()], *carried)


def join(a: DataFrame, b: DataFrame) -> DataFrame:
    """The natural join on all common variables; a product where there are none."""
    common = [c for c in a.columns if c in b.columns and c != "_exists"]
    if common:
        return a.join(b, common)
    return a.drop("_exists").crossJoin(b) if "_exists" in a.columns and "_exists" in b.columns else a.crossJoin(b)


def _component_parts(graph, patterns: list[Pattern]) -> list[DataFrame]:
    """The component's patterns in their join order. Where the graph stores a star's predicates side by side, as tables
    do, the star is one scan and its patterns need no joins."""
    rest, parts = order(patterns, graph.selectivity), []
    while rest:
        star = graph.star_of(rest[0], rest) if hasattr(graph, "star_of") else []
        if len(star) > 1:
            parts.append(graph.star_bindings(star))
            rest = [p for p in rest if p not in star]
        else:
            parts.append(pattern_bindings(graph, rest.pop(0)))
    return parts


#: Rows that a join may give in one cell of a key's product, beyond which the product is dealt to several.
CELL = 500_000


def component_bindings(graph, patterns: list[Pattern], decode: set[str] | None = None) -> DataFrame:
    """The component's bindings. In an encoded graph those of decode that it has had to decode already are removed from it."""
    parts = _component_parts(graph, patterns)
    subjects = {_column(p.s.name) for p in patterns if isinstance(p.s, Var)}
    if len(parts) == 2 and not getattr(graph, "carried", []):
        common = [c for c in parts[0].columns if c in parts[1].columns]
        if len(common) == 1 and common[0] not in subjects and (heavy := heavy_keys(*parts, common[0])) is not None:
            for c in sorted((decode or set()) - set(common)):
                # each side has far fewer rows than their product
                if c in parts[0].columns or c in parts[1].columns:
                    parts = [graph.decode(x, c) if c in x.columns else x for x in parts]
                    decode.discard(c)
            return dealt_join(*parts, common[0], heavy)
    return reduce(join, parts)


def heavy_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame | None:
    """Keys whose rows in a and b give more than CELL rows, with the blocks that each side is dealt to; None if there are
    none. They are few: a key takes over 2 CELL ** 0.5 rows of both sides together."""
    n, m = (x.groupBy(key).agg(F.count("*").alias(c)) for x, c in ((a, "_n"), (b, "_m")))
    cells = F.ceil(F.col("_n") / CELL * F.col("_m"))
    both = n.join(m, key).where(cells > 1)
    rows = F.least(F.greatest(F.round(F.sqrt(cells * F.col("_n") / F.col("_m"))), F.lit(1)), cells).cast("long")
    found = materialize(both.select(key, rows.alias("_rows"), F.ceil(cells / rows).alias("_columns")))
    return None if found.isEmpty() else found


def dealt_join(a: DataFrame, b: DataFrame, key: str, heavy: DataFrame) -> DataFrame:
    """a and b joined on a key. A heavy key's product is a grid of blocks of a by blocks of b: a row goes to the cells of its
    block, so that the product has as many tasks as it needs, whatever the number of keys."""
    parts = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        block = F.pmod(F.xxhash64(*df.columns), F.coalesce(own, F.lit(1))).alias(f"{own}_block")
        places = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(other, F.lit(1)) - 1)).alias(f"{other}_block")
        found = df.join(F.broadcast(heavy), key, "left").select(*df.columns, block, own, other).select(*df.columns, f"{own}_block", places)
        return found.repartition(parts, key, "_rows_block", "_columns_block")

    on = [key, "_rows_block", "_columns_block"]
    return dealt(a, "_rows", "_columns").join(dealt(b, "_columns", "_rows").hint("shuffle_hash"), on).drop("_rows_block", "_columns_block")


def component_count(graph, patterns: list[Pattern]) -> DataFrame:
    """_times: how many rows the component has, 0 without any.

    Rows carry how often they stand for a binding. Before and after each join the variables that no later pattern has
    are summed away, on the key of the join, so that what many bindings share is one row: the work follows the triples
    and not the bindings, whose number grows with the square of a common neighbour's edges.
    """
    parts = _component_parts(graph, patterns)

    def summed(df: DataFrame, needed: set[str]) -> DataFrame:
        keys = [c for c in df.columns if c in needed and c != "_n"]
        return df if len(keys) + 1 == len(df.columns) else df.groupBy(*keys).agg(F.sum("_n").alias("_n"))

    out = None
    for i, part in enumerate(parts):
        later = {c for x in parts[i + 1 :] for c in x.columns}
        part = summed(part.withColumn("_n", F.lit(1).cast("long")), later | set(out.columns if out is not None else ()))
        if out is not None:
            part = join(out.withColumnRenamed("_n", "_m"), part).withColumn("_n", F.col("_n") * F.col("_m")).drop("_m")
        out = summed(part, later)
    return out.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("_times"))


def _asked(query: Query) -> set[str]:
    """The variables that the result or a filter needs."""
    return set(query.select) | {v for f in query.filters for v in f.variables()}


def _names(patterns: list[Pattern]) -> set[str]:
    return {v for p in patterns for v in p.variables()}


def _prepare(graph, query: Query) -> None:
    """Let an encoded graph look up all constants at once."""
    if graph.encoded:
        graph.prepare(list(dict.fromkeys(t for p in query.patterns for t in (p.s, p.p, p.o) if isinstance(t, str))))


def bindings(graph, query: Query, decode: set[str] | None = None) -> DataFrame:
    """The variables of the query that are asked for, before filters; decode as component_bindings has it.

    A component none of whose variables are asked for only says how often rows repeat: it is counted, or with DISTINCT
    tested for a first row, and never multiplied out.
    """
    parts, others = [], []
    for c in components(query.patterns):
        if _names(c) & _asked(query):
            parts.append(component_bindings(graph, c, decode))
        else:
            others.append(component_bindings(graph, c).limit(1).select(F.lit(1).cast("long").alias("_times")) if query.distinct else component_count(graph, c).where("_times > 0"))
    if not parts and not others:
        raise QueryError("no pattern")
    out = reduce(join, parts) if parts else None
    for times in others:
        if out is None:
            out = times.select(F.explode(F.sequence(F.lit(1).cast("long"), "_times"))).select(F.lit(True).alias("_exists"))
        elif query.distinct:
            out = out.crossJoin(F.broadcast(times)).drop("_times")  # one row or none
        else:
            out = out.crossJoin(F.broadcast(times)).select("*", F.explode(F.sequence(F.lit(1).cast("long"), "_times")).alias("_time")).drop("_time", "_times")
    return out


def count_query(graph, query: Query) -> DataFrame:
    """bindings: how many rows the query has. Components that no filter ties together are counted apart, and those that no
    filter reads without building their rows. Several components' counts are found at once, and their product's type
    follows its size."""
    if query.distinct:
        return compile_query(graph, query).agg(F.count("*").alias("bindings"))
    _prepare(graph, query)
    groups: list[tuple[list[Pattern], list[Expr]]] = [(c, []) for c in components(query.patterns)]
    loose = []
    for f in query.filters:
        tied = [g for g in groups if _names(g[0]) & f.variables()]
        if not tied:
            loose.append(f)
            continue
        one = ([p for g in tied for p in g[0]], [f, *(x for g in tied for x in g[1])])
        groups = [g for g in groups if g not in tied] + [one]
    counts = []
    for i, (patterns, filters) in enumerate(groups):
        filters = filters + (loose if not i else [])
        if filters:
            n = compile_query(graph, Query(sorted(_names(patterns)), patterns, filters), decoded=False).agg(F.count("*").alias("bindings"))
        else:
            n = component_count(graph, patterns).withColumnRenamed("_times", "bindings")
        counts.append(n)
    if len(counts) == 1:
        return counts[0]
    return product(graph.spark, [n.first()["bindings"] for n in counts])


def product(spark, counts: list[int]) -> DataFrame:
    """bindings: the product of single sums, exact whatever its size: a long where it is one, else a decimal."""
    n = prod(counts)
    if n < 1 << 63:
        return spark.createDataFrame([(n,)], "bindings long")
    if n >= 10**38:
        raise QueryError(f"{n} rows, more than a decimal holds")
    return spark.createDataFrame([(Decimal(n),)], "bindings decimal(38,0)")


def compile_query(graph, query: Query, decoded: bool = True) -> DataFrame:
    """The result: one string column for each selected variable, in order; null where the pattern doesn't bind it.
    Without decoded, an encoded graph's columns stay ids where no filter needs the term."""
    _prepare(graph, query)
    needed = _asked(query)
    predicates = {_column(p.p.name) for p in query.patterns if isinstance(p.p, Var)}
    filtered = {_column(v) for f in query.filters for v in f.variables()}
    early = set() if query.distinct or not (graph.encoded and decoded) else {_column(v) for v in query.select} - predicates
    late = set(early)
    df = bindings(graph, query, late)
    shown = early - late
    if graph.encoded:
        for c in sorted(filtered - shown):
            if c in df.columns:
                df = graph.decode(df, c, c in predicates)
        shown |= filtered
    for f in query.filters:
        df = df.where(condition(f, df.columns))
    df = df.select(*[c for c in dict.fromkeys(_column(v) for v in sorted(needed)) if c in df.columns], *([] if any(_column(v) in df.columns for v in needed) else [F.lit(True).alias("_exists")]))
    if graph.encoded and decoded:
        if query.distinct:  # ids tell terms apart as well, and are smaller
            df = df.select(*[c for c in (_column(v) for v in dict.fromkeys(query.select)) if c in df.columns]).distinct() if any(_column(v) in df.columns for v in query.select) else df
        for c in dict.fromkeys(_column(v) for v in query.select):
            if c in df.columns and c not in shown:
                df = graph.decode(df, c, c in predicates)
    df = df.select(*[(F.col(_column(v)) if _column(v) in df.columns else F.lit(None).cast("string")).alias(v) for v in dict.fromkeys(query.select)])
    return df.distinct() if query.distinct else df


# --- filters ------------------------------------------------------------------------------------------


def _term(x, columns: list[str]) -> Column:
    """x as a term."""
    if isinstance(x, Var):
        return F.col(_column(x.name)) if _column(x.name) in columns else F.lit(None).cast("string")
    if isinstance(x, str):
        return F.lit(x)
    if x.op in ("STR", "LANG", "DATATYPE"):
        t = _term(x.args[0], columns)
        if x.op == "DATATYPE":
            return F.concat(F.lit("<"), terms.datatype(t), F.lit(">"))
        text = terms.lexical(t) if x.op == "STR" else terms.language(t)
        return F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    raise QueryError(f"{x.op} doesn't give a term that can be compared")


def _number(x, columns: list[str]) -> Column:
    if isinstance(x, Expr) and x.op in "+-*/":
        a, b = (_number(y, columns) for y in x.args)
        return {"+": a + b, "-": a - b, "*": a * b, "/": F.try_divide(a, b)}[x.op]
    return terms.numeric(_term(x, columns))


def _text(x, columns: list[str]) -> Column:
    return terms.lexical(_term(x, columns))


def condition(e, columns: list[str]) -> Column:
    """The effective boolean value; an error is null, which a filter drops and ``||`` and ``&&`` treat as SQL does."""
    if not isinstance(e, Expr):
        t = _term(e, columns)
        value = terms.numeric(t)
        return F.when(terms.datatype(t) == terms.XSD + "boolean", terms.lexical(t).isin("true", "1")).when(value.isNotNull(), (value != 0) & ~F.isnan(value)).when(terms.datatype(t) == terms.XSD + "string", terms.lexical(t) != "")
    if e.op == "||":
        return condition(e.args[0], columns) | condition(e.args[1], columns)
    if e.op == "&&":
        return condition(e.args[0], columns) & condition(e.args[1], columns)
    if e.op == "!":
        return ~condition(e.args[0], columns)
    if e.op == "BOUND":
        if not isinstance(e.args[0], Var):
            raise QueryError("BOUND takes a variable")
        return _term(e.args[0], columns).isNotNull()
    if e.op in ("=", "!=", "<", ">", "<=", ">="):
        return _compare(e.op, *e.args, columns)
    if e.op == "SAMETERM":
        return _term(e.args[0], columns) == _term(e.args[1], columns)
    if e.op in ("ISIRI", "ISURI", "ISBLANK", "ISLITERAL"):
        return terms.kind(_term(e.args[0], columns)) == {"ISBLANK": "bnode", "ISLITERAL": "literal"}.get(e.op, "iri")
    if e.op == "REGEX":
        pattern, flags = e.args[1], e.args[2] if len(e.args) > 2 else '""'
        if not (isinstance(pattern, str) and isinstance(flags, str)):
            raise QueryError("REGEX takes a constant pattern")
        own = "".join(c for c in flags.strip('"') if c in "imsx")
        text = pattern[1 : pattern.rindex('"')].replace('\\"', '"').replace("\\\\", "\\")
        return _text(e.args[0], columns).rlike((f"(?{own})" if own else "") + text)
    if e.op in ("CONTAINS", "STRSTARTS", "STRENDS"):
        a, b = _text(e.args[0], columns), _text(e.args[1], columns)
        return {"CONTAINS": F.contains, "STRSTARTS": F.startswith, "STRENDS": F.endswith}[e.op](a, b)
    if e.op == "LANGMATCHES":
        a, b = F.lower(_text(e.args[0], columns)), F.lower(_text(e.args[1], columns))
        return F.when(b == "*", a != "").otherwise((a == b) | a.startswith(F.concat(b, F.lit("-"))))
    raise QueryError(f"{e.op} isn't a condition")


def _compare(op: str, a, b, columns: list[str]) -> Column:
    """Numbers by value, strings and date-times by their text, other terms by identity."""

    def apply(x: Column, y: Column) -> Column:
        return {"=": x == y, "!=": x != y, "<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op]

    x, y = _number(a, columns), _number(b, columns)
    if any(isinstance(z, Expr) and z.op in "+-*/" for z in (a, b)):
        return apply(x, y)
    s, t = _term(a, columns), _term(b, columns)
    whole = terms.integer(s).isNotNull() & terms.integer(t).isNotNull()
    exact = apply(terms.integer(s), terms.integer(t))  # doubles would take integers beyond 2^53 for equal
    numbers = x.isNotNull() & y.isNotNull()
    if op in ("=", "!="):
        return F.when(whole, exact).when(numbers, apply(x, y)).otherwise(apply(s, t))
    alike = terms.datatype(s).eqNullSafe(terms.datatype(t)) & terms.is_literal(s) & terms.datatype(s).isin(terms.XSD + "string", terms.XSD + "dateTime", terms.XSD + "date")
    return F.when(whole, exact).when(numbers, apply(x, y)).when(alike, apply(terms.lexical(s), terms.lexical(t)))
