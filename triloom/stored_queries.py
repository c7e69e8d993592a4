"""Queries over stored graphs, files, partitions and plans, and SQL or fixed rows that they must equal.

A stored graph is written once for a session and folder of tables, then read by all queries that name it.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.terms import RDF_TYPE
from .operators import dictionary, layout, partitioning
from .operators.shared import clustered, materialize, shared_dir
from .plans import query_graph
from .plans.distributed import partitioned_answer
from .plans.ordering import order
from .plans.sparql import Query, parse
from .sources import encoded, ntriples, rdfxml
from .sources.publications import publications, publications_sql
from .sources.sample import PREFIXES, PROLOGUE, QUERIES
from .sources.tables import BASE, GRAPH, TableGraph, mapping_sql
from .store import GraphStore

_RUNS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
_STORES: dict[tuple, GraphStore] = {}


def add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    _RUNS[name] = run
    if sql:
        _SQL[name] = sql


def values(columns: str, rows: list[tuple]) -> str:
    """SQL for fixed rows."""
    def text(x) -> str:
        return "true" if x is True else "false" if x is False else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) v({columns})"


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(spark: SparkSession, sf_dir: str, kind: str, graph: str = "tables") -> GraphStore:
    """The tables' graph or that of publications, saved as terms or ids."""
    key = (spark.conf.get("spark.app.id", ""), sf_dir, kind, graph)
    if key not in _STORES:
        source = GraphStore.from_tables(spark, sf_dir) if graph == "tables" else GraphStore.from_triples(publications(spark, sf_dir, once=False))
        _STORES[key] = source.save(fresh(spark, graph), encoded=kind == "ids")
    return _STORES[key]


def on_stores(name: str, text: str, sql: str | None) -> None:
    """A query over the tables' graph, from both stored forms."""
    for kind in ("terms", "ids"):
        add(f"{kind}_{name}", lambda spark, d, kind=kind: stored(spark, d, kind).sparql(text), sql)


# --- the benchmark's queries over publications --------------------------------------------------------

_PUB = f"WITH t AS MATERIALIZED (\n{publications_sql()})\n"
#: Queries whose rows are products or nearly so are counted.
_COUNTED = ("q4", "q4a", "q5", "q5a", "q6a", "q7", "q7a")


def count_sql(q: Query, body: Callable[[Query, str], str]) -> str:
    """The number of rows as a product of its components' numbers."""
    parts = [f"(SELECT CAST(count(*) AS BIGINT) FROM ({body(Query(sorted({v for p in c for v in p.variables()}), c, []), 't')}))" for c in query_graph.components(q.patterns)]
    return f"SELECT {' * '.join(parts)} AS bindings"


def _iri(prefix: str, name: str) -> str:
    return f"'<{PREFIXES[prefix]}{name}>'"


#: q8 in two steps, which keeps its self-joins in a good order.
_Q8_SQL = _PUB.rstrip() + f""", n AS (SELECT n.s, n.o FROM t n JOIN t y ON y.s = n.s WHERE n.p = {_iri('foaf', 'name')} AND y.p = {_iri('rdf', 'type')} AND y.o = {_iri('foaf', 'Person')} AND n.o LIKE '"Paul Erdoes"%'),
c AS MATERIALIZED (SELECT s, o FROM t WHERE p = {_iri('dc', 'creator')}),
a AS MATERIALIZED (SELECT d.o AS author FROM n JOIN c ON c.o = n.s JOIN c d ON d.s = c.s),
b AS MATERIALIZED (SELECT y.o AS author FROM a JOIN c x ON x.o = a.author JOIN c y ON y.s = x.s)
SELECT m.o AS name FROM b JOIN t m ON m.s = b.author AND m.p = {_iri('foaf', 'name')}"""


def add_publications(body: Callable[[Query, str], str]) -> None:
    for name, (text, _, _) in QUERIES.items():
        q = parse(PROLOGUE + text)
        for kind in ("terms", "ids"):
            if name in _COUNTED:
                add(f"pub_{kind}_{name}", lambda spark, d, kind=kind, text=text: stored(spark, d, kind, "publications").bindings_count(PROLOGUE + text), _PUB + count_sql(q, body))
            else:
                add(f"pub_{kind}_{name}", lambda spark, d, kind=kind, text=text: stored(spark, d, kind, "publications").sparql(PROLOGUE + text), _Q8_SQL if name == "q8" else _PUB + body(q, "t"))
    add("pub_triples", publications, _PUB + "SELECT s, p, o FROM t")
    for name in ("q3", "q8", "q11"):
        q = parse(PROLOGUE + QUERIES[name][0])
        add(f"pub_parts_{name}", lambda spark, d, q=q: _partitioned(spark, d, q), _Q8_SQL if name == "q8" else _PUB + body(q, "t"))


def _partitioned(spark: SparkSession, d: str, q: Query, hops: int = 2) -> DataFrame:
    """The query over 2-hop partitions of the publications that it reaches (the classes' hubs taken out)."""
    triples = publications(spark, d, once=False)
    wanted = [p.p for p in q.patterns if isinstance(p.p, str) and p.p != RDF_TYPE]
    if not any(not isinstance(p.p, str) for p in q.patterns):
        triples = triples.where(F.col("p").isin(wanted) | (F.col("p") == RDF_TYPE) & F.col("o").isin([p.o for p in q.patterns if isinstance(p.o, str)]))
    triples = materialize(triples, compression="zstd")
    parts = materialize(partitioning.assign_by_hash(triples.select(F.explode(F.array("s", "o")).alias("v")), 4))
    return partitioned_answer(partitioning.replicas(triples, parts, hops), q, hops)


# --- sources ------------------------------------------------------------------------------------------

_T = f"WITH t AS ({mapping_sql()})\n"
_SMALL = ("region", "nation", "customer")


def _graph(spark: SparkSession, d: str) -> DataFrame:
    return TableGraph(spark, d).triples()


def _nt_files(spark: SparkSession, d: str) -> DataFrame:
    """Files of N-Triples among comments and broken lines, read back: triples' lines, and the rejected ones."""
    path = fresh(spark, "nt")
    ntriples.write_ntriples(_graph(spark, d), path)
    nations = spark.read.parquet(f"{d}/nation.parquet")
    nations.select(F.explode(F.array(F.concat(F.lit("<a> <b> "), "n_name"), F.concat(F.lit("# "), "n_name"), F.lit("  "))).alias("value")).write.mode("append").text(path)
    triples, bad = ntriples.read_ntriples(spark, path)
    return ntriples.to_lines(triples).select(F.lit(True).alias("good"), F.col("value").alias("line")).union(bad.select(F.lit(False), "line"))


add("nt_files", _nt_files, _T + "SELECT true AS good, s || ' ' || p || ' ' || o || ' .' AS line FROM t UNION ALL SELECT false, '<a> <b> ' || n_name FROM nation")


def _rdfxml(spark: SparkSession, d: str) -> DataFrame:
    """Customers written as RDF/XML, a file for each nation, and read back."""
    c = spark.read.parquet(f"{d}/customer.parquet")
    ns = f"{BASE}/customer#"
    row = F.format_string(f'<c:customer rdf:about="{BASE}/customer/%d"><n:c_name rdf:datatype="http://www.w3.org/2001/XMLSchema#string">%s</n:c_name><n:c_nationkey rdf:resource="{BASE}/nation/%d"/></c:customer>', "c_custkey", "c_name", "c_nationkey")
    head = f'<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:c="{BASE}/class/" xmlns:n="{ns}">'
    files = c.groupBy("c_nationkey").agg(F.concat(F.lit(head), F.array_join(F.collect_list(row), ""), F.lit("</rdf:RDF>")).alias("value"))
    path = fresh(spark, "rdf")
    files.withColumnRenamed("c_nationkey", "file").write.partitionBy("file").text(path)
    return rdfxml.read_rdfxml(spark, f"{path}/*/*.txt")


add("rdfxml_files", _rdfxml, f"WITH t AS ({mapping_sql(('customer',))}) SELECT s, p, o FROM t WHERE p IN ('{RDF_TYPE}', '<{BASE}/customer#c_name>', '<{BASE}/customer#c_nationkey>')")


def add_encoded(terms: str, encode: Callable[[SparkSession, str], tuple[DataFrame, DataFrame]]) -> None:
    """terms: SQL that ends with relations t and dict."""
    ids = "SELECT CAST(a.id AS BIGINT) AS s, CAST(b.id AS BIGINT) AS p, CAST(c.id AS BIGINT) AS o FROM t JOIN dict a ON t.s = a.term AND a.role = 'vertex' JOIN dict b ON t.p = b.term AND b.role = 'predicate' JOIN dict c ON t.o = c.term AND c.role = 'vertex'"

    def text(spark: SparkSession, d: str) -> DataFrame:
        path = fresh(spark, "kv")
        encoded.write_encoded(encode(spark, d)[0], path)
        return encoded.read_encoded(spark, path)

    add("encoded_files", text, terms + ids)
    add("id_range_dump", lambda spark, d: encoded.id_range(text(spark, d), 100, 5000), terms + f"SELECT * FROM ({ids}) WHERE s BETWEEN 100 AND 5000")
    add("synthetic_iris", lambda spark, d: ntriples.synthetic_iris(encode(spark, d)[0]), terms + f"SELECT '<{ntriples.ID_BASE}' || s || '>' AS s, '<{ntriples.ID_BASE}' || p || '>' AS p, '<{ntriples.ID_BASE}' || o || '>' AS o FROM ({ids})")

    def stars(spark: SparkSession, d: str) -> DataFrame:
        triples = _graph(spark, d)
        found = dictionary.encode_stars(triples, materialize(dictionary.build_dictionary(triples)))
        return found.select("s", F.array_join(F.transform(F.array_sort("predobj"), lambda x: F.concat_ws(" ", x["p"].cast("string"), x["o"].cast("string"))), "|").alias("pairs"))

    add("encode_stars", stars, terms + f"SELECT s, string_agg(p || ' ' || o, '|' ORDER BY p, o) AS pairs FROM ({ids}) GROUP BY s")


_SHARED = _T + ", w AS (SELECT s AS term FROM t UNION SELECT p FROM t UNION SELECT o FROM t), d AS (SELECT term, CAST(row_number() OVER (ORDER BY sha1(term)) AS BIGINT) AS id FROM w) "


def _dictionary(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{stored(spark, d, 'ids').graph.path}/dictionary")


add("dict_stored", lambda spark, d: _dictionary(spark, d).select("term", "id"), _SHARED + "SELECT term, id FROM d")
add("dict_copied", lambda spark, d: dictionary.copy_dictionary(spark, f"{stored(spark, d, 'ids').graph.path}/dictionary", fresh(spark, "dictionary")).select("term", "id"), _SHARED + "SELECT term, id FROM d")
_CONSTANTS = [f"<{BASE}/nation/3>", RDF_TYPE, f"<{BASE}/customer/7>", f"<{BASE}/no/such>", f"<{BASE}/class/part>"]
add("const_ids", lambda spark, d: spark.createDataFrame(sorted(dictionary.look_up(_dictionary(spark, d), _CONSTANTS).items()), "term string, id long"), _SHARED + f"SELECT term, id FROM d WHERE term IN ({', '.join(repr(c) for c in _CONSTANTS)})")
for _kind in ("terms", "ids"):
    add(f"{_kind}_triples", lambda spark, d, kind=_kind: stored(spark, d, kind).triples().select("s", "p", "o"), _T + "SELECT s, p, o FROM t")

# --- layouts in files ---------------------------------------------------------------------------------


def _stars_stored(spark: SparkSession, d: str) -> DataFrame:
    path = fresh(spark, "stars")
    layout.star_rows(_graph(spark, d)).write.parquet(path)
    return layout.from_star(layout.read_stars(spark, path))


add("stars_stored", _stars_stored, _T + "SELECT s, p, o FROM t")


def _by_predicate(spark: SparkSession, d: str) -> DataFrame:
    """The layout by predicate: rows and pieces of each folder, read from the files."""
    path = fresh(spark, "vp")
    triples = _graph(spark, d)
    numbers = materialize(layout.number_predicates(triples))
    layout.write_by_predicate(triples, path, numbers)
    return spark.read.parquet(path).join(numbers.select("p", "pid"), "pid").select("s", "p", "o")


add("by_predicate_files", _by_predicate, _T + "SELECT s, p, o FROM t")


def _bucketed(spark: SparkSession, d: str) -> DataFrame:
    """A star's self-join on a bucketed table, which needs no shuffle."""
    table = f"triloom_bucketed_{uuid.uuid4().hex}"
    layout.write_bucketed(_graph(spark, d), table, 8)
    t = spark.table(table)
    a = t.where(F.col("p") == f"<{BASE}/customer#c_name>").select("s", F.col("o").alias("name"))
    b = t.where(F.col("p") == f"<{BASE}/customer#c_nationkey>").select("s", F.col("o").alias("nation"))
    return a.join(b.hint("merge"), "s")


add("bucketed_star", _bucketed, _T + f"SELECT a.s, a.o AS name, b.o AS nation FROM t a JOIN t b ON a.s = b.s WHERE a.p = '<{BASE}/customer#c_name>' AND b.p = '<{BASE}/customer#c_nationkey>'")


def _files_again(files: int) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        path = fresh(spark, "files")
        ntriples.repartition_files(ntriples.to_lines(TableGraph(spark, d, _SMALL).triples()), path, files)
        lines = spark.read.text(path).select("value", F.input_file_name().alias("file"))
        sizes = lines.groupBy("file").agg(F.count("*").alias("n"))
        return sizes.agg(F.count("*").alias("files"), F.sum("n").alias("lines"), (F.max("n") - F.min("n") <= 32).alias("even"))

    return run


_LINES = f"WITH t AS ({mapping_sql(_SMALL)}) SELECT CAST(%d AS BIGINT) AS files, CAST(count(*) AS BIGINT) AS lines, true AS even FROM t"
add("files_merged", _files_again(1), _LINES % 1)
add("files_split", _files_again(5), _LINES % 5)
add("literal_flags", lambda spark, d: ntriples.with_literal_flag(_graph(spark, d)), _T + "SELECT s, p, o, o LIKE '\"%' AS is_literal FROM t")

# --- partitions in files ------------------------------------------------------------------------------

_PART = "CAST(CAST('0x' || substr(sha1(v), 1, 6) AS BIGINT) % 4 AS INTEGER)"
_PARTS = _T + f", vp AS (SELECT v, {_PART} AS part FROM (SELECT DISTINCT s AS v FROM t)) "


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d).select(F.col("s").alias("v")).distinct().select("v", (F.conv(F.substring(F.sha1("v"), 1, 6), 16, 10).cast("long") % 4).cast("int").alias("part"))


def _part_stars(spark: SparkSession, d: str) -> DataFrame:
    path = fresh(spark, "part-stars")
    layout.write_partitioned_stars(_graph(spark, d), _parts(spark, d), path)
    found = layout.read_stars(spark, path)
    return found.select("part", "s", F.explode("predobj").alias("x")).select("s", "x.p", "x.o", F.col("part").cast("int").alias("part"))


def _part_lines(spark: SparkSession, d: str) -> DataFrame:
    path = fresh(spark, "part-nt")
    ntriples.write_ntriples(partitioning.part_triples(_graph(spark, d), _parts(spark, d)), path, by_partition=True)
    return spark.read.text(path).select("value", F.col("part").cast("int").alias("part"))


add("part_stars_stored", _part_stars, _PARTS + "SELECT s, p, o, part FROM t JOIN vp ON s = v")
add("part_nt_files", _part_lines, _PARTS + "SELECT s || ' ' || p || ' ' || o || ' .' AS value, part FROM t JOIN vp ON s = v")
_ADJ = _T + f", u AS (SELECT s, o FROM t WHERE p <> '{RDF_TYPE}'), e AS (SELECT s AS v, o AS w FROM u UNION ALL SELECT o, s FROM u), ids AS (SELECT v, CAST(row_number() OVER (ORDER BY v) AS BIGINT) AS id FROM (SELECT DISTINCT v FROM e)), dense AS (SELECT a.id AS v, b.id AS w FROM e JOIN ids a ON e.v = a.v JOIN ids b ON e.w = b.v) "


def _dense(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    adj, ids = partitioning.renumber(partitioning.adjacency(partitioning.split_typed(_graph(spark, d))[1]))
    return materialize(adj.select("v", F.array_sort("neighbours").alias("neighbours"))), ids


def _zipped(spark: SparkSession, d: str) -> DataFrame:
    """Vertices and neighbour lists as two files, zipped again by their lines."""
    adj, _ = _dense(spark, d)
    vertices, lists = partitioning.vertices_and_neighbours(adj)
    numbered = vertices.select("v", F.col("v").alias("line"))  # dense ids are line numbers
    return numbered.join(lists.withColumnRenamed("line", "neighbours"), "v").select("v", "neighbours")


def _zip_parts(spark: SparkSession, d: str) -> DataFrame:
    """The vertices' file and an assignment's file, which has nothing but a part on each line."""
    _, ids = _dense(spark, d)
    vertices = ids.select(F.col("id").alias("line"), "v")
    parts = ids.select(F.col("id").alias("line"), (F.col("id") % 3).alias("part"))
    return partitioning.zip_assignment(vertices, parts)


add("dense_adjacency", _zipped, _ADJ + "SELECT v, string_agg(CAST(w AS VARCHAR), ' ' ORDER BY w) AS neighbours FROM dense GROUP BY v")
add("dense_ids_of_vertices", lambda spark, d: _dense(spark, d)[1].select("v", "id"), _ADJ + "SELECT v, id FROM ids")
add("zip_assignment", _zip_parts, _ADJ + "SELECT v, CAST(id % 3 AS INTEGER) AS part FROM ids")


def _restored(spark: SparkSession, d: str) -> DataFrame:
    adj, ids = _dense(spark, d)
    return partitioning.restore(adj.select("v", F.size("neighbours").cast("long").alias("degree")), ids)


add("unwrap_ids", _restored, _ADJ + "SELECT v, count(*) AS degree FROM e GROUP BY v")


def _cuts(spark: SparkSession, d: str) -> DataFrame:
    """Label propagation against the hash assignment: all vertices once, sizes within the slack, fewer edges cut."""
    untyped = partitioning.split_typed(_graph(spark, d))[1]
    both = untyped.select("s", "o").union(untyped.select("o", "s")).toDF("v", "w")
    with clustered(both, "w") as edges:
        vertices = materialize(edges.select(F.col("w").alias("v")).distinct())
        near = partitioning.assign_by_edges(edges, vertices, 4, 6)
        parts = materialize(partitioning.assign_by_hash(vertices, 4).withColumnRenamed("part", "hash").join(near.withColumnRenamed("part", "near"), "v"))
        ends = edges.join(parts.select(F.col("v").alias("w"), F.struct("hash", "near").alias("b")), "w").join(parts.select("v", F.struct("hash", "near").alias("a")), "v")
        cut = materialize(ends.agg(*[F.count_if(F.col(f"a.{way}") != F.col(f"b.{way}")).alias(way) for way in ("hash", "near")]))
    size = partitioning.vertices_by_part(parts.withColumnRenamed("near", "part")).agg(F.sum("vertices").alias("vertices"), (F.max("vertices") <= 1.2 * F.sum("vertices") / 4).alias("balanced"))
    return size.crossJoin(cut).select("vertices", "balanced", (F.col("near") < 0.9 * F.col("hash")).alias("cuts_fewer"))  # one row each


add("part_propagate", _cuts, _ADJ + "SELECT CAST(count(*) AS BIGINT) AS vertices, true AS balanced, true AS cuts_fewer FROM ids")

# --- planning -----------------------------------------------------------------------------------------


def _plans(rows: Callable[[str, Query], list[tuple]], schema: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: spark.createDataFrame([r for name, (text, _, _) in QUERIES.items() for r in rows(name, parse(PROLOGUE + text))], schema)


def _fixed(text: str) -> list[tuple]:
    """Rows of words: numbers and true or false as what they say."""
    def word(x: str):
        return int(x) if x.lstrip("-").isdigit() else {"true": True, "false": False}.get(x, x)

    return [tuple(word(x) for x in line.split()) for line in text.strip().splitlines()]


# the rows below were worked out by hand from the queries' graphs
_LOCAL = "q1 1 true\nq2 1 true\nq3 1 true\nq4 3 false\nq4a 3 false\nq5 -1 false\nq5a 3 false\nq6 2 true\nq6a 3 false\nq7 -1 false\nq7a 4 false\nq8 3 false\nq11 1 true"
_SHAPES = "q1 1 1\nq2 1 1\nq3 1 1\nq4 2 4\nq4a 1 4\nq5 3 5\nq5a 1 4\nq6 1 3\nq6a 1 5\nq7 2 5\nq7a 1 11\nq8 1 4\nq11 1 1"
_SPLITS = "q1 6\nq2 10\nq3 3\nq4 6,1,1\nq4a 6,1,1\nq5 3,3,1\nq5a 5,1,1\nq6 5\nq6a 7,2\nq7 5,1\nq7a 7,5,2,1\nq8 5,2\nq11 2"
_CUTS = """
q1 ?journal
q2 ?inproc
q3 ?article
q4 ?article1,?article2,?author1,?author2
q4a ?article1,?article2,?author1,?author2,?journal
q5 ?article,?inproc,?person1,?person2
q5a ?article,?inproc,?name,?person,?person2
q6 ?author,?class,?document
q6a ?author1,?class,?class2,?document,?document2
q7 ?bag2,?class,?doc
q7a ?bag2,?bag3,?bag4,?class,?class3,?class4,?doc,?doc3,?doc4,?object
q8 ?author,?author2,?document,?document2,?erdoes
q11 ?publication
"""
_KINDS = """
q1 SUB_SUB 15
q2 SUB_SUB 45
q3 SUB_SUB 3
q4 OBJ_SUB 2
q4 SUB_SUB 6
q4a OBJ_OBJ 1
q4a OBJ_SUB 2
q4a SUB_SUB 6
q5 OBJ_SUB 2
q5 SUB_SUB 2
q5a OBJ_OBJ 1
q5a OBJ_SUB 3
q5a SUB_SUB 3
q6 OBJ_SUB 1
q6 SUB_OBJ 1
q6 SUB_SUB 3
q6a OBJ_OBJ 1
q6a OBJ_SUB 1
q6a SUB_OBJ 3
q6a SUB_SUB 6
q7 SUB_OBJ 4
q7 SUB_SUB 1
q7a OBJ_OBJ 2
q7a OBJ_SUB 3
q7a SUB_OBJ 10
q7a SUB_SUB 4
q8 OBJ_OBJ 1
q8 OBJ_SUB 1
q8 SUB_OBJ 2
q8 SUB_SUB 3
q11 SUB_SUB 1
"""
_STARS = """
q4 ?article1 star 3 author1>?author1
q4 ?article2 star 3 author2>?author2
q4 ?author1 triple 1 -
q4 ?author2 triple 1 -
q7 ?class triple 1 -
q7 ?doc star 2 class>?class
q7 ?bag2 pipeline 1 doc>?doc
q7 ?doc2 pipeline 1 bag2>?bag2
q7 ?subject triple 1 -
q8 ?erdoes star 2 -
q8 ?document star 2 erdoes>?erdoes,author=?document2
q8 ?document2 star 2 author2>?author2
q8 ?author2 triple 1 -
q11 ?publication star 2 -
"""


def _where(name: str, q: Query) -> list[tuple]:
    x = query_graph.locality(q.patterns)
    return [(name, -1 if x.radius is None else x.radius, x.answerable(2))]


def _stars(name: str, q: Query) -> list[tuple]:
    if name not in ("q4", "q7", "q8", "q11"):
        return []
    sign = {query_graph.Connection.OBJ_SUB: ">", query_graph.Connection.OBJ_OBJ: "="}
    return [(name, s.subject, s.kind, len(s.patterns), ",".join(f"{v}{sign[k]}{b}" for v, k, b in sorted(s.links, key=lambda x: x[1] is query_graph.Connection.OBJ_OBJ)) or "-") for s in query_graph.decompose(q.patterns)]


def _connections(name: str, q: Query) -> list[tuple]:
    found = Counter(k.name for a, b in combinations(q.patterns, 2) for _, k in query_graph.connections(a, b))
    return [(name, k, n) for k, n in found.items()]


add("plan_pwoc", _plans(_where, "query string, radius int, local boolean"), values("query, radius, local", _fixed(_LOCAL)))
add("plan_components", _plans(lambda n, q: [(n, len(query_graph.components(q.patterns)), len(query_graph.decompose(q.patterns)))], "query string, components int, stars int"), values("query, components, stars", _fixed(_SHAPES)))
add("plan_split", _plans(lambda n, q: [(n, ",".join(str(len(s.patterns)) for s in query_graph.split(q, 2)))], "query string, patterns string"), values("query, patterns", [tuple(x.split()) for x in _SPLITS.splitlines()]))
add("plan_articulations", _plans(lambda n, q: [(n, ",".join(sorted(query_graph.articulation_points(q.patterns))))], "query string, vertices string"), values("query, vertices", _fixed(_CUTS)))
add("plan_connections", _plans(_connections, "query string, connection string, pairs int"), values("query, connection, pairs", _fixed(_KINDS)))
add("plan_stars", _plans(_stars, "query string, subject string, kind string, patterns int, links string"), values("query, subject, kind, patterns, links", _fixed(_STARS)))
_Q8 = parse(PROLOGUE + QUERIES["q8"][0])


def _far(spark: SparkSession, d: str) -> DataFrame:
    """q8's distances to the farthest vertex, freely and where paths may not pass the authors (vertices of high degree)."""
    rows = [(way, v, -1 if n is None else n) for way, stops in (("free", frozenset()), ("stopped", frozenset({"?author"}))) for v, n in query_graph.edge_distances(_Q8.patterns, stops).items() if v.startswith("?")]
    return spark.createDataFrame(rows, "way string, vertex string, distance int")


add("plan_distances", _far, values("way, vertex, distance", _fixed("free ?erdoes 5\nfree ?document 4\nfree ?author 3\nfree ?document2 4\nfree ?author2 5\nfree ?name 6\nstopped ?erdoes -1\nstopped ?document -1\nstopped ?author 3\nstopped ?document2 -1\nstopped ?author2 -1\nstopped ?name -1")))
#: One constant in two patterns doesn't connect them; a variable does.
_TWICE = {"constants": "SELECT ?a ?b { ?a <p> <k> . ?b <q> <k> }", "variable": "SELECT ?a ?b { ?a <p> ?k . ?b <q> ?k }"}
add("plan_constants", lambda spark, d: spark.createDataFrame([(n, len(query_graph.components(parse(t).patterns))) for n, t in _TWICE.items()], "query string, components int"), values("query, components", [("constants", 2), ("variable", 1)]))


def add_orders(prefixes: str, pipe: str) -> None:
    """The join order of a chain by the stored graph's statistics: the smallest relation first."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        graph = stored(spark, d, "terms").graph
        return spark.createDataFrame([(i, str(p.p)) for i, p in enumerate(order(parse(prefixes + pipe).patterns, graph.selectivity))], "place int, predicate string")

    add("plan_order", run, values("place, predicate", [(0, f"<{BASE}/region#r_name>"), (1, f"<{BASE}/nation#n_regionkey>"), (2, f"<{BASE}/customer#c_nationkey>"), (3, f"<{BASE}/orders#o_custkey>")]))


def add_filters(prefixes: str, sql: str) -> None:
    """A filter goes to the sub-query that has all its variables; the answer is joined from partitions' answers."""
    text = prefixes + "SELECT ?o ?name { ?o orders:o_custkey ?c . ?c customer:c_nationkey ?n . ?n nation:n_name ?name . ?n nation:n_regionkey ?r . ?r region:r_name ?rn FILTER(regex(str(?name), \"[13579]$\")) }"
    q = parse(text)

    def split_filters(spark: SparkSession, d: str) -> DataFrame:
        return spark.createDataFrame([(len(s.patterns), len(s.filters)) for s in query_graph.split(q, 1)], "patterns int, filters int")

    def answers(spark: SparkSession, d: str) -> DataFrame:
        wanted = [p.p for p in q.patterns]
        triples = materialize(_graph(spark, d).where(F.col("p").isin(wanted)))
        parts = materialize(partitioning.assign_by_hash(triples.select(F.explode(F.array("s", "o")).alias("v")), 4))
        return partitioned_answer(partitioning.replicas(triples, parts, 1), q, 1)

    add("plan_filters", split_filters, values("patterns, filters", [(3, 1), (1, 0), (1, 0)]))
    add("split_answer", answers, sql)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_RUNS)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


__all__ = ["GRAPH", "add_encoded", "add_filters", "add_orders", "add_publications", "on_stores", "oracle_sql", "queries", "stored", "values"]
