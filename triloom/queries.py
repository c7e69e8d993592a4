"""The registered queries of the graph engine, and SQL that gives the same rows from the tables.

Queries over tables with keys are held against plain relational SQL where it is easy to write, else against self-joins
of a relation of all triples.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import stored_queries
from .functions.terms import RDF_TYPE, XSD
from .operators import dictionary, layout, partitioning, statistics
from .operators.shared import materialize
from .plans.distributed import partitioned_answer
from .plans.sparql import Query, Var, parse
from .sources import ntriples
from .sources.generator import synthetic_triples
from .sources.sample import NTRIPLES, PROLOGUE, QUERIES
from .sources.tables import BASE, GRAPH, TableGraph, mapping_sql
from .store import GraphStore

PREFIXES = "".join(f"PREFIX {t}: <{BASE}/{t}#> " for t in GRAPH) + f"PREFIX class: <{BASE}/class/> PREFIX xsd: <{XSD}> "
_RUNS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
_TEXTS: dict[str, str] = {}


def _add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    _RUNS[name] = run
    if sql:
        _SQL[name] = sql


def query_sql(q: Query, relation: str) -> str:
    """Self-joins of a relation (s, p, o) for a query's patterns; filters aside."""
    tables, conditions, where = [], [], {}
    for i, pattern in enumerate(q.patterns):
        tables.append(f"{relation} x{i}")
        for c, t in (("s", pattern.s), ("p", pattern.p), ("o", pattern.o)):
            if isinstance(t, Var):
                if t.name in where:
                    conditions.append(f"x{i}.{c} = {where[t.name]}")
                else:
                    where[t.name] = f"x{i}.{c}"
            else:
                quoted = t.replace("'", "''")
                conditions.append(f"x{i}.{c} = '{quoted}'")
    columns = ", ".join(f"{where.get(v, 'CAST(NULL AS VARCHAR)')} AS {v}" for v in q.select)
    return f"SELECT {'DISTINCT ' * q.distinct}{columns} FROM {', '.join(tables)}" + (" WHERE " + " AND ".join(conditions) if conditions else "")


_ALL = f"WITH t AS ({mapping_sql()})\n"


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TableGraph(spark, sf_dir).triples()


def _sparql(name: str, text: str, sql: str | None = None) -> None:
    """A query over the tables' graph; without sql it is held against self-joins of all triples."""
    _TEXTS[name] = text
    _add(name, lambda spark, sf_dir: GraphStore.from_tables(spark, sf_dir).sparql(PREFIXES + text), sql or _ALL + query_sql(parse(PREFIXES + text), "t"))


def _iri(table: str, column: str) -> str:
    return f"'<{BASE}/{table}/' || {column} || '>'"


def _lit(column: str, kind: str = "string") -> str:
    return f"'\"' || CAST({column} AS VARCHAR) || '\"^^<{XSD}{kind}>'"


# --- patterns, stars, pipelines -----------------------------------------------------------------------

_add("map_triples", _graph, _ALL + "SELECT s, p, o FROM t")
_sparql("pat_vvv", "SELECT ?s ?p ?o { ?s ?p ?o }")
_sparql("pat_vcv", "SELECT ?s ?o { ?s orders:o_orderpriority ?o }", f"SELECT {_iri('orders', 'o_orderkey')} AS s, {_lit('o_orderpriority')} AS o FROM orders")
_sparql("pat_vcc", 'SELECT ?s { ?s customer:c_mktsegment "BUILDING"^^xsd:string }', f"SELECT {_iri('customer', 'c_custkey')} AS s FROM customer WHERE c_mktsegment = 'BUILDING'")
_sparql("pat_vvc", f"SELECT ?s ?p {{ ?s ?p <{BASE}/nation/3> }}")
_sparql("pat_cvv", f"SELECT ?p ?o {{ <{BASE}/customer/7> ?p ?o }}")
_sparql("pat_ccv", f"SELECT ?o {{ <{BASE}/customer/7> customer:c_nationkey ?o }}", f"SELECT {_iri('nation', 'c_nationkey')} AS o FROM customer WHERE c_custkey = 7")
_sparql("pat_cvc", f"SELECT ?p {{ <{BASE}/customer/7> ?p class:customer }}")
_sparql("pat_ccc", f"SELECT ?n {{ <{BASE}/customer/7> a class:customer . <{BASE}/nation/3> nation:n_name ?n }}", f"SELECT {_lit('n_name')} AS n FROM nation WHERE n_nationkey = 3 AND EXISTS (SELECT 1 FROM customer WHERE c_custkey = 7)")
_sparql("pat_unknown_const", 'SELECT ?s ?n { ?s customer:c_mktsegment "NO SUCH"^^xsd:string ; customer:c_nationkey ?n }')
_sparql("star_2", 'SELECT ?c ?n { ?c customer:c_mktsegment "BUILDING"^^xsd:string ; customer:c_nationkey ?n }', f"SELECT {_iri('customer', 'c_custkey')} AS c, {_iri('nation', 'c_nationkey')} AS n FROM customer WHERE c_mktsegment = 'BUILDING'")
_sparql("star_5", "SELECT ?c ?name ?n ?b ?m { ?c a class:customer ; customer:c_name ?name ; customer:c_nationkey ?n ; customer:c_acctbal ?b ; customer:c_mktsegment ?m }", f"SELECT {_iri('customer', 'c_custkey')} AS c, {_lit('c_name')} AS name, {_iri('nation', 'c_nationkey')} AS n, {_lit('c_acctbal', 'double')} AS b, {_lit('c_mktsegment')} AS m FROM customer")
_VARPRED = f"WITH t AS ({mapping_sql(('customer',))}) SELECT s AS c, p, o AS v FROM t WHERE s IN (SELECT {_iri('customer', 'c_custkey')} FROM customer WHERE c_mktsegment = 'MACHINERY')"
_sparql("star_varpred", 'SELECT ?c ?p ?v { ?c customer:c_mktsegment "MACHINERY"^^xsd:string . ?c ?p ?v }', _VARPRED)
_sparql("pipe_2", "SELECT ?o ?c ?n { ?o orders:o_custkey ?c . ?c customer:c_nationkey ?n }", f"SELECT {_iri('orders', 'o_orderkey')} AS o, {_iri('customer', 'o_custkey')} AS c, {_iri('nation', 'c_nationkey')} AS n FROM orders JOIN customer ON o_custkey = c_custkey")
_sparql("pipe_4", "SELECT ?o ?r { ?o orders:o_custkey ?c . ?c customer:c_nationkey ?n . ?n nation:n_regionkey ?k . ?k region:r_name ?r }", f"SELECT {_iri('orders', 'o_orderkey')} AS o, {_lit('r_name')} AS r FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
_sparql("oo_join", "SELECT ?c ?s { ?c customer:c_nationkey ?n . ?s supplier:s_nationkey ?n }", f"SELECT {_iri('customer', 'c_custkey')} AS c, {_iri('supplier', 's_suppkey')} AS s FROM customer JOIN supplier ON c_nationkey = s_nationkey")
SNOWFLAKE = "SELECT ?o ?n { ?o a class:orders . ?o orders:o_custkey ?c . ?c customer:c_nationkey ?nk . ?nk nation:n_name ?n }"
_sparql("snowflake", SNOWFLAKE, f"SELECT {_iri('orders', 'o_orderkey')} AS o, {_lit('n_name')} AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
_sparql("cart_components", "SELECT ?a ?b { ?r region:r_name ?a . ?n nation:n_name ?b }", f"SELECT {_lit('r_name')} AS a, {_lit('n_name')} AS b FROM region, nation")
_sparql("unbound_select", "SELECT ?n ?nothing { ?x nation:n_name ?n }", f"SELECT {_lit('n_name')} AS n, CAST(NULL AS VARCHAR) AS nothing FROM nation")
_sparql("filter_num", "SELECT ?c ?b { ?c customer:c_acctbal ?b FILTER (?b > 5000 && ?b <= 6000.5) }", f"SELECT {_iri('customer', 'c_custkey')} AS c, {_lit('c_acctbal', 'double')} AS b FROM customer WHERE c_acctbal > 5000 AND c_acctbal <= 6000.5")
_sparql("filter_bool", 'SELECT ?c ?m ?b { ?c customer:c_mktsegment ?m ; customer:c_acctbal ?b . FILTER (bound(?c) && (?m = "BUILDING"^^xsd:string || !(?b + 10 >= 0))) FILTER (!bound(?zzz)) }', f"SELECT {_iri('customer', 'c_custkey')} AS c, {_lit('c_mktsegment')} AS m, {_lit('c_acctbal', 'double')} AS b FROM customer WHERE c_mktsegment = 'BUILDING' OR c_acctbal + 10 < 0")
_sparql("filter_text", 'SELECT ?p ?b { ?p part:p_brand ?b . ?p part:p_type ?t FILTER (regex(str(?t), "^[a-s]", "i") && !contains(str(?b), "3")) }', f"SELECT {_iri('part', 'p_partkey')} AS p, {_lit('p_brand')} AS b FROM part WHERE regexp_matches(p_type, '^[a-s]', 'i') AND NOT contains(p_brand, '3')")
_sparql("distinct_proj", "SELECT DISTINCT ?m ?n { ?c customer:c_mktsegment ?m ; customer:c_nationkey ?n }", f"SELECT DISTINCT {_lit('c_mktsegment')} AS m, {_iri('nation', 'c_nationkey')} AS n FROM customer")
_sparql("semi_join", "SELECT DISTINCT ?c { ?o orders:o_custkey ?c . ?c a class:customer }", f"SELECT DISTINCT {_iri('customer', 'o_custkey')} AS c FROM orders")


def _intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = GraphStore.from_tables(spark, sf_dir)
    return g.sparql(PREFIXES + "SELECT ?n { ?c customer:c_nationkey ?n }").intersect(g.sparql(PREFIXES + "SELECT ?n { ?s supplier:s_nationkey ?n }"))


_add("semi_join_intersect", _intersection, f"SELECT {_iri('nation', 'c_nationkey')} AS n FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)")


def _orders_graph(spark: SparkSession, sf_dir: str) -> GraphStore:
    """Orders with their parts and suppliers (many of each), and what suppliers supply."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")

    def term(table: str, column: str):
        return F.concat(F.lit(f"<{BASE}/{table}/"), F.col(column).cast("string"), F.lit(">"))

    o, p, s = term("orders", "l_orderkey"), term("part", "l_partkey"), term("supplier", "l_suppkey")
    # a union rather than exploded rows: a pattern's predicate then leaves one branch of it to read
    edges = [lines.select(a.alias("s"), F.lit(f"<{BASE}/{name}>").alias("p"), b.alias("o")) for a, name, b in ((o, "has_part", p), (o, "has_supplier", s), (s, "supplies", p))]
    return GraphStore.from_triples(edges[0].union(edges[1]).union(edges[2]))


def _supplied(spark: SparkSession, sf_dir: str) -> GraphStore:
    """Suppliers and parts as nodes of one kind, so that some supply themselves."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    s, o = (F.concat(F.lit(f"<{BASE}/node/"), F.col(c).cast("string"), F.lit(">")) for c in ("l_suppkey", "l_partkey"))
    return GraphStore.from_triples(lines.select(s.alias("s"), F.lit(f"<{BASE}/supplies>").alias("p"), o.alias("o")))


_add("pat_repeated_var", lambda spark, d: _supplied(spark, d).sparql("SELECT ?x ?p { ?x ?p ?x }"), f"SELECT DISTINCT {_iri('node', 'l_suppkey')} AS x, '<{BASE}/supplies>' AS p FROM lineitem WHERE l_suppkey = l_partkey")
_LINES = "WITH op AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), os AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), sp AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) "
_MULTI = f"SELECT ?o ?p ?s {{ ?o <{BASE}/has_part> ?p . ?o <{BASE}/has_supplier> ?s "
_add("star_multivalue", lambda spark, d: _orders_graph(spark, d).sparql(_MULTI + "}"), _LINES + f"SELECT {_iri('orders', 'op.l_orderkey')} AS o, {_iri('part', 'l_partkey')} AS p, {_iri('supplier', 'l_suppkey')} AS s FROM op JOIN os ON op.l_orderkey = os.l_orderkey")
_add("both_var_join", lambda spark, d: _orders_graph(spark, d).sparql(_MULTI + f". ?s <{BASE}/supplies> ?p }}"), _LINES + f"SELECT {_iri('orders', 'op.l_orderkey')} AS o, {_iri('part', 'op.l_partkey')} AS p, {_iri('supplier', 'os.l_suppkey')} AS s FROM op JOIN os ON op.l_orderkey = os.l_orderkey JOIN sp ON sp.l_suppkey = os.l_suppkey AND sp.l_partkey = op.l_partkey")
_add("cycle_3", lambda spark, d: _orders_graph(spark, d).sparql(f"SELECT ?p ?s {{ ?s <{BASE}/supplies> ?p . ?o <{BASE}/has_part> ?p . ?o <{BASE}/has_supplier> ?s }}"), _LINES + f"SELECT {_iri('part', 'op.l_partkey')} AS p, {_iri('supplier', 'os.l_suppkey')} AS s FROM op JOIN os ON op.l_orderkey = os.l_orderkey JOIN sp ON sp.l_suppkey = os.l_suppkey AND sp.l_partkey = op.l_partkey")
_TABLES = GRAPH + ("events", "documents", "labels", "conversations")
_add("map_all_tables", lambda spark, d: TableGraph(spark, d, _TABLES).triples().groupBy("p").agg(F.count("*").alias("triples"), F.count_distinct("s", "o").alias("pairs")), f"WITH t AS ({mapping_sql(_TABLES)}) SELECT p, count(*) AS triples, count(DISTINCT s || ' ' || o) AS pairs FROM t GROUP BY p")


def _sample(spark: SparkSession) -> GraphStore:
    lines = spark.createDataFrame([(x,) for x in NTRIPLES.strip().split("\n")], "value string")
    return GraphStore.from_triples(ntriples.parse_lines(lines)[0])


def _sample_sql() -> str:
    import re

    rows = [re.match(ntriples.LINE, x).groups() for x in NTRIPLES.strip().split("\n")]
    return "WITH t AS (SELECT * FROM (VALUES " + ", ".join("('" + "', '".join(x.replace("'", "''") for x in r) + "')" for r in rows) + ") v(s, p, o))\n"


for _name, (_text, _, _) in QUERIES.items():
    _add(f"bench_{_name}", lambda spark, d, text=_text: _sample(spark).sparql(PROLOGUE + text), _sample_sql() + query_sql(parse(PROLOGUE + _text), "t"))

# --- dictionary ---------------------------------------------------------------------------------------

_TERMS = _ALL + f""", uses AS (SELECT s AS term, 'vertex' AS role, 1 AS flag FROM t UNION ALL SELECT p, 'predicate', 1 FROM t UNION ALL SELECT o, 'vertex', CASE WHEN p = '{RDF_TYPE}' THEN -1 ELSE 1 END FROM t),
terms AS (SELECT term, role, max(flag) AS flag, sha1(term) AS digest, CASE WHEN term LIKE '<%' THEN 'iri' WHEN term LIKE '\\_:%' ESCAPE '\\' THEN 'bnode' ELSE 'literal' END AS kind FROM uses GROUP BY term, role),
dict AS (SELECT *, CASE WHEN role = 'predicate' AND term = '{RDF_TYPE}' THEN 2 WHEN role = 'predicate' THEN 9 + row_number() OVER (PARTITION BY role, term = '{RDF_TYPE}' ORDER BY digest) ELSE flag * row_number() OVER (PARTITION BY role, flag ORDER BY digest) END AS id FROM terms) """
_add("dict_terms", lambda spark, d: dictionary.unique_terms(_graph(spark, d)), _TERMS + "SELECT term, role, flag, digest, kind FROM terms")
_add("dict_ids", lambda spark, d: dictionary.build_dictionary(_graph(spark, d)).select("term", "role", "id"), _TERMS + "SELECT term, role, CAST(id AS BIGINT) AS id FROM dict")


def _encoded(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    triples = _graph(spark, d)
    ids = materialize(dictionary.build_dictionary(triples))
    return dictionary.encode(triples, ids), ids


_add("encode_triples", lambda spark, d: _encoded(spark, d)[0], _TERMS + "SELECT CAST(a.id AS BIGINT) AS s, CAST(b.id AS BIGINT) AS p, CAST(c.id AS BIGINT) AS o FROM t JOIN dict a ON t.s = a.term AND a.role = 'vertex' JOIN dict b ON t.p = b.term AND b.role = 'predicate' JOIN dict c ON t.o = c.term AND c.role = 'vertex'")
_add("decode_roundtrip", lambda spark, d: dictionary.decode(*_encoded(spark, d)), _ALL + "SELECT s, p, o FROM t")
_add("missing_terms", lambda spark, d: dictionary.missing_terms(_graph(spark, d), dictionary.unique_terms(TableGraph(spark, d, ("region", "nation", "customer")).triples())), _ALL + f", k AS ({mapping_sql(('region', 'nation', 'customer'))}), a AS (SELECT s AS term, 'vertex' AS role FROM t UNION SELECT p, 'predicate' FROM t UNION SELECT o, 'vertex' FROM t), b AS (SELECT s AS term, 'vertex' AS role FROM k UNION SELECT p, 'predicate' FROM k UNION SELECT o, 'vertex' FROM k) SELECT * FROM a EXCEPT SELECT * FROM b")
_add("class_only_terms", lambda spark, d: dictionary.class_only_terms(dictionary.unique_terms(_graph(spark, d))), _TERMS + "SELECT count(*) AS class_terms FROM terms WHERE role = 'vertex' AND flag = -1")
_add("ntriples_roundtrip", lambda spark, d: ntriples.parse_lines(ntriples.to_lines(_graph(spark, d)))[0], _ALL + "SELECT s, p, o FROM t")
_add("synthetic", lambda spark, d: synthetic_triples(spark, 10_000).groupBy(F.col("s").startswith("<http://synthetic.local/star").alias("star")).agg(F.count("*").alias("triples"), F.count_distinct(F.when(F.col("s").startswith("<http://synthetic.local/star"), F.col("s"))).alias("stars"), (F.count_distinct("p") <= 500).alias("few_predicates")), "SELECT true AS star, 2000::BIGINT AS triples, 200::BIGINT AS stars, true AS few_predicates UNION ALL SELECT false, 8000, 0, true")

# --- layouts and statistics ---------------------------------------------------------------------------

_PAIRS = "string_agg(p || ' ' || o, '|' ORDER BY p || ' ' || o)"
_add("star_docs", lambda spark, d: layout.star_rows(_graph(spark, d)).select("s", F.array_join(F.array_sort(F.transform("predobj", lambda x: F.concat_ws(" ", x["p"], x["o"]))), "|").alias("pairs")), _ALL + f"SELECT s, {_PAIRS} AS pairs FROM t GROUP BY s")
_add("star_triple_count", lambda spark, d: layout.star_triple_count(layout.star_rows(_graph(spark, d))), _ALL + "SELECT count(*) AS triples FROM t")
_SEGMENT = (f"<{BASE}/customer#c_mktsegment>", f'"BUILDING"^^<{XSD}string>')
_add("star_match_count", lambda spark, d: layout.match_count(layout.star_rows(_graph(spark, d)), [_SEGMENT, (f"<{BASE}/customer#c_nationkey>", None)]), "SELECT CAST(5 * count(*) AS BIGINT) AS results FROM customer WHERE c_mktsegment = 'BUILDING'")
_add("pred_selectivity", lambda spark, d: statistics.predicate_selectivity(_graph(spark, d)), _ALL + "SELECT p, count(DISTINCT s) AS subjects FROM t GROUP BY p")
_add("distinct_preds", lambda spark, d: statistics.distinct_predicates(_graph(spark, d)), _ALL + "SELECT DISTINCT p FROM t")
_DEGREE = _ALL + f", ends AS (SELECT s AS v, p FROM t UNION ALL SELECT o, p FROM t), deg AS (SELECT v, count(*) AS degree FROM ends GROUP BY v HAVING max(CASE WHEN p = '{RDF_TYPE}' THEN 1 ELSE 0 END) = 1), st AS (SELECT count(*) AS n, sum(degree) AS total, CAST(floor(sum(degree) / count(*)::DOUBLE + 0.5) AS BIGINT) AS average FROM deg), sg AS (SELECT CAST(floor(sqrt(sum((degree - average) * (degree - average)) / max(n)::DOUBLE) + 0.5) AS BIGINT) AS sigma FROM deg, st) "
_add("vertex_degree", lambda spark, d: statistics.vertex_degrees(_graph(spark, d)), _DEGREE + "SELECT v, degree FROM deg")
_add("degree_stats", lambda spark, d: statistics.degree_statistics(statistics.vertex_degrees(_graph(spark, d))), _DEGREE + "SELECT n AS total_vertices, CAST(total AS BIGINT) AS total_degree, average, sigma FROM st, sg")
_add("degree_threshold", lambda spark, d: statistics.degree_threshold(statistics.vertex_degrees(_graph(spark, d))), _DEGREE + "SELECT average + 3 * sigma AS threshold FROM st, sg")
_UNTYPED = _ALL + f", u AS (SELECT s, o FROM t WHERE p <> '{RDF_TYPE}'), both_ways AS (SELECT s AS v, o AS w FROM u UNION ALL SELECT o, s FROM u) "


def _untyped(spark: SparkSession, d: str) -> DataFrame:
    return partitioning.split_typed(_graph(spark, d))[1]


def _listed(adj: DataFrame) -> DataFrame:
    return adj.select("v", F.array_join(F.array_sort("neighbours"), " ").alias("neighbours"))


_add("map_type_split", lambda spark, d: partitioning.split_typed(_graph(spark, d))[0].withColumn("typed", F.lit(True)).union(_untyped(spark, d).withColumn("typed", F.lit(False))), _ALL + f"SELECT s, p, o, p = '{RDF_TYPE}' AS typed FROM t")
_add("adjacency", lambda spark, d: _listed(partitioning.adjacency(_untyped(spark, d))), _UNTYPED + "SELECT v, string_agg(w, ' ' ORDER BY w) AS neighbours FROM both_ways GROUP BY v")
_add("adjacency_dedup", lambda spark, d: _listed(partitioning.adjacency(_untyped(spark, d), True)), _UNTYPED + "SELECT v, string_agg(DISTINCT w, ' ' ORDER BY w) AS neighbours FROM both_ways GROUP BY v")
_add("out_adjacency", lambda spark, d: _listed(partitioning.out_adjacency(_graph(spark, d), f"<{BASE}/customer/", f"<{BASE}/customer/~")), _UNTYPED + f"SELECT s AS v, string_agg(o, ' ' ORDER BY o) AS neighbours FROM u WHERE s BETWEEN '<{BASE}/customer/' AND '<{BASE}/customer/~' GROUP BY s")
_add("edge_count", lambda spark, d: statistics.edge_count(partitioning.adjacency(_untyped(spark, d))), _UNTYPED + "SELECT count(*) AS edges FROM u")


_add("id_gaps", lambda spark, d: statistics.id_gaps(spark.read.parquet(f"{d}/lineitem.parquet"), "l_orderkey"), "SELECT * FROM (SELECT k AS after, lead(k) OVER (ORDER BY k) AS before FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem)) WHERE before > after + 1")


def _customer_links(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.groupBy((F.col("o_custkey") + 1).alias("v")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("neighbours"))


_add("isolated_fill", lambda spark, d: partitioning.fill_isolated(_customer_links(spark, d)).select("v", F.array_join(F.transform("neighbours", lambda x: x.cast("string")), " ").alias("neighbours")), "WITH a AS (SELECT o_custkey + 1 AS v, string_agg(CAST(o_orderkey AS VARCHAR), ' ' ORDER BY o_orderkey) AS neighbours FROM orders GROUP BY 1) SELECT r.v, coalesce(neighbours, '') AS neighbours FROM (SELECT unnest(generate_series(1, (SELECT max(v) FROM a))) AS v) r LEFT JOIN a ON r.v = a.v")
_add("renumber", lambda spark, d: partitioning.renumber(partitioning.adjacency(_untyped(spark, d)))[0].agg(F.count("*").alias("vertices"), F.max("v").alias("largest"), F.sum(F.size("neighbours")).alias("entries")), _UNTYPED + "SELECT count(DISTINCT v) AS vertices, count(DISTINCT v) AS largest, count(*) AS entries FROM both_ways")

# --- partitions ---------------------------------------------------------------------------------------

_PART = "CAST(CAST('0x' || substr(sha1(v), 1, 6) AS BIGINT) % 4 AS INTEGER)"


def _parts(spark: SparkSession, d: str) -> DataFrame:
    """Subjects dealt to 4 partitions by their digest (which SQL can repeat)."""
    return _graph(spark, d).select(F.col("s").alias("v")).distinct().select("v", (F.conv(F.substring(F.sha1("v"), 1, 6), 16, 10).cast("long") % 4).cast("int").alias("part"))


_PARTS = _ALL + f", vp AS (SELECT v, {_PART} AS part FROM (SELECT DISTINCT s AS v FROM t)) "
_add("part_assign", lambda spark, d: partitioning.vertices_by_part(_parts(spark, d)), _PARTS + "SELECT part, count(*) AS vertices FROM vp GROUP BY part")
_add("part_triples", lambda spark, d: partitioning.part_triples(_graph(spark, d), _parts(spark, d)), _PARTS + "SELECT s, p, o, part FROM t JOIN vp ON s = v")
_add("triples_of_vertices", lambda spark, d: partitioning.triples_of_vertices(_graph(spark, d), _parts(spark, d).where("part = 1")), _PARTS + "SELECT s, p, o FROM t WHERE s IN (SELECT v FROM vp WHERE part = 1)")

_HOP = _PARTS + """, e1 AS (SELECT s, p, o, part FROM t JOIN vp ON v = s UNION SELECT s, p, o, part FROM t JOIN vp ON v = o), f1 AS (SELECT s AS v, part FROM e1 UNION SELECT o, part FROM e1),
e2 AS (SELECT t.s, t.p, t.o, part FROM t JOIN f1 ON v = t.s UNION SELECT t.s, t.p, t.o, part FROM t JOIN f1 ON v = t.o) """
_add("nhop_1", lambda spark, d: partitioning.expand_hops(_graph(spark, d), _parts(spark, d), 1), _HOP + "SELECT * FROM e1")
_add("nhop_2", lambda spark, d: partitioning.expand_hops(_graph(spark, d), _parts(spark, d), 2), _HOP + "SELECT * FROM e2")


def _partitioned(spark: SparkSession, d: str) -> DataFrame:
    q = parse(PREFIXES + "SELECT ?c ?name ?r { ?c customer:c_nationkey ?n . ?n nation:n_name ?name . ?n nation:n_regionkey ?r }")
    triples = TableGraph(spark, d, ("region", "nation", "customer")).triples()
    parts = materialize(partitioning.assign_by_hash(triples.select(F.explode(F.array("s", "o")).alias("v")), 4))
    return partitioned_answer(partitioning.replicas(triples, parts, 1), q, 1)


_add("nhop_answer_equals_global", _partitioned, f"SELECT {_iri('customer', 'c_custkey')} AS c, {_lit('n_name')} AS name, {_iri('region', 'n_regionkey')} AS r FROM customer JOIN nation ON c_nationkey = n_nationkey")


def _high_low(spark: SparkSession, d: str) -> DataFrame:
    triples = _graph(spark, d)
    degrees = materialize(statistics.vertex_degrees(triples))
    return partitioning.split_by_degree(triples, degrees, 30)


_SPLIT = _DEGREE + ", hl AS (SELECT s, p, o, greatest(coalesce(a.degree, 0), coalesce(b.degree, 0)) AS d FROM t LEFT JOIN deg a ON t.s = a.v LEFT JOIN deg b ON t.o = b.v) "
_add("high_low_split", _high_low, _SPLIT + "SELECT s, p, o, CASE WHEN d >= 30 THEN 'high' ELSE 'low' END AS level FROM hl WHERE d > 0")
_add("high_vertices", lambda spark, d: partitioning.high_degree_subjects(_high_low(spark, d)), _SPLIT + "SELECT DISTINCT s AS v FROM hl WHERE d >= 30")
_add("hd_placement", lambda spark, d: partitioning.place_high_degree(_graph(spark, d), statistics.vertex_degrees(_graph(spark, d)).where("degree >= 30").select("v"), _parts(spark, d)), _DEGREE + f", vp AS (SELECT v, {_PART} AS part FROM (SELECT DISTINCT s AS v FROM t)), near AS (SELECT s AS v, o AS w FROM t UNION ALL SELECT o, s FROM t), c AS (SELECT near.v, vp.part, count(*) AS n FROM near JOIN vp ON near.w = vp.v WHERE near.v IN (SELECT v FROM deg WHERE degree >= 30) GROUP BY 1, 2) SELECT v, part FROM (SELECT *, row_number() OVER (PARTITION BY v ORDER BY n DESC, part) AS r FROM c) WHERE r = 1")

# --- stored graphs, files, plans ----------------------------------------------------------------------

for _name in ("pat_vvc", "pat_cvv", "pat_cvc", "pat_unknown_const", "star_2", "star_5", "star_varpred", "pipe_4", "oo_join", "snowflake", "cart_components", "filter_num", "filter_bool", "filter_text", "distinct_proj"):
    stored_queries.on_stores(_name, PREFIXES + _TEXTS[_name], _SQL[_name])
stored_queries.add_publications(query_sql)
stored_queries.add_encoded(_TERMS, _encoded)
stored_queries.add_orders(PREFIXES, "SELECT ?o ?r { ?o orders:o_custkey ?c . ?c customer:c_nationkey ?n . ?n nation:n_regionkey ?k . ?k region:r_name ?r }")
stored_queries.add_filters(PREFIXES, f"SELECT {_iri('orders', 'o_orderkey')} AS o, {_lit('n_name')} AS name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE regexp_matches(n_name, '[13579]$')")
_add("count_product", lambda spark, d: GraphStore.from_tables(spark, d).bindings_count(PREFIXES + "SELECT ?o ?p { ?o orders:o_custkey ?c . ?p part:p_size ?s FILTER(?s > 25) }"), "SELECT (SELECT count(*) FROM orders) * (SELECT count(*) FROM part WHERE p_size > 25) AS bindings")
_add("distinct_existence", lambda spark, d: GraphStore.from_tables(spark, d).sparql(PREFIXES + "SELECT DISTINCT ?n { ?x nation:n_name ?n . ?o orders:o_custkey ?c . ?l part:p_size ?s }"), f"SELECT {_lit('n_name')} AS n FROM nation")
for _key, _run in stored_queries.queries().items():
    _add(_key, _run, stored_queries.oracle_sql().get(_key))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_RUNS)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return GraphStore.from_tables(spark, sf_dir).sparql(PREFIXES + SNOWFLAKE)
