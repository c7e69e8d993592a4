"""Parsing, sources, dictionary, statistics and partitions on the hand-made graph and small tables."""

import pytest
from pyspark.sql import functions as F

from triloom import GraphStore
from triloom.functions import terms
from triloom.functions.terms import RDF_TYPE, XSD
from triloom.operators import dictionary, layout, partitioning, shared, statistics
from triloom.plans import query_graph
from triloom.plans.ordering import order
from triloom.plans.sparql import QueryError, Var, parse
from triloom.sources import encoded, generator, ntriples, rdfxml
from triloom.sources.sample import NTRIPLES, PROLOGUE
from triloom.streaming.ingest import append_triples, stream_ntriples


@pytest.fixture(scope="module")
def mini(spark):
    lines = spark.createDataFrame([(x,) for x in NTRIPLES.strip().split("\n")], "value string")
    return ntriples.parse_lines(lines)[0].distinct().cache()


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_parse_lines(spark):
    lines = ['<a> <b> "x|y \\" z"@EN-us . # note', "# comment", "", "<a><b><c>.", '_:n.1 <b> "1"^^<t> .', "<a> b <c> .", "<a> <b> <c>", '<a> <b> _:x .']
    good, bad = ntriples.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert rows(good) == sorted([("<a>", "<b>", '"x|y \\" z"@en-us'), ("<a>", "<b>", "<c>"), ("_:n.1", "<b>", '"1"^^<t>'), ("<a>", "<b>", "_:x")])
    assert rows(bad) == [("<a> <b> <c>",), ("<a> b <c> .",)]


def test_files_round_trip(spark, mini, tmp_path):
    ntriples.write_ntriples(mini, str(tmp_path / "nt"))
    back, bad = ntriples.read_ntriples(spark, str(tmp_path / "nt"))
    assert rows(back) == rows(mini) and not bad.count()
    ntriples.repartition_files(spark.read.text(str(tmp_path / "nt")), str(tmp_path / "one"), 1)
    assert len(list((tmp_path / "one").glob("part-*"))) == 1
    ids = dictionary.build_dictionary(mini).cache()
    enc = dictionary.encode(mini, ids)
    encoded.write_encoded(enc, str(tmp_path / "kv"))
    again = encoded.read_encoded(spark, str(tmp_path / "kv"))
    assert rows(again) == rows(enc) and rows(dictionary.decode(again, ids)) == rows(mini)
    assert encoded.id_range(again, 1, 5).count() == again.where("s <= 5").count()
    parts = partitioning.assign_by_hash(mini.select(F.col("s").alias("v")), 3)
    ntriples.write_ntriples(partitioning.part_triples(mini, parts), str(tmp_path / "by"), by_partition=True)
    assert spark.read.text(str(tmp_path / "by")).count() == 44
    assert ntriples.synthetic_iris(enc).where("s LIKE '<http://num.example.org#%>'").count() == 44


def test_stream(spark, mini, tmp_path):
    ntriples.write_ntriples(mini, str(tmp_path / "in"))
    append_triples(stream_ntriples(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(mini)


def test_rdfxml(spark, tmp_path):
    (tmp_path / "a.owl").write_text('''<?xml version="1.0"?><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="http://e/" xml:base="http://b/x">
<e:C rdf:about="#one" e:tag="t"><e:p rdf:resource="two"/><e:q rdf:datatype="http://t">5</e:q><e:r xml:lang="en">hi "you"</e:r><e:s><rdf:Description rdf:nodeID="k"><e:t>in</e:t></rdf:Description></e:s><e:u rdf:nodeID="k"/></e:C></rdf:RDF>''')
    got = {(s, p[9:-1] if p.startswith("<http://e/") else p, o) for s, p, o in rows(rdfxml.read_rdfxml(spark, str(tmp_path)))}
    one = "<http://b/x#one>"
    k = next(o for s, p, o in got if p == "/u" or p.endswith("u"))
    assert (one, RDF_TYPE, "<http://e/C>") in got and len(got) == 8 and k.startswith("_:")
    assert {o for s, _, o in got if s == one} >= {'"t"', "<http://b/two>", '"5"^^<http://t>', '"hi \\"you\\""@en', k}
    assert [o for s, _, o in got if s == k] == ['"in"']


def test_generator(spark):
    a, b = (generator.synthetic_triples(spark, 1000, 3).repartition(n) for n in (1, 7))
    assert rows(a) == rows(b)
    stars = a.where("s LIKE '%/star%'").groupBy("s").count()
    assert rows(stars.select("count").distinct()) == [(10,)] and stars.count() == 20


def test_terms(spark):
    data = ['"5"^^<' + XSD + 'integer>', '"a\\"b\\\\"', '"x"@en', "<http://i>", "_:b", '"q"^^<' + XSD + 'double>']
    t = F.col("t")
    got = spark.createDataFrame([(x,) for x in data], "t string").select(terms.kind(t), terms.lexical(t), terms.datatype(t), terms.language(t), terms.numeric(t)).collect()
    assert [r[0] for r in got] == ["literal"] * 3 + ["iri", "bnode", "literal"]
    assert [r[1] for r in got] == ["5", 'a"b\\', "x", "http://i", "b", "q"]
    assert [r[4] for r in got] == [5.0, None, None, None, None, None] and got[2][3] == "en" and got[1][2] == XSD + "string"


def test_parser():
    q = parse('PREFIX : <http://e/> SELECT DISTINCT ?s ?n WHERE { ?s a :C ; :p "x"@EN, 5, -2.5, 1e3, true . ?s :q [ :r ?n ] . FILTER(?n > 3 || !bound(?s)) }')
    assert q.distinct and q.select == ["s", "n"] and len(q.patterns) == 8 and q.filters[0].op == "||"
    assert [p.o for p in q.patterns[1:6]] == ['"x"@en', f'"5"^^<{XSD}integer>', f'"-2.5"^^<{XSD}decimal>', f'"1e3"^^<{XSD}double>', f'"true"^^<{XSD}boolean>']
    assert parse("SELECT * { ?b ?a _:x }").select == ["b", "a"]
    assert parse("BASE <http://e/> SELECT ?a { <x> <p#q> ?a . }").patterns[0].s == "<http://e/x>"


@pytest.mark.parametrize("text", ["SELECT ?a { ?a ?b }", "ASK { ?a ?b ?c }", "SELECT ?a { ?a x:y ?c }", "SELECT ?a { OPTIONAL { ?a ?b ?c } }", "SELECT ?a { ?a ?b ?c } LIMIT 3", "SELECT ?a { ?a <p>/<q> ?c }", "SELECT ?a { ?a ?b ?c", "SELECT { ?a ?b ?c }", 'SELECT ?a { ?a "p" ?c }', "SELECT ?a { { ?a ?b ?c } UNION { ?a ?c ?b } }"])
def test_what_is_not_supported_says_so(text):
    with pytest.raises(QueryError):
        parse(text)


def test_filters(spark):
    x = lambda n: f'"{n}"^^<{XSD}integer>'
    g = GraphStore.from_triples(spark.createDataFrame([("<a>", "<v>", x(5)), ("<b>", "<v>", x("05")), ("<c>", "<v>", x(12)), ("<d>", "<v>", '"12"'), ("<e>", "<v>", '"hallo"@de'), ("<f>", "<v>", "_:n"), ("<a>", "<v>", x(5))], "s string, p string, o string"))

    def ask(f):
        return [r[0] for r in rows(g.sparql(f"SELECT ?s {{ ?s <v> ?o FILTER({f}) }}"))]

    assert ask("?o = 5") == ["<a>", "<b>"] and ask("sameTerm(?o, 5)") == ["<a>"] and ask("?o < 12") == ["<a>", "<b>"]
    assert ask('?o = "12"') == ["<d>"] and ask("?o * 2 - 4 >= 20") == ["<c>"] and ask("!(?o > 5)") == ["<a>", "<b>"]
    assert ask("isBlank(?o)") == ["<f>"] and ask('lang(?o) = "de"') == ["<e>"] and ask('regex(str(?o), "^HAL", "i")') == ["<e>"]
    assert ask("?o / 0 = 1 || ?s = <c>") == ["<c>"] and ask("bound(?nothing)") == []
    assert ask(f"datatype(?o) = <{XSD}string>") == ["<d>"] and ask('langMatches(lang(?o), "*")') == ["<e>"]


def test_access_paths(spark):
    g = GraphStore.from_triples(spark.createDataFrame([("<a>", "<p>", "<a>"), ("<a>", "<p>", "<b>"), ("<p>", "<q>", "<p>"), ("<b>", "<p>", "<c>")], "s string, p string, o string"))
    assert rows(g.sparql("SELECT ?x ?p { ?x ?p ?x }")) == [("<a>", "<p>"), ("<p>", "<q>")]
    assert rows(g.sparql("SELECT ?s { ?s ?p ?o . ?p <q> ?p }")) == [("<a>",), ("<a>",), ("<b>",)]  # predicates join with subjects
    assert g.count("SELECT ?s { <a> <p> <b> . ?s <q> ?o }") == 1 and g.count("SELECT ?s { <a> <p> <z> . ?s <q> ?o }") == 0
    assert g.count("SELECT ?z { <a> <p> <b> . <b> <p> <c> }") == 1 and g.count("SELECT ?z { <a> <p> <b> . <b> <p> <a> }") == 0


def test_counts_follow_triples(spark):
    import random

    draw = random.Random(5)
    triples = {(f"<n{draw.randrange(12)}>", f"<{draw.choice('pqr')}>", f"<n{draw.randrange(12)}>") for _ in range(90)}
    g = GraphStore.from_triples(spark.createDataFrame(sorted(triples), "s string, p string, o string"))
    for text in (
        "SELECT ?a { ?a <p> ?b }",
        "SELECT ?a { ?a <p> ?b . ?c <p> ?b . ?c <q> ?d }",
        "SELECT ?a { ?a <p> ?b . ?b <q> ?c . ?c <r> ?a }",
        "SELECT ?a { ?a ?x ?b . ?c ?x ?a . <n1> <p> ?c }",
        "SELECT ?a { ?a <p> ?a . ?b <q> ?c }",
        "SELECT ?a { ?a <p> ?b . ?c <q> ?d . ?e <r> ?f FILTER(?b != ?d) }",
        "SELECT ?a { ?a <p> ?b . ?b <none> ?c }",
        "SELECT DISTINCT ?a { ?a <p> ?b . ?c <q> ?d . ?d <r> ?e }",
    ):
        assert g.count(text) == g.sparql(text).count(), text
    # 2000 triples at a hub: 2000 ** 3 bindings
    hub = GraphStore.from_triples(spark.range(2000).selectExpr("concat('<s', id, '>') AS s", "'<p>' AS p", "'<hub>' AS o"))
    assert hub.count("SELECT ?a { ?a <p> ?h . ?b <p> ?h . ?c <p> ?h }") == 2000**3


def test_counts_beyond_a_long(spark):
    g = GraphStore.from_triples(spark.range(1300).selectExpr("concat('<s', id, '>') AS s", "'<p>' AS p", "'<hub>' AS o"))
    text = "SELECT * { " + " . ".join(f"?a{i} <p> ?h . ?b{i} <p> ?h".replace("?h", f"?h{i}") for i in range(4)) + " }"
    assert g.count(text) == 1300**8 > 1 << 63
    assert g.bindings_count(text).schema["bindings"].dataType.simpleString() == "decimal(38,0)"
    assert g.bindings_count("SELECT * { ?a <p> ?b . ?c <p> ?d }").dtypes == [("bindings", "bigint")]


def test_stars_come_first_without_statistics():
    """A cycle whose first pattern joins on an object: the star of the other two is joined before."""
    q = parse("SELECT ?p ?s { ?s <supplies> ?p . ?o <has_part> ?p . ?o <has_supplier> ?s }")
    assert [p.p for p in order(q.patterns)] == ["<has_part>", "<has_supplier>", "<supplies>"]


@pytest.mark.parametrize("encoded", [None, False, True])
def test_products_of_heavy_keys_are_dealt(spark, tmp_path, monkeypatch, encoded):
    """Two common objects: the join has more tasks than keys, ids are decoded before it, and its rows are all there, once."""
    from triloom.plans import compiler

    monkeypatch.setattr(compiler, "CELL", 50)
    data = [(f"<c{i}>", "<in>", f"<n{i % 2}>") for i in range(40)] + [(f"<s{i}>", "<near>", f"<n{i % 3}>") for i in range(30)]
    g = GraphStore.from_triples(spark.createDataFrame(data, "s string, p string, o string"))
    g = g if encoded is None else g.save(str(tmp_path / "g"), encoded=encoded)
    got = g.sparql("SELECT ?c ?s { ?c <in> ?n . ?s <near> ?n }")
    assert rows(got) == sorted((a, b) for a, p, n in data for b, q, m in data if p == "<in>" and q == "<near>" and n == m)
    assert rows(g.sparql("SELECT ?n ?s { ?c <in> ?n . ?s <near> ?n FILTER(?s != <s0>) }")) == sorted((n, b) for _, p, n in data for b, q, m in data if p == "<in>" and q == "<near>" and n == m and b != "<s0>")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_rows_block" in plan
    if encoded:  # no join above the product
        assert [x for x in plan.splitlines() if "Join" in x][0].count("_rows_block") == 2


def test_saving_shuffles_terms_once_and_drops_its_tables(spark, tmp_path):
    import hashlib

    data = [(f"<s{i % 50}>", f"<p{i % 3}>", f"<s{i % 7}>") for i in range(200)]
    g = GraphStore.from_triples(spark.createDataFrame(data * 2, "s string, p string, o string")).save(str(tmp_path / "g"))
    ids = {r["term"]: r["id"] for r in spark.read.parquet(str(tmp_path / "g/dictionary")).collect()}
    assert ids == {t: i for i, t in enumerate(sorted({x for r in data for x in r}, key=lambda t: hashlib.sha1(t.encode()).hexdigest()), 1)}
    assert rows(g.triples()) == sorted(set(data)) and dictionary.look_up(g.graph._dictionary, ["<s3>", "<none>"]) == {"<s3>": ids["<s3>"]}
    assert {r["term"]: (r["subjects"], r["triples"]) for r in g.graph._predicates.collect()} == {p: (len({s for s, q, _ in data if q == p}), len({x for x in data if x[1] == p})) for p in ("<p0>", "<p1>", "<p2>")}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("triloom_") and "bucketed" not in t.name]


def test_dictionary(mini):
    d = {(r["term"], r["role"]): r for r in dictionary.build_dictionary(mini).collect()}
    assert len({t for t, _ in d}) == 49
    by = lambda role, sign: sorted(r["id"] for r in d.values() if r["role"] == role and (r["id"] > 0) == sign)
    assert by("vertex", True) == list(range(1, len(by("vertex", True)) + 1))
    assert by("vertex", False) == list(range(-len(by("vertex", False)), 0))
    assert by("predicate", True) == [2, *range(10, 26)] and d[RDF_TYPE, "predicate"]["id"] == 2
    assert {t for (t, r), x in d.items() if r == "vertex" and x["id"] < 0} == {"<http://xmlns.com/foaf/0.1/Person>", "<http://www.w3.org/1999/02/22-rdf-syntax-ns#Bag>"}
    assert rows(dictionary.class_only_terms(dictionary.unique_terms(mini))) == [(2,)]
    assert not dictionary.missing_terms(mini, dictionary.unique_terms(mini)).count()


def test_statistics(mini):
    sel = {r["p"]: r["subjects"] for r in statistics.predicate_selectivity(mini).collect()}
    assert sel[RDF_TYPE] == 9 and sel["<http://purl.org/dc/elements/1.1/creator>"] == 3 and len(sel) == 17 == statistics.distinct_predicates(mini).count()
    deg = statistics.vertex_degrees(mini).cache()
    assert rows(statistics.degree_statistics(deg)) == [(14, 65, 5, 3)] and rows(statistics.degree_threshold(deg)) == [(14,)]
    top = [(r["v"], r["degree"]) for r in deg.orderBy(F.desc("degree"), "v").limit(5).collect()]
    assert [n for _, n in top] == [11, 9, 8, 7, 5] and top[0][0] == "<http://localhost/c/I1>"


def test_gaps(spark):
    ids = spark.createDataFrame([(i,) for i in (1, 2, 5, 6, 1 << 20, (1 << 20) + 1, 5 << 20)], "id long")
    assert rows(statistics.id_gaps(ids)) == [(2, 5), (6, 1 << 20), ((1 << 20) + 1, 5 << 20)]


def test_partitioning(spark, mini):
    typed, untyped = partitioning.split_typed(mini)
    assert (typed.count(), untyped.count()) == (9, 35)
    adj = partitioning.adjacency(untyped)
    assert adj.count() == 30 and rows(statistics.edge_count(adj)) == [(35,)]
    assert rows(statistics.edge_count(partitioning.adjacency(untyped, True))) == [(34,)]
    seed = spark.createDataFrame([("<http://localhost/a/A1>", 0)], "v string, part int")
    assert [partitioning.expand_hops(mini, seed, h).count() for h in (0, 1, 2)] == [0, 9, 28]
    split = partitioning.split_by_degree(mini, statistics.vertex_degrees(mini), 10)
    assert "<http://localhost/c/I1>" in {r["v"] for r in partitioning.high_degree_subjects(split).collect()}
    dense, ids = partitioning.renumber(adj)
    assert rows(dense.select("v")) == [(i,) for i in range(1, 31)] and rows(partitioning.restore(dense.select("v"), ids)) == rows(adj.select("v"))
    label = partitioning.assign_by_neighbours(partitioning.adjacency(untyped, True), 3, 3)
    assert label.count() == 30 and label.select("v").distinct().count() == 30


def test_replicas_are_one_row_a_triple(spark):
    """A hub that 70 parts reach: the triples' parts are bits of two words, and the rows are those of brute force."""
    data = {(f"<v{i}>", "<p>", "<hub>") for i in range(70)} | {("<hub>", "<q>", "<far>"), ("<far>", "<q>", "<end>"), ("<end>", "<q>", "<off>")}
    parts = {(f"<v{i}>", i) for i in range(70)}
    found = partitioning.replicas(spark.createDataFrame(sorted(data) * 2, "s string, p string, o string"), spark.createDataFrame(sorted(parts), "v string, part int"), 2)
    known, want = set(parts), set()
    for _ in range(2):
        step = {(s, p, o, k) for s, p, o in data for v, k in known if v in (s, o)}
        want |= step
        known |= {(v, k) for s, _, o, k in step for v in (s, o)}
    assert rows(found.rows()) == sorted(want) and found._masked.count() == 71
    assert rows(found.rows("s")) == sorted((s, p, o, k) for s, p, o, k in want if (s, k) in parts) and not found.rows("o").count()


def test_labels_and_votes_are_all_that_is_shuffled(spark):
    """Edges in clusters join with labels as they lie; a hub's neighbours are never one row; labels follow neighbours."""
    data = [(f"a{i}", "A") for i in range(40)] + [(f"b{i}", "B") for i in range(40)]
    both = spark.createDataFrame(data + [(w, v) for v, w in data], "v string, w string")
    with shared.clustered(both.union(both), "w") as edges:
        assert "Exchange" not in edges.groupBy("w").agg(F.count("*"))._jdf.queryExecution().executedPlan().toString()
        assert edges.count() == 160
        label = dict(rows(partitioning.assign_by_edges(edges, edges.select(F.col("w").alias("v")).distinct(), 2, 6, 1.3)))
    alike = sum(label[v] == label[w] for v, w in data)
    by_hash = dict(rows(partitioning.assign_by_hash(both.select("v"), 2)))
    assert len(label) == 82 and alike > sum(by_hash[v] == by_hash[w] for v, w in data)


def test_small_partition_operators(spark):
    adj = spark.createDataFrame([(2, [4]), (4, [2])], "v long, neighbours array<long>")
    assert rows(partitioning.fill_isolated(adj)) == [(1, []), (2, [4]), (3, []), (4, [2])]
    v = spark.createDataFrame([(0, "a"), (1, "b")], "line long, v string")
    p = spark.createDataFrame([(0, 3), (1, 1)], "line long, part int")
    assert rows(partitioning.zip_assignment(v, p)) == [("a", 3), ("b", 1)]
    with pytest.raises(Exception, match="differ in length"):
        partitioning.zip_assignment(v, p.where("line = 0")).collect()
    t = spark.createDataFrame([("x", "p", "h"), ("y", "p", "h"), ("h", "p", "z")], "s string, p string, o string")
    parts = spark.createDataFrame([("x", 1), ("y", 1), ("z", 0)], "v string, part int")
    assert rows(partitioning.place_high_degree(t, spark.createDataFrame([("h",)], "v string"), parts)) == [("h", 1)]


def test_star_layout(spark, mini, tmp_path):
    stars = layout.star_rows(mini)
    assert stars.count() == 12 and rows(layout.from_star(stars)) == rows(mini) and rows(layout.star_triple_count(stars)) == [(44,)]
    parts = partitioning.assign_by_hash(mini.select(F.col("s").alias("v")), 2)
    layout.write_partitioned_stars(mini, parts, str(tmp_path / "stars"))
    assert rows(layout.star_triple_count(layout.read_stars(spark, str(tmp_path / "stars")))) == [(44,)]


def test_locality_with_stops():
    q = parse("SELECT * { ?a <p> ?b . ?b <p> ?c . ?c <p> ?d }")
    assert query_graph.locality(q.patterns).radius == 2
    assert query_graph.locality(q.patterns, frozenset({"?b", "?c"})).radius is None
    assert [len(s.patterns) for s in query_graph.split(q, 1)] == [2, 1]
    assert query_graph.articulation_points(q.patterns) == {"?b", "?c"}
    assert parse(PROLOGUE + "SELECT ?x { ?x a foaf:Person }").patterns[0].variables() == ("x",)
    assert Var("x") != Var("y")


def test_saved_by_predicate_prunes(spark, mini, tmp_path):
    store = GraphStore.from_triples(mini).save(str(tmp_path / "g"), encoded=False)
    plan = store.sparql(PROLOGUE + "SELECT ?s ?n { ?s foaf:name ?n }")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(pid" in plan


def test_table_stars_are_one_scan(spark, tmp_path):
    from triloom.sources.tables import BASE, TableGraph

    data = [(1, "a", 1, 5.0, "X"), (2, 'q"\\', 1, -1.5, None), (3, "1", 2, 5.0, "X"), (4, None, 2, 0.0, "Y")]
    spark.createDataFrame(data, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    graph = TableGraph(spark, str(tmp_path), ("customer",))
    flat = GraphStore.from_triples(graph.triples())
    prefix = f"PREFIX c: <{BASE}/customer#> PREFIX k: <{BASE}/class/> "
    for body in ("?s c:c_name ?n ; c:c_nationkey ?k ; a k:customer", f'?s c:c_mktsegment "X"^^<{XSD}string> ; c:c_acctbal ?n', "?s c:c_name ?n ; c:c_mktsegment ?n", "?s c:c_acctbal ?n . ?s c:c_acctbal ?n", "?s c:c_name ?n . ?s c:c_nationkey ?s", f'?s c:c_acctbal "5.0"^^<{XSD}double> ; c:c_nationkey <{BASE}/nation/2> ; ?p ?n', f'?s a k:customer ; c:c_name "q\\"\\\\"^^<{XSD}string> ; c:c_acctbal ?n', "?s c:c_name ?n . ?t c:c_nationkey ?k ; c:c_mktsegment ?m . ?s c:c_nationkey ?k"):
        text = prefix + f"SELECT ?s ?n {{ {body} }}"
        assert rows(GraphStore(graph).sparql(text)) == rows(flat.sparql(text)), body
    plan = GraphStore(graph).sparql(prefix + "SELECT * { ?s c:c_name ?n ; c:c_acctbal ?b ; c:c_nationkey ?k }")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_hops_from_all_vertices_against_brute_force(spark, monkeypatch):
    from triloom import queries

    graph = [("<a>", "<p>", "<b>"), ("<b>", "<p>", "<c>"), ("<c>", "<q>", '"x"'), ("<d>", "<q>", "<c>"), ("<e>", "<p>", "<e>"), ("<f>", "<p>", '"x"'), ("<d>", "<p>", "<g>")]
    monkeypatch.setattr(queries, "_graph", lambda s, d: s.createDataFrame(graph, "s string, p string, o string"))
    parts = {tuple(r) for r in queries._parts(spark, "").collect()}
    assert {v for v, _ in parts} == {s for s, _, _ in graph}
    for hops in (1, 2):
        known, want = set(parts), set()
        for _ in range(hops):
            found = {(s, p, o, k) for s, p, o in graph for v, k in known if v in (s, o)}
            want |= found
            known |= {(v, k) for s, _, o, k in found for v in (s, o)}
        assert rows(queries.queries()[f"nhop_{hops}"](spark, "")) == sorted(want)
