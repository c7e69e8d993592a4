"""A graph of publications that grows with the tables, for the benchmark queries.

Orders are publications (finished ones articles, others conference papers), parts are journals, customers and suppliers
are authors; urgent publications have a bag of references. The same SQL makes the triples in Spark and in other engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .sample import PREFIXES

_NS = "http://localhost/publications/"


def _iri(prefix: str, name: str) -> str:
    return f"'<{PREFIXES[prefix]}{name}>'"


def _node(kind: str, key: str) -> str:
    return f"concat('<{_NS}{kind}', {key}, '>')"


def _text(*parts: str, kind: str = "string") -> str:
    return "concat('\"', " + ", ".join(parts) + f", '\"^^<{PREFIXES['xsd']}{kind}>')"


_TYPE, _DOC, _PAPER, _JOURNAL = _iri("rdf", "type"), _node("doc", "o_orderkey"), _node("doc", "l_orderkey"), _node("journal", "p_partkey")
_URGENT = "{orders} WHERE o_orderpriority = '1-URGENT'"
#: (subject, predicate, object, rows) of each kind of triples
_PARTS = [
    *[(_iri("bench", c), _iri("rdfs", "subClassOf"), _iri("foaf", "Document"), "(SELECT 1) x") for c in ("Article", "Inproceedings", "Journal")],
    (_JOURNAL, _TYPE, _iri("bench", "Journal"), "{part}"),
    (_JOURNAL, _iri("dc", "title"), _text("'Journal '", "p_partkey", "' (1940)'"), "{part}"),
    *[(_JOURNAL, _iri(*p), _text(v, kind="integer"), "{part}") for p, v in ((("dcterms", "issued"), "'1940'"), (("swrc", "number"), "'1'"), (("swrc", "volume"), "'1'"))],
    (_DOC, _TYPE, f"CASE WHEN o_orderstatus = 'F' THEN {_iri('bench', 'Article')} ELSE {_iri('bench', 'Inproceedings')} END", "{orders}"),
    (_DOC, _iri("dc", "title"), _text("'Paper '", "o_orderkey"), "{orders}"),
    (_DOC, _iri("dcterms", "issued"), _text("year(o_orderdate)", kind="integer"), "{orders}"),
    (_DOC, _iri("dc", "creator"), _node("person", "o_custkey"), "{orders}"),
    (_DOC, _iri("rdfs", "seeAlso"), _text("'http://ee/'", "o_orderkey"), "{orders} WHERE o_orderpriority <> '5-LOW'"),
    (_DOC, _iri("bench", "booktitle"), _text("'Conference '", "o_custkey"), "{orders} WHERE o_orderstatus <> 'F'"),
    (_DOC, _iri("dcterms", "partOf"), _node("proceedings", "o_custkey"), "{orders} WHERE o_orderstatus <> 'F'"),
    (_DOC, _iri("swrc", "pages"), _text("o_custkey", kind="integer"), _URGENT),
    (_DOC, _iri("foaf", "homepage"), _text("'http://hp/'", "o_orderkey"), _URGENT),
    (_DOC, _iri("dcterms", "references"), "concat('_:bag', o_orderkey)", _URGENT),
    ("concat('_:bag', o_orderkey)", _TYPE, _iri("rdf", "Bag"), _URGENT),
    ("concat('_:bag', o_orderkey)", f"concat('<{PREFIXES['rdf']}_', l_linenumber, '>')", _node("doc", "l_partkey"), "{orders} JOIN {lineitem} ON o_orderkey = l_orderkey WHERE o_orderpriority = '1-URGENT'"),
    (_PAPER, _iri("dc", "creator"), _node("supplier", "l_suppkey"), "{lineitem}"),
    (_PAPER, _iri("swrc", "journal"), _node("journal", "l_partkey"), "{lineitem} JOIN {orders} ON o_orderkey = l_orderkey WHERE l_linenumber = 1 AND o_orderstatus = 'F'"),
    (_node("person", "c_custkey"), _TYPE, _iri("foaf", "Person"), "{customer}"),
    (_node("person", "c_custkey"), _iri("foaf", "name"), _text("CASE WHEN c_custkey = 1 THEN 'Paul Erdoes' ELSE c_name END"), "{customer}"),
    (_node("supplier", "s_suppkey"), _TYPE, _iri("foaf", "Person"), "{supplier}"),
    (_node("supplier", "s_suppkey"), _iri("foaf", "name"), _text("s_name"), "{supplier}"),
]
TABLES = ("customer", "lineitem", "orders", "part", "supplier")
_TEMPLATE = "\nUNION ".join(f"SELECT {s} AS s, {p} AS p, {o} AS o FROM {rows}" for s, p, o, rows in _PARTS)


def publications(spark: SparkSession, sf_dir: str, once: bool = True) -> DataFrame:
    """s, p, o of the graph, each triple once; without once, repeated ones as they come."""
    return spark.sql(_TEMPLATE if once else _TEMPLATE.replace("\nUNION ", "\nUNION ALL "), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES})


def publications_sql() -> str:
    """The same as SQL over tables of these names."""
    return _TEMPLATE.format(**{t: t for t in TABLES})
