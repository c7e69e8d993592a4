"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line with the median seconds of each.

Stored graphs are written once (not timed); each query is then run once to warm up and three times for the record.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from triloom import GraphStore
from triloom import queries as graph
from triloom.sources.publications import publications
from triloom.sources.sample import PROLOGUE, QUERIES

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

BGP = {
    "star_2": 'SELECT ?c ?n { ?c customer:c_mktsegment "BUILDING"^^xsd:string ; customer:c_nationkey ?n }',
    "star_5": "SELECT ?c ?name ?n ?b ?m { ?c a class:customer ; customer:c_name ?name ; customer:c_nationkey ?n ; customer:c_acctbal ?b ; customer:c_mktsegment ?m }",
    "bgp_5": 'SELECT ?o ?p ?n { ?o orders:o_custkey ?c . ?o orders:o_orderpriority ?p . ?c customer:c_mktsegment "BUILDING"^^xsd:string . ?c customer:c_nationkey ?k . ?k nation:n_name ?n }',
    "pipe_4": "SELECT ?o ?r { ?o orders:o_custkey ?c . ?c customer:c_nationkey ?n . ?n nation:n_regionkey ?k . ?k region:r_name ?r }",
    "varpred": 'SELECT ?c ?p ?v { ?c customer:c_mktsegment "MACHINERY"^^xsd:string . ?c ?p ?v }',
}
OPERATORS = ["snowflake", "both_var_join", "pred_selectivity", "vertex_degree", "adjacency_dedup", "dict_ids", "nhop_2"]
#: Benchmark queries on publications, by their numbers of rows.
PUBLICATIONS = ["q1", "q2", "q3", "q4", "q6", "q6a", "q11"]


def timed(run) -> float:
    run()
    times = []
    for _ in range(3):
        began = time.perf_counter()
        run()
        times.append(time.perf_counter() - began)
    return round(statistics.median(times), 3)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    out: dict[str, float] = {}
    with tempfile.TemporaryDirectory() as folder:
        tables = GraphStore.from_tables(spark, SF)
        stores = {"tables": tables, "terms": tables.save(f"{folder}/terms", encoded=False), "ids": tables.save(f"{folder}/ids")}
        for kind, store in stores.items():
            for name, text in BGP.items():
                out[f"{kind}_{name}"] = timed(lambda store=store, text=text: store.sparql(graph.PREFIXES + text).write.format("noop").mode("overwrite").save())
        pub = GraphStore.from_triples(publications(spark, SF))
        for kind, store in {"terms": pub.save(f"{folder}/pub-terms", encoded=False), "ids": pub.save(f"{folder}/pub-ids")}.items():
            for name in PUBLICATIONS:  # counted without building the rows
                out[f"pub_{kind}_{name}"] = timed(lambda store=store, text=QUERIES[name][0]: store.count(PROLOGUE + text))
        for name in OPERATORS:
            out[name] = timed(lambda name=name: graph.queries()[name](spark, SF).write.format("noop").mode("overwrite").save())
    print(json.dumps({"metric": "headline queries, sum of medians", "value": round(sum(out.values()), 3), "unit": "sec", "queries": out, "sf": os.path.basename(SF.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    sys.exit(main())
