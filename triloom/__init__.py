"""A graph-pattern engine on Spark: RDF triples, their layouts and partitions, and SPARQL basic graph patterns."""

from .store import GraphConfig, GraphStore

__all__ = ["GraphConfig", "GraphStore"]
