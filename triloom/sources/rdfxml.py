"""RDF/XML files as triples: node elements, property elements, attributes, datatypes, languages and node ids.

Each file is parsed by one task (XML can't be split); files are spread over tasks.
"""

from __future__ import annotations

import hashlib
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from urllib.parse import urljoin

from pyspark.sql import DataFrame, SparkSession

from ..functions.terms import RDF_TYPE, iri, literal

_RDF, _XML = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}", "{http://www.w3.org/XML/1998/namespace}"


def _name(tag: str) -> str:
    return iri(tag[1:].replace("}", "", 1))


class _Reader:
    def __init__(self, path: str):
        self.base, self.salt, self.count = path, hashlib.sha1(path.encode()).hexdigest()[:12], 0

    def blank(self, label: str | None = None) -> str:
        self.count += label is None
        return f"_:{'n' + label if label else 'g' + str(self.count)}x{self.salt}"

    def node(self, e: ET.Element, lang: str | None) -> Iterator[tuple[str, str, str]]:
        """Triples of a node element; its term comes first, as a triple with empty parts."""
        lang = e.get(_XML + "lang", lang)
        about, ident, label = e.get(_RDF + "about"), e.get(_RDF + "ID"), e.get(_RDF + "nodeID")
        s = iri(urljoin(self.base, about)) if about is not None else iri(f"{self.base}#{ident}") if ident is not None else self.blank(label)
        yield s, "", ""
        if e.tag != _RDF + "Description":
            yield s, RDF_TYPE, _name(e.tag)
        for k, v in e.attrib.items():
            if k == _RDF + "type":
                yield s, RDF_TYPE, iri(urljoin(self.base, v))
            elif not k.startswith((_RDF, _XML)) and k.startswith("{"):
                yield s, _name(k), literal(v, lang=lang)
        members = 0
        for prop in e:
            if prop.tag == _RDF + "li":
                members += 1
                p = iri(f"{_RDF[1:-1]}_{members}")
            else:
                p = _name(prop.tag)
            yield from self.value(s, p, prop, lang)

    def value(self, s: str, p: str, prop: ET.Element, lang: str | None) -> Iterator[tuple[str, str, str]]:
        lang = prop.get(_XML + "lang", lang)
        if (to := prop.get(_RDF + "resource")) is not None:
            yield s, p, iri(urljoin(self.base, to))
        elif (label := prop.get(_RDF + "nodeID")) is not None:
            yield s, p, self.blank(label)
        elif len(prop):
            for child in prop:
                inner = self.node(child, lang)
                yield s, p, next(inner)[0]
                yield from inner
        else:
            kind = prop.get(_RDF + "datatype")
            yield s, p, literal(prop.text or "", kind, None if kind else lang)


def parse_rdfxml(text: str | bytes, path: str) -> list[tuple[str, str, str]]:
    root, reader = ET.fromstring(text), _Reader(path)
    reader.base = root.get(_XML + "base", path)
    nodes = list(root) if root.tag == _RDF + "RDF" else [root]
    return [t for e in nodes for t in reader.node(e, root.get(_XML + "lang")) if t[1]]


def read_rdfxml(spark: SparkSession, path: str) -> DataFrame:
    """The distinct triples of RDF/XML files."""
    import pandas as pd

    def run(parts):
        for part in parts:
            rows = [t for p, c in zip(part["path"], part["content"], strict=True) for t in parse_rdfxml(bytes(c), p)]
            yield pd.DataFrame(rows, columns=["s", "p", "o"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "s string, p string, o string").distinct()
