"""RDF terms as strings in N-Triples syntax, and column functions over them.

An IRI is ``<iri>``, a blank node ``_:label``, a literal ``"lex"``, ``"lex"^^<datatype>`` or ``"lex"@lang``. One
string is one term, so equality of strings is equality of terms, language tags included.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RDF_TYPE = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"
XSD = "http://www.w3.org/2001/XMLSchema#"
_NUMERIC = [f"{XSD}{t}" for t in ("integer", "decimal", "double", "float", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger", "negativeInteger", "nonPositiveInteger", "unsignedInt", "unsignedLong")]


def iri(text: str) -> str:
    return f"<{text}>"


def literal(lex: str, datatype: str | None = None, lang: str | None = None) -> str:
    """A literal term; escapes what N-Triples asks for."""
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        lex = lex.replace(a, b)
    return f'"{lex}"' + (f"@{lang.lower()}" if lang else f"^^<{datatype}>" if datatype else "")


def kind(term: Column) -> Column:
    """iri, bnode or literal."""
    return F.when(term.startswith("<"), "iri").when(term.startswith("_:"), "bnode").otherwise("literal")


def lexical(term: Column) -> Column:
    """The lexical form: what stands between the quotes or angle brackets, unescaped."""
    raw = F.regexp_extract(term, r'^"((?:[^"\\]|\\.)*)"', 1)
    for a, b in (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ('\\"', '"'), ("\\\\", "\\")):
        raw = F.replace(raw, F.lit(a), F.lit(b))
    return F.when(term.startswith("<"), F.regexp_extract(term, r"^<(.*)>$", 1)).when(term.startswith("_:"), F.substring(term, 3, 1 << 30)).otherwise(raw)


def datatype(term: Column) -> Column:
    """The datatype IRI of a literal; plain ones are strings, null for other terms."""
    own = F.regexp_extract(term, r'"\^\^<([^<>]*)>$', 1)
    return F.when(~term.startswith('"'), F.lit(None)).when(own != "", own).when(language(term) != "", F.lit("http://www.w3.org/1999/02/22-rdf-syntax-ns#langString")).otherwise(F.lit(XSD + "string"))


def language(term: Column) -> Column:
    return F.when(term.startswith('"'), F.regexp_extract(term, r'"@([A-Za-z0-9-]+)$', 1))


def numeric(term: Column) -> Column:
    """The value of a numeric literal; null for any other term."""
    return F.when(datatype(term).isin(_NUMERIC), lexical(term).try_cast("double"))


def integer(term: Column) -> Column:
    """The value of an integer literal, to 38 digits; null for any other term."""
    return F.when(datatype(term).isin([t for t in _NUMERIC if t.rsplit("#")[1] not in ("decimal", "double", "float")]), lexical(term).try_cast("decimal(38,0)"))


def is_literal(term: Column) -> Column:
    return term.startswith('"')


def digest(term: Column) -> Column:
    """SHA-1 of the term, as hexadecimal."""
    return F.sha1(term)
