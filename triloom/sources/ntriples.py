"""N-Triples files as triples, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import is_literal

_SUBJECT, _PREDICATE = r"(<[^>]*>|_:[^\s<]+)", r"(<[^>]*>)"
_OBJECT = r'(<[^>]*>|_:[^\s<]*[^\s<.]|"(?:[^"\\]|\\.)*"(?:\^\^<[^>]*>|@[A-Za-z0-9-]+)?)'
LINE = rf"^\s*{_SUBJECT}\s*{_PREDICATE}\s*{_OBJECT}\s*\.\s*(?:#.*)?$"


def parse_lines(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(triples s, p, o; rejected lines). Blank lines and comments are neither; language tags are in lower case."""
    line = F.col(column)
    content = lines.where(~line.rlike(r"^\s*(#.*)?$"))
    good = content.where(line.rlike(LINE))
    s, p, o = (F.regexp_extract(line, LINE, i) for i in (1, 2, 3))
    o = F.when(o.rlike(r'"@[A-Za-z0-9-]+$'), F.concat(F.regexp_extract(o, r'^(.*"@)[A-Za-z0-9-]+$', 1), F.lower(F.regexp_extract(o, r'"@([A-Za-z0-9-]+)$', 1)))).otherwise(o)
    return good.select(s.alias("s"), p.alias("p"), o.alias("o")), content.where(~line.rlike(LINE) | line.isNull()).select(line.alias("line"))


def read_ntriples(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The distinct triples of a file or folder, and its malformed lines."""
    triples, rejected = parse_lines(spark.read.text(path))
    return triples.distinct(), rejected


def to_lines(triples: DataFrame) -> DataFrame:
    return triples.select(F.concat_ws(" ", "s", "p", "o", F.lit(".")).alias("value"))


def write_ntriples(triples: DataFrame, path: str, by_partition: bool = False) -> None:
    """One line a triple; with by_partition one folder for each value of column part."""
    if by_partition:
        triples.select("part", F.concat_ws(" ", "s", "p", "o", F.lit(".")).alias("value")).write.partitionBy("part").text(path)
    else:
        to_lines(triples).write.text(path)


#: Fixed value: the base of IRIs that carry ids.
ID_BASE = "http://num.example.org#"


def synthetic_iris(encoded: DataFrame, base: str = ID_BASE) -> DataFrame:
    """Encoded triples as triples of IRIs that carry the ids."""
    return encoded.select(*[F.concat(F.lit(f"<{base}"), F.col(c).cast("string"), F.lit(">")).alias(c) for c in ("s", "p", "o")])


def with_literal_flag(triples: DataFrame) -> DataFrame:
    """s, p, o and whether the object is a literal."""
    return triples.select("s", "p", "o", is_literal(F.col("o")).alias("is_literal"))


def repartition_files(lines: DataFrame, path: str, files: int) -> None:
    """Write lines again as so many files of about equal size (1: merged; the lines come by a shuffle, so only their
    writing is one task)."""
    lines.repartition(files).write.text(path)
