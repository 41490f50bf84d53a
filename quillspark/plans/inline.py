"""Rows for queries, the same for Spark and for SQL: derived from the tables, or literal."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..session import table


def literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).upper()
    if isinstance(x, str):
        return "'" + x.replace("'", "''") + "'"
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(map(literal, x)) + "]"
    return repr(x)


class Rows:
    """Rows with a Spark schema; `sql` is a DuckDB subquery of the same rows."""

    def __init__(self, schema: str, rows: list[tuple]):
        self.schema, self.rows = schema, rows
        self.names = [part.split()[0] for part in _fields(schema)]
        kinds = [_duck(part.split(None, 1)[1]) for part in _fields(schema)]
        body = ", ".join("(" + ", ".join(literal(v) for v in r) + ")" for r in rows)
        casts = ", ".join(f"CAST({n} AS {k}) AS {n}" for n, k in zip(self.names, kinds, strict=True))
        self.sql = f"(SELECT {casts} FROM (VALUES {body}) AS v({', '.join(self.names)}))"

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema).coalesce(1)


def _fields(schema: str) -> list[str]:
    out, depth, part = [], 0, ""
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(part.strip())
            part = ""
        else:
            part += c
    return [*out, part.strip()]


def _duck(kind: str) -> str:
    kind = kind.strip()
    if kind.startswith("array<"):
        return _duck(kind[6:-1]) + "[]"
    return {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}[kind]


class Derived:
    """Rows that one SQL text, of what Spark and DuckDB write alike, derives from the given tables ({documents} and so on).

    `literal` are rows of the same columns with the odd cases, which tests put in their place.
    """

    def __init__(self, text: str, literal_: Rows | None = None):
        self.text, self.literal = " ".join(text.split("\n")), literal_
        self.tables = sorted(set(re.findall(r"(?<!\{)\{(\w+)\}", text)))
        self.sql = "(" + self.text.format(**{t: t for t in self.tables}) + ")"

    def df(self, spark: SparkSession, d: str) -> DataFrame:
        return spark.sql(self.text, **{t: table(spark, d, t) for t in self.tables})
