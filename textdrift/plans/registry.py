"""Registry of named queries and their DuckDB oracle SQL.

``@query(name, sql=...)`` registers a ``(spark, sf_dir) -> DataFrame``
builder.  The oracle text is the same computation written independently in
SQL over the raw tables (documents, lineitem, events, ...).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def _shortest(x: str) -> str:
    """DuckDB text of the shortest decimal string that reads back as ``x``."""
    e = f"CAST(({x}) AS DOUBLE)"
    return (f"(CASE WHEN printf('%.15g', {e})::DOUBLE = {e} THEN printf('%.15g', {e}) "
            f"WHEN printf('%.16g', {e})::DOUBLE = {e} THEN printf('%.16g', {e}) "
            f"ELSE printf('%.17g', {e}) END)")


def spark_round(sql: str) -> str:
    """Make every ``round(expr, d)`` of DuckDB text round like Spark.

    Spark rounds a double half-up on its shortest decimal form; DuckDB's
    ``round`` works on the binary value, so ties such as 0.5015625 would go
    different ways.  Rounding the shortest round-trip string as a DECIMAL
    reproduces Spark.
    """
    out, i, key = [], 0, "round("
    low = sql.lower()
    while True:
        j = low.find(key, i)
        if j < 0 or (j > 0 and (low[j - 1].isalnum() or low[j - 1] == "_")):
            if j < 0:
                out.append(sql[i:])
                return "".join(out)
            out.append(sql[i:j + len(key)])
            i = j + len(key)
            continue
        depth, k, comma = 1, j + len(key), -1
        while depth:
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
            elif ch == "," and depth == 1:
                comma = k
            k += 1
        out.append(sql[i:j])
        if comma < 0:  # round(x): no digits, nothing to align
            out.append("round(" + spark_round(sql[j + len(key):k - 1]) + ")")
        else:
            inner = spark_round(sql[j + len(key):comma])
            digits = sql[comma + 1:k - 1].strip()
            out.append(f"round(TRY_CAST({_shortest(inner)} AS DECIMAL(38, 20)), {digits})::DOUBLE")
        i = k


def query(name: str, sql: str | None = None):
    def register(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = spark_round(sql)
        return fn
    return register
