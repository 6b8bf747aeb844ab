"""The registered queries: name -> function of (spark, folder), and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larkspur.session import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of Tables under a name."""

    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            SQL[name] = sql
        return f

    return register


def type_sql(columns: dict[str, str], table: str) -> str:
    """SQL of profile.type_plan over text expressions of a table, by name."""
    whole = """CASE WHEN min(x::BIGINT) >= 0 AND max(x::BIGINT) < 255 THEN 'smallint' WHEN min(x::BIGINT) >= -128 AND max(x::BIGINT) <= 127 THEN 'tinyint'
  WHEN min(x::BIGINT) >= -32768 AND max(x::BIGINT) <= 32767 THEN 'smallint' WHEN min(x::BIGINT) >= -2147483648 AND max(x::BIGINT) <= 2147483647 THEN 'int' ELSE 'bigint' END"""
    kind = f"""CASE WHEN bool_and(lower(x) IN ('true', 'false', '1', '0', 'yes', 'no', 'y', 'n', 't', 'f')) THEN 'boolean' WHEN bool_and(regexp_full_match(x, '[+-]?[0-9]+')) THEN {whole.replace("x::BIGINT", "TRY_CAST(x AS BIGINT)")}
  WHEN bool_and(TRY_CAST(x AS DOUBLE) IS NOT NULL) THEN 'double' WHEN bool_and(TRY_CAST(x AS TIMESTAMP) IS NOT NULL) THEN 'timestamp'
  WHEN count(DISTINCT x) < count(*) / 2 AND count(DISTINCT x) < 1000 THEN 'category' ELSE 'string' END"""
    return " UNION ALL ".join(f"SELECT '{name}' AS \"column\", {kind} AS type FROM (SELECT {x} AS x FROM {table})" for name, x in columns.items())
