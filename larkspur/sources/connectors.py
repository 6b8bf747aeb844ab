"""Databases by JDBC and the catalog, as one registry: create('postgres', host=...), or from environment variables
{TYPE}_{PARAMETER}. A source is a context manager; reading before connect() raises ConnectionError."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Source:
    """connect, execute_query, fetch_data, write_data, close."""

    required: tuple[str, ...] = ()

    def __init__(self, spark: SparkSession, **params: str):
        missing = [p for p in self.required if not params.get(p)]
        if missing:
            raise ValueError(f"missing parameters: {', '.join(missing)}")
        self.spark, self.params, self.connected = spark, params, False

    def connect(self) -> Source:
        self.connected = True
        return self

    def close(self) -> None:
        self.connected = False

    def __enter__(self) -> Source:
        return self.connect()

    def __exit__(self, *_) -> None:
        self.close()

    def _check(self) -> None:
        if not self.connected:
            raise ConnectionError("connect() first")

    def execute_query(self, query: str) -> DataFrame:
        raise NotImplementedError

    def fetch_data(self, table: str, columns: list[str] | None = None) -> DataFrame:
        self._check()
        df = self.execute_query(f"SELECT * FROM {table}")
        return df.select(*columns) if columns else df


class Jdbc(Source):
    """Partitioned reads where a column and its bounds are given; fetch size keeps a task's memory bounded."""

    required = ("host", "database", "user")
    driver, port, scheme = "", "", ""

    def url(self) -> str:
        p = self.params
        return f"jdbc:{self.scheme}://{p['host']}:{p.get('port', self.port)}/{p['database']}"

    def options(self) -> dict[str, str]:
        p = self.params
        return {"url": self.url(), "driver": self.driver, "user": p["user"], "password": p.get("password", ""), "fetchsize": p.get("fetchsize", "10000")}

    def execute_query(self, query: str) -> DataFrame:
        self._check()
        return self.spark.read.format("jdbc").options(**self.options(), query=query).load()

    def read_partitioned(self, table: str, column: str, low: int, high: int, partitions: int) -> DataFrame:
        self._check()
        bounds = {"partitionColumn": column, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(partitions)}
        return self.spark.read.format("jdbc").options(**self.options(), dbtable=table, **bounds).load()

    def read_parallel(self, table: str, column: str, partitions: int) -> DataFrame:
        """The table in ``partitions`` ranges of a whole-number column, whose bounds the database gives; rows without a value
        are in the first. Filters and columns of what is built on it are pushed to the database."""
        r = self.execute_query(f"SELECT MIN({column}) AS lo, MAX({column}) AS hi FROM {table}").first()
        if r[0] is None or r[0] == r[1] or partitions < 2:
            self._check()
            return self.spark.read.format("jdbc").options(**self.options(), dbtable=table).load()
        return self.read_partitioned(table, column, int(r[0]), int(r[1]) + 1, partitions)

    def write_data(self, df: DataFrame, table: str, mode: str = "append", batch: int = 5_000, connections: int = 16) -> None:
        """Batches of ``batch`` rows over at most ``connections`` connections. A task that is run again may add its rows again:
        see ``write_new``."""
        self._check()
        sized = {"batchsize": str(batch), "numPartitions": str(connections)}
        df.write.format("jdbc").mode(mode).options(**self.options(), **sized, dbtable=table).save()

    def write_new(self, df: DataFrame, table: str, keys: list[str], column: str | None = None, partitions: int = 8, **options: int) -> None:
        """Appends the rows whose keys the table does not have, one for each key, so the same write twice adds nothing. The
        table's keys are read in parallel ranges of ``column`` (by default the first key)."""
        there = self.read_parallel(table, column or keys[0], partitions)
        names = {c.lower(): c for c in there.columns}
        known = there.select(*[F.col(f"`{names[k.lower()]}`").alias(f"__{k}") for k in keys])
        same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
        self.write_data(df.dropDuplicates(keys).join(known, same, "left_anti"), table, **options)


class Postgres(Jdbc):
    driver, port, scheme = "org.postgresql.Driver", "5432", "postgresql"


class Derby(Jdbc):
    """A database in a folder of this machine: for tests and single machines, as only one JVM may open it."""

    required, driver = ("database",), "org.apache.derby.jdbc.EmbeddedDriver"

    def url(self) -> str:
        return f"jdbc:derby:{self.params['database']};create=true"

    def options(self) -> dict[str, str]:
        return {"url": self.url(), "driver": self.driver, "fetchsize": self.params.get("fetchsize", "10000")}


class MySql(Jdbc):
    driver, port, scheme = "com.mysql.cj.jdbc.Driver", "3306", "mysql"


class Redshift(Jdbc):
    driver, port, scheme = "com.amazon.redshift.jdbc42.Driver", "5439", "redshift"


class Snowflake(Jdbc):
    required = ("account", "database", "user")
    driver, scheme = "net.snowflake.client.jdbc.SnowflakeDriver", "snowflake"

    def url(self) -> str:
        return f"jdbc:snowflake://{self.params['account']}.snowflakecomputing.com/?db={self.params['database']}"


class Catalog(Source):
    """Hive or any catalog of the session: SQL as it is."""

    def execute_query(self, query: str, args: dict | None = None) -> DataFrame:
        self._check()
        return self.spark.sql(query, args=args)


REGISTRY: dict[str, Callable[..., Source]] = {"postgres": Postgres, "mysql": MySql, "redshift": Redshift, "snowflake": Snowflake, "hive": Catalog, "derby": Derby}


def register(name: str, factory: Callable[..., Source]) -> None:
    REGISTRY[name] = factory


def create(spark: SparkSession, name: str, **params: str) -> Source:
    if name not in REGISTRY:
        raise ValueError(f"unknown source {name}; known: {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name](spark, **params)


def from_environment(spark: SparkSession, name: str, environ: dict[str, str] | None = None) -> Source:
    """Parameters from variables such as POSTGRES_HOST."""
    env, prefix = environ if environ is not None else dict(os.environ), f"{name.upper()}_"
    return create(spark, name, **{k[len(prefix) :].lower(): v for k, v in env.items() if k.startswith(prefix)})
