"""Shared helpers: tables, words, shared storage and batch iteration."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lower-cases A-Z and turns each byte outside 0-9, a-z and 0x80-0xFF into a blank, so ``split()`` gives the words
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the lower-cased text (every byte of a non-ASCII character is >= 0x80).
WORD_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def words(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8 bytes; None has none."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_TABLE).split() if text else []


#: Rows of an Arrow batch between the JVM and Python: texts can be long, so batches are short.
BATCH_ROWS = 1024
_HOT: list = [None]


def sole(owner) -> None:
    """Before an operator (None: one that remembers nothing) works in a worker, what another one remembers there is
    forgotten, so a worker that serves several operators holds one memory, not all of them."""
    if _HOT[0] is not owner:
        if _HOT[0] is not None:
            _HOT[0].forget()
        _HOT[0] = owner


def short_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of this session, if they are longer."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only where it is unset and Spark runs on
    this machine alone a folder of our own is made and removed at exit."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="larkspur-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Paths of the tables written so far and not dropped.
_MADE: list[str] = []


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
        _MADE.remove(path)


def drop(df: DataFrame) -> None:
    """Deletes a stored() table that nothing reads any more."""
    names = {f.rsplit("/", 2)[-2] for f in df.inputFiles()}
    _delete(df.sparkSession, [p for p in _MADE if p.rsplit("/", 1)[-1] in names])


@contextmanager
def temporary(spark: SparkSession):
    """Tables stored inside are deleted at the end, but for those given to the function that this yields."""
    start, kept = len(_MADE), set()

    def keep(*tables: DataFrame) -> None:
        kept.update(f.rsplit("/", 2)[-2] for df in tables for f in df.inputFiles())

    yield keep
    _delete(spark, [p for p in _MADE[start:] if p.rsplit("/", 1)[-1] not in kept])


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, survives lost executors."""
    short_batches(df.sparkSession)
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches, rows: int = 256, owner=None) -> Iterator:
    """Record batches cut to at most ``rows`` rows, so that only so many texts are Python objects at a time. The worker
    remembers for ``owner`` alone, and Arrow gives back after each batch what it would keep for later ones."""
    sole(owner)
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        pa.default_memory_pool().release_unused()


def crc32_mod(column: str, n: int):
    """crc32(column as text) mod n; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(n))
