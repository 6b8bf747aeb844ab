"""Files: CSV with detected encoding, delimiter and types, Parquet, JSON, SQL on files, partitioned and compressed output,
and a manifest of artifacts. Detection reads a bounded head through Spark's readers, so any store they reach will do."""

from __future__ import annotations

import bz2
import codecs
import csv
import gzip
import hashlib
import io
import json
import lzma
import zipfile
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators.profile import type_plan

DELIMITERS = [",", ";", "\t", "|", " "]


def _head(spark: SparkSession, path: str, size: int) -> bytes:
    """The first bytes of a file, through Hadoop's file systems; no more is read."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(at)
    try:
        return bytes(stream.readNBytes(size))
    finally:
        stream.close()


def detect_encoding(spark: SparkSession, path: str, head: int = 10_000) -> str:
    """UTF-8 (with or without mark), UTF-16 by mark, else Latin-1, from the first bytes of one file. A character that the
    end of the head cuts is no error."""
    first = spark.read.format("binaryFile").load(path).select("path").orderBy("path").first()
    raw = _head(spark, first.path, head) if first else b""
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "UTF-16"
    try:
        codecs.getincrementaldecoder("utf-8")().decode(raw, final=len(raw) < head)
        return "UTF-8"
    except UnicodeDecodeError:
        return "ISO-8859-1"


def detect_delimiter(spark: SparkSession, path: str, lines: int = 10) -> str:
    """The delimiter with the highest mean count times consistency over the first lines."""
    found = [r.value for r in spark.read.text(path).limit(lines).collect()]

    def score(d: str) -> float:
        counts = [x.count(d) for x in found]
        mean = sum(counts) / max(1, len(counts))
        spread = (sum((c - mean) ** 2 for c in counts) / max(1, len(counts))) ** 0.5
        return mean / (1 + spread)

    return max(DELIMITERS, key=score) if found else ","


def read_csv(spark: SparkSession, paths: str | list[str], delimiter: str | None = None, encoding: str | None = None, types: dict[str, str] | None = None, infer: bool = True, ignore_header_mismatch: bool = False) -> DataFrame:
    """Several files or globs as one frame. Headers are compared as sets; types are planned in one aggregation over text
    columns (never by sampling rows) and cast once; what does not cast is null."""
    paths = sorted([paths] if isinstance(paths, str) else paths)
    delimiter = delimiter or detect_delimiter(spark, paths[0])
    encoding = encoding or detect_encoding(spark, paths[0])
    frames = [spark.read.csv(p, header=True, sep=delimiter, encoding=encoding) for p in paths]
    if not ignore_header_mismatch and any(set(f.columns) != set(frames[0].columns) for f in frames):
        raise ValueError("headers differ: " + "; ".join(f"{p}: {sorted(f.columns)}" for p, f in zip(paths, frames, strict=True)))
    df = frames[0]
    for f in frames[1:]:
        df = df.unionByName(f, allowMissingColumns=ignore_header_mismatch)
    plan = dict(types or {})
    if infer and (rest := [c for c in df.columns if c not in plan]):
        plan |= {r.column: "string" if r.type == "category" else r.type for r in type_plan(df, rest).collect()}
    cast = {c: F.try_to_timestamp(F.col(c)) if k == "timestamp" else F.col(c).try_cast(k) for c, k in plan.items()}
    return df.withColumns(cast)


def read_archives(spark: SparkSession, path: str, delimiter: str = ",", encoding: str = "utf-8", infer: bool = True) -> DataFrame:
    """CSV inside zip (all members), xz, bz2 or gzip archives that Spark's own reader does not open, by the content of the file;
    all members have the same columns, in any order. An archive cannot be split: it is one task, which unpacks and parses it as a
    stream. Empty fields are null; types are planned in one aggregation."""

    def rows(batches):
        for batch in batches:
            for content in batch.column(0).to_pylist():
                for member in _members(content):
                    reader = csv.reader(io.TextIOWrapper(member, encoding=encoding, newline=""), delimiter=delimiter)
                    head = next(reader, None)
                    held: list[list[str]] = []
                    for values in reader:
                        held.append(values)
                        if len(held) == 4096:
                            yield _lines(head, held)
                            held = []
                    if head is not None:
                        yield _lines(head, held)

    def _lines(head: list[str], held: list[list[str]]) -> pa.RecordBatch:
        n = len(held) or 1  # a row of nulls carries the header of an empty file
        kind = pa.list_(pa.string())
        return pa.RecordBatch.from_arrays([pa.array([head] * n, kind), pa.array(held or [None], kind)], names=["head", "row"])

    raw = spark.read.format("binaryFile").load(path).select("content")
    found = raw.mapInArrow(rows, "head array<string>, row array<string>")
    heads = [r[0] for r in found.select(F.array_sort("head")).distinct().limit(2).collect()]
    if len(heads) > 1:
        raise ValueError(f"headers differ: {heads[0]}, {heads[1]}")
    if not heads:
        raise ValueError(f"no header in {path}")
    names = list(found.select("head").first()[0])
    at = {c: F.array_position("head", c).cast("int") - 1 for c in names}
    df = found.filter("row IS NOT NULL").select(*[F.nullif(F.get("row", at[c]), F.lit("")).alias(c) for c in names])
    if not infer:
        return df
    plan = {r.column: "string" if r.type == "category" else r.type for r in type_plan(df, names).collect()}
    return df.withColumns({c: F.try_to_timestamp(F.col(c)) if k == "timestamp" else F.col(c).try_cast(k) for c, k in plan.items()})


def _members(content: bytes):
    """Open files of an archive, told by its first bytes; what is none is one file."""
    whole = io.BytesIO(content)
    if content[:4] == b"PK\x03\x04":
        with zipfile.ZipFile(whole) as z:
            for name in sorted(z.namelist()):
                if not name.endswith("/"):
                    with z.open(name) as f:
                        yield f
        return
    opened = {b"\xfd7zXZ": lzma.open, b"BZh": bz2.open, b"\x1f\x8b": gzip.open}
    yield next((f(whole) for mark, f in opened.items() if content.startswith(mark)), whole)


def partitions(spark: SparkSession, path: str) -> DataFrame:
    """The partitions of a partitioned table: its partition columns, files, bytes and rows of each. Rows come from the
    files' footers, no column is read."""
    df = spark.read.parquet(path)
    # partition columns stand last, in the order of the folders below the table
    names = [c for c in df.columns if c in _folder_columns(spark, path)]
    rows = df.select(*names, F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("b")).groupBy(*names, "f", "b").agg(F.count("*").alias("n"))
    return rows.groupBy(*names).agg(F.count("*").alias("files"), F.sum("b").alias("bytes"), F.sum("n").alias("rows"))


def _folder_columns(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders name=value on the way to the first file."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs, out = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), []
    while True:
        below = [s.getPath() for s in fs.listStatus(hadoop) if s.isDirectory() and "=" in s.getPath().getName()]
        if not below:
            return out
        hadoop = below[0]
        out.append(hadoop.getName().split("=", 1)[0])


def read_chunks(df: DataFrame, size: int = 10_000):
    """An iterator of lists of rows, one partition on the driver at a time."""
    chunk = []
    for row in df.toLocalIterator(prefetchPartitions=False):
        chunk.append(row)
        if len(chunk) == size:
            yield chunk
            chunk = []
    if chunk:
        yield chunk


def query_csv(df: DataFrame, expression: str) -> DataFrame:
    return df.filter(expression)


def file_info(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """file, bytes, rows of every file."""
    df = spark.read.format(fmt).load(path)
    return df.groupBy(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("bytes")).agg(F.count("*").alias("rows"))


def sql_on_files(spark: SparkSession, text: str, args: dict | None = None, **frames: DataFrame) -> DataFrame:
    """SQL with frames in braces ({orders}) and named parameters (:from); parquet.`path` works in FROM."""
    return spark.sql(text, args=args, **frames)


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partition_by: list[str] | None = None, compression: str | None = None, **options) -> None:
    """csv (with a header unless told otherwise), parquet, json, orc; partitioned and compressed if wanted."""
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        options.setdefault("header", "true")
    if compression:
        options["compression"] = compression
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.options(**options).save(path)


def append_new(df: DataFrame, path: str, key: list[str]) -> None:
    """Appends only rows whose key is not there yet (conflict: do nothing)."""
    spark = df.sparkSession
    here = spark.read.parquet(path).select(*key)
    df.join(here, key, "left_anti").write.mode("append").parquet(path)


def _digest(df: DataFrame) -> str:
    """Rows and the sum of their hashes: the same for the same rows in any order."""
    r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h")).first()
    return f"{r.n}:{r.h}"


class Artifacts:
    """Versioned frames and JSON documents under a root that Spark reaches, with a manifest of name, version, path,
    digest and tags."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def manifest(self) -> DataFrame:
        kind = "name string, version int, kind string, path string, digest string, tags map<string,string>, at string"
        try:
            return self.spark.read.schema(kind).json(f"{self.root}/manifest/*")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], kind)

    def _next(self, name: str) -> int:
        return (self.manifest().filter(F.col("name") == name).agg(F.max("version").alias("v")).first().v or 0) + 1

    def _note(self, name: str, version: int, kind: str, path: str, digest: str, tags: dict | None) -> None:
        row = [(name, version, kind, path, digest, tags or {}, datetime.now(UTC).isoformat())]
        d = self.spark.createDataFrame(row, "name string, version int, kind string, path string, digest string, tags map<string,string>, at string")
        d.coalesce(1).write.json(f"{self.root}/manifest/{name}-{version}")

    def save_frame(self, name: str, df: DataFrame, tags: dict | None = None) -> int:
        version = self._next(name)
        path = f"{self.root}/data/{name}/{version}"
        df.write.parquet(path)
        made = self.spark.read.parquet(path)
        self._note(name, version, "parquet", path, _digest(made), tags)
        return version

    def save_json(self, name: str, value: dict, tags: dict | None = None) -> int:
        version = self._next(name)
        path, text = f"{self.root}/data/{name}/{version}", json.dumps(value, sort_keys=True)
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
        self._note(name, version, "json", path, hashlib.sha256(text.encode()).hexdigest(), tags)
        return version

    def exists(self, name: str, version: int | None = None) -> bool:
        m = self.manifest().filter(F.col("name") == name)
        return not (m.filter(F.col("version") == version) if version else m).isEmpty()

    def listing(self, prefix: str = "") -> DataFrame:
        """name, kind, versions and the latest of every artifact whose name begins so."""
        m = self.manifest().filter(F.col("name").startswith(prefix))
        return m.groupBy("name", "kind").agg(F.count("*").alias("versions"), F.max("version").alias("latest"), F.max("at").alias("at"))

    def delete(self, name: str, version: int | None = None) -> int:
        """Deletes a version, or all, with its note; how many there were. The note goes first: what breaks off leaves data
        that nothing names, never a name without data."""
        m = self.manifest().filter(F.col("name") == name)
        found = (m.filter(F.col("version") == version) if version else m).select("version", "path").collect()
        for r in found:
            for path in (f"{self.root}/manifest/{name}-{r.version}", r.path):
                hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
        return len(found)

    def verify(self, name: str, version: int | None = None) -> bool:
        """Whether the data of a version (the latest) still has the digest that its note says."""
        m = self.manifest().filter(F.col("name") == name)
        row = (m.filter(F.col("version") == version) if version else m.orderBy(F.desc("version"))).first()
        if row is None:
            raise KeyError(f"no artifact {name} of version {version or 'any'}")
        if row.kind == "json":
            return hashlib.sha256(self.spark.read.text(row.path).first().value.encode()).hexdigest() == row.digest
        return _digest(self.spark.read.parquet(row.path)) == row.digest

    def load(self, name: str, version: int | None = None):
        m = self.manifest().filter(F.col("name") == name)
        m = m.filter(F.col("version") == version) if version else m.orderBy(F.desc("version"))
        row = m.first()
        if row is None:
            raise KeyError(f"no artifact {name} of version {version or 'any'}")
        return self.spark.read.parquet(row.path) if row.kind == "parquet" else json.loads(self.spark.read.text(row.path).first().value)
