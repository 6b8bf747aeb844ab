"""Archives, partition listings, artifacts, outliers by an isolation forest."""

import bz2
import gzip
import lzma
import random
import zipfile

import pytest

from larkspur.operators import prepare
from larkspur.sources import files

ROWS = 'id,name,x\n1,"a, b",1.5\n2,"two\nlines",\n3,Größe,-2\n'


def test_archives_are_read_by_their_content(spark, tmp_path):
    for i, pack in enumerate((lzma.compress, bz2.compress, gzip.compress, lambda b: b)):
        (tmp_path / f"f{i}.dat").write_bytes(pack(ROWS.encode()))
    with zipfile.ZipFile(tmp_path / "f4.zip", "w") as z:
        z.writestr("in/b.csv", "name,id,x\nzip,9,4\n")  # another order of columns
        z.writestr("a.csv", ROWS)
        z.writestr("empty.csv", "id,name,x\n")
    got = files.read_archives(spark, str(tmp_path))
    assert dict(got.dtypes)["x"] == "double" and dict(got.dtypes)["name"] == "string" and dict(got.dtypes)["id"] in ("int", "bigint", "smallint", "tinyint")
    want = [(1, "a, b", 1.5), (2, "two\nlines", None), (3, "Größe", -2.0)] * 5 + [(9, "zip", 4.0)]
    assert sorted(tuple(r[c] for c in ("id", "name", "x")) for r in got.collect()) == sorted(want, key=lambda r: r[:2])
    (tmp_path / "other.xz").write_bytes(lzma.compress(b"id,wrong\n1,2\n"))
    with pytest.raises(ValueError, match="headers differ"):
        files.read_archives(spark, str(tmp_path))


def test_partitions_are_listed(spark, tmp_path):
    d = spark.range(100).selectExpr("id", "id % 3 AS k", "IF(id < 50, 'a', 'b') AS g")
    files.write(d, str(tmp_path / "t"), partition_by=["k", "g"])
    got = {(r.k, r.g): r for r in files.partitions(spark, str(tmp_path / "t")).collect()}
    assert {p: r.rows for p, r in got.items()} == {(k, g): sum(i % 3 == k and (i < 50) == (g == "a") for i in range(100)) for k in range(3) for g in "ab"}
    assert all(r.files >= 1 and r.bytes > 0 for r in got.values())


def test_artifacts_come_and_go(spark, tmp_path):
    a = files.Artifacts(spark, str(tmp_path))
    d = spark.range(10)
    assert a.save_frame("one.rows", d) == 1 and a.save_frame("one.rows", d.limit(4)) == 2 and a.save_json("two", {"x": 1}) == 1
    assert {(r.name, r.versions, r.latest) for r in a.listing().collect()} == {("one.rows", 2, 2), ("two", 1, 1)}
    assert [r.name for r in a.listing("tw").collect()] == ["two"] and a.exists("one.rows", 1) and not a.exists("one.rows", 3)
    assert a.verify("one.rows") and a.verify("one.rows", 1) and a.verify("two")
    path = a.manifest().filter("name = 'one.rows' AND version = 2").first().path
    d.limit(5).write.mode("overwrite").parquet(path)
    assert not a.verify("one.rows", 2) and a.verify("one.rows", 1)
    assert a.delete("one.rows", 2) == 1 and a.load("one.rows").count() == 10 and a.delete("nothing") == 0
    assert a.delete("one.rows") == 1 and not a.exists("one.rows")
    with pytest.raises(KeyError):
        a.verify("one.rows")


def test_isolation_forest_treats_outliers(spark):
    r = random.Random(1)
    rows = [(i, r.gauss(0, 1), r.gauss(5, 1)) for i in range(300)] + [(300 + i, 40.0 + i, -30.0) for i in range(6)] + [(400, None, 1.0)]
    d = spark.createDataFrame(rows, "id int, x double, y double")
    options = {"contamination": 6 / 306, "trees": 30}
    kept = {r.id for r in prepare.outliers_isolation(d, "id", ["x", "y"], **options).collect()}
    assert 400 in kept and not kept & set(range(300, 306)) and len(kept) >= 299
    flags = prepare.outliers_isolation(d, "id", ["x", "y"], action="flag", **options).filter("outlier").collect()
    assert {r.id for r in flags} == {i for i, *_ in rows} - kept
    capped = {r.id: r for r in prepare.outliers_isolation(d, "id", ["x", "y"], action="cap", **options).collect()}
    assert len(capped) == len(rows) and all(abs(capped[i].x) < 1 and 4 < capped[i].y < 6 for i in range(300, 306)) and capped[5].x == rows[5][1]
