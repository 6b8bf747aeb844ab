"""A database that is really there (the embedded one that Spark brings along), and state that ends."""

import datetime

import pytest
from pyspark.sql import functions as F

from larkspur.sources import connectors
from larkspur.streaming import streams


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    db = connectors.create(spark, "derby", database=str(tmp_path_factory.mktemp("db") / "base"))
    db.connect()
    rows = spark.range(1, 501).select(F.col("id").alias("ID"), (F.col("id") % 7).cast("int").alias("KIND"), F.concat(F.lit("n"), "id").alias("NAME"))
    db.write_data(rows, "ITEMS", "overwrite", batch=40, connections=3)
    return db, rows


def test_parallel_reads_are_whole(base):
    db, rows = base
    want = sorted(tuple(r) for r in rows.collect())
    for n in (1, 3, 8):
        got = db.read_parallel("ITEMS", "ID", n)
        assert got.rdd.getNumPartitions() == n and sorted(tuple(r) for r in got.collect()) == want
    assert sorted(r.ID for r in db.fetch_data("ITEMS", ["ID"]).collect()) == list(range(1, 501))


def test_filters_reach_the_database(base):
    db, _ = base
    found = db.read_parallel("ITEMS", "ID", 4).filter("KIND = 3 AND ID > 100").select("NAME")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "EqualTo(KIND,3)" in plan.replace("*", "") and "GreaterThan(ID,100)" in plan.replace("*", "")
    assert found.count() == sum(i % 7 == 3 for i in range(101, 501))


def test_the_same_write_twice_adds_nothing(spark, base):
    db, rows = base
    db.write_data(rows.filter("ID <= 50"), "COPY", "overwrite")
    more = rows.filter("ID BETWEEN 30 AND 90").union(rows.filter("ID = 90"))
    for _ in range(2):
        db.write_new(more, "COPY", ["ID"], partitions=3)
        assert sorted(r.ID for r in db.fetch_data("COPY").collect()) == list(range(1, 91))


@pytest.mark.parametrize("operator", ["velocity", "rate_limited"])
def test_state_of_silent_users_ends(spark, tmp_path, operator):
    """Twenty users, then one user ten days later twice: the timers drop the others' state."""
    start = datetime.datetime(2024, 1, 1)
    for i, (users, day) in enumerate([(range(20), 0), ([99], 10), ([99], 20)]):
        rows = [(100 * i + u, u, start + datetime.timedelta(days=day, minutes=u)) for u in users]
        spark.createDataFrame(rows, "event_id bigint, user_id bigint, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    source = spark.readStream.schema("event_id bigint, user_id bigint, ts timestamp").option("maxFilesPerTrigger", 1)
    stream = source.option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    made = streams.velocity(stream, 600, 0) if operator == "velocity" else streams.rate_limited(stream, 2, 300)
    q = made.writeStream.option("checkpointLocation", str(tmp_path / "state")).format("memory").queryName(operator).trigger(availableNow=True).start()
    q.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(held) >= 20 and held[-1] <= 1
    assert spark.table(operator).count() == 22
