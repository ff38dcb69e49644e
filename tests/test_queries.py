"""Registered queries against their SQL on the smallest tables, on another engine."""

import math
import os
from datetime import date

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(v):
    if v is None or isinstance(v, str):
        return v
    if hasattr(v, "isoformat"):
        return str(v)
    v = float(v)
    return "nan" if math.isnan(v) else round(v, 3) + 0.0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    got = sorted(str([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    cursor = duck.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(str([plain(dict(zip(columns, row, strict=True))[c]) for c in sorted(columns)]) for row in cursor.fetchall())
    assert got == want


def test_missing_quarters_of_treated_suppliers(spark, tmp_path):
    """One treated supplier misses a quarter that others of its event time have, another is the only one of its event time and misses it."""
    gone = {(13, 15), (10, 20), (7, 3), (2, 11)}
    rows = [(u, date(2000 + t // 4, 3 * (t % 4) + 1, 5), float((u * 37 + t * 91 + u * t * 13) % 101) * 100 + 5000) for u in range(16) for t in range(20) if (u, t + 1) not in gone]
    spark.createDataFrame(rows, "l_suppkey long, l_shipdate date, l_extendedprice double").withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp")).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    df = registry.queries()["event_intervals_jackknife"](spark, str(tmp_path))
    want = con.execute(registry.oracle_sql()["event_intervals_jackknife"]).fetchall()
    assert sorted(str([plain(v) for v in r]) for r in df.collect()) == sorted(str([plain(v) for v in r]) for r in want)


def test_streamed_panel_equals_batch(spark, tmp_path):
    from tessera.streaming import event_panels

    events = spark.read.parquet(f"{DATA}/events.parquet").select("user_id", "ts", "value")
    source = str(tmp_path / "in")
    events.write.parquet(source)
    stream = spark.readStream.schema(events.schema).parquet(source)
    event_panels.write_panel(stream, str(tmp_path / "out"), str(tmp_path / "state"), "user_id", "ts", "value", lateness="0 seconds").awaitTermination()
    last = events.agg({"ts": "max"}).first()[0]
    done = spark.read.parquet(str(tmp_path / "out"))
    batch = event_panels.windowed(events, "user_id", "ts", "value")
    closed = batch.where(f"time + interval 1 day <= timestamp'{last}'")
    key = lambda r: (r["unit"], r["time"], round(r["y"], 6), r["n_events"])
    assert sorted(map(key, done.collect())) == sorted(map(key, closed.collect()))
