"""Core operators against SQL over the test tables, and edge cases on small fixtures."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from shelfwright.plans.queries import ORACLES, QUERIES
from shelfwright.session import TABLES, materialize, release, shared_dir

SF = "/root/testdata/sf0.001"


def cell(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return v


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as from '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    cur = db.execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted((tuple(cell(r[columns.index(c)]) for c in df.columns) for r in cur.fetchall()), key=repr)
    got = sorted((tuple(cell(x) for x in r) for r in df.collect()), key=repr)
    assert got == want


def test_materialize_and_release(spark):
    df = materialize(spark.range(10))
    assert df.count() == 10 and df._shelfwright_path.startswith(shared_dir(spark))
    release(df)


def test_missing_and_keys(spark):
    from shelfwright.functions.text import key, missing, wordpunct_count

    rows = spark.createDataFrame([(None,), ("",), ("  ",), ("NULL ",), ("x",), ("Null hypothesis",), ("a_1 b-c ½!?",)], "v string")
    got = rows.select(missing(F.col("v")), key(F.col("v")), wordpunct_count(F.col("v"))).collect()
    assert [r[0] for r in got] == [True, True, True, True, False, False, False]
    assert [r[1] for r in got] == [None, None, None, None, "x", "null hypothesis", "a_1 b-c ½!?"]
    assert [r[2] for r in got] == [0, 0, 0, 1, 1, 2, 6]


def test_repeated_paths(spark):
    from shelfwright.operators.cleaning import repeated_path

    rows = spark.createDataFrame([(["a"],), (["a", "a"],), (["a", "b", "a", "b"],), (["a", "b", "a"],), ([],)], "v array<string>")
    assert [r[0] for r in rows.select(repeated_path(F.col("v"))).collect()] == [False, True, True, False, False]


def test_gtin(spark):
    from shelfwright.functions.identifiers import gtin

    rows = spark.createDataFrame([("036000291452",), ("036000291453",), ("00036000291452",), ("000000000000",), ("3.6E+10",), (None,)], "v string")
    assert [r[0] for r in rows.select(gtin(F.col("v"))).collect()] == ["00036000291452", None, "00036000291452", None, None, None]


def test_sinks(spark, tmp_path):
    from shelfwright.sources import sinks

    df = spark.createDataFrame([("=1+1", ["a"], "x"), ("b", [], "y")], "t string, l array<string>, p string")
    sinks.write_csv(df, f"file://{tmp_path}/c")
    assert sorted(spark.read.option("header", True).option("escape", '"').csv(f"file://{tmp_path}/c").collect())[0]["t"] == "'=1+1"
    sinks.write_partitioned(df, f"file://{tmp_path}/p", "p")
    sinks.write_json_lines(df, f"file://{tmp_path}/j")
    assert spark.read.json(f"file://{tmp_path}/j").count() == 2
    assert sinks.content_digest(df).collect() == sinks.content_digest(df.repartition(3)).collect()
    with pytest.raises(Exception):
        sinks.write_partitioned(df, f"file://{tmp_path}/p", "p")


def test_stream(spark, tmp_path):
    from shelfwright.streaming.events import event_stream, unique_events

    static = spark.read.parquet(f"{SF}/review_events.parquet")
    static.repartition(2).write.parquet(f"file://{tmp_path}/in")
    q = unique_events(event_stream(spark, f"file://{tmp_path}/in", static)).writeStream.format("memory").queryName("unique_events_test").option("checkpointLocation", f"file://{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("unique_events_test").count() == static.filter("event_id is not null").select("event_id").distinct().count()
