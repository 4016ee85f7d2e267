"""Snapshots in buckets, times, and transactions over the tables of a store."""

from __future__ import annotations

from datetime import timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions import predicates as p
from sparkloom.operators import dml
from sparkloom.sources import Conflict, Store, Table, Transaction, Work

ROW = T.StructType([T.StructField("id", T.StringType()), T.StructField("link", T.StringType()), T.StructField("n", T.LongType())])


def rows(spark, *some):
    return spark.createDataFrame(some, ROW)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def of(df) -> set:
    return {tuple(r) for r in df.collect()}


def test_reads_dont_shuffle_the_snapshot(spark, tmp_path):
    table = Table(spark, f"file://{tmp_path}/t", ROW)
    table.insert(spark.range(500).selectExpr("concat('r:', id) AS id", "'x' AS link", "id AS n"))
    table.snapshot()
    assert "Exchange" not in plan(table.read()).replace("BroadcastExchange", "").split("Union")[0] and table.read().count() == 500
    table.update({"n": F.lit(-1)}, p.eq("id", "r:3"))
    table.delete("n = 4")
    table.insert(rows(spark, ("r:new", None, 7)))
    found = table.read()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        shown = plan(table.read())
        snapshot = shown.split("Union")[1].split("FileScan")[0]
        assert "hashpartitioning" not in snapshot and "BroadcastHashJoin" in snapshot
        one = plan(table.read(record="r:7"))
        assert "_bucket" in one.split("PartitionFilters: ")[1].split("]")[0] and "EqualTo(id,r:7)" in one
        assert plan(table.read().where("id = 'r:7'")).count("EqualTo(id,r:7)") == 3
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert found.count() == 500 and of(table.read(record="r:3")) == {("r:3", "x", -1)} and of(table.read(record="r:new")) == {("r:new", None, 7)}
    assert table.read(record="r:4").isEmpty() and of(table.read(1, record="r:4")) == {("r:4", "x", 4)}
    before = of(table.read())
    table.snapshot()
    assert of(table.read()) == before and table.read(record="r:nope").isEmpty()


def test_ids_that_are_null_or_repeated(spark, tmp_path):
    table = Table(spark, f"file://{tmp_path}/t", ROW)
    for bad in (rows(spark, ("a", None, 1), ("a", None, 2)), rows(spark, (None, None, 1))):
        for write in (table.insert, table.upsert, table.merge):
            with pytest.raises(ValueError):
                write(bad)
    assert table.version() == 0
    table.insert(rows(spark, ("a", None, 1)))
    with pytest.raises(ValueError, match="exists"):
        Transaction(table).run(dml.insert, rows(spark, ("a", None, 2)))
    twice = rows(spark, ("a", None, 1), ("a", None, 2))
    for f in (dml.upsert, dml.merge):
        with pytest.raises(Exception, match="comes twice"):
            f(table.read(), twice).collect()


def test_times_and_age(spark, tmp_path):
    table = Table(spark, f"file://{tmp_path}/t", ROW, originals=True)
    for k in range(3):
        table.insert(rows(spark, (f"r:{k}", None, k)))
    when = table.times()
    assert sorted(when) == [1, 2, 3] and sorted(when.values()) == list(when.values())
    assert table.read(when[2]).count() == table.version_at(when[2]) and table.read(when[1] - timedelta(seconds=1)).isEmpty()
    assert {r.id for r in table.changes(when[1]).collect()} == {f"r:{k}" for k in range(table.version_at(when[1]), 3)}
    assert table.expire(timedelta(days=1)) == 1 and table.versions() == [1, 2, 3]
    assert table.expire(timedelta(seconds=1), when[3] + timedelta(seconds=1)) == 3 and table.read().count() == 3
    with pytest.raises(ValueError, match="expired"):
        table.read(2)
    assert table.changes(1).isEmpty()


def store_of(spark, tmp_path) -> Store:
    store = Store(spark, f"file://{tmp_path}/s")
    leaves = store.table("leaf", ROW, originals=True)
    nodes = store.table("node", ROW, originals=True, references={"leaf": (leaves, "link", "cascade")})
    store.table("root", ROW, originals=True, references={"node": (nodes, "link", "cascade")})
    one = Work(store)
    one.insert("root", rows(spark, ("root:1", None, 1), ("root:2", None, 2)))
    one.insert("node", rows(spark, ("node:1", "root:1", 1), ("node:2", "root:2", 2)))
    one.insert("leaf", rows(spark, ("leaf:1", "node:1", 1), ("leaf:2", "node:2", 2), ("leaf:3", "node:1", 3)))
    assert one.commit() == 1
    return store


def again(store: Store) -> Store:
    """What another driver finds."""
    out = Store(store.spark, store.root)
    for name, t in store.tables.items():
        out.table(name, t.schema, originals=True)
    return out


def test_a_cascade_is_seen_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    from sparkloom.sources import store as module

    class Stopped(Exception):
        pass

    for stops_at, whole in ((1, False), (2, True), (3, True), (4, True)):
        store, calls = store_of(spark, tmp_path / str(stops_at)), []
        publish = module.publish

        def stopping(*args, calls=calls, publish=publish, stops_at=stops_at):  # the entry, then a table at a time
            calls.append(args)
            if len(calls) == stops_at:
                raise Stopped
            return publish(*args)

        monkeypatch.setattr(module, "publish", stopping)
        with pytest.raises(Stopped):
            store.tables["root"].delete("id = 'root:1'")
        monkeypatch.setattr(module, "publish", publish)
        later = again(store)
        n = {name: t.read().count() for name, t in later.tables.items()}
        assert n == ({"leaf": 1, "node": 1, "root": 1} if whole else {"leaf": 3, "node": 2, "root": 2})
        assert later.version() == (2 if whole else 1) and later.tables["leaf"].read(1).count() == 3


def test_writers_of_different_rows_both_succeed(spark, tmp_path):
    store = store_of(spark, tmp_path)
    a, b, c, d = Work(store), Work(store), Work(store), Work(store)
    a.update("leaf", {"n": F.lit(10)}, p.eq("id", "leaf:1"))
    b.update("leaf", {"n": F.lit(20)}, p.eq("id", "leaf:2")).insert("root", rows(spark, ("root:3", None, 3)))
    c.update("leaf", {"n": F.col("n") + 1}, "n >= 10")  # reads what a has made meanwhile
    d.upsert("leaf", rows(spark, ("leaf:1", None, 0)))
    assert a.commit() == 2 and b.commit() == 3
    for w in (c, d):
        with pytest.raises(Conflict):
            w.commit()
        with pytest.raises(RuntimeError):
            w.commit()
    assert of(store.tables["leaf"].read()) == {("leaf:1", "node:1", 10), ("leaf:2", "node:2", 20), ("leaf:3", "node:1", 3)}
    assert of(again(store).tables["root"].read().select("id")) == {("root:1",), ("root:2",), ("root:3",)}
    assert store.tables["leaf"].changes(2).select("version", "id").collect() == [(2, "leaf:1"), (3, "leaf:2")]


def test_statements_see_those_before(spark, tmp_path):
    store = store_of(spark, tmp_path)
    w = Work(store)
    w.insert("leaf", rows(spark, ("leaf:9", "node:1", 9))).update("leaf", {"n": F.col("n") * 2}, "n > 2").merge("leaf", spark.createDataFrame([("leaf:3", "node:2")], "id string, link string"))
    w.delete("leaf", "id = 'leaf:1'").insert("leaf", rows(spark, ("leaf:1", None, 0)))
    want = {("leaf:1", None, 0), ("leaf:2", "node:2", 2), ("leaf:3", "node:2", 6), ("leaf:9", "node:1", 18)}
    assert of(w.rows("leaf")) == want and store.tables["leaf"].read().count() == 3
    with pytest.raises(ValueError):
        w.insert("leaf", rows(spark, ("leaf:9", None, 0)))
    w.insert("leaf", rows(spark, ("leaf:x", None, 0))).delete("leaf", "id = 'leaf:x'")
    w.commit()
    assert of(store.tables["leaf"].read()) == want
    assert {(r.id, r.action) for r in store.tables["leaf"].changes(2).collect()} == {("leaf:1", "update"), ("leaf:3", "update"), ("leaf:9", "create")}
    out = Work(store).delete("root")
    assert out.rows("leaf").select("id").collect() == [("leaf:1",)] or out.rows("leaf").count() == 1
    out.rollback()
    assert store.version() == 2 and Work(store).commit() == 2


def test_unique_keys_of_a_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    t = store.table("t", ROW, unique=(("n",),))
    t.insert(rows(spark, ("a", None, 1)))
    one, two = Work(store), Work(store)
    one.insert("t", rows(spark, ("b", None, 2)))
    two.insert("t", rows(spark, ("c", None, 2)))
    one.commit()
    with pytest.raises(Conflict):
        two.commit()
    with pytest.raises(ValueError, match="held by"):
        Work(store).insert("t", rows(spark, ("d", None, 1))).commit()
