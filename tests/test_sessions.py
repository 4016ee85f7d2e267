"""What callers see and change, and frames kept by their plans."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.cache import Cache
from sparkloom.functions import predicates as p
from sparkloom.operators import graph
from sparkloom.plans import Database, Query
from sparkloom.plans.session import Forbidden, Session
from sparkloom.sources import Table

KIND = T.StructType([T.StructField("id", T.StringType()), T.StructField("owner", T.StringType()), T.StructField("n", T.LongType())])


@pytest.fixture
def notes(spark, tmp_path):
    table = Table(spark, f"file://{tmp_path}/notes", KIND, originals=True)
    table.insert(spark.createDataFrame([("note:1", "ann", 1), ("note:2", "bob", 2), ("note:3", "ann", 3), ("note:4", None, 4)], KIND))
    return table


@pytest.fixture
def sessions(spark, notes):
    links = spark.createDataFrame([("note:1", "note:2"), ("note:1", "note:3"), ("note:3", "note:1")], "in string, out string")
    db = Database(spark, {"links": links}, {"links"}, ends={"links": ("note", "note")})
    own = lambda caller: p.eq("owner", caller["name"])
    rules = {"note": {"select": own, "create": own, "update": lambda c: p.and_(own(c), p.lt("n", 100)), "delete": lambda c: c["name"] == "bob"}}
    return [Session(db, {"name": n}, rules, {"note": notes}) for n in ("ann", "bob")]


def ids(df) -> list[str]:
    return sorted(r[0] for r in df.select("id").collect())


def test_callers_read_and_hop_over_their_own_rows(sessions):
    ann, bob = sessions
    assert ids(ann.read("note")) == ["note:1", "note:3"] and ids(bob.read("note")) == ["note:2"]
    assert ids(ann.run(Query().from_table("note").where_("n > 1"))) == ["note:3"]
    assert ids(ann.run(Query().from_table("note:1").traverse("->links->note"))) == ["note:3"]  # the hop to bob's note isn't there
    assert [r.node for r in graph.GraphQuery("note:1").out("links").to_df(ann.database().tables).collect()] == ["note:3"]
    assert bob.run(Query().from_table("note").traverse("->links->note")).isEmpty()


def test_callers_write_their_own_rows(spark, sessions, notes):
    ann, bob = sessions
    row = lambda *x: spark.createDataFrame([x], KIND)
    for refused in (lambda: ann.insert("note", row("note:9", "bob", 1)), lambda: ann.upsert("note", row("note:2", "ann", 1)), lambda: ann.upsert("note", row("note:1", "bob", 1)), lambda: ann.update("note", {"owner": F.lit("bob")}), lambda: bob.update("note", {"n": F.lit(500)})):
        version = notes.version()
        with pytest.raises(Forbidden):
            refused()
        assert notes.version() == version
    ann.insert("note", row("note:5", "ann", 5))
    ann.upsert("note", row("note:1", "ann", 10))
    bob.update("note", {"n": F.col("n") + 1})
    ann.delete("note")  # her rule allows none
    bob.delete("note", "n > 0")
    assert {tuple(r) for r in notes.read().collect()} == {("note:1", "ann", 10), ("note:3", "ann", 3), ("note:4", None, 4), ("note:5", "ann", 5)}


def test_callers_follow_their_own_rows(spark, sessions, tmp_path):
    got = []
    ann, _ = sessions
    q = ann.live("note", "n > 1").writeStream.foreachBatch(lambda df, _: got.extend(r.id for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert got == ["note:3"]


def test_frames_are_kept_by_their_plans(spark, notes):
    cache = Cache()
    make = lambda n: notes.read().where(p.gt("n", n).build(notes.read()))
    first = cache.plan(make(1))
    assert cache.plan(make(1)) is first and cache.plan(make(2)) is not first and (cache.hits, cache.misses) == (1, 2)
    notes.delete("n = 4")
    assert cache.plan(make(1)) is not first and cache.plan(make(1)).count() == 2 and first.count() == 3
    cache.clear()
