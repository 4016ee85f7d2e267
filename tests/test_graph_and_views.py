"""Paths as numbers, paths from both ends, fetched arrays, maintained views, and what definitions compare by."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom import migrations, schema, shared
from sparkloom.functions import expressions as e
from sparkloom.functions import predicates as p
from sparkloom.ids import RecordId
from sparkloom.operators import graph
from sparkloom.plans import Database
from sparkloom.sources import Table
from sparkloom.streaming import feeds


def edges_of(spark, pairs):
    return spark.createDataFrame([(f"n:{a}", f"n:{b}") for a, b in pairs], "in string, out string")


def some_pairs(seed: int, nodes: int, n: int) -> list[tuple[int, int]]:
    rng = random.Random(seed)
    return [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(n)]


def test_paths_are_counted_by_node(spark):
    pairs = some_pairs(1, 12, 60)
    want = {("n:0", "n:0"): 1, ("n:1", "n:1"): 2}
    for _ in range(4):
        now: dict = {}
        for (start, node), k in want.items():
            for a, b in pairs:
                if f"n:{a}" == node:
                    now[start, f"n:{b}"] = now.get((start, f"n:{b}"), 0) + k
        want = now
    at = spark.createDataFrame([("n:0", "n:0"), ("n:1", "n:1"), ("n:1", "n:1")], "start string, node string")
    found = graph.counted(at, edges_of(spark, pairs), graph.OUT, 4)
    assert {(r.start, r.node): r.paths for r in found.collect()} == want and sum(want.values()) > 100 * len(want) / 12
    rows = graph.hop(at, edges_of(spark, pairs), graph.OUT, 4).groupBy("start", "node").count().collect()
    assert {(r.start, r.node): r["count"] for r in rows} == want
    tables = {"e": edges_of(spark, pairs)}
    n = sum(k for (start, _), k in want.items() if start == "n:0")
    q = graph.GraphQuery("n:0").out("e", 2).out("e").out("e")
    assert q.count(tables) == n == q.to_df(tables).count() and q.limit(3).count(tables) == 3 and q.exists(tables) and not q.limit(0).exists(tables)
    with pytest.raises(ValueError):
        graph.counted(at, tables["e"], graph.OUT, 0)


def test_shortest_paths_from_both_ends(spark):
    pairs = sorted(set(some_pairs(2, 60, 150)))
    edges = edges_of(spark, pairs).cache()
    ahead: dict[int, set] = {}
    for a, b in pairs:
        ahead.setdefault(a, set()).add(b)
    hops, frontier, k = {0: 0}, {0}, 0
    while frontier:
        k += 1
        frontier = {b for a in frontier for b in ahead.get(a, ())} - hops.keys()
        hops |= dict.fromkeys(frontier, k)
    far = max(hops.values())
    assert far > 2
    some = [next(n for n, k in hops.items() if k == d) for d in range(1, far + 1)][-4:]
    for end in some:
        r = graph.shortest(edges, "n:0", f"n:{end}", 20).collect()
        assert len(r) == 1 and r[0].hops == hops[end] and r[0].nodes[0] == "n:0" and r[0].nodes[-1] == f"n:{end}" and len(r[0].nodes) == hops[end] + 1
        assert all((int(x["in"][2:]), int(x["out"][2:])) in pairs for x in r[0].edges)
        assert [x["in"] for x in r[0].edges] == r[0].nodes[:-1] and [x["out"] for x in r[0].edges] == r[0].nodes[1:]
    assert graph.shortest(edges, "n:0", f"n:{some[-1]}", far - 1).isEmpty() and graph.shortest(edges, "n:0", "n:999", 9).isEmpty()
    assert graph.path_to(edges, "n:0", "n:0", 3) == ["n:0"] and graph.path_to(edges, "n:0", "n:999", 3) == []


def test_frontiers_that_are_too_large_meet_dealt_edges(spark, monkeypatch):
    edges = edges_of(spark, some_pairs(3, 40, 120)).cache()
    want = {(r.node, r.hops) for r in graph.distances(edges, "n:0", 4, graph.BOTH).collect()}
    monkeypatch.setattr(graph, "BROADCAST_NODES", 2)
    assert {(r.node, r.hops) for r in graph.distances(edges, "n:0", 4, graph.BOTH).collect()} == want


def test_fetched_arrays_keep_order_repeats_and_gaps(spark):
    target = spark.createDataFrame([(f"t:{k}", k) for k in range(3)], "id string, n int")
    rows = spark.createDataFrame([(1, ["t:2", "t:0", "t:2", "t:9"]), (2, []), (3, None), (4, [None, "t:1"]), (5, ["t:2", "t:0", "t:2", "t:9"])], "k int, links array<string>")
    got = {r.k: None if r.links is None else [x and x.n for x in r.links] for r in graph.fetch(rows, "links", target).collect()}
    assert got == {1: [2, 0, 2, None], 2: [], 3: None, 4: [None, 1], 5: [2, 0, 2, None]}
    inner = spark.createDataFrame([(1, ("t:1", "x")), (2, ("t:7", "y"))], "k int, s struct<link: string, other: string>")
    found = {r.k: (r.s.link and r.s.link.n, r.s.other) for r in graph.fetch(inner, "s.link", target).collect()}
    assert found == {1: (1, "x"), 2: (None, "y")}


def test_edges_at_a_record_are_looked_up_by_key(spark, tmp_path):
    spark.range(100).selectExpr("id AS a", "id % 10 AS b").write.parquet(f"{tmp_path}/e")
    raw = spark.read.parquet(f"{tmp_path}/e")
    nodes = spark.range(10).selectExpr("id AS k", "concat('b:', id) AS id")
    db = Database(spark, {"e": raw.selectExpr("concat('a:', a) AS `in`", "concat('b:', b) AS out"), "b": nodes, "a": nodes}, {"e"}, keys={"b": "k", "a": "k"}, keyed={"e": raw.selectExpr("a AS `in`", "b AS out")}, ends={"e": ("a", "b")})
    at = db.edges_at("e", "a:13")
    assert [tuple(r) for r in at.collect()] == [(13, 3)] and "EqualTo(a,13)" in at._jdf.queryExecution().executedPlan().toString()
    assert db.edges_at("e", "b:3", graph.IN).count() == 10 and db.edges_at("e", "a:3", graph.IN).isEmpty() and db.edges_at("e", "b:3", graph.BOTH).count() == 10
    assert [r.id for r in db.related("e", "a:13").collect()] == ["b:3"] and "EqualTo(a,13)" in db.related("e", "a:13")._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        db.related("e", "a:13", graph.BOTH)


def test_a_view_follows_its_tables(spark, tmp_path):
    rng = random.Random(6)
    kind = T.StructType([T.StructField("id", T.StringType()), T.StructField("g", T.StringType()), T.StructField("n", T.LongType())])
    a, b = (Table(spark, f"file://{tmp_path}/{x}", kind, originals=True) for x in "ab")
    rows = lambda some: spark.createDataFrame(some, kind)
    joined = lambda t: t["a"].join(t["b"].select("g", F.col("n").alias("m")), "g", "left")
    view = feeds.QueryView({"a": a, "b": b}, f"file://{tmp_path}/v", joined, ("g",), {"least": F.min("n"), "mean": F.avg("m"), "kinds": F.count_distinct("n"), "rows": F.count("*")})
    group = lambda: rng.choice(["x", "y", "z", None])
    a.insert(rows([(f"a:{k}", group(), rng.randrange(9)) for k in range(30)]))
    b.insert(rows([(f"b:{k}", group(), rng.randrange(9)) for k in range(6)]))

    def check() -> None:
        view.refresh()
        want = view._query(joined({"a": a.read(), "b": b.read()})).drop("id")
        assert sorted(map(repr, map(tuple, view.read().collect()))) == sorted(map(repr, map(tuple, want.collect())))

    check()
    assert view.refresh() == 0
    a.upsert(rows([("a:1", "new", 100), ("a:2", "y", -5), ("a:99", None, 1)]))
    check()
    a.delete("g = 'z'")
    b.delete("g = 'z' OR g = 'x'")  # both sides of a group go before the view follows
    check()
    a.delete("g = 'x'")
    b.insert(rows([("b:9", "new", 4)]))
    check()
    a.delete()
    check()
    assert view.read().isEmpty()


def test_equal_definitions_are_equal(spark):
    make = lambda n: schema.TableDef("t", (schema.int_field("x", check=p.and_(p.gt("x", n), p.inside("x", [1, 2]))),), permission=p.eq("owner", "me"))
    assert schema.differences([make(1)], [make(1)]) == [] and [c.kind for c in schema.differences([make(1)], [make(2)])] == ["modify field"]
    one, two = schema.Registry(), schema.Registry()
    one.register(make(1))
    two.register(make(1))
    assert one.snapshot() == two.snapshot() and " at 0x" not in one.snapshot()
    assert repr(p.gt("x", 1)) != repr(p.gt("y", 1)) and repr(p.gt("x", 1)) != repr(p.gte("x", 1)) and repr(~p.gt("x", 1)) != repr(p.gt("x", 1))


def test_small_forms(spark, monkeypatch):
    assert migrations.statements("SELECT 2; /* ; */ SELECT 3; /* only\na comment; */") == ("SELECT 2", "SELECT 3")
    assert migrations.statements("SELECT '/* ; */' AS a /* in ; between */, 1; -- x ; y\nSELECT 4") == ("SELECT '/* ; */' AS a /* in ; between */, 1", "SELECT 4")
    rows = spark.createDataFrame([("2020-01-01",), ("2020-01-01T10:00:00",), ("2020-01-01T10:00:00+02:00",), ("2020-13-01",), ("x",)], "t string")
    got = [r[0] for r in rows.select(F.date_format(e.to_datetime("t").build(rows), "yyyy-MM-dd HH:mm")).collect()]
    assert got == ["2020-01-01 00:00", "2020-01-01 10:00", "2020-01-01 08:00", None, None]
    for key in ("-7", "a", "a b", 7, -7):
        assert RecordId.parse(str(RecordId("n", key))) == RecordId("n", key)
    assert RecordId.parse("n:⟨7⟩").key == "7" and RecordId.parse("n:7").key == 7
    monkeypatch.setattr(shared, "ONE_STEP", ("hdfs",))
    with pytest.raises(NotImplementedError):
        shared.publish(spark, "file:///tmp/none", "file:///tmp/other")
