"""Plans that must stay as they are, and what happens where writers meet."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom import schema
from sparkloom.functions import porter
from sparkloom.functions import predicates as p
from sparkloom.operators import dml, fulltext, graph
from sparkloom.plans import Database, Query
from sparkloom.shared import publish, scratch
from sparkloom.sources import Bucket, Conflict, Sequence, Table
from sparkloom.streaming import feeds

NOTES = T.StructType([T.StructField("id", T.StringType()), T.StructField("tenant", T.StringType()), T.StructField("n", T.LongType())])


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def notes(spark, *rows):
    return spark.createDataFrame(rows, NOTES)


def test_record_ids_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id AS k", "id * 2 AS x").write.parquet(f"{tmp_path}/t")
    rows = spark.read.parquet(f"{tmp_path}/t").withColumn("id", F.concat(F.lit("t:"), F.col("k").cast("string")))
    db = Database(spark, {"t": rows}, keys={"t": "k"})
    got = Query().select("x").from_table("t:7").to_df(db)
    assert [r.x for r in got.collect()] == [14] and "EqualTo(k,7)" in plan(got)
    assert Query().from_table("t:none").to_df(db).isEmpty()


def test_hops_by_keys_give_what_ids_give(spark):
    nodes = lambda name, n: spark.range(n).select(F.concat(F.lit(f"{name}:"), F.col("id").cast("string")).alias("id"), F.col("id").alias("k"))
    pairs = spark.range(30).selectExpr("id % 5 AS a", "id % 7 AS b")
    edges = pairs.select(F.concat(F.lit("x:"), F.col("a").cast("string")).alias("in"), F.concat(F.lit("y:"), F.col("b").cast("string")).alias("out"))
    tables = {"x": nodes("x", 5), "y": nodes("y", 6), "e": edges}
    plain = Database(spark, tables, {"e"})
    keyed = Database(spark, tables, {"e"}, keys={"x": "k", "y": "k"}, keyed={"e": pairs.select(F.col("a").alias("in"), F.col("b").alias("out"))})
    for path in ("->e->y", "->e->y<-e<-x", "->e", "<->e"):
        q = Query().from_table("x:3").traverse(path)
        assert sorted(r.id for r in q.to_df(plain).collect()) == sorted(r.id for r in q.to_df(keyed).collect())
    assert "cast(" not in plan(Query().select("k").from_table("x:3").traverse("->e->y").to_df(keyed)).split("Join")[1]


@pytest.mark.parametrize("action", ["cascade", "unset", "ignore"])
def test_array_links_join_by_equality(spark, action):
    rows = spark.createDataFrame([("a", ["t:1", "t:2"]), ("b", ["t:3"]), ("c", []), ("d", None), ("e", ["t:1", "t:1"])], "id string, links array<string>")
    table = spark.createDataFrame([("t:1", 1), ("t:2", 2), ("t:3", 3)], "id string, n int")
    _, out = dml.delete_referenced(table, "n < 2", {"r": (rows, "links", action)})
    got = {r.id: r.links for r in out["r"].collect()}
    assert got == {"cascade": {"b": ["t:3"], "c": [], "d": None}, "unset": {"a": ["t:2"], "b": ["t:3"], "c": [], "d": None, "e": []}, "ignore": {r.id: r.links for r in rows.collect()}}[action]
    assert "NestedLoop" not in plan(out["r"])


def test_deletions_go_on_in_cycles(spark):
    link = lambda *rows: spark.createDataFrame(rows, "id string, link string")
    a, b = link(("a:1", "b:9"), ("a:2", "b:2")), link(("b:1", "a:1"), ("b:2", "a:9"))
    root = spark.createDataFrame([("r:1",)], "id string")
    start = link(("s:1", "r:1"), ("s:2", "r:2"))
    refs = {"s": (start, "link", "cascade"), "a": (a.withColumn("link", F.when(F.col("id") == "a:1", "s:1").otherwise(F.col("link"))), "link", "cascade", "s"), "b": (b, "link", "cascade", "a")}
    _, out = dml.delete_referenced(root, None, refs)
    assert {n: [r.id for r in df.collect()] for n, df in out.items()} == {"s": ["s:2"], "a": ["a:2"], "b": ["b:2"]}


def test_frontiers_meet_edges_that_stay(spark):
    edges = spark.range(40).selectExpr("concat('n:', id) AS `in`", "concat('n:', id + 1) AS out")
    got = {r.node: r.hops for r in graph.distances(edges, "n:0", 4).collect()}
    assert got == {f"n:{k}": k for k in range(5)}
    assert {r.node: r.hops for r in graph.distances(edges, ["n:0", "n:3"], 2).collect()} == {"n:0": 0, "n:1": 1, "n:2": 2, "n:3": 0, "n:4": 1, "n:5": 2}
    assert graph.distances(edges, [], 3).isEmpty()


def test_texts_are_split_once_to_filter(spark):
    rows = spark.createDataFrame([(1, "the cat THE hat"), (2, "a cat"), (3, None), (4, "")], "k int, t string")
    found = fulltext.bm25(rows, "t", "the cat")
    assert [r.k for r in found.collect()] == [1]
    assert plan(found).count("split(") == 1  # to filter and to score


def test_index_gives_the_scores_of_a_scan(spark, tmp_path):
    rows = spark.createDataFrame([(1, "the cat the hat"), (2, "a cat"), (3, None), (4, ""), (5, "hat THE")], "k int, t string")
    index = fulltext.TextIndex(spark, f"file://{tmp_path}/i").build(rows, "k", "t")
    for any_ in (False, True):
        want = {r.k: round(r.score, 9) for r in fulltext.bm25(rows, "t", "the hat", any_=any_).collect()}
        assert {r.key: round(r.score, 9) for r in index.search("the hat", any_).collect()} == want
    assert index.search("nothing").isEmpty() and index.search("hat nothing").isEmpty()
    assert {r.key: r.matches[0].places for r in index.search("the").collect()} == {1: [0, 2], 5: [1]}
    assert "In(token" in plan(index.search("the hat"))


def test_only_one_of_two_writers_commits(spark, tmp_path):
    table = Table(spark, f"file://{tmp_path}/t", NOTES)
    table.insert(notes(spark, ("n:1", "a", 1)))
    change = lambda n: table._of(table._shaped(notes(spark, ("n:1", "b", n))).withColumn("original", F.lit(None).cast(NOTES)), "update")
    base = table.version()  # both have read it
    table.commit(change(2), base)
    with pytest.raises(Conflict):
        table.commit(change(3), base)
    assert [r.n for r in table.read().collect()] == [2] and table.versions() == [1, 2]


def test_publish_keeps_what_exists(spark, tmp_path):
    for n in ("a", "b"):
        spark.range(3 if n == "a" else 5).write.parquet(f"file://{tmp_path}/{n}")
    assert publish(spark, f"file://{tmp_path}/a", f"file://{tmp_path}/to") and not publish(spark, f"file://{tmp_path}/b", f"file://{tmp_path}/to")
    assert spark.read.parquet(f"file://{tmp_path}/to").count() == 3 and spark.read.parquet(f"file://{tmp_path}/b").count() == 5


def test_two_writers_of_a_sequence_share_no_number(spark, tmp_path):
    bucket = Bucket(spark, f"file://{tmp_path}/b")
    one, two = Sequence(bucket, "s", batch=5), Sequence(bucket, "s", batch=5)
    first = one.number(spark.range(13))
    got = [r.number for r in first.collect()] + [two.next() for _ in range(6)] + [one.next() for _ in range(3)]
    assert len(set(got)) == len(got)
    claims = Sequence(bucket, "t", batch=1)
    claims._claim(3)
    assert not bucket.put_if_not_exists(f"t/{0:020}", "9") and claims._claim() == 4


def test_readers_see_a_table_whole_while_it_expires(spark, tmp_path, monkeypatch):
    table = Table(spark, f"file://{tmp_path}/t", NOTES)
    for k in range(4):
        table.insert(notes(spark, (f"n:{k}", "a", k)))
    seen = []
    real = table._files

    class Files:
        def __getattr__(self, name):
            return getattr(real, name)

        def delete(self, *args):
            seen.append(table.read().count())
            return real.delete(*args)

    monkeypatch.setattr(table, "_files", Files())
    assert table.expire(1) == 3
    assert seen and set(seen) == {4} and table.read().count() == 4 and table.read(3).count() == 3
    with pytest.raises(ValueError, match="expired"):
        table.read(2)
    assert [r.id for r in table.changes(1).collect()] == ["n:3"]


def test_unique_keys_are_enforced(spark, tmp_path):
    table = Table(spark, f"file://{tmp_path}/t", NOTES, unique=(("tenant", "n"),))
    table.insert(notes(spark, ("n:1", "a", 1), ("n:2", "a", 2), ("n:3", None, 1), ("n:4", None, 1)))
    for rows in ((("n:5", "a", 1),), (("n:5", "b", 1), ("n:6", "b", 1))):
        with pytest.raises(ValueError, match="held by 2"):
            table.insert(notes(spark, *rows))
    with pytest.raises(ValueError, match="held by 2"):
        table.update({"n": 1}, p.eq("tenant", "a"))
    table.upsert(notes(spark, ("n:1", "a", 2), ("n:2", "a", 1)))
    assert table.version() == 2


def test_tables_delete_through_each_other(spark, tmp_path):
    make = lambda n, **more: Table(spark, f"file://{tmp_path}/{n}", NOTES, originals=True, **more)
    c = make("c")
    b = make("b", references={"c": (c, "tenant", "reject")})
    a = make("a", references={"b": (b, "tenant", "cascade")})
    a.references["a"] = (a, "tenant", "unset")
    a.insert(notes(spark, ("a:1", None, 1), ("a:2", "a:1", 2)))
    b.insert(notes(spark, ("b:1", "a:1", 1), ("b:2", "a:2", 2)))
    c.insert(notes(spark, ("c:2", "b:2", 1)))
    a.delete(p.eq("id", "a:1"))
    assert [tuple(r) for r in a.read().collect()] == [("a:2", None, 2)] and [r.id for r in b.read().collect()] == ["b:2"]
    with pytest.raises(dml.Rejected):
        a.delete()
    assert a.read().count() == 1 and b.read().count() == 1


def test_views_keep_null_and_empty_groups_apart(spark, tmp_path):
    table = Table(spark, f"file://{tmp_path}/t", NOTES, originals=True)
    kept = T.StructType([T.StructField("id", T.StringType()), T.StructField("tenant", T.StringType()), T.StructField("total", T.LongType()), T.StructField("seen", T.LongType()), T.StructField("n", T.LongType())])
    view = feeds.CountedView(table, Table(spark, f"file://{tmp_path}/v", kept), ("tenant",), ("n",))
    table.insert(notes(spark, ("n:1", None, 1), ("n:2", "", 2), ("n:3", "a|b", 3)))
    table.upsert(notes(spark, ("n:2", "", 5), ("n:4", None, 7)))
    for k in range(2):  # a batch that comes again counts once
        view.refresh(table.log(1, 2), k)
    assert {(r.tenant, r.total, r.n) for r in view.read().collect()} == {(None, 2, 8), ("", 1, 5), ("a|b", 1, 3)}


# Words and their published stems.
STEMS = {"consistency": "consist", "knackeries": "knackeri", "generously": "generous", "hopping": "hop", "hoping": "hope", "cries": "cri", "gas": "gas", "skies": "sky", "happy": "happi", "relational": "relat", "agreed": "agre", "controlling": "control", "youth": "youth", "electrical": "electr", "dying": "die", "succeeding": "succeed"}


@pytest.mark.parametrize("word", list(STEMS))
def test_stems(word):
    assert porter.stem(word) == STEMS[word]


def test_definitions_contradict_themselves():
    for params, body, returns in (((("x", "int"), ("x", "int")), "x", "int"), ((("x", "none"),), "x", "int"), ((("x", "int"),), " ", "int"), ((("1x", "int"),), "1", "int")):
        with pytest.raises(schema.SchemaError):
            schema.FunctionDef("fn::f", params, body, returns)
    own = schema.Registry()
    own.register(schema.table("a", schema.string_field("s"), indexes=(schema.Index("i", ("none",)), schema.Index("v", ("s",), "hnsw", dimension=3), schema.Index("f", ("s",), "fulltext"))), schema.edge("e", "a", "b"), schema.edge("g", "e", "a"))
    assert [(x.severity, x.table, x.name) for x in own.problems()] == [("error", "a", "i"), ("error", "a", "v"), ("error", "e", "b"), ("warning", "g", "e")]


def test_snapshots_of_definitions():
    old, new = schema.Registry(), schema.Registry()
    old.register(schema.table("a", schema.int_field("n")), schema.table("b"))
    new.register(schema.table("a", schema.float_field("n")), schema.table("c"))
    new.define("param", "limit", 5)
    assert schema.Registry.compared(old.snapshot(), new.snapshot()) == [("added", "param", "limit"), ("modified", "tables", "a"), ("dropped", "tables", "b"), ("added", "tables", "c")]
    assert schema.Registry.compared(old.snapshot(), old.snapshot()) == []
    with pytest.raises(schema.SchemaError):
        new.define("none", "x", 1)


def test_scratch_is_shared(spark):
    assert scratch(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
