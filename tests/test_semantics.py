"""Small tables whose results are known."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sparkloom import results
from sparkloom.cache import Cache
from sparkloom.functions import expressions as e
from sparkloom.functions import field
from sparkloom.functions import predicates as p
from sparkloom.ids import IdError, RecordId
from sparkloom.operators import dml, fulltext, graph, vector
from sparkloom.plans import Database, Query
from sparkloom.plans import hints


@pytest.fixture(scope="module")
def db(spark):
    out = Database(spark)
    out.tables["memory"] = spark.createDataFrame([("m:1", "default", 1.0), ("m:2", "default", 3.0), ("m:3", "other", 5.0)], "id string, network string, strength double")
    out.tables["person"] = spark.createDataFrame([("person:alice", "Alice", "acme"), ("person:bob", "Bob", "acme"), ("person:charlie", "Charlie", "globex"), ("person:isolated", "I", "acme")], "id string, name string, tenant string")
    out.tables["follows"] = spark.createDataFrame([("person:alice", "person:bob"), ("person:bob", "person:charlie"), ("person:alice", "person:charlie"), ("person:alice", "person:bob")], "in string, out string")
    out.tables["doc"] = spark.createDataFrame([("doc:1", "An insider told the insider desk"), ("doc:2", "Nothing here"), ("doc:3", "the Insider"), ("doc:4", None)], "id string, content string")
    out.edges.add("follows")
    return out


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_record_ids():
    assert str(RecordId("user", "alice")) == "user:alice" and str(RecordId("user", "a.b")) == "user:⟨a.b⟩"
    assert RecordId.parse("user:⟨a.b⟩") == RecordId.parse("user:<a.b>") == RecordId("user", "a.b")
    assert RecordId.parse("t:123").key == 123 and str(RecordId("t", "123")) == "t:123"
    for bad in ("user", "1x:2", "t:"):
        with pytest.raises(IdError):
            RecordId.parse(bad)


def test_aggregates(db):
    q = Query().select(e.as_(e.count(), "total"), e.as_(e.math_sum("strength"), "sum"), e.as_(e.math_mean("strength"), "mean")).from_table("memory").group_all()
    assert rows(q.to_df(db)) == [(3, 9.0, 3.0)]
    by = Query().select("network", e.as_(e.count(), "n"), e.as_(e.sum_("strength"), "s")).from_table("memory").group_by("network").order_by("network")
    assert rows(by.to_df(db)) == [("default", 2, 4.0), ("other", 1, 5.0)]
    with pytest.raises(ValueError, match="fields"):
        Query().from_table("memory").group_all().to_df(db)


def test_builder_refuses(db):
    for f in (lambda q: q.limit(-1), lambda q: q.offset(-1), lambda q: q.order_by("a", "up"), lambda q: q.from_table("a b"), lambda q: q.traverse("->"), lambda q: q.vector_search("v", [], 1), lambda q: q.vector_search("v", [1.0], 0), lambda q: q.fulltext_search("c", ""), lambda q: q.search_score("s")):
        with pytest.raises(ValueError):
            f(Query())
    with pytest.raises(ValueError, match="no table"):
        Query().to_df(db)


def test_order_paging_and_results(db):
    q = Query().select("id").from_table("memory").order_by("strength", "desc")
    assert [r.id for r in q.to_df(db).collect()] == ["m:3", "m:2", "m:1"]
    assert results.one(q.first().to_df(db)) == {"id": "m:3"} and results.one(q.last().to_df(db)) == {"id": "m:1"}
    page = results.paged(q, db, 2, 2)
    assert page.rows == [{"id": "m:1"}] and page.pages == 2 and page.total == 3
    assert results.listed(q.limit(2), db, counted=True).has_more and results.listed(q.limit(2), db).has_more and not results.listed(q, db).has_more
    assert results.count_records(db, "memory", p.gt("strength", 2)) == 2 and results.exists(db, "memory:9") is False and results.exists(db, "memory:m") is False
    assert results.scalar(Query().from_table("memory").limit(0).to_df(db), "x", 7) == 7


def test_null_comparisons(spark):
    df = spark.createDataFrame([(1, None), (2, "a"), (3, "b")], "k int, t string")
    ids = lambda c: [r.k for r in df.where(c.column(df)).orderBy("k").collect()]
    assert ids(p.eq("t", None)) == [1] and ids(p.ne("t", None)) == [2, 3] and ids(p.ne("t", "a")) == [3]
    assert ids(p.not_inside("t", ["a"])) == [3] and ids(p.is_none("t")) == ids(p.is_null("t")) == [1]
    assert ids(p.or_("k = 1", p.and_(p.is_not_null("t"), p.not_(p.eq("t", "a"))))) == [1, 3]


def test_null_and_absent_in_variants(spark):
    df = spark.sql("SELECT k, parse_json(j) AS d FROM VALUES (1, '{\"a\": null}'), (2, '{}'), (3, '{\"a\": 5}') AS t(k, j)")
    ids = lambda c: [r.k for r in df.where(c.column(df)).orderBy("k").collect()]
    assert ids(p.is_null("d.a")) == [1] and ids(p.is_none("d.a")) == [2] and ids(p.is_not_none("d.a")) == [1, 3] and ids(p.gt("d.a", 4)) == [3]
    assert ids(e.type_is("d.a", "int")) == [3]


def test_expressions(spark):
    df = spark.createDataFrame([(2.5, -2.5, [1, 2, 3], "Ab")], "x double, y double, xs array<int>, t string")
    q = lambda x: df.select(x.column(df)).first()[0]
    assert q(e.round_("x")) == 3.0 and q(e.round_("y")) == -3.0 and q(e.math_sum("xs")) == 6.0 and q(e.math_max("xs")) == 3
    assert q(field("x") / 0) is None and q(field("x") - 0.5) == 2.0 and q(e.concat("t", "'-'", "t")) == "Ab-Ab" and q(e.func("upper", "t")) == "AB"
    assert q(e.cast("t", "int")) is None and q(e.type_is("xs", "array")) is True and q(p.contains_all("xs", [1, 3])) is True and q(p.contains_any("xs", [9])) is False
    with pytest.raises(ValueError):
        e.time_format("t", "%Q")


def test_traversal(db):
    t = db.tables
    assert graph.count_related(t["follows"], "person:alice") == 3 and graph.count_related(t["follows"], "person:charlie", graph.IN) == 2
    g = graph.GraphQuery("person:alice").out("follows").to("person")
    assert g.count(t) == 3 and g.where(p.eq("tenant", "globex")).count(t) == 1 and g.where("tenant = 'acme'").where("name = 'Bob'").count(t) == 2
    assert g.exists(t) and not graph.GraphQuery("person:charlie").out("follows").to("person").exists(t)
    assert rows(graph.GraphQuery("person:alice").out("follows", 2).to("person").select("name").to_df(t)) == [("Charlie",), ("Charlie",)]
    assert rows(graph.GraphQuery("person:charlie").in_("follows").to("person").select("name").limit(5).to_df(t)) == [("Alice",), ("Bob",)]
    assert graph.GraphQuery("person:bob").both("follows").count(t) == 3
    assert rows(Query().select("name").from_table("person:alice").traverse("->follows->person").to_df(db)) == [("Bob",), ("Bob",), ("Charlie",)]


def test_shortest_paths(db):
    t = db.tables
    assert [r.hops for r in graph.shortest_path(t["follows"], t["person"], "person:alice", "person:charlie", 5).collect()] == [1]
    assert graph.shortest_path(t["follows"], t["person"], "person:alice", "person:isolated", 5).isEmpty()
    assert graph.shortest_path(t["follows"], t["person"], "person:alice", "person:alice", 5).isEmpty()
    assert graph.shortest_path(t["follows"], t["person"], "person:alice", "person:bob", 0).isEmpty()
    chain = t["follows"].where("out != 'person:charlie' or in = 'person:bob'")
    assert graph.path_to(chain, "person:alice", "person:charlie", 5) == ["person:alice", "person:bob", "person:charlie"]
    cycle = t["follows"].unionByName(t["follows"].sparkSession.createDataFrame([("person:charlie", "person:alice")], "in string, out string"))
    assert [r.hops for r in graph.shortest_path(cycle, t["person"], "person:alice", "person:alice", 5).collect()] == [2]


def test_references(spark):
    comics = spark.createDataFrame([("comic:1", "One"), ("comic:2", "Two")], "id string, title string")
    people = spark.createDataFrame([("person:mat", "Mat", ["comic:1"], "comic:1"), ("person:nyn", "Nynaeve", ["comic:1", "comic:2"], None)], "id string, name string, comics array<string>, favourite string")
    back = {r.id: r.owners for r in graph.reverse_references(comics, people, "comics", "owners", "name").collect()}
    assert back == {"comic:1": ["Mat", "Nynaeve"], "comic:2": ["Nynaeve"]}
    assert graph.fetch(people, "favourite", comics).orderBy("id").first().favourite.title == "One"
    _, out = dml.delete_referenced(comics, "id = 'comic:1'", {"a": (people, "comics", "unset"), "b": (people, "favourite", "cascade"), "c": (people, "favourite", "unset"), "d": (people, "comics", "ignore")})
    assert {r.id: r.comics for r in out["a"].collect()} == {"person:mat": [], "person:nyn": ["comic:2"]}
    assert [r.id for r in out["b"].collect()] == ["person:nyn"] and {r.favourite for r in out["c"].collect()} == {None} and out["d"].count() == 2
    with pytest.raises(dml.Rejected):
        dml.delete_referenced(comics, None, {"x": (people, "comics", "reject")})


def test_vectors(spark):
    near = spark.createDataFrame([("near:1", [1.0, 2.0, 3.0]), ("near:2", [1.1, 2.0, 3.0]), ("near:3", None), ("near:4", [0.0, 0.0, 0.0])], "id string, v array<double>")
    assert [r.id for r in vector.knn(near, "v", [1.0, 2.0, 3.0], 2).collect()] == ["near:1", "near:2"]
    axis = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 1.0]), ("c", [0.0, 1.0])], "id string, v array<double>")
    got = vector.knn(axis, "v", [1.0, 0.0], 3).collect()
    assert [round(r.distance, 4) for r in got] == [0.0, 0.2929, 1.0]
    assert [r.id for r in vector.knn(axis, "v", [1.0, 0.0], 3, threshold=0.5).collect()] == ["a", "b"]
    assert [r.id for r in vector.knn_hashed(axis, "v", [1.0, 0.0], 3).collect()] == ["a", "b", "c"]
    with pytest.raises(NotImplementedError):
        vector.knn(axis, "v", [1.0], 1, "mahalanobis")


@pytest.mark.parametrize("norm", [0.01, 1, 10, 100])
def test_hashed_search_finds_the_nearest(spark, norm):
    """Recall at 10 over the rows whose id is divisible by 100, at several norms."""
    rng = random.Random(4)
    vectors = [[rng.gauss(0, 1) for _ in range(32)] for _ in range(400)]
    vectors = [[norm * x / math.sqrt(sum(y * y for y in v)) for x in v] for v in vectors]
    rows = spark.createDataFrame(list(enumerate(vectors)), "id long, v array<double>").cache()
    for k in range(0, 400, 100):
        want = [r.id for r in vector.knn(rows, "v", vectors[k], 10, "euclidean").collect()]
        assert [r.id for r in vector.knn_hashed(rows, "v", vectors[k], 10).collect()] == want


def test_nearest_neighbour_join_in_blocks(spark, monkeypatch):
    """Blocks give what all pairs give, with ties, copies, several lengths, nulls and non-finite values; a block, not a pair, is a row."""
    monkeypatch.setattr(vector, "BLOCK", 7)
    rng = random.Random(6)
    own = [(f"k{k}", [float(rng.randint(-2, 2)) for _ in range(3 + k % 2)]) for k in range(120)]
    own += [("k5", [1.0, 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), ("n1", None), ("n2", [1.0, None, 0.0]), ("n3", [math.nan] * 3), ("n4", [math.inf, 0.0, 0.0]), ("n5", []), ("n6", [])]
    rows = spark.createDataFrame(own, "id string, v array<double>").repartition(3)
    asked = rows.where("substring(id, 2) % 3 = 0 or id like 'n%'")
    pairs = asked.select(F.col("id").alias("query"), F.col("v").alias("q")).join(rows, F.col("query") != F.col("id"))
    best = defaultdict(list)
    for r in pairs.withColumn("d", vector.distance("euclidean", F.col("q"), F.col("v"))).where("d is not null").collect():
        best[r.query].append((math.isnan(r.d), 0.0 if math.isnan(r.d) else r.d, r.id))
    want = {(q, i, n + 1) for q, x in best.items() for n, (_, _, i) in enumerate(sorted(x)[:4])}
    found = vector.knn_join(asked, rows, "v", 4, "euclidean")
    assert {(r.query, r.id, r["rank"]) for r in found.collect()} == want
    assert "MapInArrow" in found._jdf.queryExecution().toString()


def test_full_text(db, spark):
    found = lambda q, **k: [r.id for r in Query().from_table("doc").fulltext_search("content", q, **k).to_df(db).orderBy("id").collect()]
    assert found("insider") == ["doc:1", "doc:3"] and found("cryptocurrency") == [] and found("insider desk") == ["doc:1"] and found("desk nothing", any_=True) == ["doc:1", "doc:2"]
    scored = Query().select("id", "score").from_table("doc").fulltext_search("content", "insider").search_score("score").order_by("score", "desc").to_df(db).collect()
    assert {r.id for r in scored} == {"doc:1", "doc:3"} and all(r.score > 0 for r in scored)
    one = spark.createDataFrame([("fooBar baz-qux Élan running parties",)], "t string")
    tokens = lambda a: one.select(a.tokens(F.col("t"))).first()[0]
    assert tokens(fulltext.Analyzer(("camel", "punct"), ("lowercase",)))[:4] == ["foo", "bar", "baz", "qux"]
    assert tokens(fulltext.Analyzer(("blank",), ("ascii", "lowercase", "snowball")))[2:] == ["elan", "run", "parti"]
    assert tokens(fulltext.Analyzer(("class",), (("ngram", 2, 3),)))[:4] == ["fo", "oo", "oB", "Ba"]
    fused = fulltext.fused([spark.createDataFrame([(1, 3.0), (2, 2.0)], "k int, s double"), spark.createDataFrame([(2, 9.0)], "k int, s double")], "k", "s")
    assert fused.orderBy(F.desc("score")).first().k == 2


def test_changes(db, spark):
    own = db.tables["memory"]
    patch = spark.createDataFrame([("m:1", None, True)], "id string, network string, seen boolean")
    assert rows(dml.merge(own, patch))[0] == ("m:1", None, 1.0, True)
    assert rows(dml.replace(own, spark.createDataFrame([("m:1", 8.0), ("m:9", 9.0)], "id string, strength double")).where("strength > 4"))[0][0] == "m:1"
    after = dml.update(own, {"strength": field("strength") + 1}, p.eq("network", "default"))
    assert rows(dml.returned(own, after, dml.BEFORE)) == [("m:1", "default", 1.0), ("m:2", "default", 3.0)]
    assert [r.field for r in dml.returned(own, after, dml.DIFF).collect()] == ["strength", "strength"] and dml.returned(own, after, dml.NONE).isEmpty()
    assert rows(dml.returned(own, dml.delete(own, "strength < 2"), dml.FULL).select("id", "after")) == [("m:1", None)]
    nested = spark.createDataFrame([("n:1", (1, "x"))], "id string, s struct<a:int,b:string>")
    assert dml.update(nested, {"s.a": 5}).first().s.a == 5
    assert dml.delete_ids(own, own.where("strength > 2")).count() == 1
    edges = dml.relate(db.tables["follows"].limit(0), spark.createDataFrame([("person:alice", "person:nobody"), ("person:bob", "person:alice")], "in string, out string"), db.tables["person"], db.tables["person"])
    assert rows(edges) == [("person:bob", "person:alice")] and dml.unrelate(edges, "person:bob", "person:alice").isEmpty()


def test_hints_and_cache(db, spark, capsys):
    q = Query().from_table("memory").hint(hints.Parallel(3), hints.Parallel(2), hints.Timeout(60))
    assert q.to_df(db).rdd.getNumPartitions() == 2 and len(list(hints.rows(q.to_df(db), q.hints))) == 3
    Query().from_table("memory").hint(hints.Explain()).to_df(db)
    assert "Physical Plan" in capsys.readouterr().out
    for bad in (lambda: hints.Parallel(33), lambda: hints.Timeout(0), lambda: hints.Fetch("batch", 0), lambda: Query().from_table("memory").hint(hints.Index("other", "i")).to_df(db)):
        with pytest.raises(ValueError):
            bad()
    now = [0.0]
    cache = Cache(ttl=10, most=2, clock=lambda: now[0])
    made = []

    @cache.cached("memory")
    def frame(n):
        made.append(n)
        return spark.range(n)

    assert frame(3).count() == frame(3).count() == 3 and made == [3]
    now[0] = 11
    frame(3), frame(4), frame(5)
    assert made == [3, 3, 4, 5] and cache.evictions == 1 and cache.hits == 1
    assert cache.invalidate_table("memory") == 2 and cache.invalidate("*") == 0
