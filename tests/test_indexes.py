"""Stored vector and text indexes: growth by generations, exactness, recall, and what searches read."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import fulltext, vector
from sparkloom.operators.vectorindex import CodeIndex, Graph, GraphIndex, defined
from sparkloom.plans import Database, Query, hints


def clustered(spark, n: int = 1500, dim: int = 16):
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 10, (30, dim))
    rows = [(k, (centres[k % 30] + rng.normal(0, 1, dim)).tolist()) for k in range(n)]
    return spark.createDataFrame([*rows, (n, None), (n + 1, [1.0, None] * 8), (n + 2, [float("nan")] * dim), (n + 3, [1.0]), (None, [0.0] * dim)], "k long, v array<double>")


@pytest.mark.parametrize(("kind", "metric"), [(GraphIndex, "euclidean"), (CodeIndex, "cosine")])
def test_search_finds_the_nearest_and_reads_few_rows(spark, tmp_path, kind, metric):
    rows = clustered(spark)
    whole = rows.where("k < 1500")
    asked = whole.where("k % 100 = 0")
    index = kind(spark, f"file://{tmp_path}/i", metric, unit=50).build(rows, "k", "v")
    true = {}
    for r in vector.knn_join(asked, whole, "v", 5, metric, "k").collect():
        true.setdefault(r.query, {})[r["rank"]] = (r.k, round(r.distance, 8))
    exact = {}
    for r in index.search_many(asked, "k", "v", 5, exact=True, but_own=True).collect():
        exact.setdefault(r.query, {})[r["rank"]] = (r.key, round(r.distance, 8))
    assert exact == true
    found = index.search_many(asked, "k", "v", 5, but_own=True).collect()
    assert len(found) == 75 and sum(any(r.key == k for k, _ in true[r.query].values()) for r in found) >= 0.9 * 75
    one = whole.where("k = 7").first()["v"]
    assert index.rows_read([one]) < 1500 / 3
    assert index.search(one, 1).first()["key"] == 7 and index.search(one, 3, exact=True).count() == 3
    assert index.search_many(asked.limit(0), "k", "v", 5).isEmpty()


@pytest.mark.parametrize("kind", [GraphIndex, CodeIndex])
def test_generations_change_delete_and_merge(spark, tmp_path, kind):
    rows = clustered(spark, 200)
    index = kind(spark, f"file://{tmp_path}/i", unit=40).build(rows.where("k < 100"), "k", "v")
    v = {r.k: r.v for r in rows.where("k < 200").collect()}
    near = lambda k: index.search(v[k], 1, exact=True).first()["key"]
    assert near(150) != 150
    index.append(rows.where("k >= 100"), "k", "v")
    index.append(spark.createDataFrame([(0, v[199])], "k long, v array<double>"), "k", "v")
    assert near(150) == 150 and {r.key for r in index.search(v[199], 2).collect()} == {0, 199}
    index.delete(spark.createDataFrame([(199,), (-1,)], "k long"), "k")
    assert index.search(v[199], 2).collect()[0]["key"] == 0
    assert near(0) != 0 and len(index.generations.numbers()) == 4
    index.merge()
    assert len(index.generations.numbers()) == 1 and index.generations.expire() == 4
    assert index.search(v[199], 1).first()["key"] == 0 and index.search(v[0], 500, probes=99).count() == 199


def test_graph_reaches_every_node():
    rng = np.random.default_rng(1)
    x = np.concatenate((rng.normal(0, 1, (60, 4)), rng.normal(500, 1, (60, 4)), np.zeros((30, 4))))
    graph = Graph.build(x, [k % 3 == 0 for k in range(150)], 6, 20)
    assert max(len(n[0]) for n in graph.links) <= 14
    assert [j for _, j in graph.search(x[70], 1)] == [70]
    assert len(graph.search(x[0], 150)) == 150 and Graph(x[:0], []).search(x[0], 3) == []


def test_equal_vectors_and_small_tables(spark, tmp_path):
    rows = spark.createDataFrame([(k, [1.0, 0.0]) for k in range(300)], "k long, v array<double>")
    index = GraphIndex(spark, f"file://{tmp_path}/i", unit=32).build(rows, "k", "v")
    assert [r.key for r in index.search([1.0, 0.0], 4, exact=True).collect()] == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        GraphIndex(spark, f"file://{tmp_path}/j").build(rows.limit(0), "k", "v")
    with pytest.raises(ValueError):
        index.search([1.0, 0.0], 0)
    assert isinstance(defined(spark, "x", "diskann", hashed=True), CodeIndex) and isinstance(defined(spark, "x", "hnsw"), GraphIndex)
    with pytest.raises(ValueError):
        defined(spark, "x", "mtree")


def test_a_query_reads_the_index_of_its_table(spark, tmp_path):
    rows = spark.createDataFrame([(f"p:{k}", [float(k), 1.0], k) for k in range(100)], "id string, v array<double>, n int")
    db = Database(spark, {"p": rows})
    db.indexes["p", "v"] = GraphIndex(spark, f"file://{tmp_path}/i").build(rows, "id", "v")
    q = Query().from_table("p").vector_search_indexed("v", [40.2, 1.0], 3, ef=20)
    assert [r.id for r in q.order_by("distance").to_df(db).collect()] == ["p:40", "p:41", "p:39"]
    assert [r.id for r in q.where_("n > 40").order_by("distance").to_df(db).collect()] == ["p:41", "p:42", "p:43"]
    with pytest.raises(ValueError):
        Query().vector_search_indexed("v", [1.0], 1, ef=0)


def sentence(rng: random.Random) -> str:
    return " ".join(rng.choices(["the", "cat", "hat", "sat", "on", "mat", "rare", "zebra"], [9, 5, 4, 4, 6, 3, 0.2, 0.02], k=rng.randint(0, 30)))


def test_segments_give_the_rows_of_a_rebuild(spark, tmp_path):
    rng = random.Random(3)
    texts = {k: sentence(rng) for k in range(1200)}
    frame = lambda some: spark.createDataFrame(list(some), "k long, t string")
    index = fulltext.TextIndex(spark, f"file://{tmp_path}/i").build(frame(list(texts.items())[:900]), "k", "t")
    index.append(frame(list(texts.items())[900:] + [(5, "zebra zebra"), (6, None), (None, "zebra")]), "k", "t")
    index.delete(frame([(7, ""), (5000, "")]), "k")
    index.append(frame([(2000, "the zebra"), (2000, "a zebra")]), "k", "t")
    now = {k: t for k, t in texts.items() if k not in (6, 7)} | {5: "zebra zebra", 2000: "the zebra"}
    fresh = fulltext.TextIndex(spark, f"file://{tmp_path}/f").build(frame(now.items()), "k", "t")
    got = lambda df: [(r.key, round(r.score, 9), [(m.token, m.places) for m in r.matches]) for r in df.collect()]
    for step in range(2):
        for query, any_ in (("zebra", False), ("the cat", False), ("rare zebra", True), ("mat zebra hat", True), ("!!!", True), ("nothing the", False)):
            want = got(fresh.search(query, any_))
            assert sorted(got(index.search(query, any_))) == sorted(want)
            best = sorted(want, key=lambda r: (-r[1], r[0]))[:10]
            assert [r[1] for r in got(index.top(query, 10, any_))] == [r[1] for r in best]
            assert {r[0] for r in got(index.top(query, 10, any_)) if r[1] > best[-1][1]} == {r[0] for r in best if r[1] > best[-1][1]}
        index.merge(whole=True)
        assert len(index.segments.numbers()) == 1
    few, all_ = index.blocks_scored("zebra the", 3, any_=True)
    assert few < all_


def test_a_search_without_a_token_finds_nothing(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, "!!!")], "k int, t string")
    for any_ in (False, True):
        assert fulltext.search(rows, "t", "!!!", any_=any_).isEmpty() and fulltext.bm25(rows, "t", "!!!", any_=any_).isEmpty()


def test_fusion_of_rankings_of_any_length(spark):
    rows = [spark.range(3000).selectExpr("id AS k", f"cast((id * {m}) % 1009 AS double) AS s") for m in (7, 13)]
    whole = {r.k: round(r.score, 12) for r in fulltext.fused(rows, "k", "s", most=5000).collect()}
    assert {r.k: round(r.score, 12) for r in fulltext.fused(rows, "k", "s", most=None).collect()} == whole and len(whole) == 3000


def test_order_takes_paths_and_refuses_unknown_names(spark):
    db = Database(spark, {"t": spark.createDataFrame([(k, (k * 7 % 10,)) for k in range(10)], "a int, b struct<c: int>")})
    q = Query().select("a").from_table("t").order_by("b.c")
    assert [r.a for r in q.limit(3).to_df(db).collect()] == [0, 3, 6] and q.to_df(db).columns == ["a"]
    assert [r.a for r in q.hint(hints.Parallel(4)).to_df(db).collect()] == sorted(range(10), key=lambda k: k * 7 % 10)
    assert [r.b.c for r in Query().from_table("t").order_by("b.c", "desc").limit(2).to_df(db).collect()] == [9, 8]
    for bad in (Query().from_table("t").order_by("nope"), Query().select("a").from_table("t").order_by("b2.c"), Query().select("count(*) n").from_table("t").group_by("a").order_by("b")):
        with pytest.raises(ValueError):
            bad.to_df(db)


def test_hamming_of_other_lengths_is_none(spark):
    rows = spark.createDataFrame([(1, [1.0]), (2, [1.0, 8.0]), (3, [1.0, 9.0])], "id int, v array<double>")
    assert [(r.id, r.distance) for r in vector.knn(rows, "v", [1.0, 9.0], 3, "hamming").collect()] == [(3, 0.0), (2, 1.0)]
