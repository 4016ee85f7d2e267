"""What indexes and paths shuffle and hand to tasks as their input grows."""

from __future__ import annotations

import random

import numpy as np

from sparkloom import queries
from sparkloom.operators import fulltext, vector
from sparkloom.operators.vectorindex import CodeIndex, GraphIndex, _scan

from .test_indexes import sentence


def shuffled(spark, run) -> int:
    """Rows that a function's jobs write to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def all_() -> int:
        stages = store.stageList(None, False, False, none, None)
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    before = all_()
    run()
    return all_() - before


def test_texts_are_inverted_where_they_lie(spark, tmp_path):
    rng = random.Random(5)
    rows = spark.createDataFrame([(k, sentence(rng) + " end") for k in range(2000)], "k long, t string")
    index = fulltext.TextIndex(spark, f"file://{tmp_path}/i")
    assert shuffled(spark, lambda: index.build(rows, "k", "t")) < 2 * 2000 + 500  # keys, and a row for a token and a block
    assert index.search("end").count() == 2000


def test_equal_keys_keep_the_largest_text(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(1, "b one"), (1, "a two"), (1, None), (2, None), (2, "x"), (3, None), (None, "y"), (4, "z z")], "k int, t string")
    for n, most in enumerate((100, 0)):
        monkeypatch.setattr(fulltext, "AGAIN", most)
        index = fulltext.TextIndex(spark, f"file://{tmp_path}/{n}").build(rows, "k", "t")
        assert {r.key: r.matches[0].places for r in index.search("one two x y z", any_=True).collect()} == {1: [1], 2: [0], 4: [0, 1]}


def test_paths_from_both_ends_deal_no_edges(spark):
    assert shuffled(spark, lambda: queries.QUERIES["q_shortest_paths_both_ends"](spark, "/root/testdata/sf0.001").collect()) < 5000


def test_pairs_of_queries_and_cells_have_no_vectors(spark, tmp_path, monkeypatch):
    from sparkloom.operators import vectorindex

    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rng.normal(0, 1, (600, 8)))], "k long, v array<double>")
    asked = rows.where("k % 20 = 0")
    index = GraphIndex(spark, f"file://{tmp_path}/i", unit=32).build(rows, "k", "v")
    assert index._pairs(index._whole(asked, "k", "v"), None).columns == ["key", "cell", "reach"]
    want = sorted((r.query, r.k) for r in vector.knn_join(asked, rows, "v", 4, "euclidean", "k").collect())
    for most in (1 << 24, 0):  # by a broadcast, and by a join
        monkeypatch.setattr(vectorindex, "BROADCAST_BYTES", most)
        found = index.search_many(asked, "k", "v", 4, exact=True, but_own=True)
        assert sorted((r.query, r.key) for r in found.collect()) == want


def test_scan_gives_nothing_beyond_the_reach():
    x, all_ = np.array([[0.0], [3.0], [3.0], [5.0]]), np.ones(4, bool)
    assert _scan(x, all_, np.array([[0.0], [0.0]]), 2, np.array([np.inf, 2.0])) == [(0, 0, 0.0), (0, 1, 9.0), (0, 2, 9.0), (1, 0, 0.0)]
    assert (0, 1, 0.0) in _scan(np.array([[0.0], [1e200]]), all_[:2], np.array([[1e200]]), 1, np.array([np.inf]))


def test_coarse_codes_read_more_rows_anew(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rng.normal(0, 1, (3000, 32)))], "k long, v array<double>")
    asked = rows.where("k % 50 = 0")
    index = CodeIndex(spark, f"file://{tmp_path}/i", unit=256, parts=2, entries=16).build(rows, "k", "v")
    true = {(r.query, r.k) for r in vector.knn_join(asked, rows, "v", 10, "euclidean", "k").collect()}
    found = {(r.query, r.key) for r in index.search_many(asked, "k", "v", 10, but_own=True).collect()}
    assert len(true & found) >= 0.9 * len(true)
