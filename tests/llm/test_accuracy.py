"""Accuracy on rows that nothing was fitted on, on the small tables; skipped where they aren't there."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import htmltext, langid, quality
from sparkloom.llm.queries import QUERIES

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def area(score, good) -> float:
    """The chance that a good row's score is above a bad one's."""
    ranks = np.argsort(np.argsort(score)) + 1
    good = np.asarray(good, bool)
    return (ranks[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())


@needs_data
def test_languages_of_held_out_rows(spark):
    known = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op4_language_id"](spark, DATA).where("held_out").join(known, "doc_id").where("lang is not null and lang_pred <> 'und'").collect()
    assert len(rows) > 150 and np.mean([r.lang == r.lang_pred for r in rows]) >= 0.99
    assert np.mean([r.score >= langid.KEEP for r in rows]) == 1


def test_a_language_of_few_texts_is_learnt(spark):
    """However often its copies, or another language's, repeat; and text of no language is rejected."""
    english = "the weather was fine and we walked along the river to the old town where the market was"
    german = [f"das Wetter war schön und wir gingen den Fluss entlang bis zur alten Stadt Nummer {'abcdefghij'[k % 10] * 3}" for k in range(50)]
    rows = [(k, english, "en") for k in range(9000)] + [(9000 + k, t, "de") for k, t in enumerate(german)]
    filters = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows=20)
    assert filters.languages == ("de", "en")
    langs, scores = langid.predict([english, german[0], "xq zvkw jjxq wvvz qqkz zzxw", "12 34", None, "Ωμέγα και άλφα"], filters)
    assert langs[:2] == ["en", "de"] and langs[3:5] == ["und", "und"]
    assert min(scores[:2]) > 0.9 and max(scores[2:]) < langid.KEEP


@needs_data
def test_filters_hold_every_n_gram_of_the_sample(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 200 and lang is not null and text is not null")
    filters = langid.learn(docs)
    for lang in filters.languages:
        for hashes, _, _ in langid.grams([r.text for r in docs.where(F.col("lang") == lang).collect()]):
            at = filters.languages.index(lang)
            bits = np.bitwise_and.reduce([filters.slots[at // 8][x] for x in filters.positions(hashes)])
            assert (bits >> np.uint8(at % 8) & 1).all()


@needs_data
def test_grades_of_rows_not_fitted_on(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "quality", "toxic")
    held = F.col("doc_id") % 5 == 0
    rows = quality.rate(docs, quality.train(docs, labels.where(~held))).join(labels.where(held), "doc_id").collect()
    assert area([r.expected_grade for r in rows], [r.quality > 0 for r in rows]) > 0.9
    clean = [r.keep for r in rows if r.quality > 0 and not r.toxic]
    assert np.mean(clean) > 0.95


@needs_data
def test_chosen_features_tell_grades_apart(spark):
    rows = [(0, [1, 9])] * 40 + [(2, [2, 9])] * 60 + [(1, [9])] * 30
    found = quality.telling(spark.createDataFrame(rows, "grade int, features array<int>"))
    assert found.tolist() == [1, 2]


@needs_data
def test_main_text_where_elements_tell(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    got = {r.page_id: r.text for r in QUERIES["op5_html_text"](spark, DATA).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    want = {r.page_id: " ".join(b.text for b in htmltext.blocks(r.html or "") if b.inside == "main") for r in rows}
    assert sum(got[k] == w for k, w in want.items()) >= 0.99 * len(want)


@pytest.fixture(scope="module")
def labelled(spark):
    """Pages, and a labeller that has learnt from some of them; the others."""
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    part = lambda own: F.pmod(F.xxhash64("page_id"), F.lit(5)) == 0 if own else F.pmod(F.xxhash64("page_id"), F.lit(5)) != 0
    return htmltext.train(pages.where(part(False))), [r.html or "" for r in pages.where(part(True)).orderBy("page_id").collect()]


@needs_data
@pytest.mark.parametrize("shown", [htmltext.NAMELESS, htmltext.PLAIN])
def test_main_text_where_names_and_elements_are_hidden(labelled, shown):
    """Of pages not learnt from: no class or id, and then plain divisions for all that tells."""
    labeller, pages = labelled
    own = [htmltext.blocks(p, shown) for p in pages]
    found = labeller.label(htmltext.vectors(own))
    whole = [all(k == (b.inside == "main") for k, b in zip(ks, bs, strict=True)) for ks, bs in zip(found, own, strict=True)]
    assert np.mean(whole) >= 0.9
