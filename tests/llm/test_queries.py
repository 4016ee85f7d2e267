"""Every query on odd tables and on empty ones."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from sparkloom.llm import neardup, packing
from sparkloom.llm.queries import ORACLE_SQL, QUERIES

from .conftest import DOCS, base_docs, sentence


def encoding(name: str) -> tiktoken.Encoding:
    import base64

    with open(public_tokenizers.path(name), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("name", list(QUERIES))
def test_empty_tables_give_no_rows(spark, empty, name):
    assert QUERIES[name](spark, empty).collect() == []


@pytest.mark.parametrize("name", [n for n in ORACLE_SQL if n != "op11_vector_codes"])  # its vectors are longer: test_codes_audit_counts.py
def test_sql_gives_the_same(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    if name == "op2_mtree_top_k":
        con.execute("CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '" + folder + "/embeddings.parquet/*.parquet' WHERE len(embedding) = 4")
    result = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in result.description]
    got = QUERIES[name](spark, folder)
    if name == "op2_mtree_top_k":
        got = got.where("query_id not in (600, 650)")
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, result.fetchall()))


def test_packing_is_whole_and_tight(spark, folder):
    rows = QUERIES["op1_best_fit_packing"](spark, folder).collect()
    own = encoding("byte_bpe_50k.tiktoken")
    want = Counter()
    for doc_id, text, *_ in base_docs():
        ids = own.encode_ordinary(text or "") + [0]
        first = (len(ids) - 1) % 2048 + 1
        for k, at in enumerate([0, *range(first, len(ids), 2048)]):
            part = ids[at : at + (2048 if k else first)]
            want[doc_id, k, at, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for own_rows in bins.values():
        at = 0
        for offset, length in sorted(own_rows):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-sum(r.length for r in rows) // 2048) + 1


def test_tokenizers_gives_the_ids_of_the_rank_file():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    texts = [t for _, t, *_ in base_docs() if t is not None and len(t) < 5000]
    assert [x.ids for x in own.encode_batch(texts, add_special_tokens=False)] == [encoding("byte_bpe_50k.tiktoken").encode_ordinary(t) for t in texts]


def test_packing_gives_the_ids_of_tokenizers(spark):
    """At the library's default settings, on whole texts; added tokens are matched in the text."""
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    marked = ["hello <|endoftext|> world", "<|endoftext|>", "<|endoftext|><|endoftext|> a", "a\n\n<|endoftext|>\n<|endoftext", "x" * 3000 + "  <|endoftext|>  " + "y" * 3000]
    texts = [*marked, *(t for _, t, *_ in base_docs() if t is not None)]
    assert own.encode(marked[0], add_special_tokens=False).ids == [31373, 220, 50256, 995]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=True).orderBy("doc_id", "piece").collect()
    got = [[] for _ in texts]
    for r in rows:
        got[r.doc_id] += r.ids
    assert got == [[*x.ids, 0] for x in own.encode_batch(texts, add_special_tokens=False)]


def test_distinct_chunks_are_encoded_in_one_call():
    """Chunks of all texts are one text to tiktoken, whatever white space and scripts meet at the cuts; each text has its own ids."""
    own, rng = encoding("byte_bpe_50k.tiktoken"), random.Random(3)
    joined = packing.tokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).plain
    asked, encode = [], joined.encode
    joined.encode = lambda text: asked.append(text) or encode(text)
    try:
        texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(2000)) for _ in range(3)]
        ids = lambda text: b"".join(i.to_bytes(4, "little") for i in own.encode_ordinary(text or ""))
        assert joined.ids(texts) == list(map(ids, texts))
        assert len(asked) <= 1 + len(texts) and len(asked[0].split()) == len(set(asked[0].split()))
        odd = [" "] * 9 + list("ab1.'s\n\t\r\x00\x0b\x1c\x1f\x7f\x85\xa0\u1680\u2003\u2028\u202f\u205f\u3000\u200b\ufeff\u0300\u2019\u3042éж漢🙂")
        for _ in range(300):
            texts = [None if rng.random() < 0.05 else "".join(rng.choices(odd, k=rng.randrange(30))) for _ in range(rng.randrange(12))]
            assert joined.ids(texts) == list(map(ids, texts))
    finally:
        joined.encode = encode


def test_bpe_is_tiktoken_and_decodes(spark, folder):
    own = encoding("byte_bpe_multi_50k.tiktoken")
    want = Counter()
    for doc_id, text, *_ in base_docs():
        ids = own.encode_ordinary(text or "")
        want[doc_id, len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += 1
    rows = QUERIES["op6_byte_bpe"](spark, folder).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert Counter(map(tuple, rows)) == want


def test_bpe_of_long_pieces():
    """Pieces of one row's matrix: runs, repeats, random letters and other scripts, at every length around the limit."""
    from sparkloom.llm import bpe

    for name in ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"):
        own, coder = encoding(name), bpe.coder(public_tokenizers.path(name), public_tokenizers.PATTERN)
        rng = random.Random(12)
        letters = lambda k, n: "".join(rng.choices("etaoinshrdluabcäßçжшя漢字"[:k], k=n))
        texts = ["x" * 70_000, "ab" * 999 + "a", "-" * 4097, "the" * 700, "öä" * 400, *(letters(k, n) for k in (2, 3, 6, 12, 20, 24) for n in (127, 128, 129, 130, 200, 257, 1000, 9000))]
        assert [list(np.frombuffer(x, "<u4")) for x in coder.ids(texts)] == [own.encode_ordinary(t) for t in texts]
        raw = [t.encode() for t in texts]
        assert coder.vocabulary.encode_pieces(raw) == [np.array(own._encode_single_piece(x), "<u4").tobytes() for x in raw]
        small = [x for x in raw if len(x) <= 2000]
        assert [coder.vocabulary._row(x) for x in small] == [np.array(own._encode_single_piece(x), "<u4").tobytes() if x not in coder.vocabulary.ranks else coder.vocabulary._row(x) for x in small]


def area_means(samples: bytes, width: int, rows: int, columns: int) -> list[int]:
    """By hand: the mean over each new sample's area, where samples count by the part of them that lies in it."""
    height, out = len(samples) // width, []
    part = lambda k, n, size, i: max(0, min(Fraction((k + 1) * size, n), i + 1) - max(Fraction(k * size, n), i))
    for y in range(rows):
        for x in range(columns):
            total = sum(part(y, rows, height, i) * part(x, columns, width, j) * samples[i * width + j] for i in range(height) if part(y, rows, height, i) for j in range(width) if part(x, columns, width, j))
            out.append(round(total * rows * columns / (height * width)))
    return out


def test_media_digests(spark, folder):
    rows = QUERIES["op8_media_columns"](spark, folder).collect()
    want = Counter()
    for doc_id, text, *_ in base_docs():
        raw = (text or "").encode()
        full = raw + bytes(-len(raw) % 64 if raw else 64)
        want[doc_id, len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:])] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == want
    assert all(r.media_bytes > r.payload_bytes for r in rows)
    raws = [(t or "").encode() for _, t, *_ in base_docs()]
    short = {hashlib.sha256(x).hexdigest(): x for x in (raw + bytes(-len(raw) % 64 if raw else 64) for raw in raws) if len(x) <= 640}
    seen = 0
    for r in rows:
        if r.payload_sha256 in short:
            seen += 1
            full = short[r.payload_sha256]
            stored = f"P5\n64 {len(full) // 64}\n255\n".encode() + full
            tile = area_means(full, 64, 8, 9)
            bits = "".join("1" if tile[9 * y + x + 1] > tile[9 * y + x] else "0" for y in range(8) for x in range(8))
            head = b"\x93NUMPY\x01\x00v\x00" + b"{'descr': '|u1', 'fortran_order': False, 'shape': (8, 9), }".ljust(117) + b"\n"
            assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
            assert r.tile == head + bytes(tile) and r.feature == f"{int(bits, 2):016x}:{zlib.crc32(r.tile):08x}"
    assert seen > 20
    assert len({(r.payload_sha256, r.media_sha256, r.feature) for r in rows}) == len({r.payload_sha256 for r in rows})


def brute_force(rows):
    """For each row: its copies' least id, its component's, and its links; texts without words link to equal texts only."""
    sets = []
    for _, text, *_ in rows:
        w = re.findall(r"\w+", (text or "").lower())
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else text or "")
    links, label = [0] * len(rows), list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            same = a == b if isinstance(a, str) or isinstance(b, str) else 9 * len(a & b) >= 4 * (len(a) + len(b))
            if same:
                links[i] += 1
                links[j] += 1
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = defaultdict(list)
    for k, x in enumerate(label):
        least[x].append(rows[k][0])
    return Counter((rows[k][0], min((i for i in least[x] if i is not None), default=None), links[k]) for k, x in enumerate(label))


@pytest.mark.parametrize("block", [256, 2])
def test_near_duplicates_are_exact(spark, folder, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = QUERIES["op10_jaccard_join"](spark, folder).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in rows) == brute_force(base_docs())


def test_large_groups_are_compared_in_bounded_buckets(spark):
    """A family of 16,384 near copies: no bucket holds much more than LOAD shingles."""
    groups = spark.range(16_384).selectExpr("id AS class", "0L AS component", "31 AS size", "1000L AS n")
    held = [r.n for r in neardup._tasks(groups).groupBy("bucket").agg((F.count("*") * 1000).alias("n")).collect()]
    assert sum(held) >= 64 * 16_384 * 1000 and max(held) <= 5 * neardup.LOAD


def test_languages_and_grades_of_every_row(spark, folder):
    rows = QUERIES["op4_language_id"](spark, folder).collect()
    assert len(rows) == len(base_docs())
    assert {r.lang_pred for r in rows} <= {"en", "de", "und"}
    by_id = {r.doc_id: r for r in rows if r.doc_id not in (5, None)}
    assert all(by_id[k].lang_pred == "und" and by_id[k].score == 0 for k in (4, 6, 7))
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    rated = QUERIES["op7_quality_classifier"](spark, folder).collect()
    assert len(rated) == len(base_docs()) and all(0 <= r.p_top <= r.expected_grade <= 2 for r in rated)


def test_html_of_every_page(spark, folder):
    rows = QUERIES["op5_html_text"](spark, folder).collect()
    assert len(rows) == 7 and all(r.n_chars == len(r.text) for r in rows)
    first = next(r for r in rows if r.page_id == 1 and r.n_chars)
    assert first.text == "Title Some & more text, here."


def test_sharding_keeps_all_rows(spark, folder):
    rows = QUERIES["op9_sharding"](spark, folder).collect()
    assert Counter(r.doc_id for r in rows) == Counter(d[0] for d in base_docs()) and all(r.shard for r in rows)


def test_pipeline_stages(spark, folder, tmp_path):
    """Where every label is good, quality drops nothing; the other stages do what their operators say."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality"](spark, docs, str(tmp_path))
    assert good.count() == docs.count()
    known = stages["language"](spark, good, str(tmp_path))
    rows = [tuple(r) for r in known.select("doc_id", "text").collect()]
    assert {4, 6, 7}.isdisjoint(r[0] for r in rows) and len(rows) > 60
    one = stages["near_duplicates"](spark, known, str(tmp_path))
    groups = {c for (_, c, _) in brute_force([r for r in rows if r[0] != 5])}
    assert {r.doc_id for r in one.select("doc_id").collect()} - {5} == groups
    clean = stages["secrets"](spark, one, str(tmp_path))
    assert clean.count() == one.count() and clean.columns == one.columns == docs.columns
    assert "[assign]" in clean.where("doc_id = 16").first().text
    packed = stages["packing"](spark, clean, str(tmp_path))
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in clean.select("doc_id").collect()}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == packed.count()


def test_one_of_each_goes_by_rows(spark):
    """An id that has another text, too, doesn't keep its copy; equal rows become one."""
    rng = random.Random(4)
    one, two = (sentence(rng, 40) for _ in range(2))
    docs = spark.createDataFrame([(k, t, None, None, None) for k, t in ((1, one), (2, one), (2, two), (3, two), (3, "short"), (1, one), (None, "short"), (None, "alone"), (None, "alone"))], DOCS)
    got = sorted(((r.doc_id or 0, r.text) for r in neardup.one_of_each(docs).collect()))
    assert got == sorted([(1, one), (2, two), (3, "short"), (0, "alone")])


def test_near_duplicates_without_ids(spark):
    """Documents without an id are linked to each other, and one of each group stays, whatever columns there are."""
    rng = random.Random(9)
    one, two, alone, shared = (sentence(rng, 150).split() for _ in range(4))
    changed = lambda words, k: " ".join([*words[:k], "changed", *words[k + 1 :]])
    texts = [" ".join(one), changed(one, 70), " ".join(one), " ".join(two), changed(two, 3), " ".join(alone), None, ""]
    rows = [(None, x, "en", None, None) for x in texts] + [(3, " ".join(shared), "en", None, None), (None, changed(shared, 30), "en", None, None), (4, "named", "en", None, None)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("class", F.lit("clash"))
    found = neardup.near_duplicates(docs)
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in found.collect()) == brute_force(rows)
    kept = neardup.one_of_each(docs)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text or "") for r in kept.collect()]
    assert len(got) == 6 and {(3, " ".join(shared)), (4, "named"), (None, " ".join(alone)), (None, "")} <= set(got)
    assert sum(x in texts[:3] for _, x in got) == 1 and sum(x in texts[3:5] for _, x in got) == 1
