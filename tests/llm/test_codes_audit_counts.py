"""Vector codes, the filter audit and token counts against brute force."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import filteraudit, tokencount, vectorcodes
from sparkloom.llm.common import hot_and_cold, text_buffers
from sparkloom.llm.queries import ORACLE_SQL, QUERIES

from .conftest import base_docs

# Vector codes


def brute_codes(rows: list[tuple], parts: int = 8, entries: int = 16, rounds: int = 6) -> tuple[list[tuple], str]:
    """(vec_id, code, error, label_error) of rows (vec_id, vector, label), in whole numbers."""
    kept = [(k, [Fraction(float(x)) * 4096 // 1 for x in v], label) for k, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    split = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    firsts = sorted((k, v) for k, v, _ in kept if k is not None)
    firsts = list({k: v for k, v in reversed(firsts)}.items())[::-1][:entries]
    books = [[split(v)[p] for _, v in firsts] for p in range(parts)]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda a, book: min((away(a, e), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for _, v, _ in kept:
                groups[nearest(split(v)[p], books[p])[1]].append(split(v)[p])
            books[p] = [[sum(c) // len(groups[i]) for c in zip(*groups[i], strict=True)] if i in groups else e for i, e in enumerate(books[p])]
    out, by_label = [], Counter()
    for k, v, label in kept:
        found = [nearest(split(v)[p], books[p]) for p in range(parts)]
        out.append((k, "".join(f"{i:02x}" for _, i in found), sum(d for d, _ in found), label))
        by_label[label] += out[-1][2]
    text = ",".join(str(c) for b in books for e in b for c in e)
    return [(k, code, error, by_label[label]) for k, code, error, label in out], hashlib.sha256(text.encode()).hexdigest()


def vectors() -> list[tuple]:
    rng = random.Random(9)
    rows = [(k, [round(rng.uniform(-1, 1), 2) for _ in range(16)], rng.choice((0, 1, 2, None))) for k in range(3, 120)]
    rows += [(k, rows[0][1], 1) for k in range(200, 260)]  # equal vectors, ties
    rows += [(7, [0.5] * 16, 3), (7, [0.25] * 16, 3), rows[4], rows[4], (None, [0.1] * 16, None)]
    return [*rows, (1, None, 1), (2, [None] * 16, 1), (0, [float("nan")] * 16, 1), (500, [float("-inf")] + [0.0] * 15, 1)]


def coded(df) -> list:
    return sorted(map(repr, (tuple(r) for r in df.select("vec_id", "code", "error", "label_error").collect())))


def test_codes_are_those_of_brute_force(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("v", F.lit("clash")).repartition(5)
    got = vectorcodes.compressed(df, "vec_id", "embedding", "label").cache()
    want, digest = brute_codes(rows)
    assert coded(got) == sorted(map(repr, want)) and {r.codebooks_sha256 for r in got.collect()} == {digest}


def test_codes_are_those_of_sql(spark, tmp_path):
    rows = [r for r in vectors() if r[0] != 7]  # SQL takes any of the vectors of one id
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(ORACLE_SQL["op11_vector_codes"])
    columns = [c[0] for c in want.description]
    got = QUERIES["op11_vector_codes"](spark, str(tmp_path)).select(*columns)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))


def test_codes_of_few_other_and_large_vectors(spark):
    of = lambda rows: vectorcodes.compressed(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), "vec_id", "embedding", "label")
    few = [(k, [float(k)] * 8, 1) for k in range(5)] + [(9, [1.0] * 16, 1), (10, [1.0], 1), (11, [], 1)]
    assert coded(of(few)) == sorted(map(repr, brute_codes(few[:5])[0]))
    assert of([(1, [1.0] * 9, 1)]).count() == 0 and of([(None, [1.0] * 8, 1)]).count() == 0
    large = [(k, [float(k * 2.0**14)] * 7 + [-3.5], k % 2) for k in range(30)]
    assert coded(of(large)) == sorted(map(repr, brute_codes(large)[0]))
    huge = [(k, [1e30 * (k + 1)] * 8, 1) for k in range(20)] + [(50, [1e308] * 8, 1)]
    fits = lambda n: n if n < 1 << 63 else None
    assert coded(of(huge)) == sorted(map(repr, ((k, code, fits(error), fits(label)) for k, code, error, label in brute_codes(huge)[0])))


@pytest.mark.parametrize(("width", "most"), [(8, 3), (8, 600), (4, 9), (5, 50), (1, 9), (8, (1 << 25) - 1)])
def test_bounds_lose_no_nearest_entry(width, most):
    rng = np.random.default_rng(width + most)
    x = rng.integers(-most, most + 1, (3000, width))
    entries = np.concatenate((x[:13], x[:2], x[-1:]))
    code, error, computed = vectorcodes.nearest(x, entries)
    d = np.square(x[:, None] - entries[None]).sum(axis=2)
    assert (code == d.argmin(axis=1)).all() and (error == d.min(axis=1)).all() and computed < d.size


# The filter audit


def fails(text: str) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    flags = (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search(r"[#$%&*|]", text)))
    return sum(f << k for k, f in enumerate(flags))


def texts() -> list[str | None]:
    rng = random.Random(2)
    some = [" ".join("".join(rng.choices("aAé#b\x00 \t", k=rng.randint(0, 12))) for _ in range(rng.randint(0, 400))) for _ in range(150)]
    near = ["aaaaaaaaab", "aaaaaaaaac", "a\x00", "a", "abcdefgh", "abcdefghi", "abcdefghijklmnopq", "é" * 200, "é" * 201]
    return ["", None, "a", " ", "A" * 300 + " " + "B" * 300, ("A" * 300 + " ") * 120, "x" * 70_000, *some, *(" ".join(rng.choice(near) + str(rng.randint(0, k)) for _ in range(200)) for k in (0, 1, 5, 30, 300))]


def test_scans_are_those_of_brute_force(monkeypatch):
    raw, offsets = text_buffers(pa.array(texts(), pa.string()))
    want = [fails(t or "") for t in texts()]
    assert filteraudit.masks_of(raw, offsets).tolist() == want
    hashes = filteraudit.word_hashes
    weak = lambda raw, starts, sizes: np.where(sizes > 8, hashes(raw, starts, sizes) & np.uint64(3), hashes(raw, starts, sizes))
    monkeypatch.setattr(filteraudit, "word_hashes", weak)  # long words that share a hash are told apart
    assert filteraudit.masks_of(raw, offsets).tolist() == want
    sliced = pa.array(["zz", *texts(), "yy"], pa.string()).slice(1, len(texts()))
    assert filteraudit.masks_of(*text_buffers(sliced)).tolist() == want
    assert filteraudit.masks_of(*text_buffers(pa.array([], pa.string()))).tolist() == []


def test_audit_counts_every_order(spark):
    rng = random.Random(4)
    rows = [(k, t, rng.choice(("en", "de", None, ""))) for k, t in enumerate(rng.choices(texts(), k=400))] + [(3, "same", "en"), (3, "same", "en"), (None, "same", "en"), (900, "same", None)]
    labels = [(k, rng.choice((0, 1, None)), rng.choice((0, 1, None))) for k in range(0, 400, 2)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1)]
    got = filteraudit.audit(spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("mask", F.lit("clash")).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    least = {}
    for k, t, _ in rows:
        if k is not None:
            least[t or ""] = min(least.get(t or "", k), k)
    good, toxic = {k for k, q, _ in labels if q == 1 and k is not None}, {k for k, _, x in labels if x == 1 and k is not None}
    docs = [(lang or "", fails(t or "") | (k is not None and k > least[t or ""]) << 4, k in good, k in toxic) for k, t, lang in rows]
    want = set()
    for part in {d[0] for d in docs}:
        own, removed_by = [d for d in docs if d[0] == part], Counter()
        found = []
        for order in itertools.permutations("ABCDE"):
            before = 0
            for step, letter in enumerate(order, 1):
                bit = 1 << "ABCDE".index(letter)
                here = [d for d in own if d[1] & bit and not d[1] & before]
                removed_by[letter] += len(here)
                found.append((part, "".join(order), step, sum(not d[1] & (before | bit) for d in own), len(here), sum(1 for d in own if d[1] & bit and d[1] & before), sum(d[1] == bit for d in own), sum(d[2] for d in here), sum(d[3] for d in here), letter))
                before |= bit
        want |= {(*f[:-1], removed_by[f[-1]]) for f in found}
    rows = [tuple(r) for r in got.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect()]
    assert len(rows) == 600 * len({d[0] for d in docs}) and set(rows) == want


def test_hot_keys_and_nulls_meet_their_totals(spark):
    rows = spark.range(5000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 'hot' ELSE concat('k', id) END AS k")
    totals = rows.groupBy("k").agg(F.count("*").alias("n")).where("k IS NULL OR k <> 'k2'")
    got = hot_and_cold(rows, totals, ["k"], 5000, "n")
    assert got.count() == 5000 and {(r.k, r.n) for r in got.where("id < 6").collect()} == {(None, 1667), ("hot", 1667), ("k2", None), ("k5", 1)}


# Token counts


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def own():
    return tokencount.Counter(public_tokenizers.path("byte_bpe_50k.json"))


def counted(own, some: list) -> list[int]:
    return own.count(*text_buffers(pa.array(some, pa.string()))).tolist()


def wanted(library, some: list) -> list[int]:
    return [len(x.ids) for x in library.encode_batch([t or "" for t in some], add_special_tokens=False)]


def odd_texts(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    parts = ["'s", "'", "r", "e", "v", "l", "'ll", "'re", " ", "  ", "\n", "\t", "a", "Z", "9", "!", "é", "漢", "😀", "՘", "　", "\xa0", "the", "ing", " of", "<|endoftext|>", "<|endo", "x", "xx", "==", "\x00", "ab"]
    return ["".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(n)]


def test_counts_are_those_of_the_library(own, library):
    rng = random.Random(3)
    plain = ["", None, "hello <|endoftext|> world", "<|endoftext|><|endoftext|>", "don't 's ''s \n's  's '", "'r 've 'll 'l", "  \n\n a", " \xa0'", "\n\n'", "x" * 70_000, "ab" * 9000, " " * 3000, "0" * 5000, "=-" * 3000, "漢" * 4000]
    noise = ["".join(chr(rng.choice((rng.randint(32, 126), rng.randint(0, 0x2FF), rng.randint(0x3000, 0x9FFF), rng.randint(0x10000, 0x1FFFF)))) for _ in range(rng.randint(0, 3000))) for _ in range(40)]
    few = ["".join(rng.choices("ab="[: rng.randint(1, 3)], k=rng.randint(0, 9000))) for _ in range(20)]
    for some in (plain, noise, few, odd_texts(1, 4000)):
        assert counted(own, some) == wanted(library, some)


def test_states_that_are_forgotten_are_compiled_again(own, library, monkeypatch):
    monkeypatch.setattr(tokencount, "STATES", 300)
    monkeypatch.setattr(tokencount, "PAIRS", 50)
    rng = random.Random(8)
    some = [*odd_texts(5, 300), "q" * 4000, "".join(rng.choices("abcdef0123456789", k=6000)), *("".join(rng.choices("abcdefgh ", k=900)) for _ in range(20))]
    assert counted(own, some) == wanted(library, some)
    assert len(own.states) < 3000


def test_classes_of_code_points_are_the_library_s(own, library):
    rng = random.Random(2)
    split = library.pre_tokenizer.pre_tokenize_str
    for c in {*range(0x600), *rng.sample(range(0x110000), 6000)}:
        if not 0xD800 <= c < 0xE000:
            kind = own.classes[c]
            assert [len(split(x + chr(c))) == 1 for x in "a1!"] == [kind in (1, 2, 3, 4, 5), kind == 6, kind in (7, 8)], hex(c)


def test_maps_compose_to_the_states_before_chunks():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 100):
        maps = rng.integers(0, 12, (12, n)).astype(np.uint8) * 16
        at, want = 0, []
        for k in range(n):
            want.append(at * 16)
            at = int(maps[at, k]) // 16
        assert tokencount.entries(maps).tolist() == want


def test_token_counts_query(spark, folder, library):
    want = Counter()
    for (k, t, *_), n in zip(base_docs(), wanted(library, [r[1] for r in base_docs()]), strict=True):
        want[k, len((t or "").encode()), n, n > 512] += 1
    assert Counter(map(tuple, QUERIES["op13_token_counts"](spark, folder).collect())) == want


def test_other_tokenizers_are_refused():
    with pytest.raises(NotImplementedError):
        tokencount.Counter(public_tokenizers.path("word_bpe_49k.json"))
