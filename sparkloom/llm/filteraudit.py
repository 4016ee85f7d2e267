"""How filters interact: what each one removes, in every order they can be applied in.

A document's failures are a mask of one bit for each filter.  Four of them come
from one scan of the texts' bytes as they lie in Arrow's buffers: a table gives
each byte's class, prefix sums count words, capitals and code points of every
text, and a document's words are told apart by their sorted hashes, of which
equal neighbours are compared byte for byte.  The fifth looks for the same text
under a smaller id: rows are compared with the least id of their text's digest.

What an order removes, at which step, follows from how many documents of a part
have each mask, so only those counts leave the scan: one row for each part and
mask.

Null texts count as empty, and a null part as the empty one.  A row without an id
has no smaller id, and is none.  Repeated rows count each; a label counts if any
row of labels has it.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, cut, hot_and_cold, text_buffers, whole

#: Bytes of texts that a task holds at a time, or one text.
SLICE = 1 << 21
#: Bytes of the longest word that is hashed together with others.
LONGEST = 256
#: The filters, by their bits from the lowest.
FILTERS = "ABCDE"
# The filters' limits, and the marks that a clean text doesn't have.
WORDS, DISTINCT, CAPITALS, MARKS = 100, 80, 10, b"#$%&*|"
#: Classes of bytes, as bits: white space, a capital, a mark, the first byte of a code point.
BLANK, CAPITAL, MARK, FIRST = 1, 2, 4, 8


def _classes() -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[[0x20, *range(9, 14)]] |= BLANK
    out[ord("A") : ord("Z") + 1] |= CAPITAL
    out[list(MARKS)] |= MARK
    out[[b for b in range(256) if b & 0xC0 != 0x80]] |= FIRST
    return out


CLASSES = _classes()


def word_hashes(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each word; of words of up to eight bytes, the bytes themselves."""
    padded = np.concatenate((raw, np.zeros(8, np.uint8)))
    at = lambda place: np.lib.stride_tricks.sliding_window_view(padded, 8)[place].view("<u8").ravel()
    masks = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    out = at(starts) & masks[np.minimum(sizes, 8)]
    left = np.flatnonzero((sizes > 8) & (sizes <= LONGEST))
    done = 8
    while len(left):
        block = at(starts[left] + done) & masks[np.minimum(sizes[left] - done, 8)]
        mixed = (out[left] ^ (out[left] >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        out[left] = (mixed ^ block) * np.uint64(0xBF58476D1CE4E5B9)
        done += 8
        left = left[sizes[left] > done]
    for k in np.flatnonzero(sizes > LONGEST).tolist():
        out[k] = xxhash.xxh3_64_intdigest(raw[starts[k] : starts[k] + sizes[k]])
    return out


def _same(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which words a[i] and b[i] are equal, byte for byte; their sizes are."""
    out = np.ones(len(a), bool)
    n = sizes[a]
    for some in np.array_split(np.arange(len(a)), max(1, math.ceil(n.sum() / SLICE))):
        if len(some):
            own = n[some]
            ends = np.cumsum(own)
            within = np.arange(ends[-1]) - np.repeat(ends - own, own)
            unequal = raw[np.repeat(starts[a[some]], own) + within] != raw[np.repeat(starts[b[some]], own) + within]
            out[some] = ~np.logical_or.reduceat(unequal, ends - own)
    return out


def distinct_words(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many different words there are between each two bounds (numbers of words)."""
    hashes = word_hashes(raw, starts, sizes)
    order = np.arange(len(starts))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a > 1:
            order[a:b] = a + np.argsort(hashes[a:b], kind="stable")
    equal = np.zeros(len(starts), bool)  # to the word before it, in the document's order
    if len(order) > 1:
        left, right = order[:-1], order[1:]
        equal[1:] = (hashes[left] == hashes[right]) & (sizes[left] == sizes[right])
        equal[bounds[:-1][bounds[:-1] < len(equal)]] = False
    one_hash = np.zeros(len(starts), bool)
    if len(order) > 1:
        one_hash[1:] = hashes[left] == hashes[right]
        one_hash[bounds[:-1][bounds[:-1] < len(equal)]] = False
    check = np.flatnonzero(equal & (sizes[order] > 8))
    unsure = np.concatenate((np.flatnonzero(one_hash & ~equal), check[~_same(raw, starts, sizes, order[check - 1], order[check])]))
    news = np.concatenate(([0], np.cumsum(~equal)))
    out = news[bounds[1:]] - news[bounds[:-1]]
    for k in np.unique(np.searchsorted(bounds, unsure, "right") - 1).tolist():  # unequal words of one hash: by the words themselves
        out[k] = len({raw[starts[w] : starts[w] + sizes[w]].tobytes() for w in range(bounds[k], bounds[k + 1])})
    return out


def masks_of(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The bits of the filters A to D that each text fails."""
    kinds = CLASSES[raw]
    between = lambda bit: np.diff(np.concatenate(([0], np.cumsum((kinds & bit) > 0)))[offsets])
    blank = (kinds & BLANK) > 0
    first = np.ones(len(raw), bool)
    first[1:] = blank[:-1]
    first[offsets[:-1][offsets[:-1] < len(raw)]] = True
    starts = np.flatnonzero(first & ~blank)
    last = np.ones(len(raw), bool)
    last[:-1] = blank[1:]
    last[offsets[1:][offsets[1:] > 0] - 1] = True
    sizes = np.flatnonzero(last & ~blank) - starts + 1
    bounds = np.searchsorted(starts, offsets)
    words, distinct = np.diff(bounds), distinct_words(raw, starts, sizes, bounds)
    fails = (words < WORDS, 100 * distinct < DISTINCT * words, 100 * between(CAPITAL) > CAPITALS * between(FIRST), between(MARK) > 0)
    return sum(f.astype(np.int32) << k for k, f in enumerate(fails))


def scanned(docs: DataFrame, part: str) -> DataFrame:
    """doc_id, part, the mask of filters A to D and the text's digest, of every row."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw, offsets = text_buffers(batch.column("text"))
        held = memoryview(raw)
        digests = [hashlib.sha256(held[a:b]).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        return pa.record_batch([batch.column("doc_id"), batch.column("part"), pa.array(masks_of(raw, offsets)), pa.array(digests, pa.binary())], ["doc_id", "part", "mask", "digest"])

    own = docs.select("doc_id", whole(part).cast("string").alias("part"), "text")
    return own.mapInArrow(by_bytes(step, "text", SLICE), "doc_id long, part string, mask int, digest binary")


def masked(docs: DataFrame, part: str) -> DataFrame:
    """doc_id, part and the mask of all filters, of every row."""
    rows = cut(scanned(docs, part))
    copies = rows.groupBy("digest").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least")).where("copies > 1")
    same = hot_and_cold(rows, cut(copies), ["digest"], rows.count(), "copies")
    copy = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    return same.select("doc_id", "part", F.when(copy, F.col("mask").bitwiseOR(1 << FILTERS.index("E"))).otherwise(F.col("mask")).alias("mask"))


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """For each part, order and step what its filter keeps, removes and finds removed already, and what it loses."""
    told = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    marked = masked(docs, part).join(told, "doc_id", "left")
    counted = marked.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))  # as many as there are masks
    orders = F.array(*(F.lit("".join(p)) for p in permutations(FILTERS)))
    steps = parts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.array(*(F.lit(k + 1) for k in range(len(FILTERS))))))
    return _reduced(steps)


def _bit(place: Column) -> Column:
    """The bit of the filter whose letter stands at a place of filter_order, from 1."""
    return F.call_function("shiftleft", F.lit(1), F.ascii(F.substring(F.col("filter_order"), place, F.lit(1))) - F.lit(ord(FILTERS[0])))


def _reduced(steps: DataFrame) -> DataFrame:
    """The counts of each step, from the part's masks."""
    own = _bit(F.col("step"))
    before = F.aggregate(F.sequence(F.lit(1), F.col("step")), F.lit(0), lambda a, k: F.when(k < F.col("step"), a.bitwiseOR(_bit(k))).otherwise(a))
    ready = steps.withColumn("own", own).withColumn("before", before)
    has = lambda m, c: m["mask"].bitwiseAND(F.col(c)) != 0

    def total(name: str, when) -> Column:
        return F.aggregate("masks", F.lit(0).cast("long"), lambda a, m: a + F.when(when(m), m[name]).otherwise(F.lit(0)))

    here = lambda m: has(m, "own") & ~has(m, "before")
    orders = math.factorial(len(FILTERS))
    shapley = F.aggregate("masks", F.lit(0).cast("long"), lambda a, m: a + F.when(has(m, "own"), m["n"] * _share(m["mask"], orders)).otherwise(F.lit(0)))
    return ready.select(
        "part", "filter_order", "step",
        total("n", lambda m: ~has(m, "own") & ~has(m, "before")).alias("kept"),
        total("n", here).alias("removed"),
        total("n", lambda m: has(m, "own") & has(m, "before")).alias("redundant"),
        total("n", lambda m: m["mask"] == F.col("own")).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
        shapley.alias("shapley"),
    )


def _share(mask: Column, orders: int) -> Column:
    """In how many orders a filter comes before the others that a document fails."""
    return (F.lit(orders) / F.greatest(F.lit(1), F.bit_count(mask))).cast("long")
