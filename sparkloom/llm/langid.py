"""Language identification by language-bitmask n-gram filters.

All languages share one bit-sliced Bloom filter: a slot holds two bits for every
language, and the AND of an n-gram's slots is the set of all languages that have
it, and of those that it is typical of, too.  A text's n-grams are looked up
together; each language's popcounts, less the hits that chance alone gives at
its share of set bits, decide.  The score is the part of the text's n-grams that
the language has.

The filters are learnt from all n-grams of a sample of distinct texts of each
language.  An n-gram is typical of a language if its share there is at least
LEAST_PART of its largest share in any.

A text without a letter, or null, is `und` with score 0.  Ties go to the first
language in order.  Repeated rows stay, each with the same result; other columns
are not read.  With nothing to learn from, every text is `und`; an empty table
gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_slices, cut
from .shingles import mix

UNKNOWN = "und"
#: Code points of an n-gram; words count with a space before and after.
SIZES = (3, 4)
#: Distinct texts of each language that the filters are learnt from, about, chosen by hash. A bound on training data.
LEARN_ROWS = 3000
#: An n-gram is typical of a language if its share is at least this part of its share in any other.
LEAST_PART = 0.35
#: log2 of the slots, slots of an n-gram, and log2 of the slots that are built at a time.
SLOT_BITS, PROBES, RANGE_BITS = 22, 2, 16
#: The least score of a text that is kept.
KEEP = 0.6
#: Code points in a slice.
SLICE = 1 << 18


@functools.cache
def _letters() -> np.ndarray:
    """Code points in lower case; 32 for what is no letter."""
    out = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def grams(texts: Sequence[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of the texts: n-gram hashes, the text number of each, and whether each text has a letter."""
    at = 0
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and (chars < SLICE or end == at):
            chars += len(texts[end] or "")
            end += 1
        own = [t or "" for t in texts[at:end]]
        points = np.frombuffer((" " + "  ".join(own) + "  ").encode("utf-32-le", "surrogatepass"), np.uint32)
        points = _letters()[points]
        text_of = np.repeat(np.arange(at, end), [len(t) + 2 for t in own])
        text_of = np.concatenate(([at], text_of))[: len(points)]
        blank = points == 32
        lettered = np.zeros(end - at, bool)
        lettered[text_of[~blank] - at] = True
        double = np.flatnonzero(~(blank[:-1] & blank[1:]))  # places where no two blanks follow each other
        ok = np.zeros(len(points) + max(SIZES), bool)
        ok[double] = True
        hashes, owners = [], []
        wide = np.concatenate((points, np.full(max(SIZES), 32, np.uint32))).astype(np.uint64)
        n = len(points)
        value = wide[:n].copy()
        valid = np.ones(n, bool)
        for k in range(1, max(SIZES)):
            value = value * np.uint64(0x100000001B3) + wide[k : n + k]
            valid &= ok[k - 1 : n + k - 1]
            if k + 1 in SIZES:
                keep = np.flatnonzero(valid)
                hashes.append(mix(value[keep] + np.uint64(k)))
                owners.append(text_of[keep])
        yield np.concatenate(hashes), np.concatenate(owners), lettered
        at = end


@dataclass(frozen=True)
class Filters:
    """The languages; bytes with the bits of 8 sets each by slot; each set's chance, its share of set bits to the power of the probes.

    Set k is language k's n-grams; the sets after the last language's, if there are any, hold typical ones in the same order.
    """

    languages: tuple[str, ...]
    slots: np.ndarray
    chance: np.ndarray

    @staticmethod
    def positions(hashes: np.ndarray) -> list[np.ndarray]:
        return [(hashes >> np.uint64(64 - SLOT_BITS * (k + 1)) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64) for k in range(PROBES)]

    @classmethod
    def of_slots(cls, languages: Sequence[str], sets: int, slots: np.ndarray) -> Filters:
        chance = [(slots[k // 8] >> np.uint8(k % 8) & 1).mean() ** PROBES for k in range(sets)]
        return cls(tuple(languages), slots, np.array(chance))

    @classmethod
    def build(cls, languages: Sequence[str], hashes: Sequence[np.ndarray]) -> Filters:
        slots = np.zeros((-(-len(hashes) // 8), 1 << SLOT_BITS), np.uint8)
        for k, own in enumerate(hashes):
            for at in cls.positions(own.astype(np.uint64)):
                slots[k // 8, at] |= np.uint8(1 << k % 8)
        return cls.of_slots(languages, len(hashes), slots)

    def count(self, hashes: np.ndarray, owners: np.ndarray, first: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """For n texts from number first: hits by set, corrected for false positives, and n-grams."""
        total = np.bincount(owners - first, minlength=n).astype(float)
        out = np.zeros((n, len(self.chance)))
        at = self.positions(hashes)
        for w, slots in enumerate(self.slots):
            mask = functools.reduce(np.bitwise_and, (slots[x] for x in at))
            hit = np.flatnonzero(mask)
            both = np.bincount((owners[hit] - first) * 256 + mask[hit], minlength=256 * n).reshape(n, 256)
            for b in range(min(8, len(self.chance) - 8 * w)):
                out[:, 8 * w + b] = both[:, np.arange(256) >> b & 1 == 1].sum(axis=1)
        return (out - total[:, None] * self.chance) / (1 - self.chance), total


def _counted(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(lang, gram, n) of a batch's texts."""
    langs = np.array(batch.column("lang").to_pylist(), object)
    found: dict[str, list[np.ndarray]] = {}
    for hashes, owners, _ in grams(batch.column("text").to_pylist()):
        own = langs[owners]
        for k in set(langs[owners.min(initial=0) : owners.max(initial=0) + 1]):
            found.setdefault(k, []).append(hashes[own == k])
    columns: list[list] = [[], [], []]
    for k, parts in found.items():
        values, n = np.unique(np.concatenate(parts).view(np.int64), return_counts=True)
        for c, x in zip(columns, ([k] * len(values), values, n), strict=True):
            c.extend(x)
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], ["lang", "gram", "n"])


def _placed(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(range, slot in it, set) for every probe of (gram, set) rows."""
    at = np.concatenate([np.empty(0, np.int64), *Filters.positions(batch.column("gram").to_numpy().view(np.uint64))])
    sets = np.tile(batch.column("set").to_numpy(), PROBES)
    columns = (at >> RANGE_BITS, at & (1 << RANGE_BITS) - 1, sets)
    return pa.record_batch([pa.array(c.astype(np.int32)) for c in columns], ["range", "slot", "set"])


def _slots(words: int):
    """A function for applyInArrow: the bytes of a range of slots."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        out = np.zeros((words, 1 << RANGE_BITS), np.uint8)
        sets, slot = group.column("set").to_numpy(), group.column("slot").to_numpy()
        for k in np.unique(sets):
            out[k // 8, slot[sets == k]] |= np.uint8(1 << k % 8)
        return pa.table({"range": pa.array([key[0].as_py()], pa.int32()), "slots": pa.array([out.tobytes()], pa.binary())})

    return run


def learn(docs: DataFrame, rows: int = LEARN_ROWS) -> Filters:
    """Filters for the values of lang, from about `rows` distinct texts of each, or all where there are fewer."""
    hash_ = F.xxhash64("text").alias("hash")
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", hash_)
    distinct = known.select("lang", "hash").distinct().groupBy("lang").count()
    counts = {r["lang"]: r["count"] for r in distinct.collect()}  # as many as there are languages
    if not counts:
        return Filters((), np.zeros((0, 1 << SLOT_BITS), np.uint8), np.zeros(0))
    share = F.element_at(F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1.0, rows / n)))), F.col("lang"))
    chosen = known.where(F.pmod("hash", F.lit(1 << 30)) < share * (1 << 30)).dropDuplicates(["lang", "hash"]).select("lang", "text")
    seen = cut(chosen.mapInArrow(by_slices(_counted, 2048), "lang string, gram long, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n")))
    totals = {r["lang"]: r["n"] for r in seen.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals)
    if not languages:
        return Filters((), np.zeros((0, 1 << SLOT_BITS), np.uint8), np.zeros(0))
    of = F.element_at(F.create_map(*(F.lit(x) for k, lang in enumerate(languages) for x in (lang, F.struct(F.lit(k).alias("set"), F.lit(float(totals[lang])).alias("total"))))), F.col("lang"))
    part = seen.select("gram", of.alias("of"), "n").select("gram", "of.set", (F.col("n") / F.col("of.total")).alias("share"))
    by_gram = part.groupBy("gram").agg(F.collect_list(F.struct("set", "share")).alias("of"))  # at most a row a language
    typical = F.transform(F.filter("of", lambda x: x["share"] >= LEAST_PART * F.array_max(F.col("of.share"))), lambda x: x["set"] + len(languages))
    sets = by_gram.select("gram", F.explode(F.concat("of.set", typical)).alias("set"))
    words = -(-2 * len(languages) // 8)
    built = sets.mapInArrow(by_slices(_placed, 1 << 16), "range int, slot int, set int").groupBy("range").applyInArrow(_slots(words), "range int, slots binary")
    slots = np.zeros((words, 1 << SLOT_BITS - RANGE_BITS, 1 << RANGE_BITS), np.uint8)
    for r in built.collect():  # the filter's bytes, whose number is fixed
        slots[:, r["range"]] = np.frombuffer(r["slots"], np.uint8).reshape(words, -1)
    return Filters.of_slots(languages, 2 * len(languages), slots.reshape(words, -1))


def predict(texts: Sequence[str | None], own: Filters) -> tuple[list[str], list[float]]:
    """The language and score of each text."""
    langs: list[str] = []
    scores: list[float] = []
    for hashes, owners, lettered in grams(texts):
        n, first = len(lettered), len(langs)
        if not own.languages:
            langs += [UNKNOWN] * n
            scores += [0.0] * n
            continue
        counts, total = own.count(hashes, owners, first, n)
        counts = np.maximum(counts, 0)
        held = counts[:, : len(own.languages)]
        best = counts.reshape(n, -1, len(own.languages)).sum(axis=1).argmax(axis=1)
        langs += [own.languages[b] if has else UNKNOWN for b, has in zip(best, lettered, strict=True)]
        scores += np.where(lettered, held[np.arange(n), best] / np.maximum(total, 1), 0.0).clip(0, 1).tolist()
    return langs, scores


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, lang_pred and score of every text."""
    held = docs.sparkSession.sparkContext.broadcast(filters)  # a fixed number of slots for every 4 languages

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, scores = predict(batch.column("text").to_pylist(), held.value)
        return pa.record_batch([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(by_slices(step), "doc_id long, lang_pred string, score double")


def select(docs: DataFrame, filters: Filters, least: float = KEEP) -> DataFrame:
    """The rows of docs in a known language with a score of `least` or more; all columns stay."""
    held = docs.sparkSession.sparkContext.broadcast(filters)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, scores = predict(batch.column("text").to_pylist(), held.value)
        return batch.filter(pa.array([k != UNKNOWN and s >= least for k, s in zip(langs, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(by_slices(step), docs.schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row is kept from training: its id's CRC-32 is divisible by 5."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
