"""Best-fit packing of token pieces into sequences by a grouping genetic algorithm.

Documents become pieces of at most `capacity` tokens; only a document's first
piece can be shorter.  The tokenizer's added tokens are matched in the texts, as the
tokenizers library does.  Full pieces are sequences of their own.  The others are
dealt at random, whatever their documents, into cells of about CELL pieces; each
cell is packed by ISLANDS populations in tasks of their own.  An individual is
a grouping of the cell's pieces into bins.  Crossover injects a parent's
well-filled bins whole into the other parent, takes out the bins that hold a
piece twice, and puts the displaced pieces where they fit best, or in place of
smaller ones where that fills a bin better.  After each
epoch every island's elite also goes to the next island; at the end the best
island's grouping stays.  Then the bins with room left, of all cells, are dealt
to new cells and evolve once more, from the grouping they have, so a cell loses
no bin by being packed alone.  An island stops early only at the fewest bins that
its pieces' lengths allow.

A null text is an empty document: one piece, the end token.  Repeated rows are
packed each on its own.  An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import heapq
import json
import math
import os
import zlib
from array import array
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import by_bytes, cut, text_buffers

CAPACITY = 2048
#: Pieces of a cell, islands of a cell, epochs, and children of an island in an epoch.
CELL, ISLANDS, EPOCHS, CHILDREN = 4096, 2, 2, 60
#: Individuals of an island.
POPULATION = 6
#: Tokens that end a document.
END = (0).to_bytes(4, "little")
#: Bytes of the texts whose distinct chunks are encoded together.
SLICE = 1 << 23
#: Bytes that begin a visible character: all but those of controls and of the blocks with white space (U+0080, U+1000, U+2000, U+3000).
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = _VISIBLE[0xC3:0xE1] = _VISIBLE[0xE4:] = True


def _beyond_latin(text: str) -> bool:
    """Whether a text has code points above 255, whose classes may change from one version of Unicode to the next."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return True
    return False


class Joined:
    """Texts to ids, as little-endian unsigned 32-bit bytes, by their distinct chunks, which are encoded as one text.

    A text is cut before each space that a visible character follows. There the pattern begins a piece, whatever comes before
    and after, so chunks that begin so have the same ids alone, in their texts and in any order.
    """

    def __init__(self, encode: Callable[[str], list[int]], lengths: np.ndarray) -> None:
        self.encode, self.lengths = encode, lengths  # of a token: its bytes

    def _chunks(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of chunks, and where and how many each chunk's are."""
        raw, at = text_buffers(words)
        joins = (np.diff(at) > 1) & (raw[at[:-1]] == 32) & _VISIBLE[raw[np.minimum(at[:-1] + 1, len(raw) - 1)]]
        text, ends = text_buffers(words.filter(pa.array(joins)))
        found = [np.array(self.encode(text.tobytes().decode()), np.uint32)]
        counts = np.zeros(len(words), np.int64)
        counts[joins] = np.diff(np.searchsorted(np.cumsum(self.lengths[found[0]]), ends, "right"))
        for k in np.flatnonzero(~joins).tolist():
            found.append(np.array(self.encode(words[k].as_py()), np.uint32))
            counts[k] = len(found[-1])
        order = np.concatenate((np.flatnonzero(joins), np.flatnonzero(~joins)))
        begin = np.empty(len(words), np.int64)
        begin[order] = np.cumsum(counts[order]) - counts[order]
        return np.concatenate(found), begin, counts

    def ids(self, texts: Sequence[str | None]) -> list[bytes]:
        raw, at = text_buffers(pa.array([t or "" for t in texts], pa.large_string()))
        if not len(raw):
            return [b""] * len(texts)
        cuts = np.zeros(len(raw) + 1, bool)
        cuts[: len(raw) - 1] = (raw[:-1] == 32) & _VISIBLE[raw[1:]]
        cuts[at[1:][at[1:] > at[:-1]] - 1] = False  # a text's last byte is followed by nothing
        cuts[at] = True
        places = np.flatnonzero(cuts)
        own = pa.Array.from_buffers(pa.large_string(), len(places) - 1, [None, pa.py_buffer(places), pa.py_buffer(raw)]).dictionary_encode()
        found, begin, counts = self._chunks(own.dictionary)
        of = own.indices.to_numpy()
        ends = np.concatenate(([0], np.cumsum(counts[of])))
        out = found[np.arange(ends[-1]) + np.repeat(begin[of] - ends[:-1], counts[of])].astype("<u4").tobytes()
        bounds = (4 * ends[np.searchsorted(places, at)]).tolist()
        return [out[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


class Marked:
    """Texts to ids, where added tokens stand for themselves and part the text.

    The two libraries know different versions of Unicode: a text with a code point that they don't put into the same class
    gets its ids from the tokenizers library itself.
    """

    def __init__(self, plain: Joined, added: list[dict], file: str | None = None) -> None:
        self.file, self.differs = file, {}
        for x in added:
            if x["single_word"] or x["lstrip"] or x["rstrip"]:
                raise NotImplementedError(f"added token {x['content']!r} that depends on its surroundings")
        self.plain, self.added = plain, {x["content"]: int(x["id"]).to_bytes(4, "little") for x in added}
        names = list(map(regex.escape, sorted(self.added, key=len, reverse=True)))
        self.split = regex.compile(f"({'|'.join(names)})").split if names else lambda text: [text]

    @functools.cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.file)

    def _own(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _differs(self, point: str) -> bool:
        """Whether the libraries part letters, digits or marks and a code point in different ways."""
        if point not in self.differs:
            tries = [x + point for x in "a1!"]
            self.differs[point] = self.plain.ids(tries) != [self._own(x) for x in tries]
        return self.differs[point]

    def ids(self, texts: Sequence[str | None]) -> list[bytes]:
        if self.file:
            odd = {k for k, t in enumerate(texts) if t and _beyond_latin(t) and any(self._differs(c) for c in set(t) if c > "\xff")}
            if odd:
                rest = iter(self._marked([t for k, t in enumerate(texts) if k not in odd]))
                return [self._own(t) if k in odd else next(rest) for k, t in enumerate(texts)]
        return self._marked(texts)

    def _marked(self, texts: Sequence[str | None]) -> list[bytes]:
        parts = [self.split(t or "") for t in texts]  # every second one is an added token
        own = iter(self.plain.ids([x for p in parts for x in p[::2]]))
        return [b"".join(self.added[x] if k % 2 else next(own) for k, x in enumerate(p)) for p in parts]


@functools.lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str) -> Marked:
    """A worker's tokenizer. The rank file of the same vocabulary gives the ids of the tokenizers file in a fifth of the time.

    Added tokens are those of the tokenizers file beside it, if there is one.
    """
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    own = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    lengths[list(ranks.values())] = list(map(len, ranks))
    plain = Joined(own.encode_ordinary, lengths)
    added, file = [], os.path.splitext(path)[0] + ".json"
    if os.path.exists(file):
        with open(file, encoding="utf-8") as text:
            added = json.load(text)["added_tokens"]
    return Marked(plain, added, file if os.path.exists(file) else None)


def starts(n: int, capacity: int) -> list[int]:
    """Where the pieces of n tokens begin; only the first may be shorter than the capacity."""
    return [0, *range((n - 1) % capacity + 1, n, capacity)]


def pieces(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids of every document's pieces."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        ids = tokenizer(path, pattern).ids(batch.column("text").to_pylist())
        for doc_id, own in zip(batch.column("doc_id").to_pylist(), ids, strict=True):
            own += END
            for k, at in enumerate(starts(len(own) // 4, capacity)):
                end = at + capacity if k else (len(own) // 4 - 1) % capacity + 1
                part = own[4 * at : 4 * end]
                rows.append((doc_id, k, at, len(part) // 4, zlib.crc32(part), *[np.frombuffer(part, "<i4")] * keep_ids))
        columns = list(zip(*rows, strict=True)) or [[]] * len(names)
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return docs.select("doc_id", "text").mapInArrow(by_bytes(step, "text", SLICE), schema)


class Bins:
    """Open bins by the room they have left; finds the tightest that fits."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.count, self.open, self.mask = capacity, 0, [[] for _ in range(capacity + 1)], 0

    def add(self, room: int) -> int:
        self.count += 1
        self._put(self.count - 1, room)
        return self.count - 1

    def _put(self, bin_: int, room: int) -> None:
        self.open[room].append(bin_)
        self.mask |= 1 << room

    def fit(self, size: int) -> int:
        """The bin with the least room for size, or a new one."""
        over = self.mask >> size
        if not over:
            return self.add(self.capacity - size)
        room = size + (over & -over).bit_length() - 1
        bin_ = self.open[room].pop()
        if not self.open[room]:
            self.mask ^= 1 << room
        self._put(bin_, room - size)
        return bin_


def best_fit(sizes: np.ndarray, order: np.ndarray, capacity: int, bins: Bins | None = None, out: np.ndarray | None = None) -> np.ndarray:
    """The bin of each piece, taken in order; pieces that out has already keep theirs."""
    bins = bins or Bins(capacity)
    out = np.empty(len(sizes), np.int64) if out is None else out
    out[order] = [bins.fit(s) for s in sizes[order].tolist()]
    return out


def exchanged(sizes: np.ndarray, loose: np.ndarray, capacity: int, out: np.ndarray) -> np.ndarray:
    """out with the loose pieces placed (theirs are -1), before any new bin is begun.

    The largest loose piece goes where it fits best. Where it fits nowhere, it takes the place of the smallest piece that it can
    stand for, in the room of that piece's bin; the bin gets fuller, and the smaller piece is loose instead. What is left in the
    end is placed by best fit.
    """
    n = int(out.max(initial=-1)) + 1
    rooms = capacity - np.bincount(out[out >= 0], sizes[out >= 0], minlength=n).astype(np.int64)
    queue = [(-int(sizes[i]), int(i)) for i in loose]
    heapq.heapify(queue)
    left = []
    for _ in range(4 * len(loose) + 40):
        if not queue or not n:
            break
        size, i = queue[0][0] * -1, queue[0][1]
        fits = np.flatnonzero(rooms >= size)
        if len(fits):
            heapq.heappop(queue)
            out[i] = fits[rooms[fits].argmin()]
            rooms[out[i]] -= size
            continue
        gain = size - sizes
        gain[(out < 0) | (gain <= 0) | (gain > rooms[out])] = 0
        j = int(gain.argmax())
        if not gain[j]:
            left.append(heapq.heappop(queue)[1])
            continue
        out[i], out[j] = out[j], -1
        rooms[out[i]] -= gain[j]
        heapq.heapreplace(queue, (-int(sizes[j]), j))
    rest = np.array([*left, *(i for _, i in queue)], np.int64)
    bins = Bins(capacity)
    for room in rooms.tolist():
        bins.add(room)
    return best_fit(sizes, rest[np.argsort(-sizes[rest], kind="stable")], capacity, bins, out)


def fitness(bins: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones: the mean of squared fills. The smaller, the fitter."""
    fill = np.bincount(bins, sizes) / capacity
    used = fill[fill > 0]
    return len(used), -float(np.square(used).mean()) if len(used) else 0.0


def crossover(one: np.ndarray, two: np.ndarray, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """one, with some of two's bins injected, of those that are fuller than most bins of both."""
    fill, other = np.bincount(two, sizes), np.bincount(one, sizes)
    good = np.flatnonzero(fill >= np.quantile(np.concatenate((fill[fill > 0], other[other > 0])), 0.5))
    injected = np.zeros(len(fill), bool)
    injected[rng.permutation(good)[: max(1, int(len(good) * rng.uniform(0.02, 0.2)))]] = True
    given = injected[two]
    broken = np.zeros(one.max() + 1, bool)
    broken[one[given]] = True
    loose = broken[one] & ~given
    stay = ~given & ~loose
    out = np.full(len(one), -1)
    kept, out_kept = np.unique(one[stay], return_inverse=True)
    out[stay] = out_kept
    new, out_new = np.unique(two[given], return_inverse=True)
    out[given] = out_new + len(kept)
    return exchanged(sizes, np.flatnonzero(loose), capacity, out)


def mutated(bins: np.ndarray, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """bins without its emptiest and a few others, whose pieces go in anew."""
    _, own = np.unique(bins, return_inverse=True)
    fill = np.bincount(own, sizes)
    out = np.zeros(len(fill), bool)
    out[np.argsort(fill)[: rng.integers(1, 4)]] = True
    out[rng.integers(0, len(fill), rng.integers(1, 6))] = True
    _, kept = np.unique(own[~out[own]], return_inverse=True)
    new = np.full(len(bins), -1)
    new[~out[own]] = kept
    return exchanged(sizes, np.flatnonzero(out[own]), capacity, new)


def evolve(sizes: np.ndarray, seeds: Sequence[np.ndarray], capacity: int, rng: np.random.Generator, children: int = CHILDREN) -> np.ndarray:
    """The fittest grouping after a number of children; stops early at the fewest bins there can be."""
    return _evolved(sizes, seeds, capacity, rng, children)[0]


def _evolved(sizes: np.ndarray, seeds: Sequence[np.ndarray], capacity: int, rng: np.random.Generator, children: int = CHILDREN) -> tuple[np.ndarray, int, int]:
    """evolve()'s grouping, the crossovers that were made, and the bins of best fit alone."""
    least = math.ceil(sizes.sum() / capacity)
    people = [(fitness(s, sizes, capacity), k, s) for k, s in enumerate(seeds)]
    plain = best_fit(sizes, np.argsort(-sizes, kind="stable"), capacity)
    people.append((fitness(plain, sizes, capacity), len(people), plain))
    bins = people[-1][0][0]
    people.sort(key=lambda x: x[:2])
    if people[0][0][0] <= least:
        return people[0][2], 0, bins
    for k in range(len(people), POPULATION):
        own = best_fit(sizes, np.argsort(-(sizes + rng.uniform(0, 0.1 * (k + 1) * capacity, len(sizes))), kind="stable"), capacity)
        people.append((fitness(own, sizes, capacity), k, own))
    people.sort(key=lambda x: x[:2])
    made = 0
    for k in range(children):
        if people[0][0][0] <= least:
            break
        one, two = rng.choice(len(people), 2, replace=False)
        child = crossover(people[one][2], people[two][2], sizes, capacity, rng)
        child = mutated(child, sizes, capacity, rng) if k % 3 == 2 else child
        made += 1
        # The child takes the place of the least fit, unless it is less fit still.
        people = sorted([*people, (fitness(child, sizes, capacity), len(seeds) + POPULATION + k, child)], key=lambda x: x[:2])[: max(POPULATION, len(seeds) + 1)]
    return people[0][2], made, bins


_PLACED = "_row long, length long, cell long, island int, own long, bins long, made long, plain long"


def _epoch(k: int, capacity: int):
    """A function for applyInPandas over an island: its pieces in the fittest grouping, with the bins, crossovers and bins of best fit."""

    def run(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("_row", ignore_index=True)
        sizes = own["length"].to_numpy()
        seeds = [own[c].to_numpy() for c in ("own", "guest") if (own[c] >= 0).all()]
        best, made, plain = _evolved(sizes, seeds, capacity, np.random.default_rng([int(key[0]), int(key[1]) + 1, k]))
        _, best = np.unique(best, return_inverse=True)
        return own.assign(own=best, bins=int(best.max()) + 1, made=own["made"] + made, plain=plain)[[x.split()[0] for x in _PLACED.split(", ")]]

    return run


def grouped(short: DataFrame, capacity: int = CAPACITY, cell: int = CELL, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """The best island's grouping of (_row, length): cell and own name a bin; bins, made and plain are the cell's bins, crossovers and bins of best fit."""
    cells = max(1, math.ceil(short.count() / cell))
    items = short.select("_row", "length", F.pmod(F.xxhash64("_row"), F.lit(cells)).alias("cell"), F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"))
    none = F.lit(-1).cast("long")
    bins = items.withColumns({"own": none, "guest": none, "made": F.lit(0).cast("long")})
    for k in range(epochs):
        found = bins.groupBy("cell", "island").applyInPandas(_epoch(k, capacity), _PLACED)
        if k + 1 < epochs:
            # A row for the island itself and one for the next; they meet again as own and guest.
            both = found.withColumn("to", F.explode(F.array(F.lit(0), F.lit(1))))
            at = F.pmod(F.col("island") + F.col("to"), F.lit(islands))
            bins = both.groupBy("cell", at.alias("island"), "_row", "length").agg(*(F.max(F.when(F.col("to") == to, F.col(c))).alias(n) for to, c, n in ((0, "own", "own"), (1, "own", "guest"), (0, "made", "made"))))
    best = F.min(F.struct("bins", "island")).over(Window.partitionBy("cell"))
    return found.withColumn("best", best).where(F.col("island") == F.col("best.island")).drop("best")


def repacked(found: DataFrame, capacity: int = CAPACITY, cell: int = CELL) -> DataFrame:
    """found (grouped), with the bins that have room left, of all cells, packed once more together; never into more bins."""
    found = cut(found)
    fill = F.sum("length").over(Window.partitionBy("cell", "own"))
    marked = found.withColumn("loose", fill < capacity)
    loose = marked.where("loose").withColumn("bin", F.struct("cell", "own"))
    cells = max(1, math.ceil(loose.count() / cell))
    # A bin's pieces stay together, and their new cell knows their grouping by the place of its first piece.
    first = F.min("_row").over(Window.partitionBy("cell", "own"))
    again = loose.withColumn("own", first).withColumn("cell", F.pmod(F.xxhash64("bin"), F.lit(cells))).withColumns({"guest": F.lit(-1).cast("long"), "island": F.lit(-1)})
    named = F.dense_rank().over(Window.partitionBy("cell").orderBy("own")).cast("long")  # a cell's pieces
    packed = again.withColumn("own", named).groupBy("cell", "island").applyInPandas(_epoch(99, capacity), _PLACED)
    return marked.where("not loose").drop("loose").unionByName(packed)


def pack(parts: DataFrame, capacity: int = CAPACITY, cell: int = CELL, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """parts (with a column length) with sequence_id and offset; every row in exactly one sequence.

    Lengths are from 1 to the capacity.  parts is computed once.
    """
    numbered = cut(parts.withColumn("_row", F.monotonically_increasing_id()))
    short = numbered.where(F.col("length") < capacity)
    final = repacked(grouped(short, capacity, cell, islands, epochs), capacity, cell)
    before = F.sum("length").over(Window.partitionBy("island", "cell", "own").orderBy("_row")) - F.col("length")
    last = F.when(F.col("island") < 0, 1).otherwise(0)  # bins of the last round have numbers of their own
    placed = final.select("_row", (((F.col("cell") * 2 + last) * (1 << 24)) + F.col("own")).alias("sequence_id"), before.alias("offset"))
    full = numbered.where(F.col("length") >= capacity).withColumn("sequence_id", -1 - F.col("_row")).withColumn("offset", F.lit(0).cast("long"))
    return short.join(placed, "_row").unionByName(full).drop("_row")
