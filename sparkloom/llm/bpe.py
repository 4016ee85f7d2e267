"""Byte-level BPE by padded numpy matrices.

The distinct pieces of a batch are put in matrices by length.  In each round
every row merges its leftmost pair of minimum rank, found by a hashed pair
lookup, closes the gap, and rows without a pair left are taken out.  A piece
longer than LONGEST bytes is a matrix of one row, whose equal pairs merge
together where that gives the same ids.

Texts split into chunks at spaces where no piece of the pattern can cross;
chunks recur, and their ids are kept in a bounded cache of the worker.

Null texts count as empty: no ids, and nothing to decode.  Repeated rows stay,
and equal texts have equal results; columns but doc_id and text are not read.  An
empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import by_slices

#: Bytes of the longest piece that is merged in a matrix with others.
LONGEST = 128
#: Cells of the largest matrix.
CELLS = 1 << 20
#: Chunks kept by a worker, and code points of the longest chunk kept.
CACHED, CACHED_CHARS = 250_000, 48
_NONE = np.iinfo(np.int32).max
#: A space inside white space that does not end it: there, cutting at spaces would cut a piece.
_CROSSED = re.compile(r"\s (?:\s|\Z)|\x00")


class PairTable:
    """Open addressing from (left id, right id) to the merged id, read by whole arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray) -> None:
        self.bits = max(10, int(len(left) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, _NONE, np.int32)
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot, rest = self._slot(keys), np.arange(len(keys))
        self.probes = 0
        while len(rest):
            free = rest[self.keys[slot[rest]] < 0]
            _, first = np.unique(slot[free], return_index=True)
            taken = free[first]
            self.keys[slot[taken]], self.values[slot[taken]] = keys[taken], merged[taken]
            rest = np.setdiff1d(rest, taken, assume_unique=True)
            slot[rest] = (slot[rest] + 1) & ((1 << self.bits) - 1)
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged ids, or the largest int32; a negative id is padding and merges with nothing."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64) & 0xFFFFFFFF
        shape, keys = keys.shape, keys.ravel()
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.values[slot], np.int32(_NONE))
        open_ = np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] >= 0))
        for _ in range(1, self.probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            seen = self.keys[slot[open_]]
            hit = seen == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (seen >= 0)]
        out[(left.ravel() < 0) | (right.ravel() < 0)] = _NONE
        return out.reshape(shape)


class Vocabulary:
    """A rank file: the ids of byte strings, which are also the order of merges."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines)}
        self.bytes_id = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        splits = [(self.ranks[x[:i]], self.ranks[x[i:]], r) for x, r in self.ranks.items() for i in range(1, len(x)) if x[:i] in self.ranks and x[i:] in self.ranks]
        self.pairs = PairTable(*np.array(splits, np.int32).T)
        top = max(self.ranks.values()) + 1
        by_id = [b""] * top
        for x, r in self.ranks.items():
            by_id[r] = x
        self.lengths = np.array([len(x) for x in by_id], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))
        self.flat = np.frombuffer(b"".join(by_id), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, gathered in one step."""
        if not len(ids):
            return b""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        at = np.arange(ends[-1]) + np.repeat(self.starts[ids] - (ends - n), n)
        return self.flat[at].tobytes()

    def encode_pieces(self, pieces: Sequence[bytes]) -> list[bytes]:
        """Each piece's ids as little-endian 32-bit bytes: the piece's own id where it has one, else what the merges leave."""
        out = [b""] * len(pieces)
        by_room: dict[int, list[int]] = {}
        for i, x in enumerate(pieces):
            if (own := self.ranks.get(x)) is not None:
                out[i] = own.to_bytes(4, "little")
            elif len(x) > LONGEST:
                out[i] = self._row(x)
            elif x:
                by_room.setdefault((len(x) + 3) & -4, []).append(i)
        for room, rows in by_room.items():
            step = max(1, CELLS // room)
            for at in range(0, len(rows), step):
                own = rows[at : at + step]
                for i, ids in zip(own, self._matrix([pieces[i] for i in own], room), strict=True):
                    out[i] = ids
        return out

    def _matrix(self, pieces: list[bytes], room: int) -> list[bytes]:
        n = np.array([len(x) for x in pieces])
        raw = np.frombuffer(b"".join(x.ljust(room, b"\0") for x in pieces), np.uint8).reshape(len(pieces), room)
        ids = np.where(np.arange(room) < n[:, None], self.bytes_id[raw], np.int32(-1))
        ranks = self.pairs.get(ids[:, :-1], ids[:, 1:])
        rows, done = np.arange(len(pieces)), [b""] * len(pieces)
        while len(rows):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), at]
            if (over := best == _NONE).any():
                raw, width = ids[over].astype("<u4").tobytes(), 4 * ids.shape[1]
                for k, (r, m) in enumerate(zip(rows[over].tolist(), n[over].tolist(), strict=True)):
                    done[r] = raw[k * width : k * width + 4 * m]
                left = ~over
                width = max(2, int(n[left].max(initial=2)))
                rows, n, at, best = rows[left], n[left], at[left], best[left]
                ids, ranks = ids[left][:, :width], ranks[left][:, : width - 1]
                if not len(rows):
                    break
            each, width = np.arange(len(rows)), ids.shape[1]
            ids[each, at] = best
            columns = np.arange(width)
            moved = np.minimum(columns + (columns > at[:, None]), width - 1)
            ids = np.take_along_axis(ids, moved, axis=1)
            n -= 1
            ids[each, n] = -1
            if width > 2:
                columns = np.arange(width - 1)
                moved = np.minimum(columns + (columns > at[:, None]), width - 2)
                ranks = np.take_along_axis(ranks, moved, axis=1)
            after = np.minimum(at, width - 2)
            ranks[each, after] = self.pairs.get(ids[each, after], ids[each, after + 1])
            ranks[each, width - 2] = self.pairs.get(ids[each, width - 2], ids[each, width - 1])
            before = np.flatnonzero(at > 0)
            ranks[before, at[before] - 1] = self.pairs.get(ids[before, at[before] - 1], ids[before, at[before]])
        return done

    def _row(self, piece: bytes) -> bytes:
        """The same merges for a matrix of one long row, whose places are linked to their neighbours and compacted by halves.

        A round merges all places of the minimum rank from left to right, up to the first that makes a pair of
        lower rank: just what merging the leftmost again and again does.
        """
        ids = np.append(self.bytes_id[np.frombuffer(piece, np.uint8)], np.int32(-1))
        alive = len(ids) - 1
        after, before = np.arange(1, len(ids) + 1), np.arange(-1, len(ids) - 1)
        ranks = np.append(self.pairs.get(ids[:-1], ids[1:]), np.int32(_NONE))
        while (rank := ranks.min()) != _NONE:
            at = np.flatnonzero(ranks == rank)
            # In a run of overlapping pairs every second one is taken.
            first = np.concatenate(([True], after[at[:-1]] != at[1:]))
            begun = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - begun) % 2 == 0]
            right = after[after[at]]
            left = ids[before[at]]
            left[1:][right[:-1] == at[1:]] = rank
            merged = np.full(len(at), rank, np.int32)
            lower = (self.pairs.get(left, merged) < rank) | (self.pairs.get(merged, ids[right]) < rank)
            if lower.any():
                at = at[: int(lower.argmax()) + 1]
            gone = after[at]
            right = after[gone]
            ids[at], ids[gone], ranks[gone] = rank, -1, _NONE
            after[at], before[right] = right, at
            ranks[at] = self.pairs.get(ids[at], ids[right])
            left = before[at]
            own = left >= 0
            ranks[left[own]] = self.pairs.get(ids[left[own]], ids[at[own]])
            alive -= len(at)
            if 2 * alive < len(ids):
                stay = np.append(np.flatnonzero(ids >= 0), len(ids) - 1)
                ids, ranks = ids[stay], ranks[stay]
                after, before = np.arange(1, len(ids) + 1), np.arange(-1, len(ids) - 1)
        return ids[ids >= 0].astype("<u4").tobytes()


def chunks(text: str, pattern: regex.Pattern) -> list[str]:
    """A text in pieces or runs of whole pieces, so that encoding each alone gives the text's ids."""
    return pattern.findall(text) if _CROSSED.search(text) else text.replace(" ", "\x00 ").split("\x00")


class Cached:
    """Texts to ids, as little-endian unsigned 32-bit bytes, by chunks that are kept."""

    def __init__(self, pattern: str, encode: Callable[[Sequence[str]], Iterable[bytes]]) -> None:
        self.pattern, self.encode = regex.compile(pattern), encode
        self.kept: dict[str, bytes] = {}

    def ids(self, texts: Sequence[str | None]) -> list[bytes]:
        parts = [chunks(t, self.pattern) if t else [] for t in texts]
        missing = list(set().union(*parts).difference(self.kept))
        self.kept.update(zip(missing, self.encode(missing), strict=True))
        out = [b"".join(map(self.kept.__getitem__, p)) for p in parts]
        if len(self.kept) > CACHED:
            self.kept.clear()
        for x in missing:
            if len(x) > CACHED_CHARS:
                self.kept.pop(x, None)
        return out


class Coder(Cached):
    """Encodes texts by a rank file, with its pattern, and decodes ids."""

    def __init__(self, path: str, pattern: str) -> None:
        super().__init__(pattern, self._chunks)
        self.vocabulary = Vocabulary(path)
        self.pieces: dict[str, bytes] = {}

    def _chunks(self, missing: Sequence[str]) -> list[bytes]:
        parts = list(map(self.pattern.findall, missing))
        new = list(set().union(*parts).difference(self.pieces))
        self.pieces.update(zip(new, self.vocabulary.encode_pieces([x.encode("utf-8", "surrogatepass") for x in new]), strict=True))
        out = [b"".join(map(self.pieces.__getitem__, own)) for own in parts]
        if len(self.pieces) > CACHED:
            self.pieces.clear()
        return out

    def decode(self, ids: bytes) -> bytes:
        return self.vocabulary.decode(np.frombuffer(ids, "<u4"))


@functools.lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> Coder:
    """A worker's coder for a rank file."""
    return Coder(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array of int) of every text."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = coder(path, pattern).ids(batch.column("text").to_pylist())
        counts = np.cumsum([0, *(len(x) // 4 for x in ids)])
        flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
        return pa.record_batch([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(counts, pa.int32()), flat)], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(by_slices(step), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, raw (bytes) of every row's ids."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = coder(path, pattern).vocabulary
        raw = [own.decode(np.array(x or [], np.int64)) for x in batch.column("ids").to_pylist()]
        return pa.record_batch([batch.column("doc_id"), pa.array(raw, pa.binary())], ["doc_id", "raw"])

    return encoded.select("doc_id", "ids").mapInArrow(by_slices(step), "doc_id long, raw binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of a text's ids and of what they decode to, in one pass over the texts."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = coder(path, pattern)
        ids = own.ids(batch.column("text").to_pylist())
        columns = [
            batch.column("doc_id"),
            pa.array([len(x) // 4 for x in ids], pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
            pa.array([hashlib.sha256(own.decode(x)).hexdigest() for x in ids]),
        ]
        return pa.record_batch(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(by_slices(step, 256), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
