"""Token counts by transducers that are compiled from a tokenizers file.

Two deterministic transducers read a text one after the other.  The first reads
classes of code points and says where the pre-tokenizer's pieces begin.  The
second reads bytes; after each one it has counted the tokens of what the piece
holds so far, so a transition carries by how many that count changes.  Its states
are sets of places in the vocabulary's trie, each with the token that ends before
it; the set is made deterministic as texts ask for it, and a bounded table keeps
the transitions.

Texts are cut into chunks that run side by side in numpy.  A chunk is a map from
the state before it to the state after it and what it counts.  The first
transducer's maps hold all of its states, and a parallel prefix scan composes
them to the state before each chunk.  A chunk of the second one begins with a
piece if any begins there, so that its map is constant; inside a longer piece
the map holds the state that a run-up gives, and where the chunk before ends in
another one, that one is added to the map.

Null texts count as empty: no bytes, no tokens.  Repeated rows stay.  Texts of
any length are read whole; columns but doc_id and text are not read.  An empty
table gives an empty result.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_bytes, text_buffers

#: Bytes of texts that a task holds at a time, or one text.
SLICE = 1 << 20
#: Code points and bytes of a chunk, and bytes of a run-up.
POINTS, CHUNK, RUN_UP = 64, 512, 64
#: States that a worker keeps; beyond, those not in use go and are compiled again when they come.
STATES = 1 << 17
#: Pairs of tokens whose order is kept.
PAIRS = 1 << 20

# The pre-tokenizer's pieces, as its file's kind defines them: contractions, then letters, digits, other marks
# (each with a space before), and white space, whose last one goes to what follows.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Classes of code points: the end of a text, letters (those of contractions apart), digits, the apostrophe, marks, space, white space.
END, LETTER, STMD, RV, E, L, DIGIT, QUOTE, MARK, SPACE, WHITE = range(11)
#: States, named by what was read: nothing; a run of letters, digits or marks; an apostrophe that begins a piece, and it with a letter
#: that may be a contraction's first of two; a whole contraction; one space, one white space, more white space that ends with a space or not.
START, LETTERS, DIGITS, MARKS, QUOTED, QUOTED_RV, QUOTED_L, CONTRACTED, ONE_SPACE, ONE_WHITE, SPACES, WHITES = (16 * k for k in range(12))
#: What a transition says: a piece begins here, and a piece began with the code point before.
HERE, BEFORE = 1, 2


@functools.cache
def piece_transducer() -> tuple[bytes, bytes]:
    """For state | class the next state, and what the transition says."""
    step, say = bytearray(256), bytearray(256)
    letters = (LETTER, STMD, RV, E, L)
    fresh = dict.fromkeys(letters, LETTERS) | {DIGIT: DIGITS, QUOTE: QUOTED, MARK: MARKS, SPACE: ONE_SPACE, WHITE: ONE_WHITE}

    def put(state: int, kind: int, to: int, said: int) -> None:
        step[state | kind], say[state | kind] = to, said

    for state in (START, LETTERS, DIGITS, MARKS, QUOTED, QUOTED_RV, QUOTED_L, CONTRACTED, ONE_SPACE, ONE_WHITE, SPACES, WHITES):
        for kind, to in fresh.items():
            put(state, kind, to, HERE)
        put(state, END, START, BEFORE if state in (QUOTED_RV, QUOTED_L) else 0)
    for kind in letters:
        put(LETTERS, kind, LETTERS, 0)
        put(ONE_SPACE, kind, LETTERS, 0)
        put(SPACES, kind, LETTERS, BEFORE)
        put(QUOTED_RV, kind, *((CONTRACTED, 0) if kind == E else (LETTERS, BEFORE)))
        put(QUOTED_L, kind, *((CONTRACTED, 0) if kind == L else (LETTERS, BEFORE)))
    for state, to, kinds in ((DIGITS, DIGITS, (DIGIT,)), (MARKS, MARKS, (MARK, QUOTE)), (QUOTED, MARKS, (MARK, QUOTE))):
        for kind in kinds:
            put(state, kind, to, 0)
    put(QUOTED, STMD, CONTRACTED, 0)
    put(QUOTED, RV, QUOTED_RV, 0)
    put(QUOTED, L, QUOTED_L, 0)
    for kind in (DIGIT, QUOTE, MARK, SPACE, WHITE):
        for state in (QUOTED_RV, QUOTED_L):  # an apostrophe, then a word of one letter
            put(state, kind, fresh[kind], HERE | BEFORE)
    for state, said in ((ONE_SPACE, 0), (SPACES, BEFORE)):
        put(state, DIGIT, DIGITS, said)
        put(state, QUOTE, MARKS, said)
        put(state, MARK, MARKS, said)
    for kind in (*letters, DIGIT, QUOTE, MARK):
        put(WHITES, kind, fresh[kind], HERE | BEFORE)
    for state in (ONE_SPACE, ONE_WHITE, SPACES, WHITES):
        put(state, SPACE, SPACES, 0)
        put(state, WHITE, WHITES, 0)
    return bytes(step), bytes(say)


def point_classes(split) -> np.ndarray:
    """Each code point's class, by what the library's own pre-tokenizer puts into one piece."""
    out = np.full(0x110000, MARK, np.uint8)
    points = np.array([c for c in range(0x110000) if c != 0x20 and not 0xD800 <= c < 0xE000])
    for _, (a, b) in split("".join(map(chr, points))):  # runs of a class, or parts of them
        one = chr(points[a])
        out[points[a:b]] = next((k for k, x in ((LETTER, "a"), (DIGIT, "1"), (MARK, "!")) if len(split(x + one)) == 1), WHITE)
    for kind, some in ((STMD, "stmd"), (RV, "rv"), (E, "e"), (L, "l"), (QUOTE, "'"), (SPACE, " ")):
        out[[ord(c) for c in some]] = kind
    return out


class Transitions:
    """An open-addressing table from a state and a byte, as 26 bits, to a state and a count, as 28; a slot holds both."""

    def __init__(self) -> None:
        self.bits, self.held = 16, 0
        self.slots = np.full(1 << self.bits, -1, np.int64)

    def _slot(self, key: int) -> int:
        return (key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 64 - self.bits

    def put(self, key: int, value: int) -> None:
        if self.held << 1 >= len(self.slots):
            old = self.slots[self.slots >= 0]
            self.bits += 1
            self.slots = np.full(1 << self.bits, -1, np.int64)
            for x in old.tolist():
                self._place(x)
        self._place(key << 28 | value)
        self.held += 1

    def _place(self, entry: int) -> None:
        slot = self._slot(entry >> 28)
        while self.slots.item(slot) >= 0:
            slot = slot + 1 & len(self.slots) - 1
        self.slots[slot] = entry

    def one(self, key: int) -> int:
        slot = self._slot(key)
        while (entry := self.slots.item(slot)) >= 0:
            if entry >> 28 == key:
                return entry & 0xFFFFFFF
            slot = slot + 1 & len(self.slots) - 1
        return -1

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 for a key that isn't there."""
        slot = ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)
        entry = self.slots[slot]
        out = entry & 0xFFFFFFF
        left = np.flatnonzero(entry >> 28 != keys)
        while len(left):
            seen = self.slots[slot[left]]
            hit, none = seen >> 28 == keys[left], seen < 0
            out[left[hit]], out[left[none]] = seen[hit] & 0xFFFFFFF, -1
            left = left[~hit & ~none]
            slot[left] = slot[left] + 1 & len(self.slots) - 1
        return out


class Counter:
    """A tokenizers file's transducers, and the tables of what was compiled of the second."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as text:
            own = json.load(text)
        pre, model = own["pre_tokenizer"] or {}, own["model"]
        if pre.get("type") != "ByteLevel" or pre["add_prefix_space"] or not pre.get("use_regex", True) or own["normalizer"] or model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges"):
            raise NotImplementedError("only byte-level BPE without normalisation has these transducers")
        if any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in own["added_tokens"]):
            raise NotImplementedError("an added token that depends on its surroundings")
        added = sorted((x["content"].encode() for x in own["added_tokens"]), key=len, reverse=True)
        self.added = re.compile(b"|".join(map(re.escape, added))) if added else None
        self.classes = point_classes(Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        alphabet = {chr(c): c for c in plain} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in plain)}
        of = lambda name: bytes(alphabet[c] for c in name)
        pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        self.ids = {bytes([c]): c for c in range(256)}
        self.parts: list[tuple[int, int] | None] = [None] * 256
        self.rank = [-1] * 256
        self.merges: dict[int, int] = {}
        for r, (a, b) in enumerate(pairs):
            left, right = self.ids[of(a)], self.ids[of(b)]
            whole = self.ids.setdefault(of(a) + of(b), len(self.parts))
            self.merges.setdefault(left << 32 | right, r)
            if whole == len(self.parts):
                self.parts.append((left, right))
                self.rank.append(r)
        self.spines: dict[int, tuple] = {}
        self.ordered: dict[int, bool] = {}
        self._grow_trie()
        self.start = (0, -1, 0)
        self._clear()

    def _grow_trie(self) -> None:
        """Children by node and byte, each node's token or -1, and whether a node has children. A token that isn't its own bytes' encoding never occurs."""
        self.child: dict[int, int] = {}
        self.token, self.inner = [-1], [True]
        for raw, t in self.ids.items():
            if self.parts[t] is not None and not self.adjacent(*self.parts[t], self.rank[t]):
                continue
            node = 0
            for c in raw:
                self.inner[node] = True
                node = self.child.setdefault(node << 8 | c, len(self.token))
                if node == len(self.token):
                    self.token.append(-1)
                    self.inner.append(False)
            self.token[node] = t

    def _spine(self, t: int, side: int) -> tuple[tuple[int, float], ...]:
        """A token and what it was merged from along one side, each with the rank of the merge that ends it."""
        key = t << 1 | side
        if key not in self.spines:
            out, ends = [], float("inf")
            at: int | None = t
            while at is not None:
                out.append((at, ends))
                ends = self.rank[at]
                at = self.parts[at][side] if self.parts[at] else None
            self.spines[key] = tuple(out)
        return self.spines[key]

    def adjacent(self, a: int, b: int, until: float = float("inf")) -> bool:
        """Whether the tokens a, b are what their bytes together are merged to, by the merges before a rank.

        They are unless some pair across their border is merged first: before the left one's own next merge, and not after the
        right one's, as equal pairs are merged from the left.
        """
        for x, x_ends in self._spine(a, 1):
            for y, y_ends in self._spine(b, 0):
                r = self.merges.get(x << 32 | y)
                if r is not None and r < x_ends and r <= y_ends and r < until:
                    return False
        return True

    def _follows(self, a: int, b: int) -> bool:
        key = a << 32 | b
        out = self.ordered.get(key)
        if out is None:
            if len(self.ordered) >= PAIRS:
                self.ordered.clear()
            out = self.ordered[key] = self.adjacent(a, b)
        return out

    def _clear(self) -> None:
        self.states = [self.start]
        self.number = {self.start: 0}
        self.table = Transitions()

    def _number(self, chain: tuple[int, ...]) -> int:
        out = self.number.setdefault(chain, len(self.states))
        if out == len(self.states):
            self.states.append(chain)
        return out

    def _compile(self, key: int) -> int:
        """The transition of a state and a byte: the last token ends here, and is the one that can follow the token before it."""
        chain, byte, found, more = self.states[key >> 8], key & 255, -1, 0
        kept: list[int] = []
        for k in range(0, len(chain), 3):
            node = self.child.get(chain[k] << 8 | byte)
            if node is None:
                continue
            last, behind, t = chain[k + 1], chain[k + 2], self.token[node]
            if found < 0 and t >= 0 and (last < 0 or self._follows(last, t)):
                found, more = t, behind + 1
            if self.inner[node]:
                kept += (node, last, behind)
        for k in range(2, len(kept), 3):
            kept[k] -= more
        out = self._number((*kept, 0, found, 0)) << 10 | more + 512
        self.table.put(key, out)
        return out

    def _forget(self, held: list[np.ndarray]) -> None:
        """Keeps only the states in the arrays held, which get their new numbers."""
        live = np.unique(np.concatenate(held))
        chains = [self.states[k] for k in live.tolist()]
        self._clear()
        numbers = np.array([self._number(c) for c in chains])
        for a in held:
            a[:] = numbers[np.searchsorted(live, a)]

    def _run(self, raw: np.ndarray, goes_on: np.ndarray, begins: np.ndarray, sizes: np.ndarray, states: np.ndarray, held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The states after chunks and their counts, all chunks side by side, the longest first. goes_on: 0 where a piece begins, else 1."""
        order = np.argsort(-sizes, kind="stable")
        at, left = begins[order], sizes[order]
        now, counts = states[order].astype(np.int64), np.zeros(len(order), np.int64)
        held = [*held, now]
        active = np.searchsorted(-left, -np.arange(left[0] if len(left) else 0))  # chunks longer than j
        for j, m in enumerate(active.tolist()):
            place = at[:m] + j
            now[:m] *= goes_on[place]
            key = now[:m] << 8 | raw[place]
            moved = self.table.get(key)
            if moved.min() < 0:
                if len(self.states) > STATES:
                    self._forget(held)
                    key = now[:m] << 8 | raw[place]
                    moved = self.table.get(key)
                for x in set(key[moved < 0].tolist()):
                    self._compile(x)
                moved = self.table.get(key)
            now[:m] = moved >> 10
            counts[:m] += moved & 1023
        back_states, back_counts = np.empty_like(now), np.empty_like(counts)
        back_states[order], back_counts[order] = now, counts - 512 * left
        return back_states, back_counts

    def _row(self, raw: np.ndarray, state: int) -> tuple[int, int]:
        """As _run, for one chunk inside a piece."""
        count = 0
        for c in raw.tolist():
            moved = self.table.one(state << 8 | c)
            if moved < 0:
                moved = self._compile(state << 8 | c)
            state, count = moved >> 10, count + (moved & 1023) - 512
        return state, count

    def piece_starts(self, raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Offsets at which pieces begin, in texts that lie one after the other and end at `ends`."""
        lead = np.flatnonzero((raw & 0xC0) != 0x80)
        points = raw[lead].astype(np.int64)
        wide = np.flatnonzero(points >= 0xC0)
        if len(wide):
            rest = np.concatenate((raw, np.zeros(3, np.uint8))).astype(np.int64) & 0x3F
            at, first = lead[wide], points[wide]
            two, three = (first & 0x1F) << 6 | rest[at + 1], (first & 0x0F) << 12 | rest[at + 1] << 6 | rest[at + 2]
            four = (first & 0x07) << 18 | rest[at + 1] << 12 | rest[at + 2] << 6 | rest[at + 3]
            points[wide] = np.minimum(np.where(first < 0xE0, two, np.where(first < 0xF0, three, four)), 0x10FFFF)
        # After each text stands an end.
        place = np.arange(len(lead)) + np.searchsorted(ends, lead, "right")
        total = len(lead) + len(ends)
        kinds = np.zeros(-(-total // POINTS) * POINTS, np.uint8)
        kinds[place] = self.classes[points]
        columns = np.ascontiguousarray(kinds.reshape(-1, POINTS).T)  # one row for each step of all chunks
        step, say = piece_transducer()
        move = lambda x, table: np.frombuffer(x.tobytes().translate(table), np.uint8).reshape(x.shape)
        maps = np.broadcast_to(np.arange(12, dtype=np.uint8)[:, None] * 16, (12, columns.shape[1]))
        for kind in columns:
            maps = move(maps | kind, step)
        before = entries(maps)
        said = np.empty_like(columns)
        for j, kind in enumerate(columns):
            key = before | kind
            said[j], before = move(key, say), move(key, step)
        said = said.T.ravel()
        begins = (said & HERE) > 0
        begins[:-1] |= (said[1:] & BEFORE) > 0
        return lead[begins[place]]

    def counts(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The number of tokens of each text, between offsets, without added tokens."""
        n = len(offsets) - 1
        if not len(raw):
            return np.zeros(n, np.int64)
        texts = offsets[:-1][np.diff(offsets) > 0]
        starts = np.union1d(self.piece_starts(raw, offsets[1:]), texts)
        goes_on = np.ones(len(raw), np.uint8)
        goes_on[starts] = 0
        windows = np.arange(0, len(raw), CHUNK)
        first = starts[np.minimum(np.searchsorted(starts, windows), len(starts) - 1)]
        inside = (first >= windows) & (first < windows + CHUNK)
        begins = np.union1d(texts, np.where(inside, first, windows))
        sizes = np.diff(begins, append=len(raw))
        opened = np.flatnonzero(~np.isin(begins, starts))  # chunks that begin inside a piece
        entry = np.zeros(len(begins), np.int64)
        if len(opened):
            ran = np.minimum(RUN_UP, begins[opened])
            entry[opened], _ = self._run(raw, goes_on, begins[opened] - ran, ran, entry[opened], [])
        after, counted = self._run(raw, goes_on, begins, sizes, entry, [entry])
        for k in opened.tolist():  # the chunk before is settled
            if after[k - 1] != entry[k]:
                if len(self.states) > STATES:
                    self._forget([entry, after])
                entry[k] = after[k - 1]
                after[k], counted[k] = self._row(raw[begins[k] : begins[k] + sizes[k]], int(entry[k]))
        return np.bincount(np.searchsorted(offsets[1:], begins, "right"), weights=counted, minlength=n).astype(np.int64)

    def count(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The number of tokens of each text; an added token's text is one, and parts what is around it."""
        held = raw.tobytes() if self.added else b""
        if not self.added or not self.added.search(held):
            return self.counts(raw, offsets)
        kept, ends, whose, out = [], [0], [], np.zeros(len(offsets) - 1, np.int64)
        for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            for m in self.added.finditer(held, a, b):
                out[k] += 1
                kept.append(raw[a : m.start()])
                whose.append(k)
                a = m.end()
            kept.append(raw[a:b])
            whose.append(k)
        ends = np.concatenate(([0], np.cumsum([len(x) for x in kept])))
        np.add.at(out, whose, self.counts(np.concatenate(kept), ends))
        return out


def entries(maps: np.ndarray) -> np.ndarray:
    """The state before each chunk, from all chunks' maps (state, chunk) to states times 16, by a scan in as many steps as the number of chunks has bits."""
    done, d = maps >> 4, 1
    while d < done.shape[1] and not (done == done[0]).all():
        done = np.concatenate((done[:, :d], np.take_along_axis(done[:, d:], done[:, :-d].astype(np.int64), axis=0)), axis=1)
        d *= 2
    return np.concatenate((np.zeros(1, np.uint8), done[0, :-1] << 4)) if done.shape[1] else np.zeros(0, np.uint8)


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """A worker's transducers."""
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, limit: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every text."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw, offsets = text_buffers(batch.column("text"))
        n = counter(path).count(raw, offsets)
        return pa.record_batch([batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(by_bytes(step, "text", SLICE), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
