"""Word shingles of whole texts, hashed with numpy a batch at a time.

A word is a maximal run of letters, digits or underscores of the lower-cased
text.  A shingle is five consecutive words; a text of one to four words has one
shingle, all its words; a text without words has none.  Shingles are 63-bit
hashes.  Null texts count as empty.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np

#: Multiplier of the rolling word hash (odd, so invertible modulo 2**64).
_BASE = 0x9E3779B97F4A7C15
#: Texts are hashed in slices of about this many code points, to bound memory.
SLICE_CHARS = 1 << 20


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Whether a code point is part of a word; odd random-looking values for code points."""
    points = np.fromiter((chr(i).isalnum() or i == 95 for i in range(0x110000)), bool, 0x110000)
    values = mix(np.arange(0x110000, dtype=np.uint64) + np.uint64(1))
    return points, values


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base, inverse = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    base[:1] = inverse[:1] = 1
    return np.multiply.accumulate(base), np.multiply.accumulate(inverse)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: Sequence[str], prefixes: Sequence[int] = ()) -> tuple[np.ndarray, ...]:
    """All words' hashes in order, the number of words of each text, and hashes of the words' beginnings.

    For each length in prefixes there is an array as long as the first; a word that isn't longer has its own hash there.
    """
    joined = "\n".join(t.lower() for t in texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends_of_text = np.cumsum([len(t.lower()) + 1 for t in texts]) if len(texts) else np.empty(0, np.int64)
    in_word, values = _tables()
    flags = in_word[points].view(np.int8)
    edges = np.flatnonzero(np.diff(flags, prepend=np.int8(0)))
    starts, ends = edges[::2], edges[1::2]  # the last code point is no part of a word
    room = 1 << max(12, int(len(points)).bit_length())
    power, inverse = _powers(room)
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(values[points] * power[: len(points)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    counts = np.diff(np.searchsorted(starts, ends_of_text), prepend=0)
    begun = []
    for n in prefixes:
        longer = np.flatnonzero(ends - starts > n)
        own = hashes.copy()
        own[longer] = mix((sums[starts[longer] + n] - sums[starts[longer]]) * inverse[starts[longer]] + np.uint64(n << 32))
        begun.append(own)
    return hashes, counts, *begun


def shingle_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """The distinct shingles of one text's words, ascending, as 63-bit int64."""
    if not len(words):
        return np.empty(0, np.int64)
    n = min(size, len(words))
    out = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[i : len(words) - n + 1 + i]
    out = np.sort(mix(out) >> np.uint64(1)).view(np.int64)
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def each(texts: Sequence[str | None], size: int = 5) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text: its words' hashes and its shingles."""
    at = 0
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and (chars < SLICE_CHARS or end == at):
            chars += len(texts[end] or "")
            end += 1
        words, counts = word_hashes([t or "" for t in texts[at:end]])
        for own in np.split(words, np.cumsum(counts)[:-1]):
            yield own, shingle_hashes(own, size)
        at = end
