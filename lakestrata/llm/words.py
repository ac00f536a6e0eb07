"""Words, word hashes and shingles of whole Arrow columns of text, in numpy.

A word is a run of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z became a-z: ASCII digits, letters and
everything beyond ASCII. That is decided byte by byte, so no text is decoded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
IN_WORD = np.zeros(256, bool)
IN_WORD[ord("0") : ord("9") + 1] = True
IN_WORD[ord("a") : ord("z") + 1] = True
IN_WORD[128:] = True

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


@dataclass
class Words:
    """The words of some texts: `first[i]` to `first[i + 1]` are those of text i."""

    data: np.ndarray  # the bytes of all texts, lower-cased
    begins: np.ndarray  # of each text
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray
    sums: np.ndarray  # of the bytes before each place, times powers of the base
    down: np.ndarray  # powers of the inverse

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def prefix(self, n: int) -> np.ndarray:
        """Hashes of the first n bytes of each word, 0 for shorter words."""
        ends = np.minimum(self.starts + n, len(self.data))
        found = mix((self.sums[ends] - self.sums[self.starts]) * self.down[self.starts] + np.uint64(n))
        found[self.ends - self.starts < n] = 0
        return found

    def text(self, i: int) -> str:
        return self.data[self.starts[i] : self.ends[i]].tobytes().decode("utf-8", "replace")


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column without nulls."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    places = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[places[0] : places[-1]], places - places[0]


def hash_spans(sums: np.ndarray, down: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * down[starts])


def words_of(texts: pa.Array) -> Words:
    raw, begins = buffers(texts)
    data = LOWER[raw]
    inside = IN_WORD[data]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    before[begins[:-1][begins[:-1] < len(data)]] = False
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    last = begins[1:] - 1
    after[last[last >= 0]] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=sums[1:])
    down = powers(INVERSE, len(data) + 1)
    first = np.searchsorted(starts, begins)
    return Words(data, begins, starts, ends, first, hash_spans(sums, down, starts, ends), sums, down)


def chunks(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Slices of about `size` bytes, with the index of their first text; a longer text is a slice of its own."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, places = buffers(texts)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(places, places[at] + size, "right")) - 1)
        yield at, texts.slice(at, to - at)
        at = to


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of n words in a row, sorted within each text, and where those of each text begin.

    A text of fewer words, but not none, has one shingle of all its words.
    """
    counts = words.counts
    rows = len(counts)
    h, total = words.hashes, len(words.hashes)
    per_text = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    if not total:
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    padded = np.concatenate([h, np.zeros(n, np.uint64)])
    rolled = np.zeros(total, np.uint64)
    for k in range(n):
        rolled = rolled * BASE + padded[k : k + total]
    owner = words.owner
    place = np.arange(total) - words.first[:-1][owner]
    keep = place < per_text[owner]
    short = np.flatnonzero((counts > 0) & (counts < n))
    for i in short:  # few: texts of less than n words
        value = np.array([counts[i]], np.uint64)
        for k in range(words.first[i], words.first[i + 1]):
            value = value * BASE + h[k : k + 1]
        rolled[words.first[i]] = value[0]
    values, owner = mix(rolled[keep]), owner[keep]
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[new], owner[new]
    return values, np.searchsorted(owner, np.arange(rows + 1))
