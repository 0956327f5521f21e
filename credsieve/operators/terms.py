"""The character n-grams of texts as numbers of a vocabulary, found word by word.

An n-gram lies inside one padded word, so a text has those of its words, as often as it has the words. A block of texts
is kept as two short tables: the words of each text, and the terms of each of its distinct words. What is linear in the counts
(a margin, a gradient) goes through the words; a text's length and the texts of a term need the counts of the text's
terms, which ``merged`` gives in pieces of bounded size.

Words without any term, and terms that the vocabulary does not have, count nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SMALLEST, LARGEST = 3, 5
#: Entries that are expanded at once, and bits of a code point.
PIECE, _BITS = 1 << 18, 21
#: Words that are looked up at once, and entries that are added up at once.
WORDS, _CACHED = 1 << 14, 1 << 16
_SPACE = ord(" ")


class Rows(NamedTuple):
    """Numbers with their counts, row after row: how many of them each row has. Without counts each counts once."""

    sizes: np.ndarray
    numbers: np.ndarray
    counts: np.ndarray | None = None

    def times(self, vector: np.ndarray) -> np.ndarray:
        """The sum over each row of its counts times the vector at its numbers."""
        total = np.zeros(len(self.sizes))
        ends = np.cumsum(self.sizes)
        at, held = 0, 0
        while held < len(self.numbers):  # in pieces that stay in a core's cache
            last = max(at + 1, int(np.searchsorted(ends, held + _CACHED, "right")))
            values = vector[self.numbers[held : ends[last - 1]]]
            if self.counts is not None:
                values *= self.counts[held : ends[last - 1]]
            filled = at + np.flatnonzero(self.sizes[at:last])
            if len(filled):
                total[filled] = np.add.reduceat(values, ends[filled] - self.sizes[filled] - held)
            at, held = last, int(ends[last - 1])
        return total

    def sums(self) -> np.ndarray:
        """The sum of each row's counts."""
        return np.bincount(np.repeat(np.arange(len(self.sizes)), self.sizes), self.counts, len(self.sizes))

    def back(self, vector: np.ndarray, total: np.ndarray) -> None:
        """Adds to each number's total its counts times the vector at their rows."""
        values = np.repeat(vector, self.sizes)
        if self.counts is not None:
            values *= self.counts
        total += np.bincount(self.numbers, values, len(total))


def counted(row: np.ndarray, number: np.ndarray, rows: int) -> Rows:
    """Pairs (row, number) as rows, equal pairs counted."""
    keys = np.sort(row.astype(np.int64) << 32 | number)
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    counts = np.diff(first, append=len(keys))
    keys = keys[first]
    return Rows(np.bincount(keys >> 32, minlength=rows), (keys & 0xFFFFFFFF).astype(np.int32), small(counts))


def small(counts: np.ndarray) -> np.ndarray:
    """Whole numbers in the smallest type that holds them."""
    return counts.astype(np.min_scalar_type(int(counts.max(initial=0))))


class _Places:
    """Where distinct keys stand in their list: a table of open places, looked up by many keys at once."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys, self.bits = keys, max(4, (2 * len(keys)).bit_length())
        self.table = np.full(1 << self.bits, -1, np.int32)
        left, slot = np.arange(len(keys), dtype=np.int32), self._slot(keys)
        while len(left):
            free = self.table[slot] < 0
            self.table[slot[free]] = left[free]
            other = self.table[slot] != left  # taken before, or by another of these
            left, slot = left[other], slot[other] + 1 & len(self.table) - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        # Fibonacci hashing; overflow is meant.
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 for none."""
        slot = self._slot(keys)
        found = self.table[slot]
        left = np.flatnonzero(found >= 0)
        left = left[self.keys[found[left]] != keys[left]]
        while len(left):
            slot[left] = slot[left] + 1 & len(self.table) - 1
            found[left] = self.table[slot[left]]
            left = left[found[left] >= 0]
            left = left[self.keys[found[left]] != keys[left]]
        return found


class Vocabulary:
    """Numbers of n-grams: a tree whose nodes are the n-grams and their beginnings.

    On the first level a node's key is three code points, further down the place of the node above and one code point.
    """

    def __init__(self, terms: pa.Array) -> None:
        sizes = pc.utf8_length(terms).to_numpy(zero_copy_only=False)
        if len(terms) and not (sizes.min() >= SMALLEST and sizes.max() <= LARGEST):
            raise ValueError(f"terms have {SMALLEST} to {LARGEST} characters")
        codes = _codes("".join(terms.slice(i, WORDS).to_pylist()) for i in range(0, len(terms), WORDS))
        self.size, self.levels = len(terms), []
        numbers, starts = np.arange(len(terms), dtype=np.int32), np.cumsum(sizes) - sizes
        keys = _first(codes, starts)
        for n in range(SMALLEST, LARGEST + 1):
            known, place = np.unique(keys, return_inverse=True)
            named, whole = np.full(len(known), -1, np.int32), sizes == n
            named[place[whole]] = numbers[whole]
            self.levels.append((_Places(known), named))
            numbers, starts, sizes, place = numbers[~whole], starts[~whole], sizes[~whole], place[~whole]
            if n < LARGEST:
                keys = place << _BITS | codes[starts + n]

    def of_words(self, words: list[str]) -> Rows:
        """The terms of words, as often as a word has them; words hold no spaces."""
        parts = [self._of_some(words[i : i + WORDS]) for i in range(0, max(1, len(words)), WORDS)]
        sizes, numbers = zip(*parts)
        return Rows(np.concatenate(sizes), np.concatenate(numbers))

    def _of_some(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        codes = _codes([f" {' '.join(words)} "])
        inside = codes != _SPACE
        word = np.cumsum(~inside) - 1
        starts = np.flatnonzero(inside[1:-1])  # the second character of an n-gram lies inside a word
        keys, found = _first(codes, starts), []
        for n, (places, named) in enumerate(self.levels, SMALLEST):
            place = places.find(keys)
            starts, place = starts[place >= 0], place[place >= 0]
            number = named[place]
            whole = number >= 0
            found.append((word[starts[whole] + 1], number[whole]))
            longer = inside[starts + n - 1]  # so does its last one, if another follows
            starts, place = starts[longer], place[longer].astype(np.int64)
            keys = place << _BITS | codes[starts + n]
        word, number = map(np.concatenate, zip(*found))
        keys = np.sort(word << 32 | number)
        return np.bincount(keys >> 32, minlength=len(words)).astype(np.int32), (keys & 0xFFFFFFFF).astype(np.int32)


def _codes(texts: Iterable[str]) -> np.ndarray:
    parts = [np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<i4") for text in texts]
    return np.concatenate(parts) if parts else np.empty(0, "<i4")


def _first(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    keys = np.zeros(len(starts), np.int64)
    for i in range(SMALLEST):
        keys = keys << _BITS | codes[starts + i]
    return keys


def pieces(texts: pa.Array, words: int = 1 << 20) -> Iterator[pa.Array]:
    """Texts in runs of at most so many words, or of one text."""
    ends = np.cumsum(pc.add(pc.count_substring(texts, " "), 1).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(ends, (ends[first - 1] if first else 0) + words, "right"))
        last = max(last, first + 1)
        yield texts[first:last]
        first = last


def words_of(texts: pa.Array) -> tuple[Rows, list[str]]:
    """The words of texts, which are separated by single spaces, as numbers of their list."""
    parts = pc.split_pattern(texts.cast(pa.large_string()), " ")
    listed = parts.flatten().dictionary_encode()
    row = np.repeat(np.arange(len(texts)), np.diff(parts.offsets.to_numpy()))
    return counted(row, listed.indices.to_numpy(), len(texts)), listed.dictionary.to_pylist()


def distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of a column of texts, few of them more than once."""

    def listed(words: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([words.cast(pa.string())], names=["word"])

    held = pa.array([], pa.large_string())
    for batch in batches:
        for part in pieces(batch.column(0)):
            words = pc.split_pattern(part.cast(pa.large_string()), " ").flatten()
            held = pa.concat_arrays([held, words.unique()]).unique()
            if len(held) > PIECE:
                yield listed(held)
                held = held[:0]
    yield listed(held)


def merged(texts: Rows, words: Rows) -> Iterator[tuple[slice, Rows]]:
    """The terms of texts with their counts, some texts at a time: (which texts, their terms)."""
    starts = np.cumsum(words.sizes) - words.sizes
    lengths = words.sizes[texts.numbers]
    entry = np.concatenate([[0], np.cumsum(texts.sizes)])
    ends = np.concatenate([[0], np.cumsum(lengths)])[entry]
    first = 0
    while first < len(texts.sizes):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + PIECE, "right")) - 1)
        held = slice(entry[first], entry[last])
        size = lengths[held]
        total = int(size.sum())
        # The places of the words' terms: runs that start where the word's do.
        at = np.arange(total) + np.repeat(starts[texts.numbers[held]] - (np.cumsum(size) - size), size)
        row = np.repeat(np.repeat(np.arange(last - first), texts.sizes[first:last]), size)
        times = np.repeat(texts.counts[held].astype(np.int64), size)
        if words.counts is not None:
            times *= words.counts[at]
        yield slice(first, last), _summed(row, words.numbers[at], times, last - first)
        first = last


def _summed(row: np.ndarray, number: np.ndarray, times: np.ndarray, rows: int) -> Rows:
    """Entries (row, number, times), added up by row and number, in their order."""
    low, high = (int(x.max(initial=0)).bit_length() for x in (number, times))
    keys = row.astype(np.int64) << low | number
    if rows.bit_length() + low + high < 63:  # sorting whole numbers is several times as fast as finding their order
        keys = np.sort(keys << high | times)
        keys, times = keys >> high, keys & (1 << high) - 1
    else:
        order = np.argsort(keys)
        keys, times = keys[order], times[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    total = np.add.reduceat(times, first) if len(first) else times
    keys = keys[first]
    return Rows(np.bincount(keys >> low, minlength=rows), keys & (1 << low) - 1, total)
