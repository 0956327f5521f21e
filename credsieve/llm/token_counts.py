"""Exact token counts of every prefix of a text, for byte-level BPE vocabularies.

The vocabulary splits a text into pieces by a pattern and merges bytes inside each piece. Within a
piece a dynamic programme over its prefixes gives the last token and the number of tokens of each:
a prefix ends in the one token that can follow the last token of the shorter prefix, that is, whose
pair with it encodes to just those two. Pieces are remembered, so a word is worked out once per
worker. The counts of a text's prefixes are the running sums over its pieces, mended at the few
places where a cut changes how the pattern splits. They answer how many tokens a prefix has and how
long a prefix fits a budget without encoding anything again.

Defined cases: null and empty texts have no bytes and no tokens; texts of any length are counted
whole; strings of special tokens inside texts count as that one token, the library's default;
repeated rows each get their count; an empty table gives an empty result; extra columns stay.
"""

from __future__ import annotations

import itertools
import json
import re
import struct
import sys

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from credsieve.llm.common import annotated

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
#: A worker starts over when the blobs it remembers hold so many bytes, or its pairs of tokens are so many.
#: Longer blobs (encoded data without spaces) are counted each time.
REMEMBERED_BYTES, REMEMBERED_PAIRS = 160 << 20, 600_000
REMEMBERED_CHARS = 64

# The byte-level pattern of the vocabulary: a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Its pieces of which a shorter cut is split differently.
_CUT_SHORT = ("'re", "'ve", "'ll")
_SPACE = r"\p{White_Space}"
_PIECES = regex.compile(PATTERN.replace(r"[^\s", f"[^{_SPACE}").replace(r"\s", _SPACE).replace(r"\S", r"\P{White_Space}"))
#: Words with their marks and the space before, or runs of space: no piece reaches over their edges.
_BLOBS = regex.compile(rf" ?\P{{White_Space}}+|{_SPACE}+(?!\P{{White_Space}})|{_SPACE}+")
_QUICK_BLOBS = re.compile(r" ?\S+|\s+(?!\S)|\s+")
_SPACES = regex.compile(f"{_SPACE}{{2}}")
_ONLY_SPACE = regex.compile(f"{_SPACE}+")
#: Space to Python, but not to the pattern.
_ODD_SPACE = "\x1c\x1d\x1e\x1f"


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: printable ones for themselves, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class PrefixCounts(dict):
    """Maps a blob to the change of the token count at each of its characters, as signed bytes."""

    def __init__(self, path: str) -> None:
        super().__init__()
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        self.letters = _byte_letters()
        vocabulary = model["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        self.specials = [t["content"] for t in model["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None
        # Of each token when it is made (bytes are there from the start) and of what.
        self.made = [-1] * (max(vocabulary.values()) + 1)
        self.left, self.right = list(self.made), list(self.made)
        self.merges: dict[int, int] = {}
        for rank, (a, b) in enumerate(merges):
            token, first, second = vocabulary[a + b], vocabulary[a], vocabulary[b]
            self.merges[first << 20 | second] = rank
            if self.made[token] < 0:
                self.made[token], self.left[token], self.right[token] = rank, first, second
        #: A trie of the tokens by letters; "" holds the token that ends there.
        self.trie: dict = {}
        for text, number in vocabulary.items():
            if self.made[number] < 0 and len(text) > 1:
                continue  # nothing merges to it
            if self.made[number] >= 0 and not self.follows(self.left[number], self.right[number], self.made[number]):
                continue
            node = self.trie
            for letter in text:
                node = node.setdefault(letter, {})
            node[""] = number
        self.pairs: dict[int, bool] = {}
        self.held = 0

    def follows(self, first: int, second: int, limit: int = 1 << 60) -> bool:
        """Whether two tokens side by side stay so: no merge over their edge comes before the
        merges that make them (and before ``limit``).

        Goes back in time: of the two the one made last is taken apart on the side of the edge. Merges
        of one rank run from left to right, so at equal rank the edge's own merge precedes the second's.
        """
        made, merges = self.made, self.merges
        while True:
            rank = merges.get(first << 20 | second)
            if rank is not None and rank < limit:
                return False
            if made[first] > made[second]:
                limit, first = made[first], self.right[first]
            elif made[second] < 0:
                return True
            else:
                limit, second = made[second] + 1, self.left[second]

    def prefix_counts(self, letters: str) -> list[int]:
        """The number of tokens of each prefix of one piece, from the empty one on."""
        trie, pairs, n = self.trie, self.pairs, len(letters)
        last, counts = [-1] * (n + 1), [0] * (n + 1)
        for i in range(n):
            before, count, node = last[i], counts[i] + 1, trie
            for k in range(i, n):
                node = node.get(letters[k])
                if node is None:
                    break
                if "" in node and last[k + 1] < 0:
                    token = node[""]
                    if i:
                        key = before << 20 | token
                        ok = pairs.get(key)
                        if ok is None:
                            ok = pairs[key] = self.follows(before, token)
                        if not ok:
                            continue
                    last[k + 1], counts[k + 1] = token, count
        return counts

    def __missing__(self, blob: str) -> bytes:
        """The changes at each character of a word with its marks, or of a run of space."""
        if _ONLY_SPACE.fullmatch(blob):
            found = self._piece(blob)
        else:
            found = b"".join([self._piece(p) for p in _PIECES.findall(blob)])
        if len(self.pairs) > REMEMBERED_PAIRS:
            self.pairs.clear()
        if len(blob) <= REMEMBERED_CHARS:
            if self.held > REMEMBERED_BYTES:
                self.clear()
                self.held = 0
            self[blob] = found
            self.held += sys.getsizeof(blob) + sys.getsizeof(found) + 100  # and its place among the others
        return found

    def _piece(self, piece: str) -> bytes:
        letters = self.letters
        if piece.isascii():
            counts = self.prefix_counts(piece.translate(letters))
        else:
            raw = piece.encode("utf-8", "surrogatepass")
            at = self.prefix_counts("".join([letters[b] for b in raw]))
            ends = itertools.accumulate(len(c.encode("utf-8", "surrogatepass")) for c in piece)
            counts = [0, *[at[e] for e in ends]]
        if piece in _CUT_SHORT:
            counts[2] = self.total(piece[0]) + self.total(piece[1])
        return struct.pack(f"{len(piece)}b", *[b - a for a, b in itertools.pairwise(counts)])

    def total(self, piece: str) -> int:
        return int(np.frombuffer(self[piece], np.int8).sum())

    def _plain(self, text: str) -> np.ndarray:
        """The counts at every prefix of a text without special tokens, from the empty one on."""
        odd = any(c in text for c in _ODD_SPACE)
        blobs = (_BLOBS if odd else _QUICK_BLOBS).findall(text)
        counts = np.zeros(len(text) + 1, dtype=np.int32)
        changes = np.frombuffer(b"".join(map(self.__getitem__, blobs)), np.int8)
        np.cumsum(changes, out=counts[1:])
        if _SPACES.search(text):
            # A cut right after a run of space leaves the run whole; in the text its last character
            # goes to the next piece.
            at = 0
            for blob, after in itertools.pairwise(blobs):
                end = at + len(blob)
                if _ONLY_SPACE.fullmatch(blob) and _ONLY_SPACE.match(after):
                    counts[end + 1] = counts[end] - self.total(blob) + self.total(blob + after[0])
                at = end
        return counts

    def of_text(self, text: str) -> np.ndarray:
        """The exact number of tokens of every prefix of a text, by code points, from the empty one."""
        if self.special is None or not any(s in text for s in self.specials):
            return self._plain(text)
        done, base, start = [np.zeros(1, np.int64)], 0, 0
        for match in self.special.finditer(text):
            before, inside = text[start : match.start()], match.group()
            counts = self._plain(before)
            done.append(base + counts[1:])
            # A cut inside the string sees its letters as text, which go on from the last blob.
            blobs = _BLOBS.findall(before)[-2:]
            tail, kept = "".join(blobs), base + int(counts[-1]) - sum(map(self.total, blobs))
            partial = [kept + int(self._plain(tail + inside[:k])[-1]) for k in range(1, len(inside))]
            base += int(counts[-1]) + 1
            done.append(np.array([*partial, base], np.int64))
            start = match.end()
        done.append(base + self._plain(text[start:])[1:])
        return np.concatenate(done)


_LOADED: dict[str, PrefixCounts] = {}


def loaded(path: str) -> PrefixCounts:
    """A worker reads a vocabulary once."""
    if path not in _LOADED:
        _LOADED[path] = PrefixCounts(path)
    return _LOADED[path]


def fitting(counts: np.ndarray, budget: int) -> int:
    """The code points of the longest prefix of at most that many tokens."""
    return int(np.flatnonzero(counts <= budget)[-1])


def count_tokens(
    docs: DataFrame, path: str, limit: int = LIMIT, prefixes: bool = False, keep: list[str] | None = None
) -> DataFrame:
    """``row`` with ``n_bytes``, ``n_tokens`` and ``fit_chars``, the code points of the longest prefix
    within the limit. ``prefixes`` adds ``prefix_tokens``: the count at every code point, as little-endian
    32-bit numbers from the empty prefix on.
    """
    schema = "n_bytes bigint, n_tokens bigint, fit_chars bigint" + ", prefix_tokens binary" * prefixes

    def run(columns: list[pa.Array]) -> list[pa.Array]:
        sizes, totals, fits, stored = [], [], [], []
        for text in columns[0]:
            text = text.as_py() or ""
            counts = loaded(path).of_text(text)
            sizes.append(len(text.encode("utf-8", "surrogatepass")))
            totals.append(int(counts[-1]))
            fits.append(len(text) if counts[-1] <= limit else fitting(counts, limit))
            if prefixes:
                stored.append(counts.astype("<i4").tobytes())
        out = [pa.array(v, pa.int64()) for v in (sizes, totals, fits)]
        return [*out, pa.array(stored, pa.binary())] if prefixes else out

    return annotated(docs, run, schema, ["text"], keep)
