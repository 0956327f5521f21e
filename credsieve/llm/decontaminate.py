"""Benchmark decontamination: one Aho-Corasick automaton over the windows of the test items.

Texts and items are lower-cased (A-Z) and reduced to words of digits, letters and non-ASCII
characters. A window is ten consecutive words of an item; an item of one to nine words is one
window. The automaton runs over word numbers, reads each text once, and its matches are mapped back
to code points of the original.

Defined cases: a null or wordless text has no words and no hits; a null or wordless item has no
window; repeated items count once by ``item_id``, a null id as the text ``null``; an empty table of
either kind gives results without hits; repeated rows each get their own result; extra columns stay.
"""

from __future__ import annotations

import re
import uuid

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credsieve.llm.common import annotated

WINDOW_WORDS = 10
#: Words of items in one automaton (about 100 bytes of memory for each word and window place). More
#: items than that are dealt over several automata, and every text is run through all of them.
AUTOMATON_WORDS = 200_000

_SEPARATORS = "".join(map(chr, [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
_TABLE = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + bytes(c for c in map(ord, _SEPARATORS) if not 65 <= c <= 90),
    b"abcdefghijklmnopqrstuvwxyz" + b" " * (len(_SEPARATORS) - 26),
)
_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")

SCHEMA = (
    "n_words bigint, n_hit bigint, items array<string>, "
    "spans array<struct<start: bigint, end: bigint>>"
)


def words(text: str | None) -> list[bytes]:
    """The normalised words of a text, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def windows(tokens: list[bytes], size: int = WINDOW_WORDS) -> set[tuple[bytes, ...]]:
    if not tokens:
        return set()
    return {tuple(tokens[i : i + size]) for i in range(max(1, len(tokens) - size + 1))}


class ItemAutomaton:
    """The windows of some items, ready to be found in word lists."""

    def __init__(self, items: list[tuple[str, str]], size: int = WINDOW_WORDS) -> None:
        found: dict[tuple[bytes, ...], set[str]] = {}
        for item_id, text in items:
            for window in windows(words(text), size):
                found.setdefault(window, set()).add(item_id)
        self.numbers: dict[bytes, int] = {}
        for window in found:
            for word in window:
                self.numbers.setdefault(word, len(self.numbers) + 1)
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for window, ids in found.items():
            self.machine.add_word(
                tuple(self.numbers[w] for w in window), (len(window), tuple(sorted(ids)))
            )
        if found:
            self.machine.make_automaton()
        self.empty = not found

    def scan(self, tokens: list[bytes]) -> list[tuple[int, int, tuple[str, ...]]]:
        """(first word, word after the last, items) of every occurrence of a window."""
        if self.empty or not tokens:
            return []
        number = self.numbers.get
        return [
            (end - size + 1, end + 1, ids)
            for end, (size, ids) in self.machine.iter(tuple([number(w, 0) for w in tokens]))
        ]


_BUILT: dict[str, ItemAutomaton] = {}


def _automaton(key: str, items: list[tuple[str, str]], size: int, keep: int) -> ItemAutomaton:
    """A worker builds an automaton once; of several blocks it holds one at a time."""
    if key not in _BUILT:
        while len(_BUILT) >= keep:
            _BUILT.pop(next(iter(_BUILT)))
        _BUILT[key] = ItemAutomaton(items, size)
    return _BUILT[key]


def _item_blocks(benchmark: DataFrame, limit: int) -> list:
    """(key, broadcast items) of bounded size; the words are bounded first."""
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("id"), "text"
    ).filter("text IS NOT NULL")
    # Two words have a separator between them, so this is a bound.
    total = items.agg(F.sum((F.length("text") + 1) / 2)).first()[0] or 0
    blocks = int(total // limit) + 1
    context = benchmark.sparkSession.sparkContext
    run = uuid.uuid4().hex
    own = F.pmod(F.xxhash64("id", "text"), F.lit(blocks))
    return [
        (f"{run}-{b}", context.broadcast([(r.id, r.text) for r in items.filter(own == b).collect()]))
        for b in range(blocks)
    ]


def find_passages(
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = WINDOW_WORDS,
    automaton_words: int = AUTOMATON_WORDS,
    keep: list[str] | None = None,
) -> DataFrame:
    """``row`` (the document, or the columns of it to keep) with its number of words and of hit
    words, the items found, and the hit spans in code points."""
    blocks = _item_blocks(benchmark, automaton_words)

    def scan(columns: list[pa.Array]) -> list[pa.Array]:
        texts = columns[0].to_pylist()
        tokens = [words(t) for t in texts]
        hits: list[list] = [[] for _ in texts]
        for key, block in blocks:
            machine = _automaton(key, block.value, size, keep=1)
            for found, document in zip(hits, tokens):
                found.extend(machine.scan(document))
        n_hit, items, spans = [], [], []
        for text, document, found in zip(texts, tokens, hits):
            if not found:
                n_hit.append(0)
                items.append([])
                spans.append([])
                continue
            edges = np.zeros(len(document) + 1, dtype=np.int64)
            for start, end, _ in set(found):
                edges[start] += 1
                edges[end] -= 1
            hit = np.cumsum(edges[:-1]) > 0
            n_hit.append(int(hit.sum()))
            items.append(sorted({i for _, _, ids in found for i in ids}))
            spans.append(_spans(text, hit))
        struct = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return [
            pa.array([len(t) for t in tokens], pa.int64()),
            pa.array(n_hit, pa.int64()),
            pa.array(items, pa.list_(pa.string())),
            pa.array(spans, struct),
        ]

    return annotated(docs, scan, SCHEMA, ["text"], keep)


def _spans(text: str, hit: np.ndarray) -> list[dict[str, int]]:
    """Runs of hit words as code points of the original text."""
    places = [m.span() for m in _WORD.finditer(text)]
    change = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    return [
        {"start": places[a][0], "end": places[b - 1][1]}
        for a, b in zip(change[::2].tolist(), change[1::2].tolist())
    ]


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any benchmark window, columns unchanged."""
    return find_passages(docs, benchmark).filter("n_hit = 0").select("row.*")
