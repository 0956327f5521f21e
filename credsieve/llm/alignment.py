"""Alignment of the tokens that two tokenizers give the same text, and how often ids are linked.

The tokenizers are a byte-level BPE vocabulary (A, of the library ``tokenizers``) and a piece vocabulary
with byte fallback (B, of ``sentencepiece``). Both cover the bytes of a space and the text. Where a token
of A and one of B end at the same byte the text is cut; between two cuts lies a group, and all its A
tokens are linked with all its B tokens.

*Lockstep merging.* A worker takes many documents at once and lays their tokens one after another. One
state vector holds for every document a pointer into its A tokens and one into its B tokens. A step
looks at the ends under all pointers, moves on the pointer that lags (both where the ends meet, which
is a cut), and hands out the cuts; documents at their end leave the vector. A long document takes part
as several lanes, cut where both tokenizers start anew, so no document holds up the others.

*Encoding.* Neither tokenizer merges over a single space or line end between two other characters: the
pattern of A splits there, and no piece of B holds such a pair (checked when the model is loaded; if it
did, texts would be encoded whole). Texts are encoded in such blobs, and short blobs are remembered, up to
``REMEMBERED_BYTES``.

*Counting.* How many documents hold a pair linked is counted in blocks of documents: a block is one row with
its distinct pairs, the number of its documents holding each, and for every document which pairs it holds how
often. Spark sums the pairs over blocks (map-side first), finds the highest count of each A id, and sends
the answers back to the blocks that asked; a pair crosses the shuffle once a block, not once a document. A
block is bounded in entries and in bytes, so nothing grows with the corpus.

Defined cases: null and empty texts, and texts whose joined tokens do not give back the space and the
text (such as those holding U+2581), have no tokens: zeros, and '' for the hash. Texts of any length are
encoded whole; one that has no single space or line end is one blob, and memory then follows its length, as
it does the number of distinct pairs of one text. Repeated rows are documents of their own and count each.
An empty table gives an empty result; extra columns stay inside ``row``, so names cannot clash.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credsieve.llm.common import ddl_fields, packed, staged

VOCABULARY_A, VOCABULARY_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of blobs and their ids that a worker remembers before it starts over, and the longest such blob.
REMEMBERED_BYTES, REMEMBERED_CHARS = 160 << 20, 64
#: Characters that are merged at once, and blobs of one lane.
BATCH_CHARS, LANE_BLOBS = 1 << 20, 256
#: A block ends with the document that brings it to so many entries (document, pair) or characters.
BLOCK_ENTRIES, BLOCK_CHARS = 1 << 20, 24 << 20
#: Groups with more links are counted by their distinct ids instead of link by link.
LARGE_GROUP = 1 << 12

_SPACE = "▁"  # how B writes a space
# A blob starts with a single space or line end between other characters; longer runs of white space stay inside.
_BLOBS = re.compile(r"(?:[ \n]?\S+|\s+\S*)(?:(?:\s\s+|[^\S \n])\S*)*")

_COUNTS = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint"


def _byte_letters() -> dict[str, int]:
    """The byte each letter of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}


class Tokenizers:
    """Both tokenizers of a worker, the bytes of their tokens, and the blobs they have seen."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = _byte_letters()
        entries = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, number in entries.items():
            known = all(c in letters for c in entry)
            self.a_bytes[number] = bytes(map(letters.get, entry)) if known else entry.encode()
        self.b_bytes = []
        for number in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(number)
            byte = self.b.is_byte(number)
            self.b_bytes.append(bytes([int(piece[1:-1], 16)]) if byte else piece.replace(_SPACE, " ").encode())
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size()) if not self.b.is_byte(i)]
        self.start = self.b.encode("\n")
        #: Whether B never merges over the start of a blob.
        self.in_blobs = (
            not any("\n" in p or re.search(f"[^{_SPACE}]{_SPACE}", p) for p in pieces)
            and [self.b_bytes[i] for i in self.start] == [b" ", b"\n"]
        )
        self.a_sizes = np.array([len(b) for b in self.a_bytes], np.int64)
        self.b_sizes = np.array([len(b) for b in self.b_bytes], np.int64)
        # What a token is followed by in the written groups: a comma inside its side, else | or ;
        self.written = np.array(
            [b"%d%c" % (i, c) for n, ends in ((len(self.a_bytes), b",|"), (len(self.b_bytes), b",;"))
             for c in ends for i in range(n)], dtype=object,
        )
        self.forget()

    def forget(self) -> None:
        #: The number of each blob seen; by number, whether its ids give it back, and where they lie.
        self.known: dict[str, int] = {}
        self.sound = np.zeros(0, bool)
        self.a_ids, self.b_ids = _Lists(), _Lists()
        self.held = 0

    def blobs(self, text: str) -> list[str]:
        text = f" {text}"
        return _BLOBS.findall(text) if self.in_blobs else [text]

    def encode(self, blobs: list[str]) -> tuple[np.ndarray, ...]:
        """(ids of A one after another, how many of each blob, the same for B, whether each is given back)."""
        raw = [blob.encode("utf-8", "surrogatepass") for blob in blobs]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        a = [e.ids for e in self.a.encode_batch_fast(blobs, add_special_tokens=False)]
        if self.in_blobs:
            # The line end keeps the blob's own start apart from the space that B puts in front.
            skip, b = len(self.start), self.b.encode(["\n" + x for x in blobs], num_threads=1)
        else:
            skip, b = 0, self.b.encode([x[1:] for x in blobs], num_threads=1)
        out, sound = [], np.ones(len(raw), bool)
        for ids, left, table, lengths in ((a, 0, self.a_bytes, self.a_sizes), (b, skip, self.b_bytes, self.b_sizes)):
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(n.sum()))
            if left:
                own = np.ones(len(flat), bool)
                own[((np.cumsum(n) - n)[:, None] + np.arange(left)).ravel()] = False
                flat, n = flat[own], n - left
            ends = np.cumsum(n)
            covered = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths[flat])])
            sound &= covered[ends] - covered[ends - n] == sizes
            # Where the lengths agree the bytes are compared all at once, and one by one only if they differ.
            if not sound.all() or b"".join([table[i] for i in flat.tolist()]) != b"".join(raw):
                for i in np.flatnonzero(sound).tolist():
                    sound[i] = b"".join([table[t] for t in ids[i][left:]]) == raw[i]
            out += [flat, n]
        return *out, sound

    def numbers(self, blobs: list[str]) -> np.ndarray:
        """The number of each blob; new ones are encoded, each once."""
        if self.held > REMEMBERED_BYTES:
            self.forget()
        found = np.fromiter(map(self.known.get, blobs, itertools.repeat(-1)), np.int64, len(blobs))
        missing = np.flatnonzero(found < 0).tolist()
        if missing:
            first, known = len(self.sound), {}
            for i in missing:
                found[i] = known.setdefault(blobs[i], first + len(known))
            order, at = list(known), 0
            while at < len(order):
                end, chars = at, 0
                while end < len(order) and chars < 1 << 18:  # what the libraries give back is large
                    chars += len(order[end])
                    end += 1
                a, n_a, b, n_b, sound = self.encode(order[at:end])
                self.a_ids.add(a, n_a)
                self.b_ids.add(b, n_b)
                self.sound = np.concatenate([self.sound, sound])
                self.held += 200 * (end - at) + 2 * chars + 4 * (len(a) + len(b))
                at = end
            self.known.update((b, n) for b, n in known.items() if len(b) <= REMEMBERED_CHARS)
        return found


class _Lists:
    """Lists of numbers, laid one after another in an array that doubles when it is full."""

    def __init__(self) -> None:
        self.values, self.used = np.empty(1 << 16, np.int32), 0
        self.starts = self.sizes = np.empty(0, np.int64)

    def add(self, values: np.ndarray, sizes: np.ndarray) -> None:
        if self.used + len(values) > len(self.values):
            self.values = np.resize(self.values, 2 * (self.used + len(values)))
        self.values[self.used : self.used + len(values)] = values
        self.starts = np.concatenate([self.starts, self.used + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.used += len(values)

    def get(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of these numbers, and how long each is."""
        sizes = self.sizes[numbers]
        return self.values[_spans(self.starts[numbers], sizes)].astype(np.int64), sizes


_LOADED: dict[tuple[str, str], Tokenizers] = {}


def loaded(a_path: str, b_path: str) -> Tokenizers:
    key = a_path, b_path
    if key not in _LOADED:
        _LOADED[key] = Tokenizers(a_path, b_path)
    return _LOADED[key]


def merge_lockstep(
    a_ends: np.ndarray, b_ends: np.ndarray, a_lanes: np.ndarray, b_lanes: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Token numbers (of A and of B) after which both end at one byte, over all lanes.

    ``a_ends`` and ``b_ends`` are the byte ends of all tokens, laid one after another; lane i holds the
    tokens from ``lanes[i]`` up to ``lanes[i + 1]``, none of them empty, and both sides cover the same bytes.
    """
    some = np.flatnonzero(a_lanes[1:] > a_lanes[:-1])
    a, b, stop = a_lanes[some], b_lanes[some], a_lanes[some + 1]
    a_cuts, b_cuts = [], []
    while len(a):
        ends_a, ends_b = a_ends[a], b_ends[b]
        step_a, step_b = ends_a <= ends_b, ends_b <= ends_a
        a += step_a
        b += step_b
        met = step_a & step_b
        cut = a[met]
        if len(cut):
            a_cuts.append(cut)
            b_cuts.append(b[met])
            going = a < stop
            if not going.all():
                a, b, stop = a[going], b[going], stop[going]
    if not a_cuts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    # Cuts of a lane come in order and lanes lie in order on both sides: sorting keeps them together.
    return np.sort(np.concatenate(a_cuts)), np.sort(np.concatenate(b_cuts))


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start..start+size-1 of each span, one after another."""
    offsets = np.cumsum(sizes) - sizes
    return np.repeat(starts - offsets, sizes) + np.arange(int(sizes.sum()))


def _starts(ends: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), ends[:-1]]) if len(ends) else ends


class Aligned:
    """The alignment of a batch of texts: per text its counts, hash, group ends and distinct links."""

    def __init__(self, tools: Tokenizers, texts: list[str]) -> None:
        blobs = [tools.blobs(t) if t and _SPACE not in t else [] for t in texts]
        numbers = tools.numbers(list(itertools.chain.from_iterable(blobs)))
        sizes = np.fromiter(map(len, blobs), np.int64, len(blobs))
        text = np.repeat(np.arange(len(blobs)), sizes)
        sound = np.ones(len(blobs), bool)
        sound[text[~tools.sound[numbers]]] = False
        numbers, sizes = numbers[sound[text]], sizes * sound
        self.a, n_a = tools.a_ids.get(numbers)
        self.b, n_b = tools.b_ids.get(numbers)
        # A lane ends with its text, or after so many blobs of it.
        lanes = -(-sizes // LANE_BLOBS)
        of_text = np.concatenate([np.zeros(1, np.int64), np.cumsum(lanes)])
        ends = np.repeat(np.cumsum(sizes) - sizes, lanes) + LANE_BLOBS * (_spans(np.zeros_like(lanes), lanes) + 1)
        ends = np.concatenate([np.zeros(1, np.int64), np.minimum(ends, np.repeat(np.cumsum(sizes), lanes))])
        a_lanes, b_lanes = (np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])[ends] for n in (n_a, n_b))
        cuts = merge_lockstep(np.cumsum(tools.a_sizes[self.a]), np.cumsum(tools.b_sizes[self.b]), a_lanes, b_lanes)
        self.a_cuts, self.b_cuts = cuts
        #: First token of each text, on both sides, and first group.
        self.a_at, self.b_at = a_lanes[of_text], b_lanes[of_text]
        self.group_at = np.searchsorted(self.a_cuts, self.a_at, side="right")
        self.n_a, self.n_b = np.diff(self.a_at), np.diff(self.b_at)
        self.n_groups = np.diff(self.group_at)
        self.a_sizes, self.b_sizes = self.a_cuts - _starts(self.a_cuts), self.b_cuts - _starts(self.b_cuts)
        links = np.concatenate([np.zeros(1, np.int64), np.cumsum(self.a_sizes * self.b_sizes)])
        self.n_links = np.diff(links[self.group_at])

    def hashes(self, tools: Tokenizers) -> list[str]:
        """The digest of each text's groups as written; '' without tokens."""
        n_a, n_b = len(tools.a_bytes), len(tools.b_bytes)
        order = np.empty(len(self.a) + len(self.b), np.int64)
        # Before an A token stand the A tokens before it and the B tokens of earlier groups; and so on.
        a_last, b_last = np.zeros(len(self.a), bool), np.zeros(len(self.b), bool)
        a_last[self.a_cuts - 1] = b_last[self.b_cuts - 1] = True
        at = np.arange(len(self.a)) + np.repeat(_starts(self.b_cuts), self.a_sizes)
        order[at] = self.a + n_a * a_last
        at = np.arange(len(self.b)) + np.repeat(self.a_cuts, self.b_sizes)
        order[at] = 2 * n_a + self.b + n_b * b_last
        written, ends = tools.written.take(order), self.a_at + self.b_at
        out = []
        for start, end in zip(ends[:-1].tolist(), ends[1:].tolist()):
            text = b"".join(written[start:end].tolist())
            out.append(hashlib.sha256(text[:-1]).hexdigest() if text else "")
        return out

    def links(self, n_texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of distinct pairs of each text, pairs as ``a << 32 | b`` by text, links of each)."""
        size = self.a_sizes * self.b_sizes
        text = np.repeat(np.arange(n_texts), self.n_groups)
        a_start, b_start = _starts(self.a_cuts), _starts(self.b_cuts)
        small = np.flatnonzero(size <= LARGE_GROUP)
        # Each A token as often as its group has B tokens, beside the group's B tokens in turn.
        a_tokens = _spans(a_start[small], self.a_sizes[small])
        group = np.repeat(small, self.a_sizes[small])
        a_side = np.repeat(a_tokens, self.b_sizes[group])
        b_side = _spans(b_start[group], self.b_sizes[group])
        texts = np.repeat(text[group], self.b_sizes[group])
        wide = int(self.b.max(initial=0)) + 1
        span = (int(self.a.max(initial=0)) + 1) * wide
        key = np.sort(texts * span + self.a[a_side] * wide + self.b[b_side])
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
        times = np.diff(np.append(first, len(key)))
        key = key[first]
        large = np.flatnonzero(size > LARGE_GROUP)
        if len(large):
            keys, counts = [key], [times]
            for g in large:
                a, a_n = np.unique(self.a[a_start[g] : self.a_cuts[g]], return_counts=True)
                b, b_n = np.unique(self.b[b_start[g] : self.b_cuts[g]], return_counts=True)
                keys.append((text[g] * span + a[:, None] * wide + b).ravel())
                counts.append((a_n[:, None] * b_n).ravel())
            key, where = np.unique(np.concatenate(keys), return_inverse=True)
            times = np.bincount(where, np.concatenate(counts), len(key)).astype(np.int64)
        of, pair = np.divmod(key, span)
        a, b = np.divmod(pair, wide)
        return np.bincount(of, minlength=n_texts), a << 32 | b, times


# --- blocks ----------------------------------------------------------------------------------


def _squeezed(values: np.ndarray) -> bytes:
    """Numbers below 2**32 as compressed planes of bytes."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _restored(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel().astype(np.int64)


class _Block:
    """Documents of a task, until they are enough for one row."""

    def __init__(self, tools: Tokenizers, row_type: pa.DataType, cuts: bool, limit: int) -> None:
        self.tools, self.row_type, self.cuts, self.limit = tools, row_type, cuts, limit
        self.number = 0
        self.clear()

    def clear(self) -> None:
        self.rows, self.values, self.counts, self.pairs, self.times = [], [], [], [], []
        self.entries = self.chars = 0

    def add(self, rows: pa.StructArray, texts: list[str]) -> Iterator[pa.RecordBatch]:
        done = Aligned(self.tools, texts)
        columns = [pa.array(v, pa.int64()) for v in (done.n_a, done.n_b, done.n_groups, done.n_links)]
        columns.append(pa.array(done.hashes(self.tools), pa.string()))
        if self.cuts:
            spans = pa.array(done.group_at, pa.int32())
            for ends, at in ((done.a_cuts, done.a_at), (done.b_cuts, done.b_at)):
                own = ends - np.repeat(at[:-1], done.n_groups)
                columns.append(pa.ListArray.from_arrays(spans, pa.array(own, pa.int64())))
        counts, pairs, times = done.links(len(texts))
        for kept, new in zip((self.rows, self.values, self.counts, self.pairs, self.times),
                             (rows, columns, counts, pairs, times)):
            kept.append(new)
        self.entries += len(pairs)
        self.chars += sum(map(len, texts))
        if self.entries >= self.limit or self.chars >= BLOCK_CHARS:
            yield self.take()

    def take(self) -> pa.RecordBatch:
        counts, pairs = np.concatenate(self.counts), np.concatenate(self.pairs)
        times = np.concatenate(self.times)
        distinct, where, docs = np.unique(pairs, return_inverse=True, return_counts=True)
        # Frequent pairs get small numbers, and the numbers of a document ascend: both compress well.
        order = np.argsort(-docs, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        key = np.repeat(np.arange(len(counts)), counts) * max(1, len(distinct)) + rank[where]
        by = np.argsort(key)
        place = rank[where][by]
        steps = np.diff(place, prepend=0)
        starts = (np.cumsum(counts) - counts)[counts > 0]
        steps[starts] = place[starts]
        columns = [pa.concat_arrays([v[i] for v in self.values]) for i in range(len(self.values[0]))]
        fields = [pa.field("row", self.row_type), *[pa.field(n, c.type) for n, c in zip(_names(self.cuts), columns)]]
        documents = pa.StructArray.from_arrays([pa.concat_arrays(self.rows), *columns], fields=fields)

        def one(values: pa.Array) -> pa.ListArray:
            return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

        partition = TaskContext.get().partitionId()
        batch = pa.RecordBatch.from_arrays(
            [
                pa.array([partition << 32 | self.number], pa.int64()),
                one(documents),
                one(pa.array(distinct[order], pa.int64())),
                one(pa.array(docs[order], pa.int64())),
                pa.array([_squeezed(counts)], pa.binary()),
                pa.array([_squeezed(steps)], pa.binary()),
                pa.array([_squeezed(times[by])], pa.binary()),
            ],
            names=["block", "docs", "pairs", "pair_docs", "sizes", "steps", "times"],
        )
        self.number += 1
        self.clear()
        return batch


def _names(cuts: bool) -> list[str]:
    return ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", *(["a_ends", "b_ends"] if cuts else [])]


def _finish(left: pa.Table, right: pa.Table) -> pa.Table:
    """The documents of one block with what the corpus says of their pairs."""
    place = right.column("pos").to_numpy()
    seen, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    seen[place], best[place] = right.column("seen").to_numpy(), right.column("best").to_numpy()
    documents = pa.concat_arrays(left.column("docs").chunks).flatten()
    n = len(documents)
    counts = _restored(left.column("sizes")[0].as_py(), n)
    total = int(counts.sum())
    steps = _restored(left.column("steps")[0].as_py(), total)
    times = _restored(left.column("times")[0].as_py(), total)
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])
    # Running sums that start anew with each document.
    place = np.concatenate([np.zeros(1, np.int64), np.cumsum(steps)])
    place = place[1:] - np.repeat(place[ends[:-1]], counts)

    def summed(values: np.ndarray) -> pa.Array:
        sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(values * times)])
        return pa.array(np.diff(sums[ends]), pa.int64())

    parts = documents.flatten()
    names = [documents.type.field(i).name for i in range(documents.type.num_fields)]
    return pa.table([*parts, summed(best[place]), summed(seen[place])], names=[*names, "n_best", "count_sum"])


def align(
    docs: DataFrame,
    a_path: str,
    b_path: str,
    keep: list[str] | None = None,
    cuts: bool = False,
    block_entries: int = BLOCK_ENTRIES,
) -> DataFrame:
    """``row`` (all columns of the documents, or those to keep) with ``n_a`` and ``n_b`` tokens,
    ``n_groups``, ``n_links``, ``groups_sha256``, ``n_best`` (links whose pair is in as many documents as
    any of its A id) and ``count_sum`` (documents holding the pair, over links). With ``cuts`` also ``a_ends`` and
    ``b_ends``: the number of tokens of either side up to the end of each group.
    """
    kept = docs.select(*[f"`{c}`" for c in (docs.columns if keep is None else keep)])
    # The text travels beside the row once more only inside the stage that reads it.
    source = docs.select(packed(kept).alias("row"), F.col("text"))
    row_type = kept.schema.simpleString()
    more = ", a_ends array<bigint>, b_ends array<bigint>" if cuts else ""
    fields = f"row {row_type}, {_COUNTS}, groups_sha256 string{more}"
    struct = ", ".join(": ".join(field.strip().split(" ", 1)) for field in ddl_fields(fields))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools, block = loaded(a_path, b_path), None
        for batch in batches:
            rows, column = batch.column(0), batch.column(1)
            block = block or _Block(tools, rows.type, cuts, block_entries)
            texts, chars, first = [], 0, 0
            for i, value in enumerate(column):
                text = value.as_py() or ""
                texts.append(text)
                chars += len(text)
                if chars >= BATCH_CHARS or i + 1 == len(column):
                    yield from block.add(rows.slice(first, i + 1 - first), texts)
                    texts, chars, first = [], 0, i + 1
        if block is not None and block.rows:
            yield block.take()

    made = staged(
        source.mapInArrow(
            blocks,
            f"block bigint, docs array<struct<{struct}>>, pairs array<bigint>, pair_docs array<bigint>, "
            "sizes binary, steps binary, times binary",
        )
    )
    asked = made.select("block", F.posexplode(F.arrays_zip("pairs", "pair_docs"))).select(
        "block", "pos", F.col("col.pairs").alias("pair"), F.col("col.pair_docs").alias("n")
    )
    seen = asked.groupBy("pair").agg(F.sum("n").alias("seen")).withColumn("a", F.shiftright("pair", 32))
    seen = staged(seen)  # as many rows as the vocabularies have pairs in use
    highest = seen.groupBy("a").agg(F.max("seen").alias("highest"))
    rated = seen.join(highest, "a").select("pair", "seen", (F.col("seen") == F.col("highest")).cast("long").alias("best"))
    answers = (
        asked.select(F.col("block").alias("asked_by"), "pos", "pair")
        .join(rated, "pair")
        .select("asked_by", "pos", "seen", "best")
    )
    return (
        made.select("block", "docs", "sizes", "steps", "times")
        .groupBy("block")
        .cogroup(answers.groupBy("asked_by"))
        .applyInArrow(_finish, f"{fields}, n_best bigint, count_sum bigint")
    )

