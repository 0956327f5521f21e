"""Language-model scoring with a weighted backoff automaton.

The model is an interpolated n-gram model with discounts by count (one, two, more), estimated from
how many n-grams occur once, twice and so on; below the bigrams lies the add-one unigram model over
the known words and one unknown. As an automaton its states are the seen contexts, its arcs the seen
n-grams with their log probabilities, and each state has a failure arc to the next shorter context
with the log of its left-over mass. A text is read once from left to right: where no arc fits, the
failure arc's weight is added and the shorter context tried.

The model of a large corpus fits no single machine, so it is never gathered. Texts are laid out in
blocks of bounded size. Each block asks for the counts of its own distinct n-grams; requests meet
in buckets by hash, each n-gram once per block whatever its frequency, so no bucket is hot. The bucket
adds the counts of all blocks and answers with them in the order of the request. A second exchange of
the same kind adds up the discounts of each context, every n-gram counted in the one block that owns it. A
block then has all it needs for the part of the automaton that its texts can reach.

Words are compared by 64-bit hashes.

Defined cases: a null text is empty and has one token, its end; a null id counts as empty text for
the choice of training texts; texts of any length are scored whole; repeated rows each get their score;
without training texts the score is that of the unknown word; an empty table gives an empty
result; extra columns are not read.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credsieve.llm.common import SPACED, fold_hashes, staged, text_chunks, word_hashes, word_spans

ORDER = 2
#: Bytes of text in a block (one longer text is a block of its own).
BLOCK_BYTES = 4 << 20
#: Distinct n-grams of a block that one bucket is to receive from all blocks, about.
BUCKET_KEYS = 2 << 20
#: One unit of discount in the exchange of whole numbers.
UNIT = 1 << 20

END, START = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9FB21C651E98DF25)
_ZSTD = pa.Codec("zstd", compression_level=1)


def pack(values: np.ndarray, delta: bool = False) -> bytes:
    """Numbers as byte planes, which compress well where the high bytes repeat."""
    if delta and len(values):
        values = np.diff(values, prepend=values.dtype.type(0))
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    raw = planes.tobytes()
    return len(raw).to_bytes(8, "little") + (_ZSTD.compress(raw, asbytes=True) if raw else b"")


def unpack(data: bytes, dtype, delta: bool = False) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    dtype = np.dtype(dtype)
    if not size:
        return np.empty(0, dtype)
    raw = np.frombuffer(_ZSTD.decompress(data[8:], decompressed_size=size, asbytes=True), np.uint8)
    values = np.ascontiguousarray(raw.reshape(dtype.itemsize, -1).T).reshape(-1).view(dtype)
    return np.cumsum(values, dtype=dtype) if delta else values


# --- blocks ----------------------------------------------------------------------------------


class Block:
    """The texts of a block: distinct word hashes, and every text as START, words, END by number."""

    def __init__(self, vocabulary: np.ndarray, ids: np.ndarray, sizes: np.ndarray, train: np.ndarray) -> None:
        self.vocabulary, self.ids, self.sizes, self.train = vocabulary, ids, sizes, train
        self.begins = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)

    @classmethod
    def of_texts(cls, hashes: list[np.ndarray], sizes: np.ndarray, train: np.ndarray) -> Block:
        words = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        padded = np.empty(len(words) + 2 * len(sizes), np.uint64)
        ends = np.cumsum(sizes + 2)
        begins = ends - sizes - 2
        inner = np.ones(len(padded), bool)
        inner[begins] = inner[ends - 1] = False
        padded[inner], padded[begins], padded[ends - 1] = words, START, END
        vocabulary, ids, counts = np.unique(padded, return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")  # small numbers for frequent words
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        return cls(vocabulary[order], rank[ids], sizes + 2, train)

    def pack(self) -> bytes:
        parts = [pack(self.vocabulary), pack(self.ids), pack(self.sizes.astype(np.int64)), pack(self.train.astype(np.uint8))]
        return b"".join(len(p).to_bytes(8, "little") + p for p in parts)

    @classmethod
    def unpack(cls, data: bytes) -> Block:
        parts, at = [], 0
        for dtype in (np.uint64, np.int32, np.int64, np.uint8):
            size = int.from_bytes(data[at : at + 8], "little")
            parts.append(unpack(data[at + 8 : at + 8 + size], dtype))
            at += 8 + size
        return cls(parts[0], parts[1], parts[2], parts[3].astype(bool))

    def grams(self, order: int) -> Grams:
        return Grams(self, order)


class Grams:
    """The distinct n-grams of a block, by the positions they end at (START itself is none)."""

    def __init__(self, block: Block, order: int) -> None:
        n = len(block.ids)
        place = np.arange(n) - np.repeat(block.begins, block.sizes)
        self.ends = np.flatnonzero(place >= max(1, order - 1))
        hashes = block.vocabulary[block.ids]
        keys = hashes[self.ends] if order == 1 else fold_hashes([hashes[self.ends - back] for back in range(order - 1, -1, -1)])
        self.keys, self.first, self.inverse = np.unique(keys, return_index=True, return_inverse=True)
        trained = np.repeat(block.train, block.sizes)[self.ends]
        self.counts = np.bincount(self.inverse[trained], minlength=len(self.keys)).astype(np.int64)


def _blocks(docs: DataFrame) -> DataFrame:
    """(block, doc_ids, payload, n_tokens) with about BLOCK_BYTES of whole texts in each."""

    def build(batches):
        ids, hashes, sizes, size, number = [], [], [], 0, 0
        task = TaskContext.get().partitionId() << 32

        def done():
            names = ["" if i is None else str(i) for i in ids]
            train = np.array([zlib.crc32(n.encode()) % 7 != 2 for n in names], dtype=bool)
            block = Block.of_texts(hashes, np.concatenate(sizes), train)
            return pa.RecordBatch.from_pylist(
                [{"block": task + number, "doc_ids": ids, "payload": block.pack(), "n_tokens": len(block.ids)}],
                schema=pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("payload", pa.binary()), ("n_tokens", pa.int64())]),
            )

        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for first, raw, offsets in text_chunks(batch.column("text")):
                starts, ends, at = word_spans(raw, offsets, SPACED)
                ids.extend(names[first : first + len(offsets) - 1])
                hashes.append(word_hashes(raw, starts, ends))
                sizes.append(np.diff(at))
                size += len(raw)
                if size >= BLOCK_BYTES:
                    yield done()
                    ids, hashes, sizes, size, number = [], [], [], 0, number + 1
        if ids:
            yield done()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(build, "block bigint, doc_ids array<bigint>, payload binary, n_tokens bigint")


# --- exchange --------------------------------------------------------------------------------

_REQUEST = "channel int, bucket bigint, block bigint, keys binary, amounts binary"
_REPLY = "channel int, bucket bigint, block bigint, totals binary, owned binary, stats array<bigint>"


def _requests(channel: int, block: int, keys: np.ndarray, amounts: np.ndarray, bits: int) -> list[dict]:
    """A block's sorted keys, cut where their top bits change."""
    if not len(keys):
        return []
    tops = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    cuts = np.flatnonzero(np.diff(tops)) + 1
    edges = [0, *cuts.tolist(), len(keys)]
    return [
        {"channel": channel, "bucket": int(tops[a]), "block": block, "keys": pack(keys[a:b], delta=True), "amounts": pack(amounts[a:b])}
        for a, b in zip(edges, edges[1:])
    ]


_REQUEST_ARROW = pa.schema(
    [("channel", pa.int32()), ("bucket", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("amounts", pa.binary())]
)
_REPLY_ARROW = pa.schema(
    [("channel", pa.int32()), ("bucket", pa.int64()), ("block", pa.int64()), ("totals", pa.binary()), ("owned", pa.binary()), ("stats", pa.list_(pa.int64()))]
)


def _answer(key, table):
    """The totals of all blocks for each request, and which of its keys the block owns.

    One more row (block -1) has statistics: distinct keys with a total, the sum of totals, and how
    many keys have a total of 1, 2, 3 and 4.
    """
    channel, bucket = (k.as_py() for k in key)
    order = np.argsort(table.column("block").to_numpy())
    blocks = table.column("block").to_numpy()[order].tolist()
    keys = [unpack(table.column("keys")[i].as_py(), np.uint64, delta=True) for i in order.tolist()]
    amounts = [unpack(table.column("amounts")[i].as_py(), np.int64) for i in order.tolist()]
    distinct, first, inverse = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    totals = np.zeros(len(distinct), np.int64)
    np.add.at(totals, inverse, np.concatenate(amounts))
    owned = np.zeros(len(inverse), bool)
    owned[first] = True
    rows, at = [], 0
    for block, own in zip(blocks, keys):
        part = slice(at, at + len(own))
        rows.append({"channel": channel, "bucket": bucket, "block": block, "totals": pack(totals[inverse[part]]), "owned": np.packbits(owned[part]).tobytes(), "stats": None})
        at += len(own)
    stats = [int((totals > 0).sum()), int(totals.sum()), *[int((totals == c).sum()) for c in (1, 2, 3, 4)]]
    rows.append({"channel": channel, "bucket": bucket, "block": -1, "totals": b"", "owned": b"", "stats": stats})
    return pa.Table.from_pylist(rows, schema=_REPLY_ARROW)


def _exchange(requests: DataFrame) -> DataFrame:
    return staged(requests.groupBy("channel", "bucket").applyInArrow(_answer, _REPLY))


def _collected(rows: list[dict], channel: int) -> tuple[np.ndarray, np.ndarray]:
    """A block's totals and ownership on a channel, in the order of its keys."""
    mine = sorted((r for r in rows if r["channel"] == channel and r["totals"] is not None), key=lambda r: r["bucket"])
    totals = [unpack(r["totals"], np.int64) for r in mine]
    owned = [np.unpackbits(np.frombuffer(r["owned"], np.uint8), count=len(t)).astype(bool) for r, t in zip(mine, totals)]
    if not mine:
        return np.empty(0, np.int64), np.empty(0, bool)
    return np.concatenate(totals), np.concatenate(owned)


def _with_replies(blocks: DataFrame, replies: DataFrame) -> DataFrame:
    """Blocks and their replies as rows of one table, to be grouped by block."""
    left = blocks.select("block", "doc_ids", "payload", *[F.lit(None).cast(t).alias(n) for n, t in (("channel", "int"), ("bucket", "bigint"), ("totals", "binary"), ("owned", "binary"))])
    right = replies.filter("block >= 0").select("block", F.lit(None).cast("array<bigint>").alias("doc_ids"), F.lit(None).cast("binary").alias("payload"), "channel", "bucket", "totals", "owned")
    return left.unionByName(right)


# --- model -----------------------------------------------------------------------------------


class Sizes:
    """What all blocks share: training tokens and words, texts, and the discounts of each order."""

    def __init__(self, stats: dict[int, list[int]], texts: int) -> None:
        self.tokens, self.words, self.texts = stats[1][1], stats[1][0], texts
        self.discounts = {}
        for order, (_, _, n1, n2, n3, n4) in stats.items():
            y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
            found = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
            self.discounts[order] = [min(max(d, 0.05), c - 0.05) for d, c in zip(found, (1, 2, 3))]

    def discount(self, order: int, counts: np.ndarray) -> np.ndarray:
        table = np.array([0.0, *self.discounts[order]])
        return table[np.minimum(counts, 3)]

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 1) / (self.tokens + self.words + 1)


class Automaton:
    """The states, arcs and failure arcs that the texts of a block can reach.

    States are numbers: 0 is the root, then the words, then the longer contexts, order by order.
    """

    def __init__(self, block: Block, grams: list[Grams], counts: list[np.ndarray], masses: list[np.ndarray], sizes: Sizes) -> None:
        words = len(block.vocabulary)
        # Of every word number its place among the distinct unigrams; START has none.
        place = np.full(words, -1, np.int64)
        place[block.ids[grams[0].ends[grams[0].first]]] = np.arange(len(grams[0].keys))
        word_counts = np.where(place >= 0, counts[0][place], 0)
        start = int(block.ids[0]) if len(block.ids) else -1
        self.root_log = np.log10(sizes.unigram(word_counts))
        contexts = np.where(np.arange(words) == start, sizes.texts, word_counts)
        self.start = start + 1 if sizes.texts else 0
        fail, back = [np.zeros(1 + words, np.int64)], [np.zeros(1 + words)]
        alive = [np.concatenate([[True], contexts > 0])]
        arcs, logs, targets = [], [], []
        state_of = np.full(len(block.ids), -1, np.int64)  # by position: its context of the order before
        state_of[:] = block.ids + 1
        lower = sizes.unigram(word_counts)[block.ids]  # by position: probability at the order before
        total, base = contexts[block.ids], 1 + words
        for k in range(2, len(grams) + 1):
            g, c, mass = grams[k - 1], counts[k - 1], masses[k - 2]
            at = g.ends[g.first]
            seen = c > 0
            # The context ends one position earlier; its figures are those of its own position.
            left = total[at - 1]
            share = mass / np.maximum(left, 1)
            p = np.where(seen, (c - sizes.discount(k, c)) / np.maximum(left, 1) + share * lower[at], lower[at])
            known = left > 0
            if k == 2:
                back[0][block.ids[at - 1][known] + 1] = np.log10(share[known])
            else:
                back[-1][(state_of[at - 1] - (base - len(back[-1])))[known]] = np.log10(share[known])
            last = k == len(grams)
            own = np.arange(len(g.keys)) + base
            arcs.append((state_of[at - 1][seen] << 32) | block.ids[at][seen])
            logs.append(np.log10(p[seen]))
            targets.append((state_of[at] if last else own)[seen])
            if not last:
                fail.append(state_of[at])
                back.append(np.zeros(len(g.keys)))
                alive.append(seen)
                new_state, new_total, new_lower = np.full(len(block.ids), -1, np.int64), np.zeros(len(block.ids), np.int64), np.zeros(len(block.ids))
                new_state[g.ends], new_total[g.ends], new_lower[g.ends] = own[g.inverse], c[g.inverse], p[g.inverse]
                state_of, total, lower, base = new_state, new_total, new_lower, base + len(g.keys)
        self.fail, self.back = np.concatenate(fail), np.concatenate(back)
        self.alive = np.concatenate(alive)
        # A target without training texts is no state: its failure arc is taken at once.
        target = np.concatenate(targets) if targets else np.empty(0, np.int64)
        while len(target) and not self.alive[target].all():
            target = np.where(self.alive[target], target, self.fail[target])
        log = np.concatenate(logs) if logs else np.empty(0)
        self.arcs = dict(zip((np.concatenate(arcs) if arcs else np.empty(0, np.int64)).tolist(), zip(log.tolist(), target.tolist())))
        self.root = list(zip(self.root_log.tolist(), np.where(self.alive[1 : 1 + words], np.arange(1, 1 + words), 0).tolist()))
        self.fail, self.back = self.fail.tolist(), self.back.tolist()

    def score(self, words: list[int]) -> float:
        """The log10 probability of a text, given as word numbers with its end."""
        arcs, root, fail, back = self.arcs.get, self.root, self.fail, self.back
        state, total = self.start, 0.0
        for word in words:
            while state:
                arc = arcs(state << 32 | word)
                if arc is not None:
                    break
                total += back[state]
                state = fail[state]
            else:
                arc = root[word]
            total += arc[0]
            state = arc[1]
        return total


def score_texts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    blocks = staged(_blocks(docs))
    total = blocks.agg(F.sum("n_tokens")).first()[0] or 0
    bits = max(3, math.ceil(math.log2(max(1, total / BUCKET_KEYS))))

    def ask(batches):
        for batch in batches:
            for number, payload in zip(batch.column("block").to_pylist(), batch.column("payload")):
                block = Block.unpack(payload.as_py())
                rows = []
                for k in range(1, order + 1):
                    grams = block.grams(k)
                    rows.extend(_requests(k, number, grams.keys, grams.counts, bits))
                # Training texts are counted on a channel of their own.
                rows.extend(_requests(0, number, np.array([START]), np.array([int(block.train.sum())]), 0))
                yield pa.RecordBatch.from_pylist(rows, schema=_REQUEST_ARROW)

    replies = _exchange(blocks.select("block", "payload").mapInArrow(ask, _REQUEST))
    stats = {
        r.channel: list(r.stats)
        for r in replies.filter("block = -1").groupBy("channel").agg(
            F.array(*[F.sum(F.get("stats", F.lit(i))) for i in range(6)]).alias("stats")
        ).collect()
    }
    if not stats:
        return docs.sparkSession.createDataFrame([], _SCORES)
    sizes = Sizes({k: stats[k] for k in range(1, order + 1) if k in stats}, stats[0][1])
    for k in range(1, order + 1):
        sizes.discounts.setdefault(k, [0.5, 1.0, 1.5])

    def contexts(block: Block, k: int, grams: Grams) -> tuple[np.ndarray, np.ndarray]:
        """The distinct contexts of the n-grams, and for each n-gram the place of its own."""
        at = grams.ends[grams.first]
        hashes = block.vocabulary[block.ids]
        back = [hashes[at - b] for b in range(k - 1, 0, -1)]
        return np.unique(back[0] if k == 2 else fold_hashes(back), return_inverse=True)

    def share(key, table):
        """The discounts of the n-grams that a block owns, added up by context."""
        rows = table.to_pylist()
        block = Block.unpack(next(r["payload"] for r in rows if r["payload"] is not None))
        out = []
        for k in range(2, order + 1):
            grams = block.grams(k)
            totals, owned = _collected(rows, k)
            keys, place = contexts(block, k, grams)
            units = np.where(owned & (totals > 0), np.rint(sizes.discount(k, totals) * UNIT).astype(np.int64), 0)
            sums = np.zeros(len(keys), np.int64)
            np.add.at(sums, place, units)
            out.extend(_requests(100 + k, key[0].as_py(), keys, sums, bits))
        return pa.Table.from_pylist(out, schema=_REQUEST_ARROW)

    held = _with_replies(blocks, replies.filter("channel >= 2"))
    masses = _exchange(held.groupBy("block").applyInArrow(share, _REQUEST))

    def score(key, table):
        rows = table.to_pylist()
        ids, payload = next((r["doc_ids"], r["payload"]) for r in rows if r["payload"] is not None)
        block = Block.unpack(payload)
        grams = [block.grams(k) for k in range(1, order + 1)]
        counts = [_collected(rows, k)[0] for k in range(1, order + 1)]
        mass = [_collected(rows, 100 + k)[0][contexts(block, k, grams[k - 1])[1]] / UNIT for k in range(2, order + 1)]
        automaton = Automaton(block, grams, counts, mass, sizes)
        by_position = counts[0][grams[0].inverse]
        owner = np.repeat(np.arange(len(block.sizes)), block.sizes - 1)
        base = np.bincount(owner, weights=np.log10(sizes.unigram(by_position)), minlength=len(ids))
        known = np.bincount(owner, weights=by_position > 0, minlength=len(ids)).astype(np.int64)
        texts = block.ids.tolist()
        scores = [automaton.score(texts[a + 1 : a + n]) for a, n in zip(block.begins.tolist(), block.sizes.tolist())]
        return pa.table(
            {
                "doc_id": pa.array(ids, pa.int64()),
                "held_out": pa.array(~block.train),
                "n_tokens": pa.array(block.sizes - 1, pa.int64()),
                "n_known": pa.array(known, pa.int64()),
                "train_tokens": pa.array(np.full(len(ids), sizes.tokens), pa.int64()),
                "base_score": pa.array(base),
                "score": pa.array(scores, pa.float64()),
            }
        )

    answers = replies.filter("channel >= 1").unionByName(masses)
    return _with_replies(blocks, answers).groupBy("block").applyInArrow(score, _SCORES)


_SCORES = (
    "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
    "base_score double, score double"
)
