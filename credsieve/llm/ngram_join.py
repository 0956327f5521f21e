"""N-gram Jaccard self-join by T-occurrence search.

Each text is the set of its distinct shingles (of four words unless the caller says otherwise). Two texts link when their Jaccard similarity
reaches the threshold, that is, when one occurs often enough in the inverted lists of the other's
shingles. The search runs in two steps.

Which texts can meet: shingles are put in one global order, rare ones first. Linked texts share at least
``l`` shingles of their prefixes in that order, so only prefixes are dealt out by shingle, texts whose
prefix meets others too seldom are dropped, and texts that share a prefix shingle form a family. The
order uses a sketch of all shingles' frequencies, of fixed size; any order gives the same links.

The search itself: a family is one task; a large one is cut by set size and into pairs of blocks. It builds the inverted
lists in order of set size, and for each text merges its short lists with a heap, keeps the texts that the
long lists could still lift to the overlap T, and probes the long lists for those by binary search
(DivideSkip). Texts that are connected already and texts too small for a link are skipped in the lists, so
a text of a group is found once and the rest of the group costs nothing. Only links that connect new
texts leave the task, never all pairs of a group.

Texts with the same set are one node throughout. Shingles and sets are compared by 64-bit hashes.

Defined cases: a null, empty or wordless text has an empty set and is linked with nothing; a text of
fewer words than a shingle is one shingle, its whole sequence; texts of any length are taken whole;
repeated rows are linked with each other; the component of rows with null ids only has a null id;
an empty table gives an empty result; extra columns stay.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credsieve.llm.common import SPACED, fold_hashes, mix, staged, text_chunks, word_hashes, word_spans
from credsieve.llm.graph import components
from credsieve.llm.lm_scoring import pack, unpack

#: Words of a shingle, and the least similarity in hundredths, where the caller does not give them.
SHINGLE_WORDS = 4
THRESHOLD = 85
#: Prefixes must share this part of a set, in hundredths (at least one shingle).
SHARED = 10
SKETCH_BITS = 18
#: Prefix shingles that one task brings together, and texts of a family and their shingles that it searches, about.
BUCKET_KEYS = 1 << 20
BLOCK_TEXTS = 3000
BLOCK_SHINGLES = 1 << 21


def shingle_sets(column: pa.Array, size: int = SHINGLE_WORDS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets, shingles) of runs of whole texts; the shingles of a text are distinct and
    sorted."""
    for first, raw, offsets in text_chunks(column):
        starts, ends, at = word_spans(raw, offsets, SPACED)
        words = word_hashes(raw, starts, ends)
        n = np.diff(at)
        owner = np.repeat(np.arange(len(n)), n)
        hashes, owners = [], []
        if len(words) >= size:
            whole = owner[size - 1 :] == owner[: len(words) - size + 1]
            grams = fold_hashes([words[i : len(words) - size + 1 + i] for i in range(size)])
            hashes.append(grams[whole])
            owners.append(owner[: len(whole)][whole])
        for short in range(1, size):
            rows = np.flatnonzero(n == short)
            if len(rows):
                parts = [words[at[rows] + i] for i in range(short)]
                hashes.append(fold_hashes([*parts, np.full(len(rows), np.uint64(short))]))
                owners.append(rows)
        hashes = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        owners = np.concatenate(owners) if owners else np.empty(0, np.int64)
        order = np.lexsort((hashes, owners))
        hashes, owners = hashes[order], owners[order]
        fresh = np.ones(len(hashes), bool)
        fresh[1:] = (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])
        hashes, owners = hashes[fresh], owners[fresh]
        yield first, np.searchsorted(owners, np.arange(len(n) + 1)), hashes


def signatures(offsets: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A hash of each set, as a signed number."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ np.uint64(0xA24BAED4963EE407)))])
    sizes = np.diff(offsets).astype(np.uint64)
    return mix((sums[offsets[1:]] - sums[offsets[:-1]]) + sizes * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def least_overlap(n, threshold: int):
    """The least overlap of a set of n shingles with any set that it links with."""
    return -(-n * threshold // 100)


def least_shared(n):
    """How many prefix shingles a set shares with a linked set of n or more."""
    return np.maximum(1, n * SHARED // 100)


_NARROW = "doc_id bigint, text_hash bigint, sig bigint, n bigint, bucket bigint, seen bigint"


def _survey(size: int):
    """Size and signature of every set, and then how many sets hold shingles of each sketch bucket."""

    def run(batches):
        seen = np.zeros(1 << SKETCH_BITS, np.int64)
        names = ["doc_id", "text_hash", "sig", "n", "bucket", "seen"]
        for batch in batches:
            sizes, marks = [], []
            for _, offsets, hashes in shingle_sets(batch.column("text"), size):
                seen += np.bincount((hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(seen))
                sizes.append(np.diff(offsets))
                marks.append(signatures(offsets, hashes))
            rows = batch.num_rows
            columns = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (marks, sizes)]
            none = pa.nulls(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), *[pa.array(c, pa.int64()) for c in columns], none, none],
                names=names,
            )
        buckets = np.flatnonzero(seen)
        none = pa.nulls(len(buckets), pa.int64())
        yield pa.RecordBatch.from_arrays([none] * 4 + [pa.array(buckets), pa.array(seen[buckets])], names=names)

    return run


_POSTINGS = "bucket bigint, shingles binary, places binary, sigs binary, sizes binary"
_SHARED = "shingle bigint, sig bigint, n bigint"


def _prefixes(sketch, bits: int, size: int, threshold: int):
    """Emits the prefix shingles of every distinct set of a task, packed by bucket."""

    def run(batches):
        known: set[int] = set()
        for batch in batches:
            for _, offsets, hashes in shingle_sets(batch.column("text"), size):
                sigs, sizes = signatures(offsets, hashes), np.diff(offsets)
                own = np.repeat(np.arange(len(sizes)), sizes)
                fresh = np.zeros(len(sizes), bool)
                for i, sig in enumerate(sigs.tolist()):
                    if sizes[i] and sig not in known:
                        known.add(sig)
                        fresh[i] = True
                seen = sketch.value[(hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                order = np.lexsort((seen, own))  # stable: equal frequencies stay in the order of hashes
                place = np.arange(len(hashes)) - np.repeat(offsets[:-1], sizes)
                length = sizes - least_overlap(sizes, threshold) + least_shared(sizes)
                chosen = (place < np.repeat(length, sizes)) & np.repeat(fresh, sizes)
                shingles, texts = hashes[order][chosen], own[chosen]
                order = np.argsort(shingles, kind="stable")
                shingles, texts = shingles[order], texts[order]
                tops = (shingles >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(shingles), np.int64)
                edges = [0, *(np.flatnonzero(np.diff(tops)) + 1).tolist(), len(shingles)] if len(shingles) else []
                rows = []
                for a, b in zip(edges, edges[1:]):
                    used, places = np.unique(texts[a:b], return_inverse=True)
                    rows.append(
                        {
                            "bucket": int(tops[a]),
                            "shingles": pack(shingles[a:b], delta=True),
                            "places": pack(places.astype(np.int32)),
                            "sigs": pack(sigs[used]),
                            "sizes": pack(sizes[used].astype(np.int64)),
                        }
                    )
                yield pa.RecordBatch.from_pylist(
                    rows,
                    schema=pa.schema([("bucket", pa.int64()), *[(n, pa.binary()) for n in ("shingles", "places", "sigs", "sizes")]]),
                )

    return run


def _meeting(key, table):
    """The prefix shingles of a bucket that at least two different sets hold."""
    shingles, sigs, sizes = [], [], []
    for row in table.to_pylist():
        places = unpack(row["places"], np.int32)
        shingles.append(unpack(row["shingles"], np.uint64, delta=True))
        sigs.append(unpack(row["sigs"], np.int64)[places])
        sizes.append(unpack(row["sizes"], np.int64)[places])
    shingles, sigs, sizes = (np.concatenate(x) for x in (shingles, sigs, sizes))
    order = np.lexsort((sigs, shingles))
    shingles, sigs, sizes = shingles[order], sigs[order], sizes[order]
    fresh = np.ones(len(sigs), bool)
    fresh[1:] = (sigs[1:] != sigs[:-1]) | (shingles[1:] != shingles[:-1])
    shingles, sigs, sizes = shingles[fresh], sigs[fresh], sizes[fresh]
    same = np.zeros(len(sigs) + 1, bool)
    same[1:-1] = shingles[1:] == shingles[:-1]
    shared = same[:-1] | same[1:]
    return pa.table({"shingle": shingles[shared].view(np.int64), "sig": sigs[shared], "n": sizes[shared]})


def _pruned(postings: DataFrame, threshold: int) -> DataFrame:
    """Drops sets that meet others on too few prefix shingles for any link, then lists of one set."""
    enough = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * threshold / 100) * SHARED / 100))
    active = postings.groupBy("sig", "n").agg(F.count("*").alias("met")).filter(F.col("met") >= enough)
    left = postings.join(active.select("sig"), "sig")
    lists = left.groupBy("shingle").agg(F.count("*").alias("sets"), F.min("sig").alias("hub")).filter("sets > 1")
    return staged(left.join(lists, "shingle").select("shingle", "sig", "n", "hub"))


def needed_overlap(n, m, threshold: int):
    """The least overlap of linked sets of n and m shingles."""
    return -(-(n + m) * threshold // (100 + threshold))


class Groups:
    """Disjoint groups of 0..n-1 within one task, with the group of each at hand as an array."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)
        self.members: list[list[int] | None] = [[i] for i in range(n)]

    def join(self, a: int, b: int) -> None:
        a, b = sorted((int(self.label[a]), int(self.label[b])), key=lambda g: len(self.members[g]))
        if a != b:
            self.label[self.members[a]] = b
            self.members[b] += self.members[a]
            self.members[a] = None


class Index:
    """Inverted lists of the sets of one task, in order of size, and the search over them.

    An entry is a shingle's number times the number of sets plus the set, so that all lists are one sorted array and
    the part of a list between two sets is found by binary search.
    """

    def __init__(self, sets: list[np.ndarray], threshold: int) -> None:
        self.threshold = threshold
        self.sets, self.sizes = sets, np.array([len(s) for s in sets], dtype=np.int64)
        shingles = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        owners = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(shingles, kind="stable")
        self.keys, counts = np.unique(shingles, return_counts=True)
        self.entries = np.repeat(np.arange(len(self.keys)) * len(sets), counts) + owners[order]

    def links(self, text: int, groups: Groups, other: np.ndarray | None = None) -> Iterator[int]:
        """Texts before ``text`` that link with it, of each group at most one; the caller joins the groups.

        ``other`` marks the texts to look at; None stands for all. Texts of the own group and texts too small for a
        link are passed over in the lists, and the search ends when none is left.
        """
        own, n, entries = self.sets[text], len(self.sets[text]), self.entries
        first = int(np.searchsorted(self.sizes[:text], least_overlap(n, self.threshold)))

        def open_from(c: int) -> list[int]:
            apart = groups.label[c:text] != groups.label[text]
            return (np.flatnonzero(apart if other is None else apart & other[c:text]) + c).tolist()

        left, k = open_from(first), 0
        if not left:
            return
        at = np.searchsorted(self.keys, own) * len(self.sets)
        begins, ends = np.searchsorted(entries, at + first), np.searchsorted(entries, at + text)
        order = np.argsort(ends - begins, kind="stable")
        # lists that may be left to probing: T - 1
        n_long = int(needed_overlap(n, self.sizes[left[0]], self.threshold)) - 1
        short, long = order[: n - n_long], at[order[n - n_long :]]
        view = memoryview(entries)
        short = short[ends[short] > begins[short]]
        heap = [(view[b] - base, b, e, base) for b, e, base in zip(*(x[short].tolist() for x in (begins, ends, at)))]
        heapq.heapify(heap)

        def skip(to: int) -> int:
            """Moves the lists that stand before ``to`` there, and returns how many did."""
            moved = 0
            while heap and heap[0][0] < to:
                _, b, e, base = heap[0]
                b += 1
                if b < e and view[b] < base + to:
                    b = bisect_left(view, base + to, b, e)
                if b < e:
                    heapq.heapreplace(heap, (view[b] - base, b, e, base))
                else:
                    heapq.heappop(heap)
                moved += 1
            return moved

        while heap:
            k = bisect_left(left, heap[0][0], k)
            if k == len(left):
                return
            candidate = left[k]
            skip(candidate)
            overlap = skip(candidate + 1)
            needed = needed_overlap(n, int(self.sizes[candidate]), self.threshold)
            if overlap + n_long < needed:
                continue
            probed = long + candidate
            place = np.minimum(np.searchsorted(entries, probed), len(entries) - 1)
            if overlap + int((entries[place] == probed).sum()) >= needed:
                yield candidate
                left, k = open_from(candidate + 1), 0


def _search(threshold: int):
    """Links of a family, or of a pair of its blocks, that connect its texts."""

    def run(key, table):
        _, _, one, two = (k.as_py() for k in key)
        sigs, fresh = np.unique(table.column("sig").to_numpy(), return_index=True)
        blocks = table.column("own").to_numpy()[fresh]
        sets = [unpack(table.column("shingles")[i].as_py(), np.uint64, delta=True) for i in fresh.tolist()]
        by_size = np.argsort([len(s) for s in sets], kind="stable")
        sigs, blocks, sets = sigs[by_size], blocks[by_size], [sets[i] for i in by_size.tolist()]
        index, groups, links = Index(sets, threshold), Groups(len(sets)), []
        for text in range(len(sets)):
            other = None if one == two else blocks != blocks[text]
            for found in index.links(text, groups, other):
                groups.join(text, found)
                links.append((text, found))
        a, b = (np.array(x, dtype=np.int64) for x in zip(*links)) if links else (np.empty(0, np.int64),) * 2
        return pa.table({"a": pa.array(sigs[a], pa.int64()), "b": pa.array(sigs[b], pa.int64())})

    return run


def _sets(size: int):
    def run(batches):
        for batch in batches:
            for first, offsets, hashes in shingle_sets(batch.column("text"), size):
                rows = len(offsets) - 1
                sets = [pack(hashes[a:b], delta=True) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                part = batch.slice(first, rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column("places"), pa.array(signatures(offsets, hashes)), pa.array(sets, pa.binary())],
                    names=["places", "sig", "shingles"],
                )

    return run


_PLACES = "array<struct<family: bigint, span: int, blocks: int>>"


def _placed(families: DataFrame, sizes: DataFrame, threshold: int) -> DataFrame:
    """(sig, places): the searches that a set takes part in.

    A large family is searched by spans of set sizes. Classes of sizes are wider than the sizes of
    linked sets can differ, so linked sets are of one class or of neighbours, and a span is a class
    with the next. What is still too large is cut into blocks.
    """
    parts = F.greatest(F.count("*") / BLOCK_TEXTS, F.sum("n") / BLOCK_SHINGLES)
    known = families.join(sizes, "sig")
    large = known.groupBy("family").agg(parts.alias("parts"))
    width = math.log(100 / (threshold - 1))
    size_class = F.floor(F.log("n") / F.lit(width)).cast("int")
    spans = F.when(F.col("parts") <= 1, F.array(F.lit(0))).otherwise(F.array(size_class - 1, size_class))
    each = known.join(large, "family").select("sig", "n", "family", F.explode(spans).alias("span"))
    blocks = each.groupBy("family", "span").agg(F.ceil(parts).cast("int").alias("blocks"))
    place = F.collect_list(F.struct("family", "span", "blocks")).alias("places")  # one or two
    return each.join(blocks, ["family", "span"]).groupBy("sig").agg(place)


def link(docs: DataFrame, size: int = SHINGLE_WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id) of every row."""
    spark = docs.sparkSession
    text_hash = F.coalesce(F.xxhash64("text"), F.lit(0)).alias("text_hash")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_hash, "text")
    survey = staged(texts.mapInArrow(_survey(size), _NARROW))
    rows = survey.filter("n IS NOT NULL").select("doc_id", "text_hash", "sig", "n")
    sketch = np.zeros(1 << SKETCH_BITS, np.int64)  # a fixed number of counts, whatever the input
    for r in survey.filter("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("seen").alias("s")).collect():
        sketch[r.bucket] = r.s
    total = int(sketch.sum())
    bits = max(3, math.ceil(math.log2(max(1, total / 5 / BUCKET_KEYS))))
    shared = spark.sparkContext.broadcast(sketch)
    packed = texts.select("text").mapInArrow(_prefixes(shared, bits, size, threshold), _POSTINGS)
    postings = staged(packed.groupBy("bucket").applyInArrow(_meeting, _SHARED))
    postings = _pruned(_pruned(postings, threshold).select("shingle", "sig", "n"), threshold)
    ties = postings.filter("sig <> hub").select(F.col("sig").alias("a"), F.col("hub").alias("b"))
    families = staged(components(ties).withColumnRenamed("root", "family").withColumnRenamed("node", "sig"))
    placed = _placed(families, postings.select("sig", "n").distinct(), threshold)
    # One row stands for each set; its text is read again for the shingles.
    row = F.min(F.struct(F.coalesce("doc_id", F.lit(0)).alias("id"), "text_hash")).alias("row")
    chosen = rows.filter("n > 0").groupBy("sig").agg(row).join(placed, "sig")
    members = (
        texts.withColumn("id", F.coalesce("doc_id", F.lit(0)))
        .join(chosen.select("row.id", "row.text_hash", "places"), ["id", "text_hash"])
        .select("places", "text")
        .mapInArrow(_sets(size), f"places {_PLACES}, sig bigint, shingles binary")
        .select(F.inline("places"), "sig", "shingles")
        .withColumn("own", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int"))
    )
    dealt = members.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("family", "span", F.least("own", "with").alias("one"), F.greatest("own", "with").alias("two"), "sig", "own", "shingles")
    links = staged(dealt.groupBy("family", "span", "one", "two").applyInArrow(_search(threshold), "a bigint, b bigint"))
    return _named(rows, components(links))


def _named(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows with the smallest id of their component."""
    classes = rows.filter("n > 0").groupBy("sig").agg(F.min("doc_id").alias("least"))
    placed = classes.join(roots.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    placed = staged(placed)
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    by_sig = placed.select("sig", "root").join(named, "root").select("sig", "component_id")
    filled = rows.filter("n > 0").join(by_sig, "sig").select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "component_id")
    empty = rows.filter("n = 0").select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return filled.unionByName(empty)


def keep_one(docs: DataFrame, size: int = SHINGLE_WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """One document of each component, that of the smallest id; columns unchanged.

    Texts without words are linked with nothing and all stay.
    """
    linked = staged(link(docs, size, threshold))
    filled = linked.filter("n_shingles > 0")
    root = F.coalesce(F.col("component_id"), F.col("text_hash"))
    kept = filled.groupBy(root, F.col("component_id").isNull()).agg(
        F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)), F.col("doc_id").alias("id"), "text_hash")).alias("first")
    )
    kept = kept.select(F.col("first.id").alias("_id"), F.col("first.text_hash").alias("_text"))
    hashed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col("doc_id").cast("bigint").alias("_doc"),
        F.coalesce(F.xxhash64("text"), F.lit(0)).alias("_text"),
        "text",
    )
    wordless = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    one = hashed.filter(~wordless).join(kept, (F.col("_doc").eqNullSafe(F.col("_id"))) & (hashed["_text"] == kept["_text"]))
    one = one.select("row", "_doc", hashed["_text"]).dropDuplicates(["_doc", "_text"]).select("row.*")
    return one.unionByName(hashed.filter(wordless).select("row.*"))
