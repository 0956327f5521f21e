import random

import numpy as np
import pytest
from tables import CLASHING, SCHEMA, sentence, spaced_words

from credsieve.llm import ngram_join


def shingles(text):
    w = spaced_words(text)
    return {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()


def brute_force(rows):
    sets = [shingles(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        ids = [x for x in (least.get(find(i)), r[0]) if x is not None]
        least[find(i)] = min(ids, default=None)
    return [(r[0], len(s), least[find(i)] if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets))]


def found(frame):
    return sorted(map(repr, (tuple(r) for r in ngram_join.link(frame).select("doc_id", "n_shingles", "component_id").collect())))


def test_messy_rows(clashing, messy_rows):
    assert found(clashing) == sorted(map(repr, brute_force(messy_rows)))


@pytest.mark.parametrize("block", [3000, 7])
def test_chains_of_near_copies(spark, monkeypatch, block):
    """Each copy changes the one before, so that only neighbours link; blocks must not lose any."""
    monkeypatch.setattr(ngram_join, "BLOCK_TEXTS", block)
    rnd = random.Random(block)
    rows, i = [], 0
    for _ in range(4):
        words = sentence(rnd, rnd.choice([30, 90, 200])).split()
        for _ in range(25):
            if rnd.random() < 0.7:
                words[rnd.randrange(len(words))] = f"w{i}"
            rows.append((i, " ".join(words), None, None, None))
            i += 1
    rows += [(i + k, sentence(rnd, 50), None, None, None) for k in range(20)]
    rnd.shuffle(rows)
    assert found(spark.createDataFrame(rows, SCHEMA)) == sorted(map(repr, brute_force(rows)))


def test_no_rows(no_docs):
    assert ngram_join.link(no_docs).count() == 0
    assert ngram_join.keep_one(no_docs).count() == 0


def test_one_document_of_each_component_stays(clashing, messy_rows):
    kept = ngram_join.keep_one(clashing)
    assert kept.columns == clashing.columns and set(CLASHING) < set(kept.columns)
    rows = kept.collect()
    expected = brute_force(messy_rows)
    components = {c for _, n, c in expected if n}
    assert sorted(repr(r.doc_id) for r in rows if shingles(r.text)) == sorted(map(repr, components))
    assert sum(not shingles(r.text) for r in rows) == sum(n == 0 for _, n, _ in expected)


def near_sets(rnd, families, members, size):
    """Sorted sets that share about as much with others of their family as a link takes, in order of size."""
    sets = []
    for _ in range(families):
        base = [rnd.randrange(2**62) for _ in range(size)]
        for _ in range(members):
            share = rnd.choice([0.85, 0.92, 0.97])
            own = {x for x in base if rnd.random() < share}
            own |= {rnd.randrange(2**62) for _ in range(rnd.randrange(size // 8 + 2))}
            sets.append(np.array(sorted(own), dtype=np.uint64))
    return sorted((s for s in sets if len(s)), key=len)


def groups_of(label):
    return {frozenset(np.flatnonzero(np.asarray(label) == x).tolist()) for x in label}


@pytest.mark.parametrize("size", [2, 12, 90])
@pytest.mark.parametrize("threshold", [60, 80, 85, 100])
@pytest.mark.parametrize("blocks", [1, 2])
def test_search_of_one_task(size, threshold, blocks):
    sets = near_sets(random.Random(size), 3, 25, size)
    marks = np.arange(len(sets)) % blocks
    index, groups, plain = ngram_join.Index(sets, threshold), ngram_join.Groups(len(sets)), ngram_join.Groups(len(sets))
    links = 0
    for text in range(len(sets)):
        for other in index.links(text, groups, None if blocks == 1 else marks != marks[text]):
            assert other < text and groups.label[other] != groups.label[text]
            groups.join(text, other)
            links += 1
        for other in range(text):
            a, b = set(sets[text].tolist()), set(sets[other].tolist())
            if (blocks == 1 or marks[text] != marks[other]) and 100 * len(a & b) >= threshold * len(a | b):
                plain.join(text, other)
    assert groups_of(groups.label) == groups_of(plain.label)
    assert links == len(sets) - len(groups_of(groups.label))


def test_blocks_are_cut_by_shingles_too(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 400)
    rnd = random.Random(3)
    words, rows = sentence(rnd, 150).split(), []
    for i in range(12):
        words[rnd.randrange(150)] = "other"
        rows.append((i, " ".join(words), None, None, 1))
    assert found(spark.createDataFrame(rows, SCHEMA)) == sorted(map(repr, brute_force(rows)))
