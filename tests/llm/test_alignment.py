"""The alignment against a plain two-pointer walk over the libraries' own tokens of whole texts."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from credsieve.llm import alignment

A_PATH = public_tokenizers.path(alignment.VOCABULARY_A)
B_PATH = public_tokenizers.path(alignment.VOCABULARY_B)
ODD = [
    "a  b\n c\x00d  \n\n e", " leading", "\nleading", "trailing ", "trailing\n", " ", "\n", " \n ", "\t",
    "it's we'll <|endoftext|> <s> </s> <unk> <0x41>", "holds ▁ the mark", "日本語のテキスト と 한국어", "🙂🙃 emoji🙂",
    "a\x1cb \x1d c\x85d   e　f", "x" * 3000, "ab" * 900 + " tail", "0123456789 " * 40, "é ﬁ ½ ①",
    "\r\n windows\r\nlines\r", "q \n q\n q  q", "﻿bom ​ zero", "aaaa    bbbb     cccc\tdddd",
]


@pytest.fixture(scope="module")
def tools():
    return alignment.Tokenizers(A_PATH, B_PATH)


def plain(texts):
    """(n_a, n_b, n_groups, n_links, hash, links) of each text, straight from the definition."""
    a_tool = Tokenizer.from_file(A_PATH)
    a_tool.encode_special_tokens = True
    b_tool = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    tools = alignment.Tokenizers(A_PATH, B_PATH)
    out = []
    for text in texts:
        a = a_tool.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_tool.encode(text) if text else []
        whole = (" " + (text or "")).encode()
        a_raw, b_raw = [tools.a_bytes[i] for i in a], [tools.b_bytes[i] for i in b]
        if not text or b"".join(a_raw) != whole or b"".join(b_raw) != whole:
            out.append((0, 0, 0, 0, "", Counter()))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in a_raw]), np.cumsum([len(x) for x in b_raw])
        groups, links, i, j = [], Counter(), 0, 0
        for end in sorted(set(ends_a.tolist()) & set(ends_b.tolist())):
            x, y = a[i : np.searchsorted(ends_a, end) + 1], b[j : np.searchsorted(ends_b, end) + 1]
            i, j = i + len(x), j + len(y)
            groups.append(f"{','.join(map(str, x))}|{','.join(map(str, y))}")
            if len(x) * len(y) < 10**6:
                links.update((p, q) for p in x for q in y)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        out.append((len(a), len(b), len(groups), links.total(), digest, links))
    return out


def expected(rows):
    """{position: the result's columns} of (key, text) rows."""
    found = plain([text for _, text in rows])
    seen = Counter(pair for *_, links in found for pair in links)
    highest = {}
    for (a, _), n in seen.items():
        highest[a] = max(n, highest.get(a, 0))
    return sorted(
        (str(key), *counts, sum(n for p, n in links.items() if seen[p] == highest[p[0]]),
         sum(n * seen[p] for p, n in links.items()))
        for (key, _), (*counts, links) in zip(rows, found)
    )


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]


def result(docs, **options):
    frame = alignment.align(docs, A_PATH, B_PATH, **options).select("row.doc_id", *COLUMNS)
    return sorted((str(r[0]), *r[1:]) for r in frame.collect())


def test_odd_texts(spark):
    rows = [(i, text) for i, text in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert result(docs) == expected(rows)


def test_messy_rows(clashing, messy_rows):
    docs = clashing.withColumn("block", F.lit(1)).withColumn("n_a", F.lit("x"))
    assert result(docs) == expected([(r[0], r[1]) for r in messy_rows])


def test_many_blocks(messy, messy_rows):
    rows = [(r[0], r[1]) for r in messy_rows]
    assert result(messy.repartition(5), keep=["doc_id"], block_entries=1) == expected(rows)


def test_empty_table(no_docs):
    frame = alignment.align(no_docs, A_PATH, B_PATH)
    assert frame.collect() == []
    assert frame.columns == ["row", *COLUMNS]


def test_cuts(spark):
    docs = spark.createDataFrame([(1, "tokenizers disagree, sometimes"), (2, None)], "doc_id bigint, text string")
    rows = {r["row"]["doc_id"]: r for r in alignment.align(docs, A_PATH, B_PATH, cuts=True).collect()}
    assert rows[2]["a_ends"] == rows[2]["b_ends"] == []
    assert rows[1]["a_ends"][-1] == rows[1]["n_a"] and rows[1]["b_ends"][-1] == rows[1]["n_b"]
    assert len(rows[1]["a_ends"]) == len(rows[1]["b_ends"]) == rows[1]["n_groups"]


def test_lanes_finish_at_different_times():
    a_ends = np.array([2, 4, 5, 7, 8, 9, 12])  # lanes of bytes 0-5, none, 5-8, 8-12
    b_ends = np.array([1, 4, 5, 8, 10, 12])
    a, b = alignment.merge_lockstep(a_ends, b_ends, np.array([0, 3, 3, 5, 7]), np.array([0, 3, 3, 4, 6]))
    assert a.tolist() == [2, 3, 5, 7] and b.tolist() == [2, 3, 4, 6]


def test_large_groups_count_like_small_ones(tools, monkeypatch):
    texts = [t for t in ODD if t]
    usual = alignment.Aligned(tools, texts).links(len(texts))
    monkeypatch.setattr(alignment, "LARGE_GROUP", 0)
    for x, y in zip(usual, alignment.Aligned(tools, texts).links(len(texts))):
        assert (x == y).all()


def test_blobs_encode_like_whole_texts(tools):
    assert tools.in_blobs
    for text in filter(None, ODD):
        a, _, b, _, sound = tools.encode([" " + text])
        part_a, _, part_b, _, parts_sound = tools.encode(tools.blobs(text))
        assert sound.tolist() == [parts_sound.all()] == ["▁" not in text]
        if sound[0]:
            assert "".join(tools.blobs(text)) == " " + text
            assert (a.tolist(), b.tolist()) == (part_a.tolist(), part_b.tolist()), repr(text)
