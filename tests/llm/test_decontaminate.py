import re

from tables import LOWER

from credsieve.llm.decontaminate import decontaminate, find_passages

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_force(text, items):
    words = WORD.findall((text or "").translate(LOWER))
    hit, ids = set(), set()
    for item_id, item in items:
        w = WORD.findall((item or "").translate(LOWER))
        for i in range(max(1, len(w) - 9)) if w else ():
            window = w[i : i + 10]
            for p in range(len(words) - len(window) + 1):
                if words[p : p + len(window)] == window:
                    hit.update(range(p, p + len(window)))
                    ids.add("null" if item_id is None else str(item_id))
    return len(words), len(hit), sorted(ids)


def table(spark, messy_rows):
    long = messy_rows[0][1].split()
    items = [
        (1, " ".join(long[5:30])), (10, " ".join(long[20:32]).upper()), (2, "ONE."), (2, "ONE."), (3, "two; three"),
        (4, None), (5, "?!"), (None, "lonely words"), (6, " ".join(["ra"] * 12)), (7, "δ ε"),
    ]
    return items, spark.createDataFrame(items, "item_id bigint, text string")


def test_as_brute_force(spark, clashing, messy_rows):
    items, benchmark = table(spark, messy_rows)
    for words_per_automaton in (200_000, 5):
        rows = find_passages(clashing, benchmark, automaton_words=words_per_automaton).collect()
        got = [(r.row.doc_id, r.row.text, r.n_words, r["n_hit"], r["items"]) for r in rows]
        expected = [(r[0], r[1], *brute_force(r[1], items)) for r in messy_rows]
        assert sorted(map(repr, got)) == sorted(map(repr, expected))


def test_spans_point_at_the_original(spark):
    text = "Intro,  (Größe)\n\tof THE-thing; end of"
    benchmark = spark.createDataFrame([(1, "größe of the thing"), (2, "end")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    (row,) = find_passages(docs, benchmark).collect()
    assert [text[s.start : s.end] for s in row.spans] == ["Größe)\n\tof THE-thing; end"]
    (row,) = find_passages(docs, benchmark.filter("item_id = 2")).collect()
    assert [text[s.start : s.end] for s in row.spans] == ["end"]


def test_empty_tables_and_filter(spark, clashing, no_docs, messy_rows):
    items, benchmark = table(spark, messy_rows)
    nothing = benchmark.limit(0)
    assert find_passages(no_docs, benchmark).count() == 0
    assert decontaminate(clashing, nothing).count() == len(messy_rows)
    kept = decontaminate(clashing, benchmark)
    assert kept.columns == clashing.columns
    assert kept.count() == sum(brute_force(r[1], items)[1] == 0 for r in messy_rows)
