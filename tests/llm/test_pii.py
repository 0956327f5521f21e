import random
import re

import pytest

from credsieve.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    pairs = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(p // 10 + p % 10 for p in pairs) % 10 == 0


def plain(text):
    """The patterns as they are written, without any care for speed."""
    only = lambda s: re.sub("[^0-9]", "", s)
    return [
        *[("email", *m.span()) for m in EMAIL.finditer(text)],
        *[("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))],
        *[("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(only(m.group())) <= 19 and luhn(only(m.group()))],
        *[("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(only(m.group())) <= 15],
    ]


def test_base_spans_as_the_plain_patterns():
    rnd = random.Random(5)
    parts = ["a", "B", ".", "@", "-", "+", " ", "1", "23", "255", "256", "4539 1488 0343 6467", "6011000990139424", "(", ")", "é",
             "x@y.z", "10.0.0.1", "+1 (555) 123-4567", "_", "%", "\n", "007", "@@"]
    for _ in range(3000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))
        assert pii.base_spans(text) == plain(text), repr(text)


def test_no_quadratic_texts():
    for text in ("a" * 300_000, "a" * 300_000 + "@", "1" * 300_000, "1." * 150_000, "+1" * 150_000, "@" * 300_000):
        pii.base_spans(text)


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_context_finds_what_the_patterns_miss(spark):
    rows = [(i, f"please call me at phone: +1 (555) 010-{1000 + i * 7} thanks a lot number {i}") for i in range(30)]
    rows += [(100, "please call me at phone: 5550101234 thanks a lot"), (101, "the build 20240115 is out and 5550101234 too")]
    rows += [(102, None), (103, ""), (None, "nothing here"), (100, "please call me at phone: 5550101234 thanks a lot")]
    found = pii.find_personal_data(docs(spark, rows)).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found}
    assert [(s.kind, s.start, s.end) for s in by_id[100].added] == [("phone", 25, 35)]
    assert [(s.kind, rows[31][1][s.start : s.end]) for s in by_id[101].added] == [("phone", "5550101234")]
    assert by_id[100].all_text == "phone:25:35" and by_id[100].base_text == ""
    assert all(r.added == [] and r.all_text == r.base_text for r in found if r.doc_id not in (100, 101))


def test_chance_neighbours_add_nothing(spark):
    rnd = random.Random(2)
    words = "one two three four five six seven eight nine ten".split()
    text = lambda: " ".join(rnd.choice(words) for _ in range(6))
    rows = [(i, f"{text()} +1 (555) 010-{1000 + i} {text()} 10.0.{i}.1 {text()} {10**7 + i * 13} {text()}") for i in range(60)]
    assert all(r.added == [] for r in pii.find_personal_data(docs(spark, rows)).collect())


@pytest.mark.parametrize("seeds, unseen", [(5, 2), (30, 10), (30, 30)])
def test_unseen_identifiers_do_not_hide_each_other(spark, seeds, unseen):
    """Up to half of a context's identifiers are not seen by the fixed patterns."""
    rows = [(i, f"please call me at phone: +1 (555) 010-{1000 + i * 7} thanks a lot number {i}") for i in range(seeds)]
    rows += [(100 + i, f"please call me at phone: {5550101234 + i * 11} thanks a lot") for i in range(unseen)]
    by_id = {r.doc_id: r for r in pii.find_personal_data(docs(spark, rows)).collect()}
    assert all([(s.kind, s.start, s.end) for s in by_id[100 + i].added] == [("phone", 25, 35)] for i in range(unseen))


@pytest.mark.parametrize("unseen", [10, 30])
def test_one_pattern_is_enough(spark, unseen):
    """Only the two words before are the same."""
    rows = [(i, f"please a{i}b call me at phone: +1 (555) 010-{1000 + i * 7} x{i}y z{i}") for i in range(30)]
    rows += [(100 + i, f"please call me at phone: {5550101234 + i * 11} v{i}w u{i}") for i in range(unseen)]
    by_id = {r.doc_id: r for r in pii.find_personal_data(docs(spark, rows)).collect()}
    assert all([s.kind for s in by_id[100 + i].added] == ["phone"] for i in range(unseen))


def test_a_context_of_mostly_other_numbers_adds_nothing(spark):
    rows = [(i, f"the record has the number +1 (555) 010-{1000 + i * 7} in it") for i in range(8)]
    rows += [(100 + i, f"the record has the number {20240000 + i * 11} in it") for i in range(80)]
    assert all(r.added == [] for r in pii.find_personal_data(docs(spark, rows)).collect())


@pytest.mark.parametrize("unseen", ["555 010 1234", "(555) 010-1234", "555 - 010 - 1234", "4539 1488 0343 6468"])
def test_identifiers_of_several_tokens(spark, unseen):
    rows = [(i, f"please call me at phone: +1 (555) 010-{1000 + i * 7} thanks a lot number {i}") for i in range(30)]
    rows += [(100, f"please call me at phone: {unseen} thanks a lot"), (101, f"please call me at phone: {unseen}, thanks")]
    by_id = {r.doc_id: r for r in pii.find_personal_data(docs(spark, rows)).collect()}
    for i in (100, 101):
        assert [(s.kind, s.start, s.end) for s in by_id[i].added] == [("phone", 25, 25 + len(unseen))]


def test_runs_of_tokens():
    def runs(text):
        return [text[a:b] for a, b, _, _ in pii._runs(text, [m.span() for m in pii._TOKEN.finditer(text)], set())]

    assert runs("call (555) 010-1234. Or tel:555 010 1234, 555 010 9999!") == ["(555) 010-1234", "555 010 1234", "555 010 9999"]
    assert runs("12 34 x 5550101234 one 555 010\n1234 a12 345 678") == ["555 010", "345 678"]
    assert runs("(555 010 1234) and 2 3 4 5 +555 010 (") == ["555 010 1234", ] + ["+555 010"]
    assert runs("1234567890 1234567890 and 1 a") == []
    assert runs("") == runs("1") == runs("- -") == []
    assert len(runs("1 2 3 a " * 20_000 + "1 2 3 4 5 6")) == 1


def test_messy_rows(clashing, messy_rows, no_docs):
    rows = pii.find_personal_data(clashing).collect()
    assert sorted(repr(r.doc_id) for r in rows) == sorted(repr(r[0]) for r in messy_rows)
    assert pii.find_personal_data(no_docs).count() == 0
