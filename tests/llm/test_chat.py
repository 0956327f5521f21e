import hashlib

from pyspark.sql import functions as F

from credsieve.llm import chat

CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string, extra int, tree int"
MESSAGES = "tree string, name bigint, node bigint, parent bigint, role string, text string, score double"
TRICKS = ["<|im_end|>", f"{chat.ESCAPE}1", f"<{chat.ESCAPE}|", f"{chat.ESCAPE}{chat.ESCAPE}0<|<|", "a\n\nb ", "", "😀 é\n", "\\|<", f"x{chat.ESCAPE}"]


def formatted(turns):
    def esc(t):
        return t.replace(chat.ESCAPE, chat.ESCAPE + "0").replace("<|", chat.ESCAPE + "1")

    return "".join(f"<|im_start|>{esc(r).replace(chr(10), chat.ESCAPE + '2')}\n{esc(t)}<|im_end|>\n" for r, t in turns)


def test_texts_come_back(spark):
    rows = [(c, t, ("user", "assistant", "sys\ntem<|")[(c + t) % 3], TRICKS[(c * 3 + t) % len(TRICKS)], 1, 2) for c in range(8) for t in range(1 + c)]
    rows += [(50, 1, None, None, 1, 2), (51, None, "assistant", "z", 1, 2), (51, 3, "assistant", "y", 1, 2), (None, 1, "user", "n", 1, 2), (None, 0, "assistant", "m", 1, 2)]
    rows += [(60, 5, "user", "same", 1, 2)] * 3 + [(61, 5, "user", "b", 1, 2), (61, 5, "assistant", "a", 1, 2)]
    frame = spark.createDataFrame(rows, CONVERSATIONS)
    got = {r.name: r for r in chat.read_back(chat.format_branches(chat.threads(frame))).collect()}
    expected = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] or "")):
        expected.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    assert set(got) == set(expected)
    for name, turns in expected.items():
        row = got[name]
        assert [(t.role, t.text) for t in row.turns] == turns
        assert row.formatted == formatted(turns)
        learned = [t for r, t in turns if r == "assistant"]
        assert row.loss_text == "".join(learned) and len(row.loss_mask) == len(learned)


def test_long_thread(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", f"t{i}", 0, 0) for i in range(300)]
    (row,) = chat.read_back(chat.format_branches(chat.threads(spark.createDataFrame(rows, CONVERSATIONS)))).collect()
    assert [t.text for t in row.turns] == [f"t{i}" for i in range(300)]
    assert hashlib.sha256(row.loss_text.encode()).hexdigest() == hashlib.sha256("".join(f"t{i}" for i in range(0, 300, 2)).encode()).hexdigest()


def test_trees(spark):
    rows = [
        ("a", 1, 1, None, "user", "root", 0.0),
        ("a", 1, 2, 1, "assistant", "good", 2.0),
        ("a", 1, 3, 1, "assistant", "bad", 1.0),
        ("a", 1, 4, 2, "user", "more", 0.0),
        ("a", 1, 5, 2, "user", "else", -5.0),
        ("b", 2, 1, 99, "user", "orphan", 0.0),
        ("c", 3, 1, 2, "user", "cycle", 0.0),
        ("c", 3, 2, 1, "user", "cycle", 0.0),
    ]
    messages = spark.createDataFrame(rows, MESSAGES)
    every = {(r.name, r.leaf): r for r in chat.read_back(chat.format_branches(messages)).collect()}
    assert {k: [t.text for t in r.turns] for k, r in every.items()} == {
        (1, 3): ["root", "bad"], (1, 4): ["root", "good", "more"], (1, 5): ["root", "good", "else"], (2, 1): ["orphan"],
    }
    best = chat.format_branches(messages, best=2).select("name", "leaf", "rank", "score").collect()
    assert sorted(map(tuple, best)) == [(1, 3, 2, 1.0), (1, 4, 1, 2.0), (2, 1, 1, 0.0)]


def test_no_rows(spark):
    empty = spark.createDataFrame([], CONVERSATIONS)
    assert chat.format_branches(chat.threads(empty)).count() == 0


def test_no_python_on_the_main_path(spark):
    frame = spark.createDataFrame([(1, 0, "user", "x", 0, 0)], CONVERSATIONS)
    plan = chat.read_back(chat.format_branches(chat.threads(frame)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and F.lit(1) is not None
