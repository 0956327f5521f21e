"""Personal data: base patterns, and identifiers that only their context gives away.

Base spans of four kinds are found by fixed patterns. They seed a bootstrap: the words around them
are lexical patterns, and patterns and identifiers (base spans and other number- or mail-like tokens)
form a graph. A pattern's confidence in a kind is the mean score of its distinct identifiers, where those
nothing is known about yet weigh little: they are what is looked for. An
identifier's score is one minus the chance that all its confident patterns err; seeds keep score 1 for
their kind. After some rounds, unseen identifiers of a high score are added as spans of that kind.

Other identifiers are single tokens, and runs of neighbouring tokens of digits with the separators of the
fixed patterns. Where a run is added, tokens within it are not added again.

Patterns are the two words before, the word before with the word after, and the two words after.
One needs several distinct seeds and must be confident, so chance neighbours add nothing.

Defined cases: null and empty texts hold nothing; texts are searched whole; repeated rows each get
their spans; an identifier that two kinds could claim goes to the better score, then to the kind
listed first; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credsieve.llm.common import annotated, staged

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
#: Distinct seeds that a pattern needs, and its least confidence.
MIN_SEEDS = 5
MIN_CONFIDENCE = 0.8
#: Identifiers without any evidence that a pattern is taken to have seen.
DOUBT = 1.0
#: Weight of an identifier that is no seed and has no score yet.
UNKNOWN = 0.1
MIN_SCORE = 0.9
#: Digits that a token or a run of them needs to be looked at as an identifier, and the most of a run:
#: no kind has more. Of longer runs only the single tokens are looked at.
MIN_DIGITS = 6
MAX_RUN_DIGITS = 19

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_TOKEN = re.compile(r"\S+")
#: First, further and last tokens of a run of digits: what stands before, digits, and what ends the run.
_RUN_FIRST = re.compile(r"(?:[^0-9\s]*[:=])?[\"'`<\[{(+]*[0-9][0-9().-]*")
_RUN_NEXT = re.compile(r"[0-9().-]+")
_RUN_END = re.compile(r"[\"'`,;:!?\]}>]*")
_EDGES = "\"'`.,;:!?()[]{}<>"


def _emails(text: str) -> list[tuple[int, int]]:
    """The part before an @ is the run of its characters; no other start needs trying."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            found.append((start, match.end()))
            free = match.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(free, at + 1))
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        value = int(c) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed and then by start."""
    spans = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return spans
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            spans.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            spans.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_DIGIT.findall(m.group())) <= 15:
                spans.append(("phone", *m.span()))
    return spans


def _lexical(token: str) -> str:
    return _DIGIT.sub("0", token.lower())


def _runs(text: str, tokens: list[tuple[int, int]], taken: set[int]) -> list[tuple[int, int, int, int]]:
    """(start, end, first token, last token) of runs of two or more tokens of digits, as long as they go."""
    runs, i = [], 0
    while i < len(tokens):
        first, match = i, None if i in taken else _RUN_FIRST.match(text, *tokens[i])
        i += 1
        while match:
            if match.end() < tokens[i - 1][1]:  # only what closes it may follow
                if not _RUN_END.fullmatch(text, match.end(), tokens[i - 1][1]):
                    i -= 1  # not of the run, but another may begin here
                break
            if i == len(tokens) or i in taken or text[tokens[i - 1][1] : tokens[i][0]].strip(" "):
                break
            match = _RUN_NEXT.match(text, *tokens[i])
            i += bool(match)
        last = i - 1
        while last > first and not _DIGIT.search(text, *tokens[last]):
            last -= 1
        if last > first:
            start = _DIGIT.search(text, tokens[first][0]).start()
            end = max(m.end() for m in _DIGIT.finditer(text, *tokens[last]))
            if text.count(")", start, end) > text.count("(", start, end) and text[start - 1 : start] == "(":
                start -= 1
            if text[start - 1 : start] == "+" and start > tokens[first][0]:
                start -= 1
            if MIN_DIGITS <= len(_DIGIT.findall(text, start, end)) <= MAX_RUN_DIGITS:
                runs.append((start, end, first, last))
        i = max(i, first + 1)
    return runs


def occurrences(text: str, spans: list[tuple[str, int, int]]) -> list[dict]:
    """Base spans and other identifiers of a text with the patterns around them."""
    if not spans and not _DIGIT.search(text) and "@" not in text:
        return []
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    begins = [a for a, _ in tokens]
    ends = [b for _, b in tokens]
    taken = set()
    found = []

    def add(kind: str | None, start: int, end: int, first: int, last: int, run: int | None = None) -> None:
        word = lambda i: _lexical(text[slice(*tokens[i])]) if 0 <= i < len(tokens) else "^"
        before, after = word(first - 1), word(last + 1)
        found.append(
            {
                "kind": kind, "start": start, "end": end, "value": text[start:end], "run": start if run is None else run,
                "patterns": [f"{word(first - 2)} {before} _", f"{before} _ {after}", f"_ {after} {word(last + 2)}"],
            }
        )

    for kind, start, end in spans:
        first = bisect_left(ends, start + 1)
        last = bisect_left(begins, end) - 1
        taken.update(range(first, last + 1))
        add(kind, start, end, first, last)
    within = {}
    for start, end, first, last in _runs(text, tokens, taken):
        within.update(dict.fromkeys(range(first, last + 1), start))
        add(None, start, end, first, last)
    for i, (a, b) in enumerate(tokens):
        token = text[a:b]
        if i in taken or ("@" not in token and len(_DIGIT.findall(token)) < MIN_DIGITS):
            continue
        core = token.strip(_EDGES)
        if core:
            start = a + token.index(core)
            add(None, start, start + len(core), i, i, within.get(i))
    return found


SCHEMA = (
    "base array<struct<kind: string, start: bigint, end: bigint>>, found array<struct<kind: string, "
    "start: bigint, end: bigint, value: string, run: bigint, patterns: array<string>>>"
)


def _find(columns: list[pa.Array]) -> list[pa.Array]:
    base, found = [], []
    for text in columns[0].to_pylist():
        text = text or ""
        spans = base_spans(text)
        base.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
        found.append(occurrences(text, spans))
    span = [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]
    more = [("value", pa.string()), ("run", pa.int64()), ("patterns", pa.list_(pa.string()))]
    return [
        pa.array(base, pa.list_(pa.struct(span))),
        pa.array(found, pa.list_(pa.struct([*span, *more]))),
    ]


def bootstrap(mentions: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(value, kind, score) of unseen identifiers, from mentions of (kind or null, value, patterns).

    The graph has one edge per distinct pattern and identifier, so copies of a text weigh once.
    """
    edges = staged(
        mentions.select("kind", "value", F.explode(F.array_distinct("patterns")).alias("pattern")).distinct()
    )
    each = edges.groupBy("pattern", "value").agg(F.max(F.col("kind").isNotNull().cast("int")).alias("labelled"))
    sizes = each.groupBy("pattern").agg(F.sum("labelled").alias("n_labelled"), F.count("*").alias("n"))
    unseen = each.filter("labelled = 0").select("pattern", "value")
    supported = (
        edges.filter("kind IS NOT NULL")
        .groupBy("pattern", "kind")
        .agg(F.count("*").alias("n_seeds"))
        .filter(F.col("n_seeds") >= MIN_SEEDS)
        .join(sizes, "pattern")
        .select("pattern", "kind", "n_seeds", "n_labelled", "n")
    )
    supported = staged(supported)
    reached = staged(unseen.join(supported.select("pattern", "kind"), "pattern"))
    scores = None
    for _ in range(rounds):
        evidence = weighed = F.lit(0.0)
        graded = supported
        if scores is not None:
            gained = reached.join(scores, ["value", "kind"]).groupBy("pattern", "kind").agg(F.sum("score").alias("gained"))
            scored = reached.select("pattern", "value").distinct().join(scores.select("value").distinct(), "value")
            scored = scored.groupBy("pattern").agg(F.count("*").alias("n_scored"))
            graded = graded.join(gained, ["pattern", "kind"], "left").join(scored, "pattern", "left")
            evidence, weighed = F.coalesce("gained", F.lit(0.0)), F.coalesce("n_scored", F.lit(0))
        known = F.col("n_labelled") + weighed
        confidence = (F.col("n_seeds") + evidence) / (known + UNKNOWN * (F.col("n") - known) + DOUBT)
        graded = graded.select("pattern", "kind", confidence.alias("confidence")).filter(F.col("confidence") >= MIN_CONFIDENCE)
        doubt = F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("confidence"))))
        scores = staged(
            reached.join(graded, ["pattern", "kind"])
            .groupBy("value", "kind")
            .agg((1 - F.exp(doubt)).alias("score"))
        )
    best = F.max_by(F.struct("kind", "score"), F.struct("score", -F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))))
    return (
        scores.filter(F.col("score") >= MIN_SCORE)
        .groupBy("value")
        .agg(best.alias("best"))
        .select("value", "best.kind", "best.score")
    )


def _joined(spans):
    """kind:start:end by kind as listed, then by start."""
    order = F.array(*map(F.lit, KINDS))
    ranked = F.array_sort(F.transform(spans, lambda s: F.struct(F.array_position(order, s["kind"]), s["start"], s["end"], s["kind"])))
    return F.array_join(F.transform(ranked, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id with ``base`` and ``added`` spans, and both joined as text."""
    found = annotated(docs, _find, SCHEMA, ["text"], ["doc_id"])
    rows = staged(found.select("row.doc_id", F.monotonically_increasing_id().alias("row_id"), "base", "found"))
    mentions = rows.select("row_id", F.explode("found").alias("m")).select("row_id", "m.*")
    known = bootstrap(mentions)
    added = (
        mentions.filter("kind IS NULL")
        .select("row_id", "value", "run", "start", "end")
        .join(known, "value")
        .groupBy("row_id", "run")  # a run and the few tokens of it
        .agg(F.collect_list(F.struct("kind", "start", "end")).alias("spans"))
    )
    inside = lambda s, t: (t["start"] <= s["start"]) & (s["end"] <= t["end"]) & (t["end"] - t["start"] > s["end"] - s["start"])
    widest = F.filter("spans", lambda s: ~F.exists("spans", lambda t: inside(s, t)))
    added = added.select("row_id", widest.alias("spans")).groupBy("row_id").agg(F.flatten(F.collect_list("spans")).alias("added"))
    none = F.array().cast("array<struct<kind: string, start: bigint, end: bigint>>")
    result = rows.join(added, "row_id", "left").withColumn("added", F.coalesce("added", none))
    return result.select(
        "doc_id", "base", "added",
        _joined("base").alias("base_text"),
        _joined(F.concat("base", "added")).alias("all_text"),
    )
