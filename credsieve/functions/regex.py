"""Python regular expressions in the dialect Spark understands."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

try:  # the parser of the standard library, by its name since Python 3.11
    from re import _parser as _sre
except ImportError:
    import sre_parse as _sre

#: Texts up to this length never exhaust the stack of a task, whatever the pattern.
SHORT_TEXT = 1000
#: Seconds that one pattern may take on one text outside the JVM.
MATCH_SECONDS = 2.0

# What Python calls a word character and white space, as members of a Java class.
_WORD = r"\p{L}\p{N}_"
_SPACE = r"\s\x1c-\x1f"
_SHORTHAND = {
    "w": (f"[{_WORD}]", _WORD),
    "W": (f"[^{_WORD}]", f"[^{_WORD}]"),
    "s": (f"[{_SPACE}]", _SPACE),
    "S": (f"[^{_SPACE}]", f"[^{_SPACE}]"),
    "Z": (r"\z", None),
}

# (pattern outside a class, Java form); each is valid Python that Java reads differently.
_GROUP_SYNTAX = (
    (re.compile(r"\(\?P<(\w+)>"), r"(?<\1>"),
    (re.compile(r"\(\?P=(\w+)\)"), r"\\k<\1>"),
    (re.compile(r"\{,(\d+)\}"), r"{0,\1}"),
)

_UPPER_RANGE = re.compile(r"[A-Z]-[A-Z]")


def to_java(pattern: str, ignore_case: bool = False) -> str:
    """Translate a Python pattern so that Java finds the same text.

    ``(?d)`` makes ``.`` stop at ``\\n`` only and ``(?U)`` makes ``\\d`` Unicode-aware, as in
    Python. Inside a class a bare ``[`` and ``&&`` are literal in Python but operators in Java.
    """
    out: list[str] = []
    i, in_class = 0, False
    while i < len(pattern):
        char = pattern[i]
        if char == "\\" and i + 1 < len(pattern):
            forms = _SHORTHAND.get(pattern[i + 1])
            form = forms[1 if in_class else 0] if forms else None
            out.append(form or pattern[i : i + 2])
            i += 2
        elif in_class and ignore_case and _UPPER_RANGE.match(pattern, i):
            # Python also compares the lower-case form of a character with such a range.
            upper = pattern[i : i + 3]
            out.append(upper + upper.lower())
            i += 3
        elif in_class:
            if char == "]":
                in_class = False
            out.append("\\" + char if char in "[&" else char)
            i += 1
        elif char == "[":
            # A "]" that opens the class, negated or not, is a member of it.
            opening = re.compile(r"\[\^?\]?").match(pattern, i).group()
            out.append(opening.replace("]", "\\]"))
            in_class = True
            i += len(opening)
        else:
            for syntax, java in _GROUP_SYNTAX:
                found = syntax.match(pattern, i)
                if found:
                    out.append(found.expand(java))
                    i = found.end()
                    break
            else:
                out.append(char)
                i += 1
    return ("(?iudU)" if ignore_case else "(?dU)") + "".join(out)


def compile_problem(pattern: str) -> str | None:
    """Why a pattern is not a valid regular expression, or None."""
    try:
        re.compile(pattern)
    except re.error as error:
        return str(error)
    return None


@lru_cache(maxsize=1024)
def danger(pattern: str) -> str | None:
    """What the pattern can do to a task: ``deep``, ``nested`` or nothing.

    Java matches a repeated group of parts that differ in length, or of alternatives, by recursion, one level per
    repetition: on a long text such a ``deep`` pattern overflows the stack, which Spark takes for the end of the
    executor. A repeat of unbounded repeats (``nested``) can try exponentially many ways on a text of any length.
    """
    found = set()

    def simple(items) -> bool:
        """One character of any kind, which Java repeats in a loop."""
        return len(items) == 1 and str(items[0][0]) in ("LITERAL", "NOT_LITERAL", "IN", "ANY", "CATEGORY")

    def walk(items, inside: bool) -> None:
        for op, value in items:
            name = str(op)
            if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
                _, most, body = value
                unbounded = most is _sre.MAXREPEAT or most > SHORT_TEXT
                if unbounded and inside:
                    found.add("nested")
                if unbounded and not simple(body):
                    found.add("deep")
                walk(body, inside or (unbounded and not simple(body)))
            elif name == "SUBPATTERN":
                walk(value[-1], inside)
            elif name == "BRANCH":
                for branch in value[1]:
                    walk(branch, inside)
            elif name in ("ASSERT", "ASSERT_NOT"):
                walk(value[1], inside)
            elif name == "ATOMIC_GROUP":
                walk(value, inside)
            elif name == "GROUPREF_EXISTS":
                for branch in value[1:]:
                    walk(branch or [], inside)

    try:
        walk(_sre.parse(pattern), False)
    except re.error:
        return None
    return "nested" if "nested" in found else "deep" if found else None


def needs_guard(pattern: str, text: Column) -> Column:
    """Whether the pattern must not meet this text inside the JVM."""
    kind = danger(pattern)
    if kind is None:
        return F.lit(False)
    return F.lit(True) if kind == "nested" else F.length(text) > SHORT_TEXT


def guarded_search(pattern: str, text: Column, ignore_case: bool = False) -> Column:
    """The first match outside the JVM, as (found, problem): an engine without a stack to overflow, stopped after
    ``MATCH_SECONDS``. Null texts cost next to nothing, so pass only those that need it."""
    seconds = MATCH_SECONDS

    @F.pandas_udf("found string, problem string")
    def search(texts: pd.Series) -> pd.DataFrame:
        import regex

        rows = []
        compiled = regex.compile(pattern, regex.IGNORECASE if ignore_case else 0)
        for value in texts:
            found, problem = None, None
            if value is not None:
                try:
                    match = compiled.search(value, timeout=seconds)
                    found = match.group() if match else None
                except TimeoutError:
                    problem = f"no answer after {seconds} seconds"
                except (MemoryError, RecursionError, regex.error) as error:
                    problem = type(error).__name__
            rows.append((found, problem))
        return pd.DataFrame(rows, columns=["found", "problem"])

    return search(text)
