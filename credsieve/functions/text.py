"""Column functions over text: paths, lines, masking, character classes, entropy, n-grams."""

from __future__ import annotations

import sys
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from credsieve import settings

# White space as Python's str.isspace sees it.
SPACE_CLASS = r"\s\x1c-\x1f"


def base_name(path: Column) -> Column:
    """The part of a path after its last slash."""
    return F.substring_index(path, "/", -1)


def extension(name: Column) -> Column:
    """Lower-cased last suffix with its dot; '' for dot-files and names without one."""
    return F.lower(F.regexp_extract(name, r"(?s)^\.*[^.].*(\.[^.]*)$", 1))


def relative_path(path: Column, root: Column | str = "") -> Column:
    """Path below ``root`` with forward slashes and no leading slash."""
    prefix = F.lit(root) if isinstance(root, str) else root
    below = F.when(
        path.startswith(prefix), F.substring(path, F.length(prefix) + 1, F.length(path))
    ).otherwise(path)
    return F.ltrim(F.replace(below, F.lit("\\"), F.lit("/")), F.lit("/"))


def strip(text: Column) -> Column:
    """Text without leading and trailing white space of any Unicode kind."""
    return F.regexp_replace(text, rf"(?U)\A[{SPACE_CLASS}]+|[{SPACE_CLASS}]+\z", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(rf"(?U)[^{SPACE_CLASS}]")


def mask(text: Column, shown: int = 4) -> Column:
    """Keep the first characters and star the rest; shorter texts are starred whole."""
    length = F.length(text)
    return F.when(length < shown, F.repeat(F.lit("*"), length)).otherwise(
        F.concat(F.substring(text, 1, shown), F.repeat(F.lit("*"), length - shown))
    )


def contains_any(text: Column, literals) -> Column:
    """Whether text holds at least one of the literals."""
    found = F.lit(False)
    for literal in literals:
        found = found | F.contains(text, F.lit(literal))
    return found


@lru_cache
def _digit_class() -> str:
    """Members of a Java class for str.isdigit: decimals plus the runs of other digit characters."""
    runs: list[list[int]] = []
    for point in range(sys.maxunicode + 1):
        if chr(point).isdigit() and not chr(point).isdecimal():
            if runs and runs[-1][1] == point - 1:
                runs[-1][1] = point
            else:
                runs.append([point, point])
    return r"\p{Nd}" + "".join(rf"\x{{{first:x}}}-\x{{{last:x}}}" for first, last in runs)


def has_digit(text: Column) -> Column:
    """The class of all digits is slow to test, so it only sees texts with other characters."""
    beyond_ascii = F.octet_length(text) != F.length(text)
    return text.rlike("[0-9]") | (beyond_ascii & text.rlike(f"[{_digit_class()}]"))


def has_upper(text: Column) -> Column:
    return text.rlike(r"\p{IsUppercase}")


def has_lower(text: Column) -> Column:
    return text.rlike(r"\p{IsLowercase}")


def has_special(text: Column) -> Column:
    """A character that is neither alphanumeric nor white space."""
    return text.rlike(rf"(?U)[^\p{{L}}\p{{N}}{SPACE_CLASS}]")


def is_alphanumeric(text: Column) -> Column:
    return text.rlike(r"\A[\p{L}\p{N}]+\z")


def prefix_hits(text: Column, prefixes=settings.KEY_PREFIXES) -> Column:
    """The prefixes the text starts with, ignoring case, as an array."""
    low = F.lower(text)
    return F.array_compact(
        F.array(*[F.when(low.startswith(prefix), F.lit(prefix)) for prefix in prefixes])
    )


def quality_flags(text: Column, min_length: int = settings.MIN_SAMPLE_LENGTH,
                  max_length: int = settings.MAX_SAMPLE_LENGTH) -> dict[str, Column]:
    """The checks a training sample can fail, by name."""
    filled = text != ""
    return {
        "empty_strings": ~filled,
        "too_short": filled & (F.length(text) < min_length),
        "too_long": F.length(text) > max_length,
        "whitespace_only": filled & is_blank(text),
        "non_printable_chars": text.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"),
        "potential_test_data": contains_any(F.lower(text), settings.TEST_WORDS),
    }


def shannon_entropy(text: Column) -> Column:
    """Entropy in bits per character.

    Sorting the characters turns equal ones into runs, so the cost is that of a sort rather than
    of comparing every character with every distinct one.
    """
    ordered = F.array_join(F.sort_array(F.split(text, "")), "")
    runs = F.regexp_extract_all(ordered, F.lit(r"(?s)(.)\1*+"), F.lit(0))
    size = F.length(text).cast("double")
    return F.when(text == "", F.lit(0.0)).otherwise(
        F.aggregate(
            F.transform(runs, lambda run: F.length(run) / size),
            F.lit(0.0),
            lambda total, share: total - share * F.log2(share),
        )
    )


def words_sql(column: str) -> str:
    """SQL for the words of a column in lower case, between single spaces."""
    return rf"trim(regexp_replace(lower({column}), r'(?U)[{SPACE_CLASS}]+', ' '))"


def char_ngrams_sql(column: str, smallest: int = 3, largest: int = 5) -> str:
    """SQL for the character n-grams of a column, see ``char_ngrams``."""
    words = words_sql(column)
    grams = ", ".join(
        rf"regexp_extract_all(concat(' ', {words}, ' '), "
        rf"r'(?s)(?=([^\x{{dc00}}-\x{{dfff}}][^ ]{{{n - 2}}}.))', 1)"
        for n in range(smallest, largest + 1)
    )
    return f"flatten(array({grams}))"


def char_ngrams(column: str, smallest: int = 3, largest: int = 5) -> Column:
    """Character n-grams inside word boundaries, each word padded with one space on each side.

    With single spaces between the words, an n-gram lies inside one padded word exactly when all
    but its first and last characters are non-blank. One look-ahead pass per n finds them all; the
    first character must not be the second half of a surrogate pair.
    """
    return F.expr(char_ngrams_sql(column, smallest, largest))
