"""Texts and names that several test modules use."""

import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
CLASHING = ("row", "size", "n", "sig", "shard", "key", "place", "n_words", "weight", "position", "text_hash")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
COMMON = "the of and a in quick brown fox jumps over lazy dog ça été größe".split()
WORDS = [a + b for a in ("ra", "to", "mi", "su", "ke", "Lo") for b in ("ne", "ti", "sa", "ru", "ßo", "pa,")]


def spaced_words(text):
    return SPACED.findall((text or "").translate(LOWER))


def sentence(rnd, n):
    return " ".join(rnd.choice(COMMON if i % 7 == 0 else WORDS) for i in range(n))
