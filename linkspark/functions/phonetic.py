"""Phonetic codes of words in the manner of Double Metaphone: a primary code, and an alternate where a spelling has two usual sounds.

The rules are a table of patterns tried in order at each place of a word.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY = "EMPTY"
#: (pattern at the place, pattern that the text before must end with or None, primary, alternate)
RULES: list[tuple[str, str | None, str, str]] = [
    (r"(GN|KN|PN|WR|PS)", r"^$", "", ""),
    (r"X", r"^$", "S", "S"),
    (r"[AEIOUY]+", r"^$", "A", "A"),
    (r"[AEIOUY]+", None, "", ""),
    (r"BB?", None, "P", "P"),
    (r"CH(?=[AEO]R|IA)", None, "K", "K"),
    (r"CH", r"^M$", "K", "K"),
    (r"SCH", None, "X", "SK"),
    (r"CH", None, "X", "K"),
    (r"CZ", None, "S", "X"),
    (r"CC(?=[IEH])", None, "KS", "X"),
    (r"CI[AO]", None, "X", "S"),
    (r"C[IEY]", None, "S", "S"),
    (r"C[CKGQ]?", None, "K", "K"),
    (r"DG(?=[IEY])", None, "J", "J"),
    (r"D[TD]?", None, "T", "T"),
    (r"FF?", None, "F", "F"),
    (r"GH(?=[AEIOU])", r"^$", "K", "K"),
    (r"GH", r"[AEIOU]U$", "F", "F"),
    (r"GH", None, "", ""),
    (r"GN", None, "N", "KN"),
    (r"GG?(?=[IEY])", None, "J", "K"),
    (r"GG?", None, "K", "K"),
    (r"H(?=[AEIOUY])", r"(^|[AEIOUY])$", "H", "H"),
    (r"H", None, "", ""),
    (r"JJ?", None, "J", "A"),
    (r"KK?", None, "K", "K"),
    (r"LL?", None, "L", "L"),
    (r"MB$", None, "M", "M"),
    (r"MM?", None, "M", "M"),
    (r"NN?", None, "N", "N"),
    (r"PH", None, "F", "F"),
    (r"P[PB]?", None, "P", "P"),
    (r"QQ?", None, "K", "K"),
    (r"RR?", None, "R", "R"),
    (r"SH", None, "X", "X"),
    (r"SI[OA]", None, "S", "X"),
    (r"SC(?=[IEY])", None, "S", "S"),
    (r"S[SZ]?", None, "S", "S"),
    (r"TI[OA]", None, "X", "X"),
    (r"TCH", None, "X", "X"),
    (r"TH(?=OM|AM)", None, "T", "T"),
    (r"TH", None, "0", "T"),
    (r"T[TD]?", None, "T", "T"),
    (r"VV?", None, "F", "F"),
    (r"W(?=[AEIOUY])", r"^$", "A", "F"),
    (r"W", None, "", ""),
    (r"X", None, "KS", "KS"),
    (r"ZH", None, "J", "J"),
    (r"ZZ?", None, "S", "TS"),
]
_COMPILED = [(re.compile(a), re.compile(b) if b else None, p, q) for a, b, p, q in RULES]


def codes(word: str) -> tuple[str, str]:
    """Primary and alternate code of a word, at most four letters each."""
    text = re.sub(r"[^A-Z]", "", word.upper())
    at, one, two = 0, "", ""
    while at < len(text) and min(len(one), len(two)) < 4:
        for pattern, before, p, q in _COMPILED:
            found = pattern.match(text, at)
            if found and found.end() > at and (before is None or before.search(text[:at])):
                one, two, at = one + p, two + q, found.end()
                if p == "" and q == "" and before is not None and before.pattern == "^$":
                    one, two = one + text[at - 1].replace("W", "").replace("R", "R"), two + text[at - 1].replace("W", "")
                break
        else:
            at += 1
    return one[:4], two[:4]


def phonetic(column: Column, max_words: int = 10) -> Column:
    """Codes of the first words of a text: each word's primary code, and its alternate if that differs; a word without a code stays."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        seen: dict[str, str] = {}

        def code(word: str) -> str:
            if word not in seen:
                one, two = codes(word)
                seen[word] = " ".join(dict.fromkeys(x for x in (one, two) if x)) or word
            return seen[word]

        return texts.map(lambda x: " ".join(code(w) for w in (x or "").split()[:max_words]) or EMPTY)

    return run(column)
