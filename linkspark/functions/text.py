"""Name normalisation as chains of built-in expressions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words that stand for others, and legal suffixes.
REPLACEMENTS = {"svc": "service", "svcs": "services", "equip": "equipment", "mfg": "manufacturing", "dist": "distribution"}
SUFFIXES = ["inc", "incorporated", "llc", "l l c", "limited liability company", "lp", "l p", "llp", "l l p", "ltd", "limited", "corp", "corporation", "co", "company", "plc", "pc", "pllc", "group", "holding", "holdings", "associates", "partners", "sons", "dba", "fka", "aka", "c o", "o b o"]
#: What introduces the name that a business goes by.
QUALIFIER = r"(?:^|.*?[^a-z0-9])(?:d[/.\-\s]*b[/.\-\s]*a|f[/.\-\s]*k[/.\-\s]*a|a[/.\-\s]*k[/.\-\s]*a|t[/.\-\s]*a(?:[^a-z0-9]|$)|formerly|now\s+known\s+as|trading\s+as|doing\s+business\s+as)[\s:]+(.+?)$"
UNKNOWN = "unknown_entity"
#: What characters become after compatibility composition, by what they become.
FOLDED = {
    "/": "\u2044\u2215\u00f7", "x": "\u00d7\u02e3", "-": "\u2212\u2010\u2011\u2012\u2013\u2014\u2015\u2043\u2022\u2023\u2027", ".": "\u2219\u2024", "o": "\u2218\u00ba", "a": "\u00aa", "s": "\u02e2",
    "...": "\u2026", "..": "\u2025", "+-": "\u00b1", "~": "\u2248\u2053", "!=": "\u2260", "<=": "\u2264", ">=": "\u2265", "!": "\u00ac", "|": "\u00a6", "*": "\u203b", "!!": "\u203c", "?!": "\u203d\u2048", "??": "\u2047", "!?": "\u2049", "%": "\u2052",
    "'": "\u2018\u2019\u201a\u201b\u2032\u2035\u2039\u203a", '"': "\u201c\u201d\u201e\u201f\u2033\u2036\u00ab\u00bb", "'''": "\u2034\u2037",
    " ": "\u00b7\t\n\r\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000\u2028\u2029",
    "": "\u00ae\u2122\u00a9\u2120\u00b0\u02da\u00a2\u00a3\u00a4\u00a5\u20ac\u2030\u2031\u221e\u00ad\u200b\u200c\u200d\u2060\u180e\ufeff\u034f\u061c\u115f\u1160\u17b4\u17b5\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069\u206a\u206b\u206c\u206d\u206e\u206f\u00a7\u00b6\u2020\u2021\u204b\u204c\u204d",
}

#: Patterns of the steps of normalisation.
LETTERS = [(r"(^|[^a-z0-9])triple\s+([a-z])($|[^a-z0-9])", r"\1\2\2\2\3"), (r"(^|[^a-z0-9])double\s+([a-z])($|[^a-z0-9])", r"\1\2\2\3")]
SYMBOLS = [(r"&+", " and "), (r"\++", " and "), (r"[/|·•]", " "), (r"[–—-]+", " ")]
ASIDES = [(r"\([^)]*\)", " "), (r"\[[^\]]*\]", " ")]
MISREAD = [(r"([a-z])0([a-z])", r"\1o\2"), (r"([a-z])1([a-z])", r"\1l\2")]
CLEAN = [(r"'s(?:$|[^a-z0-9])", " "), (r"[^\p{L}\p{N}_\s]", " "), (r"\s+", " ")]


def replacement_steps(words: dict[str, str] = REPLACEMENTS) -> list[tuple[str, str]]:
    return [(rf"(^|[^a-z0-9]){re.escape(a)}($|[^a-z0-9])", rf"\1{b}\2") for a, b in words.items()]


def suffix_step(suffixes: list[str] = SUFFIXES) -> list[tuple[str, str]]:
    """All suffixes at the end of a name at once, longest first: the fixpoint of taking them one by one."""
    names = "|".join(re.escape(x).replace(r"\ ", " ") for x in sorted(suffixes, key=len, reverse=True))
    return [(rf"(?:(?:^|[^a-z0-9])(?:{names})\W*)+$", " ")]


def replaced(column: Column, steps: list[tuple[str, str]]) -> Column:
    for pattern, by in steps:
        column = F.regexp_replace(column, pattern, re.sub(r"\\(\d)", r"$\1", by))
    return column


def qualified(column: Column) -> Column:
    """What follows a qualifier such as "doing business as", else the text itself."""
    found = F.regexp_extract(column, QUALIFIER, 1)
    return F.when(found == "", column).otherwise(found)


def strip_suffixes(column: Column, suffixes: list[str] = SUFFIXES) -> Column:
    return F.trim(replaced(column, suffix_step(suffixes)))


def cleaned(column: Column) -> Column:
    return F.trim(replaced(column, CLEAN))


def normalize_name(column: Column, words: dict[str, str] = REPLACEMENTS, suffixes: list[str] = SUFFIXES) -> Column:
    """A name in normal form; names that vanish fall back to the cleaned text, empty ones to `UNKNOWN`."""
    low = F.lower(F.coalesce(column, F.lit("")))
    out = replaced(low, LETTERS + replacement_steps(words))
    out = replaced(qualified(out), SYMBOLS + ASIDES + MISREAD)
    out = cleaned(replaced(out, suffix_step(suffixes)))
    out = F.when(F.length(out) < 2, cleaned(low)).otherwise(out)
    return F.when(out == "", UNKNOWN).otherwise(out)


def with_normal_name(df: DataFrame, source: str, target: str, words: dict[str, str] = REPLACEMENTS, suffixes: list[str] = SUFFIXES) -> DataFrame:
    """df with the normal form of a name, folded first.  Each step that is used again is a column of its own, so it is computed once."""
    names = [F.col(f"`{c}`") for c in df.columns if c != target]
    low = df.withColumn("_low", F.lower(F.coalesce(folded(F.col(f"`{source}`")), F.lit(""))))
    step = low.withColumn("_a", replaced(F.col("_low"), LETTERS + replacement_steps(words)))
    step = step.withColumn("_q", F.regexp_extract("_a", QUALIFIER, 1))
    step = step.withColumn("_b", replaced(F.when(F.col("_q") == "", F.col("_a")).otherwise(F.col("_q")), SYMBOLS + ASIDES + MISREAD))
    step = step.withColumn("_c", cleaned(replaced(F.col("_b"), suffix_step(suffixes))))
    step = step.withColumn("_d", F.when(F.length("_c") < 2, cleaned(F.col("_low"))).otherwise(F.col("_c")))
    return step.select(*names, F.when(F.col("_d") == "", UNKNOWN).otherwise(F.col("_d")).alias(target))


def without_overlap(words: dict[str, str] = REPLACEMENTS, suffixes: list[str] = SUFFIXES) -> tuple[dict[str, str], list[str]]:
    """Replacements and suffixes such that no word is both: a replacement wins over a suffix."""
    own = {w.lower().strip() for w in words}
    return words, [x for x in suffixes if x.lower().strip() not in own]


TABLE = str.maketrans({c: to for to, chars in FOLDED.items() for c in chars})


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", x).split()))


@F.pandas_udf(StringType())
def _folded(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", x).translate(TABLE).split()))


def _beyond_ascii(column: Column, f) -> Column:
    """Single spaces; f where there is more than plain ASCII, which doesn't leave the JVM."""
    plain = column.rlike("^[ -~]*$")
    return F.when(plain, F.trim(F.regexp_replace(column, r"\s+", " "))).otherwise(f(F.when(~plain, column)))


def nfkc(column: Column) -> Column:
    """Compatibility composition and single spaces; nulls stay."""
    return _beyond_ascii(column, _nfkc)


def folded(column: Column) -> Column:
    """Compatibility composition, then signs, spaces and marks as plain characters (`FOLDED`), then single spaces; nulls stay."""
    return _beyond_ascii(column, _folded)
