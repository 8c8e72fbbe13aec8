"""Quality rules: tokeniser fertility with rejection bands per script, and plain base rules.

A public vocabulary with byte fallback splits each word of a text.  Its tokens give
  chars_per_token   code points in words / tokens
  fallback_share    tokens that stand for single bytes / tokens
  token_entropy     bits, of the text's token distribution
A text is kept if it passes the base rules and all three lie in the band of the
script that most of its letters belong to.  As n tokens hold log2(n) bits at most, a
short text need only have a share of these where that is less than the band's entropy.  The bands are parameters; the defaults
are wide enough for written prose and turn away symbol runs, encoded data,
scripts that the vocabulary can't read and texts that say little again and again.

White space is left out: each word is encoded on its own, as the vocabulary's pieces
never reach across white space.

Defined results: a null or empty text has no words, fails the base rules and has null
for the three measures; every input row gives one row, repeated ones too; an empty
table gives no rows; other columns of the input are carried along by `filter_kept`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.llm import common

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "[#*$%&|<>]"
#: Share of log2(tokens) that is enough entropy for a short text.
ENTROPY_SHARE = 0.72
#: script: least and most characters per token, most fallback share, least token entropy in bits
BANDS: dict[str, tuple[float, float, float, float]] = {
    "latin": (1.6, 8.0, 0.10, 5.4),
    "greek": (0.8, 8.0, 0.30, 4.5),
    "cyrillic": (1.0, 8.0, 0.10, 5.0),
    "arabic": (0.7, 8.0, 0.30, 4.0),
    "cjk": (0.4, 4.0, 0.90, 4.5),
    "other": (0.2, 8.0, 1.00, 4.0),
}
SCRIPTS = list(BANDS)
#: First code points of ranges, and their script (index in SCRIPTS, -1: no letters).
RANGES = [(0x41, 0), (0x5B, -1), (0x61, 0), (0x7B, -1), (0xC0, 0), (0xD7, -1), (0xD8, 0), (0xF7, -1), (0xF8, 0), (0x250, 5), (0x2B0, -1), (0x370, 1), (0x400, 2), (0x530, 5), (0x600, 3), (0x700, 5), (0x750, 3), (0x780, 5), (0x1E00, 0), (0x1F00, 1), (0x2000, -1), (0x2C00, 5), (0x2E00, -1), (0x3040, 4), (0xA000, 5), (0xAC00, 4), (0xD7B0, -1), (0xF900, 4), (0xFB00, 5), (0xFE00, -1), (0xFF66, 4), (0xFFA0, -1), (0x10000, 5), (0x1F000, -1), (0x20000, 4), (0x32000, -1)]
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, fallback_share double, token_entropy double, script string"


class Fertility:
    """Tokens of distinct words by a sentencepiece vocabulary."""

    def __init__(self, path: str):
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.pieces.get_piece_size()
        self.fallback = np.array([self.pieces.is_byte(i) or self.pieces.is_unknown(i) for i in range(self.size)])

    def __call__(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return common.compact(self.pieces.encode(names.to_pylist(), num_threads=1))


def repeated(starts: np.ndarray, ids: np.ndarray, n_ids: int) -> np.ndarray:
    """Flags of words in 3-word windows that their text has twice or more."""
    out = np.zeros(len(ids), bool)
    if len(ids) < 3:
        return out
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    first = np.flatnonzero(row[2:] == row[:-2])
    wide = ids.astype(np.int64)
    pairs = wide[:-1] * n_ids + wide[1:]
    if n_ids > 1 << 20:  # three ids don't fit into 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[first] * n_ids + wide[first + 2]
    order = np.argsort(windows, kind="stable")  # equal windows of a text stay together, as its rows do
    same = (windows[order][1:] == windows[order][:-1]) & (row[first[order]][1:] == row[first[order]][:-1])
    twice = np.zeros(len(first), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = first[twice]
    for k in range(3):
        out[at + k] = True
    return out


def dup_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def entropies(starts: np.ndarray, tokens: np.ndarray, size: int) -> np.ndarray:
    """Bits of the token distribution of each row (0 without tokens)."""
    n = len(starts) - 1
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(starts))
    keys = np.sort(row * size + tokens)
    firsts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    counts = np.diff(np.append(firsts, len(keys)))
    owner = keys[firsts] // size
    total = np.maximum(np.diff(starts), 1)
    logs = np.bincount(owner, counts * np.log2(np.maximum(counts, 1)), n)
    return np.maximum(np.log2(total) - logs / total, 0.0)


def scripts(names: pa.Array) -> np.ndarray:
    """Letters of each script in each word, words x scripts."""
    points = np.frombuffer("".join(names.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = np.array([-1] + [x[1] for x in RANGES])[np.searchsorted([x[0] for x in RANGES], points, "right")]
    word = np.repeat(np.arange(len(names)), np.asarray(pc.utf8_length(names)))
    some = kind >= 0
    return np.bincount(word[some] * len(SCRIPTS) + kind[some], minlength=len(names) * len(SCRIPTS)).reshape(-1, len(SCRIPTS))


def measure(texts: pa.Array, fertility: Fertility) -> list[pa.Array]:
    texts = pc.fill_null(texts, "")
    starts, ids, names = common.words(texts)
    token_starts, tokens = fertility(names)
    n_tokens = np.diff(token_starts)
    fallback = common.row_sums(fertility.fallback[tokens].astype(np.int64), token_starts)
    chars = np.asarray(pc.utf8_length(names)).astype(np.int64)
    symbols = np.asarray(pc.count_substring_regex(names, SYMBOLS)).astype(np.int64)
    total = common.row_sums(n_tokens[ids], starts)
    all_tokens, places = common.gather(token_starts, tokens, ids)
    some = total > 0
    word_chars = common.row_sums(chars[ids], starts)
    letters = scripts(names)
    by_script = np.stack([common.row_sums(letters[ids, k], starts) for k in range(len(SCRIPTS))])
    main = np.where(by_script.max(0) > 0, by_script.argmax(0), SCRIPTS.index("other"))
    share = lambda x: pa.array(x / np.maximum(total, 1), mask=~some)
    counts = [np.diff(starts), word_chars, common.row_sums(symbols[ids], starts), np.array([dup_lines(x) for x in texts.to_pylist()], np.int64), common.row_sums(repeated(starts, ids, len(names)).astype(np.int64), starts), total]
    return [pa.array(x, pa.int64()) for x in counts] + [
        share(word_chars),
        share(common.row_sums(fallback[ids], starts)),
        pa.array(entropies(places[starts], all_tokens, fertility.size), mask=~some),
        pa.array([SCRIPTS[k] for k in main], pa.string()),
    ]


def verdict(bands: dict[str, tuple[float, float, float, float]]) -> F.Column:
    """True where the measures lie in the band of the script."""
    out = F.lit(False)
    for script, (least, most, fallback, entropy) in bands.items():
        needed = F.least(F.lit(entropy), ENTROPY_SHARE * F.log2(F.col("n_tokens")))
        ok = F.col("chars_per_token").between(least, most) & (F.col("fallback_share") <= fallback) & (F.col("token_entropy") >= needed)
        out = F.when(F.col("script") == script, ok).otherwise(out)
    return F.coalesce(out, F.lit(False))


def assess(docs: DataFrame, vocabulary: str, bands: dict = BANDS, carry: tuple[str, ...] = ("doc_id",), text_column: str = "text") -> DataFrame:
    """`carry` columns, the measures, base_failed and kept, for each row.  vocabulary: a sentencepiece file that all executors can open."""
    fields = [docs.schema[c] for c in carry]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("_carried"), F.col(text_column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fertility = Fertility(vocabulary)
        for batch in common.steps(batches, "text"):
            columns = [batch.column("_carried"), *measure(batch.column("text"), fertility)]
            yield pa.RecordBatch.from_arrays(columns, names=["_carried", *[x.split()[0] for x in MEASURES.split(", ")]])

    inner = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in fields)
    out = rows.mapInArrow(common.lean(run), f"_carried struct<{inner}>, {MEASURES}")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = out.withColumn("base_failed", failed).withColumn("kept", ~failed & verdict(bands))
    return out.select(*[F.col(f"_carried.`{c}`").alias(c) for c in carry], *[x.split()[0] for x in MEASURES.split(", ")], "base_failed", "kept")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def filter_kept(docs: DataFrame, vocabulary: str | None = None, bands: dict = BANDS, text_column: str = "text") -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    names = docs.columns
    numbered = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text = f"c{names.index(text_column)}"
    out = assess(numbered, vocabulary or default_vocabulary(), bands, tuple(numbered.columns), text).filter("kept")
    return out.select(*[F.col(f"c{i}").alias(x) for i, x in enumerate(names)])


def query(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    return assess(common.table(spark, sf_dir, "documents"), vocabulary or default_vocabulary())
