"""Language-model scores by a weighted backoff automaton of word n-grams.

Words are lower-cased (A-Z); a text is its words and one end token, read after a start
mark.  The states of the automaton are the contexts of up to ``order - 1`` tokens that
training texts have.  A state has an arc for each token that follows it in training,
weighted with its smoothed probability, and a failure arc to the state of its shorter
context, weighted with the mass left to that:

    P(w | h) = (c(hw) + m * P(w | h')) / (c(h) + m),   failure: m / (c(h) + m)

with Dirichlet mass m for the order, down to P(w) = (c(w) + 1) / (N + V + 1), the arcs of
the empty state, which has one for every token.

The automaton grows with the corpus and is nowhere whole.  Chunks of documents ask for the
training counts of the n-grams that they hold (see exchange); so each chunk gets the part
of the automaton that its texts can reach.  One traversal then reads the chunk's texts
from left to right, all of them a token at a time: it carries each text's state, follows
failure arcs, adding their weights, until the state has an arc for the token, adds the
arc's weight and goes to the longest state that ends with the token.  Texts of more than
``SEGMENT`` tokens are read in several places at once; the state at such a place is that
of the tokens before it.

An n-gram of two or more words is known by as many bits of a hash as make chance equals
one in a million; single words by 64 bits.

Defined results: null and empty texts are the end token alone; rows with null doc_id are
training rows and keep their null; repeated rows count each time; without training texts
N and V are 0 and all probabilities 1; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.llm import chunks as C
from linkspark.llm import common, exchange

ORDER = 3
#: Dirichlet mass of the orders 2, 3 ...
MASSES = (8000.0, 10.0)
CHUNK_BYTES = 12 << 20
SEGMENT = 256
MARGIN = 20  # see exchange.key_bits
FACTOR = np.uint64(0x9E3779B97F4A7C15)
END, START = np.uint64(0x1F3D5B79), np.uint64(0x2E4C6A88)
NULL_ID = np.iinfo(np.int64).max
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def tokens_of(chunk: C.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(starts of each text's tokens and the end, hashes); a text is START, its words, END."""
    chunk.data = LOWER[chunk.data]
    n = len(chunk.ids)
    starts, ids, names = common.words(chunk.texts(0, n))
    hashes = C.word_hashes(names)[ids]
    out_starts = starts + 2 * np.arange(n + 1)
    out = np.empty(out_starts[-1], np.uint64)
    row = np.repeat(np.arange(n), np.diff(starts))
    out[np.arange(len(hashes)) + 2 * row + 1] = hashes
    out[out_starts[:-1]] = START
    out[out_starts[1:] - 1] = END
    return out_starts, out


def grams(hashes: np.ndarray, starts: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the last tokens, keys) of the n-grams inside texts.  The start mark alone is none."""
    if order == 1:
        at = np.ones(len(hashes), bool)
        at[starts[:-1]] = False
        at = np.flatnonzero(at)
        return at, hashes[at]
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    at = np.flatnonzero(row[order - 1 :] == row[: len(row) - order + 1]) + order - 1
    key = np.zeros(len(at), np.uint64)
    for k in range(order - 1, -1, -1):
        key = key * FACTOR + hashes[at - k]
    return at, C.mix(key)


class Automaton:
    """The part of the automaton that some texts can reach.

    starts: of the texts' tokens, and the end.  places, which, counts: of each order,
    where its n-grams end, which n-gram that is, and how often training has each n-gram.
    A state or arc is an n-gram's number; `arcs[n]` has the weights (log10) of the arcs that
    n-grams of order n stand for (nan: no such arc), `failures[n]` those of the failure arcs of
    the states that they stand for, `at[n]` the number of the n-gram that ends at a place (-1: none).
    """

    def __init__(self, starts: np.ndarray, places: list[np.ndarray], which: list[np.ndarray], counts: list[np.ndarray], total: int, vocabulary: int, masses: tuple[float, ...]):
        self.starts, self.order = starts, len(counts)
        self.at: list[np.ndarray] = [np.empty(0, np.int64)]
        for p, w in zip(places, which):
            own = np.full(starts[-1], -1, np.int64)
            own[p] = w
            self.at.append(own)
        self.counts = [np.empty(0), *counts]
        # the start mark is a state, though no arc leads to it; it occurs as often as the end token
        ends = self.at[1][starts[1:] - 1]
        mark = len(counts[0])
        self.counts[1] = np.append(counts[0], counts[0][ends[0]] if len(ends) else 0)
        self.at[1][starts[:-1]] = mark
        weight = np.append((counts[0] + 1) / (total + vocabulary + 1) if total else np.ones(len(counts[0])), 1.0)
        self.arcs, self.failures = [np.empty(0), np.log10(weight)], [np.zeros(1)]
        for n, mass in enumerate(masses, 2):
            first = np.zeros(len(counts[n - 1]), np.int64)  # a place of each n-gram
            first[which[n - 1]] = places[n - 1]
            context = self.counts[n - 1]
            self.failures.append(np.log10(mass / (context + mass)))
            own = (counts[n - 1] + mass * weight[self.at[n - 1][first]]) / (context[self.at[n - 1][first - 1]] + mass)
            self.arcs.append(np.where(counts[n - 1] > 0, np.log10(own), np.nan))
            weight = own

    def states_before(self, places: np.ndarray) -> np.ndarray:
        """Of each place, how many tokens the state of the tokens before it has: the longest context in training."""
        out = np.zeros(len(places), np.int64)
        for n in range(1, self.order):
            gram = self.at[n][places - 1]
            out[(gram >= 0) & (self.counts[n][gram] > 0)] = n
        return out

    def traverse(self, segment: int) -> np.ndarray:
        """log10 of the weight that each token gets (start marks: 0)."""
        logs = np.zeros(self.starts[-1] if len(self.starts) else 0)
        first, last = self.starts[:-1] + 1, self.starts[1:]
        pieces = -(-(last - first) // segment)
        text = np.repeat(np.arange(len(first)), pieces)
        begin = first[text] + segment * (np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        length = np.minimum(last[text] - begin, segment)
        order = np.argsort(-length, kind="stable")
        begin, length = begin[order], length[order]
        state = self.states_before(begin)  # a state is the n-gram of so many tokens before the place
        live = len(begin)
        for step in range(int(length[0]) if live else 0):
            live = int(np.searchsorted(-length, -step, "left"))  # segments longer than step
            here = begin[:live] + step
            now = state[:live]
            gained = np.zeros(live)
            after = np.zeros(live, np.int64)
            for n in range(self.order, 1, -1):  # states of n - 1 tokens: arcs are n-grams
                some = np.flatnonzero(now == n - 1)
                p = here[some]
                arc = self.arcs[n][self.at[n][p]]
                none = np.isnan(arc)
                gained[some] += np.where(none, self.failures[n - 1][self.at[n - 1][p - 1]], arc)
                after[some[~none]] = min(n, self.order - 1)
                now[some[~none]] = -1  # done
                some, p = some[none], p[none]  # the failure arc leads to the longest shorter context
                now[some] = n - 2
            some = np.flatnonzero(now == 0)
            word = self.at[1][here[some]]
            gained[some] += self.arcs[1][word]
            after[some] = np.minimum(self.counts[1][word] > 0, self.order - 1)
            state[:live] = after
            logs[here] = gained
        return logs


def score(docs: DataFrame, held_out: F.Column, order: int = ORDER, masses: tuple[float, ...] = MASSES, id_column: str = "doc_id", text_column: str = "text", chunk_bytes: int = CHUNK_BYTES, fan: int = exchange.FAN) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row; rows that aren't held out train."""
    assert len(masses) == order - 1
    segment = SEGMENT
    chunks = C.chunked(docs, id_column, text_column, held_out.cast("int"), chunk_bytes)
    n_bytes = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    bits = {n: 64 if n == 1 else exchange.key_bits(n_bytes, MARGIN) for n in range(1, order + 1)}

    def own_grams(chunk: C.Chunk) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """(starts of the tokens, for each order: places, different keys, which of them each place has)."""
        starts, hashes = tokens_of(chunk)
        out = []
        for n in range(1, order + 1):
            at, keys = grams(hashes, starts, n)
            out.append((at, *exchange.unique(keys >> np.uint64(64 - bits[n]))))
        return starts, out

    def lists(row: dict) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        chunk = C.Chunk(row)
        starts, found = own_grams(chunk)
        train = np.repeat(chunk.extra == 0, np.diff(starts))
        for n, (at, keys, which) in enumerate(found, 1):
            yield n, keys, np.bincount(which, train[at], len(keys)).astype(np.int64)

    answers, sums = exchange.totals(chunks, lists, bits, lambda _, totals: totals, fan, sums_too=True)
    total, vocabulary = (x or 0 for x in sums.filter("kind = 1").select("total", "different").first() or (0, 0))
    schema = "doc_id long, held_out int, n_tokens long, n_known long, base_score double, score double"

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        got = list(C.rows_of(right))
        out = []
        for row in C.rows_of(left):
            chunk = C.Chunk(row)
            starts, found = own_grams(chunk)
            counts = [exchange.known(got, n).astype(np.float64) for n in range(1, order + 1)]
            places, which = [x[0] for x in found], [x[2] for x in found]
            logs = Automaton(starts, places, which, counts, total, vocabulary, masses).traverse(segment)
            own = counts[0][which[0]]
            base, seen = np.zeros(starts[-1]), np.zeros(starts[-1], np.int64)
            base[places[0]] = np.log10((own + 1) / (total + vocabulary + 1)) if total else 0.0
            seen[places[0]] = own > 0
            tokens = np.diff(starts) - 1
            sums = [np.add.reduceat(x, starts[:-1]) for x in (seen, base, logs)]
            for i, h, t, s, b, m in zip(chunk.ids.tolist(), chunk.extra.tolist(), tokens.tolist(), *(x.tolist() for x in sums)):
                out.append((None if i == NULL_ID else i, h, t, s, b, m))
        return pa.Table.from_batches([C.batch(schema, out)])

    scored = chunks.groupBy("chunk").cogroup(answers.groupBy("grp")).applyInArrow(common.lean(finish), schema)
    return scored.select("doc_id", (F.col("held_out") == 1).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.table(spark, sf_dir, "documents"), F.coalesce(common.crc_mod("doc_id", 7) == 2, F.lit(False)))
