"""Totals of keys over all chunks, told to every chunk, through a tree of nodes.

Were each chunk to send a row to each bucket of the keys, rows would grow with the square
of the corpus.  Here a chunk sends at most ``fan`` rows, one for each range of the keys.
``fan`` chunks, about, meet in a node for each range; it merges what they send, so it
holds about as much as one chunk, and sends the merged keys on, to ``fan`` narrower ranges,
where ``fan`` such groups meet, and so on until one group is left.  Its nodes know the
totals; the answers go back the same way.  So with n chunks there are at most
n * fan rows for each of the log(n) / log(fan) levels, and no task holds more than about a
chunk's keys, however frequent a key is: it goes to a node once from each sender.

With one level, what chunks send is shuffled once and gone when the answers are written.  With
more, it is written, and its ranges go through the tree in up to ``SLICES`` turns, so that of
shuffled keys no more than one turn's are on disk at a time.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspark.llm import chunks as C
from linkspark.llm import common
from linkspark.operators.storage import drop, materialize

FAN = 256
#: Turns, at most, in which a tree of several levels is gone through; chunks for each turn at least.
SLICES, SLICED = 8, 32
#: kind: which of a chunk's lists of keys; grp, rng: the node; child: who sends; keys, values: packed.
SENT = "kind int, grp long, rng long, child long, keys binary, vals binary"
ANSWERS = "kind int, grp long, rng long, vals binary, total long, different long"


def groups_of(chunks: DataFrame, fan: int) -> list[int]:
    """Number of groups at each level; the last is 1."""
    out = [max(1, math.ceil(chunks.count() / fan))]
    while out[-1] > 1:
        out.append(math.ceil(out[-1] / fan))
    return out


def group_of(chunk: int, groups: int) -> int:
    return int(C.mix(np.array([chunk], np.int64).view(np.uint64))[0] % np.uint64(groups))


def key_bits(n_bytes: int, margin: int) -> int:
    """Bits of a key such that about one in 2 ** margin of a corpus' keys has another's by chance (64 at most)."""
    return min(64, max(n_bytes, 2).bit_length() + margin)


def bounds(keys: np.ndarray, bits: int, fan: int, level: int, prefix: int) -> np.ndarray:
    """Bounds of the `fan` ranges of a node's sorted keys.  prefix: the node's range, of level - 1."""
    shift = bits - level * (fan.bit_length() - 1)
    assert shift >= 0
    edges = [((prefix * fan + j) << shift) for j in range(1, fan)]
    return np.concatenate([[0], np.searchsorted(keys, np.array(edges, np.uint64)), [len(keys)]])


def unique(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(different keys in order, index of each key among them)."""
    order = np.argsort(keys, kind="stable")
    sorted_ = keys[order]
    new = np.concatenate([[True], sorted_[1:] != sorted_[:-1]]) if len(keys) else np.empty(0, bool)
    inverse = np.empty(len(keys), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return sorted_[new], inverse


def merged(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(different keys, their totals, index of each sent key, where each row's keys begin and the end)."""
    keys = [C.unpack_sorted(x["keys"], np.uint64) for x in rows]
    values = np.concatenate([C.unpack_numbers(x["vals"]) for x in rows])
    different, inverse = unique(np.concatenate(keys))
    totals = np.zeros(len(different), np.int64)
    np.add.at(totals, inverse, values)
    return different, totals, inverse, np.concatenate([[0], np.cumsum([len(x) for x in keys])])


def totals(
    chunks: DataFrame,
    lists: Callable[[dict], Iterator[tuple[int, np.ndarray, np.ndarray]]],
    bits: dict[int, int],
    answer: Callable[[int, np.ndarray], np.ndarray],
    fan: int = FAN,
    sums_too: bool = False,
) -> DataFrame:
    """(kind, grp: the chunk, rng, vals, total, different): answers to a chunk's lists of keys.

    lists: (kind, rising different keys below 2 ** bits[kind], counts) of a chunk's row.
    answer: what to tell (numbers from 0) for a kind's totals.  total and different are, over
    the first rows of all nodes, the sum of the totals and the number of keys with any;
    with sums_too, the result is (these rows, the sums of each kind), taken from the top of the tree.
    The answers are written.  `known` puts a chunk's answers together.  No chunks give no rows.
    """
    assert fan & (fan - 1) == 0
    groups = groups_of(chunks, fan)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in batches:
            for row in C.rows_of(pa.Table.from_batches([one])):
                group = group_of(row["chunk"], groups[0])
                for kind, keys, counts in lists(row):
                    cuts = bounds(keys, bits[kind], fan, 1, 0)
                    parts = [(k, slice(cuts[k], cuts[k + 1])) for k in range(fan) if cuts[k] < cuts[k + 1]]
                    yield C.batch(SENT, [(kind, group, k, row["chunk"], C.pack_sorted(keys[own]), C.pack_numbers(counts[own])) for k, own in parts])

    def forward(level: int) -> Callable[[pa.Table], pa.Table]:
        def run(table: pa.Table) -> pa.Table:
            rows = list(C.rows_of(table))
            kind, grp, rng = rows[0]["kind"], rows[0]["grp"], rows[0]["rng"]
            keys, sums, _, _ = merged(rows)
            cuts = bounds(keys, bits[kind], fan, level + 1, rng)
            parts = [(k, slice(cuts[k], cuts[k + 1])) for k in range(fan) if cuts[k] < cuts[k + 1]]
            return pa.Table.from_batches([C.batch(SENT, [(kind, grp % groups[level], rng * fan + k, grp, C.pack_sorted(keys[own]), C.pack_numbers(sums[own])) for k, own in parts])])

        return run

    def top(table: pa.Table) -> pa.Table:
        rows = list(C.rows_of(table))
        kind, rng = rows[0]["kind"], rows[0]["rng"]
        _, sums, inverse, begins = merged(rows)
        told = answer(kind, sums)[inverse]
        out = []
        for i, (x, a, b) in enumerate(zip(rows, begins[:-1], begins[1:])):
            out.append((kind, x["child"], rng, C.pack_numbers(told[a:b]), 0 if i else int(sums.sum()), 0 if i else int((sums > 0).sum())))
        return pa.Table.from_batches([C.batch(ANSWERS, out)])

    def back(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, got = list(C.rows_of(left)), list(C.rows_of(right))
        kind, rng = rows[0]["kind"], rows[0]["rng"]
        _, _, inverse, begins = merged(rows)
        told = known(got, kind)[inverse]
        return pa.Table.from_batches([C.batch(ANSWERS, [(kind, x["child"], rng, C.pack_numbers(told[a:b]), 0, 0) for x, a, b in zip(rows, begins[:-1], begins[1:])])])

    node = ["kind", "grp", "rng"]
    first = chunks.mapInArrow(common.lean(send), SENT)

    def through(first: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(answers to what chunks sent, the sums of each kind), written."""
        sent = [first]
        for level in range(1, len(groups)):
            rows = sent[-1].groupBy(*node).applyInArrow(common.lean(forward(level)), SENT)
            sent.append(materialize(rows))
        found = materialize(sent[-1].groupBy(*node).applyInArrow(common.lean(top), ANSWERS))
        sums = found.groupBy("kind").agg(F.sum("total").alias("total"), F.sum("different").alias("different"))
        sums = materialize(sums) if sums_too else sums
        drop(*sent[-1:] if len(sent) > 1 else [])
        for level in range(len(groups) - 2, -1, -1):
            above = found.select("kind", "grp", F.floor(F.col("rng") / fan).cast("long").alias("node"), "rng", "vals")
            told = materialize(sent[level].groupBy(*node).cogroup(above.groupBy("kind", "grp", "node")).applyInArrow(common.lean(back), ANSWERS))
            drop(found, *[sent[level]] if level else [])
            found = told
        return found, sums

    if len(groups) == 1:
        found, sums = through(first)
        return (found, sums) if sums_too else found
    first, turns = materialize(first), max(1, min(SLICES, fan, groups[0] * fan // SLICED))
    done = [through(first.filter(F.floor(F.col("rng") * turns / fan) == turn)) for turn in range(turns)]
    drop(first)
    found, sums = (reduce(DataFrame.union, x) for x in zip(*done))
    return (found, sums.groupBy("kind").agg(F.sum("total").alias("total"), F.sum("different").alias("different"))) if sums_too else found


def known(rows: list[dict], kind: int) -> np.ndarray:
    """What one chunk is told of a kind: a number for each of its keys, in their order."""
    parts = sorted((x["rng"], x["vals"]) for x in rows if x["kind"] == kind)
    return np.concatenate([C.unpack_numbers(x) for _, x in parts]) if parts else np.empty(0, np.int64)
