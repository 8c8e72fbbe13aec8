"""Packing of tokenised documents into sequences by an order-preserving dynamic program.

Documents keep the order of the input partitions.  Each input partition is one
stream of tokens: the ids of a document, then an end id, and so on.  A dynamic
program chooses the cuts of the stream.  It may cut at document ends (free), at
sentence ends (``sentence_cost``) and, inside units of more than ``max_unit`` tokens
without a sentence end, at regular places (``inner_cost``).  A window of L tokens
costs the padding, ``window - L``, or none if L is a power of two of at least ``least_power``, plus ``window_cost``.
The best start of a padded window is the least ``cost[i] + position[i]`` over a sliding range, so a
monotone queue gives each transition in constant time; the few starts at a power of
two before a place are tried one by one.  The rest of a stream is cut into powers
of two where the padding saved is more than the cuts cost.

A stream is solved in blocks of ``block_tokens`` tokens.  All windows of a block
but the last are final; the last one's tokens open the next block.  Memory is
bounded by a block and the longest document.  Nothing is shuffled.

Defined results: a null or empty text is the end id alone; repeated documents and
repeated or null doc_ids are packed once per row; of equally cheap cuts the later starts win; an empty table gives no rows;
columns other than the two named ones are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.llm import bpe, common

WINDOW = 4096
END_ID = 2
#: Text bytes that are encoded at once: working arrays take some thirty times as much.
STEP_BYTES = 3 << 20
STOPS, CLOSERS = [ord(x) for x in ".!?"], [ord(x) for x in "\"')]"]
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def ends_sentence(names: pa.Array) -> np.ndarray:
    """Flags of words that end in a full stop, exclamation or question mark (ASCII or wide), perhaps with a closing quote or bracket after it."""
    offsets, data = common.bytes_of(names)
    data = np.concatenate([np.zeros(3, np.uint8), data])
    at = offsets[1:] + 2  # of the last byte
    some = np.diff(offsets) > 1
    last, before, third = data[at], data[at - 1], data[at - 2]
    wide = (third == 0xE3) & (before == 0x80) & (last == 0x82) | (third == 0xEF) & (before == 0xBC) & np.isin(last, [0x81, 0x9F])
    return np.isin(last, STOPS) | some & np.isin(last, CLOSERS) & np.isin(before, STOPS) | wide


class WordTokenizer:
    """Ids of whole texts by way of their distinct words.

    The vocabulary's pre-tokeniser drops white space and never joins across it, and
    normalisation doesn't reach across it either, so the ids of a text are those of
    its words in turn.  Texts that hold the start of a special token's string are
    encoded as they are.
    """

    def __init__(self, path: str):
        self.merger = bpe.Merger(path)
        self.tokenizer = self.merger.tokenizer

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts of each text's ids and the end, ids, flags of ids that end a sentence)."""
        starts, ids, distinct = common.words(texts)
        word_starts, word_ids = self.merger.encode(distinct)
        ends = ends_sentence(distinct)
        values, places = common.gather(word_starts, word_ids, ids)
        last = np.zeros(len(values), bool)
        stops = places[1:][ends[ids] & (places[1:] > places[:-1])] - 1
        last[stops] = True
        return places[starts], values, last


def whole(tokenizer: WordTokenizer, texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, sentence flags) of each text."""
    texts = pc.fill_null(texts, "")
    odd = np.asarray(pc.match_substring(texts, "<|"), dtype=bool)
    starts, ids, last = tokenizer.encode(pc.if_else(pa.array(odd), "", texts))
    out = [(ids[a:b], last[a:b]) for a, b in zip(starts[:-1], starts[1:])]
    for i in np.flatnonzero(odd):
        got = np.asarray(tokenizer.tokenizer.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, np.int32)
        out[i] = (got, np.zeros(len(got), bool))
    return out


def choose_cuts(places: np.ndarray, costs: np.ndarray, window: int, window_cost: float, least_power: int = 256) -> list[int]:
    """Indices of the places at which the cheapest windows end.  places begins with 0 and rises by at most window."""
    where, extra = places.tolist(), (costs + window_cost + window).tolist()
    exact: dict[int, list[int]] = {}  # starts from which a window has a power of two of tokens
    power = least_power
    while power < window:
        at = np.minimum(np.searchsorted(places, places - power), len(places) - 1)
        for j in np.flatnonzero((places[at] == places - power) & (places >= power)).tolist():
            exact.setdefault(j, []).append(int(at[j]))
        power *= 2
    came, keys = [0] * len(where), [0.0] * len(where)
    # (least cost of a prefix plus its length, its place, its index): a window's padding is linear in where it starts
    queue: deque[tuple[float, int, int]] = deque([(0.0, 0, 0)])
    first, pop, append = queue.popleft, queue.pop, queue.append
    key, low_at, i = queue[0]
    for j in range(1, len(where)):
        t = where[j]
        while low_at < t - window:
            first()
            key, low_at, i = queue[0]
        came[j] = i
        new = key + extra[j]  # the cost, key - t + extra, plus t
        if j in exact:
            for k in exact[j]:
                other = keys[k] - where[k] + extra[j] - window + t
                if other < new:
                    new, came[j] = other, k
        keys[j] = new
        while queue and queue[-1][0] >= new:
            pop()
        append((new, t, j))
        key, low_at, i = queue[0]
    out, j = [], len(where) - 1
    while j > 0:
        out.append(j)
        j = came[j]
    return out[::-1]


def with_inner(places: np.ndarray, costs: np.ndarray, max_unit: int, step: int, inner_cost: float) -> tuple[np.ndarray, np.ndarray]:
    """Add places every `step` tokens inside units of more than max_unit tokens."""
    gaps = np.diff(places)
    more = [np.arange(places[i] + step, places[i + 1], step) for i in np.flatnonzero(gaps > max_unit)]
    if not more:
        return places, costs
    added = np.concatenate(more)
    places, costs = np.concatenate([places, added]), np.concatenate([costs, np.full(len(added), inner_cost)])
    order = np.argsort(places, kind="stable")
    return places[order], costs[order]


def powers(length: int) -> list[int]:
    return [1 << k for k in range(length.bit_length() - 1, -1, -1) if length >> k & 1]


class Stream:
    """Documents in, finished pieces out."""

    def __init__(self, partition: int, window: int, sentence_cost: float, inner_cost: float, window_cost: float, max_unit: int):
        self.base, self.made = partition << 36, 0
        self.window, self.sentence, self.inner, self.each, self.unit = window, sentence_cost, inner_cost, window_cost, max_unit
        self.held: list[tuple] = []  # doc_id, start in the document, ids, sentence flags, tokens of the document
        self.size = 0

    def add(self, doc_id: int | None, ids: np.ndarray, last: np.ndarray, end_id: int) -> None:
        self.held.append((doc_id, 0, np.append(ids, np.int32(end_id)), np.append(last, False), len(ids) + 1))
        self.size += len(ids) + 1

    def solve(self, final: bool) -> pa.RecordBatch:
        docs, self.held = self.held, []
        ids = np.concatenate([x[2] for x in docs]).astype("<u4")
        ends = np.cumsum([len(x[2]) for x in docs])
        sentences = np.flatnonzero(np.concatenate([x[3] for x in docs])) + 1
        sentences = sentences[~np.isin(sentences, ends)]
        places = np.concatenate([[0], ends, sentences])
        costs = np.concatenate([np.zeros(len(ends) + 1), np.full(len(sentences), self.sentence)])
        order = np.argsort(places, kind="stable")
        places, costs = with_inner(places[order], costs[order], self.unit, max(1, self.unit // 2), self.inner)
        cuts = [0, *places[choose_cuts(places, costs, self.window, self.each)].tolist()]
        if not final and len(cuts) > 2:
            rest = cuts.pop()
        else:
            rest = cuts[-1]
            tail = powers(cuts[-1] - cuts[-2])
            if (len(tail) - 1) * self.inner < self.window - sum(tail):
                cuts = cuts[:-1] + (cuts[-2] + np.cumsum(tail)).tolist()
        done = cuts[-1]
        begins = np.concatenate([[0], ends[:-1]])
        bounds = np.unique(np.concatenate([cuts, begins[begins < done], [done]]))
        lefts, rights = bounds[:-1], bounds[1:]
        doc = np.searchsorted(ends, lefts, "right")
        seq = np.searchsorted(np.asarray(cuts), lefts, "right") - 1
        starts = np.asarray([x[1] for x in docs])
        raw = ids.tobytes()
        out = pa.RecordBatch.from_arrays(
            [
                pa.array([docs[d][0] for d in doc], pa.int64()),
                pa.array(starts[doc] + lefts - begins[doc], pa.int64()),
                pa.array(rights - lefts, pa.int64()),
                pa.array([raw[4 * a : 4 * b] for a, b in zip(lefts.tolist(), rights.tolist())], pa.binary()),
                pa.array(np.asarray([x[4] for x in docs])[doc], pa.int64()),
                pa.array(self.base + self.made + seq, pa.int64()),
                pa.array(lefts - np.asarray(cuts)[seq], pa.int64()),
            ],
            names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
        )
        self.made += len(cuts) - 1
        self.size = 0
        if rest > done:
            for k in range(int(np.searchsorted(ends, done, "right")), len(docs)):
                skip = max(0, done - int(begins[k]))
                d = docs[k]
                self.held.append((d[0], d[1] + skip, d[2][skip:].copy(), d[3][skip:].copy(), d[4]))
                self.size += len(d[2]) - skip
        return out


def pack(
    docs: DataFrame,
    vocabulary: str,
    window: int = WINDOW,
    end_id: int = END_ID,
    sentence_cost: float = 2.0,
    inner_cost: float = 48.0,
    window_cost: float = 4.0,
    max_unit: int = 1024,
    block_tokens: int = 1 << 20,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Pieces of documents: doc_id, start, length, ids (little-endian unsigned 32 bits), doc_tokens, sequence_id, offset.

    vocabulary: a file of the tokenizers library that all executors can open.
    """
    assert window > 1
    max_unit = min(max_unit, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer(vocabulary)
        stream = Stream(TaskContext.get().partitionId(), window, sentence_cost, inner_cost, window_cost, max_unit)
        for batch in common.steps(batches, "text", STEP_BYTES):
            for doc_id, (ids, last) in zip(batch.column("doc_id").to_pylist(), whole(tokenizer, batch.column("text"))):
                stream.add(doc_id, ids, last, end_id)
                if stream.size >= block_tokens:
                    yield stream.solve(False)
        if stream.size:
            yield stream.solve(True)

    two = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return two.mapInArrow(common.lean(run), PIECES)


def query(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    return digest(common.table(spark, sf_dir, "documents"), vocabulary)


def digest(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    pieces = pack(docs, vocabulary)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
