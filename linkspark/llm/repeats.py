"""Removal of byte strings that an earlier document has, by suffix arrays.

Every byte is removed that is covered by a string of ``length`` bytes that also starts in
a document with a smaller id.  Steps:

1. Documents are written as chunks.  A place of a text is an anchor if the hash of its
   ``seed`` bytes is the least of some ``length - seed + 1`` places in a row.  Two equal
   strings of ``length`` bytes have an anchor at the same offset, so only anchors that at
   least two documents have can lie in a string to remove.  Chunks learn which of their
   anchors these are (see exchange; its short hashes make a few too many shared, which
   only costs time).
2. Around each shared anchor, a chunk sends all bytes that a string through the anchor can
   reach, once for each different surrounding and with the least id that has it, to a node
   for its range of anchors.  Nodes form a tree like that of exchange: equal surroundings
   are merged on the way to its top.
3. A node at the top has all different surroundings of its anchors.  Of an anchor with
   several, all suffixes that begin a string of ``length`` bytes go to a suffix array
   (see suffix_array: difference cover, one bucket at a time, ties by ranks of the sample),
   where equal strings are neighbours; the least id of each run is the string's.
4. Back down the tree, the chunks learn at which places strings start that a smaller id has.

An anchor that more than ``hot`` documents have could bring any number of surroundings to
one node.  Its strings are sent one by one instead, as 128-bit hashes with their least id,
which scatters them over all nodes.

Defined results: null text is empty; texts under ``length`` bytes lose nothing; rows with
null id neither lose bytes nor take them from others; rows with one id count as one
document, so they take nothing from each other; an empty table gives no rows; `strip`
keeps all columns, whatever their names, `digest` looks at the two named ones alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.llm import chunks as C
from linkspark.llm import common, exchange, suffix_array
from linkspark.operators.storage import materialize

LENGTH = 50
SEED = 26
STEP = 3 << 18
#: Surroundings that one suffix array holds, about.
ROWS = 1 << 15
NULL_ID = np.iinfo(np.int64).max
FACTOR, OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
#: Documents that share an anchor, above which its strings are sent one by one.
HOT = 1 << 16
MARGIN = 9  # see exchange.key_bits
#: What chunks and nodes send: kind 0 surroundings, 1 hashed strings; own: which row a place has, later: whether an id below the place's has it in the chunk.
AROUND = "kind int, grp long, rng long, child long, around binary, ids binary, places binary, own binary, later binary"


def rolling(data: np.ndarray, length: int, factor_: np.uint64 = FACTOR) -> np.ndarray:
    """Polynomial hashes of all strings of `length` bytes (64 bits, not scattered)."""
    factor = int(factor_)
    power, span = data.astype(np.uint64) + np.uint64(1), 1  # hashes of spans of 1, 2, 4 ... bytes
    out, have = None, 0
    rest = length
    while True:
        if rest & 1:
            part = power
            if out is None:
                out, have = part, span
            else:  # put this span before what there is
                n = len(data) - have - span + 1
                if n <= 0:
                    return np.empty(0, np.uint64)
                out = part[:n] * np.uint64(pow(factor, have, 1 << 64)) + out[span : span + n]
                have += span
        rest >>= 1
        if not rest:
            return out[: max(len(data) - length + 1, 0)]
        n = len(data) - 2 * span + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        power = power[:n] * np.uint64(pow(factor, span, 1 << 64)) + power[span : span + n]
        span *= 2


def sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Least or greatest of each `width` neighbours."""
    f = np.minimum if least else np.maximum
    span = 1
    while 2 * span <= width:
        values = f(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return f(values[:-rest], values[rest:]) if rest else values


def anchors(data: np.ndarray, starts: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the anchors of texts laid end to end."""
    width = length - seed + 1
    if len(data) < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = C.mix(rolling(data, seed))
    low = sliding(h, width, True)  # of the strings of `length` bytes that start at each place
    sizes = np.diff(starts)
    inside = np.ones(len(low), bool)  # strings that lie in one text
    for end in starts[1:-1][sizes[:-1] > 0]:
        inside[max(0, end - length + 1) : end] = False
    low = np.where(inside, low, 0)
    padded = np.concatenate([np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)])
    high = sliding(padded, width, False)[: len(h)]
    at = np.flatnonzero(high == h)
    return at, C.mix(h[at] + FACTOR)  # mixed again, as least hashes are small numbers and would share a range


def anchor_keys(rows: np.ndarray, reach: int, seed: int) -> np.ndarray:
    """The anchors' hashes from their surroundings."""
    return C.mix(C.mix(rolling(np.ascontiguousarray(rows[:, reach : reach + seed]).reshape(-1), seed)[::seed]) + FACTOR)


def surroundings(data: np.ndarray, starts: np.ndarray, at: np.ndarray, length: int, seed: int) -> np.ndarray:
    """Rows of bytes around anchors; zeros beyond the text; the last two tell how much there is left and right of the anchor."""
    reach = length - seed
    span = length + reach
    width = -(-(span + 2) // suffix_array.PERIOD) * suffix_array.PERIOD
    doc = np.searchsorted(starts, at, "right") - 1
    left = np.minimum(at - starts[doc], reach)
    right = np.minimum(starts[doc + 1] - at, length)
    padded = np.concatenate([np.zeros(reach, np.uint8), data, np.zeros(length, np.uint8)])
    rows = np.zeros((len(at), width), np.uint8)
    rows[:, :span] = np.lib.stride_tricks.sliding_window_view(padded, span)[at]
    column = np.arange(span)
    odd = np.flatnonzero((left < reach) | (right < length))
    rows[odd, :span] *= (column >= reach - left[odd, None]) & (column < reach + right[odd, None])
    rows[:, -2], rows[:, -1] = left, right
    return rows


def classes(rows: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class of each row, a row of each class, least id of each class) of equal rows."""
    words = rows.view(np.uint64)
    key = np.zeros(len(rows), np.uint64)
    for k in range(words.shape[1]):
        key = C.mix(key * FACTOR + words[:, k])
    order = np.lexsort((ids, key))
    new = np.ones(len(rows), bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (words[order[1:]] != words[order[:-1]]).any(1)
    firsts = np.flatnonzero(new)
    own = np.empty(len(rows), np.int64)
    own[order] = np.cumsum(new) - 1
    return own, order[firsts], np.minimum.reduceat(ids[order], firsts) if len(rows) else ids


def whole_strings(rows: np.ndarray, length: int, seed: int) -> np.ndarray:
    """Bits of the offsets at which a string of `length` bytes starts, for each surrounding."""
    reach = length - seed
    left, right = rows[:, -2].astype(np.int16), rows[:, -1].astype(np.int16)
    real = np.zeros(len(rows), np.uint32)
    for k in range(reach + 1):
        real |= np.where((k >= reach - left) & (k + length <= reach + right), np.uint32(1 << k), np.uint32(0))
    return real


def masks(rows: np.ndarray, ids: np.ndarray, real: np.ndarray, length: int, seed: int) -> np.ndarray:
    """For different surroundings and the least id of each: bits of the offsets whose string some smaller id has."""
    reach = length - seed
    bits = np.uint32(1) << np.arange(reach + 1, dtype=np.uint32)
    taken = np.zeros(len(rows), np.uint32)
    seeds = seed_keys(rows, reach, seed)
    order = np.argsort(seeds, kind="stable")
    firsts = np.flatnonzero(np.concatenate([[True], seeds[order][1:] != seeds[order][:-1]])) if len(rows) else np.empty(0, np.int64)
    sizes = np.diff(np.append(firsts, len(rows)))
    order = order[np.repeat(sizes > 1, sizes)]  # one surrounding alone has nothing to be compared with
    ends = np.cumsum(sizes[sizes > 1])
    at = 0
    while at < len(order):  # anchors together, with about ROWS surroundings
        to = int(ends[min(np.searchsorted(ends, at + ROWS), len(ends) - 1)])
        some = order[at:to]
        own = rows[some].copy()
        own[:, -2:] = 0
        text = suffix_array.Text(own)
        r, c = np.nonzero(real[some, None] & bits)
        sorted_ = text.order(r, c)
        r, c = r[sorted_], c[sorted_]
        places = r * text.stride + c
        runs = np.flatnonzero(np.concatenate([[True], ~text.same(places[1:], places[:-1], length)])) if len(places) else np.empty(0, np.int64)
        who = ids[some][r]
        if len(runs):
            least = np.repeat(np.minimum.reduceat(who, runs), np.diff(np.append(runs, len(who))))
            lower = least < who
            taken[some] = np.bincount(r[lower], bits[c[lower]].astype(float), len(some)).astype(np.uint32)
        at = to
    return taken


def seed_keys(rows: np.ndarray, at: int, seed: int) -> np.ndarray:
    key = np.zeros(len(rows), np.uint64)
    for k in range(0, seed, 8):
        k = min(k, seed - 8)
        key = C.mix(key * FACTOR + np.ascontiguousarray(rows[:, at + k : at + k + 8]).view(np.uint64).reshape(-1))
    return key


def covered(begins: np.ndarray, n: int, length: int) -> np.ndarray:
    """Flags of n bytes that strings from these places on cover."""
    out = np.zeros(n, bool)
    out[begins] = True
    span = 1
    while span < length:
        more = min(span, length - span)
        out[more:] = out[more:] | out[:-more]
        span += more
    return out


def flagged(flags: np.ndarray, chunk: C.Chunk) -> np.ndarray:
    """Number of flagged bytes in each text, some texts at a time."""
    out = np.zeros(len(chunk.ids), np.int64)
    for a, b in chunk.steps(1 << 20):
        base = chunk.starts[a]
        out[a:b] = common.row_sums(flags[base : chunk.starts[b]].astype(np.int64), chunk.starts[a : b + 1] - base)
    return out


def find(chunks: DataFrame, length: int = LENGTH, seed: int = SEED, hot: int = HOT, fan: int = exchange.FAN) -> DataFrame:
    """(chunk, starts binary): places of a chunk's bytes where a string starts that a smaller id has."""
    assert 8 <= seed <= length <= seed + 31 and length < 256
    reach = length - seed
    bits = exchange.key_bits(chunks.agg(F.sum("n_bytes")).first()[0] or 0, MARGIN)
    groups = exchange.groups_of(chunks, fan)
    widths = {0: -(-(length + reach + 2) // suffix_array.PERIOD) * suffix_array.PERIOD, 1: 16}

    def short(hashes: np.ndarray) -> np.ndarray:
        return hashes >> np.uint64(64 - bits)

    def chunk_anchors(chunk: C.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, short hashes, ids) of a chunk's anchors, by hash and id."""
        at, hashes = [], []
        for a, b in chunk.steps(STEP):
            base = chunk.starts[a]
            p, h = anchors(chunk.data[base : chunk.starts[b]], chunk.starts[a : b + 1] - base, length, seed)
            at.append(p + base)
            hashes.append(short(h))
        at, hashes = np.concatenate(at), np.concatenate(hashes)
        ids = chunk.ids[np.searchsorted(chunk.starts, at, "right") - 1]
        real = ids != NULL_ID
        at, hashes, ids = at[real], hashes[real], ids[real]
        order = np.lexsort((ids, hashes))
        return at[order], hashes[order], ids[order]

    def strings(chunk: C.Chunk, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, 128-bit hashes) of the strings of `length` bytes through these anchors."""
        begins, keys = [], []
        for a, b in chunk.steps(STEP):
            base, end = chunk.starts[a], chunk.starts[b]
            some = at[np.searchsorted(at, base) : np.searchsorted(at, end)]
            doc = np.searchsorted(chunk.starts, some, "right") - 1
            mark = np.zeros(end - base, bool)
            for o in range(reach + 1):
                inside = (some - o >= chunk.starts[doc]) & (some - o + length <= chunk.starts[doc + 1])
                mark[some[inside] - o - base] = True
            own = np.flatnonzero(mark)
            if len(own):
                begins.append(own + base)
                keys.append(np.stack([C.mix(rolling(chunk.data[base:end], length, f)[own]) for f in (FACTOR, OTHER)], 1))
        return (np.concatenate(begins), np.concatenate(keys)) if begins else (np.empty(0, np.int64), np.empty((0, 2), np.uint64))

    def lists(row: dict) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        _, hashes, ids = chunk_anchors(C.Chunk(row))
        first = np.ones(len(hashes), bool)
        first[1:] = hashes[1:] != hashes[:-1]
        another = first.copy()
        another[1:] |= ids[1:] != ids[:-1]
        at = np.flatnonzero(first)
        yield 0, hashes[at], np.add.reduceat(another.astype(np.int64), at) if len(at) else at

    def tell(_: int, documents: np.ndarray) -> np.ndarray:
        return (documents > 1).astype(np.uint8) + (documents > hot)

    def row_of(kind: int, node: tuple[int, int], child: int, rows: np.ndarray, least: np.ndarray, places=None, own=None, later=None) -> tuple:
        return (kind, *node, child, C.pack(rows), C.pack(least), *(None if x is None else C.pack(x) for x in (places, own, later)))

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        got, out = list(C.rows_of(right)), []
        for row in C.rows_of(left):
            chunk = C.Chunk(row)
            group = exchange.group_of(chunk.key, groups[0])
            at, hashes, ids = chunk_anchors(chunk)
            which = np.cumsum(np.concatenate([[True], hashes[1:] != hashes[:-1]])) - 1 if len(hashes) else np.empty(0, np.int64)
            told = exchange.known(got, 0)[which] if len(hashes) else which
            p, h, who = at[told == 1], hashes[told == 1], ids[told == 1]
            cuts = exchange.bounds(h, bits, fan, 1, 0)
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                part = slice(cuts[k], cuts[k + 1])
                own, first, least = classes(surroundings(chunk.data, chunk.starts, p[part], length, seed), who[part])
                rows = surroundings(chunk.data, chunk.starts, p[part][first], length, seed)
                out.append(row_of(0, (group, k), chunk.key, rows, least, p[part].astype(np.uint32), own.astype(np.uint32), who[part] != least[own]))
            some = at[told == 2]
            if len(some):  # the strings through hot anchors
                begin, keys = strings(chunk, np.sort(some))
                order = np.argsort(keys[:, 0], kind="stable")
                begin, keys = begin[order], np.ascontiguousarray(keys[order])
                who = chunk.ids[np.searchsorted(chunk.starts, begin, "right") - 1]
                cuts = exchange.bounds(short(keys[:, 0]), bits, fan, 1, 0)
                for k in np.flatnonzero(np.diff(cuts)).tolist():
                    part = slice(cuts[k], cuts[k + 1])
                    rows = keys[part].view(np.uint8).reshape(-1, 16)
                    own, first, least = classes(rows, who[part])
                    out.append(row_of(1, (group, k), chunk.key, rows[first], least, begin[part].astype(np.uint32), own.astype(np.uint32), who[part] != least[own]))
        return pa.Table.from_batches([C.batch(AROUND, out)])

    def gather(got: list[dict]) -> tuple:
        """(rows, ids, class of each, different rows by their anchors' hashes, least ids, hashes, whole strings of each)."""
        kind = got[0]["kind"]
        rows = np.concatenate([C.unpack(x["around"], np.uint8).reshape(-1, widths[kind]) for x in got])
        ids = np.concatenate([C.unpack(x["ids"], np.int64) for x in got])
        own, first, least = classes(rows, ids)
        different = rows[first]
        keys = short(anchor_keys(different, reach, seed) if kind == 0 else np.ascontiguousarray(different[:, :8]).view(np.uint64).reshape(-1))
        order = np.argsort(keys, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        different = different[order]
        real = whole_strings(different, length, seed) if kind == 0 else np.full(len(different), 1 << reach, np.uint32)
        return ids, place[own], different, least[order], keys[order], real

    def forward(level: int):
        def run(table: pa.Table) -> pa.Table:
            got = list(C.rows_of(table))
            kind, grp, rng = got[0]["kind"], got[0]["grp"], got[0]["rng"]
            _, _, rows, least, keys, _ = gather(got)
            cuts = exchange.bounds(keys, bits, fan, level + 1, rng)
            parts = [(k, slice(cuts[k], cuts[k + 1])) for k in np.flatnonzero(np.diff(cuts)).tolist()]
            return pa.Table.from_batches([C.batch(AROUND, [row_of(kind, (grp % groups[level], rng * fan + k), grp, rows[part], least[part]) for k, part in parts])])

        return run

    def answers(got: list[dict], taken: np.ndarray, gathered: tuple, bottom: bool) -> pa.Table:
        """What a node tells its senders: of their rows' strings those that smaller ids have, at the bottom as places."""
        ids, own, _, least, _, real = gathered
        flags = np.where(ids > least[own], real[own], taken[own])
        out, at = [], 0
        for x in got:
            n = len(C.unpack(x["ids"], np.int64))
            here = flags[at : at + n]
            if bottom:
                place = C.unpack(x["places"], np.uint32).astype(np.int64)
                cls = C.unpack(x["own"], np.uint32)
                mask = np.where(C.unpack(x["later"], bool), real[own[at : at + n]][cls], here[cls])
                starts = np.unique(np.concatenate([place[mask >> np.uint32(o) & np.uint32(1) > 0] + (o - reach) for o in range(reach + 1)]))
                here = np.diff(starts, prepend=0).astype(np.uint32)
            out.append((x["kind"], x["child"], x["rng"], C.pack(here)))
            at += n
        return pa.Table.from_batches([C.batch("kind int, grp long, rng long, starts binary", out)])

    def judge(bottom: bool):
        def run(table: pa.Table) -> pa.Table:
            got = list(C.rows_of(table))
            gathered = gather(got)
            _, _, rows, least, _, real = gathered
            taken = masks(rows, least, real, length, seed) if got[0]["kind"] == 0 else np.zeros(len(rows), np.uint32)
            return answers(got, taken, gathered, bottom)

        return run

    def back(bottom: bool):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            got = list(C.rows_of(left))
            told = sorted((x["rng"], x["starts"]) for x in C.rows_of(right))
            return answers(got, np.concatenate([C.unpack(x, np.uint32) for _, x in told]), gather(got), bottom)

        return run

    node, told = ["kind", "grp", "rng"], "kind int, grp long, rng long, starts binary"
    shared = exchange.totals(chunks, lists, {0: bits}, tell, fan)
    sent = [chunks.groupBy("chunk").cogroup(shared.groupBy("grp")).applyInArrow(common.lean(send), AROUND)]
    for level in range(1, len(groups)):
        sent[-1] = materialize(sent[-1])
        sent.append(sent[-1].groupBy(*node).applyInArrow(common.lean(forward(level)), AROUND))
    found = sent[-1].groupBy(*node).applyInArrow(common.lean(judge(len(groups) == 1)), told)
    for level in range(len(groups) - 2, -1, -1):
        above = materialize(found).withColumn("node", F.floor(F.col("rng") / fan).cast("long"))
        found = sent[level].groupBy(*node).cogroup(above.groupBy("kind", "grp", "node")).applyInArrow(common.lean(back(level == 0)), told)
    return found.select(F.col("grp").alias("chunk"), "starts")


def removed_flags(chunk: C.Chunk, answers: pa.Table, length: int) -> np.ndarray:
    begins = [np.cumsum(C.unpack(x["starts"], np.uint32).astype(np.int64)) for x in C.rows_of(answers)]
    return covered(np.concatenate(begins) if begins else np.empty(0, np.int64), len(chunk.data), length)


def digest(docs: DataFrame, length: int = LENGTH, seed: int = SEED, id_column: str = "doc_id", text_column: str = "text", hot: int = HOT, chunk_bytes: int = C.CHUNK_BYTES, fan: int = exchange.FAN) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row."""
    chunks = C.chunked(docs, id_column, text_column, chunk_bytes=chunk_bytes)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in C.rows_of(left):
            chunk = C.Chunk(row)
            gone = removed_flags(chunk, right, length)
            counts = flagged(gone, chunk)
            begin = gone.copy()
            begin[1:] &= ~gone[:-1]
            edge = chunk.starts[:-1][np.diff(chunk.starts) > 0]
            begin[edge] = gone[edge]
            spans = flagged(begin, chunk)
            for i, (a, b) in enumerate(zip(chunk.starts[:-1].tolist(), chunk.starts[1:].tolist())):
                own = chunk.data[a:b]
                own = own[~gone[a:b]] if counts[i] else own
                out.append((None if chunk.ids[i] == NULL_ID else int(chunk.ids[i]), b - a, int(counts[i]), int(spans[i]), hashlib.sha256(own.tobytes()).hexdigest()))
        return pa.Table.from_batches([C.batch(schema, out)])

    found = find(chunks, length, seed, hot, fan)
    return chunks.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(common.lean(finish), schema)


def strip(docs: DataFrame, length: int = LENGTH, seed: int = SEED, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of docs with what is left of their texts, all other columns as they are.

    Where a removed run splits a character, the character's remaining bytes go too.  A null text stays null.
    """
    names = docs.columns
    others = tuple(c for c in names if c != text_column)
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    number = {c: f"c{i}" for i, c in enumerate(names)}
    carried = plain.withColumn("_null", F.col(number[text_column]).isNull())
    chunks = C.chunked(carried, number[id_column], number[text_column], carry=(*[number[c] for c in others], "_null"))
    schema = [plain.schema[number[c]] for c in others]

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in C.rows_of(left):
            chunk = C.Chunk(row)
            gone = removed_flags(chunk, right, length)
            counts = flagged(gone, chunk)
            texts = []
            for i, (a, b) in enumerate(zip(chunk.starts[:-1].tolist(), chunk.starts[1:].tolist())):
                own = chunk.data[a:b]
                texts.append((own[~gone[a:b]] if counts[i] else own).tobytes().decode("utf-8", "ignore"))
            kept = C.deserialize(chunk.blob)
            null = np.asarray(kept.column(len(others)).fill_null(False))
            columns = [*kept.columns[: len(others)], pa.array(texts, pa.string(), mask=null)]
            out.append(pa.RecordBatch.from_arrays(columns, names=[*[number[c] for c in others], "_left"]))
        return pa.Table.from_batches(out)

    inner = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    found = find(chunks, length, seed)
    done = chunks.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(common.lean(finish), f"{inner}, _left string")
    return done.select(*[F.col("_left").alias(c) if c == text_column else F.col(number[c]).alias(c) for c in names])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(common.table(spark, sf_dir, "documents"))
