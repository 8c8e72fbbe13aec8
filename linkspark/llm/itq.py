"""Near-duplicate vectors by iterative quantisation.

Fit: on a sample of at most ``sample`` vectors (those with the least hash), centre them,
turn them to principal axes and alternate between binary codes and the rotation that
fits them best; this makes balanced codes.  Several rotations from different starts
give as many bits as the tables need.  The sample only shapes the codes: all vectors are
indexed.

Retrieve: the codes are cut into substrings, one hash table for each (multi-index
Hamming).  Two vectors meet if a substring is equal.  Bits are signs of the vectors
themselves, not of the centred ones: with angle t between two of them each bit differs
with probability about t/pi wherever they lie, so the number of tables is chosen for a
miss rate of ``miss`` at the threshold itself; pairs above it are missed far less often.
Centring would widen the angles of vectors with a common direction and lose links.  The
substrings grow with the logarithm of the number of vectors, so buckets stay small
unless vectors share a direction; then buckets are larger and cost more comparisons.

Filter: what is sent to the tables is a number and the code of each vector, not the vector.
Members of a bucket are compared by the Hamming distance of their whole codes, and only those
with a partner within ``DEVIATIONS`` standard deviations of what is expected at the threshold go on.
Buckets of more than ``shard`` vectors are dealt to several tasks, a pair of shards each.

Rerank: these members get their original vectors and are compared by cosine in double
precision, in blocks.  A pair that meets in several tables counts in the first.  A task
returns counts of links and a spanning forest of them, never all pairs.

Equal vectors with equal labels are compared once and carry their number.

Defined results: vectors that are null, zero, or hold null or non-finite components, and
rows with null label, link with nothing and are their own component; vectors of another
length than most (the sample's commonest) are compared exactly among their own length;
rows that repeat a vec_id are vectors of their own, each with its links; an empty table
gives no rows; only the three named columns are read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.llm import common
from linkspark.llm.graph import forest
from linkspark.operators import graph
from linkspark.operators.storage import materialize

THRESHOLD = 0.93
SAMPLE = 20_000
ROUNDS = 30
MISS = 0.002
DEVIATIONS = 5.0
SHARD = 2048
BUCKET = 64  # vectors that a bucket should hold on average, at most


def rotations(sample: np.ndarray, count: int, rounds: int = ROUNDS, seed: int = 0) -> np.ndarray:
    """Projections (count x dim x dim) from vectors of unit length."""
    mean = sample.mean(0) if len(sample) else np.zeros(sample.shape[1])
    centred = sample - mean
    axes = np.linalg.eigh(centred.T @ centred)[1][:, ::-1]
    turned = centred @ axes
    out = []
    for k in range(count):
        q = np.linalg.qr(np.random.default_rng(seed + k).normal(size=(sample.shape[1],) * 2))[0]
        for _ in range(rounds if len(sample) else 0):
            codes = np.where(turned @ q >= 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(codes.T @ turned)
            q = right.T @ left.T
        out.append(axes @ q)
    return np.stack(out)


def plan(vectors: int, dim: int, threshold: float, miss: float) -> tuple[int, int]:
    """(bits of a substring, tables)."""
    bits = max(8, min(24, math.ceil(math.log2(max(vectors, 1) / BUCKET + 1))))
    bits = min(bits, dim)
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - same))


def substrings(unit: np.ndarray, turns: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Keys of each vector in each table."""
    per_turn = turns.shape[2] // bits
    out = np.empty((len(unit), tables), np.int64)
    weights = 1 << np.arange(bits)
    for k in range(tables):
        if k % per_turn == 0:
            signs = unit @ turns[k // per_turn] >= 0
        at = (k % per_turn) * bits
        out[:, k] = signs[:, at : at + bits] @ weights
    return out


def codes_of(unit: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """All bits of each vector, 64 to a number."""
    signs = np.concatenate([unit @ t >= 0 for t in turns], 1)
    packed = np.packbits(signs, axis=1)
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))).view(np.uint64)


def radius(bits: int, threshold: float) -> int:
    """Hamming distance of whole codes that pairs at the threshold hardly ever exceed."""
    p = math.acos(threshold) / math.pi
    return math.ceil(bits * p + DEVIATIONS * math.sqrt(bits * p * (1 - p)))


def alive(codes: np.ndarray, first: np.ndarray, second: np.ndarray, limit: int, block: int = 512) -> np.ndarray:
    """Flags of the rows that have a partner within the limit, between rows `first` and `second` (the same rows, or none in common)."""
    out = np.zeros(len(codes), bool)
    alike = first is second
    for at in range(0, len(first), block):
        a = first[at : at + block]
        for to in range(at if alike else 0, len(second), block):
            b = second[to : to + block]
            near = np.zeros((len(a), len(b)), np.uint16)
            for k in range(codes.shape[1]):
                near += np.bitwise_count(codes[a, k][:, None] ^ codes[b, k][None, :])
            near = near <= limit
            if alike and at == to:
                near &= np.arange(len(a))[:, None] != np.arange(len(b))[None, :]
            out[a] |= near.any(1)
            out[b] |= near.any(0)
    return out


def compare(ids: np.ndarray, sizes: np.ndarray, unit: np.ndarray, keys: np.ndarray, table: int, threshold: float, first: np.ndarray, second: np.ndarray, block: int = 512) -> tuple[list, list]:
    """Links between rows `first` and `second` (the same rows, or none in common) that no earlier table has: (id, partners' number), (id, id)."""
    counts: list[tuple[np.ndarray, np.ndarray]] = []
    links: list[tuple[np.ndarray, np.ndarray]] = []
    alike = first is second
    for at in range(0, len(first), block):
        a = first[at : at + block]
        for to in range(at if alike else 0, len(second), block):
            b = second[to : to + block]
            near = unit[a] @ unit[b].T >= threshold
            if alike and at == to:
                near &= np.arange(len(a))[:, None] < np.arange(len(b))[None, :]
            i, j = np.nonzero(near)
            if not len(i):
                continue
            i, j = a[i], b[j]
            if table:
                new = ~(keys[i, :table] == keys[j, :table]).any(1)
                i, j = i[new], j[new]
            if len(i):
                counts += [(ids[i], sizes[j]), (ids[j], sizes[i])]
                tree = forest(ids[i], ids[j])
                links.append((ids[i[tree]], ids[j[tree]]))
    return counts, links


def _unit(column: pa.Array) -> np.ndarray:
    dim = len(column[0]) if len(column) else 0
    flat = np.asarray(column.flatten()).astype(np.float64).reshape(-1, dim)
    return flat / np.sqrt((flat * flat).sum(1, keepdims=True))


def link(vectors: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE, miss: float = MISS, shard: int = SHARD, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row."""
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v"), F.col(label_column).alias("label"))
    good = F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    good = F.coalesce(good, F.lit(False))
    kind = vectors.schema[label_column].dataType.simpleString()
    valid = rows.filter(good)
    hashes = [F.xxhash64("label", "v").alias("h1"), F.xxhash64(F.lit(1), "v", "label").alias("h2")]
    grouped = valid.groupBy("label", "v").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("size"))
    classes = materialize(grouped.select("*", *hashes, F.monotonically_increasing_id().alias("id")))
    total, dim = classes.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").select("n", "dim").first() or (0, 1)
    bits, tables = plan(total, dim, threshold, miss)
    picked = common.sampled(classes.filter(F.size("v") == dim), sample, "h1", total).select("v").toArrow().column("v").combine_chunks()
    picked = picked.chunk(0) if isinstance(picked, pa.ChunkedArray) and picked.num_chunks else picked
    turns = rotations(_unit(picked) if len(picked) else np.empty((0, dim)), math.ceil(tables / (dim // bits)))
    limit = radius(turns.shape[0] * dim, threshold)

    def key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.asarray(batch.column("v").value_lengths())
            for n in np.unique(lengths):
                part = batch.filter(pa.array(lengths == n))
                if n == dim:
                    unit = _unit(part.column("v"))
                    own, codes = substrings(unit, turns, bits, tables), codes_of(unit, turns)
                else:  # one table for a length, and codes that tell nothing
                    own, codes = np.full((part.num_rows, 1), -int(n), np.int64), np.zeros((part.num_rows, 1), np.uint64)
                k = own.shape[1]
                again = pa.array(np.repeat(np.arange(part.num_rows), k))
                code = pa.array([x.tobytes() for x in codes], pa.binary())
                cols = [*(part.column(c).take(again) for c in ("label", "id", "size")), code.take(again)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.tile(np.arange(k, dtype=np.int32), part.num_rows)), pa.array(own.reshape(-1))], names=["label", "id", "size", "code", "t", "key"])

    keyed = materialize(classes.select("label", "id", "size", "v").mapInArrow(common.lean(key_rows), f"label {kind}, id long, size long, code binary, t int, key long"))
    met = keyed.join(keyed.groupBy("label", "t", "key").agg(F.count("*").alias("n")).filter("n > 1"), ["label", "t", "key"])
    met = met.withColumn("shards", F.ceil(F.col("n") / shard).cast("int")).withColumn("own", F.pmod(F.xxhash64("id", "t"), F.col("shards")).cast("int"))
    dealt = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    place = ["label", "t", "key", "low", "high"]
    dealt = dealt.select("label", "t", "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "id", "size", "own", "code")
    carried = f"label {kind}, t int, key long, low int, high int, id long, size long, own int"

    def together(df: DataFrame) -> DataFrame:
        """Rows of a place one after the other in one partition."""
        return df.withColumn("place", F.xxhash64(*place)).repartition("place").sortWithinPartitions("place", *place, "id")

    def by_place(done):
        """Call done with whole places, some of them at once."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            last = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                marks = np.asarray(batch.column("place"))
                cut = int(np.searchsorted(marks, marks[-1]))
                if last is not None and marks[0] != last and held:
                    yield from done(*places_of(held))
                    held = []
                if cut:
                    yield from done(*places_of([*held, batch.slice(0, cut)]))
                    held = []
                held.append(batch.slice(cut))
                last = marks[-1]
            if held:
                yield from done(*places_of(held))

        return run

    def places_of(parts: list[pa.RecordBatch]) -> tuple[pa.RecordBatch, list[tuple[int, int, tuple]]]:
        got = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        names = list(zip(*[got.column(c).to_pylist() for c in place]))
        bounds = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1]], len(names)]
        return got, [(a, b, names[a]) for a, b in zip(bounds[:-1], bounds[1:]) if b - a > 1]

    def sides(own: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        first = np.flatnonzero(own == low)
        return first, first if low == high else np.flatnonzero(own == high)

    def near(got: pa.RecordBatch, spans: list) -> Iterator[pa.RecordBatch]:
        own, keep = np.asarray(got.column("own")), np.zeros(got.num_rows, bool)
        for a, b, (_, _, _, low, high) in spans:
            codes = np.frombuffer(b"".join(got.column("code").slice(a, b - a).to_pylist()), np.uint64).reshape(b - a, -1)
            keep[a:b] = alive(codes, *sides(own[a:b], low, high), limit)
        yield got.filter(pa.array(keep)).select([x.split()[0] for x in carried.split(", ")])

    def verify(got: pa.RecordBatch, spans: list) -> Iterator[pa.RecordBatch]:
        ids, sizes, own = (np.asarray(got.column(c)) for c in ("id", "size", "own"))
        lengths = np.asarray(got.column("v").value_lengths())
        counts, links = [], []
        for a, b, (_, table, key, low, high) in spans:
            unit = _unit(got.column("v").slice(a, b - a))
            keys = substrings(unit, turns, bits, table) if table and key >= 0 and lengths[a] == dim else None
            c, x = compare(ids[a:b], sizes[a:b], unit, keys, table, threshold, *sides(own[a:b], low, high))
            counts += c
            links += x
        if counts:
            i, n = (np.concatenate(x) for x in zip(*counts))
            who, at = np.unique(i, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(np.bincount(at, n, len(who)).astype(np.int64)), pa.nulls(len(who), pa.int64())], names=["id", "n", "to"])
            i, j = (np.concatenate(x) for x in zip(*links))
            tree = forest(i, j)
            yield pa.RecordBatch.from_arrays([pa.array(i[tree]), pa.array(np.zeros(int(tree.sum()), np.int64)), pa.array(j[tree])], names=["id", "n", "to"])

    live = together(dealt).mapInArrow(common.lean(by_place(near)), carried)
    reranked = together(live.join(classes.select("id", "v"), "id"))
    found = materialize(reranked.mapInArrow(common.lean(by_place(verify)), "id long, n long, to long"))
    counts = found.filter("to is null").groupBy("id").agg(F.sum("n").alias("others"))
    roots = graph.components(found.filter("to is not null").select(F.col("id").alias("src"), F.col("to").alias("dst")))
    named = classes.drop("v").join(counts, "id", "left").join(roots, classes["id"] == roots["vertex"], "left").withColumn("root", F.coalesce("component_id", "id"))
    least = named.groupBy("root").agg(F.min("vec_id").alias("least"))
    by_class = named.select("root", "size", "h1", "h2", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")).join(least, "root").drop("root")
    by_class = materialize(by_class)
    # rows get their class; classes of very many rows are few, so they go to all tasks
    keys, many = valid.select("vec_id", *hashes), max(1000, (by_class.agg(F.sum("size")).first()[0] or 0) // 1000)
    large = F.broadcast(by_class.filter(F.col("size") > many).drop("size"))
    small = by_class.filter(F.col("size") <= many).drop("size")
    linked = keys.join(large, ["h1", "h2"]).union(keys.join(F.broadcast(large.select("h1", "h2")), ["h1", "h2"], "left_anti").join(small, ["h1", "h2"]))
    linked = linked.select("vec_id", "n_links", F.col("least").alias("component_id"))
    alone = rows.filter(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(common.table(spark, sf_dir, "embeddings"))
