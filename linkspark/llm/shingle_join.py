"""Jaccard join of word shingle sets with token-combination prefixes.

The tokens of a document are its different shingles.  Tokens are ordered by class, then
by hash: single (in one document), rare (in up to ``frequent``) and frequent.  If two sets
of similarity t or more agree in all but e tokens of one of them, any e + 1 tokens of it
hold a shared one; this is the prefix.  Single tokens take places of the prefix but can't
be shared.  Rare tokens are indexed one by one, frequent ones in combinations of two.
For these the tokens are dealt to m parts by their hash, and the prefix is extended by m
tokens: then m + 1 shared tokens lie in the prefixes of both sets, so a rare one is among
them, or two frequent ones of one part.  Combinations are made inside parts only; m grows with
the prefix, so that a part has about ``part`` tokens and the keys of a set grow with its
size, not with the square of it.  Sets only match sets of like size, so keys carry a band
of sizes, which also tells m.

Documents with equal sets are one class.  Of the classes under a key, first a leader is
compared with the others, in rounds with another leader each: `STARS` of them, and more
while a round still settles a good part of what is open.  What then still
lies in different components under a common key falls into clusters by such keys.  A
cluster with few pairs is compared pair by pair.  One with many (of near copies that are
not all near each other) is compared by matrix products of blocks: the members outside its
largest component with each other and with that component's members, which needn't be compared
among themselves; blocks return a spanning forest of the links.  No link between different texts is missed.
Pairs are verified with the whole sets.  Pairs and blocks are compared in turns that carry about
`CARRIED` times as many sets as there are, and tables go as soon as what follows is written, so
that disk holds a bounded share of the corpus however many pairs there are.

A shingle's identity is a 64-bit hash of its words.

Defined results: null, empty and wordless texts have no shingles and link with nothing;
a text with fewer words than a shingle has its whole sequence as its one shingle; rows with
equal doc_id are one node of the graph; rows with null doc_id have null component_id; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkspark.llm import chunks as C
from linkspark.llm import common, exchange
from linkspark.llm.graph import forest
from linkspark.operators import graph
from linkspark.operators.storage import drop, materialize, settle

WIDTH = 4
THRESHOLD = (85, 100)
FREQUENT = 64
PART = 8
STARS = 2
#: More rounds of leaders follow while there is this much open, and the last one settled this share of it.
OPEN, SETTLED = 1 << 16, 0.25
#: Sets that a task compares with as many others.
BLOCK = 256
STEP = 4 << 20
#: Rows of a turn that carry sets: so many for each set, or so many if that is more.
CARRIED, CARRIED_LEAST = 2, 1 << 18
MARGIN = 1  # see exchange.key_bits; chance equals only make a single token rare
FACTOR = np.uint64(0x9E3779B97F4A7C15)
NULL_ID = np.iinfo(np.int64).max
SINGLE, RARE, COMMON = 0, 1, 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def sets_of(chunk: C.Chunk, width: int) -> Iterator[np.ndarray]:
    """Sorted hashes of the different shingles of each text of a chunk."""
    chunk.data = LOWER[chunk.data]
    for a, b in chunk.steps(STEP):
        starts, ids, names = common.words(chunk.texts(a, b))
        hashes = C.word_hashes(names)[ids]
        mixed = np.zeros(max(len(hashes) - width + 1, 0), np.uint64)
        for k in range(width if len(mixed) else 0):
            mixed = mixed * FACTOR + hashes[k : k + len(mixed)]
        mixed = C.mix(mixed)
        for x, y in zip(starts[:-1].tolist(), starts[1:].tolist()):
            if y - x >= width:
                yield np.unique(mixed[x : y - width + 1])
            elif y == x:
                yield np.empty(0, np.uint64)
            else:
                key = np.array([y - x], np.uint64)
                for k in range(x, y):
                    key = key * FACTOR + hashes[k : k + 1]
                yield C.mix(key)


def signature(own: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    one, two = C.mix(own), C.mix(own * FACTOR + np.uint64(len(own)))
    return int(one.sum(dtype=np.uint64).view(np.int64)), int(two.sum(dtype=np.uint64).view(np.int64))


def spare(n: int, over: int, under: int) -> int:
    """How many of n tokens a partner of similarity over/under can lack, at most."""
    return n - -(-n * over // under)


def band(n: int, over: int, under: int) -> int:
    return int(math.floor(math.log(n) / math.log(under / over) + 1e-9))


def band_prefix(b: int, over: int, under: int) -> int:
    return spare(math.floor((under / over) ** (b + 1)), over, under) + 1


def band_parts(b: int, over: int, under: int, part: int) -> int:
    """Parts that a band's tokens are dealt to: about `part` tokens of a prefix each, and fewer than sets of the band must share (0: one token at least; all are indexed one by one then)."""
    least = math.ceil((under / over) ** b * over / under - 1e-9)
    return min(max(1, band_prefix(b, over, under) // part), least - 1)


def keys_of(own: np.ndarray, kinds: np.ndarray, over: int, under: int, part: int) -> np.ndarray:
    """Keys under which a set is indexed.  kinds: the class of each token."""
    n = len(own)
    order = np.lexsort((own, kinds))
    tokens, kinds = own[order], kinds[order]
    need = spare(n, over, under) + 1
    plain = int(np.searchsorted(kinds, COMMON))
    out = []
    home = band(n, over, under)
    for b in (home, home + 1):  # bands of partners differ by one at most
        salt = C.mix(np.array([b + 1000], np.uint64))
        parts = band_parts(b, over, under, part)
        take = min(need if plain >= need else need + parts, n)
        out.append(C.mix(tokens[:take][(kinds[:take] == RARE) | (kinds[:take] == COMMON if not parts else False)] + salt))
        if not parts:
            continue
        often = tokens[:take][kinds[:take] == COMMON]
        where = C.mix(often) % np.uint64(parts)
        by = np.argsort(where, kind="stable")
        often, sizes = often[by], np.bincount(where.astype(np.int64), minlength=1)
        ends = np.repeat(np.cumsum(sizes), sizes)
        after = ends - np.arange(len(often)) - 1  # partners of each in its part
        i = np.repeat(np.arange(len(often)), after)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(after) - after, after)
        out.append(C.mix(C.mix(often[i] + salt) * FACTOR + often[j]))
    return np.concatenate(out)


def intersect(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


def in_turns(rows: DataFrame, by: tuple[str, ...], sets: DataFrame, compare: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What compare returns for rows that each carry a set or two, written; rows equal in `by` come together."""
    rows = materialize(rows)
    turns = max(1, math.ceil(rows.count() / max(CARRIED * sets.count(), CARRIED_LEAST)))
    turn = F.pmod(F.xxhash64(*by), F.lit(turns))
    done = [materialize(compare(rows.filter(turn == t) if turns > 1 else rows)) for t in range(turns)]
    drop(rows)
    return reduce(DataFrame.union, done)


def verified(pairs: DataFrame, sets: DataFrame, over: int, under: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    return in_turns(pairs, ("a", "b"), sets, lambda some: compared(some, sets, over, under))


def compared(pairs: DataFrame, sets: DataFrame, over: int, under: int) -> DataFrame:
    with_b = pairs.join(sets.select(F.col("id").alias("b"), F.col("tokens").alias("tb")), "b")
    both = with_b.join(sets.select(F.col("id").alias("a"), F.col("tokens").alias("ta")), "a").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("ta"), batch.column("tb")):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                small, large = min(len(p), len(q)), max(len(p), len(q))
                common_ = intersect(p, q) if under * small >= over * large else 0
                good.append(under * common_ >= over * (small + large - common_))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(common.lean(run), "a long, b long").distinct()


def overlaps(sets: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, by products of blocks of the incidence matrix."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    token = np.unique(np.concatenate(sets), return_inverse=True)[1]
    times = np.bincount(token)
    owner, token = owner[times[token] > 1], (np.cumsum(times > 1) - 1)[token[times[token] > 1]]
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(token[-1]) + 1 if len(token) else 0, columns):
        a, b = np.searchsorted(token, [at, at + columns])
        part = np.zeros((len(sets), columns), np.float32)
        part[owner[a:b], token[a:b] - at] = 1
        out += part @ part.T
    return out


def in_blocks(members: DataFrame, sets: DataFrame, over: int, under: int, block: int) -> DataFrame:
    """Links (a, b) among the members (cluster, id, comp, inner: the cluster's largest component) of clusters, enough of them to span what they join.

    Members outside the largest component, and those inside, are dealt to shards of `block`; a
    task compares two shards by a matrix product, unless both are inside.
    """
    outside = (F.col("comp") != F.col("inner")).cast("int")
    rows = members.withColumn("outside", outside)
    count = rows.groupBy("cluster").agg(F.ceil(F.sum("outside") / block).cast("int").alias("outer"), F.ceil(F.sum(1 - F.col("outside")) / block).cast("int").alias("inners"))
    rows = rows.join(count, "cluster")
    here = F.when(F.col("outside") == 1, F.pmod(F.xxhash64("id"), F.col("outer"))).otherwise(F.col("outer") + F.pmod(F.xxhash64("id"), F.col("inners"))).cast("int")
    last = F.when(F.col("outside") == 1, F.col("outer") + F.col("inners")).otherwise(F.col("outer"))  # inner shards only meet outer ones
    own = rows.withColumn("own", here).withColumn("other", F.explode(F.sequence(F.lit(0), last - 1)))
    own = own.select("cluster", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "id")

    def compare(table: pa.Table) -> pa.Table:
        ids = np.asarray(table.column("id").combine_chunks())
        own = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("tokens")]
        sizes = np.array([len(x) for x in own])
        both = overlaps(own)
        near = np.triu(under * both >= over * (sizes[:, None] + sizes[None, :] - both), 1)
        i, j = np.nonzero(near)
        tree = forest(ids[i], ids[j])
        return pa.table({"a": pa.array(ids[i[tree]], pa.int64()), "b": pa.array(ids[j[tree]], pa.int64())})

    def blocks(some: DataFrame) -> DataFrame:
        whole = some.join(sets, "id").select("cluster", "low", "high", "id", "tokens")
        return whole.groupBy("cluster", "low", "high").applyInArrow(common.lean(compare), "a long, b long")

    return in_turns(own, ("cluster", "low", "high"), sets, blocks)


def link(docs: DataFrame, width: int = WIDTH, threshold: tuple[int, int] = THRESHOLD, frequent: int = FREQUENT, part: int = PART, id_column: str = "doc_id", text_column: str = "text", chunk_bytes: int = C.CHUNK_BYTES, fan: int = exchange.FAN) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row, written.  threshold: a fraction (over, under)."""
    return settle(docs.sparkSession, lambda: _link(docs, width, threshold, frequent, part, id_column, text_column, chunk_bytes, fan))


def _link(docs: DataFrame, width: int, threshold: tuple[int, int], frequent: int, part: int, id_column: str, text_column: str, chunk_bytes: int, fan: int) -> DataFrame:
    over, under = threshold
    chunks = C.chunked(docs, id_column, text_column, chunk_bytes=chunk_bytes)
    bits = exchange.key_bits(chunks.agg(F.sum("n_bytes")).first()[0] or 0, MARGIN)

    def firsts(chunk: C.Chunk) -> Iterator[tuple[int, np.ndarray, tuple[int, int], bool]]:
        """(row, set, signature, whether it is the first such set of the chunk) of each row."""
        seen: set[tuple[int, int]] = set()
        for i, own in enumerate(sets_of(chunk, width)):
            s = signature(own)
            yield i, own, s, s not in seen and len(own) > 0 and chunk.ids[i] != NULL_ID
            if chunk.ids[i] != NULL_ID:
                seen.add(s)

    def short(tokens: np.ndarray) -> np.ndarray:
        return tokens >> np.uint64(64 - bits)

    def lists(row: dict) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        keys = np.sort(short(np.concatenate([own for _, own, _, first in firsts(C.Chunk(row)) if first] or [np.empty(0, np.uint64)])))
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
        yield 0, keys[at], np.diff(np.append(at, len(keys)))

    def kind_of(_: int, total: np.ndarray) -> np.ndarray:
        return np.where(total == 1, SINGLE, np.where(total <= frequent, RARE, COMMON)).astype(np.uint8)

    schema = "id long, n long, s1 long, s2 long, keys binary, tokens binary"

    def index(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = exchange.known(list(C.rows_of(right)), 0)
        out = []
        for row in C.rows_of(left):
            chunk = C.Chunk(row)
            rows = list(firsts(chunk))
            known = np.unique(short(np.concatenate([own for _, own, _, first in rows if first] or [np.empty(0, np.uint64)])))
            for i, own, s, first in rows:
                keys = keys_of(own, kinds[np.searchsorted(known, short(own))], over, under, part) if first else own[:0]
                out.append((None if chunk.ids[i] == NULL_ID else int(chunk.ids[i]), len(own), *s, keys.tobytes() if len(keys) else None, own.tobytes() if len(keys) else None))
        return pa.Table.from_batches([C.batch(schema, out)])

    answers = exchange.totals(chunks, lists, {0: bits}, kind_of, fan)
    indexed = materialize(chunks.groupBy("chunk").cogroup(answers.groupBy("grp")).applyInArrow(common.lean(index), schema))
    drop(chunks)
    rows = materialize(indexed.drop("keys", "tokens"))

    some = rows.filter("n > 0 and id is not null")
    classes = some.groupBy("n", "s1", "s2").agg(F.min("id").alias("rep"))
    classes = materialize(classes)
    heads = indexed.filter("keys is not null").join(classes, ["n", "s1", "s2"])
    sets = heads.groupBy(F.col("rep").alias("id"), "n", "s1", "s2").agg(F.first("tokens").alias("tokens")).select("id", "tokens")  # several of an id whose texts differ
    again = some.groupBy("id").agg(F.count("*").alias("rows")).filter("rows > 1").select("id")
    again = some.join(again, "id", "left_semi").join(classes, ["n", "s1", "s2"])
    tied = again.select(F.col("id").alias("a"), F.col("rep").alias("b")).filter("a <> b").distinct()  # classes of one id

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("keys")]
            again = np.repeat(np.arange(len(keys)), [len(x) for x in keys])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), batch.column("rep").take(pa.array(again))], names=["key", "id"])

    keyed = heads.select("rep", "keys").mapInArrow(common.lean(spread), "key long, id long").distinct()
    shared = keyed.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high").select("key")
    keyed = materialize(keyed.join(shared, "key", "left_semi"))
    used = keyed.select("id").distinct()
    sets = materialize(sets.join(used, "id", "left_semi"))
    drop(indexed)

    def cross(comp: DataFrame) -> DataFrame:
        """Keys and ids that still lie in several components, with the component."""
        own = keyed.join(comp, "id", "left").select("key", "id", F.coalesce("component_id", "id").alias("comp"))
        apart = own.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("key")
        return own.join(apart, "key", "left_semi")

    links, comp = None, None

    def add(pairs: DataFrame) -> None:
        nonlocal links, comp
        found = materialize(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")))
        links = found if links is None else links.union(found)
        comp = graph.components(links).select(F.col("vertex").alias("id"), "component_id")

    def led(open_: DataFrame, order: F.Column) -> DataFrame:
        """The first id of each key with the others of other components."""
        pick = F.struct(order.alias("order"), F.col("id"), F.col("comp"))
        leader = open_.groupBy("key").agg(F.min(pick).alias("l")).select("key", F.col("l.id").alias("a"), F.col("l.comp").alias("ca"))
        return open_.join(leader, "key").filter("comp <> ca").select("a", F.col("id").alias("b")).distinct()

    open_, k, left = keyed.withColumn("comp", F.col("id")), 0, None
    while True:
        found = verified(led(open_, F.xxhash64("id", F.lit(k))), sets, over, under)
        add(found if k else found.union(tied))
        still = materialize(cross(comp))
        drop(open_)
        open_, k, before = still, k + 1, left
        left = open_.count()
        if k >= STARS and (left < OPEN or before is not None and left > (1 - SETTLED) * before):
            break
    # every id of an open key is placed, those of its leader's component too: they may be near the others where the leader is not
    least = open_.groupBy("key").agg(F.min("id").alias("src"))
    clusters = graph.components(open_.join(least, "key").select("src", F.col("id").alias("dst")).distinct()).select(F.col("vertex").alias("id"), F.col("component_id").alias("cluster"))
    placed = open_.join(clusters, "id")
    pairs_at_most = placed.groupBy("cluster", "key").agg(F.count("*").cast("double").alias("n")).groupBy("cluster").agg(F.sum(F.col("n") * F.col("n") / 2).alias("pairs"))
    parts = placed.select("cluster", "comp", "id").distinct().groupBy("cluster", "comp").agg(F.count("*").alias("m"))
    sizes = parts.groupBy("cluster").agg(F.sum("m").alias("m"), F.max_by("comp", F.struct("m", "comp")).alias("inner")).join(pairs_at_most, "cluster")
    sizes = materialize(sizes.withColumn("dense", F.col("pairs") > F.col("m") * F.ceil(F.col("m") / BLOCK)))
    dense = placed.join(sizes.filter("dense"), "cluster").select("cluster", "id", "comp", "inner").distinct()
    sparse = placed.join(sizes.filter("not dense"), "cluster").select("key", "id", "comp")
    left = sparse.select("key", F.col("id").alias("a"), F.col("comp").alias("ca"))
    pairs = sparse.join(left, "key").filter("ca <> comp and a < id").select("a", F.col("id").alias("b")).distinct()
    add(verified(pairs, sets, over, under).union(in_blocks(dense, sets, over, under, BLOCK)))
    drop(keyed, sets, open_)
    whole = classes.join(comp, classes["rep"] == comp["id"], "left").select("n", "s1", "s2", F.coalesce("component_id", "rep").alias("component_id"))
    out = some.join(whole, ["n", "s1", "s2"]).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")
    return out.union(rows.filter("n = 0 or id is null").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("id").alias("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(common.table(spark, sf_dir, "documents"))
