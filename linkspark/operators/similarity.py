"""String and vector similarity, n-gram weights, neighbours."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkspark.operators.storage import materialize

#: Vectors of one shard of the exact neighbour table.
SHARD = 32768


def edit_similarity(a: Column, b: Column) -> Column:
    """exp(-2 x edit distance / both lengths); 0 if either is empty."""
    value = F.exp(-2.0 * F.levenshtein(a, b) / (F.length(a) + F.length(b)))
    return F.when((F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == ""), F.lit(0.0)).otherwise(value)


def length_bonus(name: Column) -> Column:
    return F.least(F.log(F.length(name) + 1.0), F.lit(3.5))


def grams(df: DataFrame, id_column: str, text_column: str, shortest: int = 3, longest: int = 5) -> DataFrame:
    """(id, gram, n): character n-grams with counts."""
    text = F.col(text_column)
    lengths = F.filter(F.sequence(F.lit(shortest), F.lit(longest)), lambda k: k <= F.length(text))
    all_ = F.flatten(F.transform(lengths, lambda k: F.transform(F.sequence(F.lit(1), F.length(text) - k + 1), lambda i: F.substring(text, i, k))))
    return df.select(F.col(id_column).alias("id"), F.explode(all_).alias("gram")).groupBy("id", "gram").agg(F.count("*").alias("n"))


def tfidf(counts: DataFrame, rows: int, min_df: int = 2, max_df: float = 0.99, copies: DataFrame | None = None) -> DataFrame:
    """(id, gram, weight) of unit length: (1 + ln n) x (ln((1 + rows) / (1 + df)) + 1).  An id counts as often in df as `copies` (id, copies) says, else once."""
    counts = materialize(counts)
    own = counts if copies is None else counts.join(copies, "id")
    df = own.groupBy("gram").agg((F.count("*") if copies is None else F.sum("copies")).alias("df")).filter((F.col("df") >= min_df) & (F.col("df") <= max_df * rows))
    w = counts.join(df, "gram").select("id", "gram", ((1 + F.log(F.col("n").cast("double"))) * (F.log((1.0 + rows) / (1 + F.col("df"))) + 1)).alias("w"))
    z = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    return w.select("id", "gram", (F.col("w") / z).alias("weight"))


def similar_pairs(weights: DataFrame, least: float) -> DataFrame:
    """(a, b, sim) with a < b of rows (unit length) whose cosine is above `least`.

    Grams are put in one order, rare ones first.  A row's prefix ends where what follows is shorter than `least`; rows
    whose prefixes share no gram can't be that similar, so common grams hardly ever bring rows together.
    """
    df = weights.groupBy("gram").agg(F.count("*").alias("df"))
    after = Window.partitionBy("id").orderBy("df", "gram").rowsBetween(0, Window.unboundedFollowing)
    ranked = weights.join(df, "gram").withColumn("rest", F.sum(F.col("weight") * F.col("weight")).over(after))
    prefix = ranked.filter(F.col("rest") >= least * least * (1 - 1e-9)).select("id", "gram")
    met = prefix.join(prefix.withColumnRenamed("id", "b"), "gram").filter("id < b").select(F.col("id").alias("a"), "b").distinct()
    left = weights.select(F.col("id").alias("a"), "gram", F.col("weight").alias("wa"))
    right = weights.select(F.col("id").alias("b"), "gram", F.col("weight").alias("wb"))
    sims = met.join(left, "a").join(right, ["b", "gram"]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("sim"))
    return sims.filter(F.col("sim") > least)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column, eps: float = 1e-12) -> Column:
    """v over its length; zeros where that is no more than eps."""
    size = F.sqrt(dot(v, v))
    return F.when(size <= eps, F.transform(v, lambda x: F.lit(0.0))).otherwise(F.transform(v, lambda x: x / size))


def finite(v: Column) -> Column:
    """v with 0 for nulls and values that aren't finite."""
    return F.transform(v, lambda x: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x))


def tiles(rows: DataFrame, shard: Column, shards: int) -> DataFrame:
    """rows with their shard, once for each pair of shards that theirs is in: i <= j, and tile, by which the rows are dealt out.

    Each pair of shards is one task's work, so memory is bounded by the size of two shards.
    """
    dealt = rows.withColumn("shard", shard).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    dealt = dealt.withColumns({"i": F.least("shard", "_other").cast("int"), "j": F.greatest("shard", "_other").cast("int")}).drop("_other")
    return dealt.withColumn("tile", F.col("i") * shards + F.col("j")).repartition(shards * (shards + 1) // 2, "tile")


def shards_for(count: int) -> int:
    """Shards for so many rows: `SHARD` rows at most in each, as a rule, and enough pairs of shards for all cores."""
    return max(4, min(16, count // 1024), -(-count // SHARD))


def stacked(table: pa.Table, column: str = "v") -> np.ndarray:
    """A column of lists of one length as a matrix."""
    v = table.column(column).combine_chunks()
    return np.asarray(v.flatten()).reshape(len(v), -1) if len(v) else np.empty((0, 0))


def _greatest(sims: np.ndarray, k: int, own: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, sim) of the k greatest of each row by 9 decimals, then by least id; what is -inf doesn't count.

    The k-th greatest of some columns is no greater than that of all, so only values that reach it are rounded and sorted.
    """
    some = sims[:, : max(1024, 4 * k)]
    floor = np.partition(some, some.shape[1] - k, axis=1)[:, some.shape[1] - k] - 2e-9 if some.shape[1] > k else np.full(len(sims), -np.inf)
    at, column = np.nonzero(sims >= floor[:, None])
    value = np.round(sims[at, column], 9)
    good = np.isfinite(value)
    at, column, value = at[good], column[good], value[good]
    order = np.lexsort((other[column], -value, at))
    at, column, value = at[order], column[order], value[order]
    first = np.searchsorted(at, np.arange(len(sims)))
    kept = np.arange(len(at)) - first[at] < k
    return at[kept], column[kept], value[kept]


def neighbours(vectors: DataFrame, k: int, shards: int | None = None, id_column: str = "vec_id", vector_column: str = "v") -> DataFrame:
    """(src, dst, rank from 0, sim): for each vector the k others of greatest dot product (9 decimals, then id).

    Rows are dealt to shards of at most about `SHARD` rows; a task multiplies two shards and keeps k for each row of both.
    The table is written, as what follows reads it more than once.
    """
    shards = shards or shards_for(vectors.count())
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v"))

    def block(table: pa.Table) -> pa.Table:
        ids, shard, m = np.asarray(table.column("id")), np.asarray(table.column("shard")), stacked(table)
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        out = []
        for one, two in ((i, j), (j, i))[: 1 + (i != j)]:
            a, b = np.flatnonzero(shard == one), np.flatnonzero(shard == two)
            if not len(a) or not len(b):
                continue
            right, names = np.ascontiguousarray(m[b].T), ids[b]
            step = max(1, (1 << 21) // len(b))
            for at in range(0, len(a), step):
                some = a[at : at + step]
                sims = m[some] @ right
                if one == two:
                    sims[ids[some][:, None] == names[None, :]] = -np.inf
                row, column, value = _greatest(sims, k, ids[some], names)
                out.append((ids[some][row], names[column], value))
        src, dst, sim = (np.concatenate(x) for x in zip(*out)) if out else (np.empty(0), np.empty(0), np.empty(0))
        return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64()), "sim": pa.array(sim, pa.float64())})

    near = tiles(rows, F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"), shards).groupBy("tile").applyInArrow(block, "src long, dst long, sim double")
    place = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("sim"), "dst"))
    return materialize(near.withColumn("place", place).filter(F.col("place") <= k).select("src", "dst", (F.col("place") - 1).alias("rank"), "sim"))


def pairs_above(vectors: DataFrame, least: float, id_column: str, vector_column: str = "v") -> DataFrame:
    """(a, b) with a < b of vectors whose dot product (9 decimals) is greater than `least`, two shards at a time."""
    shards = shards_for(vectors.count())
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v"))

    def block(table: pa.Table) -> pa.Table:
        ids, shard, m = np.asarray(table.column("id")), np.asarray(table.column("shard")), stacked(table)
        a, b = np.flatnonzero(shard == table.column("i")[0].as_py()), np.flatnonzero(shard == table.column("j")[0].as_py())
        out = []
        step = max(1, (1 << 21) // max(1, len(b)))
        for at in range(0, len(a) if len(b) else 0, step):
            some = a[at : at + step]
            row, column = np.nonzero(np.round(m[some] @ m[b].T, 9) > least)
            x, y = ids[some][row], ids[b][column]
            out.append(np.stack([x, y])[:, x < y if a[0] == b[0] else x != y])
        x, y = np.sort(np.concatenate(out, axis=1), axis=0) if out else np.empty((2, 0), np.int64)
        return pa.table({"a": pa.array(x, pa.int64()), "b": pa.array(y, pa.int64())})

    return tiles(rows, F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"), shards).groupBy("tile").applyInArrow(block, "a long, b long")


def central_names(names: DataFrame, group: str, name: str) -> DataFrame:
    """(group, canonical_name): of each group the name with the greatest (sum of similarity x frequency + own frequency) x length bonus.

    Similarity of names is exp(-edit distance / greatest length in the group).
    """
    counted = names.groupBy(group, name).agg(F.count("*").alias("n"))
    total = counted.groupBy(group).agg(F.sum("n").alias("total"), F.max(F.length(name)).alias("longest"))
    freq = counted.join(total, group).select(F.col(group).alias("g"), F.col(name).alias("a"), (F.col("n") / F.col("total")).alias("fa"), "longest")
    other = freq.select("g", F.col("a").alias("b"), F.col("fa").alias("fb"))
    sim = F.exp(-F.levenshtein("a", "b").cast("double") / F.col("longest"))
    scored = freq.join(other, "g").groupBy("g", "a", "fa").agg(F.sum(F.when(F.col("a") == F.col("b"), 0.0).otherwise(sim * F.col("fb"))).alias("s"))
    scored = scored.withColumn("score", F.round((F.col("s") + F.col("fa") + F.col("fa")) * length_bonus(F.col("a")), 9))
    best = scored.groupBy("g").agg(F.min(F.struct((-F.col("score")).alias("score"), "a")).alias("b"))
    return best.select(F.col("g").alias(group), F.col("b.a").alias("canonical_name"), (-F.col("b.score")).alias("score"))
