"""Vectors: fused streams, reductions, consensus, central members."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkspark.operators.similarity import dot, unit


def fuse(streams: dict[str, Column], shares: dict[str, float]) -> Column:
    """Unit streams, each times the root of its share, one after the other, of unit length together."""
    total = sum(shares.values())
    times = lambda w: lambda x: x * F.lit(w)
    return unit(F.concat(*[F.transform(unit(c), times((shares[n] / total) ** 0.5)) for n, c in streams.items()]))


def truncated_svd(vectors: DataFrame, k: int, damping: float = 0.4, floor: float = 1e-8, id_column: str = "vec_id", vector_column: str = "v") -> DataFrame:
    """(id, scores): scores of the k greatest singular vectors, damped by sigma ** -damping, signs fixed.

    The Gram matrix of the columns, dim x dim, is summed on the executors; only it comes to the driver.
    """
    matrix = _column_gram(vectors, vector_column)
    values, axes = np.linalg.eigh(matrix)
    order = np.argsort(-values)[:k]
    sigma = np.sqrt(np.maximum(values[order], 0.0))
    axes = _signed(axes[:, order]) * np.maximum(sigma, floor) ** -damping
    return _projected(vectors, axes, np.zeros(len(matrix)), id_column, vector_column)


def pca(vectors: DataFrame, k: int, id_column: str = "vec_id", vector_column: str = "v") -> DataFrame:
    """(id, scores) by Spark's principal components."""
    from pyspark.ml.feature import PCA

    ready = vectors.select(id_column, array_to_vector(F.col(vector_column)).alias("x"))
    out = PCA(k=k, inputCol="x", outputCol="y").fit(ready).transform(ready)
    return out.select(id_column, vector_to_array("y").alias("scores"))


def _column_gram(vectors: DataFrame, vector_column: str) -> np.ndarray:
    def part(batches):
        total = None
        for batch in batches:
            m = np.stack(batch["v"].to_numpy()) if len(batch) else None
            if m is not None:
                total = m.T @ m if total is None else total + m.T @ m
        if total is not None:
            yield pd.DataFrame({"g": [total.ravel().tolist()]})

    rows = vectors.select(F.col(vector_column).cast("array<double>").alias("v")).mapInPandas(part, "g array<double>")
    summed = rows.select(F.posexplode("g").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()
    side = int(round(len(summed) ** 0.5))
    return np.array([r["x"] for r in summed]).reshape(side, side)


def _signed(axes: np.ndarray) -> np.ndarray:
    """Axes whose entry of greatest size is positive."""
    top = np.abs(axes).argmax(0)
    return axes * np.sign(axes[top, np.arange(axes.shape[1])])


def _projected(vectors: DataFrame, axes: np.ndarray, mean: np.ndarray, id_column: str, vector_column: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            if len(batch):
                out = (np.stack(batch["v"].to_numpy()) - mean) @ axes
                yield pd.DataFrame({id_column: batch[id_column], "scores": list(out)})

    kind = vectors.schema[id_column].dataType.simpleString()
    return vectors.select(id_column, F.col(vector_column).cast("array<double>").alias("v")).mapInPandas(run, f"{id_column} {kind}, scores array<double>")


def top_eigenpairs(m: np.ndarray, k: int, least: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest eigenvalues above `least` and their vectors, zeros where there are fewer."""
    values, vectors = np.linalg.eigh((m + m.T) / 2)
    order = [i for i in np.argsort(-values) if values[i] > least][:k]
    out_values, out_vectors = np.zeros(k), np.zeros((len(m), k))
    out_values[: len(order)] = values[order]
    out_vectors[:, : len(order)] = _signed(vectors[:, order]) if order else 0
    return out_values, out_vectors


def random_projections(vectors: DataFrame, runs: int, dim: int, seed: int = 42, vector_column: str = "v") -> list[np.ndarray]:
    """An ensemble of seeded projections; run i has the seed + i x 104729 modulo 2^31."""
    width = vectors.select(F.size(vector_column).alias("n")).first()["n"]
    return [np.random.default_rng((seed + i * 104729) % 2**31).normal(size=(width, dim)) / dim**0.5 for i in range(runs)]


def consensus(vectors: DataFrame, runs: int = 3, dim: int = 8, anchors: int = 256, seed: int = 42, id_column: str = "vec_id", vector_column: str = "v") -> DataFrame:
    """(id, scores): kernel principal components of the mean cosine over an ensemble of projections.

    The kernel among at most `anchors` rows (least hash) is decomposed on the driver; all
    rows are projected on the executors.
    """
    turns = random_projections(vectors, runs, dim, seed, vector_column)
    picked = vectors.orderBy(F.xxhash64(id_column), id_column).limit(anchors).select(F.col(vector_column).cast("array<double>").alias("v")).collect()
    base = np.array([r["v"] for r in picked])
    halves = [_unit_rows(base @ t) for t in turns]
    kernel = np.clip(sum(h @ h.T for h in halves) / runs, -1, 1)
    means, grand = kernel.mean(0), kernel.mean()
    values, axes = top_eigenpairs(kernel - means[:, None] - means[None, :] + grand, dim)
    weights = axes / np.sqrt(np.where(values > 0, values, 1.0))

    def run(batches):
        for batch in batches:
            if len(batch):
                x = np.stack(batch["v"].to_numpy())
                k = np.clip(sum(_unit_rows(x @ t) @ h.T for t, h in zip(turns, halves)) / runs, -1, 1)
                out = (k - k.mean(1, keepdims=True) - means[None, :] + grand) @ weights
                yield pd.DataFrame({id_column: batch[id_column], "scores": list(out)})

    kind = vectors.schema[id_column].dataType.simpleString()
    return vectors.select(id_column, F.col(vector_column).cast("array<double>").alias("v")).mapInPandas(run, f"{id_column} {kind}, scores array<double>")


def _unit_rows(m: np.ndarray) -> np.ndarray:
    size = np.sqrt((m * m).sum(1, keepdims=True))
    return np.divide(m, size, out=np.zeros_like(m), where=size > 1e-12)


def central_vectors(members: DataFrame, group: str, id_column: str, count: str, vector_column: str = "v") -> DataFrame:
    """(group, id, score): of each group the member of greatest similarity to the others by frequency, plus its own.

    A sum of dot products is the dot product with the sum, so a group is one vector.
    """
    freq = members.withColumn("fa", F.col(count) / F.sum(count).over(Window.partitionBy(group)))
    long = freq.select(group, "fa", F.posexplode(vector_column).alias("pos", "x")).groupBy(group, "pos").agg(F.sum(F.col("x") * F.col("fa")).alias("m"))
    centre = long.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("s")).select(group, F.transform("s", lambda x: x["m"]).alias("c"))
    scored = freq.join(centre, group).withColumn("score", F.round(dot(F.col(vector_column), F.col("c")) + F.col("fa"), 9))
    best = scored.groupBy(group).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col(id_column).alias("id"))).alias("b"))
    return best.select(group, F.col("b.id").alias(id_column), (-F.col("b.s")).alias("score"))
