"""Language identification with a string kernel, Nyström landmarks and kernel ridge regression.

A text is the set of its byte n-grams of lengths 1 to 3 (the blended spectrum, by
presence), after lower-casing and turning each ASCII character that is no letter into
a space.  The kernel of two texts is the size of the intersection over the geometric
mean of the sizes.  Landmarks span the feature space (Nyström), a ridge regression for
each language against the rest is fitted there, and both are folded into one weight
per n-gram and language, so that a batch of texts is scored by one (sparse) matrix
product of presence and weights.

Learning takes at most ``per_language`` labelled texts of each language, those with the
least hash of their id and text (equal rows count once); of these, ``landmarks`` are landmarks.
Counts and predictions cover whole texts.

Defined results: null text or a text without a letter is ``und`` with score 0; without
any labelled text all are ``und``; ties go to the first language in order of name; every
input row gives one row, repeated ids too; the carried columns keep their names, and other columns
than these, the text and, for learning, the label are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkspark.llm import common

PER_LANGUAGE = 300
LANDMARKS = 60
RIDGE = 1e-2
SHARPNESS = 6.0
BLOCK = 64  # texts of one matrix product
FOLD = np.arange(256, dtype=np.uint8)
FOLD[:0x80] = 0x20
FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)


def grams(data: np.ndarray) -> np.ndarray:
    """Sorted distinct codes of the 1-, 2- and 3-grams of folded bytes."""
    x = data.astype(np.uint32)
    two = x[:-1] << 8 | x[1:]
    three = two[:-1] << 8 | x[2:]
    return np.concatenate([np.flatnonzero(np.bincount(data, minlength=256)).astype(np.uint32), np.unique(two) + (1 << 8), np.unique(three) + (1 << 16) + (1 << 8)])


def folded(texts: pa.Array) -> list[np.ndarray]:
    """Folded bytes of each (lower-cased) text."""
    offsets, data = common.bytes_of(pc.fill_null(texts, ""))
    data = FOLD[data]
    return [data[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


class Model:
    """codes: sorted n-grams; weights: n-grams x languages; languages."""

    def __init__(self, codes: np.ndarray, weights: np.ndarray, languages: list[str]):
        self.codes, self.weights, self.languages = codes, weights.astype(np.float32), languages

    def decide(self, texts: pa.Array) -> np.ndarray:
        """Regression values, texts x languages."""
        sizes, found = [], []
        for data in folded(texts):
            own = grams(data)
            at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
            found.append(at[self.codes[at] == own])
            sizes.append(max(len(own), 1))
        out = np.empty((len(sizes), len(self.languages)))
        for at in range(0, len(sizes), BLOCK):
            some = found[at : at + BLOCK]
            present = np.zeros((len(some), len(self.codes)), np.float32)
            present[np.repeat(np.arange(len(some)), [len(x) for x in some]), np.concatenate(some)] = 1
            out[at : at + len(some)] = present @ self.weights
        return out / np.sqrt(np.asarray(sizes, float))[:, None]

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        values = self.decide(texts) * SHARPNESS
        values = np.exp(values - values.max(1, keepdims=True))
        values /= values.sum(1, keepdims=True)
        best = values.argmax(1)
        return [self.languages[k] for k in best], values[np.arange(len(best)), best]


def solve(sets: list[np.ndarray], labels: list[str], is_landmark: list[bool], ridge: float) -> Model | None:
    """The folded model from n-gram sets of labelled texts."""
    if not any(len(s) for s, m in zip(sets, is_landmark) if m):
        return None
    languages = sorted(set(labels))
    marks = [s for s, m in zip(sets, is_landmark) if m]
    codes = np.unique(np.concatenate(marks))
    spread = np.zeros((len(marks), len(codes)), np.float32)
    for i, s in enumerate(marks):
        spread[i, np.searchsorted(codes, s)] = 1 / np.sqrt(max(len(s), 1))
    kernel = np.empty((len(sets), len(marks)))
    for i, s in enumerate(sets):
        at = np.minimum(np.searchsorted(codes, s), len(codes) - 1)
        at = at[codes[at] == s]
        kernel[i] = spread[:, at].sum(1) / np.sqrt(max(len(s), 1))
    among = kernel[np.asarray(is_landmark)]
    values, vectors = np.linalg.eigh((among + among.T) / 2)
    good = values > 1e-8 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    features = kernel @ root
    target = np.where(np.asarray(labels)[:, None] == np.asarray(languages)[None, :], 1.0, -1.0)
    share = np.asarray([labels.count(x) for x in languages])
    weight = (len(labels) / (len(languages) * share))[[languages.index(x) for x in labels]]  # languages count alike
    left = features.T @ (features * weight[:, None]) + ridge * len(sets) / len(marks) * np.eye(features.shape[1])
    beta = root @ np.linalg.solve(left, features.T @ (target * weight[:, None]))
    return Model(codes, (spread.T.astype(float) @ beta), languages)


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS, ridge: float = RIDGE, id_column: str = "doc_id", text_column: str = "text", label_column: str = "lang") -> Model | None:
    """Learn from rows with text and label.  At most languages x per_language n-gram sets come to the driver."""
    rows = labelled.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.col(label_column).alias("lang")).filter("text is not null and lang is not null")
    ways = 1 << 40
    placed = rows.withColumn("h", F.pmod(F.xxhash64("id", "text"), F.lit(ways)))
    share = F.least(F.lit(1.0), (2 * per_language + 100) / F.col("n"))  # few rows lie below, however many there are
    bound = rows.groupBy("lang").agg(F.count("*").alias("n")).select("lang", (share * ways).cast("long").alias("bound"))
    near = placed.join(F.broadcast(bound), "lang").filter("h <= bound").dropDuplicates(["lang", "h"])
    used = near.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("r") <= per_language)
    used = used.select("id", "lang", "r", F.lower("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.steps(batches, "text"):
            sets = [grams(x).tobytes() for x in folded(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.string()), batch.column("lang"), batch.column("r"), pa.array(sets, pa.binary())], names=["id", "lang", "r", "grams"])

    got = used.mapInArrow(common.lean(run), "id string, lang string, r int, grams binary").collect()
    got = sorted(got, key=lambda x: (x.lang, x.r, x.id, bytes(x.grams)))
    return solve([np.frombuffer(x.grams, np.uint32) for x in got], [x.lang for x in got], [x.r <= landmarks for x in got], ridge)


def predict(docs: DataFrame, model: Model | None, carry: tuple[str, ...] = ("doc_id",), text_column: str = "text") -> DataFrame:
    """The carried columns, lang_pred and score of each row."""
    if model is None:
        return docs.select(*carry, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    fields = [docs.schema[c] for c in carry]
    text = F.col(text_column)
    lettered = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("_carried"), F.when(lettered, F.lower(text)).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.steps(batches, "text"):
            texts = batch.column("text")
            none = pa.array(np.asarray(texts.is_null()))
            languages, score = model.predict(texts)
            yield pa.RecordBatch.from_arrays([batch.column("_carried"), pc.if_else(none, "und", pa.array(languages, pa.string())), pc.if_else(none, 0.0, pa.array(score))], names=["_carried", "lang_pred", "score"])

    inner = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in fields)
    out = rows.mapInArrow(common.lean(run), f"_carried struct<{inner}>, lang_pred string, score double")
    return out.select(*[F.col(f"_carried.`{c}`").alias(c) for c in carry], "lang_pred", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    held = F.coalesce(common.crc_mod("doc_id", 4) == 2, F.lit(False))
    model = fit(docs.filter(~held))
    return predict(docs.withColumn("held_out", held), model, ("doc_id", "held_out"))
