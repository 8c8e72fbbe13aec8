"""Licence scans: a trained paragraph classifier, confirmed by comparison with templates.

The unit is the line, as texts come with one paragraph or one wrapped piece of it on each.
Features of a line are the words and word pairs (lower case, without punctuation at the
ends) that the templates hold; a multinomial logistic regression with ridge penalty over
these sparse features gives a probability to each licence family and to ``unknown``.  It is
trained here, by gradient steps on the driver, on the templates, on variants of them
(parts, other versions and holders, added words) and, as unknown, on sentences that speak
of licences without naming one and on a bounded sample of the corpus' own lines: of up to
``sample`` / 4 documents, up to ``sample`` lines of at most ``longest`` characters, both those with the
least hashes.  Sampled lines that have much in common with a template are left out, as a
corpus may be full of licences.  A temperature is fitted on variants left out of
the training, so that probabilities are calibrated.

A line whose likeliest family has at least ``least`` probability is a candidate.  It is
confirmed if a template of that family is found where it stands: around the line, over the
lines of the same paragraph (up to an empty line), the part of the text that is nearest to the template
is looked for, by edit distance over words.  Similarity is 1 less that distance over the template's
weight.  Words too many cost 1; missing or other words cost their weight in the template, which is
``MAIN`` for words that no other family's templates have, else 1.

Defined results: null, empty and wordless texts have no paragraphs; repeated rows each
give a row; ties between families go to the first by name, between templates to any, as only their
similarity is told; an empty table gives no rows; only the two named columns are read, and the id keeps its name and type.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.llm import common

UNKNOWN = "unknown"
LEAST = 0.6
SHARED = 0.75
MAIN = 3.0
SAMPLE = 2000
LONGEST = 2000
#: Word pairs of a template, in number or share, from which on a sampled line is no negative example.
LIKE_PAIRS, LIKE_SHARE = 3, 0.4
#: How texts state licences of each family.
TEMPLATES: dict[str, list[str]] = {
    "agpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License", "Licensed under the GNU Affero General Public License, version 3."],
    "apache": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Released under the Apache License 2.0."],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Licensed under the BSD 3-Clause License.", "Released under the BSD 2-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "cc-by-nc": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related rights to this work.", "Released under CC0 1.0 Universal, public domain dedication."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "Released under the GPL, version 2 or later.", "You should have received a copy of the GNU General Public License along with this program."],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Released under the ISC License."],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "Licensed under the GNU Lesser General Public License, version 2.1."],
    "mit": ["Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0."],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "Released under the Unlicense."],
}
#: Sentences near the subject that state no licence.
OTHERS = ["A driving license is issued by the county office.", "The club lost its license to sell alcohol last year.", "Please renew your fishing license before the season.", "The work was released under a new name.", "All software must be installed by the public library.", "He was permitted to use the source of the river.", "Copyright law differs between countries.", "The general public is free to visit the foundation.", "The version of this file is 2.0.", "The terms of the lease are subject to change.", "You may not copy the answers of others.", "The university released its report under pressure."]
EDGE = r"^[^a-z0-9]+|[^a-z0-9]+$"


def tokens(text: str) -> list[str]:
    return [w for x in text.encode().lower().split() if (w := re.sub(EDGE, "", x.decode("utf-8", "ignore")))]


def variants(words: list[str], seed: int) -> list[list[str]]:
    """A template as it is, shortened, with words added before and after, and with single words missing."""
    rng = np.random.default_rng(seed)
    out = [words]
    for k in range(24):
        some = list(words)
        if k % 3 == 0 and len(some) > 6:
            at = int(rng.integers(0, len(some) - 5))
            some = some[at : at + int(rng.integers(6, len(some) + 1))]
        if k % 3 == 1 and len(some) > 5:
            some.pop(int(rng.integers(0, len(some))))
        if k % 2:
            some = [f"~{i}" for i in range(int(rng.integers(0, 6)))] + some + [f"~{i}" for i in range(int(rng.integers(0, 6)))]
        out.append(some)
    return out


class Model:
    """Vocabulary of words, features (words and pairs), weights, temperature."""

    def __init__(self, families: list[str], words: list[str]):
        self.families, self.words = families, words
        self.index = {w: i for i, w in enumerate(words)}
        self.pairs: np.ndarray = np.empty(0, np.int64)
        self.weights: np.ndarray = np.empty((0, 0))
        self.temperature = 1.0

    def features(self, word_ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, feature) of different features; word ids below 0 are no words of the vocabulary."""
        n = len(self.words)
        row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        known = word_ids >= 0
        both = np.flatnonzero(known[1:] & known[:-1] & (row[1:] == row[:-1]))
        codes = word_ids[both].astype(np.int64) * n + word_ids[both + 1]
        at = np.minimum(np.searchsorted(self.pairs, codes), max(len(self.pairs) - 1, 0))
        hit = self.pairs[at] == codes if len(self.pairs) else np.zeros(len(codes), bool)
        rows = np.concatenate([row[known], row[both[hit]]])
        feats = np.concatenate([word_ids[known].astype(np.int64), n + at[hit]])
        keys = np.unique(rows * (n + len(self.pairs) + 1) + feats)
        return np.divmod(keys, n + len(self.pairs) + 1)

    def logits(self, rows: np.ndarray, feats: np.ndarray, count: int) -> np.ndarray:
        out = np.tile(self.weights[-1], (count, 1))
        ends = np.searchsorted(rows, np.arange(count + 1))
        for k in range(out.shape[1]):
            out[:, k] += common.row_sums(self.weights[feats, k], ends)
        return out

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        x = logits / self.temperature
        x = np.exp(x - x.max(1, keepdims=True))
        return x / x.sum(1, keepdims=True)


def train(templates: dict[str, list[str]], negatives: list[str], ridge: float = 1e-4, steps: int = 400) -> Model:
    families = [UNKNOWN, *sorted(templates)]
    own = {f: [tokens(t) for t in ts] for f, ts in templates.items()}
    words = sorted({w for ts in own.values() for t in ts for w in t})
    model = Model(families, words)
    n = len(words)
    model.pairs = np.unique([model.index[a] * n + model.index[b] for ts in own.values() for t in ts for a, b in zip(t, t[1:])])
    rows: list[tuple[list[str], int, bool]] = []
    for k, f in enumerate(families[1:], 1):
        for i, t in enumerate(own[f]):
            rows += [(v, k, j % 5 == 4) for j, v in enumerate(variants(t, 100 * k + i))]
    rows += [(tokens(t), 0, j % 5 == 4) for j, t in enumerate(negatives)]
    lengths = [len(r[0]) for r in rows]
    ids = np.array([model.index.get(w, -1) for r in rows for w in r[0]])
    r, f = model.features(ids, np.concatenate([[0], np.cumsum(lengths)]))
    x = np.zeros((len(rows), n + len(model.pairs) + 1))
    x[r, f] = 1
    x[:, -1] = 1
    y = np.zeros((len(rows), len(families)))
    y[np.arange(len(rows)), [q[1] for q in rows]] = 1
    share = 1 / np.maximum(y.sum(0), 1)
    weight = (y @ share)[:, None]
    weight /= weight.mean()
    held = np.array([q[2] for q in rows])
    a, b, c = x[~held], y[~held], weight[~held]
    w, speed = np.zeros((x.shape[1], len(families))), np.zeros((x.shape[1], len(families)))
    rate = 4 / max((a * a).sum(1).mean(), 1)
    for _ in range(steps):
        p = np.exp(z := a @ w - (a @ w).max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        speed = 0.9 * speed - rate * (a.T @ ((p - b) * c) / len(a) + ridge * w)
        w = w + speed
    model.weights = w
    z = x[held] @ w

    def loss(t: float) -> float:
        q = z / t
        q = q - q.max(1, keepdims=True)
        return float(-((q - np.log(np.exp(q).sum(1, keepdims=True))) * y[held] * weight[held]).sum())

    model.temperature = min(np.geomspace(0.3, 4, 40), key=loss)
    return model


def weights_of(templates: dict[str, list[list[str]]]) -> dict[str, list[list[float]]]:
    """The weight of each word of each template."""
    families: dict[str, set[str]] = {}
    for f, ts in templates.items():
        for t in ts:
            for w in t:
                families.setdefault(w, set()).add(f)
    return {f: [[MAIN if len(families[w]) == 1 else 1.0 for w in t] for t in ts] for f, ts in templates.items()}


def similarity(words: list[str], template: list[str], weights: list[float]) -> float:
    """1 less the least weighted edit distance between the template and any run of the words, over the template's weight."""
    total = sum(weights)
    if not total:
        return 0.0
    weight = np.asarray(weights)
    down = np.concatenate([[0.0], np.cumsum(weight)])  # the template's first words are all missing
    row = down.copy()
    least = row[-1]
    same = {w: np.array([w != x for x in template]) * weight for w in set(words)}
    for w in words:
        step = np.empty_like(row)
        step[0] = 0.0  # a run may begin anywhere
        step[1:] = np.minimum(row[1:] + 1.0, row[:-1] + same[w])
        row = np.minimum.accumulate(step - down) + down  # missing words of the template
        least = min(least, row[-1])
    return float(max(0.0, 1 - least / total))


def resembles(words: list[str], pairs: dict[tuple[str, str], list[int]], sizes: list[int]) -> bool:
    """Whether a line has much in common with a template.  pairs: which templates have a word pair; sizes: how many pairs each has."""
    met: dict[int, int] = {}
    for p in set(zip(words, words[1:])):
        for k in pairs.get(p, ()):
            met[k] = met.get(k, 0) + 1
    return any(n >= LIKE_PAIRS or n >= LIKE_SHARE * sizes[k] for k, n in met.items())


def negatives_of(lines: list[str], templates: dict[str, list[list[str]]]) -> list[str]:
    """The lines that can stand for unknown."""
    speaks = re.compile(r"licen[sc]e|copyright|public domain|creative commons", re.I)
    pairs: dict[tuple[str, str], list[int]] = {}
    sizes = []
    for k, t in enumerate(t for ts in templates.values() for t in ts):
        own = set(zip(t, t[1:]))
        sizes.append(max(len(own), 1))
        for p in own:
            pairs.setdefault(p, []).append(k)
    return [x for x in lines if not speaks.search(x) and not resembles(tokens(x), pairs, sizes)]


def scan(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, sample: int = SAMPLE, least: float = LEAST, shared: float = SHARED, longest: int = LONGEST, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """For each row: id, n_paragraphs, and findings: (paragraph from 0, family, probability, similarity, confirmed, text)."""
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    lines = common.sampled(rows, sample // 4).select(F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("place", "line")).filter(F.length("line").between(1, longest))
    lines = lines.select("line", F.xxhash64("line", "place").alias("h")).orderBy("h", "line").limit(sample)
    own = {f: [tokens(t) for t in ts] for f, ts in templates.items()}
    weights = weights_of(own)
    model = train(templates, OTHERS * 4 + negatives_of([r["line"] for r in lines.collect()], own))
    reach = max((len(t) for ts in own.values() for t in ts), default=0)

    def around(lines: pa.Array, at: int, first: int, last: int) -> list[str]:
        """Words of a line and of those before and after it in its paragraph, as far as a template can reach."""
        words = tokens(lines[at].as_py())
        for step, end in ((-1, first - 1), (1, last)):
            k, more = at + step, []
            while k != end and len(more) < reach:
                one = tokens(lines[k].as_py())
                if not one:
                    break
                more = one + more if step < 0 else more + one
                k += step
            words = more[-reach:] + words if step < 0 else words + more[:reach]
        return words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pa.array(model.words, pa.large_string())
        kind = pa.list_(pa.struct([("paragraph", pa.int64()), ("family", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64()), ("confirmed", pa.bool_()), ("text", pa.string())]))
        for batch in common.steps(batches, "text"):
            lists = pc.split_pattern(pc.fill_null(batch.column("text"), "").cast(pa.large_string()), "\n")
            lines = lists.flatten()
            owner = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lists.offsets)))
            starts, ids, names = common.words(lines)
            plain = pc.replace_substring_regex(pc.ascii_lower(names), EDGE, "")
            found = np.asarray(pc.fill_null(pc.index_in(plain, vocabulary), -1))
            full = np.diff(starts) > 0
            r, f = model.features(found[ids], starts)
            some = np.unique(r)  # lines without a word of the vocabulary are unknown
            logits = model.logits(np.searchsorted(some, r), f, len(some))
            p = model.probabilities(logits) if len(some) else np.empty((0, len(model.families)))
            best = p.argmax(1) if len(some) else np.empty(0, int)
            findings: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            first = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            for k in np.flatnonzero((best > 0) & (p.max(1, initial=0) >= least)):
                line = int(some[k])
                text = lines[line].as_py()
                family = model.families[best[k]]
                near = around(lines, line, int(first[owner[line]]), int(first[owner[line] + 1]))
                like = max(similarity(near, t, w) for t, w in zip(own[family], weights[family]))
                findings[owner[line]].append({"paragraph": line - int(first[owner[line]]), "family": family, "probability": float(p[k, best[k]]), "similarity": like, "confirmed": like >= shared, "text": text})
            n = np.bincount(owner[full], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(findings, kind)], names=["id", "n_paragraphs", "findings"])

    kind = docs.schema[id_column].dataType.simpleString()
    return rows.mapInArrow(common.lean(run), f"id {kind}, n_paragraphs long, findings array<struct<paragraph: long, family: string, probability: double, similarity: double, confirmed: boolean, text: string>>").withColumnRenamed("id", id_column)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_paragraphs, n_candidates, families (of confirmed paragraphs), licence (of the last of them, or unknown), probability."""
    found = scan(common.table(spark, sf_dir, "documents"))
    sure = F.filter("findings", lambda x: x["confirmed"])
    last = F.element_at(sure, -1)
    some = F.size(sure) > 0
    return found.select("doc_id", "n_paragraphs", F.size("findings").cast("long").alias("n_candidates"), F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",").alias("families"), F.when(some, last["family"]).otherwise(UNKNOWN).alias("licence"), F.when(some, last["probability"]).otherwise(F.lit(0.0)).alias("probability"))
