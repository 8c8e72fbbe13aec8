import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkspark.operators import cluster, graph, matrix, resolve, similarity


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (3, 4), (7, 8), (9, 9)], "src long, dst long")
    assert pairs(graph.components(edges)) == [(1, 1), (2, 1), (3, 1), (4, 1), (7, 7), (8, 7), (9, 9)]
    assert pairs(graph.components(edges.limit(0))) == []
    rng = np.random.default_rng(0)
    raw = rng.integers(0, 120, (110, 2)).tolist()
    label = {v: v for e in raw for v in e}
    for _ in label:
        for a, b in raw:
            label[a] = label[b] = min(label[a], label[b])
    df = spark.createDataFrame(raw, "src long, dst long")
    assert dict(pairs(graph.components(df))) == label
    assert dict(pairs(graph.components(df.repartition(7)))) == label


def test_flatten(spark):
    m = spark.createDataFrame([(5, 4), (4, 3), (3, 1), (9, 8)], "id long, parent long")
    flat = graph.flatten(m)
    assert pairs(flat) == [(3, 1), (4, 1), (5, 1), (9, 8)]
    assert pairs(graph.flatten(flat.withColumnRenamed("root", "parent"))) == pairs(flat)


def test_similarity(spark):
    df = spark.createDataFrame([("acme", "acme"), ("", "x"), (None, "x"), ("abc", "abd")], "a string, b string")
    got = [r[0] for r in df.select(similarity.edit_similarity(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([1, 0, 0, math.exp(-2 / 6)])


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, v array<double>")
    got = {(r["src"], r["rank"]): r["dst"] for r in similarity.neighbours(df, 3).collect()}
    s = np.round(v @ v.T, 9)
    np.fill_diagonal(s, -9)
    for i in range(60):
        want = sorted(range(60), key=lambda j: (-s[i, j], j))[:3]
        assert [got[i, k] for k in range(3)] == want
    assert similarity.neighbours(df.limit(2), 5).count() == 2


def test_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [float("nan"), 1.0])], "i int, v array<double>")
    got = [r[0] for r in df.orderBy("i").select(similarity.unit(similarity.finite(F.col("v")))).collect()]
    assert got == [[0.6, 0.8], [0.0, 0.0], [0.0, 1.0]]


def test_center(spark):
    k = spark.createDataFrame([(i, j, float(i * j + i)) for i in range(4) for j in range(4)], "i int, j int, value double")
    out = matrix.center(k)
    assert out.groupBy("i").agg(F.sum("value").alias("s")).filter("abs(s) > 1e-9").count() == 0
    assert out.groupBy("j").agg(F.sum("value").alias("s")).filter("abs(s) > 1e-9").count() == 0


def test_condense():
    chain = [(i, i + 1, 0.1) for i in range(5)] + [(i, i + 1, 0.1) for i in range(10, 15)] + [(5, 10, 5.0), (15, 99, 9.0)]
    labels = cluster.condense(chain, min_size=3, selection="eom")
    assert labels[99][0] == -1
    assert len({labels[i][0] for i in range(6)}) == 1 and len({labels[i][0] for i in range(10, 16)}) == 1
    assert labels[0][0] != labels[10][0]


def test_confidence_bins(spark):
    rows = [(1, 1, 1.0, 1.0, 1.0, 0.0, False), (2, -1, 0.0, 1.0, 0.0, 0.0, False)]
    df = spark.createDataFrame(rows, "record_id int, cluster int, probability double, name_similarity double, address_confidence double, change double, enriched boolean")
    got = {r["record_id"]: (r["confidence_score"], r["confidence_category"]) for r in resolve.confidence(df).collect()}
    assert got[2] == (0.5, "Low") and got[1][1] == "Very High"
    flags = {r["record_id"]: r["review_reason"] for r in resolve.review_flags(resolve.confidence(df)).collect()}
    assert flags == {1: "", 2: "low_confidence"}


def test_benjamini_hochberg(spark):
    p = [0.001, 0.008, 0.039, 0.041, 0.042, 0.06, 0.9]
    df = spark.createDataFrame(list(enumerate(p)), "id int, p double")
    assert [r["rejected"] for r in resolve.benjamini_hochberg(df).orderBy("id").collect()] == [True, True, False, False, False, False, False]


def test_split_at_threshold(spark):
    rows = [(1, 1, "100", "a st", "1", "k1"), (2, 1, "130", "a st", "1", "k2"), (3, 2, "100", "a st", "1", "k1"), (4, 2, "131", "a st", "1", "k3")]
    df = spark.createDataFrame(rows, "record_id long, cluster long, street_number string, street_name string, zip string, address_key string")
    assert pairs(resolve.split_ranges(df)) == [(1, 1), (2, 1), (3, 3), (4, 4)]


def test_components_large_and_together(spark):
    import random

    from linkspark.operators import graph

    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(0, k) for k in range(300, 330)] + [(k, k + 1) for k in range(500, 560)] + [(900, 900), (None, 3), (5, None)]
    root = {v: v for e in edges for v in e if v is not None and None not in e}
    for _ in root:
        for a, b in edges:
            if a in root and b in root and None not in (a, b):
                root[a] = root[b] = min(root[a], root[b])
    df = spark.createDataFrame(edges, "src long, dst long")
    for together in (1 << 20, 0):
        assert {r["vertex"]: r["component_id"] for r in graph.components(df, together=together).collect()} == root
    assert graph.components(df.limit(0)).count() == 0


def test_similar_pairs_against_all(spark):
    from linkspark.operators import similarity

    names = spark.createDataFrame([(i, x) for i, x in enumerate("acme tools|acme tool|acme toolz inc|beta freight|beta freights|gamma|gama|acme|tools acme".split("|"))], "id long, name string")
    w = similarity.tfidf(similarity.grams(names, "id", "name"), names.count()).cache()
    rows = {}
    for r in w.collect():
        rows.setdefault(r["id"], {})[r["gram"]] = r["weight"]
    for least in (0.2, 0.5, 0.8):
        want = {(a, b) for a in rows for b in rows if a < b and sum(x * rows[b].get(g, 0) for g, x in rows[a].items()) > least}
        assert {(r["a"], r["b"]) for r in similarity.similar_pairs(w, least).collect()} == want


def test_shared_neighbour_clusters(spark):
    import numpy as np

    from linkspark.operators import cluster

    rng = np.random.default_rng(2)
    rows = [(k * 12 + i, (5 * np.eye(8)[k] + rng.normal(size=8) * 0.2).tolist()) for k in range(3) for i in range(12)]
    got = {r["id"]: r["cluster"] for r in cluster.shared_neighbour_clusters(spark.createDataFrame(rows, "vec_id long, v array<double>"), k=5).collect()}
    groups = [{got[k * 12 + i] for i in range(12)} - {-1} for k in range(3)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3
    assert sum(c == -1 for c in got.values()) <= 3  # between communities that are merged after noise is attached


def unit_rows(n, dim, seed):
    v = np.random.default_rng(seed).normal(size=(n, dim)) + 1
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def test_each_pair_of_shards_is_multiplied_once(spark):
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(unit_rows(90, 6, 4).repeat(2, 0)[:120].round(1))], "vec_id long, v array<double>")
    dealt = similarity.tiles(df, F.col("vec_id") % 3, 3)
    assert dealt.count() == 360 and dealt.filter("i > j").count() == 0  # with every pair of shards in both orders it was 720
    want = pairs(similarity.neighbours(df, 4, shards=1).select("src", "rank", "dst"))
    assert want == pairs(similarity.neighbours(df, 4, shards=5).select("src", "rank", "dst")) and len(want) == 480


def test_spanning_forest_in_rounds_and_in_one_task(spark):
    rng = np.random.default_rng(5)
    edges = sorted({tuple(sorted(e)) for e in rng.integers(0, 60, (150, 2)).tolist() if e[0] != e[1]})
    rows = [(a, b, float(rng.integers(0, 5))) for a, b in edges]
    root, want = {v: v for e in edges for v in e}, []
    for a, b, d in sorted(rows, key=lambda e: (e[2], e[0], e[1])):
        if root[a] != root[b]:
            want.append((a, b, d))
            root = {v: root[a] if r == root[b] else r for v, r in root.items()}
    df = spark.createDataFrame(rows, "src long, dst long, distance double")
    for together in (0, 40, 1 << 20):
        assert pairs(cluster.spanning_forest(df, together=together)) == sorted(want)


def test_merge_similar_against_all_members(spark, monkeypatch):
    monkeypatch.setattr(cluster, "PART", 3)  # members of a cluster in several shards
    rng = np.random.default_rng(6)
    v = np.concatenate([c + rng.normal(size=(n, 5)) * s for c, n, s in ((np.eye(5)[0] * 3, 8, 0.5), (np.eye(5)[0] * 3, 7, 0.7), (np.eye(5)[1] * 3, 6, 0.4), (np.eye(5)[1] * 3 + 1, 5, 0.4), (np.eye(5)[2], 2, 0.01), (np.eye(5)[2], 1, 0.01))])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    label = np.repeat([10, 11, 12, 13, 14, 15], [8, 7, 6, 5, 2, 1])
    df = spark.createDataFrame([(i, int(c), x.tolist()) for i, (c, x) in enumerate(zip(label, v))], "id long, cluster int, v array<double>")
    for median in (0.7, 0.84, 0.9, 0.95):
        root = {int(c): int(c) for c in label}
        for a in root:
            for b in root:
                s = np.round(v[label == a] @ v[label == b].T, 9)
                ca, cb = v[label == a].mean(0), v[label == b].mean(0)
                if a < b and ca @ cb / np.linalg.norm(ca) / np.linalg.norm(cb) > 0.75 and np.median(s) >= median and s.max() >= 0.9:
                    low, high = sorted((root[a], root[b]))
                    root = {k: low if r == high else r for k, r in root.items()}
        assert dict(pairs(cluster.merge_similar(df, median=median))) == root
