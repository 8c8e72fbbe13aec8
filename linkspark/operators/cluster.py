"""Clusters of vectors: density clustering, noise attachment, merging, label ensembles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkspark.operators import graph, similarity
from linkspark.operators.storage import materialize

NOISE = -1


def core_distances(neighbours: DataFrame, min_samples: int) -> DataFrame:
    """(src, core): distance 1 - sim to the min_samples-th neighbour."""
    return neighbours.filter(F.col("rank") == min_samples - 1).select("src", (1 - F.col("sim")).alias("core"))


def mutual_reachability(neighbours: DataFrame, min_samples: int, alpha: float = 1.0) -> DataFrame:
    """(src, dst, distance) with src < dst: the greatest of both core distances and the distance over alpha."""
    core = core_distances(neighbours, min_samples)
    pairs = neighbours.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "sim").groupBy("src", "dst").agg(F.max("sim").alias("sim"))
    both = pairs.join(core, "src").join(core.select(F.col("src").alias("dst"), F.col("core").alias("core_dst")), "dst")
    return both.select("src", "dst", F.greatest("core", "core_dst", (1 - F.col("sim")) / alpha).alias("distance"))


#: Edges whose spanning forest one task makes at once; of more, rounds over all of them go before.
TOGETHER = 1 << 21


def least_forest(src: np.ndarray, dst: np.ndarray, distance: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which edges the least spanning forest of the groups a and b that they join has; ties by ids."""
    order = np.lexsort((dst, src, distance))
    nodes, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = codes[: len(a)][order], codes[len(a) :][order]
    label, live, taken = np.arange(len(nodes)), np.arange(len(order)), np.zeros(len(order), bool)
    while True:
        x, y = label[left[live]], label[right[live]]
        apart = x != y
        live, x, y = live[apart], x[apart], y[apart]
        if not len(live):
            return order[taken]
        first = np.full(len(nodes), len(order))
        np.minimum.at(first, x, live)
        np.minimum.at(first, y, live)
        new = np.unique(first[first < len(order)])
        taken[new] = True
        vertex, least = graph.least_labels(label[left[new]], label[right[new]])
        move = np.arange(len(nodes))
        move[vertex] = least
        label = move[label]


def spanning_forest(edges: DataFrame, max_rounds: int = 40, together: int = TOGETHER) -> DataFrame:
    """(src, dst, distance): least spanning forest by Boruvka's rounds; ties by ids.

    Once no more than `together` edges lead from one tree to another, one task does the rest.
    """
    named = materialize(edges.select("src", "dst", "distance", F.col("src").alias("a"), F.col("dst").alias("b")).filter("a <> b"))
    parts = []
    for _ in range(max_rounds):
        if named.count() <= together:

            def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                got = [x for x in batches if x.num_rows]
                if got:
                    whole = pa.Table.from_batches(got)
                    kept = least_forest(*(whole.column(c).to_numpy() for c in ("src", "dst", "distance", "a", "b")))
                    yield from whole.select(["src", "dst", "distance"]).take(pa.array(kept)).combine_chunks().to_batches()

            types = ", ".join(f"{c} {named.schema[c].dataType.simpleString()}" for c in ("src", "dst", "distance"))
            parts.append(materialize(named.coalesce(1).mapInArrow(finish, types)))
            break
        both = named.select(F.col("a").alias("c"), "src", "dst", "distance", "a", "b").union(named.select(F.col("b").alias("c"), "src", "dst", "distance", "a", "b"))
        least = both.groupBy("c").agg(F.min(F.struct("distance", "src", "dst", "a", "b")).alias("e"))
        found = materialize(least.select("e.*").distinct())
        parts.append(found.select("src", "dst", "distance"))
        labels = graph.components(found.select(F.col("a").alias("src"), F.col("b").alias("dst")))
        one, two = labels.select(F.col("vertex").alias("a"), F.col("component_id").alias("na")), labels.select(F.col("vertex").alias("b"), F.col("component_id").alias("nb"))
        named = materialize(named.join(one, "a").join(two, "b").filter("na <> nb").select("src", "dst", "distance", F.col("na").alias("a"), F.col("nb").alias("b")))
    else:
        raise RuntimeError("the forest did not settle")
    return reduce(DataFrame.union, parts)


def condense(forest: list[tuple[int, int, float]], min_size: int = 2, selection: str = "leaf") -> dict[int, tuple[int, float]]:
    """vertex: (label, probability) from the edges of a spanning forest, on the driver.

    A tree is cut from its longest edge down.  A side with fewer than min_size vertices
    falls out of its cluster there; where both sides are large enough two clusters begin.
    Leaves of that hierarchy are the clusters ("leaf"), or those of greatest excess of
    mass ("eom").  A vertex's probability is its leaving density over its cluster's greatest.
    """
    edges = sorted(forest, key=lambda e: (e[2], e[0], e[1]))
    parent: dict[int, int] = {}
    node: dict[int, int] = {}
    children: list[tuple[int, int, float] | int] = []
    size: list[int] = []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for e in edges:
        for v in e[:2]:
            if v not in parent:
                parent[v], node[v] = v, len(children)
                children.append(v)
                size.append(1)
    for a, b, distance in edges:
        ra, rb = find(a), find(b)
        if ra == rb:
            continue
        children.append((node[ra], node[rb], distance))
        size.append(size[node[ra]] + size[node[rb]])
        parent[rb] = ra
        node[ra] = len(children) - 1
    roots = sorted({node[find(v)] for v in parent})
    clusters: list[dict] = []

    def leaves(top: int) -> list[int]:
        out, todo = [], [top]
        while todo:
            x = children[todo.pop()]
            if isinstance(x, tuple):
                todo += x[:2]
            else:
                out.append(x)
        return out

    for root in roots:
        if size[root] < min_size:
            continue
        todo = [(root, None, 0.0)]
        while todo:
            top, above, birth = todo.pop()
            own = {"parent": above, "birth": birth, "points": {}, "kids": []}
            clusters.append(own)
            me = len(clusters) - 1
            if above is not None:
                clusters[above]["kids"].append(me)
            at = top
            while True:
                x = children[at]
                if not isinstance(x, tuple):
                    own["points"][x] = float("inf")
                    break
                left, right, distance = x
                density = 1 / max(distance, 1e-12)
                big = [k for k in (left, right) if size[k] >= min_size]
                for k in (left, right):
                    if k not in big:
                        own["points"].update(dict.fromkeys(leaves(k), density))
                if len(big) == 2:
                    own["split"] = (density, sum(size[k] for k in big))
                    todo += [(k, me, density) for k in big]
                    break
                if not big:
                    break
                at = big[0]
    picked: set[int] = set()
    if selection == "leaf":
        picked = {i for i, c in enumerate(clusters) if not c["kids"]}
    else:
        best = [0.0] * len(clusters)
        for i in range(len(clusters) - 1, -1, -1):
            c = clusters[i]
            own = sum(min(d, 1e12) - c["birth"] for d in c["points"].values())
            if "split" in c:
                own += (c["split"][0] - c["birth"]) * c["split"][1]
            below = sum(best[k] for k in c["kids"])
            best[i] = max(own, below)
            if own >= below and c["parent"] is not None or not c["kids"]:
                todo = list(c["kids"])
                while todo:
                    k = todo.pop()
                    picked.discard(k)
                    todo += clusters[k]["kids"]
                picked.add(i)
    out: dict[int, tuple[int, float]] = {v: (NOISE, 0.0) for v in parent}
    for label, i in enumerate(sorted(picked)):
        points, todo = {}, [i]
        while todo:
            k = todo.pop()
            points.update(clusters[k]["points"])
            todo += clusters[k]["kids"]
        top = max((d for d in points.values() if d != float("inf")), default=1.0)
        for v, d in points.items():
            out[v] = (label, 1.0 if d == float("inf") else min(1.0, d / top))
    return out


def density_clusters(vectors: DataFrame, k: int = 15, min_samples: int = 1, min_size: int = 2, selection: str = "leaf", id_column: str = "vec_id") -> DataFrame:
    """(vec_id, cluster, probability).  Each tree of the spanning forest is condensed by one task; labels are numbered by tree."""
    near = similarity.neighbours(vectors, k, id_column=id_column)
    edges = spanning_forest(mutual_reachability(near, min_samples)).select("src", "dst", "distance")
    trees = edges.join(graph.components(edges), edges["src"] == F.col("vertex")).select("component_id", "src", "dst", "distance")

    def one(table: pa.Table) -> pa.Table:
        tree = table.column("component_id")[0].as_py()
        labels = condense(list(zip(*(table.column(c).to_pylist() for c in ("src", "dst", "distance")))), min_size, selection)
        rows = sorted(labels.items())
        return pa.table({"id": pa.array([v for v, _ in rows], pa.int64()), "tree": pa.array([tree] * len(rows), pa.int64()), "label": pa.array([c for _, (c, _) in rows], pa.int32()), "probability": pa.array([p for _, (_, p) in rows], pa.float64())})

    found = materialize(trees.groupBy("component_id").applyInArrow(one, "id long, tree long, label int, probability double"))
    numbers = found.filter(F.col("label") != NOISE).select("tree", "label").distinct().withColumn("cluster", F.row_number().over(Window.orderBy("tree", "label")) - 1)
    placed = found.join(numbers, ["tree", "label"], "left").select(F.col("id").alias(id_column), "cluster", "probability")
    return vectors.select(id_column).join(placed, id_column, "left").select(id_column, F.coalesce("cluster", F.lit(NOISE)).alias("cluster"), F.coalesce("probability", F.lit(0.0)).alias("probability"))


def check_vectors(vectors: DataFrame, dim: int, id_column: str = "vec_id", vector_column: str = "v") -> DataFrame:
    """(id, problem) of vectors that can't be clustered: null, of another length, or with values that aren't finite."""
    v = F.col(vector_column)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    problem = F.when(v.isNull(), "null").when(F.size(v) != dim, "length").when(bad, "not_finite")
    return vectors.select(id_column, problem.alias("problem")).filter("problem is not null")


def shared_neighbour_clusters(vectors: DataFrame, k: int = 15, min_weight: float = 0.0, rounds: int = 8, id_column: str = "vec_id") -> DataFrame:
    """(id, cluster) by shared neighbours: unit vectors, mutual neighbours weighted by rank, communities, noise attached, like clusters merged.

    Vectors without a mutual neighbour are noise before noise is attached.
    """
    own = materialize(vectors.select(F.col(id_column).alias("id"), similarity.unit(F.col("v")).alias("v")))
    near = materialize(similarity.neighbours(own, k, id_column="id"))
    found = graph.communities(graph.mutual_rank_graph(near, min_weight=min_weight), rounds)
    labels = own.select("id").join(found, own["id"] == found["vertex"], "left").select("id", F.coalesce("community", F.lit(NOISE)).alias("cluster"))
    attached = materialize(attach_noise(labels, near))
    merged = merge_similar(own.join(attached, "id"))
    return attached.join(merged, "cluster", "left").select("id", F.coalesce("merged", "cluster").alias("cluster"))


def attach_noise(labels: DataFrame, neighbours: DataFrame, sim_at_least: float = 0.82, matches: int = 2, ambiguity: float = 1.5) -> DataFrame:
    """(id, cluster): noise joins the commonest label among its neighbours if that is near, often and clear enough."""
    near = neighbours.join(labels.filter(F.col("cluster") == NOISE).select(F.col("id").alias("src")), "src", "left_semi")
    near = near.join(labels.filter(F.col("cluster") != NOISE).select(F.col("id").alias("dst"), "cluster"), "dst")
    by = near.groupBy("src", "cluster").agg(F.count("*").alias("n"), F.avg("sim").alias("mean"), F.count(F.when(F.col("sim") >= sim_at_least, 1)).alias("good"))
    w = Window.partitionBy("src").orderBy(F.desc("n"), F.desc(F.round("mean", 9)), "cluster")
    by = by.withColumn("r", F.row_number().over(w)).withColumn("next", F.lead("mean").over(w)).filter("r = 1")
    clear = F.col("next").isNull() | (F.col("mean") / (F.col("next") + 1e-8) >= ambiguity)
    joined = by.filter(clear & (F.col("n") >= matches) & (F.col("mean") >= sim_at_least) & (F.col("good") >= matches)).select(F.col("src").alias("id"), F.col("cluster").alias("new"))
    return labels.join(joined, "id", "left").select("id", F.coalesce("new", "cluster").alias("cluster"))


def purity_map(labels: DataFrame, purity: float = 0.75, overlap: int = 3) -> DataFrame:
    """(snn, hdb, n, purity): groups of one labelling (id, hdb, snn) that lie mostly in one cluster of the other."""
    size = labels.filter(F.col("snn") != NOISE).groupBy("snn").agg(F.count("*").alias("size"))
    both = labels.filter((F.col("snn") != NOISE) & (F.col("hdb") != NOISE)).groupBy("snn", "hdb").agg(F.count("*").alias("n"))
    best = F.row_number().over(Window.partitionBy("snn").orderBy(F.desc("n"), "hdb"))
    found = both.withColumn("r", best).filter("r = 1").join(size, "snn").withColumn("purity", F.col("n") / F.col("size"))
    return found.filter((F.col("purity") >= purity) & (F.col("n") >= overlap)).select("snn", "hdb", "n", "purity")


def rescue(labels: DataFrame, mapping: DataFrame, probability: float = 0.60) -> DataFrame:
    """(id, cluster, probability): noise of hdb in a mapped group takes the group's cluster."""
    joined = labels.join(mapping.select("snn", F.col("hdb").alias("to")), "snn", "left")
    saved = (F.col("hdb") == NOISE) & F.col("to").isNotNull()
    return joined.select("id", F.when(saved, F.col("to")).otherwise(F.col("hdb")).alias("cluster"), F.when(saved, probability).otherwise(F.col("prob")).alias("probability"), "snn", "hdb")


def mint(labels: DataFrame, mapping: DataFrame, least: int = 4) -> DataFrame:
    """(id, cluster): noise in unmapped groups of enough such rows makes new clusters, numbered from the greatest label on."""
    free = labels.filter((F.col("hdb") == NOISE) & (F.col("snn") != NOISE)).join(mapping.select("snn"), "snn", "left_anti")
    groups = free.groupBy("snn").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    top = labels.agg(F.max("hdb").alias("top"))
    new = groups.withColumn("k", F.row_number().over(Window.orderBy("snn"))).crossJoin(F.broadcast(top)).select("snn", (F.col("top") + F.col("k")).cast("int").alias("new"))
    return labels.join(new, "snn", "left").select("id", F.when((F.col("hdb") == NOISE) & F.col("new").isNotNull(), F.col("new")).otherwise(F.col("hdb")).alias("cluster"))


#: Members of a cluster that are compared at once.
PART = 4096


def _pair_figures(near: pa.Table, table: pa.Table, median: float) -> pa.Table:
    """(a, b, n, good, low, high, top) for pairs of clusters near (a, b), of the members (cluster, v, shard) of two shards."""
    cluster, shard, m = np.asarray(table.column("cluster")), np.asarray(table.column("shard")), similarity.stacked(table)
    order = np.argsort(cluster, kind="stable")
    cluster, shard, m = cluster[order], shard[order], m[order]
    left, right, turn = (np.asarray(near.column(c)) for c in ("a", "b", "turn"))
    i, j = near.column("i")[0].as_py(), near.column("j")[0].as_py()
    out = []
    for flip, (one, two) in enumerate(((i, j), (j, i))[: 1 + (i != j)]):
        x, y = np.flatnonzero(shard == one), np.flatnonzero(shard == two)
        mine = turn == flip
        pairs = np.stack([left[mine], right[mine]])[:, np.lexsort((right[mine], left[mine]))]
        for a, begin, end in zip(*_runs(pairs[0])):
            rows = m[x[np.searchsorted(cluster[x], a) : np.searchsorted(cluster[x], a, "right")]]
            b = pairs[1, begin:end]
            low, high = np.searchsorted(cluster[y], b), np.searchsorted(cluster[y], b, "right")
            for b, low, high in _bounded(b, low, high):
                size = high - low
                at = np.concatenate([[0], np.cumsum(size)[:-1]])
                columns = m[y[np.repeat(low - at, size) + np.arange(size.sum())]].T
                step = max(1, (1 << 21) // columns.shape[1])
                for k in range(0, len(rows), step):
                    s = np.round(rows[k : k + step] @ columns, 9)
                    good = s >= median
                    under, over = np.where(good, -np.inf, s).max(0), np.where(good, s, np.inf).min(0)
                    out.append((np.full(len(b), a), b, size * len(s), np.add.reduceat(good.sum(0), at), np.maximum.reduceat(under, at), np.minimum.reduceat(over, at), np.maximum.reduceat(s.max(0), at)))
    columns = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0)] * 7
    kinds = [pa.int64()] * 4 + [pa.float64()] * 3
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("a", "b", "n", "good", "low", "high", "top"), columns, kinds)})


def _bounded(b: np.ndarray, low: np.ndarray, high: np.ndarray, most: int = 1 << 16) -> Iterator[tuple]:
    """The columns b, low and high in turns of about `most` rows between low and high."""
    full = high > low
    b, low, high = b[full], low[full], high[full]
    turn = np.cumsum(high - low) // most
    for k in np.unique(turn):
        yield b[turn == k], low[turn == k], high[turn == k]


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, begin, end) of the runs of sorted values."""
    unique, begin = np.unique(values, return_index=True)
    return unique, begin, np.append(begin[1:], len(values))


def merge_similar(vectors: DataFrame, centroid: float = 0.75, median: float = 0.84, most: float = 0.90) -> DataFrame:
    """(cluster, merged): clusters (id, cluster, v) whose centroids are near and whose members are, by median and greatest similarity, become one: the least id.

    All members of near clusters are compared, two shards of members at a time.  A median needs no table of
    the similarities: of each pair of clusters it reaches the limit if more than half of them do; if just half do, it is
    the mean of the greatest below and the least of the others.
    """
    member = materialize(vectors.filter(F.col("cluster") != NOISE).select(F.col("cluster").cast("long").alias("cluster"), F.col("id"), F.col("v").cast("array<double>").alias("v")))
    kind = vectors.schema["cluster"].dataType.simpleString()
    long = member.select("cluster", F.posexplode("v").alias("pos", "x")).groupBy("cluster", "pos").agg(F.avg("x").alias("m"))
    c = long.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("s")).select("cluster", similarity.unit(F.transform("s", lambda x: x["m"])).alias("v"))
    pairs = materialize(similarity.pairs_above(materialize(c), centroid, "cluster"))
    sizes = member.groupBy("cluster").agg(F.ceil(F.count("*") / F.lit(PART)).alias("parts"))
    shards = similarity.shards_for(member.count())
    dealt = member.join(sizes, "cluster").withColumn("shard", F.pmod(F.xxhash64("cluster", F.pmod(F.xxhash64("id"), F.col("parts"))), F.lit(shards)).cast("int")).select("cluster", "v", "shard")
    dealt = materialize(dealt)
    held = dealt.select("cluster", "shard").distinct()
    met = pairs.join(held.select(F.col("cluster").alias("a"), F.col("shard").alias("x")), "a").join(held.select(F.col("cluster").alias("b"), F.col("shard").alias("y")), "b")
    met = met.select("a", "b", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), (F.col("x") > F.col("y")).cast("int").alias("turn"))
    met = met.withColumn("tile", F.col("i") * shards + F.col("j")).repartition(shards * (shards + 1) // 2, "tile")

    def compare(near: pa.Table, table: pa.Table) -> pa.Table:
        if not near.num_rows or not table.num_rows:
            return _NO_FIGURES
        return _pair_figures(near, table, median)

    found = met.groupBy("tile").cogroup(similarity.tiles(dealt, F.col("shard"), shards).groupBy("tile")).applyInArrow(compare, "a long, b long, n long, good long, low double, high double, top double")
    sums = found.groupBy("a", "b").agg(*[F.sum(x).alias(x) for x in ("n", "good")], F.max("low").alias("low"), F.min("high").alias("high"), F.max("top").alias("top"))
    half = F.when(2 * F.col("good") == F.col("n"), (F.col("low") + F.col("high")) / 2 >= median).otherwise(2 * F.col("good") > F.col("n"))
    good = sums.filter(half & (F.col("top") >= most))
    joined = graph.components(good.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    return member.select("cluster").distinct().join(joined, F.col("cluster") == F.col("vertex"), "left").select(F.col("cluster").cast(kind).alias("cluster"), F.coalesce("component_id", "cluster").cast(kind).alias("merged"))


_NO_FIGURES = pa.table({n: pa.array([], t) for n, t in zip(("a", "b", "n", "good", "low", "high", "top"), [pa.int64()] * 4 + [pa.float64()] * 3)})


def dedup_vectors(vectors: DataFrame, decimals: int = 9, id_column: str = "vec_id") -> DataFrame:
    """(id, rep, n): vectors that are equal after rounding share the least id."""
    keyed = vectors.withColumn("k", F.transform("v", lambda x: F.round(x, decimals)))
    reps = keyed.groupBy("k").agg(F.min(id_column).alias("rep"), F.count("*").alias("n"))
    return keyed.join(reps, "k").select(id_column, "rep", "n")
