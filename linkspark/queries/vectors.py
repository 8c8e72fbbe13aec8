"""Matrix, vector and cluster queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkspark.operators import cluster, matrix, reduce, similarity
from linkspark.queries.base import VECS, query, table, vecs
from linkspark.queries.basic import KNN, TFIDF

LONG = "m AS (SELECT vec_id AS row_, i - 1 AS col_, embedding[i]::double AS value FROM embeddings, range(1, 65) t(i))"


def long(spark, d):
    return matrix.long_of(table(spark, d, "embeddings"), "vec_id", "embedding")


def shown(m):
    return m.select(F.col("row").alias("row_"), F.col("col").cast("long").alias("col_"), F.round("value", 6).alias("value"))


@query("q_row_normalize", f"WITH {LONG} SELECT row_, col_, round(value / sqrt(sum(value * value) OVER (PARTITION BY row_)), 6) AS value FROM m")
def row_normalize(spark, d):
    return shown(matrix.normalize_rows(long(spark, d)))


@query("q_frobenius", f"WITH {LONG} SELECT round(sqrt(sum(value * value)), 6) AS norm, count(*)::bigint AS entries FROM m")
def frobenius(spark, d):
    return matrix.frobenius(long(spark, d)).select(F.round("norm", 6).alias("norm"), "entries")


@query("q_scale_frobenius", f"WITH {LONG.replace('m AS', 'm AS MATERIALIZED', 1)}, f AS MATERIALIZED (SELECT sqrt(sum(value * value)) AS norm FROM m) SELECT row_, col_, round(value / norm, 6) AS value FROM m CROSS JOIN f")
def scale_frobenius(spark, d):
    return shown(matrix.scale_by_frobenius(long(spark, d)))


@query("q_winsorize", f"WITH {LONG}, b AS (SELECT quantile_cont(value, 0.001) AS lo, quantile_cont(value, 0.999) AS hi FROM m) SELECT row_, col_, round(least(greatest(value, lo), hi), 6) AS value FROM m, b")
def winsorize(spark, d):
    return shown(matrix.winsorize(long(spark, d), 0.001, 0.999))


@query("q_prune_matrix", f"""WITH {TFIDF}, rs AS (SELECT id FROM c GROUP BY id HAVING sum(n) > 1e-9), k AS (SELECT * FROM c WHERE id IN (SELECT id FROM rs)),
cols AS (SELECT gram, count(*) AS df, sum(n::double * n) AS e FROM k GROUP BY 1 HAVING count(*) >= 2 AND count(*) <= floor(0.98 * (SELECT rows_ FROM nn))),
r AS (SELECT gram, coalesce(sum(e) OVER (ORDER BY round(e, 9) DESC, gram ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(e) OVER () AS all_ FROM cols)
SELECT id AS row_, gram AS col_, n::double AS value FROM k WHERE gram IN (SELECT gram FROM r WHERE round(before, 9) < round(0.995 * all_, 9))""")
def prune_matrix(spark, d):
    names = table(spark, d, "part").select("p_name").distinct()
    m = similarity.grams(names, "p_name", "p_name").select(F.col("id").alias("row"), F.col("gram").alias("col"), F.col("n").cast("double").alias("value"))
    return matrix.prune(m, names.count()).select(F.col("row").alias("row_"), F.col("col").alias("col_"), "value")


@query("q_regularization", f"WITH {LONG} SELECT round(least(greatest(0.001 * sqrt(sum(value * value)) / sqrt(32.0::double), 1e-8), 0.1), 6) AS lam FROM m")
def regularization(spark, d):
    return matrix.regularization(long(spark, d), 32).select(F.round("lambda", 6).alias("lam"))


#: Landmarks are the vectors whose id is divisible by 20; all rows are compared with them.
GRAM = "r AS (SELECT vec_id, v, embedding::double[] AS e FROM vecs JOIN embeddings USING (vec_id)), g AS MATERIALIZED (SELECT a.vec_id AS i, b.vec_id AS j, greatest(-1.0::double, least(1.0::double, (list_dot_product(a.v, b.v) + list_dot_product(a.e, b.e)) / 2)) AS value FROM r a JOIN r b ON b.vec_id % 20 = 0)"


def runs(spark, d):
    return vecs(spark, d).join(table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e")), "vec_id")


def gram(spark, d):
    rows = runs(spark, d)
    return matrix.gram(rows, "vec_id", ["v", "e"], rows.filter("vec_id % 20 = 0"))


@query("q_avg_gram", f"WITH {VECS}, {GRAM} SELECT i, j, round(value, 6) AS value FROM g")
def avg_gram(spark, d):
    return gram(spark, d).select("i", "j", F.round("value", 6).alias("value"))


@query("q_gram_center", f"WITH {VECS}, {GRAM}, a AS (SELECT * FROM g WHERE i % 20 = 0) SELECT i, j, round(value - avg(value) OVER (PARTITION BY i) - avg(value) OVER (PARTITION BY j) + avg(value) OVER (), 6) AS value FROM a")
def gram_center(spark, d):
    return matrix.center(gram(spark, d).filter("i % 20 = 0")).select("i", "j", F.round("value", 6).alias("value"))


@query("q_gram_center_new", f"WITH {VECS}, {GRAM}, a AS (SELECT * FROM g WHERE i % 20 = 0), rm AS (SELECT j, avg(value) AS mean FROM a GROUP BY 1) SELECT n.i, n.j, round(n.value - avg(n.value) OVER (PARTITION BY n.i) - rm.mean + (SELECT avg(value) FROM a), 6) AS value FROM (SELECT * FROM g WHERE i % 20 <> 0) n JOIN rm ON n.j = rm.j")
def gram_center_new(spark, d):
    g = gram(spark, d)
    anchors = g.filter("i % 20 = 0")
    grand = anchors.agg(F.avg("value").alias("grand"))
    means = anchors.groupBy("j").agg(F.avg("value").alias("mean")).crossJoin(F.broadcast(grand))
    return matrix.center_new(g.filter("i % 20 <> 0"), means, F.col("mean") * 0).crossJoin(F.broadcast(grand)).select("i", "j", F.round(F.col("value") + F.col("grand"), 6).alias("value"))


@query("q_finite_vectors", "SELECT vec_id, list_count([x for x in embedding if isfinite(x)])::bigint AS n FROM embeddings")
def finite_vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.size(similarity.finite(F.col("embedding").cast("array<double>"))).cast("long").alias("n"))


@query("q_stream_fuse", "WITH n AS (SELECT p_name AS id, length(p_name)::double AS a, p_size::double AS b, p_retailprice / 1000 AS c, 1.0::double AS e, p_partkey FROM part), u AS (SELECT p_partkey, sqrt(0.6::double) * a / sqrt(a * a + b * b) AS x, sqrt(0.6::double) * b / sqrt(a * a + b * b) AS y, sqrt(0.4::double) * c / sqrt(c * c + e * e) AS z, sqrt(0.4::double) * e / sqrt(c * c + e * e) AS w FROM n) SELECT p_partkey, round(x / sqrt(x*x+y*y+z*z+w*w), 6) AS x, round(y / sqrt(x*x+y*y+z*z+w*w), 6) AS y, round(z / sqrt(x*x+y*y+z*z+w*w), 6) AS z, round(w / sqrt(x*x+y*y+z*z+w*w), 6) AS w FROM u")
def stream_fuse(spark, d):
    p = table(spark, d, "part")
    one = F.array(F.length("p_name").cast("double"), F.col("p_size").cast("double"))
    two = F.array(F.col("p_retailprice") / 1000, F.lit(1.0))
    fused = p.select("p_partkey", reduce.fuse({"one": one, "two": two}, {"one": 0.6, "two": 0.4}).alias("f"))
    return fused.select("p_partkey", *[F.round(F.col("f")[i], 6).alias(c) for i, c in enumerate("xyzw")])


@query("q_vector_dedup", f"WITH {VECS} SELECT vec_id, min(vec_id) OVER (PARTITION BY [round(x, 1) for x in v]) AS rep, count(*) OVER (PARTITION BY [round(x, 1) for x in v])::bigint AS n FROM vecs")
def vector_dedup(spark, d):
    return cluster.dedup_vectors(vecs(spark, d), 1)


LABELS = "labels_ AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN -1 ELSE label END AS cluster FROM vecs)"


@query("q_noise_attach", f"""WITH {VECS}, {KNN}, {LABELS},
by_ AS (SELECT src, l.cluster, count(*) AS n, avg(sim) AS mean, count(*) FILTER (sim >= 0.82) AS good FROM knn JOIN labels_ l ON dst = l.id JOIN labels_ s ON src = s.id WHERE s.cluster = -1 AND l.cluster <> -1 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER w AS r, lead(mean) OVER w AS next FROM by_ WINDOW w AS (PARTITION BY src ORDER BY n DESC, round(mean, 9) DESC, cluster)),
ok AS (SELECT src, cluster FROM r WHERE r = 1 AND (next IS NULL OR mean / (next + 1e-8) >= 1.5) AND n >= 2 AND mean >= 0.82 AND good >= 2)
SELECT l.id, coalesce(ok.cluster, l.cluster) AS cluster FROM labels_ l LEFT JOIN ok ON l.id = ok.src""")
def noise_attach(spark, d):
    v = vecs(spark, d)
    labels = v.select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 7 == 0, -1).otherwise(F.col("label")).alias("cluster"))
    return cluster.attach_noise(labels, similarity.neighbours(v, 15))


TWO = "two AS (SELECT vec_id AS id, CASE WHEN vec_id % 6 = 0 OR label = 9 THEN -1 ELSE label END AS hdb, CASE WHEN vec_id % 10 = 9 THEN -1 ELSE label * 2 + (vec_id % 11 = 0)::int END AS snn, 0.9::double AS prob FROM vecs)"
PURITY = "sz AS (SELECT snn, count(*) AS size FROM two WHERE snn <> -1 GROUP BY 1), ov AS (SELECT snn, hdb, count(*) AS n FROM two WHERE snn <> -1 AND hdb <> -1 GROUP BY 1, 2), best AS (SELECT * FROM ov QUALIFY row_number() OVER (PARTITION BY snn ORDER BY n DESC, hdb) = 1), map_ AS (SELECT snn, hdb, n, n / size AS purity FROM best JOIN sz USING (snn) WHERE n / size >= 0.75 AND n >= 3)"


def two(spark, d):
    hdb = F.when((F.col("vec_id") % 6 == 0) | (F.col("label") == 9), -1).otherwise(F.col("label"))
    snn = F.when(F.col("vec_id") % 10 == 9, -1).otherwise(F.col("label") * 2 + F.when(F.col("vec_id") % 11 == 0, 1).otherwise(0))
    return vecs(spark, d).select(F.col("vec_id").alias("id"), hdb.alias("hdb"), snn.alias("snn"), F.lit(0.9).alias("prob"))


@query("q_purity_map", f"WITH {VECS}, {TWO}, {PURITY} SELECT snn, hdb, n::bigint AS n, round(purity, 6) AS purity FROM map_")
def purity_map(spark, d):
    return cluster.purity_map(two(spark, d)).select("snn", "hdb", "n", F.round("purity", 6).alias("purity"))


@query("q_rescue", f"WITH {VECS}, {TWO}, {PURITY} SELECT t.id, CASE WHEN t.hdb = -1 AND m.hdb IS NOT NULL THEN m.hdb ELSE t.hdb END AS cluster, CASE WHEN t.hdb = -1 AND m.hdb IS NOT NULL THEN 0.6::double ELSE prob END AS probability FROM two t LEFT JOIN map_ m USING (snn)")
def rescue(spark, d):
    t = two(spark, d)
    return cluster.rescue(t, cluster.purity_map(t)).select("id", "cluster", "probability")


@query("q_mint", f"WITH {VECS}, {TWO}, {PURITY}, f AS (SELECT snn FROM two WHERE hdb = -1 AND snn <> -1 AND snn NOT IN (SELECT snn FROM map_) GROUP BY 1 HAVING count(*) >= 4), nw AS (SELECT snn, (SELECT max(hdb) FROM two) + row_number() OVER (ORDER BY snn) AS new_ FROM f) SELECT id, (CASE WHEN hdb = -1 AND new_ IS NOT NULL THEN new_ ELSE hdb END)::int AS cluster FROM two LEFT JOIN nw USING (snn)")
def mint(spark, d):
    t = two(spark, d)
    return cluster.mint(t, cluster.purity_map(t))


HALVES = "halves AS (SELECT vec_id, label * 2 + (vec_id % 2)::int AS cluster, v FROM vecs)"


@query("q_cluster_merge", f"""WITH RECURSIVE {VECS}, {HALVES}, mm AS (SELECT cluster, i, avg(v[i]) AS m FROM halves, range(1, 65) t(i) GROUP BY 1, 2), cen AS (SELECT cluster, list(m ORDER BY i) AS c FROM mm GROUP BY 1),
un AS (SELECT cluster, [x / sqrt(list_dot_product(c, c)) for x in c] AS c FROM cen), pr AS (SELECT a.cluster AS a, b.cluster AS b FROM un a JOIN un b ON a.cluster < b.cluster AND round(list_dot_product(a.c, b.c), 9) > 0.75),
ok AS (SELECT pr.a, pr.b FROM pr JOIN halves x ON x.cluster = pr.a JOIN halves y ON y.cluster = pr.b GROUP BY 1, 2 HAVING median(round(list_dot_product(x.v, y.v), 9)) >= 0.84 AND max(round(list_dot_product(x.v, y.v), 9)) >= 0.90),
e AS (SELECT a, b FROM ok UNION SELECT b, a FROM ok), reach(v, r) AS (SELECT DISTINCT cluster, cluster FROM halves UNION SELECT e.b, reach.r FROM reach JOIN e ON e.a = reach.v)
SELECT v AS cluster, min(r) AS merged FROM reach GROUP BY 1""")
def cluster_merge(spark, d):
    halves = vecs(spark, d).select(F.col("vec_id").alias("id"), (F.col("label") * 2 + (F.col("vec_id") % 2).cast("int")).alias("cluster"), "v")
    return cluster.merge_similar(halves)


@query("q_core_distance", f"WITH {VECS}, {KNN} SELECT src, round(1 - sim, 6) AS core FROM knn WHERE rank = 4")
def core_distance(spark, d):
    return cluster.core_distances(similarity.neighbours(vecs(spark, d), 15), 5).select("src", F.round("core", 6).alias("core"))


@query("q_mutual_reachability", f"WITH {VECS}, {KNN}, co AS (SELECT src, 1 - sim AS core FROM knn WHERE rank = 4), p AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, max(sim) AS sim FROM knn GROUP BY 1, 2) SELECT p.src, p.dst, round(greatest(a.core, b.core, 1 - p.sim), 6) AS distance FROM p JOIN co a ON a.src = p.src JOIN co b ON b.src = p.dst")
def mutual_reachability(spark, d):
    return cluster.mutual_reachability(similarity.neighbours(vecs(spark, d), 15), 5).select("src", "dst", F.round("distance", 6).alias("distance"))


@query("q_density_clusters")
def density_clusters(spark, d):
    return cluster.density_clusters(vecs(spark, d), min_size=5, min_samples=5)


@query("q_svd")
def svd(spark, d):
    return reduce.truncated_svd(vecs(spark, d), 8)


@query("q_pca")
def pca(spark, d):
    return reduce.pca(vecs(spark, d), 8)


@query("q_consensus")
def consensus(spark, d):
    return reduce.consensus(vecs(spark, d), runs=3, dim=8, anchors=128)


CENTRAL_VEC = """ng AS (SELECT label AS g, vec_id, v, 1 + vec_id % 3 AS n FROM vecs), f AS (SELECT *, n / sum(n) OVER (PARTITION BY g) AS fa FROM ng),
s AS (SELECT a.g, a.vec_id, sum(list_dot_product(a.v, b.v) * b.fa) AS s, max(a.fa) AS fa FROM f a JOIN f b ON a.g = b.g GROUP BY 1, 2)"""


@query("q_canonical_name_vec", f"WITH {VECS}, {CENTRAL_VEC} SELECT g AS label, vec_id, round(s + fa, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY g ORDER BY round(s + fa, 9) DESC, vec_id) = 1")
def canonical_name_vec(spark, d):
    return reduce.central_vectors(vecs(spark, d).withColumn("n", 1 + F.col("vec_id") % 3), "label", "vec_id", "n").select("label", "vec_id", F.round("score", 6).alias("score"))
