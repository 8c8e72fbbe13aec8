"""Queries over clustered companies."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from linkspark.operators import cluster as clusters
from linkspark.operators import resolve
from linkspark.operators.similarity import dot, edit_similarity, unit
from linkspark.operators.storage import materialize
from linkspark.queries.base import VECS, WITH_ORGS, entities, query, table, vecs, written_entities
from linkspark.queries.basic import CENTRAL

#: Records with clusters: the true entity, some as noise; in `wide` two entities share a cluster and many addresses lose their street.
CLUSTERED = "clustered AS (SELECT *, (CASE WHEN record_id % 17 = 3 THEN -1 ELSE true_entity END)::bigint AS cluster, 0.5 + (record_id % 50) / 100.0::double AS probability FROM entities)"
WIDE = "wide AS (SELECT record_id, (CASE WHEN record_id % 17 = 3 THEN -1 ELSE true_entity // 2 END)::bigint AS cluster, state, street_name, street_number, zip, address_key FROM entities)"


def clustered(spark, d):
    df = written_entities(spark, d).withColumn("cluster", F.when(F.col("record_id") % 17 == 3, -1).otherwise(F.col("true_entity")).cast("long"))
    return df.withColumn("probability", 0.5 + (F.col("record_id") % 50) / 100.0)


def wide(spark, d):
    return written_entities(spark, d).withColumn("cluster", F.when(F.col("record_id") % 17 == 3, -1).otherwise(F.floor(F.col("true_entity") / 2)).cast("long"))


PROFILES = f"""{CLUSTERED}, base AS (SELECT cluster AS g, normalized_text AS a FROM clustered WHERE cluster <> -1), {CENTRAL},
pk AS (SELECT cluster, address_key, state, max(score) AS score, count(*) AS n FROM clustered WHERE cluster <> -1 GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY max(score) DESC, count(*) DESC, address_key, state) = 1),
profiles AS (SELECT c.cluster, count(*) AS size, avg(probability) AS avg_probability, any_value(canonical_name) AS name, any_value(pk.address_key) AS key, any_value(pk.state) AS state FROM clustered c JOIN central ON g = c.cluster JOIN pk ON pk.cluster = c.cluster GROUP BY 1)"""


@query("q_cluster_profiles", f"{WITH_ORGS}, {PROFILES} SELECT cluster, size::bigint AS size, round(avg_probability, 6) AS avg_probability, name, key, state FROM profiles")
def cluster_profiles(spark, d):
    return resolve.profiles(clustered(spark, d)).withColumn("avg_probability", F.round("avg_probability", 6))


TWO_SIMS = f"{VECS}, mm AS (SELECT label, i, avg(v[i]) AS m FROM vecs, range(1, 65) t(i) GROUP BY 1, 2), cen AS (SELECT label, list(m ORDER BY i) AS c FROM mm GROUP BY 1), un AS (SELECT label, [x / sqrt(list_dot_product(c, c)) for x in c] AS c FROM cen), cs AS (SELECT vec_id AS id, v.label AS cluster, un.label AS profile, round(list_dot_product(v.v, un.c), 9) AS sim FROM vecs v, un)"


def centroid_sims(spark, d):
    v = vecs(spark, d)
    long = v.select("label", F.posexplode("v").alias("pos", "x")).groupBy("label", "pos").agg(F.avg("x").alias("m"))
    c = long.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("s")).select(F.col("label").alias("profile"), unit(F.transform("s", lambda x: x["m"])).alias("c"))
    return v.crossJoin(F.broadcast(c)).select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"), "profile", F.round(dot(F.col("v"), F.col("c")), 9).alias("sim"))


@query("q_margin_vote", f"WITH {TWO_SIMS}, o AS (SELECT id, max(sim) FILTER (cluster = profile) AS own, max(sim) FILTER (cluster <> profile) AS other FROM cs GROUP BY 1) SELECT id, round(own, 6) AS own, round(other, 6) AS other, own - other < 0.5 AS low_margin FROM o")
def margin_vote(spark, d):
    return resolve.margin_vote(centroid_sims(spark, d), 0.5).select("id", F.round("own", 6).alias("own"), F.round("other", 6).alias("other"), "low_margin")


MAHA = """s AS (SELECT cluster AS g, id, max(sim) FILTER (cluster = profile) AS a, 1 - 1.0::double / (2 + id % 13) AS b FROM cs GROUP BY 1, 2),
x AS (SELECT *, ln(greatest(1e-6, least(1 - 1e-6, a)) / (1 - greatest(1e-6, least(1 - 1e-6, a)))) AS x, ln(greatest(1e-6, least(1 - 1e-6, b)) / (1 - greatest(1e-6, least(1 - 1e-6, b)))) AS y, count(*) OVER (PARTITION BY g) AS n FROM s),
m AS (SELECT g, median(x) AS mx, median(y) AS my FROM x GROUP BY 1), z AS (SELECT x.*, greatest(0.01, least(0.2, 1 / sqrt(n))) AS c, row_number() OVER (PARTITION BY g ORDER BY round((x - mx) * (x - mx) + (y - my) * (y - my), 9), id) AS near FROM x JOIN m USING (g) WHERE n >= 5),
k AS (SELECT g, avg(x) AS ux, avg(y) AS uy, var_samp(x) + 1e-6 AS xx, var_samp(y) + 1e-6 AS yy, covar_samp(x, y) AS xy FROM z WHERE near <= greatest(3, floor(n * (1 - least(0.10, c / 2)))) GROUP BY 1),
dd AS (SELECT z.g, z.id, c, sqrt((yy * (x - ux) * (x - ux) - 2 * xy * (x - ux) * (y - uy) + xx * (y - uy) * (y - uy)) / (xx * yy - xy * xy)) AS distance FROM z JOIN k USING (g)),
ln_ AS (SELECT g, quantile_cont(distance, 0.5) AS q5, list(distance ORDER BY distance) AS l, max((1 - c) * 1.0::double) AS f FROM dd GROUP BY 1),
th AS (SELECT g, l[floor(f * (len(l) - 1))::int + 1] + (l[least(floor(f * (len(l) - 1))::int + 2, len(l))] - l[floor(f * (len(l) - 1))::int + 1]) * (f * (len(l) - 1) - floor(f * (len(l) - 1))) AS line FROM ln_)"""


@query("q_mahalanobis", f"WITH {TWO_SIMS}, {MAHA} SELECT dd.g, dd.id, round(distance, 5) AS distance, distance > greatest(line, 3.05) AS outlier FROM dd JOIN th USING (g)")
def mahalanobis(spark, d):
    own = centroid_sims(spark, d).filter("cluster = profile").select(F.col("cluster").alias("g"), "id", F.col("sim").alias("a"), (1 - 1.0 / (2 + F.col("id") % 13)).alias("b"))
    return resolve.mahalanobis(own).withColumn("distance", F.round("distance", 5))


@query("q_logit", "SELECT l_orderkey, l_linenumber, round(ln(greatest(1e-6, least(1 - 1e-6, l_discount)) / (1 - greatest(1e-6, least(1 - 1e-6, l_discount)))), 6) AS x FROM lineitem")
def logit(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(resolve.logit(F.col("l_discount")), 6).alias("x"))


@query("q_fdr_bh", "WITH p AS (SELECT event_id AS id, round((event_id * 7919 % 10007) * (event_id * 7919 % 10007) / 100140049.0::double, 9) AS p FROM events), r AS (SELECT *, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS k, count(*) OVER () AS n FROM p), l AS (SELECT max(p) AS line FROM r WHERE p <= k * 0.05::double / n) SELECT id, p, coalesce(p <= line, false) AS rejected FROM p, l")
def fdr_bh(spark, d):
    x = F.col("event_id") * 7919 % 10007
    return resolve.benjamini_hochberg(table(spark, d, "events").select(F.col("event_id").alias("id"), F.round(x * x / F.lit(100140049.0), 9).alias("p")))


EDIT = lambda a, b: f"CASE WHEN {a} = '' OR {b} = '' THEN 0.0::double ELSE exp(-2.0::double * levenshtein({a}, {b}) / (length({a}) + length({b}))) END"
REASSIGN = f"""{PROFILES}, cand AS (SELECT record_id, normalized_text, address_key, state, cluster AS now_ FROM clustered WHERE cluster = -1 OR probability < 0.55),
pp AS (SELECT record_id, now_, p.cluster AS to_, {EDIT("normalized_text", "name")} AS one, {EDIT("address_key", "key")} AS two, size, avg_probability FROM cand c JOIN profiles p ON c.state = p.state OR c.state = '' OR p.state = ''),
sc AS (SELECT *, round(greatest(0.0::double, 0.4 * greatest(0.0::double, one - CASE WHEN one < 0.89 THEN 0.05::double ELSE 0 END) + 0.4 * greatest(0.0::double, two - CASE WHEN two < 0.89 THEN 0.05::double ELSE 0 END) + 0.1 * greatest(0.0::double, least(1.0::double, ln(1.0 + size) / ln(11.0::double))) + 0.1 * avg_probability), 9) AS s FROM pp),
rk AS (SELECT *, coalesce(max(s) FILTER (now_ = to_) OVER (PARTITION BY record_id), 0) AS current, row_number() OVER (PARTITION BY record_id ORDER BY s DESC, to_) AS r FROM sc WHERE s >= 0.2),
moves AS (SELECT record_id, to_, s FROM rk WHERE r = 1 AND (current = 0 AND s > 0.3 OR current <> 0 AND s - current >= 0.1))"""


@query("q_reassign", f"{WITH_ORGS}, {REASSIGN} SELECT record_id, to_ AS cluster, round(s, 6) AS match_score FROM moves")
def reassign(spark, d):
    df = clustered(spark, d)
    return resolve.reassign(df, materialize(resolve.profiles(df))).withColumn("match_score", F.round("match_score", 6))


@query("q_apply_reassign", f"{WITH_ORGS}, {REASSIGN} SELECT c.record_id, coalesce(to_, c.cluster) AS cluster, round(CASE WHEN to_ IS NOT NULL THEN s * p.avg_probability WHEN c.cluster <> -1 AND probability < 0.55 THEN probability * 0.9 ELSE probability END, 6) AS probability FROM clustered c LEFT JOIN moves m USING (record_id) LEFT JOIN profiles p ON p.cluster = to_")
def apply_reassign(spark, d):
    df = clustered(spark, d)
    found = materialize(resolve.profiles(df))
    return resolve.apply_reassignment(df, resolve.reassign(df, found), found).withColumn("probability", F.round("probability", 6))


SPLIT3 = "clustered AS (SELECT *, record_id::bigint AS cluster, 0.5 + (record_id % 50) / 100.0::double AS probability FROM entities)"


@query("q_merge_clusters", f"""{WITH_ORGS}, {PROFILES.replace(CLUSTERED, SPLIT3)}, e0 AS (SELECT a.cluster AS src, b.cluster AS dst FROM profiles a JOIN profiles b ON a.key = b.key AND a.key <> '' AND a.cluster < b.cluster WHERE (a.state = b.state OR a.state = '' OR b.state = '') AND round({EDIT("a.name", "b.name")}, 9) >= 0.8),
e AS (SELECT src, dst FROM e0 UNION SELECT dst, src FROM e0), reach(v, r) AS (SELECT src, src FROM e UNION SELECT e.dst, reach.r FROM reach JOIN e ON e.src = reach.v), comp AS (SELECT v, min(r) AS c FROM reach GROUP BY 1)
SELECT v AS cluster, first_value(v) OVER (PARTITION BY c ORDER BY size DESC, v) AS winner FROM comp JOIN profiles p ON p.cluster = v""")
def merge_clusters(spark, d):
    df = clustered(spark, d).withColumn("cluster", F.col("record_id"))
    return resolve.merge_clusters(materialize(resolve.profiles(df)))


@query("q_consolidate_identical", f"""{WITH_ORGS}, i AS (SELECT DISTINCT normalized_text, address_key, record_id AS cluster FROM entities WHERE address_key <> ''), e0 AS (SELECT a.cluster AS src, b.cluster AS dst FROM i a JOIN i b USING (normalized_text, address_key) WHERE a.cluster < b.cluster),
e AS (SELECT src, dst FROM e0 UNION SELECT dst, src FROM e0), reach(v, r) AS (SELECT src, src FROM e UNION SELECT e.dst, reach.r FROM reach JOIN e ON e.src = reach.v) SELECT v AS cluster, min(r) AS winner FROM reach GROUP BY 1""")
def consolidate_identical(spark, d):
    return resolve.consolidate_identical(clustered(spark, d).withColumn("cluster", F.col("record_id")))


@query("q_enrich_address", f"""{WITH_ORGS}, {CLUSTERED}, holes AS (SELECT * REPLACE (CASE WHEN record_id % 3 = 1 THEN '' ELSE street_number END AS street_number, CASE WHEN record_id % 3 = 1 THEN '' ELSE street_name END AS street_name) FROM clustered),
b AS (SELECT cluster, address_key, street_number, street_name, city, state, zip FROM holes WHERE cluster <> -1 AND street_name <> '' QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY score DESC, address_key) = 1),
j AS (SELECT h.record_id, h.cluster <> -1 AND h.street_name = '' AND coalesce(h.city = b.city AND h.state = b.state AND h.zip = b.zip, false) AS enriched, h.street_number AS n0, h.street_name AS s0, h.address_key AS k0, b.* FROM holes h LEFT JOIN b ON h.cluster = b.cluster)
SELECT record_id, CASE WHEN enriched THEN street_number ELSE n0 END AS street_number, CASE WHEN enriched THEN street_name ELSE s0 END AS street_name, CASE WHEN enriched THEN concat_ws('|', street_number, street_name, city, state, zip) ELSE k0 END AS address_key, enriched FROM j""")
def enrich_address(spark, d):
    hole = F.col("record_id") % 3 == 1
    df = clustered(spark, d).withColumn("street_number", F.when(hole, "").otherwise(F.col("street_number"))).withColumn("street_name", F.when(hole, "").otherwise(F.col("street_name")))
    return resolve.enrich(df)


@query("q_state_split", f"{WITH_ORGS}, {WIDE}, o AS (SELECT DISTINCT cluster, state FROM wide WHERE cluster <> -1 AND state <> ''), k AS (SELECT cluster FROM o GROUP BY 1 HAVING count(*) > 1), n AS (SELECT cluster, state, (SELECT max(cluster) FROM wide) + row_number() OVER (ORDER BY cluster, state) AS new_ FROM o WHERE cluster IN (SELECT cluster FROM k)) SELECT w.record_id, coalesce(new_, w.cluster) AS cluster FROM wide w LEFT JOIN n USING (cluster, state)")
def state_split(spark, d):
    return resolve.split_states(wide(spark, d))


RANGE = "far_ AS (SELECT * REPLACE ((CASE WHEN record_id % 17 = 3 THEN -1 ELSE true_entity // 60 END)::bigint AS cluster, 'one st' AS street_name, '60000' AS zip) FROM clustered WHERE address_key <> '')"


@query("q_range_split", f"{WITH_ORGS}, {CLUSTERED}, {RANGE}, o AS (SELECT *, street_number::bigint AS num FROM far_ WHERE cluster <> -1), g AS (SELECT cluster, street_name, zip FROM o GROUP BY 1, 2, 3 HAVING count(DISTINCT num) > 1 AND max(num) - min(num) > 30), p AS (SELECT record_id, cluster, address_key FROM o SEMI JOIN g USING (cluster, street_name, zip)), n AS (SELECT cluster, address_key, (SELECT max(cluster) FROM far_) + row_number() OVER (ORDER BY cluster, address_key) AS new_ FROM (SELECT DISTINCT cluster, address_key FROM p)) SELECT f.record_id, coalesce(new_, f.cluster) AS cluster FROM far_ f LEFT JOIN p USING (record_id) LEFT JOIN n ON n.cluster = p.cluster AND n.address_key = p.address_key")
def range_split(spark, d):
    df = clustered(spark, d).filter("address_key <> ''").withColumn("cluster", F.when(F.col("record_id") % 17 == 3, -1).otherwise(F.floor(F.col("true_entity") / 60)).cast("long"))
    return resolve.split_ranges(df.withColumn("street_name", F.lit("one st")).withColumn("zip", F.lit("60000")))


CHAINS = f"{PROFILES}, ranked AS (SELECT cluster AS final_cluster, name, key, dense_rank() OVER (PARTITION BY name ORDER BY key) AS k FROM profiles), canonical AS (SELECT final_cluster, key, name || CASE WHEN max(k) OVER (PARTITION BY name) > 1 THEN ' - ' || k ELSE '' END AS canonical_name FROM ranked)"


def canonical(df):
    found = materialize(resolve.profiles(df)).select(F.col("cluster").alias("final_cluster"), "name", "key")
    return found.join(resolve.number_chains(found), "final_cluster")


@query("q_chain_numbering", f"{WITH_ORGS}, {CHAINS} SELECT final_cluster, canonical_name FROM canonical")
def chain_numbering(spark, d):
    return canonical(clustered(spark, d)).select("final_cluster", "canonical_name")


APPLIED = f"{CHAINS}, applied AS (SELECT c.*, upper(coalesce(m.canonical_name, c.normalized_text)) AS canonical_name, coalesce(m.key, c.address_key) AS canonical_address FROM clustered c LEFT JOIN canonical m ON m.final_cluster = c.cluster)"


@query("q_apply_canonical", f"{WITH_ORGS}, {APPLIED} SELECT record_id, canonical_name, canonical_address FROM applied")
def apply_canonical(spark, d):
    df = clustered(spark, d)
    return resolve.apply_canonical(df, canonical(df), "upper")


SCORED = f"""{APPLIED}, sims_ AS (SELECT *, {EDIT("normalized_text", "regexp_replace(lower(canonical_name), ' - [0-9]+$', '')")} AS name_similarity, {EDIT("address_key", "canonical_address")} AS address_confidence, 1 - {EDIT("lower(company_name)", "regexp_replace(lower(canonical_name), ' - [0-9]+$', '')")} AS change, record_id % 13 = 0 AS enriched FROM applied),
sized AS (SELECT *, count(*) OVER (PARTITION BY cluster) AS cluster_size, greatest(0.0::double, least(1.0::double, 1 - coalesce(stddev_samp(name_similarity) OVER (PARTITION BY cluster), 0))) AS cohesion_score FROM sims_),
scored AS (SELECT *, round(greatest(0.0::double, least(1.0::double, CASE WHEN cluster = -1 THEN 0.5 * name_similarity ELSE (0.25 * probability + 0.2 * name_similarity + 0.25 * address_confidence + 0.15 * cohesion_score + 0.15 * least(ln(1.0::double + cluster_size) / ln(11.0::double), 1.0::double)) * CASE WHEN change > 0.5 THEN 0.9::double ELSE 1 END * CASE WHEN enriched THEN 0.95::double ELSE 1 END * CASE WHEN cluster_size <= 2 AND change > 0.7 THEN 0.85::double ELSE 1 END END)), 9) AS confidence_score FROM sized),
final_ AS (SELECT *, concat_ws(',', CASE WHEN confidence_score < 0.75 THEN 'low_confidence' END, CASE WHEN change > 0.7 THEN 'drastic_name_change' END, CASE WHEN cluster_size = 1 AND change > 0.01 THEN 'singleton_name_change' END, CASE WHEN enriched AND confidence_score < 0.8 THEN 'enriched_low_confidence' END) AS review_reason FROM scored)"""


def final(spark, d):
    df = clustered(spark, d)
    df = df.join(resolve.apply_canonical(df, canonical(df), "upper"), "record_id")
    plain = F.regexp_replace(F.lower("canonical_name"), " - [0-9]+$", "")
    df = df.withColumn("name_similarity", edit_similarity(F.col("normalized_text"), plain)).withColumn("address_confidence", edit_similarity(F.col("address_key"), F.col("canonical_address")))
    df = df.withColumn("change", 1 - edit_similarity(F.lower("company_name"), plain)).withColumn("enriched", F.col("record_id") % 13 == 0)
    return resolve.review_flags(resolve.confidence(df))


@query("q_confidence", f"{WITH_ORGS}, {SCORED} SELECT record_id, cluster_size::bigint AS cluster_size, round(cohesion_score, 6) AS cohesion_score, round(confidence_score, 6) AS confidence_score, CASE WHEN confidence_score <= 0.5 THEN 'Low' WHEN confidence_score <= 0.7 THEN 'Medium' WHEN confidence_score <= 0.85 THEN 'High' ELSE 'Very High' END AS confidence_category FROM final_")
def confidence(spark, d):
    return final(spark, d).select("record_id", "cluster_size", F.round("cohesion_score", 6).alias("cohesion_score"), F.round("confidence_score", 6).alias("confidence_score"), "confidence_category")


@query("q_review_flags", f"{WITH_ORGS}, {SCORED} SELECT record_id, review_reason <> '' AS needs_review, review_reason FROM final_")
def review_flags(spark, d):
    return final(spark, d).select("record_id", "needs_review", "review_reason")


@query("q_review_table", f"{WITH_ORGS}, {APPLIED} SELECT DISTINCT company_name AS original_name, address AS original_address, canonical_name, canonical_address FROM applied")
def review_table(spark, d):
    df = clustered(spark, d)
    names = resolve.apply_canonical(df, canonical(df), "upper")
    return df.join(names, "record_id").select(F.col("company_name").alias("original_name"), F.col("address").alias("original_address"), "canonical_name", "canonical_address").distinct()


@query("q_report_summary", f"{WITH_ORGS}, {SCORED} SELECT count(*)::bigint AS records, count(DISTINCT company_name)::bigint AS names_before, count(DISTINCT canonical_name)::bigint AS names_after, count(DISTINCT CASE WHEN cluster <> -1 THEN cluster END)::bigint AS clusters, count(*) FILTER (cluster = -1)::bigint AS noise, count(DISTINCT CASE WHEN regexp_matches(canonical_name, ' - [0-9]+$') THEN canonical_name END)::bigint AS chains, count(*) FILTER (enriched)::bigint AS enriched, count(*) FILTER (review_reason <> '')::bigint AS flagged FROM final_")
def report_summary(spark, d):
    return resolve.report(final(spark, d))


@query("q_review_reasons", f"{WITH_ORGS}, {SCORED} SELECT reason, count(*)::bigint AS n FROM (SELECT unnest(string_split(review_reason, ',')) AS reason FROM final_ WHERE review_reason <> '') GROUP BY 1")
def review_reasons(spark, d):
    return final(spark, d).filter("needs_review").select(F.explode(F.split("review_reason", ",")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("q_describe", "SELECT l_returnflag, count(l_extendedprice)::bigint AS n, round(avg(l_extendedprice), 6) AS mean, round(stddev_samp(l_extendedprice), 6) AS std, min(l_extendedprice) AS min, round(quantile_cont(l_extendedprice, 0.25), 6) AS q25, round(quantile_cont(l_extendedprice, 0.5), 6) AS q50, round(quantile_cont(l_extendedprice, 0.75), 6) AS q75, max(l_extendedprice) AS max FROM lineitem GROUP BY 1")
def describe(spark, d):
    out = resolve.describe(table(spark, d, "lineitem").groupBy("l_returnflag"), "l_extendedprice")
    return out.select("l_returnflag", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std")], "min", *[F.round(c, 6).alias(c) for c in ("q25", "q50", "q75")], "max")


@query("q_check_duplicates", f"{WITH_ORGS} SELECT normalized_text, address_key, count(DISTINCT record_id)::bigint AS n_clusters FROM entities WHERE address_key <> '' GROUP BY 1, 2 HAVING count(DISTINCT record_id) > 1")
def check_duplicates(spark, d):
    return resolve.duplicates_across(clustered(spark, d).withColumn("cluster", F.col("record_id")))


@query("q_check_consistency", f"{WITH_ORGS} SELECT normalized_text AS canonical_name, count(DISTINCT address_key)::bigint AS n_addresses FROM entities GROUP BY 1 HAVING count(DISTINCT address_key) > 1")
def check_consistency(spark, d):
    return resolve.inconsistent_names(entities(spark, d).select(F.col("normalized_text").alias("canonical_name"), F.col("address_key").alias("canonical_address")))


@query("q_pair_validation", f"{WITH_ORGS} SELECT a.record_id AS src, b.record_id AS dst, coalesce(abs(try_cast(a.street_number AS bigint) - try_cast(b.street_number AS bigint)) <= 30, true) AND (a.state = '' OR b.state = '' OR a.state = b.state) AS valid FROM entities a JOIN entities b ON a.normalized_text = b.normalized_text AND a.record_id < b.record_id")
def pair_validation(spark, d):
    df = written_entities(spark, d)
    a = df.select(F.col("record_id").alias("src"), "normalized_text", F.col("street_number").alias("na"), F.col("state").alias("sa"))
    b = df.select(F.col("record_id").alias("dst"), "normalized_text", F.col("street_number").alias("nb"), F.col("state").alias("sb"))
    ok = resolve.numbers_fit(F.col("na"), F.col("nb")) & resolve.states_fit(F.col("sa"), F.col("sb"))
    return a.join(b, "normalized_text").filter("src < dst").select("src", "dst", ok.alias("valid"))
