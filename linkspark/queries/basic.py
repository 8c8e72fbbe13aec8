"""Names, addresses, similarity and graphs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from linkspark.functions import address, text
from linkspark.operators import graph, similarity
from linkspark.queries.base import VECS, WITH_ORGS, entities, orgs, query, quoted, sql_replaced, table, vecs, written_entities


@query("q_name_normalize", f"{WITH_ORGS} SELECT record_id, normalized_text FROM names")
def name_normalize(spark, d):
    return text.with_normal_name(orgs(spark, d), "company_name", "normalized_text").select("record_id", "normalized_text")


@query("q_doc_normalize", f"SELECT doc_id, md5(trim({sql_replaced('lower(text)', text.CLEAN)})) AS clean_md5 FROM documents")
def doc_normalize(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.cleaned(F.lower("text")).cast("binary")).alias("clean_md5"))


@query("q_nfkc_fold")
def nfkc_fold(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    talk = table(spark, d, "conversations").select(F.col("conv_id").alias("id"), "text")
    return docs.union(talk).select("id", text.nfkc(F.col("text")).alias("folded"))


@query("q_qualifier_extract", f"{WITH_ORGS} SELECT record_id, CASE WHEN regexp_extract(q, {quoted(text.QUALIFIER)}, 1) = '' THEN q ELSE regexp_extract(q, {quoted(text.QUALIFIER)}, 1) END AS name FROM (SELECT record_id, lower(concat(company_name, CASE record_id % 4 WHEN 0 THEN ' dba north ' || record_id WHEN 1 THEN ' f/k/a old co' ELSE '' END)) AS q FROM orgs)")
def qualifier_extract(spark, d):
    tail = F.when(F.col("record_id") % 4 == 0, F.concat(F.lit(" dba north "), F.col("record_id").cast("string"))).when(F.col("record_id") % 4 == 1, " f/k/a old co").otherwise("")
    return orgs(spark, d).select("record_id", text.qualified(F.lower(F.concat("company_name", tail))).alias("name"))


@query("q_suffix_strip", f"{WITH_ORGS} SELECT record_id, trim({sql_replaced('lower(company_name)', text.suffix_step())}) AS name FROM orgs")
def suffix_strip(spark, d):
    return orgs(spark, d).select("record_id", text.strip_suffixes(F.lower("company_name")).alias("name"))


@query("q_address_parse", f"{WITH_ORGS} SELECT record_id, street_number, street_name, city, state, zip FROM addresses")
def address_parse(spark, d):
    return orgs(spark, d).select("record_id", *[c.alias(n) for n, c in address.parse(F.col("address")).items()])


@query("q_address_combine", f"{WITH_ORGS} SELECT record_id, trim(regexp_replace(regexp_replace(lower(concat_ws(' ', nullif(trim(company_name), ''), nullif(trim(address), ''))), '[,|;/]+', ' ', 'g'), '\\s+', ' ', 'g')) AS line FROM orgs")
def address_combine(spark, d):
    return orgs(spark, d).select("record_id", address.combine(F.col("company_name"), F.col("address")).alias("line"))


@query("q_address_key", f"{WITH_ORGS} SELECT record_id, address_key FROM addresses")
def address_key(spark, d):
    return entities(spark, d).select("record_id", "address_key")


@query("q_address_score", f"{WITH_ORGS} SELECT record_id, score::bigint AS score FROM addresses")
def address_score(spark, d):
    return entities(spark, d).select("record_id", F.col("score").cast("long").alias("score"))


@query("q_best_address", f"{WITH_ORGS}, f AS (SELECT true_entity, address_key, max(score) AS score, count(*) AS n FROM entities GROUP BY 1, 2) SELECT true_entity, address_key, n::bigint AS n FROM f QUALIFY row_number() OVER (PARTITION BY true_entity ORDER BY score DESC, n DESC, address_key) = 1")
def best_address(spark, d):
    f = entities(spark, d).groupBy("true_entity", "address_key").agg(F.max("score").alias("score"), F.count("*").alias("n"))
    first = F.row_number().over(Window.partitionBy("true_entity").orderBy(F.desc("score"), F.desc("n"), "address_key"))
    return f.withColumn("r", first).filter("r = 1").select("true_entity", "address_key", "n")


@query(
    "q_text_streams",
    f"""{WITH_ORGS} SELECT record_id, concat_ws(' ', n, n, n, nullif(street_number, ''), nullif(street_name, ''), nullif(city, ''), nullif(state, ''), nullif(zip, '')) AS combined_tfidf,
    'entity: ' || concat_ws(' ', n, nullif(street_name, ''), nullif(city, ''), nullif(state, '')) AS combined_semantic, concat_ws(' ', n, n, n) AS name_tfidf, 'name: ' || n AS name_semantic, n AS phonetic,
    concat_ws(' ', nullif(street_number, ''), nullif(street_name, ''), nullif(street_name, ''), nullif(city, ''), nullif(state, ''), nullif(zip, '')) AS address_tfidf,
    trim('address: ' || street_number || ' ' || street_name || ', ' || city || ', ' || state || ' ' || zip) AS address_semantic FROM (SELECT *, normalized_text AS n FROM entities)""",
)
def text_streams(spark, d):
    full = lambda c: F.when(F.col(c) != "", F.col(c))
    n, (num, street, city, state, zip_) = F.col("normalized_text"), map(full, address.PARTS)
    line = F.concat(F.lit("address: "), F.col("street_number"), F.lit(" "), F.col("street_name"), F.lit(", "), F.col("city"), F.lit(", "), F.col("state"), F.lit(" "), F.col("zip"))
    return entities(spark, d).select(
        "record_id",
        F.concat_ws(" ", n, n, n, num, street, city, state, zip_).alias("combined_tfidf"),
        F.concat(F.lit("entity: "), F.concat_ws(" ", n, street, city, state)).alias("combined_semantic"),
        F.concat_ws(" ", n, n, n).alias("name_tfidf"),
        F.concat(F.lit("name: "), n).alias("name_semantic"),
        n.alias("phonetic"),
        F.concat_ws(" ", num, street, street, city, state, zip_).alias("address_tfidf"),
        F.trim(line).alias("address_semantic"),
    )


@query("q_names_per_address", f"{WITH_ORGS} SELECT address_key, count(*)::bigint AS n, count(DISTINCT normalized_text)::bigint AS n_names FROM entities WHERE address_key <> '' GROUP BY 1")
def names_per_address(spark, d):
    return entities(spark, d).filter("address_key <> ''").groupBy("address_key").agg(F.count("*").alias("n"), F.count_distinct("normalized_text").alias("n_names"))


CENTRAL = """c AS (SELECT g, a, count(*) AS n FROM base GROUP BY 1, 2), t AS (SELECT g, sum(n) AS total, max(length(a)) AS longest FROM c GROUP BY 1),
f AS (SELECT c.g, c.a, c.n / t.total AS fa, t.longest FROM c JOIN t USING (g)),
s AS (SELECT x.g, x.a, x.fa, sum(CASE WHEN x.a = y.a THEN 0.0::double ELSE exp(-levenshtein(x.a, y.a)::double / x.longest) * y.fa END) AS s FROM f x JOIN f y ON x.g = y.g GROUP BY 1, 2, 3),
central AS (SELECT g, a AS canonical_name, round((s + fa + fa) * least(ln(length(a) + 1.0), 3.5), 9) AS score FROM s QUALIFY row_number() OVER (PARTITION BY g ORDER BY round((s + fa + fa) * least(ln(length(a) + 1.0), 3.5), 9) DESC, a) = 1)"""


@query("q_canonical_name", f"WITH base AS (SELECT p_brand AS g, p_name AS a FROM part), {CENTRAL} SELECT g AS p_brand, canonical_name, round(score, 6) AS score FROM central")
def canonical_name(spark, d):
    out = similarity.central_names(table(spark, d, "part"), "p_brand", "p_name")
    return out.select("p_brand", "canonical_name", F.round("score", 6).alias("score"))


@query("q_consolidate_names", f"{WITH_ORGS}, base AS (SELECT address_key AS g, normalized_text AS a FROM entities WHERE address_key <> ''), {CENTRAL} SELECT record_id, coalesce(canonical_name, normalized_text) AS normalized_text FROM entities LEFT JOIN central ON address_key = g")
def consolidate_names(spark, d):
    own = written_entities(spark, d).select("record_id", "normalized_text", "address_key")
    names = similarity.central_names(own.filter("address_key <> ''"), "address_key", "normalized_text")
    return own.join(names, "address_key", "left").select("record_id", F.coalesce("canonical_name", "normalized_text").alias("normalized_text"))


@query("q_edit_similarity", "WITH n AS (SELECT DISTINCT p_name FROM part) SELECT a.p_name AS a, b.p_name AS b, round(exp(-2.0::double * levenshtein(a.p_name, b.p_name) / (length(a.p_name) + length(b.p_name))), 6) AS sim FROM n a JOIN n b ON a.p_name < b.p_name")
def edit_similarity(spark, d):
    a = table(spark, d, "part").select(F.col("p_name").alias("a")).distinct()
    b = a.withColumnRenamed("a", "b")
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(similarity.edit_similarity(F.col("a"), F.col("b")), 6).alias("sim"))


TFIDF = """g AS (SELECT p_name AS id, unnest(flatten([[substring(p_name, i::int, k::int) for i in range(1, length(p_name) - k + 2)] for k in range(3, 6)])) AS gram FROM (SELECT DISTINCT p_name FROM part)),
c AS (SELECT id, gram, count(*) AS n FROM g GROUP BY 1, 2), nn AS (SELECT count(DISTINCT p_name) AS rows_ FROM part),
df AS (SELECT gram, count(*) AS df FROM c GROUP BY 1 HAVING count(*) >= 2 AND count(*) <= 0.99::double * (SELECT rows_ FROM nn)),
w AS (SELECT id, gram, (1 + ln(n::double)) * (ln((1.0::double + (SELECT rows_ FROM nn)) / (1 + df)) + 1) AS w FROM c JOIN df USING (gram)),
tfidf AS (SELECT id, gram, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM w),
pairs AS (SELECT x.id AS a, y.id AS b, sum(x.weight * y.weight) AS sim FROM tfidf x JOIN tfidf y ON x.gram = y.gram AND x.id < y.id GROUP BY 1, 2)"""


def part_weights(spark, d):
    names = table(spark, d, "part").select("p_name").distinct()
    return similarity.tfidf(similarity.grams(names, "p_name", "p_name"), names.count())


@query("q_ngram_tfidf", f"WITH {TFIDF} SELECT id AS p_name, gram, round(weight, 6) AS weight FROM tfidf")
def ngram_tfidf(spark, d):
    return part_weights(spark, d).select(F.col("id").alias("p_name"), "gram", F.round("weight", 6).alias("weight"))


@query("q_tfidf_pair_similarity", f"WITH {TFIDF} SELECT a, b, round(sim, 6) AS sim FROM pairs")
def tfidf_pair_similarity(spark, d):
    return similarity.similar_pairs(part_weights(spark, d), 0.0).select("a", "b", F.round("sim", 6).alias("sim"))


@query("q_similar_pairs", f"WITH {TFIDF} SELECT a, b, round(sim, 6) AS sim FROM pairs WHERE round(sim, 9) > 0.3")
def similar_pairs(spark, d):
    return similarity.similar_pairs(part_weights(spark, d), 0.0).filter("round(sim, 9) > 0.3").select("a", "b", F.round("sim", 6).alias("sim"))


@query("q_doc_exact_duplicates", "SELECT min(doc_id) AS doc_id, count(*)::bigint AS n FROM documents GROUP BY text HAVING count(*) > 1")
def doc_exact_duplicates(spark, d):
    return table(spark, d, "documents").groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).filter("n > 1").select("doc_id", "n")


KNN = "knn AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) - 1 AS rank, sim FROM sims QUALIFY row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) <= 15)"


@query("q_knn", f"WITH {VECS}, {KNN} SELECT src, dst, rank::bigint AS rank, round(sim, 6) AS sim FROM knn")
def knn(spark, d):
    return similarity.neighbours(vecs(spark, d), 15).select("src", "dst", F.col("rank").cast("long").alias("rank"), F.round("sim", 6).alias("sim"))


@query("q_mutual_graph", f"WITH {VECS}, {KNN} SELECT a.src, a.dst, round(1.0::double / (a.rank + b.rank + 2) * ((a.sim + b.sim) / 2), 6) AS weight FROM knn a JOIN knn b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst")
def mutual_graph(spark, d):
    return graph.mutual_rank_graph(similarity.neighbours(vecs(spark, d), 15)).select("src", "dst", F.round("weight", 6).alias("weight"))


@query("q_components", f"WITH RECURSIVE {VECS}, {KNN}, e AS MATERIALIZED (SELECT src, dst FROM knn WHERE sim > 0.82 UNION SELECT dst, src FROM knn WHERE sim > 0.82), reach(v, r) AS (SELECT src, src FROM e UNION SELECT e.dst, reach.r FROM reach JOIN e ON e.src = reach.v WHERE reach.r < e.dst OR reach.r < reach.v) SELECT v AS vertex, min(r) AS component_id FROM reach GROUP BY 1")
def components(spark, d):
    near = similarity.neighbours(vecs(spark, d), 15).filter("sim > 0.82")
    return graph.components(near.select("src", "dst"))


@query("q_flatten_mapping", "WITH RECURSIVE m AS (SELECT c_custkey AS id, c_custkey // 2 AS parent FROM customer WHERE c_custkey % 5 <> 0), f(id, root) AS (SELECT id, parent FROM m UNION ALL SELECT f.id, m.parent FROM f JOIN m ON f.root = m.id WHERE m.parent <> f.root) SELECT id, min(root) AS root FROM f GROUP BY 1")
def flatten_mapping(spark, d):
    mapping = table(spark, d, "customer").filter("c_custkey % 5 <> 0").selectExpr("c_custkey AS id", "c_custkey div 2 AS parent")
    return graph.flatten(mapping)


@query("q_communities")
def communities(spark, d):
    return graph.communities(graph.mutual_rank_graph(similarity.neighbours(vecs(spark, d), 15)))


@query("q_embedding_cosine", f"WITH {VECS} SELECT a.vec_id, b.vec_id AS other, round(list_dot_product(a.v, b.v), 6) AS sim FROM vecs a JOIN vecs b ON b.vec_id = a.vec_id + 1")
def embedding_cosine(spark, d):
    a = vecs(spark, d).select("vec_id", "v", (F.col("vec_id") + 1).alias("other"))
    b = vecs(spark, d).select(F.col("vec_id").alias("other"), F.col("v").alias("w"))
    return a.join(b, "other").select("vec_id", "other", F.round(similarity.dot(F.col("v"), F.col("w")), 6).alias("sim"))
