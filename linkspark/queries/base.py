"""Derived views that the queries start from, and helpers for their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.functions import address, text
from linkspark.operators.storage import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with its SQL if it has one."""

    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Companies with noisy names and addresses, three records for each true entity; the text runs in both engines.
ORGS = """
SELECT c_custkey AS record_id, cast(floor(c_custkey / 3) AS bigint) AS true_entity,
  concat(CASE WHEN c_custkey % 7 = 5 THEN upper(split_part('acme apex delta summit pioneer harbor liberty triple', ' ', cast(floor(c_custkey / 3) % 8 + 1 AS int)))
      ELSE split_part('Acme Apex Delta Summit Pioneer Harbor Liberty Triple', ' ', cast(floor(c_custkey / 3) % 8 + 1 AS int)) END,
    ' ', split_part('Truck Auto Equip Steel Freight Dental Paper', ' ', cast(floor(c_custkey / 3) % 7 + 1 AS int)),
    ' ', split_part('Svc Supply Works Rpr Traders', ' ', cast(floor(c_custkey / 3) % 5 + 1 AS int)),
    CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN ', Inc.' ELSE ' LLC' END,
    CASE WHEN c_custkey % 7 = 3 THEN ' (HQ)' WHEN c_custkey % 7 = 6 THEN ' & Co' ELSE '' END) AS company_name,
  CASE WHEN c_custkey % 11 = 10 THEN '' ELSE concat(cast(100 + floor(c_custkey / 3) % 800 AS int), ' ',
    split_part('Main Oak Maple Cedar Lake Hill', ' ', cast(floor(c_custkey / 3) % 6 + 1 AS int)),
    CASE WHEN c_custkey % 3 = 1 THEN ' Street' ELSE ' St' END, ', ',
    split_part('Chicago Dallas Denver Boise Tampa', ' ', cast(floor(c_custkey / 3) % 5 + 1 AS int)), ', ',
    CASE WHEN c_custkey % 3 = 2 THEN split_part('Illinois Texas Colorado Idaho Florida', ' ', cast(floor(c_custkey / 3) % 5 + 1 AS int))
      ELSE split_part('IL TX CO ID FL', ' ', cast(floor(c_custkey / 3) % 5 + 1 AS int)) END, ' ',
    cast(60000 + floor(c_custkey / 3) % 900 AS int)) END AS address
FROM customer
"""


def orgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").createOrReplaceTempView("customer")
    return spark.sql(ORGS)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt out to all cores: a small file would be read by one task, which would parse all its rows too."""
    spark = df.sparkSession
    return df.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def sql_replaced(x: str, steps: list[tuple[str, str]]) -> str:
    for pattern, by in steps:
        x = f"regexp_replace({x}, {quoted(pattern)}, {quoted(by)}, 'g')"
    return x


def sql_state(x: str) -> str:
    cases = " ".join(f"WHEN {quoted(a)} THEN {quoted(b)}" for a, b in address.STATES.items())
    return f"CASE lower(trim({x})) {cases} ELSE lower(trim({x})) END"


def _sql_names() -> str:
    """Stages of name normalisation as nested selects."""
    T = text
    return f"""
names_1 AS (SELECT record_id, lower(company_name) AS low FROM orgs),
names_2 AS (SELECT record_id, low, {sql_replaced("low", T.LETTERS + T.replacement_steps())} AS x FROM names_1),
names_3 AS (SELECT record_id, low, CASE WHEN regexp_extract(x, {quoted(T.QUALIFIER)}, 1) = '' THEN x ELSE regexp_extract(x, {quoted(T.QUALIFIER)}, 1) END AS x FROM names_2),
names_4 AS (SELECT record_id, low, {sql_replaced("x", T.SYMBOLS + T.ASIDES + T.MISREAD + T.suffix_step())} AS x FROM names_3),
names_5 AS (SELECT record_id, trim({sql_replaced("low", T.CLEAN)}) AS plain, trim({sql_replaced("x", T.CLEAN)}) AS x FROM names_4),
names AS (SELECT record_id, CASE WHEN length(x) >= 2 THEN x WHEN plain = '' THEN 'unknown_entity' ELSE plain END AS normalized_text FROM names_5)"""


def _sql_addresses() -> str:
    part = lambda k: f"regexp_extract(lower(address), {quoted(address.GRAMMAR)}, {k})"
    return f"""
parts AS (SELECT record_id, {part(1)} AS street_number, {part(2)} AS street_name, {part(3)} AS city, {sql_state(part(4))} AS state, {part(5)} AS zip FROM orgs),
keyed AS (SELECT *, trim(regexp_replace(concat_ws('|', regexp_replace(street_number, '[^0-9].*', ''), regexp_replace(street_name, '\\s+(n|s|e|w|north|south|east|west)$', ''), city, state, substr(zip, 1, 5)), '\\s+', ' ', 'g')) AS k0 FROM parts),
addresses AS (SELECT record_id, street_number, street_name, city, state, zip, CASE WHEN k0 = '||||' THEN '' ELSE k0 END AS address_key,
  2 * (street_name <> '')::int + (street_number <> '')::int + (city <> '')::int + (state <> '')::int + regexp_matches(zip, '^\\d{{5}}$')::int AS score FROM keyed)"""


#: Prologue of the SQL of queries on companies: orgs, names, addresses and entities (all of it by record).
WITH_ORGS = f"WITH RECURSIVE orgs AS ({ORGS}), {_sql_names()}, {_sql_addresses()},\nentities AS (SELECT o.record_id, o.true_entity, o.company_name, o.address, n.normalized_text, a.street_number, a.street_name, a.city, a.state, a.zip, a.address_key, a.score FROM orgs o JOIN names n USING (record_id) JOIN addresses a USING (record_id))"


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies with normal names, parsed addresses, keys and completeness."""
    df = text.with_normal_name(orgs(spark, sf_dir), "company_name", "normalized_text").withColumns(address.parse(F.col("address")))
    parts = {p: F.col(p) for p in address.PARTS}
    return df.withColumn("address_key", address.key(parts)).withColumn("score", address.completeness(parts))


def written_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities, parsed once and written, for queries that read them more than once."""
    return materialize(entities(spark, sf_dir))


#: Vectors with a planted cluster for each label.
VECS_SPARK = """
WITH p AS (SELECT vec_id, label, transform(embedding, (x, i) -> CAST(x AS double) * (CASE WHEN vec_id % 10 = 9 THEN 1.0D ELSE 0.3D END)
    + (CASE WHEN floor(i / 6) = label THEN 0.4D ELSE 0.0D END)) AS u FROM embeddings),
n AS (SELECT vec_id, label, u, sqrt(aggregate(u, 0.0D, (a, x) -> a + x * x)) AS z FROM p)
SELECT vec_id, label, transform(u, x -> round(x / z, 9)) AS v FROM n
"""
VECS = """vecs AS (WITH p AS (SELECT vec_id, label, [embedding[i]::double * (CASE WHEN vec_id % 10 = 9 THEN 1.0::double ELSE 0.3::double END)
    + (CASE WHEN floor((i - 1) / 6) = label THEN 0.4::double ELSE 0.0::double END) for i in range(1, 65)] AS u FROM embeddings),
n AS (SELECT vec_id, label, u, sqrt(list_sum([x * x for x in u])) AS z FROM p)
SELECT vec_id, label, [round(x / z, 9) for x in u] AS v FROM n),
sims AS (SELECT a.vec_id AS src, b.vec_id AS dst, a.label AS src_label, b.label AS dst_label, round(list_dot_product(a.v, b.v), 9) AS sim FROM vecs a JOIN vecs b ON a.vec_id <> b.vec_id)"""


def vecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "embeddings").createOrReplaceTempView("embeddings")
    return spark.sql(VECS_SPARK)
