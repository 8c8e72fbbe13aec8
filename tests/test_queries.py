"""Queries against their SQL on the smallest tables, and the whole resolver."""

import os

import duckdb
import pytest

import __spark_entry__
from linkspark import queries as own

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: A spread over the modules; the driver holds all of them against their SQL.
SOME = ["q_name_normalize", "q_address_key", "q_text_streams", "q_similar_pairs", "q_canonical_name", "q_best_address", "q_winsorize", "q_describe", "q_confidence", "q_state_split", "q_fdr_bh", "q_enrich_address", "q_reassign_candidates", "q_address_near_duplicates", "q_contexts", "q_gram_center_new", "q_aligned"]

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def rows(columns, data):
    return sorted(str(tuple(round(v, 5) + 0.0 if isinstance(v, float) else v for v in (dict(zip(columns, r))[c] for c in sorted(columns)))) for r in data)


@pytest.mark.parametrize("name", SOME)
def test_same_as_sql(spark, duck, name):
    df = own.queries()[name](spark, DATA)
    result = duck.sql(own.oracle_sql()[name])
    assert sorted(df.columns) == sorted(result.columns)
    got, want = rows(df.columns, [tuple(r) for r in df.collect()]), rows(result.columns, result.fetchall())
    assert got == want and got


def test_entry(spark):
    names = set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= names
    assert __spark_entry__.entry(spark).count() > 0


def test_quick_start(spark):
    from linkspark.plans.resolver import Linker
    from linkspark.sources.store import Columns, Config

    data = [(1, "Acme Corp", "123 Main St, Chicago, IL 60601"), (2, "ACME Corporation", "123 Main St, Chicago, Illinois 60601"), (3, "Acme Corp.", ""), (4, "TechStart Inc", "456 Oak Ave, Hoffman Estates, IL 60169"), (5, "Tech Start LLC", "456 Oak Ave, Hoffman Estates, IL 60169")]
    df = spark.createDataFrame(data, "record_id long, company_name string, address string")
    model = Linker(Config(columns=Columns("company_name", ("address",))))
    got = {r["record_id"]: r["cluster"] for r in model.fit_transform(df).collect()}
    assert len({got[1], got[2], got[3]}) == 1 and got[4] == got[5] != got[1]
    with pytest.raises(KeyError):
        model.fit(df.drop("company_name"))


def test_resolver_finds_the_entities(spark):
    from linkspark.plans.resolver import Linker
    from linkspark.queries.base import orgs
    from linkspark.queries.serving import CONFIG

    df = orgs(spark, DATA)
    typo = df.filter("address <> '' and record_id % 30 = 1").selectExpr("record_id + 100000 AS record_id", "true_entity", "concat(company_name, 's') AS company_name", "replace(address, 'St', 'Str') AS address")
    df = df.unionByName(typo)
    got = Linker(CONFIG).fit_transform(df).select("record_id", "cluster").join(df, "record_id").toPandas()
    for rows, least in ((got, 0.9), (got[got.address != ""], 0.95)):
        pairs = lambda c: (rows.groupby(c).size() * (rows.groupby(c).size() - 1) // 2).sum()  # noqa: B023, E731
        both = pairs(["cluster", "true_entity"])
        assert both / pairs(["cluster"]) >= least and both / pairs(["true_entity"]) >= least
