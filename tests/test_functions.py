import pytest
from pyspark.sql import functions as F

from linkspark.functions import address, phonetic, text
from linkspark.sources import store


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_names(spark):
    cases = {
        "Acme, Inc.": "acme",
        "ACME   Svc LLC": "acme service",
        "triple a llc": "aaa",
        "x holdings group inc": "x holdings group inc",
        "north holdings group inc": "north",
        "acme inc dba road runner": "road runner",
        "smith f/k/a jones co": "jones",
        "Bob's Parts (HQ)": "bob parts",
        "Zürich Foods": "zürich foods",
        None: "unknown_entity",
        "": "unknown_entity",
        "!!": "unknown_entity",
        "Inc": "inc",
    }
    df = spark.createDataFrame([(k,) for k in cases], "x string").select("x", text.normalize_name(F.col("x")).alias("y"))
    got = {r["x"]: r["y"] for r in df.collect()}
    assert got == cases
    again = df.select(F.col("y").alias("x")).select("x", text.normalize_name(F.col("x")).alias("y")).filter("x <> 'unknown_entity' and x <> 'x holdings group inc'").collect()
    assert all(r["x"] == r["y"] for r in again)


def test_qualifier(spark):
    assert one(spark, "d.b.a. foo", text.qualified) == "d.b.a. foo"
    assert one(spark, "formerly: old name", text.qualified) == "old name"


def test_nfkc(spark):
    assert one(spark, "ﬁne  ①", text.nfkc) == "fine 1"
    assert one(spark, " plain  text ", text.nfkc) == "plain text"
    assert one(spark, None, text.nfkc) is None


def test_addresses(spark):
    def parsed(line):
        row = spark.createDataFrame([(line,)], "x string").select(*[c.alias(n) for n, c in address.parse(F.col("x")).items()])
        parts = {p: F.col(p) for p in address.PARTS}
        return row.select("*", address.key(parts).alias("key"), address.completeness(parts).alias("score")).first().asDict()

    got = parsed("123 Main St N, Chicago, IL 60601")
    assert got == {"street_number": "123", "street_name": "main st n", "city": "chicago", "state": "illinois", "zip": "60601", "key": "123|main st|chicago|illinois|60601", "score": 6}
    assert parsed("")["key"] == "" and parsed(None)["score"] == 0
    assert parsed("P.O. Box 12")["street_name"] == "po box 12"
    assert one(spark, "penn", address.state_name) == "pennsylvania"
    assert one(spark, "D.C.", address.state_name) == "district of columbia"
    assert one(spark, "Narnia", address.state_name) == "narnia"
    assert one(spark, None, address.state_name) is None


def test_phonetic(spark):
    assert phonetic.codes("Smith")[0] == phonetic.codes("Smyth")[0]
    assert phonetic.codes("Philip") == phonetic.codes("Filip")
    assert one(spark, "", phonetic.phonetic) == "EMPTY"
    assert one(spark, None, phonetic.phonetic) == "EMPTY"


def test_config():
    c = store.load_config("columns: {entity_col: name, address_cols: [a, b]}\nlinking: {pair_similarity: 0.7}")
    assert c.columns.address_cols == ("a", "b") and c.linking.pair_similarity == 0.7
    assert store.load_config(store.save_config(c)) == c
    for bad in ("columns: {entity_col: a, address_cols: [a]}", "output: {casing: odd}", "nothing: 1"):
        with pytest.raises(ValueError):
            store.load_config(bad)


def test_folded_names(spark):
    from linkspark.functions import text

    rows = [(1, "Acme\u2122 \u201cTools\u201d\u2009Ltd"), (2, "\uff21\uff42\uff43 \u00f7 x"), (3, None), (4, "plain  text"), (5, "\u2460 \u00bd\u2026")]
    df = spark.createDataFrame(rows, "id long, name string")
    got = {r["id"]: r["f"] for r in df.select("id", text.folded(df["name"]).alias("f")).collect()}
    assert got == {1: 'AcmeTM "Tools" Ltd', 2: "Abc / x", 3: None, 4: "plain text", 5: "1 1/2..."}
    staged = {r["id"]: r["n"] for r in text.with_normal_name(df, "name", "n").collect()}
    assert staged[1] == "acmetm tools" and staged[3] == text.UNKNOWN


def test_replacements_win_over_suffixes():
    from linkspark.functions import text

    words, suffixes = text.without_overlap({"co": "company"}, ["inc", "co", "company"])
    assert words == {"co": "company"} and suffixes == ["inc", "company"]


def test_run_parameters():
    from linkspark.operators import contexts

    runs = contexts.run_parameters(6, state=7)
    assert [r["seed"] for r in runs] == [7 + 104729 * i for i in range(6)] and [r["view"] for r in runs] == ["local"] * 3 + ["global"] * 3
    assert all(r["min_dist"] <= r["spread"] for r in runs) and runs == contexts.run_parameters(6, state=7)
    assert max(r["neighbours"] for r in runs[:3]) <= 25 <= min(r["neighbours"] for r in runs[3:])
    assert contexts.sub_range(0, 10, 0.2, 0.5) == (2, 5)
    low, high = contexts.sub_range(0.01, 1, 0.5, 1, log=True)
    assert abs(low - 0.1) < 1e-6 and abs(high - 1) < 1e-6
