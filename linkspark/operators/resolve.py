"""Resolution of clustered records: profiles, votes, reassignment, merging, refinement, scoring, reports.

Frames of records hold record_id, cluster (-1: noise), probability, normalized_text,
the five address parts, address_key and score (completeness).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkspark.operators import graph
from linkspark.operators.similarity import central_names, edit_similarity

NOISE = -1


def profiles(records: DataFrame) -> DataFrame:
    """(cluster, size, avg_probability, name, key, state): of each cluster its central name and best address."""
    own = records.filter(F.col("cluster") != NOISE)
    stats = own.groupBy("cluster").agg(F.count("*").alias("size"), F.avg("probability").alias("avg_probability"))
    names = central_names(own, "cluster", "normalized_text").select("cluster", F.col("canonical_name").alias("name"))
    keys = own.groupBy("cluster", "address_key", "state").agg(F.max("score").alias("score"), F.count("*").alias("n"))
    best = keys.groupBy("cluster").agg(F.min(F.struct((-F.col("score")).alias("s"), (-F.col("n")).alias("n"), "address_key", "state")).alias("b"))
    return stats.join(names, "cluster").join(best.select("cluster", F.col("b.address_key").alias("key"), F.col("b.state").alias("state")), "cluster")


def logit(p: Column) -> Column:
    x = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(x / (1 - x))


def mahalanobis(scores: DataFrame, min_size: int = 5, cutoff: float = 3.05) -> DataFrame:
    """(g, id, distance, outlier) of rows (g, id, a, b), by robust means and covariances of both logits in each group."""
    group = Window.partitionBy("g")
    x = scores.withColumns({"x": logit(F.col("a")), "y": logit(F.col("b")), "n": F.count("*").over(group)}).filter(F.col("n") >= min_size)
    middle = x.groupBy("g").agg(F.median("x").alias("mx"), F.median("y").alias("my"))
    x = x.join(middle, "g").withColumn("c", F.greatest(F.lit(0.01), F.least(F.lit(0.2), 1 / F.sqrt("n"))))
    off = F.round((F.col("x") - F.col("mx")) * (F.col("x") - F.col("mx")) + (F.col("y") - F.col("my")) * (F.col("y") - F.col("my")), 9)
    x = x.withColumn("near", F.row_number().over(group.orderBy(off, "id"))).withColumn("kept", F.greatest(F.lit(3), F.floor(F.col("n") * (1 - F.least(F.lit(0.10), F.col("c") / 2)))))
    stats = x.filter("near <= kept").groupBy("g").agg(F.avg("x").alias("ux"), F.avg("y").alias("uy"), (F.var_samp("x") + 1e-6).alias("xx"), (F.var_samp("y") + 1e-6).alias("yy"), F.covar_samp("x", "y").alias("xy"))
    dx, dy, det = F.col("x") - F.col("ux"), F.col("y") - F.col("uy"), F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    d = x.join(stats, "g").withColumn("distance", F.sqrt((F.col("yy") * dx * dx - 2 * F.col("xy") * dx * dy + F.col("xx") * dy * dy) / det))
    d = d.withColumn("r", F.row_number().over(group.orderBy(F.round("distance", 9), "id"))).withColumn("place", (1 - F.col("c")) * (F.col("n") - 1))
    at = lambda k: F.max(F.when(F.col("r") == k + 1, F.col("distance"))).over(group)
    low = F.floor("place")
    line = at(low) + (at(F.least(low + 1, F.col("n") - 1)) - at(low)) * (F.col("place") - low)
    return d.withColumn("line", line).select("g", "id", "distance", (F.col("distance") > F.greatest("line", F.lit(cutoff))).alias("outlier"))


def benjamini_hochberg(p_values: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(id, p, rejected) of rows (id, p).  Ranks are made of the counts of different values, so no row order is global."""
    counts = p_values.groupBy("p").agg(F.count("*").alias("k"))
    steps = counts.withColumn("rank", F.sum("k").over(Window.orderBy("p"))).withColumn("n", F.sum("k").over(Window.partitionBy()))
    line = steps.filter(F.col("p") <= F.col("rank") * F.lit(alpha) / F.col("n")).agg(F.max("p").alias("line"))
    return p_values.crossJoin(F.broadcast(line)).select("id", "p", F.coalesce(F.col("p") <= F.col("line"), F.lit(False)).alias("rejected"))


def margin_vote(sims: DataFrame, margin: float = 0.1) -> DataFrame:
    """(id, own, other, low_margin) of rows (id, cluster, profile, sim)."""
    own = F.max(F.when(F.col("cluster") == F.col("profile"), F.col("sim")))
    other = F.max(F.when(F.col("cluster") != F.col("profile"), F.col("sim")))
    return sims.groupBy("id").agg(own.alias("own"), other.alias("other")).withColumn("low_margin", F.coalesce(F.col("own") - F.col("other") < margin, F.lit(False)))


def states_fit(a: Column, b: Column, neighbours: list[tuple[str, str]] = ()) -> Column:
    """Equal states, one unknown, or a pair that may be mixed (in either order)."""
    fit = (F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == "") | (a == b)
    if neighbours:
        fit = fit | F.concat_ws("|", F.least(a, b), F.greatest(a, b)).isin(["|".join(sorted(x)) for x in neighbours])
    return fit


def allowed_profiles(records: DataFrame, found: DataFrame, neighbours: list[tuple[str, str]] = ()) -> DataFrame:
    """(record_id, cluster) of records with the profiles that their state may go with, by equi-joins on states.

    Known states meet equal ones, allowed neighbours (both orders) and profiles without a
    state; records without a state meet all profiles.
    """
    own = records.select("record_id", F.coalesce("state", F.lit("")).alias("state"))
    ways = [(a, b) for x, y in neighbours for a, b in ((x, y), (y, x))]
    near = F.array(*[F.when(F.col("state") == a, F.lit(b)) for a, b in ways]) if ways else F.array().cast("array<string>")
    asked = own.withColumn("wanted", F.explode(F.array_union(F.array(F.when(F.col("state") == "", "*").otherwise(F.col("state")), F.when(F.col("state") != "", "")), F.array_compact(near)))).filter("wanted is not null")
    p = found.select("cluster", F.coalesce("state", F.lit("")).alias("s"))
    given = p.select("cluster", F.explode(F.array("s", F.lit("*"))).alias("wanted"))
    return asked.join(given, "wanted").select("record_id", "cluster").distinct()


def match_scores(records: DataFrame, found: DataFrame, name_weight: float = 0.6, address_weight: float = 0.4) -> DataFrame:
    """(record_id, cluster, name_score, address_score, match_score) of clustered records with the profile of their cluster."""
    p = found.select("cluster", "name", "key", F.col("state").alias("profile_state"))
    own = records.filter(F.col("cluster") != NOISE).join(p, "cluster")
    one, two = edit_similarity(F.col("normalized_text"), F.col("name")), edit_similarity(F.col("address_key"), F.col("key"))
    scored = own.select("record_id", "cluster", "state", "profile_state", one.alias("name_score"), two.alias("address_score"))
    return scored.withColumn("match_score", F.round(name_weight * F.col("name_score") + address_weight * F.col("address_score"), 9))


def candidates(records: DataFrame, found: DataFrame, votes: DataFrame | None = None, least_votes: int = 2, low: float = 0.3, neighbours: list[tuple[str, str]] = ()) -> DataFrame:
    """(record_id, reason) of records to reassign: all noise, enough votes (record_id, votes), a match score below `low`, or a state that doesn't go with the cluster's."""
    scored = match_scores(records, found)
    scored = scored.join(votes, "record_id", "left") if votes is not None else scored.withColumn("votes", F.lit(0))
    reason = F.when(F.coalesce("votes", F.lit(0)) >= least_votes, "votes").when(F.col("match_score") < low, "low_score").when(~states_fit(F.col("state"), F.col("profile_state"), neighbours), "state")
    noise = records.filter(F.col("cluster") == NOISE).select("record_id", F.lit("noise").alias("reason"))
    return noise.union(scored.select("record_id", reason.alias("reason")).filter("reason is not null"))


def votes(scores: DataFrame, margins: DataFrame, min_size: int = 5) -> DataFrame:
    """(record_id, votes): outliers of their cluster by both scores, and low margins over other profiles (margins: margin_vote's rows)."""
    out = mahalanobis(scores.select(F.col("cluster").alias("g"), F.col("record_id").alias("id"), F.col("name_score").alias("a"), F.col("address_score").alias("b")), min_size)
    one = out.select(F.col("id").alias("record_id"), F.col("outlier").cast("int").alias("v"))
    two = margins.select(F.col("id").alias("record_id"), F.col("low_margin").cast("int").alias("v"))
    return one.union(two).groupBy("record_id").agg(F.sum("v").cast("int").alias("votes"))


def most_frequent(records: DataFrame, group: str, column: str) -> DataFrame:
    """(group, column, n): the commonest value of each group, ties to the least; nulls don't count."""
    counts = records.filter(F.col(column).isNotNull()).groupBy(group, column).agg(F.count("*").alias("n"))
    best = counts.groupBy(group).agg(F.min(F.struct((-F.col("n")).alias("o"), F.col(column).alias("x"))).alias("b"))
    return best.select(group, F.col("b.x").alias(column), (-F.col("b.o")).alias("n"))


def numbers_fit(a: Column, b: Column, most: int = 30) -> Column:
    """Street numbers no more than `most` apart, or one that is no number."""
    x, y = a.try_cast("long"), b.try_cast("long")
    return x.isNull() | y.isNull() | (F.abs(x - y) <= most)


def reassign(records: DataFrame, found: DataFrame, chosen: DataFrame | None = None, neighbours: list[tuple[str, str]] = (), name_fuzz: float = 0.89, address_fuzz: float = 0.89, name_weight: float = 0.40, address_weight: float = 0.40, size_weight: float = 0.10, prob_weight: float = 0.10) -> DataFrame:
    """(record_id, cluster, match_score) of the best profile for the chosen records (record_id; unset: noise and records of low probability).

    Profiles are met by state (see allowed_profiles).
    """
    own = records.filter((F.col("cluster") == NOISE) | (F.col("probability") < 0.55)) if chosen is None else records.join(chosen.select("record_id").distinct(), "record_id", "left_semi")
    own = own.select("record_id", "normalized_text", "address_key", "state", F.col("cluster").alias("now"))
    p = found.select(F.col("cluster").alias("to"), "name", "key", "size", "avg_probability")
    pairs = own.join(allowed_profiles(own, found, neighbours).withColumnRenamed("cluster", "to"), "record_id").join(p, "to")
    one, two = edit_similarity(F.col("normalized_text"), F.col("name")), edit_similarity(F.col("address_key"), F.col("key"))
    less = lambda s, fuzz: F.greatest(F.lit(0.0), s - F.when(s < fuzz, 0.05).otherwise(0.0))
    score = name_weight * less(one, name_fuzz) + address_weight * less(two, address_fuzz) + size_weight * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.log1p("size") / F.log1p(F.lit(10.0)))) + prob_weight * F.col("avg_probability")
    scored = pairs.withColumn("s", F.round(F.greatest(F.lit(0.0), score), 9)).filter("s >= 0.2")
    current = F.coalesce(F.max(F.when(F.col("now") == F.col("to"), F.col("s"))).over(Window.partitionBy("record_id")), F.lit(0.0))
    best = F.row_number().over(Window.partitionBy("record_id").orderBy(F.desc("s"), "to"))
    ranked = scored.withColumn("current", current).withColumn("r", best).filter("r = 1")
    good = ((F.col("current") == 0) & (F.col("s") > 0.3)) | ((F.col("current") != 0) & (F.col("s") - F.col("current") >= 0.1))
    return ranked.filter(good).select("record_id", F.col("to").alias("cluster"), F.col("s").alias("match_score"))


def apply_reassignment(records: DataFrame, moves: DataFrame, found: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """(record_id, cluster, probability) after the moves: score x the cluster's mean probability, x 0.9 where a candidate (record_id; unset: of low probability) stayed."""
    mean = found.select(F.col("cluster").alias("to"), "avg_probability")
    m = moves.select("record_id", F.col("cluster").alias("to"), "match_score").join(mean, "to")
    joined = records.join(m, "record_id", "left")
    if chosen is None:
        considered = (F.col("cluster") != NOISE) & (F.col("probability") < 0.55)
    else:
        joined = joined.join(chosen.select("record_id", F.lit(True).alias("asked")).distinct(), "record_id", "left")
        considered = (F.col("cluster") != NOISE) & F.coalesce("asked", F.lit(False))
    probability = F.when(F.col("to").isNotNull(), F.col("match_score") * F.col("avg_probability")).when(considered, F.col("probability") * 0.9).otherwise(F.col("probability"))
    return joined.select("record_id", F.coalesce("to", "cluster").alias("cluster"), probability.alias("probability"))


def merge_clusters(found: DataFrame, name_at_least: float = 0.8) -> DataFrame:
    """(cluster, winner): clusters with one address, fitting states and like names become the largest of them."""
    a = found.filter("key <> ''").select(F.col("cluster").alias("src"), "key", F.col("name").alias("na"), F.col("state").alias("sa"))
    b = found.select(F.col("cluster").alias("dst"), "key", F.col("name").alias("nb"), F.col("state").alias("sb"))
    near = a.join(b, "key").filter(F.col("src") < F.col("dst")).filter(states_fit(F.col("sa"), F.col("sb")) & (F.round(edit_similarity(F.col("na"), F.col("nb")), 9) >= name_at_least))
    return graph.merge_map(graph.components(near.select("src", "dst")), found.select("cluster", "size"))


def consolidate_identical(records: DataFrame) -> DataFrame:
    """(cluster, winner): clusters that hold the same name and address become the largest of those; chains are followed."""
    own = records.filter(F.col("cluster") != NOISE)
    sizes = own.groupBy("cluster").agg(F.count("*").alias("size"))
    keyed = own.filter("address_key <> ''").select("normalized_text", "address_key", "cluster").distinct()
    first = keyed.groupBy("normalized_text", "address_key").agg(F.min("cluster").alias("src"), F.count("*").alias("k")).filter("k > 1")
    edges = keyed.join(first, ["normalized_text", "address_key"]).filter("src <> cluster").select("src", F.col("cluster").alias("dst"))
    return graph.merge_map(graph.components(edges), sizes)


def relabel(records: DataFrame, mapping: DataFrame) -> DataFrame:
    """Records with their cluster replaced by the winner's."""
    return records.join(mapping, "cluster", "left").withColumn("cluster", F.coalesce("winner", "cluster")).drop("winner")


def enrich(records: DataFrame) -> DataFrame:
    """(record_id, street_number, street_name, address_key, enriched): clustered records without a street take the cluster's best, if city, state and zip agree."""
    from linkspark.functions import address

    own = records.filter((F.col("cluster") != NOISE) & (F.col("street_name") != ""))
    best = own.groupBy("cluster").agg(F.min(F.struct((-F.col("score")).alias("s"), "address_key", "street_number", "street_name", "city", "state", "zip")).alias("b"))
    joined = records.join(best, "cluster", "left")
    ok = (F.col("cluster") != NOISE) & (F.col("street_name") == "") & F.col("b").isNotNull() & (F.col("city") == F.col("b.city")) & (F.col("state") == F.col("b.state")) & (F.col("zip") == F.col("b.zip"))
    ok = F.coalesce(ok, F.lit(False))
    parts = {c: F.when(ok, F.col(f"b.{c}")).otherwise(F.col(c)) for c in ("street_number", "street_name")}
    full = parts | {c: F.col(c) for c in ("city", "state", "zip")}
    return joined.select("record_id", *[c.alias(n) for n, c in parts.items()], F.when(ok, address.key(full)).otherwise(F.col("address_key")).alias("address_key"), ok.alias("enriched"))


def _new_ids(parts: DataFrame, top: DataFrame, keys: list[str]) -> DataFrame:
    """A new cluster id for each different key: numbers of the distinct keys from the greatest id on."""
    order = F.dense_rank().over(Window.orderBy(*keys))
    return parts.select(*keys).distinct().withColumn("k", order).crossJoin(F.broadcast(top)).select(*keys, (F.col("top") + F.col("k")).cast("long").alias("new"))


def split_states(records: DataFrame) -> DataFrame:
    """(record_id, cluster): clusters in several known states fall apart by state."""
    own = records.filter((F.col("cluster") != NOISE) & (F.col("state") != ""))
    many = own.groupBy("cluster").agg(F.count_distinct("state").alias("k")).filter("k > 1").select("cluster")
    parts = own.join(many, "cluster", "left_semi").select("cluster", "state").distinct()
    new = _new_ids(parts, records.agg(F.max("cluster").alias("top")), ["cluster", "state"])
    return records.join(new, ["cluster", "state"], "left").select("record_id", F.coalesce("new", F.col("cluster").cast("long")).alias("cluster"))


def split_ranges(records: DataFrame, most: int = 30) -> DataFrame:
    """(record_id, cluster): records of a cluster on one street and zip whose numbers lie further apart fall apart by address."""
    own = records.filter((F.col("cluster") != NOISE) & (F.col("street_name") != "")).withColumn("num", F.col("street_number").try_cast("long"))
    place = ["cluster", "street_name", "zip"]
    wide = own.groupBy(*place).agg(F.count_distinct("num").alias("k"), (F.max("num") - F.min("num")).alias("span")).filter((F.col("k") > 1) & (F.col("span") > most))
    parts = own.join(wide, place, "left_semi").select("record_id", "cluster", "address_key")
    new = _new_ids(parts, records.agg(F.max("cluster").alias("top")), ["cluster", "address_key"])
    moved = parts.join(new, ["cluster", "address_key"]).select("record_id", "new")
    return records.join(moved, "record_id", "left").select("record_id", F.coalesce("new", F.col("cluster").cast("long")).alias("cluster"))


def number_chains(canonical: DataFrame) -> DataFrame:
    """(final_cluster, canonical_name): names with several addresses get ` - n` by the rank of the address."""
    rank = F.dense_rank().over(Window.partitionBy("name").orderBy("key"))
    many = F.max(rank_ := F.col("rank_")).over(Window.partitionBy("name")) > 1
    return canonical.withColumn("rank_", rank).withColumn("many", many).select("final_cluster", F.when(F.col("many"), F.concat("name", F.lit(" - "), rank_.cast("string"))).otherwise(F.col("name")).alias("canonical_name"))


def cased(name: Column, how: str) -> Column:
    return {"proper": F.initcap, "upper": F.upper, "lower": F.lower, "raw": lambda c: c}[how](name)


def apply_canonical(records: DataFrame, canonical: DataFrame, how: str = "proper") -> DataFrame:
    """(record_id, canonical_name, canonical_address) with the record's own values where there is no cluster."""
    m = canonical.select(F.col("final_cluster").alias("cluster"), F.col("canonical_name").alias("cn"), F.col("key").alias("ck"))
    joined = records.join(m, "cluster", "left")
    return joined.select("record_id", cased(F.coalesce("cn", "normalized_text"), how).alias("canonical_name"), F.coalesce("ck", "address_key").alias("canonical_address"))


def confidence(scored: DataFrame) -> DataFrame:
    """Adds cluster_size, cohesion_score, change, confidence_score, confidence_category; rows hold cluster, probability, name_similarity, address_confidence, change and enriched."""
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    stats = scored.groupBy("cluster").agg(F.count("*").alias("cluster_size"), clip(1 - F.coalesce(F.stddev_samp("name_similarity"), F.lit(0.0))).alias("cohesion_score"))
    own = scored.filter(F.col("cluster") != NOISE).join(stats, "cluster")
    alone = scored.filter(F.col("cluster") == NOISE).crossJoin(F.broadcast(stats.filter(F.col("cluster") == NOISE).drop("cluster")))  # one row, as noise may be most of the table
    out = own.unionByName(alone)
    base = 0.25 * F.col("probability") + 0.20 * F.col("name_similarity") + 0.25 * F.col("address_confidence") + 0.15 * F.col("cohesion_score") + 0.15 * F.least(F.log1p("cluster_size") / F.log1p(F.lit(10.0)), F.lit(1.0))
    base = base * F.when(F.col("change") > 0.5, 0.9).otherwise(1.0) * F.when(F.col("enriched"), 0.95).otherwise(1.0) * F.when((F.col("cluster_size") <= 2) & (F.col("change") > 0.7), 0.85).otherwise(1.0)
    score = clip(F.when(F.col("cluster") == NOISE, 0.5 * F.col("name_similarity")).otherwise(base))
    out = out.withColumn("confidence_score", F.round(score, 9))
    s = F.col("confidence_score")
    return out.withColumn("confidence_category", F.when(s <= 0.5, "Low").when(s <= 0.7, "Medium").when(s <= 0.85, "High").otherwise("Very High"))


def review_flags(scored: DataFrame, line: float = 0.75) -> DataFrame:
    """Adds needs_review and review_reason."""
    reasons = F.concat_ws(
        ",",
        F.when(F.col("confidence_score") < line, "low_confidence"),
        F.when(F.col("change") > 0.7, "drastic_name_change"),
        F.when((F.col("cluster_size") == 1) & (F.col("change") > 0.01), "singleton_name_change"),
        F.when(F.col("enriched") & (F.col("confidence_score") < 0.8), "enriched_low_confidence"),
    )
    return scored.withColumn("review_reason", reasons).withColumn("needs_review", F.col("review_reason") != "")


def duplicates_across(records: DataFrame) -> DataFrame:
    """Names with addresses that lie in more than one cluster."""
    own = records.filter((F.col("cluster") != NOISE) & (F.col("address_key") != ""))
    return own.groupBy("normalized_text", "address_key").agg(F.count_distinct("cluster").alias("n_clusters")).filter("n_clusters > 1")


def inconsistent_names(resolved: DataFrame) -> DataFrame:
    """Canonical names with more than one canonical address (a missing one counts)."""
    return resolved.groupBy("canonical_name").agg(F.count_distinct(F.coalesce("canonical_address", F.lit("\u0000"))).alias("n_addresses")).filter("n_addresses > 1")


def describe(df: DataFrame, column: str) -> DataFrame:
    """One row: n, mean, std, min, exact quartiles, max."""
    q = lambda p: F.percentile(column, F.lit(p))
    return df.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("min"), q(0.25).alias("q25"), q(0.5).alias("q50"), q(0.75).alias("q75"), F.max(column).alias("max"))


def report(resolved: DataFrame) -> DataFrame:
    """One row: records, names before and after, clusters, noise, chains, enriched and flagged records."""
    return resolved.agg(
        F.count("*").alias("records"),
        F.count_distinct("company_name").alias("names_before"),
        F.count_distinct("canonical_name").alias("names_after"),
        F.count_distinct(F.when(F.col("cluster") != NOISE, F.col("cluster"))).alias("clusters"),
        F.count(F.when(F.col("cluster") == NOISE, 1)).alias("noise"),
        F.count_distinct(F.when(F.col("canonical_name").rlike(r" - \d+$"), F.col("canonical_name"))).alias("chains"),
        F.count(F.when(F.col("enriched"), 1)).alias("enriched"),
        F.count(F.when(F.col("needs_review"), 1)).alias("flagged"),
    )
