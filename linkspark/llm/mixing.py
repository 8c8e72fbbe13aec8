"""Mixing documents to target weights of domains, by DataFrame functions alone.

1. A table of labelled documents trains a naive Bayes classifier.  Its features are, for
   each domain, whether a text holds a word of the domain's lexicon (words that are
   commoner in it, by log odds, learned from the labels too), and the bins of the shares
   of symbols and of capitals.  It gives each document a posterior over the domains.
2. Each document gets a nonnegative rate, the expected number of its copies, such that
   the expected tokens of the domains, sum of rate x tokens x posterior, are the targets'
   shares of all tokens.  Projected gradient steps on the least squares start from rate 1:
       rate <- max(0, rate - posterior . M^-1 (tokens now - tokens wanted))
   with M the second moments of the posteriors, which is the gradient in a metric that
   makes the steps fast.  A step needs one sum over all documents; equal posteriors are
   added up beforehand.
3. Copies: the rate, rounded up or down by the hash of the id so that its mean is right.

Labels are read for at most ``sample`` documents, those with the least hash of their id.

Defined results: null and empty texts have no tokens and the classifier's value for no
features; rows with null id are rounded alike; without labels all posteriors are equal;
repeated rows each get their rate; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.llm import common
from linkspark.operators.storage import materialize

#: Share of the expected tokens that each domain is to have.
TARGETS = {"good": 0.90, "low": 0.06, "toxic": 0.04}
SAMPLE = 20_000
LEXICON = 16
SUPPORT = 8
STEPS = 40
MARKS = "#*$%&|<>!"
MARK_BINS = (0.002, 0.01, 0.03)
CAPITAL_BINS = (0.1, 0.3, 0.6)
WORD = "[^\\x20\\x09-\\x0D]+"


def domain_of() -> Column:
    """Domains of the labels table."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "good")


def _words(text: Column) -> Column:
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), ".,;:!?\"'()[]#*$%&|<>\n\t\r", " " * 24)
    return F.split(plain, " ")


def _bin(value: Column, edges: tuple[float, ...]) -> Column:
    out = F.lit(len(edges))
    for k in range(len(edges) - 1, -1, -1):
        out = F.when(value < edges[k], k).otherwise(out)
    return out


def _features(text: Column, lexicons: dict[str, list[str]]) -> dict[str, Column]:
    whole = F.coalesce(text, F.lit(""))
    size = F.greatest(F.length(whole), F.lit(1))
    marks = F.length(whole) - F.length(F.translate(whole, MARKS, ""))
    capitals = F.length(whole) - F.length(F.translate(whole, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    out = {"marks": _bin(marks / size, MARK_BINS), "capitals": _bin(capitals / size, CAPITAL_BINS)}
    words = _words(text)
    for name, lexicon in lexicons.items():
        if lexicon:
            out[f"has_{name}"] = F.arrays_overlap(words, F.array(*[F.lit(x) for x in lexicon])).cast("int")
    return out


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


class Classifier:
    """Lexicons and log probabilities of binned features."""

    def __init__(self, domains: list[str], lexicons: dict[str, list[str]], prior: dict[str, float], tables: dict[str, dict[str, list[float]]]):
        self.domains, self.lexicons, self.prior, self.tables = domains, lexicons, prior, tables

    def features(self, text: Column) -> dict[str, Column]:
        return _features(text, self.lexicons)

    def posteriors(self, bins: dict[str, Column]) -> Column:
        """Posterior of each domain, an array, from columns of bins."""
        logs = []
        for d in self.domains:
            value = F.lit(self.prior[d])
            for name in sorted(self.tables):
                value = value + F.element_at(F.array(*[F.lit(x) for x in self.tables[name][d]]), F.col(name) + 1)
            logs.append(value)
        most = F.greatest(*logs) if len(logs) > 1 else logs[0]
        raised = F.array(*[F.exp(x - most) for x in logs])
        total = F.aggregate(raised, F.lit(0.0), lambda a, x: a + x)
        return F.transform(raised, lambda x: x / total)


def fit(docs: DataFrame, labels: DataFrame, domains: list[str], domain: Column, sample: int = SAMPLE, id_column: str = "doc_id", text_column: str = "text") -> Classifier:
    """Train on documents with labels.  The driver gets words of the lexicons and counts of bins only."""
    picked = labels.select(F.col(id_column).alias("id"), domain.alias("domain")).filter(F.col("domain").isin(domains) & F.col("id").isNotNull())
    picked = common.sampled(picked, sample)
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).join(F.broadcast(picked), "id")
    rows = materialize(rows.select("id", "domain", "text"))
    found = rows.select("domain", F.explode(F.array_distinct(_words(F.col("text")))).alias("word")).filter("word <> ''")
    counts = found.groupBy("word").agg(*[F.count(F.when(F.col("domain") == d, 1)).alias(f"n_{i}") for i, d in enumerate(domains)])
    sizes = {r["domain"]: r["n"] for r in rows.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    lexicons: dict[str, list[str]] = {}
    for i, d in enumerate(domains[1:], 1):  # the first domain is what the others differ from
        inside, outside = F.col(f"n_{i}"), sum((F.col(f"n_{j}") for j in range(len(domains)) if j != i), F.lit(0))
        odds = F.log((inside + 0.5) / (sizes.get(d, 0) + 1)) - F.log((outside + 0.5) / (total - sizes.get(d, 0) + 1))
        best = counts.filter((inside >= SUPPORT) & (odds > math.log(20))).orderBy(odds.desc(), "word").limit(LEXICON)
        lexicons[d] = [r["word"] for r in best.select("word").collect()]
    features = _features(F.col("text"), lexicons)
    binned = rows.select("domain", *[c.alias(n) for n, c in features.items()]).groupBy("domain", *features).agg(F.count("*").alias("n")).collect()
    ways = {n: len(MARK_BINS) + 1 if n == "marks" else len(CAPITAL_BINS) + 1 if n == "capitals" else 2 for n in features}
    tables: dict[str, dict[str, list[float]]] = {}
    for name, k in ways.items():
        tables[name] = {}
        for d in domains:
            seen = [1.0 + sum(r["n"] for r in binned if r["domain"] == d and r[name] == x) for x in range(k)]
            tables[name][d] = [math.log(x / sum(seen)) for x in seen]
    prior = {d: math.log((sizes.get(d, 0) + 1) / (total + len(domains))) for d in domains}
    return Classifier(domains, lexicons, prior, tables)


def _solve(matrix: list[list[float]], vector: list[float]) -> list[float]:
    """Gaussian elimination of a small system."""
    n = len(vector)
    rows = [[*r, v] for r, v in zip(matrix, vector)]
    for i in range(n):
        best = max(range(i, n), key=lambda k: abs(rows[k][i]))
        rows[i], rows[best] = rows[best], rows[i]
        for k in range(n):
            if k != i:
                f = rows[k][i] / rows[i][i]
                rows[k] = [x - f * y for x, y in zip(rows[k], rows[i])]
    return [rows[i][n] / rows[i][i] for i in range(n)]


def _dot(posterior: Column, weights: list[float]) -> Column:
    return sum((F.element_at(posterior, i + 1) * F.lit(w) for i, w in enumerate(weights)), F.lit(0.0))


def solve(totals: DataFrame, targets: list[float], steps: int = STEPS, tolerance: float = 1e-9) -> list[list[float]]:
    """The steps' weights.  totals: (posterior array, tokens), equal posteriors added up."""
    k = len(targets)
    p = [F.element_at("posterior", i + 1) for i in range(k)]
    moments = totals.agg(F.sum("tokens").alias("all"), *[F.sum(F.col("tokens") * p[i] * p[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    everything = moments["all"] or 0
    if not everything:
        return []
    matrix = [[moments[f"m{min(i, j)}_{max(i, j)}"] / everything + (1e-6 if i == j else 0.0) for j in range(k)] for i in range(k)]
    history: list[list[float]] = []
    rated = totals.withColumn("rate", F.lit(1.0))
    for _ in range(steps):
        now = rated.agg(*[F.sum(F.col("tokens") * p[i] * F.col("rate")).alias(f"t{i}") for i in range(k)]).first()
        off = [now[f"t{i}"] / everything - targets[i] for i in range(k)]
        if max(map(abs, off)) < tolerance:
            break
        step = _solve(matrix, off)
        history.append(step)
        rated = totals.withColumn("rate", rate(F.col("posterior"), history))
    return history


def rate(posterior: Column, history: list[list[float]]) -> Column:
    """What the steps make of rate 1 for a posterior."""
    if not history:
        return F.lit(1.0)
    weights = F.array(*[F.array(*[F.lit(float(x)) for x in step]) for step in history])
    return F.aggregate(weights, F.lit(1.0), lambda r, w: F.greatest(F.lit(0.0), r - F.aggregate(F.zip_with(posterior, w, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)))


def copies(rate_: Column, id_: Column) -> Column:
    """Whole copies whose mean is the rate."""
    part = F.pmod(F.xxhash64(id_, F.lit("copies")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return F.floor(rate_ + part).cast("long")


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, domain: Column | None = None, sample: int = SAMPLE, id_column: str = "doc_id", text_column: str = "text") -> tuple[Classifier, DataFrame, DataFrame]:
    """(classifier, rates, rows).

    rates has a row for each combination of bins that occurs (at most a few hundred, by
    the numbers of bins): bins, tokens, posterior, rate.  rows have id, tokens, posterior,
    rate and copies, measured once and written to the shared folder.
    """
    domains = list(targets)
    model = fit(docs, labels, domains, domain_of() if domain is None else domain, sample, id_column, text_column)
    text = F.col(text_column)
    bins = model.features(text)
    measured = materialize(docs.select(F.col(id_column).alias("id"), tokens_of(text).alias("words"), *[c.alias(n) for n, c in bins.items()]))
    totals = materialize(measured.groupBy(*bins).agg(F.sum("words").alias("tokens")).withColumn("posterior", model.posteriors(bins)))
    history = solve(totals, [targets[d] / sum(targets.values()) for d in domains])
    rates = materialize(totals.withColumn("rate", rate(F.col("posterior"), history)))
    found = measured.join(F.broadcast(rates.drop("tokens")), list(bins))
    rows = found.select("id", F.col("words").alias("tokens"), "posterior", "rate", copies(F.col("rate"), F.col("id")).alias("copies"))
    return model, rates, rows


def apply(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, domain: Column | None = None, sample: int = SAMPLE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of docs, each as often as its copies say."""
    model, rates, _ = mix(docs, labels, targets, domain, sample, id_column, text_column)
    bins = model.features(F.col(text_column))
    names = docs.columns
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(id_column).alias("_id"), *[c.alias(n) for n, c in bins.items()])
    rated = own.join(F.broadcast(rates.select(*bins, "rate")), list(bins)).select("_row", copies(F.col("rate"), F.col("_id")).alias("_n"))
    often = rated.filter("_n > 0").withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    return often.select(*[F.col(f"_row.`{c}`").alias(c) for c in names])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    _, _, rows = mix(docs, common.table(spark, sf_dir, "labels"))
    shares = [F.element_at("posterior", i + 1).alias(f"p_{d}") for i, d in enumerate(TARGETS)]
    return rows.select(F.col("id").alias("doc_id"), "tokens", *shares, "rate", "copies")
