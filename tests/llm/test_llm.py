"""The operators against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import gc
import hashlib
import math
import os
import random
import time
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from linkspark.llm import backoff, common, exchange, html_text, itq, langid, licences, mixing, packing, quality, repeats, shingle_join, suffix_array
from linkspark.operators import storage

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words(x):
    return (x or "").encode().translate(LOWER).split()


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice(["ka", "lo", "mi", "né", "su", "tor", "Bel"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)) + "."
    out = [None, "", "  \n\t", "!!! ???", "one", "one two", "one two three", "ONE two three", "it's <|endoftext|> here's ñ x²", "日本語 テキスト。 とても", "é café Ünïcode", " nbsp word"]
    passage = sentence(30)
    for k in range(30):
        out.append("\n".join(sentence(rng.randint(3, 25)) for _ in range(rng.randint(1, 8))))
    base = "\n".join(sentence(20) for _ in range(5))
    for k in range(12):  # near copies
        some = base.split(" ")
        for _ in range(k // 3):
            some[rng.randrange(len(some))] = "changed%d" % k
        out.append(" ".join(some))
    out += [base] * 5 + [sentence(10) + passage + sentence(10) for _ in range(6)] + [" ".join(["same"] * 400)] + ["long " + " ".join(rng.choice(vocabulary) for _ in range(12000))]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    common.tune(spark)
    return spark.createDataFrame([(i, x, "en", "s", len(x or "")) for i, x in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).cache()


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_packing(docs, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = packing.pack(docs, path, window=512, block_tokens=2000).collect()
    pieces = collections.defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
    for i, x in enumerate(texts):
        ids = np.array(tokenizer.encode(x or "", add_special_tokens=False).ids + [2], "<u4")
        got = sorted(pieces[i], key=lambda r: r["start"])
        assert b"".join(bytes(r["ids"]) for r in got) == ids.tobytes()
        assert [r["start"] for r in got] == np.cumsum([0, *[r["length"] for r in got]])[:-1].tolist() and got[0]["doc_tokens"] == len(ids)
    windows = collections.defaultdict(list)
    for r in rows:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    padding = 0
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
        padding += 0 if at & (at - 1) == 0 else 512 - at
    assert padding < 0.05 * sum(r["length"] for r in rows)


def test_packing_is_optimal():
    rng = random.Random(1)
    padding = lambda n: 0 if n in (4, 8, 16) else 16 - n
    for _ in range(200):
        places = np.concatenate([[0], np.cumsum([rng.randint(1, 9) for _ in range(12)])])
        costs = np.array([0.0] + [rng.choice([0.0, 2.0, 5.0]) for _ in range(12)])
        best = [0.0] + [math.inf] * 12
        for j in range(1, 13):
            best[j] = min(best[i] + padding(places[j] - places[i]) + costs[j] + 1 for i in range(j) if places[j] - places[i] <= 16)
        cuts = [0, *packing.choose_cuts(places, costs, 16, 1.0, 4)]
        cost = sum(padding(places[b] - places[a]) + costs[b] + 1 for a, b in zip(cuts, cuts[1:]))
        assert cost == pytest.approx(best[12])


def test_quality(docs, texts):
    got = by_id(quality.assess(docs, quality.default_vocabulary()))
    for i, x in enumerate(texts):
        w = (x or "").encode().split()
        seen = collections.Counter(zip(w, w[1:], w[2:]))
        flag = [0] * len(w)
        for k, t in enumerate(zip(w, w[1:], w[2:])):
            if seen[t] > 1:
                flag[k] = flag[k + 1] = flag[k + 2] = 1
        lines = [y for y in (x or "").split("\n") if y.encode().split()]
        r = got[i]
        assert (r["n_words"], r["n_repeat_words"], r["n_dup_lines"]) == (len(w), sum(flag), len(lines) - len(set(lines)))
        assert r["base_failed"] == (len(w) < 50 or 100 * sum(flag) > 50 * len(w)) and not (r["kept"] and r["base_failed"])
    kept = quality.filter_kept(docs.withColumnRenamed("source", "script"))
    assert kept.columns == ["doc_id", "text", "lang", "script", "n_chars"] and 0 < kept.count() < len(texts)


PROSE = [
    "The old man walked down to the harbour in the morning and sat on the wall. He watched the boats go out, one after the other, until the water was still. Then he went back up the hill to the house, where the dog was waiting by the door, and he made some tea and read the paper in the kitchen.",
    "If the file is open, the object reads the next line from the file and returns the line as a string. If the end of the file is reached, the object returns an empty string. If the file is not open, an error is raised and the state of the object is not changed by the call. The caller can open the file again.",
]


def test_short_prose_is_kept(spark):
    rng = random.Random(8)
    few = " ".join(rng.choice("one two three four five six seven eight".split()) for _ in range(60))
    rows = list(enumerate([*PROSE, few]))
    got = by_id(quality.assess(spark.createDataFrame(rows, "doc_id long, text string"), quality.default_vocabulary()))
    for i in range(len(PROSE)):
        assert got[i]["kept"] and 50 <= got[i]["n_words"] <= 80 and got[i]["token_entropy"] < 5.4
    assert not got[len(PROSE)]["kept"] and not got[len(PROSE)]["base_failed"]


def test_licences(spark, docs):
    rows = [(1, "Some words here.\nReleased under the MIT License."), (2, "Licensed under the Apache License, Version 2.0."), (3, "A driving license is issued by the county office."), (4, None), (5, ""), (6, "This work is licensed under the GNU General Public License, version 3.")]
    found = licences.scan(spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs.select((docs.doc_id + 100).alias("doc_id"), "text")))
    got = {r["doc_id"]: [(f["paragraph"], f["family"]) for f in r["findings"] if f["confirmed"]] for r in found.collect()}
    assert got.pop(1) == [(1, "mit")] and got.pop(2) == [(0, "apache")] and got.pop(6) == [(0, "gpl")]
    assert not any(got.values())


NEGATIVES = [
    "The report was written under the eyes of the board by a clerk who had no idea of the matter and was paid for it all the same by the town.",
    "You may obtain a copy of the report", "Released under the new management.", "Licensed under the county rules, version two.", "This work is dedicated to my mother.",
    "Permission is hereby granted to enter the hall.", "This program is shown on Sundays.", "The source code is in the public library.", "Use of this door is governed by the house rules.",
    "Redistribution of wealth is a subject of debate.", "This is free and open land.",
]
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights"""
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"


def test_licences_among_many(spark):
    rows = [(k, x) for k, x in enumerate(NEGATIVES)] + [(100 + k, MIT) for k in range(300)] + [(400 + k, BSD) for k in range(300)]
    rng = random.Random(1)
    rows += [(1000 + k, " ".join(rng.choice("the of a house river was by under and copy work free terms old men walked to".split()) for _ in range(20))) for k in range(1200)]
    found = licences.scan(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: {f["family"] for f in r["findings"] if f["confirmed"]} for r in found.collect()}
    for i, _ in rows:
        assert got[i] == ({"mit"} if 100 <= i < 400 else {"bsd"} if 400 <= i < 1000 else set()), (i, got[i])
    odd = spark.createDataFrame([(None, None, 1), ("a", "", 2), ("a", NEGATIVES[0] * 400, 3)], "doc_id string, text string, findings int")
    assert [r["doc_id"] for r in licences.scan(odd).orderBy("doc_id").collect()] == [None, "a", "a"] and licences.scan(odd.limit(0)).count() == 0


def test_licence_similarity_against_plain_distance():
    rng = random.Random(2)

    def distance(a, b, weights):
        row = [0.0]
        for w in weights:
            row.append(row[-1] + w)
        for x in a:
            last, row[0] = row[0], row[0] + 1
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + weights[j - 1], last + (weights[j - 1] if x != y else 0))
        return row[-1]

    for _ in range(60):
        words_, template = ([rng.choice("abcde") for _ in range(rng.randint(0, 12))] for _ in range(2))
        weights = [rng.choice([1.0, 3.0]) for _ in template]
        best = min((distance(words_[i:j], template, weights) for i in range(len(words_) + 1) for j in range(i, len(words_) + 1)), default=0)
        assert licences.similarity(words_, template, weights) == pytest.approx(max(0, 1 - best / sum(weights)) if template else 0)


def test_itq(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 32))
    v = [c + rng.normal(size=32) * s for c in centres for s in (0, 0, 0.02, 0.02, 0.1, 0.2, 0.4)]
    rows = [(i, x.tolist(), i % 2) for i, x in enumerate(v)]
    n = len(rows)
    rows += [(n, None, 0), (n + 1, [0.0] * 32, 0), (n + 2, [float("nan")] + [1.0] * 31, 0), (n + 3, rows[0][1], None), (n + 4, [None] + [1.0] * 31, 1), (n + 5, rows[0][1], 0), (n + 6, [1.0, 2.0], 0), (n + 7, [2.0, 4.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in itq.link(df, shard=8).collect()}
    good = [(i, np.array(x), y) for i, x, y in rows if x and y is not None and None not in x and np.isfinite(x).all() and any(x)]
    links = collections.defaultdict(set)
    for i, x, y in good:
        for j, z, w in good:
            if i != j and y == w and len(x) == len(z) and x @ z / np.sqrt((x @ x) * (z @ z)) >= 0.93:
                links[i].add(j)
    root = {i: i for i, _, _ in rows}
    for _ in rows:
        for i in links:
            root[i] = min([root[i], *[root[j] for j in links[i]]])
    found = sum(got[i][0] for i, _, _ in rows)
    assert all(got[i][0] <= len(links[i]) for i in root) and found >= 0.97 * sum(map(len, links.values()))
    assert got[n] == (0, n) and got[n + 3] == (0, n + 3) and got[n + 6] == (1, n + 6)
    assert sum(got[i][1] != root[i] for i in root) <= 1
    assert itq.link(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(7, [1.0] * 32, "a"), (7, [-1.0] * 32, "a"), (7, [-1.0] * 32, "a"), (8, [1.0] * 32, "a"), (9, [1.0] * 32, None)], "vec_id long, embedding array<double>, label string").selectExpr("*", "1 AS id", "'x' AS v")
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in itq.link(twice).collect()) == [(7, 1, 7), (7, 1, 7), (7, 1, 7), (8, 1, 7), (9, 0, 9)]


@pytest.mark.parametrize("offset", [0.0, 1.5])
@pytest.mark.parametrize("vectors", [20_000, 1_000_000])
def test_itq_recall_with_a_common_direction(offset, vectors):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 64)) / 8 + offset * np.eye(64)[0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    aside = rng.normal(size=x.shape)
    aside -= (aside * x).sum(1, keepdims=True) * x
    y = 0.93 * x + math.sqrt(1 - 0.93**2) * aside / np.linalg.norm(aside, axis=1, keepdims=True)
    bits, tables = itq.plan(vectors, 64, itq.THRESHOLD, itq.MISS)
    turns = itq.rotations(x, math.ceil(tables / (64 // bits)))
    met = (itq.substrings(x, turns, bits, tables) == itq.substrings(y, turns, bits, tables)).any(1)
    apart = np.bitwise_count(itq.codes_of(x, turns) ^ itq.codes_of(y, turns)).sum(1)
    assert (met & (apart <= itq.radius(turns.shape[0] * 64, itq.THRESHOLD))).mean() >= 0.99


@pytest.mark.parametrize("options", [{}, {"chunk_bytes": 1500, "fan": 4}])
def test_backoff(docs, texts, monkeypatch, options):
    monkeypatch.setattr(backoff, "SEGMENT", 256 if not options else 7)
    got = by_id(backoff.score(docs, common.crc_mod("doc_id", 7) == 2, **options))
    tokens = [["<s>", *words(x), "</s>"] for x in texts]
    train = [t for i, t in enumerate(tokens) if zlib.crc32(str(i).encode()) % 7 != 2]
    c1, c2, c3 = (collections.Counter(g for t in train for g in f(t)) for f in (lambda t: t[1:], lambda t: zip(t, t[1:]), lambda t: zip(t, t[1:], t[2:])))
    total, size = sum(c1.values()), len(c1)
    m2, m3 = backoff.MASSES
    for i, t in enumerate(tokens):
        base = score = 0.0
        for k in range(1, len(t)):
            p = (c1[t[k]] + 1) / (total + size + 1)
            base += math.log10(p)
            p = (c2[t[k - 1], t[k]] + m2 * p) / ((c1["</s>"] if k == 1 else c1[t[k - 1]]) + m2)
            if k > 1:
                p = (c3[t[k - 2], t[k - 1], t[k]] + m3 * p) / (c2[t[k - 2], t[k - 1]] + m3)
            score += math.log10(p)
        r = got[i]
        assert (r["n_tokens"], r["train_tokens"], r["n_known"]) == (len(t) - 1, total, sum(c1[x] > 0 for x in t[1:]))
        assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(score)
    vocabulary = [*c1, "?"]
    for a, b in (("<s>", train[-1][1]), (train[-1][3], train[-1][4])):  # probabilities add up to 1
        whole = sum((c3[a, b, x] + m3 * (c2[b, x] + m2 * (c1[x] + 1) / (total + size + 1)) / (c1[b] + m2)) / (c2[a, b] + m3) for x in vocabulary)
        assert whole == pytest.approx(1)


def test_langid(spark):
    rng = random.Random(2)
    parts = {"aa": ["ka", "ko", "ri", "mu"], "bb": ["sch", "ung", "eit", "der"], "cc": ["ção", "nho", "lê", "est"]}
    rows = []
    for i in range(240):
        lang = rng.choice(list(parts))
        rows.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(30)), lang if i % 9 else None))
    rows += [(900, None, "aa"), (901, "", None), (902, "123 !!", "bb"), (903, "", "cc")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df.filter("doc_id % 2 = 0"), per_language=30, landmarks=10)
    got = by_id(langid.predict(df, model))
    held = [r for r in rows if r[0] % 2 and r[2] and r[0] < 900]
    assert np.mean([got[i]["lang_pred"] == lang for i, _, lang in held]) > 0.98
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 902, 903))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    many = df.filter("doc_id = 8").crossJoin(spark.range(2000)).drop("id").union(df.filter("doc_id % 2 = 0")).withColumn("score", df.doc_id)
    again = langid.fit(many, per_language=30, landmarks=10)  # rows of one id, and a column of another use
    assert np.mean([r["lang_pred"] == dict((i, x) for i, _, x in held)[r["doc_id"]] for r in langid.predict(many.unionByName(df.withColumn("score", df.doc_id)), again).collect() if r["doc_id"] in [h[0] for h in held]]) > 0.95
    assert langid.fit(df.limit(0)) is None and set(r["lang_pred"] for r in langid.predict(df, None).collect()) == {"und"}


def test_mixing(spark):
    rng = random.Random(4)
    plain = [f"w{i}" for i in range(50)]
    rows, labels = [], []
    for i in range(600):
        kind = i % 3
        w = [rng.choice(plain) for _ in range(40)]
        if kind == 1:
            w = [x + "###" for x in w]
        if kind == 2:
            w[3] = "scum"
        rows.append((i, " ".join(w), "x"))
        if i % 2:
            labels.append((i, 0 if kind == 1 else 1, int(kind == 2)))
    rows += [(9000, None, "x"), (9001, "", "x"), (None, "w1 w2", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, marks string")
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    _, _, out = mixing.mix(docs, marked, {"good": 0.6, "low": 0.3, "toxic": 0.1})
    got = out.toPandas()
    p = np.stack(got["posterior"])
    share = (p * (got["tokens"] * got["rate"]).values[:, None]).sum(0) / got["tokens"].sum()
    assert share == pytest.approx([0.6, 0.3, 0.1], abs=1e-6) and (got["rate"] >= 0).all()
    assert len(got) == len(rows)
    kept = mixing.apply(docs, marked, {"good": 0.6, "low": 0.3, "toxic": 0.1})
    assert kept.columns == docs.columns and kept.count() == got["copies"].sum()
    assert "Python" not in out._jdf.queryExecution().toString()
    assert mixing.mix(docs.limit(0), marked)[2].count() == 0 and mixing.mix(docs, marked.limit(0))[2].count() == len(rows)


def test_html():
    page = """<!doctype html><html><head><title>x</title><style>p{}</style></head><body><header><h1>Site</h1></header>
    <nav><ul><li><a href=a>Home</a><li><a href=b>News</a></ul></nav><div class="cookie-notice">We use cookies, lots, of them.</div>
    <article><h1>A &amp; B</h1><p>First, a paragraph,   with\n enough text to be scored&nbsp;well.<p><b>Second, <i>bold</i> one<br>broken line, more text here.
    <ul><li>item one<li>item two</ul><script>var a = "<p>no</p>";</script><table><tr><td>cell</td></tr></table><p>Last &lt;tag&gt; &#233; text.</p></article>
    <section id="comments"><article><p>I, as a reader, think, that, this, is, good, indeed, and so on.</p></article></section>
    <aside>Aside, text, here.</aside><form><p>Your name, please, now.</p></form><footer>&copy; us</footer></body></html>"""
    assert html_text.main_text(page) == "A & B\n\nFirst, a paragraph, with enough text to be scored well.\n\nSecond, bold one broken line, more text here.\n\nitem one\n\nitem two\n\ncell\n\nLast <tag> é text."
    plain = '<div class="top"><a href=1>one</a> <a href=2>two</a></div><div><div><p>' + "Words, and more words. " * 9 + "</p><p>" + "Other, words. " * 9 + "</p></div><div><p>tiny</p></div></div>"
    assert html_text.main_text(plain).split("\n\n")[:2] == [("Words, and more words. " * 9).strip(), ("Other, words. " * 9).strip()]
    for odd in (None, "", "<", "<p", "</p></b>", "<p>a<b", "&amp", "<!-- x", "<script>", "<div>" * 3000, "<a><b></a></b>x"):
        assert isinstance(html_text.main_text(odd), str)
    assert html_text.main_text("just text") == "just text"


def test_html_layout_words():
    text = "\n\n".join(["Words, and more words, of the article. " * 4, "Other words, of the same article. " * 4]).replace(" \n", "\n").strip()
    body = "".join(f"<p>{x}</p>" for x in text.split("\n\n"))
    for around in ("content with-sidebar", "no-sidebar", "layout header-fixed", "search-results", "has-comments", "widget"):
        for inner in (body, f"<article>{body}</article>", f"<main><div class='entry-content'>{body}</div></main>"):
            assert html_text.main_text(f'<body><div class="{around}">{inner}</div><div class="sidebar"><p>Not this, at all, please.</p></div></body>') == text
    for title in ('<div class="entry-header"><h1>Title</h1></div>', '<h1 class="article-header">Title</h1>', '<h2 class="related">Title</h2>'):
        assert html_text.main_text(f"<body><article>{title}{body}</article></body>") == "Title\n\n" + text
    for out in ("ad", "site-footer", "related-posts", "share-buttons", "comments-area", "cookie_notice"):
        assert html_text.main_text(f"<body><article>{body}<div class='{out}'><p>Not this, at all, please.</p></div></article></body>") == text
    for out in ("ad", "widget", "banner"):
        assert html_text.main_text(f"<body><div class='{out}'>" + "<p>Not this, at all, please, whatever its length may be.</p>" * 9 + "</div><article><p>Short text.</p></article></body>") == "Short text."
    talk = "".join(f"<p>I, as reader {k}, think, that, this, is, good, indeed, and so on.</p>" for k in range(40))
    assert html_text.main_text(f"<body><div>{body}</div><div id='comments'>{talk}</div></body>") == text


def test_html_sections():
    long = ("Words, and more words, of the article. " * 9).strip()
    short = "One short paragraph of a part."
    menu = "<ul>" + "".join(f"<li><a href={k}>Some page {k}</a></li>" for k in range(9)) + "</ul>"
    want = f"Part one\n\n{long}\n\n{long}\n\n{long}\n\n{long}\n\nPart two\n\n{short}\n\nitem\n\ncell\n\nquote\n\ncode"
    more = "<ul><li>item</li></ul><table><tr><td>cell</td></tr></table><blockquote>quote</blockquote><pre>code</pre>"
    for wrap in ("<div>{}</div>", "<section>{}</section>", "<section><div>{}</div></section>"):
        parts = "<h2>Part one</h2>" + wrap.format(f"<p>{long}</p>" * 4) + "<h2>Part two</h2>" + wrap.format(f"<p>{short}</p>") + more
        for page in (f"<body>{menu}{parts}{menu}</body>", f"<body><div>{menu}</div><div class='page'>{parts}</div><div>{menu}</div></body>"):
            assert html_text.main_text(page) == want


def test_html_classes_that_do_not_name():
    text = "\n\n".join(f"Words, and more words, of part {k} of the article, which is long enough." for k in range(9))
    body = "".join(f"<p>{x}</p>" for x in text.split("\n\n"))
    for name in ("content has-sidebar", "post category-social-history", "main banner-story", "no-footer", "post tag-related-work", "w-social"):
        assert html_text.main_text(f'<body><div class="{name}">{body}</div></body>') == text
        assert html_text.main_text(f'<body><div><div class="{name}">{body}</div><div class="sidebar"><p>Not this, at all, please.</p></div></div></body>') == text
    around = '<form id="f"><nav><a href="/">Home</a></nav><div id="c">%s</div></form>'
    assert html_text.main_text(f"<body>{around % body}</body>") == text
    assert html_text.main_text(f"<body><div>{body}<form><p>Your name, please, now, at once, whoever you are.</p></form></div></body>") == text
    assert html_text.main_text(f"<body><div>{body}<div class='mobile-ad-300'><p>Buy this, and that, today, dear reader, for it is cheap.</p></div></div></body>") == text
    assert html_text.main_text(f"<body><div role=navigation><p>Not this, at all, please, whatever it may be.</p></div><div>{body}</div></body>") == text


@pytest.mark.parametrize("page", ["<b " + "\"'" * 200, ("<b \"' x") * 20_000, "<div>" * 100_000 + "x", "<p><button>" + "<div>" * 100_000, "<div>x" * 50_000, "<span hidden>" * 50_000, "<ul><li>" * 50_000, "</div>" * 50_000 + "<b>" * 50_000 + "</b>" * 50_000, "<a " + "x=y " * 100_000, "<!--" * 50_000, "<" * 100_000, "<a href='" * 50_000, "<div class='sidebar ad menu'>y, " * 20_000, "<script>" * 50_000])
def test_html_hostile(page):
    began = time.process_time()
    assert isinstance(html_text.main_text(page), str)
    assert time.process_time() - began < 3


def test_html_scores_against_plain_definition():
    rng = random.Random(3)
    for _ in range(40):
        parts, depth = [], 0
        for _ in range(60):
            step = rng.random()
            if step < 0.4:
                parts.append("<div>")
                depth += 1
            elif step < 0.6 and depth:
                parts.append("</div>")
                depth -= 1
            else:
                words_ = ", ".join("word" * rng.randint(1, 9) for _ in range(rng.randint(1, 9)))
                parts.append(rng.choice(["<p>%s</p>", "<p>a<a href=x>%s</a></p>", "%s<br>", "<ul><li>%s</ul>"]) % words_)
        page = html_text.Page("<body>" + "".join(parts) + "</body>")
        points, chars, links = html_text.scored(page)
        for k in range(1, len(page.tags)):
            want = [0.0, 0, 0]
            for owner, text, linked in page.blocks:
                path = [owner]
                while path[-1] > 0:
                    path.append(page.parents[path[-1]])
                if k in path:
                    want[1] += len(text)
                    want[2] += linked
                    inner = path[1:] if page.tags[owner] in html_text.PARAGRAPH else path
                    if k in inner:
                        want[0] += html_text.gain(text, linked) / (inner.index(k) + 1)
            assert [points[k], chars[k], links[k]] == pytest.approx(want)


def test_html_rows(spark):
    df = spark.createDataFrame([(1, "u", "<p>Hello, there.</p>", 7), (2, None, None, 8)], "page_id long, url string, html string, text long")
    got = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in html_text.extract(df).collect()}
    assert got == {1: ("u", "Hello, there.", 13), 2: (None, "", 0)}
    assert html_text.extract(df.limit(0)).count() == 0


def test_suffix_array():
    rng = np.random.default_rng(0)
    rows = rng.integers(97, 99, (40, 48)).astype(np.uint8)
    rows[10:20] = rows[5]
    rows[12, 40] += 1
    rows[30] = 97
    text = suffix_array.Text(rows)
    r, c = np.divmod(np.arange(40 * 48), 48)
    order = text.order(r, c)
    raw = [rows[i].tobytes()[j:] for i, j in zip(r, c)]
    assert [raw[k] for k in order] == sorted(raw)
    shift = suffix_array.shifts()
    assert all((i + shift[i, j]) % 16 in suffix_array.COVER and (j + shift[i, j]) % 16 in suffix_array.COVER for i in range(16) for j in range(16))


def brute_repeats(texts, length):
    seen, out = set(), []
    for x in texts:
        b = (x or "").encode()
        gone = bytearray(len(b))
        own = [b[k : k + length] for k in range(len(b) - length + 1)]
        for k, w in enumerate(own):
            if w in seen:
                gone[k : k + length] = b"\1" * length
        seen.update(own)
        out.append((b, gone))
    return out


@pytest.mark.parametrize("options", [{}, {"chunk_bytes": 3000, "fan": 4}, {"chunk_bytes": 3000, "fan": 2, "hot": 2}, {"hot": 1}])
def test_repeats(spark, docs, texts, options):
    got = by_id(repeats.digest(docs, **options))
    brute = brute_repeats(texts, 50)
    for i, (b, gone) in enumerate(brute):
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    assert sum(r["n_removed"] for r in got.values()) > 0
    left = repeats.strip(docs)
    assert left.columns == docs.columns
    for r in left.collect():
        b, gone = brute[r["doc_id"]]
        assert r["text"] == (None if texts[r["doc_id"]] is None else bytes(c for c, g in zip(b, gone) if not g).decode("utf-8", "ignore"))
    assert repeats.digest(docs.limit(0)).count() == 0
    passage = "a passage that is written in both of the documents, word for word, to the end"
    same = spark.createDataFrame([(None, passage), (3, passage), (3, passage), (4, "x" + passage)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in repeats.digest(same).collect()) == [(0, 0), (3, 0), (3, 0), (4, len(passage))]


def test_shingle_join(spark, docs, texts):
    sets = []
    for x in texts:
        w = words(x)
        sets.append({tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set())
    root = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 85 * len(a | b):
                    root[i] = min(root[i], root[j])
    for options in ({}, {"frequent": 2, "chunk_bytes": 2000, "fan": 4}, {"frequent": 2, "part": 2}, {"frequent": 1, "part": 1000}):
        got = by_id(shingle_join.link(docs, **options))
        assert [(got[i]["n_shingles"], got[i]["component_id"]) for i in range(len(texts))] == [(len(s), r) for s, r in zip(sets, root)]
    assert len(set(root)) < len(root)
    assert shingle_join.link(docs.limit(0)).count() == 0


@pytest.mark.parametrize("threshold", [(85, 100), (80, 100), (50, 100)])
@pytest.mark.parametrize("part", [1, 3, 8])
def test_keys_of_similar_sets_meet(threshold, part):
    rng = np.random.default_rng(4)
    over, under = threshold
    for _ in range(150):
        n = int(rng.integers(1, 400))
        union = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        kinds = rng.choice([shingle_join.RARE, shingle_join.COMMON], len(union), p=rng.choice([[0, 1], [0.02, 0.98], [0.1, 0.9]])).astype(np.uint8)
        shared = -(-len(union) * over // under)
        a, b = union.copy(), union.copy()
        apart = rng.permutation(len(union))[: len(union) - shared]
        cut = int(rng.integers(0, len(apart) + 1))
        a, ka = np.delete(a, apart[:cut]), np.delete(kinds, apart[:cut])
        b, kb = np.delete(b, apart[cut:]), np.delete(kinds, apart[cut:])
        ka, kb = ka.copy(), kb.copy()
        ka[~np.isin(a, b)] = rng.choice([0, 1, 2])  # tokens that only one of them has may be of any class
        kb[~np.isin(b, a)] = rng.choice([0, 1, 2])
        if not len(a) or not len(b) or len(a) == len(b) == shared:
            continue
        one, two = (shingle_join.keys_of(x, k, over, under, part) for x, k in ((a, ka), (b, kb)))
        assert len(np.intersect1d(one, two)), (len(a), len(b), shared)
    long_ = np.unique(rng.integers(0, 1 << 62, 4000).astype(np.uint64))
    assert len(shingle_join.keys_of(long_, np.full(len(long_), 2, np.uint8), over, under, 8)) < 24 * len(long_)


def test_dense_clusters(spark, monkeypatch):
    monkeypatch.setattr(shingle_join, "BLOCK", 8)
    rng = random.Random(6)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(60)] = f"x{rng.random()}"
        rows.append((i, " ".join(w)))
    sets = [{tuple(w[k : k + 4]) for k in range(57)} for w in (r[1].split() for r in rows)]
    root = list(range(60))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if 100 * len(a & b) >= 85 * len(a | b):
                    root[i] = min(root[i], root[j])
    got = by_id(shingle_join.link(spark.createDataFrame(rows, "doc_id long, text string"), frequent=4))
    assert [got[i]["component_id"] for i in range(60)] == root


@pytest.mark.parametrize("dense", [False, True])
def test_chains_of_near_copies(spark, monkeypatch, dense):
    monkeypatch.setattr(shingle_join, "BLOCK", 4 if dense else 1 << 20)
    rng = random.Random(7)
    sets = []
    for chain in range(60):
        line = [f"c{chain}w{rng.random()}" for _ in range(250)]
        for k in range(20):  # each is near those one or two steps away only
            sets.append((line, k))
    rng.shuffle(sets)
    texts_ = [" ".join(line[4 * k : 4 * k + 100]) for line, k in sets]
    grams = [{tuple(w[k : k + 4]) for k in range(len(w) - 3)} for w in map(str.split, texts_)]
    root = list(range(len(sets)))
    chains = collections.defaultdict(list)
    for i, (line, _) in enumerate(sets):
        chains[line[0]].append(i)
    near = [(i, j) for own in chains.values() for i in own for j in own if i < j and 100 * len(grams[i] & grams[j]) >= 85 * len(grams[i] | grams[j])]
    for _ in range(20):
        for i, j in near:
            root[i] = root[j] = min(root[i], root[j])
    rows = list(enumerate(texts_))
    got = by_id(shingle_join.link(spark.createDataFrame(rows, "doc_id long, text string"), frequent=4))
    assert [got[i]["component_id"] for i in range(len(rows))] == root


def test_texts_of_one_id(spark):
    rng = random.Random(9)
    text = [[f"t{k}w{rng.random()}" for _ in range(60)] for k in range(8)]
    near = [" ".join([*w[:-1], "changed"]) for w in text]
    text = [" ".join(w) for w in text]
    rows = [(10, x) for x in text[:6]] + [(20 + k, x) for k, x in enumerate(near[:6])]  # many texts of one id
    rows += [(3, text[6]), (5, text[6]), (5, text[7]), (7, near[7])]  # one of them another id's too
    found = shingle_join.link(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in found) == sorted((i, 10 if i >= 10 else 3) for i, _ in rows)


def test_pipeline(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "suffix-array dedup", "mixing", "packing"]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"] for r in now.select("doc_id").collect()}
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        assert {r["doc_id"] for r in now.select("doc_id").collect()} <= before
        if k < 4:
            assert now.columns == docs.columns
    assert now.count() > 0


@pytest.mark.parametrize("stage", [corpus_pipeline.quality_rules, corpus_pipeline.pack_sequences])
def test_stages_begin_without_the_heap_of_those_before(spark, docs, stage):
    heap = spark._jvm.java.lang.Runtime.getRuntime()  # of the executor too, as the master is local
    held = [spark._jvm.java.nio.ByteBuffer.allocate(50 << 20) for _ in range(8)]
    before = heap.totalMemory()
    assert before > 400 << 20
    del held
    gc.collect()  # so that the JVM may free them, which alone shrinks nothing
    time.sleep(1)
    stage(spark, docs, "")
    assert heap.totalMemory() < before - (100 << 20)


def test_lean_keeps_results_and_kinds_of_functions(spark, monkeypatch):
    monkeypatch.setattr(common, "GROUP_BYTES", 0)

    def rows(batches):
        yield from batches

    def own(table):
        return table

    def both(left, right):
        return left

    table = spark.createDataFrame([(1, "a"), (2, None), (2, "")], "id long, text string")
    expected = sorted(map(str, table.collect()))
    kind = "id long, text string"
    for out in (table.mapInArrow(common.lean(rows), kind), table.groupBy("id").applyInArrow(common.lean(own), kind), table.groupBy("id").cogroup(table.groupBy("id")).applyInArrow(common.lean(both), kind)):
        assert sorted(map(str, out.collect())) == expected
    assert table.limit(0).mapInArrow(common.lean(rows), kind).count() == 0

    def failing(batches):
        raise ValueError("told")
        yield

    with pytest.raises(ValueError, match="told"):
        list(common.lean(failing)(iter([])))


def files_below(spark):
    """Files of tables in the shared folder."""
    top = storage.shared_dir(spark).removeprefix("file://")
    return {os.path.join(d, f) for d, _, names in os.walk(top) for f in names if f.endswith(".parquet")}


def shuffled(spark):
    """Shuffle files with anything in them."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
    return {f for f in files if f.endswith(".data") and os.path.exists(f)}


def settled_shuffles(spark, before):
    """New shuffle files that are still there after the removals under way."""
    for _ in range(40):
        if not shuffled(spark) - before:
            break
        time.sleep(0.25)
    return shuffled(spark) - before


def test_writing_leaves_no_shuffle_files(spark):
    before, switch = shuffled(spark), spark.conf.get(storage.CLEANUP, None)
    rows = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    out = storage.materialize(rows)
    assert not settled_shuffles(spark, before)
    assert out.agg(F.sum("count")).first()[0] == 1000 and out.count() == 7
    assert spark.conf.get(storage.CLEANUP, None) == switch


def test_settle_and_drop(spark):
    before = files_below(spark)

    def make():
        one, two = storage.materialize(spark.range(5)), storage.materialize(spark.range(5, 8))
        both = storage.materialize(one.union(two))
        storage.drop(one, two, spark.range(3))
        assert both.count() == 8
        return both.filter("id > 1")

    with storage.scratch(spark):
        out = storage.settle(spark, make)
        assert sorted(r["id"] for r in out.collect()) == [2, 3, 4, 5, 6, 7]
        kept = {os.path.dirname(f) for f in files_below(spark) - before}
        assert len(kept) == 1  # the result alone
    assert files_below(spark) == before


def test_shingle_join_leaves_its_result_alone(spark, docs):
    before = files_below(spark)
    out = shingle_join.link(docs)
    assert out.count() == docs.count()
    assert len({os.path.dirname(f) for f in files_below(spark) - before}) == 1


def test_shingle_join_in_turns(spark, docs, monkeypatch):
    written, write = [], storage.materialize
    monkeypatch.setattr(shingle_join, "materialize", lambda df: written.append(df.columns) or write(df))
    expected = sorted(map(str, shingle_join.link(docs, frequent=2).collect()))
    once = written.count(["a", "b"])
    monkeypatch.setattr(shingle_join, "CARRIED", 0)
    monkeypatch.setattr(shingle_join, "CARRIED_LEAST", 10)
    assert sorted(map(str, shingle_join.link(docs, frequent=2).collect())) == expected
    assert written.count(["a", "b"]) - once > once  # some comparison took several turns


def test_near_duplicates_are_known_by_few_ids(spark, docs):
    left = corpus_pipeline.near_duplicates(spark, docs, "")
    linked = shingle_join.link(docs, corpus_pipeline.SHINGLE_WORDS, corpus_pipeline.SIMILARITY)
    gone = {r["doc_id"] for r in linked.collect() if r["doc_id"] != r["component_id"]}
    assert gone and {r["doc_id"] for r in left.collect()} == {r["doc_id"] for r in docs.collect()} - gone
    plan = left._jdf.queryExecution().sparkPlan().toString()  # the ids are a table by now
    assert "HashAggregate" not in plan and plan.count("BroadcastHashJoin") == 1 and "SortMergeJoin" not in plan


@pytest.mark.parametrize("fan", [256, 8, 2])
def test_totals_leave_answers_alone(spark, monkeypatch, fan):
    monkeypatch.setattr(exchange, "SLICED", 2)
    files = files_below(spark)
    chunks = spark.range(12).select(F.col("id").alias("chunk"))

    def lists(row):
        keys = np.arange(row["chunk"], 40, dtype=np.uint64) << np.uint64(57)
        yield 1, keys, np.ones(len(keys), np.int64)

    found, sums = exchange.totals(chunks, lists, {1: 64}, lambda _, totals: totals, fan, sums_too=True)
    assert tuple(sums.select("total", "different").first()) == (sum(40 - c for c in range(12)), 40)
    for c in range(12):
        rows = [r.asDict() for r in found.filter(F.col("grp") == c).collect()]
        assert exchange.known(rows, 1).tolist() == [min(k, 11) + 1 for k in range(c, 40)]
    assert {r["kind"] for r in found.select("kind").distinct().collect()} == {1}
    kinds = {tuple(pq.read_schema(f).names) for f in files_below(spark) - files}
    assert kinds <= {tuple(x.split()[0] for x in exchange.ANSWERS.split(", ")), ("kind", "total", "different")}
