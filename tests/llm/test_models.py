"""Fitted models walked one row at a time in plain Python, and the pipeline against plain Python."""

import math
import random

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from driftledger.llm import decontaminate, docstats, ngram_join, quality_classifier, quality_rules, substring_dedup, toxicity
from driftledger.llm.queries import PIECE_MODEL

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")


def _tree_score(model, stats):
    margin = model.base
    for at in model.roots:
        while model.feature[at] >= 0:
            at = model.left[at] if stats[model.feature[at]] <= model.threshold[at] else model.right[at]
        margin += model.value[at]
    return 1 / (1 + math.exp(-min(30, max(-30, margin))))


def test_toxicity_equals_a_plain_mean_over_words(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    assert model.part
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    for d in docs.collect():
        weights, odds = [toxicity.NEUTRAL], []
        for word in toxicity.tokens(d.text):
            pieces = toxicity.subwords(word)
            pull = sum(model.part.get(s, (0, 0))[1] for s in pieces) / len(pieces)
            weights.append(math.exp(min(toxicity.STEEP, max(-toxicity.STEEP, pull))))
            odds.append(weights[-1] * sum(model.part.get(s, (0, 0))[0] for s in pieces) / len(pieces))
        assert got[d.doc_id] == pytest.approx(1 / (1 + math.exp(-(model.bias + sum(odds) / sum(weights)))), abs=1e-9)


def test_quality_score_equals_walking_the_trees(given):
    docs, labels = given
    model = quality_classifier.fit(docs, labels)
    got = {r.doc_id: r.score for r in quality_classifier.score(docs, model).collect()}
    for d in docs.collect():
        assert got[d.doc_id] == pytest.approx(_tree_score(model, docstats.of_text(d.text)), abs=1e-9)


def test_first_split_is_the_best_of_all():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 3)).round(1)
    y = ((x[:, 1] > 0.2) ^ (rng.random(60) < 0.1)).astype(float)
    model = quality_classifier.fit_trees(x, y, rounds=1, depth=1, bins=200)
    g, h = y.mean() - y, np.full(60, y.mean() * (1 - y.mean()))

    def gain(low):
        part = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
        return part(low) + part(~low) - part(np.ones(60, dtype=bool))

    sides = [x[:, f] <= c for f in range(3) for c in np.unique(x[:, f])]
    best = max(gain(s) for s in sides if 3 <= s.sum() <= 57)
    root = model.roots[0]
    assert gain(x[:, model.feature[root]] <= model.threshold[root]) == pytest.approx(best)
    low = x[:, model.feature[root]] <= model.threshold[root]
    assert model.value[model.left[root]] == pytest.approx(-0.15 * g[low].sum() / (h[low].sum() + 1))


def test_rules_equal_plain_conditions(given):
    docs, labels = given
    rules = quality_rules.fit(docs, labels)
    assert rules
    got = {r.doc_id: (r.rule, r.kept) for r in quality_rules.classify(docs, labels).collect()}
    for d in docs.collect():
        stat = dict(zip(quality_rules.TESTED, docstats.of_text(d.text), strict=True))
        holds = [k for k, r in enumerate(rules, 1) if all(stat[t.stat] > t.threshold if t.above else stat[t.stat] <= t.threshold for t in r.tests)]
        failed = stat["n_words"] < 50 or 100 * stat["n_repeat_words"] > 50 * stat["n_words"]
        assert got[d.doc_id] == (holds[0] if holds else 0, not failed and not holds)


def test_empty_tables_and_clashing_columns(spark, given):
    docs, labels = given
    none = docs.where("false")
    bench = spark.read.parquet(f"{DIR}/benchmark.parquet")
    assert toxicity.classify(none, labels).count() == quality_classifier.classify(none, labels).count() == quality_rules.classify(none, labels).count() == 0
    for stage in (lambda d: quality_classifier.keep_good(d, labels), ngram_join.one_of_each, substring_dedup.clean, lambda d: decontaminate.clean(d, bench)):
        assert stage(none).count() == 0
        more = docs.limit(20)
        for name in ("__score", "__text", "__key", "__kept", "__rep", "_0", "label", "score", "key", "a.b"):
            more = more.withColumn(name, F.lit(name))
        out = stage(more)
        assert out.columns == more.columns and all(r["__key"] == "__key" and r["a.b"] == "a.b" and r["_0"] == "_0" for r in out.collect())
    assert decontaminate.clean(docs, bench.where("false")).count() == docs.count()


def test_conflicting_labels_and_null_ids(spark, given):
    docs, labels = given
    twice = labels.unionByName(labels.withColumns({"toxic": 1 - F.col("toxic"), "quality": 1 - F.col("quality")}).limit(10)).unionByName(spark.createDataFrame([(None, 1, 1), (1, None, None)], labels.schema))
    rows = docs.unionByName(docs.limit(5).withColumn("doc_id", F.lit(None).cast("long")))
    for classify in (toxicity.classify, quality_classifier.classify):
        first, second = (sorted(map(str, classify(rows.repartition(n), twice).collect())) for n in (2, 5))
        assert first == second and len(first) == rows.count()


def _distance(item, text):
    """The least number of edits of the item against any part of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_pipeline_equals_plain_python(spark, given, tmp_path):
    """Each stage on what its predecessor kept, with near copies, shared passages and benchmark items planted."""
    import corpus_pipeline

    rng = random.Random(3)
    docs, labels = given
    some = [r.asDict() for r in docs.orderBy("doc_id").limit(50).collect()]
    items = ["which river crosses the old town of marlow before it meets the sea", "name the three colours that the northern painters mixed at dawn"]
    made = [" ".join(rng.choice(some)["text"].split()[:400]) for _ in range(24)]
    passage = " ".join(rng.choice(made).split()[:60])
    for k, text in enumerate(made):
        words = text.split()
        if k % 4 == 0 and words:
            words[rng.randrange(len(words))] = "changed"
        if k % 4 == 1:
            words[len(words) // 2 : len(words) // 2] = passage.split()
        if k % 4 == 2:
            words[len(words) // 3 : len(words) // 3] = rng.choice(items).replace("a", "e", 1).split()
        some.append({**some[k], "doc_id": 10_000 + k, "text": " ".join(words)})
    rows = spark.createDataFrame(some, docs.schema)
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    model = quality_classifier.fit(rows, labels)
    now = {r["doc_id"]: r["text"] for r in some if _tree_score(model, docstats.of_text(r["text"])) >= 0.3}
    grams = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in now.items() for w in [t.split()]}
    group = {i: i for i in now}
    for i in sorted(now):
        for j in sorted(now):
            if i < j and (now[i] == now[j] or grams[i] and grams[j] and len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j])):
                a, b = group[i], group[j]
                group = {k: min(a, b) if g in (a, b) else g for k, g in group.items()}
    now = {i: t for i, t in now.items() if group[i] == i}
    first, marked = {}, {}
    for i in sorted(now):
        w = now[i].split()
        for k in range(len(w) - 12):
            if first.setdefault(tuple(w[k : k + 13]), i) < i:
                marked.setdefault(i, set()).update(range(k, k + 13))
    cut = {i: t if i not in marked else " ".join(x for k, x in enumerate(t.split()) if k not in marked[i]) for i, t in now.items()}
    hit = {i for i, t in cut.items() for item in map(decontaminate.normal, items) if _distance(item, decontaminate.normal(t)) <= int(len(item) * 0.06)}
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    want = {i: library.encode(t) for i, t in cut.items() if i not in hit}
    got = {r.doc_id: list(r.token_ids) for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "token_ids").collect()}
    assert marked and hit and len(now) < len(group) and got == want


def test_toxicity_gradient():
    """The gradient of the joint fit against differences of its loss."""
    rng = np.random.default_rng(4)
    n_words, grams, dim = 12, 15, 3
    bags = toxicity._Bags.of([rng.integers(0, n_words, k).astype(np.int32) for k in (4, 9, 1, 6)], [0, 1, 1, 0], np.zeros(n_words, dtype=bool))
    words = (rng.integers(0, n_words, 40), rng.integers(0, grams, 40), rng.random((40, 1)), n_words)
    cost = rng.random((4, 1))
    params = (rng.normal(0, 0.5, (grams, dim)), rng.normal(0, 0.5, (dim, 2)), rng.normal(0, 0.5, 2), rng.normal(0, 0.5, dim))
    grads = toxicity._loss(params, bags, words, cost)[1]
    for k, param in enumerate(params):
        for _ in range(12):
            at = tuple(rng.integers(0, m) for m in param.shape)
            kept, sides = param[at], []
            for step in (1e-2, -1e-2):
                param[at] = kept + step
                sides.append(toxicity._loss(params, bags, words, cost)[0])
            param[at] = kept
            assert abs((sides[0] - sides[1]) / 2e-2 - grads[k][at]) < 2e-3, (k, at)


def test_toxicity_of_few_labels_is_no_constant():
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(300)]
    texts = [" ".join(rng.choice(words, 40)) + (" grobian" if k % 6 == 0 else "") for k in range(60)]
    model = toxicity.train(texts, [int(k % 6 == 0) for k in range(60)])
    score = model.scorer()
    bad = [score(" ".join(rng.choice(words, 40)) + w) for w in (" grobian", " grobians", " Grobiann")]
    good = [score(" ".join(rng.choice(words, 40))) for _ in range(20)]
    assert min(bad) > 0.5 > sorted(good)[-3] and len(set(good)) > 10


def test_toxicity_of_very_long_texts_and_clashing_columns(spark):
    rows = [(k, f"plain words number {k % 7} " + ("vile thing" if k % 2 else "kind thing")) for k in range(120)] + [(500, "plain words " * 60_000 + "vile thing"), (501, "w" * 200_000), (None, "vile thing"), (502, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit("x").alias(c) for c in ("label", "score", "held_out", "predicted", "t")))
    labels = spark.createDataFrame([(k, k % 2) for k in range(120)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.classify(docs, labels).collect()}
    assert len(got) == 124 and got[None] > 0.5 and all(0 <= v <= 1 for v in got.values())
