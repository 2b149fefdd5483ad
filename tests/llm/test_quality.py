import numpy as np

from pyspark.sql import functions as F

from tidegauge.llm import pu_quality, quality_rules, queries, textstats


def _brute(text):
    import re

    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    cover = set()
    for i, x in enumerate(windows):
        if windows.count(x) > 1:
            cover |= set(range(i, i + 8))
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(cover))


def test_base_statistics_match_brute_force():
    r = np.random.default_rng(3)
    texts = [None, "", " \n ", "a b c", "x y z é\u0085q", "# * $a|b <c> && 1%", "l one\nl one\n\n \nl one \nl one", "a " * 9, "a " * 200]
    for n in (7, 8, 9, 16, 40, 120):
        base = [f"w{k}" for k in r.integers(0, 6, n)]
        texts += [" ".join(base), " ".join(base + ["mid"] + base), "\n".join(base[:5] * 3)]
    for t in texts:
        assert textstats.stats(t)[:5] == _brute(t), t


def test_repeats_of_any_width():
    r = np.random.default_rng(4)
    for width in (1, 2, 3, 5, 7, 8, 11):
        for _ in range(20):
            w = [b"%d" % k for k in r.integers(0, 3, 30)]
            runs = [tuple(w[i : i + width]) for i in range(len(w) - width + 1)]
            want = {k for i, x in enumerate(runs) if runs.count(x) > 1 for k in range(i, i + width)}
            assert textstats.repeated_words(w, width) == len(want)


def test_decision_list_finds_planted_conjunctions():
    r = np.random.default_rng(0)
    x = {n: r.random(3000) for n in quality_rules.TESTED}
    bad = ((x["symbol_rate"] > 0.8) & (x["upper_rate"] > 0.5)) | (x["dup_line_rate"] > 0.9)
    rules = quality_rules.learn(x, bad)
    hit = np.any([rule.covers(x) for rule in rules], axis=0)
    assert (hit & bad).sum() > 0.9 * bad.sum() and (hit & ~bad).sum() < 0.02 * (~bad).sum()
    assert quality_rules.learn(x, np.zeros(3000, bool)) == []
    assert quality_rules.learn({n: v[:0] for n, v in x.items()}, bad[:0]) == []


def test_verdict_is_the_list_in_order(spark):
    rules = [quality_rules.Rule((("symbol_rate", ">", 0.5), ("upper_rate", "<=", 0.1))), quality_rules.Rule((("word_length", ">", 9.0),))]
    df = spark.createDataFrame([(0.6, 0.05, 1.0), (0.6, 0.5, 1.0), (0.1, 0.5, 10.0)], "symbol_rate double, upper_rate double, word_length double")
    assert [r.k for r in df.select(quality_rules.verdict(rules).alias("k")).collect()] == [False, True, False]
    assert all(r.k for r in df.select(quality_rules.verdict([]).alias("k")).collect())


def _labelled(spark):
    good = [" ".join(f"word{(i * 7 + k * 3) % 97}" for k in range(40)) for i in range(160)]
    junk = [" ".join(f"wo#r$d{(i + k) % 50}%%" for k in range(40)) for i in range(80)]
    docs = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(good + junk)]
    labels = [(i, int(i < 160), 0) for i in range(240) if i % 2 == 0] + [(None, 1, 0), (3, None, 0), (9999, 0, 0)]
    return (
        spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint"),
        spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"),
    )


def test_rules_query(spark, stored):
    docs, labels = _labelled(spark)
    out = queries.op7_quality_rules(spark, stored(documents=docs, labels=labels)).collect()
    assert len(out) == 240
    assert all(r.kept == (r.doc_id < 160) and not r.base_failed for r in out)


def test_classifier_query_on_held_out(spark, stored):
    docs, labels = _labelled(spark)
    out = queries.op10_pu_quality(spark, stored(documents=docs, labels=labels)).collect()
    held = [r for r in out if r.held_out]
    assert len(out) == 240 and 20 < len(held) < 90
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    right = np.mean([(r.predicted == 1) == (r.doc_id < 160) for r in held])
    assert right > 0.95


def test_risk_does_not_go_negative_with_few_positives():
    r = np.random.default_rng(1)
    k = len(pu_quality.USED)
    pos, unl = r.normal(1, 1, (40, k)), np.concatenate([r.normal(1, 1, (300, k)), r.normal(-1, 1, (300, k))])
    model = pu_quality.train(pos, unl, 0.5, rounds=500)
    assert np.mean(model.scores(r.normal(1, 1, (200, k))) > model.scores(r.normal(-1, 1, (200, k)))) > 0.95
    alone = pu_quality.train(pos[:0], unl, 0.3)
    assert np.allclose(alone.scores(unl), 0.3)


def test_odd_and_empty(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    rules = quality_rules.fit(odd_docs, labels)
    assert rules == []
    judged = quality_rules.judged(odd_docs, rules)
    assert judged.count() == odd_docs.count()
    assert judged.where("base_failed").where(F.col("n_words") >= 20).count() == 0
    clash = odd_docs.withColumnRenamed("lang", "kept").withColumnRenamed("source", "n_words")
    assert quality_rules.passing(clash, rules).columns == clash.columns
    assert {r.doc_id for r in quality_rules.passing(clash, rules).collect()} == {6, 7, 8}
    assert quality_rules.passing(no_docs, rules).count() == 0
    model = pu_quality.fit(no_docs, labels)
    assert pu_quality.score(odd_docs, model).count() == odd_docs.count()
    assert pu_quality.score(no_docs, model).count() == 0


def test_parts_of_the_risk_match_a_plain_loop():
    import math

    r = np.random.default_rng(6)
    edges = [np.array([0.0, 1.0]) for _ in pu_quality.USED]
    model = pu_quality.Model(edges, r.normal(size=3 * len(edges)), 0.3, 0.4)
    rows = pu_quality._binned(r.normal(0.5, 1, (50, len(edges))), edges)
    loss, grad, hess = pu_quality.parts(rows, model)
    want, slope, bend = 0.0, np.zeros(len(model.weights) + 1), np.zeros((len(model.weights) + 1,) * 2)
    for row in rows.tolist():
        z = sum(model.weights[k] for k in row) + model.bias
        p = 1 / (1 + math.exp(-z))
        want += math.log(1 + math.exp(z))
        for i in [*row, -1]:
            slope[i] += p
            for j in [*row, -1]:
                bend[i, j] += p * (1 - p)
    assert np.isclose(loss, want) and np.allclose(grad, slope) and np.allclose(hess, bend)
    eps = 1e-6  # and the gradient is that of the loss
    for k in (0, 5, 11):
        moved = pu_quality.Model(edges, model.weights + eps * (np.arange(len(model.weights)) == k), 0.3, 0.4)
        assert np.isclose((pu_quality.parts(rows, moved)[0] - loss) / eps, grad[k], atol=1e-3)


def test_descent_reaches_the_least_risk_and_keeps_it_non_negative():
    r = np.random.default_rng(2)
    k = len(pu_quality.USED)
    pos, unl = r.normal(0.3, 1, (400, k)), np.concatenate([r.normal(0.3, 1, (400, k)), r.normal(-0.3, 1, (600, k))])
    first = pu_quality.train(pos, unl, 0.4)  # 168 weights and 400 positives: the border is met
    p, u = pu_quality._binned(pos, first.edges), pu_quality._binned(unl, first.edges)
    model = pu_quality.descend(pu_quality._start(first.edges, 0.4), p, lambda m: (len(u), *pu_quality.parts(u, m)), 0.4, ridge=0.1)

    def value(m):
        zp, zu = (m.weights[x].sum(axis=1) + m.bias for x in (p, u))
        negatives = np.logaddexp(0, zu).mean() - 0.4 * np.logaddexp(0, zp).mean()
        return 0.4 * np.logaddexp(0, -zp).mean() + negatives + (0.1 + 1 / 400) / 2 * (m.weights**2).sum(), negatives

    best, negatives = value(model)
    assert negatives >= 0 and value(first)[1] >= 0
    for _ in range(200):
        other = pu_quality.Model(model.edges, model.weights + r.normal(0, 0.05, len(model.weights)), model.bias, 0.4)
        assert value(other)[0] >= best or value(other)[1] < 0


def test_class_prior_comes_from_positives_and_unlabelled(spark):
    docs, labels = _labelled(spark)
    few = labels.where("quality = 1 or doc_id % 8 = 0")  # how negatives are labelled has no say
    for known in (labels, few, labels.where("quality = 1")):
        assert abs(pu_quality.fit(docs, known).prior - 160 / 240) < 0.08


def test_fits_agree_on_reruns_with_repeated_ids_and_names(spark):
    docs, labels = _labelled(spark)
    twice = docs.union(docs.withColumn("text", F.concat("text", F.lit(" more #")))).withColumnRenamed("lang", "label").withColumnRenamed("source", "i")
    sets = [twice.repartition(n).orderBy(F.rand(n)) for n in (3, 5)]
    one, two = (quality_rules.fit(d, labels.union(labels)) for d in sets)
    assert one == two and one
    a, b = (pu_quality.fit(d, labels.union(labels)) for d in sets)
    assert np.allclose(a.weights, b.weights, atol=1e-6) and a.prior == b.prior
