import random

import numpy as np
from tidemark.llm import mixing as M


def corpus(spark, n=900):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        k = r.random()
        lang, bad = ("en" if k < 0.7 else "de"), r.random() < 0.3
        base = ["the", "of", "and", "that", "with"] if lang == "en" else ["der", "und", "nicht", "mit", "das"]
        w = [r.choice(base) + (r.choice(["", "a", "b", "c"])) for _ in range(r.randint(5, 80))]
        rows.append((i, " ".join(x + "###" if bad else x for x in w), lang))
        if i % 2:
            labels.append((i, int(not bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")


DOMAIN = "concat(lang, if(quality = 1, '_good', '_plain'))"
NAMES = ("en_good", "en_plain", "de_good", "de_plain")
WEIGHTS = [0.5, 0.05, 0.42, 0.03]


def test_targets_are_met_and_rates_agree_with_plain_numpy(spark):
    docs, labels = corpus(spark)
    rated, report = M.mix(docs, labels, DOMAIN, NAMES, WEIGHTS)
    rows = rated.collect()
    t, p, r = (np.array([x[c] for x in rows]) for c in ("mix_tokens", "mix_p", "mix_rate"))
    reached = (t * r) @ p
    assert np.allclose(reached, t.sum() * np.array(WEIGHTS), rtol=2e-3, atol=5) and (r >= 0).all() and len(rows) == 900
    assert np.allclose(reached, report["reached"])
    # the rates nearest to 1 (each weighed by its tokens) that meet the targets: 1 + p . nu, cut at 0
    goal, nu = t.sum() * np.array(WEIGHTS), np.zeros(4)
    for _ in range(200):
        raw = 1 + p @ nu
        nu += 0.5 * np.linalg.solve((p * (t * (raw >= 0))[:, None]).T @ p, goal - (t * np.maximum(0, raw)) @ p)
    assert np.allclose(np.maximum(0, 1 + p @ nu), r, atol=0.02)


def test_posteriors_know_the_domains(spark):
    docs, labels = corpus(spark)
    rated, _ = M.mix(docs, labels, DOMAIN, NAMES, WEIGHTS)
    truth = {r.doc_id: f"{r.lang}_{'plain' if '###' in r.text else 'good'}" for r in docs.collect()}
    hits = [NAMES[int(np.argmax(r.mix_p))] == truth[r.doc_id] for r in rated.collect()]
    assert np.mean(hits) > 0.98


def test_floor_only_adds(spark):
    docs, labels = corpus(spark)
    rated, report = M.mix(docs, labels, "if(quality = 1, 'good', 'plain')", ("plain", "good"), [0.1, 0.9], floor=1.0, keep=True)
    rows = rated.collect()
    assert min(r.mix_rate for r in rows) >= 1 and min(r.mix_copies for r in rows) >= 1 and {"text", "lang"} <= set(rated.columns)
    assert (report["reached"] >= report["start"] - 1e-6).all() and max(r.mix_rate for r in rows) < 10
    assert np.allclose(report["reached"], report["target"], rtol=0.02)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "en", 1), (1, None, "en", 1), (None, "a b", None, 2), (3, "word " * 100_000, "en", 3)], "doc_id long, text string, lang string, y int")
    labels = spark.createDataFrame([(None, 1), (3, None), (1, 1)], "doc_id long, quality int")
    rows = M.mix(docs, labels, DOMAIN, NAMES, WEIGHTS)[0].collect()
    assert len(rows) == 4 and all(r.mix_rate >= 0 and r.mix_copies >= 0 for r in rows) and max(r.mix_tokens for r in rows) == 100_000
    assert M.mix(docs.limit(0), labels, DOMAIN, NAMES, WEIGHTS)[0].collect() == []


def test_missed_targets_are_told(spark, caplog):
    members = spark.createDataFrame([(10, [1.0, 0.0])] * 5, "mix_tokens long, mix_p array<double>")
    _, report = M.fit_rates(members, [0.5, 0.5])  # nothing is of the second domain
    assert not report["met"] and "every rate stays 1" in caplog.text
    caplog.clear()
    far = members.unionByName(spark.createDataFrame([(10, [0.0, 1.0])] * 15, members.schema))
    _, report = M.fit_rates(far, [0.5, 0.5], steps=0)
    assert not report["met"] and "missed" in caplog.text
    caplog.clear()
    both = members.unionByName(spark.createDataFrame([(10, [0.0, 1.0])] * 15, members.schema))
    _, report = M.fit_rates(both, [0.5, 0.5])
    assert report["met"] and not caplog.text and np.allclose(report["reached"], report["target"], rtol=1e-3)


def test_without_labels_or_with_one_kind_every_rate_is_one(spark):
    docs, _ = corpus(spark, 200)
    some = [[], [(i, 1) for i in range(50)]]
    for rows in some:
        labels = spark.createDataFrame(rows, "doc_id long, quality int")
        for floor in (0.0, 1.0):
            rated, report = M.mix(docs, labels, "if(quality = 1, 'good', 'plain')", ("plain", "good"), [0.1, 0.9], floor=floor, keep=True)
            got = rated.collect()
            assert len(got) == 200 and {r.mix_rate for r in got} == {1.0} and {r.mix_copies for r in got} == {1} and not report["met"]


def test_rates_stay_within_their_bounds(spark):
    members = spark.createDataFrame([(10, [1.0, 0.0])] * 95 + [(10, [0.0, 1.0])] * 5, "mix_tokens long, mix_p array<double>")
    slope, report = M.fit_rates(members, [0.5, 0.5], floor=1.0, ceiling=4.0)
    rates = {r[0] for r in members.select(M._rate(slope, 1.0, 4.0)[0]).collect()}
    assert max(rates) == 4.0 and min(rates) >= 1.0 and not report["met"]


def test_a_domain_without_documents_leaves_the_targets(spark):
    members = spark.createDataFrame([(10, [1.0, 0.0, 0.0])] * 5 + [(10, [0.0, 1.0, 0.0])] * 15, "mix_tokens long, mix_p array<double>")
    _, report = M.fit_rates(members, [0.4, 0.4, 0.2])
    assert report["met"] and np.allclose(report["reached"], [100, 100, 0], rtol=1e-3)


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(i, "word " * (i + 3), "en", 7, 8) for i in range(20)], "doc_id long, text string, lang string, mix_tokens int, quality int")
    labels = spark.createDataFrame([(i, i % 2, "xx", "no", 1) for i in range(20)], "doc_id long, quality int, lang string, text string, y int")
    rated, _ = M.mix(docs, labels, DOMAIN, NAMES, WEIGHTS, keep=True)
    assert sorted((r.doc_id, r.mix_tokens, r.quality) for r in rated.collect()) == [(i, i + 3, 8) for i in range(20)]
