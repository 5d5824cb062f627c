import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from voltide.llm import toxicity
from voltide.llm.queries import op4_toxicity, table


def auc(score, label):
    order = np.argsort(np.argsort(score, kind="stable")) + 1
    p = label.sum()
    return (order[label].sum() - p * (p + 1) / 2) / (p * (~label).sum())


def test_held_out_accuracy(spark, medium):
    got = {r["doc_id"]: r for r in op4_toxicity(spark, medium).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, medium, "labels").collect() if r["toxic"] is not None}
    assert len(got) == table(spark, medium, "documents").count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for i, r in got.items())
    test = [(got[i]["score"], y == 1) for i, y in labels.items() if got[i]["held_out"]]
    score, label = np.array([s for s, _ in test]), np.array([y for _, y in test])
    print("auc", auc(score, label), "recall", (score[label] >= 0.7).mean(), "false", (score[~label] >= 0.7).mean())
    assert auc(score, label) >= 0.9  # a few labels are noise
    assert (score[label] >= 0.7).mean() >= 0.65 and (score[~label] >= 0.7).mean() <= 0.02


def test_hard_rows(spark, docs, none):
    labels = spark.createDataFrame([(k, 0, int(k % 4 == 0)) for k in range(80)] + [(5, None, None), (None, 1, 1), (4, 1, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.judge(docs, labels)
    assert out.count() == docs.count() and out.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.judge(docs, labels.where("false")).where("predicted = 1").count() == 0
    assert toxicity.judge(none, labels).count() == 0
    assert sorted(map(tuple, toxicity.judge(docs, labels).collect()), key=str) == sorted(map(tuple, out.collect()), key=str)


def test_risk_separates(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(500):
        toxic = k < 100 or k % 5 == 0
        words = np.unique(np.concatenate([rng.integers(100, 300, 20), rng.integers(0, 10, 5) if toxic else np.zeros(0, np.int64)]))
        rows.append((k < 100, words.tolist(), words[:2].tolist()))
    words = toxicity.telling(spark.createDataFrame(rows, "positive boolean, words array<long>, twice array<long>"), 100, 400)
    assert len(words) and set(words.tolist()) <= set(range(10))
    bags = [np.array([list(words).index(w) for w in ws if w in words], np.int64) for _, ws, _ in rows]
    weights, bias = toxicity.fit(bags, np.arange(500) < 100, 0.2, len(words))
    assert (weights > 0).all() and bias < 0


def plain_risk(weights, bias, bags, positive, prior):
    """The non-negative risk by its definition, a text at a time, and its bracket."""
    sigmoid = lambda z: 1 / (1 + math.exp(-z))
    f = [bias + sum(weights[k] for k in bag) for bag in bags]
    mean = lambda xs: sum(xs) / len(xs)
    found = mean([sigmoid(-x) for x, p in zip(f, positive, strict=True) if p])
    bracket = mean([sigmoid(x) for x, p in zip(f, positive, strict=True) if not p]) - prior * mean([sigmoid(x) for x, p in zip(f, positive, strict=True) if p])
    return prior * found + max(0.0, bracket), bracket


@pytest.mark.parametrize("prior", [0.2, 0.9])
def test_first_step_follows_the_plain_risk(monkeypatch, prior):
    """One step of the optimiser moves each weight by the rate against the slope of the risk, by finite differences; up the bracket where that is negative."""
    r = np.random.default_rng(2)
    bags = [r.integers(0, 8, r.integers(1, 6)) for _ in range(60)]
    positive = np.arange(60) < 20
    monkeypatch.setattr(toxicity, "ROUNDS", 1)
    weights, bias = toxicity.fit(bags, positive, prior, 8)
    w0, b0 = np.zeros(8), math.log(prior / (1 - prior))
    below = plain_risk(w0, b0, bags, positive, prior)[1] < 0
    value = (lambda w, b: -plain_risk(w, b, bags, positive, prior)[1]) if below else (lambda w, b: plain_risk(w, b, bags, positive, prior)[0])
    for k in range(9):
        step = np.eye(9)[k] * 1e-5
        slope = (value(w0 + step[:8], b0 + step[8]) - value(w0 - step[:8], b0 - step[8])) / 2e-5
        moved = (weights[k] if k < 8 else bias - b0) / toxicity.RATE
        assert abs(slope) < 1e-7 or moved == pytest.approx(-np.sign(slope), abs=1e-3)


def test_scores_against_plain_sums(spark, docs, rows):
    words = sorted({w for _, t, *_ in rows[:40] for w in re.findall(r"[^\W\d_]+", (t or "").lower())})[:50]
    key = lambda w: int(toxicity._word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))[0][0])
    weight = {w: (k % 7 - 3) / 3 for k, w in enumerate(words)}
    order = sorted(words, key=key)
    model = {"words": np.array([key(w) for w in order], np.uint64), "weights": np.array([weight[w] for w in order]), "bias": -1.0}
    got = sorted((str(r["doc_id"]), round(r["score"], 9)) for r in toxicity.score(docs, model).collect())
    plain = lambda t: 1 / (1 + math.exp(-max(-30, min(30, -1 + sum(weight.get(w, 0) * min(n, 2) for w, n in Counter(re.findall(r"[^\W\d_]+", (t or "").lower())).items())))))
    assert got == sorted((str(r[0]), round(plain(r[1]), 9)) for r in rows)


def test_a_repeated_id_does_not_outgrow_the_sample(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "POSITIVES", 40)
    monkeypatch.setattr(toxicity, "UNLABELLED", 80)
    seen = []
    fit = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda bags, positive, *a: seen.append((int(positive.sum()), len(bags))) or fit(bags, positive, *a))
    base = spark.range(2000).selectExpr("id AS doc_id", "concat(if(id % 5 = 0, 'vile wretched worthless ', 'kind '), 'text number ', CAST(id AS string)) AS text")
    often = spark.range(30_000).selectExpr("5L AS doc_id", "concat('vile wretched worthless copy ', CAST(id % 3000 AS string)) AS text")
    labels = spark.range(2000).selectExpr("id AS doc_id", "CAST(id % 5 = 0 AS int) AS toxic")
    toxicity.train(base.unionByName(often), labels)
    toxicity.train(base, labels)
    assert all(0 < p <= 50 and n - p <= 100 for p, n in seen) and len(seen) == 2
