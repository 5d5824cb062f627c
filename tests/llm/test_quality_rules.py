import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from voltide.llm import quality_rules
from voltide.llm.queries import op8_quality_rules, table


def expected(doc_id, text):
    text = text or ""
    words = [(m[0], m.start()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    tokens = [w for w, _ in words]
    grams = Counter(tuple(tokens[k : k + 5]) for k in range(len(tokens) - 4))
    hit = {k + j for k in range(len(tokens) - 4) if grams[tuple(tokens[k : k + 5])] > 1 for j in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(tokens)
    return doc_id, n, sum(map(len, tokens)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(hit), n < 10 or 100 * len(hit) > 20 * n


def test_query(spark, medium):
    got = op8_quality_rules(spark, medium).collect()
    texts = {r["doc_id"]: r["text"] for r in table(spark, medium, "documents").collect()}
    assert sorted(tuple(r)[:7] for r in got) == sorted(expected(i, t) for i, t in texts.items())
    quality = {r["doc_id"]: r["quality"] for r in table(spark, medium, "labels").collect()}
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert not any(r["kept"] and r["base_failed"] for r in got)
    good = np.mean([kept[i] for i, q in quality.items() if q == 1])
    bad = np.mean([kept[i] for i, q in quality.items() if q == 0])
    assert good > 0.9 and bad < 0.5


def test_hard_rows(spark, docs, rows, none):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(60)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    out = quality_rules.judge(docs, labels)
    key = lambda r: (str(r[0]), r[1:])
    assert sorted((tuple(r)[:7] for r in out.collect()), key=key) == sorted((expected(*r[:2]) for r in rows), key=key)
    assert quality_rules.judge(none, labels).count() == 0
    assert quality_rules.judge(docs, labels.where("false")).where("kept is null or kept = base_failed").count() == 0


def test_covering_finds_a_conjunction():
    r = np.random.default_rng(3)
    x = {"a": r.random(3000), "b": r.random(3000)}
    bad = ((x["a"] > 0.8) & (x["b"] < 0.5)) | (x["b"] > 0.95)
    rules = quality_rules.learn(x, bad)
    found = np.zeros(3000, bool)
    for rule in rules:
        found |= quality_rules._holds(x, rule)
    assert (found == bad).mean() > 0.97


def test_a_repeated_id_does_not_outgrow_the_sample(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "SAMPLE_ROWS", 300)
    seen = []
    monkeypatch.setattr(quality_rules, "learn", lambda x, bad: seen.append(len(bad)) or [])
    text = "concat_ws(' ', transform(sequence(1, CAST(pmod(hash(id), 60) + 5 AS int)), x -> concat('w', CAST(x * id % 97 AS string))))"
    base = spark.range(1000).selectExpr("id AS doc_id", f"{text} AS text")
    ids = [r["doc_id"] for r in base.where("pmod(xxhash64(doc_id, 3), 1000000) < 300000").limit(2).collect()]
    often = spark.range(30_000).selectExpr(f"{ids[0]}L AS doc_id", f"{text} AS text").unionByName(spark.range(30_000).selectExpr(f"{ids[1]}L AS doc_id", "'one text for all of these rows' AS text"))
    labels = spark.range(1000).selectExpr("id AS doc_id", "CAST(id % 2 AS int) AS quality")
    quality_rules.train(base, labels)
    quality_rules.train(base.unionByName(often), labels)
    assert 200 < seen[0] <= 300 and seen[1] == 300


def test_verdict_against_plain_reading(docs):
    """Rules, read one after another in Python on the ratios of each row."""
    both = [[("symbol_share", ">=", 0.01)], [("repeat_share", ">=", 0.3), ("dup_line_share", "<=", 0.2)], [("mean_word", "<=", 3.0), ("n_words", ">=", 2.0), ("digit_share", "<=", 0.5)]]
    table_ = quality_rules.statistics(docs)
    ratios = table_.select("doc_id", *(F.expr(sql).alias(f"r_{k}") for k, sql in quality_rules.RATIOS.items()), quality_rules.verdict(both).alias("kept")).collect()
    compare = {"<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, ">": lambda a, b: a > b}
    for r in ratios:
        hit = any(all(r[f"r_{n}"] is not None and compare[op](r[f"r_{n}"], v) for n, op, v in rule) for rule in both)
        assert r["kept"] == (not hit)
    assert 0 < sum(r["kept"] for r in ratios) < len(ratios)
