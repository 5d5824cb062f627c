import hashlib
import math
import random
from collections import Counter

import numpy as np

from voltide.llm import fingerprints as fp
from voltide.llm.queries import op13_document_fingerprints


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest()))


def plain(rows):
    sampler, out = fp.Sampler(), []
    rows = [(i, t or "") for i, t in ordered(rows)]
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        n = len(t) // 4
        changed = t[: len(t) - n] + following[:n]
        own, other, then = (fp.written_out(sampler.signature(sampler.least(*sampler.terms(sampler.words(x))))) for x in (t, changed, following))
        out.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), own, other, fp.likeness(own, other), fp.likeness(own, then)))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_against_brute_force(docs, rows, none, spark):
    assert got(fp.fingerprints(docs)) == plain([(r[0], r[1]) for r in rows])
    assert fp.fingerprints(none).count() == 0
    one = spark.createDataFrame([(3, "only a few words here")], "doc_id long, text string")
    assert got(fp.fingerprints(one)) == plain([(3, "only a few words here")])


def test_equal_texts_equal_fingerprints(docs):
    seen = {}
    for r in docs.select("doc_id", "text").join(fp.fingerprints(docs), "doc_id").where("doc_id < 60").collect():
        assert seen.setdefault(r["text"], r["fingerprint"]) == r["fingerprint"]


def plain_sample(weights, term_key, samples):
    """The sample by the formulas, one term at a time, from a generator of its own for each term and sample."""
    out = []
    for k in range(samples):
        best = None
        for term, w in weights.items():
            r = np.random.default_rng([term_key[term], k])
            g, c, b = r.gamma(2), r.gamma(2), r.random()
            t = math.floor(math.log(w) / g + b)
            a = math.log(c) - g * (t - b) - g
            best = min(best or (math.inf, 0, 0), (a, term, t))
        out.append(best[1:])
    return out


def test_collisions_are_generalised_jaccard():
    """The vectorised sampler and a plain one with other random numbers both meet the exact ratio of minima to maxima."""
    r = random.Random(1)
    for share in (0.9, 0.5, 0.1):
        names = list(range(60))
        a = {n: r.randint(1, 9) for n in names}
        b = {n if r.random() < share else n + 1000: max(1, w + r.randint(-2, 2)) for n, w in a.items()}
        exact = sum((Counter(a) & Counter(b)).values()) / sum((Counter(a) | Counter(b)).values())
        sampler = fp.Sampler(4000)
        hashes = {n: int(fp._mixed(np.array([n + 1], np.uint64))[0]) for n in {*a, *b}}
        sign = lambda x: sampler.signature(sampler.least(np.array([hashes[n] for n in x], np.uint64), np.array(list(x.values()))))
        assert abs((sign(a) == sign(b)).mean() - exact) < 0.03
        x, y = plain_sample(a, {n: n for n in {*a, *b}}, 400), plain_sample(b, {n: n for n in {*a, *b}}, 400)
        assert abs(sum(p == q for p, q in zip(x, y, strict=True)) / 400 - exact) < 0.09


def test_pair_is_two_signatures():
    sampler = fp.Sampler()
    for a, b in (("", ""), ("a", ""), ("", "b c"), ("a b a b c", "a b c d"), ("x y z " * 50, "x y z " * 40 + "u v w " * 9), ("語" * 200, "語" * 150 + "é" * 50)):
        own, other = sampler.pair(a, b)
        for text, s in ((a, own), (b, other)):
            assert (s == sampler.signature(sampler.least(*sampler.terms(sampler.words(text))))).all()
    assert (sampler.pair("", " \n")[0] == sampler.pair("", " \n")[1]).all()


def test_query(spark, small):
    table = spark.read.parquet(f"{small}/documents.parquet")
    rows = [tuple(r) for r in table.select("doc_id", "text").collect()]
    found = op13_document_fingerprints(spark, small)
    assert got(found) == plain(rows)
    near = [(r["near_edited"], r["near_next"]) for r in found.where("n_chars > 400").collect()]
    assert np.mean([e for e, _ in near]) > 0.5 and np.mean([n for _, n in near]) < 0.15 and sum(e > n for e, n in near) > 0.95 * len(near)
