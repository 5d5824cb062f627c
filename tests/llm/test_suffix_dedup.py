import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from voltide.llm import suffix_dedup
from voltide.llm.queries import op1_suffix_array_dedup, table


def expected(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    out = []
    for (doc_id, _), raw, spans in zip(rows, texts, suffix_dedup.brute_force(texts, length), strict=True):
        keep = np.ones(len(raw), bool)
        for a, z in spans:
            keep[a:z] = False
        kept = bytes(np.frombuffer(raw, np.uint8)[keep])
        out.append((doc_id, len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("length", [400, 37])
def test_hard_rows(docs, rows, length):
    assert Counter(map(tuple, suffix_dedup.digest(docs, length).collect())) == expected([r[:2] for r in rows], length)


@pytest.mark.parametrize("length", [400, 37])
def test_large_groups_are_dealt_again(docs, rows, monkeypatch, length):
    monkeypatch.setattr(suffix_dedup, "GROUP_LIMIT", 1)
    assert Counter(map(tuple, suffix_dedup.digest(docs, length).collect())) == expected([r[:2] for r in rows], length)


def test_query(spark, medium):
    rows = [tuple(r) for r in table(spark, medium, "documents").select("doc_id", "text").collect()]
    assert Counter(map(tuple, op1_suffix_array_dedup(spark, medium).collect())) == expected(rows, 400)


def test_empty_table(none):
    assert suffix_dedup.digest(none).count() == 0


def test_first_place_stays(spark):
    passage = hashlib.shake_128(b"passage").hexdigest(250)
    docs = spark.createDataFrame([(1, f"one {passage}", 7), (2, passage, 8), (3, f"{passage} THREE:{passage}", 9)], "doc_id long, text string, kept int")
    out = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(docs, 400, "first").collect()}
    assert bytes(out[1]["kept"]).decode() == f"one {passage}"
    assert bytes(out[2]["kept"]) == b""
    assert bytes(out[3]["kept"]).decode() == " THREE:"


def joined(parts):
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])


def test_longest_previous_factors():
    r = random.Random(1)
    for alphabet in ("ab", "abc", "a"):
        parts = ["".join(r.choice(alphabet) for _ in range(r.randint(1, 40))).encode() for _ in range(6)]
        parts += parts[:2] + [b"aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"]
        buf, off = joined(parts)
        place = [(k, p) for k, x in enumerate(parts) for p in range(len(x))]
        shared = lambda x, y: next((n for n, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), min(len(x), len(y)))
        tails = [parts[k][p:] for k, p in place]
        for later in (False, True):
            want = [max((shared(tails[i], tails[j]) for j in (range(i + 1, len(tails)) if later else range(i))), default=0) for i in range(len(tails))]
            for units in (buf, buf.astype(np.uint64) << np.uint64(40)):
                assert suffix_dedup.SuffixOrder(units, off).factors(later=later).tolist() == want
                assert suffix_dedup.SuffixOrder(units, off).factors(5, later).tolist() == [x if x >= 5 else 0 for x in want]


def test_nearest_smaller():
    r = np.random.default_rng(4)
    for x in (r.permutation(300), np.arange(50), np.arange(50)[::-1], np.append(np.arange(1, 50), 0), r.integers(0, 5, 60)):
        assert suffix_dedup.nearest_smaller(x).tolist() == [max((j for j in range(i) if x[j] <= x[i]), default=-1) for i in range(len(x))]


def test_runs():
    parts = joined([b"abcdefgh" * 3, b"xxabcdefghyy"])
    assert [x.tolist() for x in suffix_dedup.factor_runs(*parts, 8, True)] == [[0, 1], [0, 2], [24, 10]]
    assert [x.tolist() for x in suffix_dedup.factor_runs(*parts, 8, False)] == [[0, 1], [8, 2], [24, 10]]


def test_cut_characters_go(spark):
    passage = hashlib.shake_128(b"other").hexdigest(250)
    docs = spark.createDataFrame([(1, f"é{passage}ä"), (2, f"ë{passage}ö")], "doc_id long, text string")
    out = {r["doc_id"]: r["kept"] for r in suffix_dedup.remove_repeats(docs, 400, "first", as_text=True).collect()}
    assert out == {1: f"é{passage}ä", 2: "ë"}


def removed_by_brute_force(rows, length):
    """What is left of each text without later places of strings of ``length`` words, punctuation around words apart."""
    seen, left = set(), []
    for _, text in rows:
        raw = (text or "").encode()
        found = [(m.start(), m.end(), re.sub(rb"^[^0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff]+$", b"", m[0]) or m[0]) for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
        cut = np.zeros(len(found), bool)
        for k in range(len(found) - length + 1):
            key = tuple(w for _, _, w in found[k : k + length])
            if key in seen:
                cut[k : k + length] = True
            seen.add(key)
        gone = np.zeros(len(raw), bool)
        for k in np.flatnonzero(cut):
            gone[found[k][0] : found[k + 1][0] if k + 1 < len(found) and cut[k + 1] else found[k][1]] = True
        left.append(np.frombuffer(raw, np.uint8)[~gone].tobytes().decode("utf-8", "ignore"))
    return left


@pytest.mark.parametrize("limit", [2000, 1])
def test_passages_of_over_50_short_words(spark, monkeypatch, limit):
    monkeypatch.setattr(suffix_dedup, "GROUP_LIMIT", limit)
    r = random.Random(3)
    prose = lambda n, size: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(1, size))) for _ in range(n))
    planted = [prose(n, size) for n in (51, 55, 60, 70) for size in (1, 3, 5)]
    short = [prose(n, 9) for n in (30, 45, 50)]
    assert max(map(len, planted)) < 400 and len(short[-1]) > 200
    texts = [x for p in planted for x in (f"{prose(20, 9)} {p} {prose(20, 9)}", f"{prose(5, 9)} ({p}). {prose(9, 9)}", p)]
    texts += [f"{prose(20, 9)} {k}left {p} {k}right {prose(20, 9)}" for p in short for k in range(2)] + [f"{prose(4, 9)} {short[0]} {short[1]} {prose(4, 9)}"]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: x["kept"] for x in suffix_dedup.remove_repeats(docs, 51, "first", as_text=True, unit="words").collect()}
    n = len(planted)
    for k, p in enumerate(planted):
        assert got[3 * k] == texts[3 * k] and p not in got[3 * k + 1] and got[3 * k + 2] == ""
    assert [got[k] for k in range(3 * n, len(texts))] == texts[3 * n :]  # also where two short repeats touch
    assert [got[k] for k in range(len(texts))] == removed_by_brute_force(rows, 51)


@pytest.mark.parametrize("limit", [2000, 1])
def test_passages_of_hard_rows(docs, rows, monkeypatch, limit):
    monkeypatch.setattr(suffix_dedup, "GROUP_LIMIT", limit)
    known = docs.where("doc_id >= 0").dropDuplicates(["doc_id"])
    want = sorted(((i, t) for i, t in {r[0]: r[1] for r in rows if r[0] is not None and r[0] >= 0}.items()), key=lambda r: r[0])
    got = {x["doc_id"]: x["kept"] for x in suffix_dedup.remove_repeats(known, 20, "first", as_text=True, unit="words").collect()}
    left = removed_by_brute_force(want, 20)
    assert got == {i: x for (i, _), x in zip(want, left, strict=True)}


def test_words_of_documents(spark, medium):
    rows = sorted(tuple(r) for r in table(spark, medium, "documents").select("doc_id", "text").collect())
    got = {x["doc_id"]: x["kept"] for x in suffix_dedup.remove_repeats(table(spark, medium, "documents"), 51, "first", as_text=True, unit="words").collect()}
    assert [got[i] for i, _ in rows] == removed_by_brute_force(rows, 51)
