import random
import re
from collections import Counter

import duckdb

from voltide.llm import collocations
from voltide.llm.queries import op11_collocations


def plain(rows, max_n, least, share, top):
    """Brute force over lists of words and Python's integers."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, max_n + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    held = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, p), a in held.items():
        around = (b for (other, q), b in held.items() if other == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)))
        if any(100 * b >= share * a for b in around):
            continue
        score, _, left, right = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top]))


def random_rows(seed, rows):
    r = random.Random(seed)
    vocabulary = ["a", "B", "c", "É", "é", "zz", "the", "THE"]
    space, end = [" ", "\t", "  "], [". ", ",", "\n", "!?", "\x0b", ""]
    text = lambda: "".join(r.choice(vocabulary) + (r.choice(end) if r.random() < 0.15 else "") + r.choice(space) for _ in range(r.randint(0, 60)))
    return [(r.choice(["en", "de", None, "und"]), None if r.random() < 0.05 else text()) for _ in range(rows)]


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_against_brute_force(spark, monkeypatch):
    for seed, max_n, least, share, top in ((1, 3, 10, 50, 2000), (2, 4, 4, 60, 7), (3, 2, 3, 50, 2000)):
        rows = random_rows(seed, 60)
        docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
        assert got(collocations.collocations(docs, max_n, least, share, top)) == plain(rows, max_n, least, share, top)
    monkeypatch.setattr(collocations, "BLOCK", 5)  # pieces in several blocks
    monkeypatch.setattr(collocations, "FILTER_BITS", 64)  # a filter that holds nearly all
    rows = random_rows(4, 60)
    assert got(collocations.collocations(spark.createDataFrame(rows, "lang string, text string"))) == plain(rows, 3, 10, 50, 2000)


def test_hard_rows(docs, rows, none):
    assert got(collocations.collocations(docs.withColumnRenamed("size", "phrase").withColumnRenamed("h", "f"))) == plain([(r[2], r[1]) for r in rows], 3, 10, 50, 2000)
    assert collocations.collocations(none).count() == 0


def test_products_past_64_bits(spark):
    counted = spark.createDataFrame([("en", "a", 1, 10**14 + 7), ("en", "b", 1, 10**14 + 9), ("en", "a b", 2, 10**14 + 3)], "lang string, phrase string, words int, f long")
    assert collocations.scored(counted, 10, 50).first()["score"] == 10**6 * (10**14 + 3) ** 2 // ((10**14 + 7) * (10**14 + 9))


def test_query_against_sql(spark, small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    assert got(op11_collocations(spark, small)) == sorted(con.execute(collocations.SQL).fetchall())
