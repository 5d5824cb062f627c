import random
import re

import numpy as np
import pytest

from voltide.llm import jaccard_join
from voltide.llm.queries import op10_ngram_jaccard_join, table


def brute_force(rows, width=5, threshold=0.8):
    """(doc_id, text_class, class_id, n_copies, n_links) of each row, from all pairs."""
    rank = lambda i: -1 if i is None else i
    texts = {}
    for i, t in rows:
        texts.setdefault(t or "", []).append(rank(i))
    sets = {}
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        sets[t] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    root, links = {t: t for t in texts}, dict.fromkeys(texts, 0)

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    names, holders = list(texts), {}
    for t in names:
        for s in sets[t]:
            holders.setdefault(s, []).append(t)
    for a in names:
        shared = {}
        for s in sets[a]:
            for b in holders[s]:
                if b is not a:
                    shared[b] = shared.get(b, 0) + 1
        for b, n in shared.items():
            if n >= threshold * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
                links[a] += 1
                root[find(a)] = find(b)
    least = {}
    for t, ids in texts.items():
        least[find(t)] = min(least.get(find(t), 1 << 60), *ids)
    return sorted(((i, min(texts[t or ""]), least[find(t or "")], len(texts[t or ""]), links[t or ""]) for i, t in rows), key=str)


def got(df):
    return sorted((tuple(r[k] for k in ("doc_id", "text_class", "class_id", "n_copies", "n_links")) for r in df.collect()), key=str)


def test_query(spark, medium):
    rows = [tuple(r) for r in table(spark, medium, "documents").select("doc_id", "text").collect()]
    assert got(op10_ngram_jaccard_join(spark, medium)) == brute_force(rows)


def test_hard_rows(docs, rows, none):
    assert got(jaccard_join.near_duplicates(docs)) == brute_force([r[:2] for r in rows])
    assert jaccard_join.near_duplicates(none).count() == 0


@pytest.mark.parametrize("block", [2, 5])
def test_large_groups_in_blocks(spark, monkeypatch, block):
    base = [f"w{k}" for k in range(80)]
    rows = [(k, " ".join([*base[: 40 + k % 3], f"own{k}", *base[43:]])) for k in range(25)] + [(100 + k, " ".join(base)) for k in range(9)]
    monkeypatch.setattr(jaccard_join, "BUCKET_BLOCK", block)
    monkeypatch.setattr(jaccard_join, "CLUSTER_BLOCK", block)
    assert got(jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_force(rows)


def test_one_of_each_class(docs, rows):
    stay = jaccard_join.one_of_each_class(docs)
    want = {c for _, _, c, _, _ in brute_force([r[:2] for r in rows])}
    assert stay.columns == docs.columns and sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in stay.collect()) == sorted(want)


def test_prefix_is_shortened_until_recall():
    d = jaccard_join.prefix_length(0.8, 20, 7, 0.9999)
    assert 1 - (1 - 0.8**d) ** 20 >= 0.9999 and (d == 7 or 1 - (1 - 0.8 ** (d + 1)) ** 20 < 0.9999)


def test_trie_joins_what_all_pairs_do():
    r = np.random.default_rng(2)
    for least in (0.0, 0.75):
        n = 60
        group = np.sort(r.integers(0, 4, n))
        cross = group == 3
        side = np.where(cross, r.integers(0, 2, n), 0)
        rest = sum(r.integers(0, 2, n).astype(np.uint64) << np.uint64(16 * k) for k in range(3))
        order = np.lexsort((rest, side, group))
        group, cross, side, rest = group[order], cross[order], side[order], rest[order]
        doc, sk = np.arange(n), r.integers(0, 2, (n, 4)).astype(np.uint8)
        trie = jaccard_join.Trie(group, cross, side, rest, doc, sk, least)
        label = trie.join(3)
        root = np.arange(n)
        pairs = [(i, j) for i in range(n) for j in range(i) if group[i] == group[j] and (sk[i] == sk[j]).mean() >= least]
        for _ in range(n):
            for i, j in pairs:
                root[i] = root[j] = min(root[i], root[j])
        assert label.tolist() == root.tolist()
        assert trie.compared < sum(group[i] == group[j] for i in range(n) for j in range(i))


def test_near_copies_are_compared_once():
    n = 500
    trie = jaccard_join.Trie(np.zeros(n, int), np.zeros(n, bool), np.zeros(n, int), np.sort(np.arange(n).astype(np.uint64) % np.uint64(7)), np.arange(n), np.ones((n, 100), np.uint8), 0.6)
    assert not trie.join(3).any() and trie.compared == n - 1


def test_recall_at_the_threshold(spark):
    """Pairs just above the threshold: none is lost to the forest or to the sketches."""
    r = random.Random(8)
    rows, want = [], 0
    for k in range(400):
        base = [f"{k}x{i}" for i in range(204)]
        near = list(base)
        for i in r.sample(range(0, 200, 5), 4):  # 4 words of 5 shingles each: 180 of 220 in common
            near[i + 2] = f"y{i}"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(near))]
        sets = [{tuple(w[i : i + 5]) for i in range(200)} for w in (base, near)]
        want += 2 * (len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for slack in (0.2, 0.8):
        assert sum(x["n_links"] for x in jaccard_join.near_duplicates(docs, slack=slack).collect()) == want > 700
