import numpy as np

from voltide.llm import ann_forest
from voltide.llm.queries import op2_ann_forest, table


def test_recall_and_scores(spark, medium):
    rows = sorted((r["vec_id"], r["embedding"]) for r in table(spark, medium, "embeddings").collect())
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    found = {}
    for r in op2_ann_forest(spark, medium).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    asked = [i for i in ids if i % 20 == 0]
    assert sorted(found) == asked
    hits = 0
    for i in asked:
        got = sorted(found[i])
        assert [g[0] for g in got] == list(range(1, 21))
        assert [(-g[2], g[1]) for g in got] == sorted((-g[2], g[1]) for g in got)
        for _, j, s in got:
            assert j != i and abs(s - float((x[ids == i][0] * x[ids == j][0]).sum())) < 1e-9
        s = x @ x[ids == i][0]
        top = {int(ids[j]) for j in [j for j in np.lexsort((ids, -s)) if ids[j] != i][:20]}
        hits += len(top & {g[1] for g in got})
    assert hits / (20 * len(asked)) >= 0.9


def test_bad_vectors_and_ties(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], "x"), (1, [1.0, 0.0], "x"), (2, [1.0, 0.0], "x"), (3, [0.5, 0.0], "x"), (4, [0.0, 0.0], "x"), (5, None, "x"), (6, [nan, 1.0], "x"), (7, [inf, 1.0], "x"), (8, [None, 1.0], "x"), (None, [1.0, 1.0], "x"), (20, [-1.0, 0.0], "x"), (9, [], "x")]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = [tuple(r) for r in ann_forest.nearest(v, v.where("vec_id % 20 = 0"), 3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 3, 0.5), (20, 1, 3, -0.5), (20, 2, 0, -1.0), (20, 3, 1, -1.0)]


def test_empty(spark):
    v = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann_forest.nearest(v, v).count() == 0


def test_several_shards_and_blocks_against_brute_force(spark, monkeypatch):
    v = table(spark, "/root/testdata/sf0.1", "embeddings")
    monkeypatch.setattr(ann_forest, "SHARD", 250)
    monkeypatch.setattr(ann_forest, "QUERIES", 9)
    found = {}
    for r in ann_forest.nearest(v, v.where("vec_id % 20 = 0"), 20).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    rows = v.collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float64)
    hits = 0
    for q in ids[ids % 20 == 0]:
        s = np.where(ids == q, -np.inf, x @ x[ids == q][0])
        hits += len(found[q] & set(ids[np.argsort(-s)[:20]].tolist()))
    assert len(found) == 100 and hits / 2000 >= 0.9


def search(x, queries, k=20):
    top = np.sqrt((x * x).sum(axis=1)).max()
    exact = queries @ x.T
    cos = -np.sort(-exact, axis=1)[:, k - 1] / (np.sqrt((queries * queries).sum(axis=1)) * top)
    forest = ann_forest.Forest(x, top)
    query, row = forest.search(queries, ann_forest.depth_for(cos), k)
    hits = sum(len(set(row[query == n].tolist()) & set(np.argsort(-exact[n])[:k].tolist())) for n in range(len(queries)))
    return hits / k / len(queries), forest.scored / len(queries) / len(x)


def test_few_rows_are_scored(spark):
    r = np.random.default_rng(3)
    centres = r.standard_normal((100, 32))
    x = np.repeat(centres, 40, axis=0) + 0.3 * r.standard_normal((4000, 32))
    recall, share = search(x / np.linalg.norm(x, axis=1)[:, None], centres[:50])
    assert recall >= 0.9 and share < 0.1
    x = np.array([r["embedding"] for r in table(spark, "/root/testdata/sf0.1", "embeddings").collect()], np.float64)  # directions at random, the hardest case
    recall, share = search(x, x[:60])
    assert recall >= 0.9 and share < 0.8


def test_likeliest_patterns():
    r = np.random.default_rng(2)
    for n in (1, 3, 6):
        same = r.uniform(0.5, 0.99, n)
        p = [np.prod([same[j] if not m >> (n - 1 - j) & 1 else 1 - same[j] for j in range(n)]) for m in range(1 << n)]
        order = ann_forest.likeliest(same, 1.1)
        assert sorted(order) == list(range(1 << n)) and np.allclose([p[m] for m in order], sorted(p, reverse=True))
        few = ann_forest.likeliest(same, 0.7)
        assert sum(p[m] for m in few) >= 0.7 > sum(p[m] for m in few[:-1])


def test_repeated_ids_and_equal_vectors(spark):
    rows = [(k, [1.0, 0.0]) for k in range(1, 60)] + [(0, [1.0, 0.5]), (0, [1.0, 0.5]), (0, [0.5, 9.0]), (77, [1.0, 2.0, 3.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = [tuple(r) for r in ann_forest.nearest(v, v.where("vec_id in (0, 3, 77)"), 3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 0.5), (0, 2, 2, 0.5), (0, 3, 3, 0.5), (3, 1, 1, 1.0), (3, 2, 2, 1.0), (3, 3, 4, 1.0)]


def plain_ascent(forest, x, top, q, depth, k):
    """The same search without sorted arrays: rows by the longest prefix that they share with the query in any tree."""
    keys, asked = forest.strings(ann_forest.lifted(x, top)), forest.strings(ann_forest.unit(q))
    out, lengths = set(), []
    for n in range(len(q)):
        shared = np.array([[ann_forest.BITS - int(a ^ b).bit_length() for a, b in zip(keys[:, j], asked[:, n], strict=True)] for j in range(len(x))]).max(axis=1)
        score, level = x @ q[n], int(shared.max())
        while True:
            met = np.sort(score[shared >= level])[::-1]
            if level == 0 or len(met) >= k and level <= max(depth[n], ann_forest.depth_for(met[k - 1] / np.linalg.norm(q[n]) / top)):
                break
            level -= 1
        lengths.append((int(shared.max()), level))
        least = met[min(k, len(met)) - 1]
        out |= {(n, int(j)) for j in np.flatnonzero((shared >= level) & (score >= least - 1e-9 * (1 + abs(least))))}
    return out, lengths


def test_descent_and_ascent_against_a_plain_search(monkeypatch):
    r = np.random.default_rng(5)
    monkeypatch.setattr(ann_forest, "TREES", 16)
    near = r.standard_normal((4, 8)).repeat(20, axis=0) + 0.02 * r.standard_normal((80, 8))
    x = np.concatenate([near, r.standard_normal((120, 8)), near[:1]])
    q = np.concatenate([near[::20] + 0.01, r.standard_normal((8, 8))])
    top = np.sqrt((x * x).sum(axis=1)).max()
    for k, depth, gathered, head in ((5, np.zeros(len(q), int), 1 << 22, 12), (5, np.full(len(q), 4), 64, 3), (500, np.full(len(q), 9), 1000, 1)):
        monkeypatch.setattr(ann_forest, "GATHERED", gathered)
        monkeypatch.setattr(ann_forest, "HEAD", head)
        monkeypatch.setattr(ann_forest, "TOGETHER", 7)
        forest = ann_forest.Forest(x, top)
        query, row = forest.search(q, depth, k)
        expected, lengths = plain_ascent(forest, x, top, q, depth, min(k, len(x)))
        assert set(zip(query.tolist(), row.tolist(), strict=True)) == expected
        if k == 5:  # descents end at many lengths, and so do ascents
            assert len({a for a, _ in lengths}) > 3 and len({z for _, z in lengths}) > 1


def test_sample(spark):
    v = table(spark, "/root/testdata/sf0.1", "embeddings").selectExpr("vec_id", "cast(embedding as array<double>) as v", "size(embedding) as dim")
    router = ann_forest.Router(v, 20)
    assert {d: abs(len(i) - 250) < 80 for d, (i, _) in router.sample.items()} == {64: True}
