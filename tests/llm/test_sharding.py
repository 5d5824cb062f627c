import zlib

from voltide.llm import sharding
from voltide.llm.queries import op7_sharding, table


def check(out, rows, shards):
    want = sorted(((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows), key=str)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in out), key=str) == want
    by = {}
    for r in out:
        by.setdefault(r["shard"], []).append(r)
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
    for members in by.values():
        assert sorted(r["slot"] for r in members) == list(range(len(members)))
    return by


def test_query(spark, medium):
    rows = [tuple(r) for r in table(spark, medium, "documents").select("doc_id", "text").collect()]
    by = check(op7_sharding(spark, medium).collect(), rows, 24)
    sizes = [sum(r["size"] for r in by.get(k, [])) for k in range(24)]
    largest = max(r["size"] for m in by.values() for r in m)
    assert max(sizes) - min(sizes) <= 2 * largest + 0.04 * sum(sizes) / 24


def test_hard_rows(docs, rows, none):
    by = check(sharding.summary(docs, 5).collect(), [r[:2] for r in rows], 5)
    place = {}
    for k, members in by.items():
        for r in members:
            place.setdefault((r["text_crc32"], r["size"]), []).append(k)
    total = sum(size * len(where) for (_, size), where in place.items())
    assert all(len(set(where)) == 1 for (_, size), where in place.items() if size * len(where) * 5 <= 0.01 * total)
    assert any(len(where) > 1 for (_, size), where in place.items() if size * len(where) * 5 <= 0.01 * total)
    assert sharding.summary(none, 5).count() == 0


def test_a_large_group_of_equal_texts_spreads(spark):
    rows = [(k, "the same" if k % 3 else f"text {k}") for k in range(3000)]
    by = check(sharding.summary(spark.createDataFrame(rows, "doc_id long, text string"), 6).collect(), rows, 6)
    sizes = [sum(r["size"] for r in by[k]) for k in range(6)]
    assert max(sizes) - min(sizes) <= 64


def test_reruns_agree(docs):
    get = lambda n: sorted(map(str, sharding.summary(docs.repartition(n), 4).collect()))
    assert get(2) == get(7)


def test_small_groups_stay_together_over_the_ends_of_partitions(spark, monkeypatch):
    monkeypatch.setattr(sharding, "TOGETHER", 1.0)  # groups of 100 rows are small then, and most go over an end
    rows = [(k, f"text {k % 30}") for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    names, seen = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled"), []
    before = [spark.conf.get(n) for n in names]
    try:
        spark.conf.set(names[1], "false")  # which would make one partition of so few rows
        for n in ("1", "40"):
            spark.conf.set(names[0], n)
            out = sharding.summary(df, 7).collect()
            check(out, rows, 7)
            seen.append(sorted((r["doc_id"], r["shard"], r["slot"]) for r in out))
    finally:
        for n, v in zip(names, before, strict=True):
            spark.conf.set(n, v)
    assert seen[0] == seen[1]
    assert len({(k % 30, shard) for k, shard, _ in seen[0]}) == 30
