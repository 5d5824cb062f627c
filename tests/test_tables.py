"""Signals by run date, ranges through a cache, as-of alignment, resampled intervals and losses of the user's own."""

import datetime as dt
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltide.operators import asof, evaluation, portfolio
from voltide.sources import tables

DAY = dt.date(2024, 1, 1)


def day(k):
    return DAY + dt.timedelta(k)


def test_signals_by_run_date(spark, tmp_path):
    base = str(tmp_path)
    signals = lambda v: spark.createDataFrame([("A", day(0), v), ("B", day(1), v)], "ticker string, dt date, ewma double")
    for run, v in (("2024-02-01", 1.0), ("2024-02-03", 3.0), ("2024-02-02", 2.0), ("2024-02-03", 4.0)):
        tables.save_signals(signals(v), base, run)
    newest = tables.newest_signals(spark, base)
    assert {(r["ticker"], r["ewma"], r["signal_run_date"]) for r in newest.collect()} == {("A", 4.0, dt.date(2024, 2, 3)), ("B", 4.0, dt.date(2024, 2, 3))}
    assert spark.read.parquet(f"{base}/signals").count() == 6
    assert "PartitionFilters: [isnotnull(signal_run_date" in (plan := newest._jdf.queryExecution().executedPlan().toString()) and "= Subquery" in plan.split("PartitionFilters")[1]
    assert tables.latest(newest.limit(0), "dt").count() == 0


def test_ranges_are_made_once(spark, tmp_path):
    made = []

    def make(asked):
        made.extend((r["ticker"], r["first"], r["last"]) for r in asked.collect())
        every = asked.where("ticker != 'none'").withColumn("dt", F.explode(F.sequence("first", "last")))
        return every.where(F.dayofweek("dt") != 1).select("ticker", "dt", F.dayofyear("dt").alias("close"))

    ask = lambda *rows: tables.cached_ranges(spark, str(tmp_path), spark.createDataFrame([(t, day(a), day(z)) for t, a, z in rows], "ticker string, first date, last date"), make)
    assert ask(("A", 3, 8), ("none", 0, 5)).count() == 6 - sum(day(k).isoweekday() == 7 for k in range(3, 9))
    ask(("A", 20, 25), ("B", 0, 2))
    made.clear()
    got = ask(("A", 0, 30), ("none", 0, 5))
    assert sorted(made) == [("A", day(0), day(2)), ("A", day(9), day(19)), ("A", day(26), day(30)), ("none", day(0), day(5))]
    assert sorted(r["dt"] for r in got.collect()) == [day(k) for k in range(31) if day(k).isoweekday() != 7]
    made.clear()
    again = ask(("A", 4, 28), ("A", 0, 30), ("B", 1, 2))
    assert made == [] and again.where("ticker = 'A'").count() == got.count() and again.where("ticker = 'B'").count() == 2
    kept = spark.read.parquet(f"{tmp_path}/rows")
    assert kept.count() == kept.select("ticker", "dt").distinct().count()
    plan = kept.where("ticker = 'B'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ticker" in plan


def test_missing_against_days(spark):
    r = random.Random(4)
    held = [("A", a := r.randint(0, 60), a + r.randint(0, 9)) for _ in range(12)] + [("B", 5, 5)]
    asked = [("A", 0, 70), ("A", 13, 14), ("A", 30, 29), ("B", 5, 5), ("C", 1, 2)]
    frame = lambda rows: spark.createDataFrame([(t, day(a), day(z)) for t, a, z in rows], "ticker string, first date, last date")
    got = {}
    for x in tables.missing(frame(asked[:1] + asked[2:]), frame(held)).collect():
        got.setdefault(x["ticker"], []).extend(x["first"] + dt.timedelta(k) for k in range((x["last"] - x["first"]).days + 1))
    covered = {k for _, a, z in held[:-1] for k in range(a, z + 1)}
    assert sorted(got.pop("A")) == [day(k) for k in range(71) if k not in covered] and got == {"C": [day(1), day(2)]}


@pytest.mark.parametrize("tolerance", [None, 40_000])
def test_asof_against_brute_force(spark, tolerance):
    r = random.Random(2)
    at = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=r.randint(0, 500) * 1000)
    left = [(k, r.choice(["x", "x", "x", "y", None, "only left"]), None if k % 17 == 0 else at()) for k in range(200)]
    left += left[:3]
    right = [(r.choice(["x", "x", "y", None, "only right"]), None if k % 19 == 0 else at(), r.choice([None, k])) for k in range(60)]
    right += [("x", right[1][1], 999), ("x", right[1][1], 998)]
    a, b = spark.createDataFrame(left, "id int, key string, ts timestamp_ntz"), spark.createDataFrame(right, "key string, ts timestamp_ntz, id int")
    got = sorted(((x["id"], x["matched"] and x["matched"]["ts"], x["matched"] and x["matched"]["id"]) for x in asof.asof(a.repartition(3), b.repartition(4), "key", tolerance_seconds=tolerance).collect()), key=str)
    want = []
    for i, key, ts in left:
        found = max(((t, v is not None, v or 0) for k, t, v in right if k == key is not None and ts is not None and t is not None and t <= ts), default=None)
        found = None if found is None or tolerance is not None and (ts - found[0]).total_seconds() > tolerance else found
        want.append((i, found and found[0], found and (found[2] if found[1] else None)))
    assert got == sorted(want, key=str) and sum(w[1] is not None for w in want) > 50
    assert asof.asof(a, b.limit(0), "key").where("matched IS NOT NULL").count() == 0 and asof.asof(a.limit(0), b, "key").count() == 0


def wide(spark, n=120):
    r = np.random.default_rng(6)
    rows = [(t, day(k), float(r.gamma(2) * 0.1), None if k % 23 == 0 else float(r.gamma(2) * 0.1)) for t in "AB" for k in range(n)]
    return rows, spark.createDataFrame(rows, "ticker string, dt date, realized double, f double")


def test_bootstrap_against_numpy(spark):
    rows, df = wide(spark)
    got = {(x["ticker"], x["dt"]): (x["lower"], x["upper"]) for x in evaluation.bootstrap_intervals(df.repartition(5), "f", 0.1, 200, 7).collect()}
    assert got == {(x["ticker"], x["dt"]): (x["lower"], x["upper"]) for x in evaluation.bootstrap_intervals(df.coalesce(1), "f", 0.1, 200, 7).collect()}
    for t, d, _, f in rows:
        if f is None:
            assert got[t, d] == (None, None)
            continue
        left = np.sort([y - g for u, _, y, g in rows if u == t and g is not None])
        draws = [left[int(int(hashlib.md5(f"{t}|{d}|7|{j}".encode()).hexdigest()[:13], 16) / 2**52 * len(left))] for j in range(200)]
        boot = np.maximum(f + np.array(draws), 1e-8)
        assert got[t, d] == pytest.approx((np.quantile(boot, 0.05), np.quantile(boot, 0.95)), rel=1e-9)


def test_bootstrap_comes_near_its_limit(spark):
    _, df = wide(spark, 400)
    limit = {(x["ticker"], x["dt"]): x["upper"] for x in evaluation.intervals(df, "f").collect()}
    gap = []
    for n in (50, 5000):
        made = evaluation.bootstrap_intervals(df, "f", draws=n).collect()
        gap.append(np.mean([abs(x["upper"] - limit[x["ticker"], x["dt"]]) for x in made if x["upper"] is not None]))
    assert gap[1] < gap[0] / 1.5 and gap[1] < 0.02


def test_user_loss_equals_the_built_in_one(spark):
    _, df = wide(spark)
    long = df.select("ticker", F.lit("m").alias("model"), "realized", F.col("f").alias("forecast")).repartition(6)
    built = {r["ticker"]: r for r in evaluation.metrics(long, "ticker", "model").collect()}
    own = evaluation.user_loss(long, ["ticker", "model"], lambda y, f: {"square": (f - y) ** 2}, lambda s, n: F.sqrt(s["square"] / n)).collect()
    assert {r["ticker"]: (pytest.approx(r["loss"]), r["n"]) for r in own} == {t: (r["rmse"], r["n"]) for t, r in built.items()}
    assert evaluation.user_loss(long.limit(0), ["ticker"], lambda y, f: {"x": y}).count() == 0


def test_cube_has_every_total_and_ties(spark):
    rows = [(t, m, h, 1.0, 1.0 + e) for t, m, h, e in (("A", "x", 1, 0.25), ("A", "y", 1, -0.25), ("A", "z", 1, 0.75), ("B", "x", 5, 0.5))]
    got = {(r["ticker"], r["model"], r["horizon"], r["slice"]): (round(r["mae"], 9), r["n"], r["rank"]) for r in portfolio.cube(spark.createDataFrame(rows, "ticker string, model string, horizon int, realized double, forecast double")).collect()}
    assert got["A", "x", 1, 0] == (0.25, 1, 1) and got["A", "y", 1, 0] == (0.25, 1, 1) and got["A", "z", 1, 0] == (0.75, 1, 3)
    assert got[None, None, None, 7] == (0.4375, 4, None) and got[None, "x", None, 5] == (0.375, 2, 2) and got["A", None, None, 3][2] is None
