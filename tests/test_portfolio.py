"""Covariances on a panel with gaps, weights of stacks of days, the path of a volatility target, recurrences in blocks."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltide.operators import backtest, forecasts, portfolio, recurrences

DAY = dt.date(2020, 1, 1)


def gappy(seed=3, days=150, names="ABCD"):
    """Returns (day, name) -> value: A daily, B every fifth day, C from day 40 on, D on random days; days 10 and 11 have none."""
    r = np.random.default_rng(seed)
    on = {"A": lambda t: True, "B": lambda t: t % 5 == 0, "C": lambda t: t >= 40, "D": lambda t: r.random() < 0.5}
    return {(t, n): float(r.normal(0, 0.02)) for t in range(days) if t not in (10, 11) for n in names if on[n](t)}


def frame(spark, values):
    rows = [(n, DAY + dt.timedelta(t), v) for (t, n), v in values.items()] + [("A", DAY + dt.timedelta(10), None)]
    return spark.createDataFrame(rows, "ticker string, dt date, ret double").repartition(6)


def plain(values):
    days, names = sorted({t for t, _ in values}), sorted({n for _, n in values})
    return days, names, np.array([[values.get((t, n), 0.0) for n in names] for t in days])


def matrices(df, names):
    out = {}
    for r in df.collect():
        m = out.setdefault((r["dt"] - DAY).days, np.full((len(names), len(names)), np.nan))
        i, j = names.index(r["asset_i"]), names.index(r["asset_j"])
        m[i, j] = m[j, i] = r["cov"]
    return out


def test_rolling_covariance_on_a_panel_with_gaps(spark):
    values = gappy()
    days, names, x = plain(values)
    got = matrices(portfolio.rolling_covariance(frame(spark, values), 20), names)
    assert sorted(got) == days[20:]
    for k, t in enumerate(days[20:], 20):
        assert np.allclose(got[t], np.cov(x[k - 20 : k].T), atol=1e-15) and np.linalg.eigvalsh(got[t]).min() > -1e-12
    last = matrices(portfolio.latest(frame(spark, values), "rolling", 20), names)
    assert list(last) == [days[-1]] and np.allclose(last[days[-1]], got[days[-1]], atol=1e-15)
    shrunk = matrices(portfolio.latest(frame(spark, values), "shrinkage", 20), names)[days[-1]]
    assert np.allclose(shrunk, 0.9 * got[days[-1]] + 0.1 * np.diag(np.diag(got[days[-1]])), atol=1e-15)
    assert portfolio.latest(frame(spark, values), "rolling", 500).count() == 0
    idle = portfolio.rolling_covariance(frame(spark, {**{(t, "A"): 0.01 * (t % 3) for t in range(12)}, (0, "B"): 0.1}), 5).where("asset_i = 'B'").collect()
    assert all(r["cov"] == 0 and r["corr"] == 0 for r in idle if r["dt"] > DAY + dt.timedelta(5))


def plain_parity(cov):
    w = [1 / len(cov)] * len(cov)
    for _ in range(50):
        marginal = cov @ np.array(w) / math.sqrt(np.array(w) @ cov @ np.array(w))
        inverse = [1 / max(m, 1e-10) for m in marginal]
        w = [i / sum(inverse) for i in inverse]
    return w


def test_weights_of_stacks():
    r = np.random.default_rng(5)
    half = r.normal(0, 0.02, (7, 9, 4))
    stack = np.einsum("dki,dkj->dij", half, half)
    stack[3] = 0
    assert np.allclose(portfolio.risk_parity(stack)[[0, 1, 2, 4, 5, 6]], [plain_parity(stack[k]) for k in (0, 1, 2, 4, 5, 6)])
    assert np.allclose(portfolio.risk_parity(stack)[3], 0.25) and np.allclose(portfolio.minimum_variance(stack)[3], 0.25)
    low = portfolio.minimum_variance(stack)
    for k in (0, 1, 2, 4):
        inverse = np.linalg.inv(stack[k] + 1e-8 * np.eye(4)).sum(1)
        long = np.maximum(inverse / inverse.sum(), 0)
        assert np.allclose(low[k], long / long.sum())
    aimed = portfolio.volatility_target(stack, 0.1)
    assert np.allclose(aimed[3], 0.25) and (aimed <= 0.75 + 1e-12).all() and (aimed >= 0).all()
    singular = np.array([[[-1e-8, 0.0], [0.0, -1e-8]]])
    assert np.allclose(portfolio.minimum_variance(singular), 0.5)


@pytest.mark.parametrize("rule", [portfolio.risk_parity, portfolio.minimum_variance, portfolio.volatility_target])
def test_backtest_on_a_panel_with_gaps(spark, rule):
    values = gappy()
    days, names, x = plain(values)
    got = {(r["dt"] - DAY).days: r["ret"] for r in portfolio.backtest(frame(spark, values), rule, window=20).collect()}
    assert sorted(got) == days[21:]
    for k in range(21, len(days)):
        w = rule(np.cov(x[k - 21 : k - 1].T)[None])[0]
        assert got[days[k]] == pytest.approx(float(w @ x[k]), abs=1e-12)
    w = portfolio.weights(portfolio.rolling_covariance(frame(spark, values), 20), rule)
    assert w.groupBy("dt").count().where("count != 4").count() == 0


def test_path_begins_with_the_first_leverage(spark):
    ret = [0.01, -0.02, 0.01, -0.01, 0.005]
    vol = [0.2, 0.25, 0.125, 0.5, 0.2]
    df = spark.createDataFrame([("A", DAY + dt.timedelta(k), r, v) for k, (r, v) in enumerate(zip(ret, vol, strict=True))], "ticker string, dt date, ret double, v double")
    path = backtest.volatility_target(df, "v", cost_bps=5, slippage_bps=2).orderBy("dt").collect()
    lever = [0.1 / v for v in vol]
    cum, top = 1.0, 0.0
    assert len(path) == 4
    for k, r in enumerate(path, 1):
        scaled = lever[k - 1] * ret[k]
        turn = abs(lever[k - 1] - lever[k - 2]) if k > 1 else 0.0
        cum *= 1 + scaled - turn * 5e-4 - abs(scaled) * 2e-4
        top = max(top, cum)
        assert (r["scaled"], r["cum"], r["drawdown"]) == pytest.approx((scaled, cum, cum / top - 1))
    got = backtest.summary(backtest.volatility_target(df, "v", cost_bps=5, slippage_bps=2)).first()
    assert got["turnover"] == pytest.approx(np.abs(np.diff(lever[1:])).mean()) and got["max_dd"] == pytest.approx(min(r["drawdown"] for r in path))
    many = spark.createDataFrame([("A", DAY + dt.timedelta(k), 0.01 * (-1) ** k, 0.2) for k in range(40)], "ticker string, dt date, ret double, v double")
    vols = [r["realized_vol_ann"] for r in backtest.volatility_target(many, "v", cost_bps=50).orderBy("dt").collect()]
    assert vols[:21] == [None] * 21 and vols[21] == pytest.approx(0.005 * math.sqrt(252))


def test_recurrences_in_blocks(spark):
    r = np.random.default_rng(8)
    rows, want = [], {}
    for name, n in (("long", 1500), ("twenty", 20), ("short", 19), ("gap", 300)):
        day, x = DAY, r.normal(0, 0.02, n)
        v = g = None
        for k in range(n):
            day += dt.timedelta(int(r.integers(1, 4)) + (700 if name == "gap" and k == 25 else 0))
            rows.append((name, day, float(x[k])))
            v = float(np.var(x[:20], ddof=1)) if k == 19 else None if v is None else 0.94 * v + 0.06 * x[k - 1] ** 2
            g = float(np.mean(x[:30] ** 2)) if k == 29 else None if g is None else max(-1e-4 + 0.08 * (x[k - 1] ** 2 - g) + 0.9 * g, 1e-12)
            want[name, day] = (v and math.sqrt(v * 252), g and math.sqrt(g * 252))
    df = spark.createDataFrame(rows, "ticker string, dt date, ret double").repartition(7)
    one, two = forecasts.ewma(df), forecasts.gas(df, window=30, omega=-1e-4)
    for out, k, c in ((one, 0, "ewma"), (two, 1, "gas")):
        got = {(x["ticker"], x["dt"]): x[c] for x in out.collect()}
        assert set(got) == set(want)
        assert all(got[key] == (None if w[k] is None else pytest.approx(w[k], rel=1e-9)) for key, w in want.items())
    assert any(w[1] is not None and w[1] == pytest.approx(math.sqrt(252e-12)) for w in want.values())  # the floor was met
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "hashpartitioning(ticker" in plan and "block" in plan
    assert df.select(F.floor(F.unix_date("dt") / recurrences.BLOCK_DAYS)).distinct().count() > 5
    with pytest.raises(ValueError):
        forecasts.gas(df, alpha=0.5, beta=0.1)
    assert forecasts.ewma(df.limit(0)).count() == 0
