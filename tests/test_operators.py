"""Hand values and edge cases of the volatility operators."""

import datetime as dt
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltide.functions import tails
from voltide.functions import volatility as vol
from voltide.operators import backtest, densities, evaluation, features, forecasts, garch, portfolio, risk, trees
from voltide.plans.queries import QUERIES
from voltide.sources.bars import lineitem_bars, with_returns


def series(spark, ret, ticker="x", high=None, low=None):
    day = dt.date(2020, 1, 1)
    close = 100 * np.cumprod(1 + np.array(ret, float))
    rows = [(ticker, day + dt.timedelta(k), float(close[k]), float(high[k]) if high else float(close[k]), float(low[k]) if low else float(close[k]), float(close[k]), float(ret[k])) for k in range(len(ret))]
    return spark.createDataFrame(rows, "ticker string, dt date, open double, high double, low double, close double, ret double")


def column(df, c):
    return [r[0] for r in df.orderBy("ticker", "dt").select(c).collect()]


def test_parkinson(spark):
    df = series(spark, [0, 0, 0], high=[105, 102, 103], low=[100, 99, 101])
    want = [math.sqrt(math.log(h / l) ** 2 / (4 * math.log(2))) for h, l in ((105, 100), (102, 99), (103, 101))]
    assert column(df, vol.parkinson()) == pytest.approx(want)


def test_realized_and_forward(spark):
    assert column(series(spark, [0.01, -0.01, 0.02]), vol.realized(2))[:2] == [None, pytest.approx(math.sqrt(2) * 0.01)]
    fwd = column(series(spark, [0.01] * 5), vol.forward_realized(2))
    assert fwd[3:] == [None, None] and fwd[:3] == pytest.approx([0.01 * math.sqrt(252)] * 3)
    assert column(series(spark, [0.0]), vol.annualized(F.lit(0.01))) == pytest.approx([0.01 * math.sqrt(126)])
    with pytest.raises(ValueError):
        vol.range_based(5, "other")


def test_ewma_starts_after_burn_in(spark):
    r = np.random.default_rng(42).normal(0, 0.01, 100)
    df = forecasts.ewma(series(spark, r))
    v = column(df, "ewma")
    assert v[:19] == [None] * 19 and all(x > 0 for x in v[19:])
    assert v[19] == pytest.approx(math.sqrt(r[:20].var(ddof=1) * 252))


def test_har_equals_least_squares(spark):
    r = np.random.default_rng(3).normal(0, 0.01, 400)
    got = column(forecasts.har(series(spark, r), window=120), "har_rv")
    d = np.abs(r)
    w, m = (np.array([np.nan if k < n - 1 else math.sqrt(np.mean(r[k - n + 1 : k + 1] ** 2)) for k in range(400)]) for n in (5, 22))
    x = np.column_stack([d, w, m])
    for t in (142, 200, 399):
        use = [s for s in range(t - 119, t) if np.isfinite(x[s - 1]).all()]
        beta = np.linalg.lstsq(x[[s - 1 for s in use]], d[use], rcond=None)[0]
        assert got[t] == pytest.approx(max(x[t - 1] @ beta, 1e-8), rel=1e-8)
    assert got[141] is None


def walk_forward(x, y, window, step, least, fit):
    """Forecasts by explicit least squares on [1, x], penalised apart from the constant, filled forward."""
    out, last = [None] * len(y), None
    for t in range(len(y)):
        if t >= window and (t - window) % step == 0:
            use = [k for k in range(t - window, t) if np.isfinite(x[k]).all() and np.isfinite(y[k])]
            if len(use) >= least and np.isfinite(x[t]).all():
                last = fit(x[use], y[use], x[t])
        out[t] = last
    return out


def penalised(x, y, new, alpha):
    mean, scale = x.mean(axis=0), x.std(axis=0)
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    root = np.vstack([z, np.sqrt(alpha) * np.eye(z.shape[1])[1:]])
    beta = np.linalg.lstsq(root, np.append(y, np.zeros(z.shape[1] - 1)), rcond=None)[0]
    return beta[0] + (new - mean) / scale @ beta[1:]


def featured(spark, n=150):
    df, names = features.build(series(spark, np.random.default_rng(1).normal(0, 0.01, n)))
    assert len(names) == 16
    df = df.withColumn("target", vol.forward_realized(2)).cache()
    rows = df.orderBy("dt").select("rolling_vol_5", "rv_d", "target").collect()
    m = np.array([[np.nan if v is None else v for v in r] for r in rows], float)
    return df, m[:, :2], m[:, 2]


def test_ridge_against_numpy(spark):
    df, x, y = featured(spark)
    got = column(forecasts.ridge(df, ["rolling_vol_5", "rv_d"], "target", window=30, step=5, least=15), "ridge")
    want = walk_forward(x, y, 30, 5, 15, lambda a, b, c: max(0.0, penalised(a, b, c, 1.0)))
    assert sum(w is not None for w in want) > 100
    assert all((g is None) == (w is None) and (g is None or math.isclose(g, w, rel_tol=1e-9, abs_tol=1e-12)) for g, w in zip(got, want, strict=True))


def test_tuned_ridge_against_numpy(spark):
    df, x, y = featured(spark, 260)
    alphas = (0.01, 10.0)

    def fit(a, b, c):
        size, mean = max(20, len(b) // 4), []
        for alpha in alphas:
            cuts = [(len(b) - (k + 1) * size, len(b) - k * size) for k in range(3)]
            mean.append(np.mean([math.sqrt(np.mean([(penalised(a[:i], b[:i], a[m], alpha) - b[m]) ** 2 for m in range(i, j)])) for i, j in cuts if i >= max(size, 50)]))
        return max(1e-8, penalised(a, b, c, alphas[int(np.argmin(mean))]))

    got = column(forecasts.ridge_tuned(df, ["rolling_vol_5", "rv_d"], "target", window=130, step=25, alphas=alphas, folds=3, least=80), "ridge_tuned")
    want = walk_forward(x, y, 130, 25, 80, fit)
    assert sum(w is not None for w in want) > 100
    assert all((g is None) == (w is None) and (g is None or math.isclose(g, w, rel_tol=1e-8)) for g, w in zip(got, want, strict=True))


def test_stacking_against_numpy(spark):
    r = np.random.default_rng(3)
    y, e, f = r.normal(1, 0.1, 200), *r.normal(0, 0.1, (2, 200))
    rows = [("x", dt.date(2020, 1, 1) + dt.timedelta(k), float(y[k]), float(y[k] + e[k]), float(y[k] - f[k])) for k in range(200)]
    got = column(forecasts.stacking(spark.createDataFrame(rows, "ticker string, dt date, realized double, a double, b double"), ["a", "b"], window=120, step=21), "stacking")
    x = np.column_stack([y + e, y - f])
    for t in (120, 141, 170):
        start = 120 + (t - 120) // 21 * 21
        z, m = x[start - 120 : start], x[start - 120 : start].mean(axis=0)
        root = np.vstack([z - m, np.eye(2)])
        beta = np.linalg.lstsq(root, np.append(y[start - 120 : start] - y[start - 120 : start].mean(), [0, 0]), rcond=None)[0]
        assert math.isclose(got[t], (x[t] - m) @ beta + y[start - 120 : start].mean(), rel_tol=1e-9)
    assert got[119] is None and got[183:] == [got[182]] * 17  # stops a step before the end


def test_singular_har_keeps_the_last_forecast(spark):
    out = column(forecasts.har(series(spark, [0.01] * 120), window=60, least=20), "har_rv")
    assert all(x is None or math.isfinite(x) and abs(x) < 1 for x in out)


def test_losses(spark):
    df = spark.createDataFrame([("x", 0.2, 0.22), ("x", 0.3, 0.28), ("x", 0.25, 0.24)], "ticker string, realized double, forecast double")
    m = evaluation.metrics(df, "ticker").first()
    assert m["mae"] == pytest.approx(0.05 / 3) and m["rmse"] == pytest.approx(math.sqrt(0.0009 / 3))
    same = evaluation.metrics(df.withColumn("forecast", F.col("realized")), "ticker").first()
    assert same["qlike"] == pytest.approx(0) and same["mae"] == 0 and same["correlation"] == pytest.approx(1)


def test_equal_errors_have_no_statistic(spark):
    rows = [("x", dt.date(2020, 1, 1) + dt.timedelta(k), 0.1 * (k % 3), 0.1, 0.1) for k in range(50)]
    wide = spark.createDataFrame(rows, "ticker string, dt date, realized double, a double, b double")
    assert [(r["dm"], r["p"]) for r in evaluation.diebold_mariano(wide, ["a", "b"], "a").collect()] == [(None, None)]


def test_diebold_mariano_against_numpy(spark):
    r = np.random.default_rng(5)
    y, a, b = r.normal(1, 0.3, (3, 80))
    rows = [("x", dt.date(2020, 1, 1) + dt.timedelta(k), float(y[k]), float(a[k]), float("nan") if k == 7 else float(b[k])) for k in range(80)]
    wide = spark.createDataFrame(rows, "ticker string, dt date, realized double, a double, b double")
    for loss, f in (("squared", np.square), ("absolute", np.abs)):
        got = evaluation.diebold_mariano(wide, ["a", "b"], "a", horizon=2, loss=loss).collect()[0]
        d = np.delete(f(y - b) - f(y - a), 7)
        z = d - d.mean()
        gamma = (z * z).mean() + sum(2 * (1 - k / 3) * (z[k:] * z[:-k]).mean() for k in (1, 2))
        want = d.mean() / math.sqrt(gamma / len(d))
        assert got["n"] == 79 and math.isclose(got["dm"], want, rel_tol=1e-9) and math.isclose(got["p"], math.erfc(abs(want) / math.sqrt(2)), rel_tol=1e-9)


def test_hits_and_runs(spark):
    hits = [0, 1, 1, 0, 0, 1, 0, 0, 0, 1]
    df = series(spark, [0.0] * 10).withColumns({"var": F.lit(0.1), "es": F.lit(0.2), "hit": F.lit(0.0)}).join(spark.createDataFrame([(dt.date(2020, 1, 1) + dt.timedelta(k), float(h)) for k, h in enumerate(hits)], "dt date, h double"), "dt").withColumn("hit", F.col("h"))
    c = risk.clustering(df).first()
    assert (c["n_violations"], c["max_run"]) == (4, 2) and c["mean_run"] == pytest.approx(4 / 3) and c["mean_gap"] == pytest.approx(8 / 3)
    lr = risk.coverage(df, 0.01).first()
    assert lr["x"] == 4 and lr["lr_uc"] > 0 and lr["lr_ind"] >= 0
    none = risk.coverage(df.withColumn("hit", F.lit(0.0))).first()
    assert none["lr_uc"] is None and none["lr_ind"] is None


def test_sizing_golden_row(spark):
    got = spark.range(1).select(*(c.alias(k) for k, c in portfolio.target_shares(20000, F.lit(182.80999755859372), F.lit(0.28288482709430457)).items())).first()
    assert got["shares"] == 39 and got["exposure"] == pytest.approx(7129.589904785155) and got["multiplier"] == pytest.approx(0.35647949523925776)


def test_leverage_is_applied_a_row_later(spark):
    df = series(spark, [0.01, 0.02, -0.01]).withColumn("v", F.lit(0.2))
    path = backtest.volatility_target(df, "v")
    assert column(path, "net") == [pytest.approx(0.01), pytest.approx(-0.005)]
    assert backtest.summary(path).first()["realized_vol"] is None


def test_reconcile(spark):
    held = spark.createDataFrame([("a", 5), ("b", 3), ("c", 0)], "ticker string, qty long")
    want = spark.createDataFrame([("a", 7), ("d", 2)], "ticker string, shares long")
    got = {r["ticker"]: tuple(r)[1:] for r in portfolio.reconcile(held, want).collect()}
    assert got == {"a": ("buy", 2, "adjust"), "b": ("sell", 3, "close"), "d": ("buy", 2, "open")}


def test_ridge_query_fits_the_reference_window_and_keeps_warm_up_rows(spark):
    large = f"{os.environ.get('VOLTIDE_TESTDATA', '/root/testdata')}/sf0.1"
    rows = {}
    for r in QUERIES["e10_ridge"](spark, large).select("ticker", "dt", "ridge").collect():
        rows.setdefault(r["ticker"], []).append((r["dt"], r["ridge"]))
    assert sum(map(len, rows.values())) == with_returns(lineitem_bars(spark, large)).count()
    for own in rows.values():
        have = [v is not None for _, v in sorted(own, key=lambda x: x[0])]
        assert len(own) > 1260 and have.index(True) == 1260 and all(have[1260:])


def simulated(n, columns, seed=1, omega=0.05, alpha=0.08, beta=0.85, gamma=0.0, freedom=None):
    r = np.random.default_rng(seed)
    s, out = np.full(columns, omega / (1 - alpha - beta - gamma / 2)), []
    for _ in range(n):
        z = r.standard_normal(columns) if freedom is None else r.standard_t(freedom, columns) * math.sqrt((freedom - 2) / freedom)
        e = np.sqrt(s) * z
        out.append(e)
        s = omega + (alpha + gamma * (e < 0)) * e * e + beta * s
    return np.array(out)


def test_garch_recovers_parameters():
    x, _, _ = garch.fit(simulated(3000, 10))
    assert np.allclose(x.mean(axis=1), [0.05, 0.08, 0.85], atol=0.03)
    x, _, _ = garch.fit(simulated(3000, 10, gamma=0.08), "gjr")
    assert np.allclose(x.mean(axis=1), [0.05, 0.08, 0.08, 0.85], atol=0.03)
    x, freedom, _ = garch.fit(simulated(3000, 10, freedom=6), "garch", True)
    assert np.allclose(x.mean(axis=1), [0.05, 0.08, 0.85], atol=0.03) and 4.5 < np.median(freedom) < 8
    x, _, v = garch.fit(simulated(2000, 4), "egarch")
    assert (np.abs(x[3] - 0.92) < 0.1).all() and (v > 0).all()


def plain_likelihood(r, omega, alpha, beta):
    """One series, one parameter vector, day by day."""
    w = 0.94 ** np.arange(75)
    first = (w * r[:75] ** 2).sum() / w.sum()
    s, total = omega + (alpha + beta) * first, 0.0
    for x in r:
        total -= 0.5 * (math.log(s) + x * x / s)
        s = omega + alpha * x * x + beta * s
    return total, s


def test_garch_is_at_the_maximum():
    r = simulated(800, 3, seed=4)
    x, _, ahead = garch.fit(r)
    noise = np.random.default_rng(2)
    for k in range(3):
        best, s = plain_likelihood(r[:, k], *x[:, k])
        assert math.isclose(s, ahead[k], rel_tol=1e-9)
        for _ in range(200):
            p = np.abs(x[:, k] * (1 + 0.1 * noise.standard_normal(3)))
            assert p[1] + p[2] >= 1 or plain_likelihood(r[:, k], *p)[0] <= best + 1e-4


def test_garch_walks_forward(spark):
    r = simulated(330, 1, seed=9)[:, 0] / 100
    got = column(garch.garch(series(spark, list(r)), "garch", window=300, step=7, blocks=3), "garch")
    want = {t: math.sqrt(garch.fit(r[t - 300 : t, None] * 100)[2][0]) / 100 * math.sqrt(126) for t in range(300, 330, 7)}
    assert {t for t, g in enumerate(got) if g is not None} == set(want)
    assert all(math.isclose(got[t], w, rel_tol=1e-6) for t, w in want.items())
    assert column(garch.garch(series(spark, [0.01] * 20), "gjr", window=300), "gjr") == [None] * 20


def test_distributions():
    assert np.allclose(tails.normal_cdf(np.array([-1.96, 0, 1.0])), [0.0249979, 0.5, 0.8413447], atol=1e-7)
    grid = np.linspace(-60, 6, 400_001)
    for df in (2.5, 5.0, 30.0):
        mass = np.exp(tails.t_log_pdf(grid, df))
        area = np.append(0, np.cumsum((mass[1:] + mass[:-1]) / 2 * np.diff(grid))) + tails.t_cdf(np.array([-60.0]), df)[0]
        at = [np.searchsorted(grid, z) for z in (-4, -1, 0, 0.5, 3)]
        assert np.allclose(tails.t_cdf(grid[at], df), area[at], atol=1e-6)
    for shape in (-4.0, 0.0, 2.0, 30.0):
        mass = 2 * np.exp(-grid * grid / 2) / math.sqrt(2 * math.pi)
        near = np.abs(grid) < 8
        z, pdf = grid[near], mass[near] * tails.normal_cdf(shape * grid[near])
        area = np.append(0, np.cumsum((pdf[1:] + pdf[:-1]) / 2 * np.diff(z)))
        assert np.allclose(tails.skew_normal_cdf(z[::2000], shape), area[::2000], atol=1e-6)
    assert np.allclose([tails.chi2_tail(np.array([x]), k)[0] for x, k in ((3.841459, 1), (5.991465, 2), (14.06714, 7), (16.91898, 9), (31.41043, 20))], 0.05, atol=1e-7)


def test_density_fits():
    r = np.random.default_rng(11)
    fit = densities.Student.fit(0.1 + 0.8 * r.standard_t(5, 6000))
    assert abs(fit.mu - 0.1) < 0.05 and abs(fit.sigma - 0.8) < 0.05 and 4 < fit.df < 6.5
    u, v = np.abs(r.standard_normal(6000)), r.standard_normal(6000)
    d = 3 / math.sqrt(10)
    fit = densities.SkewNormal.fit(0.5 + 2 * (d * u + math.sqrt(1 - d * d) * v))
    assert abs(fit.mu - 0.5) < 0.15 and abs(fit.sigma - 2) < 0.15 and 2 < fit.shape < 4.5
    # The closed form of the shortfall against the mean of what lies beyond the quantile.
    law = densities.Student(6.0, 0.0, 1.0)
    q = tails.quantile(law.cdf, 0.05)
    z = np.linspace(q - 400, q, 2_000_001)
    assert abs(law.shortfall(0.05) + (z * np.exp(tails.t_log_pdf(z, 6.0))).sum() * (z[1] - z[0]) / 0.05) < 1e-2


def test_density_pipeline(spark):
    r = np.random.default_rng(12).standard_t(6, 700) * 0.01
    df = series(spark, list(r)).withColumn("v", F.when(F.dayofyear("dt") % 7 != 3, F.lit(0.01 * math.sqrt(252))))
    out = densities.density_forecasts(df, "v").orderBy("dt").collect()
    known = [x for x in out if x["var"] is not None]
    assert len(known) >= 698 and {x["dist"] for x in out} == {"studentt"} and all(x["es"] > x["var"] > 0 and 0 < x["pit"] < 1 for x in known)
    assert abs(np.mean([x["hit"] for x in known]) - 0.01) < 0.012
    signed = densities.density_forecasts(df, "v", "normal", compat_sign=True).where("es IS NOT NULL").select(F.max("es")).first()[0]
    assert signed < 0
    few = densities.density_forecasts(series(spark, [0.01, -0.02] * 5).withColumn("v", F.lit(0.2)), "v").select("dist").distinct().collect()
    assert [x[0] for x in few] == ["normal"] and densities.fit(series(spark, [0.1] * 9).withColumn("z", F.lit(0.1))).count() == 0


def test_dq_against_numpy(spark):
    r = np.random.default_rng(6)
    n, alpha = 400, 0.1
    var, ret = r.uniform(0.01, 0.02, n), r.normal(0, 0.01, n)
    hit = (ret < -var).astype(float)
    rows = [("x", dt.date(2020, 1, 1) + dt.timedelta(k), float(ret[k]), float(var[k]), 0.0, float(hit[k])) for k in range(n)]
    got = risk.dq(spark.createDataFrame(rows, "ticker string, dt date, ret double, var double, es double, hit double"), alpha).collect()[0]
    x = np.column_stack([np.ones(n - 5), *(hit[4 - i : n - 1 - i] for i in range(5)), var[5:]])
    y = hit[5:] - alpha
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    e = y - x @ beta
    want = beta @ (x.T @ x) @ beta / (e @ e / (len(y) - 7))
    assert got["n"] == n - 5 and math.isclose(got["dq"], want, rel_tol=1e-8) and math.isclose(got["p_dq"], tails.chi2_tail(np.array([want]), 7)[0], rel_tol=1e-8)


def test_histogram_has_empty_bins(spark):
    df = spark.createDataFrame([("x", v) for v in [0.0, 0.05, 1.0, 0.95] * 3] + [("y", 0.5)] * 9, "ticker string, pit double")
    assert sorted((r["bin"], r["n"]) for r in risk.pit_histogram(df).collect()) == [(0, 6), *((k, 0) for k in range(1, 9)), (9, 6)]
    assert risk.pit_uniform(risk.pit_histogram(df)).collect()[0]["chi2"] is None


def test_weights():
    cov = np.array([[0.04, 0.01, 0.0], [0.01, 0.09, 0.02], [0.0, 0.02, 0.16]])
    w = portfolio.minimum_variance(cov[None])[0]
    assert math.isclose(w.sum(), 1) and all(v @ cov @ v >= w @ cov @ w - 1e-9 for v in np.random.default_rng(1).dirichlet(np.ones(3), 500))
    p = portfolio.risk_parity(np.diag([1.0, 4.0])[None])[0]
    q = np.full(2, 0.5)
    for _ in range(50):
        m = np.diag([1.0, 4.0]) @ q / math.sqrt(q @ np.diag([1.0, 4.0]) @ q)
        q = (1 / m) / (1 / m).sum()
    assert np.allclose(p, q)
    s = portfolio.volatility_target(cov[None] / 252, 0.1)[0]
    assert math.isclose(math.sqrt(s @ cov @ s), 0.1, rel_tol=1e-2) or (s == 1).any()


def test_fractional_shares_and_cap(spark):
    df = spark.createDataFrame([(182.81, 0.2829)], "close double, v double")
    made = portfolio.target_shares(20000.0, F.col("close"), F.col("v"), whole=False)
    assert math.isclose(df.select(made["shares"]).first()[0], 0.1 / 0.2829 * 20000 / 182.81, rel_tol=1e-12)
    held = spark.createDataFrame([("a", 3)], "ticker string, qty long")
    want = spark.createDataFrame([("a", 5, 30_000.0), ("b", 2, 10.0)], "ticker string, shares long, close double")
    assert {r["ticker"]: (r["side"], r["qty"], r["action"]) for r in portfolio.reconcile(held, want).collect()} == {"a": ("sell", 3, "adjust"), "b": ("buy", 2, "open")}


def test_wins_ties_and_wide_rows(spark):
    m = spark.createDataFrame([("x", "b", 1.0, 2.0, 200), ("x", "a", 1.0, 3.0, 200), ("y", "a", None, None, 3), ("y", "b", 5.0, 1.0, 3)], "ticker string, model string, mae double, qlike double, n long")
    assert {r["model"]: r["wins"] for r in portfolio.wins(m, ["b", "a"]).collect()} == {"b": 2}
    assert [tuple(r) for r in portfolio.one_row_each(m, ["a", "b"]).collect()] == [("x", 1.0, 3.0, 1.0, 2.0)]
    assert [r["ticker"] for r in portfolio.smallest(m.withColumn("mae", F.col("mae").cast("string")), "none", 2, "mae").collect()] == ["x", "x"]


def plain_tree(x, slope, depth):
    """Row by row: the leaf that a tree grown on all thresholds gives each row and a function for new rows."""
    score = lambda rows: slope[rows].sum() ** 2 / (len(rows) + 1)

    def grow(rows, left):
        best, found = 1e-6, None
        for j in range(x.shape[1] if left else 0):
            for cut in np.unique(x[rows, j])[1:]:
                a, b = rows[x[rows, j] < cut], rows[x[rows, j] >= cut]
                gain = score(a) + score(b) - score(rows)
                if gain > best + 1e-12:
                    best, found = gain, (j, cut, a, b)
        if found is None:
            value = -0.1 * slope[rows].sum() / (len(rows) + 1)
            return lambda v: value
        j, cut, a, b = found
        low, high = grow(a, left - 1), grow(b, left - 1)
        return lambda v: low(v) if v[j] < cut else high(v)

    return grow(np.arange(len(x)), depth)


def plain_boosting(x, y, ask, rounds, depth):
    fitted, value = np.full(len(y), y.mean()), y.mean()
    for _ in range(rounds):
        tree = plain_tree(x, fitted - y, depth)
        fitted, value = fitted + np.array([tree(v) for v in x]), value + tree(ask)
    return value


def test_boosted_trees_against_plain_trees(spark):
    r = np.random.default_rng(4)
    x = r.integers(0, 12, (60, 3)).astype(float)
    y = np.where(x[:, 0] > 5, 2.0, 0.5) + 0.3 * x[:, 1] * (x[:, 2] > 3) + 0.05 * r.standard_normal(60)
    for ask in (x[7], np.array([-1.0, 20.0, 4.5]), np.array([6.0, 0.0, 3.0])):
        assert trees.predict(x, y, ask, trees=12, depth=3) == pytest.approx(plain_boosting(x, y, ask, 12, 3), rel=1e-9)
    assert trees.predict(np.zeros((10, 2)), np.full(10, 0.3), np.zeros(2)) == pytest.approx(0.3)
    assert len(trees.cuts(r.standard_normal(1000), 64)) == 63

    day = dt.date(2020, 1, 1)
    rows = [(t, day + dt.timedelta(k), *map(float, x[k]), float(y[k])) for t in ("a", "b") for k in range(60)]
    rows[25] = (*rows[25][:2], None, *rows[25][3:])  # incomplete: no forecast of its own, and no row of training
    rows[30] = (*rows[30][:5], None)
    df = spark.createDataFrame(rows, "ticker string, dt date, f1 double, f2 double, f3 double, target double")
    made = trees.boosted_trees(df, ["f1", "f2", "f3"], "target", window=20, step=5, least=15, blocks=3, trees=5, depth=2)
    got = {t: [v["boosted_trees"] for v in made.where(F.col("ticker") == t).orderBy("dt").collect()] for t in "ab"}
    for t in "ab":
        last = None
        for k in range(60):
            if k >= 20 and k % 5 == 0 and (t, k) != ("a", 25):
                use = [i for i in range(k - 20, k) if not (t == "a" and i in (25, 30))]
                last = max(1e-8, trees.predict(x[use], y[use], x[k], trees=5, depth=2))
            assert got[t][k] == (None if last is None else pytest.approx(last, rel=1e-9))
    assert set(column(trees.boosted_trees(df, ["f1", "f2", "f3"], "target", window=20, step=5, least=50), "boosted_trees")) == {None}


def test_erfc_on_arrays():
    x = np.concatenate([np.linspace(-6, 6, 2401), [np.nan, np.inf, -np.inf, 0.0, 2.0, 25.0]])
    want = np.array([math.erfc(v) for v in x])
    assert np.allclose(tails.erfc(x), want, rtol=1e-12, atol=0, equal_nan=True)
    assert tails.erfc(1.5).shape == () and tails.erfc(np.zeros((2, 3))).tolist() == [[1.0] * 3] * 2
