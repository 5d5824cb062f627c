"""One registered query for each operator or tight group, with DuckDB SQL where SQL expresses it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import volatility as vol
from ..functions.frames import significant
from ..operators import asof, backtest, densities, evaluation, features, forecasts, garch, portfolio, risk, trees
from ..session import shared_folder
from ..sources import tables
from ..sources.bars import lineitem_bars, long_enough, segment_bars, ticker_list, tickers, with_returns
from ..streaming import windows
from ..streaming.bars import closed_days
from . import experiments, pipeline

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# --- SQL shared by the oracles ---------------------------------------------------------------------------------------
_BARS = """WITH x AS (SELECT l_returnflag AS ticker, l_shipdate::DATE AS dt, l_extendedprice AS p, l_orderkey AS k1, l_linenumber AS k2 FROM lineitem),
b AS (SELECT ticker, dt, arg_min(p, ROW(k1, k2, p)) AS open, max(p) AS high, min(p) AS low, sum(round(p * 100)::BIGINT)::DOUBLE / count(*) / 100 AS close FROM x GROUP BY 1, 2),
c AS (SELECT *, close / lag(close) OVER w - 1 AS ret, ln(close / lag(close) OVER w) AS logret FROM b WINDOW w AS (PARTITION BY ticker ORDER BY dt)),
bars AS (SELECT * FROM c WHERE ret IS NOT NULL)"""
_SEGMENTS = """WITH x AS (SELECT c_mktsegment AS ticker, o_orderdate::DATE AS dt, o_totalprice AS p, o_orderkey AS k1 FROM orders JOIN customer ON o_custkey = c_custkey),
b AS (SELECT ticker, dt, arg_min(p, ROW(k1, p)) AS open, max(p) AS high, min(p) AS low, sum(round(p * 100)::BIGINT)::DOUBLE / count(*) / 100 AS close FROM x GROUP BY 1, 2),
c AS (SELECT *, close / lag(close) OVER w - 1 AS ret FROM b WINDOW w AS (PARTITION BY ticker ORDER BY dt)),
bars AS (SELECT * FROM c WHERE ret IS NOT NULL)"""
_OVER = "OVER (PARTITION BY ticker ORDER BY dt ROWS BETWEEN {} AND {})"


def _frame(first: int, last: int) -> str:
    place = lambda k: f"{-k} PRECEDING" if k < 0 else "CURRENT ROW" if k == 0 else f"{k} FOLLOWING"
    return _OVER.format(place(first), place(last))


def _full(f: str, x: str, first: int, last: int) -> str:
    w = _frame(first, last)
    return f"CASE WHEN count({x}) {w} = {last - first + 1} THEN {f}({x}) {w} END"


def _sig(x: str, name: str, digits: int = 8) -> str:
    return f"printf('%.{digits - 1}e', round(({x})::DOUBLE, 15))::DOUBLE AS {name}"


def _p_normal_sql(z: str) -> str:
    """Two-sided p by Simpson's rule over 400 steps, to nine decimals."""
    x = f"least(abs({z}), 10.0::DOUBLE)"
    area = f"{x} / 1200 * list_sum([(CASE WHEN i = 0 OR i = 400 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-((i * {x} / 400) ** 2) / 2) for i in range(401)]) / sqrt(2 * pi())"
    return f"round(greatest(0.0::DOUBLE, 1 - 2 * ({area})), 6)"


def _p_chi2_sql(x: str, k: int) -> str:
    if k % 2 == 0:
        terms, term = [], "1.0::DOUBLE"
        for j in range(k // 2):
            term = term if j == 0 else f"({term}) * ({x}) / {2 * j}"
            terms.append(term)
        return f"round(exp(-({x}) / 2) * ({' + '.join(terms)}), 6)"
    odd = {1: "0", 9: f"sqrt(2 * ({x}) / pi()) * exp(-({x}) / 2) * (1 + ({x}) / 3 + ({x}) ** 2 / 15 + ({x}) ** 3 / 105)"}[k]
    return f"round({_p_normal_sql(f'sqrt(greatest({x}, 0.0::DOUBLE))')} + {odd}, 6)"


def _p6(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


_FRAME = f"""{_BARS},
rv0 AS (SELECT *, {_full('sum', 'ret * ret', 1, 1)} AS f1, sqrt(ret * ret) * sqrt(252.0::DOUBLE) AS rv, row_number() OVER (PARTITION BY ticker ORDER BY dt) AS n FROM bars),
e AS (SELECT ticker, dt, n, ret, sum(ret) OVER w20 AS s1, 0.94::DOUBLE AS l FROM rv0 WINDOW w20 AS (PARTITION BY ticker ORDER BY dt ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
ew AS (WITH RECURSIVE q AS (SELECT ticker, 20::BIGINT AS n, var_samp(ret) AS v FROM e WHERE n <= 20 GROUP BY ticker HAVING count(*) = 20
  UNION ALL SELECT q.ticker, q.n + 1, 0.94::DOUBLE * q.v + 0.06::DOUBLE * e.ret * e.ret FROM q JOIN e ON e.ticker = q.ticker AND e.n = q.n JOIN e AS nx ON nx.ticker = q.ticker AND nx.n = q.n + 1)
  SELECT ticker, n, sqrt(v * 252) AS ewma FROM q),
h AS (SELECT *, abs(ret) AS d, sqrt({_full('avg', 'ret * ret', -4, 0)}) AS wk, sqrt({_full('avg', 'ret * ret', -21, 0)}) AS mo FROM rv0),
h1 AS (SELECT *, lag(d) OVER w AS a, lag(wk) OVER w AS bb, lag(mo) OVER w AS cc FROM h WINDOW w AS (PARTITION BY ticker ORDER BY dt)),
h2 AS (SELECT *, count(*) FILTER (WHERE cc IS NOT NULL) {_frame(-251, -1)} AS kk, {', '.join(f"sum({p} * {q}) FILTER (WHERE cc IS NOT NULL) {_frame(-251, -1)} AS {p}_{q}" for p, q in (('a', 'a'), ('a', 'bb'), ('a', 'cc'), ('bb', 'bb'), ('bb', 'cc'), ('cc', 'cc'), ('a', 'd'), ('bb', 'd'), ('cc', 'd')))} FROM h1),
h3 AS (SELECT *, a_a * (bb_bb * cc_cc - bb_cc * bb_cc) - a_bb * (a_bb * cc_cc - bb_cc * a_cc) + a_cc * (a_bb * bb_cc - bb_bb * a_cc) AS det,
  a_d * (bb_bb * cc_cc - bb_cc * bb_cc) - a_bb * (bb_d * cc_cc - bb_cc * cc_d) + a_cc * (bb_d * bb_cc - bb_bb * cc_d) AS da,
  a_a * (bb_d * cc_cc - bb_cc * cc_d) - a_d * (a_bb * cc_cc - bb_cc * a_cc) + a_cc * (a_bb * cc_d - bb_d * a_cc) AS db,
  a_a * (bb_bb * cc_d - bb_d * bb_cc) - a_bb * (a_bb * cc_d - bb_d * a_cc) + a_d * (a_bb * bb_cc - bb_bb * a_cc) AS dc FROM h2),
h4 AS (SELECT *, CASE WHEN n > 274 AND kk >= 50 AND det <> 0 THEN greatest((da * a + db * bb + dc * cc) / det, 1e-8::DOUBLE) END AS hr FROM h3),
ff AS (SELECT h4.ticker, h4.dt, open, high, low, close, ret, h4.n, sqrt(f1) * sqrt(252.0::DOUBLE) AS realized, lag(rv) OVER w AS naive, {_full('avg', 'rv', -22, -1)} AS roll_mean,
  last_value(hr IGNORE NULLS) OVER (PARTITION BY h4.ticker ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) * sqrt(252.0::DOUBLE) AS har_rv, ewma
  FROM (SELECT h4.*, ew.ewma FROM h4 LEFT JOIN ew ON h4.ticker = ew.ticker AND h4.n = ew.n) AS h4 WINDOW w AS (PARTITION BY h4.ticker ORDER BY dt)),
frame AS (SELECT * FROM ff WHERE coalesce(naive, roll_mean, har_rv, ewma) IS NOT NULL AND realized IS NOT NULL)"""
_LONG = f"""{_FRAME},
long AS (SELECT ticker, dt, realized AS y, m.model, m.place, m.f FROM frame, LATERAL (SELECT unnest([{{'model': 'naive', 'place': 0, 'f': naive}}, {{'model': 'roll_mean', 'place': 1, 'f': roll_mean}}, {{'model': 'har_rv', 'place': 2, 'f': har_rv}}, {{'model': 'ewma', 'place': 3, 'f': ewma}}]) AS m))"""


def _loss_sql(y: str, f: str) -> dict[str, str]:
    q = f"CASE WHEN {y} * {y} >= 1e-12 AND {f} IS NOT NULL THEN ({y} * {y}) / greatest({f} * {f}, 1e-12::DOUBLE) END"
    return {
        "mae": f"avg(abs({f} - {y}))",
        "rmse": f"sqrt(avg(({f} - {y}) * ({f} - {y})))",
        "correlation": f"CASE WHEN count(*) FILTER (WHERE {f} IS NOT NULL AND {y} IS NOT NULL) = count(*) THEN corr({y}, {f}) END",
        "qlike": f"avg(({q}) - ln({q}) - 1)",
        "mse_var": f"avg(({f} * {f} - {y} * {y}) ** 2)",
        "log_vol": f"avg(CASE WHEN {f} IS NOT NULL AND {y} IS NOT NULL THEN (ln(greatest({f}, 1e-12::DOUBLE)) - ln(greatest({y}, 1e-12::DOUBLE))) ** 2 END)",
    }


_METRICS = f"{_LONG}, m AS (SELECT ticker, model, {', '.join(f'{v} AS {k}' for k, v in _loss_sql('y', 'f').items())}, count(f) AS n FROM long GROUP BY 1, 2)"


def _add(name: str, query: Query, oracle: str | None = None) -> None:
    QUERIES[name] = query
    if oracle:
        ORACLES[name] = oracle


def _rounded(df: DataFrame, keys: list[str], digits: int = 8) -> DataFrame:
    """Keys as they are, other columns to significant digits."""
    return df.select(*(F.col(c) if c in keys else significant(F.col(c), digits).alias(c) for c in df.columns))


def _bars(spark, sf_dir):
    return with_returns(lineitem_bars(spark, sf_dir))


def _evaluated(spark, sf_dir):
    return pipeline.forecast_frame(_bars(spark, sf_dir))


def _long(spark, sf_dir):
    return forecasts.long_form(_evaluated(spark, sf_dir), pipeline.MODELS)


_KEY = ["ticker", "dt"]
_B6 = ["open", "high", "low", "close", "ret", "logret"]
_add("a01_bars", lambda s, d: _rounded(_bars(s, d).select(*_KEY, *_B6), _KEY, 13), f"{_BARS} SELECT ticker, dt, {', '.join(_sig(c, c, 13) for c in _B6)} FROM bars")
_add("a10_tickers", lambda s, d: tickers(s.read.parquet(f"{d}/nation.parquet"), "n_name", 9), "SELECT DISTINCT trim(n_name) AS symbol FROM nation WHERE length(trim(n_name)) BETWEEN 1 AND 9 AND lower(trim(n_name)) <> 'nan'")

_HL, _CO = "ln(high / low)", "ln(close / open)"
_PK, _GK, _RS = f"sqrt({_HL} ** 2 / (4 * ln(2)))", f"sqrt(greatest(0.5 * {_HL} ** 2 - (2 * ln(2) - 1) / 2 * {_CO} ** 2, 1e-12::DOUBLE))", "sqrt(greatest(ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open), 1e-12::DOUBLE))"
_add(
    "c01_c03_range_estimators",
    lambda s, d: _rounded(_bars(s, d).select(*_KEY, vol.parkinson().alias("parkinson"), vol.garman_klass().alias("gk"), vol.rogers_satchell().alias("rs")), _KEY, 7),
    f"{_BARS} SELECT ticker, dt, {_sig(_PK, 'parkinson', 7)}, {_sig(_GK, 'gk', 7)}, {_sig(_RS, 'rs', 7)} FROM bars",
)
_add(
    "c04_c10_realized",
    lambda s, d: _rounded(_bars(s, d).select(*_KEY, vol.realized(5).alias("rv5"), vol.realized_variance(5).alias("var5"), vol.range_based(5, "rs").alias("range5"), *(vol.forward_realized(h).alias(f"fwd{h}") for h in (1, 5, 21)), vol.annualized(vol.realized(2)).alias("ann")), _KEY),
    f"{_BARS}, g AS (SELECT *, {_RS} AS rs FROM bars) SELECT ticker, dt, {_sig('sqrt(' + _full('sum', 'ret * ret', -4, 0) + ')', 'rv5')}, {_sig(_full('sum', 'ret * ret', -4, 0), 'var5')}, {_sig('sqrt(' + _full('avg', 'rs * rs', -4, 0) + ')', 'range5')}, "
    + ", ".join(_sig(f"sqrt({_full('sum', 'ret * ret', 1, h)}) * sqrt(252::DOUBLE / {h})", f"fwd{h}") for h in (1, 5, 21))
    + f", {_sig('sqrt(' + _full('sum', 'ret * ret', -1, 0) + ') * sqrt(126::DOUBLE)', 'ann')} FROM g",
)


def _d_features(s, d):
    df, names = features.build(_bars(s, d))
    return _rounded(df.select(*_KEY, *names), _KEY, 6)


_add(
    "d01_d08_features",
    _d_features,
    f"{_BARS}, g AS (SELECT *, {_GK} AS gk, close / max(close) OVER (PARTITION BY ticker ORDER BY dt ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM bars) SELECT ticker, dt, "
    + ", ".join(
        [_sig(f"sqrt({_full('sum', 'ret * ret', 1 - w, 0)})", f"rolling_vol_{w}", 6) for w in (5, 10, 20, 63)]
        + [_sig(_full("avg", "abs(ret)", 1 - w, 0), f"rolling_abs_{w}", 6) for w in (5, 10)]
        + [_sig(_full("stddev_samp", "ret", 1 - w, 0), f"return_std_{w}", 6) for w in (5, 20)]
        + [_sig(f"sqrt({_full('avg', 'gk * gk', -4, 0)})", "range_vol_gk", 6), _sig("abs(ret)", "rv_d", 6), _sig(f"sqrt({_full('avg', 'ret * ret', -4, 0)})", "rv_w", 6), _sig(f"sqrt({_full('avg', 'ret * ret', -21, 0)})", "rv_m", 6)]
        + [_sig(_full("skewness", "ret", -19, 0), "rolling_skew_20", 6), _sig(_full("kurtosis", "ret", -19, 0), "rolling_kurt_20", 6), _sig("dd", "drawdown", 6), _sig(_full("min", "dd", -4, 0), "drawdown_5", 6)]
    )
    + " FROM g",
)
_FC = ["realized", *pipeline.MODELS]
_add("e01_e04_forecasts", lambda s, d: _rounded(_evaluated(s, d).select(*_KEY, *_FC), _KEY, 7), f"{_FRAME} SELECT ticker, dt, {', '.join(_sig(c, c, 7) for c in _FC)} FROM frame")
_add(
    "e12_gas",
    lambda s, d: _rounded(forecasts.gas(_bars(s, d)), _KEY),
    f"""{_BARS}, e AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY dt) AS n FROM bars),
q AS (WITH RECURSIVE q AS (SELECT ticker, 252::BIGINT AS n, avg(ret * ret) AS f FROM e WHERE n <= 252 GROUP BY ticker HAVING count(*) = 252
  UNION ALL SELECT q.ticker, q.n + 1, greatest(0.01::DOUBLE + 0.08::DOUBLE * (e.ret * e.ret - q.f) + 0.90::DOUBLE * q.f, 1e-12::DOUBLE) FROM q JOIN e ON e.ticker = q.ticker AND e.n = q.n) SELECT * FROM q)
SELECT e.ticker, e.dt, {_sig('sqrt(q.f * 252)', 'gas')} FROM e LEFT JOIN q ON e.ticker = q.ticker AND e.n = q.n""",
)


def _e10(s, d):
    df, names = features.build(_bars(s, d))
    return forecasts.ridge(df.withColumn("target", vol.forward_realized(1)), names, "target", window=1260, step=2)


_add("e10_ridge", _e10)
_EM = ["naive", "roll_mean", "ewma"]
_add(
    "e14_rank_ensemble",
    lambda s, d: _rounded(forecasts.rank_ensemble(_evaluated(s, d), _EM), _KEY, 7),
    f"""{_LONG}, ok AS (SELECT ticker, dt FROM frame WHERE naive IS NOT NULL AND roll_mean IS NOT NULL AND ewma IS NOT NULL), l AS (SELECT long.* FROM long JOIN ok USING (ticker, dt) WHERE model <> 'har_rv'),
g AS (SELECT *, row_number() OVER w AS n, CASE WHEN count(*) OVER p >= 50 THEN sqrt(avg((y - f) ** 2) OVER p) ELSE 'inf'::DOUBLE END AS rmse FROM l WINDOW w AS (PARTITION BY ticker, model ORDER BY dt), p AS (PARTITION BY ticker, model ORDER BY dt ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING)),
k AS (SELECT *, 1.0::DOUBLE / row_number() OVER (PARTITION BY ticker, dt ORDER BY rmse, place) AS w FROM g WHERE n > 252)
SELECT ticker, dt, {_sig('sum(w * f) / sum(w)', 'ensemble', 7)} FROM k GROUP BY 1, 2""",
)
_LOSSES = list(_loss_sql("y", "f"))
_add("f01_f06_metrics", lambda s, d: _rounded(pipeline.model_metrics(_bars(s, d)), ["ticker", "model", "n"], 7), f"{_METRICS} SELECT ticker, model, n, {', '.join(_sig(c, c, 7) for c in _LOSSES)} FROM m")
_REGIME = f"{_FRAME}, q AS (SELECT ticker, quantile_cont(realized, 0.33) AS q1, quantile_cont(realized, 0.67) AS q2 FROM frame GROUP BY 1), g AS (SELECT frame.*, CASE WHEN realized <= q1 THEN 'low' WHEN realized <= q2 THEN 'medium' ELSE 'high' END AS regime FROM frame JOIN q USING (ticker))"
_EW = _loss_sql("realized", "ewma")
_add("f08_f09_regimes", lambda s, d: _rounded(evaluation.by_regime(evaluation.regimes(_evaluated(s, d)), "ewma"), ["ticker", "regime", "n"], 7), f"{_REGIME} SELECT ticker, regime, count(*) AS n, {', '.join(_sig(_EW[c], c, 7) for c in ('mae', 'rmse', 'qlike'))} FROM g WHERE ewma IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 10")


def _dm_sql(loss: str) -> str:
    cost = {"squared": "({}) ** 2", "absolute": "abs({})"}[loss]
    return f"""{_LONG}, dd AS (SELECT a.ticker, a.model, a.dt, {cost.format('a.y - a.f')} - {cost.format('b.y - b.f')} AS d FROM long a JOIN long b ON a.ticker = b.ticker AND a.dt = b.dt AND b.model = 'ewma' WHERE a.model <> 'ewma' AND a.f IS NOT NULL AND b.f IS NOT NULL),
dz AS (SELECT *, d - avg(d) OVER (PARTITION BY ticker, model) AS z FROM dd), l AS (SELECT *, lag(z) OVER (PARTITION BY ticker, model ORDER BY dt) AS z1 FROM dz),
st AS (SELECT ticker, model, count(*) AS n, avg(d) / sqrt((avg(z * z) + 2 * 0.5 * avg(z * z1)) / count(*)) AS s FROM l GROUP BY 1, 2)
SELECT ticker, model, n, {_sig('s', 'dm', 6)}, {_p_normal_sql('s')} AS p FROM st"""


_add(
    "f10_f11_diebold_mariano",
    lambda s, d: _rounded(_p6(evaluation.diebold_mariano(_evaluated(s, d), pipeline.MODELS, "ewma"), "p"), ["ticker", "model", "n", "p"], 6),
    _dm_sql("squared"),
)
_add("f10_absolute_loss", lambda s, d: _rounded(_p6(evaluation.diebold_mariano(_evaluated(s, d), pipeline.MODELS, "ewma", loss="absolute"), "p"), ["ticker", "model", "n", "p"], 6), _dm_sql("absolute"))
_add("j14_dm_summary", lambda s, d: _p6(experiments.dm_summary(evaluation.diebold_mariano(_evaluated(s, d), pipeline.MODELS, "ewma")), "mean_p", "std_p"), f"SELECT model, round(avg(p), 6) AS mean_p, round(stddev_samp(p), 6) AS std_p FROM ({_dm_sql('squared')}) GROUP BY 1")
_IV = ["lower", "upper"]
_add(
    "f12_intervals",
    lambda s, d: _rounded(evaluation.intervals(_evaluated(s, d), "ewma").select(*_KEY, *_IV), _KEY, 7),
    f"{_FRAME}, q AS (SELECT ticker, quantile_cont(realized - ewma, 0.05) AS ql, quantile_cont(realized - ewma, 0.95) AS qu FROM frame GROUP BY 1) SELECT ticker, dt, {_sig('CASE WHEN ewma IS NOT NULL THEN greatest(ewma + ql, 1e-8::DOUBLE) END', 'lower', 7)}, {_sig('CASE WHEN ewma IS NOT NULL THEN greatest(ewma + qu, 1e-8::DOUBLE) END', 'upper', 7)} FROM frame JOIN q USING (ticker)",
)
_add(
    "f13_residual_acf",
    lambda s, d: _rounded(evaluation.residual_diagnostics(_evaluated(s, d), "ewma"), ["ticker", "lag", "n"], 6),
    f"{_FRAME}, r AS (SELECT ticker, dt, realized - ewma AS r, row_number() OVER (PARTITION BY ticker ORDER BY dt) AS i FROM frame WHERE ewma IS NOT NULL), rc AS (SELECT ticker, count(*) AS n FROM r GROUP BY 1) SELECT a.ticker, a.i - b.i AS lag, rc.n, {_sig('corr(a.r, b.r)', 'acf', 6)} FROM r a JOIN r b ON a.ticker = b.ticker AND a.i - b.i BETWEEN 1 AND 20 JOIN rc ON rc.ticker = a.ticker GROUP BY 1, 2, 3",
)

_add(
    "f13_ljung_box",
    lambda s, d: _rounded(_p6(evaluation.ljung_box(evaluation.residual_diagnostics(_evaluated(s, d), "ewma")), "p"), ["ticker", "n", "p"], 6),
    f"{_FRAME}, r AS (SELECT ticker, dt, realized - ewma AS r, row_number() OVER (PARTITION BY ticker ORDER BY dt) AS i FROM frame WHERE ewma IS NOT NULL), rc AS (SELECT ticker, count(*) AS n FROM r GROUP BY 1), ac AS (SELECT a.ticker, a.i - b.i AS lag, rc.n, corr(a.r, b.r) AS c FROM r a JOIN r b ON a.ticker = b.ticker AND a.i - b.i BETWEEN 1 AND 20 JOIN rc ON rc.ticker = a.ticker GROUP BY 1, 2, 3), lb AS (SELECT ticker, n, n * (n + 2) * sum(c * c / (n - lag)) AS q FROM ac GROUP BY 1, 2) SELECT ticker, n, {_sig('q', 'q', 6)}, {_p_chi2_sql('q', 20)} AS p FROM lb",
)
_add(
    "f07_plain_metrics",
    lambda s, d: _rounded(evaluation.plain_metrics(_long(s, d), "ticker", "model"), ["ticker", "model"], 6),
    f"{_LONG}, w AS (SELECT ticker, model, count(f) = count(*) AS whole, avg(abs(f - y)) AS mae, sqrt(avg((f - y) ** 2)) AS rmse, corr(y, f) AS correlation FROM long GROUP BY 1, 2) SELECT ticker, model, {', '.join(_sig(f'CASE WHEN whole THEN {c} END', c, 6) for c in ('mae', 'rmse', 'correlation'))} FROM w",
)


def _horizon_sql(h: int) -> str:
    """The metrics query for another horizon: target, realised volatility and the lags that depend on it."""
    out = _METRICS
    for old, new in (
        (_full("sum", "ret * ret", 1, 1), _full("sum", "ret * ret", 1, h)),
        ("sqrt(ret * ret) * sqrt(252.0::DOUBLE) AS rv", f"sqrt({_full('sum', 'ret * ret', 1 - h, 0)}) * sqrt(252.0::DOUBLE / {h}) AS rv"),
        ("sqrt(f1) * sqrt(252.0::DOUBLE) AS realized", f"sqrt(f1) * sqrt(252.0::DOUBLE / {h}) AS realized"),
        ("lag(rv) OVER w AS naive", f"lag(rv, {h}) OVER w AS naive"),
        (_full("avg", "rv", -22, -1), _full("avg", "rv", -21 - h, -h)),
    ):
        assert out.count(old) == 1, old
        out = out.replace(old, new)
    return f"SELECT * FROM ({out} SELECT {h} AS horizon, ticker, model, n, {', '.join(_sig(c, c, 6) for c in _LOSSES)} FROM m)"


_add("f06_horizons", lambda s, d: _rounded(pipeline.horizons(_bars(s, d)), ["ticker", "model", "horizon", "n"], 6), " UNION ALL ".join(_horizon_sql(h) for h in (1, 5, 21)))


def _long_horizons(s, d):
    out = None
    for h in (1, 5, 21):
        one = forecasts.long_form(pipeline.forecast_frame(_bars(s, d), h), pipeline.MODELS).withColumn("horizon", F.lit(h))
        out = one if out is None else out.unionByName(one)
    return out


def _cube_sql() -> str:
    long = " UNION ALL ".join(f"SELECT * FROM ({_horizon_sql(h).split(' FROM (', 1)[1].split(', m AS (SELECT ticker, model')[0]} SELECT ticker, model, {h} AS horizon, y, f FROM long)" for h in (1, 5, 21))
    made = f"WITH h AS ({long}), g AS (SELECT ticker, model, horizon, grouping(ticker, model, horizon) AS slice, avg(abs(f - y)) AS mae, count(f) AS n FROM h GROUP BY CUBE (ticker, model, horizon))"
    return f"{made} SELECT ticker, model, horizon, slice, n, {_sig('mae', 'mae', 7)}, CASE WHEN slice & 2 = 0 THEN rank() OVER (PARTITION BY slice, ticker, horizon ORDER BY mae NULLS LAST) END AS rank FROM g"


_add("j12_cube", lambda s, d: _rounded(portfolio.cube(_long_horizons(s, d)), ["ticker", "model", "horizon", "slice", "n", "rank"], 7), _cube_sql())
_U = "list_sort([('0x' || substr(md5(ticker || '|' || dt || '|42|' || j), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE for j in range(500)])"
_add(
    "f12_bootstrap",
    lambda s, d: _rounded(evaluation.bootstrap_intervals(_evaluated(s, d), "ewma"), _KEY, 7),
    f"""{_FRAME}, rs AS (SELECT ticker, realized - ewma AS r, row_number() OVER (PARTITION BY ticker ORDER BY realized - ewma) - 1 AS rank FROM frame WHERE ewma IS NOT NULL), sz AS (SELECT ticker, count(*) AS size FROM rs GROUP BY 1),
us AS (SELECT ticker, dt, ewma AS f, size, {_U} AS u FROM frame JOIN sz USING (ticker) WHERE ewma IS NOT NULL),
pk AS (SELECT ticker, dt, f, v.side, v.w, floor(u[v.k] * size)::BIGINT AS rank FROM us, (VALUES ('l', 25, 1 - (0.05::DOUBLE * 499 - 24)), ('l', 26, 0.05::DOUBLE * 499 - 24), ('u', 475, 1 - (0.95::DOUBLE * 499 - 474)), ('u', 476, 0.95::DOUBLE * 499 - 474)) AS v(side, k, w)),
en AS (SELECT ticker, dt, sum(w * greatest(f + r, 1e-8::DOUBLE)) FILTER (WHERE side = 'l') AS lower, sum(w * greatest(f + r, 1e-8::DOUBLE)) FILTER (WHERE side = 'u') AS upper FROM pk JOIN rs USING (ticker, rank) GROUP BY 1, 2)
SELECT ticker, dt, {_sig('lower', 'lower', 7)}, {_sig('upper', 'upper', 7)} FROM frame LEFT JOIN en USING (ticker, dt)""",
)


def _numpy_losses(y, f):
    ratio = np.where(y * y >= 1e-12, y * y, np.nan) / np.maximum(f * f, 1e-12)
    return {"qlike": ratio - np.log(ratio) - 1}


_add("f06_user_loss", lambda s, d: _rounded(evaluation.user_loss(_long(s, d), ["ticker", "model"], _numpy_losses), ["ticker", "model", "n"], 6), f"{_LONG}, q AS (SELECT ticker, model, CASE WHEN y * y >= 1e-12 AND f IS NOT NULL THEN y * y / greatest(f * f, 1e-12::DOUBLE) END AS q FROM long) SELECT ticker, model, count(q) AS n, {_sig('avg(q - ln(q) - 1)', 'loss', 6)} FROM q GROUP BY 1, 2")


def _hits(s, d, alpha=0.05):
    return risk.normal_var_es(_evaluated(s, d), "ewma", alpha)


_Z = repr(-__import__("statistics").NormalDist().inv_cdf(0.05))
_HITS = f"{_FRAME}, v AS (SELECT *, greatest(ewma, 1e-10::DOUBLE) / sqrt(252.0::DOUBLE) * {_Z}::DOUBLE AS var, greatest(ewma, 1e-10::DOUBLE) / sqrt(252.0::DOUBLE) * (exp(-({_Z}::DOUBLE * {_Z}::DOUBLE) / 2) / sqrt(2 * pi()) / 0.05::DOUBLE) AS es FROM frame WHERE ewma IS NOT NULL), hits AS (SELECT *, CASE WHEN ret < -abs(var) THEN 1 ELSE 0 END AS hit FROM v)"
_VE = ["var", "es"]
_add("g03_g07_var_es", lambda s, d: _rounded(_hits(s, d).where("ewma IS NOT NULL").select(*_KEY, F.col("hit").cast("long").alias("hit"), *_VE), [*_KEY, "hit"], 7), f"{_HITS} SELECT ticker, dt, hit::BIGINT AS hit, {_sig('var', 'var', 7)}, {_sig('es', 'es', 7)} FROM hits")
_add(
    "g08_g10_coverage",
    lambda s, d: _rounded(_p6(risk.coverage(_hits(s, d), 0.05), "p_uc", "p_ind"), ["ticker", "n", "x", "p_uc", "p_ind"], 6),
    f"""{_HITS}, p AS (SELECT *, lag(hit) OVER (PARTITION BY ticker ORDER BY dt) AS prev FROM hits),
cn AS (SELECT ticker, count(*) AS n, sum(hit)::BIGINT AS x, {', '.join(f"(count(*) FILTER (WHERE prev = {a} AND hit = {b}))::DOUBLE AS n{a}{b}" for a in (0, 1) for b in (0, 1))} FROM p GROUP BY 1),
k AS (SELECT *, x / n AS ph, n01 / nullif(n00 + n01, 0) AS p0, n11 / nullif(n10 + n11, 0) AS p1, (n01 + n11) / nullif(n00 + n01 + n10 + n11, 0) AS q FROM cn),
s AS (SELECT *, CASE WHEN x > 0 AND x < n THEN -2 * ((n - x) * ln(0.95::DOUBLE / (1 - ph)) + x * ln(0.05::DOUBLE / ph)) END AS uc,
  CASE WHEN x > 0 AND x < n AND q > 0 AND q < 1 THEN -2 * ((n00 + n10) * ln(1 - q) + (n01 + n11) * ln(q) - (CASE WHEN n00 = 0 THEN 0 ELSE n00 * ln(1 - p0) END + CASE WHEN n01 = 0 THEN 0 ELSE n01 * ln(p0) END + CASE WHEN n10 = 0 THEN 0 ELSE n10 * ln(1 - p1) END + CASE WHEN n11 = 0 THEN 0 ELSE n11 * ln(p1) END)) END AS ind FROM k)
SELECT ticker, n, x, {_sig('uc', 'lr_uc', 6)}, {_sig('ind', 'lr_ind', 6)}, {_sig('uc + ind', 'lr_cc', 6)}, {_sig('exp(-(uc + ind) / 2)', 'p_cc', 6)}, {_p_chi2_sql('uc', 1)} AS p_uc, {_p_chi2_sql('ind', 1)} AS p_ind FROM s""",
)
_add(
    "g17_clustering",
    lambda s, d: _rounded(risk.clustering(_hits(s, d).where("ewma IS NOT NULL")), ["ticker", "n_violations", "max_run"]),
    f"""{_HITS}, i AS (SELECT ticker, dt, hit, row_number() OVER (PARTITION BY ticker ORDER BY dt) AS i FROM hits), h5 AS (SELECT *, row_number() OVER w AS k, i - lag(i) OVER w AS gap FROM i WHERE hit = 1 WINDOW w AS (PARTITION BY ticker ORDER BY dt)),
runs AS (SELECT ticker, i - k AS g, count(*) AS len FROM h5 GROUP BY 1, 2), rr AS (SELECT ticker, avg(len) AS mean_run, max(len) AS max_run FROM runs GROUP BY 1)
SELECT h5.ticker, count(*) AS n_violations, {_sig('any_value(mean_run)', 'mean_run')}, any_value(max_run) AS max_run, {_sig('avg(gap)', 'mean_gap')} FROM h5 JOIN rr USING (ticker) GROUP BY 1""",
)
_add(
    "g12_g14_es_scores",
    lambda s, d: _rounded(risk.es_scores(_hits(s, d).where("ewma IS NOT NULL"), 0.05), ["ticker"], 6),
    f"""{_HITS}, sc AS (SELECT ticker, hit, -ret AS x, var AS v, es AS e, exp(greatest(-20.0::DOUBLE, least(20.0::DOUBLE, es))) AS g FROM hits)
SELECT ticker, {_sig("CASE WHEN count(*) FILTER (WHERE hit = 1 AND e > 1e-10) >= 5 THEN avg(x / e) FILTER (WHERE hit = 1 AND e > 1e-10) END", "es_ratio", 6)}, {_sig("avg(((x >= v)::INT - 0.05::DOUBLE) * (v - least(x, v)) + g * (x >= v)::INT * (x - v) / 0.05::DOUBLE + g * (e - v) - g)", "fz", 6)} FROM sc GROUP BY 1""",
)


def _path(s, d):
    return backtest.volatility_target(_evaluated(s, d), "ewma", cost_bps=5, slippage_bps=2)


_PATH = f"""{_FRAME}, p0 AS (SELECT ticker, dt, ret, greatest(coalesce(ewma, first_value(ewma IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY dt ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 1e-8::DOUBLE) AS vf FROM frame),
p1 AS (SELECT *, greatest(least(0.10::DOUBLE / vf, 3.0::DOUBLE), 0.0::DOUBLE) AS leverage FROM p0), p2 AS (SELECT *, lag(leverage) OVER (PARTITION BY ticker ORDER BY dt) AS ll FROM p1),
p3 AS (SELECT *, ll * ret AS scaled, coalesce(abs(ll - lag(ll) OVER (PARTITION BY ticker ORDER BY dt)), 0.0::DOUBLE) AS turnover FROM p2), p4 AS (SELECT *, scaled - (turnover * 5 / 1e4::DOUBLE + abs(scaled) * 2 / 1e4::DOUBLE) AS net FROM p3 WHERE scaled IS NOT NULL),
p5 AS (SELECT *, product(1 + net) OVER w AS cum, abs(leverage - lag(leverage) OVER w) AS t, sqrt({_full('avg', 'scaled * scaled', -21, 0)}) * sqrt(252.0::DOUBLE) AS realized_vol_ann FROM p4 WINDOW w AS (PARTITION BY ticker ORDER BY dt ROWS UNBOUNDED PRECEDING)),
path AS (SELECT *, cum / max(cum) OVER (PARTITION BY ticker ORDER BY dt ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM p5)"""
_PC = ["leverage", "scaled", "turnover", "net", "cum", "drawdown", "realized_vol_ann"]
_add("h01_vol_target", lambda s, d: _rounded(_path(s, d).select(*_KEY, *_PC), _KEY, 6), f"{_PATH} SELECT ticker, dt, {', '.join(_sig(c, c, 6) for c in _PC)} FROM path")
_add(
    "h02_h04_summary",
    lambda s, d: _rounded(backtest.summary(_path(s, d)), ["ticker"], 6),
    f"""{_PATH}, a AS (SELECT ticker, avg(net) AS m, stddev_samp(net) AS s, min(drawdown) AS dd, avg(t) AS t FROM path GROUP BY 1)
SELECT ticker, {_sig('m / (s + 1e-12::DOUBLE) * sqrt(252.0::DOUBLE)', 'sharpe', 6)}, {_sig('dd', 'max_dd', 6)}, {_sig('m * 252', 'mean_ret', 6)}, {_sig('t', 'turnover', 6)}, {_sig('s * sqrt(252.0::DOUBLE)', 'realized_vol', 6)}, {_sig('m * 252 - s * s * 252', 'utility', 6)}, {_sig('abs(s * sqrt(252.0::DOUBLE) - 0.10::DOUBLE)', 'vol_error', 6)} FROM a""",
)
_CV = ["dt", "asset_i", "asset_j"]
_PAIRS = f"""{_SEGMENTS}, days AS (SELECT DISTINCT dt FROM bars), names AS (SELECT DISTINCT ticker FROM bars), panel AS (SELECT dt, ticker, coalesce(ret, 0) AS ret, dense_rank() OVER (ORDER BY dt) AS n FROM days CROSS JOIN names LEFT JOIN bars USING (dt, ticker)),
pp AS (SELECT a.dt, a.n, a.ticker AS i, b.ticker AS j, a.ret AS x, b.ret AS y FROM panel a JOIN panel b ON a.dt = b.dt AND a.ticker <= b.ticker)"""
_ROLLING = f"""{_PAIRS}, g AS (SELECT dt, i AS asset_i, j AS asset_j, count(*) OVER w AS n, covar_samp(x, y) OVER w AS cov, stddev_samp(x) OVER w AS sx, stddev_samp(y) OVER w AS sy FROM pp WINDOW w AS (PARTITION BY i, j ORDER BY dt ROWS BETWEEN 63 PRECEDING AND 1 PRECEDING)), ok AS (SELECT * FROM g WHERE n = 63)"""
_add(
    "i01_i02_covariance",
    lambda s, d: _rounded(portfolio.shrunk(portfolio.rolling_covariance(with_returns(segment_bars(s, d)))), _CV, 6),
    f"{_ROLLING} SELECT dt, asset_i, asset_j, {_sig('CASE WHEN asset_i = asset_j THEN cov ELSE cov * (1 - 0.1::DOUBLE) END', 'cov', 6)}, {_sig('cov / (CASE WHEN sx <= 1e-10 THEN 1 ELSE sx END * CASE WHEN sy <= 1e-10 THEN 1 ELSE sy END)', 'corr', 6)} FROM ok",
)
_PS = ["forecast_vol", "close", "exposure", "multiplier"]
_POS = f"{_FRAME}, one AS (SELECT * FROM frame WHERE ewma IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY dt DESC) = 1), pos AS (SELECT ticker, dt AS signal_date, dt + 1 AS trade_date, ewma AS forecast_vol, close, round_even(least(1.0::DOUBLE, 0.10::DOUBLE / greatest(ewma, 0.05::DOUBLE)) * 10000000 / close, 0) AS sh FROM one)"
_add("i11_i12_positions", lambda s, d: _rounded(portfolio.next_positions(_evaluated(s, d), "ewma", 1e7), ["ticker", "signal_date", "trade_date", "shares"]), f"{_POS} SELECT ticker, signal_date, trade_date::DATE AS trade_date, sh::BIGINT AS shares, {_sig('forecast_vol', 'forecast_vol')}, {_sig('close', 'close')}, {_sig('sh * close', 'exposure')}, {_sig('sh * close / 10000000', 'multiplier')} FROM pos")

_add(
    "i13_fractional_sizing",
    lambda s, d: _rounded(portfolio.next_positions(_evaluated(s, d), "ewma", 1e7, whole=False), ["ticker", "signal_date", "trade_date"], 7),
    f"{_POS}, fr AS (SELECT *, least(1.0::DOUBLE, 0.10::DOUBLE / greatest(forecast_vol, 0.05::DOUBLE)) * 10000000 / close AS share FROM pos) SELECT ticker, signal_date, trade_date::DATE AS trade_date, {_sig('forecast_vol', 'forecast_vol', 7)}, {_sig('close', 'close', 7)}, {_sig('share', 'shares', 7)}, {_sig('share * close', 'exposure', 7)}, {_sig('share * close / 10000000', 'multiplier', 7)} FROM fr",
)


def _seg_metrics(s, d):
    return pipeline.model_metrics(with_returns(segment_bars(s, d)))


_SEG_METRICS = _METRICS.replace(_BARS, _SEGMENTS)
_add("j03_wins", lambda s, d: portfolio.wins(_seg_metrics(s, d), pipeline.MODELS), f"{_SEG_METRICS} SELECT model, count(*) AS wins FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY mae, list_position({pipeline.MODELS!r}, model)) AS r FROM m) WHERE r = 1 GROUP BY 1")
_add("j04_ranks", lambda s, d: _rounded(portfolio.model_ranks(_seg_metrics(s, d)).select("ticker", "model", "rank", "mae"), ["ticker", "model", "rank"], 7), f"{_SEG_METRICS} SELECT ticker, model, rank() OVER (PARTITION BY ticker ORDER BY mae) AS rank, {_sig('mae', 'mae', 7)} FROM m")
_add("j05_top", lambda s, d: _rounded(portfolio.smallest(_seg_metrics(s, d).where("model = 'har_rv'"), "mae", 3).select("ticker", "mae"), ["ticker"], 7), f"{_SEG_METRICS} SELECT ticker, {_sig('mae', 'mae', 7)} FROM (SELECT * FROM m WHERE model = 'har_rv' ORDER BY mae, ticker LIMIT 3)")
_SCORES = f"{_POS.replace(_BARS, _SEGMENTS)}, mo AS (SELECT ticker, (close / old - 1) * 4 AS momentum FROM (SELECT *, lag(close, 63) OVER (PARTITION BY ticker ORDER BY dt) AS old FROM bars) QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY dt DESC) = 1), sc AS (SELECT ticker, momentum / greatest(forecast_vol, 1e-6::DOUBLE) AS score FROM pos JOIN mo USING (ticker) WHERE forecast_vol > 0)"


def _scores(s, d):
    bars = with_returns(segment_bars(s, d))
    return portfolio.scored(portfolio.next_positions(pipeline.forecast_frame(bars), "ewma", 1e7), portfolio.momentum(bars))


_add("j06_j08_scores", lambda s, d: _rounded(_scores(s, d), ["ticker", "rank"], 7), f"{_SCORES} SELECT ticker, row_number() OVER (ORDER BY score DESC, ticker) AS rank, {_sig('score', 'score', 7)} FROM sc")


def _orders(s, d):
    held = s.read.parquet(f"{d}/nation.parquet").select(F.col("n_name").alias("ticker"), (F.col("n_nationkey") % 7).cast("long").alias("qty"))
    wanted = s.read.parquet(f"{d}/nation.parquet").where("n_regionkey > 1").select(F.col("n_name").alias("ticker"), (F.col("n_nationkey") % 5).cast("long").alias("shares"))
    return portfolio.reconcile(held, wanted)


_add("j10_reconcile", _orders, """WITH h AS (SELECT n_name AS ticker, (n_nationkey % 7)::BIGINT AS qty FROM nation), t AS (SELECT n_name AS ticker, (n_nationkey % 5)::BIGINT AS shares FROM nation WHERE n_regionkey > 1),
j AS (SELECT coalesce(h.ticker, t.ticker) AS ticker, coalesce(qty, 0) AS a, shares AS w FROM h FULL JOIN t ON h.ticker = t.ticker)
SELECT ticker, CASE WHEN coalesce(w, 0) > a THEN 'buy' WHEN coalesce(w, 0) < a THEN 'sell' ELSE 'none' END AS side, abs(coalesce(w, 0) - a) AS qty, CASE WHEN w IS NULL THEN 'close' WHEN w = a THEN 'no_change' WHEN a = 0 THEN 'open' ELSE 'adjust' END AS action FROM j WHERE w IS NOT NULL OR a > 0""")
_add("j12_leaderboard", lambda s, d: _rounded(portfolio.leaderboard(_seg_metrics(s, d)), ["model", "n"], 7), f"{_SEG_METRICS} SELECT model, count(*) AS n, {_sig('avg(mae)', 'mae', 7)}, {_sig('avg(qlike)', 'qlike', 7)} FROM m GROUP BY ROLLUP (model)")
_RES = f"{_FRAME}, z AS (SELECT ticker, dt, ret / greatest(ewma / sqrt(252.0::DOUBLE), 1e-10::DOUBLE) AS z FROM frame WHERE ewma IS NOT NULL AND ret IS NOT NULL)"
_add("g01_standardized_residuals", lambda s, d: _rounded(risk.standardized(_evaluated(s, d), "ewma"), _KEY, 7), f"{_RES} SELECT ticker, dt, {_sig('z', 'z', 7)} FROM z")
_add("g02_normal_fit", lambda s, d: _rounded(risk.fit_normal(risk.standardized(_evaluated(s, d), "ewma")), ["ticker", "n"], 6), f"{_RES} SELECT ticker, {_sig('avg(z)', 'mu', 6)}, {_sig('stddev_pop(z) + 1e-8::DOUBLE', 'sigma', 6)}, count(*) AS n FROM z WHERE abs(z) < 20 GROUP BY 1 HAVING count(*) >= 30")
_KU = "CASE WHEN x = 0 THEN -2 * n * ln(0.95::DOUBLE) WHEN x = n THEN -2 * n * ln(0.05::DOUBLE) ELSE -2 * ((n - x) * ln(0.95::DOUBLE / (1 - x / n)) + x * ln(0.05::DOUBLE / (x / n))) END"
_add(
    "g21_kupiec",
    lambda s, d: _rounded(_p6(risk.kupiec(_hits(s, d), 0.05), "p"), ["ticker", "n", "x", "p"], 6),
    f"{_HITS}, ku AS (SELECT ticker, count(*) AS n, sum(hit)::BIGINT AS x FROM hits GROUP BY 1), kl AS (SELECT *, {_KU} AS lr FROM ku) SELECT ticker, n, x, {_sig('lr', 'lr', 6)}, {_p_chi2_sql('lr', 1)} AS p FROM kl",
)
_add(
    "i05_latest_covariance",
    lambda s, d: _rounded(portfolio.latest(with_returns(segment_bars(s, d))).select(*_CV, "cov"), _CV, 6),
    f"{_ROLLING} SELECT dt, asset_i, asset_j, {_sig('cov', 'cov', 6)} FROM ok WHERE dt = (SELECT max(dt) FROM ok)",
)


# --- Signals, reference lists, wide rows and runs --------------------------------------------------------------------
def _saved_signals(s, d):
    """Signals saved by date of run (here the last day of each year), the newest partition read back."""
    base = f"{shared_folder(s)}/signals-{uuid.uuid4().hex}"
    tables.save_signals(_evaluated(s, d).select(*_KEY, "close", *pipeline.MODELS), base, F.make_date(F.year("dt"), F.lit(12), F.lit(31)))
    return tables.latest(tables.newest_signals(s, base), "dt").drop("signal_run_date")


_add("a08_latest_signals", lambda s, d: _rounded(_saved_signals(s, d), _KEY, 7), f"{_FRAME} SELECT ticker, dt, {', '.join(_sig(c, c, 7) for c in ['close', *pipeline.MODELS])} FROM frame WHERE dt = (SELECT max(dt) FROM frame)")
_add("a11_ticker_list", lambda s, d: ticker_list(tickers(s.read.parquet(f"{d}/nation.parquet"), "n_name", 9), 7), "SELECT count(*) AS n, string_agg(symbol, ',' ORDER BY symbol) AS symbols FROM (SELECT DISTINCT trim(n_name) AS symbol FROM nation WHERE length(trim(n_name)) BETWEEN 1 AND 9 AND lower(trim(n_name)) <> 'nan' ORDER BY symbol LIMIT 7)")
_WIDE = [f"{m}_{x}" for m in pipeline.MODELS for x in ("mae", "qlike")]
_add(
    "j01_one_row_each",
    lambda s, d: _rounded(portfolio.one_row_each(pipeline.model_metrics(long_enough(with_returns(segment_bars(s, d)))), pipeline.MODELS), ["ticker"], 6),
    f"{_SEG_METRICS} SELECT ticker, " + ", ".join(_sig(f"max({x}) FILTER (WHERE model = '{m}')", f"{m}_{x}", 6) for m in pipeline.MODELS for x in ("mae", "qlike")) + " FROM m WHERE ticker IN (SELECT ticker FROM bars GROUP BY 1 HAVING count(*) >= 600) GROUP BY 1 HAVING max(n) >= 100",
)
_add("j13_regime_table", lambda s, d: experiments.regime_table(evaluation.by_regime(evaluation.regimes(_evaluated(s, d)), "har_rv")), f"{_REGIME} SELECT ticker, regime, {', '.join(f'round({v}, 6) AS {k}' for k, v in _loss_sql('realized', 'har_rv').items() if k in ('mae', 'rmse', 'qlike'))} FROM g WHERE har_rv IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 10")


def _run_tables(s, d):
    base = f"{shared_folder(s)}/experiments-{uuid.uuid4().hex}"
    experiments.run(_bars(s, d), experiments.Config(cost_bps=5.0), base)
    return experiments.leaderboard(s, base)


_add("a06_j17_run_leaderboard", _run_tables, f"{_METRICS} SELECT model, round(avg(mae), 6) AS mae, round(avg(rmse), 6) AS rmse, round(avg(qlike), 6) AS qlike, count(*) AS n FROM m GROUP BY 1")


def _two_runs(s, d):
    base = f"{shared_folder(s)}/experiments-{uuid.uuid4().hex}"
    experiments.run(_bars(s, d), experiments.Config(), base, "all models")
    experiments.run(_bars(s, d), experiments.Config(models=["naive", "ewma"]), base, "two models")
    shown = experiments.differing(s, base).select("run_id", F.col("value").alias("setting"))
    return experiments.master(s, base).join(shown, "run_id")


_add(
    "j15_runs_compared",
    _two_runs,
    f"""{_METRICS}, r(run_id, models, setting) AS (VALUES ('all models', 4, '["naive","roll_mean","har_rv","ewma"]'), ('two models', 2, '["naive","ewma"]'))
SELECT run_id, models, setting, model, round(avg(mae), 6) AS mae, count(*) AS n FROM m JOIN r ON models = 4 OR model IN ('naive', 'ewma') GROUP BY ALL""",
)


def _capped(s, d):
    parts = s.read.parquet(f"{d}/nation.parquet").select(F.col("n_name").alias("ticker"), (F.col("n_nationkey") % 5).cast("long").alias("shares"), (F.col("n_nationkey") * 3000.0).alias("close"))
    held = s.read.parquet(f"{d}/nation.parquet").where("n_regionkey < 3").select(F.col("n_name").alias("ticker"), F.lit(2).cast("long").alias("qty"))
    return portfolio.reconcile(held, parts)


_add("j10_exposure_cap", _capped, """WITH t AS (SELECT n_name AS ticker, CASE WHEN (n_nationkey % 5) * (n_nationkey * 3000.0) > 100000 THEN 0 ELSE n_nationkey % 5 END::BIGINT AS w FROM nation), h AS (SELECT n_name AS ticker, 2::BIGINT AS a FROM nation WHERE n_regionkey < 3),
j AS (SELECT t.ticker, coalesce(a, 0) AS a, w FROM t LEFT JOIN h USING (ticker))
SELECT ticker, CASE WHEN w > a THEN 'buy' WHEN w < a THEN 'sell' ELSE 'none' END AS side, abs(w - a) AS qty, CASE WHEN w = a THEN 'no_change' WHEN a = 0 THEN 'open' ELSE 'adjust' END AS action FROM j""")


def _asof(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    bought, seen = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("seen_id"), F.col("value").alias("seen_value"))
    return asof.asof(bought, seen, "user_id", tolerance_seconds=36_000).select("event_id", "matched.seen_id", "matched.seen_value")


_add(
    "k17_asof",
    _asof,
    """WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, event_id AS seen_id, value AS seen_value FROM events WHERE event_type = 'view'),
j AS (SELECT p.event_id, v.seen_id, v.seen_value, p.ts - v.ts <= INTERVAL 10 HOUR AS near FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts)
SELECT event_id, CASE WHEN near THEN seen_id END AS seen_id, CASE WHEN near THEN seen_value END AS seen_value FROM j""",
)


def _days(s, d):
    bars = segment_bars(s, d)
    of = lambda name: bars.where(F.col("ticker") == name).select("dt")
    both, only = of("BUILDING").intersect(of("MACHINERY")), of("BUILDING").subtract(of("MACHINERY"))
    kinds = [("both", both), ("first only", only), ("either", of("BUILDING").union(of("MACHINERY")).distinct())]
    out = kinds[0][1].select(F.lit("both").alias("kind"), "dt")
    for kind, df in kinds[1:]:
        out = out.unionByName(df.select(F.lit(kind).alias("kind"), "dt"))
    return out.groupBy("kind").agg(F.count("*").alias("n"), F.min("dt").alias("first"), F.max("dt").alias("last"))


_add("k10_set_operations", _days, """WITH a AS (SELECT DISTINCT o_orderdate::DATE AS dt FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'), b AS (SELECT DISTINCT o_orderdate::DATE AS dt FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY')
SELECT kind, count(*) AS n, min(dt) AS first, max(dt) AS last FROM (SELECT 'both' AS kind, dt FROM (FROM a INTERSECT FROM b) UNION ALL SELECT 'first only', dt FROM (FROM a EXCEPT FROM b) UNION ALL SELECT 'either', dt FROM (FROM a UNION FROM b)) GROUP BY 1""")

# --- Estimated models: no SQL; tested against numpy and simulated series -------------------------------------------------


def _garch(s, d):
    bars = _bars(s, d)
    out = bars.select(*_KEY)
    for kind in garch.KINDS:
        out = out.join(garch.garch(bars, kind, window=1260, step=2), _KEY)
    return out


def _featured(s, d):
    df, names = features.build(_bars(s, d))
    return df.withColumn("target", vol.forward_realized(1)), names


_add("e05_e09_garch", _garch)
_add("e11_ridge_tuned", lambda s, d: forecasts.ridge_tuned(*_featured(s, d), "target"))
_add("e13_boosted_trees", lambda s, d: trees.boosted_trees(*_featured(s, d), "target"))
_add("e15_stacking", lambda s, d: forecasts.stacking(_evaluated(s, d), _EM))
_add("g02_density_fits", lambda s, d: densities.fit(risk.standardized(_evaluated(s, d), "ewma"), "studentt").unionByName(densities.fit(risk.standardized(_evaluated(s, d), "ewma"), "skewt")))
_add("g06_density_pipeline", lambda s, d: densities.density_forecasts(_evaluated(s, d), "ewma"))
_add("g11_dq", lambda s, d: risk.dq(_hits(s, d), 0.05))
_add("g18_report", lambda s, d: risk.report(_hits(s, d), 0.05))
_add("g13_joint_scores", lambda s, d: _rounded(risk.fissler_ziegel(_hits(s, d).where("ewma IS NOT NULL"), 0.05).select(*_KEY, "fz"), _KEY, 6), f"{_HITS}, sc AS (SELECT ticker, dt, -ret AS x, var AS v, es AS e, exp(greatest(-20.0::DOUBLE, least(20.0::DOUBLE, es))) AS g FROM hits) SELECT ticker, dt, {_sig('((x >= v)::INT - 0.05::DOUBLE) * (v - least(x, v)) + g * (x >= v)::INT * (x - v) / 0.05::DOUBLE + g * (e - v) - g', 'fz', 6)} FROM sc")


def _pit(s, d):
    return densities.density_forecasts(_evaluated(s, d).where("ewma IS NOT NULL"), "ewma", "normal")


_PIT = f"{_RES}, pit AS (SELECT ticker, dt, CASE WHEN z < 0 THEN {_p_normal_sql('z').removeprefix('round(').removesuffix(', 6)')} / 2 ELSE 1 - {_p_normal_sql('z').removeprefix('round(').removesuffix(', 6)')} / 2 END AS pit FROM z)"
_HIST = f"{_PIT}, hist AS (SELECT t.ticker, b.bin, (SELECT count(*) FROM pit p WHERE p.ticker = t.ticker AND least(floor(p.pit * 10), 9) = b.bin) AS n FROM (SELECT DISTINCT ticker FROM pit) t, (SELECT unnest(range(10)) AS bin) b)"
_add("g05_pit_normal", lambda s, d: _p6(_pit(s, d).select(*_KEY, "pit"), "pit"), f"{_PIT} SELECT ticker, dt, round(pit, 6) AS pit FROM pit")
_add("g15_pit_histogram", lambda s, d: risk.pit_histogram(_pit(s, d)), f"{_HIST} SELECT * FROM hist")
_add("g16_pit_uniform", lambda s, d: _rounded(_p6(risk.pit_uniform(risk.pit_histogram(_pit(s, d))), "p"), ["ticker", "p"], 6), f"{_HIST}, un AS (SELECT ticker, sum(n * n) * 10.0::DOUBLE / sum(n) - sum(n) AS chi2 FROM hist GROUP BY 1) SELECT ticker, {_sig('chi2', 'chi2', 6)}, {_p_chi2_sql('chi2', 9)} AS p FROM un")

# --- Covariances by recursion, weights and portfolios -----------------------------------------------------------------


def _returns(s, d):
    return with_returns(segment_bars(s, d))


_EWMA_COV = f"""{_PAIRS}, q AS (WITH RECURSIVE q AS (SELECT i, j, 20::BIGINT AS n, covar_samp(x, y) AS c FROM pp WHERE n <= 20 GROUP BY i, j UNION ALL SELECT q.i, q.j, q.n + 1, 0.94::DOUBLE * q.c + 0.06::DOUBLE * pp.x * pp.y FROM q JOIN pp ON pp.i = q.i AND pp.j = q.j AND pp.n = q.n) SELECT * FROM q),
ec AS (SELECT pp.dt, pp.i AS asset_i, pp.j AS asset_j, q.c AS cov, CASE WHEN pp.i = pp.j THEN sqrt(q.c * 252) END AS vol FROM pp JOIN q ON pp.i = q.i AND pp.j = q.j AND q.n = pp.n AND q.n > 20)"""
_add("i03_ewma_covariance", lambda s, d: _rounded(portfolio.ewma_covariance(_returns(s, d)), _CV, 6), f"{_EWMA_COV} SELECT dt, asset_i, asset_j, {_sig('cov', 'cov', 6)}, {_sig('vol', 'vol', 6)} FROM ec")
_add(
    "i04_ewma_correlation",
    lambda s, d: _rounded(portfolio.ewma_correlation_covariance(_returns(s, d), pipeline.forecast_frame(_returns(s, d)).select("ticker", "dt", F.col("ewma").alias("vol")).where("ticker <> 'BUILDING'")), _CV, 6),
    _FRAME.replace(_BARS, _PAIRS) + f""", u AS (SELECT *, x * y / (sqrt(x * x + 1e-12::DOUBLE) * sqrt(y * y + 1e-12::DOUBLE)) AS rho FROM pp),
q AS (WITH RECURSIVE q AS (SELECT i, j, 50::BIGINT AS n, CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS c FROM u WHERE n = 50 UNION ALL SELECT q.i, q.j, q.n + 1, 0.94::DOUBLE * q.c + 0.06::DOUBLE * u.rho FROM q JOIN u ON u.i = q.i AND u.j = q.j AND u.n = q.n) SELECT * FROM q),
sp AS (SELECT p.dt, p.ticker, CASE WHEN p.ticker = 'BUILDING' THEN 0.15::DOUBLE ELSE last_value(f.ewma IGNORE NULLS) OVER (PARTITION BY p.ticker ORDER BY p.dt ROWS UNBOUNDED PRECEDING) END AS v FROM panel p LEFT JOIN frame f ON f.ticker = p.ticker AND f.dt = p.dt),
sd AS (SELECT dt, ticker, greatest(v / sqrt(252.0::DOUBLE), 1e-8::DOUBLE) AS v FROM sp WHERE v IS NOT NULL)
SELECT u.dt, u.i AS asset_i, u.j AS asset_j, {_sig('a.v * q.c * b.v', 'cov', 6)} FROM u JOIN q ON q.i = u.i AND q.j = u.j AND q.n = u.n AND q.n > 50 LEFT JOIN sd a ON a.dt = u.dt AND a.ticker = u.i LEFT JOIN sd b ON b.dt = u.dt AND b.ticker = u.j""",
)
_add("i05_latest_ewma", lambda s, d: _rounded(portfolio.latest(_returns(s, d), "ewma"), _CV, 6), f"{_EWMA_COV} SELECT dt, asset_i, asset_j, {_sig('cov', 'cov', 6)} FROM ec WHERE dt = (SELECT max(dt) FROM ec)")


def _weights(s, d):
    cov = portfolio.rolling_covariance(_returns(s, d))
    rules = {"risk_parity": portfolio.risk_parity, "min_variance": portfolio.minimum_variance, "vol_target": portfolio.volatility_target}
    out = None
    for name, rule in rules.items():
        w = portfolio.weights(cov, rule).select(F.lit(name).alias("rule"), "dt", "ticker", "weight")
        out = w if out is None else out.unionByName(w)
    return out


def _inverse_variance(cov):
    precision = 1 / np.diagonal(cov, axis1=1, axis2=2)
    return precision / precision.sum(1, keepdims=True)


_add("i06_i08_weights", _weights)
_add("i10_risk_parity_backtest", lambda s, d: portfolio.backtest(_returns(s, d)))
_add("i10_minimum_variance_backtest", lambda s, d: portfolio.backtest(_returns(s, d), portfolio.minimum_variance))
_add(
    "i09_k15_backtest_with_callables",
    lambda s, d: _rounded(portfolio.backtest(_returns(s, d), _inverse_variance, lambda r, w: portfolio.shrunk(portfolio.rolling_covariance(r, w)), 63), ["dt"], 6),
    f"""{_ROLLING}, v AS (SELECT dt, asset_i AS i, (1 / cov) / sum(1 / cov) OVER (PARTITION BY dt) AS w FROM ok WHERE asset_i = asset_j),
f AS (SELECT dt, lead(dt) OVER (ORDER BY dt) AS nx FROM (SELECT DISTINCT dt FROM ok))
SELECT f.nx AS dt, {_sig('sum(v.w * panel.ret)', 'ret', 6)} FROM v JOIN f USING (dt) JOIN panel ON panel.dt = f.nx AND panel.ticker = v.i WHERE f.nx IS NOT NULL GROUP BY 1""",
)

# --- Streaming ---------------------------------------------------------------------------------------------------------
_add(
    "s01_streaming_bars",
    closed_days,
    """WITH e AS (SELECT event_type AS ticker, date_trunc('day', ts) AS day, ts, event_id, value FROM events), m AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events)
SELECT ticker, day::DATE AS dt, arg_min(value, ROW(ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, ROW(ts, event_id)) AS close, count(*) AS n FROM e GROUP BY ticker, day HAVING day + INTERVAL 1 DAY <= (SELECT mark FROM m)""",
)
_STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"
_MARK = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"
_SERIES = f"""WITH RECURSIVE b AS (SELECT event_type AS ticker, time_bucket(INTERVAL 1 HOUR, ts) AS start, arg_max(value, ROW(ts, event_id)) AS close FROM events GROUP BY 1, 2 HAVING start + INTERVAL 1 HOUR <= {_MARK}),
c AS (SELECT *, lag(close) OVER w AS before, coalesce(start - lag(start) OVER w > INTERVAL 48 HOUR, true)::INT AS fresh FROM b WINDOW w AS (PARTITION BY ticker ORDER BY start)),
d AS (SELECT *, sum(fresh) OVER (PARTITION BY ticker ORDER BY start) AS series FROM c),
e AS (SELECT ticker, series, start, close, close / before - 1 AS ret, row_number() OVER (PARTITION BY ticker, series ORDER BY start) AS n FROM d WHERE fresh = 0 AND before <> 0),
ew AS (SELECT ticker, series, 20::BIGINT AS n, var_samp(ret) AS v FROM e WHERE n <= 20 GROUP BY 1, 2 HAVING count(*) = 20
  UNION ALL SELECT ew.ticker, ew.series, ew.n + 1, 0.94::DOUBLE * ew.v + 0.06::DOUBLE * e.ret * e.ret FROM ew JOIN e USING (ticker, series, n)),
ga AS (SELECT ticker, series, 252::BIGINT AS n, avg(ret * ret) AS v FROM e WHERE n <= 252 GROUP BY 1, 2 HAVING count(*) = 252
  UNION ALL SELECT ga.ticker, ga.series, ga.n + 1, greatest(0.01::DOUBLE + 0.08::DOUBLE * (e.ret * e.ret - ga.v) + 0.90::DOUBLE * ga.v, 1e-12::DOUBLE) FROM ga JOIN e USING (ticker, series, n))"""
_add(
    "s02_streaming_recursive_volatility",
    lambda s, d: _rounded(windows.recursive(s, d).withColumn("start", windows.written_out("start")), ["ticker", "start"], 7),
    f"{_SERIES} SELECT e.ticker, {_STAMP.format('e.start')} AS start, {_sig('close', 'close', 7)}, {_sig('ret', 'ret', 7)}, {_sig('sqrt(ew.v * 252)', 'ewma', 7)}, {_sig('sqrt(ga.v * 252)', 'gas', 7)} FROM e LEFT JOIN ew USING (ticker, series, n) LEFT JOIN ga USING (ticker, series, n)",
)
_add(
    "s03_streaming_sessions",
    lambda s, d: _rounded(windows.through(s, d, windows.sessions).withColumns({c: windows.written_out(c) for c in ("start", "finish")}), ["user_id", "start", "finish", "n", "first_type", "last_type"], 7),
    f"""WITH a AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 30 MINUTE, true)::INT AS fresh FROM events), b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM a),
c AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS finish, count(*) AS n, sum(value) AS value, arg_min(event_type, ROW(ts, event_id)) AS first_type, arg_max(event_type, ROW(ts, event_id)) AS last_type FROM b GROUP BY user_id, island)
SELECT user_id, {_STAMP.format('start')} AS start, {_STAMP.format('finish')} AS finish, n, {_sig('value', 'value', 7)}, first_type, last_type FROM c WHERE finish <= {_MARK}""",
)
_add(
    "s04_streaming_sliding_windows",
    lambda s, d: _rounded(windows.through(s, d, windows.sliding).withColumn("start", windows.written_out("start")), ["ticker", "start", "n"], 7),
    f"""WITH spine AS (SELECT event_type AS ticker, time_bucket(INTERVAL 1 HOUR, ts) - to_hours(k) AS start, value FROM events, (SELECT unnest(range(6)) AS k))
SELECT ticker, {_STAMP.format('start')} AS start, count(*) AS n, {_sig('sum(value)', 'value', 7)}, {_sig('max(value)', 'most', 7)} FROM spine GROUP BY ticker, spine.start HAVING spine.start + INTERVAL 6 HOUR <= {_MARK}""",
)
