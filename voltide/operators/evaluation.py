"""Losses, comparison tests and regimes over forecasts in long form (ticker, dt, realized, model, place, forecast)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions.tails import p_chi2, p_normal

TINY = 1e-12


def losses(y: Column, f: Column) -> dict[str, Column]:
    """Aggregates that skip nulls; the correlation is null if any forecast is."""
    s2, r2 = F.greatest(f * f, F.lit(TINY)), y * y
    both = y.isNotNull() & f.isNotNull()
    ratio = F.when(both & (r2 >= TINY), r2 / s2)
    log_gap = F.when(both, F.ln(F.greatest(f, F.lit(TINY))) - F.ln(F.greatest(y, F.lit(TINY))))
    return {
        "mae": F.avg(F.abs(f - y)),
        "rmse": F.sqrt(F.avg((f - y) * (f - y))),
        "correlation": F.when(F.count(F.when(both, 1)) == F.count("*"), F.corr(y, f)),
        "qlike": F.avg(ratio - F.ln(ratio) - 1),
        "mse_var": F.avg(F.pow(f * f - y * y, 2)),
        "log_vol": F.avg(log_gap * log_gap),
    }


def metrics(long: DataFrame, *keys: str) -> DataFrame:
    made = losses(F.col("realized"), F.col("forecast"))
    return long.groupBy(*keys).agg(*(c.alias(k) for k, c in made.items()), F.count("forecast").alias("n"))


def regimes(wide: DataFrame, low: float = 0.33, high: float = 0.67) -> DataFrame:
    """wide plus ``regime``: low, medium or high by exact quantiles of the instrument's realized volatility."""
    cuts = wide.groupBy("ticker").agg(F.percentile("realized", F.lit(low)).alias("q1"), F.percentile("realized", F.lit(high)).alias("q2"))
    y = F.col("realized")
    label = F.when(y <= F.col("q1"), "low").when(y <= F.col("q2"), "medium").when(y > F.col("q2"), "high")
    return wide.join(cuts, "ticker").withColumn("regime", label).drop("q1", "q2")


def by_regime(labelled: DataFrame, model: str, least: int = 10) -> DataFrame:
    m = losses(F.col("realized"), F.col(model))
    return labelled.where(F.col("regime").isNotNull() & finite(F.col("realized")) & finite(F.col(model))).groupBy("ticker", "regime").agg(*(m[k].alias(k) for k in ("mae", "rmse", "qlike")), F.count("*").alias("n")).where(F.col("n") >= least)


def plain_metrics(long: DataFrame, *keys: str) -> DataFrame:
    """mae, rmse and correlation that do not skip nulls: null wherever one value is."""
    y, f = F.col("realized"), F.col("forecast")
    whole = F.count(F.when(finite(y) & finite(f), 1)) == F.count("*")
    return long.groupBy(*keys).agg(*(F.when(whole, x).alias(k) for k, x in (("mae", F.avg(F.abs(f - y))), ("rmse", F.sqrt(F.avg((f - y) * (f - y)))), ("correlation", F.corr(y, f)))))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def diebold_mariano(wide: DataFrame, models: list[str], benchmark: str, horizon: int = 1, loss: str = "squared") -> DataFrame:
    """(ticker, model, n, dm, p) of squared or absolute errors against the benchmark's, with Bartlett weights up to lag ``horizon``.

    Rows where either loss is not finite go; the statistic is null for fewer than two rows or a variance of zero. All models
    stand in one row, so the benchmark's losses need no join.
    """
    size = {"squared": lambda e: e * e, "absolute": F.abs}[loss]
    cost = lambda m: size(F.col("realized") - F.col(m))
    cells = F.array(*(F.struct(F.lit(m).alias("model"), (cost(m) - cost(benchmark)).alias("d")) for m in models if m != benchmark))
    d = wide.select("ticker", "dt", F.explode(cells).alias("c")).select("ticker", "dt", "c.model", "c.d").where(finite(F.col("d")))
    d = d.withColumn("dm", F.col("d") - F.avg("d").over(Window.partitionBy("ticker", "model")))
    by = Window.partitionBy("ticker", "model").orderBy("dt")
    d = d.withColumns({f"l{k}": F.lag("dm", k).over(by) for k in range(1, horizon + 1)})
    gamma = F.avg(F.col("dm") * F.col("dm"))
    first = gamma
    for k in range(1, horizon + 1):
        gamma = gamma + 2 * (1 - k / (horizon + 1)) * F.coalesce(F.avg(F.col("dm") * F.col(f"l{k}")), F.lit(0.0))
    out = d.groupBy("ticker", "model").agg(F.count("*").alias("n"), F.avg("d").alias("mean"), first.alias("g0"), gamma.alias("g"))
    fine = (F.col("n") >= 2) & (F.col("g0") > 0) & (F.col("g") > 0)
    out = out.select("ticker", "model", "n", F.when(fine, F.col("mean") / F.sqrt(F.col("g") / F.col("n"))).alias("dm"))
    return out.withColumn("p", p_normal(F.col("dm")))


def intervals(wide: DataFrame, model: str, alpha: float = 0.1) -> DataFrame:
    """wide plus ``lower`` and ``upper``: the limit of a residual bootstrap, the forecast plus quantiles of its residuals."""
    r = F.col("realized") - F.col(model)
    q = wide.groupBy("ticker").agg(F.percentile(r, F.lit(alpha / 2)).alias("ql"), F.percentile(r, F.lit(1 - alpha / 2)).alias("qu"))
    edge = lambda c: F.when(F.col(model).isNotNull(), F.greatest(F.col(model) + F.col(c), F.lit(1e-8)))
    return wide.join(q, "ticker").withColumns({"lower": edge("ql"), "upper": edge("qu")}).drop("ql", "qu")


def drawn(parts: list, draws: int) -> Column:
    """An array of ``draws`` numbers in [0, 1) that hang on nothing but ``parts`` and their place: no generator with a state."""
    word = lambda j: F.conv(F.substring(F.md5(F.concat_ws("|", *parts, j.cast("string"))), 1, 13), 16, 10)
    return F.transform(F.sequence(F.lit(0), F.lit(draws - 1)), lambda j: word(j).cast("long") / F.lit(float(1 << 52)))


def bootstrap_intervals(wide: DataFrame, model: str, alpha: float = 0.1, draws: int = 500, seed: int = 42) -> DataFrame:
    """(ticker, dt, lower, upper): quantiles of the forecast plus ``draws`` residuals drawn with replacement, 1e-8 at least.

    A draw is the residual of rank floor(u N), u a hash of instrument, day, seed and place, so reruns agree however rows are
    dealt. As ranks keep the order of draws, the sorted u give the order statistics: only the four residuals that the two
    quantiles (linear between neighbours) need are looked up, whatever ``draws`` is. Null forecasts have no interval.
    """
    r = F.col("realized") - F.col(model)
    held = wide.select("ticker", "dt", F.col(model).alias("f"), r.alias("r"))
    ranked = held.where(finite(F.col("r"))).select("ticker", "r", (F.row_number().over(Window.partitionBy("ticker").orderBy("r")) - 1).cast("long").alias("rank"))
    sizes = ranked.groupBy("ticker").agg(F.count("*").alias("size"))
    u = F.array_sort(drawn([F.col("ticker"), F.col("dt").cast("string"), F.lit(str(seed))], draws))
    picks = []
    for side, q in (("lower", alpha / 2), ("upper", 1 - alpha / 2)):
        low = int(q * (draws - 1))
        share = q * (draws - 1) - low
        picks += [F.struct(F.lit(side).alias("side"), F.floor(F.element_at("u", k + 1) * F.col("size")).cast("long").alias("rank"), F.lit(w).alias("w")) for k, w in ((low, 1 - share), (min(low + 1, draws - 1), share))]
    asked = held.where("f IS NOT NULL").join(sizes, "ticker").withColumn("u", u).select("ticker", "dt", "f", F.explode(F.array(*picks)).alias("p")).select("ticker", "dt", "f", "p.*")
    value = F.sum(F.col("w") * F.greatest(F.col("f") + F.col("r"), F.lit(1e-8)))
    ends = asked.join(ranked, ["ticker", "rank"]).groupBy("ticker", "dt", "side").agg(value.alias("v"))
    ends = ends.groupBy("ticker", "dt").agg(*(F.max(F.when(F.col("side") == side, F.col("v"))).alias(side) for side in ("lower", "upper")))
    return held.select("ticker", "dt").join(ends, ["ticker", "dt"], "left")


def user_loss(long: DataFrame, keys: list[str], terms: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]], finish: Callable[[dict[str, Column], Column], Column] | None = None) -> DataFrame:
    """(keys, loss, n): a loss of the user's own, a numpy function of realized values and forecasts.

    ``terms`` gives named arrays, a number a row (not finite: left out); ``finish`` makes the loss of their sums and the count
    of rows, by default the mean of the one term. Each batch is summed by group where it lies, so a group's rows, however
    many, meet as a few sums and counts. Keys are strings or numbers. An empty table gives no rows.
    """
    probe = list(terms(np.ones(1), np.ones(1)))
    schema = StructType([*(long.schema[k] for k in keys), *(StructField(f"s_{t}", DoubleType()) for t in probe), StructField("n", LongType())])

    def run(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            y, f = (t.column(c).to_numpy().astype(float) for c in ("realized", "forecast"))
            made = terms(y, f)
            whole = np.logical_and.reduce([np.isfinite(v) for v in made.values()])
            part = pa.table({k: t.column(k) for k in keys} | {f"s_{k}": np.where(whole, v, 0.0) for k, v in made.items()} | {"n": whole.astype(np.int64)})
            sums = part.group_by(keys).aggregate([(c, "sum") for c in part.column_names if c not in keys])
            yield from sums.select([*keys, *(f"s_{k}_sum" for k in probe), "n_sum"]).rename_columns(schema.names).to_batches()

    part = long.select(*keys, F.col("realized").cast("double"), F.col("forecast").cast("double")).mapInArrow(run, schema)
    total = part.groupBy(*keys).agg(*(F.sum(f"s_{t}").alias(f"s_{t}") for t in probe), F.sum("n").alias("n"))
    made = finish({t: F.col(f"s_{t}") for t in probe}, F.col("n")) if finish else F.col(f"s_{probe[0]}") / F.col("n")
    return total.select(*keys, F.when(F.col("n") > 0, made).alias("loss"), "n")


def residual_diagnostics(wide: DataFrame, model: str, lags: int = 20) -> DataFrame:
    """(ticker, lag, acf, n): autocorrelations of the residuals."""
    by = Window.partitionBy("ticker").orderBy("dt")
    r = wide.select("ticker", "dt", (F.col("realized") - F.col(model)).alias("r")).where("r IS NOT NULL")
    r = r.withColumns({f"l{k}": F.lag("r", k).over(by) for k in range(1, lags + 1)})
    one = r.groupBy("ticker").agg(F.count("*").alias("n"), *(F.corr("r", f"l{k}").alias(f"c{k}") for k in range(1, lags + 1)))
    cells = F.array(*(F.struct(F.lit(k).cast("long").alias("lag"), F.col(f"c{k}").alias("acf")) for k in range(1, lags + 1)))
    return one.where(F.col("n") >= lags + 5).select("ticker", "n", F.explode(cells).alias("c")).select("ticker", "c.lag", "c.acf", "n")


def ljung_box(acf: DataFrame, lags: int = 20) -> DataFrame:
    """(ticker, n, q, p) of autocorrelations as of residual_diagnostics."""
    out = acf.groupBy("ticker", "n").agg((F.sum(F.col("acf") * F.col("acf") / (F.col("n") - F.col("lag"))) * F.col("n") * (F.col("n") + 2)).alias("q"))
    return out.withColumn("p", p_chi2(F.col("q"), lags))
