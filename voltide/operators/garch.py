"""Rolling GARCH forecasts: all windows of an instrument are fitted together, by scoring steps on matrices (days x windows).

Zero mean, one lag of each kind. A step is one pass through the days that gives variances and their derivatives for every
window; windows whose likelihood did not rise go back half a step. The degrees of freedom of t innovations are found on a grid.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame

from ..functions.volatility import TRADING_DAYS
from .walks import on_rows, walk

KINDS = {"garch": ("garch", False), "gjr": ("gjr", False), "egarch": ("egarch", False), "garch_t": ("garch", True)}
_FREEDOM = np.exp(np.linspace(math.log(2.1), math.log(200), 28))
_MEAN_SIZE = math.sqrt(2 / math.pi)  # of a standard normal variable


def _starts(kind: str, spread: np.ndarray) -> list[np.ndarray]:
    one = np.ones_like(spread)
    if kind == "egarch":
        return [np.stack([np.log(spread) * (1 - b), a * one, 0 * one, b * one]) for a, b in ((0.1, 0.95), (0.2, 0.8), (0.05, 0.5))]
    plain = [(spread * (1 - a - b), a * one, b * one) for a, b in ((0.05, 0.9), (0.1, 0.7), (0.1, 0.3), (0.2, 0.7))]
    return [np.stack([w, a, b] if kind == "garch" else [w, a / 2, a, b]) for w, a, b in plain]


def _allowed(kind: str, x: np.ndarray, spread: np.ndarray) -> np.ndarray:
    x = x.copy()
    if kind == "egarch":
        x[3] = np.clip(x[3], -0.999, 0.999)
        x[1:3] = np.clip(x[1:3], -2, 2)
        x[0] = np.clip(x[0], -20, 20)
        return x
    x[0] = np.clip(x[0], 1e-8 * spread, 10 * spread)
    x[1] = np.clip(x[1], 0.0, 0.999)
    if kind == "gjr":
        x[2] = np.clip(x[2], -x[1], 1.9)
    used = x[1] + (x[2] / 2 if kind == "gjr" else 0)
    x[-1] = np.clip(x[-1], 0.0, np.maximum(0.0, 0.9999 - used))
    return x


def _pass(kind: str, x: np.ndarray, r: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Variances (log variances of egarch) for each day and the day after, and their derivatives."""
    days, n = r.shape
    h, d = np.empty((days + 1, n)), np.empty((days + 1, *x.shape))
    if kind == "egarch":
        h[0], d[0] = np.log(first), 0.0
        for t in range(days):
            z = r[t] * np.exp(-h[t] / 2)
            size = np.abs(z)
            h[t + 1] = np.clip(x[0] + x[1] * (size - _MEAN_SIZE) + x[2] * z + x[3] * h[t], -50, 50)
            d[t + 1] = (x[3] - (x[1] * size + x[2] * z) / 2) * d[t]
            d[t + 1, 0] += 1
            d[t + 1, 1] += size - _MEAN_SIZE
            d[t + 1, 2] += z
            d[t + 1, 3] += h[t]
        return h, d
    square = r * r
    down = np.where(r < 0, square, 0.0)
    beta = x[-1]
    h[0], d[0] = x[0] + (x[1] + beta + (x[2] / 2 if kind == "gjr" else 0)) * first, first
    d[0, 0] = 1
    if kind == "gjr":
        d[0, 2] = first / 2
    for t in range(days):
        h[t + 1] = x[0] + x[1] * square[t] + beta * h[t]
        d[t + 1] = beta * d[t]
        d[t + 1, 0] += 1
        d[t + 1, 1] += square[t]
        if kind == "gjr":
            h[t + 1] += x[2] * down[t]
            d[t + 1, 2] += down[t]
        d[t + 1, -1] += h[t]
    return np.maximum(h, 1e-12), d


def _likelihood(s: np.ndarray, r: np.ndarray, freedom: np.ndarray | None) -> np.ndarray:
    if freedom is None:
        return -0.5 * (np.log(s) + r * r / s).sum(axis=0)
    constant = np.array([math.lgamma((v + 1) / 2) - math.lgamma(v / 2) - 0.5 * math.log((v - 2) * math.pi) for v in freedom])
    return len(r) * constant - 0.5 * np.log(s).sum(axis=0) - (freedom + 1) / 2 * np.log1p(r * r / ((freedom - 2) * s)).sum(axis=0)


def fit(r: np.ndarray, kind: str = "garch", student: bool = False, rounds: int = 60) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """Parameters (k x windows), degrees of freedom and next day's variance of each column of r (days x windows)."""
    log = kind == "egarch"
    spread = np.maximum((r * r).mean(axis=0), 1e-10)
    weight = 0.94 ** np.arange(min(75, len(r)))
    first = np.maximum((weight[:, None] * r[: len(weight)] ** 2).sum(axis=0) / weight.sum(), 1e-10)
    freedom = np.full(r.shape[1], 8.0) if student else None
    best, x = np.full(r.shape[1], -np.inf), None
    for start in _starts(kind, spread):
        start = _allowed(kind, start, spread)
        h = _pass(kind, start, r, first)[0][:-1]
        value = _likelihood(np.exp(h) if log else h, r, freedom)
        x = start if x is None else np.where(value > best, start, x)
        best = np.maximum(best, value)
    size = np.ones(r.shape[1])
    trial, best, move = x, np.full(r.shape[1], -np.inf), np.zeros_like(x)
    for k in range(rounds):
        h, d = _pass(kind, trial, r, first)
        s = np.exp(h[:-1]) if log else h[:-1]
        value = _likelihood(s, r, freedom)
        better = value > best + 1e-9
        if not better.any() and (size < 1e-4).all():
            break
        square = r * r / s if freedom is None else (freedom + 1) * r * r / ((freedom - 2) * s + r * r)
        scale = 1.0 if log else s
        slope = np.einsum("tn,tpn->pn", (square - 1) / (2 * scale), d[:-1])
        bend = np.einsum("tn,tpn,tqn->npq", 1 / (2 * scale * scale) * np.ones_like(s), d[:-1], d[:-1], optimize=True)
        bend += 1e-8 * np.einsum("npp->n", bend)[:, None, None] * np.eye(len(x)) + 1e-12 * np.eye(len(x))
        step = np.linalg.solve(bend, slope.T[:, :, None])[:, :, 0].T
        x, best = np.where(better, trial, x), np.where(better, value, best)
        move = np.where(better, step, move)
        size = np.where(better, 1.0, size / 2)
        if freedom is not None and k % 10 == 9:
            h = _pass(kind, x, r, first)[0][:-1]
            grid = np.stack([_likelihood(h, r, np.full(r.shape[1], v)) for v in _FREEDOM])
            freedom, best = _FREEDOM[grid.argmax(axis=0)], grid.max(axis=0)
        trial = _allowed(kind, x + size * move, spread)
    last = _pass(kind, x, r, first)[0][-1]
    return x, freedom, np.exp(last) if log else last


def forecasts(r: np.ndarray, window: int, step: int, kind: str, student: bool, horizon: int, block: int = 256) -> np.ndarray:
    """Annualised forecasts at every ``step``-th row from ``window`` on, from the rows before; the rest is nan."""
    out = np.full(len(r), np.nan)
    rows = np.arange(window, len(r), step)
    counts = {int(t): np.flatnonzero(np.isfinite(r[t - window : t])) + t - window for t in rows} if not np.isfinite(r).all() else {}
    usable = np.array([t for t in rows if not counts or len(counts[int(t)]) >= 0.9 * window], int)
    sizes = np.array([len(counts[int(t)]) if counts else window for t in usable], int)
    for n in np.unique(sizes):  # windows with as many known returns are fitted together
        own = usable[sizes == n]
        for i in range(0, len(own), block):
            part = own[i : i + block]
            panel = np.stack([r[counts[int(t)]] if counts else r[t - window : t] for t in part], axis=1) * 100
            variance = fit(panel, kind, student)[2]
            out[part] = np.sqrt(variance) / 100 * math.sqrt(TRADING_DAYS / horizon)
    return out


def garch(bars: DataFrame, kind: str = "garch", window: int = 1260, step: int = 2, horizon: int = 2, blocks: int = 2, ret: str = "ret", isolate: bool = False) -> DataFrame:
    """(ticker, dt, <kind>): walk-forward forecasts of one of KINDS, null between steps and before the first window.

    ``horizon`` is that of the annualisation (the reference's default is 2). Each instrument's windows are dealt to ``blocks``
    tasks. With ``isolate`` what ``walk`` gives.
    """
    model, student = KINDS[kind]

    def run(x, own):
        begin = own[0] - window
        value = forecasts(x[begin : own[-1] + 1, 0], window, step, model, student, horizon)
        return np.arange(begin, own[-1] + 1), value

    made = walk(bars, kind, [ret], run, lambda n: np.arange(window, n, step), blocks, isolate)
    return made if isolate else on_rows(bars, made, kind, fill=False)
