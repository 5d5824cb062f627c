"""Rolling forecasts by boosted regression trees: squared loss, a second-order gain, splits between histogram bins.

A tree is grown level by level for all of its nodes at once; a node without a worthwhile split sends all its rows left.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .forecasts import refits
from .walks import on_rows, walk

#: Added to the rows of a node when its value and gain are taken, and the least gain of a split.
PENALTY, LEAST_GAIN = 1.0, 1e-6


def cuts(x: np.ndarray, bins: int) -> np.ndarray:
    """Values of x, in order, between which it is binned: all but the first, or quantiles if there are more than ``bins``."""
    own = np.unique(x)
    return own[1:] if len(own) <= bins else np.unique(np.quantile(x, np.arange(1, bins) / bins, method="higher"))


def predict(x: np.ndarray, y: np.ndarray, ask: np.ndarray, trees: int = 100, depth: int = 4, rate: float = 0.1, bins: int = 64) -> float:
    """The value at ``ask`` (features) of trees fitted to x (rows x features) and y."""
    rows, k = x.shape
    edges = [cuts(x[:, j], bins) for j in range(k)]
    code = np.column_stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)])
    asked = np.array([np.searchsorted(e, v, side="right") for e, v in zip(edges, ask, strict=True)])
    cell = code + np.arange(k) * bins
    every = np.arange(rows)
    value = y.mean()
    fitted = np.full(rows, value)
    for _ in range(trees):
        slope = fitted - y
        repeated = np.repeat(slope, k)
        node, at = np.zeros(rows, np.int64), 0
        for level in range(depth):
            nodes = 2**level
            key = (node[:, None] * (k * bins) + cell).ravel()
            n = np.bincount(key, minlength=nodes * k * bins).reshape(nodes, k, bins).cumsum(axis=2)
            g = np.bincount(key, repeated, minlength=nodes * k * bins).reshape(nodes, k, bins).cumsum(axis=2)
            all_n, all_g = n[:, :1, -1:], g[:, :1, -1:]  # the same for each feature
            gain = g * g / (n + PENALTY) + (all_g - g) ** 2 / (all_n - n + PENALTY)
            gain[(n == 0) | (n == all_n)] = -np.inf
            gain = gain.reshape(nodes, k * bins)
            best = gain.argmax(axis=1)
            split = gain[np.arange(nodes), best] - (all_g * all_g / (all_n + PENALTY))[:, 0, 0] > LEAST_GAIN
            feature, last = best // bins, np.where(split, best % bins, bins)
            at = 2 * at + int(asked[feature[at]] > last[at])
            node = 2 * node + (code[every, feature[node]] > last[node])
        n, g = np.bincount(node, minlength=2**depth), np.bincount(node, slope, minlength=2**depth)
        leaf = -rate * g / (n + PENALTY)
        fitted += leaf[node]
        value += leaf[at]
    return float(value)


def boosted_trees(data: DataFrame, features: list[str], target: str, window: int = 1260, step: int = 2, least: int = 200, blocks: int = 8, isolate: bool = False, **shape) -> DataFrame:
    """(ticker, dt, boosted_trees): fitted anew every ``step`` rows on the complete rows of the ``window`` rows before, at row t on the features of t.

    At least 1e-8, forward-filled; no forecast from fewer than ``least`` complete rows or for an incomplete row. Each instrument's
    rows are dealt to ``blocks`` tasks. With ``isolate`` what ``walk`` gives.
    """

    def run(x, own):
        at, value = refits(x, own, window, least, lambda z, y: lambda ask: predict(z, y, ask, **shape))
        return at, np.maximum(value, 1e-8)

    made = walk(data, "boosted_trees", [*features, target], run, lambda n: np.arange(window, n, step), blocks, isolate)
    return made if isolate else on_rows(data, made, "boosted_trees")
