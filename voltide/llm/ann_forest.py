"""Nearest neighbours by inner product: a forest of sorted arrays of hash strings, dealt to tasks by hash prefix.

Vectors are lifted to one length by an extra component, so that the largest inner product is the smallest angle. A string
has one bit for each of BITS random hyperplanes. The index is dealt by the first bits of one more string, the router, and a
query goes to those shards alone in which its neighbours may lie, likeliest first, until the chance is ROUTE; how near they
are, a small sample of the index tells. In a shard a query descends all trees, by bisection, to the longest prefix that any
row shares with it; then all trees ascend together, a bit at a time, and the rows that each bit adds are scored, once. A query
stops where a row as near as its k-th best so far, or as the sample's k-th, would have met it with probability MEET.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textkernel import tidy

#: Index vectors of a shard (on average; twice as many at most) and queries of a block; trees and bits of a string.
SHARD, QUERIES, TREES, BITS = 4096, 8192, 128, 24
#: Probabilities that a neighbour lies in a visited shard and that it meets the query in some tree of its shard.
ROUTE, MEET = 0.98, 0.92
#: Vectors sampled of a dimension, from which the nearness of the k-th neighbour is estimated; an eighth of a smaller index.
SAMPLE = 2048
#: Queries that ascend at once, places in the sorted arrays that are gathered at once, and bits of the prefixes that are looked up.
TOGETHER, GATHERED, HEAD = 1024, 1 << 22, 12

_erf = np.vectorize(math.erf, otypes=[float])


def planes(dim: int, router: int) -> tuple[np.ndarray, np.ndarray]:
    """Hyperplanes of the router and of the trees, for vectors of dim components and the lifting one."""
    r = np.random.default_rng(1 + dim)
    trees = r.standard_normal((dim + 1, TREES * BITS))
    return r.standard_normal((dim + 1, max(router, 1)))[:, :router], trees


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(top**2 - (x * x).sum(axis=1), 0))]) / top


def unit(q: np.ndarray) -> np.ndarray:
    return np.column_stack([q / np.sqrt((q * q).sum(axis=1))[:, None], np.zeros(len(q))])


def likeliest(same: np.ndarray, enough: float) -> list[int]:
    """Patterns of flipped bits, as numbers, likeliest first, until their probabilities add up; same: of each bit not to flip (0.5 at least)."""
    order = np.argsort(same, kind="stable")
    cost = np.log(same[order]) - np.log(np.maximum(1 - same[order], 1e-12))
    weight = (1 << (len(same) - 1 - order)).tolist()
    total, out = float(np.exp(np.log(same).sum())), [0]
    first, heap = total, [(cost[0], 0, weight[0])] if len(same) else []
    while heap and total < enough:
        c, j, mask = heapq.heappop(heap)
        out.append(mask)
        total += first * math.exp(-c)
        if j + 1 < len(cost):
            heapq.heappush(heap, (c + cost[j + 1], j + 1, mask | weight[j + 1]))
            heapq.heappush(heap, (c + cost[j + 1] - cost[j], j + 1, (mask & ~weight[j]) | weight[j + 1]))
    return out


def depth_for(cos: np.ndarray) -> np.ndarray:
    """The longest prefix with which a neighbour at these cosines meets the query in some tree with probability MEET."""
    p = 1 - np.arccos(np.clip(cos, -1, 1)) / math.pi
    need = 1 - (1 - MEET) ** (1 / TREES)
    with np.errstate(divide="ignore"):
        return np.clip(np.floor(math.log(need) / np.log(np.minimum(p, 1 - 1e-12)) + 1e-9), 0, BITS).astype(int)


class Forest:
    """Sorted arrays of hash strings over the rows of x."""

    def __init__(self, x: np.ndarray, top: float):
        self.x, self.top, self.trees = x, top, planes(x.shape[1], 0)[1]
        keys = self.strings(lifted(x, top))
        self.order = np.argsort(keys, axis=1, kind="stable")
        self.keys = np.take_along_axis(keys, self.order, axis=1)
        # How many rows stand before each prefix of HEAD bits, tree by tree.
        counts = [np.bincount(s >> (BITS - HEAD), minlength=1 << HEAD) for s in self.keys]
        self.heads = np.concatenate([np.append(0, np.cumsum(c)) for c in counts])
        self.scored = 0

    def strings(self, rows: np.ndarray) -> np.ndarray:
        out = np.empty((TREES, len(rows)), np.int64)
        weights = 1 << np.arange(BITS - 1, -1, -1)
        for i in range(0, len(rows), 1024):
            out[:, i : i + 1024] = ((rows[i : i + 1024] @ self.trees > 0).reshape(-1, TREES, BITS) @ weights).T
        return out

    def places(self, keys: np.ndarray, where: np.ndarray | None = None) -> np.ndarray:
        """Where strings (trees x queries) would stand in the sorted arrays; sought only ``where``, if given."""
        out = np.zeros(keys.shape, np.int64)
        for t in range(TREES):
            at = slice(None) if where is None else np.flatnonzero(where[t])
            out[t, at] = np.searchsorted(self.keys[t], keys[t, at])
        return out

    def range(self, prefix: np.ndarray, level: int, matched: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of the rows with a prefix of ``level`` bits: by HEAD up to its length, beyond by bisection in the trees that match so far, where others stay as they are."""
        if level > HEAD:
            cut = BITS - level
            return tuple(np.where(matched, self.places((prefix + k) << cut, matched), old) for k, old in ((0, low), (1, high)))
        heads = np.arange(TREES)[:, None] * ((1 << HEAD) + 1)
        return tuple(self.heads[heads + ((prefix + k) << (HEAD - level))] for k in (0, 1))

    def longest(self, keys: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The length of the longest prefix that any row shares with each string, in each tree: a row beside its place has it."""
        out = np.zeros(keys.shape, np.int64)
        for side in (at - 1, at):
            beside = np.take_along_axis(self.keys, np.clip(side, 0, len(self.x) - 1), axis=1)
            out = np.maximum(out, BITS - np.frexp((keys ^ beside).astype(np.float64))[1])
        return out

    def added(self, low: np.ndarray, high: np.ndarray, n: np.ndarray, seen: np.ndarray):
        """(query, row), in order of query, of the rows at low to high (trees x queries n) in some tree whose cell of ``seen`` is negative; some queries at a time."""
        size = high - low
        total = size.sum(axis=0)
        block = np.cumsum(total) // GATHERED
        base = low + np.arange(TREES)[:, None] * len(self.x)
        for b in np.unique(block[total > 0]):
            own = np.flatnonzero((block == b) & (total > 0))
            part = size[:, own].T.ravel()
            place = np.arange(part.sum()) + np.repeat(base[:, own].T.ravel() - np.cumsum(part) + part, part)
            cell = np.repeat(n[own], total[own]) * len(self.x) + self.order.ravel()[place]
            cell = cell[seen.ravel()[cell] < 0]
            number = np.arange(len(cell), dtype=np.int32)
            seen.ravel()[cell] = number
            cell = cell[seen.ravel()[cell] == number]  # one of equal cells
            yield cell // len(self.x), cell % len(self.x)

    def better(self, q: np.ndarray, query: np.ndarray, row: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score) of the pairs, in order of query, that are among the best of their query so far; best (queries x k, the least first) takes them up."""
        score = np.empty(len(row))
        ends = np.append(np.flatnonzero(np.diff(query)) + 1, len(query)) if len(query) else []
        for a, z in zip([0, *ends], ends):  # noqa: B905
            score[a:z] = self.x[row[a:z]] @ q[query[a]]
        self.scored += len(row)
        near = score >= _least(best[query, 0])
        query, row, score = query[near], row[near], score[near]
        order = np.lexsort((-score, query))
        of, first, at = np.unique(query, return_index=True, return_inverse=True)
        rank = np.arange(len(query)) - first[at]
        k = best.shape[1]
        pool = np.full((len(of), k), -np.inf)
        pool[at[rank < k], rank[rank < k]] = score[order][rank < k]
        best[of] = np.partition(np.column_stack([best[of], pool]), k, axis=1)[:, k:]
        return query, row, score

    def ascend(self, q: np.ndarray, depth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        keys = self.strings(unit(q))
        at = self.places(keys)
        longest = self.longest(keys, at)
        first = longest.max(axis=0)
        length = np.sqrt((q * q).sum(axis=1)) * self.top
        low, high, seen = at, at.copy(), np.full((len(q), len(self.x)), -1, np.int32)
        best, kept, going = np.full((len(q), k), -np.inf), [], np.ones(len(q), bool)
        for level in range(first.max(), -1, -1):
            n = np.flatnonzero(going & (first >= level))
            begin, end = self.range(keys[:, n] >> (BITS - level), level, longest[:, n] >= level, low[:, n], high[:, n])
            for a, z in ((begin, low[:, n]), (high[:, n], end)):  # a bit less adds rows before and behind those known
                kept += [self.better(q, query, row, best) for query, row in self.added(a, z, n, seen)]
            low[:, n], high[:, n] = begin, end
            going[n] = np.isneginf(best[n, 0]) | (level > np.maximum(depth[n], depth_for(best[n, 0] / length[n])))
            if not going.any():
                break
        query, row, score = (np.concatenate(c) for c in zip(*kept, strict=True))
        near = score >= _least(best[query, 0])
        return query[near], row[near]

    def search(self, q: np.ndarray, depth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, row of x) of the k best candidates of each query; more for equal scores at the end. With k rows no query ascends above ``depth``."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for i in range(0, len(q), TOGETHER):
            query, row = self.ascend(q[i : i + TOGETHER], depth[i : i + TOGETHER], min(k, len(self.x)))
            found.append((query + i, row))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _least(score: np.ndarray) -> np.ndarray:
    """A little under the scores: products differ in their last bits by the order of summation."""
    return score - 1e-9 * (1 + np.where(np.isfinite(score), np.abs(score), 0))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _search_shard(index: pa.Table, asked: pa.Table, k: int, tops: dict[int, float]) -> pa.Table:
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
    if not index.num_rows or not asked.num_rows:
        return schema.empty_table()
    ids, x = index.column("vec_id").to_numpy(), _matrix(index.column("v"))
    qid, q, depth = asked.column("vec_id").to_numpy(), _matrix(asked.column("v")), asked.column("depth").to_numpy()
    # Equal vectors are one entry of the forest.
    order = np.lexsort((ids, *x.T[::-1]))
    ids, x = ids[order], x[order]
    first = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]).any(axis=1)]))
    size = np.diff(np.append(first, len(ids)))
    distinct = np.ascontiguousarray(x[first])
    query, row = Forest(distinct, tops[x.shape[1]]).search(q, depth, k + 1)
    exact = (q[query] * distinct[row]).sum(axis=1)
    many = size[row]
    at = np.repeat(first[row], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    query, exact = np.repeat(query, many), np.repeat(exact, many)
    other = qid[query] != ids[at]
    query, at, exact = query[other], at[other], exact[other]
    order = np.lexsort((ids[at], -exact, query))
    query, at, exact = query[order], at[order], exact[order]
    keep = np.arange(len(query)) - np.searchsorted(query, query) < k
    return pa.table({"query_id": qid[query[keep]], "vec_id": ids[at[keep]], "score": exact[keep]}, schema=schema)


class Router:
    """What dealing needs of each dimension: vectors, greatest length, bits of the router and a sample of the index. Broadcast; some SAMPLE vectors of a dimension."""

    def __init__(self, index: DataFrame, k: int):
        stats = index.groupBy("dim").agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)).alias("s")).collect()  # one row a dimension
        self.k = k
        self.rows = {r["dim"]: r["n"] for r in stats}
        self.top = {r["dim"]: math.sqrt(r["s"]) for r in stats}
        self.bits = {d: max(0, round(math.log2(n / SHARD))) for d, n in self.rows.items()}
        # The sample is what lies under a bound of the hash: some SAMPLE vectors of a dimension, without an order of the index.
        share = {d: min(1.0, min(SAMPLE, max(64, n // 8)) / n) for d, n in self.rows.items()}
        sample: dict[int, tuple[list, list]] = {d: ([], []) for d in self.rows}
        if share:
            bound = F.create_map(*(F.lit(x) for d, s in share.items() for x in (d, min(2**63 - 1, int(s * 2**64) - 2**63))))
            for r in index.where(F.xxhash64("vec_id", F.lit(3)) <= bound[F.col("dim")]).select("dim", "vec_id", "v").collect():
                sample[r["dim"]][0].append(r["vec_id"])
                sample[r["dim"]][1].append(r["v"])
        self.sample = {d: (np.array(i), np.array(v)) for d, (i, v) in sample.items()}

    def shards(self, x: np.ndarray) -> np.ndarray:
        dim = x.shape[1]
        b = self.bits[dim]
        return (lifted(x, self.top[dim]) @ planes(dim, b)[0] > 0) @ (1 << np.arange(b - 1, -1, -1)) if b else np.zeros(len(x), np.int64)

    def cosines(self, ids: np.ndarray, q: np.ndarray) -> np.ndarray:
        """The cosine (lifted) of the k-th neighbour: that of as high a rank of the sample, and two ranks more to be safe."""
        dim = q.shape[1]
        own, v = self.sample[dim]
        rank = math.ceil(self.k * len(v) / self.rows[dim]) + 2
        if len(v) <= rank:
            return np.full(len(q), -1.0)
        score = np.where(ids[:, None] == own, -np.inf, q @ v.T)
        return -np.partition(-score, rank - 1, axis=1)[:, rank - 1] / (np.sqrt((q * q).sum(axis=1)) * self.top[dim])

    def visits(self, ids: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
        """The prefix length and the shards of each query."""
        dim = q.shape[1]
        b, cos = self.bits[dim], self.cosines(ids, q)
        if not b:
            return depth_for(cos), [[0]] * len(q)
        z = unit(q) @ planes(dim, b)[0]
        home = (z > 0) @ (1 << np.arange(b - 1, -1, -1))
        c = np.clip(cos, 0, 0.999)[:, None]
        same = 0.5 * (1 + _erf(c * np.abs(z) / np.sqrt(1 - c * c) / math.sqrt(2)))
        return depth_for(cos), [[int(h) ^ m for m in likeliest(s, ROUTE)] for h, s in zip(home, same, strict=True)]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score (inner product, double) of the k nearest rows of ``vectors`` to each of ``queries`` (vec_id, column).

    A query is not its own neighbour; ties go to the smaller vec_id. Rows whose vector or id is null, or whose vector is
    empty, zero or has null or non-finite components, take no part; vectors meet those of their own dimension only. Of rows
    with one vec_id the vector that sorts first takes part. Very long vectors are rows like others; an empty table gives none.
    """
    v = F.col(column).cast("array<double>")
    fine = F.col("vec_id").isNotNull() & v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists(v, lambda c: c != 0)
    one = lambda df: df.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    # Of equal vectors the k + 1 least ids can matter, one of them perhaps the query's own.
    same = F.row_number().over(Window.partitionBy("dim", "v").orderBy("vec_id"))
    index, asked = one(vectors).withColumn("__r", same).where(F.col("__r") <= k + 1).drop("__r"), one(queries)
    router = Router(index, k)
    shared = index.sparkSession.sparkContext.broadcast(router)

    def dealt(batches, visits: bool):
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims):
                if dim not in shared.value.rows:
                    continue
                t = b.take(pa.array(np.flatnonzero(dims == dim)))
                x = _matrix(t.column("v"))
                if visits:
                    depth, shards = shared.value.visits(t.column("vec_id").to_numpy(), x)
                    count = [len(s) for s in shards]
                    t = t.take(pa.array(np.repeat(np.arange(len(shards)), count)))
                    added = [pa.array(np.concatenate(shards), pa.int64()), pa.array(np.repeat(depth, count), pa.int32())]
                else:
                    added = [pa.array(shared.value.shards(x), pa.int64())]
                yield pa.RecordBatch.from_arrays([*t.columns, *added], [*t.schema.names, "shard", *(["depth"] if visits else [])])

    columns = "vec_id long, v array<double>, dim int, shard long"
    left = index.mapInArrow(tidy(lambda b: dealt(b, False)), columns)
    right = asked.mapInArrow(tidy(lambda b: dealt(b, True)), f"{columns}, depth int")
    # Shards with too many vectors or queries are parted by id: each part of the one meets each of the other.
    parts = lambda df, most, name: df.groupBy("dim", "shard").agg(F.ceil(F.count("*") / most).alias(name))
    plan = parts(left, 2 * SHARD, "xs").join(parts(right, QUERIES, "qs"), ["dim", "shard"])
    deal = lambda df, own, other, n, m: df.join(plan, ["dim", "shard"]).withColumn(own, F.pmod(F.xxhash64("vec_id"), F.col(n))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(m) - 1))).drop("xs", "qs")
    keys = ["dim", "shard", "x", "q"]
    pairs = deal(left, "x", "q", "xs", "qs").groupBy(*keys).cogroup(deal(right, "q", "x", "qs", "xs").groupBy(*keys))
    found = pairs.applyInArrow(lambda a, b: _search_shard(a, b, k, shared.value.top), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
