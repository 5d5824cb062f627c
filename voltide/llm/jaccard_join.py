"""Near-duplicate documents: n-gram Jaccard self-join through a MinHash LSH forest, each link verified exactly.

A signature is ``trees`` strings of ``depth`` minima, and a tree is the prefix trie of the sorted strings. Documents that share
the shortest prefix in question (``prefix_length``) are a node of the trie, dealt to one task. There matching starts with the
longest prefixes: neighbours in sorted order first, then the members of ever shorter prefixes. What longer prefixes have
joined is not compared again, so a node is done as soon as its members are one group, and else when the prefix is so short
that a pair at the threshold meets in some tree with the target probability. Candidate pairs are told by their sketches;
within the clusters that they join, shingle sets are intersected in full. Copies of a text are one node throughout, only
spanning links leave a task, and nodes too large for one task are dealt as pairs of blocks, so no pair is lost and none is
written out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import checkpointed, components, written
from .textkernel import batch, chunks, grouped, map_batches, tidy, utf8, windows, word_hashes, words

#: Members of a prefix that one task compares, and members and bytes of a cluster's block.
BUCKET_BLOCK, CLUSTER_BLOCK, CLUSTER_BYTES = 1024, 512, 4 << 20
#: Ids (24 bytes each) of clustered texts up to which they are broadcast.
FEW = 500_000
_SKETCH = 5  # minima of each tree of which the sketch has a byte
_PAIRS = 100_000  # pairs that are compared at once
_A, _B = (np.random.default_rng(77).integers(1, 1 << 63, size=(2, 1024), dtype=np.uint64) * np.uint64(2) + np.uint64(1))


def prefix_length(threshold: float, trees: int, depth: int, recall: float) -> int:
    """The longest prefix with which a pair at the threshold meets in some tree with probability ``recall``."""
    d = depth
    while d > 1 and 1 - (1 - threshold**d) ** trees < recall:
        d -= 1
    return d


def shingles(buf: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of ``width`` words and their rows, sorted by row; a shorter text is one shingle, none without words."""
    start, end, row = words(buf, off)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = word_hashes(buf, start, end)
    grams, at = windows(h, row, width)
    count = np.bincount(row, minlength=len(off) - 1)
    short = np.flatnonzero((count > 0) & (count < width))
    rows = row[at]
    if len(short):
        first = np.searchsorted(row, short)
        extra = np.array([_fold(h[a : a + count[r]]) for a, r in zip(first, short, strict=True)], np.uint64)
        grams, rows = np.concatenate([grams, extra]), np.concatenate([rows, short])
    order = np.lexsort((grams, rows))
    grams, rows = grams[order], rows[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (rows[1:] != rows[:-1])
    return grams[new], rows[new]


def _fold(h: np.ndarray) -> int:
    out = len(h)
    for x in h.tolist():
        out = (out * 0x9DDFEA08EB382D69 + x) & ((1 << 64) - 1)
    return out


def signatures(docs: DataFrame, width: int, trees: int, depth: int) -> DataFrame:
    """(th, sig) of each of ``docs(th, text)`` with words: the low 16 bits of trees x depth minima."""
    schema = pa.schema([("th", pa.int64()), ("sig", pa.binary())])
    k = trees * depth

    def run(b):
        buf, off = utf8(b.column(1))
        for i, j in chunks(off):
            grams, rows = shingles(buf[off[i] : off[j]], off[i : j + 1] - off[i], width)
            if not len(rows):
                continue
            first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
            sig = np.empty((len(first), k), np.uint16)
            for c in range(k):
                sig[:, c] = np.minimum.reduceat((grams * _A[c] + _B[c]) >> np.uint64(32), first).astype(np.uint16)
            yield batch({"th": b.column(0).slice(i, j - i).take(pa.array(rows[first])), "sig": pa.array([x.tobytes() for x in sig], pa.binary())}, schema)

    return map_batches(docs, run, "th long, sig binary")


def _nodes(sigs: DataFrame, trees: int, depth: int, length: int) -> DataFrame:
    """(key, rest, th) for each tree: a hash of the tree and the shortest prefix, and the minima behind it as one number, which sorts as they do."""
    schema = pa.schema([("key", pa.int64()), ("rest", pa.int64()), ("th", pa.int64())])

    def run(b):
        sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(b.num_rows, trees, depth).astype(np.uint64)
        h = np.broadcast_to(np.arange(1, trees + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (b.num_rows, trees))
        for c in range(length):
            h = h * np.uint64(0x9DDFEA08EB382D69) + sig[:, :, c]
            h = h ^ (h >> np.uint64(31))
        rest = np.zeros(h.shape, np.uint64)
        for c in range(length, depth):
            rest = rest << np.uint64(16) | sig[:, :, c]
        yield batch({"key": h.ravel().view(np.int64), "rest": rest.ravel().view(np.int64), "th": np.repeat(b.column(0).to_numpy(), trees)}, schema)

    return map_batches(sigs.select("th", "sig"), run, "key long, rest long, th long")


def _in_blocks(members: DataFrame, group: str, blocks: str, order: list[str], tasks: int | None = None) -> DataFrame:
    """Rows dealt to units of work (group, a, b), a <= b: a group of n blocks meets itself as n(n+1)/2 of them, each row in n."""
    own = F.pmod(F.xxhash64("th", F.lit(5)), F.col(blocks)).cast("int")
    dealt = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(blocks).cast("int") - 1)))
    dealt = dealt.withColumns({"a": F.least("own", "other"), "b": F.greatest("own", "other"), "side": (F.col("own") > F.col("other")).cast("int")}).drop("own", "other", blocks)
    return dealt.repartition(*([tasks] if tasks else []), F.col(group), F.col("a"), F.col("b")).sortWithinPartitions(group, "a", "b", "side", *order)


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (the least node of a group) after the groups of a and b are joined."""
    root = np.arange(len(label))
    a, b = label[a], label[b]
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            break
    return root[label]


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, least node) of the components of the edges a-b among n nodes."""
    label = _joined(np.arange(n), a, b)
    node = np.flatnonzero(label != np.arange(n))
    return node, label[node]


class Trie:
    """Nodes of the forest in one task: rows sorted by node, side and what follows the node's prefix.

    ``cross`` marks nodes of which one block (side 0) is compared with another (side 1).
    """

    def __init__(self, group: np.ndarray, cross: np.ndarray, side: np.ndarray, rest: np.ndarray, doc: np.ndarray, sketches: np.ndarray, least: float):
        self.group, self.cross, self.side, self.rest, self.doc, self.sk, self.least = group, cross, side, rest, doc, sketches, least
        self.label = np.arange(int(doc.max(initial=-1)) + 1)
        self.compared = 0

    def compare(self, x: np.ndarray, y: np.ndarray) -> None:
        apart = self.label[self.doc[x]] != self.label[self.doc[y]]
        x, y = x[apart], y[apart]
        self.compared += len(x)
        near = (self.sk[x] == self.sk[y]).mean(axis=1) >= self.least
        self.label = _joined(self.label, self.doc[x[near]], self.doc[y[near]])

    def join(self, levels: int) -> np.ndarray:
        """Labels after matching with prefixes that are shortened ``levels`` times, from full length to the node's own."""
        order = np.lexsort((self.rest, self.group))
        x, y = order[:-1], order[1:]
        near = self.group[x] == self.group[y]
        for i in range(0, len(x), _PAIRS):  # neighbours have the longest prefix in common
            part = slice(i, i + _PAIRS)
            self.compare(x[part][near[part]], y[part][near[part]])
        left, right = np.flatnonzero(self.side == 0), np.flatnonzero(~self.cross | (self.side == 1))
        deeper = None
        for k in range(levels + 1):
            cell = self.group.astype(np.uint64) << np.uint64(48) | self.rest >> np.uint64(16 * k)
            self._within(cell, deeper, left, right)
            deeper = cell
        return self.label

    def _within(self, cell: np.ndarray, deeper: np.ndarray | None, left: np.ndarray, right: np.ndarray) -> None:
        """Compare the members of each cell that were not together in a deeper one; cells that are one group already are done."""
        _, of = np.unique(cell, return_inverse=True)
        label = self.label[self.doc]
        low, high = np.full(int(of.max(initial=-1)) + 1, len(self.label)), np.zeros(int(of.max(initial=-1)) + 1, np.int64)
        np.minimum.at(low, of, label)
        np.maximum.at(high, of, label)
        left = left[low[of[left]] < high[of[left]]]
        begin, end = np.searchsorted(cell[right], cell[left]), np.searchsorted(cell[right], cell[left], side="right")
        own = ~self.cross[left]
        begin[own] = np.searchsorted(right, left[own]) + 1
        count = end - begin
        total = np.cumsum(count)
        row = 0
        while row < len(left):
            stop = max(row + 1, int(np.searchsorted(total, (total[row - 1] if row else 0) + _PAIRS, side="right")))
            n = count[row:stop]
            x = np.repeat(left[row:stop], n)
            y = right[np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[row:stop], n)]
            if deeper is not None:
                new = deeper[x] != deeper[y]
                x, y = x[new], y[new]
            self.compare(x, y)
            row = stop


def _candidates(members: DataFrame, least: float, levels: int) -> DataFrame:
    """Spanning edges of the pairs within each node whose sketches agree enough; members(key, rest, th, sk, a, b, side) sorted."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for t in grouped(batches, ["key", "a", "b"], 20_000, lambda b: np.ones(b.num_rows)):
            key, rest, th, side, a, b = (t.column(x).to_numpy() for x in ("key", "rest", "th", "side", "a", "b"))
            sk = np.frombuffer(b"".join(t.column("sk").to_pylist()), np.uint8).reshape(len(th), -1)
            group = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            ids, doc = np.unique(th, return_inverse=True)
            label = Trie(group, a != b, side, rest.view(np.uint64), doc, sk, least).join(levels)
            node = np.flatnonzero(label != np.arange(len(ids)))
            yield batch({"a": ids[node], "b": ids[label[node]]}, schema)

    return members.mapInArrow(tidy(run), "a long, b long")


def _verified(members: DataFrame, width: int, threshold: float) -> DataFrame:
    """members(cluster, th, text, a, b, side), sorted, to rows (a, a, links) for each node and (a, b, 0) for spanning links."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])

    def solve(th, texts, side, cross):
        buf, off = utf8(texts)
        parts = [(g, r + i) for i, j in chunks(off) for g, r in [shingles(buf[off[i] : off[j]], off[i : j + 1] - off[i], width)]]
        grams, rows = np.concatenate([g for g, _ in parts]), np.concatenate([r for _, r in parts])
        n = len(th)
        size = np.bincount(rows, minlength=n)
        _, column, seen = np.unique(grams, return_inverse=True, return_counts=True)
        shared = seen[column] > 1  # what one text alone has meets nothing
        rows, column = rows[shared], np.unique(column[shared], return_inverse=True)[1]
        order = np.argsort(column, kind="stable")
        rows, column = rows[order], column[order]
        own = np.flatnonzero(side == 0) if cross else np.arange(n)
        other = np.flatnonzero(side == 1) if cross else own
        both = np.zeros((len(own), len(other)), np.float32)
        n_columns = int(column[-1]) + 1 if len(column) else 0
        step = min(n_columns, max(256, (1 << 22) // max(1, n)))
        for c in range(0, n_columns, step or 1):
            x, y = np.searchsorted(column, [c, c + step])
            dense = np.zeros((n, step), np.float32)
            dense[rows[x:y], column[x:y] - c] = 1
            both += dense[own] @ dense[other].T
        near = both >= threshold * (size[own][:, None] + size[other][None] - both) - 1e-6
        if not cross:
            np.fill_diagonal(near, False)
        x, y = np.nonzero(near)
        node, root = _forest(own[x], other[y], n)
        links = np.zeros(n, np.int64)
        np.add.at(links, own, near.sum(axis=1))
        if cross:
            np.add.at(links, other, near.sum(axis=0))
        at = np.flatnonzero(links)
        return np.concatenate([th[at], th[node]]), np.concatenate([th[at], th[root]]), np.concatenate([links[at], np.zeros(len(node), np.int64)])

    def run(batches):
        for t in grouped(batches, ["cluster", "a", "b"], CLUSTER_BYTES, lambda b: np.diff(utf8(b.column(b.schema.get_field_index("text")))[1])):
            cluster, th, side, a, b = (t.column(x).to_numpy() for x in ("cluster", "th", "side", "a", "b"))
            new = np.concatenate([[True], (cluster[1:] != cluster[:-1]) | (th[1:] != th[:-1]) | (side[1:] != side[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            if not new.all():  # repeated rows
                t, (cluster, th, side, a, b) = t.filter(pa.array(new)), (x[new] for x in (cluster, th, side, a, b))
            border = np.flatnonzero(np.concatenate([[True], (cluster[1:] != cluster[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1]), [True]]))
            out = [solve(th[i:j], t.column("text").slice(i, j - i), side[i:j], a[i] != b[i]) for i, j in zip(border[:-1], border[1:], strict=True) if j > i + 1]
            if out:
                yield batch(dict(zip(schema.names, map(np.concatenate, zip(*out, strict=True)), strict=True)), schema)

    return members.mapInArrow(tidy(run), "a long, b long, links long")


def near_duplicates(docs: DataFrame, width: int = 5, threshold: float = 0.8, trees: int = 20, depth: int = 7, recall: float = 0.9999, slack: float = 0.2) -> DataFrame:
    """One row (doc_id, th, text_class, class_id, n_copies, n_links) for each row of ``docs(doc_id, text, ...)``.

    ``text_class`` is the least doc_id with an equal text, ``n_copies`` the number of rows with it, ``n_links`` the number of
    different texts whose sets of ``width``-word shingles have a Jaccard similarity of ``threshold`` or more, and ``class_id`` the
    least doc_id of all that such links and equal texts join. Texts of fewer words are one shingle; texts without words
    (null too, as empty) have no links, but equal ones share a class. A null doc_id sorts first as -1 in class ids; repeated
    rows are copies. Equality is that of 64-bit hashes.

    ``recall`` is the probability that a pair at the threshold meets in some tree. Pairs that meet are candidates if their
    sketches agree to ``threshold - slack``; by default that is five standard deviations below the mean for a pair at the
    threshold, and ``slack=threshold`` makes all pairs that meet candidates.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select(F.coalesce(F.col("doc_id"), F.lit(-1)).cast("long").alias("id"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    length = prefix_length(threshold, trees, depth, recall)
    sigs = written(signatures(own.select("th", "text"), width, trees, depth).dropDuplicates(["th"]))
    nodes = _nodes(sigs, trees, depth, length)
    common = nodes.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key", F.ceil(F.col("m") / BUCKET_BLOCK).alias("blocks"))
    members = nodes.join(common, "key").join(_sketches(sigs, trees, depth), "th").select("key", "rest", "th", "sk", "blocks")
    edges = _candidates(_in_blocks(members, "key", "blocks", ["rest", "th"]), threshold - slack, depth - length)
    clusters = checkpointed(components(edges).select(F.col("node").alias("th"), F.col("component").alias("cluster")))
    texts = written(own.select("id", "th").join(clusters, "th").groupBy("cluster", "th").agg(F.min("id").alias("id")))
    few = texts.count() <= FEW  # then only these texts are shuffled
    rep = own.join(F.broadcast(texts) if few else texts, ["th", "id"]).select("cluster", "th", "text")
    sizes = own.select("th", F.length("text").alias("c")).join(clusters, "th").groupBy("cluster", "th").agg(F.max("c").alias("c")).groupBy("cluster").agg(F.count("*").alias("m"), F.sum("c").alias("c"))
    sizes = checkpointed(sizes.select("cluster", "c", F.greatest(F.ceil(F.col("m") / CLUSTER_BLOCK), F.ceil(F.col("c") / CLUSTER_BYTES)).alias("blocks")))
    # The work grows with a cluster's size times its blocks, so tasks are not cut by the bytes that they read.
    work = sizes.agg(F.sum(F.col("c") * F.col("blocks"))).first()[0] or 0
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-work // CLUSTER_BYTES))
    checked = checkpointed(_verified(_in_blocks(rep.join(sizes.drop("c"), "cluster"), "cluster", "blocks", ["th"], tasks), width, threshold))
    links = checked.where("a = b").groupBy("a").agg(F.sum("links").alias("n_links")).withColumnRenamed("a", "th")
    joined = components(checked.where("a != b").select("a", "b")).select(F.col("node").alias("th"), "component")
    kinds = own.groupBy("th").agg(F.min("id").alias("text_class"), F.count("*").alias("n_copies"))
    kinds = kinds.join(joined, "th", "left").withColumn("component", F.coalesce("component", "th")).join(links, "th", "left")
    least = kinds.groupBy("component").agg(F.min("text_class").alias("class_id"))
    kinds = kinds.join(least, "component").select("th", "text_class", "class_id", "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return own.select("doc_id", "th").join(kinds, "th").select("doc_id", "th", "text_class", "class_id", "n_copies", "n_links")


def _sketches(sigs: DataFrame, trees: int, depth: int) -> DataFrame:
    """(th, sk): the low byte of the first minima of each tree."""
    schema = pa.schema([("th", pa.int64()), ("sk", pa.binary())])

    def run(b):
        sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(b.num_rows, trees, depth)[:, :, :_SKETCH].astype(np.uint8)
        yield batch({"th": b.column(0), "sk": pa.array([x.tobytes() for x in sig], pa.binary())}, schema)

    return map_batches(sigs.select("th", "sig"), run, "th long, sk binary")


def one_of_each_class(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay when one row of each near-duplicate class does: that with the least doc_id.

    Repeated rows of that doc_id and text leave one.
    """
    names = docs.columns
    stay = near_duplicates(docs, **options).where(F.coalesce("doc_id", F.lit(-1)) == F.col("class_id")).select(F.col("th").alias("__th"), F.col("class_id").alias("__id")).distinct()
    # Two different texts of one class may carry the same least doc_id; the lesser hash stays.
    stay = stay.groupBy("__id").agg(F.min("__th").alias("__th"))
    own = docs.withColumn("__k", F.coalesce(F.col("doc_id"), F.lit(-1)).cast("long")).withColumn("__h", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    left = own.join(stay, (F.col("__k") == F.col("__id")) & (F.col("__h") == F.col("__th")))
    return left.dropDuplicates(["__k", "__h"]).select(*names)
