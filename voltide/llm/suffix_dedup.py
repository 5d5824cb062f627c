"""Removal of repeated strings by longest-previous-factor arrays over suffix order.

Texts are sequences of units: their UTF-8 bytes, or their words. A unit is removed if a string of ``length`` units that covers
it also starts elsewhere in the corpus (``keep="none"``) or starts earlier (``keep="first"``). Work is dealt out by content:
every window of ``length`` units has an anchor, its least-hashed gram (the leftmost of equals), which depends on the window
alone. Successive windows with one anchor form a segment; equal windows always lie in segments with equal anchors. So the
corpus falls into independent groups of segments, most of them with one member. Equal segments are one string, counted;
the different ones of a group are put into suffix order, where the previous and next smaller positions give every
position's longest previous factor. A group with too many different segments for one task is dealt again, by longer
stretches around the anchor (``_halves``), until its groups fit or their members are equal.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import written
from .textkernel import CHUNK_BYTES, RollingHash, batch, chunks, grouped, map_batches, tidy, utf8, word_hashes, words

#: Different segments of a group up to which they are put into suffix order in one task; larger groups are dealt again.
GROUP_LIMIT = 2000
#: Ids (16 bytes each) of texts with large groups up to which they are broadcast.
FEW = 500_000
#: Bytes of segments that are put into suffix order at once.
SUFFIX_BYTES = 1 << 19

_POS = 18  # bits of a position within a pass
_CORE = np.zeros(256, bool)  # what a word is without the punctuation around it
_CORE[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True


def in_bytes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Units and row offsets of texts as bytes."""
    return buf, off


def in_words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Units and row offsets of texts as words: 64-bit hashes of the words without the punctuation around them (a word of punctuation is taken whole)."""
    start, end, row = words(buf, off)
    core = np.flatnonzero(_CORE[buf])
    a, z = np.searchsorted(core, start), np.searchsorted(core, end)
    has = np.flatnonzero(z > a)
    start, end = start.copy(), end.copy()
    start[has], end[has] = core[a[has]], core[z[has] - 1] + 1
    return word_hashes(buf, start, end), np.searchsorted(row, np.arange(len(off)))


UNITS = {"bytes": (in_bytes, np.uint8), "words": (in_words, np.uint64)}


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def segments(units: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Row, start, end, anchor (within the row), anchor hash and content hash of each segment of the rows."""
    out: list[tuple[np.ndarray, ...]] = []
    step = (1 << _POS) - length
    for p0 in range(0, max(0, len(units) - length + 1), step):
        part = units[p0 : p0 + step + length - 1]
        n = len(part) - length + 1
        if n <= 0:
            break
        one = RollingHash(part)
        grams = one.all(gram)
        low = np.uint64((1 << _POS) - 1)
        least = _sliding_min((grams & ~low) | np.arange(len(grams), dtype=np.uint64), length - gram + 1)
        at = (least & low).astype(np.int64)[:n]
        row_of = np.searchsorted(off, np.arange(p0, p0 + n), side="right") - 1 if len(off) > 2 else np.zeros(n, np.int64)
        whole = np.arange(p0 + length, p0 + length + n) <= off[row_of + 1]
        first = np.ones(n, bool)
        first[1:] = (at[1:] != at[:-1]) | (row_of[1:] != row_of[:-1]) | (whole[1:] & ~whole[:-1])
        last = np.ones(n, bool)
        last[:-1] = first[1:] | (whole[:-1] & ~whole[1:])
        s, e = np.flatnonzero(first & whole), np.flatnonzero(last & whole)
        rows = row_of[s]
        out.append((rows, p0 + s - off[rows], p0 + e + length - off[rows], p0 + at[s] - off[rows], grams[at[s]], one(s, e + length)))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _dense(keys: np.ndarray) -> np.ndarray:
    """Ranks of the keys from 1 on, equal keys sharing one."""
    order = np.argsort(keys)
    ordered = keys[order]
    step = np.ones(len(keys), np.int32)
    step[1:] = ordered[1:] != ordered[:-1]
    out = np.empty(len(keys), np.int32)
    out[order] = np.cumsum(step)
    return out


class SuffixOrder:
    """Suffixes of the parts of a sequence, sorted by prefix doubling; equal suffixes of different parts by position.

    ``ranks[k]`` orders all positions by the 2**k units from there on (fewer at a part's end).
    """

    def __init__(self, units: np.ndarray, off: np.ndarray):
        n = len(units)
        self.room = np.repeat(off[1:], np.diff(off)) - np.arange(n)  # units to the end of the part
        rank = units.astype(np.int64) + 1 if units.dtype == np.uint8 else _dense(units)
        self.ranks, depth, longest = [rank], 1, int(self.room.max(initial=1))
        while depth < longest:
            if int(rank.max()) >= 1 << 31:
                rank = self.ranks[-1] = _dense(rank)
            more = np.flatnonzero(self.room > depth)
            key = rank.astype(np.int64) * (int(rank.max()) + 1)
            key[more] += rank[more + depth]
            depth *= 2
            rank = key if depth < 8 and units.dtype == np.uint8 else _dense(key)
            self.ranks.append(rank)
        self.order = np.argsort(rank, kind="stable")

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the longest common prefixes of the suffixes at a and b."""
        room = np.minimum(self.room[a], self.room[b])
        size = np.zeros(len(a), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            todo = np.flatnonzero(size < room)
            same = self.ranks[k][a[todo] + size[todo]] == self.ranks[k][b[todo] + size[todo]]
            size[todo[same]] += 1 << k
        return np.minimum(size, room)

    def factors(self, least: int = 1, later: bool = False) -> np.ndarray:
        """For each position the length of the longest factor from there on that also starts earlier (``later``: later); 0 if under ``least``.

        That factor is shared with the previous or the next smaller (larger) position in suffix order.
        """
        out = np.zeros(len(self.order), np.int64)
        k = min(least.bit_length() - 1, len(self.ranks) - 1)
        x = -self.order if later else self.order
        for side in (1, -1):
            near = nearest_smaller(x[::side])
            own = np.flatnonzero(near >= 0)
            at, source = self.order[::side][own], self.order[::side][near[own]]
            may = self.ranks[k][at] == self.ranks[k][source]
            at, source = at[may], source[may]
            out[at] = np.maximum(out[at], self.common(at, source))
        out[out < least] = 0
        return out


def nearest_smaller(x: np.ndarray) -> np.ndarray:
    """For each place the nearest one before it with a smaller value, or -1: candidates step along the candidates of those that they meet."""
    near = np.arange(-1, len(x) - 1)
    todo = np.arange(1, len(x))
    while len(todo):
        todo = todo[x[near[todo]] > x[todo]]
        near[todo] = near[near[todo]]
        todo = todo[near[todo] >= 0]
    return near


def factor_runs(units: np.ndarray, off: np.ndarray, length: int, both: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Part, start and end of the runs covered by repeated windows of ``length`` units, parts being in order of precedence; ``both``: of first places too."""
    order = SuffixOrder(units, off)
    hit = order.factors(length) > 0
    if both:
        hit |= order.factors(length, later=True) > 0
    found = np.flatnonzero(hit)
    part = np.searchsorted(off, found, side="right") - 1
    new = np.ones(len(found), bool)
    new[1:] = (np.diff(found) > length) | (np.diff(part) > 0)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(found)) - 1 if len(first) else first
    return part[first], found[first] - off[part[first]], found[last] - off[part[first]] + length


def _strings(units: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The stretches of a sequence as binary values."""
    size = end - start
    off = np.zeros(len(start) + 1, np.int64)
    np.cumsum(size, out=off[1:])
    flat = np.ascontiguousarray(units[np.arange(off[-1]) + np.repeat(start - off[:-1], size)])
    return pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(off * units.itemsize), pa.py_buffer(flat)]).cast(pa.binary())


def _units_of(strings: pa.Array | pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """What _strings made, end to end, and where each begins."""
    buf, off = utf8(strings.cast(pa.large_binary()), as_is=True)
    width = np.dtype(kind).itemsize
    return np.frombuffer(buf.tobytes(), kind), off // width


def _find(docs: DataFrame, length: int, gram: int, unit: str) -> DataFrame:
    """Segments of each text, equal ones of one text as one row: where the first begins, and where the others do."""
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("s", pa.int32()), ("size", pa.int32()), ("a", pa.int32()), ("h", pa.int64()), ("fp", pa.int64()), ("more", pa.list_(pa.int32()))])
    split = UNITS[unit][0]

    def run(b):
        buf, off = utf8(b.column(2))
        for i, j in chunks(off):
            rows, s, e, a, h, fp = segments(*split(buf[off[i] : off[j]], off[i : j + 1] - off[i]), length, gram)
            if not len(rows):
                continue
            order = np.lexsort((s, fp, h, rows))
            rows, s, e, a, h, fp = (x[order] for x in (rows, s, e, a, h, fp))
            new = np.ones(len(rows), bool)
            new[1:] = (rows[1:] != rows[:-1]) | (h[1:] != h[:-1]) | (fp[1:] != fp[:-1])
            first = np.flatnonzero(new)
            others = np.concatenate([[0], np.cumsum(np.diff(np.append(first, len(rows))) - 1)])
            own = b.select([0, 1]).slice(i, j - i).take(pa.array(rows[first]))
            more = pa.ListArray.from_arrays(pa.array(others, pa.int32()), pa.array(s[~new], pa.int32()))
            yield batch({"doc_id": own.column(0), "th": own.column(1), "s": s[first].astype(np.int32), "size": (e - s)[first].astype(np.int32), "a": (a - s)[first].astype(np.int32), "h": h[first].view(np.int64), "fp": fp[first].view(np.int64), "more": more}, schema)

    return map_batches(docs, run, "doc_id long, th long, s int, size int, a int, h long, fp long, more array<int>")


_PIECE = "key long, doc_id long, th long, s int, a int, lo int, hi int, part binary"


def _cut(texts: DataFrame, unit: str, most: int) -> DataFrame:
    """(__k, __h, text, __segs, ...) to one row for each segment, with its units and the place of its anchor among them."""
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("th", pa.int64()), ("s", pa.int32()), ("a", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32()), ("part", pa.binary())])
    split = UNITS[unit][0]

    def run(b):
        buf, off = utf8(b.column("text"))
        for i, j in chunks(off):
            units, o = split(buf[off[i] : off[j]], off[i : j + 1] - off[i])
            lists = b.column("__segs").slice(i, j - i)
            row = np.repeat(np.arange(j - i), pc.list_value_length(lists).to_numpy())
            flat = lists.flatten()
            s, size, a, h = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(4))
            for x in range(0, len(s), 256):
                y = slice(x, x + 256)
                own = b.select(["__k", "__h"]).slice(i, j - i).take(pa.array(row[y]))
                zero = np.zeros(len(s[y]), np.int32)
                yield batch({"key": h[y], "doc_id": own.column(0), "th": own.column(1), "s": s[y], "a": a[y], "lo": zero, "hi": zero + np.int32(most), "part": _strings(units, o[row[y]] + s[y], o[row[y]] + s[y] + size[y])}, schema)

    return map_batches(texts, run, _PIECE)


def _halves(pieces: DataFrame, unit: str, length: int, gram: int) -> DataFrame:
    """Pieces of groups that are too large, each dealt to one or two smaller groups.

    A piece holds the windows that begin ``lo`` to ``hi`` units before its anchor, as far as its text has them. Those of either
    half of that range share a longer stretch around the anchor than all do, and that stretch is the key of the new group. So
    windows that are equal stay together, and windows of a range of one have all their units in the key.
    """
    schema = pa.schema([("key", pa.int64()), ("fp", pa.int64()), ("doc_id", pa.int64()), ("th", pa.int64()), ("s", pa.int32()), ("a", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32()), ("part", pa.binary())])
    kind = UNITS[unit][1]

    def run(b):
        strings = b.column("part").cast(pa.large_binary())
        for i, j in chunks(utf8(strings, as_is=True)[1]):
            units, off = _units_of(strings.slice(i, j - i), kind)
            key, doc_id, th, s, a, lo, hi = (b.column(k).slice(i, j - i).to_numpy() for k in ("key", "doc_id", "th", "s", "a", "lo", "hi"))
            hashed, base = RollingHash(units), off[:-1]
            far, near = a, a - (np.diff(off) - length)  # the first and the last window's distance
            mid = (lo + hi) // 2
            for child, (l, h) in enumerate(((lo, mid), (mid + 1, hi))):
                d1, d0 = np.minimum(far, h), np.maximum(near, l)
                own = np.flatnonzero((d1 >= d0) & (lo < hi))
                if not len(own):
                    continue
                l, h, d1, d0, o, at = l[own], h[own], d1[own], d0[own], base[own], a[own]
                start, end = o + at - d1, o + at - d0 + length
                stretch = hashed(o + at - l, o + at + length - h)
                new = (key[own].view(np.uint64) * np.uint64(0x9DDFEA08EB382D69) + stretch) * np.uint64(2) + np.uint64(child)
                yield batch({"key": new.view(np.int64), "fp": hashed(start, end).view(np.int64), "doc_id": doc_id[own], "th": th[own], "s": (s[own] + at - d1).astype(np.int32), "a": d1.astype(np.int32), "lo": l.astype(np.int32), "hi": h.astype(np.int32), "part": _strings(units, start, end)}, schema)

    return map_batches(pieces, run, _PIECE.replace("key long", "key long, fp long"))


def _suffix_sorted(parts: DataFrame, unit: str, length: int, both: bool) -> DataFrame:
    """Spans of the pieces, which come sorted by group and precedence; whole groups are gathered up to SUFFIX_BYTES."""
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("s", pa.int32()), ("e", pa.int32())])
    kind = UNITS[unit][1]

    def run(batches):
        for t in grouped(batches, ["key"], SUFFIX_BYTES, lambda b: pc.binary_length(b.column("part")).to_numpy()):
            key, doc_id, th, s = (t.column(k).to_numpy() for k in ("key", "doc_id", "th", "s"))
            again = np.zeros(len(key), bool)  # of a repeated row
            again[1:] = (key[1:] == key[:-1]) & (doc_id[1:] == doc_id[:-1]) & (th[1:] == th[:-1]) & (s[1:] == s[:-1])
            own = np.flatnonzero(~again)
            part, start, end = factor_runs(*_units_of(t.column("part").take(pa.array(own)), kind), length, both)
            part = own[part]
            yield batch({"doc_id": doc_id[part], "th": th[part], "s": (s[part] + start).astype(np.int32), "e": (s[part] + end).astype(np.int32)}, schema)

    return parts.select("key", "doc_id", "th", "s", "part").mapInArrow(tidy(run), "doc_id long, th long, s int, e int")


def _listed(kinds: DataFrame) -> DataFrame:
    """(doc_id, th, __segs) of the first places of different segments."""
    seg = F.struct("first.s", "first.size", "first.a", "h")
    return kinds.select("first.doc_id", "first.th", seg.alias("seg")).groupBy("doc_id", "th").agg(F.collect_list("seg").alias("__segs"))


def repeated_spans(docs: DataFrame, length: int = 400, keep: str = "none", gram: int | None = None, unit: str = "bytes") -> DataFrame:
    """Spans (doc_id, th, s, e), in units, of ``docs(__k, __h, text, ...)`` that lie in repeated strings of ``length`` units.

    ``__k`` is the id and ``__h`` a hash of the text; rows equal in both are copies of each other. With ``keep="first"`` a string's first
    place, in the order (doc_id, th, offset), is left out, for ``"none"`` all its places are given. Spans may overlap.
    """
    gram = gram or max(1, length // 4)
    both = keep == "none"
    found = written(_find(docs.select("__k", "__h", "text"), length, gram, unit))
    count = F.sum(F.size("more") + 1).alias("n")
    # Counts are written before they are joined: between two plain shuffles Spark splits a hot anchor over tasks.
    anchors = found.groupBy("h").agg(count, F.min("fp").alias("f0"), F.max("fp").alias("f1")).where("n > 1")
    hits = written(found.join(written(anchors.select("h", (F.col("f0") != F.col("f1")).alias("mixed"))), "h"))
    place = F.struct("doc_id", "th", "s")
    kinds = written(hits.groupBy("h", "fp", "mixed").agg(count, F.min(F.struct("doc_id", "th", "s", "size", "a")).alias("first")))
    again = hits.join(kinds.where("n > 1").select("h", "fp", F.struct("first.doc_id", "first.th", "first.s").alias("place")), ["h", "fp"])
    places = F.concat(F.array("s"), F.col("more"))
    again = again.select("doc_id", "th", "size", F.explode(places if both else F.when(place == F.col("place"), F.col("more")).otherwise(places)).alias("s"))
    spans = [again.select("doc_id", "th", "s", (F.col("s") + F.col("size")).alias("e"))]
    kinds = kinds.where("mixed")
    wide = written(kinds.groupBy("h").agg(F.count("*").alias("m")).where(F.col("m") > GROUP_LIMIT).select("h"))
    sort = lambda p: p.repartition(F.col("key")).sortWithinPartitions("key", "doc_id", "th", "s")
    # Copies settled by counting stay, once, as what others are compared with. All columns go along, so that this shuffle of
    # the texts is the one that remove_repeats joins the spans to.
    spans.append(_suffix_sorted(sort(_cut(_of(docs, _listed(kinds.join(wide, "h", "left_anti")), "inner"), unit, length - gram)), unit, length, both))
    if not wide.isEmpty():
        listed = written(_listed(kinds.join(wide, "h")))
        texts = docs
        if listed.count() <= FEW:  # only these texts are shuffled then
            texts = docs.join(F.broadcast(listed.select(F.col("doc_id").alias("__k"), F.col("th").alias("__h"))), ["__k", "__h"], "left_semi").select(docs.columns)
        hot = _cut(_of(texts, listed, "inner"), unit, length - gram)
    while not wide.isEmpty():
        pieces = written(_halves(hot, unit, length, gram))
        kinds = written(pieces.groupBy("key", "fp").agg(F.min(place).alias("first"), F.max(place).alias("last")))
        again = pieces.join(kinds.where("first != last").select("key", "fp", "first"), ["key", "fp"])
        again = again if both else again.where(place != F.col("first"))
        spans.append(again.select("doc_id", "th", "s", (F.col("s") + F.octet_length("part") / np.dtype(UNITS[unit][1]).itemsize).cast("int").alias("e")))
        sizes = written(kinds.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"))
        wide = sizes.where(F.col("m") > GROUP_LIMIT)
        kinds = written(kinds.join(sizes, "key").select("key", "fp", "first", (F.col("m") > GROUP_LIMIT).alias("hot")))
        parts = pieces.join(kinds, ["key", "fp"]).where(place == F.col("first"))
        spans.append(_suffix_sorted(sort(parts.where("NOT hot")), unit, length, both))
        hot = parts.where("hot")
    out = spans[0]
    for x in spans[1:]:
        out = out.unionByName(x)
    return out


def keyed(docs: DataFrame) -> DataFrame:
    """docs with __k, the id (null: -1 for matching), and __h, a hash of the text (null: empty)."""
    return docs.withColumns({"__k": F.coalesce(F.col("doc_id"), F.lit(-1)).cast("long"), "__h": F.xxhash64(F.coalesce(F.col("text"), F.lit("")))})


def _of(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """Keyed docs with the third column of found(doc_id, th, ...)."""
    found = found.withColumnsRenamed({"doc_id": "__id", "th": "__th"})
    return docs.join(found, (F.col("__k") == F.col("__id")) & (F.col("__h") == F.col("__th")), how).drop("__id", "__th")


def merge(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the union of spans; spans that only touch join."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(s[1:] > e[:-1]) + 1
    first, last = np.concatenate([[0], new]), np.concatenate([new - 1, [len(s) - 1]])
    return list(zip(s[first].tolist(), e[last].tolist(), strict=True))


def remove_repeats(docs: DataFrame, length: int = 400, keep: str = "first", as_text: bool = False, unit: str = "bytes") -> DataFrame:
    """All rows and columns of ``docs(doc_id, text, ...)`` plus ``kept`` (bytes that stay), ``n_bytes``, ``n_removed`` and ``spans`` (in bytes).

    ``unit`` is what ``length`` counts: bytes, or words, which are compared without the punctuation around them and go with it,
    and with what lies between them. With ``as_text`` kept is a string, without the characters that a span's ends cut through.

    Null texts are empty; texts under ``length`` units stay whole; an empty table gives none. Rows equal in doc_id and text
    are copies of each other; with ``keep="first"`` such a row keeps what its first place keeps, so both rows of such a
    pair keep it. Columns named like the added ones are replaced. Equality of long segments is that of 64-bit hashes.
    """
    docs = docs.drop("kept", "n_bytes", "n_removed", "spans", "__k", "__h")
    own = keyed(docs)
    spans = repeated_spans(own, length, keep, unit=unit)
    spans = spans.groupBy("doc_id", "th").agg(F.collect_set(F.struct("s", "e")).alias("__spans"))
    joined = _of(own, spans, "left").drop("__k", "__h")
    names = docs.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def runs_of(raw, found):
        merged = merge(np.array([x["s"] for x in found]), np.array([x["e"] for x in found]))
        if unit == "words":
            start, end, _ = words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
            merged = [(int(start[a]), int(end[z - 1])) for a, z in merged]
        return merged

    def run(b):
        kept, total, gone, runs = [], [], [], []
        for text, found in zip(b.column(names.index("text")).to_pylist(), b.column(len(names)).to_pylist(), strict=True):
            raw = (text or "").encode()
            merged = runs_of(raw, found) if found else []
            edges = [0, *(p for x in merged for p in x), len(raw)]
            kept.append(b"".join(raw[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True)) if merged else raw)
            total.append(len(raw))
            gone.append(len(raw) - len(kept[-1]))
            runs.append([{"s": a, "e": z} for a, z in merged])
        stay = pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], stay, pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])))], [*names, "kept", "n_bytes", "n_removed", "spans"])

    return map_batches(joined, run, f"{kinds}, kept {'string' if as_text else 'binary'}, n_bytes long, n_removed long, spans array<struct<s: long, e: long>>")


def digest(docs: DataFrame, length: int = 400) -> DataFrame:
    """One row per document: sizes, removed runs and the hash of what is left, all places of a repeated string removed."""
    out = remove_repeats(docs.select("doc_id", "text"), length, keep="none")
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list, length: int) -> list[list[tuple[int, int]]]:
    """Spans by looking at every window; for tests."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for p in range(len(t) - length + 1):
            seen[t[p : p + length]] = seen.get(t[p : p + length], 0) + 1
    out = []
    for t in texts:
        hit = [p for p in range(len(t) - length + 1) if seen[t[p : p + length]] > 1]
        out.append(merge(np.array(hit), np.array(hit) + length) if hit else [])
    return out


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()
