"""Quality rules: a decision list of threshold conjunctions, learnt by sequential covering from labelled text statistics.

Statistics come from one vectorised pass over each text. Rules for low quality are grown condition by condition and pruned
on rows set aside; the list becomes one ordered Spark CASE expression over the statistics.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import written
from .textkernel import RollingHash, chunks, map_batches, utf8, windows, words

#: Labelled rows that are learnt from at most, conditions of a rule, and the precision that a rule must show on rows set aside.
SAMPLE_ROWS, MOST_CONDITIONS, PRECISION = 20_000, 3, 0.9

STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_digits", "n_bangs"]
#: Ratios that conditions are about, as SQL over the statistics.
RATIOS = {
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "upper_share": "n_upper / greatest(n_letters, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "bang_share": "n_bangs / greatest(n_words, 1)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "n_words": "CAST(n_words AS DOUBLE)",
}


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_SYMBOL, _DIGIT, _BANG = _table(b"#*$%&|<>"), _table(b"0123456789"), _table(b"!")
_UPPER = _table(bytes(range(ord("A"), ord("Z") + 1)))
_ASCII_LETTER = _UPPER | _table(bytes(range(ord("a"), ord("z") + 1)))


def _sums(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def text_statistics(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    n = len(off) - 1
    start, end, row = words(buf, off)
    inside = np.zeros(len(buf) + 1, np.int8)
    inside[start] = 1
    inside[end] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    inside[start] = True
    lead = (buf & 0xC0) != 0x80
    out = {"n_words": np.bincount(row, minlength=n), "word_chars": _sums(inside & lead, off)}
    roll = RollingHash(buf)
    # Words of the 5-word windows that a text holds twice or more.
    h, at = windows(roll(start, end), row, 5)
    order = np.lexsort((h, row[at]))
    same = (h[order][1:] == h[order][:-1]) & (row[at][order][1:] == row[at][order][:-1])
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(start) + 5, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + 5, -1)
    repeated = np.cumsum(cover)[: len(start)] > 0
    # Lines with a word that equal an earlier line of the text.
    line0, line1 = _lines(buf, off)
    used = np.searchsorted(start, line1) > np.searchsorted(start, line0)
    line0, line1 = line0[used], line1[used]
    owner = np.searchsorted(off, line0, side="right") - 1
    lh = roll(line0, line1)
    order = np.lexsort((lh, owner))
    again = (lh[order][1:] == lh[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    out["n_symbols"] = _sums(_SYMBOL[buf], off)
    out["n_dup_lines"] = np.bincount(owner[order][1:][again], minlength=n)
    out["n_repeat_words"] = np.bincount(row[repeated], minlength=n)
    out["n_lines"] = np.bincount(owner, minlength=n)
    out |= {k: _sums(t[buf], off) for k, t in (("n_upper", _UPPER), ("n_letters", _ASCII_LETTER), ("n_digits", _DIGIT), ("n_bangs", _BANG))}
    return out


def _lines(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the non-empty lines."""
    cut = np.flatnonzero(buf == 10)
    starts = np.union1d(off[:-1], cut + 1)
    starts = starts[starts < len(buf)]
    starts = starts[buf[starts] != 10]
    ends = np.union1d(cut, off[1:])
    return starts, ends[np.searchsorted(ends, starts, side="right")]


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and STATISTICS of each row of docs(doc_id, text); null texts are empty."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(b):
        buf, off = utf8(b.column(1))
        parts = [text_statistics(buf[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in chunks(off)]
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.concatenate([p[k] for p in parts]), pa.int64()) for k in STATISTICS)], ["doc_id", *STATISTICS])

    return map_batches(docs.select("doc_id", "text"), run, ", ".join([f"doc_id {kind}", *(f"{k} long" for k in STATISTICS)]))


Condition = tuple[str, str, float]


def _holds(x: dict[str, np.ndarray], rule: list[Condition]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for name, op, limit in rule:
        out &= x[name] >= limit if op == ">=" else x[name] <= limit
    return out


def learn(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = PRECISION) -> list[list[Condition]]:
    """Rules, in order, whose union marks low quality. Grown on two thirds of the rows by FOIL gain, pruned on the rest."""
    n = len(bad)
    grow = np.random.default_rng(11).permutation(n) % 3 != 0
    left = np.ones(n, bool)
    rules: list[list[Condition]] = []
    while (left & grow & bad).any():  # a rule takes three rows at least
        pool = left & grow
        steps = {k: np.unique(np.quantile(v[pool & bad], np.linspace(0, 1, 33))) for k, v in x.items()}
        rule: list[Condition] = []
        inside = pool.copy()
        while len(rule) < MOST_CONDITIONS and (inside & bad).any() and (inside & ~bad).any():
            p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
            best, what = 0.0, None
            for name, limits in steps.items():
                for limit in limits.tolist():
                    for op in (">=", "<="):
                        hit = inside & (x[name] >= limit if op == ">=" else x[name] <= limit)
                        p, m = (hit & bad).sum(), (hit & ~bad).sum()
                        gain = p * (np.log2(p / (p + m)) - np.log2(p0 / (p0 + n0))) if p else 0.0
                        if gain > best + 1e-12:
                            best, what = gain, (name, op, limit)
            if what is None:
                break
            rule.append(what)
            inside &= _holds(x, [what])
        if not rule:
            break
        test = left & ~grow

        def worth(r: list[Condition], test=test) -> float:
            hit = test & _holds(x, r)
            p, m = (hit & bad).sum(), (hit & ~bad).sum()
            return (p - m) / (p + m) if p + m else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        hit = left & _holds(x, rule)
        p, m = (hit & bad).sum(), (hit & ~bad).sum()
        if p < 3 or p < precision * (p + m) or worth(rule) < 2 * precision - 1:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """The list as an ordered conditional: false at the first rule that holds, else true."""
    out = None
    for rule in rules:
        test = F.expr(" AND ".join(f"({RATIOS[name]}) {op} {limit!r}D" for name, op, limit in rule))
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def train(docs: DataFrame, labels: DataFrame) -> list[list[Condition]]:
    """Rules from labels(doc_id, quality), where 0 is low, on at most SAMPLE_ROWS labelled rows.

    Ids are drawn by their hash, and of the rows of those ids, however many, the SAMPLE_ROWS with the least hashes of id and
    statistics; rows equal in these count once.
    """
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    share = min(1.0, SAMPLE_ROWS / max(1, known.count()))
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) < share * 1_000_000)
    drawn = written(drawn)
    ids = F.broadcast(drawn.select("doc_id"))  # about SAMPLE_ROWS short rows, a bound of the draw
    rows = statistics(docs.select("doc_id", "text").join(ids, "doc_id", "left_semi")).join(F.broadcast(drawn), "doc_id")
    own = F.xxhash64(*(c for c in rows.columns if c != "quality")).alias("__own")
    drawn_rows = rows.select("quality", own, *(F.expr(sql).alias(k) for k, sql in RATIOS.items())).dropDuplicates(["__own"])
    t = drawn_rows.orderBy("__own").limit(SAMPLE_ROWS).drop("__own").toPandas()
    order = np.lexsort([t[k].to_numpy() for k in t])
    return learn({k: t[k].to_numpy(np.float64)[order] for k in RATIOS}, (t["quality"].to_numpy() == 0)[order])


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics, base_failed and kept of each row of docs(doc_id, text, ...), with rules learnt from labels(doc_id, quality, ...).

    Null and empty texts have no words and fail the base; repeated rows are judged each; null ids have no label; of
    several labels of an id the least counts; other columns are left out. Very long texts are read whole. Ties between conditions go to the one found first. Without
    labels the list is empty and the base alone decides; without rows there are none.
    """
    rules = train(docs, labels)
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = statistics(docs).withColumn("base_failed", base)
    return out.withColumn("kept", ~F.col("base_failed") & verdict(rules)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
