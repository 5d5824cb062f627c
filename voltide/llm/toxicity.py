"""Toxicity from confirmed toxic and unlabelled texts: a linear classifier under the non-negative positive-unlabelled risk.

The risk is prior * loss(positives as positive) + max(0, loss(unlabelled as negative) - prior * loss(positives as negative)); where the
bracket turns negative, its gradient is followed back up. Features are words (runs of letters in lower case), counted
up to two.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import written
from .language_id import _LETTER
from .textkernel import RollingHash, chunks, map_batches, runs, utf8

#: Bounds of the training sample and the model: positives, unlabelled texts, words.
POSITIVES, UNLABELLED, FEATURES = 4000, 12_000, 4096
ROUNDS, RATE, DECAY, THRESHOLD = 600, 0.1, 1e-4, 0.7


def held_out() -> F.Column:
    """The id's text has a CRC-32 that leaves 1 when divided by 3 (a null id counts as an empty text)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _word_hashes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start, end, row = runs(_LETTER[buf], off)
    return (RollingHash(buf)(start, end), row) if len(start) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _bags(sample: DataFrame) -> DataFrame:
    """(positive, words, twice, own): the different word hashes of each text of sample(positive, text, own), and those that occur again."""

    def run(b):
        buf, off = utf8(pc.utf8_lower(b.column(1)))
        words, twice = [], []
        for i, j in chunks(off):
            h, row = _word_hashes(buf[off[i] : off[j]], off[i : j + 1] - off[i])
            for x in np.split(h, np.searchsorted(row, np.arange(1, j - i))):
                w, n = np.unique(x, return_counts=True)
                words.append(w.view(np.int64))
                twice.append(w[n > 1].view(np.int64))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.list_(pa.int64())), pa.array(twice, pa.list_(pa.int64())), b.column(2)], ["positive", "words", "twice", "own"])

    return map_batches(sample, run, "positive boolean, words array<long>, twice array<long>, own long")


def telling(bags: DataFrame, p: int, u: int) -> np.ndarray:
    """The hashes, sorted, of at most FEATURES words that are in far more of the p positive than of the u unlabelled texts.

    Counts, and the z score of the difference, are taken in Spark; only the words that lead come to the driver.
    """
    seen = bags.select("positive", F.explode("words").alias("w")).groupBy("w").agg(F.sum(F.col("positive").cast("double")).alias("a"), F.count("*").alias("n"))
    rate = F.col("n") / (p + u)
    gap = F.col("a") / p - (F.col("n") - F.col("a")) / u
    z = gap / F.sqrt(F.greatest(rate * (1 - rate), F.lit(1e-12)) * (1 / p + 1 / u))
    top = seen.select("w", "a", z.alias("z")).where("a >= 3 AND z > 4").orderBy(F.desc("z"), "w").limit(FEATURES).toPandas()
    # Words of a few copied texts stand out too, but far less than words that toxic texts share.
    top = top[top["z"] > 0.15 * top["z"].max()]
    return np.sort(top["w"].to_numpy(np.int64).view(np.uint64))


def _places(bags: DataFrame, words: np.ndarray) -> DataFrame:
    """(positive, at): for each text the places in ``words`` of those it has, twice for those that occur again."""

    def run(b):
        at = []
        for one, more in zip(b.column(1), b.column(2), strict=True):
            h = np.concatenate([np.asarray(x.values).view(np.uint64) for x in (one, more)])
            found = np.minimum(np.searchsorted(words, h), len(words) - 1)
            at.append(np.sort(found[words[found] == h]).astype(np.int32))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at, pa.list_(pa.int32()))], ["positive", "at"])

    return map_batches(bags, run, "positive boolean, at array<int>")


def fit(bags: list[np.ndarray], positive: np.ndarray, prior: float, features: int) -> tuple[np.ndarray, float]:
    """Weights and bias that lower the risk on texts given as the places of their words."""
    bag = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    word = np.concatenate([*bags, np.zeros(0, np.int32)]).astype(np.int64)
    p, u = int(positive.sum()), int((~positive).sum())
    w = np.zeros(features + 1)
    m, v = np.zeros(len(w)), np.zeros(len(w))
    w[-1] = np.log(prior / (1 - prior))
    for step in range(1, ROUNDS + 1):
        f = np.bincount(bag, weights=w[word], minlength=len(bags)) + w[-1]
        s = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
        slope = s * (1 - s)  # of the sigmoid loss: sigma(-f) for a positive, sigma(f) for a negative
        rest = s[~positive].mean() - prior * s[positive].mean()
        back = np.where(positive, -prior / p, 1 / u) * slope
        g = -back if rest < 0 else np.where(positive, -prior / p, 0.0) * slope + back
        grad = np.append(np.bincount(word, weights=g[bag], minlength=features), g.sum()) + DECAY * np.append(w[:-1], 0) / len(bags)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-10)
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame) -> dict:
    """A model from docs(doc_id, text) and labels(doc_id, toxic) that are not held out.

    Positives are rows labelled 1, the unlabelled are drawn from all texts. Rows are drawn by a hash of id and text to about
    POSITIVES and UNLABELLED; rows equal in both count once, and a quarter more is the most that is kept, by the least hashes,
    so an id that is repeated any number of times brings no more. The prior is the share of 1 among the labels (0.1 without any). Without positives every score is low.
    """
    known = labels.where(~held_out() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, p = known.agg(F.count("*"), F.sum((F.col("toxic") == 1).cast("long"))).first()
    prior = min(0.9, max(1e-3, p / n)) if n and p else 0.1
    rows = docs.where(~held_out()).select("doc_id", "text")
    own = lambda *c: F.xxhash64(*c)
    draw = lambda df, share, h: df.where(F.pmod(h, F.lit(1_000_000)) < min(1.0, share) * 1_000_000)
    # Ids are drawn before the texts are read, so that about POSITIVES of them (a bound of the draw) are broadcast and no text is shuffled.
    ids = draw(known.where("toxic = 1").select("doc_id"), POSITIVES / max(1, p or 0), own("doc_id", F.lit(1)))
    positive = rows.join(F.broadcast(written(ids)), "doc_id", "left_semi")
    positive = draw(positive, 1.1 * POSITIVES / max(1, positive.count()), own("doc_id", "text", F.lit(3)))
    unlabelled = draw(rows, UNLABELLED / max(1, rows.count()), own("doc_id", "text", F.lit(2)))
    sample = [df.select(F.lit(is_positive).alias("positive"), "text", own("doc_id", "text").alias("own")) for df, is_positive in ((positive, True), (unlabelled, False))]
    found = written(_bags(sample[0].unionByName(sample[1]))).dropDuplicates(["positive", "own"])
    kept = [found.where(side).orderBy("own").limit(most * 5 // 4) for side, most in (("positive", POSITIVES), ("NOT positive", UNLABELLED))]
    bags = written(kept[0].unionByName(kept[1]).drop("own"))
    counts = dict(bags.groupBy("positive").count().collect())
    model = {"words": np.zeros(0, np.uint64), "weights": np.zeros(0), "bias": -5.0}
    if len(counts) < 2:
        return model
    words = telling(bags, counts[True], counts[False])
    if not len(words):
        return model
    t = _places(bags, words).toArrow()
    labels_, at = t.column(0).to_numpy(zero_copy_only=False), [np.asarray(x.values) for x in t.column(1)]
    order = sorted(range(len(at)), key=lambda k: (not labels_[k], at[k].tobytes()))  # sums don't hang on the order of rows
    weights, bias = fit([at[k] for k in order], labels_[order].astype(bool), prior, len(words))
    return {"words": words, "weights": weights, "bias": bias}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out and score (0 to 1) of each row of docs(doc_id, text); null texts are empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(b):
        model = shared.value
        buf, off = utf8(pc.utf8_lower(b.column(2)))
        f = np.full(b.num_rows, model["bias"])
        for i, j in chunks(off) if len(model["words"]) else []:
            h, row = _word_hashes(buf[off[i] : off[j]], off[i : j + 1] - off[i])
            at = np.minimum(np.searchsorted(model["words"], h), len(model["words"]) - 1)
            hit = model["words"][at] == h
            pairs, n = np.unique(row[hit] * len(model["words"]) + at[hit], return_counts=True)
            np.add.at(f, i + pairs // len(model["words"]), model["weights"][pairs % len(model["words"])] * np.minimum(n, 2))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(1 / (1 + np.exp(-np.clip(f, -30, 30))), pa.float64())], ["doc_id", "held_out", "score"])

    return map_batches(docs.select("doc_id", held_out().alias("held_out"), "text"), run, f"doc_id {kind}, held_out boolean, score double")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of docs(doc_id, text, ...), learnt from labels(doc_id, toxic, ...).

    Null and empty texts score as the model's bias; a null id is not held out and has no label; repeated rows are scored
    each; of several labels of an id the greatest counts; other columns are left out. Very long texts are read whole. Without
    rows there are none; without labels every score is that of an empty model.
    """
    return score(docs, train(docs, labels)).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
