"""Document fingerprints by consistent weighted sampling, and how near a document stays to itself when its end is replaced."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import written

#: Samples of a fingerprint (four to a hash), each of 4 hexadecimal digits. A likeness s is measured to within sqrt(s (1 - s) / SAMPLES).
SAMPLES = 64
#: Words, those of over 24 characters cut into parts: texts without spaces have many terms too. A term is two words on end, its weight how often it occurs.
WORD = re.compile(r"[^\x20\x09-\x0D]{1,24}")
#: Terms sampled at a time.
CHUNK = 512
#: Words whose hashes a task keeps.
REMEMBERED = 1 << 18

_GOLDEN = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (multiplications and shifts, wrapping)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _upper(rank: np.ndarray) -> np.ndarray:
    """Ranks as the upper half of a key: above zero, numbers compare like their bits."""
    return (rank + 128).astype(np.float32).view(np.int32).astype(np.int64) << 32


def _uniform(k: int) -> np.ndarray:
    """Uniform numbers between 0 and 1, one for each draw."""
    return ((_mixed(np.arange(1, DRAWS + 1, dtype=np.uint64) + np.uint64(k * _GOLDEN % 2**64)) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


#: What a hash of 16 bits draws: r and c from Gamma(2, 1), b uniform; and the upper half of the key of a weight of 1.
DRAWS = 1 << 16
R, LOG_C, B = -np.log(_uniform(1) * _uniform(2)), np.log(-np.log(_uniform(3) * _uniform(4))), _uniform(5)
LIGHT = _upper(LOG_C + R * (B - 1))


class _Hashes(dict):
    """Words to their hashes, filled as they are met."""

    def __missing__(self, word: str) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


class Sampler:
    """Consistent weighted samples of sets of weighted terms."""

    def __init__(self, samples: int = SAMPLES):
        self.seeds = _mixed(np.arange(1, samples // 4 + 1, dtype=np.uint64) * np.uint64(_GOLDEN))[:, None]
        self.hashes = _Hashes()

    def words(self, text: str) -> np.ndarray:
        """Hashes of the words of a text, in order."""
        if len(self.hashes) > REMEMBERED:
            self.hashes.clear()
        words = WORD.findall(text)
        return np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))

    def terms(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the terms, rising, and their weights. A single word is a term; a text without words has none."""
        h = _mixed(words[:-1] * np.uint64(_GOLDEN) + words[1:]) if len(words) > 1 else words
        return np.unique(h, return_counts=True)

    def least(self, h: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """For each sample the least of the terms' keys: the rank of a term in the upper half, the name of what was sampled in the lower.

        A hash of term and sample draws (r, c, b): r and c from Gamma(2, 1), b uniform. A weight w falls on step
        t = floor(log w / r + b) of the term, and log a = log c - r (t - b) - r ranks it. The least a is the sample, and
        (term, t) its name: two sets of weights draw the same one with the chance sum of minima over sum of maxima.
        """
        best = np.full((len(self.seeds), 4), np.iinfo(np.int64).max)
        for at in range(0, len(h), CHUNK):
            x, w = h[at : at + CHUNK], weight[at : at + CHUNK]
            draw = _mixed(x ^ self.seeds).view(np.uint16).reshape(len(self.seeds), len(x), 4)  # four draws of one hash
            key = LIGHT.take(draw) | (x & np.uint64(0xFFFFFFFF)).astype(np.int64)[:, None]
            heavy = np.flatnonzero(w > 1)  # at weight 1 the step is 0
            if len(heavy):
                drawn = draw[:, heavy]
                r, b = R.take(drawn), B.take(drawn)
                step = np.floor(np.log(w[heavy])[:, None] / r + b)
                name = _mixed(x[heavy][:, None] + step.astype(np.int64).astype(np.uint64) * np.uint64(_GOLDEN)) & np.uint64(0xFFFFFFFF)
                name = np.where(step == 0, (x[heavy] & np.uint64(0xFFFFFFFF))[:, None], name)
                key[:, heavy] = _upper(LOG_C.take(drawn) + r * (b - 1 - step)) | name.astype(np.int64)
            best = np.minimum(best, key.min(1))
        return best.ravel()

    def signature(self, *least: np.ndarray) -> np.ndarray:
        """The samples' names, 16 bits of each, from the least keys of the parts of a text."""
        return (np.minimum.reduce(least) & 0xFFFF).astype(np.uint16)

    def pair(self, text: str, other: str, alike: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Signatures of two texts whose first ``alike`` characters are the same; those are read once, and what both hold with one weight is sampled once."""
        alike = max((text.rfind(c, 0, alike) for c in " \n"), default=-1) + 1  # whole words only
        start = self.words(text[:alike])
        (h, w), (g, v) = (self.terms(np.concatenate([start, self.words(x[alike:])])) for x in (text, other))
        at = np.minimum(np.searchsorted(g, h), max(len(g) - 1, 0))
        both = (g[at] == h) & (v[at] == w) if len(g) else np.zeros(len(h), bool)
        rest = np.ones(len(g), bool)
        rest[at[both]] = False
        shared = self.least(h[both], w[both])
        return self.signature(self.least(h[~both], w[~both]), shared), self.signature(self.least(g[rest], v[rest]), shared)


def written_out(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter of code points replaced by as many of ``following``, or all."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def compared(sampler: Sampler, text: str, following: str) -> tuple[str, str, str, float]:
    """Digest of the edited text, both fingerprints and their likeness."""
    other = edited(text, following)
    own, changed = sampler.pair(text, other, len(text) - len(text) // 4)
    return hashlib.sha256(other.encode()).hexdigest(), written_out(own), written_out(changed), float((own == changed).mean())


def likeness(a: str, b: str) -> float:
    """The share of equal samples of two fingerprints."""
    same = [a[k : k + 4] == b[k : k + 4] for k in range(0, len(a), 4)]
    return sum(same) / len(same)


_ROW = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: Besides the rows: the first and the last text of each task, the last one without what follows it.
_TASK = f"{_ROW}, task long, first boolean, last boolean, text string"


def _stream(samples: int):
    names = [f.split()[0] for f in f"doc_id x, {_TASK}".split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, task, held, begun = Sampler(samples), TaskContext.get().partitionId(), None, False
        schema = None
        for batch in batches:
            schema = schema or _schema(batch.schema.field("doc_id").type)
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                text = text or ""
                if held is None:
                    out.append(dict.fromkeys(names) | {"doc_id": doc_id, "task": task, "first": True, "text": text, "fingerprint": written_out(sampler.pair(text, text)[0])})
                else:
                    row = _completed(sampler, *held, text)
                    if begun:  # likeness to the next one waits for its fingerprint
                        before["near_next"] = likeness(before["fingerprint"], row["fingerprint"])
                        out.append(dict.fromkeys(names) | before)
                    before, begun = row, True
                held = (doc_id, text)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        if held is not None:
            out = [dict.fromkeys(names) | {"doc_id": held[0], "task": task, "last": True, "text": held[1], "fingerprint": written_out(sampler.pair(held[1], held[1])[0])}]
            if begun:
                before["near_next"] = likeness(before["fingerprint"], out[0]["fingerprint"])
                out.append(dict.fromkeys(names) | before)
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def _completed(sampler: Sampler, doc_id, text: str, following: str) -> dict:
    sha, own, changed, near = compared(sampler, text, following)
    return {"doc_id": doc_id, "n_chars": len(text), "edited_sha256": sha, "fingerprint": own, "edited_fingerprint": changed, "near_edited": near}


def _schema(doc_id: pa.DataType, rows_only: bool = False) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [f.split() for f in (_ROW if rows_only else _TASK).split(", ")]
    return pa.schema([("doc_id", doc_id), *[(name, kinds[kind]) for name, kind in fields]])


def _resolve(samples: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(samples)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                out.append(_completed(sampler, row["doc_id"], row["text"], row["next_text"]) | {"near_next": likeness(row["fingerprint"], row["next_fingerprint"])})
            yield pa.RecordBatch.from_pylist(out, schema=_schema(batch.schema.field("doc_id").type, rows_only=True))

    return run


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)``, a row for each row of ``docs``.

    Documents follow one another by ``doc_id`` (nulls first), rows of one id by the MD5 of their texts; the first follows the
    last. Equal texts have equal fingerprints; a null text is empty; texts without words have the fingerprint of no terms and
    are wholly like each other. Texts of any length are one row of one task. An empty table gives no rows; other columns,
    whatever their names, are not read.

    Texts are shuffled once, by ranges of ids (equal rows are spread by their place in the scan, which must come from files or
    another source that rereads alike), and stream by in order. Only the first and last text of each task are joined with
    another task's.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    keys = ["doc_id", "digest", "place"]
    rows = docs.select("doc_id", "text").select("doc_id", "text", F.md5(F.coalesce("text", F.lit(""))).alias("digest"), F.monotonically_increasing_id().alias("place"))
    streamed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text").mapInArrow(_stream(samples), f"doc_id {kind}, {_TASK}")
    found = written(streamed)
    firsts, lasts = found.where("first").select("task", "text", "fingerprint"), found.where("last").select("doc_id", "task", "text", "fingerprint")
    # A row for each task of the sort: numbers only.
    order = Window.orderBy("task")
    ring = firsts.select("task", F.coalesce(F.lead("task").over(order), F.min("task").over(Window.partitionBy(F.lit(0)))).alias("next"))
    ends = lasts.join(ring, "task").join(firsts.select(F.col("task").alias("next"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint")), "next")
    columns = ["doc_id", *[f.split()[0] for f in _ROW.split(", ")]]
    return found.where("first IS NULL AND last IS NULL").select(*columns).unionByName(ends.select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint").mapInArrow(_resolve(samples), f"doc_id {kind}, {_ROW}"))
