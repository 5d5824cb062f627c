"""Language identification: known words by their log frequency in each language, unseen words by character n-grams.

An unseen word is scored at each of its characters by the longest known n-gram from there on, shorter ones being tried only
where the longer are unknown. Words are runs of letters (every character beyond ASCII counts as one), in lower case.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textkernel import RollingHash, batch, chunks, map_batches, runs, utf8, word_hashes

#: Bounds of the model: training documents of a language, words and n-grams of each length kept for a language.
SAMPLE_DOCUMENTS, WORDS, GRAMS, LONGEST = 2000, 20_000, 10_000, 5
UNKNOWN = "und"

_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True
_BYTES = 1 << 19
_CELLS = 4_000_000  # rows times languages that are scored at once


def held_out(column: str = "doc_id", modulus: int = 5) -> F.Column:
    """Rows kept from learning: the id's text has a CRC-32 divisible by ``modulus`` (a null id counts as an empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus == 0


def _grams(buf: np.ndarray, start: np.ndarray, end: np.ndarray):
    """The words' bytes without what lies between, and for each character its word, and (n, first characters, hashes) of the n-grams, longest first."""
    size = end - start
    off = np.concatenate([[0], np.cumsum(size)])
    part = buf[np.arange(off[-1]) + np.repeat(start - off[:-1], size)]
    chars = np.flatnonzero((part & 0xC0) != 0x80)
    word = np.searchsorted(off, chars, side="right") - 1
    h = RollingHash(part)
    ends = np.append(chars, len(part))

    def of():
        for n in range(LONGEST, 0, -1):
            at = np.flatnonzero(word[: len(word) - n + 1] == word[n - 1 :])
            yield n, at, h(chars[at], ends[at + n])

    return word, of()


def _count(sample: DataFrame, languages: list[str]) -> DataFrame:
    """(lang, kind, h, n) of the words (kind 0) and n-grams (kind n) of sample(lang, text), summed within batches."""
    schema = pa.schema([("lang", pa.int32()), ("kind", pa.int32()), ("h", pa.int64()), ("n", pa.int64())])
    index = {x: k for k, x in enumerate(languages)}

    def run(b):
        lang = np.array([index[x] for x in b.column(0).to_pylist()], np.int32)
        buf, off = utf8(pc.utf8_lower(b.column(1)))
        for i, j in chunks(off, _BYTES):
            part = buf[off[i] : off[j]]
            start, end, row = runs(_LETTER[part], off[i : j + 1] - off[i])
            if not len(start):
                continue
            h, of = RollingHash(part)(start, end), lang[i:j][row]
            order = np.lexsort((h, of))
            h, of, start, end = h[order], of[order], start[order], end[order]
            first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])]))
            count = np.diff(np.append(first, len(h)))
            out = [(of[first], np.zeros(len(first), np.int32), h[first], count)]
            word, grams = _grams(part, start[first], end[first])
            for n, at, g in grams:
                out.append((of[first][word[at]], np.full(len(at), n, np.int32), g, count[word[at]]))
            l, k, g, c = (np.concatenate(x) for x in zip(*out, strict=True))
            order = np.lexsort((g, k, l))
            l, k, g, c = l[order], k[order], g[order], c[order]
            first = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (k[1:] != k[:-1]) | (l[1:] != l[:-1])]))
            yield batch({"lang": l[first], "kind": k[first], "h": g[first].view(np.int64), "n": np.add.reduceat(c, first)}, schema)

    return map_batches(sample, run, "lang int, kind int, h long, n long")


def train(docs: DataFrame) -> dict:
    """The model, from docs(doc_id, text, lang) that are not held out; its size is bounded for each language, whatever the corpus.

    At most some SAMPLE_DOCUMENTS documents a language are taken, by a hash of the id; all languages are learnt. Without any
    labelled text the model knows no language and predicts "und". A table of the model has, for each of its sorted keys, the
    languages that have it and by how much its log frequency there exceeds that of a key that the language lacks.
    """
    usable = docs.where(~held_out()).where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang", "text")
    sizes = usable.groupBy("lang").count().collect()  # one row a language
    languages = sorted(r["lang"] for r in sizes)
    model: dict = {"languages": languages, "tables": {}}
    if not languages:
        return model
    share = F.create_map(*(F.lit(x) for r in sizes for x in (r["lang"], min(1.0, SAMPLE_DOCUMENTS / r["count"]))))
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000
    counts = _count(usable.where(drawn).select("lang", "text"), languages)
    counts = counts.groupBy("lang", "kind", "h").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "h"))
    kept = counts.withColumn("rank", rank).where(F.col("rank") <= F.when(F.col("kind") == 0, WORDS).otherwise(GRAMS)).drop("rank").toPandas()
    for kind, t in kept.groupby("kind"):
        h, lang, n = t["h"].to_numpy().view(np.uint64), t["lang"].to_numpy(), t["n"].to_numpy().astype(np.float64)
        order = np.lexsort((lang, h))
        h, lang, n = h[order], lang[order], n[order]
        keys, begin = np.unique(h, return_index=True)
        total = np.bincount(lang, weights=n, minlength=len(languages))
        absent = np.log(0.5) - np.log(total + 0.5 * len(keys))
        model["tables"][int(kind)] = keys, np.append(begin, len(h)), lang, (np.log(n + 0.5) - np.log(0.5)).astype(np.float32), absent
    return model


class _Sums:
    """Weighted log frequencies of keys, by row and language."""

    def __init__(self, rows: int, languages: int):
        self.total = np.zeros(rows * languages)
        self.rows, self.languages = rows, languages

    def add(self, table: tuple, key: np.ndarray, row: np.ndarray, weight: np.ndarray) -> None:
        _, begin, lang, more, absent = table
        count = begin[key + 1] - begin[key]
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin[key], count)
        cell = np.repeat(row, count) * self.languages + lang[at]
        self.total += np.bincount(cell, weights=np.repeat(weight, count) * more[at], minlength=len(self.total))
        self.total += np.outer(np.bincount(row, weights=weight, minlength=self.rows), absent).ravel()


def _look_up(table: tuple, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table[0], h), len(table[0]) - 1)
    return at, table[0][at] == h


def scores(model: dict, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean log likelihood of the words of each row in each language, and the number of words."""
    tables, m, n = model["tables"], len(model["languages"]), len(off) - 1
    sums = _Sums(n, m)
    start, end, row = runs(_LETTER[buf], off)
    if not len(start):
        return sums.total.reshape(n, m), np.zeros(n, np.int64)
    at, known = _look_up(tables[0], word_hashes(buf, start, end))
    sums.add(tables[0], at[known], row[known], np.ones(int(known.sum())))
    unseen = np.flatnonzero(~known)
    if len(unseen):
        word, grams = _grams(buf, start[unseen], end[unseen])
        owner, share = row[unseen][word], (1 / np.bincount(word, minlength=len(unseen)))[word]
        open_ = np.ones(len(word), bool)
        for k, begin, g in grams:
            if k not in tables:
                continue
            todo = open_[begin]
            begin, g = begin[todo], g[todo]
            at, found = _look_up(tables[k], g)
            begin = begin[found]
            sums.add(tables[k], at[found], owner[begin], share[begin])
            open_[begin] = False
    count = np.bincount(row, minlength=n)
    return sums.total.reshape(n, m) / np.maximum(count, 1)[:, None], count


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """All rows and columns of docs(text, ...) plus lang_pred and score (0 to 1), replacing columns of these names.

    Null texts and texts without a letter are "und" with score 0. The score is the posterior of the best language with
    the evidence of at most ten average words; ties go to the language that sorts first.
    """
    docs = docs.drop("lang_pred", "score")
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(b):
        model = shared.value
        text = b.column(names.index("text")).cast(pa.large_string())
        has = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        buf, off = utf8(pc.utf8_lower(text))
        lang, score = np.full(b.num_rows, UNKNOWN, object), np.zeros(b.num_rows)
        most = max(1, _CELLS // max(1, len(model["languages"])))
        passes = ((x, min(x + most, j)) for i, j in chunks(off, _BYTES) for x in range(i, j, most)) if model["languages"] else ()
        for i, j in passes:
            mean, count = scores(model, buf[off[i] : off[j]], off[i : j + 1] - off[i])
            best = mean.argmax(axis=1)
            odds = np.exp((mean - mean.max(axis=1)[:, None]) * np.minimum(count, 10)[:, None])
            ok = has[i:j] & (count > 0)
            lang[i:j][ok] = np.array(model["languages"], object)[best[ok]]
            score[i:j][ok] = (1 / odds.sum(axis=1))[ok]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "score"])

    return map_batches(docs, run, f"{kinds}, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row of docs(doc_id, text, lang, ...), with a model learnt from those not held out.

    Null texts and texts without a letter are "und" with score 0, as are all if there is nothing to learn from; rows with a
    null lang are only predicted; repeated rows are predicted each, and learnt from each; null ids count as held out; ties go to the language that sorts first. Very long texts are read whole;
    without rows there are none.
    """
    model = train(docs)
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
