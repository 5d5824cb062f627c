"""Phrase collocations: every n-gram is a row, counted by language and scored by its weakest cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import written

#: The ends of pieces, the space between words.
PIECE_END, SPACE = r"[.,;:!?\x0A-\x0D]", r"[\x20\x09]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Language of documents without one.
UNKNOWN = "und"
#: Words of one row while n-grams are made: a piece of any length is cut into blocks that look ahead over their end.
BLOCK = 4096
#: Bits of the filter of frequent phrases: 262,144 rows of 64, the bound of what is broadcast.
FILTER_BITS = 1 << 24
#: Parts in which a language's phrases are ranked before the best of all parts are.
PARTS = 64
#: Counts stay under 10 ** 15, so that a million times a square fits Spark's 38 digits.
COUNT = "decimal(15,0)"


def blocks(docs: DataFrame, max_n: int) -> DataFrame:
    """The words of each piece as ``(lang, words)``, in blocks of ``BLOCK`` words and the ``max_n`` - 1 that follow."""
    pieces = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"),
        F.explode(F.split(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), PIECE_END)).alias("piece"),
    )
    words = pieces.select("lang", F.array_remove(F.split("piece", SPACE), "").alias("words")).where(F.size("words") > 0)
    cut = F.transform(F.sequence(F.lit(1), F.size("words"), F.lit(BLOCK)), lambda at: F.slice("words", at, BLOCK + max_n - 1))
    return words.select("lang", F.explode(F.when(F.size("words") <= BLOCK, F.array("words")).otherwise(cut)).alias("words"))


def joined(start: int, stop: int) -> Column:
    """Words ``start`` to ``stop`` of a place as a phrase."""
    return F.concat_ws(" ", *[f"at.w{k}" for k in range(start, stop + 1)])


def places(docs: DataFrame, max_n: int) -> DataFrame:
    """Each word's place as ``(lang, at)``, ``at`` holding the words ``w1`` to ``w<max_n>`` from there on, null beyond the piece's end."""
    columns = [F.slice("words", n, BLOCK).alias(f"w{n}") for n in range(1, max_n + 1)]
    return blocks(docs, max_n).select("lang", F.explode(F.arrays_zip(*columns)).alias("at")).where("at.w1 IS NOT NULL")


def ngrams(docs: DataFrame, max_n: int) -> DataFrame:
    """Every contiguous phrase of 1 to ``max_n`` words within a piece as a row ``(lang, phrase)``."""
    phrases = F.array(*[F.when(F.col(f"at.w{n}").isNotNull(), joined(1, n)) for n in range(1, max_n + 1)])
    return places(docs, max_n).select("lang", F.explode(phrases).alias("phrase")).where("phrase IS NOT NULL")


def place_in_filter(phrase: Column) -> Column:
    return F.pmod(F.xxhash64("lang", phrase), F.lit(FILTER_BITS))


def frequent(counted: DataFrame) -> DataFrame:
    """A bit for each phrase of ``counted``, 64 to a row ``(slot, bits)``: ``FILTER_BITS`` / 64 rows at most, whatever the corpus."""
    place = place_in_filter(F.col("phrase"))
    bits = counted.withColumn("place", place).select(F.shiftright("place", 6).alias("slot"), F.expr("shiftleft(1L, CAST(place & 63 AS int))").alias("bit"))
    return bits.groupBy("slot").agg(F.bit_or("bit").alias("bits"))


def hopeful(docs: DataFrame, n: int, filled: DataFrame) -> DataFrame:
    """Of the phrases of ``n`` words those whose first and last ``n`` - 1 words may both be frequent, as rows ``(lang, phrase)``: none that is frequent itself is lost."""
    out = places(docs, n).where(F.col(f"at.w{n}").isNotNull())
    for side, part in (("first", joined(1, n - 1)), ("last", joined(2, n))):
        held = F.broadcast(filled.select(F.col("slot").alias(f"{side}_slot"), F.col("bits").alias(f"{side}_bits")))  # bounded by FILTER_BITS
        out = out.withColumn(f"{side}_place", place_in_filter(part)).join(held, F.shiftright(f"{side}_place", 6) == F.col(f"{side}_slot"))
        out = out.where(F.expr(f"shiftright({side}_bits, CAST({side}_place & 63 AS int)) & 1L = 1L"))
    return out.select("lang", joined(1, n).alias("phrase"))


def counts(docs: DataFrame, max_n: int, least: int) -> DataFrame:
    """``(lang, phrase, words, f)`` of all words, and of all longer phrases found ``least`` times or more.

    Words and pairs are counted whole. A longer phrase that is frequent has frequent parts, so of the longer ones only those
    with parts in a filter of the shorter frequent ones are counted; where the filter errs, a phrase is counted in vain.
    """

    def counted(grams: DataFrame) -> DataFrame:
        # The phrase leads: should a task's table outgrow its memory, it is sorted by the leading bytes.
        found = grams.groupBy("phrase", "lang").agg(F.count("*").alias("f"))
        words = (F.length("phrase") - F.length(F.translate("phrase", " ", "")) + 1).alias("words")
        return written(found.select("lang", "phrase", words, "f").where((F.col("words") == 1) | (F.col("f") >= least)))

    out = counted(ngrams(docs, min(2, max_n)))
    for n in range(3, max_n + 1):
        out = out.unionByName(counted(hopeful(docs, n, frequent(out.where(F.col("words") == n - 1)))))
    return out


def scored(counted: DataFrame, least: int, share: int) -> DataFrame:
    """Candidates ``(lang, phrase, a, l, r, score)``: phrases of two words or more with a count of ``least`` or more that no longer candidate holds in ``share`` per cent of their places.

    Parts of a candidate are found as often as it at least, so all of them are in ``counted``. A longer phrase around a
    candidate has a one-word extension within it that is found as often at least, so extensions by one word decide.
    """
    held = counted.where((F.col("words") > 1) & (F.col("f") >= least)).withColumnRenamed("f", "a")
    words = F.split("phrase", " ")
    within = F.explode(F.array(F.array_join(F.slice(words, F.lit(1), F.col("words") - 1), " "), F.array_join(F.slice(words, F.lit(2), F.col("words") - 1), " ")))
    longer = held.where("words > 2").select("lang", within.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longest"))
    kept = held.join(longer.withColumnRenamed("longest", "e"), (held["lang"] == longer["lang"]) & (held["phrase"] == longer["phrase"]) & (100 * F.col("e") >= share * F.col("a")), "left_anti")
    cuts = kept.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice(words, F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice(words, F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("rest"))
    cuts = cuts.join(counted.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(counted.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    exact = {c: f"CAST({c} AS {COUNT})" for c in "alr"}
    score = F.expr(f"(CAST(1000000 AS decimal(7,0)) * ({exact['a']} * {exact['a']})) DIV ({exact['l']} * {exact['r']})")
    weakest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    return cuts.groupBy("lang", "phrase", "a").agg(weakest).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, max_n: int = 3, least: int = 10, share: int = 50, top: int = 2000) -> DataFrame:
    """Each language's ``top`` collocations: ``(lang, rank, phrase, a, l, r, n, score)``.

    Texts are lower-cased in A to Z and split into pieces and words; ``a``, ``l``, ``r`` are the counts of the phrase and of
    the two parts of its weakest cut, ``n`` the language's words, ``score`` floor(1000000 a a / (l r)), reckoned in Decimal
    (exact up to counts of 10 ** 15). Ranked by score, count (both falling) and phrase (UTF-8 byte order). A top-k report:
    ``top`` is its limit, nothing else is cut.

    All n-grams are exploded into rows, those of three words or more only where their parts may be frequent (``counts``).
    They are combined before they are shuffled, so a very frequent phrase or language is one row a task. Phrases of a
    language are ranked in parts first. Null texts and empty ones have no words; a null language is ``und``, together with
    documents that are marked so; texts of any length are cut into blocks; repeated rows count each time; an empty table
    gives no rows; other columns, whatever their names, are not read.
    """
    counted = counts(docs, max_n, least)
    ranked = scored(counted, least, share)
    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    best = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    total = counted.where("words = 1").groupBy("lang").agg(F.sum("f").alias("n"))
    return best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: DuckDB SQL of ``collocations`` with its defaults.
SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (
  SELECT lang, g.n AS words, unnest(list_transform(range(1, len(w) - g.n + 2), lambda i: array_to_string(w[i:i + g.n - 1], ' '))) AS phrase
  FROM words, (VALUES (1), (2), (3)) AS g(n)),
counted AS (SELECT lang, words, phrase, count(*) AS f FROM grams GROUP BY ALL),
total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counted WHERE words = 1 GROUP BY lang),
held AS (SELECT lang, words, phrase, string_split(phrase, ' ') AS w, f AS a FROM counted WHERE words > 1 AND f >= 10),
inner_phrases AS (
  SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM held WHERE words = 3
  UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM held WHERE words = 3),
kept AS (SELECT * FROM held h WHERE NOT EXISTS (SELECT 1 FROM inner_phrases i WHERE i.lang = h.lang AND i.phrase = h.phrase AND 100 * i.a >= 50 * h.a)),
cuts AS (
  SELECT h.lang, h.phrase, h.a, c.k, x.f AS l, y.f AS r,
    CAST((CAST(1000000 AS HUGEINT) * h.a * h.a) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM kept h JOIN (VALUES (1), (2)) AS c(k) ON c.k < h.words
  JOIN counted x ON x.lang = h.lang AND x.phrase = array_to_string(h.w[1:c.k], ' ')
  JOIN counted y ON y.lang = h.lang AND y.phrase = array_to_string(h.w[c.k + 1:], ' ')),
weakest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM weakest)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
