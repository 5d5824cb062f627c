import zlib

from voltide.llm import language_id
from voltide.llm.queries import op9_language_id, table


def test_held_out_accuracy(spark, medium):
    texts = {r["doc_id"]: (r["text"], r["lang"]) for r in table(spark, medium, "documents").collect()}
    got = {r["doc_id"]: r for r in op9_language_id(spark, medium).collect()}
    assert got.keys() == texts.keys()
    right = total = 0
    for i, (text, lang) in texts.items():
        r = got[i]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (text is None or not any(c.isalpha() for c in text))
        if r["held_out"] and lang is not None and r["lang_pred"] != "und":
            total += 1
            right += r["lang_pred"] == lang
    assert right / total > 0.97


def test_hard_rows(docs, rows, none):
    out = language_id.identify(docs)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["lang_pred"] == "und") for r in out.collect())
    assert got == sorted((i is None, i or 0, t is None or not any(c.isalpha() for c in t)) for i, t, *_ in rows)
    assert language_id.identify(none).count() == 0
    assert language_id.predict(docs, language_id.train(docs.where("false"))).where("lang_pred != 'und'").count() == 0
    kept = language_id.predict(docs, language_id.train(docs))
    assert kept.columns == [*docs.columns, "lang_pred", "score"]


def test_unseen_words_go_by_their_parts(spark):
    train = spark.createDataFrame([(k, a, t) for k, (a, t) in enumerate([("x", "straßenbahn schönheit freiheit"), ("y", "nation station action")] * 20)], "doc_id long, lang string, text string")
    model = language_id.train(train)
    ask = spark.createDataFrame([(1, "einheit"), (2, "ration")], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in language_id.predict(ask, model).collect()} == {1: "x", 2: "y"}


def test_many_languages(spark):
    """Every language of the labels is learnt, however many there are."""
    names = [f"l{k:03}" for k in range(260)]
    text = lambda k: " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}q{x}" for x in ("ra", "lo", "mi"))
    rows = [(k + 260 * j, x, text(k)) for j in range(3) for k, x in enumerate(names)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    learnt = {x for i, x, _ in rows if zlib.crc32(str(i).encode()) % 5}
    assert model["languages"] == sorted(learnt) and len(learnt) > 250
    got = language_id.predict(spark.createDataFrame([(x, text(k)) for k, x in enumerate(names) if x in learnt], "lang string, text string"), model).collect()
    assert all(r["lang_pred"] == r["lang"] for r in got)
