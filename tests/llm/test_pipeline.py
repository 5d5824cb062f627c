import re

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .conftest import SCHEMA, hard_rows
from .test_jaccard_join import brute_force
from .test_suffix_dedup import removed_by_brute_force


def test_stages(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    seen = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], small).write.parquet(f"{tmp_path}/{k}")
        seen.append(spark.read.parquet(f"{tmp_path}/{k}"))
        if k < 4:
            assert seen[-1].columns == docs.columns and seen[-1].dtypes == docs.dtypes
    rows = [[(r["doc_id"], r["text"]) for r in d.select("doc_id", "text").collect()] for d in seen[:5]]
    assert sorted(i for i, _ in rows[1]) == sorted(i for i, t in rows[0] if t is not None and any(c.isalpha() for c in t))
    assert sorted(i for i, _ in rows[2]) == sorted({c for _, _, c, _, _ in brute_force(rows[1])})
    before, after = dict(rows[2]), dict(rows[3])
    assert all(len(t) <= len(before[i]) for i, t in after.items())
    rest = removed_by_brute_force(sorted((i, t) for i, t in before.items()), 51)
    assert {i: t for (i, _), t in zip(sorted(before.items()), rest, strict=True) if t.split() or not before[i]} == after
    words = lambda rs: sum(len(re.findall(r"[^\x20\x09-\x0D]+", t)) for _, t in rs)
    assert abs(words(rows[4]) / words(rows[3]) - 1.5) < 0.1
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    want = sorted((i, len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in rows[4])
    assert sorted((r["doc_id"], r["n_tokens"]) for r in seen[5].collect()) == want


def test_run_on_hard_rows(spark, tmp_path):
    spark.createDataFrame(hard_rows(), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


CLASHES = ["score", "lang_pred", "held_out", "kept", "n_bytes", "n_removed", "spans", "n_spans", "size", "source_size", "target", "slope", "start", "goal", "copy", "position", "taken", "before", "th", "class_id", "n_links", "unit", "key", "n_tokens"]


def test_stages_carry_clashing_columns_unchanged(spark, tmp_path):
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(hard_rows())], f"{SCHEMA}, mark long")
    docs = docs.drop("size").withColumns({c: F.concat(F.lit(f"{c}-"), F.col("mark")) for c in CLASHES})
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        assert out.dtypes == docs.dtypes and out.count() > 0
        for c in CLASHES:
            assert out.where(~F.col(c).eqNullSafe(F.concat(F.lit(f"{c}-"), F.col("mark")))).count() == 0, (k, c)
        was = {r["mark"]: (r["doc_id"], r["lang"], r["source"], r["h"]) for r in docs.collect()}
        assert all(was[r["mark"]] == (r["doc_id"], r["lang"], r["source"], r["h"]) for r in out.collect())
        docs = out
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "n-gram Jaccard join", "suffix-array dedup", "mixing sources", "BPE encoding"]


def test_planted_passages_of_over_50_words(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(2)
    passage = " ".join("abcdefghijklmnop"[k % 16] + "qrst"[k % 4] * (k % 3) + str(k) for k in range(55))
    texts = [f"first {passage} end", f"another {passage} close", f"third {' '.join(passage.split()[:50])} stays"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    rows = rows.select(*(F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema))
    got = {r["doc_id"]: r["text"] for r in dict(corpus_pipeline.STAGES)["suffix-array dedup"](spark, rows, small).collect()}
    assert len(passage) < 400 and got == {0: texts[0], 1: "another  close", 2: texts[2]}
