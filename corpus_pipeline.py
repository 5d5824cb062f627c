"""A corpus from raw documents to token ids: five stages, each applying one operator to all that the one before kept."""

from __future__ import annotations

import functools
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltide.llm import bpe, graph, jaccard_join, language_id, mixing, suffix_dedup
from voltide.session import ship_package


#: Columns that stages read or rewrite; all others are carried along.
READ = ("doc_id", "text", "lang", "source", "n_chars")


def _on_workers(stage):
    """The stage, with this package sent to the workers and Arrow batches held small first.

    Columns that stages don't read go through under names of their own, so that none that is named like what an operator
    adds (``score``, ``kept``, ``size``, ``position`` and so on) is overwritten.
    """

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        carried = {c: f"__carried_{k}" for k, c in enumerate(docs.columns) if c not in READ}
        out = stage(ship_package(spark), docs.withColumnsRenamed(carried), sf_dir)
        return out.withColumnsRenamed({private: c for c, private in carried.items()})

    return run


@_on_workers
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told (null text or no letter) go; all others stay as they are, repeated rows, long texts and rows with a null id, lang or source too. An empty table stays empty."""
    return language_id.predict(docs, language_id.train(docs)).where(F.col("lang_pred") != language_id.UNKNOWN).select(*docs.columns)


@_on_workers
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, that with the least id (null before all; of rows with this id and text one).

    Texts under five words, null and empty ones are like equal texts only (null as empty); texts of any length are compared
    whole; ties cannot matter, as links make classes whatever their order. An empty table stays empty.
    """
    return jaccard_join.one_of_each_class(docs, width=5, threshold=0.8)


@_on_workers
def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of passages of over 50 words are cut out of the texts; documents of which no word is left go.

    The first place, by id (null first), hash of the text and offset, stays; rows equal in id and text keep what the first of
    them keeps. Null, empty and shorter texts stay as they are; texts of any length are read whole. An empty table stays empty.
    """
    out = suffix_dedup.remove_repeats(docs, length=51, keep="first", as_text=True, unit="words")
    out = out.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.where((F.col("n_removed") == 0) | F.col("text").rlike(mixing.WORD)).select(*docs.columns)


@_on_workers
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks, in training order; null texts and empty ones have no words and are not taken, repeated rows are rows of their own, long texts are taken whole or not at all, a null source is a source; an empty table stays empty."""
    return mixing.mix(docs).select(*docs.columns)


@_on_workers
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, as digests: one row for each row, repeated ones too, whatever its length; null texts are empty; other columns are left out. An empty table gives none."""
    return bpe.digest(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language ID", language), ("n-gram Jaccard join", near_duplicates), ("suffix-array dedup", repeats), ("mixing sources", mixed), ("BPE encoding", tokens)]

#: SQL can express neither the language model nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{graph.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
