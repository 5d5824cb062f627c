"""Contiguous shards of near equal bytes from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import checkpointed

#: Bytes that a document counts for besides its text, and the share of a shard up to which equal texts stay together.
OVERHEAD, TOGETHER = 8, 0.01


def shard_by_bytes(docs: DataFrame, shards: int, overhead: int = OVERHEAD) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each row of docs(doc_id, text).

    Rows are range-sorted by (text hash, doc_id), so equal texts are neighbours and a large group of them still spreads over
    partitions. The sorted, narrow rows are checkpointed; each partition's bytes and rows are summed, the sums are
    accumulated over partitions (one row each), and a row's place in bytes picks its shard: cuts lie at equal targets, a
    small group of equal texts going by its middle (also one that goes over the end of a partition). ``slot`` counts a shard's rows from 0. Null texts have ``overhead`` bytes
    and the checksum of an empty text; null ids sort first; repeated rows take successive slots; no rows give no shards.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    narrow = docs.select("doc_id", (F.length(raw) + overhead).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.xxhash64(raw).alias("h"))
    parts = checkpointed(narrow.repartitionByRange("h", "doc_id").withColumn("part", F.spark_partition_id()))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.min("h").alias("lo"), F.max("h").alias("hi"))
    totals = totals.select("part", "bytes", "lo", "hi", F.coalesce(F.sum("bytes").over(ahead), F.lit(0)).alias("b0"), F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("r0"), F.sum("bytes").over(Window.partitionBy()).alias("total"))
    order = Window.partitionBy("part").orderBy("h", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, 0)
    group = Window.partitionBy("part", "h")
    # Groups that go over the end of a partition are its first or last: at most two for each partition.
    over = totals.select(F.explode(F.array_distinct(F.array("lo", "hi"))).alias("h")).groupBy("h").count().where("count > 1").select("h")
    over = parts.join(F.broadcast(over), "h").groupBy("h", "part").agg(F.sum("size").alias("n")).join(F.broadcast(totals), "part")
    over = over.groupBy("h").agg(F.min(F.struct("part", (F.col("b0") + F.col("bytes") - F.col("n")).alias("at")))["at"].alias("o0"), F.sum("n").alias("on"))
    placed = parts.join(F.broadcast(totals.drop("bytes", "lo", "hi")), "part").withColumns({  # one short row for each partition
        "start": F.col("b0") + F.sum("size").over(order) - F.col("size"),
        "row": F.col("r0") + F.count("*").over(order) - 1,
    })
    placed = placed.withColumns({"g0": F.min("start").over(group), "gn": F.sum("size").over(group)}).join(F.broadcast(over), "h", "left")
    placed = placed.withColumns({"g0": F.coalesce("o0", "g0"), "gn": F.coalesce("on", "gn")})
    small = F.col("gn") * shards <= F.col("total") * F.lit(TOGETHER)
    twice = F.when(small, F.col("g0") * 2 + F.col("gn")).otherwise(F.col("start") * 2 + F.col("size"))
    placed = placed.withColumn("twice", twice)
    placed = placed.withColumn("shard", F.least(F.lit(shards - 1).cast("long"), F.expr(f"(twice * {shards}) DIV (2 * total)")).cast("int"))
    first = placed.groupBy("shard").agg(F.min("row").alias("first"))
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first")).alias("slot"))  # one row a shard


def summary(docs: DataFrame, shards: int = 24) -> DataFrame:
    """The shards with the law that they keep: sizes in bytes are near equal."""
    out = shard_by_bytes(docs, shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
