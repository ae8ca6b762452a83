"""Sharding by weighted rendezvous hashing of stable record keys (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epistola.llm.common import materialize

#: Buckets that split each shard while positions are numbered; at most shards x SLOT_BUCKETS offsets exist.
SLOT_BUCKETS = 1024
SHARDS = 16


def _unit(key: Column, salt: str) -> Column:
    """A number in (0, 1) from 52 bits of the md5 of key and salt."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"#{salt}")).cast("binary")), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(float(1 << 52))


def rendezvous(key: Column, weights: Sequence[float], first: int = 0) -> Column:
    """struct<cost, shard>: shard s costs -ln(u(key, s)) / weight(s) and the cheapest shard wins.

    A key moves only to an added shard, or away from a removed one; a shard of weight w
    gets w / sum(weights) of the keys. Weight 0 never wins.
    """
    costs = [
        F.struct((-F.ln(_unit(key, str(s))) / F.lit(float(w))).alias("cost"), F.lit(s).alias("shard"))
        for s, w in enumerate(weights, first)
        if w > 0
    ]
    return F.least(*costs) if len(costs) > 1 else costs[0]


def shard(
    docs: DataFrame,
    weights: Sequence[float] = (1.0,) * SHARDS,
    grown_weight: float = 1.0,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Deal rows into shards by key alone and number each shard's rows without gaps.

    Returns key, size, text_crc32, law, shard, slot, grown_shard. grown_shard is the shard
    when one more of grown_weight joins. A null key counts as the text null, a null text has
    size 1 and checksum 0; repeated keys share a shard and get slots of their own; an empty
    table gives an empty table; other columns are ignored. Slots follow (bucket, key,
    checksum, size), so equal input gives equal slots.
    """
    name = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    best = F.col("best")
    rows = (
        docs.select(F.col(key).alias("key"), name.alias("name"), (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body).alias("text_crc32"))
        .withColumns({"best": rendezvous(F.col("name"), weights), "extra": rendezvous(F.col("name"), [grown_weight], len(weights)) if grown_weight > 0 else F.lit(None)})
        .select(
            "key",
            "size",
            "text_crc32",
            best["shard"].alias("shard"),
            F.when(F.col("extra")["cost"] < best["cost"], F.lit(len(weights))).otherwise(best["shard"]).alias("grown_shard")
            if grown_weight > 0
            else best["shard"].alias("grown_shard"),
            F.pmod(F.conv(F.substring(F.md5(F.concat_ws("#", "name", "text_crc32", "size").cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(SLOT_BUCKETS)).cast("int").alias("bucket"),
        )
    )
    rows = materialize(rows, "shards")
    per_shard = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # at most shards x SLOT_BUCKETS rows, whatever the input
    offsets = rows.groupBy("shard", "bucket").count().select("shard", "bucket", F.coalesce(F.sum("count").over(per_shard), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "bucket").orderBy("key", "text_crc32", "size")
    return (
        rows.withColumn("at", F.row_number().over(inside))
        .join(F.broadcast(offsets), ["shard", "bucket"])
        .select(
            F.col("key").alias(key),
            "size",
            "text_crc32",
            F.lit("key").alias("law"),
            "shard",
            (F.col("offset") + F.col("at") - 1).cast("long").alias("slot"),
            "grown_shard",
        )
    )
