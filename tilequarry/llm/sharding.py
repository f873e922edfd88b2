"""Sharding by jump consistent hashing, on DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilequarry.llm import native, scratch

#: Fixed values of the published algorithm's generator: its multiplier, and 2 to the power of 31.
MULTIPLIER = 2862933555777941757
STEP = 2147483648.0
_LOW = 0xFFFFFFFF


def _times(high: Column, low: Column) -> tuple[Column, Column]:
    """The halves of (high, low) * MULTIPLIER + 1 modulo 2**64, in parts that stay below 2**63."""
    m = [MULTIPLIER >> s & 0xFFFF for s in (0, 16, 32, 48)]
    under, over = low * m[0] + 1, low * m[1]
    total = under + F.shiftleft(over.bitwiseAND(0xFFFF), 16)
    carry = F.shiftright(total, 32) + F.shiftright(over, 16)
    cross = high * m[0] + F.shiftleft((high * m[1]).bitwiseAND(0xFFFF), 16) + low * m[2] + F.shiftleft((low * m[3]).bitwiseAND(0xFFFF), 16)
    return (carry + cross).bitwiseAND(_LOW), total.bitwiseAND(_LOW)


def jumps(key: Column, shards: int) -> Column:
    """A struct of shard, for ``shards`` shards, and grown, for one more.

    The last jump below ``shards`` is the shard; the jump after it tells whether one more shard
    would take the key, so both counts come from one walk. Each jump lands further on, so
    ``shards`` steps suffice. A null key counts as 0.
    """
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    at = F.struct(F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"), F.shiftrightunsigned(key, 32).alias("h"), key.bitwiseAND(_LOW).alias("l"))

    def step(now: Column, _: Column) -> Column:
        high, low = _times(now["h"], now["l"])
        to = F.floor((now["j"] + 1).cast("double") * (F.lit(STEP) / (F.shiftright(high, 1) + 1).cast("double")))
        return F.when(now["j"] >= shards, now).otherwise(F.struct(now["j"].alias("b"), to.cast("long").alias("j"), high.alias("h"), low.alias("l")))

    end = F.aggregate(F.sequence(F.lit(1), F.lit(shards)), at, step)
    return F.transform(F.array(end), lambda e: F.struct(e["b"].cast("int").alias("shard"), F.when(e["j"] == shards, F.lit(shards)).otherwise(e["b"]).cast("int").alias("grown")))[0]


def shard(docs: DataFrame, shards: int = 24, rows: int = 2000) -> DataFrame:
    """Put every document into one of ``shards`` shards by its doc_id.

    Returns doc_id, size (UTF-8 bytes of the text plus 8), text_crc32, shard, slot (0, 1, ... in
    each shard) and grown_shard (with one more shard: the same, or the new one). A null text has
    no bytes and the checksum of an empty one; null ids count as id 0; repeated rows get a slot
    each; an empty table gives an empty result; other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    own = docs.select(F.col("doc_id").cast("long"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), jumps(F.col("doc_id"), shards).alias("to"))
    own = scratch.store(own.select("doc_id", "size", "text_crc32", F.col("to.shard").alias("shard"), F.col("to.grown").alias("grown_shard")), "shards")
    spread = F.pmod(F.coalesce(F.col("doc_id"), F.lit(0)), F.lit(1 << 30)) + F.col("text_crc32")
    return native.numbered(own, ["shard"], ["doc_id", "text_crc32", "size"], spread, rows, "slot")
