"""Rows whose key a large set of known keys does not hold, most of them without a shuffle.

A Bloom filter of the known keys stands in front of the anti-join: rows that it rules out are new for sure and stay where they
are; only the others meet the known keys.  The filter is blocked: a key's block is one row of BLOCK_BITS bits, in which it sets
HASHES bits, so rows look their block up in a broadcast of at most most_blocks * 4 KB.  A filter of that size over more
keys than it suits lets more rows through to the join; the result stays exact.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BITS = 32_768  # what bitmap_construct_agg holds
BITS_PER_KEY = 12
HASHES = 4
MOST_BLOCKS = 16_384  # 64 MB


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _places(key: Column) -> list[Column]:
    h = F.xxhash64(key, F.lit(1))
    return [F.shiftrightunsigned(h, 15 * i).bitwiseAND(F.lit(BLOCK_BITS - 1)) for i in range(HASHES)]


def blocks_for(keys: int, most_blocks: int = MOST_BLOCKS) -> int:
    return min(max(math.ceil(keys * BITS_PER_KEY / BLOCK_BITS), 1), most_blocks)


def bloom_filter(known: DataFrame, key: str, blocks: int) -> DataFrame:
    """block, bits of the keys; blocks without a key have no row."""
    k = known.where(F.col(key).isNotNull()).select(_block(F.col(key), blocks).alias("block"), F.explode(F.array(*_places(F.col(key)))).alias("place"))
    return k.groupBy("block").agg(F.bitmap_construct_agg("place").alias("bits"))


def _is_set(bits: Column, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (place % 8).cast("int")) == 1


def with_maybe(rows: DataFrame, key: str, bits: DataFrame, blocks: int, out: str = "_maybe") -> DataFrame:
    """rows with whether the filter may hold their key; false means that it does not.  Null keys are held by none."""
    b = F.broadcast(bits.select(F.col("block").alias("_block"), F.col("bits").alias("_bits")))
    found = rows.join(b, _block(F.col(key), blocks) == F.col("_block"), "left")
    held = F.col("_bits").isNotNull() & F.col(key).isNotNull()
    for place in _places(F.col(key)):
        held = held & _is_set(F.col("_bits"), place)
    return found.withColumn(out, F.coalesce(held, F.lit(False))).drop("_block", "_bits")


def without_known(rows: DataFrame, key: str, known: DataFrame, keys: int | None = None, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """rows whose key known (column key) does not hold: the left anti-join, behind the filter.  keys: about how many there
    are (counted where not given)."""
    k = known.select(key).where(F.col(key).isNotNull()).distinct()
    blocks = blocks_for(k.count() if keys is None else keys, most_blocks)
    marked = with_maybe(rows, key, bloom_filter(k, key, blocks), blocks)
    new = marked.where(~F.col("_maybe")).select(*rows.columns)
    doubtful = marked.where("_maybe").select(*rows.columns).join(k, key, "left_anti").select(*rows.columns)
    return new.unionByName(doubtful)
