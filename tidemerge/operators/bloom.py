"""Bloom filters as tables of set bits, from a hash that any engine can compute: two 60-bit halves of MD5."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import BLOOM_KEYS, BLOOM_RATE


def parameters(keys: int = BLOOM_KEYS, rate: float = BLOOM_RATE) -> tuple[int, int]:
    """(bits, hashes) for so many keys at a false-positive rate; 0 keys count as 1, a rate outside (0, 1) as 0.01."""
    keys, rate = max(1, keys), rate if 0 < rate < 1 else BLOOM_RATE
    bits = max(1, math.ceil(-keys * math.log(rate) / math.log(2) ** 2))
    return bits, max(1, round(bits / keys * math.log(2)))


def _half(key: Column, start: int, bits: int) -> Column:
    return F.conv(F.substring(F.md5(key.cast("binary")), start, 15), 16, 10).cast("bigint") % bits


def positions(key: Column, bits: int, hashes: int) -> Column:
    """The bits of a key: first hash plus multiples of the second, which is never 0."""
    first, second = _half(key, 1, bits), _half(key, 16, bits)
    step = F.when(second == 0, 1).otherwise(second)
    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: (first + i * step) % bits)


def build(keys: DataFrame, bits: int, hashes: int, *by: str) -> DataFrame:
    """The set bits (for each ``by``): a row for each, without repeats. Each key is hashed once, below the explode."""
    halves = keys.select(*by, _half(F.col("key"), 1, bits).alias("first"), _half(F.col("key"), 16, bits).alias("second"))
    each = halves.select(*by, "first", F.greatest("second", F.lit(1)).alias("step"), F.explode(F.sequence(F.lit(0), F.lit(hashes - 1))).alias("i"))
    return each.select(*by, ((F.col("first") + F.col("i") * F.col("step")) % bits).alias("bit")).distinct()


def probe(keys: DataFrame, filter_bits: DataFrame, bits: int, hashes: int, *by: str) -> DataFrame:
    """key (and ``by``: of each filter that has any of its bits), may_contain: whether all its bits are set. Never false for a key that was added."""
    asked = keys.select("key").distinct().withColumn("at", F.array_distinct(positions(F.col("key"), bits, hashes)))
    asked = asked.select("key", F.size("at").alias("n"), F.explode("at").alias("bit"))
    hit = asked.join(filter_bits.select("bit", *by, F.lit(1).alias("set")), "bit", "inner" if by else "left")
    return hit.groupBy("key", *by).agg((F.count("set") == F.max("n")).alias("may_contain"))


def described(keys: int, rate: float) -> dict:
    """What a filter knows about itself: expected keys, false-positive rate, bits, hashes."""
    bits, hashes = parameters(keys, rate)
    return {"expected": max(1, keys), "rate": rate if 0 < rate < 1 else BLOOM_RATE, "bits": bits, "hashes": hashes}


def packed(filter_bits: DataFrame, *by: str) -> DataFrame:
    """The filter as blocks of a bitmap (32768 bits each): the form to store."""
    place = F.col("bit") + 1  # bitmaps count from 1
    return filter_bits.groupBy(*by, F.bitmap_bucket_number(place).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bitmap"))


def unpacked(blocks: DataFrame, *by: str) -> DataFrame:
    """The set bits of a stored filter."""
    at = F.posexplode(F.split(F.regexp_replace(F.hex("bitmap"), "(..)", "$1,"), ","))
    byte = blocks.select(*by, "block", at.alias("byte", "hex")).where(F.col("hex") != "")
    each = byte.select(*by, ((F.col("block") - 1) * 32768 + F.col("byte") * 8).alias("base"), F.conv("hex", 16, 10).cast("int").alias("v"))
    spread = each.select(*by, "base", "v", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k"))
    is_set = F.expr("shiftright(v, k) & 1") == 1
    return spread.where(is_set).select(*by, (F.col("base") + F.col("k")).cast("bigint").alias("bit"))


#: Of the places ``at`` in ``bitmap`` those that are set, without unpacking it.
_SET = "filter(at, p -> (shiftright(cast(conv(hex(substring(bitmap, cast(p div 8 as int) + 1, 1)), 16, 10) as int), cast(p % 8 as int)) & 1) = 1)"


def probe_stored(keys: DataFrame, blocks: DataFrame, bits: int, hashes: int, *by: str) -> DataFrame:
    """As ``probe``, of a filter in the form it is stored: a block is looked at where bits are asked for, and never unpacked.

    With ``by`` each key meets each filter, so the keys are sent to the blocks: all filters have the same few block numbers, and a
    shuffle by these would bring them into a few tasks.
    """
    asked = keys.select("key").distinct().withColumn("at", F.array_distinct(positions(F.col("key"), bits, hashes)))
    asked, place = asked.select("key", F.size("at").alias("n"), F.explode("at").alias("bit")), F.col("bit") + 1  # bitmaps count from 1
    wanted = asked.groupBy("key", "n", F.bitmap_bucket_number(place).alias("block")).agg(F.collect_list(F.bitmap_bit_position(place)).alias("at"))
    stored = blocks.select(*by, "block", "bitmap")
    met = stored.join(F.broadcast(wanted), "block") if by else wanted.join(stored, "block", "left")
    found = met.select("key", *by, "n", F.when(F.col("bitmap").isNull(), 0).otherwise(F.size(F.expr(_SET))).alias("set"))
    counted = found.groupBy("key", *by).agg(F.sum("set").alias("set"), F.max("n").alias("n"))
    return (counted.where("set > 0") if by else counted).select("key", *by, (F.col("set") == F.col("n")).alias("may_contain"))
