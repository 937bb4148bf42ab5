"""Bitmaps of hashed keys, as tables of 64-bit words: they say which keys are not there, and at times of one that it may be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A bitmap has 2^BITS bits (more than 2^6), so 2^(BITS - 6) rows at most (1 MB); of n keys about n / 2^BITS let a stranger pass.
BITS = 22


def word_of(key: Column, bits: int) -> Column:
    """The word of a 64-bit hash: its first bits."""
    return F.shiftrightunsigned(key, 64 - bits + 6)


def bit_of(key: Column, bits: int) -> Column:
    """The bit within the word: the six bits that follow."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(key, 64 - bits).bitwiseAND(63).cast("int"))


def bitmap(rows: DataFrame, key: str, bits: int = BITS, also: tuple[str, ...] = ()) -> DataFrame:
    """word and bits of the keys (64-bit hashes; null: no key), for each value of the columns `also`."""
    k = F.col(key)
    return rows.where(k.isNotNull()).groupBy(*also, word_of(k, bits).alias("word")).agg(F.bit_or(bit_of(k, bits)).alias("bits"))


def may_hold(rows: DataFrame, held: DataFrame, keys: list[Column], bits: int = BITS) -> DataFrame:
    """The rows of which some key may be in a bitmap; it is joined by broadcast, which its number of words bounds."""
    out, hit = rows, F.lit(False)
    for k, key in enumerate(keys):
        words = F.broadcast(held.select(F.col("word").alias(f"_word{k}"), F.col("bits").alias(f"_bits{k}")))
        out = out.withColumn(f"_key{k}", key).withColumn(f"_word{k}", word_of(F.col(f"_key{k}"), bits)).join(words, f"_word{k}", "left")
        hit = hit | (F.coalesce(F.col(f"_bits{k}").bitwiseAND(bit_of(F.col(f"_key{k}"), bits)), F.lit(0)) != 0)
    return out.where(hit).select(*rows.columns)
