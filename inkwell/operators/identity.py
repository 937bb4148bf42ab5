"""Identity of items over several keys: resolution, new and known items, duplicates, limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.operators import bitmaps

#: Keys in the order of their test; a null or empty part means that the key does not apply.
KEYS = (("source_url", ["source_url"]), ("canonical_url", ["canonical_url"]), ("id", ["item_key", "column_name"]), ("content_hash", ["content_hash"]))


def filled(names: list[str]) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(n).isNotNull() & (F.col(n).cast("string") != "")
    return out


def _dealt(rows: DataFrame, names: list[str]) -> DataFrame:
    """rows with _salt: 0 where the key applies; others are spread by their other keys, and match nothing."""
    every = [n for _, key in KEYS for n in key if n in rows.columns]
    return rows.withColumn("_salt", F.when(filled(names), F.lit(0)).otherwise(F.pmod(F.xxhash64(*every), F.lit(1 << 20)).cast("int") + 1))


def resolve(incoming: DataFrame, state: DataFrame) -> DataFrame:
    """incoming with existing_id and match_kind: the least state id of the first key that matches.

    Each key is one left join to the least id by key, so a key shared by many state rows
    multiplies nothing. Rows without a match have nulls. Null and empty keys are dealt over all
    tasks instead of meeting in one.
    """
    out = incoming
    for kind, names in KEYS:
        least = state.where(filled(names)).groupBy(*names).agg(F.min("id").alias(f"_{kind}")).withColumn("_salt", F.lit(0))
        out = _dealt(out, names).join(least, [*names, "_salt"], "left").drop("_salt")
    found = [F.col(f"_{kind}") for kind, _ in KEYS]
    named = F
    for kind, _ in KEYS:
        named = named.when(F.col(f"_{kind}").isNotNull(), kind)
    return out.select(*[out[c] for c in incoming.columns], F.coalesce(*found).alias("existing_id"), named.alias("match_kind"))


def key_hash(kind: str, names: list[str]) -> Column:
    """64 bits of a key's kind and parts; null where it does not apply."""
    return F.when(filled(names), F.xxhash64(F.lit(kind), *names))


def candidates(state: DataFrame, incoming: DataFrame, bits: int = bitmaps.BITS) -> DataFrame:
    """The rows of state that may share a key with incoming, and few others: what is worth to be joined.

    A bitmap of incoming's keys goes to all tasks, of at most 2^bits bits whatever comes in, so state
    is thinned where it is read and only the rest is shuffled. resolve, new_items and known_items
    give with it what they give with the whole state.
    """
    keys = None
    for kind, names in KEYS:
        one = incoming.select(key_hash(kind, names).alias("key"))
        keys = one if keys is None else keys.union(one)
    return bitmaps.may_hold(state, bitmaps.bitmap(keys, "key", bits), [key_hash(kind, names) for kind, names in KEYS], bits)


def new_items(incoming: DataFrame, state: DataFrame) -> DataFrame:
    """The rows that no key finds: one anti join by each."""
    out = incoming
    for _, names in KEYS:
        keys = state.where(filled(names)).select(*names, F.lit(0).alias("_salt"))
        out = _dealt(out, names).join(keys, [*names, "_salt"], "left_anti").drop("_salt")
    return out.select(*incoming.columns)


def known_items(incoming: DataFrame, state: DataFrame) -> DataFrame:
    """The rows that some key finds."""
    return resolve(incoming, state).where("existing_id is not null").select(*incoming.columns)


def mark_repeats(incoming: DataFrame, names: list[str], order: str = "seq") -> DataFrame:
    """incoming with duplicate: whether an earlier row has the same key; null and empty keys have no duplicates.

    The first of each key is an aggregate that is joined again, not a window: a key that many rows
    share is summed before it is shuffled, and its join can be split.
    """
    first = incoming.where(filled(names)).groupBy(*names).agg(F.min(order).alias("_first")).withColumn("_salt", F.lit(0))
    rows = _dealt(incoming, names).join(first, [*names, "_salt"], "left")
    return rows.select(*(rows[c] for c in incoming.columns), F.coalesce(F.col(order) > F.col("_first"), F.lit(False)).alias("duplicate"))


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows that share the keys, the first in order."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def limit_new(rows: DataFrame, is_new: str, order: list[str], limit: int) -> DataFrame:
    """Rows before the (limit + 1)-th new one, over all columns in order; known ones before it stay.

    Only the order of the first limit + 1 new rows decides, so the cut comes from a top-k,
    not from a running sum over one partition.
    """
    cut = rows.where(is_new).select(*order).orderBy(*order).limit(limit + 1)
    last = cut.agg(F.count("*").alias("n"), F.max(F.struct(*order)).alias("at"))
    at = F.col("at")
    return rows.crossJoin(F.broadcast(last)).where((F.col("n") <= limit) | (F.struct(*order) < at)).drop("n", "at")  # one row


def first_source(rows: DataFrame, key: str, rank: str) -> DataFrame:
    """Per key, all rows of the first source that has any."""
    best = rows.groupBy(key).agg(F.min(rank).alias("_best"))
    return rows.join(best, key).where(F.col(rank) == F.col("_best")).drop("_best")
