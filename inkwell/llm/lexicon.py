"""Units (pre-tokens, words) of a corpus: counted once, valued once, joined back and summed by document.

Frequent units are looked up in a dictionary of at most `head` entries that goes to every
task; the others are joined by a shuffle on the unit, so no size of vocabulary breaks it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, bytes_of

#: Most entries of the dictionary that is sent to tasks (about 40 MB in a Python worker).
HEAD = 1 << 18
#: Counts that a task gathers before it adds up those of the same unit, and passes them on if half as many are left.
GATHER = 1 << 19

#: The units (binary) of a column of texts, in any order, and of each the place of its text.
Split = Callable[[pa.Array], tuple[pa.Array, np.ndarray]]


def split_each(split: Callable[[bytes], list[bytes]]) -> Split:
    """Units by a function of one text."""

    def units(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        found = [split(t) for t in bytes_of(texts)]
        return pa.array(chain.from_iterable(found), pa.binary()), np.repeat(np.arange(len(found)), [len(x) for x in found])

    return units


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased (A-Z) words between ASCII white space."""
    found = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.binary()).fill_null(b"").view(pa.string())))
    units, owner = found.flatten().cast(pa.binary()), np.repeat(np.arange(len(texts)), pc.list_value_length(found).to_numpy())
    words = pc.not_equal(pc.binary_length(units), 0)  # white space at either end leaves an empty one
    return units.filter(words), owner[words.to_numpy(zero_copy_only=False)]


def count_units(docs: DataFrame, split: Split, flags: Sequence[Column]) -> DataFrame:
    """(unit binary, n0 long, n1 long, ...): occurrences in column text of the rows where each flag is true.

    Null texts count as empty.
    """

    names = [f"n{k}" for k in range(len(flags))]

    def start():
        parts, held = [], 0

        def added():
            sums = pa.concat_tables(parts).group_by("unit", use_threads=False).aggregate([(n, "sum") for n in names])
            return sums.select(["unit", *(f"{n}_sum" for n in names)]).rename_columns(["unit", *names])

        def passed(table):
            return [c.combine_chunks() for c in table.columns] if len(table) else None

        def work(*columns):
            nonlocal parts, held
            if not columns:
                return passed(added()) if parts else None
            units, owner = split(columns[0])
            own = units.dictionary_encode()
            at, size = own.indices.to_numpy(), len(own.dictionary)
            counts = [np.bincount(at, c.to_numpy().take(owner), size).astype(np.int64) for c in columns[1:]]
            parts.append(pa.table([own.dictionary, *counts], ["unit", *names]))
            held += size
            if held <= GATHER:
                return None
            table = added()
            parts, held = ([], 0) if len(table) > GATHER // 2 else ([table], len(table))
            return None if parts else passed(table)

        return work

    asked = [F.coalesce(f.cast("long"), F.lit(0).cast("long")).alias(n) for f, n in zip(flags, names)]
    parts = arrow_map(docs, ["text", *asked], "unit binary, " + ", ".join(f"{n} long" for n in names), start, finish=True)
    return parts.groupBy("unit").agg(*(F.sum(n).alias(n) for n in names))


def frequent(table: DataFrame, most: int) -> DataFrame:
    """The rows of table whose n is so large that at most `most` rows have as much, to an eighth of a doubling.

    The driver gets a count for each step of n, some 500 at most.
    """
    step = F.floor(8 * F.log2(F.greatest("n", F.lit(1)))).cast("int")
    left, least = most, None
    for row in table.groupBy(step.alias("step")).agg(F.count("*").alias("rows")).orderBy(F.desc("step")).collect():
        left -= row["rows"]
        if left < 0:
            break
        least = row["step"]
    return table.where(step >= least) if least is not None else table.limit(0)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function, for x > 0, by Stirling's series from x + 8 on."""
    shifted = np.zeros_like(x)
    for k in range(8):
        shifted += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shifted


def urn_log10(strength: float, log10_p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """log10 of the weights with which an urn of `strength` coloured by p gives one colour n times."""
    p = strength * 10.0**log10_p
    out = np.log10(p)
    again = np.flatnonzero(n > 1)
    p, n = p[again], n[again]
    out[again] += (log_gamma(p + n) - log_gamma(p + 1)) / np.log(10)
    return out


def document_sums(
    docs: DataFrame, split: Split, table: DataFrame, urns: Sequence[float] = (), also: Sequence[str] = (), head: int = HEAD
) -> DataFrame:
    """For each row of docs: doc_id, n_bytes, n_units, and the sums of `a` and `b` over its units.

    table: (unit, n, a double, b long), one row for each unit of docs; those of most n, at most
    `head`, go to all tasks. With urns (strengths), `a` is a log10 probability and urn_0, urn_1, ... are
    the log10 probabilities of the text's units drawn from urns to which each drawn unit is
    added. also: further columns (double) of the table to sum, as sum_<name>. Rows are told apart by their place, so repeated rows and null ids stay.
    """
    spark = docs.sparkSession
    rows = frequent(table, head).select("unit", "a", "b", *also).toArrow()
    values_of = [rows[c].to_numpy() for c in ("a", "b", *also)]
    shared = spark.sparkContext.broadcast(({u: i for i, u in enumerate(rows["unit"].to_pylist())}, values_of))
    del rows
    names = [f"sum_{c}" for c in also] + [f"urn_{k}" for k in range(len(urns))]

    def start():
        known, (value_a, value_b, *others) = shared.value
        get = known.get

        def work(places, ids, texts):
            whole = len(texts)
            if not whole:
                return None
            units, owner = split(texts)
            own = units.dictionary_encode()
            units = own.dictionary
            key = owner * len(units) + own.indices.to_numpy()
            key.sort()
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
            times = np.diff(np.r_[first, len(key)])
            owner, code = np.divmod(key[first], max(len(units), 1))
            rank = np.fromiter(map(get, units.to_numpy(zero_copy_only=False).tolist(), repeat(-1)), np.int64, len(units))[code]
            total = lambda weights, own=owner: np.bincount(own, weights, whole)
            count = total(times)
            here, there = np.flatnonzero(rank >= 0), np.flatnonzero(rank < 0)
            n, a, own = times[here], value_a[rank[here]], owner[here]
            places = np.asarray(places)
            sums = [total(n * a, own), total(n * value_b[rank[here]], own)]
            sums += [total(n * v[rank[here]], own) for v in others]
            sums += [total(urn_log10(s, a, n), own) - (log_gamma(s + count) - log_gamma(np.full(whole, s))) / np.log(10) for s in urns]
            rest = len(there)
            # a document's own row is spread over partitions by its place, and has no match in the table
            return [
                np.r_[places[owner[there]], places],
                pa.concat_arrays([units.take(pa.array(code[there])), pa.array([b"%d" % p for p in places.tolist()], pa.binary())]),
                np.r_[np.zeros(rest, np.int32), np.ones(whole, np.int32)],
                np.r_[times[there], np.zeros(whole, np.int64)],
                [None] * rest + ids.to_pylist(),
                [None] * rest + pc.binary_length(texts.cast(pa.binary())).fill_null(0).to_pylist(),
                np.r_[np.zeros(rest, np.int64), count.astype(np.int64)],
                np.r_[np.zeros(rest), sums[0]],
                np.r_[np.zeros(rest, np.int64), sums[1].astype(np.int64)],
                *(np.r_[np.zeros(rest), s] for s in sums[2:]),
            ]

        return work

    parts = arrow_map(
        docs.select(F.monotonically_increasing_id().alias("place"), F.col("doc_id").cast("long").alias("doc_id"), "text"),
        ["place", "doc_id", "text"],
        "place long, unit binary, own int, times long, doc_id long, n_bytes long, n_units long, sum_a double, sum_b long"
        + "".join(f", {n} double" for n in names),
        start,
    )
    values = table.select("unit", F.lit(0).alias("own"), "a", "b", *also)

    def urn(name: str, strength: float) -> Column:
        p = f"({strength}D * power(10D, a))"
        again = f"if(times > 1, aggregate(sequence(1L, times - 1), 0D, (t, j) -> t + log10({p} + j)), 0D)"
        return F.sum(F.col(name) + F.coalesce(F.expr(f"if(own = 0, log10({p}) + {again}, 0D)"), F.lit(0.0))).alias(name)

    return (
        parts.join(values, ["unit", "own"], "left")
        .groupBy("place")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.max("n_bytes").alias("n_bytes"),
            F.sum("n_units").alias("n_units"),
            F.sum(F.col("sum_a") + F.col("times") * F.coalesce("a", F.lit(0.0))).alias("sum_a"),
            F.sum(F.col("sum_b") + F.col("times") * F.coalesce("b", F.lit(0))).alias("sum_b"),
            *(F.sum(F.col(f"sum_{c}") + F.col("times") * F.coalesce(c, F.lit(0.0))).alias(f"sum_{c}") for c in also),
            *(urn(n, s) for n, s in zip(names[len(also) :], urns)),
        )
        .drop("place")
    )
