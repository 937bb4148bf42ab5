"""Places in an order by a distributed scan: a range partition, counts of its parts, prefix sums of the counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.sources.shared import stored

#: Bits of a row's place within its partition, as monotonically_increasing_id gives it.
WITHIN = 33


def placed(rows: DataFrame, order: list[str], name: str, key: list[str] | None = None) -> DataFrame:
    """rows with `name`: their place from 1 by the columns `order`, of all or of each key (null is a key too).

    Rows are dealt by ranges of key and order and sorted there; only the count of each key in each
    part is summed before it, so neither a hot key nor one long order goes through one task. The
    sorted rows are a table in the shared folder, since bounds of ranges are sampled and would
    differ if they were dealt again. Rows equal in `order` are placed by chance; further columns
    in it tell them apart, and let a value that many rows share be split.
    """
    key, at = key or [], f"_{name}_at"
    by = [F.col(c) for c in (*key, *order)]
    held = stored(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(at, F.monotonically_increasing_id()))
    part = F.shiftright(at, WITHIN).cast("int")
    earlier = Window.partitionBy(*(f"_k{i}" for i in range(len(key)))).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = held.groupBy(part.alias("_part"), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(key))).agg(F.count("*").alias("_n"), F.min(at).alias("_first"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    same = part == F.col("_part")
    for i, k in enumerate(key):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = held.join(before, same)
    return out.select(*(held[c] for c in rows.columns), (F.col("_before") + F.col(at) - F.col("_first") + 1).cast("long").alias(name))
