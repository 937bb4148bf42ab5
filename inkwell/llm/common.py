"""Shared helpers: Arrow batches, tables in the cluster's shared folder, graph components."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from inkwell.operators.graph import Forest, components, thinned  # noqa: F401
from inkwell.sources.shared import shared_dir, stored as written  # noqa: F401



def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> Column:
    """A column by its name as it is, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(stem: str, columns: Sequence[str]) -> str:
    """A column name that no other column has, in any case of its letters."""
    taken, name = {c.lower() for c in columns}, f"_{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def arrow_map(
    df: DataFrame,
    columns: Sequence[str | Column],
    schema: str,
    start: Callable[[], Callable[..., Sequence | None]],
    rows: int = 256,
    finish: bool = False,
) -> DataFrame:
    """Apply a function to slices of `rows` rows.

    `start()` runs once in each task and returns f(*arrow_columns) -> sequence of output
    columns (or None for no rows). With `finish`, f() is also called without arguments
    after the last slice, for what a task has gathered.
    """
    fields = to_arrow_schema(T.StructType.fromDDL(schema))

    def pack(out: Sequence) -> pa.RecordBatch:
        arrays = [x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(out, fields)]
        return pa.RecordBatch.from_arrays(arrays, schema=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = work(*batch.slice(at, rows).columns)
                if out is not None:
                    yield pack(out)
        if finish:
            out = work()
            if out is not None:
                yield pack(out)

    return df.select(*columns).mapInArrow(run, schema)


def bytes_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def crc_of_id(column: str) -> Column:
    """crc32 of an id written as decimal text (null: of the empty text)."""
    return F.crc32(F.encode(F.coalesce(F.col(column).cast("string"), F.lit("")), "UTF-8"))
