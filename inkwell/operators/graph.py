"""Connected components of links between numbered nodes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.sources.shared import stored

#: Links of which one task keeps those that span them.
LINKS = 1 << 18


class Forest:
    """Links among those given so far that connect what was not connected: at most one less than there are nodes."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def _root(self, node: int) -> int:
        up = self.up
        while (above := up.get(node, node)) != node:
            up[node] = up.get(above, above)
            node = above
        return node

    def grown(self, pairs: Iterable[tuple[int, int]]) -> pa.RecordBatch:
        """The links of pairs (a, b) that are needed, as columns a and b."""
        new = []
        for pair in pairs:
            a, b = map(self._root, pair)
            if a != b:
                self.up[max(a, b)] = min(a, b)
                new.append(pair)
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in new], pa.int64()) for k in (0, 1)], ["a", "b"])


def thinned(links: DataFrame, part: int = LINKS) -> DataFrame:
    """A written table of links (a, b), with only those that span what parts of about `part` links connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for batch in batches:
            yield forest.grown(zip(*(c.to_pylist() for c in batch.columns)))

    return stored(links.repartition(max(1, -(-links.count() // part))).mapInArrow(run, "a long, b long"))


def groups(links: DataFrame) -> DataFrame:
    """components of a table of links (a, b), which one task solves where it may hold them: LINKS at most."""
    if links.count() > LINKS:
        return components(links)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for batch in batches:
            forest.grown(zip(*(c.to_pylist() for c in batch.columns)))
        nodes = sorted({*forest.up, *forest.up.values()})
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (nodes, list(map(forest._root, nodes)))], ["node", "root"])

    return links.select("a", "b").coalesce(1).mapInArrow(run, "node long, root long")


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Connected components of edges (a, b), as (node, root): root is the least node reachable.

    Alternates the large-star and small-star steps; each round is written to the shared
    folder. Nulls are not nodes. Nodes without edges do not appear. Fails if `rounds` is
    not enough, rather than returning part of a result.
    """
    links = thinned(stored(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))))

    def star(pairs: DataFrame, larger_only: bool) -> DataFrame:
        both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if larger_only:
            near = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
            out = both.join(near, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            near = pairs.groupBy("a").agg(F.min("b").alias("m"))
            moved = pairs.join(near, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            out = moved.union(near.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    def mark(df: DataFrame) -> tuple:
        row = df.agg(
            F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.crc32(F.concat_ws(",", "a", "b").cast("binary"))).alias("s")
        ).first()
        return tuple(row)

    seen = mark(links)
    if not seen[0]:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(rounds):
        links = stored(star(star(links, True), False))
        now = mark(links)
        if now == seen:
            roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return roots.union(links.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        seen = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
