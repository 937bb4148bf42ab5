"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Forest, arrow_map, bytes_of, components, quoted, read_table, unused, written

WORDS = 3
SEED = 42
#: Two segments of 32 bits: of 3 differing bits at most 1 lies in one of them.
DISTANCE = 3
#: Rows of one table entry that are compared in one task; larger entries are cut in blocks.
BLOCK = 4096
#: Entries of up to so many rows are first searched together for any near pair.
FEW = 8
#: For similarity instead of a fixed distance: two prints of LANES fingerprints each, one of the distinct
#: two-word shingles and one of the distinct five-word ones, find candidates, and the sets of five-word
#: shingles decide. Of a print's 128 bits 126 are the index, in six segments.
LANES = 2
PRINT_WORDS = (2, 5)
SEGMENT_BITS = 21
SEGMENTS = LANES * (63 // SEGMENT_BITS)
#: Leading bits of a segment that rows are dealt by, at least; the others are searched within a task.
ROUTE_BITS = 12
#: Rows of a route that one task compares at once; larger routes are cut in blocks.
ROUTE_ROWS = 1 << 16
#: Keys with several blocks that are broadcast (24 bytes each).
BLOCKS_SENT = 100_000
#: Rows and bytes of shingle sets of one group that are compared in one task; larger groups are cut in blocks.
SET_ROWS, SET_BYTES = 1024, 16 << 20
SIMILAR_WORDS = 5
SIMILARITY = 0.8


def shingle_hashes(text: bytes, n: int) -> np.ndarray:
    """XXH64 of the n-word shingles of a text (UTF-8), A-Z in lower case; of all words if they are fewer."""
    words = text.lower().split()
    if len(words) <= n:
        shingles = [b" ".join(words)] if words else []
    else:
        shingles = list(map(b" ".join, zip(*(words[k:] for k in range(n)))))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, SEED) for s in shingles), "<u8", len(shingles))


def majority(hashes: np.ndarray) -> int:
    """Each of 64 bits is set if it is set in over half the hashes; zero if there are none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, n: int = WORDS) -> int:
    """The 64-bit SimHash of a text."""
    return majority(shingle_hashes(text, n))


def word_hashes(text: bytes) -> np.ndarray:
    """XXH64 of the words of a text (UTF-8), A-Z in lower case."""
    words = text.lower().split()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w, SEED) for w in words), "<u8", len(words))


def joined_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n word hashes; of all of them if they are fewer; none for none."""
    n = min(n, len(words))
    rows = len(words) - n + 1 if n else 0
    out = np.full(rows, n, np.uint64)
    for k in range(n):
        out = (out ^ words[k : k + rows]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out


def wide_fingerprint(words: np.ndarray, n: int) -> list[int]:
    """A print of the word hashes of a text: LANES SimHashes, of the distinct shingle hashes and of further hashes of these."""
    out, h = [], np.unique(joined_hashes(words, n))
    for _ in range(LANES):
        out.append(majority(h))
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return out


def shingle_set(text: bytes, n: int) -> np.ndarray:
    """The distinct shingle hashes in order; one zero for a text without words."""
    found = np.unique(joined_hashes(word_hashes(text), n))
    return found if len(found) else np.zeros(1, "<u8")


def fingerprints(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """place (a number for the row), doc_id, fp (the fingerprint as a signed long)."""

    def start():
        def work(places, ids, texts):
            return [places, ids, np.array([fingerprint(x, n) for x in bytes_of(texts)], "<u8").view("<i8")]

        return work

    return arrow_map(
        docs.select(F.monotonically_increasing_id().alias("place"), F.col("doc_id").cast("long").alias("doc_id"), "text"),
        ["place", "doc_id", "text"],
        "place long, doc_id long, fp long",
        start,
    )


def index_rows(prints: DataFrame, step: int = 1) -> DataFrame:
    """(segment, entry, fp): each fingerprint's own two table entries, and those it probes (step 33: only its own).

    A probe flips one bit of a segment. Of two segments that differ in one bit, one has it
    unset, so only unset bits are flipped: each pair still meets.
    """
    j = F.col("j")
    segment, bit = (j / 33).cast("int"), (j % 33) - 1
    value = F.when(segment == 0, F.col("fp").bitwiseAND(0xFFFFFFFF)).otherwise(F.shiftrightunsigned("fp", 32))
    flip = F.when(bit < 0, F.lit(0).cast("long")).otherwise(F.expr("shiftleft(1L, cast(j % 33 - 1 as int))"))
    return (
        prints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(65), F.lit(step))).alias("j"))
        .select("fp", segment.alias("segment"), value.alias("value"), flip.alias("flip"))
        .where(F.col("value").bitwiseAND(F.col("flip")) == 0)
        .select("segment", F.col("value").bitwiseOR(F.col("flip")).alias("entry"), "fp")
    )


def route_bits(n: int) -> int:
    """Bits to deal n texts by, so that a route has some ten thousand rows at most unless it is hot."""
    return min(SEGMENT_BITS, max(ROUTE_BITS, n.bit_length() - 13))


def segment_values(lanes: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """The bits of segment (0 to SEGMENTS - 1) of each row of lanes (unsigned)."""
    half = SEGMENTS // LANES
    lane = np.take_along_axis(lanes, (segment // half)[:, None], 1)[:, 0]
    return (lane >> (SEGMENT_BITS * (segment % half)).astype(np.uint64) & np.uint64((1 << SEGMENT_BITS) - 1)).astype(np.int64)


def similar_rows(prints: DataFrame, bits: int = ROUTE_BITS) -> DataFrame:
    """(segment, route, node, l0, l1): each print under the leading `bits` of its segments, and with one unset bit of these set.

    prints: node and the lanes p0_l0, p0_l1, p1_l0, ...; segments count on from print to print.
    """
    names, per, half = [f"l{k}" for k in range(LANES)], bits + 1, SEGMENTS // LANES
    out = None
    for k in range(len(PRINT_WORDS)):
        own = prints.select("node", *(F.col(f"p{k}_{n}").alias(n) for n in names), F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS * per - 1))).alias("j"))
        cut = "shiftright({}, cast(%d * ((j div %d) %% %d) + %d as int)) & %d" % (SEGMENT_BITS, per, half, SEGMENT_BITS - bits, (1 << bits) - 1)
        value = F.when(F.col("j") < per * half, F.expr(cut.format("l0"))).otherwise(F.expr(cut.format("l1")))
        flip = F.when(F.col("j") % per == 0, F.lit(0).cast("long")).otherwise(F.expr(f"shiftleft(1L, cast(j % {per} - 1 as int))"))
        rows = (
            own.select(((F.col("j") / per).cast("int") + F.lit(k * SEGMENTS)).alias("segment"), value.alias("value"), flip.alias("flip"), "node", *names)
            .where(F.col("value").bitwiseAND(F.col("flip")) == 0)
            .select("segment", F.col("value").bitwiseOR(F.col("flip")).cast("int").alias("route"), "node", *names)
        )
        out = rows if out is None else out.union(rows)
    return out


def entries_of(segment: np.ndarray, route: np.ndarray, lanes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, low): the entries of a route that each of its rows is under.

    A row whose leading bits are the route's own is under its low bits and all one bit away; a row
    with a leading bit set is under its low bits alone. So two segments meet if they differ in at most
    two bits, unless both are leading bits and the same one of the segments has them unset.
    """
    low_bits = SEGMENT_BITS - bits
    value = segment_values(lanes, segment % SEGMENTS)
    low, own = value & ((1 << low_bits) - 1), np.flatnonzero(value >> low_bits == route)
    flips = 1 << np.arange(low_bits)
    return np.r_[np.arange(len(low)), np.repeat(own, low_bits)], np.r_[low, (low[own][:, None] ^ flips).ravel()]


def similar_links(prints: DataFrame, distance: int, bits: int, block: int = ROUTE_ROWS) -> DataFrame:
    """(a, b): links between nodes; all that meet under an entry and are within `distance` bits of a print are connected through them."""
    lanes = [f"l{k}" for k in range(LANES)]
    rows = similar_rows(prints, bits)
    blocks = rows.groupBy("segment", "route").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).where("blocks > 1")
    sorted_rows = in_blocks(rows, ["segment", "route"], "node", blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, forest = np.empty((5 + LANES, 0), np.int64), Forest()

        def found(rows: np.ndarray, cuts: np.ndarray) -> pa.RecordBatch:
            key = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
            row, low = entries_of(rows[0], rows[1], rows[5:].T.copy().view("<u8"), bits)
            order = np.lexsort((low, key[row]))
            row, low = row[order], low[order]
            ends = np.flatnonzero(np.r_[True, (key[row[1:]] != key[row[:-1]]) | (low[1:] != low[:-1]), True]) if len(row) else np.array([0])
            pairs, sorted_lanes = [], rows[5:, row].view("<u8")
            for k in np.flatnonzero(with_near_pair(sorted_lanes, ends, distance)):
                nodes, first = np.unique(rows[4, row[ends[k] : ends[k + 1]]], return_index=True)
                if len(nodes) > 1:
                    pairs += linked_within(nodes, sorted_lanes[:, ends[k] + first].T.copy(), distance)
            return forest.grown(pairs)

        for batch in batches:
            new = np.stack([np.asarray(c).astype(np.int64) for c in batch.columns])
            rows = np.concatenate([kept, new], axis=1)
            cuts = np.flatnonzero(np.r_[True, (rows[:4, 1:] != rows[:4, :-1]).any(0)]) if rows.shape[1] else np.array([0])
            kept = rows[:, cuts[-1] :]
            if len(cuts) > 1:
                yield found(rows[:, : cuts[-1]], cuts)
        if kept.shape[1]:
            yield found(kept, np.array([0, kept.shape[1]]))

    return sorted_rows.select("segment", "route", "x", "y", "node", *lanes).mapInArrow(run, "a long, b long")


def linked_within(nodes: np.ndarray, lanes: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that span the same components as all pairs whose lanes (unsigned) are at most `distance` bits apart."""
    left, out = np.arange(len(nodes)), []
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            one = todo.pop()
            near = np.bitwise_count(lanes[left] ^ lanes[one]).sum(1) <= distance
            if near.any():
                found = left[near]
                out += [(int(nodes[one]), int(x)) for x in nodes[found]]
                todo.extend(found)
                left = left[~near]
    return out


def linked_sets(nodes: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that span the same components as all pairs of sets with this Jaccard similarity or more."""
    sizes = np.array([len(x) for x in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts, mark = np.cumsum(sizes) - sizes, np.zeros(ids.max() + 1, np.int32)
    left, flat, out = np.arange(len(sets)), ids, []

    def drop(gone: np.ndarray) -> None:
        nonlocal left, flat
        flat, left = flat[np.repeat(~gone, sizes[left])], left[~gone]

    while len(left) > 1:
        todo = [left[0]]
        drop(np.arange(len(left)) == 0)
        while todo and len(left):
            one = todo.pop()
            own = ids[starts[one] : starts[one] + sizes[one]]
            mark[own] = 1
            common = np.add.reduceat(mark[flat], np.cumsum(sizes[left]) - sizes[left])
            mark[own] = 0
            near = common >= similarity * (sizes[left] + sizes[one] - common) - 1e-9
            if near.any():
                out += [(int(nodes[one]), int(x)) for x in nodes[left[near]]]
                todo.extend(left[near])
                drop(near)
    return out


def with_near_pair(rows: np.ndarray, cuts: np.ndarray, distance: int) -> np.ndarray:
    """Which of the runs between cuts have two rows at most `distance` bits apart; those of over FEW rows count as having."""
    sizes = np.diff(cuts)
    run = np.repeat(np.arange(len(sizes)), sizes)
    found = sizes > FEW
    for step in range(1, min(FEW, len(run))):
        at = np.flatnonzero((run[step:] == run[:-step]) & ~found[run[step:]])
        near = np.bitwise_count(rows[:, at] ^ rows[:, at + step]).sum(0) <= distance
        found[run[at[near]]] = True
    return found


def in_blocks(rows: DataFrame, key: list[str], node: str, blocks: DataFrame) -> DataFrame:
    """rows with x, y: keys that `blocks` (key, blocks) names are dealt to pairs of blocks; sorted by key, x, y.

    Each row goes to as many places as its key has blocks, and every two rows of a key meet.
    Up to BLOCKS_SENT keys are broadcast, so that rows are shuffled once; more are joined.
    """
    blocks = written(blocks)
    if blocks.count() <= BLOCKS_SENT:
        blocks = F.broadcast(blocks)
    one = F.col("blocks").isNull()
    own = F.pmod(F.xxhash64(node), F.col("blocks")).cast("int")
    dealt = (
        rows.join(blocks, key, "left")
        .withColumn("own", F.when(one, F.lit(0)).otherwise(own))
        .withColumn("other", F.explode(F.when(one, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
        .select(*key, F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), *[c for c in rows.columns if c not in key])
    )
    return dealt.repartition(*key, "x", "y").sortWithinPartitions(*key, "x", "y")


def large_entries(own: DataFrame, ball: int, block: int) -> DataFrame:
    """(segment, entry, blocks): the entries that may have over `block` rows, from the rows' own entries.

    An entry has the rows of at most `ball` own entries: itself and those one bit apart. Where
    none of these has over block / ball rows it stays within `block`; so only the balls of
    larger ones are followed, and the other rows of such an entry fit in one more block.
    """
    flips = F.array(*[F.lit(x).cast("long") for x in (0, *(1 << k for k in range(ball - 1)))])
    return (
        own.groupBy("segment", "entry").agg(F.count("*").alias("n")).where(F.col("n") > block // ball)
        .select("segment", "entry", "n", F.explode(flips).alias("flip"))
        .groupBy("segment", F.col("entry").bitwiseXOR(F.col("flip")).alias("entry"))
        .agg((F.ceil(F.sum("n") / block) + 1).cast("int").alias("blocks"))
    )


def links(rows: DataFrame, node: str, lanes: list[str], distance: int, block: int = BLOCK, own: DataFrame | None = None, ball: int = 1) -> DataFrame:
    """(a, b): links between nodes; all that share an entry within `distance` bits are connected through them.

    rows: segment, entry, node and lanes; own: of these, those that are no probes, where others
    probe `ball` entries. Each table entry is compared in one task, in blocks and pairs of blocks
    where it may have more than `block` rows; a task passes on only as many links as span what it
    found.
    """
    blocks = large_entries(rows if own is None else own, ball, block)
    sorted_rows = in_blocks(rows.select("segment", "entry", node, *lanes), ["segment", "entry"], node, blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, forest = np.empty((5 + len(lanes), 0), np.int64), Forest()

        def found(rows: np.ndarray, cuts: np.ndarray) -> pa.RecordBatch:
            pairs = []
            for k in np.flatnonzero(with_near_pair(rows[5:].view("<u8"), cuts, distance)):
                nodes, first = np.unique(rows[4, cuts[k] : cuts[k + 1]], return_index=True)
                if len(nodes) > 1:
                    pairs += linked_within(nodes, rows[5:, cuts[k] + first].T.copy().view("<u8"), distance)
            return forest.grown(pairs)

        for batch in batches:
            new = np.stack([np.asarray(c).astype(np.int64) for c in batch.columns])
            rows = np.concatenate([kept, new], axis=1)
            cuts = np.flatnonzero(np.r_[True, (rows[:4, 1:] != rows[:4, :-1]).any(0)]) if rows.shape[1] else np.array([0])
            kept = rows[:, cuts[-1] :]
            yield found(rows, cuts)
        if kept.shape[1]:
            yield found(kept, np.array([0, kept.shape[1]]))

    return sorted_rows.mapInArrow(run, "a long, b long")


def links_of_sets(sets: DataFrame, similarity: float, rows: int = SET_ROWS, size: int = SET_BYTES) -> DataFrame:
    """(a, b): links between nodes of a root; all with this Jaccard similarity are connected through them.

    sets: root, node, shingles (a shingle_set as bytes). Groups of over `rows` rows or `size`
    bytes are compared in blocks and pairs of blocks.
    """
    need = F.ceil(F.greatest(F.count("*") / rows, F.sum(F.octet_length("shingles")) / size)).cast("int")
    blocks = sets.groupBy("root").agg(F.least(need, F.count("*").cast("int")).alias("blocks")).where("blocks > 1")
    sorted_sets = in_blocks(sets.select("root", "node", "shingles"), ["root"], "node", blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, held, forest = None, [], [], Forest()

        def found() -> pa.RecordBatch:
            return forest.grown(linked_sets(np.array(nodes, np.int64), held, similarity) if len(nodes) > 1 else [])

        for batch in batches:
            roots, xs, ys, ids, values = (c.to_pylist() for c in batch.columns)
            for row, node, value in zip(zip(roots, xs, ys), ids, values):
                if row != key:
                    if len(nodes) > 1:
                        yield found()
                    key, nodes, held = row, [], []
                nodes.append(node)
                held.append(np.frombuffer(value, "<u8"))
        if len(nodes) > 1:
            yield found()

    return sorted_sets.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, n: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """place, doc_id, fp, component_id: one row per input row.

    Rows with the same fingerprint are one node, so copies cost one row each. component_id is
    the least doc_id that links of at most `distance` bits reach (null if all are null). Null
    and empty texts have the fingerprint zero and are linked like any other; repeated rows
    share a component; other columns are ignored; an empty table gives no rows.
    """
    if not 0 <= distance <= 3:
        raise ValueError("two segments with balls of radius 1 serve distances up to 3")
    rows = written(fingerprints(docs, n))
    prints = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = links(index_rows(prints).withColumn("lane", F.col("fp")), "fp", ["lane"], distance, own=index_rows(prints, 33), ball=33)
    return _grouped(rows, prints, found, "fp", ["fp"]).select("place", "doc_id", "fp", "component_id")


def _grouped(rows: DataFrame, prints: DataFrame, found: DataFrame, node: str, key: list[str]) -> DataFrame:
    """rows with root and component_id: the least of `least` of the prints (one for each key) that links connect."""
    roots = components(found).withColumnRenamed("node", node)
    placed = prints.join(roots, node, "left").select(*key, "least", F.coalesce("root", node).alias("root"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(placed.join(least, "root").select(*key, "root", "component_id"), key)


def _similar(placed: DataFrame, n: int, similarity: float) -> DataFrame:
    """similar_groups of a written table (place, doc_id, text), with root: a number of the group."""
    bits = 64 * LANES
    apart = math.acos(2 * similarity / (1 + similarity)) / math.pi
    most = math.ceil(bits * apart + 3 * math.sqrt(bits * apart * (1 - apart)))
    lanes = [f"p{p}_l{k}" for p in range(len(PRINT_WORDS)) for k in range(LANES)]

    def start_prints():
        def work(places, ids, texts):
            texts = bytes_of(texts)
            wide = np.array([[v for n in PRINT_WORDS for v in wide_fingerprint(w, n)] for w in map(word_hashes, texts)], np.uint64).reshape(-1, len(lanes))
            same = np.array([xxhash.xxh64_intdigest(b" ".join(x.lower().split()), SEED) for x in texts], np.uint64)
            return [places, ids, *(x.copy().view("<i8") for x in (same, *wide.T))]

        return work

    def start_sets():
        def work(roots, nodes, texts):
            return [roots, nodes, [shingle_set(x, n).tobytes() for x in bytes_of(texts)]]

        return work

    key = ["same", *lanes]
    rows = written(arrow_map(placed, ["place", "doc_id", "text"], "place long, doc_id long, " + ", ".join(f"{x} long" for x in key), start_prints))
    prints = written(rows.groupBy(*key).agg(F.min("place").alias("node"), F.min("doc_id").alias("least")))
    near = written(components(similar_links(prints, most, route_bits(prints.count()))))
    texts = placed.join(near.withColumnRenamed("node", "place"), "place")
    sets = written(arrow_map(texts, ["root", F.col("place").alias("node"), "text"], "root long, node long, shingles binary", start_sets))
    return _grouped(rows, prints, links_of_sets(sets, similarity), "node", key).select("place", "doc_id", "root", "component_id")


def _narrow(docs: DataFrame, place: str) -> DataFrame:
    return docs.select(F.col(place).alias("place"), F.col("doc_id").cast("long").alias("doc_id"), "text")


def similar_groups(docs: DataFrame, n: int = SIMILAR_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """place, doc_id, component_id: one row per input row, as near_duplicates, but linked by similarity.

    Texts are linked if the Jaccard similarity of their sets of n-word shingles (A-Z in lower
    case; fewer words: the whole sequence) is `similarity` or more. Prints propose the groups in
    which sets are compared, so no pair below it is linked. A pair above it is missed if neither
    of its prints meets the index (at most two differing bits in one of six segments; see
    entries_of) within the number of differing bits that such a pair has at three standard
    deviations. Texts without words are equal. Nulls, repeated rows, other columns, whatever
    their names, and empty tables are treated as there.
    """
    place = unused("place", docs.columns)
    return _similar(written(_narrow(docs.withColumn(place, F.monotonically_increasing_id()), place)), n, similarity).drop("root")


def drop_near_duplicates(docs: DataFrame, n: int = SIMILAR_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs, one of each group of similar texts: of least doc_id, and of its repeats the first.

    All columns stay as they are, whatever their names. Null and empty texts are one group; null
    ids come after others; an empty table stays empty. The rows are numbered in a written table,
    so that numbers hold when executors are lost.
    """
    mark = unused("place", docs.columns)
    placed = written(docs.withColumn(mark, F.monotonically_increasing_id()))
    found = written(_similar(_narrow(placed, mark), n, similarity))
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "place")).alias("m"))
    gone = written(found.select("place").join(first.select(F.col("m.place").alias("place")), "place", "left_anti"))
    return placed.join(gone.withColumnRenamed("place", mark), mark, "left_anti").select(*map(quoted, docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
