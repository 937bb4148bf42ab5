"""Jaccard join of word n-grams: R-trees over vectors of group counts.

The distinct shingles of a text are hashed into groups, and the counts of its groups are a point.
Two texts share at most the sum of the smaller coordinate of each group, so the corners of an
R-tree's boxes bound what any point inside can share; pairs that pass are compared exactly.

One tree over a corpus prunes little: counts of long texts lie close together in every few
coordinates. So texts are first dealt to trees by shingles that similar ones must have in common:
of a text's shingles in one order for all, rare ones first, the first few that it cannot do without.
What passes in the trees is connected, and compared exactly, again by trees, with the sets at hand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Forest, arrow_map, bytes_of, components, read_table, written
from .simhash import in_blocks, joined_hashes

WORDS = 4
PERCENT = 85
#: Counters of how often shingles occur: they only order shingles, so their number bounds no result.
SLOTS, SLOT_BLOCK = 1 << 20, 1 << 14
#: Bits of the filter that finds candidates' texts; too many candidates only let more texts through.
FILTER_BITS = 26
#: Distinct texts that a task remembers, so as to send copies on once.
REMEMBERED = 1 << 17
#: Texts and bytes of one tree and what is searched in it; larger groups are cut in blocks.
TREE_ROWS, TREE_BYTES = 1024, 8 << 20
#: Texts of a route whose set is told from others; routes of more are passed on as they are.
ROUTE_TEXTS = 4096
#: Points of a leaf, children of a box, and shingles for each group.
LEAF, FAN, GROUPED = 16, 8, 8
#: Bytes that are hashed at once.
CHUNK = 4 << 20
#: Bytes to lower-case letters, spaces and others.
LOWER = bytes(32 if b in b" \t\n\v\f\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))


class Words:
    """Hashes of the words of texts, of all bytes at once.

    A word is the sum of its bytes' random numbers times powers of an odd number, so it is the
    difference of two running sums, brought to the same power by the inverse.
    """

    ODD = 0x9E3779B97F4A7C15

    def __init__(self):
        self.of_byte = np.random.default_rng(42).integers(1, 1 << 64, 256, np.uint64)
        self.up = self.down = np.empty(0, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            self.up, self.down = (np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, x, np.uint64)]) for x in (self.ODD, pow(self.ODD, -1, 1 << 64)))

    def _hashed(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self._powers(len(raw))
        inside = np.r_[False, raw != 32, False]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        sums = np.r_[np.uint64(0), np.cumsum(self.of_byte[raw] * self.up[: len(raw)], dtype=np.uint64)]
        h = (sums[ends] - sums[starts]) * self.down[starts]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32)), starts

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        """For each text the hashes of its words, A-Z in lower case."""
        raw = b" ".join(texts).translate(LOWER)
        hashes, starts, at = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
        while at < len(raw):
            end = len(raw) if len(raw) - at <= CHUNK else raw.rfind(b" ", at, at + CHUNK)
            end = end if end > at else raw.find(b" ", at + 1)
            end = end if end > at else len(raw)
            h, start = self._hashed(np.frombuffer(raw, np.uint8, end - at, at))
            hashes.append(h)
            starts.append(start + at)
            at = end
        first = np.cumsum([0, *(len(t) + 1 for t in texts)])
        cuts = np.searchsorted(np.concatenate(starts), first)
        whole = np.concatenate(hashes)
        return [whole[a:b] for a, b in zip(cuts, cuts[1:])]


def text_key(words: np.ndarray) -> bytes:
    """128 bits that tell texts with different words apart."""
    return xxhash.xxh3_128_digest(words.tobytes())


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """The distinct hashes of the n-word shingles in order; of the whole sequence if it has fewer words; none for none."""
    return np.unique(joined_hashes(words, n))


def group_of(hashes: np.ndarray, groups: int | np.ndarray) -> np.ndarray:
    """The group of each hash, of a power of two: half as many groups join each with the one that follows by half."""
    return ((hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & (groups - 1)


def counted(found: np.ndarray) -> np.ndarray:
    """The point of a set: how many hashes are in each group; about GROUPED in each."""
    groups = max(8, 1 << (len(found) // GROUPED).bit_length())
    return np.bincount(group_of(found, groups), minlength=groups)


def packed(point: np.ndarray) -> bytes:
    """A point in one byte for each group, or in four where a count needs them; the first byte says which."""
    wide = 1 if point.max() < 256 else 4
    return bytes([wide]) + point.astype(f"<u{wide}").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def folded(point: np.ndarray, groups: int) -> np.ndarray:
    return point.reshape(-1, groups).sum(0)


def least_common(a, b, percent: int):
    """How many shingles sets of sizes a and b share at least if they are similar."""
    return -((-percent * (a + b)) // (100 + percent))


class CountTree:
    """An R-tree over vectors of group counts, packed from the top: halves by the coordinate of greatest spread."""

    def __init__(self, points: np.ndarray, percent: int):
        self.points, self.sizes, self.percent = points, points.sum(1), percent
        order, cuts, todo = [], [], [np.arange(len(points))]
        while todo:
            rows = todo.pop()
            if len(rows) <= LEAF:
                cuts.append(len(order))
                order.extend(rows)
                continue
            spread = points[rows]
            widest = np.argmax(spread.max(0) - spread.min(0))
            rows = rows[np.argsort(spread[:, widest], kind="stable")]
            todo += [rows[len(rows) // 2 :], rows[: len(rows) // 2]]
        self.order = np.array(order, np.int64)
        #: From the leaves up: the first child of each box, its upper corner and its smallest size.
        self.levels, starts = [], np.array(cuts, np.int64)
        top, least = points[self.order], self.sizes[self.order]
        while True:
            top, least = np.maximum.reduceat(top, starts), np.minimum.reduceat(least, starts)
            self.levels.append((np.r_[starts, len(self.order) if not self.levels else len(self.levels[-1][1])], top, least))
            if len(starts) <= FAN:
                break
            starts = np.arange(0, len(starts), FAN)

    def near(self, point: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The rows, of those in the mask `left`, that may be similar to a point."""
        size, boxes = int(point.sum()), np.arange(len(self.levels[-1][1]))
        for first, top, least in reversed(self.levels):
            shared = np.minimum(top[boxes], point).sum(1)
            boxes = boxes[shared >= least_common(size, least[boxes], self.percent)]
            spans = [np.arange(first[b], first[b + 1]) for b in boxes]
            boxes = np.concatenate(spans) if spans else np.empty(0, np.int64)
        rows = self.order[boxes]
        rows = rows[left[rows]]
        shared = np.minimum(self.points[rows], point).sum(1)
        return rows[shared >= least_common(size, self.sizes[rows], self.percent)]


def spanned(nodes: np.ndarray, tree: CountTree, sure=None) -> list[tuple[int, int]]:
    """Links that span the same components as all pairs that a tree lets pass, and that `sure` (row, rows) confirms."""
    left, out = np.ones(len(nodes), bool), []
    for begin in range(len(nodes)):
        if not left[begin]:
            continue
        left[begin], todo = False, [begin]
        while todo:
            one = todo.pop()
            found = tree.near(tree.points[one], left)
            if sure is not None and len(found):
                found = sure(one, found)
            left[found] = False
            out += [(int(nodes[one]), int(nodes[k])) for k in found]
            todo.extend(found)
    return out


def linked_points(nodes: np.ndarray, points: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that connect all pairs whose points may be of similar sets.

    Similar sets differ little in size, so one has as many groups as the other or twice as many.
    """
    out, groups = [], np.array([len(p) for p in points])
    for g in np.unique(groups) if percent > 50 else [groups.min()]:
        rows = np.flatnonzero((groups == g) | (groups == 2 * g)) if percent > 50 else np.arange(len(points))
        if len(rows) > 1:
            out += spanned(nodes[rows], CountTree(np.stack([folded(points[k], g) for k in rows]), percent))
    return out


def linked(nodes: np.ndarray, sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that span the same components as all pairs of sets (not empty) that are similar."""
    sizes = np.array([len(s) for s in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts, mark = np.cumsum(sizes) - sizes, np.zeros(ids.max() + 1, np.int64)
    groups = max(8, 1 << (int(np.median(sizes)) // GROUPED).bit_length())

    def sure(one: int, found: np.ndarray) -> np.ndarray:
        own = ids[starts[one] : starts[one] + sizes[one]]
        mark[own] = 1
        flat = np.concatenate([ids[starts[k] : starts[k] + sizes[k]] for k in found])
        common = np.add.reduceat(mark[flat], np.cumsum(sizes[found]) - sizes[found])
        mark[own] = 0
        return found[common >= least_common(sizes[one], sizes[found], percent)]

    points = np.stack([np.bincount(group_of(s, groups), minlength=groups) for s in sets])
    return spanned(nodes, CountTree(points, percent), sure)


class Once:
    """Tells whether a task meets a text for the first time, as far as it remembers."""

    def __init__(self):
        self.seen: set[bytes] = set()

    def new(self, key: bytes) -> bool:
        if key in self.seen:
            return False
        if len(self.seen) >= REMEMBERED:
            self.seen.clear()
        self.seen.add(key)
        return True


def measured(docs: DataFrame, n: int) -> DataFrame:
    """One written pass: place, doc_id, size, t0, t1 and point of each text; and blocks of counters of shingles (block, counts).

    A text that its task has met before has no point.
    """

    def start():
        slots, once, hashed = np.zeros(SLOTS, np.int32), Once(), Words()

        def work(*columns):
            if not columns:
                held = slots.reshape(-1, SLOT_BLOCK)
                used = np.flatnonzero(held.any(1))
                return [*([None] * len(used) for _ in range(6)), used, [held[k].tobytes() for k in used]] if len(used) else None
            places, ids, texts = columns
            sizes, keys, points = [], [], []
            for words in hashed(bytes_of(texts)):
                keys.append(text_key(words))
                found = shingles(words, n)
                sizes.append(len(found))
                points.append(None)
                if once.new(keys[-1]):
                    points[-1] = packed(counted(found)) if len(found) else None
                    np.add.at(slots, (found >> np.uint64(44)).astype(np.int64), 1)
            none = [None] * len(sizes)
            t = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
            return [places, ids, sizes, t[:, 0].copy(), t[:, 1].copy(), points, none, none] if sizes else None

        return work

    rows = docs.select(F.monotonically_increasing_id().alias("place"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "place long, doc_id long, size long, t0 long, t1 long, point binary, block int, counts binary"
    return written(arrow_map(rows, ["place", "doc_id", "text"], schema, start, finish=True))


def slot_counts(table: DataFrame) -> np.ndarray:
    """The sum of all counters, which the driver gets: SLOTS numbers at any size of the corpus."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(*(c.to_pylist() for c in batch.columns)):
                held[block] = held.get(block, 0) + np.frombuffer(counts, np.int32).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], ["block", "counts"])

    out = np.zeros((SLOTS // SLOT_BLOCK, SLOT_BLOCK), np.int64)
    parts = table.where("block is not null").select("block", "counts").repartition("block").mapInArrow(summed, "block int, counts binary")
    for row in parts.toLocalIterator():
        out[row["block"]] = np.frombuffer(row["counts"], np.int64)
    return out.ravel()


def routes(docs: DataFrame, slots: np.ndarray, n: int, percent: int) -> DataFrame:
    """(route, t0): the shingles of which a similar text must have one; rare ones, as the counters tell.

    A similar text shares at least ceil(percent * size / 100) of a set's shingles. So, with all sets
    in one order, two similar ones share a shingle among their first size - that + 1.
    """
    shared = docs.sparkSession.sparkContext.broadcast(slots.astype(np.float32))

    def start():
        counts, once, hashed = shared.value, Once(), Words()

        def work(texts):
            out, owner = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            for words in hashed(bytes_of(texts)):
                key = text_key(words)
                if not len(words) or not once.new(key):
                    continue
                found = shingles(words, n)
                first = len(found) + (-percent * len(found)) // 100 + 1
                rank = np.lexsort((found, counts[(found >> np.uint64(44)).astype(np.int64)]))
                out.append(found[rank[:first]])
                owner.append(np.full(first, np.frombuffer(key, "<i8")[0]))
            return [np.concatenate(out).view("<i8"), np.concatenate(owner)]

        return work

    return arrow_map(docs, ["text"], "route long, t0 long", start)


def route_groups(rows: DataFrame) -> DataFrame:
    """(root, t0): the texts of each route that has several; routes with the same texts are one.

    A task reads its routes sorted and holds ROUTE_TEXTS texts of one; a longer one is passed on as it is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, route, held, more = Once(), None, [], False
        out: tuple[list, list] = ([], [])

        def give(name: int) -> None:
            out[0].extend([name] * len(held))
            out[1].extend(held)

        def closed() -> None:
            if more:
                give(route)
            elif len(held) > 1:
                key = xxhash.xxh3_128_digest(np.array(held, np.int64).tobytes())
                if once.new(key):
                    give(int(np.frombuffer(key, "<i8")[0]))

        for batch in batches:
            for own, text in zip(*(c.to_pylist() for c in batch.columns)):
                if own != route:
                    closed()
                    route, held, more = own, [], False
                if not held or held[-1] != text:
                    if len(held) == ROUTE_TEXTS:
                        give(route)
                        held, more = [], True
                    held.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["root", "t0"])
            out = ([], [])
        closed()
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["root", "t0"])

    return rows.repartition("route").sortWithinPartitions("route", "t0").mapInArrow(run, "root long, t0 long").distinct()


def grouped_links(dealt: DataFrame, links) -> DataFrame:
    """(a, b) of rows of in_blocks (root, x, y, node, value): links(nodes, values) of each block or pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, forest = None, {}, Forest()

        def found() -> pa.RecordBatch:
            return forest.grown(links(np.array(list(held), np.int64), list(held.values())) if len(held) > 1 else [])

        for batch in batches:
            roots, xs, ys, nodes, values = (c.to_pylist() for c in batch.columns)
            for key, node, value in zip(zip(roots, xs, ys), nodes, values):
                if key != group:
                    if len(held) > 1:
                        yield found()
                    group, held = key, {}
                held[node] = value
        if len(held) > 1:
            yield found()

    return dealt.select("root", "x", "y", "node", "value").mapInArrow(run, "a long, b long")


def candidate_links(groups: DataFrame, points: DataFrame, percent: int, rows: int = TREE_ROWS) -> DataFrame:
    """(a, b): links that connect all texts of a group (root, t0) whose points (t0, point) may be of similar sets."""
    table = written(groups.join(points, "t0").select("root", F.col("t0").alias("node"), F.col("point").alias("value")))
    blocks = table.groupBy("root").agg(F.ceil(F.count("*") / rows).cast("int").alias("blocks")).where("blocks > 1")
    return grouped_links(in_blocks(table, ["root"], "node", blocks), lambda nodes, values: linked_points(nodes, list(map(unpacked, values)), percent))


def texts_of(docs: DataFrame, near: DataFrame) -> DataFrame:
    """(t0, t1, text): texts whose t0 is in near, and a few others that its filter lets through.

    The filter is a map of 2^FILTER_BITS bits, one for each of the first bits of t0.
    """
    word = F.shiftrightunsigned("t0", 64 - FILTER_BITS + 6).cast("int")
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(t0, {64 - FILTER_BITS}) & 63 as int))")
    held = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    rows = near.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    held[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(held)

    def start():
        bits, once, hashed = shared.value.view(np.uint64), Once(), Words()

        def work(texts):
            out, texts = [], bytes_of(texts)
            for words, text in zip(hashed(texts), texts):
                key = text_key(words)
                at = int.from_bytes(key[:8], "little") >> (64 - FILTER_BITS)
                if int(bits[at >> 6]) >> (at & 63) & 1 and once.new(key):
                    out.append((*np.frombuffer(key, "<i8").tolist(), text))
            return list(zip(*out)) if out else None

        return work

    return arrow_map(docs, ["text"], "t0 long, t1 long, text binary", start)


def verified_links(texts: DataFrame, n: int, percent: int, rows: int = TREE_ROWS, size: int = TREE_BYTES) -> DataFrame:
    """(a, b): links between the nodes of a root (root, node, text); all similar ones are connected through them.

    Roots of more than `rows` texts or `size` bytes are compared in blocks and pairs of blocks, each in
    a tree of its own; a task passes on as many links as span what it found.
    """
    need = F.ceil(F.greatest(F.count("*") / rows, F.sum(F.octet_length("text")) / size)).cast("int")
    blocks = texts.groupBy("root").agg(F.least(need, F.count("*").cast("int")).alias("blocks")).where("blocks > 1")
    dealt = in_blocks(texts.select("root", "node", F.col("text").alias("value")), ["root"], "node", blocks)

    def links(nodes: np.ndarray, values: list[bytes]) -> list[tuple[int, int]]:
        return linked(nodes, [shingles(w, n) for w in Words()(values)], percent)

    return grouped_links(dealt, links)


def similar_texts(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per input row.

    Two rows are linked if their sets of distinct n-word shingles (A-Z in lower case; fewer words: the
    whole sequence) have a Jaccard similarity of `percent` or more; component_id is the least doc_id
    that links reach (null if all are null). Every such pair is connected, however large its group.
    Null texts and texts without words have no shingles and are linked with nothing, not even with
    each other. Repeated rows share a component; other columns are ignored, whatever their names;
    an empty table gives no rows.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent must be from 1 to 100")
    docs = docs.select("doc_id", "text")
    table = measured(docs, n)
    rows = table.where("place is not null").drop("point", "block", "counts")
    prints = written(rows.where("size > 0").groupBy("t0", "t1").agg(F.min("place").alias("node"), F.min("doc_id").alias("least")))
    points = table.where("point is not null").groupBy("t0").agg(F.first("point").alias("point"))
    groups = route_groups(routes(docs, slot_counts(table), n, percent))
    near = written(components(candidate_links(groups, points, percent))).select(F.col("node").alias("t0"), "root")
    known = prints.select("t0", "t1", "node").join(near, "t0")
    texts = written(texts_of(docs, near).join(known, ["t0", "t1"]).select("root", "node", "text"))
    roots = components(verified_links(texts, n, percent))
    joined = prints.join(roots, "node", "left").select("t0", "t1", "least", F.coalesce("root", "node").alias("root"))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    found = joined.join(least, "root").select("t0", "t1", "component_id")
    alone = rows.where("size = 0").select("doc_id", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return rows.where("size > 0").join(found, ["t0", "t1"]).select("doc_id", F.col("size").alias("n_shingles"), "component_id").union(alone)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_texts(read_table(spark, sf_dir, "documents"))


#: Pairs are counted over shared shingles of different sets, so copies are not expanded.
ORACLE = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select doc_id, case when len(ws) = 0 then [] when len(ws) < 4 then [array_to_string(ws, ' ')]
    else list_sort(list_distinct([ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] for i in range(1, len(ws) - 2)])) end as ss from w),
u as (select min(doc_id) as node, ss, len(ss) as n from s where len(ss) > 0 group by ss),
e as (select node, n, unnest(ss) as g from u),
p as (select a.node as a, b.node as b from e a join e b on a.g = b.g and a.node < b.node and 100 * a.n >= 85 * b.n and 100 * b.n >= 85 * a.n
    group by a.node, b.node, a.n, b.n having 185 * count(*) >= 85 * (a.n + b.n)),
l as (select a, b from p union all select b, a from p),
r(node, reached) as (select node, node from u union select r.node, l.b from r join l on l.a = r.reached),
c as (select node, min(reached) as component_id from r group by node)
select s.doc_id, len(s.ss)::bigint as n_shingles, coalesce(c.component_id, s.doc_id) as component_id
from s left join u on u.ss = s.ss left join c on c.node = u.node
"""
