"""Divergence of sources: how far the use of words in each source is from other sources, and from its language.

The kept terms of a language are a minimal acyclic transducer: an automaton whose outputs, summed
along a term, are the term's place in order. Texts are streamed through it once more, so counts are
kept by place, and places break ties.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.operators.numbering import placed

from .common import arrow_map, bytes_of, read_table, written
from .lexicon import frequent

#: Documents of a language that a kept term is in, at least.
LEAST_DOCS = 10
TOP = 10
SCALE = 1_000_000_000
#: UTF-8 bytes of a term, A-Z in lower case; all others are spaces.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Terms of the transducers that go to all tasks, and the bytes of the longest of them.
HEAD, LONGEST = 1 << 19, 64
#: Distinct terms, or counts, that a task gathers before it passes them on.
GATHER = 400_000
#: Places of one block of counts, and sources that are compared at once.
BLOCK, CHUNK = 4096, 64
TEXTS = 64


class Transducer:
    """Terms (bytes) -> numbers, as a minimal acyclic automaton with an output on each edge.

    Edges are a hash table from state and byte to the next state and the output.
    """

    def __init__(self, terms: list[bytes], numbers: np.ndarray):
        """terms in order, no two alike."""
        children, ends = [{}], [False]  # of the path of the last term; node 0 is the root
        known: dict[tuple, int] = {}
        self.final, self.below, edges = [], [], []
        self.numbers = np.asarray(numbers, np.int64)

        def settled(kids: dict[int, int], end: bool) -> int:
            """The state that accepts what a finished node accepts."""
            key = (end, *kids.items())
            state = known.get(key)
            if state is None:
                state = known[key] = len(self.final)
                passed = int(end)
                for byte, kid in kids.items():
                    edges.append((state << 8 | byte, kid, passed))
                    passed += self.below[kid]
                self.final.append(end)
                self.below.append(passed)
            return state

        path = b""  # byte k leads from node k to node k + 1
        for term in [*terms, b""]:
            same = 0
            while same < len(path) and same < len(term) and path[same] == term[same]:
                same += 1
            for k in range(len(path), same, -1):
                children[k - 1][path[k - 1]] = settled(children.pop(), ends.pop())
            children += [{} for _ in term[same:]]
            ends += [False] * (len(term) - same)
            if term:
                ends[-1] = True
            path = term
        self.root = settled(children[0], False)
        self.final = np.array(self.final)
        self._hashed(np.array(edges, np.int64).reshape(-1, 3))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)).astype(np.int64)

    def _hashed(self, edges: np.ndarray) -> None:
        bits = max(4, int(2 * len(edges)).bit_length())
        self.shift, mask = 64 - bits, (1 << bits) - 1
        self.keys, self.to, self.out = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int32)
        left, at, self.probes = np.arange(len(edges)), self._slot(edges[:, 0]), 0
        while len(left):
            self.probes += 1
            free = np.flatnonzero(self.keys[at] < 0)
            free = free[np.unique(at[free], return_index=True)[1]]  # one edge for each free place
            rows, spots = left[free], at[free]
            self.keys[spots], self.to[spots], self.out[spots] = edges[rows].T
            rest = np.ones(len(left), bool)
            rest[free] = False
            left, at = left[rest], (at[rest] + 1) & mask

    def _next(self, keys: np.ndarray) -> np.ndarray:
        """The places of edges, or -1."""
        at, mask = self._slot(keys), len(self.keys) - 1
        found = np.where(self.keys[at] == keys, at, -1)
        left = np.flatnonzero((found < 0) & (self.keys[at] >= 0))
        for _ in range(self.probes - 1):
            if not len(left):
                break
            at[left] = (at[left] + 1) & mask
            held = self.keys[at[left]]
            hit = held == keys[left]
            found[left[hit]] = at[left[hit]]
            left = left[~hit & (held >= 0)]
        return found

    def stream(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, numbers) of the terms of a text, bytes of LETTERS; -1 for terms that are not held.

        All terms walk at once, a byte a step; those without an edge stop.
        """
        inside = np.r_[False, text != 32, False]
        starts, ends = np.flatnonzero(~inside[:-1] & inside[1:]), np.flatnonzero(inside[:-1] & ~inside[1:])
        sizes, numbers = ends - starts, np.full(len(starts), -1, np.int64)
        alive = np.argsort(-sizes, kind="stable")
        state, total, step = np.full(len(alive), self.root, np.int64), np.zeros(len(alive), np.int64), 0
        while len(alive):
            going = np.searchsorted(-sizes[alive], -step, "left")  # those with a byte at this step
            done = np.flatnonzero(self.final[state[going:]]) + going
            numbers[alive[done]] = self.numbers[total[done]]
            alive, state, total = alive[:going], state[:going], total[:going]
            edge = self._next(state << 8 | text[starts[alive] + step])
            ok = edge >= 0
            alive, state, total = alive[ok], self.to[edge[ok]].astype(np.int64), total[ok] + self.out[edge[ok]]
            step += 1
        return starts, ends, numbers


def _filled(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns))


def document_counts(docs: DataFrame) -> DataFrame:
    """lang, term (binary), n: the documents of a language that each term is in."""

    def start():
        found: dict[str, Counter] = defaultdict(Counter)

        def take():
            rows = [(lang, term, n) for lang, c in found.items() for term, n in c.items()]
            found.clear()
            return list(zip(*rows)) if rows else None

        def work(*columns):
            if not columns:
                return take()
            for lang, text in zip(columns[0].to_pylist(), bytes_of(columns[1])):
                found[lang].update(set(text.translate(LETTERS).split()))
            return take() if sum(map(len, found.values())) > GATHER else None

        return work

    parts = arrow_map(docs, ["lang", "text"], "lang string, term binary, n long", start, finish=True)
    return parts.groupBy("lang", "term").agg(F.sum("n").alias("n"))


def kept_terms(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """lang, term, n, ord: the terms in at least so many documents of a language, with their places from 0 in order of UTF-8."""
    kept = placed(document_counts(docs).where(F.col("n") >= least), ["term"], "place", ["lang"])
    return kept.select("lang", "term", "n", (F.col("place") - 1).alias("ord"))


def head_transducers(terms: DataFrame) -> dict[str, Transducer]:
    """A transducer for each language; terms (lang, term, ord) are bounded, and each language's is built in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, transducer in _built(batches):
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([_packed(transducer)], pa.binary())], ["lang", "parts"])

    rows = terms.select("lang", "term", "ord").repartition("lang").sortWithinPartitions("lang", "term").mapInArrow(run, "lang string, parts binary")
    return {r["lang"]: _unpacked(r["parts"]) for r in rows.collect()}


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Transducer]]:
    """A transducer of each language of rows (lang, term, ord) sorted by lang and term."""
    own, terms, numbers = None, [], []
    for batch in batches:
        for lang, term, number in zip(*(c.to_pylist() for c in batch.columns)):
            if lang != own and terms:
                yield own, Transducer(terms, numbers)
                terms, numbers = [], []
            own = lang
            terms.append(term)
            numbers.append(number)
    if terms:
        yield own, Transducer(terms, numbers)


#: What makes up a transducer, with its type.
PARTS = (("keys", np.int64), ("to", np.int32), ("out", np.int32), ("final", np.bool_), ("numbers", np.int64))


def _packed(t: Transducer) -> bytes:
    arrays = [np.asarray(getattr(t, name), kind) for name, kind in PARTS]
    head = np.array([t.root, t.shift, t.probes, *map(len, arrays)], np.int64)
    return head.tobytes() + b"".join(a.tobytes() for a in arrays)


def _unpacked(raw: bytes) -> Transducer:
    t = Transducer.__new__(Transducer)
    head = np.frombuffer(raw, np.int64, 3 + len(PARTS)).tolist()
    (t.root, t.shift, t.probes), at = head[:3], 8 * len(head)
    for (name, kind), size in zip(PARTS, head[3:]):
        setattr(t, name, np.frombuffer(raw, kind, size, at))
        at += size * np.dtype(kind).itemsize
    return t


class Gathered:
    """Counts by language, source and place, passed on as blocks of places: lang, source, block, ats, counts."""

    def __init__(self, block: int):
        self.held: dict[tuple, list] = defaultdict(list)
        self.size, self.block = 0, block

    def add(self, key: tuple, numbers: np.ndarray, times: np.ndarray | None = None) -> None:
        found, at = np.unique(numbers, return_inverse=True)
        self.held[key].append((found, np.bincount(at, times).astype(np.int64)))
        self.size += len(found)

    def take(self) -> list[list]:
        out = [[], [], [], [], []]
        for (lang, source), parts in self.held.items():
            found, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            n = np.zeros(len(found), np.int64)
            np.add.at(n, at, np.concatenate([p[1] for p in parts]))
            starts = np.flatnonzero(np.r_[True, found[1:] // self.block != found[:-1] // self.block, True]) if len(found) else []
            for a, b in zip(starts, starts[1:]):
                for column, value in zip(out, (lang, source, int(found[a]) // self.block, (found[a:b] % self.block).astype(np.uint16).tobytes(), n[a:b].tobytes())):
                    column.append(value)
        self.held.clear()
        self.size = 0
        return out


COUNTS = "lang string, source string, block long, ats binary, counts binary"


def recounted(docs: DataFrame, kept: DataFrame, head: int = HEAD) -> DataFrame:
    """lang, source, block, ats, counts: occurrences of kept terms in texts streamed through the transducers.

    The terms of most documents, at most `head` and none longer than LONGEST bytes, are in transducers
    that go to all tasks. If there are others, terms that these do not hold are counted and
    shuffled to the task that builds a transducer of its share of the others.
    """
    short = kept.where(F.octet_length("term") <= LONGEST)
    top = written(frequent(short, head))
    shared = docs.sparkSession.sparkContext.broadcast(head_transducers(top))
    rest = kept.join(top.select("lang", "term"), ["lang", "term"], "left_anti").select("lang", "term", "ord")
    rest = written(rest)
    whole = rest.isEmpty()

    def start():
        gathered, others, known = Gathered(BLOCK), Counter(), shared.value

        def take():
            out = gathered.take()
            blank, none = [None] * len(others), [None] * len(out[0])
            langs, sources, terms = map(list, zip(*others)) if others else ([], [], [])
            more = [langs, sources, blank, blank, blank, terms, list(others.values())]
            others.clear()
            return [a + b for a, b in zip([*out, none, none], more)] if out[0] or langs else None

        def work(*columns):
            if not columns:
                return take()
            groups = defaultdict(list)
            for lang, source, text in zip(columns[0].to_pylist(), columns[1].to_pylist(), bytes_of(columns[2])):
                groups[lang, source].append(text)
            for (lang, source), texts in groups.items():
                raw = b" ".join(texts).translate(LETTERS)
                if lang in known:
                    starts, ends, numbers = known[lang].stream(np.frombuffer(raw, np.uint8))
                    gathered.add((lang, source), numbers[numbers >= 0])
                    if not whole:
                        gone = np.flatnonzero(numbers < 0)
                        others.update((lang, source, raw[a:b]) for a, b in zip(starts[gone].tolist(), ends[gone].tolist()))
                elif not whole:
                    others.update((lang, source, term) for term in raw.split())
            return take() if gathered.size + len(others) > 4 * GATHER else None

        return work

    parts = arrow_map(docs, ["lang", "source", "text"], f"{COUNTS}, term binary, n long", start, rows=TEXTS, finish=True)
    if whole:
        return parts.drop("term", "n")
    parts = written(parts)

    def tail(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a task by language, its terms before what was counted of them."""
        gathered, own, terms, numbers, built = Gathered(BLOCK), None, [], [], None

        def taken() -> pa.RecordBatch:
            types = (pa.string(), pa.string(), pa.int64(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(gathered.take(), types)], ["lang", "source", "block", "ats", "counts"])

        for batch in batches:
            for lang, term, number, source, n in zip(*(c.to_pylist() for c in batch.columns)):
                if lang != own:
                    own, terms, numbers, built = lang, [], [], None
                if number is not None:
                    terms.append(term)
                    numbers.append(number)
                elif terms:
                    built = built or Transducer(terms, numbers)
                    found = built.stream(np.frombuffer(term, np.uint8))[2]
                    if found[0] >= 0:
                        gathered.add((lang, source), found, np.array([n]))
            if gathered.size > GATHER:
                yield taken()
        yield taken()

    found = parts.where("term is not null").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"))
    found = found.select("lang", "term", F.lit(None).cast("long").alias("ord"), "source", "n")
    both = rest.select("lang", "term", "ord", F.lit(None).cast("string").alias("source"), F.lit(0).cast("long").alias("n")).union(found)
    spread = both.repartition("lang", "term").sortWithinPartitions("lang", F.col("ord").isNull(), "term")
    return parts.where("term is null").drop("term", "n").union(spread.mapInArrow(tail, COUNTS))


def summed(parts: DataFrame) -> DataFrame:
    """lang, source, block, ats, counts, total: one row for each block of a source, and one of the whole language (null source)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, key, own, everything = [], None, np.zeros(BLOCK, np.int64), np.zeros(BLOCK, np.int64)

        def row(lang, source, block, counts) -> None:
            at = np.flatnonzero(counts)
            out.append((lang, source, block, at.astype(np.uint16).tobytes(), counts[at].tobytes(), int(counts.sum())))

        def closed(new: tuple | None) -> None:
            """Ends a source, and a block where the next row is of another."""
            nonlocal own, everything
            if key is not None and key != new:
                row(key[0], key[2], key[1], own)
                everything = everything + own
                own = np.zeros(BLOCK, np.int64)
                if new is None or key[:2] != new[:2]:
                    row(key[0], None, key[1], everything)
                    everything = np.zeros(BLOCK, np.int64)

        def taken() -> pa.RecordBatch:
            types = (pa.string(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.int64())
            batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], ["lang", "source", "block", "ats", "counts", "total"])
            out.clear()
            return batch

        for batch in batches:
            for lang, source, block, ats, counts in zip(*(c.to_pylist() for c in batch.columns)):
                new = (lang, block, source)
                closed(new)
                key = new
                own[np.frombuffer(ats, np.uint16)] += np.frombuffer(counts, np.int64)
            yield taken()
        closed(None)
        yield taken()

    return parts.repartition("lang", "block").sortWithinPartitions("lang", "block", "source").mapInArrow(run, f"{COUNTS}, total long")


def shares(counts: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / size), exactly: three long divisions by a thousandth each. size is at least count + 2."""
    rest, out = counts + 2, 0
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // size
        rest = rest % size
    return out + 1


def differences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _pair_rows(groups: DataFrame, sums: DataFrame) -> DataFrame:
    """lang, a, b, value: of each two sources of a language (by place, a < b), the differences summed over all kept terms.

    Sources are compared in chunks, and terms in blocks, so that a task holds two chunks of one block.
    """
    chunks = groups.groupBy("lang").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    own = F.floor((F.col("place") - 1) / CHUNK).cast("int")
    rows = (
        groups.where("terms > 0").join(chunks, "lang")
        .select("lang", "source", "place", "size", "terms", "chunks", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(terms - 1) div {BLOCK}"))).alias("block"))
        .join(sums.where("source is not null").select("lang", "source", "block", "ats", "counts"), ["lang", "source", "block"], "left")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("lang", "block", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "place", "size", "terms", "ats", "counts")
    )

    def compared(lang: str, block: int, x: int, y: int, rows: list[tuple]) -> Iterator[tuple]:
        width = min(BLOCK, rows[0][3] - block * BLOCK)
        p = np.zeros((len(rows), width), np.int64)
        for k, (_, _, _, _, ats, counts) in enumerate(rows):
            if ats is not None:
                p[k, np.frombuffer(ats, np.uint16)] = np.frombuffer(counts, np.int64)
        p = shares(p, np.array([r[2] for r in rows])[:, None])
        owners, places = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        for k in np.flatnonzero(owners == x):
            others = np.flatnonzero((owners == y) & (places > places[k]))
            value = differences(p[k], p[others]).sum(1)
            yield from ((lang, int(places[k]), int(places[o]), int(v)) for o, v in zip(others, value))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []

        def taken() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["lang", "a", "b", "value"])
            out.clear()
            return batch

        for batch in batches:
            for *new, own, place, size, terms, ats, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if new != key:
                    if held:
                        out.extend(compared(*key, held))
                        yield taken()
                    key, held = new, []
                held.append((own, place, size, terms, ats, counts))
        if held:
            out.extend(compared(*key, held))
            yield taken()

    dealt = rows.repartition("lang", "block", "x", "y").sortWithinPartitions("lang", "block", "x", "y")
    return dealt.mapInArrow(run, "lang string, a long, b long, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def _term_rows(groups: DataFrame, langs: DataFrame, sums: DataFrame, top: int) -> DataFrame:
    """lang, source, ord, value: terms that a source uses more than its language, of each block the `top` of largest value."""
    whole = sums.where("source is null").select("lang", "block", F.col("ats").alias("all_ats"), F.col("counts").alias("all_counts"))
    own = sums.where("source is not null and total > 0").select("lang", "source", "block", "ats", "counts").join(whole, ["lang", "block"])
    rows = own.join(groups.select("lang", "source", "size"), ["lang", "source"]).join(langs.select("lang", F.col("size").alias("all_size")), "lang")

    def start():
        def work(*columns):
            out = []
            for lang, source, block, ats, counts, all_ats, all_counts, size, all_size in zip(*(c.to_pylist() for c in columns)):
                at = np.frombuffer(ats, np.uint16)
                every = np.zeros(BLOCK, np.int64)
                every[np.frombuffer(all_ats, np.uint16)] = np.frombuffer(all_counts, np.int64)
                p, q = shares(np.frombuffer(counts, np.int64), size), shares(every[at], all_size)
                more = np.flatnonzero(p > q)
                value = differences(p[more], q[more])
                best = np.lexsort((at[more], -value))[:top]
                out += [(lang, source, block * BLOCK + int(at[more[k]]), int(value[k])) for k in best]
            return list(zip(*out)) if out else None

        return work

    return arrow_map(rows, ["lang", "source", "block", "ats", "counts", "all_ats", "all_counts", "size", "all_size"], "lang string, source string, ord long, value long", start)


def divergence(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP, head: int = HEAD) -> DataFrame:
    """lang, source, part, item, value, rank: how the sources of each language differ in their use of its kept terms.

    Kept are the terms (letters and all that is not ASCII; only A-Z in lower case) in at least `least`
    documents of a language. With count 2 added to each, a group's share of a term is p, scaled to
    integers, and two shares differ by (p - q)^2 / (p + q), rounded down. Part pair: each other source
    of the language, and the sum over all kept terms. Part term: the `top` terms that a source uses
    more than its language does. Ties go by UTF-8 order, which is that of the terms' places.

    Null text, lang and source are read as ''; groups without terms take part; a language without kept
    terms gives pairs of value 0; repeated rows count again; other columns are ignored; an empty table
    gives no rows.
    """
    docs = _filled(docs, "lang", "source", "text")
    kept = written(kept_terms(docs, least))
    sums = written(summed(recounted(docs, kept, head)))
    counted = written(sums.groupBy("lang", "source").agg(F.sum("total").alias("total")))
    terms = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    size = (F.coalesce("total", F.lit(0)) + 2 * F.coalesce("terms", F.lit(0))).alias("size")
    groups = docs.select("lang", "source").distinct().join(counted, ["lang", "source"], "left").join(terms, "lang", "left")
    groups = written(placed(groups.select("lang", "source", size, F.coalesce("terms", F.lit(0)).alias("terms")), ["source"], "place", ["lang"]))
    langs = counted.where("source is null").join(terms, "lang").select("lang", size)
    found = written(_pair_rows(groups, sums))
    names = groups.select("lang", "source", "place")
    one, two = (names.select("lang", F.col("source").alias(n), F.col("place").alias(k)) for n, k in (("source", "a"), ("item", "b")))
    both = found.union(found.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    pairs = both.join(one, ["lang", "a"]).join(two, ["lang", "b"]).select("lang", "source", "item", "value")
    silent = groups.where("terms = 0").select("lang", "source")
    zeros = silent.join(silent.select("lang", F.col("source").alias("item")), "lang").where("source <> item").select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    pairs = pairs.union(zeros).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    best = _term_rows(groups, langs, sums, top).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "ord"))).where(F.col("rank") <= top)
    best = best.join(kept.select("lang", "ord", F.col("term").cast("string").alias("item")), ["lang", "ord"])
    row = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return row(pairs, "pair").union(row(best, "term"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(read_table(spark, sf_dir, "documents"))


ORACLE = r"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
t as (select r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
k as (select lang, term from t group by lang, term having count(distinct r) >= 10),
v as (select lang, count(*) as v from k group by lang),
c as (select lang, source, term, count(*) as n from t join k using (lang, term) group by lang, source, term),
gs as (select lang, source, coalesce(sum(n), 0)::hugeint as total from (select distinct lang, source from d) left join c using (lang, source) group by lang, source),
ls as (select lang, sum(n)::hugeint as total from c group by lang),
p as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 2)) // (g.total + 2 * v.v) as p
  from gs g join v using (lang) join k on k.lang = g.lang left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
q as (select l.lang, c.term, 1 + (1000000000::hugeint * (sum(c.n) + 2)) // (max(l.total) + 2 * max(v.v)) as q
  from ls l join v using (lang) join c on c.lang = l.lang group by l.lang, c.term),
s as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by a.lang, a.source, b.source),
pairs as (select a.lang, a.source, b.source as item, coalesce(s.value, 0)::bigint as value from gs a join gs b on a.lang = b.lang and a.source <> b.source
  left join s on s.lang = a.lang and s.source = a.source and s.item = b.source),
terms as (select p.lang, p.source, p.term as item, (((p.p - q.q) * (p.p - q.q)) // (p.p + q.q))::bigint as value from p join q on q.lang = p.lang and q.term = p.term where p.n > 0 and p.p > q.q)
select lang, source, 'pair' as part, item, value, (row_number() over (partition by lang, source order by value desc, item))::int as rank from pairs
union all
select * from (select lang, source, 'term' as part, item, value, (row_number() over (partition by lang, source order by value desc, item))::int as rank from terms) where rank <= 10
"""
