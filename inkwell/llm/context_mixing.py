"""Language-model scores by logistic context mixing over bits, with unigram scores beside them.

A word is its bytes and an end; each of these is a path of bits in a Huffman tree. Hashed
contexts (the last 1 to 4 bytes, and the whole word so far) each predict every bit from counts
over the training corpus. A gate, how often the two longest contexts were met in training, picks the
weights that mix their logits, and an adaptive map corrects what the mix says. Both are fitted on all
training documents, dealt to two halves: the words of each are predicted from the counts of the other,
by Newton's steps on sums over all of them. The model itself has the counts of both. Bits depend on nothing
outside their word, so each distinct word of the corpus is scored once and joined to its documents.
There, the model is refined by what the document has shown: urns of several strengths raise
the words already met, and they are weighed against the plain model by how well each has done
so far.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, bytes_of, crc_of_id, read_table, written
from .lexicon import count_units, document_sums, split_words

#: Slots of the tables of the short contexts are 2^BITS, and of the whole word 2^(BITS + WORD_BITS), for
#: corpora of some GB; larger ones take more.
BITS = 20
WORD_BITS = 2
ORDERS = 4
CONTEXTS = ORDERS + 1
#: Newton's steps for the mixing weights, each a pass over the distinct words, and the bits that pull a gate's
#: weights to where they began.
NEWTON = 2
PRIOR = 20.0
#: Steps of how often a context was met: 0, 1, 2, 4, 8, 32, 128, 1024 times or more.
MET = np.array([1, 2, 4, 8, 32, 128, 1024])
GATES = (len(MET) + 1) ** 2
SCALE = 12.0
LEVELS = 4096
#: Strengths of the urns: about so many words of a document outweigh the model.
URNS = (1000.0, 100.0)
#: Bytes of words that are worked on together in a task.
PART = 1 << 16
#: Most that a task's counters hold before it passes them on.
FULL = 1 << 32
#: Counters in a block of the tables.
BLOCK = 1 << 11
END = 256
ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words and one end of text; the end, empty, is no possible word."""
    return [*text.lower().split(), b""]


def units_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words and ends of each of many texts, and the place of the text."""
    words, owner = split_words(texts)
    return pa.concat_arrays([words, pa.array([b""] * len(texts), pa.binary())]), np.r_[owner, np.arange(len(texts))]


class Code:
    """A Huffman code of bytes and the end of a word, from their counts."""

    def __init__(self, counts: np.ndarray):
        heap = [(int(n) + 1, b) for b, n in enumerate(counts)]
        heapq.heapify(heap)
        children, made = {}, len(heap)
        while len(heap) > 1:
            (n, a), (m, b) = heapq.heappop(heap), heapq.heappop(heap)
            children[made] = (a, b)
            heapq.heappush(heap, (n + m, made))
            made += 1
        paths: dict[int, list[tuple[int, int]]] = {}
        todo: list[tuple[int, list[tuple[int, int]]]] = [(made - 1, [])]
        while todo:
            node, path = todo.pop()
            if node in children:
                todo += [(child, [*path, (node, bit)]) for bit, child in enumerate(children[node])]
            else:
                paths[node] = path
        self.length = np.array([len(paths[b]) for b in range(len(counts))])
        self.first = np.cumsum(self.length) - self.length
        nodes = np.array([n for b in range(len(counts)) for n, _ in paths[b]], np.uint64)
        bits = np.array([x for b in range(len(counts)) for _, x in paths[b]], np.uint32)
        self.step = ((nodes * ODD) >> np.uint64(36)).astype(np.uint32) << np.uint32(1) | bits

    def decisions(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of symbols: how many decisions each has, and twice the node hash plus the bit of every decision."""
        each = self.length.take(symbols)
        ends = np.cumsum(each)
        at = np.repeat(self.first.take(symbols) - (ends - each), each)
        at += np.arange(len(at))
        return each, self.step.take(at)


def symbols_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and ends of the words, one after another, and where each word starts."""
    size = np.array([len(w) + 1 for w in words], np.int64)
    ends = np.cumsum(size)
    out = np.full(ends[-1] if len(words) else 0, END, np.int64)
    inner = np.ones(len(out), bool)
    inner[ends - 1] = False
    out[inner] = np.frombuffer(b"".join(words), np.uint8)
    return out, ends - size


def contexts(s: np.ndarray, starts: np.ndarray) -> Iterator[np.ndarray]:
    """An even 32-bit hash of each context at each symbol: the last 1 to ORDERS symbols, and all since the start."""
    n = len(s)
    first = np.zeros(n, np.int64)
    first[starts] = starts
    np.maximum.accumulate(first, out=first)
    age = np.arange(n) - first
    wide = s.astype(np.uint64) + np.uint64(1)
    h = np.zeros(n, np.uint64)
    for k in range(1, ORDERS + 1):
        h[k:] |= np.where(age[k:] >= k, wide[:-k], np.uint64(0)) << np.uint64(9 * (k - 1))
        yield _mixed(h + np.uint64(k << 40))
    base = 0xD1342543DE82EF95
    power, inverse = (np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, v, np.uint64)]) for v in (base, pow(base, -1, 1 << 64)))
    before = np.zeros(n + 1, np.uint64)
    np.cumsum(wide * power[:n], out=before[1:])  # modulo 2^64
    yield _mixed((before[:-1] - before[first]) * inverse[first])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * ODD
    return ((h ^ (h >> np.uint64(32))) * ODD >> np.uint64(32)).astype(np.uint32) << np.uint32(1)


def spans(bits: int) -> np.ndarray:
    """Where each context's slots begin among those of all contexts, and their end."""
    return np.cumsum([0, *[1 << bits] * ORDERS, 1 << (bits + WORD_BITS)])


def slots(code: Code, s: np.ndarray, starts: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, Iterator[np.ndarray]]:
    """Decisions per symbol, the bits, and for each context twice the slot of every decision plus its bit."""
    each, step = code.decisions(s)
    masks = (2 * np.diff(spans(bits)) - 1).astype(np.uint32)
    return each, step & np.uint32(1), ((np.repeat(h, each) + step) & m for h, m in zip(contexts(s, starts), masks))


def parts_of(words: list[bytes], times: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of words that have about PART bytes, and occur less than FULL / 2 times, together; or one word alone."""
    at, size, often = 0, 0, 0
    for i, w in enumerate(words):
        n = 0 if times is None else int(times[i])
        if i > at and often + n >= FULL // 2:
            yield at, i
            at, size, often = i, 0, 0
        size += len(w) + 1
        often += n
        if size >= PART:
            yield at, i + 1
            at, size, often = i + 1, 0, 0
    if at < len(words):
        yield at, len(words)


def corpus_counts(units: DataFrame, code: Code, bits: int = BITS) -> np.ndarray:
    """The table of units (unit, k), each word k times."""
    return corpus_tables(units, code, bits, ["k"])[-1]


def corpus_tables(units: DataFrame, code: Code, bits: int, columns: list[str]) -> np.ndarray:
    """Quantised logits, and how often they were met, by context and slot, of all bits of units: a table for each of the
    columns, which say how often a word counts, and last one for their sum.

    A task counts into arrays of fixed size and passes on what is not zero, in blocks; blocks of
    the same place are added up one after another, so a task holds one at a time. The driver
    gets the finished tables, two bytes a slot.
    """
    shared = units.sparkSession.sparkContext.broadcast(code)

    def start():
        own = shared.value
        cuts = 2 * spans(bits)
        found = np.zeros(cuts[-1], np.uint32)
        held = 0

        def take():
            nonlocal held
            at = np.flatnonzero(found)
            block = at // BLOCK
            ends = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True]) if len(at) else [0]
            rows = [(int(block[a]), (at[a:b] % BLOCK).astype(np.uint16).tobytes(), found[at[a:b]].tobytes()) for a, b in zip(ends[:-1], ends[1:])]
            found[:], held = 0, 0
            return rows

        def work(*columns):
            nonlocal held
            rows = []
            if columns:
                words, times = bytes_of(columns[0]), columns[1].to_numpy()
                for a, b in parts_of(words, times):
                    s, starts = symbols_of(words[a:b])
                    each, _, places = slots(own, s, starts, bits)
                    places, left = [p.copy() for p in places], times[a:b].copy()
                    while left.any():  # more than once for a word of FULL / 2 occurrences or more alone
                        now = np.minimum(left, FULL // 2 - 1)
                        left -= now
                        if held + int(now.sum()) >= FULL:
                            rows += take()
                        held += int(now.sum())
                        weights = np.repeat(np.repeat(now, np.diff(np.r_[starts, len(s)])), each).astype(np.uint32)
                        for k, place in enumerate(places):
                            np.add.at(found[cuts[k] : cuts[k + 1]], place, weights)
            else:
                rows = take()
            return list(zip(*rows)) if rows else None

        return work

    parts = None
    for t, name in enumerate(columns):
        own = arrow_map(units.where(F.col(name) > 0), ["unit", name], "block int, at binary, counts binary", start, rows=1 << 14, finish=True)
        own = own.withColumn("part", F.lit(t))
        parts = own if parts is None else parts.union(own)
    n = len(columns)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None

        def done() -> pa.RecordBatch:
            pair = np.concatenate([total, total.sum(0, keepdims=True)]).reshape(n + 1, -1, 2).astype(float)
            level = np.clip(np.rint(np.log((pair[..., 1] + 0.4) / (pair[..., 0] + 0.4)) * SCALE), -127, 127)
            met = np.searchsorted(MET, pair.sum(-1), "right")
            return pa.RecordBatch.from_arrays(
                [pa.array([now], pa.int32()), pa.array([np.stack([level, met], 1).astype(np.int8).tobytes()])], ["block", "levels"]
            )

        for batch in batches:
            for block, at, counts, part in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3).to_pylist()):
                if block != now:
                    if now is not None:
                        yield done()
                    now, total = block, np.zeros((n, BLOCK), np.int64)
                total[part, np.frombuffer(at.as_buffer(), np.uint16)] += np.frombuffer(counts.as_buffer(), np.uint32)
        if now is not None:
            yield done()

    tables = np.zeros((n + 1, 2, spans(bits)[-1]), np.int8)
    summed = parts.repartition("block").sortWithinPartitions("block").mapInArrow(add, "block int, levels binary")
    rows = summed.toArrow()  # at most 2 * spans(bits)[-1] bytes a table
    for block, levels in zip(rows["block"].to_pylist(), rows["levels"]):
        tables[..., block * (BLOCK // 2) : (block + 1) * (BLOCK // 2)] = np.frombuffer(levels.as_buffer(), np.int8).reshape(n + 1, 2, -1)
    return tables


class Mixer:
    """Tables, gated weights, and the adaptive map."""

    def __init__(self, code: Code, tables: np.ndarray, bits: int):
        cuts = spans(bits)
        self.code, self.bits = code, bits
        self.tables, self.met = ([t[a:b] for a, b in zip(cuts[:-1], cuts[1:])] for t in tables)
        self.weights = np.tile(np.r_[np.zeros(ORDERS - 1), 0.4, 0.6, 0], (GATES, 1))
        self.map = np.tile(self._levels(), (GATES, 1))

    @staticmethod
    def _levels() -> np.ndarray:
        return (np.arange(LEVELS) - LEVELS / 2) / 128

    def inputs(self, s: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Decisions per symbol, the bits, the logits (contexts and a one), and the gate."""
        each, bit, places = slots(self.code, s, starts, self.bits)
        x = np.ones((CONTEXTS + 1, len(bit)), np.float32)
        gate = np.zeros(len(bit), np.int64)
        for k, place in enumerate(places):
            place = place >> np.uint32(1)
            x[k] = self.tables[k].take(place)
            if k >= CONTEXTS - 2:
                gate = gate * (len(MET) + 1) + self.met[k].take(place)
        x[:-1] /= SCALE
        return each, bit, x, gate

    def mix(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        w = self.weights.astype(np.float32)
        return sum(w[:, k].take(gate) * x[k] for k in range(CONTEXTS + 1))

    def level(self, mixed: np.ndarray) -> np.ndarray:
        return np.clip(mixed * 128 + LEVELS / 2, 0, LEVELS - 1).astype(np.int64)

    def fit_map(self, counted: np.ndarray) -> None:
        """The map, from how often (counted[bit, gate, level // 64]) each bit was met at a level of the mix."""
        coarse = self._levels().reshape(-1, 64).mean(1)
        prior = 20 / (1 + np.exp(-coarse))
        fitted = np.log((counted[1] + prior) / (counted[0] + 20 - prior))
        self.map = np.stack([np.interp(self._levels(), coarse, f) for f in fitted])

    def log10(self, words: list[bytes]) -> np.ndarray:
        """log10 probability of each word with its end."""
        out = np.zeros(len(words))
        loss = np.stack([np.logaddexp(0, self.map).ravel(), np.logaddexp(0, -self.map).ravel()]).ravel()
        for a, b in parts_of(words):
            s, starts = symbols_of(words[a:b])
            each, bit, x, gate = self.inputs(s, starts)
            at = self.level(self.mix(x, gate)) + gate * LEVELS + bit.astype(np.int64) * (GATES * LEVELS)
            out[a:b] = -np.add.reduceat(loss.take(at), (np.cumsum(each) - each)[starts]) / np.log(10)
        return out


def symbol_counts(units: DataFrame) -> np.ndarray:
    """How often each byte and the end of a word occur in units (unit, k), each word k times."""

    def start():
        total = np.zeros(END + 1, np.int64)

        def work(*columns):
            if not columns:
                return [np.arange(END + 1), total]
            s, starts = symbols_of(bytes_of(columns[0]))
            if len(s):
                total[:] += np.bincount(s, np.repeat(columns[1].to_numpy(), np.diff(np.r_[starts, len(s)])), END + 1).astype(np.int64)
            return None

        return work

    rows = arrow_map(units, ["unit", "k"], "symbol int, n long", start, rows=4096, finish=True).groupBy("symbol").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(END + 1)
    counts[rows["symbol"].to_numpy(int)] = rows["n"].to_numpy(float)
    return counts


def _sums(units: DataFrame, mixers: list[Mixer], size: int, add: Callable) -> np.ndarray:
    """The sum of size numbers over the training words of units (unit, c, k), each half's predicted by the other's mixer.

    add(total, mixer, words, times) adds words that occur so often. The driver gets a row for each number.
    """
    shared = units.sparkSession.sparkContext.broadcast(mixers)

    def start():
        total = np.zeros(size)

        def work(*columns):
            if not columns:
                return [np.arange(size), total]
            words, first, both = bytes_of(columns[0]), columns[1].to_numpy(), columns[2].to_numpy()
            for mixer, times in zip(shared.value, (both - first, first)):
                some = np.flatnonzero(times)
                own = [words[i] for i in some.tolist()]
                for a, b in parts_of(own):
                    add(total, mixer, own[a:b], times[some[a:b]])
            return None

        return work

    rows = arrow_map(units.where("c > 0"), ["unit", "k", "c"], "at int, n double", start, rows=1 << 14, finish=True).groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    shared.destroy()
    out = np.zeros(size)
    out[rows["at"].to_numpy(int)] = rows["n"].to_numpy(float)
    return out


def _bits_of(mixer: Mixer, words: list[bytes], times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every bit of the words: how often it occurs, what it is, the logits, and the gate."""
    s, starts = symbols_of(words)
    each, bit, x, gate = mixer.inputs(s, starts)
    return np.repeat(times, np.add.reduceat(each, starts)), bit, x, gate


def _add_slopes(total: np.ndarray, mixer: Mixer, words: list[bytes], times: np.ndarray) -> None:
    """By gate: gradient and curvature of the log probability of the words' bits by the weights."""
    n, bit, x, gate = _bits_of(mixer, words, times)
    p = 1 / (1 + np.exp(-np.clip(mixer.mix(x, gate), -30, 30)))  # in 32 bits, as all that a part sums up
    order = np.argsort(gate.astype(np.uint8), kind="stable")
    ends = np.cumsum(np.bincount(gate, minlength=GATES))
    n = n.astype(np.float32)
    miss, firm = n * (bit.astype(np.float32) - p), n * p * (1 - p)
    x, miss, firm = x.take(order, axis=1), miss.take(order), firm.take(order)
    slopes = total.reshape(GATES, CONTEXTS + 2, CONTEXTS + 1)
    for g, (a, b) in enumerate(zip(np.r_[0, ends[:-1]], ends)):
        if a < b:
            own = x[:, a:b]
            slopes[g, 0] += own @ miss[a:b]
            slopes[g, 1:] += (own * firm[a:b]) @ own.T


def _add_levels(total: np.ndarray, mixer: Mixer, words: list[bytes], times: np.ndarray) -> None:
    n, bit, x, gate = _bits_of(mixer, words, times)
    total += np.bincount((bit.astype(np.int64) * GATES + gate) * (LEVELS // 64) + mixer.level(mixer.mix(x, gate)) // 64, n, len(total))


def fit(units: DataFrame, bits: int = BITS) -> Mixer:
    """The model of units (unit, c: occurrences in training documents, k: those in the first half of these).

    Weights and map see all training words, each predicted from the half that it is not of; the mixer
    returned has the counts of all.
    """
    code = Code(symbol_counts(units.select("unit", F.col("c").alias("k"))))
    tables = corpus_tables(units.withColumn("rest", F.col("c") - F.col("k")), code, bits, ["k", "rest"])
    halves, mixer = [Mixer(code, t, bits) for t in tables[:2]], Mixer(code, tables[2], bits)
    weights = begun = mixer.weights.copy()
    for _ in range(NEWTON):
        for m in halves:
            m.weights = weights
        slopes = _sums(units, halves, GATES * (CONTEXTS + 2) * (CONTEXTS + 1), _add_slopes).reshape(GATES, CONTEXTS + 2, CONTEXTS + 1)
        pull = slopes[:, 0] + PRIOR * (begun - weights)
        weights = weights + np.linalg.solve(slopes[:, 1:] + PRIOR * np.eye(CONTEXTS + 1), pull[..., None])[..., 0]
    for m in (*halves, mixer):
        m.weights = weights
    mixer.fit_map(_sums(units, halves, 2 * GATES * (LEVELS // 64), _add_levels).reshape(2, GATES, -1))
    return mixer


def score(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte: a row per input row.

    Learns from all rows whose crc32 remainder (mod 10) is not 0, in two halves by a hash of id and
    text; counts, mixing weights and the map are of all of them. A null or empty text is one
    end token. Repeated rows count as often as they appear and give repeated results; null
    ids stay null (their remainder is that of the empty text); other columns are ignored; an
    empty table gives no rows. bits_per_byte is over the bytes of the text, or 1 if it has none.
    """
    chosen = crc_of_id("doc_id") % 10 != 0
    half = chosen & (F.pmod(F.xxhash64(F.lit(9), F.col("doc_id").cast("long"), "text"), F.lit(2)) == 0)
    flags = [chosen, half, F.lit(True)]
    units = written(count_units(docs, units_of, flags).select("unit", F.col("n0").alias("c"), F.col("n1").alias("k"), F.col("n2").alias("n")))
    sizes = units.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    below = sizes["n"] + 0.1 * (sizes["v"] + 1)
    shared = docs.sparkSession.sparkContext.broadcast(fit(units, bits))

    def start():
        return lambda unit, c, n: [unit, c, n, shared.value.log10(bytes_of(unit))]

    scored = written(arrow_map(units, ["unit", "c", "n"], "unit binary, c long, n long, a double", start, rows=1 << 14))
    table = scored.select("unit", "n", "a", F.log10((F.col("c") + 0.1) / below).alias("base"), (F.col("c") > 0).cast("long").alias("b"))
    sums = document_sums(docs, units_of, table, URNS, ["base"])
    copies = [F.col("sum_a"), *(F.col(f"urn_{k}") for k in range(len(URNS)))]
    best = F.greatest(*copies)
    mixed = best + F.log10(sum((F.pow(F.lit(10.0), c - best) for c in copies[1:]), F.pow(F.lit(10.0), copies[0] - best)) / len(copies))
    return sums.withColumn("score", mixed).select(
        "doc_id", (crc_of_id("doc_id") % 10 == 0).alias("held_out"), F.col("n_units").alias("n_tokens"), F.col("sum_b").alias("n_known"),
        F.lit(sizes["n"]).cast("long").alias("train_tokens"), F.col("sum_base").alias("base_score"), "score", "n_bytes",
        (-F.col("score") * float(np.log2(10)) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read_table(spark, sf_dir, "documents"))
