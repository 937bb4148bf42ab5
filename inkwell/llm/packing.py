"""Packing by column generation: patterns over a histogram of piece lengths, dealt to ranked pieces."""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Callable
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from .common import arrow_map, bytes_of, read_table, written

VOCABULARY = "word_bpe_49k.json"
LENGTH = 2048
END_ID = 1
#: Tokens in a bin of the histogram: 256 bins, half a bin lost for each piece on average.
BIN = 8
#: Parts that a bin's pieces are ranked in at least, and pieces of a part, about, so that no task ranks a whole hot bin.
SALTS = 64
RANKED = 1 << 19
#: Words whose ids a task remembers.
REMEMBER = 400_000


class _Known(dict):
    """Ids by word; those of a word that is not there are found and kept."""

    def __init__(self, find: Callable[[bytes], bytes]):
        self.find = find

    def __missing__(self, word: bytes) -> bytes:
        ids = self[word] = self.find(word)
        return ids


class WordIds:
    """Ids of words, remembered. Pre-tokens never cross white space, so a text's ids are its words' ids in order.

    A word made of letter runs and other ASCII runs has its runs' ids in order, too: a
    pre-token ends wherever letters do, but at an apostrophe. A run of letters is one
    pre-token, so the model alone, without the library's normalizer, gives its ids.
    """

    RUNS = re.compile(rb"[a-z\x80-\xff]+|[^a-z\x80-\xff]+")

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the tasks are the parallel part
        assert array("I").itemsize == 4
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known = _Known(self._word)
        self.runs: dict[bytes, bytes] = {}
        self.four = [array("I", [k]).tobytes() for k in range(self.tokenizer.get_vocab_size())]
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.shown = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(97, 123)}
        # how the vocabulary writes each byte of letters beyond ASCII, from texts that hold it
        for point in (*range(0xA0, 0x800), *range(0x800, 0x10000, 64), *range(0x10000, 0x110000, 4096)):
            if not 0xD800 <= point < 0xE000:
                self.shown |= dict(zip(chr(point).encode(), level.pre_tokenize_str(chr(point))[0][0]))

    def _encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _letters(self, run: bytes) -> bytes | None:
        """Ids of a run of letters; None if it holds anything else once it is normalized."""
        if not run.isascii():
            text = "".join(c.lower() for c in unicodedata.normalize("NFC", run.decode()))
            shown = [self.shown.get(b) for b in text.encode()]
            if not text.isalpha() or None in shown:
                return None
            return array("I", [t.id for t in self.model.tokenize("".join(shown))]).tobytes()
        return array("I", [t.id for t in self.model.tokenize(run.decode())]).tobytes()

    def _word(self, word: bytes) -> bytes:
        if b"'" in word or b"<|" in word:
            return self._encode(word.decode())
        low, held = word.lower(), self.runs.get
        out = []
        for run in (low,) if low.isalpha() else self.RUNS.findall(low):
            ids = held(run)
            if ids is None:
                ids = self._letters(run) if run[0] >= 97 and (run[0] <= 122 or run[0] >= 128) else self._encode(run.decode())
                if ids is None:
                    return self._encode(word.decode())
                self.runs[run] = ids
            out.append(ids)
        return b"".join(out)

    def forget(self) -> None:
        """Lets go of what is remembered, once it is too much."""
        for held in (self.known, self.runs):
            if len(held) > REMEMBER:
                held.clear()

    def ids(self, words: list[bytes]) -> bytes:
        return b"".join(map(self.known.__getitem__, words))


def pieces_of(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: each document's ids and end id, cut every `length` ids."""
    end = np.array([end_id], "<u4").tobytes()

    def start():
        words_ids = WordIds(path)

        def work(ids, texts):
            split = [x.split() for x in bytes_of(texts)]
            words_ids.forget()
            out = []
            for doc, words in zip(ids.to_pylist(), split):
                all_ids = words_ids.ids(words) + end
                n = len(all_ids) // 4
                out += [
                    (doc, at, min(length, n - at), zlib.crc32(all_ids[4 * at : 4 * (at + length)]), n)
                    for at in range(0, n, length)
                ]
            return list(zip(*out)) if out else None

        return work

    return arrow_map(
        docs,
        [F.col("doc_id").cast("long"), "text"],
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long",
        start,
        rows=512,
    )


def best_pattern(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the counts of most worth that fit the capacity."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        fits = np.searchsorted(sizes, c, "right")
        if fits:
            value = best[c - sizes[:fits]] + worth[:fits]
            k = int(value.argmax())
            if value[k] > best[c] + 1e-12:
                best[c], took[c] = value[k], k
    counts, c = np.zeros(len(sizes), int), capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            counts[took[c]] += 1
            c -= sizes[took[c]]
    return float(best[capacity]), counts


def solve_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 2e-4) -> list[tuple[np.ndarray, int]]:
    """Patterns (counts per size) and whole multiplicities that meet the demand exactly.

    The linear program's columns are priced by best_pattern until none is worth more than
    1 + gap (then the value is within that factor of the optimum). Multiplicities are rounded
    down, and what is left, fewer pieces than patterns times their slots, is packed by best fit.
    """
    m = len(sizes)
    columns = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1 / np.diag(columns))
    x = inverse @ demand
    for _ in range(60 * m):
        worth, counts = best_pattern(sizes, np.maximum(inverse.sum(0), 0), capacity)
        if worth <= 1 + gap:
            break
        way = inverse @ counts
        ratio = np.where(way > 1e-9, x / np.where(way > 1e-9, way, 1), np.inf)
        r = int(ratio.argmin())
        x = np.maximum(x - ratio[r] * way, 0)
        x[r] = ratio[r]
        columns[:, r] = counts
        row = inverse[r] / way[r]
        inverse -= np.outer(way, row)
        inverse[r] = row
    left = demand.astype(int).copy()
    out = []
    for k in np.argsort(-x):
        counts = columns[:, k].astype(int)
        used = counts > 0
        times = min(int(x[k] + 1e-6), int((left[used] // counts[used]).min()))
        if times > 0:
            out.append((counts, times))
            left -= times * counts
    return out + best_fit(sizes, left, capacity)


def best_fit(sizes: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Largest pieces first, each into the fullest sequence that it fits."""
    made: list[np.ndarray] = []
    room: list[tuple[int, int]] = []
    for k in np.argsort(-sizes):
        for _ in range(left[k]):
            at = bisect_left(room, (int(sizes[k]), -1))
            if at < len(room):
                free, i = room.pop(at)
            else:
                free, i = capacity, len(made)
                made.append(np.zeros(len(sizes), int))
            made[i][k] += 1
            insort(room, (free - int(sizes[k]), i))
    return [(counts, 1) for counts in made]


def pack(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece.

    A null or empty text is its end id alone. Repeated rows are packed each on its own; null
    ids stay null; other columns are ignored; an empty table gives no rows. Only the
    histogram (a row for each part of a bin) and the patterns (at most a few per bin) reach the driver.
    """
    spark = docs.sparkSession
    width = max(1, BIN * length // LENGTH)
    capacity = length // width
    pieces = written(pieces_of(docs, path, length, end_id)).withColumn("bin", F.ceil(F.col("length") / width).cast("int"))
    total = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("bin").agg(F.count("*").alias("n")).collect():  # a row for each bin
        total[row["bin"]] = row["n"]
    salts = np.maximum(SALTS, -(-total // RANKED))
    salt = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.element_at(F.array(*map(F.lit, salts.tolist())), F.col("bin") + 1))
    pieces = pieces.withColumn("salt", salt.cast("int"))
    histogram = pieces.groupBy("bin", "salt").agg(F.count("*").alias("n")).toPandas()
    first = np.cumsum(salts) - salts
    count = np.zeros(int(salts.sum()), np.int64)
    count[first[histogram["bin"].to_numpy(int)] + histogram["salt"].to_numpy(int)] = histogram["n"].to_numpy(np.int64)
    before = np.cumsum(count) - count
    before -= np.repeat(before[first], salts)  # within the bin
    sizes = np.flatnonzero(total)
    patterns = solve_patterns(sizes, total[sizes], capacity) if len(sizes) else []
    # of each bin: the ranks at which a pattern begins to take pieces, and what it is
    deals: dict[int, list[tuple[int, int, int, int]]] = {int(s): [] for s in sizes}
    taken, first_id = dict.fromkeys(deals, 0), 0
    for counts, times in patterns:
        slot = 0
        for size, each in zip(sizes.tolist(), counts.tolist()):
            if each:
                deals[size].append((taken[size], each, first_id, slot))
                taken[size] += each * times
                slot += each
        first_id += times
    shared = spark.sparkContext.broadcast((first, before, {k: np.array(v).T for k, v in deals.items()}))

    def start():
        first, before, deals = shared.value

        def work(doc, begin, size, crc, tokens, bins, salts, ranks):
            bins, salts, ranks = (np.asarray(v) for v in (bins, salts, ranks))
            rank = before[first[bins] + salts] + ranks - 1
            sequence, slot = np.empty(len(bins), np.int64), np.empty(len(bins), np.int64)
            for b in np.unique(bins):
                own = bins == b
                at, each, ids, slots = deals[int(b)]
                k = np.searchsorted(at, rank[own], "right") - 1
                copy, place = np.divmod(rank[own] - at[k], each[k])
                sequence[own], slot[own] = ids[k] + copy, slots[k] + place
            return [doc, begin, size, crc, tokens, sequence, slot]

        return work

    ranked = pieces.withColumn("rank", F.row_number().over(Window.partitionBy("bin", "salt").orderBy("doc_id", "start", "ids_crc32")))
    dealt = arrow_map(
        ranked,
        ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bin", "salt", "rank"],
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, slot long",
        start,
        rows=1 << 16,
    )
    earlier = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return dealt.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0))).drop("slot")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
