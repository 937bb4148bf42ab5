"""Benchmark decontamination: CGK walks, bit-sampling LSH over item-sized windows, exact edit distance.

A random walk over a text's characters stays on a character or moves on, as a random bit of the
step and the character says; what it reads is an embedding in which a few edits change a few
places only. Each walk is begun anew every few characters of an item and at every character of a
text, so that it is in step again behind an edit. A hash of sampled places of a walk is a key;
equal keys of item and text are votes for a place of the item, and the votes that fall in one
item-sized window are counted. How many are asked for comes from the target recall, at as many
edits as the bound allows. What has enough votes is verified exactly.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, bytes_of, read_table

SIMILARITY = 0.8
#: Share of the passages at the edit bound whose votes suffice; those with fewer edits have more.
RECALL = 0.99
#: Walks, the steps of each, and of these the places that a key samples.
WALKS, STEPS, SAMPLED = 2, 14, 12
#: Characters between the walks of an item; shorter items have more walks for their length.
STRIDE = 6
#: Bits of a key.
HASH_BITS = 20
#: Sets of random edits that the number of votes is taken from.
TRIALS = 400
#: Parts of a text walked or bounded side by side; letters that have a class of their own.
WALKED, SIDE_BY_SIDE, CLASSES = 1 << 15, 1 << 13, 255
#: Diagonals that a region begins in at most; longer ones are cut.
TILE = 512
#: Documents searched together.
SLICE = 256
#: Bytes of items that are held in a task at once; more are searched in blocks, one after another.
BLOCK_BYTES = 1 << 20


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """32 random-looking bits of each number."""
    x = (x.astype(np.uint32) + np.uint32(seed)) * np.uint32(0x9E3779B1)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x85EBCA77)
    return x ^ (x >> np.uint32(13))


def walk_keys(text: np.ndarray, walk: int) -> np.ndarray:
    """The key of a walk from each character of a text.

    Steps are taken from the last to the first, for all characters at once: the key from a step on is that of the next
    step, here or one character on as the walk moves, and the letter's own number if the step is sampled.
    """
    padded = np.concatenate([text, np.zeros(STEPS, np.uint32)])
    sampled = set(np.random.default_rng(walk).permutation(STEPS)[:SAMPLED].tolist())
    keys = np.empty(len(text), np.uint32)
    moved, other = np.empty((2, WALKED + STEPS), np.uint32)
    for at in range(0, len(text), WALKED):
        size = min(WALKED, len(text) - at)
        part = padded[at : at + size + STEPS]
        moves, names = mixed(part, 2 * walk + 1).view(np.int32), mixed(part, 2 * walk + 2)
        key = np.zeros(len(part), np.uint32)
        for step in reversed(range(STEPS)):
            n = size + step
            move = np.left_shift(moves[:n], np.int32(31 - step), out=moved[:n].view(np.int32))
            move >>= np.int32(31)  # all bits, or none
            here = key[:n]
            change = np.bitwise_xor(key[1 : n + 1], here, out=other[:n])
            change &= moved[:n]
            here ^= change
            if step in sampled:
                here *= np.uint32(0xC2B2AE3D)
                here += names[:n]
            key = here
        np.right_shift(key, np.uint32(32 - HASH_BITS), out=keys[at : at + size])
    return keys


def walk_ends(text: np.ndarray, walk: int) -> np.ndarray:
    """The place where a walk from each character of a text ends."""
    moves, place = mixed(np.concatenate([text, np.zeros(STEPS, np.uint32)]), 2 * walk + 1), np.arange(len(text))
    for step in range(STEPS):
        place += moves.take(place) >> np.uint32(step) & np.uint32(1)
    return place


def votes_left(begins: np.ndarray, ends: np.ndarray, size: int, edits: int, recall: float) -> int:
    """How many of the walks (begin to end) keep clear of `edits` random edits in a share `recall` of the trials, at least."""
    draw = np.random.default_rng(size).random((TRIALS, size))
    hit = np.zeros((TRIALS, size + 2), np.int32)
    if edits:
        np.put_along_axis(hit[:, 1:-1], np.argpartition(draw, edits - 1, axis=1)[:, :edits], 1, axis=1)
    np.cumsum(hit, axis=1, out=hit)
    clear = (hit[:, np.minimum(ends + 1, size)] == hit[:, begins]).sum(1)
    return int(np.sort(clear)[int((1 - recall) * TRIALS)])


def distance_within(item: str, text: str, most: int) -> int | None:
    """The least edit distance of item to any part of text, by bit-parallel dynamic programming; None if over `most`."""
    found = least_distance(item, text)[0]
    return found if found <= most else None


def least_distance(item: str, text: str) -> tuple[int, int]:
    """The least edit distance of item to any part of text, and where the first such part ends."""
    if item in text:
        return 0, text.index(item) + len(item)
    size = len(item)
    has: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        has[c] |= 1 << i
    full, top = (1 << size) - 1, 1 << (size - 1)
    up, down, now, least, end = full, 0, size, size, 0
    for at, c in enumerate(text, 1):
        eq = has.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph, mh = down | (~(xh | up) & full), up & xh
        if ph & top:
            now += 1
        elif mh & top:
            now -= 1
            if now < least:
                least, end = now, at
        ph, mh = (ph << 1) & full, (mh << 1) & full  # a match may begin anywhere
        up, down = mh | (~(xv | ph) & full), ph & xv
    return least, end


class Items:
    """Items of one block, with a table of the keys of their walks and bit masks of their blocks.

    The diagonal of a vote is its place in the text less its place in the item. The diagonals of
    an alignment within the bound are at most `most` apart, so votes are counted over so many.
    Where there are enough, blocks of at most 64 characters of the item are looked up, each near
    its place: their least distances add up to no more than the item's, so what is over the bound
    goes without loss. What is left is compared exactly. An item too short to keep a walk clear of
    edits is looked for in all of each text, and with a recall of 1 every item is.
    """

    def __init__(self, rows: list[tuple], similarity: float = SIMILARITY, recall: float = RECALL):
        self.ids = [r[0] for r in rows]
        self.texts = [b" ".join((r[1] or "").encode().lower().split()).decode() for r in rows]
        points = [code_points(t) for t in self.texts]
        self.sizes = np.array([len(t) for t in self.texts], np.int64)
        self.most = np.array([int((1 - similarity) * len(t) + 1e-9) for t in self.texts], np.int64)
        self.least = np.zeros(len(rows), np.int64)
        voters = [[np.zeros((3, 0), np.int64)] for _ in range(WALKS)]
        for i, p in enumerate(points):
            stride, own = max(1, min(STRIDE, len(p) // 48)), []
            for walk in range(WALKS):
                keys, ends = walk_keys(p, walk), walk_ends(p, walk)
                at = np.arange(walk * stride // WALKS, len(p), stride)
                at = at[ends[at] < len(p)]
                own.append(np.stack([at, ends[at]]))
                voters[walk].append(np.stack([keys[at], np.full(len(at), i), at]).astype(np.int64))
            begins, ends = np.concatenate(own, axis=1) if own else np.zeros((2, 0), np.int64)
            if len(p) and recall < 1:
                self.least[i] = votes_left(begins, ends, len(p), int(self.most[i]), recall)
        self.short = np.flatnonzero((self.least < 1) & (self.sizes > 0))
        self.tables = []
        for found in voters:
            keys, item, at = np.concatenate(found, axis=1)
            use = self.least[item] > 0
            keys, item, at = (x[use][np.argsort(keys[use], kind="stable")] for x in (keys, item, at))
            count = np.bincount(keys, minlength=1 << HASH_BITS)
            self.tables.append((count > 0, count, np.cumsum(count) - count, item, at))
        # rare letters share the last class but one, which can only lower a bound; letters of no item have the last
        letters, often = np.unique(np.concatenate([*points, np.zeros(0, np.uint32)]), return_counts=True)
        self.width = min(len(letters), CLASSES + 1) + 1
        self.classes = np.full(0x110000, self.width - 1, np.uint16)
        self.classes[letters[np.argsort(-often, kind="stable")]] = np.minimum(np.arange(len(letters)), CLASSES)
        self.parts = (self.sizes + 63) // 64
        self.part = -(-self.sizes // np.maximum(self.parts, 1))
        self.first = np.cumsum(self.parts) - self.parts
        self.masks = np.zeros(int(self.parts.sum()) * self.width, np.uint64)
        for i, p in enumerate(points):
            if len(p):
                block, bit = np.divmod(np.arange(len(p)), self.part[i])
                ends = np.minimum((block + 1) * self.part[i], len(p)) - block * self.part[i]
                np.bitwise_or.at(self.masks, (self.first[i] + block) * self.width + self.classes[p], np.uint64(1) << (64 - ends + bit).astype(np.uint64))

    def regions(self, text: np.ndarray) -> np.ndarray:
        """Rows (item, first, last diagonal) with enough votes, and all of the text for short items."""
        ahead = int(self.sizes.max(initial=0))  # diagonals begin before the text
        line = len(text) + 2 * ahead + 1
        votes = [np.zeros(0, np.int64)]
        for walk, (any_of, count, begin, item, at) in enumerate(self.tables):
            if len(item):
                keys = walk_keys(text, walk)
                place = np.flatnonzero(any_of.take(keys))
                keys = keys.take(place)
                n = count.take(keys)
                own = np.repeat(begin.take(keys) - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                votes.append(item.take(own) * line + (np.repeat(place, n) - at.take(own) + ahead))
        votes = np.sort(np.concatenate(votes))
        item = votes // line
        most, after = self.most.take(item), np.arange(len(votes)) + self.least.take(item) - 1
        enough = after < len(votes)
        lead = np.flatnonzero(enough & (votes.take(after, mode="clip") - votes <= most))
        found = [np.zeros((0, 3), np.int64)]
        if len(lead):
            item, first, last = item[lead], votes[lead], votes[lead] + most[lead]
            # overlapping ones are one region, up to TILE diagonals
            cut = np.flatnonzero(np.r_[True, (np.diff(item) != 0) | (first[1:] > last[:-1]) | (np.diff(first // TILE) != 0)])
            item, first, last = item[cut], first[cut], last[np.r_[cut[1:], len(lead)] - 1]
            found.append(np.stack([item, first - item * line - ahead, last - item * line - ahead], 1))
        tiles = np.arange(-ahead, len(text), TILE)
        found += [np.stack([np.full(len(tiles), i), tiles, tiles + TILE - 1], 1) for i in self.short]
        return np.concatenate(found)

    def bounded(self, letters: np.ndarray, found: np.ndarray) -> np.ndarray:
        """The rows of regions in which the least distances of the item's blocks do not add up to more than its bound."""
        item, first, last = found.T
        left, alive = self.most[item], np.arange(len(item))
        for k in range(int(self.parts[item].max(initial=0))):
            for at in range(0, len(more := alive[self.parts[item[alive]] > k]), SIDE_BY_SIDE):
                some = more[at : at + SIDE_BY_SIDE]
                i = item[some]
                offset = k * self.part[i]
                size = np.minimum(self.part[i], self.sizes[i] - offset)
                begin, end = (np.clip(x, 0, len(letters)) for x in (first[some] + offset, last[some] + offset + size))
                left[some] -= self._least((self.first[i] + k) * self.width, size, letters, begin, end)
            alive = alive[left[alive] >= 0]
        return found[alive]

    def _least(self, base: np.ndarray, size: np.ndarray, letters: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The least distance of each block (masks at base) to any part of letters[begin:end], all side by side."""
        order = np.argsort(begin - end, kind="stable")  # longest first: those still running come first
        base, size, begin, spans = base[order], size[order], begin[order], (end - begin)[order]
        # a block ends at the top bit; the bits below it are letters that match any, at no cost
        up = np.full(len(base), ~np.uint64(0)) << (64 - size).astype(np.uint64)
        down, any_letter, one = np.zeros(len(base), np.uint64), ~up, np.uint64(1)
        now = size.astype(np.int8)
        least = now.copy()
        for j, n in enumerate(np.searchsorted(-spans, -np.arange(int(spans.max(initial=0))), "left").tolist()):
            xv = self.masks.take(base[:n] + letters.take(begin[:n] + j))
            xv |= any_letter[:n]
            pv, mv = up[:n], down[:n]
            xh = xv & pv
            xh += pv
            xh ^= pv
            xh |= xv
            xv |= mv
            ph = xh | pv
            np.invert(ph, ph)
            ph |= mv
            xh &= pv
            now[:n] += (ph.view(np.int64) < 0).view(np.int8)
            now[:n] -= (xh.view(np.int64) < 0).view(np.int8)
            np.minimum(least[:n], now[:n], out=least[:n])
            ph <<= one
            xh <<= one
            np.bitwise_and(ph, xv, out=mv)
            xv |= ph
            np.invert(xv, xv)
            np.bitwise_or(xh, xv, out=pv)
        out = np.empty(len(least), np.int64)
        out[order] = least
        return out

    def matches(self, docs: list[list[bytes]]) -> list[tuple[int, int, int, int]]:
        """(document, item, least distance, word) of each pair within the bound; the passage ends an item's size behind the word's begin."""
        texts = [b" ".join(words).decode() for words in docs]
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        first = np.cumsum(sizes) - sizes
        whole = "\n".join([*texts, ""])
        text = code_points(whole)
        pairs: set[tuple[int, int, int, int]] = set()
        for i, low, high in self.bounded(self.classes.take(text), self.regions(text)).tolist():
            begin, end = max(low, 0), min(high + int(self.sizes[i]), len(text))
            d = int(np.searchsorted(first, begin, "right")) - 1
            while d < len(texts) and first[d] < end:
                pairs.add((d, i, max(begin, int(first[d])), min(end, int(first[d]) + len(texts[d]))))
                d += 1
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for d, i, begin, end in pairs:
            far, stop = least_distance(self.texts[i], whole[begin:end])
            if far <= self.most[i]:
                best[d, i] = min(best.get((d, i), (far, begin + stop)), (far, begin + stop))
        return [(d, i, far, whole.count(" ", int(first[d]), max(int(first[d]), end - int(self.sizes[i])))) for (d, i), (far, end) in best.items()]


def item_blocks(items: DataFrame) -> list[list[tuple]]:
    """The items (item_id, text) in lists of about BLOCK_BYTES at most; the last in size order may be one item alone."""
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK_BYTES))
    own = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    return [[tuple(r) for r in own.where(block == k).collect()] for k in range(blocks)]


def find_leaks(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """doc_id, item_id, distance, item_chars, first_word: one row per document row and item found in it.

    Texts are compared lower-cased (A-Z) with white space as single spaces. An item is found
    where some part of the text is at most (1 - similarity) * item_chars edits away and enough
    walks agree: all exact passages, and a share of about `recall` or more of those with as many
    edits at random places as the bound allows. recall = 1 finds all, at many times the cost.
    Documents never move: each block of items is searched in one pass over them. Null or blank
    items and texts match nothing; repeated rows give repeated results; other columns are ignored,
    whatever their names; an empty table on either side gives no rows.
    """
    out = None
    for block in item_blocks(items):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def start(shared=shared):
            known = Items(shared.value, similarity, recall)

            def work(ids, texts):
                split = [x.lower().split() for x in bytes_of(texts)]
                ids = ids.to_pylist()
                rows = [(ids[d], known.ids[i], far, len(known.texts[i]), at) for d, i, far, at in known.matches(split)]
                return list(zip(*rows)) if rows else None

            return work

        found = arrow_map(
            docs,
            [F.col("doc_id").cast("long"), "text"],
            "doc_id long, item_id long, distance long, item_chars long, first_word long",
            start,
            rows=SLICE,
        )
        out = found if out is None else out.union(found)
    return out


def drop_leaks(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """The rows of docs in which find_leaks finds no item, with all their columns; texts are judged in place, nothing is shuffled.

    Null, empty and repeated rows without an item stay as they are.
    """

    def clean_of(shared: Broadcast):
        @F.pandas_udf("boolean")
        def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            known = Items(shared.value, similarity, recall)
            for texts in batches:
                keep = np.ones(len(texts), bool)
                for at in range(0, len(texts), SLICE):
                    split = [(t or "").encode().lower().split() for t in texts.iloc[at : at + SLICE]]
                    keep[[at + m[0] for m in known.matches(split)]] = False
                yield pd.Series(keep)

        return clean

    for block in item_blocks(items):
        docs = docs.where(clean_of(docs.sparkSession.sparkContext.broadcast(block))(F.col("text")))
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
