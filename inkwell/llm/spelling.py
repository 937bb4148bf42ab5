"""Spelling variants: neighbours at one edit, found by pairs of trie nodes.

The prefixes of all words are the nodes of a trie and their suffixes those of a trie of reversed
words. A word cut at a place is a pair of a prefix node and a suffix node; a word without its letter
at a place is such a pair across the gap. Two words differ in one replaced letter if they have a
pair across a gap in common, and in one inserted letter if one's pair across a gap is a cut of the
other. Pairs are integers, so the join is exact and no text is compared.
"""

from __future__ import annotations

import math
import os
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, read_table, written

LEAST_LETTERS = 7
LEAST_TIMES = 2
#: A near word so many times as frequent is the form of a word.
TIMES = 10
#: The query deletes a letter where this divides a run's checksum.
DAMAGE = 31
#: Distinct words that a task gathers before it passes their counts on.
GATHER = 200_000
#: Latin-1 bytes to letters, A-Z in lower case, or spaces.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
#: Kinds of pairs: a cut; a gap; a gap at the first of equal letters, so that a deletion counts once.
CUT, GAP, FIRST_GAP = 0, 1, 2


def damaged(run: bytes, prefix: int, every: int) -> bytes:
    """A run (Latin-1), without one letter where `every` divides the checksum of prefix and run."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), prefix)
    return run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run


def count_words(docs: DataFrame, letters: int = LEAST_LETTERS, times: int = LEAST_TIMES, damage: int = 0) -> DataFrame:
    """word, n: runs of letters (A-Z, a-z, U+00C0 to U+00FF; only A-Z in lower case) with their occurrences.

    Words of fewer than `letters` letters or `times` occurrences are left out. With damage, a letter of
    every so many runs is deleted first, by the crc32 of doc_id and run. Null texts have no words, a
    null id is written as nothing; repeated rows count again; other columns are ignored; an empty table has no words.
    """

    def start():
        found = Counter()

        def take():
            rows = [w.decode("latin-1") for w in found], list(found.values())
            found.clear()
            return rows if rows[0] else None

        def work(*columns):
            if not columns:
                return take()
            for i, text in zip(*(c.to_pylist() for c in columns)):
                runs = [w for w in (text or "").encode("latin-1", "replace").translate(LETTERS).split() if len(w) >= letters]
                if not damage:
                    found.update(runs)
                    continue
                prefix = zlib.crc32(b"" if i is None else b"%d" % i)
                prefix = zlib.crc32(b":", prefix)
                for run, n in Counter(runs).items():
                    word = damaged(run, prefix, damage)
                    if len(word) >= letters:
                        found[word] += n
            return take() if len(found) > GATHER else None

        return work

    parts = arrow_map(docs, [F.col("doc_id").cast("long"), "text"], "word string, n long", start, finish=True)
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


def numbered_nodes(words: DataFrame, word: str) -> DataFrame:
    """words with part, at and nodes: the numbers of the trie nodes on the way to each word.

    Words (no two alike) are dealt and sorted by ranges, so words with a common prefix follow each
    other: a node is new where the prefix is longer than what the word before has of it. A number
    is made of the part and a count in it; `at` follows the order of words. Nodes that begin in an
    earlier part have several numbers until `same_nodes` joins them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        base = part << 40
        last, path, count, rows = "", [], 0, 0
        for batch in batches:
            nodes, ends = [], [0]
            for one in batch.column(names.index(word)).to_pylist():
                kept = len(os.path.commonprefix((last, one)))
                del path[kept:]
                path.extend(range(base + count + 1, base + count + 1 + len(one) - kept))
                count += len(one) - kept
                nodes += path
                ends.append(len(nodes))
                last = one
            at = np.arange(rows, rows + batch.num_rows) + base
            rows += batch.num_rows
            lists = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(nodes, pa.int64())).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), pa.array(at), lists], [*names, "part", "at", "nodes"])

    names = words.columns
    schema = ", ".join(f"`{n}` {t}" for n, t in words.dtypes)
    return words.repartitionByRange(word).sortWithinPartitions(word).mapInArrow(run, f"{schema}, part int, at long, nodes array<long>")


def same_nodes(table: DataFrame, word: str) -> dict[int, int]:
    """Of a written table of numbered_nodes: nodes at the beginning of a part -> the first number of the same prefix.

    A prefix of a part's first word is older if the last word before the part has it. The driver gets
    two words of each part.
    """
    ends = table.groupBy("part").agg(F.min("at").alias("first"), F.max("at").alias("last")).collect()
    held = {r["at"]: r for r in table.where(F.col("at").isin([x for r in ends for x in (r["first"], r["last"])])).collect()}
    same, before, path = {}, "", []
    for row in sorted(ends, key=lambda r: r["part"]):
        first, last = held[row["first"]], held[row["last"]]
        for k in range(len(os.path.commonprefix((before, first[word])))):
            same[first["nodes"][k]] = path[k]
        before, path = last[word], [same.get(x, x) for x in last["nodes"]]
    return same


def pairs_of(rows: DataFrame, forward: dict[int, int], backward: dict[int, int]) -> DataFrame:
    """(p, s, id, tag): the pairs of nodes of each word (id, n, letters, nodes, suffixes); tag is 4 * n + kind."""

    def table(same: dict[int, int]):
        keys = np.array(sorted(same), np.int64)
        return keys, np.array([same[k] for k in keys.tolist()], np.int64)

    tables = table(forward), table(backward)

    def joined(nodes: np.ndarray, same: tuple) -> np.ndarray:
        keys, values = same
        if not len(keys):
            return nodes
        at = np.minimum(np.searchsorted(keys, nodes), len(keys) - 1)
        return np.where(keys[at] == nodes, values[at], nodes)

    def start():
        def work(ids, times, words, nodes, suffixes):
            n = len(ids)
            if not n:
                return None
            letters = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32)
            sizes = nodes.value_lengths().to_numpy()
            ends = np.cumsum(sizes)
            starts = ends - sizes
            of = np.repeat(np.arange(n), sizes)
            place = np.arange(len(of)) - starts[of]  # of each letter in its word
            prefix = joined(nodes.flatten().to_numpy(), tables[0])  # up to and with the letter
            tail = joined(suffixes.flatten().to_numpy(), tables[1])  # by length: one letter, two letters, ...
            suffix = tail[starts[of] + sizes[of] - 1 - place]  # from the letter on
            before = np.where(place > 0, np.r_[0, prefix[:-1]], 0)
            after = np.where(place < sizes[of] - 1, np.r_[suffix[1:], 0], 0)
            first = (place == 0) | np.r_[True, letters[1:] != letters[:-1]]
            ids, tag = np.asarray(ids), 4 * np.asarray(times)
            # a cut before each letter and one at the end; a gap at each letter
            return [
                np.r_[before, prefix[ends - 1], before],
                np.r_[suffix, np.zeros(n, np.int64), after],
                np.r_[ids[of], ids, ids[of]],
                np.r_[tag[of] + CUT, tag + CUT, tag[of] + np.where(first, FIRST_GAP, GAP)],
            ]

        return work

    return arrow_map(rows, ["id", "n", "letters", "nodes", "suffixes"], "p long, s long, id long, tag long", start, rows=2048)


def _best_others(group: np.ndarray, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row: how many others its group has, and the row of largest n (ties: least id) among them, or -1.

    Rows are sorted by group, falling n and id.
    """
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    size, first = np.repeat(sizes, sizes), np.repeat(starts, sizes)
    best = np.where(np.arange(len(group)) == first, first + 1, first)
    return size - 1, np.where(size > 1, np.minimum(best, len(group) - 1), -1), first


def neighbours(pairs: DataFrame) -> DataFrame:
    """id, n_near, best_n, best: how many words are one edit away, and which has the largest n (ties: the least id).

    Words of a pair are as many as there are letters, at most, and one more; each task reads its pairs
    sorted, and passes on what each word of a pair has in the others.
    """

    def found(p, s, ids, tag) -> list[np.ndarray]:
        kind, n = tag & 3, tag >> 2
        new = np.r_[True, (p[1:] != p[:-1]) | (s[1:] != s[:-1])]
        group = np.cumsum(new) - 1
        many = np.bincount(group)[group] > 1
        group, kind, n, ids = group[many], kind[many], n[many], ids[many]
        out = [[], [], [], []]

        def add(who, near, best_n, best):
            for column, values in zip(out, (who, near, best_n, best)):
                column.append(values)

        order = np.lexsort((ids, -n, group))
        group, kind, n, ids = group[order], kind[order], n[order], ids[order]
        gaps = np.flatnonzero(kind != CUT)
        near, best, _ = _best_others(group[gaps], ids[gaps], n[gaps]) if len(gaps) else (np.empty(0, int),) * 3
        some = near > 0
        add(ids[gaps[some]], near[some], n[gaps[best[some]]], ids[gaps[best[some]]])
        cuts, firsts = np.flatnonzero(kind == CUT), np.flatnonzero(kind == FIRST_GAP)
        if len(cuts) and len(firsts):
            # a group has one cut at most: all words with this cut are one word
            cut_of = np.full(group[-1] + 1, -1)
            cut_of[group[cuts]] = cuts
            longer = firsts[cut_of[group[firsts]] >= 0]
            shorter = cut_of[group[longer]]
            add(ids[longer], np.ones(len(longer), np.int64), n[shorter], ids[shorter])
            begin = np.flatnonzero(np.r_[True, shorter[1:] != shorter[:-1]]) if len(longer) else np.empty(0, int)
            add(ids[shorter[begin]], np.diff(np.r_[begin, len(longer)]), n[longer[begin]], ids[longer[begin]])
        return [np.concatenate(x).astype(np.int64) for x in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "near", "best_n", "best"]
        held = [np.empty(0, np.int64)] * 4
        for batch in batches:
            held = [np.concatenate([a, np.asarray(b)]) for a, b in zip(held, batch.columns)]
            if not len(held[0]):
                continue
            cut = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))
            cut = cut[-1] + 1 if len(cut) else 0
            if cut:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found(*(c[:cut] for c in held))], names)
                held = [c[cut:] for c in held]
        if len(held[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found(*held)], names)

    parts = pairs.repartition("p", "s").sortWithinPartitions("p", "s").mapInArrow(run, "id long, near long, best_n long, best long")
    top = F.max(F.struct("best_n", (-F.col("best")).alias("b"))).alias("top")
    return parts.groupBy("id").agg(F.sum("near").alias("n_near"), top).select("id", "n_near", F.col("top.best_n").alias("best_n"), (-F.col("top.b")).alias("best"))


def followed(forms: DataFrame, most: int, times: int) -> DataFrame:
    """forms (id, form) with form as the last that forms lead to; n grows `times` times with each, so few doublings reach it."""
    steps, done = math.floor(math.log(most, times)) + 1, 1
    while done < steps:
        last = forms.select(F.col("id").alias("form"), F.col("form").alias("further"))
        forms = written(forms.join(last, "form", "left").select("id", F.coalesce("further", "form").alias("form")))
        done *= 2
    return forms


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n of words (word, n; no word twice, none empty).

    Two words are near if they differ in exactly one inserted, deleted or replaced code point. form is
    the near word of largest n (ties: the smallest by code points), if that is `times` times the word's
    n or more, else null; root is the last of a word's forms, or the word. Null words are left out;
    other columns are ignored; an empty table gives no rows.
    """
    if times < 2:
        raise ValueError("a form must be twice as frequent at least, or forms could lead in circles")
    words = words.select("word", F.col("n").cast("long").alias("n")).where("word is not null and word <> ''")
    forward = written(numbered_nodes(words, "word"))
    backward = written(numbered_nodes(forward.select(F.reverse("word").alias("letters"), F.col("at").alias("id")), "letters"))
    joined = forward.select(F.col("at").alias("id"), "n", F.col("word").alias("letters"), "nodes").join(backward.select("id", F.col("nodes").alias("suffixes")), "id")
    near = neighbours(pairs_of(joined, same_nodes(forward, "word"), same_nodes(backward, "letters")))
    own = forward.select(F.col("at").alias("id"), "word", "n")
    has = F.col("best_n") >= times * F.col("n")
    rows = written(own.join(near, "id", "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("best")).alias("form_id"), F.when(has, F.col("best_n")).alias("form_n")))
    most = rows.agg(F.max("n")).first()[0] or 1
    roots = followed(rows.where("form_id is not null").select("id", F.col("form_id").alias("form")), most, times)
    named = roots.join(own.select(F.col("id").alias("form"), F.col("word").alias("root")), "form").join(rows.where("form_id is not null").select("id", "form_id"), "id")
    named = named.join(own.select(F.col("id").alias("form_id"), F.col("word").alias("form_word")), "form_id").select("id", "root", F.col("form_word").alias("form"))
    return rows.join(named, "id", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(count_words(read_table(spark, sf_dir, "documents"), damage=DAMAGE))
