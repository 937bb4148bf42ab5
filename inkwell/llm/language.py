"""Language identification by error-correcting output codes over hashed letter n-grams."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, crc_of_id, read_table

#: Documents of each language that training reads, at most about so many (chosen by a hash of the id).
SAMPLE = 6000
SLOTS = 1 << 16
#: Most languages that a model may have: each takes half a megabyte of counts on the driver.
LANGUAGES = 500
#: Least gap of decoded probability between the best two languages that is not ambiguous.
GAP = 0.2
LETTER = re.compile(r"[^\W\d_]")
#: Grams compared at once in a task.
CHUNK = 1 << 16
NOT_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def grams(text: str) -> np.ndarray:
    """Slots of the byte pairs and triples of the lower-cased letters of a text."""
    raw = np.frombuffer(b" " + b" ".join(text.lower().encode().translate(NOT_LETTERS).split()) + b" ", np.uint8).astype(np.uint32)
    two = raw[:-1] << np.uint32(8) | raw[1:]
    three = two[:-1] << np.uint32(8) | raw[2:]
    return np.concatenate([two, (three + np.uint32(1 << 24)) * np.uint32(2654435761) >> np.uint32(16)]) & np.uint32(SLOTS - 1)


def codewords(n: int) -> np.ndarray:
    """(n, bits) of +1 and -1: all two-way splits for up to 7 languages, else the best of several random codes."""
    if n <= 7:
        bits = max(1, 2 ** (n - 1) - 1)
        code = np.array([[(b + 1) >> (n - 1 - i) & 1 if i else 0 for b in range(bits)] for i in range(n)])
        return 1 - 2 * code
    rng, best = np.random.default_rng(7), None
    for _ in range(200):
        code = rng.choice([-1, 1], (n, int(np.ceil(10 * np.log2(n)))))
        far = (code.shape[1] - code @ code.T) // 2 + code.shape[1] * np.eye(n, dtype=int)
        if (abs(code.sum(0)) < n).all() and (best is None or far.min() > best[0]):
            best = (far.min(), code)
    return best[1]


class Model:
    """languages, their codewords, a weight per bit, and the classifiers: log odds of each slot per bit."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages, self.code = languages, codewords(len(languages)) if languages else np.zeros((0, 1), int)
        share = (counts + 0.5) / (counts + 0.5).sum(1, keepdims=True)
        odds, weight = [], []
        for bit in self.code.T:
            one, two = (share[bit == s].mean(0) if (bit == s).any() else np.full(SLOTS, 1 / SLOTS) for s in (1, -1))
            odds.append(np.log(one / two))
            weight.append(((one - two) * odds[-1]).sum() / 2)  # how well this bit can be told
        self.odds = np.array(odds, np.float32).T.copy() if odds else np.zeros((SLOTS, 1), np.float32)
        self.weight = np.array(weight) / max(np.mean(weight), 1e-9) if weight else np.ones(1)

    def margins(self, text: str) -> np.ndarray:
        slots = grams(text)
        total = np.zeros(self.odds.shape[1])
        for at in range(0, len(slots), CHUNK):
            total += self.odds.take(slots[at : at + CHUNK], axis=0).sum(0)
        return total / np.sqrt(len(slots))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """The language, its decoded probability, and whether another is close."""
        if not text or not self.languages or not LETTER.search(text):
            return "und", 0.0, True
        loss = (self.weight * np.logaddexp(0, -self.code * self.margins(text))).sum(1)
        chance = np.exp(loss.min() - loss)
        chance /= chance.sum()
        order = np.argsort(-chance, kind="stable")
        second = float(chance[order[1]]) if len(order) > 1 else 0.0
        best = float(chance[order[0]])
        return self.languages[order[0]], min(1.0, best), best - second < GAP


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits the bit classifiers on rows whose crc32 remainder is not 1 and that name a language.

    Reads about `sample` rows per language at most, by a hash of the id; what reaches the
    driver is one count per language and slot. Fails on more than LANGUAGES values of lang, which
    is then no column of languages.
    """
    own = docs.where((crc_of_id("doc_id") % 3 != 1) & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    sizes = own.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(LANGUAGES + 1).collect()
    if len(sizes) > LANGUAGES:
        raise ValueError(f"over {LANGUAGES} values of lang")
    languages = [r["lang"] for r in sizes]
    if not languages:
        return Model([], np.zeros((0, SLOTS)))
    code = F.create_map(*[F.lit(x) for i, r in enumerate(sizes) for x in (r["lang"], i)])
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, sample / r["n"]))])
    drawn = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20))

    def start():
        found: dict[int, np.ndarray] = {}

        def work(*columns):
            if columns:
                for lang, text in zip(columns[0].to_pylist(), columns[1].to_pylist()):
                    if text:
                        total = found.setdefault(lang, np.zeros(SLOTS, np.int64))
                        total += np.bincount(grams(text), minlength=SLOTS)
                return None
            used = [(k, np.flatnonzero(v), v) for k, v in found.items()]
            if not used:
                return None
            return [np.concatenate([np.full(len(i), k) for k, i, _ in used]), np.concatenate([i for _, i, _ in used]), np.concatenate([v[i] for _, i, v in used])]

        return work

    parts = arrow_map(drawn, [F.element_at(code, F.col("lang")).alias("lang"), "text"], "lang int, slot int, n long", start, finish=True)
    table = parts.groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(languages), SLOTS))
    counts[table["lang"].to_numpy(int), table["slot"].to_numpy(int)] = table["n"].to_numpy(float)
    return Model(languages, counts)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous: one row per input row.

    lang_pred is `und`, with score 0, if the text is null or has no letter, or nothing was
    learned. Repeated rows give repeated results; null ids stay null (their remainder is that
    of the empty text); only the text is read for a prediction.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        own = shared.value

        def work(ids, held, texts):
            found = [own.predict(t) for t in texts.to_pylist()]
            return [ids, held, *zip(*found)] if found else None

        return work

    return arrow_map(
        docs,
        [F.col("doc_id").cast("long"), (crc_of_id("doc_id") % 3 == 1).alias("held_out"), "text"],
        "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean",
        start,
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
