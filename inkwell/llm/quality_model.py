"""Quality by positive-unlabelled learning with the non-negative risk estimator."""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, bytes_of, crc_of_id, read_table

#: Rows that training reads at most, about: trusted positives and unlabelled texts.
POSITIVES = 6000
UNLABELLED = 12000
#: Class prior where there are no positives or no unlabelled texts to tell it.
PRIOR = 0.5
#: Share of the positives that the part of all texts from which the prior is read holds at least.
TRUSTED = 0.2
BINS = 12
THRESHOLD = 0.7
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FEATURES = (
    "log_words", "word_length", "symbols", "marks", "upper", "digits", "stops", "line_words", "repeated_lines",
    "distinct_words", "top_word", "echoes", "repeated_pairs", "joined_marks",
)


def features(text: bytes) -> list[float]:
    """Shape of a text (UTF-8): no word is known by name, so the model carries over to other languages."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    size = max(1, len(text))
    without = lambda chars: (size - len(text.translate(None, chars))) / size
    lines = [x for x in text.split(b"\n") if x.strip()]
    found = Counter(words)
    pairs = list(zip(words, words[1:]))
    return [
        float(np.log1p(n)), sum(map(len, words)) / n, without(b"#*$%&|<>"), without(b"!?"), without(UPPER), without(b"0123456789"),
        without(b".,;:"), n / len(lines), 1 - len(set(lines)) / len(lines), len(found) / n, max(found.values()) / n,
        sum(a == b for a, b in pairs) / n, 1 - len(set(pairs)) / max(1, len(pairs)), sum(text.count(x) for x in (b"!!", b"$$", b"##", b"%%", b"&&", b"**")) / n,
    ]


class Model:
    """Logistic scores over features cut at the quantiles of the training rows."""

    def __init__(self, positives: np.ndarray, unlabelled: np.ndarray, prior: float):
        every = np.concatenate([positives, unlabelled])
        self.prior = prior
        at = np.linspace(0, 1, BINS + 1)[1:-1]
        # besides the quantiles, a cut above the bulk, where what is rare begins
        self.cuts = [np.unique(np.r_[np.quantile(x, at), np.quantile(x, [0.95, 0.98])]) if len(x) else np.zeros(0) for x in every.T]
        self.first = np.cumsum([0, *(len(c) + 1 for c in self.cuts)])
        self.weights, self.bias = np.zeros(self.first[-1]), 0.0
        if len(positives) and len(unlabelled):
            self._fit(self.hot(positives), self.hot(unlabelled))
        else:
            self.bias = float(np.log(prior / (1 - prior)))

    def hot(self, rows: np.ndarray) -> np.ndarray:
        """Indices of the one bin of each feature."""
        return np.stack([self.first[k] + np.searchsorted(c, rows[:, k], "right") for k, c in enumerate(self.cuts)], axis=1)

    def raw(self, hot: np.ndarray) -> np.ndarray:
        return self.weights[hot].sum(1) + self.bias

    def _fit(self, p: np.ndarray, u: np.ndarray, steps: int = 600, rate: float = 0.05, decay: float = 1e-4) -> None:
        """Adam on prior * R(p, +) + max(0, R(u, -) - prior * R(p, -)), logistic loss."""
        size = len(self.weights)
        m, v = np.zeros(size + 1), np.zeros(size + 1)
        self.bias = float(np.log(self.prior / (1 - self.prior)))
        for step in range(1, steps + 1):
            fp, fu = self.raw(p), self.raw(u)
            sp, su = 1 / (1 + np.exp(-fp)), 1 / (1 + np.exp(-fu))
            negative = np.logaddexp(0, fu).mean() - self.prior * np.logaddexp(0, fp).mean()
            gp_plus, gp_minus, gu_minus = -self.prior * (1 - sp) / len(p), -self.prior * sp / len(p), su / len(u)
            if negative >= 0:
                gp, gu = gp_plus + gp_minus, gu_minus
            else:  # step back from a negative risk
                gp, gu = -gp_minus, -gu_minus
            grad = np.bincount(p.ravel(), np.repeat(gp, p.shape[1]), size) + np.bincount(u.ravel(), np.repeat(gu, u.shape[1]), size)
            grad = np.r_[grad + decay * self.weights, gp.sum() + gu.sum()]
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
            self.weights -= move[:-1]
            self.bias -= float(move[-1])

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(self.hot(rows)), -50, 50)))


def estimate_prior(positives: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled, from these two alone.

    Of any part of the texts the unlabelled hold at least prior times the share that the
    positives have in it. The tightest part is looked for among the highest scores of a model
    that tells the two apart, fitted on one half and read, with two standard errors, on the other.
    """
    if len(positives) < 4 or len(unlabelled) < 4:
        return PRIOR
    model = Model(positives[::2], unlabelled[::2], PRIOR)
    p, u = np.sort(model.scores(positives[1::2])), np.sort(model.scores(unlabelled[1::2]))
    at = np.unique(p[: len(p) - int(TRUSTED * len(p))])
    share_p, share_u = (1 - np.searchsorted(x, at, "left") / len(x) for x in (p, u))
    upper = share_u + 2 * np.sqrt((share_u * (1 - share_u) + 1 / len(u)) / len(u))
    lower = np.maximum(share_p - 2 * np.sqrt((share_p * (1 - share_p) + 1 / len(p)) / len(p)), 1e-9)
    best = int(np.argmin(upper / lower))
    return float(np.clip(share_u[best] / share_p[best], 0.01, 0.99))


def feature_rows(docs: DataFrame, columns: list) -> DataFrame:
    """The given columns and `x`, the array of features of the text."""

    def start():
        return lambda *cols: [*cols[:-1], [features(t) for t in bytes_of(cols[-1])]]

    schema = ", ".join(f"{n} {t}" for n, t in docs.select(*columns).dtypes)
    return arrow_map(docs, [*columns, "text"], f"{schema}, x array<double>", start)


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Fits on rows whose crc32 remainder is not 2: those labelled 1 are trusted, others unlabelled.

    The prior is estimated from these two alone: labels other than 1 are not read. At most about
    `positives` and `unlabelled` rows, chosen by a hash of the id, are read and sent to the driver
    as features; copies of one id and text are one row there.
    """
    seen = labels.where((crc_of_id("doc_id") % 4 != 2) & (F.col("quality") == 1))
    ones = seen.count()
    own = docs.where((crc_of_id("doc_id") % 4 != 2) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n_docs = own.select("doc_id").count()
    drawn = lambda bound, n, seed: F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id").cast("long")), F.lit(1 << 20)) < F.lit(min(1.0, bound / max(1, n)) * (1 << 20))
    trusted = seen.where(drawn(positives, ones, 1)).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    # about `positives` ids at most, so they are small enough to send to every task
    p = own.join(F.broadcast(trusted), "doc_id", "left_semi").select(F.lit(1).alias("kind"), "doc_id", "text")
    u = own.where(drawn(unlabelled, n_docs, 2)).select(F.lit(0).alias("kind"), "doc_id", "text")
    rows = feature_rows(p.union(u).distinct(), ["kind"]).toPandas()
    x = np.array(rows["x"].tolist(), float).reshape(-1, len(FEATURES))
    kind = rows["kind"].to_numpy(int)
    return Model(x[kind == 1], x[kind == 0], estimate_prior(x[kind == 1], x[kind == 0]))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per input row.

    Null and empty texts have all features zero and are scored like any other; repeated rows
    give repeated results; null ids stay null; only the text is read for a score.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        def work(ids, held, texts):
            x = np.array([features(t) for t in bytes_of(texts)], float).reshape(-1, len(FEATURES))
            s = shared.value.scores(x)
            return [ids, held, s, (s >= threshold).astype(np.int32)]

        return work

    return arrow_map(
        docs,
        [F.col("doc_id").cast("long"), (crc_of_id("doc_id") % 4 == 2).alias("held_out"), "text"],
        "doc_id long, held_out boolean, score double, predicted int",
        start,
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score(docs, train(docs, read_table(spark, sf_dir, "labels")))
