import numpy as np
from conftest import SF
from pyspark.sql import functions as F

from inkwell.llm import context_mixing


def test_counts_are_of_all_training_words(spark, monkeypatch):
    counted, plain = [], context_mixing.symbol_counts
    monkeypatch.setattr(context_mixing, "symbol_counts", lambda units: counted.append(units.agg(F.sum("k")).first()[0]) or plain(units))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert context_mixing.score(docs, bits=10).first().train_tokens == counted[0]


def test_weights_are_of_all_training_words_and_tables_of_both_halves(spark):
    rows = [(b"word", 7, 3, 9), (b"other", 2, 2, 2), (b"third", 5, 0, 5), (b"held", 0, 0, 4), (b"", 6, 3, 8)]
    units = spark.createDataFrame(rows, "unit binary, c long, k long, n long")
    code = context_mixing.Code(np.ones(257))
    tables = context_mixing.corpus_tables(units.withColumn("rest", F.col("c") - F.col("k")), code, 8, ["k", "rest"])
    for table, column in zip(tables, ("k", "c - k", "c")):
        assert (table == context_mixing.corpus_counts(units.selectExpr("unit", f"{column} as k"), code, 8)).all()
    halves = [context_mixing.Mixer(code, t, 8) for t in tables[:2]]

    def add(total, mixer, words, times):
        total[halves_at[mixer.map[0, 0]]] += times.sum()

    halves_at = {0.0: 0, 1.0: 1}
    for k, m in enumerate(halves):
        m.map[0, 0] = float(k)
    assert context_mixing._sums(units, halves, 2, add).tolist() == [7 - 3 + 5 + 6 - 3, 3 + 2 + 3]
