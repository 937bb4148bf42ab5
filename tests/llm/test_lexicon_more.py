from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from inkwell.llm import context_mixing, lexicon

ODD = [None, "", "  ", "One", " two\tTWO\n\x0b\x0c\rtwo ", "É é x y\x85z\x1cq ÀÉ", "a\x00b \x00", "x" * 5000 + " \n" * 300, "end"]


def test_words_of_many_texts_equal_those_of_each():
    texts = pa.array(["cut", *ODD, *ODD]).slice(1)
    for some in (texts, texts.slice(0, 0), texts.slice(0, 2)):
        units, owner = context_mixing.units_of(some)
        own = [[] for _ in some]
        for u, k in zip(units.to_pylist(), owner.tolist(), strict=True):
            own[k].append(u)
        assert [Counter(x) for x in own] == [Counter(context_mixing.words_of((t or "").encode())) for t in some.to_pylist()]


def test_a_task_passes_a_unit_on_once_whatever_the_flags(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD * 40)], "doc_id long, text string").coalesce(1)
    passed, plain = [], lexicon.arrow_map
    monkeypatch.setattr(lexicon, "arrow_map", lambda *a, **k: passed.append(plain(*a, **k)) or passed[-1])
    flags = [F.col("doc_id") % 2 == 0, F.col("doc_id") % 3 == 0, F.lit(True)]
    got = {bytes(r[0]): tuple(r)[1:] for r in lexicon.count_units(docs, context_mixing.units_of, flags).collect()}
    want = {}
    for i, t in enumerate(ODD * 40):
        for u in context_mixing.words_of((t or "").encode()):
            want[u] = tuple(np.add(want.get(u, (0, 0, 0)), (i % 2 == 0, i % 3 == 0, 1)).tolist())
    assert got == want
    assert passed[0].count() == len(want)


def test_counts_passed_on_early_add_up(spark, monkeypatch):
    docs = spark.range(700).selectExpr("id as doc_id", "concat('w', id % 500, ' v', id) as text").coalesce(1)
    whole = {tuple(r) for r in lexicon.count_units(docs, context_mixing.units_of, [F.lit(True)]).collect()}
    monkeypatch.setattr(lexicon, "GATHER", 300)
    assert {tuple(r) for r in lexicon.count_units(docs, context_mixing.units_of, [F.lit(True)]).collect()} == whole


def test_urns_equal_plain_products():
    n, a = np.array([1, 2, 5, 1]), np.array([-1.0, -3.0, -0.5, -6.0])
    want = [sum(np.log10(100 * 10**x + t) for t in range(k)) for k, x in zip(n, a)]
    assert np.allclose(lexicon.urn_log10(100.0, a, n), want)
