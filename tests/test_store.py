"""The bucketed state: batches against the plain merge of a whole table, what a batch writes, and bitmaps that lose nothing."""

import os
import random

import pytest
from pyspark.sql import functions as F

from inkwell.operators import bitmaps, identity, state
from inkwell.streaming import store

KEYS = "seq long, source_url string, canonical_url string, item_key string, column_name string, content_hash string, title string"


def rows_of(spark, rows):
    null = F.lit(None).cast("string")
    more = {n: null for n in ("file_path", "published_at", "summary_status", "error_message")} | {"status": F.lit("synced"), "has_transcript": F.lit(True), "transcribed": F.lit(False)}
    return spark.createDataFrame(rows, KEYS).withColumns(more)


def whole(items, incoming, now):
    for names in (["item_key", "column_name"], ["content_hash"]):
        incoming = identity.mark_repeats(incoming, names).where("not duplicate").drop("duplicate")
    return state.upsert(items, identity.resolve(incoming, items).drop("match_kind"), now)


def size(root):
    return sum(os.path.getsize(os.path.join(d, n)) for d, _, names in os.walk(root) for n in names)


def show(items):
    return sorted(map(str, items.collect()))


@pytest.mark.parametrize("seed", range(1))
def test_batches_equal_the_whole_merge(spark, tmp_path, seed):
    rnd = random.Random(seed)
    held, want = store.Store(spark, f"{tmp_path}/s", 4), spark.createDataFrame([], state.ITEMS)
    for batch in (3, 7, 8, 20):  # numbers may have gaps
        rows = []
        for k in range(25):
            u = rnd.randrange(40)
            rows.append((batch * 100 + k, rnd.choice([f"u{u}", f"u{u}", None, ""]), rnd.choice([f"u{u}", f"v{rnd.randrange(20)}", None]), rnd.choice([f"i{u}", None]), rnd.choice("ab"), rnd.choice([f"h{batch}{k}", f"h{rnd.randrange(90)}", None]), f"t{batch}-{k}"))
        incoming = rows_of(spark, rows)
        assert held.merge(incoming, batch, f"now{batch}") and not held.merge(incoming, batch, "again")
        want = spark.createDataFrame(whole(want, incoming, f"now{batch}").collect(), state.ITEMS)
        assert show(held.items()) == show(want)
        if batch == 8:
            assert held.compact(1) > 0 and held.compact(99) == 0 and show(held.items()) == show(want)


def test_a_batch_writes_what_it_changes(spark, tmp_path):
    held = store.Store(spark, f"{tmp_path}/s", 16)
    many = rows_of(spark, [(k, f"u{k}", f"u{k}", f"i{k}", "c", f"h{k}", "title " * 20 + str(k)) for k in range(4000)])
    held.merge(many, 0, "n0")
    first = size(f"{tmp_path}/s")
    held.merge(rows_of(spark, [(1, "u7", "u7", "i7", "c", "h7", "new"), (2, "w1", "w1", "w1", "c", "w1", "new")]), 1, "n1")
    assert size(f"{tmp_path}/s") - first < first / 15
    assert {r.id: r.title for r in held.items().where("title = 'new'").collect()} == {8: "new", 4001: "new"} and held.items().count() == 4001


def test_a_batch_that_breaks_off_does_not_count(spark, tmp_path, monkeypatch):
    held = store.Store(spark, f"{tmp_path}/s", 4)
    rows = rows_of(spark, [(1, "u1", None, None, "c", None, "t")])

    def lost(entries):
        raise OSError("lost")

    monkeypatch.setattr(held, "_commit", lost)
    with pytest.raises(OSError):
        held.merge(rows, 0, "n")
    monkeypatch.undo()
    assert held.items().count() == 0 and held.merge(rows, 0, "n") and held.items().count() == 1
    assert store.Store(spark, f"{tmp_path}/s", 4).items().count() == 1 and held.merge(rows.limit(0), 1, "n")


def test_ingest_reads_what_is_new(spark, tmp_path):
    source, root = f"{tmp_path}/in", f"{tmp_path}/s"
    schema = rows_of(spark, []).schema
    for k, rows in enumerate(([(1, "u1", "u1", None, "c", None, "a"), (2, "u2", "u2", None, "c", None, "b")], [(3, "u1", "u1", None, "c", None, "c")])):
        rows_of(spark, rows).write.mode("append").parquet(source)
        store.ingest(spark, source, schema, root, f"n{k}", f"{tmp_path}/checkpoint", 4).awaitTermination()
    assert {r.source_url: (r.title, r.updated_at) for r in store.Store(spark, root, 4).items().collect()} == {"u1": ("c", "n1"), "u2": ("b", "n0")}


def test_bitmaps_lose_nothing(spark):
    rows = spark.range(3000).select("id", F.xxhash64("id").alias("key")).withColumn("key", F.when(F.col("id") % 7 > 0, F.col("key")))
    for bits in (7, 10, 16):
        held = bitmaps.bitmap(rows.where("id < 500"), "key", bits)
        assert held.count() <= 1 << (bits - 6)
        found = {r.id for r in bitmaps.may_hold(rows, held, [F.col("key")], bits).collect()}
        assert {i for i in range(500) if i % 7} <= found and not any(i % 7 == 0 for i in found)
    assert len(found) < 600


def test_candidates_change_no_result(spark):
    rnd = random.Random(5)
    row = lambda k: (k, *(rnd.choice([f"{p}{rnd.randrange(300)}", None, ""]) for p in "usi"), rnd.choice("ab"), rnd.choice([f"h{rnd.randrange(300)}", None]))
    schema = "id long, source_url string, canonical_url string, item_key string, column_name string, content_hash string"
    items, incoming = (spark.createDataFrame([row(k) for k in range(n)], schema) for n in (2000, 30))
    few = identity.candidates(items, incoming, 14)
    assert few.count() < 700
    for f in (identity.resolve, identity.new_items, identity.known_items):
        assert show(f(incoming, few)) == show(f(incoming, items))
