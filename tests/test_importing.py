"""Notes taken over in order, against a plain loop that looks each one up in the items as they then are."""

import random

import pytest
from pyspark.sql import functions as F

from inkwell.operators import importing, state

NOTES = "column_name string, path string, source_url string, item_key string, title string, published_at string, has_transcript boolean, has_summary boolean, outcome string"


def plain(items, notes):
    """(items by id, imported, updated): one note after the other."""
    rows, imported, updated = {r["id"]: dict(r) for r in items}, 0, 0
    for n in sorted(notes, key=lambda n: (n[0], n[1])):
        column, path, url, key, title, *_ = n
        found = [r for r in rows.values() if url and r["source_url"] == url] or [r for r in rows.values() if url and r["canonical_url"] == url]
        found = found or [r for r in rows.values() if key and r["item_key"] == key and r["column_name"] == column]
        if found:
            row = min(found, key=lambda r: r["id"])
            updated += 1
        else:
            row = {"id": max(rows, default=0) + 1, "source_url": url, "item_key": None}
            rows[row["id"]] = row
            imported += 1
        row |= {"canonical_url": url, "item_key": key or row["item_key"], "column_name": column, "title": title, "file_path": path}
    return rows, imported, updated


def stored_items(spark, rows):
    names = ["id", "source_url", "canonical_url", "item_key", "column_name"]
    table = spark.createDataFrame(rows, "id long, source_url string, canonical_url string, item_key string, column_name string")
    full = {f.name: F.col(f.name) if f.name in names else F.lit(None).cast(f.dataType) for f in state.ITEMS}
    return table.select(*(c.alias(n) for n, c in full.items()))


@pytest.mark.parametrize("seed", range(4))
def test_import_equals_a_plain_loop(spark, seed):
    rnd = random.Random(seed)
    many = seed % 2 == 0  # few addresses and ids: large groups
    address = lambda: f"u{rnd.randrange(6 if many else 60)}"
    ids = {f"u{k}": rnd.choice([None, "", f"i{k % 4}", f"i{k % 4}"]) for k in range(60)}  # an address has one id at most
    first = [address() for _ in range(12)]
    rows = [(k + 1, u, rnd.choice([u, address(), None]), rnd.choice([ids[u], "i1", None]), rnd.choice("ab")) for k, u in enumerate(dict.fromkeys(first))]
    notes = []
    for k in range(80):
        u = address()
        notes.append((rnd.choice("abc"), f"p{rnd.randrange(10**6):06}-{k}", u, ids[u], f"t{k}", None, True, k % 2 == 0, "item"))
    table = spark.createDataFrame(notes, NOTES)
    items = stored_items(spark, rows)
    known = importing.resolved(table, items, ["column_name", "path"])
    want, imported, updated = plain([r.asDict() for r in items.collect()], notes)
    counts = importing.tallies(table, known).first()
    assert (counts.imported, counts.updated, counts.no_transcript, counts.no_summary, counts.missing_meta) == (imported, updated, 0, 40, 0)
    names = ("id", "source_url", "canonical_url", "item_key", "column_name", "title", "file_path")
    got = sorted(tuple(r[n] for n in names) for r in importing.changed(items, known, "now").collect())
    assert got == sorted(tuple(r.get(n) for n in names) for r in want.values())


def test_notes_without_keys_are_items_of_their_own(spark):
    notes = [("c", f"p{k}", "" if k else None, None, "t", None, True, True, "item") for k in range(3)]
    table = spark.createDataFrame(notes, NOTES)
    items = stored_items(spark, [(1, "", None, "", "c")])
    assert importing.tallies(table, importing.resolved(table, items, ["path"])).first().imported == 3
    empty = spark.createDataFrame([], NOTES)
    assert importing.tallies(empty, importing.resolved(empty, items, ["path"])).first().imported == 0
    assert importing.changed(items, importing.resolved(empty, items, ["path"]), "now").count() == 1
