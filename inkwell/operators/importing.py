"""Taking over notes as items, in order: each note meets the items as the notes before it left them.

A note finds an item by its address, then by the item's latest address, then by id and column, and
what it finds it changes; so the order decides. But only notes that a key or an item connects can
change what another one finds. Notes with one address and column are a class; classes that share an
address, an id in one column or a stored item are a group; a group of one class needs no order but
its own, and only the notes of larger groups are read one after the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.operators import graph, numbering, state
from inkwell.operators.identity import filled
from inkwell.sources.shared import stored

#: The keys of a note, in the order of their test, and the columns of items that they are compared with.
KEYS = ((["source_url"], ["source_url"]), (["source_url"], ["canonical_url"]), (["item_key", "column_name"], ["item_key", "column_name"]))


def _hits(classes: DataFrame, items: DataFrame) -> DataFrame:
    """class, rank, id: the stored items that a class finds, by each key."""
    out = None
    for rank, (own, theirs) in enumerate(KEYS):
        held = items.where(filled(theirs)).select("id", *(F.col(c).alias(f"_{n}") for n, c in enumerate(theirs)))
        asked = classes.where(filled(own)).select("class", *(F.col(c).alias(f"_{n}") for n, c in enumerate(own)))
        found = asked.join(held, [f"_{n}" for n in range(len(own))]).select("class", F.lit(rank).alias("rank"), "id")
        out = found if out is None else out.union(found)
    return out


def _groups(classes: DataFrame, hits: DataFrame, items: DataFrame) -> DataFrame:
    """class, group: the classes that others are connected with, and the least class of their group."""
    with_id = classes.where(filled(["item_key", "column_name"]))
    of_address = classes.where(filled(["source_url"])).select("class", F.xxhash64("source_url").alias("key"))
    of_id = with_id.select("class", F.xxhash64("item_key", "column_name").alias("key"))
    of_item = hits.select("class", F.col("id").alias("key")).distinct()
    links = None
    for shared in (of_address, of_id, of_item):
        least = shared.groupBy("key").agg(F.min("class").alias("b"), F.max("class").alias("most")).where("b < most")
        pairs = shared.join(least.select("key", "b"), "key").where("class <> b").select(F.col("class").alias("a"), "b")
        links = pairs if links is None else links.union(pairs)
    links = stored(links)
    if classes.where(~filled(["item_key"])).isEmpty():
        return _members(links)
    # a note without an id moves an item, with the id it has, to the note's column: who looks for that id there is of the group
    ids = with_id.select("class", "item_key").union(hits.join(items.where(filled(["item_key"])).select("id", "item_key"), "id").select("class", "item_key"))
    while True:
        members = _members(links)
        group = classes.join(members, "class", "left").withColumn("group", F.coalesce("group", "class"))
        moved = group.where(~filled(["item_key"])).select("group", "column_name").distinct()
        known = ids.join(group.select("class", "group"), "class").select("group", "item_key").distinct()
        found = moved.join(known, "group").withColumnRenamed("group", "b").join(group.select("item_key", "column_name", "class", "group"), ["item_key", "column_name"])
        more = stored(found.where("group <> b").select(F.col("class").alias("a"), "b"))
        if more.isEmpty():
            return members
        links = links.union(more)


def _members(links: DataFrame) -> DataFrame:
    return stored(graph.groups(links).select(F.col("node").alias("class"), F.col("root").alias("group")))


def _folded(rows: DataFrame) -> DataFrame:
    """place, id, made: what each note finds, where it matters what notes before it did.

    rows: group, place (null: a stored item), id, source_url, canonical_url, item_key, column_name. A
    task reads a group's items, then its notes in order, and holds the group's items only.
    """

    class Items:
        def __init__(self):
            self.rows: dict[tuple, list] = {}
            self.by: tuple[dict, ...] = ({}, {}, {})

        def keys(self, row: list) -> list:
            source, canonical, item_key, column = row
            return [source or None, canonical or None, (item_key, column) if item_key and column else None]

        def put(self, name: tuple, row: list) -> None:
            old = self.rows.get(name)
            for index, was, now in zip(self.by, self.keys(old) if old else [None] * 3, self.keys(row)):
                if was is not None and was != now:
                    index[was].discard(name)
                if now is not None:
                    index.setdefault(now, set()).add(name)
            self.rows[name] = row

        def find(self, address: str, item_key: str | None, column: str) -> tuple | None:
            """The least item of the first key that finds any; new items come after stored ones."""
            asked = (address or None, address or None, (item_key, column) if item_key and column else None)
            for index, key in zip(self.by, asked):
                if key is not None and index.get(key):
                    return min(index[key])
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, items = None, Items()
        for batch in batches:
            out = []
            for own, place, number, source, canonical, item_key, column in zip(*(c.to_pylist() for c in batch.columns)):
                if own != group:
                    group, items = own, Items()
                if place is None:
                    items.put((0, number), [source, canonical, item_key, column])
                    continue
                found = items.find(source, item_key, column)
                name = found or (1, place)
                old = items.rows.get(name, [source, None, None, None])
                items.put(name, [old[0], source, item_key or old[2], column])
                out.append((place, name[1] if name[0] == 0 else None, name[1] if name[0] == 1 else None, found is None))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.bool_()))], ["place", "existing_id", "made", "new"])

    dealt = rows.repartition("group").sortWithinPartitions("group", F.col("place").isNotNull(), "place", "id")
    names = ["group", "place", "id", "source_url", "canonical_url", "item_key", "column_name"]
    return dealt.select(*names).mapInArrow(run, "place long, existing_id long, made long, new boolean")


def resolved(noted: DataFrame, items: DataFrame, order: list[str]) -> DataFrame:
    """noted with place, existing_id or made (the place of the note that made the item), and new.

    noted: source_url (its address), item_key, column_name and more; notes follow each other by the
    columns `order`, no two alike. An address or id that is null or empty finds nothing.
    """
    placed = stored(numbering.placed(noted, order, "place"))
    keyless = ~filled(["source_url"]) & ~filled(["item_key", "column_name"])
    placed = placed.withColumn("_own", F.when(keyless, F.col("place")))  # each an item of its own
    kinds = ["source_url", "item_key", "column_name", "_own"]
    classes = stored(placed.groupBy(*kinds).agg(F.min("place").alias("class")))
    hits = stored(_hits(classes, items))
    groups = _groups(classes, hits, items)
    first = hits.groupBy("class").agg(F.min(F.struct("rank", "id")).alias("m")).select("class", F.col("m.id").alias("existing_id"))
    columns = [c for c in placed.columns if c != "_own"]
    of_class = placed.join(classes, [placed[c].eqNullSafe(classes[c]) for c in kinds]).select(*(placed[c] for c in columns), "class").join(groups, "class", "left")
    alone = of_class.where("group is null").join(first, "class", "left")
    made = F.col("existing_id").isNull()
    alone = alone.select(*columns, "existing_id", F.when(made, F.col("class")).alias("made"), (made & (F.col("class") == F.col("place"))).alias("new"))
    if groups.isEmpty():
        return alone
    met = hits.join(groups, "class").select("group", "id").distinct().join(items.select("id", "source_url", "canonical_url", "item_key", "column_name"), "id")
    crowd = stored(of_class.where("group is not null"))
    null = F.lit(None)
    rows = met.select("group", null.cast("long").alias("place"), "id", "source_url", "canonical_url", "item_key", "column_name").union(
        crowd.select("group", "place", null.cast("long"), "source_url", null.cast("string"), "item_key", "column_name")
    )
    return alone.union(crowd.select(*columns).join(_folded(rows), "place").select(*columns, "existing_id", "made", "new"))


def tallies(noted: DataFrame, known: DataFrame) -> DataFrame:
    """imported, updated, no_transcript, no_summary of resolved notes, and missing_meta of all."""
    counts = known.agg(
        F.count_if("new").alias("imported"), F.count_if(~F.col("new")).alias("updated"),
        F.count_if(~F.col("has_transcript")).alias("no_transcript"), F.count_if(~F.col("has_summary")).alias("no_summary"),
    )
    return counts.crossJoin(noted.agg(F.count_if(F.col("outcome") == "missing_meta").alias("missing_meta")))  # one row each


def changed(items: DataFrame, known: DataFrame, now: str) -> DataFrame:
    """items after resolved notes: of an item's notes the last counts, its id is the last that is given, and a new item's address the first's."""
    last = lambda c: F.max_by(c, "place").alias(c)
    values = known.groupBy("existing_id", "made").agg(
        F.max_by("source_url", "place").alias("canonical_url"), F.min_by("source_url", "place").alias("source_url"),
        F.max_by("item_key", F.when(F.coalesce("item_key", F.lit("")) != "", F.col("place"))).alias("item_key"),
        *map(last, ("column_name", "title", "published_at", "path", "has_transcript", "has_summary")),
    )
    changes = values.select(
        F.col("made").alias("seq"), "existing_id", "source_url", "item_key", "canonical_url", F.lit(None).cast("string").alias("content_hash"), F.col("path").alias("file_path"),
        "column_name", "title", "published_at", F.lit("synced").alias("status"), "has_transcript", F.lit(False).alias("transcribed"),
        F.when(F.col("has_summary"), "success").alias("summary_status"), F.lit(None).cast("string").alias("error_message"),
    )
    return state.upsert(items, changes, now)
