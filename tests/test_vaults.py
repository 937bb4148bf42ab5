"""Names beside taken ones against a loop that tries them in turn; the sink of notes, also where it breaks off."""

import os
import random

import pytest
from pyspark.sql import functions as F

from inkwell.operators import notes, workflow
from inkwell.sources import note_sink


def plain_names(rows, stored, longest=10**6):
    """seq -> path: what a writer does that looks each name up."""
    taken, out = dict(stored), {}

    def free(path, identity):
        stem, names = path.removesuffix(".md"), [path]
        names += [f"{stem}-{identity[:8]}.md"] + [f"{stem}-{identity[:8]}-{k}.md" for k in range(2, 100)]
        return next(n for n in names if taken.get(n, identity) == identity)

    late = []
    for seq, path, short, identity in sorted(rows):
        name = free(path, identity)
        if len(name) > longest:
            late.append((seq, short, identity))
            continue
        out[seq] = name
        taken[name] = identity
    for seq, short, identity in late:
        out[seq] = free(short, identity)
        taken[out[seq]] = identity
    return out


@pytest.mark.parametrize("seed", range(3))
def test_names_equal_a_loop(spark, seed):
    rnd = random.Random(seed)
    identity = lambda: f"h{rnd.randrange(2)}000000{rnd.randrange(6)}"
    rows = [(k, f"f/{'long' * (p % 2)}p{p}.md", f"f/s{p % 2}.md", identity()) for k, p in enumerate(rnd.choices(range(6), k=60))]
    stored = {}
    for p in range(6):
        for h in ("", "-h0000000", "-h1000000"):
            for n in ("", "-2", "-3", "-5", "-10", "-02"):
                if (h or not n) and rnd.random() < 0.4:
                    stored[f"f/{'long' * (p % 2)}p{p}{h}{n}.md"] = identity()
    table = spark.createDataFrame(rows, "seq int, path string, short string, identity string")
    vault = spark.createDataFrame(list(stored.items()), "path string, identity string")
    got = {r.seq: r.final_path for r in notes.without_collisions(table, vault).collect()}
    assert got == plain_names(rows, stored)
    got = {r.seq: r.final_path for r in notes.without_collisions(table, vault, short="short", longest=18).collect()}
    assert got == plain_names(rows, stored, 18)


def test_a_taken_name_with_a_hash(spark):
    rows = spark.createDataFrame([(1, "c/t.md", "abcdefgh99")], "seq int, path string, identity string")
    vault = spark.createDataFrame([("c/t.md", "x"), ("c/t-abcdefgh.md", "y")], "path string, identity string")
    assert notes.without_collisions(rows, vault).first().final_path == "c/t-abcdefgh-2.md"
    vault = vault.union(spark.createDataFrame([("c/t-abcdefgh-2.md", "abcdefgh99")], vault.schema))
    assert notes.without_collisions(rows, vault).first().final_path == "c/t-abcdefgh-2.md"
    assert notes.without_collisions(rows.limit(0), vault).count() == 0


def batch(spark, *rows):
    return spark.createDataFrame(rows, "final_path string, note string").repartition(3)


def held(root):
    return {os.path.relpath(os.path.join(d, n), root): open(os.path.join(d, n), encoding="utf-8").read() for d, _, names in os.walk(root) for n in names if not n.endswith(".crc")}


def test_batches_add_up_and_repeat_without_change(spark, tmp_path):
    root = f"{tmp_path}/vault"
    note_sink.write_notes(batch(spark, ("a/2024/x.md", "one\n"), ("a/y é+%.md", "two"), ("b/z.md", "z")), root)
    times = {n: os.stat(f"{root}/{n}").st_mtime_ns for n in held(root)}
    for _ in range(2):
        note_sink.write_notes(batch(spark, ("b/new.md", "three"), ("b/z.md", "z")), root)
    want = {"a/2024/x.md": "one\n", "a/y é+%.md": "two", "b/z.md": "z", "b/new.md": "three"}
    assert held(root) == want and all(os.stat(f"{root}/{n}").st_mtime_ns == t for n, t in times.items())
    assert {r.path: r.note for r in note_sink.read_notes(spark, root).collect()} == want
    note_sink.write_notes(batch(spark, ("a/2024/x.md", "last")), root)
    assert held(root) == want | {"a/2024/x.md": "last"}


def test_overwriting_leaves_other_folders(spark, tmp_path):
    root = f"file://{tmp_path}/vault"
    note_sink.write_notes(batch(spark, ("a/1.md", "1"), ("a/2.md", "2"), ("b/3.md", "3")), root)
    note_sink.write_notes(batch(spark, ("a/4.md", "4"), ("a/2.md", "2")), root, replace=True)
    assert held(f"{tmp_path}/vault") == {"a/2.md": "2", "a/4.md": "4", "b/3.md": "3"}
    note_sink.write_notes(batch(spark).limit(0), root, replace=True)
    assert len(held(f"{tmp_path}/vault")) == 3


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    root = f"{tmp_path}/vault"
    note_sink.write_notes(batch(spark, ("a/1.md", "kept")), root)
    with pytest.raises(Exception, match="not a path|STREAM|Task|failed|null|NoneType"):
        note_sink.write_notes(batch(spark, *((f"a/{k}.md", "new") for k in range(20)), ("a/bad.md", None)), root)
    with pytest.raises(Exception, match="not a path|failed|Task"):
        note_sink.write_notes(batch(spark, ("a/5.md", "new"), ("../out.md", "x")), root)
    assert {n: t for n, t in held(root).items() if not n.startswith(".staging")} == {"a/1.md": "kept"} and not os.path.exists(f"{tmp_path}/out.md")
    assert note_sink.recover(root, abandoned=True) == 0 and held(root) == {"a/1.md": "kept"}


def test_a_commit_that_breaks_off_is_rolled_forward(tmp_path, monkeypatch):
    root = f"{tmp_path}/vault"
    writer = note_sink.NoteWriter(root, ["path", "note"], False)
    messages = [writer.write(iter([(f"a/{t}-{k}.md", f"{t}{k}") for k in range(3)])) for t in range(2)]
    writer.write(iter([("a/never.md", "an attempt that was not committed")]))
    moves, real = [], note_sink.fs.LocalFileSystem.move

    def broken(self, source, target):
        moves.append(target)
        if len(moves) > 3:
            raise OSError("lost")
        return real(self, source, target)

    class Broken(note_sink.fs.LocalFileSystem):
        move = broken

    monkeypatch.setattr(note_sink, "MOVERS", 1)
    monkeypatch.setattr(note_sink, "_opened", lambda r: (Broken(), r))
    with pytest.raises(OSError, match="lost"):
        writer.commit(messages)
    monkeypatch.undo()
    assert sum(not n.startswith(".staging") for n in held(root)) == 2
    assert note_sink.recover(root) == 1 and note_sink.recover(root) == 0
    assert held(root) == {f"a/{t}-{k}.md": f"{t}{k}" for t in range(2) for k in range(3)}


def test_retry_writes_what_the_page_says(spark):
    """A retried item takes title, author and day of its page, and the path of its note; a known note is not doubled."""
    from test_importing import stored_items

    items = stored_items(spark, [(1, "https://h/a?id=1", None, "1", "c")]).withColumns({"status": F.lit("failed"), "title": F.lit("old"), "transcribed": F.lit(False)})
    results = spark.createDataFrame([(1, None, None, None, "words", None, "New title", "Kim", "2024-05-06")], f"id long, error string, reason string, raw_hash string, transcript string, summary {notes.SUMMARY}, found_title string, found_author string, found_published string")
    after, runs, made = workflow.retry(items, results, "now")
    row, note = after.first(), made.first()
    assert (row.title, row.published_at, row.file_path, row.status, row.summary_status) == ("New title", "2024-05-06", "notes/c/2024/c-2024-05-06-New title.md", "synced", "disabled")
    assert note.final_path == row.file_path == runs.first().message and 'author: "Kim"' in note.note and note.note.endswith("words\n")
    stored = made.select(F.col("final_path").alias("path"), F.sha2(F.regexp_replace("note", 'sync_time: ".*"', 'sync_time: "<ignored>"'), 256).alias("identity"))
    assert workflow.retry(items, results, "later", stored_notes=stored)[2].first().final_path == row.file_path
    other = spark.createDataFrame([(row.file_path, "other")], "path string, identity string")
    assert workflow.retry(items, results, "later", stored_notes=other)[2].first().final_path.startswith("notes/c/2024/c-2024-05-06-New title-")
