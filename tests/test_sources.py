import json
import random

from pyspark.sql import functions as F

from inkwell.functions import text, urls
from inkwell.operators import identity, notes, numbering, payloads, reports, state
from inkwell.sources import files, log_lines
from inkwell.streaming import store


def test_files_and_vault(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>x</p>\n<p>y</p>")
    (tmp_path / "n.md").write_text('---\ntitle: "T"\nurl: \'u\'\nother: z\npublished: "2024-05-06T01:00"\n---\n### 卡片 1\n\n## 全文稿\n\nbody\n')
    (tmp_path / "m.md").write_text("no fields")
    assert [r.html for r in files.html_files(spark, f"file://{tmp_path}/a.html").collect()] == ["<p>x</p>\n<p>y</p>"]
    m, n = files.note_vault(spark, f"file://{tmp_path}").orderBy("path").collect()
    assert (n.fields, n.transcript, n.has_summary, n.date) == ({"title": "T", "url": "u", "published": "2024-05-06T01:00"}, "body", True, "2024-05-06")
    assert (m.fields, m.transcript, m.has_summary, m.date) == ({}, "", False, None)


def test_captured_lists(spark):
    body = {"c": {"article_list": [
        {"id": 7, "enid": "e1", "title": " A  title ", "publish_time": 1780588800}, {"id_str": "8", "en_id": "e2", "title": "", "audio": {"title": "Spoken"}},
        {"enid": "e1", "title": "again the same"}, {"enid": "e3", "title": "abc"}, {"title": "no address"},
    ]}}
    rows = files.article_lists(spark.createDataFrame([(1, json.dumps(body)), (2, "no json"), (3, None)], "capture_id long, body string")).orderBy("enid").collect()
    assert [(r.enid, r.id, r.published_at) for r in rows] == [("e1", "7", "2026-06-05"), ("e2", "8", None)] and rows[1].title == "Spoken"


def test_trace_and_log(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps([{"url": "u", "status": 200, "content_type": "application/json", "media_like": False}] * 2))
    assert files.network_trace(spark, f"file://{tmp_path}/t.json").count() == 2
    (tmp_path / "l.log").write_text("".join(f"{'WARNING' if i % 2 else 'INFO'} line {i}\n" for i in range(200)))
    tail = [r.value for r in log_lines.log_tail(spark, f"file://{tmp_path}/l.log").collect()]
    assert tail == [f"WARNING line {i}" for i in range(101, 200, 2)]


def test_log_tail_over_files_and_blocks(spark, tmp_path):
    """Lines keep their places whatever the blocks; hidden files are none; of a long log only the end is read."""
    rnd, lines = random.Random(3), []
    for name in ("b.log", "a/2.log", "a/10.log", "c.log"):
        own = [f"{rnd.choice(['INFO', 'ERROR', 'WARNING é'])} {name} {k} " + "x" * rnd.randrange(200) for k in range(rnd.choice([0, 3, 40, 200]))]
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes("\r\n".join(own).encode() + (b"" if name == "b.log" else b"\n"))
        lines += [(name, v) for v in own if not v.startswith("INFO")]
    (tmp_path / "_SUCCESS").write_text("ERROR hidden")
    (tmp_path / ".x.crc").write_text("ERROR hidden")
    lines.sort(key=lambda x: x[0])
    for block in (90, 1000, 1 << 20):
        got = log_lines.log_tail(spark, f"file://{tmp_path}", 25, block=block).collect()
        assert [(r.file.removeprefix(f"{tmp_path}/"), r.value) for r in got] == lines[-25:]
    assert [r.value for r in log_lines.log_tail(spark, f"file://{tmp_path}", 10**6, block=700).collect()] == [v for _, v in lines]
    reader = log_lines.LogReader({"path": "file:///x", "block": "10", "last": "25", "files": json.dumps([["p", 1000], ["q", 12]])})
    assert [(b.path, b.start, b.end) for b in reader.partitions()] == [("q", 2, 12), ("q", 0, 2), ("p", 990, 1000), ("p", 980, 990)]


def test_counters_of_a_run_while_it_is_written(spark, tmp_path):
    rows = [("sync", "synced", "ok", 2), ("skip", None, None, 0), ("sync", "failed", None, 1), ("sync", "missing_transcript", "summary_failed", None)]
    table = spark.createDataFrame(rows, "action string, status string, summary_status string, requests long")
    row = reports.written_run(table, f"{tmp_path}/run").first().asDict()
    again = state.run_counters(table.withColumn("run_id", F.lit(1))).drop("run_id").first().asDict()
    assert row == again and spark.read.parquet(f"{tmp_path}/run").count() == 4
    assert reports.written_run(table.limit(0), f"{tmp_path}/none").first().status == "success"
    assert reports.written_run(table.drop("requests"), f"{tmp_path}/less").first().request_count == 0


def _incoming(spark, rows):
    c = spark.createDataFrame(rows, "seq long, source_url string, title string, content_hash string")
    null = F.lit(None).cast("string")
    more = {n: null for n in ("item_key", "canonical_url", "file_path", "column_name", "published_at", "summary_status", "error_message")}
    return c.withColumns({**more, "status": F.lit("synced"), "has_transcript": F.lit(True), "transcribed": F.lit(False)})


def test_ingest_in_batches(spark, tmp_path):
    source, root = f"{tmp_path}/in", f"{tmp_path}/state"
    for k, rows in enumerate(([(1, "u1", "a", "h1"), (2, "u2", "b", "h2"), (3, None, "c", None), (4, None, "d", None)], [(5, "u2", "b2", "h9"), (6, "u9", "moved", "h1"), (7, "u3", "e", "h3")])):
        _incoming(spark, rows).coalesce(1).write.mode("append").parquet(source)
        store.ingest(spark, source, _incoming(spark, []).schema, root, f"n{k}", f"{tmp_path}/checkpoint", 4).awaitTermination()
        got = {r.id: (r.source_url, r.title) for r in store.Store(spark, root, 4).items().collect()}
    assert got == {1: ("u1", "moved"), 2: ("u2", "b2"), 3: (None, "c"), 4: (None, "d"), 5: ("u3", "e")}


def test_migrate_fills_what_it_can(spark):
    old = spark.createDataFrame([(1, "u1", "summary_failed", True, "f"), (2, "u2", "summary_failed", False, None)], "id long, source_url string, status string, has_transcript boolean, file_path string")
    once = state.migrate(old, "now")
    rows = {r.id: r for r in once.collect()}
    assert once.columns == state.ITEMS.names and (rows[1].status, rows[2].status) == ("synced", "summary_failed")
    assert rows[1].canonical_url == "u1" and rows[2].created_at == "now" and sorted(once.collect()) == sorted(state.migrate(once, "later").collect())


def test_places_whatever_the_parts(spark):
    rows = [(i * 3 % 101, "k" if i % 3 else None) for i in range(101)] + [(50, "hot")] * 200
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for parts in ("1", "16", "300"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            table = spark.createDataFrame(rows, "seq long, key string")
            got = numbering.placed(table, ["seq", "key"], "n").collect()
            assert [r.n for r in sorted(got, key=lambda r: (r.seq, r.key is not None, r.key or "", r.n))] == list(range(1, 302))
            by_key = numbering.placed(table, ["seq"], "n", ["key"]).collect()
            for key in ("k", "hot", None):
                assert [r.n for r in sorted((r for r in by_key if r.key == key), key=lambda r: (r.seq, r.n))] == list(range(1, 1 + sum(k == key for _, k in rows)))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert numbering.placed(spark.createDataFrame([], "seq long"), ["seq"], "n").count() == 0


def test_identity_of_rows_without_keys(spark):
    schema = "id long, source_url string, canonical_url string, item_key string, column_name string, content_hash string"
    items = spark.createDataFrame([(1, "u", None, None, "c", None), (2, None, None, "", "c", ""), (3, "u", None, "k", "c", "h")], schema)
    incoming = spark.createDataFrame([(10, None, None, None, None, None), (11, "", "", "", "", ""), (12, "u", None, None, None, "h"), (13, None, None, "k", "c", None)], schema)
    got = {r.id: (r.existing_id, r.match_kind) for r in identity.resolve(incoming, items).collect()}
    assert got == {10: (None, None), 11: (None, None), 12: (1, "source_url"), 13: (3, "id")}
    assert {r.id for r in identity.new_items(incoming, items).collect()} == {10, 11}


def test_relative_urls(spark):
    rows = spark.createDataFrame([("/a/../b?z=1&a=%20x#f",), ("HTTP://H.Example.com/A;p?b=2&b=1&c",), ("mailto:x",), (None,), ("",)], "u string")
    got = [r[0] for r in rows.select(urls.resolve(F.col("u"), F.lit("https://h.example.com/x/y"))).collect()]
    assert got == ["https://h.example.com/b?a=+x&z=1", "http://h.example.com/A?b=1&b=2&c=", "mailto:x", None, "https://h.example.com/x/y"]


def test_block_payloads_of_any_shape(spark):
    shapes = [None, "", "no json", "[]", '{"c": 1}', '{"c": {"content": ""}}', '{"c": {"content": "plain words"}}', '{"c": {"content": {"text": "one"}}}', '{"c": {"content": [{"type": "image", "text": "x"}, {"contents": ["a", {"text": {"content": "b"}}]}]}}']
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(shapes)], "i int, p string")
    assert [r.b for r in rows.select("i", payloads.block_text(F.col("p")).alias("b")).orderBy("i").collect()] == ["", "", "", "", "", "", "plain words", "one", "ab"]


def test_collision_numbers(spark):
    same = [("a.md", "h" * 9, 1), ("a.md", "k" * 8 + "1", 2), ("a.md", "k" * 8 + "2", 3), ("a.md", "k" * 8 + "1", 4)]
    rows = spark.createDataFrame(same, "path string, identity string, seq int")
    assert [r.final_path for r in notes.without_collisions(rows).orderBy("seq").collect()] == ["a.md", "a-kkkkkkkk.md", "a-kkkkkkkk-2.md", "a-kkkkkkkk.md"]


def test_linked_data_and_cards(spark):
    from inkwell.operators import pages

    page = """<script type="application/ld+json">[{"@graph": [{"headline": "In graph", "author": [{"name": "A"}, "B"]}], "name": "Outer", "dateModified": "2024-01-02"}, {"name": "Last", "creator": "C"}]</script>
      <script type="application/ld+json">{broken</script><ul class="Course-list"><div class="card">Card <a data-url="/d">Go there</a> more</div></ul><a>none</a><span role="link" href="/s">Span link</span>"""
    r = pages.parsed(spark.createDataFrame([(1, "https://h.example.com/p", page)], "page_id long, url string, html string")).first()
    assert (r.title, r.author, r.published) == ("Outer", "A，B", "2024-01-02")
    assert [(a.href, a.text, a.card_text) for a in r.anchors] == [("https://h.example.com/d", "Go there", "Card Go there"), ("https://h.example.com/s", "Span link", "")]
    assert text.SPACE
