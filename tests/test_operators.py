import json
import random

from pyspark.sql import functions as F

from inkwell.functions import text
from inkwell.operators import notes, pages, payloads, state

PAGE = """<html><head><title>A walk - Site</title><meta name="author" content="Kim"><script type="application/ld+json">{"datePublished": "2024-05-06"}</script></head>
<body><nav>menu<script>var x = '</p>'</script></nav><article><h1>A walk</h1><p>one</p><p>two <b>three</p></article><audio src="/a.mp3" type="audio/mpeg"></audio>
<li class="card">Card <a href="/x?b=2&a=1#f">Link text</a></li></body></html>"""


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v"))).first()[0]


def test_page_parts(spark):
    row = pages.parsed(spark.createDataFrame([(1, "https://h.example.com/p", PAGE), (2, None, None)], "page_id long, url string, html string"))
    r = {x.page_id: x for x in row.collect()}
    assert (r[1].title, r[1].author, r[1].published) == ("A walk", "Kim", "2024-05-06")
    assert [m.url for m in r[1].media] == ["https://h.example.com/a.mp3"]
    assert r[1].candidates[0] == "A walk\n\none\n\ntwo three" and "var x" not in r[1].visible
    assert r[1].anchors[0].href == "https://h.example.com/x?b=2&a=1#f" and r[2].candidates == []


def test_section(spark):
    assert one(spark, pages.section, "x\n全文稿\nbody\n\nmore\n上一篇\nrest") == "body\nmore"
    assert one(spark, pages.section, "x\n转述师：y\nbody") == "body" and one(spark, pages.section, "none") == ""


def test_redaction_is_stable(spark):
    once = one(spark, text.redact, "api_key=abc Authorization: Bearer tok.en, Cookie: a=b")
    assert "abc" not in once and "tok.en" not in once and "a=b" not in once and one(spark, text.redact, once) == once


def test_file_names(spark):
    assert one(spark, text.file_name, 'a/b: "c"  ') == "a b c" and one(spark, text.file_name, " . ") == "untitled"
    assert one(spark, text.file_name, "con") == "_con" and len(one(spark, text.file_name, "x" * 200)) == 80


def test_summaries(spark):
    s = lambda v: one(spark, notes.parse_summary, v)
    assert s('```json\n{"原子卡片": ["a", "b"], "关键词": "x; y"}\n```').atomic_cards == ["a", "b"]
    assert s('{"permanent_note": "n", "links": ["l1", "l').permanent_note == "n"
    assert s("## 永久笔记\n- note\n关键词：\na，b").keywords == ["a", "b"]
    assert s("chatter").status == "summary_failed" and s(None).status == "summary_failed"


def test_upsert_twice_changes_nothing(spark):
    empty = spark.createDataFrame([], state.ITEMS)
    c = spark.createDataFrame([(1, None, "u1", "t"), (2, None, "u2", "s")], "seq long, existing_id long, source_url string, title string")
    for n in (*state.KEEP_OLD, "column_name", "published_at", "summary_status", "error_message"):
        c = c.withColumn(n, F.lit(None).cast("string"))
    c = c.withColumns({"status": F.lit("synced"), "has_transcript": F.lit(True), "transcribed": F.lit(False)})
    first = state.upsert(empty, c, "n1")
    again = state.upsert(first, c.withColumn("existing_id", F.col("seq")), "n1")
    assert sorted(map(tuple, first.collect()), key=str) == sorted(map(tuple, again.collect()), key=str)


def test_collisions(spark):
    rows = spark.createDataFrame([("a.md", "h" * 9, 1), ("a.md", "h" * 9, 2), ("a.md", "k" * 9, 3)], "path string, identity string, seq int")
    assert [r.final_path for r in notes.without_collisions(rows).orderBy("seq").collect()] == ["a.md", "a.md", "a-kkkkkkkk.md"]


def test_keyword_fields_equal_a_walk(spark):
    """Up to 30 fields in the order of the text, of lists five elements, previews of 180 characters."""

    def walk(value, path, found):
        for name, child in value.items() if isinstance(value, dict) else ():
            if len(found) < 30:
                if any(w in name.lower() for w in ("text", "title", "desc", "content")):
                    shown = " ".join((child if isinstance(child, str) else json.dumps(child, ensure_ascii=False)).split())
                    found.append((f"{path}.{name}".lstrip("."), shown[:180] + "..." * (len(shown) > 180)))
                walk(child, f"{path}.{name}".lstrip("."), found)
        for k, child in enumerate(value[:5]) if isinstance(value, list) else ():
            if len(found) < 30:
                walk(child, f"{path}[{k}]", found)
        return found

    rnd = random.Random(9)

    def made(depth):
        kind = rnd.randrange(6 if depth else 3)
        if kind < 3:
            return rnd.choice(["a  b", "é" * 200, 1.5, None, True, "x"])
        if kind == 3:
            return [made(depth - 1) for _ in range(rnd.randrange(8))]
        return {rnd.choice(["text", "Title", "z", "a", "desc1", "k2"]) + str(rnd.randrange(3)): made(depth - 1) for _ in range(rnd.randrange(9))}

    values = [made(6) for _ in range(60)] + [{f"title{k}": k for k in range(50)}, [{"text": k} for k in range(9)]]
    table = spark.createDataFrame([(k, json.dumps(v, ensure_ascii=False)) for k, v in enumerate(values)], "k int, v string")
    got = {}
    for r in payloads.keyword_fields(table, "v").orderBy("k", "pos").collect():
        got.setdefault(r.k, []).append((r.path, r.preview))
    assert got == {k: found for k, v in enumerate(values) if (found := walk(v, "", []))} and max(map(len, got.values())) == 30
