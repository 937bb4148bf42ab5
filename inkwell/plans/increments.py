"""Queries of state in batches, counters while writing, log tails, captured cards and pages that say who wrote them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from inkwell.operators import identity, notes, pages, payloads, reports, state, workflow
from inkwell.plans.catalog import _COUNTERS, _LOG, _RESOLVED, _docs, _incoming_and_state, _log, _pages, _shown, query, table
from inkwell.sources import log_lines
from inkwell.sources.shared import shared_dir
from inkwell.streaming import store


def _folder(spark, stem: str) -> str:
    return f"{shared_dir(spark)}/{stem}-{uuid.uuid4().hex}"


@query("resolved_candidates", _RESOLVED)
def _(spark, d):
    """As identity_resolution, but only items that a bitmap of the incoming keys lets pass are joined."""
    incoming, items = _incoming_and_state(spark, d)
    return identity.resolve(incoming, identity.candidates(items, incoming))


@query(
    "stored_batches",
    """with b as (select *, row_number() over (order by doc_id) as id from documents), n as (select count(*) as n from documents)
    select id, 'u' || doc_id as source_url, case when doc_id % 4 = 1 then 'w' || doc_id else 'u' || doc_id end as canonical_url, case doc_id % 4 when 0 then 'New ' when 1 then 'Moved ' else 'T ' end || doc_id as title, 'i' || doc_id as item_key,
      case when doc_id % 4 < 2 then 'now5' else 'now0' end as updated_at from b
    union all select n + row_number() over (order by doc_id), 'v' || doc_id, 'v' || doc_id, 'Other ' || doc_id, 'j' || doc_id, 'now5' from documents, n where doc_id % 4 = 2""",
)
def _(spark, d):
    """Three batches of a bucketed state: all documents, then changed, moved, new and unchanged ones, and these once more."""
    i = F.col("doc_id").cast("string")
    null = F.lit(None).cast("string")
    fixed = {n: null for n in ("file_path", "published_at", "summary_status", "error_message")} | {"status": F.lit("synced"), "has_transcript": F.lit(True), "transcribed": F.lit(False)}
    docs = _docs(spark, d)
    row = lambda stem, key, title, hashed: [F.col("doc_id").alias("seq"), F.concat(stem, i).alias("source_url"), F.concat(stem, i).alias("canonical_url"), F.concat(key, i).alias("item_key"), F.col("source").alias("column_name"), F.concat(hashed, i).alias("content_hash"), F.concat(title, i).alias("title")]
    lit = F.lit
    first = docs.select(*row(lit("u"), lit("i"), lit("T "), lit("h"))).withColumns(fixed)
    kind = F.col("doc_id") % 4
    later = docs.where(kind < 3).select(*row(F.when(kind == 0, "u").when(kind == 1, "w").otherwise("v"), F.when(kind == 2, "j").otherwise("i"), F.when(kind == 0, "New ").when(kind == 1, "Moved ").otherwise("Other "), F.when(kind == 2, "k").otherwise("h"))).withColumns(fixed)
    held = store.Store(spark, _folder(spark, "items"), 8)
    held.merge(first, 0, "now0")
    held.merge(later, 5, "now5")
    held.merge(later, 5, "again")
    return held.items().select("id", "source_url", "canonical_url", "title", "item_key", "updated_at")


@query(
    "empty_columns_but_valid",
    """select n_name as column_name from nation left join (select distinct 'src' || (doc_id % 11) as s from documents) on s = 'src' || n_nationkey where s is null and n_nationkey % 3 <> 0""",
)
def _(spark, d):
    """Columns without items, but for those that are marked as empty and valid."""
    columns = table(spark, d, "nation").select(F.concat(F.lit("src"), "n_nationkey").alias("column_name"), F.col("n_name"), (F.col("n_nationkey") % 3 == 0).alias("may_be_empty"))
    items = _docs(spark, d).select(F.concat(F.lit("src"), F.col("doc_id") % 11).alias("column_name"))
    return state.empty_columns(columns, items, valid="may_be_empty").join(columns, "column_name").select(F.col("n_name").alias("column_name"))


@query("written_run", f"select *, case when failed_count + missing_transcript_count + summary_failed_count = 0 then 'success' else 'partial_failed' end as status from (select {_COUNTERS} from ({_LOG}))")
def _(spark, d):
    return reports.written_run(_log(spark, d), _folder(spark, "run"))


@query(
    "log_tail_lines",
    """select strftime(ts, '%Y-%m-%d') as day, event_id || case event_type when 'error' then ' ERROR ' else ' WARNING ' end || user_id as value from events where event_type in ('error', 'click')
    order by strftime(ts, '%Y-%m-%d') desc, ts desc, event_id desc limit 50""",
)
def _(spark, d):
    """A log file a day of all events, and the last warnings and errors of all files, of which only the end is read."""
    kind = F.when(F.col("event_type") == "error", " ERROR ").when(F.col("event_type") == "click", " WARNING ").otherwise(" INFO ")
    lines = table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "ts", "event_id", F.concat("event_id", kind, "user_id").alias("value"))
    root = _folder(spark, "logs")
    lines.repartition("day").sortWithinPartitions("day", "ts", "event_id").select("day", "value").write.partitionBy("day").text(root)
    return log_lines.log_tail(spark, root, block=4096).select(F.regexp_extract("file", "day=([^/]*)", 1).alias("day"), "value")


@query(
    "card_items",
    """select doc_id, 'https://h.example.com/course/article?id=e' || doc_id as source_url, case when doc_id % 3 = 2 then 'Sound ' else 'Title ' end || doc_id as title, 'e' || doc_id as item_key,
    case when doc_id % 2 = 0 then '2024-05-06' end as published_at from documents where doc_id % 5 <> 4""",
)
def _(spark, d):
    i = F.col("doc_id")
    name = F.when(i % 3 == 0, "enid").when(i % 3 == 1, "en_id").otherwise("enId")
    title = F.when(i % 3 == 2, '"audio": {"title": "Sound  ').otherwise('"title": " Title ')
    end = F.when(i % 3 == 2, '"}').otherwise('"')
    published = F.when(i % 4 == 0, ', "publish_time": 1714953600').when(i % 4 == 2, ', "publish_time": "", "publishTime": "1714953600"').otherwise(', "publishTime": 0')
    address = F.when(i % 5 == 4, "").otherwise(F.concat(F.lit('"'), name, F.lit('": "e'), i, F.lit('", ')))
    data = F.concat(F.lit("{"), address, F.lit('"dd_article_id": 5, '), title, i, end, published, F.lit(', "share_url": "/x"}'))
    cards = _docs(spark, d).select(i.alias("capture_id"), F.explode(F.sequence(F.lit(1), F.lit(2))).alias("pos"), data.alias("data"))
    return payloads.card_items(cards, "https://h.example.com/c").withColumnRenamed("capture_id", "doc_id")


@query(
    "payload_hashes",
    """select doc_id, sha256('{"z": ' || doc_id || ', "c": {"content": "' || source || ' é", "list": [1, 2.5, null, true, {}]}}') as payload_hash, false as has_transcript from documents where doc_id % 7 <> 6
    union all select doc_id, sha256('{"z": ' || doc_id), false from documents where doc_id % 7 = 6""",
)
def _(spark, d):
    i = F.col("doc_id")
    wide = F.concat(F.lit('{ "z" :'), i, F.lit(',\n "c":{"content"  :"'), "source", F.lit(' \\u00e9" ,"list":[1,2.5 , null,true,{ }]} } '))
    tight = F.concat(F.lit('{"z":'), i, F.lit(',"c":{"content":"'), "source", F.lit(' é","list":[1,2.5,null,true,{}]}}'))
    rows = _docs(spark, d).select("doc_id", F.when(i % 7 == 6, F.concat(F.lit('{"z": '), i)).when(i % 2 == 0, wide).otherwise(tight).alias("payload"))
    return payloads.from_payload(rows).select("doc_id", "payload_hash", "has_transcript")


_HEAD = """'<head><meta name="author" content=" Kim ' || page_id || '">' || case page_id % 3 when 0 then '<meta property="article:published_time" content="2024-05-06T08:00">' when 1 then '<time datetime="2023-01-02"></time>' else '' end
  || case when page_id % 4 = 0 then '<audio src="/a' || page_id || '.mp3" type="audio/mpeg"></audio><source src="/a' || page_id || '.mp3">' when page_id % 4 = 1 then '<video src="clip.mpd"></video>' else '' end
  || case when page_id % 10 = 7 then '<i>PlayReady</i>' else '' end || '</head>' || html"""


def _headed(spark, d):
    return _pages(spark, d).select("page_id", "url", F.expr(_HEAD).alias("html"))


@query(
    "page_credits",
    """select page_id, 'Kim ' || page_id as author, case page_id % 3 when 0 then '2024-05-06T08:00' when 1 then '2023-01-02' end as published, case page_id % 4 when 0 then 1 when 1 then 1 else 0 end::bigint as n_media,
    case page_id % 4 when 0 then 'audio/mpeg' end as mime_type, case page_id % 4 when 0 then 'audio' when 1 then 'video' end as label,
    case when page_id % 10 = 7 then 'drm_playready' when page_id % 4 = 1 then 'dash_manifest' end as reason from pages""",
)
def _(spark, d):
    rows = pages.parsed(_headed(spark, d)).withColumn("first", F.try_element_at("media", F.lit(1)))
    reason = pages.policy(F.col("html"), F.col("media"))
    return rows.select("page_id", "author", "published", F.size("media").cast("long").alias("n_media"), "first.mime_type", "first.label", reason.alias("reason"))


@query(
    "quarantined_pages",
    f"""select page_id, '20250101' as day, sha256(html) as h, length({_shown('html')})::bigint as shown, len(regexp_extract_all(html, '<a href='))::bigint as anchors from pages""",
)
def _(spark, d):
    rows = workflow.quarantined(_pages(spark, d).withColumn("key", F.concat(F.lit("k"), "page_id")), "20250101-000000")
    return rows.select("page_id", "day", F.sha2("html", 256).alias("h"), F.length("text").cast("long").alias("shown"), F.json_array_length("anchors").cast("long").alias("anchors"))


@query(
    "prompt_texts",
    """select conv_id, turn, kind, sha256(array_to_string(list_filter([ 'Task', shape, case when kind <> 'least' then 'column: c' end, case when kind <> 'least' then 'title: ' || role end, case when kind = 'full' then 'published: ' end,
      case when kind <> 'least' and length(t) > most then 'Only the first ' || most || ' characters are given; say so in permanent_note.' end, '', left(t, most)], lambda x: x is not null), chr(10))) as h
    from (select *, repeat(text, 40) as t from conversations), (values
      ('full', 20000, '{"atomic_cards": ["at most 8"], "permanent_note": "...", "links": ["at most 6"], "actions": ["at most 6"], "questions": ["at most 6"], "keywords": ["at most 6"]}'),
      ('compact', 8000, '{"atomic_cards": ["at most 4"], "permanent_note": "...", "keywords": ["at most 6"]}'),
      ('least', 2500, '{"atomic_cards": ["at most 2"], "permanent_note": "...", "keywords": ["at most 4"]}')) p(kind, most, shape)""",
)
def _(spark, d):
    rows = table(spark, d, "conversations").withColumn("t", F.repeat("text", F.lit(40)))
    asked = lambda kind: F.struct(F.lit(kind).alias("kind"), F.sha2(notes.prompt(kind, F.lit("c"), F.col("role"), F.lit(None).cast("string"), F.col("t"), "Task"), 256).alias("h"))
    return rows.select("conv_id", "turn", F.explode(F.array(*map(asked, notes.PROMPTS))).alias("p")).select("conv_id", "turn", "p.kind", "p.h")


