"""Queries of batches, reports and payloads on the supplied tables, and the DuckDB SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions import failures, text, urls
from inkwell.operators import importing, notes, pages, payloads, reports, state, workflow
from inkwell.plans.catalog import _HOST, _ITEMS_SQL, _LOG, _URL, _docs, _items, _log, _squash, _strip, query, table

_COLUMNS = "select n_name as name, case when n_nationkey = 5 then 'ftp://x' when n_nationkey = 6 then '' else 'https://h.example.com/' || n_nationkey end as url, n_nationkey % 3 <> 0 as enabled from nation union all select r_name, 'https://r.example.com', false from region"


def _columns(spark, d):
    n = F.col("n_nationkey")
    url = F.when(n == 5, "ftp://x").when(n == 6, "").otherwise(F.concat(F.lit("https://h.example.com/"), n))
    nations = table(spark, d, "nation").select(F.col("n_name").alias("name"), url.alias("url"), (n % 3 != 0).alias("enabled"))
    return nations.union(table(spark, d, "region").select("r_name", F.lit("https://r.example.com"), F.lit(False)))


@query("enabled_columns", f"select name, url from ({_COLUMNS}) where enabled")
def _(spark, d):
    return workflow.enabled(_columns(spark, d)).select("name", "url")


@query(
    "column_checks",
    f"""select 'invalid_url' as rule, name as subject from ({_COLUMNS}) where not regexp_matches(url, '^https?://[^/?#]+')
    union all select 'duplicate_name', name from (select * from ({_COLUMNS}) union all select * from ({_COLUMNS}) where enabled) group by name having count(*) > 1
    union all select 'negative_interval', '-1' union all select 'unsupported_provider', 'other' union all select 'missing_field', 'column' union all select 'missing_field', 'title' union all select 'unsupported_field', 'day'
    union all select 'invalid_url', name from ({_COLUMNS}) where enabled and not regexp_matches(url, '^https?://[^/?#]+')""",
)
def _(spark, d):
    columns = _columns(spark, d)
    settings = spark.createDataFrame([(-1, "other", "{published_date}-{day}")], "interval int, provider string, pattern string")
    return workflow.column_checks(columns.union(columns.where("enabled")), settings, ("known",))


_PATTERN = "case doc_id % 4 when 0 then '{column}-{published_date}-{title}' when 1 then '{title}-{lang}' when 2 then '{zone}{area}' else 'plain' end"


@query(
    "field_differences",
    f"""select doc_id, array_to_string(list_sort(list_filter(['column', 'published_date', 'title'], lambda x: not list_contains(f, x))), ',') as missing,
    array_to_string(list_sort(list_filter(f, lambda x: x not in ('column', 'published_date', 'title'))), ',') as unsupported
    from (select doc_id, regexp_extract_all({_PATTERN}, '\\{{([A-Za-z_]+)\\}}', 1) as f from documents)""",
)
def _(spark, d):
    f = workflow.field_differences(F.expr(_PATTERN))
    return _docs(spark, d).select("doc_id", f.alias("f")).select("doc_id", F.array_join("f.missing", ",").alias("missing"), F.array_join("f.unsupported", ",").alias("unsupported"))


@query("item_sequence", "select doc_id, source, row_number() over (partition by source order by doc_id) as place, count(*) over (partition by source) as of from documents")
def _(spark, d):
    return workflow.sequence(_docs(spark, d).select("doc_id", "source"), "source", "doc_id").select("doc_id", "source", "place", "of")


@query(
    "items_with_pages",
    f"""select page_id, case when page_id % 4 = 3 then 'missing' when held then 'payload' else 'html' end as kind,
    case when page_id % 4 = 3 then null when held then md5('second') else md5(html) end as content_hash
    from (select u.page_id, bool_or(u.page_id % 3 = 0) over (partition by u.url) as held, min(p.html) over (partition by u.url) as html from ({_URL}) u join pages p on p.page_id = u.page_id)""",
)
def _(spark, d):
    p, i = table(spark, d, "pages"), F.col("page_id")
    detail = F.when(i % 4 == 3, F.concat(F.lit("https://nowhere.example/"), i)).otherwise(F.concat("url", F.lit("#part")))
    items = p.select("page_id", detail.alias("detail_url"))
    held = p.select("page_id", F.when(i % 3 == 0, F.col("url")).otherwise(F.concat(F.lit("https://else.example/"), i)).alias("url"))
    two = held.select("url", F.lit(1).alias("seq"), F.lit("first").alias("payload")).union(held.select("url", F.lit(2), F.lit("second")))
    return workflow.with_pages(items, p, two).select("page_id", "kind", F.md5("content").alias("content_hash"))


_FACTS = """select doc_id, doc_id % 10 = 0 as known, case when doc_id % 11 = 0 then 'boom' end as error,
  case doc_id % 7 when 0 then 'policy_blocked:drm_fairplay' when 1 then 'too_short' when 2 then '' end as reason,
  coalesce(doc_id % 7, 9) > 2 as has_transcript, doc_id % 13 = 0 as duplicate, doc_id % 9 = 0 as summary_failed from documents"""


@query(
    "item_outcomes",
    f"""select doc_id, case when status is null then 'skip' else 'sync' end as action, status from (select doc_id, case when known then null when error is not null then 'failed'
    when starts_with(reason, 'policy_blocked:') then 'policy_blocked' when not has_transcript and coalesce(reason, '') <> '' then 'extractor_failed' when not has_transcript then 'missing_transcript'
    when duplicate then null when summary_failed then 'summary_failed' else 'synced' end as status from ({_FACTS}))""",
)
def _(spark, d):
    docs = _docs(spark, d)
    docs.createOrReplaceTempView("_facts_documents")
    return state.outcomes(spark.sql(_FACTS.replace("from documents", "from _facts_documents"))).select("doc_id", "action", "status")


_SHOWN = "case page_id % 6 when 0 then 'a 获取验证码 b' when 1 then '首页 登录 注册 最近学习' when 2 then '已购 课程' when 3 then '退出登录' when 4 then '登录  注册x 最近学习' else html end"


@query(
    "login_pages",
    f"""select page_id, l as asks, not l and not regexp_matches(t, '(^|\\s)登录\\s+注册(\\s|$)') and regexp_matches(t, '已购|最近学习|退出登录') as logged_in
    from (select page_id, t, contains(lower(url), 'login') or regexp_matches(t, '扫码登录|验证码登录|手机号登录|获取验证码|请登录|登录/注册') as l
    from (select page_id, case when page_id % 25 = 0 then url || '/LOGIN' else url end as url, {_SHOWN} as t from pages))""",
)
def _(spark, d):
    u = F.when(F.col("page_id") % 25 == 0, F.concat("url", F.lit("/LOGIN"))).otherwise(F.col("url"))
    rows = table(spark, d, "pages").select("page_id", u.alias("u"), F.expr(_SHOWN).alias("t"))
    return rows.select("page_id", failures.asks_for_login(F.col("u"), F.col("t")).alias("asks"), failures.is_logged_in(F.col("u"), F.col("t")).alias("logged_in"))


_BODY = "case event_id % 7 when 0 then 'Error 1010' when 1 then 'A Captcha page' when 2 then '<!DOCTYPE html>' when 3 then 'browser_signature_banned' when 4 then 'try another User-Agent' when 5 then 'quota' end"
_STATUS = "cast(case event_id % 5 when 0 then 403 when 1 then 429 when 2 then 500 when 3 then 418 else 401 end as int)"


@query(
    "guard_classes",
    f"""select event_id, case when code = 403 and regexp_matches(b, 'error 1010|browser_signature_banned|browser''s signature|user-agent has been banned') then 'yes'
    when code in (403, 406, 418, 429, 456) and regexp_matches(b, '_guard/|captcha|cloudflare|browser|user-agent') then 'possible' else 'no' end as of_error,
    case when regexp_matches(b, 'browser_signature_banned|error 1010') then 'yes' when regexp_matches(b, '_guard/|captcha|cloudflare') then 'possible'
    when regexp_matches(b, '<html|<!doctype html') then 'no' else 'unknown' end as of_page from (select event_id, {_STATUS} as code, lower(coalesce({_BODY}, '')) as b from events)""",
)
def _(spark, d):
    rows = table(spark, d, "events").select("event_id", F.expr(_STATUS).alias("code"), F.expr(_BODY).alias("b"))
    return rows.select("event_id", failures.guard_of_error(F.col("code"), F.col("b")).alias("of_error"), failures.guard_of_page(F.col("b")).alias("of_page"))


_BASE = "case event_id % 4 when 0 then 'https://api.example.com/v1/' when 1 then 'https://api.example.com/v1/chat/completions' when 2 then 'https://api.example.com?secret=abc' else 'local' end"


@query(
    "service_urls",
    f"""select event_id, case when ends_with(s, '/chat/completions') then s else s || '/chat/completions' end as url,
    'provider=p, model=m, base_url=' || case event_id % 4 when 0 then 'https://api.example.com/v1' when 1 then 'https://api.example.com/v1/chat/completions' when 2 then 'https://api.example.com/' else 'local' end as context
    from (select event_id, regexp_replace({_BASE}, '/+$', '') as s from events)""",
)
def _(spark, d):
    b = F.expr(_BASE)
    return table(spark, d, "events").select("event_id", failures.completions_url(b).alias("url"), failures.service_context(F.lit("p"), F.lit("m"), b).alias("context"))


@query(
    "summary_errors",
    """select event_id, case event_id % 5 when 0 then 'summary API HTTP 401 (c): denied api_key=[REDACTED], x; key' when 1 then 'summary API HTTP 500 (c): ' || repeat('y', 500)
    when 2 then 'summary API timeout after 180s: timed out' when 3 then 'connection secret=[REDACTED]' else 'summary API HTTP 404 (c): ; base_url' end as message from events""",
)
def _(spark, d):
    i = F.col("event_id")
    code = F.when(i % 5 == 0, 401).when(i % 5 == 1, 500).when(i % 5 == 4, 404)
    body = F.when(i % 5 == 0, "denied api_key=abc" + ", x").when(i % 5 == 1, "y" * 900).when(i % 5 == 3, "connection secret=zz").when(i % 5 == 4, "")
    return table(spark, d, "events").select("event_id", failures.summary_error(code, body, F.lit("c"), failures.http_hint(code, body), 180).alias("message"))


_MEDIA = """case doc_id % 4 when 0 then [] when 1 then ['audio/mpeg'] when 2 then ['video/mp4', 'audio/mpeg', 'video/mp4', 'source', 'zip'] else ['media'] end"""


@query(
    "failure_messages",
    f"""select doc_id, nullif(concat_ws('; ', nullif(r, ''), case when len(m) > 0 then 'media_candidates=' || len(m) || ' (' || array_to_string(list_sort(list_distinct(m))[1:3], ', ') || ')' end,
    case when doc_id % 5 = 0 then 'diagnostic_html=p' || doc_id end), '') as message
    from (select doc_id, case doc_id % 3 when 0 then 'too_short' when 1 then '' end as r, {_MEDIA} as m from documents)""",
)
def _(spark, d):
    i = F.col("doc_id")
    one = lambda mime, label: F.struct(F.lit(mime).cast("string").alias("mime_type"), F.lit(label).cast("string").alias("label"))
    media = (
        F.when(i % 4 == 0, F.slice(F.array(one("a", "b")), 1, 0)).when(i % 4 == 1, F.array(one("audio/mpeg", "audio")))
        .when(i % 4 == 2, F.array(one("video/mp4", "video"), one("audio/mpeg", ""), one("video/mp4", None), one(None, "source"), one("zip", None))).otherwise(F.array(one("", None)))
    )
    reason = F.when(i % 3 == 0, "too_short").when(i % 3 == 1, "")
    return _docs(spark, d).select("doc_id", reports.failure_message(reason, media, F.when(i % 5 == 0, F.concat(F.lit("p"), i)).otherwise("")).alias("message"))


_TOTAL = f"(select count(*) filter (where enabled) from ({_COLUMNS}))"
_FAILED_LOG = f"select run_id, seq, 'item ' || item_id || ' token' as message from ({_LOG}) where status = 'failed' qualify row_number() over (partition by run_id order by seq) <= 50"
_RUNS = f"""select run_id, case when failed_count + missing_transcript_count + summary_failed_count = 0 then 'success' else 'partial_failed' end as status, {_TOTAL} as total_columns,
  discovered_count, new_count, skipped_count, success_count, failed_count, missing_transcript_count, summary_failed_count, request_count, strftime(first, '%Y-%m-%d %H:%M:%S') as started, strftime(last, '%Y-%m-%d %H:%M:%S') as finished, e.error_message
  from (select run_id, count(*) as discovered_count, count(*) filter (where action <> 'skip') as new_count, count(*) filter (where action = 'skip') as skipped_count,
    count(*) filter (where status = 'synced') as success_count, count(*) filter (where status = 'failed') as failed_count, count(*) filter (where status = 'missing_transcript') as missing_transcript_count,
    count(*) filter (where summary_status = 'summary_failed') as summary_failed_count, sum(requests)::bigint as request_count from ({_LOG}) group by run_id)
  join (select strftime(ts, '%Y-%m-%d') as run_id, min(ts) as first, max(ts) as last from events group by 1) using (run_id)
  left join (select run_id, string_agg(message, chr(10) order by seq) as error_message from ({_FAILED_LOG}) group by run_id) e using (run_id)"""


def _runs(spark, d):
    log, span = _log(spark, d), table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("run_id")).agg(F.min("ts").alias("started_at"), F.max("ts").alias("finished_at"))
    failed = log.where("status = 'failed'").select("run_id", "seq", F.concat(F.lit("item "), "item_id", F.lit(" token")).alias("message"))
    started = reports.start_runs(_columns(spark, d), span.select("run_id", "started_at"))
    return reports.finish_runs(started, state.run_counters(log), failed, span.select("run_id", "finished_at"))


@query("run_rows", _RUNS)
def _(spark, d):
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return _runs(spark, d).select(
        "run_id", "status", "total_columns", "discovered_count", "new_count", "skipped_count", "success_count", "failed_count", "missing_transcript_count",
        "summary_failed_count", "request_count", shown("started_at").alias("started"), shown("finished_at").alias("finished"), "error_message",
    )


@query("runs_recent", f"select run_id, request_count from ({_RUNS}) order by started desc, run_id desc limit 20")
def _(spark, d):
    return state.newest(_runs(spark, d).withColumn("id", F.col("run_id")), "started_at").select("run_id", "request_count")


_DETAILS = f"""select run_id, case status when 'synced' then 1 when 'missing_transcript' then 2 else 4 end as section, case when status = 'failed' then null else 'c' || item_id % 3 end as column_name, seq,
  'item ' || item_id as title, case when status = 'missing_transcript' then 'secret=s' || item_id end as note from ({_LOG}) where status in ('synced', 'missing_transcript', 'failed')"""
_LINES = f"""select run_id, section, string_agg(line, chr(10) order by r) || case when max(n) > 10 then chr(10) || '- 还有 ' || (max(n) - 10) || ' 条，详见日志或 list 命令。' else '' end as lines from (
  select run_id, section, n, r, '- ' || coalesce(column_name || '：', '') || title || coalesce('（' || regexp_replace(note || '）', 'secret=[^\\s]+', 'secret=[REDACTED]'), '') as line from (
  select *, row_number() over (partition by run_id, section order by f, seq) as r, count(*) over (partition by run_id, section) as n from (
  select *, min(seq) over (partition by run_id, section, column_name) as f from ({_DETAILS})))) where r <= 10 group by run_id, section"""


@query(
    "run_reports",
    f"""select run_id, 'Report' || chr(10) || chr(10) || '执行时间：' || finished || chr(10) || '运行机器：host' || chr(10) || '耗时：' || (epoch(finished::timestamp) - epoch(started::timestamp))::bigint || 's' || chr(10) || '状态：' || status
    || chr(10) || '总栏目数：' || total_columns || chr(10) || '发现条目数：' || discovered_count || chr(10) || '新增文章数：' || new_count || chr(10) || '跳过文章数：' || skipped_count || chr(10) || '成功文章数：' || success_count
    || chr(10) || '网页请求数：' || request_count || chr(10) || '失败文章数：' || failed_count || chr(10) || '无文字稿文章数：' || missing_transcript_count || chr(10) || '摘要失败数：' || summary_failed_count
    || coalesce((select string_agg(chr(10) || chr(10) || case section when 1 then '新增内容：' when 2 then '无文字稿/待处理：' else '失败：' end || chr(10) || lines, '' order by section) from ({_LINES}) l where l.run_id = r.run_id), '')
    || chr(10) || chr(10) || '日志：log' as report from ({_RUNS}) r""",
)
def _(spark, d):
    log = _log(spark, d).where(F.col("status").isin("synced", "missing_transcript", "failed"))
    s = F.col("status")
    details = log.select(
        "run_id", F.when(s == "synced", 1).when(s == "missing_transcript", 2).otherwise(4).alias("section"), F.when(s != "failed", F.concat(F.lit("c"), F.col("item_id") % 3)).alias("column_name"), "seq",
        F.concat(F.lit("item "), "item_id").alias("title"), F.when(s == "missing_transcript", F.concat(F.lit("secret=s"), "item_id")).alias("note"),
    )
    return reports.run_reports(_runs(spark, d).withColumn("log_path", F.lit("log")), details, F.lit("Report"), "host")


@query(
    "daily_report",
    f"""select 0 as section, '' as place, '# daily report - 2024-01-30' as line union all select 1, '', '## Summary' union all select 2, '', '## Failure reason analysis' union all select 3, '', '## Failed by status'
    union all select 4, '', '## Failed by column' union all select 5, '', '## Remaining failed items'
    union all select 1, '1', '| items | ' || count(*) || ' |' from documents union all select 1, '2', '| columns | ' || count(distinct source) || ' |' from documents
    union all select 2, category, '| ' || category || ' | ' || count(*) || ' |' from (select case event_type when 'error' then 'kind ' || event_id % 2 when 'click' then 'network_issue' end as category from events) where category is not null group by category
    union all select 3, status, '| ' || status || ' | ' || count(*) || ' |' from ({_ITEMS_SQL}) where status in ('failed', 'extractor_failed') group by status
    union all select 4, column_name, '| ' || column_name || ' | ' || count(*) || ' |' from ({_ITEMS_SQL}) where status in ('failed', 'extractor_failed') group by column_name
    union all select 5, lpad(id::varchar, 20, '0'), '| ' || status || ' | ' || column_name || ' | ' || title || '0123456789012345678901234567890123456789'[1:50 - length(title)] || case when length(title) > 10 then '...' else '' end || ' |' from ({_ITEMS_SQL}) where status in ('failed', 'extractor_failed')""",
)
def _(spark, d):
    failed = _items(spark, d).where("status in ('failed', 'extractor_failed')").withColumn("title", F.concat("title", F.lit("0123456789012345678901234567890123456789")))
    totals = _docs(spark, d).agg(F.count("*").alias("items"), F.countDistinct("source").alias("columns"))
    said = "case event_type when 'error' then 'missing transcript of x: kind ' || event_id % 2 when 'click' then 'Timeout' else 'fine' end as message"
    return reports.daily_report(failed, table(spark, d, "events").selectExpr(said), totals, "2024-01-30")


@query(
    "pass_totals",
    "select count(*) as passes, sum(greatest(n - coalesce(m, n), 0))::bigint as fixed from (select run_id, n, lead(n) over (order by run_id) as m from (select strftime(ts, '%Y-%m-%d') as run_id, count(*) filter (where event_type = 'error') as n from events group by 1))",
)
def _(spark, d):
    from pyspark.sql import Window

    days = table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("run_id")).agg(F.count_if(F.col("event_type") == "error").alias("failed_before"))
    after = F.lead("failed_before").over(Window.partitionBy(F.lit(1)).orderBy("run_id"))  # one row a day
    return reports.pass_totals(days.withColumn("failed_after", F.coalesce(after, "failed_before")))


@query("exit_codes", "select r_name as \"group\", max(case when n_nationkey = 7 then 1 else 0 end)::int as exit_code from nation join region on n_regionkey = r_regionkey group by 1")
def _(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    status = F.when(F.col("n_nationkey") == 7, "error").when(F.col("n_nationkey") % 2 == 0, "warning").otherwise("ok")
    return reports.exit_codes(n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("r_name").alias("group"), status.alias("status")))


_NOTE = """'---' || chr(10) || 'source: "web"' || chr(10) || 'column: "' || source || '"' || chr(10) || case when doc_id % 9 = 0 then '' else 'title: "T ' || doc_id || '"' || chr(10) end
  || 'published: "' || case when doc_id % 4 = 0 then '' else '2024-05-0' || (doc_id % 9 + 1) || 'T08:00' end || '"' || chr(10) || 'url: "https://h.example.com/a?id=' || doc_id || '"' || chr(10) || '---' || chr(10)
  || case when doc_id % 5 = 0 then '' else '### 卡片 1' || chr(10) end || chr(10) || '## 全文稿' || chr(10) || case when doc_id % 7 = 0 then ' ' else text end"""
_VAULT = "select doc_id, 'notes/' || source || '/n' || lpad(doc_id::varchar, 9, '0') || '.md' as path, source as column_name, {} as note from documents".format(_NOTE)


def _vault(spark, d):
    i = F.col("doc_id")
    path = F.concat(F.lit("notes/"), "source", F.lit("/n"), F.lpad(i.cast("string"), 9, "0"), F.lit(".md"))
    return _docs(spark, d).select("doc_id", path.alias("path"), F.col("source").alias("column_name"), F.expr(_NOTE.replace("chr(10)", "char(10)")).alias("note"))


def _vault_columns(spark, d):
    names = _docs(spark, d).select(F.col("source").alias("name")).distinct()
    return names.select("name", F.lit("https://h.example.com/").alias("url"), (F.col("name") != "src3").alias("enabled"))


@query(
    "noted_items",
    f"""select path, column_name, case when doc_id % 9 = 0 then '' else 'T ' || doc_id end as title, doc_id::varchar as item_key, case when doc_id % 4 <> 0 then '2024-05-0' || (doc_id % 9 + 1) end as published_at,
    doc_id % 7 <> 0 and {_strip('text')} <> '' as has_transcript, doc_id % 5 <> 0 or contains(text, '### 卡片 1') as has_summary, case when doc_id % 9 = 0 then 'missing_meta' else 'item' end as outcome
    from ({_VAULT.replace(' as note from', ' as note, text from')}) where column_name <> 'src3'""",
)
def _(spark, d):
    rows = workflow.noted_items(_vault(spark, d), _vault_columns(spark, d))
    return rows.select("path", "column_name", "title", "item_key", "published_at", "has_transcript", "has_summary", "outcome")


_COPY = "select doc_id, 'notes/' || {c} || '/n' || lpad(doc_id::varchar, 9, '0') || 'b.md' as path, {c} as column_name, replace(replace({n}, '/a?id=', case when doc_id % 8 in (1, 4) then '/b?id=' else '/a?id=' end), 'title: \"T', 'title: \"Again T') as note, text from documents where doc_id % 8 in (1, 2, 4, 5, 6)".format(
    c="case when doc_id % 8 not in (5, 6) then source when source = 'src4' then 'src5' else 'src4' end", n=_NOTE
)
_IMPORTED = f"""select doc_id, path, column_name, contains(note, '/b?id=' || doc_id || '\"') as moved, contains(note, 'title: "Again T') as again, doc_id % 7 <> 0 and {_strip('text')} <> '' as has_transcript,
  doc_id % 5 <> 0 or contains(text, '### 卡片 1') as has_summary, doc_id % 9 <> 0 as ok from ({_VAULT.replace(' as note from', ' as note, text from')} union all {_COPY}) where column_name <> 'src3'"""
_IMPORT_GROUPS = f"""select doc_id, doc_id % 2 = 0 and bool_or(not moved) as matched, min(struct_pack(c := column_name, p := path)) as first, max(struct_pack(c := column_name, p := path)) as last, arg_min(moved, struct_pack(c := column_name, p := path)) as first_moved,
  count(*) as n from ({_IMPORTED}) where ok group by doc_id"""


def _crowded_vault(spark, d):
    """A vault in which addresses, and ids within a column, are repeated: a second note of some documents, in the same or another folder."""
    i, rows = F.col("doc_id"), _vault(spark, d)
    column = F.when(~(i % 8).isin(5, 6), F.col("column_name")).when(F.col("column_name") == "src4", "src5").otherwise("src4")
    moved = F.regexp_replace("note", r"/a\?id=", F.when((i % 8).isin(1, 4), "/b?id=").otherwise("/a?id="))
    path = F.concat(F.lit("notes/"), column, F.lit("/n"), F.lpad(i.cast("string"), 9, "0"), F.lit("b.md"))
    again = rows.where((i % 8).isin(1, 2, 4, 5, 6)).select("doc_id", path.alias("path"), column.alias("column_name"), F.replace(moved, F.lit('title: "T'), F.lit('title: "Again T')).alias("note"))
    return rows.union(again)


@query(
    "import_tallies",
    f"""select (select count(*) filter (where not matched) from ({_IMPORT_GROUPS})) as imported, (select sum(n - case when matched then 0 else 1 end)::bigint from ({_IMPORT_GROUPS})) as updated,
    count(*) filter (where ok and not has_transcript) as no_transcript, count(*) filter (where ok and not has_summary) as no_summary, count(*) filter (where not ok) as missing_meta from ({_IMPORTED})""",
)
def _(spark, d):
    return importing.tallies(*workflow.import_notes(_stored(spark, d), _crowded_vault(spark, d), _vault_columns(spark, d)))


@query(
    "imported_items",
    f"""with g as ({_IMPORT_GROUPS}), w as (select g.*, i.moved, i.again, i.has_transcript, i.has_summary from g join ({_IMPORTED}) i on i.doc_id = g.doc_id and i.path = g.last.p),
    f as (select doc_id, last.p as file_path, last.c as column_name, case when again then 'Again T ' else 'T ' end || doc_id as title, has_transcript, case when has_summary then 'success' end as summary_status, matched, first, first_moved,
      'https://h.example.com/' || case when moved then 'b' else 'a' end || '?id=' || doc_id as canonical_url, doc_id::varchar as item_key from w)
    select d.doc_id as id, 'https://h.example.com/a?id=' || case when d.doc_id % 2 = 1 then 'own' else '' end || d.doc_id as source_url, f.canonical_url, coalesce(f.column_name, d.source) as column_name, f.title, f.item_key, f.file_path,
      case when f.doc_id is null then 'failed' else 'synced' end as status, coalesce(f.has_transcript, false) as has_transcript, f.summary_status from documents d left join f on f.doc_id = d.doc_id and f.matched
    union all select (select max(doc_id) from documents) + row_number() over (order by first), 'https://h.example.com/' || case when first_moved then 'b' else 'a' end || '?id=' || doc_id, canonical_url, column_name, title, item_key, file_path,
      'synced', has_transcript, summary_status from f where not matched""",
)
def _(spark, d):
    items = _stored(spark, d)
    rows = importing.changed(items, workflow.import_notes(items, _crowded_vault(spark, d), _vault_columns(spark, d))[1], "2025")
    return rows.select("id", "source_url", "canonical_url", "column_name", "title", "item_key", "file_path", "status", "has_transcript", "summary_status")


def _stored(spark, d):
    """The state before an import: items of even ids have the address of a note, which updates them, and others an address of their own."""
    null = F.lit(None).cast("string")
    rows = _docs(spark, d)
    filled = {"id": F.col("doc_id"), "source_url": F.concat(F.lit("https://h.example.com/a?id="), F.when(F.col("doc_id") % 2 == 1, "own").otherwise(""), "doc_id"), "column_name": F.col("source"), "status": F.lit("failed"), "has_transcript": F.lit(False), "transcribed": F.lit(False)}
    return rows.select(*(filled.get(f.name, null).cast(f.dataType).alias(f.name) for f in state.ITEMS))


def _full(spark, d):
    """The items as state.ITEMS."""
    null, items = F.lit(None).cast("string"), _items(spark, d)
    more = {"canonical_url": F.col("source_url"), "published_at": null, "synced_at": null, "transcribed": F.lit(False), "error_message": null, "created_at": F.lit("2024")}
    return items.withColumns(more).select(*state.ITEMS.names)


#: A rendered note, as SQL: {sync} is the time of writing, {note} the permanent note, {word} a keyword.
_RENDERED = """array_to_string(['---', 'source: "web"', 'column: "' || column_name || '"', 'title: "' || title || '"', 'author: "' || coalesce(author, '') || '"', 'published: "' || coalesce(published_at, '') || '"',
  'url: "' || source_url || '"', 'content_type: "transcript"', 'summary_style: "zettelkasten"', 'sync_time: "{sync}"', 'tags:', '  - "' || column_name || '"', '---', '', '# ' || title, '', '## 原子卡片', '', '> 摘要尚未生成。', '',
  '## 永久笔记', '', {note}, '', '## 关联', '', '- ', '', '## 行动/观察', '', '- ', '', '## 复习问题', '', '- ', '', '## 关键词', '', '', '', '## 来源', '', '- <' || source_url || '>', '', '## 全文稿', '', {text}, ''], chr(10))"""
_RETRIED = f"""select *, case when id % 5 = 4 then 'notes/' || column_name || case when published_at is null then '/' else '/2024/' end || column_name || '-' || coalesce(published_at, 'unknown-da') || '-' || title || '.md' end as base from (
  select i.* exclude (title), case when id % 5 <= 1 then 'T' || id % 2 when id % 3 = 0 then 'Found' else 'T' || id % 2 end as title, case when id % 5 > 1 and id % 4 = 0 then 'Kim' end as author, case when id % 5 > 1 and id % 2 = 0 then '2024-05-06' end as published_at,
    case when id % 5 = 0 then 'lost connection' when id % 5 = 1 then 'no page' end as err, case id % 5 when 2 then 'too_short' when 3 then 'policy_blocked:drm_widevine' end as rsn, id % 5 = 4 as got, id % 2 = 0 as bad
  from (select * from ({_ITEMS_SQL}) where status in ('failed', 'extractor_failed', 'missing_transcript', 'transcription_failed') order by updated_at nulls first, id limit 200) i)"""
_RETRY_NOTES = f"""select id, note, case when ident = case when base = 'notes/' || column_name || '/' || column_name || '-unknown-da-T1.md' then 'other' else first_value(ident) over (partition by base order by updated_at nulls first, id) end then base
  else replace(base, '.md', '-' || left(ident, 8) || '.md') end as final_path from (select *, {_RENDERED.format(sync='2025', note="case when bad then '> 摘要尚未生成。' else 'n' || id end", text="'t' || id")} as note,
    sha256({_RENDERED.format(sync='<ignored>', note="case when bad then '> 摘要尚未生成。' else 'n' || id end", text="'t' || id")}) as ident from ({_RETRIED}) where got)"""


def _retried(spark, d):
    i = F.col("id")
    made = F.from_json(F.concat(F.lit('{"permanent_note": "n'), i, F.lit('", "status": "'), F.when(i % 2 == 0, "summary_failed").otherwise("ok"), F.lit('"}')), notes.SUMMARY)
    results = _items(spark, d).select(
        F.when(i % 5 == 1, -i).otherwise(i).alias("id"), F.when(i % 5 == 0, "lost connection").alias("error"), F.when(i % 5 == 2, "too_short").when(i % 5 == 3, "policy_blocked:drm_widevine").alias("reason"),
        F.when(i % 5 == 2, F.concat(F.lit("raw"), i)).alias("raw_hash"), F.when(i % 5 == 4, F.concat(F.lit("t"), i)).alias("transcript"), F.when(i % 5 == 4, made).alias("summary"),
        F.when(i % 3 == 0, "Found").otherwise("The Site").alias("found_title"), F.when(i % 4 == 0, "Kim").alias("found_author"), F.when(i % 2 == 0, "2024-05-06").alias("found_published"),
    )
    items = _full(spark, d).withColumn("title", F.concat(F.lit("T"), i % 2))
    sources = _docs(spark, d).select("source").distinct()
    taken = sources.select(F.concat(F.lit("notes/"), "source", F.lit("/"), "source", F.lit("-unknown-da-T1.md")).alias("path"), F.lit("other").alias("identity"))
    return workflow.retry(items, results, "2025", 200, taken, is_generic=lambda t: F.lower(t) == "the site")


@query("retry_runs", f"select id as item_id, case when id % 5 = 3 then 'policy' else 'retry' end as action, case when err is not null then 'failed' when id % 5 = 3 then 'policy_blocked' when not got then 'extractor_failed' when bad then 'summary_failed' else 'synced' end as status, coalesce(err, rsn, n.final_path) as message from ({_RETRIED}) left join ({_RETRY_NOTES}) n using (id)")
def _(spark, d):
    return _retried(spark, d)[1]


@query(
    "retry_items",
    f"""select i.id, case when r.id is null then i.status when r.err is not null then 'failed' when r.id % 5 = 3 then 'policy_blocked' when not r.got then 'extractor_failed' else 'synced' end as status,
    case when r.id is null then i.summary_status when r.got then case when r.bad then 'summary_failed' else 'ok' end end as summary_status, coalesce(case when r.got then sha256('t' || i.id) when r.id % 5 = 2 then 'raw' || r.id end, i.content_hash) as content_hash,
    coalesce(r.err, r.rsn) as error_message, case when r.got then '2025' end as synced_at, coalesce(n.final_path, i.file_path) as file_path, case when r.id is null then 'T' || i.id % 2 else r.title end as title, r.published_at
    from ({_ITEMS_SQL}) i left join ({_RETRIED}) r on r.id = i.id left join ({_RETRY_NOTES}) n on n.id = i.id""",
)
def _(spark, d):
    return _retried(spark, d)[0].select("id", "status", "summary_status", "content_hash", "error_message", "synced_at", "file_path", "title", "published_at")


@query("retry_notes", f"select id, final_path, sha256(note) as note from ({_RETRY_NOTES})")
def _(spark, d):
    return _retried(spark, d)[2].select("id", "final_path", F.sha2("note", 256).alias("note"))


_WORK = f"select * from ({_ITEMS_SQL}) where has_transcript and file_path is not null and (summary_status is null or summary_status = 'summary_failed') order by updated_at nulls first, id limit 200"
_REMADE = f"select *, case when id % 5 = 0 then 'no note at ' || file_path when id % 5 = 1 then 'no transcript in the note' when id % 5 = 2 then 'no reply' when id % 5 = 3 then 'no recognizable note fields' end as err from ({_WORK})"


def _remade(spark, d):
    items, i = _full(spark, d).withColumn("title", F.lit("T")), F.col("id")
    body = F.when(i % 5 == 1, "# t\n").otherwise("# t\n\n## 全文稿\n\nbody\n")
    vault = items.select(F.when(i % 5 == 0, F.concat(F.lit("else/"), i)).otherwise(F.col("file_path")).alias("path"), body.alias("note"))
    replies = items.select(F.when(i % 5 == 2, -i).otherwise(i).alias("id"), F.when(i % 5 == 3, "chatter").otherwise('{"permanent_note": "n"}').alias("reply"))
    return workflow.resummarize(items, vault.where("path is not null"), replies, "2025", 200)


@query("resummarize_runs", f"select id as item_id, 'resummarize' as action, case when err is null then 'synced' else 'summary_failed' end as status, coalesce(err, file_path) as message from ({_REMADE})")
def _(spark, d):
    return _remade(spark, d)[1]


@query("resummarize_items", f"select i.id, case when r.id is null then i.status else 'synced' end as status, case when r.id is null then i.summary_status when r.err is null then 'ok' else 'summary_failed' end as summary_status, r.err as error_message from ({_ITEMS_SQL}) i left join ({_REMADE}) r on r.id = i.id")
def _(spark, d):
    return _remade(spark, d)[0].select("id", "status", "summary_status", "error_message")


@query("resummarized_notes", f"select id, file_path as final_path, sha256({_RENDERED.format(sync='2025', note=chr(39) + 'n' + chr(39), text=chr(39) + 'body' + chr(39))}) as note from (select * exclude (title), 'T' as title, null as author, null as published_at from ({_REMADE})) where err is null")
def _(spark, d):
    return _remade(spark, d)[2].select("id", "final_path", F.sha2("note", 256).alias("note"))




@query("archived_notes", "select doc_id as id, 'notes/' || source || '/2024/' || source || '-2024-05-06-n' || doc_id || '.md' as file_path from documents where doc_id % 6 in (0, 1)")
def _(spark, d):
    i = F.col("doc_id")
    docs = _docs(spark, d).where("text is not null and source is not null")
    spot = lambda folder: F.concat(F.lit("notes/"), "source", F.lit(folder), "source", F.lit("-2024-05-06-n"), i, F.lit(".md"))
    place = F.when(i % 6 == 4, F.concat(F.lit("notes/"), "source", F.lit("/plain"), i, F.lit(".md"))).when(i % 6 == 5, F.concat(F.lit("else/"), "source", F.lit("/a-2024-05-06-"), i, F.lit(".md"))).otherwise(spot("/"))
    kept = F.concat(F.lit("u"), i)
    items = docs.select(i.alias("id"), place.alias("file_path"), text.content_hash(F.concat(F.lit("body "), i)).alias("content_hash"), kept.alias("source_url"), kept.alias("canonical_url"), F.col("source").alias("column_name"))
    head = F.concat(F.lit("---\ncolumn: "), text.yaml_scalar(F.col("source")), F.lit("\nurl: "), text.yaml_scalar(F.when(i % 6 == 1, kept).otherwise("other")), F.lit("\n---\n"))
    body = F.concat(head, F.lit("\n## 全文稿\n\nbody "), F.when(i % 6 == 0, i.cast("string")).otherwise("edited"), F.lit("\n"))
    vault = docs.select(spot("/2024/").alias("path"), body.alias("note")).union(docs.select(F.when(i % 6 == 3, spot("/")).otherwise(spot("/other/")), body))
    return workflow.reconcile(items, vault, "notes").join(items.select("id", F.col("file_path").alias("before")), "id").where("file_path <> before").select("id", "file_path")


@query("year_folders", f"select doc_id, case doc_id % 3 when 0 then 'notes/' || source || '/2024/' || source || '-2024-05-06-n' || doc_id || '.md' when 1 then 'notes/' || source || '/2024/' || source || '-2024-05-06-n' || doc_id || '.md' else 'notes/' || source || '/n' || doc_id || '.md' end as path from documents")
def _(spark, d):
    given = "case doc_id % 3 when 0 then 'notes/' || source || '/' || source || '-2024-05-06-n' || doc_id || '.md' when 1 then 'notes/' || source || '/2024/' || source || '-2024-05-06-n' || doc_id || '.md' else 'notes/' || source || '/n' || doc_id || '.md' end"
    return _docs(spark, d).select("doc_id", workflow.year_folder(F.expr(given)).alias("path"))


_SLUGGED = rf"regexp_replace(regexp_replace({_HOST} || case when p <> '' then '_' || p else '' end || '_k' || page_id, '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g')"


@query("quarantine_names", rf"select page_id, '20250101-000000-' || left({_SLUGGED}, 80) || '-' || left(sha256(html), 12) || '.html' as name from (select *, regexp_replace(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), '^/+|/+$', '', 'g') as p from pages)")
def _(spark, d):
    key = F.concat(F.lit("k"), "page_id")
    return table(spark, d, "pages").select("page_id", workflow.quarantine_name(F.lit("20250101-000000"), F.col("url"), key, text.content_hash(F.col("html"))).alias("name"))


@query(
    "merged_metadata",
    """select doc_id, case when doc_id % 4 in (0, 1) then 'Found ' || doc_id else 'own' end as title, case when doc_id % 2 = 0 then 'Kim' else 'Lee' end as author, case when doc_id % 3 = 0 then '2024-01-02' else null end as published_at from documents""",
)
def _(spark, d):
    i = F.col("doc_id")
    rows = _docs(spark, d).select(
        "doc_id", F.lit("own").alias("title"), F.lit("Lee").alias("author"), F.lit(None).cast("string").alias("published_at"),
        F.when(i % 4 < 2, F.concat(F.lit("Found "), i)).when(i % 4 == 2, "The SITE app").otherwise("").alias("found_title"), F.when(i % 2 == 0, "Kim").otherwise("").alias("found_author"), F.when(i % 3 == 0, "2024-01-02").alias("found_published"),
    )
    return pages.merge_metadata(rows, lambda t: failures.is_site_title(t, ("the site",), ("site app",)))


@query("redacted_urls", "select page_id, case when contains(url, '?') then regexp_replace(url, '#.*$', '') || '&' else regexp_replace(url, '#.*$', '') || '?' end || 'token=[REDACTED]&long=<50 chars>' as url from pages")
def _(spark, d):
    bare = F.regexp_replace("url", "#.*$", "")
    made = F.concat(bare, F.when(F.contains("url", F.lit("?")), "&").otherwise("?"), F.lit("token=abc&long=" + "x" * 50))
    return table(spark, d, "pages").select("page_id", urls.redact_query(made).alias("url"))


@query("identity_hashes", "select doc_id, sha256('sync_time: \"<ignored>\"' || chr(10) || text) as h from documents")
def _(spark, d):
    note = F.concat(F.lit('sync_time: "'), "doc_id", F.lit('"\n'), "text")
    return _docs(spark, d).select("doc_id", text.identity_hash(note).alias("h"))


_PROPS = "'{\"title\": \"t' || event_id || '\", \"z\": [{\"text\": ' || event_id || ', \"b\": 1}, {\"text\": \"x  y\"}], \"k\": {\"desc\": null}}'"


@query(
    "keyword_fields",
    """select event_id, 0 as pos, 'title' as path, 't' || event_id as preview from events union all select event_id, 1, 'z[0].text', event_id::varchar from events
    union all select event_id, 2, 'z[1].text', 'x y' from events union all select event_id, 3, 'k.desc', 'null' from events""",
)
def _(spark, d):
    rows = table(spark, d, "events").select("event_id", F.expr(_PROPS).alias("v"))
    return payloads.keyword_fields(rows, "v").drop("v")


@query("top_keys", "select event_id, case event_id % 3 when 0 then 'k' when 1 then 'a,b' else '' end as keys from events")
def _(spark, d):
    v = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, '[{"b": 1, "a": 2}, {"c": 3}]').otherwise("[1]")
    return table(spark, d, "events").select("event_id", F.array_join(payloads.top_keys(v), ",").alias("keys"))


@query("trace_summary", "select count(*) as records, count(*) filter (where event_type = 'click' or event_type = 'view' or value > 40) as interesting from events")
def _(spark, d):
    kind = F.when(F.col("event_type") == "click", "application/JSON").otherwise("text/html")
    return payloads.trace_summary(table(spark, d, "events").select(kind.alias("content_type"), (F.col("event_type") == "view").alias("media_like"), F.when(F.col("value") > 40, 2).otherwise(0).alias("n_fields")))


@query(
    "state_items",
    """select doc_id, 'https://h.example.com/course/article?id=e' || doc_id as source_url, 'Title ' || doc_id as title, 'e' || doc_id as item_key, case when doc_id % 2 = 0 then '2024-05-06' end as published_at from documents
    union all select doc_id, 'https://h.example.com/x/' || doc_id, 'Second', 'i' || doc_id, null from documents""",
)
def _(spark, d):
    i = F.col("doc_id")
    first = F.concat(F.lit('{"enid": "e'), i, F.lit('", "id": 5, "title": " Title  '), i, F.lit('", "publishTime": '), F.when(i % 2 == 0, "1714953600").otherwise("0"), F.lit("}"))
    second = F.concat(F.lit('{"id": "i'), i, F.lit('", "title": "", "audio": {"title": "Second"}, "url": "/x/'), i, F.lit('#f"}'))
    whole = F.concat(F.lit("["), first, F.lit(","), second, F.lit(","), first, F.lit(',{"title": "abc", "enid": "q"},{"title": "no address"}]'))
    docs = _docs(spark, d)
    states = docs.select(i.alias("capture_id"), F.lit(2).alias("pos"), whole.alias("s")).union(docs.select(i, F.lit(1), F.lit('[{"title": "shorter", "enid": "z"}]')))
    lists = payloads.longest_lists(states.select("capture_id", "pos", F.from_json("s", "array<variant>").alias("list")))
    return payloads.state_items(lists.select("capture_id", F.to_json("list").alias("list")), "https://h.example.com/c").withColumnRenamed("capture_id", "doc_id")


@query(
    "block_texts",
    f"""select doc_id, b as transcript_head, sha256(b) as h from (select doc_id, array_to_string(list_filter([{_squash('text')}, 'in line', 'bare'], lambda x: x <> ''), chr(10) || chr(10)) as b from documents)""",
)
def _(spark, d):
    block = lambda kind, own: F.to_json(F.struct(F.lit(kind).alias("type"), own.alias("text")))
    inner = F.lit('{"type": "paragraph", "contents": [{"text": {"content": "in "}}, "li", {"contents": [{"text": "ne"}]}]}')
    blocks = F.concat_ws(",", block("paragraph", F.concat(F.lit(payloads.READER_NAME), "text")), block("Audio", F.lit("no")), inner, F.lit('" bare "'), F.lit('{"type": "divider"}'))
    content = F.concat(F.lit("["), blocks, F.lit("]"))
    payload = F.to_json(F.struct(F.struct(content.alias("content")).alias("c")))
    rows = _docs(spark, d).where("text is not null").select("doc_id", payload.alias("p"))
    body = text.once(rows, "b", payloads.block_text(F.col("p")))
    return body.select("doc_id", F.col("b").alias("transcript_head"), text.content_hash(F.col("b")).alias("h"))


@query("detail_payloads", "select page_id, '{\"c\": ' || page_id || '}' as payload from pages where page_id % 3 = 0 and page_id % 4 <> 3")
def _(spark, d):
    i = F.col("page_id")
    body = F.when(i % 3 == 0, F.concat(F.lit('{"c": '), i, F.lit("}"))).when(i % 3 == 1, "[1]").otherwise("{broken")
    address = F.concat(F.lit("https://h.example.com/"), F.when(i % 4 == 3, "list").otherwise("article/get"), F.lit("?id="), i)
    found = payloads.detail_payloads(table(spark, d, "pages").select(address.alias("url"), body.alias("body")), "/article/get")
    return found.select(F.regexp_extract("url", r"id=(\d+)", 1).cast("long").alias("page_id"), "payload")
