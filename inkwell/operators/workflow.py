"""Batches over items and notes: checks of columns, sequences, pages of items, retries, summaries anew, imports, archives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import text, urls
from inkwell.operators import importing, notes, numbering, pages, state
from inkwell.sources.shared import stored

FILENAME_FIELDS = ("column", "published_date", "title")


def enabled(columns: DataFrame, name: str | None = None) -> DataFrame:
    """The enabled columns, or the enabled one of that name."""
    out = columns.where(F.coalesce("enabled", F.lit(False)))
    return out if name is None else out.where(F.col("name") == name)


def field_differences(pattern: Column, required: tuple[str, ...] = FILENAME_FIELDS) -> Column:
    """struct(missing, unsupported): the fields that a name pattern lacks, and those that it may not have, each in order."""
    found = F.array_distinct(F.regexp_extract_all(pattern, F.lit(r"\{([A-Za-z_]+)\}")))
    want = F.array(*map(F.lit, required))
    return F.struct(F.array_sort(F.array_except(want, found)).alias("missing"), F.array_sort(F.array_except(found, want)).alias("unsupported"))


def column_checks(columns: DataFrame, settings: DataFrame, providers: tuple[str, ...] = ()) -> DataFrame:
    """(rule, subject) of all that is wrong with columns (name, url, enabled) and settings (interval, provider, pattern)."""
    fail = lambda df, rule, c: df.select(F.lit(rule).alias("rule"), c.cast("string").alias("subject"))
    on = columns.agg(F.count_if(F.coalesce("enabled", F.lit(False))).alias("n"))
    fields = settings.select(field_differences(F.col("pattern")).alias("f"))
    parts = [
        fail(on.where("n = 0"), "no_enabled_column", F.lit("")),
        fail(columns.where(~F.coalesce(urls.is_http(F.col("url")), F.lit(False))), "invalid_url", F.col("name")),
        fail(state.repeated(columns, "name"), "duplicate_name", F.col("name")),
        fail(settings.where("interval < 0"), "negative_interval", F.col("interval")),
        fail(settings.where(~F.coalesce(F.col("provider").isin(*providers), F.lit(False))), "unsupported_provider", F.col("provider")),
        fail(fields.select(F.explode("f.missing").alias("x")), "missing_field", F.col("x")),
        fail(fields.select(F.explode("f.unsupported").alias("x")), "unsupported_field", F.col("x")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def sequence(items: DataFrame, key: str, order: str) -> DataFrame:
    """items with place and of: their place in their column from 1, and how many it has."""
    sizes = items.groupBy(key).agg(F.count("*").alias("of"))
    return numbering.placed(items, [order], "place", [key]).join(sizes, key)


def with_pages(items: DataFrame, pages: DataFrame, payloads: DataFrame) -> DataFrame:
    """items with what was fetched for their detail_url: kind (payload before html, else missing) and content.

    pages: url, html; payloads: url, seq, payload (the last counts). Addresses are compared normalized.
    """
    key = lambda df, c: df.withColumn("_url", urls.resolve(F.col(c), F.col(c)))
    html = key(pages, "url").groupBy("_url").agg(F.min("html").alias("_html"))
    last = key(payloads, "url").groupBy("_url").agg(F.max_by("payload", "seq").alias("_payload"))
    out = key(items, "detail_url").join(html, "_url", "left").join(last, "_url", "left")
    kind = F.when(F.col("_payload").isNotNull(), "payload").when(F.col("_html").isNotNull(), "html").otherwise("missing")
    return out.select(*(out[c] for c in items.columns), kind.alias("kind"), F.coalesce("_payload", "_html").alias("content"))


def as_items(rows: DataFrame) -> DataFrame:
    """Stored rows as items to work on: the address of the detail page falls back to the source's."""
    return rows.withColumn("detail_url", F.coalesce(F.nullif("canonical_url", F.lit("")), "source_url"))


def retry(
    items: DataFrame, results: DataFrame, now: str, limit: int = 20, stored_notes: DataFrame | None = None, root: str = "notes", source: str = "web", is_generic=lambda title: F.lit(False)
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, run rows, notes) after the retry of up to `limit` failed items, longest untouched first.

    results: id, error, reason, raw_hash, transcript, summary (struct notes.SUMMARY) and found_title,
    found_author, found_published of what was fetched now; an item without one failed to be fetched.
    What a page says of itself goes before what the item says, but for generic titles; an item that
    failed to be fetched stays as it is. A transcript becomes a note (final_path, note) beside stored
    ones (path, identity), with an empty summary if that failed; its path is the item's. Failed
    summaries are not retried.
    """
    work = state.oldest_of(items, list(state.RETRY), limit)
    r = as_items(work).join(results, "id", "left")
    has = F.coalesce("transcript", F.lit("")) != ""
    lost = F.col("reason").isNull() & F.col("transcript").isNull()
    error = F.coalesce("error", F.when(lost, "no page"))
    for name in ("title", "author", "published"):
        r = r.withColumn(f"found_{name}", F.when(error.isNull(), F.col(f"found_{name}")))
    merged = pages.merge_metadata(r.withColumn("author", F.lit(None).cast("string")), is_generic)
    failed = F.coalesce(F.col("summary.status") == "summary_failed", F.lit(False))
    named = merged.select(
        "id", "source_url", "detail_url", "item_key", "column_name", "title", "author", "published_at", "transcribed", "reason", "transcript", "summary", "updated_at", error.alias("error"), has.alias("has_transcript"),
        F.when(has, text.content_hash(F.col("transcript"))).otherwise(F.when(error.isNull(), F.col("raw_hash"))).alias("content_hash"),
        F.lit(False).alias("known"), F.lit(False).alias("duplicate"), failed.alias("summary_failed"),
    )
    out = stored(state.outcomes(named))
    made = out.where("has_transcript and error is null").withColumn("summary", F.when(~F.col("summary_failed"), F.col("summary")).otherwise(F.lit(None).cast(notes.SUMMARY)))
    made = made.select("id", "title", "column_name", "author", "published_at", F.col("detail_url").alias("url"), "transcript", "has_transcript", "summary", "updated_at")
    written = stored(noted(stored(made), stored_notes, root, source, now, F.struct("updated_at", "id")))
    done = out.join(written.select("id", "final_path"), "id", "left")
    changes = done.select(
        F.col("id").alias("seq"), F.col("id").alias("existing_id"), "source_url", "item_key", F.col("detail_url").alias("canonical_url"), "content_hash", F.col("final_path").alias("file_path"),
        "column_name", "title", "published_at", "status", "has_transcript", "transcribed",
        F.when(F.col("has_transcript"), F.coalesce("summary.status", F.lit("disabled"))).alias("summary_status"), text.redact(F.coalesce("error", F.when(~F.col("has_transcript"), F.col("reason")))).alias("error_message"),
    )
    action = F.when(F.col("status") == "policy_blocked", "policy").otherwise("retry")
    runs = done.select(F.col("id").alias("item_id"), action.alias("action"), "status", F.coalesce("error", F.when(~F.col("has_transcript"), F.col("reason")), "final_path", F.lit("")).alias("message"))
    return state.upsert(items, changes, now), runs, written


def noted(rows: DataFrame, stored_notes: DataFrame | None, root: str, source: str, now: str, order: Column) -> DataFrame:
    """id, final_path, note of rows with the columns that notes.render takes, beside stored notes (path, identity)."""
    rows = text.once(rows.withColumn("seq", order), "note", notes.render(rows, source, now))
    digest = F.left(text.content_hash(F.col("note")), F.lit(8))
    place = lambda longest: notes.path(root, F.col("column_name"), F.col("published_at"), F.col("title"), digest, longest)
    named = stored(rows.select("id", "seq", "note", text.identity_hash(F.col("note")).alias("identity"), place(240).alias("path"), place(0).alias("short")))
    return notes.without_collisions(named, stored_notes, short="short").select("id", "final_path", "note")


def resummarize(items: DataFrame, vault: DataFrame, replies: DataFrame, now: str, limit: int = 20, every: bool = False, source: str = "web") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, run rows, notes) after summaries were made anew for up to `limit` items that need one, longest untouched first.

    vault: path, note; replies: id, reply of the summary service. A missing note, a note without
    transcript, and a reply without content fail; a failure keeps the item's content, and its note.
    The others' notes (final_path, note) are written anew in their places.
    """
    work = as_items(state.needs_summary(items, every)).orderBy(F.col("updated_at").asc_nulls_first(), "id").limit(limit)
    notes_of = vault.select(F.col("path").alias("file_path"), notes.read_back(F.col("note")).alias("body"), F.lit(True).alias("present"))
    r = work.join(notes_of, "file_path", "left").join(replies, "id", "left").withColumn("s", notes.parse_summary(F.col("reply")))
    error = (
        F.when(F.col("present").isNull(), F.concat(F.lit("no note at "), "file_path")).when(F.col("body") == "", "no transcript in the note")
        .when(F.col("reply").isNull(), "no reply").when(F.col("s.status") != "ok", "no recognizable note fields")
    )
    r = stored(r.withColumn("error", error))
    ok = F.col("error").isNull()
    changes = r.select(
        F.col("id").alias("seq"), F.col("id").alias("existing_id"), "source_url", "item_key", F.col("detail_url").alias("canonical_url"), "content_hash", "file_path", "column_name", "title", "published_at",
        F.when(ok, "synced").otherwise("summary_failed").alias("status"), F.lit(True).alias("has_transcript"), "transcribed",
        F.when(ok, "ok").otherwise("summary_failed").alias("summary_status"), text.redact(F.col("error")).alias("error_message"),
    )
    runs = r.select(
        F.col("id").alias("item_id"), F.lit("resummarize").alias("action"), F.when(ok, "synced").otherwise("summary_failed").alias("status"),
        F.when(ok, F.col("file_path")).otherwise(text.redact(F.col("error"))).alias("message"),
    )
    done = r.where(ok).select("id", "file_path", "title", "column_name", F.lit(None).cast("string").alias("author"), "published_at", F.col("detail_url").alias("url"), F.col("body").alias("transcript"), "has_transcript", F.col("s").alias("summary"))
    return state.upsert(items, changes, now), runs, done.select("id", F.col("file_path").alias("final_path"), notes.render(done, source, now).alias("note"))


def noted_items(vault: DataFrame, columns: DataFrame) -> DataFrame:
    """Notes of enabled columns as items: path, column_name, and outcome (missing_meta without address or title).

    vault: path, column_name (its folder), note. Addresses are resolved against the column's own.
    """
    position = F.col("position") if "position" in columns.columns else F.lit(0)
    on = enabled(columns).select(F.col("name").alias("column_name"), F.col("url").alias("base"), position.alias("position"))
    rows = vault.join(F.broadcast(on), "column_name")  # a row for each configured column
    rows = text.once(rows, "f", notes.front_matter(F.col("note")))
    rows = rows.withColumns({"url": F.coalesce(F.col("f")["url"], F.lit("")), "title": F.coalesce(F.col("f")["title"], F.lit(""))})
    rows = text.once(rows, "detail_url", urls.resolve(F.col("url"), F.col("base")))
    return rows.select(
        "path", "column_name", F.left("title", F.lit(120)).alias("title"), F.col("detail_url").alias("source_url"), urls.extract_id(F.col("detail_url")).alias("item_key"),
        F.nullif(F.regexp_extract(F.coalesce(F.col("f")["published"], F.lit("")), r"\d{4}-\d{2}-\d{2}", 0), F.lit("")).alias("published_at"),
        (text.strip(notes.read_back(F.col("note"))) != "").alias("has_transcript"), F.col("note").rlike("### 卡片 1").alias("has_summary"),
        F.when((F.col("url") == "") | (F.col("title") == ""), "missing_meta").otherwise("item").alias("outcome"), "position",
    )


def import_notes(items: DataFrame, vault: DataFrame, columns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(noted, known): the notes of a vault, and those that are items with the item that each finds or makes.

    Notes follow each other by their column's position (name, where columns have none) and path, and
    each meets the items as the ones before left them. importing.tallies and importing.changed take it
    from here.
    """
    noted = stored(noted_items(vault, columns))
    return noted, importing.resolved(noted.where("outcome = 'item'"), items, ["position", "column_name", "path"])


def archived_paths(items: DataFrame, vault: DataFrame, root: str) -> DataFrame:
    """(id, file_path) of the items whose note has moved to the folder of its year: those that the vault holds there.

    Only notes that are gone from a column's folder under root count, and only where the note says
    the same text or names the same column and address as the item. vault: path, note.
    """
    inside = items.where(F.startswith("file_path", F.lit(root + "/")))
    rest = F.substring("file_path", len(root) + 2, 1 << 20)
    flat = inside.where(F.size(F.split(rest, "/")) == 2).join(vault.select(F.col("path").alias("file_path")), "file_path", "left_anti")
    year = F.regexp_extract("file_path", r"-(20\d{2})-\d{2}-\d{2}-[^/]*$", 1)
    moved = flat.withColumn("_year", year).where("_year <> ''").withColumn("path", F.regexp_replace("file_path", "/([^/]*)$", F.concat(F.lit("/"), F.col("_year"), F.lit("/$1"))))
    found = moved.join(vault, "path")
    body = notes.read_back(F.col("note"))
    same_text = (body != "") & (text.content_hash(body) == F.col("content_hash"))
    lines = F.split(F.regexp_extract("note", r"^---\n([\s\S]*?)\n---\n", 1), "\n")
    says = lambda name, c: F.coalesce(F.array_contains(lines, F.concat(F.lit(f"{name}: "), text.yaml_scalar(c))) & (F.coalesce(c, F.lit("")) != ""), F.lit(False))
    same_source = says("column", F.col("column_name")) & (says("url", F.col("source_url")) | says("url", F.col("canonical_url")))
    return found.where(F.coalesce(same_text, F.lit(False)) | same_source).select("id", F.col("path").alias("file_path"))


def reconcile(items: DataFrame, vault: DataFrame, root: str) -> DataFrame:
    """items with the paths of archived_paths; all else stays."""
    moved = archived_paths(items, vault, root).withColumnRenamed("file_path", "_moved")
    return items.join(moved, "id", "left").withColumn("file_path", F.coalesce("_moved", "file_path")).select(*items.columns)


def year_folder(path: Column) -> Column:
    """A note's path in the folder of its year, if its name gives a date and it stands in no such folder yet."""
    year = F.regexp_extract(path, r"/[^/-]+-(\d{4})-\d{2}-\d{2}-[^/]*\.md$", 1)
    there = path.rlike(r"/20\d\d/[^/]*$")
    return F.when((year == "") | there, path).otherwise(F.regexp_replace(path, "/([^/]*)$", F.concat(F.lit("/"), year, F.lit("/$1"))))


def quarantine_name(stamp: Column, url: Column, key: Column, html_hash: Column) -> Column:
    """The name under which a failed page is kept: time, address and key as a slug, and the start of its hash."""
    net = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    path = F.regexp_replace(F.regexp_extract(url, r"^[^:]+://[^/?#]*([^?#]*)", 1), "^/+|/+$", "")
    filled = F.filter(F.array(net, path, F.coalesce(key, F.lit(""))), lambda x: x != "")
    digest = F.coalesce(F.nullif(F.left(text.strip(html_hash), F.lit(12)), F.lit("")), F.lit("nohash"))
    return F.concat(stamp, F.lit("-"), F.left(text.slug(F.array_join(filled, "_"), "detail"), F.lit(80)), F.lit("-"), digest, F.lit(".html"))


def quarantined(failed: DataFrame, stamp: str) -> DataFrame:
    """Failed pages (page_id, url, html, key) as they are kept: day, name, html, the text that they show, and their anchors as JSON."""
    own = failed.withColumn("name", quarantine_name(F.lit(stamp), F.col("url"), F.col("key"), text.content_hash(F.col("html"))))
    shown = pages.parsed(failed.select("page_id", "url", "html")).select("page_id", F.col("visible").alias("text"), F.to_json("anchors").alias("anchors"))
    return own.join(shown, "page_id").select("page_id", F.lit(stamp[:8]).alias("day"), "name", "url", "html", "text", "anchors")


def quarantine(failed: DataFrame, stamp: str, path: str) -> None:
    """Keeps failed pages as a table partitioned by day."""
    quarantined(failed, stamp).drop("page_id").write.mode("append").partitionBy("day").parquet(path)
