"""State tables of items, runs and run items: merge rules, last write wins, numbering, lists, and run counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.operators.numbering import placed

#: Columns of an update: the new value counts if it is not null, or it always counts.
KEEP_OLD = ("item_key", "canonical_url", "content_hash", "file_path")
OVERWRITE = ("column_name", "title", "published_at", "status", "has_transcript", "transcribed", "summary_status", "error_message")
# Statuses that are tried again (failed summaries are not), and those that are shown as failed.
RETRY = ("failed", "extractor_failed", "missing_transcript", "transcription_failed")
ATTENTION = ("failed", "extractor_failed", "missing_transcript", "policy_blocked", "transcription_failed")
ITEMS = T.StructType(
    [T.StructField("id", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in ("source_url", "item_key", "canonical_url", "column_name", "title", "published_at", "synced_at", "content_hash", "status", "file_path")]
    + [T.StructField(n, T.BooleanType()) for n in ("has_transcript", "transcribed")]
    + [T.StructField(n, T.StringType()) for n in ("summary_status", "error_message", "created_at", "updated_at")]
)


def migrate(items: DataFrame, now: str) -> DataFrame:
    """An older table in today's columns: missing ones null, then filled as far as others tell."""
    spark = items.sparkSession
    full = spark.createDataFrame([], ITEMS).unionByName(items, allowMissingColumns=True)
    repaired = (F.col("status") == "summary_failed") & F.col("has_transcript") & F.col("file_path").isNotNull()
    return full.withColumns(
        {
            "canonical_url": F.coalesce("canonical_url", "source_url"),
            "created_at": F.coalesce(F.nullif("created_at", F.lit("")), F.lit(now)),
            "updated_at": F.coalesce(F.nullif("updated_at", F.lit("")), F.lit(now)),
            "status": F.when(repaired, "synced").otherwise(F.col("status")),
        }
    )


def upsert(items: DataFrame, changes: DataFrame, now: str, top: int | None = None) -> DataFrame:
    """The next snapshot of items. changes: item columns, seq, and existing_id (null: a new item).

    Of several changes to an item, or to a new source_url, the last by seq counts; a change with
    neither is a new item of its own. New ids follow the greatest old one (or `top`, where items are
    only a part) in order of seq: only new rows are numbered. A stored summary failure is a synced item.
    """
    key = F.coalesce(F.concat(F.lit("id:"), F.col("existing_id")), F.concat(F.lit("url:"), F.col("source_url")))
    known = changes.where(key.isNotNull())
    c = known.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("seq")))).where("_n = 1").drop("_n").union(changes.where(key.isNull()))
    stored = F.col("status") == "summary_failed"
    c = c.withColumn("status", F.when(stored & F.col("has_transcript") & F.col("file_path").isNotNull(), "synced").otherwise(F.col("status")))
    mark = (F.col("c.status") == "synced") | (F.col("c.has_transcript") & F.col("c.file_path").isNotNull())
    hit = F.col("c.existing_id").isNotNull()
    merged = items.alias("o").join(c.where("existing_id is not null").alias("c"), F.col("o.id") == F.col("c.existing_id"), "left")
    updated = merged.select(
        "o.id", "o.source_url",
        *(F.coalesce(f"c.{n}", f"o.{n}").alias(n) for n in KEEP_OLD),
        *(F.when(hit, F.col(f"c.{n}")).otherwise(F.col(f"o.{n}")).alias(n) for n in OVERWRITE),
        F.when(mark, F.lit(now)).otherwise(F.col("o.synced_at")).alias("synced_at"), "o.created_at", F.when(hit, F.lit(now)).otherwise(F.col("o.updated_at")).alias("updated_at"),
    )
    last = items.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")) if top is None else items.sparkSession.createDataFrame([(top,)], "top long")
    fresh = placed(c.where("existing_id is null"), ["seq", "source_url"], "_place").alias("c").crossJoin(F.broadcast(last)).select(  # one row
        (F.col("top") + F.col("_place")).alias("id"), "c.source_url", *KEEP_OLD, *OVERWRITE,
        F.when(mark, F.lit(now)).alias("synced_at"), F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"),
    )
    return updated.unionByName(fresh).select(*ITEMS.names)


def last_wins(run_items: DataFrame) -> DataFrame:
    """One row per run and item: the last by seq."""
    w = Window.partitionBy("run_id", "item_id").orderBy(F.desc("seq"))
    return run_items.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def newest(rows: DataFrame, by: str, limit: int = 20) -> DataFrame:
    return rows.orderBy(F.col(by).desc_nulls_last(), F.desc("id")).limit(limit)


def oldest_of(items: DataFrame, statuses: list[str], limit: int) -> DataFrame:
    """Work list: items with one of the statuses, longest untouched first; none for no statuses."""
    return items.where(F.col("status").isin(*statuses) if statuses else F.lit(False)).orderBy(F.col("updated_at").asc_nulls_first(), "id").limit(limit)


def attention(items: DataFrame, also: tuple[str, ...] = (), limit: int = 20) -> DataFrame:
    """Items that need attention or have one of the statuses `also`, longest untouched first."""
    return oldest_of(items, list(dict.fromkeys((*ATTENTION, *also))), limit)


def needs_summary(items: DataFrame, every: bool = False) -> DataFrame:
    out = items.where(F.col("has_transcript") & F.col("file_path").isNotNull())
    return out if every else out.where(F.col("summary_status").isNull() | (F.col("summary_status") == "summary_failed"))


def run_details(run_items: DataFrame, items: DataFrame, run_id, limit: int | None = None) -> DataFrame:
    """Actions of a run with what is known of their items, if anything; with a limit the first by item."""
    own = run_items.where(F.col("run_id") == F.lit(run_id)).select("run_id", "item_id", "action", F.col("status").alias("run_item_status"), "message")
    own = own if limit is None else own.orderBy("item_id").limit(limit)
    return own.join(items.select(F.col("id").alias("item_id"), "title", "column_name", "status"), "item_id", "left")


def outcomes(rows: DataFrame) -> DataFrame:
    """rows with action, status and new: what became of each item of a listing.

    Read are known, error, reason, has_transcript, duplicate and summary_failed, in the order of
    the tests: a known item is skipped, an exception fails, a blocked page is blocked, no text is an
    extraction failure if there is a reason for it, a known content hash is skipped.
    """
    c = F.col
    status = (
        F.when(c("known"), F.lit(None)).when(c("error").isNotNull(), "failed").when(is_blocked(c("reason")), "policy_blocked")
        .when(~c("has_transcript"), F.when(F.coalesce(c("reason"), F.lit("")) != "", "extractor_failed").otherwise("missing_transcript"))
        .when(c("duplicate"), F.lit(None)).when(c("summary_failed"), "summary_failed").otherwise("synced")
    )
    return rows.withColumns({"status": status, "action": F.when(status.isNull(), "skip").otherwise("sync"), "new": ~c("known")})


def is_blocked(reason: Column) -> Column:
    """Whether a reason names a blocked page; false for null."""
    return F.coalesce(F.startswith(reason, F.lit("policy_blocked:")), F.lit(False))


#: Counter -> the rows that it counts.
COUNTERS = {
    "discovered_count": "true",
    "new_count": "action <> 'skip'",
    "skipped_count": "action = 'skip'",
    "success_count": "status = 'synced'",
    "failed_count": "status in ('failed', 'policy_blocked', 'extractor_failed')",
    "missing_transcript_count": "status = 'missing_transcript'",
    "summary_failed_count": "summary_status = 'summary_failed'",
}


def run_counters(outcomes: DataFrame) -> DataFrame:
    """Counters and status of each run from its outcome rows, in one aggregation; requests are summed where rows have them."""
    sums = [F.coalesce(F.sum("requests"), F.lit(0)).alias("request_count")] if "requests" in outcomes.columns else []
    counted = outcomes.groupBy("run_id").agg(*(F.count_if(F.expr(rule)).alias(n) for n, rule in COUNTERS.items()), *sums)
    bad = F.col("failed_count") + F.col("missing_transcript_count") + F.col("summary_failed_count")
    return counted.withColumn("status", F.when(bad == 0, "success").otherwise("partial_failed"))


# What a warning is about, by the first pattern that it has.
REASONS = (
    (r"(?i)(summary failed|summary_failed)", "summary_api_failure"),
    (r"(?i)fetch.*fail|download.*fail|request.*fail", "fetch_failure"),
    (r"(?i)(timeout|retry|connection)", "network_issue"),
)
MISSING = r"(?i)missing transcript.*:\s*(.+)$"


def reason_counts(log: DataFrame, message: str = "message") -> DataFrame:
    """Warnings by category; those of a missing transcript by what they say themselves; others do not count."""
    m = F.col(message)
    category = F.when(m.rlike(MISSING), F.trim(F.regexp_extract(m, MISSING, 1)))
    for pattern, name in REASONS:
        category = category.when(m.rlike(pattern), name)
    return log.select(category.alias("category")).where("category is not null").groupBy("category").agg(F.count("*").alias("n"))


def top_details(rows: DataFrame, section: str, order: list[str], most: int = 10) -> DataFrame:
    """The first rows of each section, and how many more it has."""
    w = Window.partitionBy(section)
    ranked = rows.withColumn("rank", F.row_number().over(w.orderBy(*order)))
    more = rows.groupBy(section).agg(F.greatest(F.count("*") - most, F.lit(0)).alias("more"))
    return ranked.where(F.col("rank") <= most).join(more, section)


def titles_by(rows: DataFrame, key: str, order: str, title: str) -> DataFrame:
    """key, place, title: the titles of each key in order, a row each, so that no key's list is held whole."""
    return placed(rows.select(key, order, F.col(title).alias("title")), [order, "title"], "place", [key]).select(key, "place", "title")


def empty_columns(columns: DataFrame, items: DataFrame, key: str = "column_name", valid: str | None = None) -> DataFrame:
    """The columns for which no item was found, but for those that a flag column calls empty but valid."""
    left = columns if valid is None else columns.where(~F.coalesce(F.col(valid), F.lit(False)))
    return left.select(key).join(items.select(key), key, "left_anti").distinct()


def repeated(rows: DataFrame, key: str) -> DataFrame:
    """key and n, of the values that occur more than once."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
