"""Reports on runs: rows of runs, failure messages, details by section, and reports as lines of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from inkwell.functions import text
from inkwell.operators import state

# What a report calls the counters of a run, in order, and its sections.
COUNTS = (
    ("total_columns", "总栏目数"), ("discovered_count", "发现条目数"), ("new_count", "新增文章数"), ("skipped_count", "跳过文章数"), ("success_count", "成功文章数"),
    ("request_count", "网页请求数"), ("failed_count", "失败文章数"), ("missing_transcript_count", "无文字稿文章数"), ("summary_failed_count", "摘要失败数"),
)
SECTIONS = ("新增内容：", "无文字稿/待处理：", "摘要失败：", "失败：")
MORE = ("- 还有 ", " 条，详见日志或 list 命令。")
HIDDEN = "明细：已按配置隐藏标题；请在本机用 list --runs / list --failed 查看。"


def media_label(media: Column) -> Column:
    """How many media a page has, and up to three of their distinct kinds, in order; null for none."""
    kinds = F.array_sort(F.array_distinct(F.transform(media, lambda m: F.coalesce(F.nullif(m["mime_type"], F.lit("")), F.nullif(m["label"], F.lit("")), F.lit("media")))))
    shown = F.concat(F.lit("media_candidates="), F.size(media).cast("string"), F.lit(" ("), F.array_join(F.slice(kinds, 1, 3), ", "), F.lit(")"))
    return F.when(F.size(media) > 0, shown)


def failure_message(reason: Column, media: Column, diagnostic: Column) -> Column:
    """Why an item has no text, as far as it is known; null if nothing is."""
    page = F.concat(F.lit("diagnostic_html="), F.nullif(diagnostic, F.lit("")))
    return F.nullif(F.concat_ws("; ", F.nullif(reason, F.lit("")), media_label(media), page), F.lit(""))


def start_runs(columns: DataFrame, runs: DataFrame, log_path: Column | None = None) -> DataFrame:
    """runs (run_id, started_at) as rows of a run table: running, with the number of enabled columns."""
    total = columns.agg(F.count_if("enabled").alias("total_columns"))
    path = F.lit(None).cast("string") if log_path is None else log_path
    return runs.crossJoin(F.broadcast(total)).select("run_id", "started_at", F.lit("running").alias("status"), "total_columns", path.alias("log_path"))  # one row


def written_run(outcomes: DataFrame, path: str) -> DataFrame:
    """Writes the outcome rows of a run, and gives its counters and status as one row, from the pass that writes them.

    Nothing is read again: the counters are observed where the rows go by, a partial sum a task. A run
    without rows has counters of zero.
    """
    seen = Observation("run")
    asked = outcomes if "requests" in outcomes.columns else outcomes.withColumn("requests", F.lit(0))
    counted = [F.count_if(F.expr(rule)).alias(n) for n, rule in state.COUNTERS.items()]
    asked.observe(seen, *counted, F.coalesce(F.sum("requests"), F.lit(0)).cast("long").alias("request_count")).write.mode("overwrite").parquet(path)
    counts = {n: seen.get.get(n) or 0 for n in (*state.COUNTERS, "request_count")}
    bad = counts["failed_count"] + counts["missing_transcript_count"] + counts["summary_failed_count"]
    row = outcomes.sparkSession.createDataFrame([tuple(counts.values())], ", ".join(f"{n} long" for n in counts))
    return row.withColumn("status", F.lit("partial_failed" if bad else "success"))


def finish_runs(started: DataFrame, counted: DataFrame, failures: DataFrame, finished_at: DataFrame, most: int = 50) -> DataFrame:
    """Started runs with their counters (run_counters), the end of each (run_id, finished_at), and what failed.

    failures: run_id, seq, message. The first `most` messages of a run, secrets masked, are its
    error_message; how many there are the counters tell.
    """
    rank = F.row_number().over(Window.partitionBy("run_id").orderBy("seq"))
    first = failures.withColumn("rank", rank).where(F.col("rank") <= most)
    lines = F.array_sort(F.collect_list(F.struct("rank", text.redact(F.col("message")).alias("m"))))
    said = first.groupBy("run_id").agg(F.array_join(F.transform(lines, lambda x: x["m"]), "\n").alias("error_message"))
    known = counted.withColumnRenamed("status", "final")
    out = started.join(known, "run_id", "left").join(finished_at, "run_id", "left").join(said, "run_id", "left")
    return out.withColumn("status", F.coalesce("final", "status")).drop("final")


def detail_lines(details: DataFrame, most: int = 10) -> DataFrame:
    """(run_id, section, line, n): up to `most` lines of each section of a run, in order, and how many details it has.

    details: run_id, section (a number), column_name (null in the section of failures), seq, title, note.
    Columns follow one another as each first appears.
    """
    own = Window.partitionBy("run_id", "section", "column_name")
    first = details.withColumn("_first", F.min("seq").over(own))
    rank = F.row_number().over(Window.partitionBy("run_id", "section").orderBy("_first", "seq"))
    title = F.when(F.coalesce("note", F.lit("")) == "", F.col("title")).otherwise(F.concat("title", F.lit("（"), text.redact(F.col("note")), F.lit("）")))
    line = F.concat(F.lit("- "), F.when(F.col("column_name").isNotNull(), F.concat("column_name", F.lit("："))).otherwise(""), text.redact(title))
    sizes = details.groupBy("run_id", "section").agg(F.count("*").alias("n"))
    return first.withColumn("rank", rank).where(F.col("rank") <= most).select("run_id", "section", "rank", line.alias("line")).join(sizes, ["run_id", "section"])


def run_reports(runs: DataFrame, details: DataFrame, heading: Column, host: str, titles: bool = True, most: int = 10) -> DataFrame:
    """run_id and report: a text for each finished run; sections without details are left out.

    runs: run_id, started_at, finished_at (timestamps), status, the counters and log_path. At most
    `most` lines a section are gathered, and what is left is counted.
    """
    lines = detail_lines(details, most)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"])
    more = F.max("n") - most
    rest = F.when(more > 0, F.array(F.concat(F.lit(MORE[0]), more.cast("string"), F.lit(MORE[1])))).otherwise(F.array().cast("array<string>"))
    blocks = lines.groupBy("run_id", "section").agg(F.concat(ordered, rest).alias("lines"))
    names = F.array(*map(F.lit, SECTIONS))
    block = F.concat(F.lit("\n\n"), F.element_at(names, F.col("section")), F.lit("\n"), F.array_join("lines", "\n"))
    parts = blocks.groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", block.alias("b")))), lambda x: x["b"]), "").alias("details"))
    seconds = F.greatest(F.lit(0), F.unix_timestamp("finished_at") - F.unix_timestamp("started_at"))
    head = [heading, F.lit(""), F.concat(F.lit("执行时间："), F.date_format("finished_at", "yyyy-MM-dd HH:mm:ss")), F.lit(f"运行机器：{host}")]
    head += [F.concat(F.lit("耗时："), seconds.cast("string"), F.lit("s")), F.concat(F.lit("状态："), F.col("status"))]
    head += [F.concat(F.lit(f"{name}："), F.col(c).cast("string")) for c, name in COUNTS]
    shown = F.coalesce("details", F.lit("")) if titles else F.when(F.col("details").isNotNull(), F.lit("\n\n" + HIDDEN)).otherwise("")
    log = F.when(F.col("log_path").isNotNull(), F.concat(F.lit("\n\n日志："), F.col("log_path"))).otherwise("")
    return runs.join(parts, "run_id", "left").select("run_id", F.concat(F.concat_ws("\n", *head), shown, log).alias("report"))


def pass_totals(passes: DataFrame) -> DataFrame:
    """passes and fixed: how many passes (failed_before, failed_after) there were, and what they mended; none mends less than nothing."""
    gain = F.greatest(F.col("failed_before") - F.col("failed_after"), F.lit(0))
    return passes.agg(F.count("*").alias("passes"), F.coalesce(F.sum(gain), F.lit(0)).alias("fixed"))


def exit_codes(checks: DataFrame) -> DataFrame:
    """exit_code of checks (group, status): 1 for a group with an error."""
    return checks.groupBy("group").agg(F.max(F.when(F.col("status") == "error", 1).otherwise(0)).alias("exit_code"))


def daily_report(items: DataFrame, log: DataFrame, totals: DataFrame, day: str) -> DataFrame:
    """The report of a day as rows (section, place, line), to be read in this order; no list is gathered.

    items: failed ones (status, column_name, title, id); log: message; totals: one row of metric counts.
    """
    from inkwell.operators import state

    def rows(section: int, df: DataFrame, place: Column, line: Column) -> DataFrame:
        return df.select(F.lit(section).alias("section"), place.cast("string").alias("place"), line.alias("line"))

    def cells(*cs: Column) -> Column:
        return F.concat(F.lit("| "), F.concat_ws(" | ", *(c.cast("string") for c in cs)), F.lit(" |"))

    spark = items.sparkSession
    heads = ((0, f"# daily report - {day}"), (1, "## Summary"), (2, "## Failure reason analysis"), (3, "## Failed by status"), (4, "## Failed by column"), (5, "## Remaining failed items"))
    heads_df = spark.createDataFrame([(n, "", h) for n, h in heads], "section int, place string, line string")
    metrics = totals.select(F.explode(F.array(*(F.struct(F.lit(k).alias("i"), F.lit(c).alias("m"), F.col(c).cast("long").alias("v")) for k, c in enumerate(totals.columns)))).alias("x"))
    out = heads_df.union(rows(1, metrics, F.col("x.i") + 1, cells(F.col("x.m"), F.col("x.v"))))
    reasons = state.reason_counts(log)
    out = out.union(rows(2, reasons, F.col("category"), cells(F.col("category"), F.col("n"))))
    for section, key in ((3, "status"), (4, "column_name")):
        out = out.union(rows(section, items.groupBy(key).agg(F.count("*").alias("n")), F.col(key), cells(F.col(key), F.col("n"))))
    title = F.when(F.length("title") > 50, F.concat(F.left("title", F.lit(50)), F.lit("..."))).otherwise(F.col("title"))
    return out.union(rows(5, items, F.lpad(F.col("id").cast("string"), 20, "0"), cells(F.col("status"), F.col("column_name"), title)))
