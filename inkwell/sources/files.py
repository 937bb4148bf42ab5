"""File sources: pages, note vaults, captured article lists, network traces, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import text
from inkwell.operators import notes

ARTICLES = "struct<c: struct<article_list: array<struct<id: string, id_str: string, enid: string, en_id: string, title: string, publish_time: string, audio: struct<title: string>>>>>"


def html_files(spark: SparkSession, path: str) -> DataFrame:
    """url (the file's path) and html of each file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("url"), F.col("value").alias("html"))


def note_vault(spark: SparkSession, path: str) -> DataFrame:
    """Notes of a folder in order of their paths: path, fields of their front matter, transcript, and whether they have a summary."""
    rows = spark.read.text(path, wholetext=True, pathGlobFilter="*.md").select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("note"))
    return rows.select(
        "path", notes.front_matter(F.col("note")).alias("fields"), notes.read_back(F.col("note")).alias("transcript"),
        F.col("note").rlike("### 卡片 1").alias("has_summary"), F.nullif(F.regexp_extract("note", r"\d{4}-\d{2}-\d{2}", 0), F.lit("")).alias("date"),
    ).orderBy("path")


def article_lists(captures: DataFrame) -> DataFrame:
    """Articles of captured list responses (capture_id, body): those with a title of four characters and an id, each once."""
    c = captures.select("capture_id", F.explode(F.from_json("body", ARTICLES)["c"]["article_list"]).alias("a"))
    rows = c.select(
        "capture_id", text.squash(text.first_filled(F.col("a.title"), F.col("a.audio.title"))).alias("title"),
        text.first_filled(F.col("a.enid"), F.col("a.en_id")).alias("enid"), text.first_filled(F.col("a.id"), F.col("a.id_str")).alias("id"),
        text.publish_date(F.col("a.publish_time")).alias("published_at"),
    )
    return rows.where((F.length("title") >= 4) & (F.col("enid") != "")).dropDuplicates(["capture_id", "enid"])


def network_trace(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)
