"""Captured payloads: article lists of page states, blocks of article bodies, and traces of responses."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import text, urls
from inkwell.operators import pages

# Kinds of blocks without text of their own, and a place holder.
SILENT_BLOCKS = ("audio", "image", "video", "divider", "salutation")
READER_NAME = "$_IGET_USER_NAME_$"
# Names of fields that may hold content, and files that are media.
KEYWORDS = r"(?i)(transcript|subtitle|caption|subtitles|captions|vtt|srt|text|content|brief|desc|title|live|replay)"
MEDIA_FILES = r"(?i)(\.m3u8|\.mp4|\.m4a|\.aac|\.vtt|\.srt)(?:[?#]|$)"
STATE_LIST = "array<struct<enid: string, id: string, title: string, publishTime: string, url: string, audio: struct<title: string, articleEnid: string>>>"


def longest_lists(states: DataFrame) -> DataFrame:
    """capture_id and list of states (capture_id, pos, list): the longest list of each; of equals the first; empty ones do not count."""
    size = F.size("list")
    return states.where(size > 0).groupBy("capture_id").agg(F.max_by("list", F.struct(size, -F.col("pos"))).alias("list"))


def state_items(captures: DataFrame, base: str, detail: str = "/course/article?id=") -> DataFrame:
    """Items of captured lists (capture_id, list as JSON): a title of four characters, and an address or an id; each address once."""
    rows = captures.select("capture_id", F.posexplode(F.from_json("list", STATE_LIST)).alias("pos", "a"))
    enid = text.strip(text.first_filled(F.col("a.enid"), F.col("a.audio.articleEnid")))
    rows = rows.select(
        "capture_id", "pos", text.squash(text.first_filled(F.col("a.title"), F.col("a.audio.title"))).alias("title"), enid.alias("enid"),
        text.strip(text.first_filled(F.col("a.id"))).alias("own"), text.strip(text.first_filled(F.col("a.url"))).alias("url"), text.publish_date(F.col("a.publishTime")).alias("published_at"),
    ).where((F.length("title") >= 4) & ((F.col("url") != "") | (F.col("enid") != "")))
    given = F.when(F.col("url") != "", F.col("url")).otherwise(F.concat(F.lit(detail), "enid"))
    rows = rows.withColumn("source_url", urls.resolve(given, F.lit(base)))
    first = F.row_number().over(Window.partitionBy("capture_id", "source_url").orderBy("pos"))
    return rows.withColumn("n", first).where("n = 1").select(
        "capture_id", "source_url", F.left("title", F.lit(120)).alias("title"), F.coalesce(F.nullif("enid", F.lit("")), F.nullif("own", F.lit("")), urls.extract_id(F.col("source_url"))).alias("item_key"), "published_at"
    )


#: Names under which captured cards give the same field, the first that is filled counts.
CARD_FIELDS = {
    "title": ("title",), "enid": ("enid", "en_id", "enId"), "id": ("id_str", "idStr", "id", "dd_article_id_str", "dd_article_id"),
    "published": ("publish_time", "publishTime"), "url": ("url", "ddurl", "share_url"),
}


def card_items(cards: DataFrame, base: str, detail: str = "/course/article?id=") -> DataFrame:
    """Items of captured audio cards (capture_id, pos, data as JSON): a title of four characters and an id; each address once.

    The address is made of the id, whatever address a card has; without a title the sound's counts.
    """
    card = cards.withColumn("card", F.try_parse_json("data"))
    said = lambda path: F.try_variant_get("card", f"$.{path}", "string")
    field = lambda name, *more: text.first_filled(*map(said, (*CARD_FIELDS[name], *more)))
    rows = card.select(
        "capture_id", "pos", text.squash(field("title", "audio.title")).alias("title"), text.strip(field("enid")).alias("item_key"), text.publish_date(field("published")).alias("published_at"),
    ).where((F.length("title") >= 4) & (F.col("item_key") != ""))
    rows = rows.withColumn("source_url", urls.resolve(F.concat(F.lit(detail), "item_key"), F.lit(base)))
    least = rows.groupBy("capture_id", "source_url").agg(F.min_by(F.struct("title", "item_key", "published_at"), "pos").alias("first"))
    return least.select("capture_id", "source_url", F.left("first.title", F.lit(120)).alias("title"), "first.item_key", "first.published_at")


def detail_payloads(responses: DataFrame, part: str) -> DataFrame:
    """url and payload of the responses (url, body) whose address holds `part`, and whose body is a JSON object."""
    whole = F.coalesce(F.startswith(F.to_json(F.try_parse_json("body")), F.lit("{")), F.lit(False))
    return responses.where(F.contains("url", F.lit(part)) & whole).select("url", F.col("body").alias("payload"))


def block_text(payload: Column) -> Column:
    """The normalized text of an article's payload (JSON); empty where it has none."""
    return text.normalize(F.pandas_udf(_block_texts, "string")(payload))


def _runs(value) -> list[str]:
    """The strings of an inline value, in order: its text, or else those of its contents."""
    out, todo = [], [value]
    while todo:
        one = todo.pop()
        if isinstance(one, str):
            out.append(one)
        elif isinstance(one, dict):
            own = one.get("text")
            own = own.get("content") if isinstance(own, dict) else own
            if isinstance(own, str):
                out.append(own)
            elif isinstance(one.get("contents"), list):
                todo += reversed(one["contents"])
    return out


def _lines(payload: str | None) -> list[str]:
    try:
        body = json.loads(payload or "null")
    except ValueError:
        return []
    body = body.get("c") if isinstance(body, dict) else None
    body = body.get("content") if isinstance(body, dict) else None
    if isinstance(body, str):
        try:
            body = json.loads(body)
        except ValueError:
            body = [{"text": body}]
    lines = []
    for block in body if isinstance(body, list) else [body]:
        if isinstance(block, dict):
            kind, own = str(block.get("type") or "").strip().lower(), block.get("text")
            inner = block.get("contents") if isinstance(block.get("contents"), list) else []
            parts = [] if kind in SILENT_BLOCKS else [own] if isinstance(own, str) and own.strip() else [r for part in inner for r in _runs(part)]
            lines.append(" ".join("".join(parts).replace(READER_NAME, "").split()))
        elif isinstance(block, str):
            lines.append(block.strip())
    return [x for x in lines if x]


def _block_texts(payloads: pd.Series) -> pd.Series:
    return payloads.map(lambda p: "\n\n".join(_lines(p)))


def canonical(payload: Column) -> Column:
    """A payload as it is written anew: names in their order, one space behind commas and colons, letters as they are; null where it is no JSON."""
    return F.pandas_udf(_written_anew, "string")(payload)


def _written_anew(payloads: pd.Series) -> pd.Series:
    def one(payload: str | None) -> str | None:
        try:
            return json.dumps(json.loads(payload or ""), ensure_ascii=False).encode("utf-8", "replace").decode()
        except ValueError:
            return None

    return payloads.map(one)


def from_payload(rows: DataFrame) -> DataFrame:
    """rows (payload) with transcript, has_transcript, reason and hash: the gate without a title test; no policy, no media.

    The hash is that of the payload written anew, so spaces between its parts do not count; of what is no JSON, of the text.
    """
    out = pages.gated(text.once(rows, "body", block_text(F.col("payload"))), "q", "body")
    ok, whole = F.col("q.ok"), F.coalesce(canonical(F.col("payload")), "payload")
    return out.select(*(out[c] for c in rows.columns), F.when(ok, F.col("body")).otherwise("").alias("transcript"), ok.alias("has_transcript"), F.col("q.reason").alias("reason"), text.content_hash(whole).alias("payload_hash"))


def top_keys(value: Column, most: int = 30) -> Column:
    """The first names, in order, of a JSON object, or of the first object of a list; none for others."""
    one = F.when(F.startswith(F.trim(value), F.lit("[")), F.get_json_object(value, "$[0]")).otherwise(value)
    names = F.coalesce(F.json_object_keys(one), F.array().cast("array<string>"))
    return F.slice(F.array_sort(names), 1, most)


def keyword_fields(rows: DataFrame, value: str, most: int = 30, pattern: str = KEYWORDS) -> DataFrame:
    """rows with pos, path and preview: up to `most` fields of a JSON value whose names match, in its order; of lists five elements."""
    named = re.compile(pattern)

    def found(source):
        try:
            todo = [("", "", json.loads(source or "null"))]
        except ValueError:
            return []
        out = []
        while todo and len(out) < most:
            path, name, one = todo.pop()
            if named.search(name):
                shown = " ".join((one if isinstance(one, str) else json.dumps(one, ensure_ascii=False)).split())
                out.append({"path": path, "preview": shown[:180] + "..." if len(shown) > 180 else shown})
            if isinstance(one, dict):
                todo += [(f"{path}.{k}" if path else k, k, v) for k, v in one.items()][::-1]
            elif isinstance(one, list):
                todo += [(f"{path}[{i}]", "", v) for i, v in enumerate(one[:5])][::-1]
        return out

    @F.pandas_udf("array<struct<path: string, preview: string>>")
    def fields(values: pd.Series) -> pd.Series:
        return values.map(found)

    spread = rows.select("*", F.posexplode(fields(F.col(value))).alias("pos", "field"))
    return spread.select(*(spread[c] for c in rows.columns), "pos", "field.path", "field.preview")


def trace_summary(trace: DataFrame) -> DataFrame:
    """records and interesting of a trace (content_type, media_like, n_fields): media, JSON, or fields with content."""
    kind = F.contains(F.lower(F.coalesce("content_type", F.lit(""))), F.lit("json"))
    hit = F.coalesce("media_like", F.lit(False)) | (F.coalesce("n_fields", F.lit(0)) > 0) | kind
    return trace.agg(F.count("*").alias("records"), F.count_if(hit).alias("interesting"))


def is_media_file(url: Column) -> Column:
    return url.rlike(MEDIA_FILES)
