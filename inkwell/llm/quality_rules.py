"""Rule bitmask ledger: every rule is evaluated once; policies and ablations only read bits."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, bytes_of, quoted, read_table, unused

SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")

#: Bit -> (name, SQL condition over the measures; true means that the document fails).
RULES = {
    0: ("few_words", "n_words < 50"),
    1: ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    2: ("symbols", "100 * n_symbols > 10 * word_chars"),
    3: ("repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    4: ("short_words", "word_chars < 2 * n_words"),
    5: ("long_words", "word_chars > 25 * n_words"),
    6: ("shouting", "100 * n_upper > 50 * word_chars"),
    7: ("marks", "100 * n_marks > 50 * n_words"),
}
#: Version -> bits that reject. Version 1 has the base rules only.
POLICIES = {1: 0b00000011, 2: 0b11111111}
BASE_MASK = POLICIES[1]
POLICY = 2


def _upper(text: bytes) -> int:
    return len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))


def measure(text: bytes, n_chars: int) -> tuple[int, ...]:
    """The measures of one text (UTF-8) of n_chars code points."""
    words = text.split()
    n = len(words)
    spaces = len(text) - sum(map(len, words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:]))
        found = Counter(windows)
        if len(found) < len(windows):
            twice = np.fromiter((found[w] > 1 for w in windows), bool, len(windows))
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[k : n - 2 + k] |= twice
            repeated = int(covered.sum())
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    marks = text.count(b"!") + text.count(b"?")
    return n, n_chars - spaces, symbols, len(lines) - len(set(lines)), repeated, len(lines), _upper(text), marks


def fail_mask(name=lambda measure: measure) -> Column:
    """The mask of the measures, whose columns `name` gives: bit k is set if rule k fails."""

    def condition(rule: str) -> Column:
        return F.expr(re.sub(r"\b(" + "|".join(MEASURES) + r")\b", lambda m: name(m[0]), rule))

    bits = [F.when(condition(rule), F.lit(1 << bit)).otherwise(F.lit(0)) for bit, (_, rule) in RULES.items()]
    return sum(bits[1:], bits[0]).cast("long")


def evaluate_rules(docs: DataFrame) -> DataFrame:
    """The ledger: doc_id, the measures, and fail_mask (bit k set: rule k fails).

    One row per input row, repeated rows included; a null text counts as empty and fails
    few_words; a null doc_id stays null; other columns are ignored, whatever their names.
    """

    def start():
        def work(ids, texts):
            chars = pc.utf8_length(texts).to_pylist()
            rows = [measure(t, c or 0) for t, c in zip(bytes_of(texts), chars)]
            return [ids, *zip(*rows)] if rows else None

        return work

    ledger = arrow_map(
        docs, [F.col("doc_id").cast("long"), "text"], "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES), start
    )
    return ledger.withColumn("fail_mask", fail_mask())


def apply_policy(ledger: DataFrame, version: int = POLICY) -> DataFrame:
    """Adds base_failed and kept; no text is read again for another version."""
    mask = F.col("fail_mask")
    return ledger.withColumn("base_failed", mask.bitwiseAND(F.lit(BASE_MASK)) != 0).withColumn(
        "kept", mask.bitwiseAND(F.lit(POLICIES[version] | BASE_MASK)) == 0
    )


def keep(docs: DataFrame, version: int = POLICY) -> DataFrame:
    """The rows of docs that a policy keeps, with all their columns; judged in place, nothing is shuffled.

    The text's entry of the ledger (measures and mask) stands beside the row and only its mask is
    read. Columns stay as they are, whatever their names; null and empty texts fail few_words and
    go; repeated rows are judged each alike; an empty table stays empty.
    """

    @F.pandas_udf("struct<" + ", ".join(f"{m}: long" for m in MEASURES) + ">")
    def measured(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measure((t or "").encode(), len(t or "")) for t in texts], columns=list(MEASURES))

    name = unused("measured", docs.columns)
    entry = docs.withColumn(name, measured(F.col("text")))
    entry = entry.withColumn(name, fail_mask(lambda m: f"{name}.{m}"))
    return entry.where(F.col(name).bitwiseAND(F.lit(POLICIES[version] | BASE_MASK)) == 0).select(*map(quoted, docs.columns))


def ablations(ledger: DataFrame, version: int = POLICY) -> DataFrame:
    """For each rule of a policy: rows that fail it, and rows that it alone rejects.

    Rows are first counted by mask, so at most 2^rules rows are left to combine.
    """
    mask = POLICIES[version]
    counted = ledger.groupBy(F.col("fail_mask").bitwiseAND(F.lit(mask)).alias("m")).agg(F.count("*").alias("n"))
    rules = ledger.sparkSession.createDataFrame(
        [(bit, name, 1 << bit) for bit, (name, _) in RULES.items() if mask >> bit & 1], "bit int, rule string, flag long"
    )
    hit = F.col("m").bitwiseAND(F.col("flag")) != 0
    return (
        rules.join(F.broadcast(counted), hit, "left")  # at most 2^8 rows
        .groupBy("bit", "rule")
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("n_failed"),
            F.coalesce(F.sum(F.when(F.col("m") == F.col("flag"), F.col("n"))), F.lit(0)).alias("n_only"),
        )
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_policy(evaluate_rules(read_table(spark, sf_dir, "documents"))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines", "n_upper", "n_marks", "fail_mask",
    )


SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
ORACLE = rf"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
w as (select r, doc_id, t, regexp_extract_all(t, '{WORD}') as ws,
        list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{WORD}')) as ls from d),
p as (select r, unnest(range(len(ws))) as i, ws from w where len(ws) > 3),
g as (select r, i, ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] as s from p where i + 3 <= len(ws)),
c as (select r, i, count(*) over (partition by r, s) as n from g),
h as (select r, count(distinct j) as n from (select r, i + unnest([0, 1, 2]) as j from c where n > 1) group by r),
m as (select doc_id, len(ws)::bigint as n_words,
        length(regexp_replace(t, '{SPACE}', '', 'g'))::bigint as word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
        (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
        coalesce(h.n, 0)::bigint as n_repeat_words, len(ls)::bigint as n_lines,
        (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::bigint as n_upper,
        (length(t) - length(regexp_replace(t, '[!?]', '', 'g')))::bigint as n_marks
      from w left join h using (r)),
f as (select *, ({" + ".join(f"case when {rule} then {1 << bit} else 0 end" for bit, (_, rule) in RULES.items())})::bigint as fail_mask from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (fail_mask & {BASE_MASK}) <> 0 as base_failed, (fail_mask & {POLICIES[POLICY]}) = 0 as kept,
  n_lines, n_upper, n_marks, fail_mask from f
"""
