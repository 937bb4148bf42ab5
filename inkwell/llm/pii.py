"""Personal data by anchor expansion: an Aho-Corasick scan finds anchors, local parsers do the rest."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, read_table

#: Kinds in the order that breaks ties of start: the base ones first.
KINDS = ("email", "ip", "card", "phone", "url", "account", "address")
N_BASE = 4
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = "0123456789"
CUES = ("iban", "account", "acct", "passport", "ssn", "tax id", "customer id", "national id", "token", "api_key", "secret", "password")
#: Cues whose values may be base64.
SECRETS = ("token", "api_key", "secret", "password")
STREETS = ("Street", "St.", "Avenue", "Ave.", "Road", "Rd.", "Lane", "Boulevard", "Blvd.")

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
QUAD = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CHAIN = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
URL_REST = re.compile(r"://[^\s<>\"'|]*[A-Za-z0-9/_=&%-]")
#: After a cue: optional words, a separator, an optional quote, then the value, as long as it is.
LEAD = re.compile(r"(?:\x20(?:number|no\.?|code))?\x20?[:=#]\x20?[\"']?")
VALUE = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.-]{4,}[A-Za-z0-9](?![A-Za-z0-9])")
SECRET = re.compile(r"[A-Za-z0-9+/][A-Za-z0-9_.+/=-]{4,}[A-Za-z0-9_+/=-](?![A-Za-z0-9])")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
HOUSE = re.compile(r"[0-9]{1,5}\x20(?:[A-Z][A-Za-z'-]{1,30}\x20){1,4}$")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def iban_ok(value: str) -> bool:
    v = value.replace(" ", "")
    return 15 <= len(v) <= 34 and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def automaton() -> ahocorasick.Automaton:
    """Anchors: at-signs, plus-signs, digits, dots before digits, schemes and cues; for texts in lower case."""
    found = ahocorasick.Automaton()
    for d in DIGITS:
        found.add_word(d, ("digit", 1))
        found.add_word(f".{d}", ("dot", 2))
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    for scheme in ("http", "https", "ftp", "sftp", "ssh"):
        found.add_word(f"{scheme}://", ("scheme", len(scheme) + 3))
    for cue in CUES:
        found.add_word(cue, ("cue", len(cue)))
    for street in STREETS:
        found.add_word(f" {street.lower()}", ("street", len(street) + 1))
    found.make_automaton()
    return found


def folded(text: str) -> str:
    """text in lower case at equal length; one letter alone (U+0130) would become two."""
    return text.replace("\u0130", "I").lower()


def find_spans(text: str, anchors: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(start, kind index, end) in order; base kinds are leftmost and do not overlap within a kind."""
    spans: list[tuple[int, int, int]] = []
    extra: list[tuple[int, int, int]] = []
    email_at = ip_at = card_at = phone_at = url_at = value_at = 0
    for last, (what, width) in anchors.iter(folded(text)):
        at = last + 1 - width
        if what == "digit":
            if at >= card_at and (m := CHAIN.match(text, at)):
                card_at = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    spans.append((at, 2, card_at))
        elif what == "dot":
            start = at
            while start > ip_at and text[start - 1] in DIGITS:
                start -= 1
            if ip_at <= start < at and (m := QUAD.match(text, start)):
                ip_at = m.end()
                if all(len(v := p.lstrip("0")) <= 3 and int(v or 0) <= 255 for p in m[0].split(".")):
                    spans.append((start, 1, ip_at))
        elif what == "at":
            start = at
            while start > email_at and text[start - 1] in LOCAL:
                start -= 1
            if email_at <= start < at and (m := DOMAIN.match(text, at)):
                email_at = m.end()
                spans.append((start, 0, email_at))
        elif what == "plus":
            if at >= phone_at and (m := PHONE.match(text, at)):
                phone_at = m.end()
                if 9 <= sum(c in DIGITS for c in m[0]) <= 15:
                    spans.append((at, 3, phone_at))
        elif what == "scheme":
            if not at or not text[at - 1].isalnum():
                if last + 1 >= url_at and (m := URL_REST.match(text, last - 2)):
                    url_at = m.end()  # an address within another one ends where that does
                if url_at > last + 1:
                    extra.append((at, 4, url_at))
        elif what == "cue":
            if at and (text[at - 1].isalnum() or text[at - 1] == "_"):
                continue
            rest = last + 1
            if text[at:rest].lower() == "iban":
                while rest < len(text) and text[rest] in " :":
                    rest += 1
                if (m := IBAN.match(text, rest)) and iban_ok(m[0]):
                    extra.append((rest, 5, m.end()))
            elif (m := LEAD.match(text, rest)) and m.end() >= value_at:
                if m := (SECRET if text[at:rest].lower() in SECRETS else VALUE).match(text, m.end()):
                    value_at = m.end()  # what begins within a value has no more digits than it
                    if sum(c in DIGITS for c in m[0]) >= 4:
                        extra.append((m.start(), 5, m.end()))
        elif text[at + 1 : last + 1] not in STREETS:
            continue
        elif last + 1 == len(text) or not text[last + 1].isalnum():
            line = text[max(0, at - 140) : at + 1]
            if (m := HOUSE.search(line)) and (not m.start() or not line[m.start() - 1].isalnum()):
                extra.append((at + 1 - len(m[0]), 6, last + 1))
    if extra:
        base = [sorted((s, e) for s, k, e in spans if k == kind) for kind in range(N_BASE)]
        behind, end = [0] * N_BASE, 0
        for s, k, e in sorted(set(extra)):
            clear = s >= end
            for kind, own in enumerate(base) if clear else ():
                i = behind[kind]
                while i < len(own) and own[i][1] <= s:
                    i += 1
                behind[kind] = i
                while clear and i < len(own) and own[i][0] < e:
                    # an account goes beyond what a base kind takes of it
                    clear = k == 5 and (s < own[i][0] or own[i][1] < e)
                    i += 1
            if clear:
                spans.append((s, k, e))
                end = e
    spans.sort()
    return spans


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_extra: one row per input row.

    A null text counts as empty: no spans, the hash of the empty text. Repeated rows give
    repeated results; null ids stay null; other columns are ignored, whatever their names; an
    empty table gives no rows. Texts are scanned whole in one pass; positions are code points.
    """

    def start():
        anchors = automaton()

        def work(ids, texts):
            out = []
            for text in texts.to_pylist():
                spans = find_spans(text or "", anchors)
                base = [x for x in spans if x[1] < N_BASE]
                kinds = [x[1] for x in base]
                out.append((*(kinds.count(k) for k in range(N_BASE)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans) - len(base)))
            return [ids, *zip(*out)] if out else None

        return work

    return arrow_map(
        docs,
        [F.col("doc_id").cast("long"), "text"],
        "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_extra long",
        start,
    )


def redact_pii(docs: DataFrame) -> DataFrame:
    """docs with each span of its text replaced by [KIND], and n_chars, where there is one, counted anew.

    Keeps every row, and every column, whatever its name; a null text stays null, an empty one
    empty; an empty table stays empty. Overlapping spans of two kinds are replaced together, under
    the first one's name.
    """
    text = docs.schema["text"].name

    def cut(spans, text):
        out, at = [], 0
        for s, k, e in spans:
            if s >= at:
                out += [text[at:s], f"[{KINDS[k].upper()}]"]
            at = max(at, e)
        return "".join([*out, text[at:]])

    @F.pandas_udf("string")
    def redact(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        anchors = automaton()
        for texts in batches:
            yield texts.map(lambda t: t if t is None else cut(find_spans(t, anchors), t))

    out = docs.withColumn(text, redact(F.col(text)))
    return out.withColumn("n_chars", F.char_length(text).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(read_table(spark, sf_dir, "documents"))
