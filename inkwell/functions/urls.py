"""URL expressions: Column -> Column; absolute URLs stay inside the JVM, relative ones are resolved by one Arrow function."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts of an address that name a page of content.
DETAIL_MARKERS = ("detail", "course", "article", "audio", "video", "content", "knowledge", "id=")


def is_http(c: Column) -> Column:
    return c.rlike(r"^https?://[^/?#]+")


def host(c: Column) -> Column:
    return F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def is_detail(c: Column, host_suffix: str, markers: tuple[str, ...] = DETAIL_MARKERS) -> Column:
    """A page of content, on a host with that suffix or on none."""
    near = (host(c) == "") | F.endswith(host(c), F.lit(host_suffix))
    marked = F.lit(False)
    for m in markers:
        marked = marked | F.contains(F.lower(c), F.lit(m))
    return near & marked


def extract_id(c: Column) -> Column:
    """The id parameter, else the last part of the path, else null."""
    path = F.regexp_replace(F.regexp_extract(c, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1), "^/+|/+$", "")
    last = F.element_at(F.split(path, "/"), -1)
    found = F.regexp_extract(c, r"[?&]id=([^&#]+)", 1)
    return F.when(found != "", found).when(path != "", last)


def normalize_absolute(c: Column) -> Column:
    """Host in lower case, query pairs in order, no fragment; for absolute URLs in canonical escapes."""
    query = F.regexp_extract(c, r"^[^?#]*\?([^#]*)", 1)
    pairs = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda x: x != "")), "&")
    stem = F.concat(F.lower(F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), F.lit("://"), F.lower(host(c)), F.regexp_extract(c, r"^[^:]+://[^/?#]*([^?#]*)", 1))
    return F.when(pairs == "", stem).otherwise(F.concat(stem, F.lit("?"), pairs))


def resolve(url: Column, base: Column) -> Column:
    """A possibly relative URL against a base: host in lower case, no parameters and fragment, query pairs decoded, in order, and escaped anew.

    Only relative URLs go to Python, to be joined to their base.
    """
    absolute = url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")
    whole = F.when(absolute, url).otherwise(F.pandas_udf(_joined, "string")(F.when(~absolute, url), F.when(~absolute, base)))
    coded = lambda x: F.replace(F.replace(F.url_encode(F.coalesce(F.try_url_decode(x), x)), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    plain = lambda x: F.coalesce(F.try_url_decode(x), x)
    pair = lambda p: F.struct(F.regexp_extract(p, "^([^=]*)", 1).alias("k"), F.regexp_extract(p, "=(.*)$", 1).alias("v"))
    pairs = F.transform(F.filter(F.split(F.regexp_extract(whole, r"^[^?#]*\?([^#]*)", 1), "&"), lambda x: x != ""), pair)
    ordered = F.array_sort(F.transform(pairs, lambda p: F.struct(plain(p["k"]), plain(p["v"]), F.concat(coded(p["k"]), F.lit("="), coded(p["v"])).alias("shown"))))
    query = F.array_join(F.transform(ordered, lambda p: p["shown"]), "&")
    scheme, rest = F.regexp_extract(whole, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), F.regexp_replace(whole, r"^[A-Za-z][A-Za-z0-9+.-]*:", "")
    net = F.lower(F.regexp_extract(rest, r"^(//[^/?#]*)", 1))
    path = F.regexp_extract(F.regexp_replace(rest, r"^//[^/?#]*", ""), r"^([^?#;]*)", 1)
    return F.concat(F.lower(scheme), net, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def _joined(urls: pd.Series, bases: pd.Series) -> pd.Series:
    return pd.Series([None if u is None else urljoin(b or "", u) for u, b in zip(urls, bases)], dtype=object)


def redact_query(c: Column, names: str = r"(?i)token|key|secret|sign|session|auth|pass", longest: int = 40) -> Column:
    """Values of sensitive query parameters masked, long ones by their length."""

    def pair(p):
        name, value = F.regexp_extract(p, "^([^=]*)", 1), F.regexp_extract(p, "=(.*)$", 1)
        shown = F.when(name.rlike(names), F.lit("[REDACTED]")).when(F.length(value) > longest, F.concat(F.lit("<"), F.length(value).cast("string"), F.lit(" chars>"))).otherwise(value)
        return F.when(F.contains(p, F.lit("=")), F.concat(name, F.lit("="), shown)).otherwise(p)

    query = F.regexp_extract(c, r"^[^?#]*\?([^#]*)", 1)
    return F.when(query == "", c).otherwise(F.concat(F.regexp_extract(c, r"^([^?#]*)", 1), F.lit("?"), F.array_join(F.transform(F.split(query, "&"), pair), "&")))
