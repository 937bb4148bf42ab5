"""Classes of failure messages, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions import text

# Parts of lower-cased messages.
TRANSIENT = (
    "sslv3_alert_bad_record_mac", "bad record mac", "connection reset", "econnreset", "net::err_http2_protocol_error",
    "net::err_connection", "temporarily unavailable",
)
SUMMARY_TRANSIENT = ("sslv3_alert_bad_record_mac", "bad record mac", "connection reset", "econnreset", "temporarily unavailable", "timed out", "timeout")
SHORTER_RETRY = ("empty message content", "recognizable note fields", "timeout after", "bad record mac")
# What the body of an error shows of a guard between client and service.
SIGNATURE_BANNED = ("error 1010", "browser_signature_banned", "browser's signature", "user-agent has been banned")
GUARD = ("_guard/", "captcha", "cloudflare", "browser", "user-agent")
GUARD_CODES = (403, 406, 418, 429, 456)
PAGE_BANNED = ("browser_signature_banned", "error 1010")
PAGE_GUARD = ("_guard/", "captcha", "cloudflare")
PAGE_HTML = ("<html", "<!doctype html")
# Words of a page that asks for a login, and of one that has it.
LOGIN_WORDS = ("扫码登录", "验证码登录", "手机号登录", "获取验证码", "请登录", "登录/注册")
ACCOUNT_WORDS = ("已购", "最近学习", "退出登录")


def has_any(c: Column, parts: tuple[str, ...]) -> Column:
    """Whether a lower-cased text holds one of the parts; false for null."""
    low = F.lower(F.coalesce(c, F.lit("")))
    found = F.lit(False)
    for part in parts:
        found = found | low.contains(part)
    return found


def is_transient(message: Column) -> Column:
    """Whether a fetch that failed so may be tried again."""
    return has_any(message, TRANSIENT)


def is_summary_transient(message: Column) -> Column:
    return has_any(message, SUMMARY_TRANSIENT)


def wants_shorter_text(message: Column) -> Column:
    """Whether a summary that failed so is tried again with less text."""
    return has_any(message, SHORTER_RETRY)


def http_hint(code: Column, body: Column) -> Column:
    """What a status code of the summary service points to: blocked, key, access, base_url or empty."""
    blocked = (code == 403) & F.coalesce(body, F.lit("")).contains("1010")
    return F.when(blocked, "blocked").when(code == 401, "key").when(code == 403, "access").when(code == 404, "base_url").otherwise("")


def is_site_title(title: Column, titles: tuple[str, ...], marks: tuple[str, ...]) -> Column:
    """Whether a title names the site (it is one of `titles` or holds one of `marks`) instead of the article."""
    low = F.lower(F.trim(F.coalesce(title, F.lit(""))))
    return low.isin(*titles) | has_any(title, marks)


def guard_of_error(code: Column, body: Column) -> Column:
    """Whether an HTTP error was a guard's, by what it says of the client: yes, possible or no."""
    return F.when((code == 403) & has_any(body, SIGNATURE_BANNED), "yes").when(code.isin(*GUARD_CODES) & has_any(body, GUARD), "possible").otherwise("no")


def guard_of_page(body: Column) -> Column:
    """The same of a reply that is no JSON: yes, possible, no (a page, so the address is wrong) or unknown."""
    return F.when(has_any(body, PAGE_BANNED), "yes").when(has_any(body, PAGE_GUARD), "possible").when(has_any(body, PAGE_HTML), "no").otherwise("unknown")


def _holds(c: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | F.contains(F.coalesce(c, F.lit("")), F.lit(word))
    return found


def asks_for_login(url: Column, visible: Column) -> Column:
    """Whether a page asks for a login, by its address or its words."""
    return F.contains(F.lower(F.coalesce(url, F.lit(""))), F.lit("login")) | _holds(visible, LOGIN_WORDS)


def is_logged_in(url: Column, visible: Column) -> Column:
    """Whether a page shows an account; one whose head offers login and registration does not."""
    offered = F.coalesce(visible, F.lit("")).rlike(r"(?:^|\s)登录\s+注册(?:\s|$)")
    return ~asks_for_login(url, visible) & ~offered & _holds(visible, ACCOUNT_WORDS)


def service_context(provider: Column, model: Column, base_url: Column) -> Column:
    """What a message says of the service: its address without query and fragment, secrets masked."""
    absolute = base_url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+")
    stem, path = F.regexp_extract(base_url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1), F.regexp_replace(F.regexp_extract(base_url, r"^[^:]+://[^/?#]*([^?#]*)", 1), "/+$", "")
    safe = F.when(absolute, F.concat(stem, F.when(path == "", "/").otherwise(path))).otherwise(base_url)
    return F.concat(F.lit("provider="), provider, F.lit(", model="), model, F.lit(", base_url="), text.redact(safe))


def completions_url(base_url: Column) -> Column:
    """The address of completions under a base address; one that is it already stays."""
    base = F.regexp_replace(base_url, "/+$", "")
    return F.when(F.endswith(base, F.lit("/chat/completions")), base).otherwise(F.concat(base, F.lit("/chat/completions")))


def summary_error(code: Column, body: Column, context: Column, hint: Column, seconds: int) -> Column:
    """The message of a failed summary: of an HTTP error (code), else a timeout (null body), else what the network said."""
    http = F.concat(F.lit("summary API HTTP "), code.cast("string"), F.lit(" ("), context, F.lit("): "), F.left(text.redact(body), F.lit(500)))
    http = F.when(hint == "", http).otherwise(F.concat(http, F.lit("; "), hint))
    return F.when(code.isNotNull(), http).when(body.isNull(), F.lit(f"summary API timeout after {seconds}s: timed out")).otherwise(text.redact(body))
