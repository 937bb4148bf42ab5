"""Text expressions: Column -> Column, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as Unicode has it; Java's \s alone is ASCII.
SPACE = r"[\s\p{Z}\x1c-\x1f\x85]"
#: The same as characters.
SPACES = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
LINE_BREAK = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85  ]"

# Device names that are no file names, and interface words that are no prose.
RESERVED_NAMES = ("CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10)))
NOISE_WORDS = ("登录", "扫码", "下载App", "相关推荐", "加入学习")
TITLE_BREAK = rf"(?:{SPACE}|[·\-—：:，,。？！!?｜|《》【】（）()])+"

# What marks a secret, in the order of replacement; the first group stays.
SECRETS = (
    r"(?i)(Bearer\s+)[A-Za-z0-9._\-]+",
    r"(?i)(authorization\s*[:=]\s*)(?!Bearer\s+)[^\r\n,]+",
    r"(?i)((?:set-)?cookie\s*[:=]\s*)[^\r\n]+",
    r"""(?i)(access[_-]?token['"]?\s*[:=]\s*['"]?)[^'"\s,]+""",
    r"""(?i)(api[_-]?key['"]?\s*[:=]\s*['"]?)[^'"\s,]+""",
    r"""(?i)(session(?:[_-]?id)?['"]?\s*[:=]\s*['"]?)[^'"\s,;]+""",
    r"""(?i)(secret['"]?\s*[:=]\s*['"]?)[^'"\s,]+""",
)


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(SPACES))


def squash(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return strip(F.regexp_replace(c, f"{SPACE}+", " "))


def paragraphs(c: Column) -> Column:
    """The lines of a text, squashed, without blank ones, as an array."""
    return F.filter(F.transform(F.split(c, LINE_BREAK), squash), lambda x: x != "")


def normalize(c: Column) -> Column:
    return F.array_join(paragraphs(c), "\n\n")


def visible(c: Column) -> Column:
    """Spaces and tabs collapsed, none around line feeds, at most one blank line."""
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t\r\f\x0b]+", " "), r" *\n *", "\n")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def clean_title(c: Column, brands: tuple[str, ...] = ()) -> Column:
    """Squashed, and cut before the first dash, underscore or bar (and a brand after it)."""
    brand = f"(?:{'|'.join(brands)})?" if brands else ""
    return strip(F.element_at(F.split(squash(c), rf"{SPACE}*[-_|]{SPACE}*{brand}", 2), 1))


def title_terms(c: Column) -> Column:
    """Up to four terms of two characters or more."""
    return F.slice(F.filter(F.split(c, TITLE_BREAK), lambda x: F.length(x) >= 2), 1, 4)


def occurrences(c: Column, words: tuple[str, ...]) -> Column:
    """How often the words occur, each without overlap."""
    counts = [((F.length(c) - F.length(F.replace(c, F.lit(w), F.lit("")))) / len(w)).cast("long") for w in words]
    return sum(counts[1:], counts[0]) if counts else F.lit(0).cast("long")


def redact(c: Column, hooks: tuple[str, ...] = ()) -> Column:
    """Secrets replaced by [REDACTED]; hooks: address prefixes whose last part is a secret."""
    for pattern in SECRETS:
        c = F.regexp_replace(c, pattern, "$1[REDACTED]")
    for hook in hooks:
        c = F.regexp_replace(c, rf"(?i)(\Q{hook}\E)[A-Za-z0-9._\-]+", "$1[REDACTED]")
    return c


def file_name(c: Column, longest: int = 80) -> Column:
    """A text as part of a file name."""
    ends = lambda x: F.regexp_replace(x, r"^[ .]+|[ .]+$", "")
    c = ends(F.regexp_replace(F.regexp_replace(c, r'[<>:"/\\|?*\x00-\x1f]', " "), f"{SPACE}+", " "))
    c = F.when(c == "", "untitled").otherwise(c)
    c = F.when(F.upper(c).isin(*RESERVED_NAMES), F.concat(F.lit("_"), c)).otherwise(c)
    return F.when(F.length(c) > longest, F.regexp_replace(F.left(c, F.lit(longest)), r"[ .]+$", "")).otherwise(c)


def single_line(c: Column) -> Column:
    return squash(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x1f]+", " "))


def yaml_scalar(c: Column) -> Column:
    """A double-quoted scalar; control characters as escapes."""
    c = F.coalesce(c.cast("string"), F.lit(""))
    for plain, shown in (("\\", "\\\\"), ('"', '\\"'), ("\b", "\\b"), ("\f", "\\f"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(plain), F.lit(shown))
    for code in range(0x20):
        if code not in (8, 9, 10, 12, 13):
            c = F.replace(c, F.lit(chr(code)), F.lit(f"\\x{code:02x}"))
    return F.concat(F.lit('"'), c, F.lit('"'))


def preview(c: Column, n: int) -> Column:
    c = squash(c)
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("..."))).otherwise(c)


def slug(c: Column, default: str = "page") -> Column:
    c = F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "_"), "^_+|_+$", "")
    return F.when(c == "", default).otherwise(c)


def first_filled(*cs: Column) -> Column:
    """The first that is neither null nor empty, else empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in cs), F.lit(""))


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def identity_hash(note: Column) -> Column:
    """Hash of a note but for its time of writing."""
    return content_hash(F.regexp_replace(note, r'(?m)^sync_time: ".*"$', 'sync_time: "<ignored>"'))


def publish_date(c: Column, zone: str = "Asia/Shanghai") -> Column:
    """Epoch seconds as a local date; zero, negative and empty as null; other text as it is."""
    number = c.try_cast("double")
    seconds = F.floor(number)
    day = F.date_format(F.from_utc_timestamp(F.timestamp_seconds(seconds), zone), "yyyy-MM-dd")
    return F.when(number.isNull(), F.nullif(strip(c), F.lit(""))).when((seconds > 0) & (seconds < 253402300800), day)


def year_of(published: Column) -> Column:
    """The year of a valid leading date, else null."""
    day = F.left(published, F.lit(10))
    return F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.year(F.try_to_date(day, "yyyy-MM-dd")).cast("string"))


def truncated_note(note: Column, transcript: Column, limit: int = 20000, notice: str = "注：本文摘要基于截断原文生成。", mark: str = "截断原文") -> Column:
    """A summary's note, with a notice if the text that it was made of was cut."""
    note = strip(F.coalesce(note, F.lit("")))
    added = F.when(note == "", F.lit(notice)).otherwise(F.concat(note, F.lit("\n\n" + notice)))
    return F.when((F.length(transcript) > limit) & ~F.contains(note, F.lit(mark)), added).otherwise(note)


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with a column that later columns read often. As a column of its own, not as a part of
    their expressions, it is worked out once: projections are not merged where that would repeat it.
    """
    return rows.withColumn(name, value)
