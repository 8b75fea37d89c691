"""Column-level helpers. All are built from
``pyspark.sql.functions`` so they stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def line_count(text: Column) -> Column:
    """``len(s.split('\\n'))`` — pieces of a split on newline (empty text is
    1), counted as newlines plus one without building the pieces."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def key_label(key: Column) -> Column:
    """F2: ``metric_name`` -> ``Metric Name`` (underscores to spaces, title case)."""
    return F.initcap(F.regexp_replace(key, "_", " "))


def strip_event_prefix(key: Column) -> Column:
    """drop a leading ``event_``."""
    return F.regexp_replace(key, "^event_", "")


def short_id(col: Column, n: int = 8) -> Column:
    """first ``n`` characters of an id."""
    return F.substring(col.cast("string"), 1, n)


def iso_text(ts: Column) -> Column:
    """ISO-8601 text of a timestamp (microseconds kept)."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def short_date(ts: Column) -> Column:
    """``%m/%d %H:%M``."""
    return F.date_format(ts, "MM/dd HH:mm")


def file_name(path: Column) -> Column:
    """F8: last path component."""
    return F.regexp_extract(path, r"([^/\\]+)$", 1)


def file_stem(path: Column) -> Column:
    """F8: last path component without its extension."""
    return F.regexp_extract(path, r"([^/\\]+?)(\.[^./\\]*)?$", 1)


def clamp(x: Column, lo, hi) -> Column:
    """``min(hi, max(lo, x))``."""
    return F.least(F.lit(hi) if not isinstance(hi, Column) else hi,
                   F.greatest(F.lit(lo) if not isinstance(lo, Column) else lo, x))


def seconds_between(start: Column, end: Column) -> Column:
    """``end - start`` in seconds (float, as the reference compares
    them), from an exact microsecond difference. Timestamps without a zone
    are differenced as wall-clock values, so the session time zone (and its
    daylight-saving changes) never enters."""
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1e6)


def to_json_text(*cols) -> Column:
    """JSON text of the given columns."""
    return F.to_json(F.struct(*cols))


def get_or(m: Column, key, default) -> Column:
    """map lookup with a default."""
    return F.coalesce(F.try_element_at(m, F.lit(key)), F.lit(default))


def ratio(num: Column, den: Column) -> Column:
    """``num / den``, null when ``den`` is 0."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def fixed1(x: Column) -> Column:
    """one decimal place as text (display only), halves to the even digit
    as Python prints them."""
    return F.format_string("%.1f", F.bround(x.cast("double"), 1))


def complexity_band(c: Column) -> Column:
    """<5 green, <8 yellow, else red."""
    return F.when(c < 5, "green").when(c < 8, "yellow").otherwise("red")


def quality_band(score: Column) -> Column:
    """P5: >=7 success else warning."""
    return F.when(score >= 7, "success").otherwise("warning")


def issues_band(n: Column) -> Column:
    """P5: 0 issues success, else danger."""
    return F.when(n == 0, "success").otherwise("danger")


def stars(score: Column) -> Column:
    """``min(int(score), 10)`` stars, none when negative (int truncates)."""
    return F.repeat(F.lit("*"), F.greatest(F.lit(0), F.least(score.cast("int"), F.lit(10))))


def complexity_alert(c: Column) -> Column:
    """Warning >= 10, critical >= 20 (inclusive, our choice)."""
    return F.when(c >= 20, "critical").when(c >= 10, "warning").otherwise("ok")


def top_numbered(arr: Column, k: int = 3) -> Column:
    """First ``k`` items numbered from 1 as ``"1. item"``."""
    return F.transform(F.slice(arr, 1, k),
                       lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))


def or_na(x: Column) -> Column:
    """Missing value shown as ``N/A``."""
    return F.coalesce(x.cast("string"), F.lit("N/A"))


# F16: our extension -> label map of the ten supported languages.
LANGUAGES = {
    "py": "Python", "js": "JavaScript", "ts": "TypeScript", "java": "Java",
    "cpp": "C++", "cc": "C++", "hpp": "C++", "cs": "C#", "go": "Go", "rs": "Rust",
    "rb": "Ruby", "php": "PHP",
}


def language_of(path: Column) -> Column:
    """F16: language label from a file extension, null when unknown."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9+]+)$", 1))
    m = F.create_map(*[x for k, v in LANGUAGES.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(m, ext)
