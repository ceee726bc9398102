"""Scalar expressions the engine's plans share; all stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "unknown"


def group_key(dimension: Column | None) -> Column:
    """A group's key: text, ``unknown`` for null, ``all`` without a dimension."""
    return F.lit("all") if dimension is None else F.coalesce(dimension.cast("string"), F.lit(UNKNOWN))


def metric_value(metric: Column | None, null_as_zero: bool = True) -> Column:
    """A row's value; an unknown one counts as zero unless told otherwise."""
    value = F.lit(1.0) if metric is None else metric.cast("double")
    return F.coalesce(value, F.lit(0.0)) if null_as_zero else value


def day(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def week(ts: Column) -> Column:
    """Year and Monday-first week number, week 00 before the year's first Monday."""
    number = F.floor((F.dayofyear(ts) + 6 - F.weekday(ts)) / 7).cast("string")
    return F.concat(F.date_format(ts, "yyyy"), F.lit("-W"), F.lpad(number, 2, "0"))


def hour(ts: Column) -> Column:
    return F.date_format(ts, "HH")


def share(count: Column, total: Column) -> Column:
    return F.when(total > 0, count / total).otherwise(F.lit(0.0))


def humanise(key: Column, labels: dict[str, str] | None = None) -> Column:
    """A readable key: fixed labels, dates as they are, else separators to blanks and a capital first letter."""
    blanks = F.regexp_replace(key, "[_-]", " ")
    plain = F.concat(F.upper(F.substring(blanks, 1, 1)), F.lower(F.substring(blanks, 2, 2**31 - 1)))
    out = F.when(key.rlike(r"^\d{4}-(\d{2}-\d{2}|W\d{2})$"), key).otherwise(plain)
    for raw, shown in reversed((labels or {}).items()):
        out = F.when(key == raw, F.lit(shown)).otherwise(out)
    return out


def number_text(value: Column) -> Column:
    """Six significant digits without trailing zeros, scientific beyond 1e6 and below 1e-4 (as ``%g``)."""
    size = F.abs(value)
    exponent = F.when(size == 0, F.lit(0)).otherwise(F.floor(F.log10(size)).cast("int"))
    places = F.greatest(F.lit(0), 5 - exponent)
    fixed = F.regexp_replace(F.format_string("%.10f", F.round(value * F.pow(F.lit(10.0), places)) / F.pow(F.lit(10.0), places)), r"\.?0+$", "")
    scientific = F.regexp_replace(F.format_string("%.5e", value), r"\.?0+e", "e")
    return F.when(value.isNull(), F.lit(None)).when((size != 0) & ((exponent >= 6) | (exponent < -4)), scientific).otherwise(fixed)


def aspect_key(value_json: Column) -> Column:
    """Group key of a judged JSON scalar: yes/no, unknown for null, short numbers, else trimmed text."""
    raw = F.trim(value_json)
    text = F.trim(F.get_json_object(F.concat(F.lit('{"v":'), raw, F.lit("}")), "$.v"))
    return (
        F.when(raw.isNull() | (raw == "null") | (raw == ""), F.lit(UNKNOWN))
        .when(raw == "true", F.lit("yes"))
        .when(raw == "false", F.lit("no"))
        .when(raw.rlike(r"^-?[0-9]"), number_text(raw.try_cast("double")))
        .otherwise(F.when(F.coalesce(text, F.lit("")) == "", F.lit(UNKNOWN)).otherwise(text))
    )


def aspect_value(value_json: Column) -> Column:
    """Metric value of a judged JSON scalar: the number itself, else 1."""
    return F.when(F.trim(value_json).rlike(r"^-?[0-9]"), F.coalesce(F.trim(value_json).try_cast("double"), F.lit(1.0))).otherwise(F.lit(1.0))


def shown_value(value: Column, unit: str, largest: Column) -> Column:
    """Display text; a dollar amount's places follow the largest value beside it."""
    if unit == "usd":
        return F.when(largest >= 1, F.format_string("$%,.2f", value)).when(largest >= 0.1, F.format_string("$%,.3f", value)).otherwise(F.format_string("$%,.4f", value))
    if unit == "ms":
        return F.format_string("%.1fs", value / 1000)
    if unit == "tokens":
        return F.format_string("%,d tokens", F.round(value).cast("long"))
    if unit == "count":
        return F.format_string("%,d", F.round(value).cast("long"))
    return F.regexp_replace(F.format_string("%,.2f", value), r"\.?0+$", "")


def contains_any(columns: list[Column], text: str) -> Column:
    """Case-insensitive substring of any column; wildcards in ``text`` are plain characters."""
    escaped = text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(c.ilike(f"%{escaped}%"), F.lit(False))
    return out


def plain_words(name: str) -> str:
    """A name with underscores as words, the first in upper case."""
    return name.replace("_", " ").strip().capitalize()
