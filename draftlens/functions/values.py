"""Identity, JSON, time and number columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(text: Column) -> Column:
    """JSON with sorted keys and no spaces; NULL when it does not parse."""
    return F.to_json(F.try_parse_json(text))


def content_hash(text: Column) -> Column:
    """md5 of the canonical JSON."""
    return F.md5(canonical_json(text))


def json_text(variant: Column, path: str) -> Column:
    """One field of a variant as text."""
    return F.try_variant_get(variant, path, "string")


def uuid_norm(text: Column) -> Column:
    """A UUID as 32 lower-case hex digits, with or without dashes."""
    return F.lower(F.replace(text, F.lit("-"), F.lit("")))


def eq_all(where: dict[str, object]) -> Column:
    """AND of equalities; None means IS NULL."""
    return reduce(
        lambda acc, item: acc & F.col(item[0]).eqNullSafe(F.lit(item[1])), where.items(), F.lit(True)
    )


# Fixed value: the export's own date format, matched from the start of the text.
EXPORT_DATETIME = r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}(?= UTC)"


def parse_datetime(text: Column) -> Column:
    """``Y-M-D h:m:s UTC`` (anything may follow), else an ISO time. Session zone UTC."""
    exported = F.regexp_extract(text, EXPORT_DATETIME, 0)
    return F.coalesce(
        F.try_to_timestamp(F.nullif(exported, F.lit("")), F.lit("y-M-d H:m:s")),
        F.try_to_timestamp(text),
    )


def parse_exported_at(text: Column) -> Column:
    """Export time with the first ``T`` read as a space."""
    return F.try_to_timestamp(F.concat(F.substring_index(text, "T", 1), F.when(
        F.contains(text, F.lit("T")), F.concat(F.lit(" "), F.substr(text, F.position(F.lit("T"), text) + 1))
    ).otherwise(F.lit(""))))


def iso_text(ts: Column) -> Column:
    """A timestamp as text with a space between date and time."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def month_floor(ts: Column) -> Column:
    return F.date_trunc("month", ts)


def round_avg_int(value: Column, digits: int = 2) -> Column:
    """Average of integers, rounded half away from zero from exact sums."""
    exact = F.sum(value).cast("decimal(20,0)") / F.count(value).cast("decimal(18,0)")
    return F.round(exact, digits).cast("double")


def stddev_int(value: Column, digits: int = 2) -> Column:
    """Sample standard deviation of integers from exact sums; NULL below two."""
    n = F.count(value).cast("decimal(18,0)")
    sx = F.sum(value).cast("decimal(19,0)")
    sxx = F.sum(value * value).cast("decimal(19,0)")
    spread = (n * sxx - sx * sx).cast("double")
    pairs = (n * (n - 1)).cast("double")
    return F.round(F.sqrt(F.try_divide(spread, pairs)), digits)
