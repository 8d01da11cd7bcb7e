"""Dates: freshness, parsing, timelines, due times. The present is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwork.functions.text import extract, squeezed

FRESH_DAYS, AGING_DAYS = 7, 30
# How texts say that a scheme is open, for life or from one day to another.
LIFETIME = r"(?i)availability\s*:\s*lifetime|\blifetime\s+available\b|\bavailable\s+lifetime\b"
PERIOD = r"(?i)(?:scheme\s*period|validity|valid\s*(?:from|period)|available\s*from)\s*:?\s*(.+?)\s+(?:to|–|-|until|till)\s+(.+?)(?:\.|$|\n)"


def at(as_of: str) -> Column:
    return F.to_timestamp(F.lit(as_of))


def days_since(ts: Column, as_of: Column) -> Column:
    return (F.unix_micros(as_of) - F.unix_micros(ts.cast("timestamp"))) / F.lit(86_400_000_000.0)


def freshness(ts: Column, as_of: Column) -> Column:
    days = days_since(ts, as_of)
    return F.when(ts.isNull(), "Unknown").when(days <= FRESH_DAYS, "Fresh").when(days <= AGING_DAYS, "Aging").otherwise("Stale")


def or_epoch(ts: Column) -> Column:
    return F.coalesce(ts.cast("timestamp"), F.timestamp_seconds(F.lit(0)))


def parsed_date(raw: Column) -> Column:
    """`5 March 2024` or `5/3/2024` (day first); null for anything that is no date."""
    text = squeezed(raw)
    word = r"([0-9]{1,2})\s+([A-Za-z]+)\s+([0-9]{4})"
    slash = r"([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{4})"
    name = F.lower(F.regexp_extract(text, word, 2))
    names = F.array(*(F.lit(m) for m in "jan feb mar apr may jun jul aug sep oct nov dec".split()))
    full = F.array(*(F.lit(m) for m in "january february march april may june july august september october november december".split()))
    month = F.greatest(F.array_position(names, name), F.array_position(full, name), F.when(name == "sept", 9).otherwise(0))

    def made(y: Column, m: Column, d: Column) -> Column:
        return F.try_make_timestamp(y.try_cast("int"), m.try_cast("int"), d.try_cast("int"), F.lit(0), F.lit(0), F.lit(0))

    worded = made(F.regexp_extract(text, word, 3), month.cast("string"), F.regexp_extract(text, word, 1))
    slashed = made(F.regexp_extract(text, slash, 3), F.regexp_extract(text, slash, 2), F.regexp_extract(text, slash, 1))
    return F.when(text.rlike(word), worded).otherwise(slashed)


def iso(raw: Column) -> Column:
    return F.try_to_timestamp(F.nullif(raw, F.lit("")))


def said_timeline(lifetime: Column, period: Column, start: Column, end: Column) -> Column:
    """struct<availability_type, valid_from, valid_to> of what `LIFETIME` and `PERIOD` find; all null where nothing is said."""
    held = ~lifetime & (period != "")
    return F.struct(
        F.when(lifetime, "lifetime").when(held, "period").alias("availability_type"),
        F.when(held, parsed_date(start)).alias("valid_from"),
        F.when(held, parsed_date(end)).alias("valid_to"),
    )


def timeline(text: Column) -> Column:
    return said_timeline(text.rlike(LIFETIME), *(F.regexp_extract(text, PERIOD, i) for i in range(3)))


def timeline_label(kind: Column, start: Column, end: Column, hindi: Column | None = None) -> Column:
    """Available for life, from, until, from and to, or not known."""
    hindi = F.lit(False) if hindi is None else hindi
    a, z = (F.date_format(x.cast("timestamp"), "dd MMM yyyy") for x in (start, end))
    say = lambda en, hi: F.when(hindi, hi).otherwise(en)
    na = say(F.lit("NA"), F.lit("उपलब्ध नहीं"))
    return (
        F.when(kind == "lifetime", say(F.lit("Lifetime"), F.lit("आजीवन")))
        .when(a.isNull() & z.isNull(), na)
        .when(a.isNull(), say(F.concat(F.lit("Until "), z), F.concat(F.lit("तक "), z)))
        .when(z.isNull(), say(F.concat(F.lit("From "), a), F.concat(a, F.lit(" से"))))
        .otherwise(say(F.concat(a, F.lit(" to "), z), F.concat(a, F.lit(" से "), z)))
    )


def is_due(enabled: Column, status: Column, last_checked: Column, every_minutes: Column, as_of: Column) -> Column:
    """Enabled, not marked MANUAL/RESTRICTED, and never checked or not checked for its frequency (15 minutes if unset or zero)."""
    waited = (F.unix_micros(as_of) - F.unix_micros(last_checked.cast("timestamp"))) / F.lit(60_000_000.0)
    every = F.coalesce(F.nullif(every_minutes, F.lit(0)), F.lit(15))
    return F.coalesce(enabled, F.lit(False)) & (F.coalesce(status, F.lit("")) != "MANUAL/RESTRICTED") & (last_checked.isNull() | (waited >= every))


def is_stale_run(status: Column, started: Column, ended: Column, as_of: Column) -> Column:
    """Running for over 90 minutes or queued for over 30, and not ended."""
    waited = (F.unix_micros(as_of) - F.unix_micros(started.cast("timestamp"))) / F.lit(60_000_000.0)
    return ended.isNull() & (((status == "running") & (waited > 90)) | ((status == "queued") & (waited > 30)))
