"""Small field rules: places, dates, scores, bands, fetch errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlane import settings
from postlane.functions.pay import to_number
from postlane.functions.text import first_nonempty, or_blank, strip

MS_PER_DAY = 86_400_000
# First and last instant of the years 1 to 9999, in epoch milliseconds.
FIRST_MS, LAST_MS = -62_135_596_800_000, 253_402_300_799_999


def place_text(area: Column, region: Column) -> Column:
    """``area, region``, collapsed when they are the same place."""
    area, region = strip(or_blank(area)), strip(or_blank(region))
    own = F.when((area != "") & (F.lower(area) != F.lower(region)), area)
    place = F.concat_ws(", ", own, first_nonempty(region))
    return F.coalesce(first_nonempty(place), F.lit(settings.SJS_DEFAULT_LOCATION))


def epoch_ms_to_date(c: Column) -> Column:
    """Epoch milliseconds to a UTC ``yyyy-MM-dd``; other text passes through."""
    text = or_blank(c.cast("string"))
    millis = F.when(strip(text).rlike("^[+-]?[0-9]+$"), strip(text).try_cast("bigint"))
    days = F.floor(millis / F.lit(MS_PER_DAY)).cast("int")
    in_range = millis.between(FIRST_MS, LAST_MS)
    # Counting days from the epoch keeps the session time zone out of it.
    date = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), days), "yyyy-MM-dd")
    return F.when(in_range, date).otherwise(text)


def score_cast(c: Column) -> Column:
    """Score text to DOUBLE, NULL if it is not a number."""
    return to_number(c)


def score_band(score: Column) -> Column:
    score = F.coalesce(score, F.lit(0.0))
    return (
        F.when(score >= settings.BAND_HIGH, F.lit("high"))
        .when(score >= settings.BAND_MID, F.lit("mid"))
        .otherwise(F.lit("low"))
    )


def verdict_class(verdict: Column) -> Column:
    return F.when(verdict.isin(settings.VERDICTS), verdict).otherwise(F.lit("other"))


def is_fresh(posted: Column, today: Column) -> Column:
    """Posted within the freshness horizon of ``today`` (both dates)."""
    return F.coalesce(F.datediff(today, posted) <= settings.FRESH_DAYS, F.lit(False))


def http_status(message: Column, code: Column) -> Column:
    """Status code of a failed fetch; without one, the first 40x/42x named in its message.

    A code that is no number gives NULL: the message is not asked then.
    """
    named = F.regexp_extract(or_blank(message), r"\b(40[0-9]|42[0-9])\b", 1)
    return F.when(code.isNotNull(), code.try_cast("int")).otherwise(F.nullif(named, F.lit("")).try_cast("int"))


def retry_after(c: Column) -> Column:
    """Seconds to wait: clamped to the allowed range, the default if unreadable."""
    seconds = to_number(c)
    clamped = F.greatest(F.lit(0.0), F.least(seconds, F.lit(float(settings.RETRY_AFTER_MAX))))
    return F.when(seconds.isNotNull(), clamped).otherwise(float(settings.RETRY_AFTER_DEFAULT))
