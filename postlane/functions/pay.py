"""Pay and salary text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlane import settings
from postlane.functions.text import WHITESPACE, bind, or_blank, strip

# Plain decimal notation, padded or not. Spark's cast also accepts suffixes such as
# `12d`, which are not numbers here, so only this much of a text is cast.
NUMBER_PATTERN = (
    rf"^[{WHITESPACE}]*([+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)[{WHITESPACE}]*$"
)


def to_number(c: Column) -> Column:
    """Text to DOUBLE; NULL for text that is not a number."""
    return F.regexp_extract(c.cast("string"), NUMBER_PATTERN, 1).try_cast("double")


def _bound(c: Column) -> Column:
    """A missing or blank bound counts as 0; a non-number stays NULL."""
    text = or_blank(c.cast("string"))
    return F.when(text == "", F.lit(0.0)).otherwise(to_number(text))


def _range_text(low: Column, high: Column, money) -> Column:
    """The positive bounds joined by a dash, one figure if they are equal.

    Blank if there is none, or if either bound is not a number.
    """

    def shown(b):
        first = F.when((b["low"] > 0) & b["high"].isNotNull(), money(b["low"]))
        second = F.when((b["high"] > 0) & (b["low"] != b["high"]), money(b["high"]))
        return F.concat_ws("-", first, second)

    return bind(F.struct(_bound(low).alias("low"), _bound(high).alias("high")), shown)


def _dollars(v: Column, places: int) -> Column:
    return F.concat(F.lit("$"), F.format_number(v, places))


def salary_range_text(low: Column, high: Column) -> Column:
    """``$60,000-$80,000``; one figure if one-sided or equal; blank if there is none."""
    return _range_text(low, high, lambda v: _dollars(v, 0))


def pay_text(low: Column, high: Column, kind: Column) -> Column:
    """``$23.95-$28.00/hr``: cents for hourly pay, whole dollars for yearly and monthly."""
    kind = F.lower(strip(or_blank(kind)))
    unit = F.lit("")
    for name, suffix in settings.PAY_UNITS.items():
        unit = F.when(kind == name, F.lit(suffix)).otherwise(unit)
    whole = kind.isin(settings.WHOLE_DOLLAR_PAY)
    amount = _range_text(low, high, lambda v: F.when(whole, _dollars(v, 0)).otherwise(_dollars(v, 2)))
    return bind(amount, lambda a: F.when(a == "", a).otherwise(F.concat(a, unit)))


def with_estimate(salary: Column, predicted: Column) -> Column:
    """Mark pay that the feed itself estimated."""
    estimated = F.coalesce(to_number(predicted), F.lit(0.0)) != 0
    return F.when(
        (salary != "") & estimated, F.concat(salary, F.lit(settings.ESTIMATED_SUFFIX))
    ).otherwise(salary)


def salary_value(c: Column) -> Column:
    """The largest figure in a salary text, 0 if there is none."""
    figures = F.regexp_extract_all(
        F.translate(or_blank(c), ",", ""), F.lit(r"([0-9]+(?:\.[0-9]+)?|\.[0-9]+)"), 1
    )
    return F.coalesce(
        F.array_max(F.transform(figures, lambda x: x.try_cast("double"))), F.lit(0.0)
    )
