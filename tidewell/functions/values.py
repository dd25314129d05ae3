"""Typed-value expressions: numbers, dates, phones, e-mails, name hints."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell import fixed
from tidewell.functions.text import trim_all


def name_words(column: str) -> set[str]:
    """Lower-case words of a column name, camel case included."""
    return set(re.findall("[a-z]+", re.sub("([a-z])([A-Z])", r"\1 \2", column).lower()))


def number_text(c: Column) -> Column:
    """The text without currency mark and spaces."""
    t = trim_all(F.regexp_replace(c, r"\x{A0}", " "))
    return F.replace(F.regexp_replace(t, fixed.CURRENCY_MARK, ""), F.lit(" "), F.lit(""))


def number_digits(c: Column) -> Column:
    """Digits with a point as the only separator, or null when the text is no number."""
    t = number_text(c)
    return (
        F.when(t.rlike(fixed.PLAIN_NUMBER), t)
        .when(t.rlike(fixed.THOUSANDS_NUMBER), F.replace(t, F.lit(","), F.lit("")))
        .when(t.rlike(fixed.DECIMAL_COMMA), F.replace(t, F.lit(","), F.lit(".")))
    )


def parse_number(c: Column) -> Column:
    return number_digits(c).try_cast("double")


def number_is_plain(c: Column) -> Column:
    t = number_text(c)
    return t.rlike(fixed.PLAIN_NUMBER) & (t == trim_all(c))


def number_bounds(column: str) -> tuple[float | None, float | None]:
    words = name_words(column)
    if "age" in words:
        return 1.0, 120.0
    if words & fixed.MONEY_WORDS:
        return 0.0, None
    return None, None


def _part(c: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(c, pattern, group).try_cast("int")


def _moment(y: Column, m: Column, d: Column, h=None, mi=None, s=None) -> Column:
    zero = F.lit(0)
    ts = F.try_make_timestamp_ntz(
        y, m, d, F.coalesce(h, zero) if h is not None else zero,
        F.coalesce(mi, zero) if mi is not None else zero,
        (F.coalesce(s, zero) if s is not None else zero).cast("decimal(16,6)"),
    )
    return F.when(y.between(1900, 2100), ts)


_CLOCK = r"^(\d{4})-(\d{2})-(\d{2})[ T](\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,]\d+)?)?)?(?:[+-]\d{2}(?::?\d{2}){0,2})?$"
_MONTH_DAY = r"^([A-Za-z]+) +(\d{1,2}),? +(\d{4})$"
_DAY_MONTH = r"^(\d{1,2}) +([A-Za-z]+),? +(\d{4})$"
_DAY_MON_DASH = r"^(\d{1,2})-([A-Za-z]{3})-(\d{4})$"


def _month_number(name: Column) -> Column:
    low = F.lower(name)
    full = F.array(*[F.lit(m) for m in fixed.MONTHS])
    short = F.array(*[F.lit(m[:3]) for m in fixed.MONTHS])
    return F.nullif(F.greatest(F.array_position(full, low), F.array_position(short, low)).cast("int"), F.lit(0))


def parse_date(c: Column, day_first) -> Column:
    """Date or date-time as a time-zone-free timestamp, or null when unreadable."""
    day_first = F.lit(day_first) if isinstance(day_first, bool) else day_first
    a, b, year = (_part(c, fixed.DMY, g) for g in (1, 2, 3))
    as_day, as_month = _moment(year, b, a), _moment(year, a, b)
    clock = F.replace(c, F.lit("Z"), F.lit(""))
    text_month = F.when(c.rlike(_MONTH_DAY), F.regexp_extract(c, _MONTH_DAY, 1)).when(
        c.rlike(_DAY_MONTH), F.regexp_extract(c, _DAY_MONTH, 2)
    )
    text_day = F.when(c.rlike(_MONTH_DAY), _part(c, _MONTH_DAY, 2)).when(c.rlike(_DAY_MONTH), _part(c, _DAY_MONTH, 1))
    text_year = F.when(c.rlike(_MONTH_DAY), _part(c, _MONTH_DAY, 3)).when(c.rlike(_DAY_MONTH), _part(c, _DAY_MONTH, 3))
    return (
        F.when(c.rlike(fixed.YMD), _moment(*(_part(c, fixed.YMD, g) for g in (1, 2, 3))))
        .when(
            c.rlike(fixed.DMY),
            F.when(day_first, F.coalesce(as_day, as_month)).otherwise(F.coalesce(as_month, as_day)),
        )
        .when(clock.rlike(_CLOCK), _moment(*(_part(clock, _CLOCK, g) for g in range(1, 7))))
        .when(
            c.rlike(_DAY_MON_DASH),
            _moment(_part(c, _DAY_MON_DASH, 3), _month_number(F.regexp_extract(c, _DAY_MON_DASH, 2)),
                    _part(c, _DAY_MON_DASH, 1)),
        )
        .otherwise(_moment(text_year, _month_number(text_month), text_day))
    )


def utc_moment(seconds: Column) -> Column:
    """Time-zone-free UTC time of seconds since 1970, whatever the session's time zone."""
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def date_order(c: Column) -> Column:
    """'day', 'month' or 'either' for a text such as 07/08/2025; null when it says nothing."""
    a, b = _part(c, fixed.DMY, 1), _part(c, fixed.DMY, 2)
    return F.when(
        c.rlike(fixed.DMY),
        F.when(a > 12, "day").when(b > 12, "month").when(a != b, "either"),
    )


def clean_phone(c: Column, country: str = fixed.DEFAULT_COUNTRY_CODE) -> Column:
    """International form of a phone number, or null."""
    raw = F.regexp_replace(c, r"[^\d+]", "")
    digits = F.when(raw.startswith("00"), F.concat(F.lit("+"), F.substring(raw, 3, 1 << 30))).otherwise(raw)
    bare = F.regexp_replace(digits, r"^\++", "")
    national = len(country) + 9
    plus = F.concat(F.lit("+"), bare)
    return (
        F.when((bare == "") | bare.rlike(r"^(.)\1*$"), None)
        .when(digits.startswith("+" + country) & (F.length(bare) == national), plus)
        .when(bare.startswith(country) & (F.length(bare) == national) & ~digits.startswith("+"), plus)
        .when(digits.startswith("0") & (F.length(digits) == 10),
              F.concat(F.lit("+" + country), F.substring(digits, 2, 1 << 30)))
        .when(digits.startswith("+") & F.length(bare).between(8, 15), plus)
    )


def clean_email(c: Column) -> Column:
    low = F.lower(c)
    return F.when(low.rlike(fixed.EMAIL_VALID) & ~low.isin(fixed.PLACEHOLDER_EMAILS), low)


def alias(c: Column, table: dict[str, str]) -> Column:
    """Look a key up in a small fixed table; null when absent."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), c)


def gender_alias(c: Column) -> Column:
    return F.coalesce(alias(F.lower(c), fixed.GENDERS), c)


def province_alias(c: Column) -> Column:
    return F.coalesce(alias(F.regexp_replace(F.lower(c), "[^a-z]", ""), fixed.PROVINCES), c)
