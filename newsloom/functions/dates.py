"""Date functions: format ladders, relative times, display. Texts without an offset are Seoul time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions import fixed_values as fv
from newsloom.functions.text import is_blank, py_strip, replace_all

# Accepted layouts.
FULL_DATE = r"^(\d{4})[-.](\d{1,2})[-.](\d{1,2})[T ]+(\d{2}):(\d{2})(:\d{2}(?:\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?$"
SHORT_YEAR = r"^(\d{2})\.(\d{1,2})\.(\d{1,2}) (\d{1,2}):(\d{2})$"
ANY_DATE = r"\d{4}[-.]\d{1,2}[-.]\d{1,2}[T ]+\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?"
NO_YEAR = r"^(\d{1,2})/(\d{1,2}) (\d{1,2}):(\d{2})$"


def _full_date(text: Column) -> Column:
    """Instant of a text with date and time; the offset defaults to Seoul."""
    def part(group: int) -> Column:
        return F.regexp_extract(text, FULL_DATE, group)

    seconds = F.when(part(6) == "", F.lit(":00")).otherwise(part(6))
    zone = F.when(part(7) == "", F.lit(f" {fv.HOME_ZONE}")).otherwise(part(7))
    iso = F.concat(part(1), F.lit("-"), part(2), F.lit("-"), part(3), F.lit(" "), part(4), F.lit(":"), part(5), seconds)
    return F.when(text.rlike(FULL_DATE), F.concat(iso, zone).try_cast("timestamp"))


def _home_parts(year: Column, text: Column, pattern: str, first_group: int) -> Column:
    month, day, hour, minute = [F.regexp_extract(text, pattern, first_group + i) for i in range(4)]
    joined = F.concat(
        year.cast("string"), F.lit("-"), month, F.lit("-"), day, F.lit(" "), F.lpad(hour, 2, "0"), F.lit(":"), minute,
        F.lit(f":00 {fv.HOME_ZONE}"),
    )
    return F.when(text.rlike(pattern), joined.try_cast("timestamp"))


def parse_instant(text: Column) -> Column:
    """``2025-09-05 15:33``, dotted, with or without seconds, fraction and offset; null when none fits."""
    return _full_date(py_strip(text))


def parse_loose_instant(text: Column, as_of: Column) -> Column:
    """As ``parse_instant``, after dropping label words; also two-digit and missing years, and a date amid text."""
    bare = py_strip(replace_all(text, [(fv.DATE_LABEL_PATTERN, "")]))
    two_digits = F.regexp_extract(bare, SHORT_YEAR, 1).try_cast("int")
    short_year = F.when(two_digits < 69, two_digits + 2000).otherwise(two_digits + 1900)
    this_year = F.year(F.from_utc_timestamp(as_of, fv.HOME_ZONE))
    return F.coalesce(
        _full_date(bare),
        _home_parts(short_year, bare, SHORT_YEAR, 2),
        _home_parts(this_year, bare, NO_YEAR, 1),
        _full_date(F.regexp_extract(bare, ANY_DATE, 0)),
    )


def parse_relative(text: Column, as_of: Column) -> Column:
    """``26분 전``, ``2시간 전``, ``1일 전``, ``3주 전`` before ``as_of``; null for anything else."""
    def step(word: str, unit: str) -> Column:
        amount = F.regexp_extract(text, rf"(\d+){word}", 1).try_cast("int")
        interval = {
            "minute": lambda n: F.make_interval(mins=n),
            "hour": lambda n: F.make_interval(hours=n),
            "day": lambda n: F.make_interval(days=n),
            "week": lambda n: F.make_interval(weeks=n),
        }[unit](amount)
        return F.when(F.contains(text, F.lit(f"{word} 전")), as_of - interval)

    return F.coalesce(*[step(word, unit) for word, unit in fv.RELATIVE_UNITS])


def resolve_published(candidates: Column, as_of: Column) -> Column:
    """``struct(published_at, date_defaulted, updated_at)``: first candidate text that parses, else ``as_of``.

    ``candidates`` is an ``array<string>`` in order of trust. A text labelled as an update only, counts as the
    publication if no other parses.
    """
    parsed = F.filter(
        F.transform(
            candidates,
            lambda t: F.struct(
                F.coalesce(parse_relative(t, as_of), parse_loose_instant(t, as_of)).alias("at"),
                (t.rlike("|".join(fv.UPDATED_WORDS)) & ~t.rlike("|".join(fv.PUBLISHED_WORDS))).alias("update"),
            ),
        ),
        lambda x: x["at"].isNotNull(),
    )
    updated = F.get(F.filter(parsed, lambda x: x["update"]), F.lit(0))["at"]
    first = F.coalesce(F.get(F.filter(parsed, lambda x: ~x["update"]), F.lit(0))["at"], updated)
    return F.struct(
        F.coalesce(first, as_of).alias("published_at"),
        first.isNull().alias("date_defaulted"),
        updated.alias("updated_at"),
    )


def published_and_updated(texts: Column) -> Column:
    """``struct(published_at, updated_at)`` from labelled date texts; the first of each kind wins."""
    instant = r"(\d{4}-\d{2}-\d{2} \d{2}:\d{2}(?::\d{2})?)"

    def first_with(words: list[str], without: list[str] | None = None) -> Column:
        def labelled(t: Column) -> Column:
            hit = t.rlike("|".join(words)) & t.rlike(instant)
            return hit & ~t.rlike("|".join(without)) if without else hit

        return parse_instant(F.regexp_extract(F.get(F.filter(texts, labelled), F.lit(0)), instant, 1))

    return F.struct(
        first_with(fv.PUBLISHED_WORDS).alias("published_at"),
        first_with(fv.UPDATED_WORDS, without=fv.PUBLISHED_WORDS).alias("updated_at"),
    )


def home_time(instant: Column) -> Column:
    """Wall-clock Seoul time of an instant, as ISO text with its offset."""
    return F.concat(F.date_format(F.from_utc_timestamp(instant, fv.HOME_ZONE), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+09:00"))


def dotted_date(text: Column) -> Column:
    """Date found anywhere in a text as ``YYYY.MM.DD``."""
    ymd = r"(\d{4})\.(\d{2})\.(\d{2})"
    return F.regexp_replace(F.regexp_extract(text, ymd, 0), r"\.", "-").try_cast("date")


def dotted_instant(text: Column) -> Column:
    """Instant found anywhere in a text as ``YYYY.MM.DD HH:MM[:SS]``, Seoul time."""
    found = F.regexp_extract(text, r"\d{4}\.\d{2}\.\d{2}\s+\d{2}:\d{2}(?::\d{2})?", 0)
    return parse_instant(F.regexp_replace(found, r"\s+", " "))


def year_and_month_day(year: Column, month_day: Column) -> Column:
    """Date from a year text and a ``MM.DD`` text kept in two places of a card."""
    return F.concat(year, F.lit("-"), F.regexp_replace(month_day, r"\.", "-")).try_cast("date")


def display_date(text: Column) -> Column:
    """``2025년 09월 05일`` from ISO text; its first ten characters when they are no date."""
    head = F.substring(text, 1, 10)
    return F.when(is_blank(text), F.lit("")).otherwise(
        F.coalesce(F.date_format(F.try_to_date(head, "yyyy-MM-dd"), fv.CARD_DATE_FORMAT), head)
    )
