"""Lenient text parsers: anything unparsable becomes null, never an error.

Ages and durations come back unrounded: round them in a projection of their
own (see ``plans.cleaning.parse_columns``), so the text is parsed once.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: patterns and date formats ---
NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf(inity)?))\s*$"
WHOLE = r"^\s*[+-]?\d+(\.0*)?\s*$"
FIRST_NUMBER = r"[\d.]+"
MINUTES = r"(\d+)m"
SECONDS = r"(\d+)s"
EPOCH = r"^\d{9,11}$"
ISO_DATE = r"^\d{4}-\d{1,2}-\d{1,2}([T ].*)?$"
DATE_FORMATS = (
    "M/d/yyyy", "M/d/yy", "yyyyMMdd", "yyyy/M/d", "M-d-yyyy",
    "MMM d yyyy", "MMM d, yyyy", "MMMM d yyyy", "MMMM d, yyyy",
    "d MMM yyyy", "d MMMM yyyy", "d/M/yyyy", "d-M-yyyy",
)
#: Unicode's White_Space, what (?U)\s stands for.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
LAST_NANOSECOND_EPOCH = 9223372036  # seconds; later instants do not fit 64-bit nanoseconds


def strip(c: Column) -> Column:
    """Remove leading and trailing Unicode white space, without a regular expression per cell."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def lenient_double(c: Column) -> Column:
    """Text to double; only plain decimal or exponent notation and infinities count."""
    return F.when(c.rlike(NUMBER), c.try_cast("double"))


def lenient_long(c: Column) -> Column:
    """Text to bigint; text that is not a whole number becomes null."""
    d = lenient_double(c)
    digits = F.substring_index(c, ".", 1).try_cast("bigint")
    return F.when(c.rlike(WHOLE), digits).otherwise(
        F.when(F.rint(d) == d, d).try_cast("bigint")
    )


def parse_count(c: Column) -> Column:
    """'1,234,567' -> 1234567."""
    return lenient_long(F.replace(c, F.lit(","), F.lit("")))


def parse_currency(c: Column) -> Column:
    """'$1,234.50' -> 1234.5."""
    return lenient_double(F.regexp_replace(c, r"[$,]", ""))


def age_years(c: Column) -> Column:
    """'3 years' / '18 months' / '2.5 yrs' -> years, not yet rounded."""
    s = F.lower(c)
    number = F.regexp_substr(s, F.lit(FIRST_NUMBER)).try_cast("double")
    return F.when(s.contains("month"), number / F.lit(12.0)).otherwise(number)


def parse_rate(c: Column) -> Column:
    """'6/month' -> 6.0."""
    return F.regexp_substr(c, F.lit(FIRST_NUMBER)).try_cast("double")


def duration_minutes(c: Column) -> Column:
    """'14m 32s' -> 14.5333..; a plain number keeps its value; seconds alone -> null."""

    def part(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(c, pattern, 1), F.lit("")).try_cast("double")

    minutes, seconds = part(MINUTES), F.coalesce(part(SECONDS), F.lit(0.0))
    plain = lenient_double(F.regexp_replace(c, r"(?<=\d)_(?=\d)", ""))
    return F.coalesce(minutes + seconds / F.lit(60.0), plain)


def parse_views(c: Column) -> Column:
    """'45320.0' -> 45320, halves to the even neighbour."""
    return F.rint(lenient_double(c)).try_cast("bigint")


def parse_date(c: Column) -> Column:
    """Epoch seconds, ISO, month-first slashed and written-out dates -> date (UTC)."""
    seconds = F.when(c.rlike(EPOCH), c.try_cast("bigint"))
    days = F.floor(seconds / F.lit(86400)).cast("int")  # UTC whatever the session's time zone
    epoch = F.when(
        seconds <= LAST_NANOSECOND_EPOCH, F.date_add(F.lit("1970-01-01").cast("date"), days)
    )
    local_day = F.regexp_substr(c, F.lit(r"^\d{4}-\d{1,2}-\d{1,2}"))
    iso = F.when(
        c.rlike(ISO_DATE) & F.try_to_timestamp(c).isNotNull(), local_day.try_cast("date")
    )
    other = [F.try_to_timestamp(c, F.lit(f)).cast("date") for f in DATE_FORMATS]
    return F.when(c.rlike(EPOCH), epoch).otherwise(F.coalesce(iso, *other))
