"""Text and number forms of time, all in UTC Unix seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapewatch.constants import DAY_SECONDS

# Accepted text layouts (one-digit months and days are fine, fractions are not).
ISO_SECONDS = (r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}$", "yyyy-M-d'T'H:m:s")
ISO_DATE = (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d")
SPACED = (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$", "yyyy-M-d H:m:s")
FULL_FORMATS = (ISO_SECONDS, ISO_DATE, SPACED)
SHORT_FORMATS = (ISO_SECONDS, ISO_DATE)
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
MIN_FLOAT_SECONDS = 1e8
MAX_SECONDS = 9e18


def parse_timestamp(col: Column, formats=FULL_FORMATS, numeric: bool = True) -> Column:
    """Text to Unix seconds: all digits, then a float above 1e8, then each layout, else 0.

    `formats=SHORT_FORMATS, numeric=False` is the reduced parser that knows two layouts only.
    """
    text = F.regexp_replace(F.trim(col.cast("string")), "Z+$", "")
    options = []
    if numeric:
        number = F.when(text.rlike(NUMBER), text.try_cast("double"))
        options.append(F.when(text.rlike(r"^\d+$"), text.try_cast("long")))
        options.append(F.when((number > MIN_FLOAT_SECONDS) & (number < MAX_SECONDS), number.cast("long")))
    for pattern, layout in formats:
        # The explicit offset keeps the result independent of the session time zone.
        instant = F.try_to_timestamp(F.concat(text, F.lit("+0000")), F.lit(layout + "xx"))
        options.append(F.when(text.rlike(pattern), F.unix_seconds(instant)))
    return F.coalesce(*options, F.lit(0).cast("long"))


def or_else(first: Column, second: Column) -> Column:
    """Zero means missing."""
    return F.coalesce(F.nullif(first, F.lit(0).cast("long")), second)


def utc_date(seconds: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / DAY_SECONDS).cast("int"))
