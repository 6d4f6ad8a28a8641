"""Text and numbers to timestamps, and durations to text (UTC throughout)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .casts import Cast

UNREADABLE = "not a time"
TOO_FAR = "time out of range"

# Accepted layouts, grouped by shape. Fixed values.
ISO_T = r"^\d{4}-\d{2}-\d{2}T\d{1,2}:\d{2}:\d{2}([.,]\d+)?(Z|[+-]\d{2}:\d{2})?\z"
ISO_BLANK = r"^\d{4}-\d{2}-\d{2} \d{1,2}:\d{2}:\d{2}([.,]\d+)?\z"
ISO_DATE = r"^\d{4}-\d{2}-\d{2}\z"
CJK = r"^(\d{4})年(\d{2})月(\d{2})日 ?(\d{1,2})时(\d{2})分(\d{2}(?:[.,]\d+)?)秒\z"
ZONE_NAME = r"(?:UTC|GMT[+-]\d{1,2}|[A-Z]{3}|[A-Z]{3,4}T|WITA|ChST|MeST)"
RFC822 = r"^\d{2} [A-Za-z]{3} \d{2} \d{1,2}:\d{2} " + ZONE_NAME + r"\z"
RFC850 = (
    r"^(?i:Sunday|Monday|Tuesday|Wednesday|Thursday|Friday|Saturday), "
    r"\d{2}-[A-Za-z]{3}-\d{2} \d{1,2}:\d{2}:\d{2}(?:[.,]\d{1,9})?" + " " + ZONE_NAME + r"\z"
)

MILLIS_ABOVE = 10**12
# what a timestamp in microseconds can hold
MOST_SECONDS, MOST_MILLIS = 9223372036853, 9223372036854775


def _stamp(text: Column) -> Column:
    # a comma may stand before the fraction; Spark cuts the fraction to microseconds
    return F.translate(text, ",", ".").try_cast("timestamp")


def _named_month(body: Column, pattern: str, zone: Column) -> Column:
    """Day, month name, two-digit year and clock to a timestamp.

    Years 69 to 99 are of the last century. A zone name carries no offset of its
    own and is read as UTC, except ``GMT+h``.
    """
    base = F.try_to_timestamp(F.translate(body, ",", "."), F.lit(pattern))
    base = F.when(F.year(base) >= 2069, base - F.expr("interval '100' year")).otherwise(base)
    hours = F.when(zone.startswith("GMT"), F.substr(zone, F.lit(4)).try_cast("int"))
    return F.when(hours.isNull(), base).otherwise(base - F.make_dt_interval(hours=hours))


def parse_time(col: Column, kind: str = "text") -> Cast:
    """Timestamp from text or numbers.

    Numbers are epoch seconds. Whole-number text is epoch milliseconds above
    10^12, else seconds. Other text must fit one of the known layouts. Numbers that a
    timestamp cannot hold are rejected as out of range.
    """
    no_reason = F.lit(None).cast("string")
    if kind == "time":
        return col.cast("timestamp"), no_reason
    if kind in ("integer", "float"):
        seconds = col.try_cast("bigint")
        fits = seconds.between(-MOST_SECONDS, MOST_SECONDS)
        value = F.when(fits, F.timestamp_seconds(F.when(fits, seconds)))
        reason = F.when(seconds.isNull() & F.isnan(col.cast("double")), F.lit(UNREADABLE)).otherwise(F.lit(TOO_FAR))
        return value, F.when(col.isNotNull() & value.isNull(), reason)
    whole = col.rlike(r"^[+-]?\d+\z")
    number = F.when(whole, col.try_cast("bigint"))
    seconds = F.when((number <= MILLIS_ABOVE) & (number >= -MOST_SECONDS), number)
    millis = F.when((number > MILLIS_ABOVE) & (number <= MOST_MILLIS), number)
    zone, dashed = F.substring_index(col, " ", -1), F.substring_index(col, ", ", -1)
    # each shape is tried only where its pattern matches, so a row pays for one parse
    value = (
        F.when(whole, F.coalesce(F.timestamp_millis(millis), F.timestamp_seconds(seconds)))
        .when(col.rlike(ISO_T) | col.rlike(ISO_BLANK) | col.rlike(ISO_DATE), _stamp(col))
        .when(col.rlike(CJK), _stamp(F.regexp_replace(col, CJK, "$1-$2-$3 $4:$5:$6")))
        .when(col.rlike(RFC822), _named_month(F.substring_index(col, " ", 4), "dd MMM yy H:mm", zone))
        .when(col.rlike(RFC850), _named_month(F.substring_index(dashed, " ", 2), "dd-MMM-yy H:mm:ss[.SSSSSSSSS]", zone))
    )
    return value, F.when(col.isNotNull() & value.isNull(), F.when(whole, F.lit(TOO_FAR)).otherwise(F.lit(UNREADABLE)))


def time_spent(start: Column, stop: Column) -> Column:
    """Duration between two epoch seconds as ``H时M分S秒``; zero parts are left out, order does not matter."""
    span = F.abs(stop - start).cast("bigint")
    hours = F.floor(span / 3600).cast("bigint")
    minutes = F.floor(span % 3600 / 60).cast("bigint")
    seconds = span % 60
    return F.when(
        span.isNotNull(),
        F.concat_ws(
            "",
            F.when(hours > 0, F.concat(hours.cast("string"), F.lit("时"))),
            F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("分"))),
            F.when((seconds > 0) | (span == 0), F.concat(seconds.cast("string"), F.lit("秒"))),
        ),
    )


def epoch_text(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss")
