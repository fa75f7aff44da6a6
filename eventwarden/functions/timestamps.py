"""Event time as columns: parsing, text forms, epoch microseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text forms a plain cast does not read. Anything else becomes null.
EXTRA_FORMATS = (
    "dd/MMM/yyyy:HH:mm:ss Z",
    "d MMM yyyy HH:mm:ss Z",
    "yyyy/MM/dd HH:mm:ss",
    "MM/dd/yyyy HH:mm:ss",
    "MMM d yyyy HH:mm:ss",
)
MILLIS_FROM = 10_000_000_000


def parse_text(text: Column) -> Column:
    """Best-effort instant from text; text without an offset counts as UTC."""
    clean = F.trim(text)
    tries = [clean.try_cast("timestamp")]
    # Mail-style dates: the weekday carries nothing, GMT is offset zero.
    bare = F.regexp_replace(F.regexp_replace(clean, "^[A-Za-z]{3}, ", ""), " GMT$", " +0000")
    tries += [F.try_to_timestamp(bare, F.lit(f)) for f in EXTRA_FORMATS]
    # A bare number must not be read as a year.
    return F.when((F.length(clean) < 8) & clean.rlike(r"^\d*$"), None).otherwise(F.coalesce(*tries))


def parse_epoch(number: Column) -> Column:
    """Instant from epoch seconds, or milliseconds when the number is that large."""
    value = number.cast("double")
    scale = F.when(value > MILLIS_FROM, 1e3).otherwise(1e6)
    return F.timestamp_micros((value * scale).cast("bigint"))


def event_time(text: Column) -> Column:
    """Instant from text or from an epoch number in text form; null where it is neither."""
    number = F.trim(text)
    epoch = F.when(number.rlike(r"^\d{9,13}(\.\d{1,9})?$"), parse_epoch(number.try_cast("double")))
    return F.coalesce(epoch, parse_text(text))


def epoch_us(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def epoch_ns(ts: Column) -> Column:
    return epoch_us(ts) * F.lit(1000).cast("bigint")


def iso_text(ts: Column) -> Column:
    """ISO-8601 in UTC; the fraction appears only when it is not zero."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    fraction = F.when(micros == 0, "").otherwise(F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0")))
    return F.concat(whole, fraction, F.lit("+00:00"))


def is_off_hours(hour: Column) -> Column:
    return (hour < 6) | (hour > 20)
