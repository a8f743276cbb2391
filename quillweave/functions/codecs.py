"""Hashes, encodings, dates and validators, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def md5_upper(x: Column | str) -> Column:
    """Upper-case hex MD5 of a string's UTF-8 or of bytes."""
    return F.upper(F.md5(_col(x).cast("binary")))


def sha256_upper(x: Column | str) -> Column:
    return F.upper(F.sha2(_col(x).cast("binary"), 256))


def base64url(x: Column | str) -> Column:
    """URL-safe base64 of a string's UTF-8, padded and without line breaks."""
    return F.regexp_replace(F.translate(F.base64(F.encode(_col(x), "UTF-8")), "+/", "-_"), r"\s", "")


def from_base64url(x: Column | str) -> Column:
    return F.decode(F.unbase64(F.translate(_col(x), "-_", "+/")), "UTF-8")


def http_date(x: Column | str) -> Column:
    """Timestamp of a date such as ``Sun, 06 Nov 1994 08:49:37 GMT``; null where it isn't one."""
    return F.try_to_timestamp(F.substring(_col(x), 6, 100), F.lit("dd MMM yyyy HH:mm:ss z"))


def display_date(seconds: Column | str) -> Column:
    """Eastern time on a 12-hour clock of seconds since 1970. The year is the calendar's, not the week's."""
    return F.date_format(F.from_utc_timestamp(F.timestamp_seconds(_col(seconds)), "EST5EDT"), "yyyy-MM-dd'T'hh:mm:ss")


# The form of a channel's name, and of its path specification: steps, then at most one test of the text. The
# class is written out, for DuckDB's expressions have none within another.
CHANNEL_NAME = r"^[_.a-zA-Z0-9-]+$"
XPATH = r"^(/[_.a-zA-Z0-9-]+)+(\[(text\(\)=\"[^\"]+\"|contains\(text\(\),\"[^\"]+\"\))\])?$"


def channel_name_valid(x: Column | str) -> Column:
    return _col(x).rlike(CHANNEL_NAME)


def xpath_compact(x: Column | str) -> Column:
    """A specification without the white space and plus signs outside quotes.

    Cut at the quotes, the last part is outside and every second one before it; a first quote without a partner is so too.
    """
    parts = F.split(_col(x), '"', -1)
    n = F.size(parts)
    return F.array_join(F.transform(parts, lambda p, i: F.when((n - i) % 2 == 1, F.regexp_replace(p, r"[\s+]", "")).otherwise(p)), '"')


def xpath_valid(x: Column | str) -> Column:
    return xpath_compact(x).rlike(XPATH)
