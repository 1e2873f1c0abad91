"""Whether texts are values of a type, zones and offsets, durations and dates."""

from __future__ import annotations

import re
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import first_of, has_any, strict_decimal

FLOAT = r"(?i)^[+-]?(?:inf|infinity|nan|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?)$"
RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:[Zz]|[+-]\d{2}:\d{2})$"
#: Names of the zone without an offset.
UTC_NAMES = ("utc", "etc/utc", "gmt", "etc/gmt")
#: Fragments of column names that tell sensitive data.
SENSITIVE = (
    "password", "passwd", "pwd", "secret", "key", "token", "auth", "credential", "ssn", "social_security", "credit_card", "creditcard", "ccn", "card_number", "email", "phone",
    "address", "ip_address", "ip_addr", "user_id", "userid", "username", "user_name", "api_key", "apikey", "private", "sensitive", "pii", "phi", "hipaa", "gdpr",
)


def is_date(v: Column) -> Column:
    return v.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$") & F.try_to_timestamp(v, F.lit("yyyy-M-d")).isNotNull()


def is_zoned(v: Column) -> Column:
    """An instant with an explicit offset."""
    return v.rlike(RFC3339) & F.try_to_timestamp(F.replace(F.upper(v), F.lit(" "), F.lit("T"))).isNotNull()


def is_time(v: Column) -> Column:
    return v.rlike(r"^(?:[01]?\d|2[0-3]):[0-5]?\d(?::(?:[0-5]?\d|60))?$")


def valid_text(v: Column, kind: str) -> Column:
    """Whether a text can be a value of a type; an empty text can be of any, a null is null. Lists and structs have no text."""
    if kind.startswith("decimal"):
        p, s = map(int, re.findall(r"\d+", kind))
        fits = strict_decimal(v, p, s).isNotNull()
    else:
        plain = v.rlike(r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$") & F.try_to_timestamp(v, F.lit("yyyy-M-d H:m:s")).isNotNull()
        fits = {
            "null": F.lit(False),
            "boolean": F.lower(v).isin("true", "false", "1", "0", "yes", "no", "t", "f"),
            "bigint": v.rlike("^[+-]?[0-9]+$") & v.try_cast("bigint").isNotNull(),
            "double": v.rlike(FLOAT),
            "date": is_date(v),
            "time": is_time(v),
            "timestamp": is_zoned(v) | plain,
            "timestamp_tz": is_zoned(v),
            "duration": F.startswith(v, F.lit("PT")) | has_any(v, "h", "m", "s"),
            "string": F.lit(True),
            "binary": F.lit(True),
        }.get(kind, F.lit(False))
    return F.when(v.isNull(), None).otherwise((v == "") | fits)


def same_zone(a: str, b: str) -> bool:
    """Zone names that mean the same: those without an offset are one, others must be equal in any case."""
    a, b = a.strip().lower(), b.strip().lower()
    return a == b or a in UTC_NAMES and b in UTC_NAMES


def offset_seconds(v: Column) -> Column:
    """The offset that a text names, in seconds."""
    sign = F.when(F.substring(v, -6, 1) == "-", -1).otherwise(1)
    named = sign * (F.substring(v, -5, 2).try_cast("int") * 3600 + F.substring(v, -2, 2).try_cast("int") * 60)
    return F.when(F.upper(F.substring(v, -1, 1)) == "Z", 0).otherwise(named)


def offset_fits(v: Column, zone: str) -> Column:
    """Whether a text with an explicit offset names the one that the zone has at that instant; null if it is no such text."""
    instant = F.try_to_timestamp(F.replace(F.upper(v), F.lit(" "), F.lit("T")))
    if not zone.strip():
        fits = F.lit(True)
    elif zone.strip().lower() in UTC_NAMES:
        fits = offset_seconds(v) == 0
    else:
        fits = offset_seconds(v) == F.unix_timestamp(F.from_utc_timestamp(F.to_utc_timestamp(instant, F.current_timezone()), zone)) - F.unix_timestamp(F.to_utc_timestamp(instant, F.current_timezone()))
    return F.when(is_zoned(v), fits)


def iso_duration_ms(text: str) -> int:
    """Milliseconds of PnD, PTnH, PTnM or PTnS, one unit alone."""
    found = re.fullmatch(r"P(?:(\d+)D|T(\d+)([HMS]))", text)
    if not found:
        raise ValueError(f"no duration: {text!r}")
    n, unit = (found[1], "D") if found[1] else (found[2], found[3])
    return int(n) * {"D": 86_400_000, "H": 3_600_000, "M": 60_000, "S": 1_000}[unit]


def logical_date_ms(text: str) -> int:
    """Milliseconds since 1970 of an RFC 3339 instant, or of a day's midnight in UTC."""
    at = datetime.fromisoformat(text.replace("Z", "+00:00"))
    return int((at if at.tzinfo else at.replace(tzinfo=timezone.utc)).timestamp() * 1000)


def sensitive(columns: list[str]) -> list[str]:
    """Columns whose names hold a fragment of SENSITIVE, in any case."""
    return [c for c in columns if any(s in c.lower() for s in SENSITIVE)]


def file_uid(path: Column, bucket: Column | None = None, version: Column | None = None, etag: Column | None = None, size: Column | None = None) -> Column:
    """Identity of a file: an object's version, else its tag and size, else its path."""
    weak = F.concat(F.lit("path:"), path)
    if bucket is None:
        return weak
    by_version = F.concat(F.lit("s3v:"), bucket, F.lit(":"), version) if version is not None else F.lit(None)
    by_tag = F.concat(F.lit("s3e:"), bucket, F.lit(":"), etag, F.lit(":"), size.cast("string")) if etag is not None else F.lit(None)
    return F.coalesce(by_version, by_tag, weak)


def kind_of_sample(values: Column) -> tuple[Column, Column]:
    """(type, format) that all values of a sample have, as aggregates: boolean, int64, float64, date, timestamp, else string; empty and null-like ones say nothing."""
    said = ~(values.isNull() | (values == "") | values.isin("null", "NULL", "NA"))
    every = lambda test: F.coalesce(F.bool_and(F.when(said, test)), F.lit(False))
    #: Formats in the order of their tests.
    dates = (("%Y-%m-%d", r"^\d{4}-\d{2}-\d{2}$"), ("%d/%m/%Y", r"^\d{2}/\d{2}/\d{4}$"), ("%Y/%m/%d", r"^\d{4}/\d{2}/\d{2}$"), ("%d-%m-%Y", r"^\d{2}-\d{2}-\d{4}$"))
    stamps = (("%Y-%m-%dT%H:%M:%S", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}"), ("%Y-%m-%d %H:%M:%S", r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}"), ("%d/%m/%Y %H:%M:%S", r"^\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2}"))
    date = first_of(*[(every(values.rlike(r)), f) for f, r in dates])
    stamp = first_of(*[(every(values.rlike(r)), f) for f, r in stamps])
    plain = first_of(
        (every(F.lower(values).isin("true", "false") | values.isin("0", "1")), "boolean"),
        (every(values.rlike("^[+-]?[0-9]+$") & values.try_cast("bigint").isNotNull()), "int64"),
        (every(values.rlike(FLOAT)), "float64"),
    )
    kind = F.coalesce(plain, F.when(date.isNotNull(), "date"), F.when(stamp.isNotNull(), "timestamp"), F.lit("string"))
    return kind, F.when(plain.isNull(), F.coalesce(date, stamp))
