"""Lifecycle Columns: time formats, routing, readiness, retention, progress.

Every rule that depends on "now" takes it as a Column or literal argument; nothing here calls
``current_timestamp()``, so results are reproducible under retries.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the reference's configuration.
DEFAULT_THRESHOLD_MB = "10"          # size threshold for async routing, inclusive
MB = 1024 * 1024
DEFAULT_TTL_DAYS = 30                # retention default; every writer passes 90
WRITER_TTL_DAYS = 90
DOCUMENT_EXPIRE_DAYS = 90            # stored documents are deleted at this age
RESULT_ARCHIVE_DAYS = 30             # results move to cold storage at this age
# Deployment defaults (store names are configuration, not semantics): the bucket used when a
# request names none, and where results go.
DEFAULT_BUCKET = "pdfs"
RESULTS_BUCKET = "results"
ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _lit_or_col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def iso_utc(ts) -> Column:
    """ISO-8601 UTC text with milliseconds (``2024-01-01T00:00:07.179Z``)."""
    return F.date_format(_c(ts), ISO_FORMAT)


def parse_float_prefix(text) -> Column:
    """JavaScript ``parseFloat``: the leading decimal number, trailing text ignored
    (``'10MB'`` -> 10.0); NULL where it would give NaN."""
    t = _lit_or_col(text).cast("string")
    num = F.regexp_extract(t, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return F.when(num != "", num.try_cast("double"))


def parse_int_prefix(text) -> Column:
    """JavaScript ``parseInt(x)``: leading integer digits; NULL where it would give NaN."""
    t = _lit_or_col(text).cast("string")
    num = F.regexp_extract(t, r"^\s*([+-]?\d+)", 1)
    return F.when(num != "", num.try_cast("long"))


def processing_type(size, threshold_mb=DEFAULT_THRESHOLD_MB) -> Column:
    """``async`` when size >= threshold MB (inclusive), else ``sync``.

    An unparsable threshold compares false, so everything goes ``sync``.
    """
    thr = parse_float_prefix(threshold_mb)
    is_async = F.coalesce(_c(size).cast("double") >= thr * F.lit(MB), F.lit(False))
    return F.when(is_async, F.lit("async")).otherwise(F.lit("sync"))


def or_default(value, default) -> Column:
    """JavaScript ``value || default`` for strings: NULL and '' both take the default."""
    return F.coalesce(F.nullif(_c(value), F.lit("")), _lit_or_col(default))


def ready(processed, total, status) -> Column:
    """Completion predicate: processed = total, total > 0, status 'processing'.

    Uses the strictest of the reference's three variants; NULL counters mean not ready.
    """
    p, t, s = _c(processed), _c(total), _c(status)
    return F.coalesce((p == t) & (t > 0) & (s == "processing"), F.lit(False))


def ttl_stamp(now, days=WRITER_TTL_DAYS) -> Column:
    """Epoch-second expiry: floor(now) + days * 86400."""
    return F.unix_timestamp(_lit_or_col(now).cast("timestamp")) + F.lit(int(days) * 86400)


def is_live(ttl, now) -> Column:
    """Row not yet expired at ``now`` (rows without ttl never expire)."""
    return F.coalesce(_c(ttl) > F.unix_timestamp(_lit_or_col(now).cast("timestamp")), F.lit(True))


def age_days(ts, now) -> Column:
    """Whole days between ``ts`` and ``now``."""
    return F.floor((F.unix_timestamp(_lit_or_col(now).cast("timestamp"))
                    - F.unix_timestamp(_c(ts).cast("timestamp"))) / 86400).cast("long")


def retention_action(age, kind) -> Column:
    """Object age rules: documents expire at 90 days; results archive at 30 days; else keep."""
    a, k = _c(age), _lit_or_col(kind)
    return (F.when((k == "document") & (a >= DOCUMENT_EXPIRE_DAYS), F.lit("expire"))
            .when((k == "result") & (a >= RESULT_ARCHIVE_DAYS), F.lit("archive"))
            .otherwise(F.lit("keep")))


def progress_percent(processed, total) -> Column:
    """Gauge percentage; zero or unknown total gives NULL."""
    p = F.coalesce(_c(processed), F.lit(0)).cast("double")
    return F.round(F.try_divide(p * 100.0, F.nullif(_c(total).cast("double"), F.lit(0.0))), 2)
