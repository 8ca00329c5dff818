"""File catalogue: upload validation, routing, record keys, retention.

Everything is a projection or filter over the upload rows, so it runs as one narrow stage and
Parquet pushdown applies to whatever a caller filters on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.keys import METADATA_SK, file_index_keys, file_pk, object_key
from quire.functions.lifecycle import (
    DEFAULT_BUCKET, DEFAULT_THRESHOLD_MB, WRITER_TTL_DAYS, age_days, is_live, or_default,
    processing_type, retention_action, ttl_stamp,
)

# Rejection messages of upload validation, checked in this order.
NO_FILE = "No file uploaded"
NO_TENANT = "Tenant ID is required"
PDF_MIME = "application/pdf"


def validate_uploads(uploads: DataFrame, has_file: Column | str = "has_file",
                     tenant: str = "tenant_id") -> DataFrame:
    """Add ``valid`` and ``reject_reason``: a missing file is reported before a missing tenant;
    an empty tenant counts as missing."""
    hf = F.col(has_file) if isinstance(has_file, str) else has_file
    t = F.col(tenant)
    reason = (F.when(~F.coalesce(hf, F.lit(False)), F.lit(NO_FILE))
              .when(t.isNull() | (t == ""), F.lit(NO_TENANT)))
    return uploads.withColumn("reject_reason", reason).withColumn("valid", reason.isNull())


def file_id_for(tenant_id, file_name, uploaded_at, *more) -> Column:
    """Deterministic upload id (P12): a hash of tenant, name, upload time and any further
    identifying columns (size, a request id), so a retried task produces the same id (a random
    uuid would not). Requests equal in all of them are one upload: a resent request maps to
    the same id."""
    parts = [F.col(tenant_id), F.col(file_name), F.col(uploaded_at).cast("string")]
    parts += [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in more]
    return F.sha2(F.concat_ws("/", *parts), 256)


def catalog_files(uploads: DataFrame, now, threshold_mb=DEFAULT_THRESHOLD_MB,
                  default_bucket: str = DEFAULT_BUCKET, bucket_col: str | None = "bucket",
                  ttl_days: int = WRITER_TTL_DAYS, carry: tuple[str, ...] = ()) -> DataFrame:
    """File records (D1) from validated uploads: keys, object key, bucket, routing, status.

    Input columns: file_id, tenant_id, file_name, file_size, uploaded_at, optional bucket and
    mime_type. ``ttl`` counts from the write time ``now``. ``carry`` names request columns to
    keep alongside (e.g. the document body for the next step, instead of a join back).
    """
    cols = set(uploads.columns)
    bucket = or_default(bucket_col, default_bucket) if bucket_col in cols else F.lit(default_bucket)
    mime = F.col("mime_type") if "mime_type" in cols else F.lit(PDF_MIME)
    gpk, gsk = file_index_keys("tenant_id", "uploaded_at")
    return uploads.select(
        "file_id", "tenant_id", "file_name", F.col("file_size").cast("long").alias("file_size"),
        mime.alias("mime_type"),
        file_pk("file_id").alias("pk"), F.lit(METADATA_SK).alias("sk"),
        gpk.alias("gsi1pk"), gsk.alias("gsi1sk"),
        object_key("tenant_id", "file_id", "file_name").alias("s3_key"),
        bucket.alias("s3_bucket"),
        processing_type("file_size", threshold_mb).alias("processing_type"),
        F.lit("uploaded").alias("status"),
        F.col("uploaded_at"), F.col("uploaded_at").alias("updated_at"),
        ttl_stamp(now, ttl_days).alias("ttl"),
        *carry,
    )


def object_exists(files: DataFrame, listing: DataFrame, key: str = "file_id") -> DataFrame:
    """Existence test per file against a listing of stored objects (S3): ``exists`` is true
    when the listing holds the key. The listing is de-duplicated by a partial aggregate before
    the join."""
    present = listing.groupBy(key).agg(F.lit(True).alias("_present"))
    return (files.join(present, key, "left")
            .withColumn("exists", F.coalesce(F.col("_present"), F.lit(False)))
            .drop("_present"))


def retention(files: DataFrame, now, result_lag_days: int = 0,
              ts_col: str = "uploaded_at") -> DataFrame:
    """Age rules per file (P10, P11): the document object expires at 90 days, its result
    archives at 30 days (results are written ``result_lag_days`` after upload); ``live`` says
    whether the record's ttl is still ahead of ``now``."""
    age = age_days(ts_col, now)
    result_age = age - F.lit(result_lag_days)
    return (files.withColumn("age_days", age)
            .withColumn("document_action", retention_action(age, "document"))
            .withColumn("result_age_days", result_age)
            .withColumn("result_action", retention_action(result_age, "result"))
            .withColumn("live", is_live("ttl", now)))
