"""Read views: job status, tenant listings, result availability.

Per-tenant listings are top-k per group written as ``row_number() <= k``; Spark plans that with
a partial per-partition group limit before the shuffle (``WindowGroupLimit``), so a tenant
with a third of all files ships at most k rows per map partition. A single-tenant listing is a
filter plus ``orderBy().limit(k)`` (TakeOrderedAndProject), with the tenant filter pushed to
the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.lifecycle import iso_utc, progress_percent

DEFAULT_LIMIT = 50


def top_k_per_group(df: DataFrame, group: str, order: list, k: int = DEFAULT_LIMIT,
                    rank_col: str = "rank") -> DataFrame:
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)


def tenant_recent(files: DataFrame, k: int = DEFAULT_LIMIT, tenant: str | None = None
                  ) -> DataFrame:
    """Newest files first per tenant (T1), ties broken by file id; the 4-column listing
    plus the rank. With ``tenant`` only that tenant, as a pushed-down filter plus a top-k."""
    order = [F.col("uploaded_at").desc(), F.col("file_id").asc()]
    cols = ["tenant_id", "file_id", "file_name", "status", "uploaded_at"]
    if tenant is not None:
        one = files.filter(F.col("tenant_id") == tenant).select(*cols).orderBy(*order).limit(k)
        return one.withColumn("rank", F.row_number().over(
            Window.partitionBy("tenant_id").orderBy(*order)))
    return top_k_per_group(files.select(*cols), "tenant_id", order, k)


def documents_by_tenant(status: DataFrame, k: int = DEFAULT_LIMIT, tenant: str | None = None,
                        status_filter: str | None = None, compat: bool = False) -> DataFrame:
    """Most recent documents per tenant.

    The name promises a status filter; ``status_filter`` provides it (the literal listing has
    none). ``compat=True`` sorts by creation time, as the literal index does (its sort key is
    written once at creation); otherwise by last update. Rows without a tenant are not indexed.
    """
    df = status.filter(F.col("tenant_id").isNotNull())
    if tenant is not None:
        df = df.filter(F.col("tenant_id") == tenant)
    if status_filter is not None:
        df = df.filter(F.col("overall_status") == status_filter)
    ts = "created_at" if compat else "updated_at"
    return top_k_per_group(df, "tenant_id", [F.col(ts).desc(), F.col("file_id").asc()], k)


def job_view(status: DataFrame, files: DataFrame, tenant: str | None = None) -> DataFrame:
    """Job view (J1, P8, P14, A3): the status row drives; the file record is optional
    (left outer join, at most one match per side). Nested ``progress``, ``timestamps`` and
    ``result`` (NULL without a result key), plus a percentage gauge."""
    st = status if tenant is None else status.filter(F.col("tenant_id") == tenant)
    f = files.select("file_id", "file_name", "uploaded_at")
    joined = st.join(f, "file_id", "left")
    return joined.select(
        "file_id", "file_name", F.col("overall_status").alias("status"),
        F.struct(F.col("processed_pages").alias("processed"),
                 F.col("total_pages").alias("total"),
                 F.col("failed_pages").alias("failed")).alias("progress"),
        F.struct(iso_utc("uploaded_at").alias("uploaded"), iso_utc("started_at").alias("started"),
                 iso_utc("completed_at").alias("completed")).alias("timestamps"),
        F.when(F.col("result_key").isNotNull(),
               F.struct(F.col("result_key").alias("s3_key"))).alias("result"),
        progress_percent("processed_pages", "total_pages").alias("percent"),
    )


def _with_result(status: DataFrame) -> DataFrame:
    return status.filter(F.col("result_key").isNotNull()).select("file_id")


def available_files(files: DataFrame, status: DataFrame) -> DataFrame:
    """Files whose results can be served (J4): status exists and has a result key
    (``left_semi``)."""
    return files.join(_with_result(status), "file_id", "left_semi")


def unavailable_files(files: DataFrame, status: DataFrame) -> DataFrame:
    """Files without results yet (``left_anti``): 'not found' for a results request."""
    return files.join(_with_result(status), "file_id", "left_anti")


def results_available(files: DataFrame, status: DataFrame) -> DataFrame:
    """Both sides of J4 in one pass: every file with ``available``. The keys with a result are
    de-duplicated by a partial aggregate and joined once (left outer), instead of scanning the
    files twice for the semi and the anti join."""
    keys = _with_result(status).groupBy("file_id").agg(F.lit(True).alias("_has"))
    return (files.join(keys, "file_id", "left")
            .withColumn("available", F.coalesce(F.col("_has"), F.lit(False))).drop("_has"))


# The file state a document state implies.
FILE_STATE_OF = {
    "pending": "uploaded", "chunking": "uploaded", "processing": "processing",
    "aggregating": "processing", "completed": "completed", "failed": "failed",
}


def derive_file_status(files: DataFrame, doc_status: DataFrame, compat: bool = False
                       ) -> DataFrame:
    """File status as its declared meaning: the state of the file's document (left join; a
    file without a status row keeps its own). ``compat=True`` keeps the stored value, which the
    upload flow never moves past ``uploaded``."""
    if compat:
        return files
    mapping = F.create_map(*[F.lit(x) for kv in FILE_STATE_OF.items() for x in kv])
    st = doc_status.select("file_id", mapping[F.col("overall_status")].alias("_derived"))
    return (files.join(st, "file_id", "left")
            .withColumn("status", F.coalesce(F.col("_derived"), F.col("status")))
            .drop("_derived"))


def derive_failed_pages(doc_status: DataFrame, pages: DataFrame, compat: bool = False,
                        analysis_col: str = "page_analysis") -> DataFrame:
    """``failed_pages`` as the number of pages whose analysis has a truthy error (one partial
    aggregate over the pages, joined to the status rows). ``compat=True`` keeps the stored
    counter, which is initialised to 0 and never incremented."""
    if compat:
        return doc_status
    from quire.functions.jsonrules import OUTCOME_FAILED, with_outcome
    failed = (with_outcome(pages.select("file_id", analysis_col), analysis_col, "_o")
              .groupBy("file_id")
              .agg(F.count_if(F.col("_o") == OUTCOME_FAILED).cast("int").alias("_failed")))
    return (doc_status.join(failed, "file_id", "left")
            .withColumn("failed_pages", F.coalesce(F.col("_failed"), F.lit(0)))
            .drop("_failed"))


def job_json(view: DataFrame) -> DataFrame:
    """A job view row as the JSON a client reads: ``{fileId, fileName, status, progress:
    {processed, total, failed}, timestamps: {uploaded, started, completed}, result}`` with
    ``result`` null when there is no result key (nulls kept)."""
    doc = F.struct(
        F.col("file_id").alias("fileId"), F.col("file_name").alias("fileName"), "status",
        "progress", "timestamps",
        F.when(F.col("result").isNotNull(), F.struct(F.col("result.s3_key").alias("s3Key")))
        .alias("result"))
    return view.select("file_id", F.to_json(doc, {"ignoreNullFields": "false"}).alias("json"))


def tenant_listing_json(listing: DataFrame) -> DataFrame:
    """A tenant listing row as ``{fileId, fileName, status, uploadedAt}`` JSON, with rank."""
    doc = F.struct(F.col("file_id").alias("fileId"), F.col("file_name").alias("fileName"),
                   "status", iso_utc("uploaded_at").alias("uploadedAt"))
    return listing.select("tenant_id", "rank", F.to_json(doc).alias("json"))
