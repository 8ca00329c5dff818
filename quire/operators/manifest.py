"""Result assembly.

The manifest of a document is its header (success / failed / missing / invalid counts) plus its
chunks ordered by page number. Counting is a plain ``groupBy(file)`` with ``count_if``: Spark
runs it as partial + final aggregation, so a document with a huge number of pages is reduced on
the map side before the shuffle. Chunks stay one row per page (``manifest_chunks``); only the
nested export (``manifest_nested``) gathers a document's chunks into one array, and that is
bounded by a single document's page count, never by the table.

Outcome rules (per stored analysis text):

    analysis                          success  failed  chunk status  document
    JSON, no truthy ``error``           +1       0      success
    object with truthy ``error``         0      +1      failed
    missing or ''                        0       0      success
    unparsable, or JSON ``null``         -       -      -             failed (invalid_count>0)
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.jsonrules import (
    OUTCOME_FAILED, OUTCOME_INVALID, OUTCOME_MISSING, OUTCOME_SUCCESS, chunk_status,
    compact_json, with_outcome, with_parsed,
)
from quire.functions.keys import page_sk, results_key
from quire.functions.lifecycle import iso_utc

# Fixed value: message prefix of an aggregation failure.
AGGREGATION_FAILED = "Aggregation failed: "
INVALID_MESSAGE = AGGREGATION_FAILED + "page analysis is not valid JSON"


def manifest_header(pages: DataFrame, keys: tuple[str, ...] = ("file_id", "tenant_id"),
                    analysis_col: str = "page_analysis",
                    totals: Mapping[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """One row per document: page rows found and the four outcome counts, plus the document
    status the aggregation ends in (``completed``, or ``failed`` when any page is invalid).
    ``totals`` adds aggregates of the parsed analyses (VARIANT), parsed once per page."""
    staged = with_parsed(pages.select(*keys, analysis_col), analysis_col, "_mh_parsed")
    agg = (with_outcome(staged, analysis_col, "outcome", parsed="_mh_parsed")
           .groupBy(*keys)
           .agg(F.count(F.lit(1)).alias("pages_found"),
                F.count_if(F.col("outcome") == OUTCOME_SUCCESS).alias("success_count"),
                F.count_if(F.col("outcome") == OUTCOME_FAILED).alias("failed_count"),
                F.count_if(F.col("outcome") == OUTCOME_MISSING).alias("missing_count"),
                F.count_if(F.col("outcome") == OUTCOME_INVALID).alias("invalid_count"),
                *[f(F.col("_mh_parsed")).alias(name) for name, f in (totals or {}).items()]))
    invalid = F.col("invalid_count") > 0
    return (agg.withColumn("document_status",
                           F.when(invalid, F.lit("failed")).otherwise(F.lit("completed")))
            .withColumn("error_message", F.when(invalid, F.lit(INVALID_MESSAGE))))


def manifest_chunks(pages: DataFrame, keys: tuple[str, ...] = ("file_id", "tenant_id"),
                    analysis_col: str = "page_analysis") -> DataFrame:
    """One row per chunk: page number and key, outcome, chunk status and the normalised
    analysis JSON (NULL when missing). Order is by ``page_number`` (numeric, so page 10000
    follows 9999)."""
    staged = with_parsed(pages.select(*keys, "page_number", analysis_col), analysis_col,
                         "_mf_parsed")
    staged = with_outcome(staged, analysis_col, "outcome", parsed="_mf_parsed")
    return staged.select(
        *keys, F.col("page_number").cast("int").alias("page_number"),
        page_sk("page_number").alias("page_key"), "outcome",
        compact_json("_mf_parsed").alias("analysis"),
        chunk_status("outcome").alias("chunk_status"))


def manifest_parts(pages: DataFrame, totals: DataFrame | None, processed_at,
                   keys: tuple[str, ...] = ("file_id", "tenant_id"),
                   analysis_col: str = "page_analysis",
                   how: str = "left") -> tuple[DataFrame, DataFrame]:
    """The manifest as two flat tables: (headers, chunks).

    ``chunks`` is one row per page (``manifest_chunks``); ``headers`` is one row per document
    with processed_at, total_pages (from ``totals``, or, when ``totals`` is None, from a
    ``total_pages`` column of the pages), the four counts, the document status and the result
    key, aggregated partially from the chunks; ``how="inner"`` keeps the headers of documents in
    ``totals`` only. Nothing gathers a document's pages
    into one row, so a document with a third of all pages is no bigger a problem than any
    other; nesting is left to ``nest_manifest`` for the documents a reader asks for.
    """
    group = keys if totals is not None else (*keys, "total_pages")
    chunks = manifest_chunks(pages, group, analysis_col)
    processed_c = processed_at if not isinstance(processed_at, str) else F.lit(processed_at)
    counts = chunks.groupBy(*group).agg(
        F.count_if(F.col("outcome") == OUTCOME_SUCCESS).alias("success_count"),
        F.count_if(F.col("outcome") == OUTCOME_FAILED).alias("failed_count"),
        F.count_if(F.col("outcome") == OUTCOME_MISSING).alias("missing_count"),
        F.count_if(F.col("outcome") == OUTCOME_INVALID).alias("invalid_count"))
    invalid = F.col("invalid_count") > 0
    with_totals = (counts if totals is None else
                   counts.join(totals.select("file_id", F.col("total_pages").cast("int")),
                               "file_id", how))
    headers = (with_totals.withColumn("total_pages", F.col("total_pages").cast("int"))
               .select(*keys, iso_utc(processed_c.cast("timestamp")).alias("processed_at"),
                       "total_pages", "success_count", "failed_count", "missing_count",
                       "invalid_count",
                       F.when(invalid, F.lit("failed")).otherwise(F.lit("completed"))
                       .alias("document_status"),
                       F.when(invalid, F.lit(INVALID_MESSAGE)).alias("error_message"),
                       F.when(~invalid, results_key("tenant_id", "file_id")).alias("result_key")))
    return headers, chunks.drop("total_pages") if totals is None else chunks


def nest_manifest(headers: DataFrame, chunks: DataFrame,
                  keys: tuple[str, ...] = ("file_id", "tenant_id")) -> DataFrame:
    """Nested manifest rows (header + ``chunks`` array sorted by page) for the documents in
    ``headers``; documents that failed (an invalid page) get none. Each row gathers one
    document's chunks, so apply it to the documents being exported or served, not to a table
    that may hold one enormous document."""
    ok = headers.filter(F.col("invalid_count") == 0)
    nested = (chunks.join(ok.select(*keys), list(keys), "left_semi").groupBy(*keys)
              .agg(F.array_sort(F.collect_list(F.struct(
                  F.col("page_number"), F.col("analysis"),
                  F.col("chunk_status").alias("status")))).alias("chunks")))
    return ok.join(nested, list(keys), "left").select(
        *keys, "processed_at", "total_pages", "success_count", "failed_count", "missing_count",
        "invalid_count", F.coalesce(F.col("chunks"), F.array().cast(
            "array<struct<page_number:int,analysis:string,status:string>>")).alias("chunks"),
        "result_key")


def manifest_documents(nested: DataFrame) -> DataFrame:
    """The result document of each nested manifest row as JSON text (S5's ``results.json``):
    ``{fileId, tenantId, processedAt, totalPages, successCount, failedCount, chunks:
    [{pageNumber, analysis, status}]}``, with each analysis embedded as JSON (parsed, not a
    string) and ``null`` kept. Returns tenant_id, file_id, result_key and ``json``."""
    chunk = F.transform("chunks", lambda c: F.struct(
        c["page_number"].alias("pageNumber"), F.try_parse_json(c["analysis"]).alias("analysis"),
        c["status"].alias("status")))
    doc = F.struct(
        F.col("file_id").alias("fileId"), F.col("tenant_id").alias("tenantId"),
        F.col("processed_at").alias("processedAt"), F.col("total_pages").alias("totalPages"),
        F.col("success_count").alias("successCount"),
        F.col("failed_count").alias("failedCount"), chunk.alias("chunks"))
    return nested.select("tenant_id", "file_id", "result_key",
                         F.to_json(doc, {"ignoreNullFields": "false"}).alias("json"))


def manifest_nested(pages: DataFrame, totals: DataFrame, processed_at,
                    keys: tuple[str, ...] = ("file_id", "tenant_id"),
                    analysis_col: str = "page_analysis") -> DataFrame:
    """Full manifest rows (header + ``chunks`` array sorted by page), as the reference writes
    one result per document. ``totals`` gives ``total_pages`` per ``file_id``. Documents with an
    invalid page get no manifest (they fail instead). See ``nest_manifest`` on row size."""
    headers, chunks = manifest_parts(pages, totals, processed_at, keys, analysis_col)
    return nest_manifest(headers, chunks, keys)


def current_pages(pages: DataFrame, order: tuple[str, ...] = ("updated_at",)) -> DataFrame:
    """The page table as a keyed store sees it: a put replaces the earlier row for the same
    (document, page), so replays never add pages. Last write wins by ``order``, writes at one
    time by the rest of the row (a partial aggregate per page key; its groups are bounded by the
    number of rewrites of one page)."""
    from quire.operators.log import latest_per_key
    rest = [c for c in sorted(pages.columns) if c not in ("file_id", "page_number", *order)
            and pages.schema[c].dataType.typeName() not in ("map", "variant")]
    return latest_per_key(pages, ["file_id", "page_number"], [*order, *rest])


def page_counts(pages: DataFrame) -> DataFrame:
    """Page rows found per document (partial aggregation; skew-safe)."""
    return pages.groupBy("file_id").agg(F.count(F.lit(1)).alias("pages_found"))


def guard(ready_docs: DataFrame, pages: DataFrame) -> DataFrame:
    """Page completeness guard (J3): join the documents to their page counts and decide.

    ``action`` is ``deferred`` when fewer page rows exist than ``total_pages`` (the document goes
    back to ``processing`` and waits), else ``assemble``; more pages than the total is accepted.
    """
    counts = page_counts(pages)
    found = F.coalesce(F.col("pages_found"), F.lit(0)).cast("long")
    return (ready_docs.join(counts, "file_id", "left")
            .withColumn("pages_found", found)
            .withColumn("action", F.when(found < F.col("total_pages"), F.lit("deferred"))
                        .otherwise(F.lit("assemble"))))
