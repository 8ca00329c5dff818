"""Events: envelopes, intake parsing, 500-record batches, publish outcomes (S8-S10, P4, P13,
A4, J5, W4, ST5).

An event travels as ``(key, value)`` where ``value`` is the JSON envelope
``{eventType, data, timestamp, metadata}``. Building and parsing envelopes are projections;
batching is a skew-safe keyed scan; the outcome report is a join on (batch, index) and one
partial aggregate.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.jsonrules import strict_json
from quire.functions.lifecycle import DEFAULT_BUCKET, iso_utc, or_default
from quire.operators.scan import keyed_scan

# Fixed values of the event model.
SOURCE = "quire"                      # metadata.source of every envelope (deployment name)
UPLOADED = "document.uploaded"
CHUNK_READY = "chunk.ready"
BATCH_LIMIT = 500
BATCH_TOO_LARGE = "Batch size cannot exceed 500 records"


def merge_payload(base: Column, payload: Column) -> Column:
    """``{...base, ...payload}``: later keys overwrite (needs mapKeyDedupPolicy=LAST_WIN, set by
    ``quire.session``), so a payload may replace ``fileId``. Both maps have one value type; a
    null payload changes nothing."""
    return F.when(payload.isNull(), base).otherwise(F.map_concat(base, payload))


def typed_map(**values: Column) -> Column:
    """A payload whose values keep their JSON type (a page number travels as a number)."""
    pairs = [x for k, v in values.items() for x in (F.lit(k), v.cast("variant"))]
    return F.create_map(*pairs)


def merge_fields(*payloads: Mapping[str, Column]) -> Column:
    """``{...first, ...second}`` as a struct, where the names of the fields are known: of each name
    the last value that is not null counts, and ``envelope`` leaves out names without one."""
    values: dict[str, list[Column]] = {}
    for payload in payloads:
        for name, value in payload.items():
            values.setdefault(name, []).insert(0, value)
    return F.struct(*[F.coalesce(*v).alias(name) for name, v in values.items()])


def envelope(event_type: Column, data: Column, ts: Column) -> Column:
    """Envelope JSON text: eventType, data (a struct whose null fields are left out, or a map of
    strings or of typed values), ISO timestamp, metadata.source."""
    return F.to_json(F.struct(
        event_type.alias("eventType"), data.alias("data"), iso_utc(ts).alias("timestamp"),
        F.create_map(F.lit("source"), F.lit(SOURCE)).alias("metadata")))


def parse_envelopes(wire: DataFrame, value_col: str = "value",
                    default_bucket: str = DEFAULT_BUCKET,
                    extra_fields: tuple[str, ...] = (),
                    typed_fields: tuple[str, ...] = ()) -> DataFrame:
    """Intake of raw events (P4, P5): strict parse; ``disposition`` is ``quarantine`` for text
    that is not a JSON envelope (or an upload without a data object), ``process`` for
    ``document.uploaded``, ``ignore`` for any other type. One bad record never stops the rest.
    Adds event_type, file_id, tenant_id, s3_key and bucket (empty or absent -> default), plus
    one string column per name in ``extra_fields`` (other members of ``data``), and for every name
    in ``typed_fields`` the JSON type it travelled with as ``<name>_type`` (null where absent)."""
    v, data, et = F.col("_pe_v"), F.col("_pe_data"), F.col("_pe_type")
    upload = et == UPLOADED

    def field(name):
        return F.try_variant_get(data, f"$.{name}", "string")

    # what is used more than once is a column of its own, so that it is read once a row
    staged = (wire.withColumn("_pe_v", strict_json(value_col))
              .withColumns({"_pe_data": F.try_variant_get(v, "$.data", "variant"),
                            "_pe_type": F.try_variant_get(v, "$.eventType", "string")})
              .withColumn("_pe_bucket", F.when(upload, field("bucket"))))
    # a strict parse that starts with a brace is an object
    is_obj = v.isNotNull() & F.col(value_col).rlike(r"^[ \t\r\n]*\{")
    data_obj = F.coalesce(F.schema_of_variant(data).startswith("OBJECT"), F.lit(False))
    disposition = (F.when(~is_obj, F.lit("quarantine"))
                   .when(upload & ~data_obj, F.lit("quarantine"))
                   .when(upload, F.lit("process"))
                   .otherwise(F.lit("ignore")))
    return staged.select(
        *wire.columns, et.alias("event_type"), disposition.alias("disposition"),
        field("fileId").alias("file_id"), field("tenantId").alias("tenant_id"),
        F.when(upload, field("s3Key")).alias("s3_key"),
        F.when(upload, or_default(F.col("_pe_bucket"), default_bucket)).alias("bucket"),
        *[field(name).alias(name) for name in extra_fields],
        *[F.schema_of_variant(F.try_variant_get(data, f"$.{name}", "variant"))
          .alias(f"{name}_type") for name in typed_fields])


def number_in_batches(records: DataFrame, key: str | Sequence[str], order: Sequence[str],
                      size: int = BATCH_LIMIT, n_segments: int | None = None) -> DataFrame:
    """Split each key's records, in order, into groups of ``size`` (S10, W4): adds
    ``chunk_index`` (1-based), ``batch_id`` and ``batch_index`` (0-based within the batch).
    0, 500, 501, 1000 records give 0, 1, 2, 2 batches."""
    scanned = keyed_scan(records, key, order, n_segments=n_segments)
    return (scanned.withColumnRenamed("row_number", "chunk_index")
            .withColumn("batch_id", F.floor((F.col("chunk_index") - 1) / size).cast("long"))
            .withColumn("batch_index", ((F.col("chunk_index") - 1) % size).cast("int")))


def publish_report(records: DataFrame, outcomes: DataFrame, key: Sequence[str],
                   limit: int = BATCH_LIMIT) -> tuple[DataFrame, DataFrame]:
    """Outcome of publishing batches.

    ``records`` carry ``key`` columns, ``batch_id`` and ``batch_index``; ``outcomes`` carry the
    same position columns and ``error_code`` (NULL = accepted), in the order of the request.
    Returns (per-batch totals, failed records). A batch over ``limit`` is rejected whole before
    sending: it gets ``error`` and no success/failed counts.
    """
    pos = [*key, "batch_id", "batch_index"]
    joined = records.join(outcomes.select(*pos, "error_code"), pos, "left")
    totals = joined.groupBy(*key, "batch_id").agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(F.col("error_code").isNotNull()).alias("failed"))
    over = F.col("records") > limit
    totals = totals.select(
        *key, "batch_id", "records",
        F.when(~over, F.col("records") - F.col("failed")).alias("success_count"),
        F.when(~over, F.col("failed")).alias("failed_count"),
        F.when(over, F.lit(BATCH_TOO_LARGE)).alias("error"))
    failed = joined.filter(F.col("error_code").isNotNull())
    return totals, failed


def chunk_events(pages: DataFrame, ts: Column) -> DataFrame:
    """Fan-out of chunk-ready events, one per page (ST5): routing key ``tenant#file``."""
    data = F.struct(F.col("file_id").cast("string").alias("fileId"),
                    F.col("tenant_id").alias("tenantId"),
                    F.col("page_number").alias("pageNumber"))
    return pages.select(
        F.concat(F.col("tenant_id"), F.lit("#"), F.col("file_id").cast("string")).alias("key"),
        envelope(F.lit(CHUNK_READY), data, ts).alias("value"))
