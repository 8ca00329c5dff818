"""Stand-in inputs: the driver's tables presented in the schemas the jobs expect.

These builders only rename and reshape columns (and apply fixed selection rules where a table
lacks a column, e.g. which pages a drill drops). They do none of the jobs' work; every job
downstream runs through the library's own operators and would run unchanged on real data of the
same schema. Each rule here is written identically in the DuckDB oracle.

Mapping
-------
documents      -> files (doc_id = file, source = tenant, n_chars = size) and page text
conversations  -> pages (conv_id = file, turn + 1 = page)
events         -> change log / event stream (file = user_id*100 + floor(day(ts)/5),
                  order = (ts, event_id), k = props.k)
labels         -> status side of jobs / result availability
lineitem       -> long chunk lists (document = l_suppkey)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import ensure_session_conf

# Fixed evaluation clock for every query that needs "now".
NOW = "2024-02-01 00:00:00"
# Upload clock of the document catalogue, a rule on the id (same in the oracle):
# 2023-09-01 plus (doc_id * 131) % 150 days plus doc_id % 1440 minutes.
CATALOG_EPOCH = "2023-09-01 00:00:00"
TENANTS = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the driver's tables."""
    ensure_session_conf(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def now_col() -> Column:
    return F.lit(NOW).cast("timestamp")


def uploaded_at(doc_id) -> Column:
    """Upload time by rule on the id (spread over ~150 days before NOW)."""
    d = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return (F.lit(CATALOG_EPOCH).cast("timestamp")
            + F.make_dt_interval(days=((d * 131) % 150).cast("int"),
                                 mins=(d % 1440).cast("int")))


def files_from_documents(docs: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """documents -> upload rows: file id, tenant, name, size, upload time, text."""
    return docs.select(*extra,
        F.col("doc_id").cast("string").alias("file_id"),
        F.col("source").alias("tenant_id"),
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_name"),
        F.col("n_chars").cast("long").alias("file_size"),
        uploaded_at("doc_id").alias("uploaded_at"),
        F.col("text"),
        F.col("lang"),
    )


def uploads_from_documents(docs: DataFrame) -> DataFrame:
    """documents -> raw upload requests: the ``files_from_documents`` columns plus the request
    fields a form post carries, set by rule: the file part is absent when doc_id % 17 = 0, the
    tenant field is empty when doc_id % 13 = 0 and absent when doc_id % 13 = 1, the bucket is
    empty when doc_id % 3 = 0, absent when doc_id % 3 = 1, else ``tenant-bucket``."""
    d = F.col("doc_id")
    req = docs.select(
        "*",
        ((d % 17) != 0).alias("has_file"),
        F.when(d % 13 == 0, F.lit("")).when(d % 13 == 1, F.lit(None).cast("string"))
        .otherwise(F.col("source")).alias("form_tenant"),
        F.when(d % 3 == 0, F.lit("")).when(d % 3 == 1, F.lit(None).cast("string"))
        .otherwise(F.lit("tenant-bucket")).alias("bucket"))
    return files_from_documents(req, extra=("has_file", "form_tenant", "bucket"))


def status_from_labels(labels: DataFrame) -> DataFrame:
    """labels -> status rows (one per job): quality 1 and not toxic = completed with a result
    key, toxic = failed, else processing; total = doc_id % 9 + 1 pages, processed = total when
    completed, else doc_id % (total + 1); started 5 minutes after the upload clock, completed
    one hour after it."""
    d = F.col("doc_id")
    total = (d % 9 + 1).cast("int")
    status = (F.when((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit("completed"))
              .when(F.col("toxic") == 1, F.lit("failed")).otherwise(F.lit("processing")))
    tenant = F.concat(F.lit("src"), (d % TENANTS).cast("string"))
    done = status == "completed"
    return labels.select(
        d.cast("string").alias("file_id"), tenant.alias("tenant_id"),
        status.alias("overall_status"), total.alias("total_pages"),
        F.when(done, total).otherwise((d % (total + 1)).cast("int")).alias("processed_pages"),
        F.lit(0).alias("failed_pages"),
        (uploaded_at(d) + F.expr("INTERVAL 5 MINUTES")).alias("started_at"),
        F.when(done, uploaded_at(d) + F.expr("INTERVAL 1 HOUR")).alias("completed_at"),
        F.when(done, F.concat_ws("/", tenant, d.cast("string"), F.lit("results.json")))
        .alias("result_key"))


def conversation_tenant(conv_id) -> Column:
    c = F.col(conv_id) if isinstance(conv_id, str) else conv_id
    return F.concat(F.lit("src"), (c % TENANTS).cast("string"))


def pages_from_conversations(conv: DataFrame) -> DataFrame:
    """conversations -> page rows: file id, tenant, page number, page text, role."""
    return conv.select(
        F.col("conv_id").cast("string").alias("file_id"),
        conversation_tenant("conv_id").alias("tenant_id"),
        (F.col("turn") + 1).cast("int").alias("page_number"),
        F.col("text").alias("page_text"),
        F.col("role"),
        F.col("conv_id"), F.col("turn"),
    )


def annotation_fault(conv_id, turn) -> Column:
    """Fault drill: pages whose annotation call errors, by a fixed rule on (file, page)."""
    return ((F.col(conv_id) * 7 + F.col(turn)) % 11) == 0


def reply_kind(conv_id, turn) -> Column:
    """Which reply shape the transport delivers for a page (0..7), by rule."""
    return ((F.col(conv_id) + F.col(turn) * 3) % 8).cast("int")


def wrap_reply(kind: Column, analysis_json: Column) -> Column:
    """A model reply around an analysis JSON, in one of eight shapes seen in practice:
    0 bare, 1 fenced block, 2 prose before/after, 3 two objects in an array, 4 cut short,
    5 one-element array, 6 the literal ``null``, 7 spread over lines."""
    j = analysis_json
    return (F.when(kind == 0, j)
            .when(kind == 1, F.concat(F.lit("```json\n"), j, F.lit("\n```")))
            .when(kind == 2, F.concat(F.lit("Here is the analysis:\n"), j,
                                      F.lit("\nHope this helps.")))
            .when(kind == 3, F.concat(F.lit("["), j, F.lit(","), j, F.lit("]")))
            .when(kind == 4, F.regexp_replace(j, r"\}$", ""))
            .when(kind == 5, F.concat(F.lit("["), j, F.lit("]")))
            .when(kind == 6, F.lit("null"))
            .otherwise(F.regexp_replace(j, ",\"", ",\n\"")))


def log_file_id(user_id, ts) -> Column:
    """events -> document id: user_id*100 + floor(day(ts)/5)."""
    return (F.col(user_id) * 100 + F.floor(F.dayofmonth(F.col(ts)) / 5)).cast("long")


def event_k(props) -> Column:
    return F.get_json_object(F.col(props), "$.k").cast("long")


def events_as_log(events: DataFrame) -> DataFrame:
    """events -> keyed change rows: file id, ts (timestamp), seq (event id), event type, k."""
    return events.select(
        log_file_id("user_id", "ts").alias("file_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        F.col("event_type"),
        event_k("props").alias("k"),
        F.col("user_id"),
        F.col("value"),
    )


def progress_log(events: DataFrame) -> DataFrame:
    """events -> progress rows: a click finishes page k%4+1, a signup records total k%4+1,
    view / error / purchase set the status to processing / failed / completed."""
    log = events_as_log(events)
    et, k = F.col("event_type"), F.col("k")
    return log.select(
        "file_id", "ts", "seq",
        F.when(et == "click", (k % 4 + 1).cast("int")).alias("page"),
        F.when(et == "signup", (k % 4 + 1).cast("int")).alias("total"),
        F.when(et == "view", F.lit("processing")).when(et == "error", F.lit("failed"))
        .when(et == "purchase", F.lit("completed")).alias("status"))


def status_change_log(events: DataFrame) -> DataFrame:
    """events -> status-record change log (schema ``LOG``): signup = put (tenant, pending,
    total k%4+1, processed 0), view = set status processing, click = increment processed,
    purchase = set processed k%4+1, error = delete when k%10 = 0, else set status failed with
    a message."""
    log = events_as_log(events)
    et, k = F.col("event_type"), F.col("k")
    tenant = F.concat(F.lit("src"), (F.col("user_id") % TENANTS).cast("string"))
    total = (k % 4 + 1).cast("string")
    op = (F.when(et == "signup", F.lit("put")).when(et == "click", F.lit("inc"))
          .when((et == "error") & (k % 10 == 0), F.lit("delete")).otherwise(F.lit("set")))
    fields = (F.when(et == "signup", F.create_map(
                F.lit("tenant_id"), tenant, F.lit("overall_status"), F.lit("pending"),
                F.lit("total_pages"), total, F.lit("processed_pages"), F.lit("0")))
              .when(et == "view", F.create_map(F.lit("overall_status"), F.lit("processing")))
              .when(et == "purchase", F.create_map(F.lit("processed_pages"), total))
              .when((et == "error") & (k % 10 != 0), F.create_map(
                  F.lit("overall_status"), F.lit("failed"),
                  F.lit("error_message"), F.concat(F.lit("error "), k.cast("string")))))
    return log.select("file_id", "ts", "seq", op.alias("op"), fields.alias("fields"),
                      F.when(et == "click", F.lit(1).cast("long")).alias("inc"))


def event_tenant(user_id) -> Column:
    c = F.col(user_id) if isinstance(user_id, str) else user_id
    return F.concat(F.lit("src"), (c % TENANTS).cast("string"))


def wire_events(events: DataFrame) -> DataFrame:
    """events -> published envelopes ``(seq, key, value)``: signups are uploads (payload with
    name, object key and a bucket that is empty when k%3 = 0; when k%7 = 0 the payload also
    carries its own fileId), clicks are chunk-ready events of page k%4+1, the rest are status
    events. Every 101st record arrives truncated (transport damage)."""
    from quire.operators.publish import CHUNK_READY, UPLOADED, envelope, merge_fields
    log = events_as_log(events)
    et, k, seq = F.col("event_type"), F.col("k"), F.col("seq")
    fid = F.col("file_id").cast("string")
    tenant = event_tenant("user_id")
    name = F.concat(F.lit("doc-"), fid, F.lit(".pdf"))
    etype = (F.when(et == "signup", F.lit(UPLOADED)).when(et == "click", F.lit(CHUNK_READY))
             .otherwise(F.lit("document.status")))
    upload = et == "signup"
    payload = {
        "fileName": F.when(upload, name),
        "s3Key": F.when(upload, F.concat_ws("/", tenant, fid, name)),
        "bucket": F.when(upload, F.when(k % 3 == 0, F.lit("")).otherwise(F.lit("bucket-a"))),
        "fileId": F.when(upload & (k % 7 == 0), F.concat(F.lit("override-"), seq.cast("string"))),
        "pageNumber": F.when(et == "click", k % 4 + 1),
        "status": F.when(~et.isin("signup", "click"), et)}
    data = merge_fields({"fileId": fid, "tenantId": tenant}, payload)
    value = envelope(etype, data, F.col("ts"))
    value = F.when(seq % 101 == 0, F.regexp_replace(value, r"\}$", "")).otherwise(value)
    key = F.when(et == "click", F.concat(tenant, F.lit("#"), fid)).otherwise(tenant)
    return log.select("seq", key.alias("key"), value.alias("value"))


def receipts_from_orders(orders: DataFrame) -> DataFrame:
    """orders -> the transport's receipts in the order they came: tenant (of the customer),
    order key, and an error code for orders in progress (status P)."""
    return orders.select(
        event_tenant("o_custkey").alias("tenant_id"), "o_orderkey",
        F.when(F.col("o_orderstatus") == "P", F.lit("ProvisionedThroughputExceededException"))
        .alias("error_code"))


def replayed(log: DataFrame, days: int = 40) -> DataFrame:
    """A progress log and its replay: every row again ``days`` later under the same sequence
    number, as a second run numbers its rows from the start again."""
    again = log.withColumn("ts", F.col("ts") + F.make_dt_interval(days=F.lit(days)))
    return log.unionByName(again)


def recorded_totals(pages: DataFrame) -> DataFrame:
    """Totals recorded per document: the pages there are, and one more (not yet stored) where the
    first page is longer than 80 characters."""
    late = F.max(F.when((F.col("page_number") == 1) & (F.length("page_text") > 80), 1)
                 .otherwise(0))
    return pages.groupBy("file_id").agg(
        (F.count(F.lit(1)) + late).cast("int").alias("total_pages"))


def drilled_annotator(request: str) -> str:
    """A stand-in annotator for drills, by the length of the request: a multiple of 5 is a server
    error, a multiple of 7 is always over the rate limit, else the first ``length % 3`` attempts
    are over it."""
    n = len(request)
    if n % 5 == 0:
        raise RuntimeError("500 server error")
    tried = _TRIED.get(request, 0)
    if n % 7 == 0 or tried < n % 3:
        _TRIED[request] = tried + 1
        if n % 7 == 0 and _TRIED[request] > 3:
            _TRIED.pop(request)
        raise RuntimeError("429 Too Many Requests")
    _TRIED.pop(request, None)
    return 'Sure:\n```json\n{"summary": "%d characters", "entities": []}\n```' % n


_TRIED: dict[str, int] = {}     # attempts of the request in hand, per Python worker
