"""DuckDB oracle SQL for each registered query (same column names, same rules).

The oracle is written independently of the Spark code: plain SQL over the driver's parquet
views. Where a query applies a fixed input rule (tenant of a conversation, fault drill, reply
shape), the same rule appears here verbatim.
"""

from __future__ import annotations

# Fixed values of the native rule set, written out here on their own.
POSITIVE_WORDS = (
    "good", "great", "excellent", "happy", "love", "best", "success", "positive",
    "bon", "bonne", "heureux", "meilleur", "succès",
    "gut", "glücklich", "beste", "erfolg",
    "bueno", "buena", "feliz", "mejor", "éxito",
)
NEGATIVE_WORDS = (
    "bad", "poor", "terrible", "sad", "hate", "worst", "failure", "negative",
    "mauvais", "mauvaise", "triste", "pire", "échec",
    "schlecht", "traurig", "schlimm", "fehler",
    "malo", "mala", "peor", "fracaso",
)


def _sql_list(words) -> str:
    return "[" + ", ".join("'" + w + "'" for w in words) + "]"


WS = "' ' || chr(9) || chr(10) || chr(13)"

# Native rule set over a column ``page_text`` of relation ``{src}``; adds summary (the longest
# sentence), entities (distinct capitalised words), key_points (all sentences), sentiment.
NATIVE = f"""
  SELECT *,
    coalesce(sents[list_position(list_transform(sents, lambda s: length(s)),
                                 list_max(list_transform(sents, lambda s: length(s))))], '')
      AS summary,
    list_distinct(list_filter(ws, lambda w: regexp_matches(w, '^\\p{{Lu}}'))) AS entities,
    sents AS key_points,
    CASE WHEN npos > nneg THEN 'positive' WHEN nneg > npos THEN 'negative' ELSE 'neutral' END
      AS sentiment
  FROM (
    SELECT *,
      len(list_filter(ws, lambda w: list_contains({_sql_list(POSITIVE_WORDS)}, lower(w)))) AS npos,
      len(list_filter(ws, lambda w: list_contains({_sql_list(NEGATIVE_WORDS)}, lower(w)))) AS nneg
    FROM (
      SELECT *,
        list_filter(list_transform(
            regexp_extract_all(coalesce(page_text, ''), '[^.!?]+[.!?]*'),
            lambda s: trim(s, {WS})), lambda s: s <> '') AS sents,
        regexp_split_to_array(coalesce(page_text, ''), '[^\\p{{L}}]+') AS ws
      FROM {{src}}))
"""

CONV_PAGES = """
  SELECT CAST(conv_id AS VARCHAR) AS file_id,
         'src' || CAST(conv_id % 20 AS VARCHAR) AS tenant_id,
         CAST(turn + 1 AS INTEGER) AS page_number, text AS page_text, role, conv_id, turn
  FROM conversations
"""

DOC_PAGES = """
  SELECT CAST(doc_id AS VARCHAR) AS file_id, source AS tenant_id,
         CAST(generate_subscripts(parts, 1) AS INTEGER) AS page_number,
         unnest(parts) AS page_text, CAST(len(parts) AS INTEGER) AS total_pages, doc_id
  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents)
"""

# Stored analysis after a reply round trip (see conversation_pages_stored): accepted replies
# keep the native analysis, rejected ones store the placeholder, 'null' is stored as is,
# system turns store nothing.
CONV_STORED = f"""
  WITH p AS ({CONV_PAGES}),
  n AS ({NATIVE.replace('{src}', 'p')}),
  r AS (
    SELECT *, CAST((conv_id + turn * 3) % 8 AS INTEGER) AS reply_kind,
      CAST(to_json({{'summary': summary, 'entities': entities, 'keyPoints': key_points,
                     'sentiment': sentiment}}) AS VARCHAR) AS j
    FROM n),
  w AS (
    SELECT *, CASE reply_kind
        WHEN 0 THEN j
        WHEN 1 THEN '```json' || chr(10) || j || chr(10) || '```'
        WHEN 2 THEN 'Here is the analysis:' || chr(10) || j || chr(10) || 'Hope this helps.'
        WHEN 3 THEN '[' || j || ',' || j || ']'
        WHEN 4 THEN regexp_replace(j, '\\}}$', '')
        WHEN 5 THEN '[' || j || ']'
        WHEN 6 THEN 'null'
        ELSE regexp_replace(j, ',"', ',' || chr(10) || '"', 'g') END AS reply
    FROM r),
  c AS (
    SELECT *, CASE WHEN regexp_extract(reply, '(?s)\\{{.*\\}}') <> ''
                   THEN regexp_extract(reply, '(?s)\\{{.*\\}}') ELSE reply END AS cand
    FROM w)
  SELECT *,
    CASE WHEN role = 'system' THEN 'missing'
         WHEN vtype IS NULL THEN 'failed'
         WHEN vtype = 'NULL' THEN 'invalid'
         ELSE 'success' END AS outcome,
    (role <> 'system' AND coalesce(vtype <> 'NULL', false)) AS accepted
  FROM (SELECT *, json_type(CASE WHEN json_valid(cand) THEN cand END) AS vtype FROM c)
"""

PROMPT = """
    'Analyze the following text from a single page of a document and provide a structured '
    || 'JSON response.' || chr(10)
    || 'The JSON should include:' || chr(10)
    || '1. "summary": A brief summary of the page content.' || chr(10)
    || '2. "entities": A list of key entities (people, organizations, locations, etc.) '
    || 'mentioned on this page.' || chr(10)
    || '3. "keyPoints": A list of main points discussed on this page.' || chr(10)
    || '4. "sentiment": The overall sentiment of the text.' || chr(10) || chr(10)
    || 'Text:' || chr(10) || coalesce(page_text, '') || chr(10) || chr(10)
    || 'Return ONLY the JSON object.' || chr(10)"""

Q: dict[str, str] = {}

Q["split_pages"] = f"""
  SELECT file_id, tenant_id, page_number, printf('PAGE#%04d', page_number) AS page_key,
         total_pages, CAST(length(page_text) AS BIGINT) AS page_chars
  FROM ({DOC_PAGES})
"""

Q["documents_manifest"] = f"""
  WITH p AS ({DOC_PAGES}), n AS ({NATIVE.replace('{src}', 'p')}),
  f AS (SELECT *, (doc_id * 7 + page_number) % 11 = 0 AS fault FROM n)
  SELECT file_id, tenant_id, CAST(total_pages AS BIGINT) AS total_pages,
         count(*) AS pages_found,
         CAST(count_if(NOT fault) AS BIGINT) AS success_count,
         CAST(count_if(fault) AS BIGINT) AS failed_count,
         CAST(0 AS BIGINT) AS missing_count, CAST(0 AS BIGINT) AS invalid_count,
         'completed' AS document_status,
         CAST(sum(CASE WHEN fault THEN 0 ELSE len(entities) END) AS BIGINT) AS entities,
         CAST(sum(CASE WHEN fault THEN 0 ELSE len(key_points) END) AS BIGINT) AS key_points,
         CAST(count_if(NOT fault AND sentiment = 'positive') AS BIGINT) AS positive_pages,
         CAST(count_if(NOT fault AND sentiment = 'negative') AS BIGINT) AS negative_pages
  FROM f
  GROUP BY file_id, tenant_id, total_pages
"""

Q["page_prompt"] = f"""
  SELECT file_id, page_number,
    CAST(length(pr) AS BIGINT) AS prompt_chars, md5(pr) AS prompt_md5
  FROM (SELECT file_id, page_number,
    {PROMPT} AS pr
  FROM ({CONV_PAGES}))
"""

Q["annotate_pages"] = f"""
  WITH p AS ({CONV_PAGES}), n AS ({NATIVE.replace('{src}', 'p')}),
  f AS (SELECT *, (conv_id * 7 + turn) % 11 = 0 AS fault FROM n)
  SELECT file_id, page_number, printf('PAGE#%04d', page_number) AS page_key,
    CASE WHEN fault THEN 'failed' ELSE 'success' END AS chunk_status,
    CASE WHEN fault THEN NULL ELSE summary END AS summary,
    CAST(CASE WHEN fault THEN 0 ELSE len(entities) END AS BIGINT) AS n_entities,
    CASE WHEN fault THEN NULL ELSE array_to_string(list_sort(entities), ' ') END AS entities,
    CAST(CASE WHEN fault THEN 0 ELSE len(key_points) END AS BIGINT) AS n_key_points,
    CASE WHEN fault THEN NULL ELSE sentiment END AS sentiment,
    CASE WHEN fault THEN 'Analysis failed' END AS error
  FROM f
"""

Q["parse_reply"] = f"""
  SELECT file_id, page_number, reply_kind, outcome,
    CASE WHEN accepted THEN summary END AS summary,
    CAST(CASE WHEN accepted THEN len(entities) ELSE 0 END AS BIGINT) AS n_entities,
    CASE WHEN accepted THEN sentiment END AS sentiment,
    CASE WHEN outcome = 'failed' THEN 'Analysis failed' END AS error
  FROM ({CONV_STORED})
"""

Q["document_manifest"] = f"""
  SELECT file_id, tenant_id, count(*) AS pages_found,
    CAST(count_if(outcome = 'success') AS BIGINT) AS success_count,
    CAST(count_if(outcome = 'failed') AS BIGINT) AS failed_count,
    CAST(count_if(outcome = 'missing') AS BIGINT) AS missing_count,
    CAST(count_if(outcome = 'invalid') AS BIGINT) AS invalid_count,
    CASE WHEN count_if(outcome = 'invalid') > 0 THEN 'failed' ELSE 'completed' END
      AS document_status,
    CASE WHEN count_if(outcome = 'invalid') > 0
      THEN 'Aggregation failed: page analysis is not valid JSON' END AS error_message
  FROM ({CONV_STORED})
  GROUP BY file_id, tenant_id
"""

Q["manifest_chunks"] = f"""
  SELECT file_id, tenant_id, page_number, printf('PAGE#%04d', page_number) AS page_key,
    outcome, CASE WHEN outcome = 'failed' THEN 'failed' ELSE 'success' END AS chunk_status,
    outcome <> 'missing' AS has_analysis,
    CASE WHEN accepted THEN summary END AS summary,
    CAST(CASE WHEN accepted THEN len(entities) ELSE 0 END AS BIGINT) AS n_entities
  FROM ({CONV_STORED})
"""

Q["deferred_documents"] = f"""
  SELECT file_id, pages_found + late AS total_pages, pages_found,
    CASE WHEN late > 0 THEN 'deferred' ELSE 'assemble' END AS action
  FROM (SELECT file_id, count(*) AS pages_found,
          max(CASE WHEN page_number = 1 AND length(page_text) > 80 THEN 1 ELSE 0 END)::BIGINT AS late
        FROM ({CONV_PAGES}) GROUP BY file_id)
"""


def oracle_sql() -> dict[str, str]:
    return dict(Q)


ISO = "'%Y-%m-%dT%H:%M:%S.%gZ'"

EVENT_LOG = """
  SELECT user_id * 100 + day(ts) // 5 AS file_id, ts, event_id AS seq, event_type,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, user_id, value
  FROM events
"""

PROGRESS = f"""
  SELECT file_id, ts, seq,
    CASE WHEN event_type = 'click' THEN CAST(k % 4 + 1 AS INTEGER) END AS page,
    CASE WHEN event_type = 'signup' THEN CAST(k % 4 + 1 AS INTEGER) END AS total,
    CASE event_type WHEN 'view' THEN 'processing' WHEN 'error' THEN 'failed'
                    WHEN 'purchase' THEN 'completed' END AS status
  FROM ({EVENT_LOG})
"""

Q["ready_documents"] = f"""
  SELECT file_id, processed_pages, total_pages, overall_status FROM (
    SELECT file_id, count(DISTINCT page) AS processed_pages,
      CAST(arg_max(total, (ts, seq)) FILTER (WHERE total IS NOT NULL) AS BIGINT) AS total_pages,
      arg_max(status, (ts, seq)) FILTER (WHERE status IS NOT NULL) AS overall_status
    FROM ({PROGRESS}) GROUP BY file_id)
  WHERE processed_pages = total_pages AND total_pages > 0 AND overall_status = 'processing'
"""

# Status fold written the explicit way: find the last put/delete of each key, keep rows after
# it, and read each field from the last row after it that writes the field.
Q["status_fold"] = f"""
  WITH l AS ({EVENT_LOG}),
  o AS (
    SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY ts, seq) AS rn,
      CASE WHEN event_type = 'signup' THEN 'put' WHEN event_type = 'click' THEN 'inc'
           WHEN event_type = 'error' AND k % 10 = 0 THEN 'delete' ELSE 'set' END AS op
    FROM l),
  r AS (
    SELECT *, max(CASE WHEN op IN ('put', 'delete') THEN rn END) OVER (PARTITION BY file_id)
      AS reset_rn,
      max(rn) OVER (PARTITION BY file_id) AS last_rn
    FROM o),
  a AS (SELECT * FROM r WHERE rn >= coalesce(reset_rn, 0)),
  g AS (
    SELECT file_id,
      arg_max(CASE WHEN op = 'put' THEN 'src' || CAST(user_id % 20 AS VARCHAR) END, rn)
        FILTER (WHERE op IN ('put', 'delete')) AS tenant_id,
      arg_max(CASE WHEN op = 'put' THEN 'pending' WHEN op = 'delete' THEN NULL
                   WHEN event_type = 'view' THEN 'processing' ELSE 'failed' END, rn)
        FILTER (WHERE op IN ('put', 'delete') OR event_type = 'view'
                OR (event_type = 'error' AND op = 'set')) AS overall_status,
      arg_max(CASE WHEN op = 'put' THEN k % 4 + 1 END, rn)
        FILTER (WHERE op IN ('put', 'delete')) AS total_pages,
      arg_max(CASE WHEN op = 'set' AND event_type = 'error' THEN 'error ' || CAST(k AS VARCHAR)
              END, rn)
        FILTER (WHERE op IN ('put', 'delete') OR (event_type = 'error' AND op = 'set'))
        AS error_message,
      max(rn) FILTER (WHERE op IN ('put', 'delete') OR event_type = 'purchase') AS abs_rn,
      arg_max(CASE WHEN op = 'put' THEN 0 WHEN event_type = 'purchase' THEN k % 4 + 1 END, rn)
        FILTER (WHERE op IN ('put', 'delete') OR event_type = 'purchase') AS abs_val,
      max(CASE WHEN op = 'put' THEN ts END) AS created,
      max(ts) AS updated,
      arg_max(op, rn) AS last_op
    FROM a GROUP BY file_id),
  i AS (
    SELECT g.file_id, count(a.rn) AS incs_after
    FROM g LEFT JOIN a ON a.file_id = g.file_id AND a.op = 'inc' AND a.rn > coalesce(g.abs_rn, 0)
    GROUP BY g.file_id),
  n AS (SELECT file_id, count(*) AS ops FROM l GROUP BY file_id)
  SELECT g.file_id, tenant_id, overall_status, CAST(total_pages AS BIGINT) AS total_pages,
    CAST(CASE WHEN incs_after = 0 THEN abs_val ELSE coalesce(abs_val, 0) + incs_after END
         AS BIGINT) AS processed_pages,
    error_message, strftime(created, {ISO}) AS created_at, strftime(updated, {ISO}) AS updated_at,
    n.ops,
    coalesce(CASE WHEN incs_after = 0 THEN abs_val ELSE coalesce(abs_val, 0) + incs_after END
             = total_pages AND total_pages > 0 AND overall_status = 'processing', false) AS ready
  FROM g JOIN i ON g.file_id = i.file_id JOIN n ON g.file_id = n.file_id
  WHERE last_op <> 'delete'
"""

CHANGES = f"""
  WITH m AS ({PROGRESS}),
  f AS (
    SELECT *, CASE WHEN page IS NOT NULL AND row_number() OVER (
        PARTITION BY file_id, page ORDER BY ts, seq) = 1 THEN 1 ELSE 0 END AS is_first
    FROM m),
  s AS (
    SELECT *,
      CAST(sum(is_first) OVER w AS BIGINT) AS new_processed,
      last_value(total IGNORE NULLS) OVER w AS new_total,
      last_value(status IGNORE NULLS) OVER w AS new_status,
      row_number() OVER (PARTITION BY file_id ORDER BY ts, seq) AS rn
    FROM f
    WINDOW w AS (PARTITION BY file_id ORDER BY ts, seq
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
  SELECT file_id, seq, ts, rn,
    new_processed - is_first AS old_processed,
    lag(new_total) OVER p AS old_total, lag(new_status) OVER p AS old_status,
    new_processed, new_total, new_status
  FROM s WINDOW p AS (PARTITION BY file_id ORDER BY ts, seq)
"""

Q["change_images"] = f"""
  SELECT file_id, seq, strftime(ts, {ISO}) AS ts, old_processed, old_total, old_status,
    new_processed, new_total, new_status,
    coalesce(new_processed = new_total AND new_total > 0 AND new_status = 'processing', false)
      AS level_trigger
  FROM ({CHANGES}) WHERE rn > 1
"""

Q["completion_transition"] = f"""
  SELECT file_id, seq, strftime(ts, {ISO}) AS ts, new_processed, new_total
  FROM ({CHANGES})
  WHERE rn > 1
    AND coalesce(new_processed = new_total AND new_total > 0 AND new_status = 'processing', false)
    AND NOT coalesce(old_processed = old_total AND old_total > 0 AND old_status = 'processing',
                     false)
"""


NOW_EPOCH = "epoch(TIMESTAMP '2024-02-01 00:00:00')"

FILES = """
  SELECT CAST(doc_id AS VARCHAR) AS file_id, source AS tenant_id,
    'doc-' || CAST(doc_id AS VARCHAR) || '.txt' AS file_name, n_chars AS file_size,
    TIMESTAMP '2023-09-01 00:00:00' + to_days(CAST((doc_id * 131) % 150 AS INTEGER))
      + to_minutes(CAST(doc_id % 1440 AS BIGINT)) AS uploaded_at,
    doc_id
  FROM documents
"""

Q["file_catalog_route"] = f"""
  SELECT file_id, tenant_id, 'FILE#' || file_id AS pk, 'METADATA' AS sk,
    'TENANT#' || tenant_id AS gsi1pk, 'FILE#' || strftime(uploaded_at, {ISO}) AS gsi1sk,
    tenant_id || '/' || file_id || '/' || file_name AS s3_key,
    CASE WHEN doc_id % 3 IN (0, 1) THEN 'pdfs' ELSE 'tenant-bucket' END
      AS s3_bucket,
    CASE WHEN file_size >= 0.00390625 * 1048576 THEN 'async' ELSE 'sync' END AS processing_type,
    'uploaded' AS status,
    CAST({NOW_EPOCH} AS BIGINT) + 90 * 86400 AS ttl
  FROM ({FILES})
"""

Q["upload_validation"] = f"""
  SELECT file_id,
    NOT (doc_id % 17 = 0 OR doc_id % 13 IN (0, 1)) AS valid,
    CASE WHEN doc_id % 17 = 0 THEN 'No file uploaded'
         WHEN doc_id % 13 IN (0, 1) THEN 'Tenant ID is required' END AS reject_reason
  FROM ({FILES})
"""

Q["missing_files"] = f"""
  SELECT file_id, tenant_id || '/' || file_id || '/' || file_name AS s3_key,
    doc_id IN (SELECT doc_id FROM labels) AS exists
  FROM ({FILES})
"""

Q["retention_actions"] = f"""
  SELECT file_id, age_days,
    CASE WHEN age_days >= 90 THEN 'expire' ELSE 'keep' END AS document_action,
    age_days - 1 AS result_age_days,
    CASE WHEN age_days - 1 >= 30 THEN 'archive' ELSE 'keep' END AS result_action,
    ttl, ttl > CAST({NOW_EPOCH} AS BIGINT) AS live
  FROM (
    SELECT file_id,
      CAST(floor(({NOW_EPOCH} - epoch(uploaded_at)) / 86400) AS BIGINT) AS age_days,
      CAST(epoch(uploaded_at) AS BIGINT) + 90 * 86400 AS ttl
    FROM ({FILES}))
"""

Q["tenant_recent_50"] = f"""
  SELECT tenant_id, rank, file_id, file_name, 'uploaded' AS status,
    strftime(uploaded_at, {ISO}) AS uploaded_at
  FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id
                                     ORDER BY uploaded_at DESC, file_id ASC) AS rank
        FROM ({FILES}))
  WHERE rank <= 50
"""

Q["tenant_documents"] = f"""
  WITH l AS ({EVENT_LOG}),
  o AS (
    SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY ts, seq) AS rn,
      CASE WHEN event_type = 'signup' THEN 'put' WHEN event_type = 'click' THEN 'inc'
           WHEN event_type = 'error' AND k % 10 = 0 THEN 'delete' ELSE 'set' END AS op
    FROM l),
  r AS (SELECT *, max(CASE WHEN op IN ('put', 'delete') THEN rn END)
                    OVER (PARTITION BY file_id) AS reset_rn FROM o),
  g AS (
    SELECT file_id,
      arg_max(CASE WHEN op = 'put' THEN 'src' || CAST(user_id % 20 AS VARCHAR) END, rn)
        FILTER (WHERE op IN ('put', 'delete')) AS tenant_id,
      arg_max(CASE WHEN op = 'put' THEN 'pending' WHEN op = 'delete' THEN NULL
                   WHEN event_type = 'view' THEN 'processing' ELSE 'failed' END, rn)
        FILTER (WHERE op IN ('put', 'delete') OR event_type = 'view'
                OR (event_type = 'error' AND op = 'set')) AS overall_status,
      max(CASE WHEN op = 'put' THEN ts END) AS created, max(ts) AS updated,
      arg_max(op, rn) AS last_op
    FROM r WHERE rn >= coalesce(reset_rn, 0) GROUP BY file_id),
  t AS (
    SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY updated DESC, file_id ASC)
      AS rank
    FROM g WHERE last_op <> 'delete' AND tenant_id IS NOT NULL)
  SELECT tenant_id, rank, file_id, overall_status, strftime(created, {ISO}) AS created_at,
    strftime(updated, {ISO}) AS updated_at
  FROM t WHERE rank <= 50
"""

LABEL_STATUS = """
  SELECT CAST(doc_id AS VARCHAR) AS file_id, doc_id,
    CASE WHEN quality = 1 AND toxic = 0 THEN 'completed' WHEN toxic = 1 THEN 'failed'
         ELSE 'processing' END AS status,
    doc_id % 9 + 1 AS total,
    TIMESTAMP '2023-09-01 00:00:00' + to_days(CAST((doc_id * 131) % 150 AS INTEGER))
      + to_minutes(CAST(doc_id % 1440 AS BIGINT)) AS up
  FROM labels
"""

Q["job_view"] = f"""
  SELECT s.file_id, f.file_name, s.status,
    CAST(CASE WHEN s.status = 'completed' THEN total ELSE s.doc_id % (total + 1) END AS BIGINT)
      AS processed,
    CAST(total AS BIGINT) AS total, CAST(0 AS BIGINT) AS failed,
    strftime(f.uploaded_at, {ISO}) AS uploaded,
    strftime(up + INTERVAL 5 MINUTE, {ISO}) AS started,
    CASE WHEN s.status = 'completed' THEN strftime(up + INTERVAL 1 HOUR, {ISO}) END AS completed,
    CASE WHEN s.status = 'completed'
      THEN 'src' || CAST(s.doc_id % 20 AS VARCHAR) || '/' || s.file_id || '/results.json'
    END AS result_s3_key,
    round(CAST(CASE WHEN s.status = 'completed' THEN total ELSE s.doc_id % (total + 1) END
               AS DOUBLE) * 100.0 / total, 2) AS percent
  FROM ({LABEL_STATUS}) s
  LEFT JOIN ({FILES}) f ON s.file_id = f.file_id
"""

Q["results_available"] = f"""
  SELECT file_id, tenant_id,
    doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0) AS available
  FROM ({FILES})
"""

Q["single_table"] = f"""
  SELECT pk, sk, kind, tenant_id, file_name, page_number, starts_with(sk, 'PAGE#') AS is_page
  FROM (
    SELECT 'FILE#' || file_id AS pk, 'METADATA' AS sk, tenant_id, file_name, 'file' AS kind
    FROM ({FILES})
    UNION ALL BY NAME
    SELECT 'DOC#' || file_id AS pk, printf('PAGE#%04d', page_number) AS sk, tenant_id,
      page_number, 'page' AS kind
    FROM ({CONV_PAGES}))
"""


Q["event_envelope"] = f"""
  SELECT seq,
    CASE WHEN event_type = 'click' THEN tenant || '#' || fid ELSE tenant END AS key,
    CASE WHEN bad THEN NULL WHEN event_type = 'signup' THEN 'document.uploaded'
         WHEN event_type = 'click' THEN 'chunk.ready' ELSE 'document.status' END AS event_type,
    CASE WHEN bad THEN 'quarantine' WHEN event_type = 'signup' THEN 'process' ELSE 'ignore' END
      AS disposition,
    CASE WHEN bad THEN NULL WHEN event_type = 'signup' AND k % 7 = 0
         THEN 'override-' || CAST(seq AS VARCHAR) ELSE fid END AS file_id,
    CASE WHEN bad THEN NULL ELSE tenant END AS tenant_id,
    CASE WHEN NOT bad AND event_type = 'signup'
         THEN tenant || '/' || fid || '/doc-' || fid || '.pdf' END AS s3_key,
    CASE WHEN NOT bad AND event_type = 'signup'
         THEN CASE WHEN k % 3 = 0 THEN 'pdfs' ELSE 'bucket-a' END
    END AS bucket,
    CASE WHEN NOT bad AND event_type = 'click' THEN 'BIGINT' END AS page_number_type
  FROM (SELECT *, CAST(file_id AS VARCHAR) AS fid,
          'src' || CAST(user_id % 20 AS VARCHAR) AS tenant, seq % 101 = 0 AS bad
        FROM ({EVENT_LOG}))
"""

Q["chunk_batches"] = """
  SELECT document, l_orderkey, l_linenumber, l_partkey, chunk_index,
    (chunk_index - 1) // 500 AS batch_id, CAST((chunk_index - 1) % 500 AS INTEGER) AS batch_index
  FROM (
    SELECT l_suppkey AS document, l_orderkey, l_linenumber, l_partkey,
      row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey,
                                                       l_shipdate, l_extendedprice)
        AS chunk_index
    FROM lineitem)
"""

Q["publish_report"] = f"""
  WITH r AS (
    SELECT 'src' || CAST(user_id % 20 AS VARCHAR) AS tenant_id,
      row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts, seq) - 1 AS pos
    FROM ({EVENT_LOG})),
  o AS (
    SELECT 'src' || CAST(o_custkey % 20 AS VARCHAR) AS tenant_id, o_orderstatus = 'P' AS bad,
      row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderkey) - 1 AS pos
    FROM orders)
  SELECT tenant_id, pos // 500 AS batch_id, count(*) AS records,
    CAST(count(*) - count_if(coalesce(bad, false)) AS BIGINT) AS success_count,
    CAST(count_if(coalesce(bad, false)) AS BIGINT) AS failed_count, CAST(NULL AS VARCHAR) AS error
  FROM r LEFT JOIN o USING (tenant_id, pos)
  GROUP BY tenant_id, batch_id
"""

Q["error_alarm"] = f"""
  SELECT strftime(ws, {ISO}) AS window_start,
    strftime(ws + INTERVAL 6 HOUR, {ISO}) AS window_end,
    count(*) AS metric, count(*) > 10 AS alarm
  FROM (SELECT TIMESTAMP '1970-01-01 00:00:00'
               + to_seconds(CAST(floor(epoch(ts) / 21600) * 21600 AS BIGINT)) AS ws
        FROM events WHERE event_type = 'error')
  GROUP BY ws
"""


Q["document_lifecycle"] = f"""
  WITH d AS ({DOC_PAGES}), p AS ({NATIVE.replace('{src}', 'd')}),
  f AS (SELECT * FROM ({FILES}) WHERE NOT (doc_id % 17 = 0 OR doc_id % 13 IN (0, 1)))
  SELECT f.file_id, f.tenant_id,
    CASE WHEN f.file_size >= 0.00390625 * 1048576 THEN 'async' ELSE 'sync' END
      AS processing_type,
    CAST(max(p.total_pages) AS BIGINT) AS total_pages,
    CAST(count(*) AS BIGINT) AS success_count, CAST(0 AS BIGINT) AS failed_count,
    CAST(0 AS BIGINT) AS missing_count,
    f.tenant_id || '/' || f.file_id || '/results.json' AS result_key,
    CAST(sum(len(p.entities)) AS BIGINT) AS entities
  FROM f JOIN p ON p.file_id = f.file_id
  GROUP BY f.file_id, f.tenant_id, f.file_size
"""


Q["chunk_fanout"] = f"""
  SELECT tenant_id || '#' || file_id AS key, file_id, 'chunk.ready' AS event_type,
    'ignore' AS disposition, count(*) AS events, CAST(max(page_number) AS BIGINT) AS max_page
  FROM ({DOC_PAGES})
  GROUP BY tenant_id, file_id
"""


Q["ready_documents_compat"] = f"""
  SELECT file_id, processed_pages, total_pages, overall_status FROM (
    SELECT file_id, count(page) AS processed_pages,
      CAST(arg_max(total, (ts, seq)) FILTER (WHERE total IS NOT NULL) AS BIGINT) AS total_pages,
      arg_max(status, (ts, seq)) FILTER (WHERE status IS NOT NULL) AS overall_status
    FROM ({PROGRESS}) GROUP BY file_id)
  WHERE processed_pages = total_pages AND total_pages > 0 AND overall_status = 'processing'
"""

Q["tenant_documents_compat"] = Q["tenant_documents"].replace(
    "ORDER BY updated DESC, file_id ASC", "ORDER BY created DESC, file_id ASC")


# A rewrite of the documents that had a failed page leaves every page annotated; those were
# written by run 2, the others by run 1.
Q["result_round_trip"] = f"""
  SELECT file_id, tenant_id, CASE WHEN bool_or(fault) THEN '2' ELSE '1' END AS run_id,
    count(*) AS total_pages, count(*) AS success_count, CAST(0 AS BIGINT) AS failed_count,
    count(*) AS chunks, tenant_id || '/' || file_id || '/results.json' AS result_key
  FROM (SELECT *, (conv_id * 7 + turn) % 11 = 0 AS fault FROM ({CONV_PAGES}))
  GROUP BY file_id, tenant_id
"""

TWICE = f"""
  SELECT * FROM ({PROGRESS})
  UNION ALL
  SELECT file_id, ts + INTERVAL 40 DAY AS ts, seq, page, total, status FROM ({PROGRESS})
"""

Q["replayed_progress"] = f"""
  SELECT file_id, max(new_processed) AS processed, count(*) AS changes,
    CAST(count_if(rn > 1
      AND coalesce(new_processed = new_total AND new_total > 0 AND new_status = 'processing', false)
      AND NOT coalesce(old_processed = old_total AND old_total > 0 AND old_status = 'processing',
                       false)) AS BIGINT) AS transitions
  FROM ({CHANGES.replace(PROGRESS, TWICE)})
  GROUP BY file_id
"""

Q["annotate_callable"] = f"""
  SELECT file_id, page_number,
    CAST(CASE WHEN n % 5 = 0 THEN 1 WHEN n % 7 = 0 THEN 4 ELSE n % 3 + 1 END AS BIGINT) AS attempts,
    CASE WHEN n % 5 = 0 OR n % 7 = 0 THEN 'failed' ELSE 'success' END AS chunk_status,
    CASE WHEN n % 5 <> 0 AND n % 7 <> 0 THEN CAST(n AS VARCHAR) || ' characters' END AS summary,
    CASE WHEN n % 5 = 0 OR n % 7 = 0 THEN 'Analysis failed' END AS error
  FROM (SELECT file_id, page_number, length({PROMPT}) AS n FROM ({CONV_PAGES}))
"""

Q["failed_documents"] = f"""
  SELECT CAST(doc_id AS VARCHAR) AS file_id, source AS tenant_id, 'failed' AS overall_status,
    CAST(NULL AS VARCHAR) AS error_message
  FROM documents WHERE text IS NULL
  UNION ALL
  SELECT file_id, tenant_id, 'failed', 'Aggregation failed: page analysis is not valid JSON'
  FROM ({CONV_STORED}) GROUP BY file_id, tenant_id HAVING count_if(outcome = 'invalid') > 0
"""

Q["upload_ids"] = f"""
  SELECT file_id, sha256(concat_ws('/', tenant_id, file_name,
    strftime(uploaded_at, '%Y-%m-%d %H:%M:%S'))) AS upload_id
  FROM ({FILES})
"""

Q["point_get"] = f"""
  SELECT file_id, 'src1' AS tenant_id, status AS overall_status,
    'src1/' || file_id || '/results.json' AS result_key
  FROM ({LABEL_STATUS}) WHERE doc_id % 20 = 1 AND status = 'completed'
"""


Q["status_fold_incremental"] = Q["status_fold"]

Q["tenant_recent_maintained"] = f"""
  SELECT tenant_id, rank, file_id, file_name, strftime(uploaded_at, {ISO}) AS uploaded_at
  FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id
                                     ORDER BY uploaded_at DESC, file_id ASC) AS rank
        FROM ({FILES}) WHERE doc_id % 5 <> 1)
  WHERE rank <= 50
"""

Q["point_get_keys"] = f"""
  SELECT file_id, 'src' || CAST(doc_id % 20 AS VARCHAR) AS tenant_id, status AS overall_status,
    CASE WHEN status = 'completed'
      THEN 'src' || CAST(doc_id % 20 AS VARCHAR) || '/' || file_id || '/results.json'
    END AS result_key
  FROM ({LABEL_STATUS}) WHERE doc_id % 97 = 0 AND doc_id IN (SELECT doc_id FROM documents)
"""

# Runs 9 and 10 instead of 1 and 2; the killed run is not there.
Q["result_commits"] = f"""
  SELECT file_id, tenant_id, CASE WHEN bool_or(fault) THEN '10' ELSE '9' END AS run_id,
    count(*) AS total_pages, count(*) AS success_count, CAST(0 AS BIGINT) AS failed_count,
    count(*) AS chunks, tenant_id || '/' || file_id || '/results.json' AS result_key
  FROM (SELECT *, (conv_id * 7 + turn) % 11 = 0 AS fault FROM ({CONV_PAGES}))
  GROUP BY file_id, tenant_id
"""

Q["annotate_resumable"] = Q["annotate_callable"]

Q["publish_retries"] = f"""
  WITH RECURSIVE w AS (
    SELECT 'src' || CAST(user_id % 20 AS VARCHAR) AS tenant_id, ts, seq, 1 AS attempt,
      (row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts, seq) - 1) % 500 AS place
    FROM ({EVENT_LOG})
    UNION ALL
    SELECT tenant_id, ts, seq, attempt + 1,
      (row_number() OVER (PARTITION BY tenant_id ORDER BY ts, seq) - 1) % 500
    FROM w WHERE attempt < 4 AND (place + 3 * attempt) % 4 = 0)
  SELECT seq, tenant_id, CAST(attempt AS BIGINT) AS attempts,
    CASE WHEN (place + 3 * attempt) % 4 = 0 THEN 'dead' ELSE 'sent' END AS status
  FROM w WHERE attempt = 4 OR (place + 3 * attempt) % 4 <> 0
"""

Q["alarm_transitions"] = f"""
  WITH c AS (SELECT date_trunc('hour', ts) AS h, count(*) AS n FROM events
             WHERE event_type = 'error' GROUP BY 1),
  axis AS (SELECT unnest(generate_series(min(h), max(h), INTERVAL 1 HOUR)) AS h FROM c),
  s AS (SELECT axis.h, coalesce(n, 0) AS metric, row_number() OVER (ORDER BY axis.h) AS nr,
               CASE WHEN coalesce(n, 0) > 2 THEN 'ALARM' ELSE 'OK' END AS to_state
        FROM axis LEFT JOIN c ON c.h = axis.h),
  e AS (SELECT *, lag(to_state, 1, 'OK') OVER (ORDER BY nr) AS from_state FROM s)
  SELECT strftime(h, {ISO}) AS window_start, CAST(metric AS BIGINT) AS metric, from_state, to_state,
    CAST(nr - lag(nr, 1, 1) OVER (ORDER BY nr) AS BIGINT) AS lasted
  FROM e WHERE from_state <> to_state
"""
Q["stream_alarm_transitions"] = Q["alarm_transitions"]

Q["retention_applied"] = f"""
  SELECT file_id, tenant_id, CASE WHEN uploaded_at + INTERVAL 90 DAY <= TIMESTAMP '2024-02-01'
                                  THEN 'archived' ELSE 'kept' END AS state
  FROM ({FILES})
"""

Q["split_pages_large"] = """
  SELECT file_id, CAST(generate_subscripts(parts, 1) AS INTEGER) AS page_number,
    CAST(len(parts) AS INTEGER) AS total_pages, CAST(length(unnest(parts)) AS BIGINT) AS page_chars,
    md5(unnest(parts)) AS page_md5
  FROM (SELECT md5(coalesce(source, '')) AS file_id,
          string_split(string_agg(text, chr(10) ORDER BY doc_id) || chr(10), chr(10)) AS parts
        FROM documents WHERE text IS NOT NULL GROUP BY source)
"""

Q["stream_change_images"] = Q["change_images"]
