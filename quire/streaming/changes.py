"""Live change feed (ST2, W3): old and new image of a document's status at every change, and whether
the change completes it, emitted inside the stream in event order.

Documents are hashed into ``BUCKETS`` buckets, and a bucket is what Spark keeps state of: a call
works on the rows of all its documents as arrays, where a call per document would cost more than its
few rows. Rows wait in the state until the watermark has passed them; an event-time timer then emits
them by (ts, seq) within their document, so files that arrive interleaved give the images of an
ordered log. State is three tables per bucket: the waiting rows, the (document, page) pairs seen, and
a row per document with its latest total and status. Where ``retention`` is given, a document's state
goes that long after its last change, and a later change is an INSERT again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quire.functions.keys import STATUS_SK, doc_pk
from quire.session import start_with_partitions

BUCKETS = 512
IMAGES = ("file_id long, us long, seq long, op string, old_processed long, old_total int,"
          " old_status string, new_processed long, new_total int, new_status string, edge boolean")
_NONE = np.iinfo(np.int64).min      # stands for null in the integer columns
_WAIT = ("file_id", "us", "seq", "page", "total", "status")
_DOCS = ("file_id", "processed", "total", "status", "rows", "due")
_PAGES = ("file_id", "page")
_LZ4 = pa.ipc.IpcWriteOptions(compression="lz4")


def _pack(table: dict[str, np.ndarray]) -> bytes:
    batch = pa.record_batch({c: pa.array(v, pa.string() if v.dtype == object else pa.int64())
                             for c, v in table.items()})
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=_LZ4) as w:
        w.write_batch(batch)
    return out.getvalue().to_pybytes()


def _unpack(blob: bytes) -> dict[str, np.ndarray]:
    t = pa.ipc.open_stream(blob).read_all()
    return {c: t[c].to_numpy() for c in t.column_names}


def _empty(names: tuple[str, ...]) -> dict[str, np.ndarray]:
    return {c: np.zeros(0, object if c == "status" else np.int64) for c in names}


def _rows(table: dict[str, np.ndarray], at: np.ndarray) -> dict[str, np.ndarray]:
    return {c: v[at] for c, v in table.items()}


def _joined(tables: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return {c: np.concatenate([t[c] for t in tables]) for c in tables[0]}


def _latest(value: np.ndarray, known: np.ndarray, start: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Last known value up to and including every row of its document, else the held one; ``start``
    is the first row of every row's document."""
    at = np.maximum.accumulate(np.where(known, np.arange(len(value)), -1))
    return np.where(at >= start, value[at], held)


def _before(now: np.ndarray, first: np.ndarray, held: np.ndarray) -> np.ndarray:
    """The value of the row before, the held one at the first row of a document."""
    return np.where(first, held, np.roll(now, 1))


def _ready(processed: np.ndarray, total: np.ndarray, status: np.ndarray) -> np.ndarray:
    return (total > 0) & (processed == total) & (status == "processing")


def _nullable(v: np.ndarray, kind: str) -> pd.Series:
    gone = v == _NONE
    return pd.Series(np.where(gone, 0, v)).astype(kind).mask(gone)


def _emitted(new: dict, docs: dict, pages: dict) -> tuple[pd.DataFrame, dict, dict]:
    """Images of rows sorted by (document, us, seq), and the documents and pages after them; their
    ``due`` is left to the caller."""
    n = len(new["us"])
    first = np.ones(n, dtype=bool)
    first[1:] = new["file_id"][1:] != new["file_id"][:-1]
    starts = np.flatnonzero(first)
    of = np.cumsum(first) - 1
    start = starts[of]
    ids = new["file_id"][starts]

    # what is held of these documents
    was = {c: np.full(len(ids), None if c == "status" else 0 if c in ("processed", "rows") else _NONE,
                      dtype=v.dtype) for c, v in docs.items()}
    if len(docs["file_id"]):
        at = np.minimum(np.searchsorted(docs["file_id"], ids), len(docs["file_id"]) - 1)
        known = docs["file_id"][at] == ids
        for c, v in docs.items():
            was[c] = np.where(known, v[at], was[c])

    # completions of pages not seen before
    done = np.flatnonzero(new["page"] != _NONE)
    seen = _joined([pages, _rows({c: new[c] for c in _PAGES}, done)])
    fresh = ~pd.DataFrame(seen).duplicated().to_numpy()
    added = np.zeros(n, dtype=np.int64)
    added[done] = fresh[len(pages["page"]):]
    run = np.cumsum(added)
    processed = run - (run - added)[start] + was["processed"][of]

    total = _latest(new["total"], new["total"] != _NONE, start, was["total"][of])
    status = _latest(new["status"], pd.notna(new["status"]), start, was["status"][of])
    number = np.arange(n) - start + was["rows"][of]
    old_processed = _before(processed, first, was["processed"][of])
    old_total = _before(total, first, was["total"][of])
    old_status = _before(status, first, was["status"][of])
    edge = _ready(processed, total, status) & (
        (number == 0) | ~_ready(old_processed, old_total, old_status))
    out = pd.DataFrame({
        "file_id": new["file_id"], "us": _nullable(new["us"], "Int64"),
        "seq": _nullable(new["seq"], "Int64"), "op": np.where(number == 0, "INSERT", "MODIFY"),
        "old_processed": old_processed, "old_total": _nullable(old_total, "Int32"),
        "old_status": old_status, "new_processed": processed,
        "new_total": _nullable(total, "Int32"), "new_status": status, "edge": edge})

    ends = np.append(starts[1:], n) - 1
    now = {"file_id": ids, "processed": processed[ends], "total": total[ends],
           "status": status[ends], "rows": number[ends] + 1, "due": new["us"][ends] // 1000}
    rest = ~np.isin(docs["file_id"], ids)
    docs = _joined([_rows(docs, rest), now])
    return out, _rows(docs, np.argsort(docs["file_id"])), _rows(seen, fresh)


def _images(retention_ms: int | None, buckets: int) -> Callable:
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            of, *blobs = state.get
            if of != buckets:
                raise ValueError(f"the checkpoint was started with {of} buckets, not {buckets}")
            wait, docs, pages = map(_unpack, blobs)
        else:
            wait, docs, pages = map(_empty, (_WAIT, _DOCS, _PAGES))
        if not state.hasTimedOut:
            wait = _joined([wait, *({c: b[c].to_numpy(object if c == "status" else np.int64)
                                     for c in _WAIT} for b in batches)])
        mark = state.getCurrentWatermarkMs()
        wait = _rows(wait, np.lexsort((wait["seq"], wait["us"], wait["file_id"])))
        past = wait["us"] // 1000 < mark
        out = None
        if past.any():
            new, wait = _rows(wait, past), _rows(wait, ~past)
            out, docs, pages = _emitted(new, docs, pages)
        timers = wait["us"] // 1000
        if retention_ms is not None:
            changed = (np.isin(docs["file_id"], new["file_id"]) if out is not None
                       else np.zeros(len(docs["due"]), dtype=bool))
            # emitted rows left the time of the last one; until the next the timer stands
            docs["due"] = np.where(changed, np.maximum(docs["due"] + retention_ms, mark + 1),
                                   docs["due"])
            idle = ~np.isin(docs["file_id"], wait["file_id"])
            gone = idle & ~changed & (docs["due"] < mark)
            pages = _rows(pages, ~np.isin(pages["file_id"], docs["file_id"][gone]))
            docs, idle = _rows(docs, ~gone), idle[~gone]
            timers = np.concatenate([timers, docs["due"][idle]])
        if not len(docs["file_id"]) and not len(wait["file_id"]):
            state.remove()
        else:
            if len(timers):
                state.setTimeoutTimestamp(max(int(timers.min()), mark + 1))
            state.update((buckets, _pack(wait), _pack(docs), _pack(pages)))
        if out is not None:
            if key[0] < 0:
                out["file_id"] = pd.array([None] * len(out), dtype="Int64")
            yield out

    return run


def change_feed(progress: DataFrame, late: str, retention: str | None = None,
                buckets: int = BUCKETS) -> DataFrame:
    """Images over a stream of progress rows (file_id, ts, seq, page, total, status). ``late`` is how
    much later than the newest row one may arrive and still take its place in order; rows later than
    that are dropped by the stream. ``buckets`` is fixed by the checkpoint at the first start: a
    bucket's state is read and written whole when one of its documents has rows, so there should be
    more of them for many millions of documents. Columns as ``log.change_images``, and ``edge``: the
    change makes the document ready."""
    session = progress.sparkSession
    ms = None
    if retention is not None:
        span = session.sql(f"SELECT CAST(INTERVAL {retention} AS INTERVAL DAY TO SECOND) AS x")
        ms = int(span.first()[0].total_seconds() * 1000)
    none = F.lit(int(_NONE))
    # documents without an id are one document, in a bucket of its own
    bucket = F.when(F.col("file_id").isNull(), -1).otherwise(
        F.pmod(F.xxhash64("file_id"), F.lit(buckets))).cast("int")
    rows = (progress.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
            .select(bucket.alias("bucket"), F.coalesce("file_id", F.lit(0)).cast("long").alias("file_id"),
                    "ts", F.coalesce(F.unix_micros("ts"), none).alias("us"),
                    *[F.coalesce(F.col(c).cast("long"), none).alias(c)
                      for c in ("seq", "page", "total")],
                    F.when(F.col("status") != "", F.col("status")).alias("status")))
    images = rows.groupBy("bucket").applyInPandasWithState(
        _images(ms, buckets), IMAGES, "buckets int, wait binary, docs binary, pages binary", "append",
        GroupStateTimeout.EventTimeTimeout)
    return images.select(
        "file_id", F.timestamp_micros("us").alias("ts"), "seq", "op", doc_pk("file_id").alias("pk"),
        F.lit(STATUS_SK).alias("sk"), "old_processed", "old_total", "old_status", "new_processed",
        "new_total", "new_status", "edge")


def start_change_feed(progress: DataFrame, out: str, checkpoint: str, late: str,
                      retention: str | None = None, available_now: bool = True,
                      state_partitions: int | None = None, buckets: int = BUCKETS) -> StreamingQuery:
    """Writes the feed to Parquet under ``out``; the file sink commits each batch once."""
    w = (change_feed(progress, late, retention, buckets).writeStream.format("parquet")
         .outputMode("append").option("path", out).option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="5 seconds")
    return start_with_partitions(w, progress.sparkSession, state_partitions)
