"""Append-only change log and the state derived from it.

A record is never updated in place: every mutation is a log row ``(file_id, ts, seq, op,
fields, inc)`` and the table is a fold of its log. Ops:

* ``put``    replaces the whole record (fields not given become NULL)
* ``set``    writes the given fields only; others keep their value
* ``inc``    adds ``inc`` to the counter, starting from 0 when it is unset
* ``delete`` removes the record; a later set/inc creates a new record holding only what it
             writes

Every fold here is a ``groupBy(key)`` of partially aggregatable functions (``max_by`` over the
position ``(ts, seq)``, counts, sums), so a key with a huge log is reduced on the map side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.keys import STATUS_SK, doc_pk, page_sk
from quire.functions.lifecycle import ready
from quire.operators.scan import keyed_scan, with_segment

RESETS = ("put", "delete")


def _pos(order: Sequence[str] = ("ts", "seq")) -> Column:
    return F.struct(*[F.col(c) for c in order])


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                   tombstone: Column | None = None) -> DataFrame:
    """Last write wins per key (W2): the row with the greatest ``order`` per ``keys``.

    Implemented as ``max_by(struct(row), struct(order))``, which Spark aggregates partially on
    the map side (a ranking window would put every version of a key in one task). Rows where
    ``tombstone`` is true delete the key.
    """
    cols = [c for c in df.columns]
    row = F.struct(*[F.col(c) for c in cols])
    agg = df.groupBy(*keys).agg(F.max_by(row, _pos(order)).alias("_lw_row"))
    out = agg.select("_lw_row.*")
    if tombstone is not None:
        # evaluate the tombstone on the surviving row
        out = out.filter(~F.coalesce(tombstone, F.lit(False)))
    return out


def fold(log: DataFrame, fields: Sequence[str], counter: str | None = None,
         key: str = "file_id", order: Sequence[str] = ("ts", "seq"),
         n_segments: int | None = None) -> DataFrame:
    """Fold a change log into one row per live key.

    For each field: the value written by the latest row that touches it (a put or delete
    touches every field; a set touches the fields it names with a value, a null value is left
    out as an undefined one is). The counter is its latest absolute value (put, delete or set)
    plus the increments after it. Output: key, the fields (strings), the counter,
    ``created_at`` (latest put), ``updated_at`` (latest row), ``ops`` (rows folded).

    With a counter the log is cut into order segments (see ``scan``): each (key, segment) is
    summarised on its own, so a key with a third of the log is many small groups, and one pass
    over the log is enough. Per key only its segment summaries meet.
    """
    pos = _pos(order)
    op = F.col("op")
    is_reset = op.isin(*RESETS)

    def touches(f: str) -> Column:
        return is_reset | ((op == "set") & F.col("fields")[f].isNotNull())

    when = {f: F.when(touches(f), pos) for f in fields}
    value = {f: F.when(op != "delete", F.col("fields")[f]) for f in fields}
    first = [
        F.max(F.struct(pos.alias("p"), op.alias("v"))).alias("_last"),
        F.max(F.col(order[0])).alias("updated_at"),
        F.max(F.when(is_reset, F.struct(pos.alias("p"), F.when(
            op == "put", F.col(order[0])).alias("v")))).alias("_created"),
        F.count(F.lit(1)).alias("ops"),
        *[F.max(F.when(when[f].isNotNull(), F.struct(when[f].alias("p"), value[f].alias("v"))))
          .alias(f"_f_{f}") for f in fields],
    ]
    again = [F.max("_last").alias("_last"), F.max("updated_at").alias("updated_at"),
             F.max("_created").alias("_created"), F.sum("ops").alias("ops"),
             *[F.max(f"_f_{f}").alias(f"_f_{f}") for f in fields]]
    if counter:
        rows = with_segment(log, "_seg", order, n_segments, [key])
        group = Window.partitionBy(key, "_seg")
        rows = rows.withColumn("_abs", F.max(F.when(touches(counter), pos)).over(group))
        number = F.when(op != "delete", F.col("fields")[counter]).try_cast("long")
        late = (op == "inc") & F.coalesce(pos > F.col("_abs"), F.lit(True))
        parts = rows.groupBy(key, "_seg").agg(
            *first, F.max(F.when(touches(counter), F.struct(pos.alias("p"), number.alias("v"))))
            .alias("_abs"), F.sum(F.when(late, F.col("inc"))).alias("_inc"))
        # increments count from the segment of the key's last absolute value on
        has = F.max(F.when(F.col("_abs").isNotNull(), F.col("_seg"))).over(Window.partitionBy(key))
        parts = parts.withColumn("_inc", F.when(
            F.coalesce(F.col("_seg") >= has, F.lit(True)), F.col("_inc")))
        state = parts.groupBy(key).agg(*again, F.max("_abs").alias("_abs"),
                                       F.sum("_inc").alias("_inc"))
        state = state.withColumn(counter, F.when(
            F.col("_inc").isNull(), F.col("_abs.v"))
            .otherwise(F.coalesce(F.col("_abs.v"), F.lit(0)) + F.col("_inc")))
    else:
        state = log.groupBy(key).agg(*first)
    live = state.filter(F.col("_last.v") != "delete")
    extra = [counter] if counter else []
    return live.select(key, "updated_at", F.col("_created.v").alias("created_at"), "ops",
                       *[F.col(f"_f_{f}.v").alias(f) for f in fields], *extra)


def document_progress(log: DataFrame, compat: bool = False) -> DataFrame:
    """Progress per document (A2, A3) from page completions, totals and status changes.

    Input rows: ``file_id, ts, seq`` plus nullable ``page`` (a page finished), ``total`` (a
    page count was recorded) and ``status`` (a status was set). ``processed_pages`` counts
    distinct finished pages, so replayed completions are harmless; ``compat=True`` counts every
    completion, the literal counter that over-counts on replay.
    """
    pos = _pos()
    page = F.col("page")
    processed = F.count(page) if compat else F.count_distinct(page)
    return log.groupBy("file_id").agg(
        processed.cast("long").alias("processed_pages"),
        F.max_by(F.col("total"), F.when(F.col("total").isNotNull(), pos))
        .cast("long").alias("total_pages"),
        F.max_by(F.col("status"), F.when(F.col("status").isNotNull(), pos)).alias("overall_status"),
    ).withColumn("ready", ready("processed_pages", "total_pages", "overall_status"))


def first_completions(log: DataFrame) -> DataFrame:
    """Mark each page completion that is the first for its (document, page). A completion is
    matched by its full position: sequence numbers may start again in every run."""
    firsts = (log.filter(F.col("page").isNotNull())
              .groupBy("file_id", "page").agg(F.min(_pos()).alias("_first"))
              .select("file_id", F.col("_first.ts").alias("ts"), F.col("_first.seq").alias("seq"),
                      "page", F.lit(1).alias("is_first")))
    return (log.join(firsts, ["file_id", "ts", "seq", "page"], "left")
            .withColumn("is_first", F.coalesce(F.col("is_first"), F.lit(0))))


def change_images(log: DataFrame, n_segments: int | None = None,
                  marked: DataFrame | None = None) -> DataFrame:
    """Old and new image of the status record at every change.

    Progress is rebuilt along each document's log with ``keyed_scan`` (skew-safe running
    state): processed = distinct pages finished so far, total and status = latest so far.
    ``op`` is INSERT for the first change of a document and MODIFY afterwards. ``marked`` is the
    log with first-completion marks, when the caller already has it.
    """
    marked = marked if marked is not None else first_completions(log)
    scanned = keyed_scan(marked, "file_id", ["ts", "seq"],
                         sums={"processed": F.col("is_first").cast("long")},
                         lasts={"total": F.col("total"), "status": F.col("status")},
                         n_segments=n_segments, quantile_source=log)
    return scanned.select(
        "file_id", "ts", "seq",
        F.when(F.col("row_number") == 1, F.lit("INSERT")).otherwise(F.lit("MODIFY")).alias("op"),
        doc_pk("file_id").alias("pk"), F.lit(STATUS_SK).alias("sk"),
        F.col("processed_before").alias("old_processed"),
        F.col("total_before").alias("old_total"),
        F.col("status_before").alias("old_status"),
        F.col("processed").alias("new_processed"),
        F.col("total").alias("new_total"),
        F.col("status").alias("new_status"),
    )


def page_changes(log: DataFrame, marked: DataFrame | None = None) -> DataFrame:
    """Page-record changes of the same log: a put of ``PAGE#nnnn`` per completion (INSERT the
    first time a page is stored, MODIFY when it is stored again)."""
    marked = (marked if marked is not None else first_completions(log)).filter(
        F.col("page").isNotNull())
    return marked.select(
        "file_id", "ts", "seq",
        F.when(F.col("is_first") == 1, F.lit("INSERT")).otherwise(F.lit("MODIFY")).alias("op"),
        doc_pk("file_id").alias("pk"), page_sk("page").alias("sk"))


def modify_status_changes(changes: DataFrame) -> DataFrame:
    """Change-feed filter (ST2, P7): MODIFY only, status records only, both images present."""
    return changes.filter((F.col("op") == "MODIFY") & (F.col("sk") == STATUS_SK))


def completion_edges(images: DataFrame) -> DataFrame:
    """Changes where the document becomes ready: ready now, not ready before (ST3, fires once
    per transition, unlike a level trigger that fires on every later change of a ready row)."""
    now = ready("new_processed", "new_total", "new_status")
    was = ready("old_processed", "old_total", "old_status")
    return images.filter(now & ~(was & (F.col("op") == "MODIFY")))


def single_table(**kinds: DataFrame) -> DataFrame:
    """Several record kinds in one table (G1): ``unionByName(allowMissingColumns=True)`` with a
    ``kind`` column naming each input."""
    out = None
    for name, df in kinds.items():
        tagged = df.withColumn("kind", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def point_get(df: DataFrame, **key_values) -> DataFrame:
    """Zero or one row by key (U5): an equality filter Parquet can prune on."""
    cond = F.lit(True)
    for k, v in key_values.items():
        cond = cond & (F.col(k) == F.lit(v))
    return df.filter(cond)
