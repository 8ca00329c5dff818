"""Stored state and repeated runs: commits, incremental folds, maintained listings, keyed lookups,
resumed annotation, retries, alarm edges, applied retention, large documents, the live feed."""

import glob
import os
import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quire.operators.foldstate import apply_delta, folded, merge, read_state, summarise
from quire.operators.ledger import annotate_resumable, answered
from quire.operators.log import change_images, fold
from quire.operators.recent import apply_changes, build_recent
from quire.operators.retries import publish_with_retries
from quire.operators.transitions import alarm_transitions
from quire.sources.commits import (
    commit, commits, last_commits, latest_by, read_runs, write_attempt, write_run,
)
from quire.sources.expiring import apply_retention, read_expiring, write_expiring
from quire.sources.keyed import get_keys, write_keyed
from quire.sources.large import read_large_pages
from quire.streaming import changes
from quire.streaming.changes import BUCKETS, start_change_feed

T0 = datetime(2024, 1, 1)


# ------------------------------------------------------------------ commits

def _table(spark, rows):
    return spark.createDataFrame(rows, "file_id string, v int")


def test_runs_are_read_in_commit_order_and_killed_runs_not_at_all(spark, tmpdir_path):
    root = f"{tmpdir_path}/results"
    with pytest.raises(FileNotFoundError):
        read_runs(spark, root, "t")
    write_run(spark, root, "9", {"t": _table(spark, [("a", 1), ("b", 1)])})
    write_run(spark, root, "10", {"t": _table(spark, [("b", 2)])})
    write_attempt(_table(spark, [("a", 3)]), root, "t", "killed")       # no commit follows
    got = latest_by(read_runs(spark, root, "t"), "file_id").collect()
    assert {(r.file_id, r.v, r.run_id) for r in got} == {("a", 1, "9"), ("b", 2, "10")}
    write_run(spark, root, "9", {"t": _table(spark, [("a", 4)])})       # run 9 done again
    got = latest_by(read_runs(spark, root, "t"), "file_id").collect()
    assert {(r.file_id, r.v) for r in got} == {("a", 4), ("b", 2)}
    assert [c["run_id"] for c in last_commits(spark, root, "t")] == ["10", "9"]


def test_two_writers_take_different_numbers(spark, tmpdir_path):
    root = f"{tmpdir_path}/r"
    os.makedirs(f"{root}/commits/seq=0")        # another writer has begun commit 0
    assert commit(spark, root, "x", "a1", ["t"]) == 1
    assert commit(spark, root, "y", "a2", ["t"]) == 2
    assert [c["seq"] for c in commits(spark, root)] == [1, 2]


# ------------------------------------------------------------------ the fold, kept

LOG = "file_id long, ts timestamp, seq long, op string, fields map<string,string>, inc long"
FIELDS = ("status", "total")


def _log(rng, n, keys=6):
    rows = []
    for seq in range(n):
        op = rng.choice(["put", "set", "set", "inc", "inc", "inc", "delete"])
        fields = {k: str(rng.randrange(5)) for k in ("status", "total", "done")
                  if op == "put" or (op == "set" and rng.random() < 0.5)}
        rows.append((rng.randrange(keys), T0 + timedelta(seconds=rng.randrange(40)), seq, op,
                     fields or None, 1 if op == "inc" else None))
    return rows



def _sorted_state(df):
    return sorted(map(str, _state_rows_unsorted(df)))


def _state_rows_unsorted(df):
    return [(r.file_id, r.updated_at, r.created_at, r.ops, r.status, r.total, r.done)
            for r in df.collect()]


@pytest.mark.parametrize("seed", [1, 2])
def test_merged_parts_equal_the_fold_in_any_order(spark, seed):
    rng = random.Random(seed)
    rows = _log(rng, 250)
    whole = fold(spark.createDataFrame(rows, LOG), FIELDS, "done")
    rng.shuffle(rows)
    parts = [summarise(spark.createDataFrame(rows[i::3], LOG), FIELDS, "done") for i in range(3)]
    rng.shuffle(parts)
    got = merge(merge(parts[0], parts[1]), parts[2])
    assert _sorted_state(folded(got)) == _sorted_state(whole)


def test_settled_increments_are_one_row_per_key(spark):
    rng = random.Random(5)
    rows = sorted(_log(rng, 300), key=lambda r: (r[1], r[2]))
    whole = fold(spark.createDataFrame(rows, LOG), FIELDS, "done")
    cut = rows[200][1]
    early = [r for r in rows if r[1] <= cut]
    late = [r for r in rows if r[1] > cut]
    empty = summarise(spark.createDataFrame([], LOG), FIELDS, "done")
    s = merge(summarise(spark.createDataFrame(early, LOG), FIELDS, "done"), empty, horizon=cut)
    assert s.incs.groupBy("file_id").count().where("count > 1").isEmpty()
    got = merge(s, summarise(spark.createDataFrame(late, LOG), FIELDS, "done"))
    assert _sorted_state(folded(got)) == _sorted_state(whole)


def test_a_delta_touches_its_buckets_only_and_once(spark, tmpdir_path):
    rng = random.Random(7)
    rows = _log(rng, 400, keys=60)
    root = f"{tmpdir_path}/state"
    delta = [(3, T0 + timedelta(seconds=99), 1000, "inc", None, 1)]
    assert apply_delta(spark, root, "base", spark.createDataFrame(rows, LOG), FIELDS, "done") > 20
    assert apply_delta(spark, root, "d1", spark.createDataFrame(delta, LOG), FIELDS, "done") == 1
    # the same delta again, as after a restart
    assert apply_delta(spark, root, "d1", spark.createDataFrame(delta, LOG), FIELDS, "done") == 0
    got = folded(read_state(spark, root, FIELDS, "done"))
    want = fold(spark.createDataFrame(rows + delta, LOG), FIELDS, "done")
    assert _sorted_state(got) == _sorted_state(want)
    attempt = last_commits(spark, root, "heads")[-1]["attempt"]
    assert len(glob.glob(f"{root}/heads/attempt={attempt}/bucket=*")) == 1


# ------------------------------------------------------------------ newest k, kept

@pytest.mark.parametrize("seed", [1, 2, 3])
def test_maintained_listing_equals_recomputation(spark, seed):
    rng = random.Random(seed)
    cols = "file_id long, tenant_id string, status string, uploaded_at long"

    def row(i):
        return (i, rng.choice("aab"), rng.choice(["x", "y"]), rng.randrange(25))   # many ties
    state = {i: row(i) for i in range(160)}
    index = build_recent(spark.createDataFrame(list(state.values()), cols).where("status = 'x'"),
                         k=5, slack=rng.choice([1, 4]))
    for _ in range(3):
        ups = {i: row(i) for i in rng.sample(range(200), 40)}
        gone = rng.sample(sorted(state), 45)
        state.update(ups)
        for i in gone:
            state.pop(i, None)
        table = spark.createDataFrame(list(state.values()), cols)
        index = apply_changes(index, spark.createDataFrame(list(ups.values()), cols),
                              spark.createDataFrame([(i,) for i in gone], "file_id long"), table,
                              keep=F.col("status") == "x")
        index.rows, index.floors = index.rows.checkpoint(), index.floors.checkpoint()
        want = build_recent(table.where("status = 'x'"), k=5).listing()
        pick = ["tenant_id", "rank", "file_id", "uploaded_at"]
        assert sorted(index.listing().select(*pick).collect()) == sorted(
            want.select(*pick).collect())


# ------------------------------------------------------------------ keyed lookups

def _scanned_rows(df):
    """Rows that the Parquet scan of a collected DataFrame gave."""
    plan = df._jdf.queryExecution().executedPlan()
    todo, total = [plan], 0
    while todo:
        p = todo.pop()
        if p.nodeName().startswith("AdaptiveSparkPlan"):
            p = p.executedPlan()
        if "Scan parquet" in p.nodeName():
            total += p.metrics().apply("numOutputRows").value()
        kids = p.children()
        todo += [kids.apply(i) for i in range(kids.size())]
        if "QueryStage" in p.nodeName():
            todo.append(p.plan())
    return total


def test_lookups_read_a_small_part_of_the_table(spark, tmpdir_path):
    path = f"{tmpdir_path}/keyed"
    rows = spark.range(200_000).selectExpr("cast(id * 7919 % 200000 AS string) AS file_id", "id AS v")
    write_keyed(rows, path, "file_id", files=16, row_group_bytes=64 << 10)
    keys = spark.createDataFrame([("77",), ("77",), (None,), ("123456",), ("absent",)],
                                 "file_id string")
    found = get_keys(spark, path, keys, "file_id")
    got = found.collect()
    assert {(r.file_id, r.v * 7919 % 200000) for r in got} == {("77", 77), ("123456", 123456)}
    assert _scanned_rows(found) < 0.2 * 200_000
    assert get_keys(spark, path, keys.where("file_id IS NULL"), "file_id").count() == 0
    many = spark.range(0, 200_000, 400).selectExpr("cast(id AS string) AS file_id")
    assert get_keys(spark, path, many, "file_id").count() == 500


# ------------------------------------------------------------------ resumed annotation

def test_no_page_is_asked_twice_after_a_restart(spark, tmpdir_path):
    asked = f"{tmpdir_path}/asked"
    open(asked, "w").close()

    def annotator(text):
        with open(asked, "a") as f:
            f.write(text + "\n")
        return '{"summary": "' + text + '"}'
    pages = spark.createDataFrame([(f"f{i % 7}", i, f"text{i}") for i in range(60)],
                                  "file_id string, page_number int, page_text string")
    root = f"{tmpdir_path}/ledger"
    options = {"waves": 6, "tasks": 2, "prompted": False}
    assert answered(spark, root) is None
    part = annotate_resumable(pages, annotator, "2024-01-01", root, most_waves=3, **options)
    assert 0 < part.count() < 60
    whole = annotate_resumable(pages, annotator, "2024-01-01", root, **options)
    assert sorted(r.page_number for r in whole.collect()) == list(range(60))
    with open(asked) as f:
        texts = f.read().split()
    assert sorted(texts) == sorted(f"text{i}" for i in range(60))
    # new pages later are the only ones asked for
    more = pages.unionByName(spark.createDataFrame([("new", 1, "later")], pages.schema))
    assert annotate_resumable(more, annotator, "2024-01-01", root, **options).count() == 61
    with open(asked) as f:
        assert f.read().split()[60:] == ["later"]


def test_the_request_budget_is_that_of_the_job(spark, tmpdir_path):
    import time
    pages = spark.createDataFrame([("f", i, "x") for i in range(12)],
                                  "file_id string, page_number int, page_text string")
    begin = time.time()
    annotate_resumable(pages, lambda t: "{}", "2024-01-01", f"{tmpdir_path}/paced", waves=1, tasks=3,
                       per_second=6.0)
    assert time.time() - begin >= 1.0


# ------------------------------------------------------------------ retries

def test_refused_records_are_sent_again_and_end_as_dead_letters(spark):
    rows = spark.range(1300).selectExpr("'t' AS tenant", "id")

    def send(batches, attempt):
        # 13 never pass; of the others those divisible by 10 pass the second time
        code = F.when(F.col("id") % 100 == 7, "500").when(
            (F.col("id") % 10 == 0) & F.lit(attempt == 1), "429")
        return batches.withColumn("error_code", code)
    sent, dead, totals = publish_with_retries(rows, send, ["tenant"], ["id"], attempts=3)
    assert sent.count() == 1287 and {r.id for r in dead.collect()} == {100 * i + 7 for i in range(13)}
    assert {(r.id % 10 == 0, r.attempts) for r in sent.collect()} == {(True, 2), (False, 1)}
    assert [(r.attempts, r.batches, r.records, r.success_count, r.failed_count)
            for r in totals.orderBy("attempts").collect()] == [
        (1, 3, 1300, 1157, 143), (2, 1, 143, 130, 13), (3, 1, 13, 0, 13)]
    none, left, _ = publish_with_retries(rows.limit(0), send, ["tenant"], ["id"])
    assert none.count() == left.count() == 0


# ------------------------------------------------------------------ alarm edges

def test_an_alarm_ends_when_the_errors_stop(spark):
    rows = [("e", T0, 12), ("e", T0 + timedelta(minutes=5), 11), ("e", T0 + timedelta(minutes=20), 50),
            ("e", T0 + timedelta(minutes=25), 10), ("q", T0, 1), ("q", T0 + timedelta(minutes=10), 99)]
    counts = spark.createDataFrame(rows, "rule string, window_start timestamp, metric long")
    got = alarm_transitions(counts, "5 MINUTES", 10, ("rule",)).orderBy("rule", "window_start")
    assert [(r.rule, (r.window_start - T0).seconds // 60, r.metric, r.to_state, r.lasted)
            for r in got.collect()] == [
        ("e", 0, 12, "ALARM", 0), ("e", 10, 0, "OK", 2), ("e", 20, 50, "ALARM", 2),
        ("e", 25, 10, "OK", 1), ("q", 10, 99, "ALARM", 2)]
    assert alarm_transitions(counts.limit(0), "5 MINUTES", 10, ("rule",)).count() == 0


# ------------------------------------------------------------------ retention

def test_retention_rewrites_the_edge_day_only(spark, tmpdir_path):
    path, archive = f"{tmpdir_path}/files", f"{tmpdir_path}/archive"
    rows = spark.createDataFrame([(i, T0 + timedelta(hours=i)) for i in range(96)] + [(-1, None)],
                                 "file_id long, at timestamp")
    write_expiring(rows, path, F.col("at"))

    def names(day):
        return sorted(glob.glob(f"{path}/expire_day={day}/*.parquet"))
    later = names("2024-01-03") + names("2024-01-04") + names("9999-12-31")
    assert apply_retention(spark, path, "2024-01-02 05:00:00", archive) == 1
    kept = {r.file_id for r in read_expiring(spark, path).collect()}
    assert kept == {-1, *range(30, 96)}
    assert {r.file_id for r in read_expiring(spark, archive).collect()} == set(range(30))
    assert names("2024-01-03") + names("2024-01-04") + names("9999-12-31") == later
    assert names("2024-01-01") == []
    assert apply_retention(spark, path, "2024-01-02 05:00:00", archive) == 0
    assert {r.file_id for r in read_expiring(spark, path).collect()} == kept
    assert apply_retention(spark, f"{tmpdir_path}/none", "2024-01-01 00:00:00") == 0


# ------------------------------------------------------------------ large documents

def test_pages_of_large_files_equal_the_split(spark, tmpdir_path):
    folder = f"{tmpdir_path}/docs"
    os.makedirs(folder)
    texts = {"a": "\n".join(f"line {i} é" * (i % 5) for i in range(5000)), "b": "x\n", "c": "one",
             "d": "", "e": "\n\n", "f": "tail\r\nkept\n\nend"}
    for name, text in texts.items():
        with open(f"{folder}/{name}.txt", "w", newline="") as f:
            f.write(text)
    pages = read_large_pages(spark, folder, range_bytes=4096)
    got = {}
    for r in pages.collect():
        got.setdefault(r.path[-5], []).append((r.page_number, r.page_text, r.total_pages))
    for name, text in texts.items():
        parts = text.split("\n")
        assert sorted(got[name]) == [(i, p, len(parts)) for i, p in enumerate(parts, 1)]


# ------------------------------------------------------------------ the live feed

PROGRESS = "file_id long, ts timestamp, seq long, page int, total int, status string"


def _images(df):
    return sorted(map(str, df.select(
        "file_id", "ts", "seq", "op", "old_processed", "old_total", "old_status", "new_processed",
        "new_total", "new_status").collect()))


def test_feed_puts_overlapping_files_in_order(spark, tmpdir_path):
    rng = random.Random(11)
    rows = [(rng.randrange(8), T0 + timedelta(minutes=5 * i, microseconds=rng.randrange(3)), i,
             rng.choice([None, 1, 2, 3]), rng.choice([None, None, 2, 3]),
             rng.choice([None, "processing", "failed"])) for i in range(300)]
    files = [[] for _ in range(7)]
    for i, r in enumerate(rows):
        files[min(5, i // 60 + (i % 3 == 0))].append(r)
    files[6] = [(-1, T0 + timedelta(days=30), 999, None, None, "processing")]
    incoming = f"{tmpdir_path}/in"
    for f in files:
        spark.createDataFrame(f, PROGRESS).coalesce(1).write.mode("append").parquet(incoming)
    stream = (spark.readStream.schema(spark.read.parquet(incoming).schema)
              .option("maxFilesPerTrigger", 1).parquet(incoming))
    out = f"{tmpdir_path}/out"
    start_change_feed(stream, out, f"{tmpdir_path}/ck", "12 hours", state_partitions=4
                      ).awaitTermination()
    got = spark.read.parquet(out)
    want = change_images(spark.createDataFrame(rows, PROGRESS))
    assert _images(got) == _images(want)
    edges = got.where("edge").count()
    ready = ("new_total IS NOT NULL AND new_processed = new_total AND new_total > 0 "
             "AND new_status = 'processing'")
    was = ready.replace("new_", "old_")
    assert edges == want.where(f"({ready}) AND NOT coalesce({was}, false)").count() > 0


def test_feed_keeps_state_by_bucket_and_not_by_document(spark, tmpdir_path):
    """Many documents of few rows each, rows without an id among them, give the images of the batch
    form, and the state has no row per document."""
    rng = random.Random(5)
    rows = [(None if i % 50 == 7 else rng.randrange(1200), T0 + timedelta(minutes=i), i,
             rng.choice([None, 1, 2, 3]), rng.choice([None, None, 2, 3]),
             rng.choice([None, "", "processing", "failed"])) for i in range(3000)]
    files = [[r for r in rows if min(2, r[2] // 1000 + (r[2] % 3 == 0)) == f] for f in range(3)]
    files.append([(-1, T0 + timedelta(days=90), 9999, None, None, "processing")])
    incoming = f"{tmpdir_path}/in"
    for f in files:
        spark.createDataFrame(f, PROGRESS).coalesce(1).write.mode("append").parquet(incoming)
    stream = (spark.readStream.schema(spark.read.parquet(incoming).schema)
              .option("maxFilesPerTrigger", 1).parquet(incoming))
    out = f"{tmpdir_path}/out"
    q = start_change_feed(stream, out, f"{tmpdir_path}/ck", "2 days", state_partitions=4)
    q.awaitTermination()
    held = max(s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"])
    assert 0 < held <= BUCKETS + 1 < len({r[0] for r in rows})
    named = [(-5 if r[0] is None else r[0], *r[1:5], r[5] or None) for r in rows]
    got = spark.read.parquet(out).fillna({"file_id": -5})
    assert _images(got) == _images(change_images(spark.createDataFrame(named, PROGRESS)))


class _State:
    """What the feed uses of a group's state."""
    get = timer = None
    hasTimedOut = False
    exists = property(lambda self: self.get is not None)

    def update(self, value):
        self.get = value

    def remove(self):
        self.get = None

    def getCurrentWatermarkMs(self):
        return self.mark

    def setTimeoutTimestamp(self, at):
        assert at > self.mark
        self.timer = at


def test_feed_forgets_each_document_of_a_bucket_by_its_own_time():
    run, state = changes._images(3000, 4), _State()

    def call(mark, *rows):
        state.mark, state.hasTimedOut = mark, not rows
        none = changes._NONE
        b = pd.DataFrame({c: np.array([r[k] for r in rows], dtype=np.int64)
                          for k, c in enumerate(("file_id", "us", "seq"))})
        b = b.assign(page=1, total=none, status=None).astype({"status": object})
        return [(r.file_id, r.seq, r.op, r.new_processed) for f in run((0,), iter([b]), state)
                for r in f.itertuples()]

    assert call(0, (4, 1_000_000, 1), (8, 2_000_000, 2), (8, 9_000_000, 3)) == []
    assert state.timer == 1000
    assert call(2500) == [(4, 1, "INSERT", 1), (8, 2, "INSERT", 1)]
    assert state.timer == 4000
    assert call(6000) == [] and state.timer == 9000     # 4 is forgotten, 8 has a row waiting
    assert call(9500, (4, 9_100_000, 4)) == [(4, 4, "INSERT", 1), (8, 3, "MODIFY", 1)]
    assert state.timer == 12000
    assert call(20_000) == [] and not state.exists
    with pytest.raises(ValueError):
        state.get = (8, b"", b"", b"")
        call(0)
