"""The fold of a change log kept up to date (U1-U4, W2): a stored state per key that deltas are
merged into, instead of folding the whole log again.

A state is two tables. ``heads`` has one row per key: position and operation of its last change,
position of its last put or delete, and per field position and value of the write that counts; all
merge by the greater position. ``incs`` holds the increments after the key's last absolute value of
the counter, by position, so an absolute value that arrives late still counts the right ones.
Increments at or before a ``horizon``, before which nothing arrives any more, are added up to one row
per key; without one nothing is settled and every order of arrival gives the fold of the whole log.

Stored, a state lies in hash buckets of the key. A delta reads and writes the buckets it touches, and
commits them (``sources.commits``); readers take each bucket from its last commit.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.log import RESETS
from quire.operators.spread import join_spread
from quire.sources.commits import last_commits, read_runs, write_run

BUCKETS = 64


@dataclass
class FoldState:
    heads: DataFrame
    incs: DataFrame
    fields: tuple[str, ...]
    counter: str | None
    key: str = "file_id"


def _position() -> Column:
    return F.struct("ts", "seq")


def summarise(log: DataFrame, fields: Sequence[str], counter: str | None = None,
              key: str = "file_id") -> FoldState:
    """The state of a part of a log (file_id, ts, seq, op, fields, inc), any rows in any order."""
    pos, op = _position(), F.col("op")
    is_reset = op.isin(*RESETS)

    def write(f: str, value: Column) -> Column:
        touched = is_reset | ((op == "set") & F.col("fields")[f].isNotNull())
        return F.max(F.when(touched, F.struct(pos.alias("p"), value.alias("v"))))

    def value(f: str) -> Column:
        return F.when(op != "delete", F.col("fields")[f])

    number = value(counter).try_cast("long") if counter else F.lit(None).cast("long")
    heads = log.groupBy(key).agg(
        F.max(F.struct(pos.alias("p"), op.alias("v"))).alias("last"),
        F.max(F.when(is_reset, F.struct(pos.alias("p"), F.when(op == "put", F.col("ts")).alias("v"))))
        .alias("created"),
        F.count(F.lit(1)).alias("ops"),
        write(counter or "", number).alias("abs"),
        *[write(f, value(f)).alias(f"f_{f}") for f in fields])
    incs = (log.where(op == "inc").select(key, "ts", "seq", "inc"))
    if not counter:
        incs = incs.limit(0)
    return _dropped(FoldState(heads, incs, tuple(fields), counter, key))


def _dropped(s: FoldState) -> FoldState:
    """Without increments that an absolute value follows."""
    after = s.heads.select(s.key, F.col("abs.p").alias("_abs"))
    incs = (join_spread(s.incs, after, [s.key], "seq")
            .where(F.col("_abs").isNull() | (_position() > F.col("_abs"))).drop("_abs"))
    return FoldState(s.heads, incs, s.fields, s.counter, s.key)


def merge(a: FoldState, b: FoldState, horizon=None) -> FoldState:
    """The state of both parts together; the order of the two doesn't matter."""
    best = [c for c in a.heads.columns if c not in (a.key, "ops")]
    heads = (a.heads.unionByName(b.heads).groupBy(a.key)
             .agg(F.sum("ops").alias("ops"), *[F.max(c).alias(c) for c in best])
             .select(*a.heads.columns))
    out = _dropped(FoldState(heads, a.incs.unionByName(b.incs), a.fields, a.counter, a.key))
    if horizon is not None:
        settled = F.col("ts") <= F.lit(horizon).cast("timestamp")
        old = (out.incs.where(settled).groupBy(a.key)
               .agg(F.max(_position()).alias("p"), F.sum("inc").alias("inc"))
               .select(a.key, "p.ts", "p.seq", "inc"))
        out.incs = out.incs.where(~settled).unionByName(old)
    return out


def folded(s: FoldState) -> DataFrame:
    """One row per live key, with the columns of ``log.fold``."""
    added = s.incs.groupBy(s.key).agg(F.sum("inc").alias("_inc"))
    live = s.heads.join(added, s.key, "left").where("last.v != 'delete'")
    count = [F.when(F.col("_inc").isNull(), F.col("abs.v"))
             .otherwise(F.coalesce("abs.v", F.lit(0)) + F.col("_inc")).alias(s.counter)
             ] if s.counter else []
    return live.select(s.key, F.col("last.p.ts").alias("updated_at"),
                       F.col("created.v").alias("created_at"), "ops",
                       *[F.col(f"f_{f}.v").alias(f) for f in s.fields], *count)


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _stored(spark: SparkSession, root: str, table: str, touched: Sequence[int] | None) -> DataFrame:
    """A table of the stored state: every bucket (or those touched) from its last commit."""
    owner = {b: c["seq"] for c in last_commits(spark, root, table)
             for b in map(int, c["note"]["buckets"].split(","))
             if touched is None or b in touched}
    if not owner:
        return read_runs(spark, root, table).where("false").drop("run_id", "commit_seq", "bucket")
    known = spark.createDataFrame(list(owner.items()), "bucket int, commit_seq long")
    rows = read_runs(spark, root, table, only=set(owner.values()))
    return (rows.where(F.col("bucket").isin(*owner)).join(
        F.broadcast(known), ["bucket", "commit_seq"]).drop("run_id", "commit_seq", "bucket"))


def read_state(spark: SparkSession, root: str, fields: Sequence[str], counter: str | None = None,
               key: str = "file_id", touched: Sequence[int] | None = None) -> FoldState:
    return FoldState(_stored(spark, root, "heads", touched), _stored(spark, root, "incs", touched),
                     tuple(fields), counter, key)


def apply_delta(spark: SparkSession, root: str, run_id: str, delta: DataFrame,
                fields: Sequence[str], counter: str | None = None, key: str = "file_id",
                buckets: int = BUCKETS, horizon=None) -> int:
    """Merges new log rows into the state stored under ``root`` (made, where there is none).
    Buckets without a changed key are neither read nor written; the number of buckets is that of the
    first run. A run id that was applied already changes nothing, so a retry is harmless. Returns the
    number of buckets written."""
    done = last_commits(spark, root, "heads")
    if any(c["run_id"] == run_id for c in done):
        return 0
    if done:
        buckets = int(done[0]["note"]["of"])
    new = summarise(delta, fields, counter, key)
    touched = sorted(r[0] for r in new.heads.select(_bucket(key, buckets)).distinct().collect())
    if not touched:
        return 0
    if done:
        new = merge(read_state(spark, root, fields, counter, key, touched), new, horizon)
    place = _bucket(key, buckets)
    write_run(spark, root, run_id,
              {"heads": new.heads.withColumn("bucket", place).repartition("bucket"),
               "incs": new.incs.withColumn("bucket", place).repartition("bucket", "seq")},
              partition_by=["bucket"],
              note={"buckets": ",".join(map(str, touched)), "of": str(buckets)})
    return len(touched)
