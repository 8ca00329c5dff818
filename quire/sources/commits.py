"""Commit records: all outputs of a run become visible together, in the order of commits.

A run writes every output table to an attempt folder of its own, ``<root>/<table>/attempt=<id>``,
and then one commit row under ``<root>/commits`` that names run, attempt and tables. Readers look at
the commit rows first and read only the folders they name, so a run that is killed between two
writes, or while it writes, changes nothing for them. A run that is done again gets a new attempt;
its later commit replaces the earlier one. Nothing that readers may look at is ever overwritten.

The order of runs is the order of their commits (a sequence number), not that of their names. One
commit is a folder that must not exist yet; where two writers meet, the later one takes the next
number. The driver holds one row per run.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMMIT = T.StructType([
    T.StructField("run_id", T.StringType()), T.StructField("attempt", T.StringType()),
    T.StructField("tables", T.ArrayType(T.StringType())),
    T.StructField("note", T.MapType(T.StringType(), T.StringType()))])
MISSING = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA", "Path does not exist")


def nothing_there(e: AnalysisException) -> bool:
    return any(m in str(e) for m in MISSING)


def commits(spark: SparkSession, root: str) -> list[dict]:
    """The commit rows of ``root`` in commit order."""
    schema = T.StructType([*COMMIT.fields, T.StructField("seq", T.LongType())])
    try:
        rows = spark.read.schema(schema).parquet(f"{root}/commits").orderBy("seq").collect()
    except AnalysisException as e:
        if nothing_there(e):
            return []
        raise
    return [r.asDict() for r in rows]


def write_attempt(df: DataFrame, root: str, table: str, attempt: str, fmt: str = "parquet",
                  partition_by: Sequence[str] = (), **options: str) -> None:
    """One output of a run, not visible before its commit."""
    df.write.partitionBy(*partition_by).options(**options).format(fmt).save(
        f"{root}/{table}/attempt={attempt}")


def commit(spark: SparkSession, root: str, run_id: str, attempt: str, tables: Sequence[str],
           note: Mapping[str, str] | None = None) -> int:
    """Makes the attempt visible; returns the number of the commit."""
    row = spark.createDataFrame([(run_id, attempt, list(tables), dict(note or {}))], COMMIT)
    seq = max([c["seq"] for c in commits(spark, root)], default=-1) + 1
    while True:
        try:
            row.coalesce(1).write.mode("errorifexists").parquet(f"{root}/commits/seq={seq}")
            return seq
        except AnalysisException as e:
            if "PATH_ALREADY_EXISTS" not in str(e):
                raise
            seq += 1


def write_run(spark: SparkSession, root: str, run_id: str, tables: Mapping[str, DataFrame],
              fmt: str = "parquet", partition_by: Sequence[str] = (),
              note: Mapping[str, str] | None = None, **options: str) -> int:
    """All outputs of a run, in the order given, then its commit. Give the same run id again to
    replace what the run wrote before."""
    attempt = f"a{uuid.uuid4().hex}"
    for table, df in tables.items():
        write_attempt(df, root, table, attempt, fmt, partition_by, **options)
    return commit(spark, root, run_id, attempt, list(tables), note)


def last_commits(spark: SparkSession, root: str, table: str) -> list[dict]:
    """Of every run with an output ``table`` its last commit, in commit order."""
    last = {c["run_id"]: c for c in commits(spark, root) if table in c["tables"]}
    return sorted(last.values(), key=lambda c: c["seq"])


def read_runs(spark: SparkSession, root: str, table: str, fmt: str = "parquet",
              schema: T.StructType | None = None, only: Sequence[int] | None = None) -> DataFrame:
    """The rows of all committed runs (or of the commits ``only``), with ``run_id`` and
    ``commit_seq``."""
    found = [c for c in last_commits(spark, root, table) if only is None or c["seq"] in only]
    if not found:
        raise FileNotFoundError(f"no committed run with {table} under {root}")
    base = f"{root}/{table}"
    r = spark.read.option("basePath", base).format(fmt)
    if schema is not None:
        r = r.schema(T.StructType([*schema.fields, T.StructField("attempt", T.StringType())]))
    rows = r.load([f"{base}/attempt={c['attempt']}" for c in found])
    known = spark.createDataFrame(
        [(c["attempt"], c["run_id"], c["seq"]) for c in found],
        "attempt string, run_id string, commit_seq long")
    return (rows.withColumn("attempt", F.col("attempt").cast("string"))
            .join(F.broadcast(known), "attempt").drop("attempt"))


def latest_by(rows: DataFrame, key: str) -> DataFrame:
    """Of each key the rows of the last commit that has it."""
    last = rows.groupBy(key).agg(F.max("commit_seq").alias("commit_seq"))
    return rows.join(last, [key, "commit_seq"], "left_semi")
