"""Annotation that survives a restart (M2, M5): waves of pages, a ledger of what is answered, and one
request budget for the whole job.

Pages are dealt into waves by a hash of their key. A wave's answers are written and committed before
the next one starts, and every wave asks only for pages that are in no committed wave: the ledger is
the answers table itself. A job that stops repeats at most the wave in hand.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.annotate import annotate_with
from quire.sources.commits import last_commits, read_runs, write_run
from quire.sources.objects import new_run_id

WAVES = 8


def answered(spark: SparkSession, root: str) -> DataFrame | None:
    """The pages answered so far, with their analysis; None before the first wave."""
    if not last_commits(spark, root, "answers"):
        return None
    return read_runs(spark, root, "answers").drop("run_id", "commit_seq")


def annotate_resumable(pages: DataFrame, fn: Callable, now, root: str, waves: int = WAVES,
                       per_second: float | None = None, tasks: int | None = None,
                       key_cols: Sequence[str] = ("file_id", "page_number"),
                       most_waves: int | None = None, **options) -> DataFrame | None:
    """Annotates the pages that the ledger under ``root`` lacks, wave by wave, and returns the whole
    ledger. ``per_second`` is the request budget of the job: it is divided over ``tasks`` (default
    ``spark.sql.shuffle.partitions``), each of which spaces its requests. ``most_waves`` ends the
    call early, for jobs with a time slot. Other options as for ``annotate_with``.

    Key columns must tell pages apart; pages with a null in one are asked once each run, since
    nothing can be found again by a null.
    """
    spark, keys = pages.sparkSession, list(key_cols)
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    pace = tasks / per_second if per_second else 0.0
    wave_of = F.pmod(F.xxhash64(*keys), F.lit(waves))
    made = 0
    for wave in range(waves):
        if most_waves is not None and made >= most_waves:
            break
        todo, done = pages.where(wave_of == wave), answered(spark, root)
        if done is not None:
            todo = todo.join(done.select(*keys), keys, "left_anti")
        if todo.isEmpty():
            continue
        answers = annotate_with(todo, fn, now, tuple(keys), partitions=tasks, min_interval=pace,
                                **options)
        write_run(spark, root, new_run_id(), {"answers": answers}, note={"wave": str(wave)})
        made += 1
    return answered(spark, root)
