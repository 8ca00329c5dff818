"""Exact deduplication: a tree merge of sorted digest runs. DataFrame functions only.

Rows that agree in id, length and text digest are counted first (map-side), so repeated rows are
one entry. Entries are dealt into ``R`` runs by a hash of id and length. A run is reduced to one
entry per text, sorted by digest. Rounds then merge neighbouring runs: run ``r`` meets the runs that
differ from it in the lowest four bits of the number, which is four rounds of a binomial tree done
as one multiway merge. Every merge keeps, per verified digest, the smallest entry. After the last
round one run is left (its entries still spread over all tasks by digest), and the answers travel
back down the same tree.

Nothing about a group of copies ever meets in one task: a run holds a ``1/R`` part of it, and each
merge sees at most 16 entries of a text. Going down, an entry is joined by (run, digest), so even a
text that makes a third of all rows is matched in ``R`` separate places.

Two entries are merged only if SHA-256, byte length and an independent 64-bit hash of the
normalised text all agree. Texts are digested once, whole, however long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import SPACE, as_row, bucket_count, field, from_row, table
from quire.llm.vectors import in_parts
from quire.session import checkpoint_root

MERGE_BITS = 4          # sixteen runs meet in one merge
RUN_ROWS = 1 << 16      # rows of a leaf run, about
LEAST_RUNS = 1 << 8


def _normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", "")


def text_key(text: Column) -> Column:
    """Verified identity of a text in 48 bytes: SHA-256, byte length and a second hash."""
    norm = _normalised(text)
    number = "%016x"
    return F.unhex(F.concat(F.sha2(norm, 256),
                            F.format_string(number, F.octet_length(norm).cast("bigint")),
                            F.format_string(number, F.xxhash64(norm))))


def _runs(rows: int) -> int:
    n = bucket_count(rows, RUN_ROWS, LEAST_RUNS)
    bits = n.bit_length() - 1
    return 1 << (-(-bits // MERGE_BITS) * MERGE_BITS)


def _entries(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, n_chars, key, n: the different entries of the table and how often each occurs."""
    text = F.col(f"`{text_col}`")
    return (df.select(F.col(f"`{id_col}`").alias("id"),
                      F.length(F.coalesce(text, F.lit(""))).cast("bigint").alias("n_chars"),
                      text_key(text).alias("key"))
            .groupBy("id", "n_chars", "key").agg(F.count(F.lit(1)).alias("n")))


def _resolved(entries: DataFrame, rows: int) -> DataFrame:
    """entries: id, n_chars, key, n. Adds best (the entry that stays) and group_size (rows). The
    entries are checkpointed, so that the texts are read and digested once."""
    checkpoint_root(entries.sparkSession)
    runs = _runs(rows)
    entries = entries.withColumn(
        "run", F.pmod(F.xxhash64("id", "n_chars"), F.lit(runs)).cast("int")).checkpoint()
    entry = F.struct((-F.col("n_chars")).alias("less"), F.col("id").isNull().alias("no_id"),
                     F.col("id"))
    levels = [entries.groupBy("run", "key").agg(F.min(entry).alias("best"),
                                                F.sum("n").alias("group_size"))]
    step = runs
    while step > 1:
        step >>= MERGE_BITS
        levels.append(levels[-1]
                      .withColumn("run", F.shiftright("run", MERGE_BITS))
                      .groupBy("run", "key")
                      .agg(F.min("best").alias("best"), F.sum("group_size").alias("group_size")))
    answer = levels.pop()
    while levels:
        below = levels.pop().select("run", "key", F.shiftright("run", MERGE_BITS).alias("up"))
        answer = (below.join(answer.withColumnRenamed("run", "up"), ["up", "key"])
                  .select("run", "key", "best", "group_size"))
    return entries.join(answer, ["run", "key"]).drop("run")


def _stays() -> Column:
    """Of an entry: one of its rows stays."""
    return F.col("best.id").eqNullSafe(F.col("id")) & (F.col("best.less") == -F.col("n_chars"))


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: the id, ``keep_id`` (id of the row that stays), ``group_size``,
    ``kept`` and ``text_sha256`` of the normalised text.

    A null text counts as empty; empty and white-space texts are one group. The row with the most
    code points stays, then the smallest id (a null id comes last). Of rows that agree in id and
    text exactly one is kept. An empty table gives an empty result. Other columns are not read.
    """
    found = in_parts(_resolved(_entries(df, id_col, text_col), df.count()), "n")
    nth = F.when(F.col("part") == 0, F.expr("transform(sequence(1L, share), i -> i = 1)")).otherwise(
        F.expr("transform(sequence(1L, share), i -> false)"))
    return (found.select("id", "best.id", "group_size", "key", _stays().alias("stays"),
                         F.explode(nth).alias("first")).toDF(
                             "id", "keep_id", "group_size", "key", "stays", "first")
            .select(F.col("id").alias(id_col), "keep_id", "group_size",
                    (F.col("stays") & F.col("first")).alias("kept"),
                    F.lower(F.hex(F.substring("key", 1, 32))).alias("text_sha256")))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns; rules as in ``exact_groups``. Of rows
    that agree in id and text, the one whose other columns have the smallest hash stays.

    Ids of which every row stays, or none, are settled by id alone; the texts of other ids (ids that
    repeat) are digested once more to tell their rows apart."""
    found = _resolved(_entries(df, id_col, text_col), df.count()).withColumn("stays", _stays())
    per_id = (found.groupBy("id").agg(F.sum("n").alias("rows"), F.count_if("stays").alias("stay"))
              .where("stay < rows").select(F.col("id").alias("gone"), "stay").checkpoint())
    same = F.col("id").eqNullSafe(F.col("gone"))
    rows = as_row(df).withColumn("id", field(id_col))
    out = from_row(rows.join(per_id.select("gone"), same, "left_anti"), df.columns)
    mixed = per_id.where("stay > 0").select("gone")
    if mixed.isEmpty():
        return out
    # one row per (id, text) on the map side, before it meets the texts that stay
    first = F.struct(-F.length(F.coalesce(field(text_col), F.lit(""))), F.xxhash64("row"))
    some = (rows.join(mixed, same, "left_semi").withColumn("key", text_key(field(text_col)))
            .groupBy("id", "key").agg(F.min_by("row", first).alias("row")))
    stay = (found.where("stays").join(mixed, same, "left_semi")
            .select(F.col("id").alias("kid"), F.col("key").alias("kkey")))
    some = some.join(stay, (F.col("key") == F.col("kkey")) & F.col("id").eqNullSafe(F.col("kid")))
    return out.union(from_row(some, df.columns))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts over all of ``documents``."""
    return exact_groups(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(norm) AS text_sha256
FROM d
WINDOW w AS (PARTITION BY norm ORDER BY length(t) DESC, doc_id NULLS LAST)
"""
