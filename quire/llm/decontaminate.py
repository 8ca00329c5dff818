"""Benchmark decontamination by winnowing.

Every window of ten words is fingerprinted by the smallest hash of its six five-word grams, so two
equal windows always have equal fingerprints: any shared span of ten words or more is found. An
item of one to nine words is one window, fingerprinted by the hash of all its words, and documents
are fingerprinted at each such length that the benchmark has.

1. Fingerprints of the benchmark set bits of a bounded filter, which is broadcast.
2. Tasks fingerprint whole documents; windows whose fingerprint may be in the benchmark leave the
   task with their words. Every document also leaves one plain row that counts it.
3. Fingerprints are joined; a hit is extended to its whole window by comparing the words. The
   join key carries a salt (benchmark windows are repeated per salt), so a passage that a third of
   the documents share is matched in ``SALTS`` places.
4. Per document the windows hit are united to words, and the items to a sorted list.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.bitfilter import bits_for, collect_bits, may_hold
from quire.llm.common import as_row, field, from_row, table
from quire.llm.vectors import in_parts, repeated
from quire.llm.words import grams, lowest, windows_in_rows, words_of

GRAM, WINDOW = 5, 10
SALTS = 64


def _prints(hashes: np.ndarray, size: int) -> np.ndarray:
    """Fingerprint of every run of ``size`` words."""
    return lowest(grams(hashes, GRAM), WINDOW - GRAM + 1) if size == WINDOW else grams(hashes, size)


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for w in words_of(b["text"]):
            rows, sizes, texts, prints = [], [], [], []
            for i in range(w.hi - w.lo):
                a, z = w.first[i], w.first[i + 1]
                size = min(z - a, WINDOW)
                if not size:
                    continue
                fp = _prints(w.hash[a:z], size)
                for j in range(len(fp)):
                    rows.append(w.lo + i)
                    sizes.append(size)
                    texts.append(w.text(a + j, a + j + size).decode())
                prints.append(fp)
            if rows:
                yield pa.record_batch({
                    "item": b["item"].take(pa.array(rows)), "size": pa.array(sizes, pa.int32()),
                    "words": pa.array(texts, pa.string()),
                    "fp": pa.array(np.concatenate(prints).view(np.int64))})


def _document_rows(sizes: list[int], bits) -> Callable:
    """Per document one row with start null, and one per window that may be in the benchmark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen = bits.value, 0
        for b in batches:
            for w in words_of(b["text"]):
                n = w.hi - w.lo
                seen += n
                uid = np.array([int.from_bytes(hashlib.md5(w.row(i)).digest()[:8], "little",
                                               signed=True) for i in range(n)], dtype=np.int64)
                rows, starts, lens, texts = [np.arange(n)], [np.full(n, -1)], [np.zeros(n)], [""] * n
                prints = [uid]
                for size in sizes:
                    at = windows_in_rows(w.first, size)
                    fp = _prints(w.hash, size)[at] if len(at) else np.zeros(0, dtype=np.uint64)
                    keep = may_hold(held, fp)
                    at, fp = at[keep], fp[keep]
                    row = np.searchsorted(w.first, at, "right") - 1
                    rows.append(row)
                    starts.append(at - w.first[row])
                    lens.append(np.full(len(at), size))
                    texts += [w.text(i, i + size).decode() for i in at]
                    prints.append(fp.view(np.int64))
                row = np.concatenate(rows).astype(np.int64)
                start = np.concatenate(starts).astype(np.int64)
                yield pa.record_batch({
                    "id": b["id"].take(pa.array(row + w.lo)), "uid": pa.array(uid[row]),
                    "n_words": pa.array(np.diff(w.first)[row].astype(np.int64)),
                    "start": pa.array(start, mask=start < 0),
                    "size": pa.array(np.concatenate(lens).astype(np.int32)),
                    "words": pa.array(texts, pa.string()),
                    "fp": pa.array(np.concatenate(prints)),
                    # by the row's place in its task, so that equal rows are spread as well
                    "salt": pa.array(((seen + row) % SALTS).astype(np.int32))})

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, n_words, n_hit (words inside an occurrence of a window
    of some item), n_items, items_sha256 (of the sorted item ids, comma-joined), contaminated,
    items (those ids).

    A null or empty text has no words and no hits; an item without words has no window. An item id
    that repeats counts once; a null item id reads 'null'. Repeated documents each get a row and are
    matched once per task and salt. Long texts are read whole. An empty benchmark leaves every
    document clean. Other columns are not read.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("null"))
                             .alias("item"), F.col(f"`{item_text_col}`").alias("text"))
    windows = items.mapInArrow(_item_windows, "item string, size int, words string, fp long")
    known = windows.groupBy("fp", "words").agg(F.collect_set("item").alias("items"))
    count, sizes = windows.agg(F.approx_count_distinct("fp"), F.collect_set("size")).first()
    bits = spark.sparkContext.broadcast(collect_bits(windows, "fp", bits_for(count)))
    ids = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([T.StructField("id", ids.schema["id"].dataType),
                           *T.StructType.fromDDL("uid long, n_words long, start long, size int,"
                                                 " words string, fp long, salt int").fields])
    rows = ids.mapInArrow(_document_rows(sorted(sizes), bits), schema)
    # never broadcast: the planner does not see that the windows are repeated
    known = (known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
             .hint("merge"))
    found = F.col("items").isNotNull()
    united = F.expr("""aggregate(hits, struct(0L as n, 0L as reach), (u, h) -> struct(
        u.n + greatest(0L, h.start + h.size - greatest(u.reach, h.start)) as n,
        greatest(u.reach, h.start + h.size) as reach), u -> u.n)""")
    counted = (rows.join(known, ["fp", "words", "salt"], "left")
            .groupBy("id", "uid", "n_words")
            .agg(F.count(F.when(F.col("start").isNull(), 1)).alias("copies"),
                 F.array_sort(F.collect_set(F.when(found, F.struct("start", "size")))).alias("hits"),
                 F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
            .select(F.col("id").alias(id_col), "n_words", united.alias("n_hit"),
                    F.size("items").cast("bigint").alias("n_items"),
                    F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                    (F.size("hits") > 0).alias("contaminated"), "items", "copies"))
    return repeated(in_parts(counted)).drop("copies")


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no window of the benchmark, with all their columns. Rows that
    share an id stay or go together."""
    bad = (contamination(docs, benchmark, id_col, text_col).where("contaminated")
           .select(F.col(f"`{id_col}`").alias("bad")).distinct())
    rows = as_row(docs).withColumn("id", field(id_col))
    return from_row(rows.join(bad, F.col("id").eqNullSafe(F.col("bad")), "left_anti"),
                    docs.columns)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` against all of ``benchmark``."""
    return (contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
            .drop("items"))


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _sql_words(column: str) -> str:
    return _WORDS.format(_LOWER.format(f"coalesce({column}, '')"))


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_sql_words('text')} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, {_sql_words('text')} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), {WINDOW}) AS n,
              array_to_string(w[s:s + least(len(w), {WINDOW}) - 1], ' ') AS t
       FROM (SELECT *, unnest(range(1, greatest(len(w) - {WINDOW} + 1, least(len(w), 1)) + 1)) AS s
             FROM b)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, s, n, array_to_string(w[s:s + n - 1], ' ') AS t
       FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes)),
m AS (SELECT rid, s, dw.n, item FROM dw JOIN bw USING (n, t)),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (
          SELECT rid, unnest(range(s, s + n)) AS p FROM m) GROUP BY rid),
it AS (SELECT rid, count(DISTINCT item) AS n_items,
              string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN it USING (rid)
"""
