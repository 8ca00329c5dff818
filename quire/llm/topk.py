"""Exact top-k search by integer inner products.

Candidates are dealt into shards and queries into blocks, both by hash and both of a bounded size.
A tile is a block against a shard: its scores are computed as products of sub-matrices, and every
product adds to the best ``k`` of each query only what passes the ``k``-th best so far (partial
selection). Candidates come in rising id order, so ties never replace what is there. The top lists
of the shards are merged sixteen at a time up a tree, each merge a grouped aggregation of at most
``16 k`` entries.

Products are exact: 32-bit floats where every sum stays below 2**24, 64-bit floats below 2**53,
else integers of any size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import table
from quire.llm.vectors import distinct_vectors, in_parts, matrix, repeated
from quire.session import checkpoint_root

SCALE = 64
TOP = 20
SHARD_ROWS = 1 << 16
BLOCK_ROWS = 1 << 15
LEAST_ROWS = 512        # of a shard, while there are fewer than LEAST_SHARDS
LEAST_SHARDS = 64
MERGE_BITS = 4
_QUERIES, _CANDIDATES = 512, 8192       # of one product
_SCORE = (1 << 63) - 1                  # scores beyond saturate


def _exact(q: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Both matrices in the narrowest type whose products are exact, and the queries at a time."""
    most = [max(abs(int(a.max(initial=0))), abs(int(a.min(initial=0)))) for a in (q, c)]
    bound = most[0] * most[1] * max(1, q.shape[1])
    if bound < 1 << 24:
        return q.astype(np.float32), c.astype(np.float32), _QUERIES
    if bound < 1 << 53:
        return q.astype(np.float64), c.astype(np.float64), _QUERIES
    return q.astype(object), c.astype(object), 8


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    s = q @ c.T
    if s.dtype == object:
        s = np.array([[min(max(v, -_SCORE), _SCORE) for v in r] for r in s], dtype=np.int64)
    return s


def best(q: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score) of the ``k`` best candidates of every query, best first, ties by
    the smaller candidate number."""
    q, c, step = _exact(q, c)
    out = []
    for a in range(0, len(q), step):
        part = q[a:a + step]
        who = which = score = np.zeros(0, dtype=np.int64)
        least = None
        for b in range(0, len(c), _CANDIDATES):
            s = _scores(part, c[b:b + _CANDIDATES])
            if least is not None:
                r, j = np.nonzero(s > least[:, None])
            elif s.shape[1] > k:
                at = s.shape[1] - k
                r, j = np.nonzero(s >= np.partition(s, at, axis=1)[:, at:at + 1])
            else:
                r, j = np.nonzero(np.ones(s.shape, dtype=bool))
            who = np.concatenate((who, r))
            score = np.concatenate((score, s[r, j].astype(np.int64)))
            which = np.concatenate((which, j + b))
            order = np.lexsort((which, -score, who))
            first = np.searchsorted(who[order], np.arange(len(part)))
            keep = order[np.arange(len(order)) - first[who[order]] < k]
            who, which, score = who[keep], which[keep], score[keep]
            if len(who) == k * len(part):
                least = score[k - 1::k]
        out.append((who + a, which, score))
    return tuple(np.concatenate(x) if x else np.zeros(0, dtype=np.int64)
                 for x in (zip(*out, strict=True) if out else ((), (), ())))


def _tile(k: int) -> Callable:
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("id", "ascending")],
                                         null_placement="at_end"))
        width = max([0, *(pc.max(pc.binary_length(t["x"])).as_py() // 8
                          for t in (queries, rows) if len(t))])
        # one more than asked for: the query itself may be among them
        who, which, score = best(matrix(queries["x"], width), matrix(rows["x"], width), k + 1)
        n = rows["copies"].to_numpy()[which]
        own = {r: i for i, r in enumerate(zip(queries["id"].to_pylist(), queries["x"].to_pylist(),
                                              strict=True))} if len(rows) else {}
        at = [(own[r], i) for i, r in enumerate(zip(
            rows["id"].to_pylist(), rows["x"].to_pylist(), strict=True)) if r in own]
        if at:
            mine = np.full(len(queries), -1)
            mine[[a for a, _ in at]] = [i for _, i in at]
            n = n - (mine[who] == which)
        some = n > 0
        who, which, score, n = who[some], which[some], score[some], n[some]
        ids = rows["id"].combine_chunks().take(pa.array(which))
        has, first = np.unique(who, return_index=True)
        top = pa.StructArray.from_arrays(
            [pa.array(-score), pc.is_null(ids), ids, pa.array(n)], ["less", "no_id", "id", "n"])
        lists = pa.ListArray.from_arrays(
            pa.array(np.append(first, len(who)).astype(np.int32)), top)
        got = queries.take(pa.array(has))
        shard = queries["shard"][0].as_py() if len(queries) else 0
        return pa.table({"id": got["id"], "key": got["key"], "copies": got["copies"],
                         "node": pa.array(np.full(len(has), shard, dtype=np.int64)), "top": lists})

    return run


def top_k(df: DataFrame, is_query: Column, k: int = TOP, scale: int = SCALE,
          id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: of every row with ``is_query`` (a condition on the id
    column) the ``k`` other rows with the highest inner product of floor(scale * vector), all where
    there are fewer; ties go to the smaller id, null ids last.

    Vectors that are null, or hold a null, NaN or infinite entry, take no part. Shorter vectors count
    as filled with zeros; an empty one scores 0 everywhere. Entries and scores beyond a long
    saturate. Rows that repeat are rows of their own: each copy of a query has its own list, and the
    other copies are candidates. An empty table, or one without queries, gives an empty result.
    Other columns are not read.
    """
    spark = df.sparkSession
    checkpoint_root(spark)
    id_type = df.schema[id_col].dataType
    rows = distinct_vectors(df, id_col, vector_col, scale).checkpoint()
    asked = (rows.withColumnRenamed("id", id_col).where(is_query).withColumnRenamed(id_col, "id")
             .withColumn("key", F.md5("x")))
    n, m = rows.count(), asked.count()
    shards = max(-(-n // SHARD_ROWS), min(LEAST_SHARDS, -(-n // LEAST_ROWS)), 1)
    blocks = max(-(-m // BLOCK_ROWS), 1)
    left = (asked.withColumn("block", F.pmod(F.xxhash64("x", "id"), F.lit(blocks)))
            .withColumn("shard", F.explode(F.expr(f"sequence(0L, {shards - 1}L)"))))
    # new names for the same columns: a cogroup of a table with itself mixes them up otherwise
    right = (rows.select(*[F.col(c).alias(c) for c in rows.columns]).withColumn("shard", F.pmod(F.xxhash64("id", "x"), F.lit(shards)))
             .withColumn("block", F.explode(F.expr(f"sequence(0L, {blocks - 1}L)"))))
    entry = T.StructType([T.StructField("less", T.LongType()), T.StructField("no_id", T.BooleanType()),
                          T.StructField("id", id_type), T.StructField("n", T.LongType())])
    tops = (left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard"))
            .applyInArrow(_tile(k), T.StructType([
                T.StructField("id", id_type), *T.StructType.fromDDL(
                    "key string, copies long, node long").fields,
                T.StructField("top", T.ArrayType(entry))])))
    width = shards
    while width > 1:
        width = -(-width // (1 << MERGE_BITS))
        tops = (tops.withColumn("node", F.shiftright("node", MERGE_BITS))
                .groupBy("id", "key", "copies", "node")
                .agg(F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top")))
    each = F.slice(F.flatten(F.transform(
        "top", lambda t: F.array_repeat(t, F.least(t["n"], F.lit(k)).cast("int")))), 1, k)
    lists = in_parts(tops.select("id", "key", "copies", each.alias("top"))).repartition("id", "key", "part")
    return (repeated(lists)
            .select(F.col("id").alias("query_id"), F.posexplode("top").alias("pos", "t"))
            .select("query_id", (F.col("pos") + 1).alias("rank"), F.col("t.id").alias("vec_id"),
                    (-F.col("t.less")).alias("score")))


def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best others of every row of ``embeddings`` whose vec_id is divisible by 20."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


ORACLE = """
WITH e AS (
  SELECT row_number() OVER () AS rid, vec_id,
         list_transform(embedding, lambda c: floor(64 * c::DOUBLE)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (
  SELECT q.rid, q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
  FROM e q JOIN e c ON q.rid <> c.rid
  WHERE q.vec_id % 20 = 0),
r AS (
  SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id NULLS LAST) AS rank
  FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""
