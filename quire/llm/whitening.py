"""Embedding whitening by a covariance over distinct vectors, weighted by how often they occur.

1. Equal x vectors are grouped (partial counts before the shuffle); a distinct vector is kept once
   with its weight.
2. Exact integer sums per dimension give the mean. Tasks centre their distinct vectors and add up
   one weighted matrix product each; the products are summed per cell. Only sums and the d x d
   covariance reach the driver: its size is that of the dimension squared, whatever the rows.
3. Every distinct vector is whitened once; rows fetch it by a join whose hot keys are spread.
4. The covariance of what came out is measured the same way (weighted, centred first) and compared
   with the identity.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import join_spread, table
from quire.llm.vectors import distinct_vectors, in_parts, matrix, repeated
from quire.session import checkpoint_root

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
FLAT = 1e-12            # eigenvalues up to this share of the largest have no direction
_ROWS = 1 << 13


@dataclass
class Fit:
    """n vectors with sums per dimension; eigenvalues (falling), unit eigenvectors as columns (the
    entry of the largest size is positive), trace of the covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def steep(self) -> np.ndarray:
        """Components that can be scaled to unit variance."""
        return self.values > FLAT * max(self.values.max(initial=0), 0)


def _integers(x: np.ndarray, n: int) -> np.ndarray:
    """``x``, as Python integers where n times an entry could leave 64 bits."""
    most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    return x if most * max(n, 1) < 1 << 61 else x.astype(object)


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for a in range(0, len(b), _ROWS):
            yield b.slice(a, _ROWS)


def _sums(n: int, d: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * d
        for b in _steps(batches):
            part = b["weight"].to_numpy() @ _integers(matrix(b["x"], d), n)
            total = [t + int(p) for t, p in zip(total, part, strict=True)]
        yield pa.record_batch({"dim": pa.array(range(d), pa.int32()),
                               "s": pa.array([str(t) for t in total])})

    return run


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact."""
    x = _integers(x, 2 * n)
    return x * n - np.array(sums, dtype=object if x.dtype == object else np.int64)


def _products(d: int, rows: Callable) -> Callable:
    """Per task the weighted product of the centred rows, upper half, cell by cell."""
    up = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for b in _steps(batches):
            c = rows(b)
            total += (c * b["weight"].to_numpy()[:, None]).T @ c
        yield pa.record_batch({"cell": pa.array(up[0].astype(np.int64) * d + up[1]),
                               "v": pa.array(total[up])})

    return run


def _covariance(vectors: DataFrame, n: int, d: int, rows: Callable) -> np.ndarray:
    cells = (vectors.mapInArrow(_products(d, rows), "cell long, v double")
             .groupBy("cell").agg(F.sum("v").alias("v")).toArrow())
    out = np.zeros(d * d)
    out[cells["cell"].to_numpy()] = cells["v"].to_numpy() / n
    out = out.reshape(d, d)
    return out + np.triu(out, 1).T


def _weighted(vectors: DataFrame, d: int) -> tuple[int, list[int]]:
    n = vectors.agg(F.sum("weight")).first()[0]
    got = (vectors.mapInArrow(_sums(n, d), "dim int, s string")
           .groupBy("dim").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect())
    sums = {r["dim"]: int(r["s"]) for r in got}
    return n, [sums[i] for i in range(d)]


def fit(vectors: DataFrame, d: int) -> Fit:
    """Eigenvectors of the covariance of ``vectors`` (x, weight), all of ``d`` entries."""
    n, sums = _weighted(vectors, d)

    def rows(b: pa.RecordBatch) -> np.ndarray:
        return _deviations(matrix(b["x"], d), n, sums).astype(np.float64) / n

    v = _covariance(vectors, n, d, rows)
    values, own = np.linalg.eigh(v)
    values, own = np.maximum(values[::-1], 0), own[:, ::-1]
    biggest = own[np.abs(own).argmax(axis=0), np.arange(d)]
    return Fit(n, sums, values, own * np.where(biggest < 0, -1, 1), float(np.trace(v)))


def _whitened(f: Fit, d: int, k: int) -> Callable:
    steep = f.steep[:k]
    scaled = f.vectors[:, :k][:, steep] / np.sqrt(f.values[:k][steep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _steps(batches):
            dev = _deviations(matrix(b["x"], d), f.n, f.sums)
            z = np.full((len(b), k), np.nan)
            z[:, steep] = dev.astype(np.float64) / f.n @ scaled
            big = max(abs(int(dev.max(initial=0))), abs(int(dev.min(initial=0)))) ** 2 * d >= 1 << 62
            square = ((dev.astype(object) if big else dev) ** 2).sum(axis=1)
            yield pa.record_batch({
                "key": b["key"], "weight": b["weight"],
                "z": pa.ListArray.from_arrays(
                    pa.array(np.arange(len(b) + 1, dtype=np.int32) * k), pa.array(z.ravel())),
                "deviation": pa.array([str(s) for s in square])})

    return run


def _identity_error(done: DataFrame, f: Fit, k: int) -> float | None:
    """Largest entry, by size, of the covariance of the whitened vectors minus the identity."""
    steep = np.flatnonzero(f.steep[:k])
    if not len(steep):
        return None
    sums = (done.select(F.posexplode("z").alias("i", "v"), "weight").groupBy("i")
            .agg(F.sum(F.coalesce("v", F.lit(0.0)) * F.col("weight")).alias("s")).collect())
    mean = np.zeros(k)
    for r in sums:
        mean[r["i"]] = r["s"] / f.n

    def rows(b: pa.RecordBatch) -> np.ndarray:
        z = b["z"].flatten().to_numpy(zero_copy_only=False).reshape(len(b), k)
        return (z - mean)[:, steep]

    got = _covariance(done.select("z", "weight"), f.n, len(steep), rows)
    return float(np.abs(got - np.eye(len(steep))).max())


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
           components: int = COMPONENTS, weights: str = "count", scale: int = SCALE,
           offset: int = OFFSET) -> DataFrame:
    """One row per row of ``df`` whose vector takes part: the id, n, deviation (decimal), whitened
    (array, one entry per component), explained (array), identity_error.

    x is floor(scale * vector) + offset. ``weights`` says how often a distinct x counts in the fit:
    ``count``, as often as it occurs, or ``one``. Vectors that are null, or hold a null, NaN or
    infinite entry, do not take part, nor do those whose length is not the commonest (of equally
    common ones the shorter). Entries beyond a long saturate. Components with no variance (at most
    1e-12 of the largest) have a null in whitened and count nothing in identity_error, which is null
    where no component varies; explained is null where the trace is 0. deviation is null beyond 38
    digits. Repeated rows and null ids each keep a row. An empty table, or one of empty vectors,
    gives an empty result. Other columns are not read.
    """
    if weights not in ("count", "one"):
        raise ValueError("weights: count or one")
    checkpoint_root(df.sparkSession)
    id_type = df.schema[id_col].dataType
    every = distinct_vectors(df, id_col, vector_col, scale, offset).checkpoint()
    common = (every.groupBy(F.octet_length("x").alias("bytes")).agg(F.sum("copies").alias("n"))
              .orderBy(F.desc("n"), "bytes").first())
    d = common["bytes"] // 8 if common else 0
    rows = every.where(F.octet_length("x") == 8 * d).withColumn("key", F.md5("x"))
    schema = T.StructType([
        T.StructField("id", id_type), *T.StructType.fromDDL(
            "n long, deviation decimal(38,0), whitened array<double>, explained array<double>,"
            " identity_error double").fields])
    if not d:
        return df.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    weight = F.sum("copies") if weights == "count" else F.lit(1).cast("bigint")
    vectors = rows.groupBy("x").agg(weight.alias("weight")).withColumn("key", F.md5("x")).checkpoint()
    f = fit(vectors, d)
    k = min(components, d)
    done = (vectors.mapInArrow(_whitened(f, d, k),
                               "key string, weight long, z array<double>, deviation string")
            .withColumn("z", F.transform("z", lambda v: F.nullif(v, F.lit(float("nan")))))
            .checkpoint())
    error = _identity_error(done, f, k)
    share = [float(v / f.trace) if f.trace > 0 else None for v in f.values[:k]]
    spread = in_parts(rows.select("id", "key", "copies")).withColumn(
        "place", F.xxhash64("id", "part"))
    out = join_spread(spread, done.drop("weight"), ["key"], "place")
    return (repeated(out)
            .select(F.col("id").alias(id_col), F.lit(f.n).cast("bigint").alias("n"),
                    F.expr("try_cast(deviation as decimal(38,0))").alias("deviation"),
                    F.col("z").alias("whitened"),
                    F.array(*[F.lit(s).cast("double") for s in share]).alias("explained"),
                    F.lit(error).cast("double").alias("identity_error")))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``embeddings``, a row per component. A deviation that leaves a long is null."""
    out = whiten(table(spark, sf_dir, "embeddings"))
    both = F.posexplode(F.arrays_zip("whitened", "explained")).alias("i", "c")
    return (out.select("vec_id", "n", "deviation", "identity_error", both)
            .select("vec_id", (F.col("i") + 1).alias("component"), "n",
                    F.expr("try_cast(deviation as bigint)").alias("deviation"),
                    F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"),
                    "identity_error"))
