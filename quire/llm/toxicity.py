"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

The model has one weight per feature, shared by all thresholds, and ordered thresholds
``t_1 < t_2 < ...``: ``P(grade < k) = sigmoid(t_k - w x)``. It gives the expected severity
``sum_k P(grade >= k)``.

Features are the distinct words of a text and their first four and five letters, present or not.
Those are kept that are ``LEAST_LIFT`` times as frequent among the features of toxic texts, beyond
chance, the ``MOST_FEATURES`` strongest; a text without any of them is as clean as can be.

Training uses a bounded sample of the labelled ids: at most ``SAMPLE_TOXIC`` and ``SAMPLE_CLEAN``
ids, those with the smallest hash, and one document of each. Spark counts their features; the driver receives only
the kept features of the sampled rows and fits the weights with full-batch steps, so the fit is
the same on every run. Prediction covers every row and whole texts.

Where labels are yes or no, ``grades`` makes three grades of them: 0 clean, and among the toxic
rows 1 for those whose evidence is no more than the median and 2 for the rest. A row's evidence is
its score under a yes/no model fitted without it (two halves, each scored by the other's model).
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import sample_rows, table

SAMPLE_TOXIC, SAMPLE_CLEAN = 4096, 12288
MIN_ROWS = 3
LEAST_LIFT = 3.0
MOST_FEATURES = 4096
STEPS, RATE, PENALTY = 600, 0.05, 1e-4
CUT = 0.5

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@dataclass(frozen=True)
class Model:
    weights: tuple[tuple[str, float], ...]
    thresholds: tuple[float, ...]


def _features(text: str | None) -> set[str]:
    words = set(_WORD.findall((text or "").lower()))
    return words | {"4" + w[:4] for w in words if len(w) > 4} | {
        "5" + w[:5] for w in words if len(w) > 5}


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.record_batch({
            "id": b["id"], "toxic": b["toxic"],
            "features": pa.array([sorted(_features(x.as_py())) for x in b["text"]],
                                 pa.list_(pa.string()))})


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The sampled rows: id, toxic, features."""
    chosen = sample_rows(labels.where("id is not null and toxic is not null"), "toxic", ["id"],
                         {True: SAMPLE_TOXIC, False: SAMPLE_CLEAN}).select("id", "toxic")
    kind = docs.schema["id"].dataType
    # of documents that share an id one, picked on the map side, so the sample keeps its bound
    return (docs.join(F.broadcast(chosen), "id").groupBy("id", "toxic")
            .agg(F.min_by("text", F.struct(F.col("text").isNull(), F.xxhash64("text"))).alias("text"))
            .select("id", "toxic", "text")
            .mapInArrow(_featured, T.StructType([
                T.StructField("id", kind), *T.StructType.fromDDL(
                    "toxic boolean, features array<string>").fields])))


def _kept_features(sample: DataFrame) -> dict[str, tuple[int, int]]:
    """feature: rows with it among toxic and clean ones; at most MOST_FEATURES. Toxic rows hold the
    part q of all features; a feature found in a of its n rows there must have a likelihood ratio
    against q that no feature would reach by chance."""
    counts = (sample.select("toxic", F.explode("features").alias("f")).groupBy("f")
              .agg(F.count(F.when(F.col("toxic"), 1)).cast("double").alias("a"),
                   F.count(F.when(~F.col("toxic"), 1)).cast("double").alias("b")))
    tested, in_toxic, in_clean = counts.agg(
        F.count(F.when(F.col("a") + F.col("b") >= MIN_ROWS, 1)), F.sum("a"), F.sum("b")).first()
    if not tested or not in_toxic or not in_clean:
        return {}
    a, b, q = F.col("a"), F.col("b"), in_toxic / (in_toxic + in_clean)
    n = a + b
    ratio = a * F.log(a / (n * q)) + F.when(b > 0, b * F.log(b / (n * (1 - q)))).otherwise(0.0)
    best = (counts.where((n >= MIN_ROWS) & (a / in_toxic >= LEAST_LIFT * b / in_clean))
            .withColumn("ratio", ratio).where(F.col("ratio") >= math.log(tested) + 1)
            .orderBy(F.desc("ratio"), "f").limit(MOST_FEATURES))
    return {r["f"]: (int(r["a"]), int(r["b"])) for r in best.collect()}


def _fit(rows: np.ndarray, cols: np.ndarray, grade: np.ndarray, n_cols: int) -> tuple:
    """Weights and thresholds that lower the mean loss: Adam steps on the whole sample, the
    thresholds as a first one and logarithms of the gaps."""
    top = int(grade.max())
    cost = 1.0 / len(grade)
    w = np.zeros(n_cols)
    t = np.concatenate(([0.0], np.zeros(top - 1)))
    par = np.concatenate((w, t))
    m, v = np.zeros_like(par), np.zeros_like(par)
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    for step in range(1, STEPS + 1):
        w, t = par[:n_cols], par[n_cols:]
        cut = t[0] + np.concatenate(([0.0], np.cumsum(np.exp(t[1:]))))
        x = np.bincount(rows, weights=w[cols], minlength=len(grade))
        edges = np.concatenate(([-np.inf], cut, [np.inf]))
        hi, lo = sig(edges[grade + 1] - x), sig(edges[grade] - x)
        lo = np.where(grade == 0, 0.0, lo)
        hi = np.where(grade == top, 1.0, hi)
        p = np.maximum(hi - lo, 1e-12)
        dh, dl = hi * (1 - hi) / p, lo * (1 - lo) / p
        gx = cost * (dh - dl)
        gw = np.bincount(cols, weights=gx[rows], minlength=n_cols) + PENALTY * w
        gc = np.zeros(top + 2)
        np.add.at(gc, grade + 1, -cost * dh)
        np.add.at(gc, grade, cost * dl)
        gc = gc[1:top + 1]
        gt = np.concatenate(([gc.sum()], np.cumsum(gc[::-1])[::-1][1:] * np.exp(t[1:])))
        g = np.concatenate((gw, gt))
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        par = par - RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    w, t = par[:n_cols], par[n_cols:]
    return w, t[0] + np.concatenate(([0.0], np.cumsum(np.exp(t[1:]))))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        toxic_col: str = "toxic") -> Model:
    """A model from labelled documents. Labels without a document, and null labels, don't count; a
    label that repeats counts once (an id may be labelled both ways), and of documents that share an
    id one counts. Long texts are read whole. Without rows of both kinds, or features that tell them
    apart, the model has no weights and finds nothing."""
    docs = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    labels = labels.select(F.col(f"`{id_col}`").alias("id"),
                           (F.col(f"`{toxic_col}`").cast("int") > 0).alias("toxic"))
    sample = _sample(docs, labels).cache()
    try:
        n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
        if not n.get(True) or not n.get(False):
            return Model((), ())
        kept = _kept_features(sample)
        if not kept:
            return Model((), ())
        names = sorted(kept)
        at = {f: i for i, f in enumerate(names)}
        lit = F.array(*[F.lit(f) for f in names])
        data = (sample.select("id", "toxic",
                              F.array_intersect("features", lit).alias("features"))
                .orderBy("id", "toxic").collect())
    finally:
        sample.unpersist()
    rows = np.array([i for i, r in enumerate(data) for _ in r["features"]], dtype=np.int64)
    cols = np.array([at[f] for r in data for f in r["features"]], dtype=np.int64)
    toxic = np.array([r["toxic"] for r in data])
    w, cut = _fit(rows, cols, grades(toxic, _evidence(rows, cols, toxic, len(names))), len(names))
    return Model(tuple((f, float(x)) for f, x in zip(names, w, strict=True)),
                 tuple(float(x) for x in cut))


def _evidence(rows: np.ndarray, cols: np.ndarray, toxic: np.ndarray, n_cols: int) -> np.ndarray:
    """Per row its score under a yes/no model fitted on the other half of the rows."""
    out = np.zeros(len(toxic))
    # every other row of either kind, so that both halves have both
    half = np.empty(len(toxic), dtype=np.int64)
    for kind in (True, False):
        half[toxic == kind] = np.arange((toxic == kind).sum()) % 2
    for side in (0, 1):
        fit_on, score = np.flatnonzero(half != side), half == side
        if not toxic[fit_on].any() or toxic[fit_on].all():
            continue
        at = np.full(len(toxic), -1)
        at[fit_on] = np.arange(len(fit_on))
        keep = at[rows] >= 0
        w, _ = _fit(at[rows[keep]], cols[keep], toxic[fit_on].astype(np.int64), n_cols)
        x = np.bincount(rows, weights=w[cols], minlength=len(toxic))
        out[score] = x[score]
    return out


def grades(toxic: np.ndarray, evidence: np.ndarray) -> np.ndarray:
    """0 clean; of the toxic rows 2 those with more evidence than their median, 1 the others."""
    out = toxic.astype(np.int64)
    if toxic.any():
        out[toxic & (evidence > np.median(evidence[toxic]))] = 2
    return out


def _scored(model: Model, cut: float) -> Callable:
    weights, cuts = dict(model.weights), np.array(model.thresholds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = weights.keys()
        for b in batches:
            x = np.array([sum(weights[f] for f in sorted(known & _features(t.as_py())))
                          for t in b["text"]], dtype=float)
            over = 1 / (1 + np.exp(np.clip(cuts[None, :] - x[:, None], -40, 40)))
            if not len(cuts):
                over = np.zeros((len(x), 1))
            yield pa.record_batch({
                "id": b["id"], "severity": pa.array(over.sum(axis=1)),
                "p_toxic": pa.array(over[:, 0].copy()),
                "grade": pa.array((over >= cut).sum(axis=1).astype(np.int64)),
                "toxic": pa.array(over[:, 0] >= cut)})

    return run


def severity(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
             cut: float = CUT) -> DataFrame:
    """One row per row of ``df``: the id, severity (expected grade), p_toxic (chance of grade 1 or
    more), grade (thresholds passed with a chance of at least ``cut``), toxic (grade 1 or more).

    A null text has no features, like an empty one; it gets what the thresholds alone say. With an
    empty model everything is grade 0 with severity 0. Other columns are not read."""
    ids = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([T.StructField("id", ids.schema["id"].dataType), *T.StructType.fromDDL(
        "severity double, p_toxic double, grade long, toxic boolean").fields])
    return ids.mapInArrow(_scored(model, cut), schema).withColumnRenamed("id", id_col)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity of all of ``documents``, learned from ``labels``."""
    docs = table(spark, sf_dir, "documents")
    return severity(docs, fit(docs, table(spark, sf_dir, "labels")))
