"""Session helpers.

Runtime SQL settings the library relies on are applied with ``ensure_session_conf``; cluster
settings (memory, executors, checkpoint folder) belong to whoever builds the session.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Runtime SQL settings every query in the library depends on.
#  * variant.allowDuplicateKeys: a strict JSON parser keeps the last duplicate key; Spark's
#    variant parser rejects the document unless this is on (then it also keeps the last).
#  * mapKeyDedupPolicy LAST_WIN: ``map_concat`` must let later keys overwrite earlier ones, the
#    way an object spread does when an event payload is merged into its envelope.
#  * session.timeZone UTC: ISO-8601 'Z' strings and epoch-second retention stamps.
REQUIRED_CONF = {
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.session.timeZone": "UTC",
}

# Settings that shape physical plans at scale; applied only when the caller left them unset.
SCALE_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Top-k per group (row_number() <= k) gets a partial per-partition limit before the shuffle.
    "spark.sql.optimizer.windowGroupLimitThreshold": "1000",
}


def ensure_session_conf(spark: SparkSession) -> SparkSession:
    """Apply the settings the library's semantics depend on; idempotent."""
    for k, v in REQUIRED_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    for k, v in SCALE_DEFAULTS.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for lineage cuts and streaming checkpoints.

    Read from ``spark.checkpoint.dir`` (what the cluster names). Only when it is unset in local
    mode (tests), a scratch folder is created and registered; on a cluster an unset setting is
    an error, since a machine-local folder is not visible to other executors.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - remote session: the server owns the context
        sc = None
    if not root:
        if sc is None or not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="quire-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    if sc is not None and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "quire", extra: dict[str, str] | None = None) -> SparkSession:
    """Local/test session builder. On a cluster, use the cluster's own session instead."""
    master = master or os.environ.get("QUIRE_MASTER", "local[8]")
    b = (SparkSession.builder.master(master).appName(app_name)
         .config("spark.ui.enabled", "false")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         # lineage-cut files are removed once nothing references them
         .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in {**REQUIRED_CONF, **SCALE_DEFAULTS, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_session_conf(spark)
    checkpoint_root(spark)
    return spark


def start_with_partitions(writer, spark: SparkSession, partitions: int | None):
    """Start a streaming writer with ``partitions`` state partitions (fixed by the checkpoint at
    the first start; later starts keep the checkpoint's number). The session setting is
    changed only for the start call: a started query works on its own copy of the session."""
    if not partitions:
        return writer.start()
    key = "spark.sql.shuffle.partitions"
    prev = spark.conf.get(key)
    spark.conf.set(key, str(int(partitions)))
    try:
        return writer.start()
    finally:
        spark.conf.set(key, prev)
