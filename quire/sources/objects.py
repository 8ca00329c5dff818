"""Stored objects and written tables (S1, S2, S4, S5, S6, U4 for objects).

Documents live under ``<root>/<tenant>/<file>/<name>``. Reading them is a ``binaryFile`` (bytes)
or ``text`` (``wholetext``) scan with recursive lookup; tenant, file and name are the last three
path parts. Header-only reads select no ``content``, so Spark never opens the files' bodies.
Tables are written as Parquet partitioned by tenant (partition pruning for per-tenant reads);
never by file id, which would make one tiny file per document.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.jsonrules import indented_json
from quire.functions.keys import path_parts
from quire.operators.spread import semi_spread
from quire.sources.commits import latest_by, read_runs, write_run
from quire.schemas import MANIFEST


def _with_parts(df: DataFrame) -> DataFrame:
    tenant, file_id, name = path_parts("path")
    return df.withColumn("tenant_id", tenant).withColumn("file_id", file_id).withColumn(
        "file_name", name)


def read_documents(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """Document bytes (S1): path, modificationTime, length, content, tenant_id, file_id,
    file_name."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    return _with_parts(r.load(root))


def read_document_headers(spark: SparkSession, root: str, glob: str | None = None,
                          catalog: DataFrame | None = None) -> DataFrame:
    """Object headers without content (S2): length and modification time; the content column
    is pruned, so bodies are not read. The content type is what the writer recorded, not
    something read from the file: with ``catalog`` it is joined on as ``content_type``."""
    heads = read_documents(spark, root, glob).select(
        "path", "tenant_id", "file_id", "file_name", F.col("length").alias("content_length"),
        F.col("modificationTime").alias("last_modified"))
    if catalog is not None:
        kinds = catalog.groupBy("file_id").agg(F.max("mime_type").alias("content_type"))
        heads = heads.join(kinds, "file_id", "left")
    return heads


def read_document_texts(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """Whole texts of text documents (one row per file): path, text, tenant_id, file_id,
    file_name. Decoding is UTF-8 (F15)."""
    r = spark.read.option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    df = r.text(root, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    return _with_parts(df.withColumnRenamed("value", "text"))


def decode_utf8(content_col: str = "content"):
    """Bytes to text."""
    return F.decode(F.col(content_col), "UTF-8")


def write_catalog(files: DataFrame, path: str, mode: str = "append") -> None:
    """Catalogue write (S4): Parquet partitioned by tenant."""
    files.write.mode(mode).partitionBy("tenant_id").parquet(path)


def read_catalog(spark: SparkSession, path: str, tenant_id: str | None = None) -> DataFrame:
    """The catalogue as a keyed store (S4 "overwrite on same key"): the latest record per file
    by ``updated_at``, ties by the whole record (a partial aggregate per file). With ``tenant_id`` only that tenant's
    partition is read."""
    from quire.operators.log import latest_per_key
    df = spark.read.parquet(path)
    if tenant_id is not None:
        df = df.filter(F.col("tenant_id") == tenant_id)
    rest = [c for c in sorted(df.columns) if c not in ("file_id", "updated_at")]
    return latest_per_key(df, ["file_id"], ["updated_at", *rest])


def new_run_id() -> str:
    """A run id of its own. The order of runs is that of their commits, whatever their ids."""
    return f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"


def write_manifests(manifests: DataFrame, path: str, fmt: str = "json",
                    run_id: str | None = None) -> str:
    """Result manifests (S5), one row per document with its nested chunks. JSON keeps
    ``analysis: null`` (``ignoreNullFields=false``). Every run writes a folder of its own and then
    its commit record (``commits``); a document written again replaces its earlier result for
    readers, other documents are not touched. Returns the run id; give the same one again to retry
    a run."""
    run_id = run_id or new_run_id()
    options = {"ignoreNullFields": "false"} if fmt == "json" else {}
    write_run(manifests.sparkSession, path, run_id, {"manifests": manifests}, fmt, ["tenant_id"],
              **options)
    return run_id


def write_results(headers: DataFrame, chunks: DataFrame, path: str,
                  run_id: str | None = None) -> str:
    """Results as two Parquet tables under ``path``: ``headers`` (one row per document) and
    ``chunks`` (one row per page, clustered by document and page within each file). One commit
    record names both, so readers see a run whole or not at all. Returns the run id (see
    ``write_manifests``)."""
    run_id = run_id or new_run_id()
    ordered = chunks.sortWithinPartitions("tenant_id", "file_id", "page_number")
    write_run(headers.sparkSession, path, run_id, {"chunks": ordered, "headers": headers},
              partition_by=["tenant_id"])
    return run_id


def read_results(spark: SparkSession, path: str, tenant_id: str | None = None,
                 file_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(headers, chunks) as a keyed store holds them: of each document the result of the run that
    committed it last. A tenant or file filter reaches the scan. The chunks are matched to their
    header by document and commit, spread over the pages of a document."""
    h, c = read_runs(spark, path, "headers"), read_runs(spark, path, "chunks")
    for name, value in (("tenant_id", tenant_id), ("file_id", file_id)):
        if value is not None:
            h, c = h.filter(F.col(name) == value), c.filter(F.col(name) == value)
    h = latest_by(h, "file_id")
    c = semi_spread(c, h.select("file_id", "commit_seq"), ["file_id", "commit_seq"], "page_number")
    return h.drop("commit_seq"), c.drop("commit_seq")


def read_result(spark: SparkSession, path: str, file_id: str,
                tenant_id: str | None = None) -> DataFrame:
    """One document's result as a nested manifest row (S6): header and chunks filtered on the
    file id (and the tenant partition when given), then nested. No row when absent."""
    from quire.operators.manifest import nest_manifest
    h, c = read_results(spark, path, tenant_id, file_id)
    return nest_manifest(h, c)


def write_result_documents(docs: DataFrame, path: str, run_id: str | None = None,
                           indent: bool = False) -> str:
    """Result documents (``manifest_documents``) with their object key (``result_key``, the
    ``tenant/file/results.json`` they stand for), committed run by run. ``indent`` stores the text
    with two-space indentation, as an object a person would open. Returns the run id."""
    run_id = run_id or new_run_id()
    text = indented_json("json") if indent else F.col("json")
    docs = docs.select("tenant_id", "file_id", "result_key", text.alias("json"))
    write_run(docs.sparkSession, path, run_id, {"documents": docs}, partition_by=["tenant_id"])
    return run_id


def read_result_documents(spark: SparkSession, path: str) -> DataFrame:
    """Of each document the text of the run that committed it last: file_id, run_id, tenant_id,
    result_key, json."""
    return latest_by(read_runs(spark, path, "documents"), "file_id").drop("commit_seq")


def read_manifest(spark: SparkSession, path: str, file_id: str | None = None,
                  fmt: str = "json") -> DataFrame:
    """Read manifests back (S6) with the fixed schema, of each document that of the last commit;
    with ``file_id`` at most one row."""
    schema = T.StructType([*MANIFEST.fields, T.StructField("result_key", T.StringType())])
    df = read_runs(spark, path, "manifests", fmt, schema)
    df = df if file_id is None else df.filter(F.col("file_id") == file_id)
    return latest_by(df, "file_id").drop("run_id", "commit_seq")


def write_bucketed(df: DataFrame, name: str, path: str, buckets: int,
                   key: str = "file_id") -> DataFrame:
    """Write a table bucketed and sorted by ``key`` (an external table at ``path``) and return
    it read back. Tables written with the same bucket count join on ``key`` without a shuffle
    (status to files to pages), which pays when they are joined repeatedly."""
    (df.write.mode("overwrite").option("path", path).bucketBy(buckets, key).sortBy(key)
     .saveAsTable(name))
    return df.sparkSession.table(name)


def delete_objects(listing: DataFrame, deletions: DataFrame, key: str = "file_id") -> DataFrame:
    """Object deletion as a rewrite (U4): the listing minus the deleted keys (``left_anti``)."""
    return listing.join(deletions.select(key).distinct(), key, "left_anti")
