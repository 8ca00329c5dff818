"""WARC archives with an index written first.

Writing: equal payloads are found by digest (partial aggregation; answers go back spread, since one
payload may be a third of all rows). Every task then streams its rows into one archive file, each
record a gzip member, and returns the index: file, offset, length, URL and digest per record. The
index is committed by Spark; a file of a failed attempt is in no index, so it is never read.

Reading: selected index rows are sorted by file and offset over tasks that read about
``TASK_READ`` bytes each (index rows are small, so their size says little); a task joins ranges that
lie close to reads of at most ``MOST_READ`` bytes and takes the records out of them.

Archives are files in a folder that all executors reach, opened through pyarrow's file systems by
URI (local paths, file://, and the object stores that pyarrow supports).
"""

from __future__ import annotations

import hashlib
import math
import posixpath
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import join_spread, table
from quire.llm.vectors import in_parts
from quire.session import checkpoint_root

LEAST_REVISIT = 100
NEAR = 1 << 16
MOST_READ = 1 << 23
TASK_READ = 1 << 25     # bytes of archive that a task reads, about
GZIP_LEVEL = 5
DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")      # the URL name space of RFC 4122
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_INDEX = ("file string, offset long, length long, url string, payload_digest string, "
          "payload_bytes long, record_type string, refers string")


def _urn(record_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'record/{record_id}')}>"


def _record(row: dict) -> bytes:
    """One record: WARC header, block, two line ends."""
    url = "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode())
                  for c in row["url"] or "")
    block = _HTTP + row["payload"] if row["type"] == "response" else _HTTP
    head = [f"WARC-Type: {row['type']}", f"WARC-Record-ID: {_urn(row['name'])}",
            f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}",
            f"WARC-Payload-Digest: sha256:{row['digest']}",
            f"X-Payload-Length: {row['bytes']}"]
    if row["type"] == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {_urn(row['refers'])}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(["WARC/1.1", *head, "", ""]).encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of one uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[:int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def _writer(folder: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, offset = None, "", 0
        try:
            for b in batches:
                if not len(b):
                    continue
                if out is None:
                    store, root = fs.FileSystem.from_uri(folder)
                    path = f"part-{uuid.uuid4()}.warc.gz"
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(posixpath.join(root, path), compression=None)
                index = []
                for row in b.to_pylist():
                    row["payload"] = (row["html"] or "").encode()
                    z = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
                    data = z.compress(_record(row)) + z.flush()
                    out.write(data)
                    index.append((path, offset, len(data), row["url"], row["digest"],
                                  row["bytes"], row["type"], row["refers"]))
                    offset += len(data)
                cols = list(zip(*index, strict=True))
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(),
                         pa.string(), pa.string())
                names = [c.split()[0] for c in _INDEX.split(", ")]
                yield pa.record_batch({"id": b["id"], "refers_to": b["refers_id"]}
                                      | {n: pa.array(c, k) for n, c, k in
                                         zip(names, cols, kinds, strict=True)})
        finally:
            if out is not None:
                out.close()

    return run


def _reader(folder: str, near: int, most: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = None, ""
        opened: dict = {}
        for b in batches:
            if store is None:
                store, root = fs.FileSystem.from_uri(folder)
            rows = b.select(["file", "offset", "length", "refers"]).to_pylist()
            types, digests, sizes, texts, refs, i = [], [], [], [], [], 0
            while i < len(rows):
                file, begin = rows[i]["file"], rows[i]["offset"]
                end, j = begin + rows[i]["length"], i + 1
                while (j < len(rows) and rows[j]["file"] == file and end <= rows[j]["offset"] <= end + near
                       and rows[j]["offset"] + rows[j]["length"] - begin <= most):
                    end, j = rows[j]["offset"] + rows[j]["length"], j + 1
                if file not in opened:
                    for f in opened.values():
                        f.close()
                    opened = {file: store.open_input_file(posixpath.join(root, file))}
                data = memoryview(opened[file].read_at(end - begin, begin))
                for r in rows[i:j]:
                    at = r["offset"] - begin
                    fields, payload = parse_record(zlib.decompress(data[at:at + r["length"]], 31))
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    full = fields["WARC-Type"] == "response"
                    if full and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"damaged payload in {file} at {r['offset']}")
                    if fields.get("WARC-Refers-To") != (r["refers"] and _urn(r["refers"])):
                        raise ValueError(f"index and record differ in {file} at {r['offset']}")
                    types.append(fields["WARC-Type"])
                    digests.append(digest)
                    sizes.append(len(payload) if full else int(fields["X-Payload-Length"]))
                    texts.append(payload.decode() if full else None)
                    refs.append(fields.get("WARC-Refers-To"))
                i = j
            yield pa.record_batch({
                "id": b["id"], "url": b["url"], "payload_bytes": pa.array(sizes, pa.int64()),
                "payload_digest": pa.array(digests, pa.string()),
                "record_type": pa.array(types, pa.string()), "refers_to": b["refers_to"],
                "refers_urn": pa.array(refs, pa.string()),
                "payload": pa.array(texts, pa.string())})
        for f in opened.values():
            f.close()

    return run


def write_archives(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html", least_revisit: int = LEAST_REVISIT) -> DataFrame:
    """Writes a record per row of ``df`` under ``folder`` (a URI all executors reach) and returns
    the committed index: id, refers_to, file, offset, length, url, payload_digest, payload_bytes,
    record_type.

    The payload is the html in UTF-8; null is empty. Of rows with equal payloads of at least
    ``least_revisit`` bytes the one with the smallest id (null last) is a response and the others
    are revisits of it; of rows that repeat that id the one with the smallest url is the response.
    Smaller payloads are all responses. A null url is an empty target; long payloads are one record.
    An empty table gives an empty index.
    """
    html = F.coalesce(F.col(f"`{html_col}`"), F.lit(""))
    pages = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"),
                      html.alias("html"), F.sha2(html, 256).alias("digest"),
                      F.octet_length(html).cast("bigint").alias("bytes"))
    pages = pages.withColumn("key", F.md5(F.concat(F.to_json(F.struct("id", "url")), "digest")))
    # equal rows are one entry, made on the map side
    entry = F.struct(F.col("id").isNull().alias("no_id"), "id", F.col("url").isNull().alias("no_url"),
                     "url")
    names = (pages.groupBy("key", "digest", "bytes")
             .agg(F.count(F.lit(1)).alias("n"), F.first(entry).alias("entry")))
    some = names.where(F.col("bytes") >= least_revisit)
    first = (some.groupBy("digest").agg(F.min("entry").alias("first"), F.sum("n").alias("n"))
             .where("n > 1").select("digest", "first"))
    again = (join_spread(some.select("key", "digest", "entry"), first, ["digest"], "key")
             .select("key", F.col("first.id").alias("refers_id"), F.lit(True).alias("again"),
                     F.col("entry").eqNullSafe(F.col("first")).alias("is_first")))
    # aggregate and join on one key, so that the pages are shuffled once
    rows = (pages.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.first(F.struct(
        "id", "url", "html", "digest", "bytes")).alias("p"))
            .join(again, "key", "left").select("copies", "p.*", "refers_id", "again", "is_first"))
    copy = (F.col("part") == 0) & (F.col("nth") == 1) & F.col("is_first")
    revisit = F.col("again").isNotNull() & ~copy
    rows = (in_parts(rows).withColumn("nth", F.explode(F.expr("sequence(1L, share)")))
            .select("id", "url", "html", "digest", "bytes",
                    F.when(revisit, "revisit").otherwise("response").alias("type"),
                    F.when(revisit, F.col("refers_id")).alias("refers_id"),
                    F.coalesce(F.col("id").cast("string"), F.lit("null")).alias("name"),
                    F.when(revisit, F.coalesce(F.col("refers_id").cast("string"),
                                               F.lit("null"))).alias("refers")))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType),
                           T.StructField("refers_to", rows.schema["id"].dataType),
                           *T.StructType.fromDDL(_INDEX).fields])
    rows.mapInArrow(_writer(folder), schema).write.parquet(f"{folder}/index")
    return df.sparkSession.read.parquet(f"{folder}/index")


def read_archives(index: DataFrame, folder: str, near: int = NEAR,
                  most: int = MOST_READ) -> DataFrame:
    """The records of the given index rows (any selection), read back from the archives: id, url,
    payload_bytes, payload_digest, record_type, refers_to, refers_urn, payload (null for a
    revisit). The digest of every payload read, and what a revisit refers to, is checked."""
    kind = index.schema["id"].dataType
    schema = T.StructType([
        T.StructField("id", kind), *T.StructType.fromDDL(
            "url string, payload_bytes long, payload_digest string, record_type string").fields,
        T.StructField("refers_to", kind),
        *T.StructType.fromDDL("refers_urn string, payload string").fields])
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, math.ceil(total / TASK_READ))
    return (index.select("id", "url", "refers_to", "refers", "file", "offset", "length")
            .repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
            .mapInArrow(_reader(folder, near, most), schema))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``pages`` written as archives in the cluster's shared folder, and read back."""
    folder = f"{checkpoint_root(spark)}/warc-{uuid.uuid4()}"
    index = write_archives(table(spark, sf_dir, "pages"), folder)
    return (read_archives(index, folder)
            .select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                    "refers_to"))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, encode(coalesce(html, '')) AS b FROM pages),
r AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha256(h) AS payload_digest,
             first_value(page_id) OVER w AS least, row_number() OVER w AS nr
      FROM p WINDOW w AS (PARTITION BY h ORDER BY page_id NULLS LAST))
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND nr > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND nr > 1 THEN least END AS refers_to
FROM r
"""
