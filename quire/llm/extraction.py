"""Main text of web pages, with site templates removed.

1. Tasks parse whole pages and give the hashes of the element subtrees that could be template.
2. Spark counts, per host, the different pages that hold a subtree (partial aggregation; pages of a
   host with the same text are one, so copies of a page support no template). A subtree on at least
   ``MIN_PAGES`` of them is template; the number needed grows with the logarithm of the host's pages
   only.
3. The templates a page holds go back to it (spread, since a template of a large host is on very
   many pages), and its text is taken without them. Rows that repeat are parsed once.

Templates complement fixed rules for what never is article text (see ``html``). Running text
inside an article is never template: a paragraph that many articles share stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import join_spread, table
from quire.llm.html import candidates, main_text
from quire.llm.vectors import in_parts, repeated
from quire.session import checkpoint_root

MIN_PAGES = 5


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [candidates(x.as_py() or "") for x in b["html"]]
        yield pa.record_batch({
            "uid": b["uid"], "host": b["host"],
            "content": pa.array([c for _, c in found], pa.int64()),
            "subtrees": pa.array([sorted(s) for s, _ in found], pa.list_(pa.int64()))})


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        text = [main_text(x.as_py() or "", set(d.as_py() or ()))
                for x, d in zip(b["html"], b["template"], strict=True)]
        yield pa.record_batch({"id": b["id"], "url": b["url"], "copies": b["copies"], "text": pa.array(text, pa.string()),
                               "n_chars": pa.array([len(t) for t in text], pa.int64())})


def site_templates(subtrees: DataFrame, pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """subtrees: host, subtree, page; pages: host, page. The (host, subtree) pairs that are
    template; rows with the same ``page`` count once. Both counts are first reduced to one row per
    different page, so a host's rows are spread."""
    often = (subtrees.select("host", "subtree", "page").distinct()
             .groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("n"))
             .where(F.col("n") >= min_pages))
    of_host = (pages.select("host", "page").distinct()
               .groupBy("host").agg(F.count(F.lit(1)).alias("n_pages")))
    return (often.join(of_host, "host").where(F.col("n") >= F.floor(F.log2("n_pages")))
            .select("host", "subtree"))


def extract_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url",
                 html_col: str = "html", min_pages: int = MIN_PAGES) -> DataFrame:
    """One row per row of ``df``: the id, url, text, n_chars (code points).

    A null or empty page, and one without article text, gives an empty text; long pages are read
    whole. The host is the authority of the url in lower case; a null url or one without an authority
    is one more host (empty). Rows that repeat each get a row. White space of any kind becomes one
    space. Broken markup never fails. Other columns are not read.
    """
    checkpoint_root(df.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce(F.col(f"`{url_col}`"), F.lit("")),
                                    r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    pages = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"),
                      F.col(f"`{html_col}`").alias("html"), host.alias("host"))
    uid = F.md5(F.concat(F.to_json(F.struct("id", "url")), F.coalesce(F.md5("html"), F.lit(""))))
    pages = pages.withColumn("uid", uid)
    found = (pages.select("uid", "host", "html")
             .mapInArrow(_subtrees, "uid string, host string, content long, subtrees array<long>")
             .dropDuplicates(["uid"]).withColumnRenamed("content", "page").checkpoint())
    subtrees = found.select("uid", "host", "page", F.explode("subtrees").alias("subtree"))
    templates = site_templates(subtrees, found, min_pages)
    held = (join_spread(subtrees.drop("page"), templates, ["host", "subtree"], "uid")
            .groupBy("uid").agg(F.collect_set("subtree").alias("template")))
    types = [T.StructField("id", pages.schema["id"].dataType),
             T.StructField("url", pages.schema["url"].dataType),
             *T.StructType.fromDDL("copies long, text string, n_chars long").fields]
    # equal rows become one on the map side, before their page meets its templates
    once = pages.groupBy("uid").agg(
        F.count(F.lit(1)).alias("copies"),
        F.first(F.struct("id", "url", "html")).alias("p")).select("uid", "copies", "p.*")
    texts = (once.join(held, "uid", "left").select("id", "url", "html", "copies", "template")
             .mapInArrow(_texts, T.StructType(types)))
    return repeated(in_parts(texts)).drop("copies").withColumnsRenamed({"id": id_col, "url": url_col})


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all of ``pages``."""
    return extract_text(table(spark, sf_dir, "pages"))
