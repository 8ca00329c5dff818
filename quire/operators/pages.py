"""Documents into pages (M1, W1), page keys, and the annotation prompt (M3).

A document row becomes one row per page with ``posexplode``; the page count is taken from the
same split, so the recorded total and the exploded pages can never disagree. Splitting is a
narrow transformation: no shuffle, and each page row only carries its own text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.keys import doc_pk, page_sk

# The annotation prompt wrapped around each page's text (indentation of the
# original template dropped; the text is inserted verbatim between head and tail).
PROMPT_HEAD = (
    "Analyze the following text from a single page of a document and provide a structured "
    "JSON response.\n"
    "The JSON should include:\n"
    "1. \"summary\": A brief summary of the page content.\n"
    "2. \"entities\": A list of key entities (people, organizations, locations, etc.) "
    "mentioned on this page.\n"
    "3. \"keyPoints\": A list of main points discussed on this page.\n"
    "4. \"sentiment\": The overall sentiment of the text.\n"
    "\n"
    "Text:\n"
)
PROMPT_TAIL = "\n\nReturn ONLY the JSON object.\n"


def join_items(items) -> Column:
    """Text items of one page joined with a single space (``items.map(str).join(' ')``)."""
    c = F.col(items) if isinstance(items, str) else items
    return F.array_join(F.transform(c, lambda x: x.cast("string")), " ", "")


def split_pages(docs: DataFrame, text_col: str = "text", sep: str = "\n",
                keep: tuple[str, ...] = ("file_id", "tenant_id")) -> DataFrame:
    """One row per page: ``keep`` columns, ``page_number`` (1-based), ``page_text``,
    ``total_pages``.

    ``sep`` is a regular expression. An empty document still has one (empty) page, the way a
    split of '' yields one element; a NULL text yields no pages (see ``document_errors``).
    """
    parts = F.split(F.col(text_col), sep, -1)
    return (docs.select(*keep, parts.alias("_parts"))
            .select(*keep, F.size("_parts").cast("int").alias("total_pages"),
                    F.posexplode("_parts").alias("_pos", "page_text"))
            .select(*keep, (F.col("_pos") + 1).cast("int").alias("page_number"),
                    "page_text", "total_pages"))


def spread_pages(pages: DataFrame, partitions: int | None = None,
                 keys: tuple[str, ...] = ("file_id", "page_number")) -> DataFrame:
    """Spread page rows over tasks before per-page work.

    All pages of a document are exploded in the task that read it, so one huge document would
    be annotated by a single task. Here every page is hash-spread on (file, page) over
    ``partitions`` tasks (default ``spark.sql.shuffle.partitions``; explicit, so adaptive
    execution does not coalesce them back): one shuffle of the pages, which per-page annotation
    work outweighs. Rows that already are pages need no spreading."""
    n = partitions or int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return pages.repartition(n, *keys)


def document_errors(docs: DataFrame, text_col: str = "text",
                    keep: tuple[str, ...] = ("file_id", "tenant_id")) -> DataFrame:
    """Documents that cannot be split (no text): one ``failed`` status row each (M7)."""
    return (docs.filter(F.col(text_col).isNull())
            .select(*keep, F.lit("failed").alias("overall_status")))


def with_page_keys(pages: DataFrame) -> DataFrame:
    """Add the record keys of each page (``DOC#<id>`` / ``PAGE#nnnn``)."""
    return pages.withColumn("pk", doc_pk("file_id")).withColumn("sk", page_sk("page_number"))


def prompt(text) -> Column:
    """The annotation prompt for one page. ``concat`` rather than a format string, since page
    text may contain ``%``."""
    c = F.col(text) if isinstance(text, str) else text
    return F.concat(F.lit(PROMPT_HEAD), F.coalesce(c, F.lit("")), F.lit(PROMPT_TAIL))
