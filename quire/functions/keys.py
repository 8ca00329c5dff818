"""Record keys and object paths as Columns.

Page keys pad to four digits and never truncate: ``format_string('%04d')`` and not ``lpad``,
which cuts ``10000`` down to ``1000``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.lifecycle import iso_utc

# Key prefixes and sort-key constants of the record model.
FILE_PREFIX = "FILE#"
DOC_PREFIX = "DOC#"
TENANT_PREFIX = "TENANT#"
PAGE_PREFIX = "PAGE#"
METADATA_SK = "METADATA"
STATUS_SK = "STATUS"
STATUS_INDEX_SUFFIX = "#STATUS"
RESULTS_NAME = "results.json"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def file_pk(file_id) -> Column:
    return F.concat(F.lit(FILE_PREFIX), _c(file_id).cast("string"))


def doc_pk(file_id) -> Column:
    return F.concat(F.lit(DOC_PREFIX), _c(file_id).cast("string"))


def page_sk(page_number) -> Column:
    """``PAGE#0001`` ... ``PAGE#9999``, ``PAGE#10000``: zero-padded to 4, never cut."""
    return F.format_string(PAGE_PREFIX + "%04d", _c(page_number))


def file_index_keys(tenant_id, uploaded_at) -> tuple[Column, Column]:
    """Tenant listing index: (``TENANT#<t>``, ``FILE#<uploadedAt ISO>``)."""
    return (F.concat(F.lit(TENANT_PREFIX), _c(tenant_id)),
            F.concat(F.lit(FILE_PREFIX), iso_utc(uploaded_at)))


def status_index_keys(tenant_id, created_at) -> tuple[Column, Column]:
    """Status listing index: (``TENANT#<t>#STATUS``, creation time ISO)."""
    return (F.concat(F.lit(TENANT_PREFIX), _c(tenant_id), F.lit(STATUS_INDEX_SUFFIX)),
            iso_utc(created_at))


def object_key(tenant_id, file_id, file_name) -> Column:
    """``<tenant>/<file>/<name>``: where the document bytes live."""
    return F.concat_ws("/", _c(tenant_id), _c(file_id).cast("string"), _c(file_name))


def results_key(tenant_id, file_id) -> Column:
    """``<tenant>/<file>/results.json``: where the manifest lives."""
    return F.concat_ws("/", _c(tenant_id), _c(file_id).cast("string"), F.lit(RESULTS_NAME))


def chunk_partition_key(tenant_id, file_id) -> Column:
    """Routing key of chunk events: ``<tenant>#<file>``."""
    return F.concat(_c(tenant_id), F.lit("#"), _c(file_id).cast("string"))


def path_parts(path) -> tuple[Column, Column, Column]:
    """(tenant, file, name) as the last three parts of an object path."""
    p = _c(path)
    rx = r"([^/]+)/([^/]+)/([^/]+)$"
    return (F.regexp_extract(p, rx, 1), F.regexp_extract(p, rx, 2), F.regexp_extract(p, rx, 3))
