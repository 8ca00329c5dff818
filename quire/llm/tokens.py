"""Token counts by prefix dynamic programming (see ``bpe``), per row in Arrow batches.

The vocabulary file is read once per Python worker, by a path that every worker can open."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.bpe import counter
from quire.llm.common import table

LIMIT = 512
VOCABULARY = "byte_bpe_50k.json"


def _counted(path: str, limit: int, prefixes: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = counter(path)
        for b in batches:
            text = pc.fill_null(b["text"], "")
            both = [bpe.total_and_fit(x.as_py(), limit) for x in text]
            cols = {"id": b["id"], "n_bytes": pc.binary_length(text).cast(pa.int64()),
                    "n_tokens": pa.array([n for n, _ in both], pa.int64()),
                    "over_limit": pa.array([n > limit for n, _ in both], pa.bool_()),
                    "fit_chars": pa.array([c for _, c in both], pa.int64())}
            if prefixes:
                cols["prefix_tokens"] = pa.array([bpe.prefixes(x.as_py()).tolist() for x in text],
                                                 pa.list_(pa.int32()))
            yield pa.record_batch(cols)

    return run


def token_counts(df: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id",
                 text_col: str = "text", prefixes: bool = False) -> DataFrame:
    """One row per row of ``df``: the id, n_bytes (UTF-8), n_tokens, over_limit (more than
    ``limit`` tokens), fit_chars (code points of the longest prefix of at most ``limit`` tokens).
    With ``prefixes``, also prefix_tokens: entry ``i`` is the token count of the first ``i`` code
    points, so any later truncation or budget question is a lookup.

    A special string of the vocabulary inside a text is one token, as the library has it. A null
    or empty text has no bytes and no tokens. Other columns are not read.
    """
    ids = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([T.StructField("id", ids.schema["id"].dataType),
                           *T.StructType.fromDDL("n_bytes long, n_tokens long, over_limit boolean,"
                                                 " fit_chars long").fields])
    if prefixes:
        schema = schema.add("prefix_tokens", T.ArrayType(T.IntegerType()))
    return (ids.mapInArrow(_counted(path, limit, prefixes), schema)
            .withColumnRenamed("id", id_col))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all of ``documents``."""
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
