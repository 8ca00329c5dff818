"""Language identification by compression.

For each language the text of a bounded sample of labelled rows becomes a zstandard raw-content
dictionary. A text is cut into blocks, every block is compressed with every dictionary, and the
language whose dictionary gives the smallest sum wins. Where the runner-up is nearly as small the
text is rejected.

Training: per language at most ``SAMPLE_DOCS`` rows with a letter, those with the smallest hash of
their id and text (rows that agree in both count once), of each a piece at a hashed offset. Pieces are cut to one length at which all sampled rows
of the language fit ``DICT_BYTES``. With very many languages each gets a smaller sample and
dictionary, ``MODEL_BYTES`` in all, which bounds what the driver holds and broadcasts; what still
grows with their number is a row of counts each (thousands of languages, not millions). Prediction
reads whole texts and nothing but the text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import sample_rows, table

SAMPLE_DOCS = 256
SAMPLE_CHARS = 2048
DICT_BYTES = 1 << 17
MODEL_BYTES = 1 << 25
BLOCK_CHARS = 1024
LEVEL, SHORT_LEVEL = 3, 12     # a text of one block is compressed with more care
# On documents, 99 of 100 texts (100 characters or more) of a learned language have margins above
# 0.05; random letters (300 or more) and nine of ten texts of a language not learned have less.
MIN_MARGIN = 0.04
UNKNOWN = "und"

_NOT_LETTERS = re.compile(r"[\W\d_]+")

Model = dict[str, bytes]


def _letters(text: str) -> str:
    """Lower-case letters, any other run a single space."""
    return _NOT_LETTERS.sub(" ", text.lower()).strip()


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string")) % 4 == 2


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang") -> Model:
    """Dictionary per language from the rows of ``df`` with a language and a text with a letter; ids
    may be null or repeat. No such rows give an empty model."""
    text = F.col(f"`{text_col}`")
    rows = (df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").alias("lang"),
                      text.alias("text")).where(text.rlike(r"\p{L}")).where("lang is not null"))
    langs = max(1, rows.select("lang").distinct().count())
    size = min(DICT_BYTES, MODEL_BYTES // langs)
    docs = max(1, min(SAMPLE_DOCS, SAMPLE_DOCS * size // DICT_BYTES))
    window, at = 4 * SAMPLE_CHARS, F.xxhash64("id", F.lit("piece"), "text")
    start = F.pmod(at, F.greatest(F.lit(1), F.length("text") - window + 1)).cast("int") + 1
    sample = (sample_rows(rows, "lang", ["id", "text"], docs)
              .select("lang", "nr", at.alias("at"),
                      F.col("text").substr(start, F.lit(window)).alias("text")))
    texts: dict[str, list] = {}
    for r in sample.toLocalIterator():      # at most SAMPLE_DOCS pieces a language
        letters = _letters(r["text"])
        texts.setdefault(r["lang"], []).append(
            (r["nr"], _piece(letters, r["at"], SAMPLE_CHARS).encode(), r["at"]))
    return {lang: _dictionary(sorted(parts), size) for lang, parts in sorted(texts.items())}


def _piece(text: str | bytes, at: int, most: int) -> str | bytes:
    """At most ``most`` of the text, from an offset given by the hash ``at``."""
    start = (at >> 20) % max(1, len(text) - most + 1)
    return text[start:start + most]


def _dictionary(parts: list[tuple[int, bytes, int]], size: int) -> bytes:
    """Pieces of all parts, space-joined, of the greatest length at which they fit ``size``."""
    low, high = 0, max(len(p) for _, p, _ in parts)
    while low < high:
        mid = (low + high + 1) // 2
        if sum(min(len(p), mid) + 1 for _, p, _ in parts) <= size + 1:
            low = mid
        else:
            high = mid - 1
    return b" ".join(_piece(p, at, low) for _, p, at in parts)


def _compressor(data: bytes, level: int, **more) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters.from_level(
        level, source_size=BLOCK_CHARS, dict_size=len(data), write_content_size=False,
        write_checksum=False, write_dict_id=False, **more)
    d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=params)


@lru_cache(maxsize=4)
def _compressors(model: tuple) -> list:
    """Per language, in the model's order, a compressor for longer and one for short texts."""
    return [(_compressor(data, LEVEL), _compressor(data, SHORT_LEVEL, min_match=3))
            for _, data in model]


def _sizes(text: str, compressors: list) -> list[int]:
    """Compressed bytes of the whole text per dictionary."""
    blocks = [text[i:i + BLOCK_CHARS].encode() for i in range(0, len(text), BLOCK_CHARS)]
    short = len(blocks) == 1
    return [sum(len(c[short].compress(b)) for b in blocks) for c in compressors]


def _judge(text: str | None, langs: list[str], compressors: list,
           min_margin: float) -> tuple[str, float, float, bool]:
    letters = _letters(text or "")
    if not letters or not langs:
        return UNKNOWN, 0.0, 0.0, True
    sizes = _sizes(letters, compressors)
    best = min(range(len(langs)), key=lambda i: (sizes[i], langs[i]))
    rest = [s - sizes[best] for i, s in enumerate(sizes) if i != best]
    margin = min(rest) / sizes[best] if rest else 1.0
    score = 1 / (1 + sum(2.0 ** -min(d, 64) for d in rest))
    return langs[best], score, margin, margin < min_margin


def _predict(model: tuple, min_margin: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, comp = [k for k, _ in model], _compressors(model)
        for b in batches:
            out = [_judge(x.as_py(), langs, comp, min_margin) for x in b["text"]]
            yield pa.record_batch({
                "id": b["id"], "held_out": b["held_out"],
                "lang_pred": pa.array([x[0] for x in out], pa.string()),
                "score": pa.array([x[1] for x in out], pa.float64()),
                "margin": pa.array([x[2] for x in out], pa.float64()),
                "rejected": pa.array([x[3] for x in out], pa.bool_())})

    return run


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
             min_margin: float = MIN_MARGIN) -> DataFrame:
    """One row per row of ``df``: the id, held_out, lang_pred, score (0 to 1: 1 over the sum of 2
    to the minus bytes by which each language is larger), margin (by how much the runner-up is
    larger, relative), rejected (margin below ``min_margin``, or no language).

    A text that is null or has no letter, and any text where nothing was learned, is 'und' with
    score 0 and rejected. A tie goes to the language first in code-point order and is rejected. A
    single language learned has no runner-up: score and margin are 1. Long texts are compressed
    whole, block by block. Other columns are not read.
    """
    ids = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"),
                    F.coalesce(held_out(F.col(f"`{id_col}`")), F.lit(False)).alias("held_out"))
    schema = T.StructType([T.StructField("id", ids.schema["id"].dataType),
                           *T.StructType.fromDDL("held_out boolean, lang_pred string, score double,"
                                                 " margin double, rejected boolean").fields])
    return (ids.mapInArrow(_predict(tuple(model.items()), min_margin), schema)
            .withColumnRenamed("id", id_col))


def keep_identified(df: DataFrame, model: Model, text_col: str = "text",
                    min_margin: float = MIN_MARGIN) -> DataFrame:
    """The rows of ``df`` whose language is not rejected, with all their columns; no shuffle."""
    items = tuple(model.items())
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, comp = [k for k, _ in items], _compressors(items)
        for b in batches:
            keep = [not _judge(x.as_py(), langs, comp, min_margin)[3] for x in b.column(at)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return df.mapInArrow(run, df.schema)


def learned_from(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows that a model may learn from."""
    return df.where(~F.coalesce(held_out(F.col(f"`{id_col}`")), F.lit(False)))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all of ``documents``, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(learned_from(docs)))
