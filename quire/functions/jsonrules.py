"""JSON rules as native Columns: strict parsing, JavaScript truthiness, reply extraction.

All helpers return Catalyst expressions, so they stay inside whole-stage codegen and never block
predicate pushdown. The Column helpers reference their argument several times: pass a column
reference, not an expensive expression. The ``with_*`` DataFrame helpers stage intermediate
values as columns, so each parse runs once per row (Catalyst will not collapse a projection
that would duplicate an expensive expression).
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Outcome labels a page analysis can take in the manifest.
OUTCOME_SUCCESS = "success"
OUTCOME_FAILED = "failed"
OUTCOME_MISSING = "missing"   # no analysis stored: labelled success, counted in neither total
OUTCOME_INVALID = "invalid"   # unparsable text or JSON null: the whole document fails

_NUMERIC_TYPES = ("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strict_json(text) -> Column:
    """Parse JSON text into a VARIANT the way a strict parser does; NULL when it would throw.

    ``try_parse_json`` alone accepts trailing text (``{"a":1},{"b":2}`` gives the first object),
    so the text must also be exactly one element in two bracket wrappings: ``[t]`` must hold one
    element and ``[t,0]`` two. Trailing junk after the first value starts with ``]`` (closes the
    second wrapping early) or ``,`` (adds elements to the first); either way one check fails.
    Duplicate keys keep the last value when ``spark.sql.variant.allowDuplicateKeys`` is on (see
    ``quire.session``).
    """
    t = _c(text)
    one = F.json_array_length(F.concat(F.lit("["), t, F.lit("]"))) == 1
    two = F.json_array_length(F.concat(F.lit("["), t, F.lit(",0]"))) == 2
    return F.when(F.coalesce(one & two, F.lit(False)), F.try_parse_json(t))


def truthy(v) -> Column:
    """JavaScript truthiness of a VARIANT value; SQL NULL (absent) is falsy.

    Falsy: absent, JSON null, false, any number equal to 0, the empty string.
    Truthy: everything else, including "0", "false", [] and {}.
    """
    v = _c(v)
    t = F.schema_of_variant(v)
    return (
        F.when(v.isNull(), F.lit(False))
        .when(t == "VOID", F.lit(False))
        .when(t == "BOOLEAN", F.coalesce(F.try_variant_get(v, "$", "boolean"), F.lit(False)))
        .when(t == "STRING", F.coalesce(F.try_variant_get(v, "$", "string") != "", F.lit(False)))
        .when(t.startswith("DECIMAL") | t.isin(*_NUMERIC_TYPES),
              F.coalesce(F.try_variant_get(v, "$", "double") != 0, F.lit(False)))
        .otherwise(F.lit(True))
    )


def error_is_truthy(v) -> Column:
    """``parsed.error`` is truthy. Non-objects (arrays, numbers, strings) have no ``error``."""
    return truthy(F.try_variant_get(_c(v), "$.error", "variant"))


def outcome_of(text, parsed, error_value) -> Column:
    """Outcome of one stored page analysis (the manifest truth table), from the text, its
    strict parse and the parsed ``error`` member (all column references).

    * NULL or ''                       -> missing  (labelled success, in neither count)
    * unparsable, or the JSON ``null`` -> invalid  (fails the whole document)
    * object with a truthy ``error``   -> failed
    * any other JSON value             -> success
    """
    t, v = _c(text), _c(parsed)
    return (
        F.when(t.isNull() | (t == ""), F.lit(OUTCOME_MISSING))
        .when(v.isNull() | F.is_variant_null(v), F.lit(OUTCOME_INVALID))
        .when(truthy(error_value), F.lit(OUTCOME_FAILED))
        .otherwise(F.lit(OUTCOME_SUCCESS))
    )


def page_outcome(analysis_text) -> Column:
    """Single-expression form of ``outcome_of`` (for literals and tests; it repeats the parse,
    so on tables prefer ``with_outcome``)."""
    v = strict_json(analysis_text)
    return outcome_of(analysis_text, v, F.try_variant_get(v, "$.error", "variant"))


def with_parsed(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """Add ``out``: the strict parse of ``text_col`` (VARIANT or NULL), computed once."""
    return df.withColumn(out, strict_json(text_col))


def with_outcome(df: DataFrame, analysis_col: str = "page_analysis", out: str = "outcome",
                 parsed: str | None = None) -> DataFrame:
    """Add the page outcome; the analysis is parsed once (or taken from ``parsed``)."""
    pv = parsed or "_jr_parsed"
    staged = df if parsed else with_parsed(df, analysis_col, pv)
    staged = staged.withColumn("_jr_error", F.try_variant_get(F.col(pv), "$.error", "variant"))
    res = staged.withColumn(out, outcome_of(analysis_col, pv, "_jr_error")).drop("_jr_error")
    return res if parsed else res.drop(pv)


def with_reply_parsed(df: DataFrame, reply_col: str, out: str) -> DataFrame:
    """Add ``out``: the reply cut to its JSON and strictly parsed (VARIANT or NULL)."""
    staged = (df.withColumn("_jr_cut", F.regexp_extract(F.col(reply_col), r"(?s)\{.*\}", 0))
              .withColumn("_jr_cand", F.when(F.coalesce(F.col("_jr_cut"), F.lit("")) != "",
                                             F.col("_jr_cut")).otherwise(F.col(reply_col))))
    return with_parsed(staged, "_jr_cand", out).drop("_jr_cut", "_jr_cand")


def chunk_status(outcome) -> Column:
    """Status label shown per chunk: only a truthy error says failed; missing says success."""
    return F.when(_c(outcome) == OUTCOME_FAILED, F.lit("failed")).otherwise(F.lit("success"))


def reply_json_text(reply) -> Column:
    """Cut a model reply to its JSON: first ``{`` to last ``}`` across lines, else the whole
    reply. Returns the candidate text (not yet validated)."""
    r = _c(reply)
    cut = F.regexp_extract(r, r"(?s)\{.*\}", 0)
    return F.when(F.coalesce(cut, F.lit("")) != "", cut).otherwise(r)


def parse_reply(reply) -> Column:
    """Strictly parsed reply (VARIANT) or NULL when the reply would make a strict parser throw."""
    return strict_json(reply_json_text(reply))


def compact_json(v) -> Column:
    """Compact JSON text of a VARIANT (the stored form of a page analysis)."""
    return F.to_json(_c(v))


_JSON_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\],:]|[^\s{}\[\],:"]+')


def _indented(text: str | None) -> str | None:
    """Valid JSON text with two spaces per level; numbers and strings stay as written."""
    if text is None:
        return None
    out, depth = [], 0
    tokens = _JSON_TOKEN.findall(text)
    for i, t in enumerate(tokens):
        if t in "{[":
            empty = i + 1 < len(tokens) and tokens[i + 1] in "}]"
            depth += not empty
            out.append(t if empty else t + "\n" + "  " * depth)
        elif t in "}]":
            empty = i > 0 and tokens[i - 1] in "{["
            depth -= not empty
            out.append(t if empty else "\n" + "  " * depth + t)
        elif t == ",":
            out.append(",\n" + "  " * depth)
        else:
            out.append(": " if t == ":" else t)
    return "".join(out)


def indented_json(text) -> Column:
    """JSON text with two-space indentation (the form a stored result object has)."""
    @F.pandas_udf("string")
    def indent(s: pd.Series) -> pd.Series:
        return s.map(_indented, na_action="ignore")

    return indent(_c(text))
