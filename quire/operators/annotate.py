"""Page annotation (M2-M7).

Two annotators share one output contract: ``page_analysis`` is JSON text, either the page's
analysis (summary, entities, keyPoints, sentiment) or the failure placeholder
``{"error":"Analysis failed","timestamp":...}``. A page is never dropped.

* ``annotate_native`` — the default: a plain SQL rule set evaluated in the JVM (codegen, no
  Python). It is a labelled stand-in for a model, not a model: summary = the longest sentence
  (the first of equals), entities = distinct capitalised words, keyPoints = all sentences,
  sentiment = sign of a small word-list count.
* ``annotate_with`` — any caller-supplied annotator (e.g. a model client) run through
  ``mapInPandas`` on Arrow batches, with the rate-limit retry rule and the per-page placeholder.
  Only the request runs in Python; reply extraction and validation run natively afterwards.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.jsonrules import compact_json, with_reply_parsed
from quire.functions.lifecycle import iso_utc
from quire.operators.pages import prompt

# Fixed values of the rate-limit rule: retry only when the error message contains "429",
# at most 3 retries, first wait 2 s, doubling each time.
RATE_LIMIT_MARK = "429"
MAX_RETRIES = 3
FIRST_DELAY_S = 2.0
FAILURE_TEXT = "Analysis failed"

# Fixed values of the native rule set.
SENTENCE_RX = r"[^.!?]+[.!?]*"        # a sentence: text up to and including its end marks
# A capitalised word: a maximal letter run whose first letter is upper case.
ENTITY_RX = r"(?<!\p{L})\p{Lu}\p{L}*"
TRIM_CHARS = " \t\n\r"
POSITIVE_WORDS = (
    "good", "great", "excellent", "happy", "love", "best", "success", "positive",
    "bon", "bonne", "heureux", "meilleur", "succès",
    "gut", "glücklich", "beste", "erfolg",
    "bueno", "buena", "feliz", "mejor", "éxito",
)
NEGATIVE_WORDS = (
    "bad", "poor", "terrible", "sad", "hate", "worst", "failure", "negative",
    "mauvais", "mauvaise", "triste", "pire", "échec",
    "schlecht", "traurig", "schlimm", "fehler",
    "malo", "mala", "peor", "fracaso",
)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sentences(text) -> Column:
    """Non-empty trimmed sentences of a text, in order."""
    parts = F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(SENTENCE_RX), 0)
    trimmed = F.transform(parts, lambda s: F.trim(s, F.lit(TRIM_CHARS)))
    return F.filter(trimmed, lambda s: s != "")


# Both lists in one pattern: group 1 holds a positive word, and is empty for a negative one.
_SENTIMENT_RX = (r"(?<!\p{L})(?:(" + "|".join(POSITIVE_WORDS) + r")|("
                 + "|".join(NEGATIVE_WORDS) + r"))(?!\p{L})")


def sentiment_balance(lower_text: Column) -> Column:
    """Positive minus negative whole-word occurrences, in a single regex pass."""
    hits = F.regexp_extract_all(lower_text, F.lit(_SENTIMENT_RX), 1)
    pos = F.size(F.array_remove(hits, ""))
    return pos * 2 - F.size(hits)


def _analysis_struct(text: Column, sents: Column, balance: Column) -> Column:
    entities = F.array_distinct(F.regexp_extract_all(text, F.lit(ENTITY_RX), 0))
    longest = F.array_max(F.transform(sents, lambda s, i: F.struct(
        F.length(s).alias("n"), (-i).alias("at"), s.alias("text"))))
    sentiment = (F.when(balance > 0, F.lit("positive")).when(balance < 0, F.lit("negative"))
                 .otherwise(F.lit("neutral")))
    return F.struct(
        F.coalesce(longest["text"], F.lit("")).alias("summary"),
        entities.alias("entities"),
        sents.alias("keyPoints"),
        sentiment.alias("sentiment"),
    )


def native_analysis(text) -> Column:
    """The native rule set as one struct Column (summary, entities, keyPoints, sentiment).

    Entities and sentiment are single regex passes over the whole text (no per-word lambdas):
    the same words as splitting on non-letters and testing each word. Single-expression form;
    on tables ``with_native_analysis`` computes the sentences and the balance once per row."""
    t = F.coalesce(_c(text), F.lit(""))
    return _analysis_struct(t, sentences(text), sentiment_balance(F.lower(t)))


def with_native_analysis(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """Add ``out``: the native analysis struct, with the sentences and the sentiment balance
    staged as columns so each is computed once per row."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    staged = (df.withColumn("_na_sents", sentences(text_col))
              .withColumn("_na_balance", sentiment_balance(F.lower(t))))
    return (staged.withColumn(out, _analysis_struct(t, F.col("_na_sents"),
                                                    F.col("_na_balance")))
            .drop("_na_sents", "_na_balance"))


def failure_placeholder(now) -> Column:
    """``{"error":"Analysis failed","timestamp":"<now ISO>"}``."""
    now_c = now if isinstance(now, Column) else F.lit(now).cast("timestamp")
    return F.to_json(F.struct(F.lit(FAILURE_TEXT).alias("error"),
                              iso_utc(now_c).alias("timestamp")))


def annotate_native(pages: DataFrame, now, text_col: str = "page_text",
                    fail: Column | None = None) -> DataFrame:
    """Add ``page_analysis`` (JSON text) by the native rule set.

    ``fail`` is an optional boolean Column marking pages whose annotation errors (tests and
    fault drills); those pages get the failure placeholder and still count as processed.
    """
    staged = with_native_analysis(pages, text_col, "_na_struct")
    analysis = F.to_json(F.col("_na_struct"))
    if fail is not None:
        analysis = (F.when(F.coalesce(fail, F.lit(False)), failure_placeholder(now))
                    .otherwise(analysis))
    return staged.withColumn("page_analysis", analysis).drop("_na_struct")


# ---------------------------------------------------------------------------------------------
# Caller-supplied annotator (mapInPandas)
# ---------------------------------------------------------------------------------------------

def call_with_retry(fn: Callable[[str], str], text: str, retries: int = MAX_RETRIES,
                    delay: float = FIRST_DELAY_S, sleep: Callable[[float], None] = time.sleep
                    ) -> tuple[str | None, str | None, int]:
    """Call ``fn(text)``; on an error whose message contains ``429`` wait and retry, doubling
    the wait, at most ``retries`` times. Returns (reply, error message, attempts)."""
    attempts = 0
    while True:
        attempts += 1
        try:
            return fn(text), None, attempts
        except Exception as e:  # noqa: BLE001 - any annotator error becomes a placeholder
            msg = str(e)
            if RATE_LIMIT_MARK in msg and retries > 0:
                sleep(delay)
                retries -= 1
                delay *= 2
                continue
            return None, msg or type(e).__name__, attempts


class _Pacer:
    """At least ``interval`` seconds between the starts of successive requests of one task."""

    def __init__(self, interval: float, sleep: Callable[[float], None]):
        import threading
        self.interval, self.sleep, self.next_at = interval, sleep, 0.0
        self.lock = threading.Lock()

    def wait(self) -> None:
        if self.interval <= 0:
            return
        with self.lock:
            now = time.monotonic()
            start = max(now, self.next_at)
            self.next_at = start + self.interval
        if start > now:
            self.sleep(start - now)


def _reply_partitions(fn, text_col, retries, delay, sleep, concurrency=1, min_interval=0.0,
                      batch=None):
    def run(batches):
        import pandas as pd
        pacer = _Pacer(min_interval, sleep)

        def one(t):
            def paced(x):
                pacer.wait()
                return fn(x)
            return call_with_retry(paced, t if t is not None else "", retries, delay, sleep)

        def some(texts):
            """One request for several pages; its failure is the failure of each."""
            def paced(x):
                pacer.wait()
                replies = list(fn(x))
                if len(replies) != len(x):
                    raise ValueError(f"{len(replies)} replies to {len(x)} pages")
                return replies
            texts = [t if t is not None else "" for t in texts]
            replies, error, attempts = call_with_retry(paced, texts, retries, delay, sleep)
            return [(r, error, attempts) for r in replies or [None] * len(texts)]

        pool = None
        if concurrency > 1:
            from concurrent.futures import ThreadPoolExecutor
            pool = ThreadPoolExecutor(max_workers=concurrency)
        try:
            for pdf in batches:
                texts = list(pdf[text_col])
                call = some if batch else one
                work = ([texts[i:i + batch] for i in range(0, len(texts), batch)] if batch
                        else texts)
                out = list(pool.map(call, work)) if pool else [call(x) for x in work]
                out = [r for rs in out for r in rs] if batch else out
                res = pdf.copy()
                res["reply"] = pd.Series([o[0] for o in out], index=pdf.index, dtype=object)
                res["annotator_error"] = pd.Series([o[1] for o in out], index=pdf.index,
                                                   dtype=object)
                res["attempts"] = pd.Series([o[2] for o in out], index=pdf.index,
                                            dtype="int32")
                yield res
        finally:
            if pool:
                pool.shutdown(wait=True)
    return run


def annotate_with(pages: DataFrame, fn: Callable[[str], str], now,
                  key_cols: tuple[str, ...] = ("file_id", "page_number"),
                  text_col: str = "page_text", partitions: int | None = None,
                  retries: int = MAX_RETRIES, delay: float = FIRST_DELAY_S,
                  sleep: Callable[[float], None] = time.sleep, concurrency: int = 1,
                  min_interval: float = 0.0, batch: int | None = None,
                  prompted: bool = True) -> DataFrame:
    """Annotate pages with a caller-supplied ``fn(prompt) -> reply text``, or, with ``batch``,
    ``fn(list of up to batch prompts) -> list of replies``. ``prompted=False`` passes the page
    text itself instead of the annotation prompt around it.

    With ``partitions`` the pages are hash-spread on ``key_cols`` first, so one long document
    is worked on by many tasks. Rows pass through whole (no join back). Within a task,
    ``concurrency`` requests may be in flight at once (threads; for a remote model, whose
    calls wait on the network) and ``min_interval`` seconds separate request starts (pacing
    against a rate limit). The reply is cut to its JSON and strictly parsed in the JVM; a
    rejected reply or an annotator error gives the failure placeholder. Result: the input
    columns plus ``page_analysis`` and ``attempts``.
    """
    spread = pages.repartition(partitions, *key_cols) if partitions else pages
    asked = "_an_request"
    spread = spread.withColumn(asked, prompt(text_col) if prompted else F.col(text_col))
    out_schema = T.StructType(list(spread.schema.fields) + [
        T.StructField("reply", T.StringType()), T.StructField("annotator_error", T.StringType()),
        T.StructField("attempts", T.IntegerType())])
    replies = spread.mapInPandas(
        _reply_partitions(fn, asked, retries, delay, sleep, concurrency, min_interval, batch),
        out_schema)
    parsed = with_reply_parsed(replies, "reply", "_an_parsed")
    ok = F.col("annotator_error").isNull() & F.col("_an_parsed").isNotNull()
    analysis = F.when(ok, compact_json("_an_parsed")).otherwise(failure_placeholder(now))
    return (parsed.withColumn("page_analysis", analysis)
            .drop("reply", "annotator_error", "_an_parsed", asked))


def store_replies(df: DataFrame, reply_col: str, now, out: str = "page_analysis") -> DataFrame:
    """Stored analysis per reply: its compact JSON when the reply parses, else the failure
    placeholder. The reply is cut and parsed once per row."""
    parsed = with_reply_parsed(df, reply_col, "_an_parsed")
    stored = F.when(F.col("_an_parsed").isNotNull(), compact_json("_an_parsed")).otherwise(
        failure_placeholder(now))
    return parsed.withColumn(out, stored).drop("_an_parsed")
