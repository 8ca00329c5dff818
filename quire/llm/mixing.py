"""Mixing sources to target weights by Sainte-Lague apportionment. DataFrame functions only.

1. Documents are dealt into shards per source, in a seeded hash order inside each shard. The
   words of a shard, laid end to end, are cut into blocks of about ``BLOCK_WORDS`` words (equal
   within a shard).
2. The blocks of the mix go to sources by highest quotient ``votes / (2 * seats + 1)``, the votes
   being the source's target in blocks of its own.
3. A source's blocks go to its shards by the same rule, the votes being the shard's blocks.
4. A shard with ``q`` seats and ``n`` blocks takes all blocks ``q div n`` times and ``q mod n``
   blocks once more, from a seeded start on the ring of its blocks.

Seats are not handed out one by one. With ``n`` parties and ``K`` seats every final count lies
within ``1 + quota * n / (2K)`` of its quota, so each party's seats below that band are certain
and only the seats inside it (a few per party) compete by quotient.

A source is spread over hash shards, so a source with a third of all rows is many small groups.
Only per-shard sums meet per source, and one row per source is ranked globally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.common import SPACE, bucket_count, hex_bucket, md5_of, table
from quire.llm.vectors import PART, in_parts

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
BLOCK_WORDS = 32
SHARD_ROWS = 1 << 16
LEAST_SHARDS = 1 << 8
VOTE_SCALE = 1024
SEED = "mix"


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null has none. A long."""
    ws, no = SPACE, r"[^\x20\x09-\x0D]"
    marks = F.regexp_replace(text, f"{ws}*+{no}++{ws}*+", "x")
    return F.when(F.coalesce(text.rlike(no), F.lit(False)),
                  F.length(marks)).otherwise(F.lit(0)).cast("bigint")


def _seats(parties: DataFrame, by: list[str], votes: str, seats: Column, limit: str,
           tie: list[str]) -> DataFrame:
    """Sainte-Lague within each group ``by``: adds ``won``, the seats of each party (a row with
    positive votes), at most ``limit``; ``seats`` is the group's total, constant in the group."""
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    p = (parties.withColumn("_k", seats)
         .withColumn("_n", F.count(F.lit(1)).over(group))
         .withColumn("_v", F.sum(votes).over(group))
         .withColumn("_q", F.when(F.col("_v") > 0, F.col(votes).cast("double") * F.col("_k")
                                  / F.col("_v")).otherwise(0.0))
         .withColumn("_band", F.when(F.col("_k") > 0,
                                     F.col("_q") * F.col("_n") / (2.0 * F.col("_k"))).otherwise(0.0) + 1)
         .withColumn("_low", F.least(F.col(limit), F.greatest(
             F.lit(0), F.floor(F.col("_q") - F.col("_band")))).cast("bigint"))
         .withColumn("_high", F.least(F.col(limit),
                                      F.ceil(F.col("_q") + F.col("_band"))).cast("bigint"))
         .withColumn("_open", F.col("_k") - F.sum("_low").over(group)))
    seat = F.explode_outer(F.when(F.col("_high") > F.col("_low"),
                                  F.sequence("_low", F.col("_high") - 1)))
    order = group.orderBy(F.col("_quot").desc_nulls_last(), *tie, "_seat")
    keys = [c for c in parties.columns]
    return (p.withColumn("_seat", seat)
            .withColumn("_quot", F.col(votes).cast("double") / (2 * F.col("_seat") + 1))
            .withColumn("_rank", F.row_number().over(order))
            .groupBy(*keys, "_low")
            .agg(F.count(F.when(F.col("_seat").isNotNull() & (F.col("_rank") <= F.col("_open")), 1))
                 .alias("_extra"))
            .withColumn("won", F.col("_low") + F.col("_extra")).drop("_low", "_extra"))


def _targets(sources: DataFrame) -> DataFrame:
    """sources: src_null, src, source_size. Adds target: shares by weight of the sum of all sizes,
    each at most MOST_REPEATS times the source; what is cut off is shared again by weight."""
    at = F.row_number().over(W.orderBy("src_null", "src"))
    weights = F.array(*[F.lit(x).cast("bigint") for x in WEIGHTS])
    s = (sources.withColumn("_at", at)
         .withColumn("_w", F.element_at(weights, ((F.col("_at") - 1) % len(WEIGHTS) + 1).cast("int")))
         .withColumn("_cap", F.col("source_size") * MOST_REPEATS))
    filling = W.orderBy(F.col("_cap") / F.col("_w"), "_at")
    everything = W.partitionBy(F.lit(0))
    s = (s.withColumn("_all", F.sum("source_size").over(everything))
         .withColumn("_rest", F.col("_all") - F.sum("_cap").over(
             filling.rowsBetween(W.unboundedPreceding, -1)))
         .withColumn("_rest", F.coalesce("_rest", F.col("_all")))
         .withColumn("_wrest", F.sum("_w").over(filling.rowsBetween(0, W.unboundedFollowing)))
         .withColumn("_level", F.col("_rest").cast("double") / F.col("_wrest"))
         .withColumn("_level", F.when(F.col("_w") * F.col("_level") <= F.col("_cap"),
                                      F.col("_level")))
         .withColumn("_level", F.first("_level", ignorenulls=True).over(
             filling.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))))
    return s.withColumn("target", F.least(F.col("_cap").cast("double"),
                                          F.col("_w") * F.col("_level")))


def mix_sources(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                source_col: str = "source", seed: str = SEED,
                block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per row of ``df``: the id, size (words), source_size, target (of the source),
    taken (words the mix takes of this document, repeats counted), source.

    Sources are taken in code-point order, null last, with weights 5, 2, 1 repeating; a null
    source is a source of its own, apart from the empty name. Null and empty texts have size 0 and
    nothing is taken of them; long texts are counted whole. Repeated rows count as rows of their own,
    but are ranked as one entry. Reruns agree, whatever the
    partitioning: every choice is a function of the ids, the sizes and ``seed``. An empty table
    gives an empty result. Other columns are not read.
    """
    shards = bucket_count(df.count(), SHARD_ROWS, LEAST_SHARDS)
    src = F.col(f"`{source_col}`")
    key = ["src_null", "src", "shard"]
    rows = (df.select(F.col(f"`{id_col}`").alias("id"), src.isNull().alias("src_null"),
                      F.coalesce(src.cast("string"), F.lit("")).alias("src"),
                      word_count(F.col(f"`{text_col}`")).alias("size"))
            # rows that agree in all of these are one entry, made on the map side
            .groupBy("id", "src_null", "src", "size").agg(F.count(F.lit(1)).alias("copies"))
            .withColumn("at", md5_of(seed, F.col("id")))
            .withColumn("shard", hex_bucket(F.col("at"), shards))
            .repartition(*key))
    by_shard = rows.groupBy(*key).agg(F.sum(F.col("size") * F.col("copies")).alias("words"))
    by_shard = by_shard.withColumn("blocks", F.when(F.col("words") > 0, F.greatest(
        F.lit(1), F.round(F.col("words") / block_words))).otherwise(0).cast("bigint"))
    sources = _targets(by_shard.groupBy("src_null", "src")
                       .agg(F.sum("words").alias("source_size"), F.sum("blocks").alias("n_blocks")))
    sources = (sources
               .withColumn("votes", F.when(F.col("source_size") > 0, F.round(
                   F.col("target") * F.col("n_blocks") / F.col("source_size") * VOTE_SCALE))
                   .otherwise(0).cast("bigint"))
               .withColumn("most", F.col("n_blocks") * MOST_REPEATS)
               .select("src_null", "src", "source_size", "target", "votes", "most", "_at"))
    total = F.round(F.sum("votes").over(W.partitionBy(F.lit(0))) / VOTE_SCALE).cast("bigint")
    of_source = (_seats(sources, [], "votes", total, "most", ["_at"])
                 .select("src_null", "src", "source_size", "target", F.col("won").alias("quota")))
    parties = (by_shard.join(of_source, ["src_null", "src"])
               .withColumn("most", F.col("blocks") * MOST_REPEATS)
               .withColumn("spin", md5_of(seed, F.col("src"), F.col("shard"))))
    of_shard = (_seats(parties, ["src_null", "src"], "blocks", F.col("quota"), "most",
                       ["spin", "shard"])
                .withColumn("n", F.greatest(F.lit(1), F.col("blocks")))
                .withColumn("passes", F.expr("won div n"))
                .withColumn("extra", F.col("won") % F.col("n"))
                .withColumn("first", hex_bucket(F.col("spin"), F.col("n")))
                .withColumn("last", F.col("first") + F.col("extra"))
                .withColumn("a", F.expr("(first * words) div n"))
                .withColumn("b", F.expr("(least(last, n) * words) div n"))
                .withColumn("c", F.expr("(greatest(last - n, 0) * words) div n"))
                .select(*key, "source_size", "target", "passes", "a", "b", "c"))
    line = W.partitionBy(*key).orderBy("at", "size", "id").rowsBetween(W.unboundedPreceding, 0)
    entries = (rows.withColumn("end", F.sum(F.col("size") * F.col("copies")).over(line))
               .join(of_shard, key))
    nth = F.col("part") * PART + F.col("nth")
    return (in_parts(entries)
            .withColumn("nth", F.explode(F.expr("sequence(0L, share - 1)")))
            .withColumn("start", F.col("end") - F.col("size") * (F.col("copies") - nth))
            .withColumn("end", F.col("start") + F.col("size"))
            .select(F.col("id").alias(id_col), "size", "source_size", "target",
                    F.expr("passes * size + greatest(0, least(end, b) - greatest(start, a))"
                           " + greatest(0, least(end, c) - start)").alias("taken"),
                    F.expr("if(src_null, null, src)").alias(source_col)))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix over all of ``documents``."""
    return mix_sources(table(spark, sf_dir, "documents"))


def oracle(rows_from: str = "documents") -> str:
    """DuckDB SQL for ``mix_sources`` over the named table with the default parameters."""
    shards = (f"greatest({LEAST_SHARDS}, (2 ** ceil(log2(greatest(1, ceil(count(*) / "
              f"{SHARD_ROWS}.0)))))::BIGINT)")
    return rf"""
WITH m AS (SELECT {shards} AS shards FROM {rows_from}),
d AS (
  SELECT doc_id, source IS NULL AS src_null, coalesce(source, '') AS src,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('{SEED}/' || coalesce(doc_id::VARCHAR, 'null')) AS pos
  FROM {rows_from}),
r AS (SELECT d.*, ('0x' || substr(pos, 1, 8))::BIGINT % shards AS shard FROM d, m),
h AS (SELECT src_null, src, shard, sum(size)::BIGINT AS words FROM r GROUP BY ALL),
hb AS (SELECT *, CASE WHEN words > 0
         THEN greatest(1, round(words / {BLOCK_WORDS}))::BIGINT ELSE 0 END AS blocks FROM h),
s0 AS (SELECT src_null, src, sum(words)::BIGINT AS source_size, sum(blocks)::BIGINT AS n_blocks
       FROM hb GROUP BY ALL),
s1 AS (SELECT *, row_number() OVER (ORDER BY src_null, src) AS nr FROM s0),
s2 AS (SELECT *, list_extract([5, 2, 1], ((nr - 1) % 3 + 1)::INTEGER)::BIGINT AS w,
              source_size * {MOST_REPEATS} AS cap FROM s1),
s3 AS (SELECT *, (sum(source_size) OVER ())::BIGINT - coalesce((sum(cap) OVER (ORDER BY cap / w, nr
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT, 0) AS rest,
              (sum(w) OVER (ORDER BY cap / w, nr
                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS wrest FROM s2),
lv AS (SELECT arg_min(rest::DOUBLE / wrest, cap / w * 1e6 + nr / 1e6) AS level FROM s3
       WHERE w * (rest::DOUBLE / wrest) <= cap),
s4 AS (SELECT s3.*, least(cap::DOUBLE, w * level) AS target FROM s3, lv),
s5 AS (SELECT *, CASE WHEN source_size > 0
         THEN round(target * n_blocks / source_size * {VOTE_SCALE})::BIGINT ELSE 0 END AS votes,
         n_blocks * {MOST_REPEATS} AS most FROM s4),
s6 AS (SELECT *, round((sum(votes) OVER ())::BIGINT / {VOTE_SCALE})::BIGINT AS k,
              (sum(votes) OVER ())::BIGINT AS v, count(*) OVER () AS n FROM s5),
s7 AS (SELECT *, coalesce(votes::DOUBLE * k / nullif(v, 0), 0) AS q FROM s6),
s8 AS (SELECT *, CASE WHEN k > 0 THEN q * n / (2.0 * k) ELSE 0 END + 1 AS band FROM s7),
s9 AS (SELECT *, least(most, greatest(0, floor(q - band)))::BIGINT AS low,
              least(most, ceil(q + band))::BIGINT AS high FROM s8),
s10 AS (SELECT *, k - (sum(low) OVER ())::BIGINT AS free FROM s9),
s11 AS (SELECT nr, free, row_number() OVER (ORDER BY votes::DOUBLE / (2 * seat + 1) DESC, nr, seat)
          AS rk FROM (SELECT *, unnest(range(low, high)) AS seat FROM s10)),
s12 AS (SELECT nr, count(*) AS extra FROM s11 WHERE rk <= free GROUP BY nr),
sq AS (SELECT src_null, src, source_size, target, low + coalesce(extra, 0) AS quota
       FROM s10 LEFT JOIN s12 USING (nr)),
p0 AS (SELECT hb.*, source_size, target, quota AS k, blocks * {MOST_REPEATS} AS most,
              md5('{SEED}/' || src || '/' || shard) AS spin
       FROM hb JOIN sq USING (src_null, src)),
p1 AS (SELECT *, count(*) OVER g AS n, (sum(blocks) OVER g)::BIGINT AS v FROM p0
       WINDOW g AS (PARTITION BY src_null, src)),
p2 AS (SELECT *, coalesce(blocks::DOUBLE * k / nullif(v, 0), 0) AS q FROM p1),
p3 AS (SELECT *, CASE WHEN k > 0 THEN q * n / (2.0 * k) ELSE 0 END + 1 AS band FROM p2),
p4 AS (SELECT *, least(most, greatest(0, floor(q - band)))::BIGINT AS low,
              least(most, ceil(q + band))::BIGINT AS high FROM p3),
p5 AS (SELECT *, k - (sum(low) OVER (PARTITION BY src_null, src))::BIGINT AS free FROM p4),
p6 AS (SELECT src_null, src, shard, free, row_number() OVER (PARTITION BY src_null, src
          ORDER BY blocks::DOUBLE / (2 * seat + 1) DESC, spin, shard, seat) AS rk
       FROM (SELECT *, unnest(range(low, high)) AS seat FROM p5)),
p7 AS (SELECT src_null, src, shard, count(*) AS extra FROM p6 WHERE rk <= free GROUP BY ALL),
p8 AS (SELECT p5.src_null, p5.src, p5.shard, words, source_size, target, spin,
              greatest(1, blocks) AS nb, low + coalesce(extra, 0) AS won
       FROM p5 LEFT JOIN p7 USING (src_null, src, shard)),
p9 AS (SELECT *, won // nb AS passes, won % nb AS extra,
              ('0x' || substr(spin, 1, 8))::BIGINT % nb AS first FROM p8),
hq AS (SELECT src_null, src, shard, source_size, target, passes, first * words // nb AS a,
              least(first + extra, nb) * words // nb AS b,
              greatest(first + extra - nb, 0) * words // nb AS c FROM p9),
l AS (SELECT *, (sum(size) OVER (PARTITION BY src_null, src, shard ORDER BY pos, size, doc_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS e FROM r)
SELECT doc_id, size, source_size, target,
       (passes * size + greatest(0, least(e, b) - greatest(e - size, a))
        + greatest(0, least(e, c) - (e - size)))::BIGINT AS taken,
       CASE WHEN src_null THEN NULL ELSE src END AS source
FROM l JOIN hq USING (src_null, src, shard)
"""


ORACLE = oracle()
