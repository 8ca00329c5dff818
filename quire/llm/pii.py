"""Personal data: fixed patterns, and bootstrapped contextual extraction beyond them. DataFrame
functions only.

1. Base. Four kinds of entities are found by pattern and check (mail address, IP address, card
   number, telephone number). They are the seeds.
2. Candidates are strings shaped like a kind that the base pattern or check leaves out: a masked
   mail address, an IPv6 address, a card number without valid check digit or length, a telephone
   number without country code.
3. A lexical pattern is what stands around an entity, with the entity's kind: the last one, two or
   three tokens before it, or the one after it. A token is a word in lower case or a single other
   character, so ``Tel:415`` has the tokens ``tel`` and ``:`` before it. A pattern's confidence is
   the part of all its occurrences in the corpus that an instance belongs to. A pattern with
   ``MIN_SUPPORT`` different instances and a confidence of ``MIN_CONFIDENCE`` is trusted.
4. A candidate value becomes an instance when the trusted patterns before or after it make it likely
   enough (noisy or of the best of either side). Patterns and instances are scored in turn,
   ``ROUNDS`` times, so identifiers found in one round support patterns in the next.

Texts are read twice: once for entities, once to count the patterns that have enough instances and a
candidate (tokens that end no such pattern are dropped before anything is counted). What goes on
after that are rows of entities, without texts; tokens travel whole, patterns as hashes. A
document's positions are running sums of pieces and matches, so a text with very many entities costs
in proportion to them. A pattern that very many entities have is spread by their values before it
meets its score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.common import join_spread, table
from quire.session import checkpoint_root

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
MIN_SUPPORT = 3
MIN_CONFIDENCE = 0.5
FEW = 1 << 13           # wanted patterns that may be a filter
TOKEN = r"(?:[\p{L}\p{M}\p{N}_]++|[^\s\p{L}\p{M}\p{N}_])"

# The base patterns. Look-behinds and possessive marks change no match; they keep a
# search linear in the length of the text.
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
CANDIDATE = {
    "email": (rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++\x20?[(\[]at[)\]]\x20?"
              r"[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[]dot[)\]]\x20?)[A-Za-z0-9-]++)++"),
    "ip": r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}+(?:::?[0-9A-Fa-f]{1,4}+){3,7}+(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?+[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": (r"(?<![+0-9.-])\(?[0-9]{2,4}+\)?[\x20.-][0-9]{2,4}+[\x20.-][0-9]{3,4}+"
              r"(?:[\x20.-][0-9]{2,4}+)?+(?![0-9.-]?[0-9])"),
}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"


def _valid(kind: Column, text: Column) -> Column:
    """The check of a base match."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    n = F.length(digits)
    return (F.when(kind == "ip", text.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"))
            .when(kind == "card", n.between(16, 19) & F.call_function("luhn_check", digits))
            .when(kind == "phone", n.between(8, 15)).otherwise(True))


def _around(piece: Column) -> Column:
    """Of a piece between matches: its length, its last three tokens (last first), its first."""
    low = F.lower(piece)
    back = F.reverse(low)
    last = [F.reverse(F.regexp_extract(back, r"\A\s*+" + (TOKEN + r"\s*+") * i + f"({TOKEN})", 1))
            for i in range(3)]
    return F.struct(F.length(piece).alias("n"), F.array(*last).alias("last"),
                    F.regexp_extract(low, rf"\A\s*+({TOKEN})", 1).alias("first"))


def _hits(text: Column) -> Column:
    """Array of (kind, base, matches, pieces) over the kinds that match; pieces are what lies
    before, between and after the matches."""
    digit, none = text.rlike("[0-9]"), F.lit(None)
    may = {("email", True): text.contains("@"), ("phone", True): text.contains("+") & digit,
           ("email", False): text.rlike(r"[(\[]at[)\]]"), ("ip", False): text.contains(":") & digit}
    out = []
    for base, patterns in ((True, BASE), (False, CANDIDATE)):
        for kind in KINDS:
            p = F.lit(patterns[kind])
            matches = F.when(may.get((kind, base), digit), F.regexp_extract_all(text, p, F.lit(0)))
            pieces = F.transform(F.split(text, patterns[kind], -1), _around)
            out.append(F.when(F.size(matches) > 0, F.struct(
                F.lit(kind).alias("kind"), F.lit(base).alias("base"), matches.alias("matches"),
                pieces.alias("pieces"))).otherwise(none))
    return F.array_compact(F.array(*out))


def _entities(found: DataFrame) -> DataFrame:
    """found: rid, hits. A row per entity and per candidate that no entity overlaps: rid, kind,
    base, start, end (code points, end exclusive), value, l1, l2, l3 (tokens before it), r1."""
    line = W.partitionBy("rid", "kind", "base").orderBy("nr").rowsBetween(W.unboundedPreceding, 0)
    piece = lambda i: F.get("h.pieces", i)
    rows = (found.select("rid", F.explode("hits").alias("h"))
            .select("rid", "h.kind", "h.base", F.posexplode(F.transform("h.matches", lambda m, i: (
                F.struct(m.alias("value"), piece(i)["n"].alias("gap"), piece(i)["last"].alias("l"),
                         piece(i + 1)["first"].alias("r1"))))).alias("nr", "z"))
            .select("rid", "kind", "base", "nr", "z.value", "z.gap", "z.r1",
                    *[F.get("z.l", F.lit(i)).alias(f"l{i + 1}") for i in range(3)])
            .repartition("rid")
            .withColumn("end", F.sum(F.col("gap") + F.length("value")).over(line))
            .withColumn("start", F.col("end") - F.length("value"))
            .where(~F.col("base") | _valid(F.col("kind"), F.col("value"))))
    order = W.partitionBy("rid").orderBy("start")
    reach = F.max(F.when(F.col("base"), F.col("end"))).over(
        order.rangeBetween(W.unboundedPreceding, 0))
    ahead = F.min(F.when(F.col("base"), F.col("start"))).over(
        order.rangeBetween(0, W.unboundedFollowing))
    free = (F.coalesce(F.col("reach") <= F.col("start"), F.lit(True))
            & F.coalesce(F.col("next") >= F.col("end"), F.lit(True)))
    return (rows.withColumn("reach", reach).withColumn("next", ahead)
            .where(F.col("base") | free)
            .select("rid", "kind", "base", "start", "end", "value", "l1", "l2", "l3", "r1"))


def _each_pattern(l1: Column, l2: Column, l3: Column, r1: Column) -> list[tuple]:
    """The patterns around something: side, token that ends it, whether it is there, number."""
    parts = [("l", l1, l1, (l1,)), ("l", l1, l2, (l2, l1)), ("l", l1, l3, (l3, l2, l1)),
             ("r", r1, r1, (r1,))]
    return [(side, token, F.coalesce(first, F.lit("")) != "",
             F.xxhash64(F.lit(f"{side}{len(words)}"), *words))
            for side, token, first, words in parts]


def _patterns(l1: Column, l2: Column, l3: Column, r1: Column) -> Column:
    """Array of (side, token that ends it, number) of the patterns around something."""
    return F.array_compact(F.array(*[F.when(there, F.struct(
        F.lit(side).alias("side"), token.alias("token"), number.alias("pattern")))
        for side, token, there, number in _each_pattern(l1, l2, l3, r1)]))


def _occurrences(text: DataFrame, wanted: DataFrame) -> DataFrame:
    """pattern, total: how often the wanted patterns (token, pattern) occur in the texts.

    Where they are few, a place in a text is reduced to the wanted patterns it ends. The longest of
    them tells the others, so there are no more different places than wanted patterns, and they
    are counted before they are listed pattern by pattern."""
    few = wanted.select("token", "pattern").limit(FEW + 1).collect()
    # an array of one, exploded: the tokens of a text are found once
    rows = (text.select(F.explode(F.array(F.regexp_extract_all(
        F.lower("text"), F.lit(TOKEN), F.lit(0)))).alias("a"))
        .select(F.inline(F.arrays_zip(
            F.col("a").alias("t"), F.concat(F.array(F.lit("")), F.col("a")).alias("p1"),
            F.concat(F.array(F.lit(""), F.lit("")), F.col("a")).alias("p2")))))
    around = _each_pattern(*map(F.col, ("t", "p1", "p2", "t")))
    count = F.count(F.lit(1)).alias("n")
    if len(few) <= FEW:
        numbers = ", ".join(str(r["pattern"]) for r in few) or "null"
        places = [f"x{i}" for i in range(len(around))]
        rows = (rows.where(F.col("t").isin(list({r["token"] for r in few})))
                .select(*[F.when(there, number).alias(x)
                          for x, (_, _, there, number) in zip(places, around, strict=True)])
                .selectExpr(*[f"if({x} in ({numbers}), {x}, null) as {x}" for x in places])
                .groupBy(*places).agg(count))
        each = F.array_compact(F.array(*places))
    else:
        tokens = wanted.select(F.col("token").alias("t")).distinct()
        rows = rows.groupBy("t", "p1", "p2").agg(count).join(tokens, "t")
        each = F.array_compact(F.array(*[F.when(there, number) for _, _, there, number in around]))
    return (rows.select("n", F.explode(each).alias("pattern"))
            .groupBy("pattern").agg(F.sum("n").alias("total"))
            .join(wanted.select("pattern").distinct(), "pattern"))


def _discovered(entities: DataFrame, text: DataFrame, rounds: int, min_support: int,
                min_confidence: float) -> DataFrame:
    """(kind, value) of the candidates that become instances."""
    edges = (entities.select("kind", "value", "base", F.explode(_patterns(
        *map(F.col, ("l1", "l2", "l3", "r1")))).alias("x"))
        .groupBy("x.side", "x.token", "x.pattern", "kind", "value", "base")
        .agg(F.count(F.lit(1)).alias("n"))).checkpoint()
    # a pattern is worth counting if it has enough instances and a candidate
    wanted = (edges.groupBy("pattern", "kind", "token")
              .agg(F.count(F.lit(1)).alias("values"), F.max(~F.col("base")).alias("more"))
              .where((F.col("values") >= min_support) & F.col("more"))
              .select("token", "pattern").distinct().checkpoint())
    totals = _occurrences(text, wanted).checkpoint()
    edges = join_spread(edges.drop("token"), totals, ["pattern"], "value").checkpoint()
    seeds = (entities.where("base").select("kind", "value", F.lit(1.0).alias("score")).distinct()
             .checkpoint())
    likely = seeds
    for _ in range(rounds):
        known = edges.join(likely, ["kind", "value"])
        trusted = (known.groupBy("pattern", "kind")
                   .agg((F.sum(F.col("n") * F.col("score")) / F.max("total")).alias("raw"),
                        F.countDistinct("value").alias("values"))
                   .withColumn("confidence", F.least(F.lit(1.0), F.col("raw")))
                   .where((F.col("values") >= min_support)
                          & (F.col("confidence") >= min_confidence))
                   .select("pattern", "kind", "confidence"))
        met = join_spread(edges.where("not base").select("pattern", "side", "kind", "value"),
                          trusted, ["pattern", "kind"], "value")
        best = [F.coalesce(F.max(F.when(F.col("side") == side, F.col("confidence"))), F.lit(0.0))
                for side in "lr"]
        new = (met.groupBy("kind", "value").agg((1 - (1 - best[0]) * (1 - best[1])).alias("score"))
               .where(F.col("score") >= min_confidence))
        likely = (seeds.union(new).groupBy("kind", "value").agg(F.max("score").alias("score"))
                  .checkpoint())
    return likely.select("kind", "value")


def find_personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       rounds: int = ROUNDS, min_support: int = MIN_SUPPORT,
                       min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """One row per row of ``df``: the id, entities (array of kind, start, end, value, base, sorted
    by kind as in ``KINDS``, then start), where ``base`` tells the fixed patterns from what context
    discovered. Positions are code points, the end exclusive.

    A null or empty text has none; long texts are searched whole. Repeated rows each get a row, and
    count as often in the scores. An empty table gives an empty result. Other columns are not read.
    """
    checkpoint_root(df.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    found = (df.select(F.monotonically_increasing_id().alias("rid"),
                       F.col(f"`{id_col}`").alias("id"), _hits(text).alias("hits")).checkpoint())
    entities = _entities(found).checkpoint()
    new = _discovered(entities, df.select(text.alias("text")), rounds, min_support, min_confidence)
    added = entities.where("not base").join(new, ["kind", "value"], "left_semi")
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    cols = ["rid", "kind", "base", "start", "end", "value"]
    by_row = (entities.where("base").select(*cols).union(added.select(*cols))
              .groupBy("rid").agg(F.sort_array(F.collect_list(F.struct(
                  order.alias("nr"), "start", "end", "kind", "value", "base"))).alias("entities")))
    none = F.expr("array()").cast(by_row.schema["entities"].dataType)
    return (found.select("rid", "id").join(by_row, "rid", "left")
            .select(F.col("id").alias(id_col), F.coalesce("entities", none).alias("entities")))


def span_text(entities: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(entities, lambda e: F.concat_ws(
        ":", e["kind"], e["start"].cast("string"), e["end"].cast("string"))), ",")


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all of ``documents``."""
    e = F.col("entities")
    base = F.filter(e, lambda x: x["base"])
    kinds = F.transform(base, lambda x: x["kind"])
    counts = [F.size(F.filter(kinds, lambda x: x == F.lit(kind))).cast("bigint")  # noqa: B023
              .alias(f"n_{kind}") for kind in KINDS]
    return (find_personal_data(table(spark, sf_dir, "documents"))
            .select("doc_id", *counts, F.sha2(span_text(base), 256).alias("base_sha256"),
                    span_text(e).alias("spans")))
