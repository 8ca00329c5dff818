"""Conversation prefix trie from vertical bitmaps.

Conversations are range-partitioned by id and cut into shards of whole conversations. A shard
indexes (position, turn) to a bitset of its conversations. Depth first, the parent's bitset is
intersected with the postings of the next position: every non-empty result is a child, its set bits
are the members, and what no posting of the next position covers has ended here. Turns are digests;
texts never enter a shard, nor any shuffle.

1. ``_shard_nodes``: the nodes of every shard in preorder, each named by a digest of its path, with
   its members in the shard, its least member and the ids that end there.
2. Nodes of the same path are merged across shards (one row per shard and path, however many
   conversations share it): members, least id, whether it has a child.
3. ``_subtrees``: every path is counted in the first shard that has it; shards sum children, leaves
   and saved bytes over their subtrees (a preorder range), and the partial sums of a path are added.
4. Ids that end at a node come as one sorted run per shard. Shards are ranges of ids, so runs are
   hashed one after another, without holding a list.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.common import table
from quire.session import checkpoint_root

SHARD_TURNS = 1 << 16           # turns of a shard, about, ...
SHARD_CONVERSATIONS = 1 << 12   # and conversations at most: the width of a bitset
PARTITION_TURNS = 1 << 19
LEAST_PARTITIONS = 16
ROOT = b""

NODE = ("shard long, pre int, size int, up int, depth long, path binary, n_bytes long, n long,"
        " first long, has_child boolean, ends string")


def _one_shard(shard: int, conv: np.ndarray, start: np.ndarray, turn: list, size: np.ndarray):
    """Nodes in preorder. Conversation ``i`` has the turns ``start[i]..start[i+1]``."""
    length = np.diff(start).tolist()
    begin = start.tolist()
    postings: list[dict[bytes, int]] = [{} for _ in range(max(length, default=0))]
    for i, n in enumerate(length):
        bit, b = 1 << i, begin[i]
        for p in range(n):
            at = postings[p]
            t = turn[b + p]
            at[t] = at.get(t, 0) | bit
    ended: dict[int, int] = {}
    for i, n in enumerate(length):
        ended[n] = ended.get(n, 0) | 1 << i
    up, depth, path, n_bytes, members, first, ends, child = [], [], [], [], [], [], [], []
    todo = [((1 << len(length)) - 1, -1, 0, ROOT, 0)]
    while todo:
        bits, above, d, name, nb = todo.pop()
        while True:
            me, low = len(up), (bits & -bits).bit_length() - 1
            up.append(above), depth.append(d), path.append(name), n_bytes.append(nb)
            members.append(bits.bit_count()), first.append(low)
            gone = bits & ended.get(d, 0)
            ends.append(gone)
            rest = bits & ~gone
            child.append(rest != 0)
            if rest != bits or rest & (rest - 1):
                break
            # a single conversation goes on alone
            at = begin[low] + d
            above, d, name, nb = me, d + 1, hashlib.md5(name + turn[at]).digest(), int(size[at])
        while rest:
            at = begin[(rest & -rest).bit_length() - 1] + d
            kid = rest & postings[d][turn[at]]
            todo.append((kid, me, d + 1, hashlib.md5(name + turn[at]).digest(), int(size[at])))
            rest &= ~kid
    m = len(up)
    above = np.array(up)
    span = np.ones(m, dtype=np.int64)
    for i in range(m - 1, 0, -1):
        span[above[i]] += span[i]
    ids = conv.tolist()

    def listed(gone: int) -> str | None:
        if not gone:
            return None
        out = []
        while gone:
            out.append(str(ids[(gone & -gone).bit_length() - 1]))
            gone &= gone - 1
        return ",".join(out)

    return pa.record_batch({
        "shard": pa.array(np.full(m, shard, dtype=np.int64)), "pre": pa.array(range(m), pa.int32()),
        "size": pa.array(span, pa.int32()), "up": pa.array(up, pa.int32()),
        "depth": pa.array(depth, pa.int64()), "path": pa.array(path, pa.binary()),
        "n_bytes": pa.array(n_bytes, pa.int64()), "n": pa.array(members, pa.int64()),
        "first": pa.array(conv[first]), "has_child": pa.array(child, pa.bool_()),
        "ends": pa.array([listed(g) for g in ends], pa.string())})


def _shard_nodes(most_turns: int, most_conversations: int) -> Callable:
    """Of one range of conversations, sorted by (conv_id, pos), with a row of position 0 each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0

        def made(t: pa.Table) -> pa.RecordBatch:
            nonlocal number
            pos, conv = t["pos"].to_numpy(), t["conv_id"].to_numpy()
            head, real = np.flatnonzero(pos == 0), np.flatnonzero(pos > 0)
            turn = t["turn"].take(pa.array(real)).to_pylist()
            start = np.append(head, len(pos)) - np.arange(len(head) + 1)
            number += 1
            return _one_shard((t["part"][0].as_py() << 32) + number, conv[head], start, turn,
                              t["n_bytes"].to_numpy()[real])

        def shards(t: pa.Table, ends: list[int]) -> Iterator[tuple[int, int]]:
            """Cuts at ``ends`` (ends of conversations), as many as a shard may hold at a time."""
            begin = count = 0
            for end in ends:
                count += 1
                if end - begin >= most_turns or count == most_conversations:
                    yield begin, end
                    begin, count = end, 0

        held, turns, limit = [], 0, most_turns
        for b in batches:
            held.append(b)
            turns += len(b)
            if turns < limit:
                continue
            t = pa.Table.from_batches(held)
            ends = np.flatnonzero(t["pos"].to_numpy() == 0)[1:].tolist()
            done = 0
            for lo, hi in shards(t, ends):
                yield made(t.slice(lo, hi - lo))
                done = hi
            t = t.slice(done)
            held, turns = t.to_batches(), len(t)
            limit = max(most_turns, 2 * turns)
        if turns:
            t = pa.Table.from_batches(held)
            done = 0
            for lo, hi in shards(t, [*np.flatnonzero(t["pos"].to_numpy() == 0)[1:].tolist(), turns]):
                yield made(t.slice(lo, hi - lo))
                done = hi
            if done < turns:
                yield made(t.slice(done))

    return run


def _subtrees(key: tuple, t: pa.Table) -> pa.Table:
    """Partial sums of one shard's nodes, from what is known of their paths in all shards."""
    t = t.sort_by("pre").combine_chunks()
    up, size = t["up"].to_numpy(), t["size"].to_numpy()
    n, conv = t["all_n"].to_numpy(), t["conv_id"].to_numpy()
    own = t["first_shard"].to_numpy() == t["shard"].to_numpy()
    leaf = ~t["any_child"].to_numpy(zero_copy_only=False)
    m = len(t)

    def under(value: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(np.where(own, value, 0))))
        return total[np.arange(m) + size] - total[:m]

    kids = np.bincount(up[1:][own[1:]], minlength=m).astype(np.int64)
    parent = pa.array(conv[up], mask=(up < 0) | ~own)
    return pa.table({
        "path": t["path"], "depth": t["depth"], "conv_id": t["conv_id"], "n": t["all_n"],
        "parent": parent, "children": pa.array(kids), "leaves": pa.array(under(leaf.astype(np.int64))),
        "saved": pa.array(under((n - 1) * t["n_bytes"].to_numpy()))})


def _hashed_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 per path of its runs, in the order they come."""
    path, h = None, None
    for b in batches:
        done: list[tuple[bytes, str]] = []
        for p, ends in zip(b["path"].to_pylist(), b["ends"].to_pylist(), strict=True):
            if p != path:
                if h is not None:
                    done.append((path, h.hexdigest()))
                path, h = p, hashlib.sha256(ends.encode())
            else:
                h.update(b"," + ends.encode())
        yield pa.record_batch({"path": pa.array([p for p, _ in done], pa.binary()),
                               "ends_sha256": pa.array([x for _, x in done], pa.string())})
    if h is not None:
        yield pa.record_batch({"path": pa.array([path], pa.binary()),
                               "ends_sha256": pa.array([h.hexdigest()], pa.string())})


def numbered_turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                   role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, pos, turn, n_bytes of the rows of ``df`` that have a conversation: position in the
    conversation from 1, digest of (role, text), UTF-8 bytes of the text.

    A null role or text is empty. Rows are ordered by the turn column, nulls first, then by role and
    by the digest of the text; rows that repeat are turns of their own. Rows with a null
    conversation id belong to none."""
    role = F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit(""))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = (df.where(F.col(f"`{conv_col}`").isNotNull())
            .select(F.col(f"`{conv_col}`").cast("bigint").alias("conv_id"),
                    F.col(f"`{turn_col}`").alias("at"), role.alias("role"),
                    F.unhex(F.md5(F.concat_ws(":", F.octet_length(role), role, text))).alias("turn"),
                    F.octet_length(text).cast("bigint").alias("n_bytes")))
    order = W.partitionBy("conv_id").orderBy(F.col("at").asc_nulls_first(), "role", "turn")
    return (rows.withColumn("pos", F.row_number().over(order).cast("bigint"))
            .select("conv_id", "pos", "turn", "n_bytes"))


def prefix_trie(turns: DataFrame, conversations: DataFrame, shard_turns: int = SHARD_TURNS,
                shard_conversations: int = SHARD_CONVERSATIONS) -> DataFrame:
    """One row per distinct prefix of turns: path (its digest, empty for the root), depth, conv_id
    (smallest member), parent_conv_id (null for the root), n_convs, n_children, n_leaves,
    saved_tokens (over the subtree, (members - 1) times the bytes of the last turn), ends_sha256 (of
    the ascending, comma-joined ids of the members that end here).

    ``turns``: conv_id, pos (1, 2, .. without gaps), turn (digest), n_bytes. ``conversations``:
    conv_id of every conversation once; one without turns is a member of the root and ends there.
    Turns of others are not read. No conversations give no rows. A conversation meets in one task as
    40 bytes a turn, and one of very many turns is a shard of its own.
    """
    spark = turns.sparkSession
    checkpoint_root(spark)
    roots = conversations.select("conv_id", F.lit(0).cast("bigint").alias("pos"),
                                 F.lit(b"").alias("turn"), F.lit(0).cast("bigint").alias("n_bytes"))
    rows = roots.union(turns.join(conversations.select("conv_id"), "conv_id", "left_semi")
                       .select("conv_id", "pos", "turn", "n_bytes")).checkpoint()
    parts = max(LEAST_PARTITIONS, -(-rows.count() // PARTITION_TURNS))
    nodes = (rows.repartitionByRange(parts, "conv_id").sortWithinPartitions("conv_id", "pos")
             .withColumn("part", F.spark_partition_id().cast("bigint"))
             .mapInArrow(_shard_nodes(shard_turns, shard_conversations), NODE)).checkpoint()
    by = W.partitionBy("path")
    known = nodes.drop("ends").select(
        "*", F.sum("n").over(by).alias("all_n"), F.min("first").over(by).alias("conv_id"),
        F.min("shard").over(by).alias("first_shard"), F.max("has_child").over(by).alias("any_child"))
    sums = known.groupBy("shard").applyInArrow(
        _subtrees, "path binary, depth long, conv_id long, n long, parent long, children long,"
                   " leaves long, saved long")
    ends = (nodes.where("ends is not null").select("path", "shard", "ends")
            .repartition("path").sortWithinPartitions("path", "shard")
            .mapInArrow(_hashed_runs, "path binary, ends_sha256 string"))
    return (sums.groupBy("path", "depth", "conv_id", "n")
            .agg(F.max("parent").alias("parent_conv_id"), F.sum("children").alias("n_children"),
                 F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
            .join(ends, "path", "left")
            .select("path", "depth", "conv_id", "parent_conv_id", F.col("n").alias("n_convs"),
                    "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")))


SHARED = 5      # conversations c - c % 5 .. share the start of the first
HEADS = 9


def _head(conv: Column) -> Column:
    """Turns taken from the start of conversation c - c % 5."""
    return F.crc32(conv.cast("string")) % HEADS


def rebuilt(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """The turns of every conversation c after its first h are put behind the first h turns of
    conversation c - c % 5; h = crc32(c) % 9."""
    heads = (turns.where((F.col("conv_id") % SHARED == 0) & (F.col("pos") < HEADS))
             .withColumnsRenamed({"conv_id": "base", "pos": "base_pos"}))
    start = (conversations.withColumn("base", F.col("conv_id") - F.col("conv_id") % SHARED)
             .join(heads, "base").where(F.col("base_pos") <= _head(F.col("conv_id"))))
    shift = start.groupBy("conv_id").agg(F.count(F.lit(1)).alias("taken"))
    own = (turns.where(F.col("pos") > _head(F.col("conv_id"))).join(shift, "conv_id", "left")
           .withColumn("pos", F.col("pos") - _head(F.col("conv_id"))
                       + F.coalesce("taken", F.lit(0))))
    return (start.select("conv_id", F.col("base_pos").alias("pos"), "turn", "n_bytes")
            .union(own.select("conv_id", "pos", "turn", "n_bytes")))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt ``conversations``."""
    checkpoint_root(spark)
    turns = numbered_turns(table(spark, sf_dir, "conversations")).checkpoint()
    conversations = turns.select("conv_id").distinct()
    return prefix_trie(rebuilt(turns, conversations), conversations).drop("path")


_CRC = """(4294967295 - list_reduce(list_prepend(4294967295::BIGINT, list_transform(
    string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda s, x:
    list_reduce(list_prepend(xor(s, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda a, b:
        CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)))"""

ORACLE = f"""
WITH o AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT c, list({{'role': role, 'text': text}} ORDER BY pos) AS own FROM o GROUP BY c),
h AS (SELECT c, own, {_CRC} % 9 AS h FROM l),
r AS (SELECT h.c, coalesce(b.own[1:h.h], []) || h.own[h.h + 1:] AS turns
      FROM h LEFT JOIN l b ON b.c = h.c - h.c % 5),
p AS (SELECT c, unnest(range(0, len(turns) + 1)) AS depth, turns FROM r),
n AS (SELECT depth, path, min(c) AS conv_id, count(*) AS n_convs,
             strlen(coalesce(path[depth].text, '')) AS size,
             sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c)
                             FILTER (ends), '')) AS ends_sha256
      FROM (SELECT c, depth, turns[1:depth] AS path, len(turns) = depth AS ends FROM p)
      GROUP BY depth, path),
k AS (SELECT path[1:depth - 1] AS up, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
t AS (SELECT a.path, sum((NOT EXISTS (SELECT 1 FROM k WHERE k.up = b.path))::INT) AS n_leaves,
             sum((b.n_convs - 1) * b.size) AS saved_tokens
      FROM n a JOIN n b ON b.path[1:a.depth] = a.path AND b.depth >= a.depth GROUP BY 1)
SELECT n.conv_id, n.depth, m.conv_id AS parent_conv_id, n.n_convs,
       coalesce(k.n_children, 0)::BIGINT AS n_children, t.n_leaves::BIGINT AS n_leaves,
       t.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM n JOIN t ON t.path = n.path LEFT JOIN k ON k.up = n.path
LEFT JOIN n m ON n.depth > 0 AND m.path = n.path[1:n.depth - 1]
"""
