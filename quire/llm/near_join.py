"""Jaccard self-join of five-word shingle sets by chosen paths.

A run hangs every set in a tree: at a node, a set ``x`` goes into the child of each of its shingles
whose hash (seeded by the node) is below ``1 / (0.8 |x|)``. Two sets of Jaccard similarity 0.8
share at least 0.8 of the larger one's shingles, so at each level they are expected to share a
child at least once, while unlike sets part. Nodes of more than ``BUCKET_LIMIT`` sets are split
again, down to ``MOST_DEPTH``, where only sets that share most shingles are still together; the rest
are buckets, compared by brute force. First nodes full of near copies, which would stay together,
are buckets at once, whatever their size. Runs repeat until the chance of missing a pair at the
threshold at that depth is below ``1 - recall``.

1. ``_sketch``: equal sets become one text; a text carries the first nodes of all runs. Nodes are
   counted, those of one text dropped. The children of large nodes (but for those of near copies) are
   made level by level, from the texts in them alone: a task finds a text's path again from the
   large nodes' bit filters.
2. Near copies share most of their buckets. Where half of a bucket's texts have the same largest
   bucket, that is where they are gathered: one group instead of many buckets with the same texts,
   if its pairs are no more than theirs. Buckets whose texts all are in one group are dropped.
3. A pair that meets in several buckets belongs to its group, else to the smallest. From the lists
   of buckets and one-bit minhash signatures it is known which texts a bucket still has to compare,
   and only their shingles are fetched. A signature passes over a pair at the threshold with a
   probability below a hundredth of ``1 - recall``.
4. Buckets verify exact similarities and give per text its links and one edge towards the least
   text it is linked with there; components of the edges are the classes.

Buckets are cut into blocks of ``BLOCK`` texts that meet in pairs, so no bucket is one task; pairs
are compared inside a task and never written out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.bitfilter import bits_for, collect_bits, may_hold
from quire.llm.common import as_row, cut, field, from_row, join_spread, table
from quire.llm.components import components
from quire.llm.words import Words, grams, mix64, numbers, words_of
from quire.session import checkpoint_root

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.9999
BUCKET_LIMIT = 64
MOST_DEPTH = 4
BLOCK = 1024
LEAST_SHINGLES = 4      # smaller sets are equal or below any threshold over 0.75
SIGNATURE = 128         # bits
_MATRIX = 1 << 18


def runs_for(recall: float, depth: int) -> int:
    """Runs after which a pair at the threshold is missed with probability below 1 - recall: the
    number of children it shares is nearly a Poisson number of mean one, so it parts within one
    level with probability exp(-1), within one more with exp(that - 1), and so on."""
    parts = 0.0
    for _ in range(depth):
        parts = math.exp(parts - 1)
    return math.ceil(math.log(1 - recall) / math.log(parts))


def most_unlike(threshold: float, chance: float) -> int:
    """Bits in which the signatures of a pair at the threshold differ at most, but for ``chance``:
    each differs with probability (1 - threshold) / 2."""
    p, tail = (1 - threshold) / 2, 0.0
    for n in range(SIGNATURE, -1, -1):
        tail += math.comb(SIGNATURE, n) * p**n * (1 - p)**(SIGNATURE - n)
        if tail > chance:
            return n
    return 0


def shingles(w: Words, i: int, k: int) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles of row ``lo + i``; a text of fewer words
    has one shingle, a text of none has none."""
    h = w.hash[w.first[i]:w.first[i + 1]]
    return np.unique(grams(h, min(k, len(h)))) if len(h) else h


def _key(s: np.ndarray) -> tuple[int, int]:
    d = hashlib.md5(s.tobytes()).digest()
    return (int.from_bytes(d[:8], "little", signed=True),
            int.from_bytes(d[8:], "little", signed=True))


def _chosen(s: np.ndarray, at: np.ndarray, least: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Children of the nodes ``at`` that the set goes into: (number in ``at``, child)."""
    ups, kids = [], []
    step = max(1, _MATRIX // len(s))
    for a in range(0, len(at), step):
        part = at[a:a + step]
        r, c = np.nonzero(mix64(s[None, :] ^ part[:, None]) <= least)
        ups.append(r + a)
        kids.append(mix64(s[c] * np.uint64(0x9E3779B97F4A7C15) + part[r]))
    return np.concatenate(ups), np.concatenate(kids)


_ODD = numbers(SIGNATURE, 9) | np.uint64(1)


def _signature(s: np.ndarray) -> tuple[int, int]:
    """One bit of the smallest product of a shingle with each of ``SIGNATURE`` odd numbers."""
    low = np.full(SIGNATURE, np.iinfo(np.uint64).max)
    step = _MATRIX // SIGNATURE
    for a in range(0, len(s), step):
        np.minimum(low, (s[a:a + step, None] * _ODD).min(axis=0), out=low)
    return tuple(np.packbits((mix64(low) & np.uint64(1)).astype(np.uint8)).view(np.int64).tolist())


def _least(s: np.ndarray, threshold: float) -> np.uint64:
    return np.uint64(min(2**64 - 1, int(2**64 / (threshold * len(s)))))


def _longs(parts: list) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    flat = np.concatenate([np.asarray(p, dtype=np.uint64) for p in parts] or [np.zeros(0, np.uint64)])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def _sketch(k: int, threshold: float, roots: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w in words_of(b["text"]):
                n = w.hi - w.lo
                k1, k2, s1, s2, nodes = [], [], [], [], []
                for i in range(n):
                    s = shingles(w, i, k)
                    a, z = _key(s) if len(s) else (None, None)
                    k1.append(a), k2.append(z)
                    a, z = _signature(s)
                    s1.append(a), s2.append(z)
                    nodes.append(_chosen(s, roots, _least(s, threshold))[1]
                                 if len(s) >= LEAST_SHINGLES else [])
                yield pa.record_batch({
                    "id": b["id"].slice(w.lo, n), "k1": pa.array(k1, pa.int64()),
                    "k2": pa.array(k2, pa.int64()), "s1": pa.array(s1, pa.int64()),
                    "s2": pa.array(s2, pa.int64()), "nodes": _longs(nodes)})

    return run


def _held(held: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    return nodes[may_hold(held, nodes)] if len(nodes) else nodes


def _children(k: int, threshold: float, roots: np.ndarray, large: list, wanted) -> Callable:
    """Children of the large nodes of the last level, for the texts in them; ``large`` holds a bit
    filter of each level's large nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b["h"].to_numpy()
            keep = np.flatnonzero(may_hold(wanted.value, h.view(np.uint64)))
            for w in words_of(b["text"].take(pa.array(keep))):
                out: list[list] = [[], [], [], []]
                for i in range(w.hi - w.lo):
                    s = shingles(w, i, k)
                    if len(s) < LEAST_SHINGLES:
                        continue
                    at, least = roots, _least(s, threshold)
                    for level in large:
                        at = _held(level.value, np.unique(_chosen(s, at, least)[1]))
                        if not len(at):
                            break
                    if not len(at):
                        continue
                    kids = _chosen(s, at, least)[1].view(np.int64)
                    for c, v in zip(out[1:], (*_key(s), h[keep[w.lo + i]]), strict=True):
                        c.append(np.full(len(kids), v))
                    out[0].append(kids)
                if out[0]:
                    yield pa.record_batch([pa.array(np.concatenate(c)) for c in out],
                                          names=["node", "k1", "k2", "h"])

    return run


def _rows_held(bits) -> Callable:
    """(node, k1, k2, h, of) for the nodes of a text that are in the filter; ``of`` is how many nodes
    the text has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            off, val = _lists(b, "nodes")
            of = np.diff(off)
            row = np.repeat(np.arange(len(b)), of)
            val = val[off[0]:off[-1]]
            keep = may_hold(bits.value, val.view(np.uint64)) if len(val) else np.zeros(0, bool)
            at = pa.array(row[keep])
            yield pa.record_batch({"node": pa.array(val[keep]), "k1": b["k1"].take(at),
                                   "k2": b["k2"].take(at), "h": b["h"].take(at),
                                   "of": pa.array(of[row[keep]].astype(np.int64))})

    return run


def _members(bits, schema_of_row: list[str]) -> Callable:
    """A row per text, bucket (of its group, and those in the filter) and block pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            off, flat = b["buckets"].offsets.to_numpy(), b["buckets"].values
            num, n = flat.field("bucket").to_numpy(), flat.field("n").to_numpy()
            group, size = (b[c].fill_null(0).to_numpy() for c in ("grp", "grp_n"))
            there = b["grp"].is_valid().to_numpy(zero_copy_only=False)
            key = b["k1"].to_numpy()
            rows, lists, out = [], [], [[], [], [], []]
            for i in range(len(b)):
                own = num[off[i]:off[i + 1]]
                keep = may_hold(bits.value, own.view(np.uint64) << np.uint64(1))
                own, sizes = own[keep], n[off[i]:off[i + 1]][keep]
                if there[i]:
                    own, sizes = np.append(own, int(group[i])), np.append(sizes, int(size[i]))
                for bucket, m in zip(own.tolist(), sizes.tolist(), strict=True):
                    blocks = -(-m // BLOCK)
                    mine = int(key[i]) % blocks
                    for other in range(blocks):
                        rows.append(i)
                        lists.append(own)
                        for c, v in zip(out, (bucket, min(mine, other), max(mine, other), mine),
                                        strict=True):
                            c.append(v)
            if rows:
                at = pa.array(rows)
                cols = dict(zip(("bucket", "lo", "hi", "block"),
                                (pa.array(c, pa.int64()) for c in out), strict=True))
                cols |= {c: b[c].take(at) for c in ("k1", "k2", "s1", "s2", "h", "rep", "copies")}
                cols["buckets"] = _longs(lists)
                yield pa.record_batch([cols[c] for c in schema_of_row], names=schema_of_row)

    return run


def _sets(k: int, bits) -> Callable:
    """Shingles of the rows whose hashed id is in the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bits.value
        for b in batches:
            keep = may_hold(held, b["h"].to_numpy().view(np.uint64))
            for w in words_of(b["text"].filter(pa.array(keep))):
                sets = [s for i in range(w.hi - w.lo) if len(s := shingles(w, i, k))]
                keys = [_key(s) for s in sets]
                yield pa.record_batch({
                    "k1": pa.array([a for a, _ in keys], pa.int64()),
                    "k2": pa.array([z for _, z in keys], pa.int64()), "s": _longs(sets)})

    return run


def _in_order(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple]:
    """(table, lo, hi) of every run of equal keys in batches sorted by them."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = (pa.concat_tables([rest, t]) if rest is not None else t).combine_chunks()
        cut = np.zeros(max(0, len(t) - 1), dtype=bool)
        for c in keys:
            v = t[c].to_numpy()
            cut |= v[1:] != v[:-1]
        edges = np.concatenate(([0], np.flatnonzero(cut) + 1)) if len(t) else np.zeros(1, int)
        yield t, edges[:-1], edges[1:]
        rest = t.slice(edges[-1])
    if rest is not None and len(rest):
        yield rest.combine_chunks(), np.array([0]), np.array([len(rest)])


def _lists(t: pa.Table, c: str) -> tuple[np.ndarray, np.ndarray]:
    col = t[c].combine_chunks() if isinstance(t[c], pa.ChunkedArray) else t[c]
    return col.offsets.to_numpy(), col.values.to_numpy()


def _open_pairs(bucket: int, block: np.ndarray, lo: int, hi: int, lists: list[np.ndarray],
                signs: tuple[np.ndarray, np.ndarray], unlike: int) -> np.ndarray:
    """Boolean matrix: the pairs that belong to this bucket and block pair and whose signatures
    differ in at most ``unlike`` bits."""
    n = len(lists)
    mine = sum(np.bitwise_count(x[:, None] ^ x[None, :]) for x in signs) <= unlike
    if lo != hi:
        mine &= (block[:, None] == lo) & (block[None, :] == hi)
    else:
        mine = np.triu(mine, 1)
    earlier = [x[x < bucket] for x in lists]
    flat = np.concatenate(earlier)
    if len(flat):
        who = np.repeat(np.arange(n), [len(x) for x in earlier])
        order = np.lexsort((who, flat))
        flat, who = flat[order], who[order]
        edge = np.concatenate(([0], np.flatnonzero(flat[1:] != flat[:-1]) + 1, [len(flat)]))
        for i in np.flatnonzero(np.diff(edge) > 1):
            both = who[edge[i]:edge[i + 1]]
            mine[np.ix_(both, both)] = False
    return mine


def _needed(unlike: int) -> Callable:
    """Of every bucket's members those that have a pair left to compare there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, los, his in _in_order(batches, ["bucket", "lo", "hi"]):
            if not len(los):
                continue
            bucket, blk, a, z = (t[c].to_numpy() for c in ("bucket", "block", "lo", "hi"))
            signs = [t[c].to_numpy().view(np.uint64) for c in ("s1", "s2")]
            off, val = _lists(t, "buckets")
            keep = []
            for lo, hi in zip(los, his, strict=True):
                if hi - lo < 2:
                    continue
                own = [val[off[i]:off[i + 1]] for i in range(lo, hi)]
                mine = _open_pairs(bucket[lo], blk[lo:hi], a[lo], z[lo], own,
                                   [x[lo:hi] for x in signs], unlike)
                keep.append(lo + np.flatnonzero(mine.any(axis=0) | mine.any(axis=1)))
            if keep:
                yield from t.take(pa.array(np.concatenate(keep))).to_batches()

    return run


def _overlaps(sets: list[np.ndarray], wanted: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(i, shingles that set i shares with every set) for the rows of ``wanted`` that have any."""
    rows = np.flatnonzero(wanted.any(axis=1))
    if len(sets) <= 8:
        for i in rows:
            out = np.zeros(len(sets), dtype=np.int64)
            for j in np.flatnonzero(wanted[i]):
                out[j] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            yield i, out
        return
    size = np.array([len(s) for s in sets])
    who = np.repeat(np.arange(len(sets)), size)
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(token, kind="stable")
    posting, first = who[order], np.concatenate(([0], np.cumsum(count)))
    begin = np.concatenate(([0], np.cumsum(size)))
    for i in rows:
        mine = token[begin[i]:begin[i + 1]]
        c = count[mine]
        at = np.repeat(first[mine] - np.concatenate(([0], np.cumsum(c)[:-1])), c) + np.arange(c.sum())
        yield i, np.bincount(posting[at], minlength=len(sets))


def _verified(threshold: float, unlike: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, los, his in _in_order(batches, ["bucket", "lo", "hi"]):
            if not len(los):
                continue
            col = {c: t[c].to_numpy() for c in ("bucket", "lo", "hi", "block", "k1", "k2", "copies")}
            signs = [t[c].to_numpy().view(np.uint64) for c in ("s1", "s2")]
            off, val = _lists(t, "buckets")
            soff, sval = _lists(t, "s")
            at, links, to = [], [], []
            for lo, hi in zip(los, his, strict=True):
                own, seen = [], set()
                for i in range(lo, hi):     # a repeated row gives its text twice
                    k = (col["k1"][i], col["k2"][i], col["block"][i])
                    if k not in seen:
                        seen.add(k)
                        own.append(i)
                if len(own) < 2:
                    continue
                own = np.array(own)
                sets = [sval[soff[i]:soff[i + 1]] for i in own]
                size = np.array([len(s) for s in sets])
                mine = _open_pairs(col["bucket"][lo], col["block"][own], col["lo"][lo],
                                   col["hi"][lo], [val[off[i]:off[i + 1]] for i in own],
                                   [x[own] for x in signs], unlike)
                least = np.minimum(size[:, None], size[None, :])
                mine &= least >= threshold * (size[:, None] + size[None, :] - least) - 1e-9
                n, copies = np.zeros(len(own), dtype=np.int64), col["copies"][own]
                root = np.arange(len(own))
                for i, both in _overlaps(sets, mine):
                    j = np.flatnonzero(mine[i] & (
                        both >= threshold * (size[i] + size - both) - 1e-9))
                    if len(j):
                        n[i] += copies[j].sum()
                        n[j] += copies[i]
                        tied = np.append(root[j], root[i])
                        root[np.isin(root, tied)] = tied.min()
                linked = np.flatnonzero(n)
                at.append(own[linked])
                links.append(n[linked])
                to.append(own[root[linked]])
            if at:
                at, to = pa.array(np.concatenate(at)), pa.array(np.concatenate(to))
                yield pa.record_batch({
                    "k1": t["k1"].combine_chunks().take(at), "k2": t["k2"].combine_chunks().take(at),
                    "links": pa.array(np.concatenate(links)),
                    "rep": t["rep"].combine_chunks().take(at),
                    "to_rep": t["rep"].combine_chunks().take(to)})

    return run


def _filter(spark: SparkSession, values: DataFrame, column: str):
    """A broadcast bit filter of a bounded size over a column of hashes."""
    return spark.sparkContext.broadcast(collect_bits(values, column, bits_for(values.count())))


def _with_size(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """rows node, k1, ..: those whose node is in ``sizes``, with its size n; hot nodes are spread."""
    return join_spread(rows, sizes, ["node"], "k1")


def _whole(rows: DataFrame) -> DataFrame:
    """rows node, n, k1, k2, .., of: the texts of the large first nodes. Adds whole: is the node one of
    near copies? Half of its texts or more have two thirds of their nodes among those whose texts
    mostly have the same largest node. Such texts go into the same children, so splitting the node
    would write them again at every level and part hardly any."""
    text = ["k1", "k2"]
    first = F.max(F.struct("n", "node")).over(W.partitionBy(*text))["node"]
    to = (rows.withColumn("first", first).groupBy("node", "n", "first")
          .agg(F.count(F.lit(1)).alias("c"))
          .groupBy("node", "n").agg(F.max(F.struct("c", "first")).alias("top"))
          .where(F.col("top.c") * 2 >= F.col("n"))
          .select("node", F.col("top.first").alias("to")).checkpoint())
    shared = F.count(F.lit(1)).over(W.partitionBy(*text, "to"))
    whole = (join_spread(rows.select("node", "n", *text, "of"), to, ["node"], "k1")
             .withColumn("alike", shared * 3 >= F.col("of") * 2)
             .groupBy("node", "n").agg(F.count_if("alike").alias("c"))
             .where(F.col("c") * 2 >= F.col("n")).select("node", F.lit(True).alias("whole")))
    every = (rows.select("node").distinct().join(whole, "node", "left")
             .select("node", F.coalesce("whole", F.lit(False)).alias("whole")))
    return join_spread(rows, every.checkpoint(), ["node"], "k1")


def _buckets(spark: SparkSession, ids: DataFrame, texts: DataFrame, shingle: int, threshold: float,
             roots: np.ndarray, limit: int) -> DataFrame:
    """bucket, n, k1, k2: the buckets of every text that shares one."""
    sizes = cut(texts.select(F.explode("nodes").alias("node")).groupBy("node")
                .agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    rows = texts.select("nodes", "k1", "k2", F.xxhash64("rep").alias("h")).mapInArrow(
        _rows_held(_filter(spark, sizes, "node")), "node long, k1 long, k2 long, h long, of long")
    level = cut(_with_size(rows, sizes))
    done, large = [], []
    for depth in range(1, MOST_DEPTH + 1):
        done.append(level.where(F.col("n") <= limit))
        level = level.where(F.col("n") > limit)
        if depth == 1:
            level = cut(_whole(level))
            done.append(level.where("whole"))
            level = level.where("not whole")
        ups = level.select("node", "n").distinct().checkpoint()
        if depth == MOST_DEPTH or ups.isEmpty():
            done.append(level)
            break
        large.append(_filter(spark, ups, "node"))
        wanted = _filter(spark, level.select("h").distinct().checkpoint(), "h")
        kids = cut(ids.select(F.xxhash64("id").alias("h"), "text")
                .mapInArrow(_children(shingle, threshold, roots, list(large), wanted),
                            "node long, k1 long, k2 long, h long")
                .groupBy("node", "k1", "k2").agg(F.min("h").alias("h")))
        sizes = cut(kids.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
        level = cut(_with_size(kids, sizes))
    out = [d.select(F.shiftrightunsigned("node", 1).alias("bucket"), "n", "k1", "k2") for d in done]
    return reduce(lambda a, b: a.union(b), out)


def _gathered(lists: DataFrame) -> DataFrame:
    """lists: k1, .., buckets (array of n, bucket), first (the largest). Adds grp and grp_n (null where there is
    none): the group a text is gathered in, numbered below all buckets."""
    by_first = (lists.select(F.explode("buckets.bucket").alias("bucket"), "first")
                .groupBy("bucket", "first").agg(F.count(F.lit(1)).alias("c")))
    of = (by_first.groupBy("bucket").agg(
        F.sum("c").alias("n"), F.max(F.struct("c", "first")).alias("top"),
        F.sum(F.when(F.col("first") == F.col("bucket"), F.col("c")).otherwise(0)).alias("firsts"))
        .where(F.col("top.c") * 2 >= F.col("n"))
        .select("bucket", "n", "firsts", F.col("top.first").alias("to")).checkpoint())
    fits = (of.groupBy("to").agg(F.sum("firsts").alias("size"),
                                 F.sum(F.col("n") * F.col("n")).alias("pairs"))
            .where(F.col("size") * F.col("size") <= F.col("pairs")).select("to", "size"))
    to = of.where("firsts > 0").join(fits, "to").select(
        F.col("bucket").alias("first"), (-1 - F.col("to")).alias("grp"),
        F.col("size").alias("grp_n"))
    every = lists.select("first").distinct().join(to, "first", "left")
    return join_spread(lists, every, ["first"], "k1")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    threshold: float = THRESHOLD, shingle: int = SHINGLE,
                    recall: float = RECALL, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """One row per row of ``df``: the id, ``class_id`` (least id of the documents connected by
    links) and ``n_links`` (other rows whose similarity is the threshold or more).

    Words are runs of letters, digits and non-ASCII characters, lower-cased. A text of one to four
    words is one shingle; a text without words, or null, is a class of its own without links. Equal
    shingle sets are links (similarity 1), so repeated rows are compared once, however many; a long
    text is one set and needs memory for its shingles. A null id is allowed; rows that share an id
    share its class. An empty table gives an empty result. Other columns are not read.
    """
    spark = df.sparkSession
    checkpoint_root(spark)
    ids = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    id_field = T.StructField("id", ids.schema["id"].dataType)
    roots = numbers(runs_for(recall, MOST_DEPTH), 7)
    unlike = most_unlike(threshold, (1 - recall) / 100)
    sketch = ids.mapInArrow(_sketch(shingle, threshold, roots), T.StructType([
        id_field, *T.StructType.fromDDL("k1 long, k2 long, s1 long, s2 long, nodes array<long>").fields])).checkpoint()
    key = ["k1", "k2"]
    texts = cut(sketch.where("k1 is not null").groupBy(*key)
             .agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"),
                  F.first("s1").alias("s1"), F.first("s2").alias("s2"),
                  F.first("nodes").alias("nodes")))
    buckets = _buckets(spark, ids, texts, shingle, threshold, roots, bucket_limit)
    lists = cut(buckets.groupBy(*key)
             .agg(F.collect_list(F.struct("n", "bucket")).alias("buckets"))
             .join(texts.drop("nodes"), key)
             .withColumn("h", F.xxhash64("rep"))
             .withColumn("first", F.array_max("buckets")["bucket"]))
    lists = cut(_gathered(lists))
    # a bucket whose texts are all in one group has nothing left to compare
    left = (lists.select(F.explode("buckets.bucket").alias("bucket"), "grp").groupBy("bucket")
            .agg(F.min("grp").alias("a"), F.max("grp").alias("z"),
                 F.count_if(F.col("grp").isNull()).alias("free"))
            .where("free > 0 or a != z").select(F.shiftleft("bucket", 1).alias("bucket"))).checkpoint()
    rep = T.StructField("rep", id_field.dataType)
    row = T.StructType([
        *T.StructType.fromDDL("bucket long, lo long, hi long, block long, k1 long, k2 long,"
                              " s1 long, s2 long, h long").fields, rep,
        *T.StructType.fromDDL("copies long, buckets array<long>").fields])
    members = lists.mapInArrow(_members(_filter(spark, left, "bucket"), row.names), row)
    task = ["bucket", "lo", "hi"]
    needed = cut(members.repartition(*task).sortWithinPartitions(*task)
                 .mapInArrow(_needed(unlike), row))
    bits = _filter(spark, needed.select("h").distinct(), "h")
    sets = (ids.select(F.xxhash64("id").alias("h"), "text")
            .mapInArrow(_sets(shingle, bits), "k1 long, k2 long, s array<long>"))
    found = cut(needed.drop("h").join(sets, key).repartition(*task).sortWithinPartitions(*task)
             .mapInArrow(_verified(threshold, unlike), T.StructType([
                 *T.StructType.fromDDL("k1 long, k2 long, links long").fields, rep,
                 T.StructField("to_rep", id_field.dataType)])))
    links = found.groupBy(*key).agg(F.sum("links").alias("links"))
    label = components(found.where("rep is not null and to_rep is not null")
                       .select(F.col("rep").alias("u"), F.col("to_rep").alias("v")))
    info = (texts.select(*key, "rep", "copies").join(links, key, "left")
            .join(label.withColumnRenamed("node", "rep"), "rep", "left")
            .select(*key, F.coalesce("label", "rep").alias("class_id"),
                    (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    named = sketch.where("k1 is not null").select("id", *key)
    alone = sketch.where("k1 is null")
    out = (join_spread(named, info, key, "id").select("id", "class_id", "n_links")
           .union(alone.select("id", "id", F.lit(0).cast("bigint"))))
    return out.withColumnRenamed("id", id_col)


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose id is the least of its class, with all their columns. Rows that
    share an id stay or go together."""
    gone = (near_duplicates(df, id_col, text_col)
            .where(~F.col(f"`{id_col}`").eqNullSafe(F.col("class_id")))
            .select(F.col(f"`{id_col}`").alias("gone")).distinct())
    rows = as_row(df).withColumn("id", field(id_col))
    return from_row(rows.join(gone, F.col("id").eqNullSafe(F.col("gone")), "left_anti"), df.columns)


def op4_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes and link counts of all of ``documents``."""
    return near_duplicates(table(spark, sf_dir, "documents"))
