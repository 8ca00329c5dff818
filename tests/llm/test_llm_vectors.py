"""Top-k search, whitening and the prefix trie against brute force, and their edge cases."""

import hashlib
import math
import os
import random
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from quire.llm import registry, topk, trie, whitening  # noqa: E402

SF = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
VECS = "vec_id long, embedding array<double>, x string, id long, copies int, key int, weight int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 5, 6, 7, 8) for i, v in rows], VECS)


def usable(rows):
    return [(i, v) for i, v in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]


def top_brute(rows, k=20):
    ok = [(i, [math.floor(64 * c) for c in v]) for i, v in usable(rows)]
    out = []
    for n, (q, x) in enumerate(ok):
        if q is None or q % 20:
            continue
        scored = sorted((-sum(a * b for a, b in zip(x, y)), i is None, i or 0)
                        for m, (i, y) in enumerate(ok) if m != n)[:k]
        out += [(q, r, None if no else i, -s) for r, (s, no, i) in enumerate(scored, 1)]
    return Counter(out)


ODD = [(0, None), (20, [1.0, None]), (40, [math.nan, 1.0]), (60, [math.inf, 0.0]),
       (80, [0.5, -0.0]), (80, [0.5, 0.0]), (80, [0.5, 0.25]), (None, [0.5, 0.5]), (7, [0.5, 0.25]),
       (100, []), (3, [1.0]), (120, [0.25, 0.25, 4.0])]


def test_topk_edges_equal_brute_force(spark):
    rng = random.Random(3)
    rows = ODD + [(rng.randrange(200), [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(2)])
                  for _ in range(400)] + [(140, [0.5, 0.5])] * 50
    got = topk.top_k(vectors(spark, rows).repartition(3), F.col("vec_id") % 20 == 0).collect()
    assert Counter((r.query_id, r.rank, r.vec_id, r.score) for r in got) == top_brute(rows)


def test_topk_few_rows_large_values_and_empty_tables(spark):
    rows = [(20, [3e7, -2e6]), (21, [1e7, 5e6]), (22, [-1e7, 3.0])]     # beyond 2**53
    got = topk.top_k(vectors(spark, rows), F.col("vec_id") % 20 == 0).collect()
    assert Counter((r.query_id, r.rank, r.vec_id, r.score) for r in got) == top_brute(rows)
    beyond = [(20, [1e300]), (21, [1e300]), (22, [-1e300])]
    got = topk.top_k(vectors(spark, beyond), F.col("vec_id") % 20 == 0).collect()
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [
        (21, 2**63 - 1), (22, -2**63 + 1)]
    assert topk.top_k(vectors(spark, []), F.col("vec_id") % 20 == 0).count() == 0
    assert topk.top_k(vectors(spark, [(1, [1.0])]), F.col("vec_id") % 20 == 0).count() == 0
    assert topk.top_k(vectors(spark, [(20, [1.0])]), F.col("vec_id") % 20 == 0).count() == 0


def test_topk_tiles_equal_one_product():
    rng = np.random.default_rng(5)
    c = np.sort(rng.integers(-3, 4, (20_000, 4)), axis=0)
    q = rng.integers(-3, 4, (600, 4))
    who, which, score = topk.best(q, c, 9)
    for i in range(0, 600, 37):
        s = c @ q[i]
        want = np.lexsort((np.arange(len(c)), -s))[:9]
        assert which[who == i].tolist() == want.tolist()
        assert score[who == i].tolist() == s[want].tolist()


def test_topk_many_shards_merge_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(topk, "LEAST_ROWS", 8)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 10)
    rows = [(r.vec_id, list(map(float, r.embedding))) for r in
            spark.read.parquet(f"{SF01}/embeddings.parquet").collect()]
    got = topk.top_k(spark.read.parquet(f"{SF01}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
    assert Counter((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()) == top_brute(rows)


def whiten_brute(rows, k=32):
    ok = usable(rows)
    width = Counter(len(v) for _, v in ok)
    d = min(width, key=lambda n: (-width[n], n)) if ok else 0
    ok = [(i, v) for i, v in ok if len(v) == d]
    x = np.array([[math.floor(64 * c) + 1000000 for c in v] for _, v in ok], dtype=np.int64)
    n = len(x)
    dev = n * x - x.sum(axis=0)
    c = dev / n
    e, q = np.linalg.eigh(c.T @ c / n)
    return [i for i, _ in ok], dev, c, e[::-1][:k], q[:, ::-1][:, :k], e.sum()


def held(got, rows):
    ids, dev, c, e, q, trace = whiten_brute(rows)
    n, k = len(ids), len(e)
    assert len(got) == n and {r.n for r in got} == {n}
    want = c @ (q / np.sqrt(e))
    by = defaultdict(list)
    for i, row, s in zip(ids, want, (dev.astype(object) ** 2).sum(axis=1), strict=True):
        by[i, int(s)].append(row)
    z = np.array([r.whitened for r in got])
    sign = np.sign(sum(z[j] * by[r.vec_id, int(r.deviation)][0] for j, r in enumerate(got)))
    for j, r in enumerate(got):
        near = [np.abs(z[j] - sign * w).max() for w in by[r.vec_id, int(r.deviation)]]
        assert min(near) < 1e-7
    assert np.allclose(got[0].explained, e / trace, rtol=1e-9)
    cov = (z - z.mean(axis=0)).T @ (z - z.mean(axis=0)) / n
    assert abs(got[0].identity_error - np.abs(cov - np.eye(k)).max()) < 1e-9 > got[0].identity_error


def test_whitening_equals_brute_force(spark):
    df = spark.read.parquet(f"{SF01}/embeddings.parquet")
    rows = [(r.vec_id, list(map(float, r.embedding))) for r in df.collect()]
    held(whitening.whiten(df).collect(), rows)
    query = registry.QUERIES["op12_whitening"](spark, SF01)
    assert query.count() == 32 * len(rows)
    assert sorted({r.component for r in query.select("component").distinct().collect()}) == list(
        range(1, 33))


def test_whitening_edges(spark):
    rng = random.Random(4)
    rows = [r for r in ODD if r[1] is None or len(r[1]) != 2] + [
        (i if i % 9 else None, [rng.gauss(0, 1), rng.gauss(2, 3)]) for i in range(60)]
    rows += [(5, [9.0, 1.0])] * 70 + [(i, [0.5, 0.25]) for i in range(100, 140)] + [(0, [None, 1.0])]
    held(whitening.whiten(vectors(spark, rows).repartition(3)).collect(), rows)
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None), (2, [])])).count() == 0
    one = whitening.whiten(vectors(spark, [(1, [2.0, 3.0])])).collect()
    assert one[0].whitened == [None, None] and one[0].explained == [None, None]
    assert one[0].deviation == 0 and one[0].identity_error is None
    line = whitening.whiten(vectors(spark, [(i, [float(i), 1.0, 2.0 * i]) for i in range(9)])).collect()
    assert all(r.whitened[0] is not None and r.whitened[1:] == [None, None] for r in line)
    assert line[0].identity_error < 1e-9
    big = whitening.whiten(vectors(spark, [(i, [1e15 * i, -1e15 * i * i]) for i in range(5)])).collect()
    assert max(r.deviation for r in big) > 2**63 and big[0].identity_error < 1e-4


def test_whitening_weights(spark):
    rows = [(i, [float(i), float(i * i % 7)]) for i in range(8)]
    many = rows + [(99, rows[3][1])] * 30
    one = whitening.whiten(vectors(spark, many), weights="one").collect()
    apart = {r.vec_id: r.whitened for r in whitening.whiten(vectors(spark, rows)).collect()}
    assert all(np.allclose(r.whitened, apart[3 if r.vec_id == 99 else r.vec_id]) for r in one)
    with pytest.raises(ValueError):
        whitening.whiten(vectors(spark, rows), weights="half")


def trie_brute(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            own[c].append((t is not None, t or 0, r,
                           hashlib.md5(f"{len(r.encode())}:{r}:{x}".encode()).digest(), x))
    own = {c: [(r, x) for _, _, r, _, x in sorted(v)] for c, v in own.items()}
    built = {c: own.get(c - int(math.fmod(c, 5)), [])[:(h := zlib.crc32(str(c).encode()) % 9)] + v[h:]
             for c, v in own.items()}
    members, kids = defaultdict(list), Counter()
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    return {(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p],
             saved[p], hashlib.sha256(",".join(map(str, sorted(
                 c for c in m if len(built[c]) == len(p)))).encode()).hexdigest())
            for p, m in members.items()}


TRIE = ("conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256").split()
CONV = "conv_id long, turn long, role string, text string, pos int, n_bytes int, path string"


def talks(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "p") for r in rows], CONV)


def built_trie(df, **shards):
    turns = trie.numbered_turns(df).checkpoint()
    convs = turns.select("conv_id").distinct()
    got = trie.prefix_trie(trie.rebuilt(turns, convs), convs, **shards).collect()
    out = {tuple(r[c] for c in TRIE) for r in got}
    assert len(out) == len(got)
    return out


@pytest.mark.parametrize("turns,convs", [(7, 4096), (1 << 16, 3), (1 << 16, 4096)])
def test_trie_equals_brute_force_for_any_shards(spark, turns, convs):
    rng = random.Random(turns + convs)
    rows = [(rng.choice([None, *range(-12, 60)]), rng.choice([None, 0, 1, 2, 3]),
             rng.choice([None, "", "u", "a"]), rng.choice([None, "", "x", "y", "é"]))
            for _ in range(500)]
    rows += [(c, t, "u", f"k{t % 3}") for c in (100, 101, 105, 110, 111) for t in range(200)]
    rows += [(c, 0, "system", "same") for c in range(200, 400)]
    rows += rows[-30:] + [(500, 1, "u", "long " * 50_000)]
    got = built_trie(talks(spark, rows), shard_turns=turns, shard_conversations=convs)
    assert got == trie_brute(rows)


def test_trie_members_without_turns_and_empty_tables(spark):
    assert built_trie(talks(spark, [])) == set()
    assert built_trie(talks(spark, [(None, 1, "u", "x")])) == set()
    convs = spark.createDataFrame([(4,), (9,)], "conv_id long")
    none = trie.numbered_turns(talks(spark, []))
    root = trie.prefix_trie(none, convs).collect()
    assert len(root) == 1 and root[0].n_convs == 2 and root[0].n_leaves == 1
    assert root[0].ends_sha256 == hashlib.sha256(b"4,9").hexdigest()
    assert root[0].parent_conv_id is None


def test_trie_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF01}/conversations.parquet").collect()
    got = registry.QUERIES["op11_prefix_trie"](spark, SF01).collect()
    assert {tuple(r[c] for c in TRIE) for r in got} == trie_brute(
        [(r.conv_id, r.turn, r.role, r.text) for r in rows])
