"""Brute-force versions of the operators on embeddings."""

import math

import numpy as np
import pytest

from ranklake.llm import ann, embedding_dedup

from .test_text_operators import brute_components

SCHEMA = "vec_id long, embedding array<float>, label int, row string, block int, tile int, u int, n int"


def vectors():
    rng = np.random.default_rng(4)
    base = rng.standard_normal((30, 16))
    out = [list(map(float, v)) for v in base]
    out += [list(map(float, v + 0.05 * rng.standard_normal(16))) for v in base[:12]]
    out += [list(map(float, 3 * v)) for v in base[5:8]] + [out[0]] * 5 + [list(map(float, -base[1]))]
    out += [list(map(float, base[20] * (1 - t) + base[21] * t)) for t in np.linspace(0, 1, 9)]
    out += [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0] * 4, [2.0] * 4, [1e-30] * 16, [1e30] * 16]
    return [(i * 5, v) for i, v in enumerate(out)] + [(None, out[3]), (15, out[3])]


def table(spark):
    return spark.createDataFrame([(i, v, 1, "r", 2, 3, 4, 5) for i, v in vectors()], SCHEMA)


def good(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def cosine(a, b):
    if not good(a) or not good(b) or len(a) != len(b):
        return -2.0
    x, y = (np.array(v, np.float32).astype(np.float64) for v in (a, b))
    x, y = x / np.abs(x).max(), y / np.abs(y).max()
    return float(x @ y / math.sqrt((x @ x) * (y @ y)))


@pytest.mark.parametrize("threshold,tile", [(0.95, 16_384), (0.95, 4), (0.5, 7)])
def test_embedding_dedup(spark, threshold, tile, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "LEAST_TILE", 4)
    data = vectors()
    near = lambda a, b: cosine(a[1], b[1]) >= threshold
    comp = brute_components(data, near)
    least = {}
    for (i, _), c in zip(data, comp):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    want = sorted(((i, sum(near(d, e) for k, e in enumerate(data) if k != j), least.get(comp[j])) for j, d in enumerate(data) for i in [d[0]]), key=str)
    got = embedding_dedup.near_duplicates(table(spark), threshold, tile).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)


def test_all_tile_pairs_without_centres(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "LEAST_TILE", 4)
    want = sorted(embedding_dedup.near_duplicates(table(spark), 0.95, 6).collect(), key=str)
    monkeypatch.setattr(embedding_dedup, "CENTRES", 0)
    assert sorted(embedding_dedup.near_duplicates(table(spark), 0.95, 6).collect(), key=str) == want


def test_quantisation_bound():
    rng = np.random.default_rng(2)
    for dim in (3, 64, 3000):
        a, b = (rng.standard_normal((200, dim)) * rng.random((200, dim)) ** 4 for _ in range(2))
        b[:100] = a[:100] + 0.1 * rng.standard_normal((100, dim)) * np.abs(a[:100]).mean()
        a, b = (x / np.sqrt((x * x).sum(1, keepdims=True)) for x in (a, b))
        for t in (0.2, 0.9, 0.99):
            i, j = embedding_dedup.possible(embedding_dedup.quantise(a), embedding_dedup.quantise(b), t)
            held = set(zip(i.tolist(), j.tolist()))
            p, q = np.nonzero(a @ b.T >= t)
            assert set(zip(p.tolist(), q.tolist())) <= held
            assert len(held) <= 1.3 * len(p) + 300


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert embedding_dedup.near_duplicates(none).count() == 0
    from pyspark.sql import functions as F
    assert ann.nearest(none, F.col("vec_id") % 50 == 0).count() == 0


def test_nearest_small(spark):
    """Few rows: every answer is exact."""
    from pyspark.sql import functions as F
    data = vectors()
    got = ann.nearest(table(spark), F.col("vec_id") % 10 == 0, k=4, block=10_000).collect()
    have = {}
    for r in got:
        have.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for j, (i, v) in enumerate(data):
        if i is None or i % 10 or not good(v):
            assert i not in have or not good(v) or i % 10 == 0
            continue
        all_ = [(cosine(v, w), k) for n, (k, w) in enumerate(data) if n != j and cosine(v, w) > -2]
        best = sorted(all_, key=lambda x: (-round(x[0], 12), x[1] is None, x[1] or 0))[:4]
        mine = sorted(have[i])
        assert [r for r, _, _ in mine] == list(range(1, len(best) + 1))
        assert [s for _, _, s in mine] == pytest.approx([s for s, _ in best], abs=1e-12)


def test_recall(spark):
    from pyspark.sql import functions as F
    t = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = t.collect()
    x = np.array([r.embedding for r in rows], np.float64)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    got = {}
    for r in ann.nearest(t, F.col("vec_id") % 50 == 0, k=5, block=700).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = total = 0
    for i, r in enumerate(rows):
        if r.vec_id % 50 == 0:
            s = x @ x[i]
            s[i] = -9
            true = {rows[k].vec_id for k in np.argsort(-s)[:5]}
            hits, total = hits + len(true & got[r.vec_id]), total + 5
    assert hits / total >= 0.93
