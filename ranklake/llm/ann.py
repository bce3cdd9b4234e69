"""Nearest neighbours by collision-counting hashing.

Every vector is projected on random lines (orthogonal in blocks); the values of
a line are kept in one sorted array.  A query opens a window around its own
value on every line and counts, for every vector, the lines on which it falls
inside.  The windows widen step by step (virtual rehashing: a wider bucket is
the union of narrower ones, nothing is hashed again).  Vectors whose count
reaches the collision threshold are verified with the exact cosine.  A query
ends once the windows are so wide that a vector as near as its k-th would have
reached the threshold.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ranklake.llm.common import materialize
from ranklake.llm.vectors import lengths, matrix, scaled, usable

LINES = 64
#: Share of the lines on which a vector must collide to be verified.
COLLISIONS = 0.79
#: Half widths of the windows, in units of a distance's spread on a line (the
#: distance between unit vectors / sqrt(dimensions)).
WIDTHS = (0.4, 1.5, 1.65, 1.8, 2.0, 2.4, 3.0, 4.0, 8.0)
#: A window of this many distances holds a vector on well over COLLISIONS of
#: the lines (a normal deviate is below 1.42 in size with probability 0.84).
SURE = 1.42
BLOCK = 16_384
QUERY_BLOCK = 512


def random_lines(dim: int, seed: int, count: int = LINES) -> np.ndarray:
    rng = np.random.default_rng((seed, dim))
    sets = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(math.ceil(count / dim))]
    return np.concatenate(sets)[:count]


class SortedLines:
    """The index of one block of vectors: a sorted array per line."""

    def __init__(self, x: np.ndarray, lines: np.ndarray):
        self.x = scaled(x)
        self.norm = lengths(self.x)
        self.lines = lines
        values = np.ascontiguousarray((self.x / self.norm[:, None] @ lines.T).T)
        self.order = np.argsort(values, axis=1, kind="stable")
        self.values = np.take_along_axis(values, self.order, axis=1)

    def _window(self, at: np.ndarray, half: float) -> tuple[list[int], list[int]]:
        left = [int(np.searchsorted(v, a - half, "left")) for v, a in zip(self.values, at, strict=True)]
        right = [int(np.searchsorted(v, a + half, "right")) for v, a in zip(self.values, at, strict=True)]
        return left, right

    def _count(self, parts: list[np.ndarray]) -> np.ndarray:
        return np.bincount(np.concatenate(parts), minlength=len(self.x))

    def search(self, q: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Verified rows (all but ``skip``) and their cosines with q; the k
        nearest that the method finds are among them."""
        n, m = self.x.shape[0], len(self.lines)
        q = scaled(q[None, :])[0]
        length = float(np.sqrt((q * q).sum()))
        at = self.lines @ (q / length)
        need = math.ceil(COLLISIONS * m)
        counts = np.zeros(n, np.int64)
        lo = hi = None
        seen = np.zeros(n, bool)
        cos = np.full(n, -np.inf)
        if skip >= 0:
            seen[skip] = True
        for width in WIDTHS:
            left, right = self._window(at, width / math.sqrt(len(q)))
            inside = sum(right) - sum(left)
            if lo is not None and inside - (sum(hi) - sum(lo)) <= n * m - inside:
                counts += self._count([self.order[i, left[i]:lo[i]] for i in range(m)] + [self.order[i, hi[i]:right[i]] for i in range(m)])
            elif 2 * inside <= n * m:
                counts = self._count([self.order[i, left[i]:right[i]] for i in range(m)])
            else:  # a wide window: count what is outside
                counts = m - self._count([self.order[i, :left[i]] for i in range(m)] + [self.order[i, right[i]:] for i in range(m)])
            lo, hi = left, right
            todo = np.flatnonzero((counts >= need) & ~seen)
            cos[todo] = (self.x[todo] * q).sum(axis=1) / (self.norm[todo] * length)
            seen[todo] = True
            found = np.flatnonzero(np.isfinite(cos))
            if seen.all():
                break
            if len(found) >= k:
                kth = np.partition(cos[found], len(found) - k)[len(found) - k]
                if width >= SURE * math.sqrt(max(0.0, 2 - 2 * kth)):
                    break
        return found, cos[found]


def nearest(table: DataFrame, queries, k: int = 5, block: int = BLOCK, query_block: int = QUERY_BLOCK, seed: int = 7) -> DataFrame:
    """The ``k`` nearest rows of every query row of ``table`` (vec_id,
    embedding): query_id, rank, vec_id, score.

    ``queries`` is a condition on vec_id; a query's candidates are all rows but
    itself.  Every row is in the index: the table is dealt into blocks of about
    ``block`` rows, every block is searched for every block of queries, and a
    query's finds are merged.  A null condition is no query.  Vectors that are
    null, empty, zero or hold a null or non-finite component take no part, as
    query or candidate; vectors of different lengths never meet.  Ties go to
    the smaller vec_id (null last); rows that share a vec_id are rows of their
    own.  Fewer candidates than k: all of them.
    """
    rows = usable(table.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding")))
    stored = materialize(rows.where("ok").select(F.col("vec_id"), "embedding", F.coalesce(queries, F.lit(False)).alias("asks")), "ann-rows")
    stored = stored.withColumn("row", F.monotonically_increasing_id())
    head = stored.agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).first()
    blocks, asked = max(1, math.ceil(head.n / block)), max(1, math.ceil(head.q / query_block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dim = F.size("embedding").alias("dim")
    deal = lambda n, s: F.pmod(F.xxhash64(F.lit(s), "row"), F.lit(n)).cast("int")
    base = stored.select(dim, deal(blocks, 1).alias("block"), every(asked).alias("part"), "row", "vec_id", "embedding", F.lit(False).alias("asks"))
    asks = stored.where("asks").select(dim, every(blocks).alias("block"), deal(asked, 2).alias("part"), "row", "vec_id", "embedding", F.lit(True).alias("asks"))

    def search(p: pd.DataFrame) -> pd.DataFrame:
        held, qs = p[~p["asks"]].sort_values("row"), p[p["asks"]].sort_values("row")
        out = []
        if len(held) and len(qs):
            index = SortedLines(matrix(held["embedding"]), random_lines(int(p["dim"].iloc[0]), seed))
            ids = held["vec_id"].astype("Int64")
            order = ids.fillna(np.iinfo(np.int64).max).to_numpy(np.int64)
            place = {r: i for i, r in enumerate(held["row"])}
            for row, vec, x in zip(qs["row"], qs["vec_id"], qs["embedding"], strict=True):
                got, cos = index.search(np.asarray(x, np.float64), k, place.get(row, -1))
                best = np.lexsort((order[got], -cos))[:k]
                out.append(pd.DataFrame({"row": row, "query_id": vec, "vec_id": ids.iloc[got[best]].to_numpy(), "score": cos[best]}))
        names = ["row", "query_id", "vec_id", "score"]
        found = pd.concat(out, ignore_index=True) if out else pd.DataFrame({c: [] for c in names})
        return found.astype({"row": "int64", "query_id": "int64", "vec_id": "Int64", "score": "float64"})
    found = base.unionByName(asks).groupBy("dim", "block", "part").applyInPandas(
        search, "row long, query_id long, vec_id long, score double")
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
