"""Embedding near-dedup by int8 tile products with exact error bounds.

Unit vectors are quantised to int8 with a scale per vector, and the length of
what quantising lost is kept with each.  Vectors are dealt into tiles; a pair of
tiles is one task, whose int8 product gives every cosine up to a bound that
follows from the two lengths (Cauchy-Schwarz).  Only pairs whose bound reaches
the threshold are computed again in double precision from the original vectors.

A task returns what its tiles need and no more: link counts per vector and a
spanning forest of its links, so its output grows with the tile, not with its
square.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklake.llm.common import connected_components, materialize
from ranklake.llm.vectors import matrix, units, usable

#: Vectors in a tile, at most; fewer where that gives each core a pair of tiles.
TILE = 16_384
LEAST_TILE = 1024
#: Rows of a product held at once.
STRIP = 1024
#: Up to so many tiles their centres go to every task, to leave out pairs of
#: tiles that are too far apart; beyond it all pairs of tiles are worked.
CENTRES = 16_384
#: Products of int8 components are summed in float32, exact below 2^24.
CHUNK = (1 << 24) // (127 * 127)
#: Room for the rounding of the double and float32 arithmetic around the bound.
SLACK = 1e-5


def quantise(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, and the length of u - scale * codes for unit rows."""
    scale = np.abs(u).max(axis=1) / 127
    codes = np.rint(u / scale[:, None]).astype(np.int8)
    lost = np.sqrt(((u - scale[:, None] * codes) ** 2).sum(axis=1))
    return codes, scale, lost


def possible(a: tuple, b: tuple, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs whose cosine may reach ``threshold``: with x = x' + e the
    product x.y differs from x'.y' by at most |e_x| + (1 + |e_x|) |e_y|."""
    (qa, sa, ea), (qb, sb, eb) = a, b
    # s_a s_b dot + e_a + (1 + e_a) e_b >= threshold, with the tile's largest e_b
    least = ((threshold - SLACK - ea - (1 + ea) * eb.max()) / sa).astype(np.float32)
    right, sb = qb.astype(np.float32), sb.astype(np.float32)
    out = []
    for top in range(0, len(qa), STRIP):
        left = qa[top:top + STRIP].astype(np.float32)
        dot = left[:, :CHUNK] @ right[:, :CHUNK].T
        for at in range(CHUNK, qa.shape[1], CHUNK):
            dot += left[:, at:at + CHUNK] @ right[:, at:at + CHUNK].T
        dot *= sb
        i, j = np.nonzero(dot >= least[top:top + STRIP, None])
        out.append((i + top, j))
    return np.concatenate([i for i, _ in out]), np.concatenate([j for _, j in out])


def tile_links(left: pd.DataFrame, right: pd.DataFrame, threshold: float, same: bool) -> pd.DataFrame:
    """Of two tiles (id, copies, u: unit vector): per vector the linked vectors
    (copies counted), as rows (id, n); and a spanning forest, as rows (id, to)."""
    ua, ub = matrix(left["u"]), matrix(right["u"])
    i, j = possible(quantise(ua), quantise(ub), threshold)
    if same:
        i, j = i[i < j], j[i < j]
    sure = np.empty(len(i), bool)
    for at in range(0, len(i), 1 << 16):
        p, q = i[at:at + (1 << 16)], j[at:at + (1 << 16)]
        sure[at:at + (1 << 16)] = (ua[p] * ub[q]).sum(axis=1) >= threshold
    i, j = i[sure], j[sure]
    ids_a, ids_b = left["id"].to_numpy(), right["id"].to_numpy()
    ca, cb = left["copies"].to_numpy(), right["copies"].to_numpy()
    na, nb = np.bincount(i, cb[j], len(ids_a)), np.bincount(j, ca[i], len(ids_b))
    counts = pd.DataFrame({"id": np.concatenate([ids_a, ids_b]), "n": np.concatenate([na, nb]).astype(np.int64)})
    counts = counts[counts["n"] > 0].assign(to=None)
    # spanning forest: nodes 0.. of the left tile, then of the right one
    shift = 0 if same else len(ids_a)
    of = np.arange(len(ids_a) + (0 if same else len(ids_b)))

    def root(x: int) -> int:
        while of[x] != x:
            of[x] = of[of[x]]
            x = of[x]
        return x
    tree = []
    for p, q in zip(i.tolist(), (j + shift).tolist(), strict=True):
        a, b = root(p), root(q)
        if a != b:
            of[b] = a
            tree.append((p, q - shift))
    forest = pd.DataFrame({"id": ids_a[[p for p, _ in tree]], "n": 0, "to": ids_b[[q for _, q in tree]]})
    return pd.concat([counts, forest], ignore_index=True).astype({"id": "int64", "n": "int64", "to": "Int64"})


def tiles_of(classes: DataFrame, tile: int, seed: int = 5) -> DataFrame:
    """``classes`` (id, copies, dim, u) with ``tile`` (int): vectors near the
    same of a few sampled pivots share tiles, so that the directions of a tile
    are alike where the data allow it; a tile holds about ``tile`` vectors."""
    n = classes.count()
    cores = classes.sparkSession.sparkContext.defaultParallelism
    tile = min(tile, max(LEAST_TILE, math.ceil(n / math.sqrt(4 * cores))))
    pivots = max(1, min(64, n // tile))
    sample = classes.select("u", "dim").orderBy(F.xxhash64("id")).limit(pivots).collect()
    held = [(r.dim, np.array(r.u)) for r in sample]

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cell = np.zeros(len(b), np.int32)
            for dim, own in b.groupby("dim").indices.items():
                fit = [(k, p) for k, (d, p) in enumerate(held) if d == dim]
                if fit:
                    best = (matrix(b["u"].iloc[own]) @ np.stack([p for _, p in fit]).T).argmax(axis=1)
                    cell[own] = np.array([k for k, _ in fit], np.int32)[best]
            yield b.assign(cell=cell)
    placed = materialize(classes.mapInPandas(nearest, "id long, copies long, dim int, u array<double>, cell int"), "cells")
    # at most pivots x dimensions rows
    sizes = placed.groupBy("dim", "cell").agg(F.count("*").alias("n")).orderBy("dim", "cell").collect()
    first, rows = 0, []
    for r in sizes:
        k = math.ceil(r.n / tile)
        rows.append((r.dim, r.cell, first, k))
        first += k
    spans = classes.sparkSession.createDataFrame(rows, "dim int, cell int, first int, parts int")
    out = placed.join(F.broadcast(spans), ["dim", "cell"])
    part = F.pmod(F.xxhash64(F.lit(seed), "id"), F.col("parts")).cast("int")
    return out.select("id", "copies", "dim", "u", (F.col("first") + part).alias("tile"))


def tile_pairs(tiled: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a <= b: pairs of tiles that may hold a link.  A tile's centre and
    the angle of its farthest vector bound the angle between any two vectors of
    two tiles from below; pairs beyond the threshold's angle are left out."""
    angle = math.acos(max(-1.0, min(1.0, threshold)))

    def summary(p: pd.DataFrame) -> pd.DataFrame:
        u = matrix(p["u"])
        mean = u.mean(axis=0)
        norm = np.sqrt(mean @ mean)
        c = mean / norm if norm > 1e-9 else np.zeros_like(mean)
        r = float(np.arccos(np.clip((u @ c).min(), -1, 1))) if norm > 1e-9 else math.pi
        return pd.DataFrame({"tile": p["tile"].iloc[:1], "dim": p["dim"].iloc[:1], "c": [c], "r": [r]})
    ends = materialize(tiled.groupBy("tile").applyInPandas(summary, "tile int, dim int, c array<double>, r double"), "tiles")
    if ends.count() > CENTRES:
        top = ends.groupBy("dim").agg(F.max("tile").alias("top"))
        return ends.join(top, "dim").select(F.col("tile").alias("a"), F.explode(F.sequence("tile", "top")).alias("b"))
    held = ends.orderBy("tile").toPandas()
    shared = tiled.sparkSession.sparkContext.broadcast(
        (held["tile"].to_numpy(), held["dim"].to_numpy(), held["c"].to_list(), held["r"].to_numpy()))

    def partners(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tiles, dims, cs, rs = shared.value
        groups = {d: np.flatnonzero(dims == d) for d in np.unique(dims)}
        centres = {d: np.stack([cs[k] for k in own]) for d, own in groups.items()}
        for b in batches:
            for t, d, c, r in zip(b["tile"], b["dim"], b["c"], b["r"], strict=True):
                own = groups[d]
                apart = np.arccos(np.clip(centres[d] @ np.asarray(c), -1, 1))
                near = (apart <= angle + r + rs[own] + 1e-6) & (tiles[own] >= t)
                yield pd.DataFrame({"a": np.full(near.sum(), t, np.int32), "b": tiles[own][near]})
    return ends.mapInPandas(partners, "a int, b int")


def near_duplicates(table: DataFrame, threshold: float = 0.95, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``table``
    (vec_id, embedding array of float or double).

    Vectors with equal components are one class and are compared once; copies
    link with each other (a cosine of 1).  Vectors that are null, empty, zero
    or hold a null or non-finite component link with nothing, and so do
    vectors of different lengths with each other.  Rows that repeat a vec_id
    are vectors of their own; component_id is then the smallest vec_id.  A null
    vec_id is never the smallest unless alone.  Further columns are ignored.
    """
    table = table.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = usable(table)
    groups = rows.where("ok").groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))

    def to_units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dim, own in b.groupby(b["embedding"].str.len()).groups.items():
                part = b.loc[own]
                yield pd.DataFrame({"id": part["id"], "least": part["least"], "copies": part["copies"], "dim": np.int32(dim),
                                    "u": list(units(matrix(part["embedding"]))), "embedding": part["embedding"]})
    stored = materialize(groups, "vectors")
    classes = stored.select(F.monotonically_increasing_id().alias("id"), "least", "copies", "embedding")
    classes = materialize(classes.mapInPandas(
        to_units, "id long, least long, copies long, dim int, u array<double>, embedding array<double>"), "classes")
    tiled = materialize(tiles_of(classes.select("id", "copies", "dim", "u"), tile), "tiled")
    pairs = tile_pairs(tiled, threshold)

    # A task holds one pair of tiles: rows of both, told apart by side.
    sides = pairs.select("a", "b", F.explode(F.when(F.col("a") == F.col("b"), F.array(F.lit(0))).otherwise(
        F.array(F.lit(0), F.lit(1)))).alias("side"))
    sides = sides.withColumn("tile", F.when(F.col("side") == 0, F.col("a")).otherwise(F.col("b")))
    work = sides.join(tiled.select("tile", "id", "copies", "u"), "tile").select("a", "b", "side", "id", "copies", "u")

    def run(p: pd.DataFrame) -> pd.DataFrame:
        left = p[p["side"] == 0].sort_values("id")
        same = bool(p["a"].iloc[0] == p["b"].iloc[0])
        right = left if same else p[p["side"] == 1].sort_values("id")
        return tile_links(left, right, threshold, same)
    found = materialize(work.groupBy("a", "b").applyInPandas(run, "id long, n long, to long"), "links")
    counts = found.where("to is null").groupBy("id").agg(F.sum("n").alias("n"))
    comps = connected_components(found.where("to is not null").select(F.col("id").alias("a"), F.col("to").alias("b")))
    info = classes.select("id", "least", "copies", F.col("embedding").alias("_e"))
    info = info.join(counts, "id", "left").join(comps, info.id == comps.v, "left").select(
        "_e", "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "id").alias("c"))
    smallest = info.groupBy("c").agg(F.min("least").alias("first"))
    info = info.join(smallest, "c").select("_e", "n", "first")
    out = rows.join(info, F.col("ok") & (rows.embedding == F.col("_e")), "left")
    comp = F.coalesce("first", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"),
                      F.coalesce(F.col("vec_id") == comp, F.lit(True)).alias("kept"))
