"""Which documents hold a term of a range, for all ranges of a clause table at once.

The distinct bounds of an index, in order, cut its terms into cells: cell 2k + 1
holds the k-th bound itself, cell 2k the terms before it and behind the one
before. A range is a run of cells. A document's terms are placed in the cells once
(by bisection, each distinct term of a batch once); how many of its terms lie up to
a cell then tells every range by one comparison, whatever the number of terms.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Cells of documents that are counted at once.
CELLS = 8_000_000

#: index_name, lower, upper, inclusive, number
Range = tuple[str, str, str, bool, int]


def _runs(ranges: list[Range]) -> dict[str, tuple[list[str], np.ndarray]]:
    """Per index its bounds and the (first cell, last cell, number) of its ranges
    that can hold a term."""
    out = {}
    is_open = lambda x: x in ("", "*")
    # a range with a null in it holds no term
    ranges = [r for r in ranges if None not in r]
    for name in {r[0] for r in ranges}:
        mine = [r for r in ranges if r[0] == name]
        bounds = sorted({x for r in mine for x in r[1:3] if not is_open(x)})
        place = {x: 2 * k + 1 for k, x in enumerate(bounds)}
        runs = [(0 if is_open(lo) else place[lo] + (not inclusive), 2 * len(bounds) if is_open(up) else place[up] - (not inclusive), no)
                for _, lo, up, inclusive, no in mine]
        out[name] = bounds, np.array([r for r in runs if r[0] <= r[1]], np.int64).reshape(-1, 3)
    return out


def held_ranges(ranges: list[Range]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of batches (doc_id, index_name, terms), a row per document,
    that gives (doc_id, form): the numbers of the ranges with a term of it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _runs(ranges)
        for batch in batches:
            for name in pc.unique(batch.column("index_name")).to_pylist():
                bounds, runs = of.get(name, ([], np.zeros((0, 3), np.int64)))
                if len(runs):
                    yield from _held(batch.filter(pc.equal(batch.column("index_name"), pa.scalar(name))), bounds, runs)
    return run


def _held(docs: pa.RecordBatch, bounds: list[str], runs: np.ndarray) -> Iterator[pa.RecordBatch]:
    lists = docs.column("terms")
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    cell_of = []
    for term in coded.dictionary.to_pylist():
        k = bisect_left(bounds, term)
        cell_of.append(2 * k + (k < len(bounds) and bounds[k] == term))
    cell = np.array(cell_of, np.int64)[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
    n_cells, ends = 2 * len(bounds) + 1, np.r_[0, np.cumsum(sizes)]
    step = max(1, CELLS // (n_cells + len(runs)))
    for a in range(0, docs.num_rows, step):
        n = min(step, docs.num_rows - a)
        doc = np.repeat(np.arange(n), sizes[a:a + n])
        up_to = np.zeros((n, n_cells + 1), np.int32)
        up_to[doc, cell[ends[a]:ends[a + n]] + 1] = 1
        np.cumsum(up_to, axis=1, out=up_to)
        row, run = np.nonzero(up_to[:, runs[:, 1] + 1] > up_to[:, runs[:, 0]])
        yield pa.RecordBatch.from_arrays([docs.column("doc_id").take(pa.array(row + a)), pa.array(runs[run, 2])], ["doc_id", "form"])
