"""Numpy helpers for tiles of verified links, used inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of equal keys in sorted batches, several small runs at a time left together.

    Yields tables that hold whole runs only; a run is bounded by the caller's tiling.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cut = 0
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            c = batch.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(change)
        if held and any(
            held[-1].column(k)[held[-1].num_rows - 1].as_py() != batch.column(k)[0].as_py()
            for k in keys
        ):
            yield pa.Table.from_batches(held)
            held = []
        cut = int(starts[-1]) if len(starts) else 0
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def bounds(*keys: np.ndarray) -> np.ndarray:
    """Start of each run of equal keys, and the end."""
    n = len(keys[0])
    change = np.zeros(n, bool)
    change[:1] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(change), n)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node each of 0..n-1 reaches over the links a-b."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            break
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root
