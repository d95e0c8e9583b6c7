"""Runs of equal keys in sorted Arrow batches, without holding more than one open run."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def sorted_runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows whose first ``n_keys`` integer columns are sorted -> tables of whole runs, with the
    position where each run begins (and the end)."""
    held: pa.Table | None = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]) if held is not None else table
        begins = _begins(table, n_keys)
        if len(begins) > 1:
            yield table.slice(0, int(begins[-1])), begins
        held = table.slice(int(begins[-1]))
    if held is not None:
        yield held, np.array([0, held.num_rows])


def _begins(table: pa.Table, n_keys: int) -> np.ndarray:
    changed = np.zeros(table.num_rows, dtype=bool)
    changed[0] = True
    for c in range(n_keys):
        key = table.column(c).to_numpy()
        changed[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(changed)
