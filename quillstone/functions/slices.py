"""Arrow batches worked off in small slices, so that a Python worker's memory follows the slice and not the batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows of a slice, and bytes of its text or words, at most; a single larger row is a slice of its own.
ROWS, BYTES = 512, 1 << 20


def sizes(column: pa.Array) -> np.ndarray:
    """Bytes of a text, or elements of a list; null has none."""
    length = pc.binary_length(column) if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else pc.list_value_length(column)
    return length.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def cuts(size: np.ndarray, rows: int = ROWS, most: int = BYTES) -> Iterator[tuple[int, int]]:
    """start, end of runs that hold ``rows`` rows and a sum of ``most`` at most."""
    ends = np.cumsum(size)
    at = 0
    while at < len(size):
        before = ends[at - 1] if at else 0
        end = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + most, side="right"))))
        yield at, end
        at = end


def in_slices(work: Callable[[pa.RecordBatch], pa.RecordBatch], by: str, rows: int = ROWS, most: int = BYTES) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow: ``work`` on slices of each batch, measured by the column ``by``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end in cuts(sizes(batch.column(by)), rows, most):
                yield work(batch.slice(at, end - at))

    return run


def rows_of(batch: pa.RecordBatch, names: list[str], found: list[list], kind: pa.StructType) -> pa.RecordBatch:
    """The named columns of a row again for each of its results, beside the fields of these."""
    index = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]), pa.int64())
    out = pa.array([y for x in found for y in x], kind)
    return pa.RecordBatch.from_arrays([*[batch.column(n).take(index) for n in names], *out.flatten()], names=[*names, *[f.name for f in kind]])
