"""Arrow batches of bounded bytes, and long byte strings cut into overlapping windows, for the operators that run numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from ..functions.arrow import BYTES, ROWS, bounded_batches

def groups(texts: list[bytes], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about most bytes together, one text at least."""
    start, total = 0, 0
    for i, t in enumerate(texts):
        if i > start and total + len(t) > most:
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)


def segment_sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of rows; a run of length 0 sums to 0."""
    ends = np.cumsum(lengths)
    total = np.zeros((len(values) + 1, *values.shape[1:]))
    np.cumsum(values, axis=0, dtype=np.float64, out=total[1:])
    return total[ends] - total[ends - lengths]


__all__ = ["BYTES", "ROWS", "bounded_batches", "groups", "segment_sums"]
