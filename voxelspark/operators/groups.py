"""Whole groups of many rows or few, several at a time, for kernels in Python workers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa


def whole(batches: Iterator[pa.RecordBatch], keys: Sequence[int]) -> Iterator[pa.Table]:
    """The rows of a partition sorted by these columns, in tables that cut no group: some batch's worth of groups, or one group that is larger.

    A worker is called once for each group by Spark's own grouped functions, which takes a millisecond a group and far longer than a small group's work.
    """
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        at = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        if len(at) or (last is not None and last != tuple(c[0] for c in columns)):
            begin = int(at[-1]) if len(at) else 0
            held.append(batch.slice(0, begin))
            yield pa.Table.from_batches(held)
            held, batch = [], batch.slice(begin)
        held.append(batch)
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)
