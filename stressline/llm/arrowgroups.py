"""Streaming whole groups through mapInArrow without one Python call per group in Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def stream_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables with all rows of one key each; the rows must come sorted by the keys."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            v = t[k].combine_chunks().to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        if held and any(held[-1][k][-1].as_py() != t[k][0].as_py() for k in keys):
            change[0] = True
        cuts = np.flatnonzero(change)
        if not len(cuts):
            held.append(t)
            continue
        if cuts[0] or held:
            yield pa.concat_tables([*held, t.slice(0, cuts[0])])
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            yield t.slice(lo, hi - lo)
        held = [t.slice(cuts[-1])]
    if held:
        yield pa.concat_tables(held)
