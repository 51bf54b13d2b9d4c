"""Rules that depend on what was kept before, as one pass over sorted series."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: (state, columns by name, whether the series ends) to (places kept, rows settled, state). The state starts as None.
Kernel = Callable[[object, dict[str, np.ndarray], bool], tuple[np.ndarray, int, object]]


def scanned(df: DataFrame, by: Sequence[str], order: Sequence[str], kernel: Kernel) -> DataFrame:
    """The rows of df that the kernel keeps. Series are sorted by Spark, which spills; a task holds an Arrow batch, the
    state, and the rows that the kernel can't settle yet."""
    by, values = list(by), [c for c in df.columns if c not in by]

    def some(table: pa.Table, state: object, last: bool) -> tuple[pa.Table, pa.Table, object]:
        """What is kept, the rows of the last series that are still open (one at least), and its state."""
        new = np.zeros(table.num_rows, bool)
        new[0] = True
        for name in by:
            codes = table[name].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            new[1:] |= codes[1:] != codes[:-1]
        first = np.flatnonzero(new).tolist()
        columns, kept, open_from = {c: table[c].to_numpy() for c in values}, [], table.num_rows
        for a, b in zip(first, [*first[1:], table.num_rows], strict=True):
            ends = last or b < table.num_rows
            places, settled, now = kernel(state, {c: x[a : b if ends else b - 1] for c, x in columns.items()}, ends)
            kept.append(places + a)
            state, open_from = (None, table.num_rows) if ends else (now, a + settled)
        return table.take(pa.array(np.concatenate(kept))), table.slice(open_from), state

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, state = None, None
        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch])
                done, open_, state = some(table if open_ is None else pa.concat_tables([open_, table]), state, False)
                yield from done.to_batches()
        if open_ is not None:
            yield from some(open_, state, True)[0].to_batches()

    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, df.schema)


def spaced(at: np.ndarray, moved: np.ndarray, gap: int, last: int | None) -> tuple[np.ndarray, int | None]:
    """Places of the samples at least `gap` behind the last kept one, which counts from where it was moved to."""
    kept, k = [], 0
    while k < len(at):
        if last is not None:
            k = k + int(np.searchsorted(at[k:], last + gap))
            if k >= len(at):
                break
        kept.append(k)
        last, k = int(moved[k]), k + 1
    return np.array(kept, np.int64), last


def tallest(at: np.ndarray, height: np.ndarray, distance: int) -> np.ndarray:
    """Places of the samples that stay if the tallest (then earliest) goes first and removes all at most `distance` away."""
    order, open_ = np.lexsort((at, -height)), np.ones(len(at), bool)
    low, high = np.searchsorted(at, at - distance), np.searchsorted(at, at + distance, side="right")
    kept = []
    for k in order.tolist():
        if open_[k]:
            kept.append(k)
            open_[low[k] : high[k]] = False
    return np.sort(np.array(kept, np.int64))
