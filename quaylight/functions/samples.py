"""Samples by hash as matrices, of which the driver holds little more than the sample."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The share of rows that is fetched at first, as a multiple of the share that is asked for.
MARGIN = 1.1


def lowest(df: DataFrame, place: str, rows: int) -> np.ndarray:
    """The other columns, doubles, of the `rows` rows of lowest `place`, a 64-bit hash, in the order of place and the columns.

    Rows that can't be among them stay on the executors: only hashes under a bound are fetched, as Arrow batches. A top-k
    would bring each task's own k rows to the driver.
    """
    n, margin = df.count(), MARGIN
    while True:
        bound = int(margin * rows / max(n, 1) * 2**64) - 2**63
        some = df if bound >= 2**63 or n <= rows else df.where(F.col(place) < bound)
        table = some.toArrow()
        if table.num_rows >= min(n, rows):
            break
        margin *= 2
    values = [table.column(c).to_numpy() for c in table.column_names if c != place]
    order = np.lexsort([*values[::-1], table.column(place).to_numpy()])[:rows]
    return np.column_stack([v[order] for v in values]).astype(float, copy=False)
