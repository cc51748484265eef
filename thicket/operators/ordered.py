"""Documents that stream through a task one behind another, each whole and in order: what Arrow functions over trees take."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def in_order(rows: DataFrame, *keys: str) -> DataFrame:
    """rows, those of one key together and by ``pre``.

    A window puts them so, and shuffles nothing where they lie together already; its numbers
    all pass, and go no further.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("pre"))
    return rows.withColumn("place_", place).filter("place_ > 0").drop("place_")


def starts(table: pa.Table, keys: tuple[str, ...]) -> np.ndarray:
    """The first rows of documents."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in keys:
        x = table.column(k).combine_chunks()
        new[1:] |= pc.fill_null(pc.not_equal(x[1:], x[:-1]), False).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def whole(batches, *keys: str):
    """Tables of whole documents: a task holds one of them and a batch."""
    held: list[pa.RecordBatch] = []  # of the document that isn't complete
    same = lambda a, i, b, k: all(a.column(c)[i].as_py() == b.column(c)[k].as_py() for c in keys)
    for b in batches:
        if not b.num_rows:
            continue
        if held and not same(held[-1], 0, b, 0):
            yield pa.Table.from_batches(held)
            held = []
        last = int(starts(pa.Table.from_batches([b]), keys)[-1])
        if last:
            yield pa.Table.from_batches([*held, b.slice(0, last)])
            held = []
        held.append(b.slice(last))
    if held:
        yield pa.Table.from_batches(held)
