"""Groups of rows handed to Python without Spark's grouped operators.

In Spark 4.1 a task of ``groupBy().applyInPandas()`` or ``applyInArrow()`` leaves the Arrow buffers
of its writer behind, about 0.1 MB or more by the number of columns, until the executor ends: its
memory grows with the number of tasks. ``mapInArrow`` frees all it takes.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def by_group(df, keys, make, schema):
    """The rows ``make`` returns for the frame of every group of rows alike in ``keys``.

    Rows must have been dealt to tasks by ``keys``. Nulls are a key as any other; an empty table
    has no groups. A group may span batches and is held whole, like those of ``applyInPandas``.
    """
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        held, last = [], None
        for batch in batches:
            made, starts = [], _starts(batch, keys)
            for start, end in zip(starts, [*starts[1:], batch.num_rows]):
                if held and (start or _key(batch, keys, 0) != last):
                    made.append(_made(held, make, kind))
                    held = []
                held.append(batch.slice(start, end - start))
            if starts:
                last = _key(batch, keys, batch.num_rows - 1)
            if made:
                yield from pa.Table.from_batches(made).combine_chunks().to_batches()
        if held:
            yield _made(held, make, kind)

    return df.sortWithinPartitions(*keys).mapInArrow(run, schema)


def _starts(batch, keys):
    """Places of the first row and of every row with other keys than the row before."""
    if not batch.num_rows:
        return []
    other = np.zeros(batch.num_rows, bool)
    other[0] = True
    for name in keys:
        number = batch.column(name).dictionary_encode(null_encoding="encode").indices.to_numpy()
        other[1:] |= number[1:] != number[:-1]
    return np.flatnonzero(other).tolist()


def _key(batch, keys, row):
    return [batch.column(name)[row].as_py() for name in keys]


def _made(held, make, kind):
    return pa.RecordBatch.from_pandas(make(pa.Table.from_batches(held).to_pandas()), kind,
                                      preserve_index=False)
