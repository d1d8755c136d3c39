"""Arrow bridge for kernels over packed rows: one row in, one row out, no shuffle."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def _plain(column: pa.Array):
    """Lists as numpy arrays, other values as they are."""
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        return [None if not v.is_valid else v.values.to_numpy(zero_copy_only=False) for v in column]
    return column.to_pylist()


def map_rows(df: DataFrame, f: Callable[..., tuple], inputs: list[str], keep: list[str], outputs: str) -> DataFrame:
    """Columns ``keep`` and, per row, what ``f(*inputs)`` returns for ``outputs``
    (a DDL list). Rows with a null input give nulls."""
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), outputs])
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    declared = StructType.fromDDL(outputs)
    kinds = [to_arrow_type(x.dataType) for x in declared]

    def run(batches):
        for batch in batches:
            columns = [_plain(batch.column(len(keep) + i)) for i in range(len(inputs))]
            rows = [(None,) * len(kinds) if any(v is None for v in row) else f(*row) for row in zip(*columns)]
            made = []
            for i, kind in enumerate(kinds):
                values = [None if r[i] is None else r[i].ravel() if isinstance(r[i], np.ndarray) else r[i] for r in rows]
                made.append(pa.array(values, kind))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *made], names=[*keep, *declared.names])

    names = [f"in{i}" for i in range(len(inputs))]
    return df.select(*keep, *[df[c].alias(n) for c, n in zip(inputs, names)]).mapInArrow(run, schema)
