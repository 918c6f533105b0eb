"""Recurrences that no window function has: one pass over each key's rows in order, with bounded state.

Keys are dealt to tasks, a task's rows are sorted, and Arrow batches of them stream through Python. Neither a key's rows
nor its results are ever held as a whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

#: Rows of results that leave a task together.
ROWS = 10_000


def recurrence(df: DataFrame, key: str, order: str, columns: list[str], out: str, fold: Callable[[], tuple[Callable, Callable]]) -> DataFrame:
    """(key, ``out`` (DDL)): ``fold()`` gives, for each key anew, ``step(order, *columns)`` and ``end()``, both of which
    return rows of ``out``. Rows with equal order come by ``columns``."""
    made = _parse_datatype_string(out)
    schema = StructType([StructField(key, df.schema[key].dataType), *made.fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        now, step, end = None, None, None

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)
            rows.clear()
            return made

        for b in batches:
            for k, *values in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if step is None or k != now:
                    if end:
                        rows += [(now, *r) for r in end()]
                    now, (step, end) = k, fold()
                rows += [(k, *r) for r in step(*values)]
                if len(rows) >= ROWS:
                    yield batch()
        if end:
            rows += [(now, *r) for r in end()]
        if rows:
            yield batch()

    dealt = df.select(key, order, *columns).repartition(key).sortWithinPartitions(key, order, *columns)
    return dealt.mapInArrow(run, schema)
