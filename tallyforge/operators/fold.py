"""Ordered folds: rows of a key in order through a state, one output row for each input row."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Row = dict[str, Any]


#: The column of ``with_later``.
LATER = "_later"


def with_later(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """``rows`` with how many more of their key come after them. A fold that remembers what came with a key can forget it where none does."""
    return rows.withColumn(LATER, F.row_number().over(Window.partitionBy(*key).orderBy(*(F.desc(c) for c in order))) - 1)


def remember(seen: dict, row: Row, value: Any, key: str = "idempotency_key") -> None:
    """Keeps ``value`` under the row's key as long as the key comes again."""
    if row[LATER]:
        seen[row[key]] = value
    else:
        seen.pop(row[key], None)


def fold(rows: DataFrame, key: list[str], order: list[str], start: Callable[[Row], Any], step: Callable[[Any, Row], tuple[Any, Row]], added: StructType) -> DataFrame:
    """``rows`` with the columns ``added`` that ``step`` gives from the state and the row.

    Rows stream through the task in order and only the state is held. States that
    remember idempotency keys hold those that come again (``with_later``), so a key
    with many rows needs no more memory than one with few. Null keys are a key.
    """
    schema = StructType([*rows.schema.fields, *added.fields])
    target = to_arrow_schema(schema, prefers_large_types=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        state: Any = None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                now = tuple(row[k] for k in key)
                if now != last:
                    last, state = now, start(row)
                state, found = step(state, row)
                out.append(row | found)
            yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in out], f.type) for f in target], schema=target)

    return rows.repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(run, schema)
