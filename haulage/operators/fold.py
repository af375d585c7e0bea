"""Ordered folds: each row's outcome depends on all rows of its group before it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


def in_order(df: DataFrame, group: str, order: list[str], start: Callable[[], Callable[[dict | None], list[tuple]]], out: str) -> DataFrame:
    """Rows of df by group, each group's in order, streamed through a step of its own; out names the group first.

    start() makes a group's step. It takes the next rows as lists by column, and None at the group's end, and gives the rows
    that are settled, without the group. A group runs in one task, but only what its step holds and one batch are in memory.
    """
    schema = StructType.fromDDL(out)
    rows = df.repartition(group).sortWithinPartitions(group, *order)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        key = step = None

        def made(key, rows: list[tuple]) -> Iterator:
            for i in range(0, len(rows), 10_000):
                part = rows[i : i + 10_000]
                columns = [[key] * len(part), *map(list, zip(*part, strict=True))]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        for batch in batches:
            d = batch.to_pydict()
            keys, a = d.pop(group), 0
            while a < len(keys):
                b = a + 1 if keys[-1] != keys[a] else len(keys)
                while b < len(keys) and keys[b] == keys[a]:
                    b += 1
                if step is None or keys[a] != key:
                    if step is not None:
                        yield from made(key, step(None))
                    key, step = keys[a], start()
                yield from made(key, step({c: v[a:b] for c, v in d.items()}))
                a = b
        if step is not None:
            yield from made(key, step(None))

    return rows.mapInArrow(run, schema)
