"""Ordered passes over the rows of a group, for operators whose next step depends on what they have decided before."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows sent on at a time.
BATCH = 10_000


def fold_groups(df: DataFrame, keys: list[str], order: list[str], step: Callable[[list[tuple]], Iterable[tuple]], added: str, batch: int = BATCH) -> DataFrame:
    """keys and the columns `added` (DDL): for each group, what step makes of its rows (without keys, in order).

    Groups are pages or documents' baselines: what one page holds. They are dealt by key and sorted by Spark, and pass
    through a task one at a time.
    """
    schema = T.StructType([*[df.schema[k] for k in keys], *T.StructType.fromDDL(added).fields])
    kinds = to_arrow_schema(schema)
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key: tuple | None = None
        out: list[tuple] = []
        for given in batches:
            for row in zip(*(c.to_pylist() for c in given.columns), strict=True):
                if row[:n] != key:
                    if held:
                        out.extend((*key, *r) for r in step(held))
                    key, held = row[:n], []
                    while len(out) >= batch:
                        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out[:batch]], f.type) for k, f in enumerate(kinds)], schema=kinds)
                        del out[:batch]
                held.append(row[n:])
        if held:
            out.extend((*key, *r) for r in step(held))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(kinds)], schema=kinds)

    rest = [c for c in df.columns if c not in keys]
    return df.select(*keys, *rest).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
