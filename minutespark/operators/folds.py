"""Folds over the ordered rows of each key, batch by batch, with a state of constant size."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows that go out together.
OUT_ROWS = 5000
#: Bytes of text that are dealt to a task.
PART_BYTES = 16 << 20


def parts_for(rows: DataFrame, *texts: str) -> int:
    """So many parts that a task has about ``PART_BYTES`` of the columns ``texts``, whatever the input's size; the session's number at least."""
    held = rows.agg(*(F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c in texts)).first()
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-sum(held) // PART_BYTES))


def fold_in_order(rows: DataFrame, key: str, order: list[Column | str], machine: Callable[[], object], schema: StructType, parts: int | None = None) -> DataFrame:
    """Rows of ``schema`` from a machine for each key. ``machine()`` makes a new one; its ``step(row)`` takes a row (a dict) and
    its ``finish()`` ends the key, both give rows (tuples). Keys are dealt out once and sorted, so neither a key nor its
    results are ever held whole; one key's rows go through one task, in order. A key may be null. ``parts``: tasks (by default as the session has it)."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, own, out = None, None, []

        def batch(found: list[tuple]) -> pa.RecordBatch:
            columns = zip(*found, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        def take(found: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
            out.extend(found)
            if len(out) >= OUT_ROWS:
                yield batch(out)
                out.clear()

        for b in batches:
            for row in b.to_pylist():
                if own is None or row[key] != current:
                    if own is not None:
                        yield from take(own.finish())
                    current, own = row[key], machine()
                yield from take(own.step(row))
        if own is not None:
            out.extend(own.finish())
        if out:
            yield batch(out)

    dealt = rows.repartition(parts, key) if parts else rows.repartition(key)
    return dealt.sortWithinPartitions(F.col(key), *order).mapInArrow(run, schema)
