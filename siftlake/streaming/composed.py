"""State after a long ordered history, by composing what its stretches do: no key's history is ever in one row or one task.

A step of a history is a function of the state, and functions compose: two neighbouring stretches are one. Rows are dealt by ranges of (key, order) and sorted; a task composes each key's stretch
to one element, in vectorised halvings; what is left is one row for each key and range, composed once more in their order.

Nulls, ties and odd rows: a null key is a key; steps with equal order apply in the order of ``ties``; an empty history gives no row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

Join = Callable[[np.ndarray, np.ndarray], np.ndarray]


def reduced(elements: np.ndarray, join: Join) -> np.ndarray:
    """All elements as one, composed in their order."""
    while len(elements) > 1:
        even = len(elements) // 2 * 2
        halves = join(elements[0:even:2], elements[1:even:2])
        elements = np.concatenate([halves, elements[even:]])
    return elements[0]


def composed(history: DataFrame, key: str, order: str, columns: list[str], element: Callable[[dict[str, pa.Array]], np.ndarray], join: Join) -> DataFrame:
    """key, n (steps), last (the greatest ``order``) and element (array of numbers) for each key.

    ``element`` turns steps' ``columns`` into a matrix, a row for each; ``join(a, b)`` composes rows of two matrices, ``a`` first.
    """
    kind = history.schema[key].dataType
    names = ["_key", "_part", "n", "last", "element"]
    schema = T.StructType([T.StructField(c, t) for c, t in zip(names, (kind, T.LongType(), T.LongType(), T.LongType(), T.ArrayType(T.DoubleType())), strict=True)])

    def rows(found: list[tuple], key_type: pa.DataType) -> dict[str, pa.Array]:
        keys, parts, counts, lasts, elements = zip(*found, strict=True) if found else ((),) * 5
        return dict(zip(names, (pa.array(keys, key_type), pa.array(parts, pa.int64()), pa.array(counts, pa.int64()), pa.array(lasts, pa.int64()), pa.array([x.tolist() for x in elements], pa.list_(pa.float64()))), strict=True))

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, open_key, held = TaskContext.get().partitionId(), None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = np.asarray(batch.column(0).dictionary_encode(null_encoding="encode").indices)
            cuts = [*np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]).tolist(), batch.num_rows]
            matrix = element({c: batch.column(k + 2) for k, c in enumerate(columns)})
            done = []
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                this, now = (batch.column(0)[a].as_py(),), (z - a, batch.column(1)[z - 1].as_py(), reduced(matrix[a:z], join))
                if this == open_key:
                    now = (held[0] + now[0], now[1], join(held[2][None], now[2][None])[0])
                elif open_key is not None:
                    done.append((open_key[0], part, *held))
                open_key, held = this, now
            if done:
                yield pa.RecordBatch.from_pydict(rows(done, batch.column(0).type))
            key_type = batch.column(0).type
        if open_key is not None:
            yield pa.RecordBatch.from_pydict(rows([(open_key[0], part, *held)], key_type))

    def whole(table: pa.Table) -> pa.Table:
        table = table.sort_by("_part")
        elements = np.array(table.column("element").to_pylist(), float)
        last = table.column("last")[table.num_rows - 1].as_py()
        return pa.table(rows([(table.column("_key")[0].as_py(), 0, sum(table.column("n").to_pylist()), last, reduced(elements, join))], table.column("_key").type))

    dealt = history.select(F.col(key).alias("_key"), F.col(order).cast("long").alias("_order"), *columns)
    dealt = dealt.repartitionByRange("_key", "_order", *columns).sortWithinPartitions("_key", "_order", *columns)
    found = dealt.mapInArrow(stretches, schema).groupBy("_key").applyInArrow(whole, schema)
    return found.select(F.col("_key").alias(key), "n", "last", "element")


def then(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Maps of numbered states, one a row: ``first``, and ``second`` from where it leads."""
    return np.take_along_axis(second, first.astype(np.int64), axis=1)


def clamped(first: np.ndarray, second: np.ndarray, lowest: float) -> np.ndarray:
    """Maps x -> min(c, a * x + b) as rows (a, b, c), composed, for x of at least ``lowest``; one that only gives its bound becomes a constant."""
    a, b = second[:, 0] * first[:, 0], second[:, 0] * first[:, 1] + second[:, 1]
    c = np.minimum(second[:, 2], second[:, 0] * first[:, 2] + second[:, 1])
    flat = a * lowest + b >= c
    return np.column_stack([np.where(flat, 0.0, a), np.where(flat, c, b), c])


def counted(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Counts since the last reset, as rows (whether there was one, the count)."""
    reset = second[:, 0] > 0
    return np.column_stack([np.maximum(first[:, 0], second[:, 0]), np.where(reset, second[:, 1], first[:, 1] + second[:, 1])])


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """Rows with their ``number`` in the order, from 1, by ranges: numbers within a range, and how many rows the ranges before it have. Equal rows are numbered in any order."""
    from siftlake.storage import stored

    schema = T.StructType([*rows.schema.fields, T.StructField("_range", T.LongType()), T.StructField("_at", T.LongType())])

    def counted_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part)), pa.array(np.arange(seen, seen + batch.num_rows))], schema.names)
            seen += batch.num_rows

    placed = stored(rows.repartitionByRange(order).sortWithinPartitions(order).mapInArrow(counted_rows, schema), "numbered")
    sizes = placed.groupBy("_range").count()  # a row for each range
    before = F.coalesce(F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.join(sizes.select("_range", before.alias("_before")), "_range").select(*rows.columns, (F.col("_before") + F.col("_at") + 1).alias("number"))
