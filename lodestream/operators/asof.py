"""As-of join: for each row, the last value before it in its key's order.

A window over the key would give a hot key to one task. Here rows are dealt by
ranges of (key, order), so a key may lie in many tasks; each task carries the
last value along its rows, and what a key's last task knew is handed to the
next ones by a table of two rows a task.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from lodestream.sources.shared import materialise

FIRST, LAST, OPEN = 1, 2, 4  # of a task's rows: the first, the last, those before any value of the task's first key


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each row but the first differs from the one before; nulls are alike."""
    a, b = column[:-1], column[1:]
    differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
    return differ | (pc.is_null(a).to_numpy(zero_copy_only=False) != pc.is_null(b).to_numpy(zero_copy_only=False))


def _carry(keys: list[str], value: str):
    def run(batches):
        part, key, carried, opening, held = TaskContext.get().partitionId(), None, None, True, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            starts = np.zeros(n, bool)
            for k in keys:
                starts[1:] |= _changes(batch.column(k))
            now = tuple(batch.column(k)[0].as_py() for k in keys)
            flags = np.zeros(n, np.int32)
            if key is None:
                flags[0] = FIRST
            else:
                starts[0] = now != key
                if starts[0]:
                    carried, opening = None, False
            column = batch.column(value)
            known = pc.is_valid(column).to_numpy(zero_copy_only=False)
            values = pc.fill_null(column, 0).to_numpy(zero_copy_only=False)
            at = np.arange(n)
            begun = np.maximum.accumulate(np.where(starts, at, 0))  # where the row's key begins in the batch
            last = np.maximum.accumulate(np.where(known, at, -1))
            own = last >= begun
            filled = np.where(own, values[np.maximum(last, 0)], 0)
            led = np.cumsum(starts) == 0 if not starts[0] else np.zeros(n, bool)  # rows that go on with the key before
            if carried is not None:
                filled = np.where(led & ~own, carried, filled)
                own = own | led
            if opening:
                flags[led & ~own] |= OPEN
                opening = not starts.any()
            key = tuple(batch.column(k)[n - 1].as_py() for k in keys)
            carried = int(filled[-1]) if own[-1] else None
            arrays = [*batch.columns, pa.array(filled, pa.int64(), mask=~own), pa.array(np.full(n, part, np.int32))]
            if held:
                yield pa.record_batch([*held[0], pa.array(held[1])], [*batch.schema.names, "__carried", "__part", "__flags"])
            held = (arrays, flags, batch.schema.names)
        if held:
            held[1][-1] |= LAST
            yield pa.record_batch([*held[0], pa.array(held[1])], [*held[2], "__carried", "__part", "__flags"])

    return run


def carry_last(rows: DataFrame, keys: list[str], order: list[Column], value: str, name: str) -> DataFrame:
    """Adds ``name``: the last value of the bigint column ``value`` that isn't null, at or before the row in its key's ``order``.

    Of rows equal in key and order, those with a value come first. Null keys
    are a key of their own. Null where there is no value yet. ``rows`` is read
    twice (its ranges are sampled first), so it should be cheap or written.
    """
    columns = rows.columns
    dealt = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order, F.col(value).asc_nulls_last())
    out = StructType(rows.schema.fields[:]).add("__carried", LongType()).add("__part", IntegerType()).add("__flags", IntegerType())
    table = materialise(dealt.mapInArrow(_carry(keys, value), out), "carried")
    edge = lambda bit, v, rank: table.where(F.col("__flags").bitwiseAND(F.lit(bit)) != 0).select(*keys, "__part", v.alias("__v"), F.lit(rank).alias("__end"))
    edges = edge(FIRST, F.lit(None).cast("bigint"), 0).unionByName(edge(LAST, F.col("__carried"), 1))
    before = F.last("__v", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("__part", "__end"))
    brought = edges.select("__part", "__end", before.alias("__brought")).where("__end = 0 and __brought is not null").select("__part", "__brought")
    found = F.when(F.col("__flags").bitwiseAND(F.lit(OPEN)) != 0, F.col("__brought")).otherwise(F.col("__carried"))
    # a row a task at most
    return table.join(F.broadcast(brought), "__part", "left").select(*columns, found.alias(name))
