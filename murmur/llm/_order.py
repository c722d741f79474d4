"""Places and running sums along an order that the whole cluster sorts, with no key in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmur.llm._common import materialise, ship


def _numbering(key: str, sums: list[str]):
    """Number the rows of each key along a sorted task, and add up the values before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, n, total = None, 0, [0] * len(sums)
        for b in batches:
            if not len(b):
                continue
            keys = b.column(b.schema.get_field_index(key))
            opens = np.ones(len(b), bool)
            opens[1:] = pc.not_equal(keys.slice(1), keys.slice(0, len(b) - 1)).to_numpy(zero_copy_only=False)
            opens[0] = keys[0].as_py() != last
            at = np.arange(len(b))
            start = np.maximum.accumulate(np.where(opens, at, 0))
            carried = np.cumsum(opens) == 0  # rows of the key that the batch before ended with
            columns = [*b.columns, pa.array(np.full(len(b), part, np.int32)), pa.array(at - start + np.where(carried, n, 0))]
            for i, s in enumerate(sums):
                v = b.column(b.schema.get_field_index(s)).to_numpy(zero_copy_only=False).astype(np.int64)
                ahead = np.cumsum(v) - v
                before = ahead - ahead[start] + np.where(carried, total[i], 0)
                columns.append(pa.array(before))
                total[i] = int(before[-1] + v[-1])
            n, last = int(columns[len(b.columns) + 1][-1].as_py()) + 1, keys[-1].as_py()
            yield pa.RecordBatch.from_arrays(columns, [*b.schema.names, "part_", "place_", *[f"before_{s}" for s in sums]])

    return run


def ranked(df: DataFrame, key: str, order: list[str], sums: list[str] | None = None, *, name: str = "ranked") -> DataFrame:
    """df with ``place``, the row's number from 0 within its key by the order (nulls first), and ``before_<s>``, the sum of s
    over the rows before it.

    Rows are dealt by ranges of (key, order) and sorted, so a key of any size is spread over tasks; a task numbers its own
    rows, and what the tasks before hold of the key that a task begins with, one row a task, is added by a broadcast.
    df is written first, so it should be narrow.  The key is without nulls; summed columns are longs without nulls; rows
    that tie in the whole order come in any sequence.  An empty df gives an empty result.
    """
    sums = sums or []
    ship(df.sparkSession)
    df = materialise(df, name)
    by = [key, *order]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema], "part_ int, place_ long", *[f"before_{s} long" for s in sums]])
    rows = materialise(df.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_numbering(key, sums), schema), name)
    ends = F.max(F.struct(F.col(key).alias("k"), F.col("place_").alias("p"), *[(F.col(f"before_{s}") + F.col(s)).alias(s) for s in sums]))
    tasks = rows.groupBy("part_").agg(F.min(key).alias("first"), ends.alias("e"))
    opens = tasks.select("part_", F.col("first").alias(key), F.lit(True).alias("opens"), F.lit(0).cast("long").alias("n"), *[F.lit(0).cast("long").alias(s) for s in sums])
    closes = tasks.select("part_", F.col("e.k").alias(key), F.lit(False).alias("opens"), (F.col("e.p") + 1).alias("n"), *[F.col(f"e.{s}") for s in sums])
    earlier = Window.partitionBy(key).orderBy("part_").rangeBetween(Window.unboundedPreceding, -1)  # two rows a task at most
    held = opens.union(closes).select("part_", key, "opens", F.sum("n").over(earlier).alias("n_"), *[F.sum(s).over(earlier).alias(f"{s}_") for s in sums])
    held = held.where("opens AND n_ > 0").drop("opens")
    out = rows.join(F.broadcast(held), ["part_", key], "left")
    place = (F.col("place_") + F.coalesce("n_", F.lit(0))).alias("place")
    return out.select(*[F.col(f"`{c}`") for c in df.columns], place, *[(F.col(f"before_{s}") + F.coalesce(F.col(f"{s}_"), F.lit(0))).alias(f"before_{s}") for s in sums])
