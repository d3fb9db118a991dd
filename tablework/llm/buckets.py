"""Buckets whose members are compared within tasks, whatever their size.

A bucket of more than a bounded number of rows is cut into chunks, and every pair of chunks is a group of its own, so that
no task ever holds more than two chunks and a hot bucket is spread over many tasks. Nothing is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a chunk.
CHUNK = 4096


def dealt(rows: DataFrame, keys: list[str], member: str, counted: DataFrame | None = None, size: int = CHUNK) -> DataFrame:
    """rows with chunk, first and second, dealt out and sorted by keys, first and second.

    Rows of a group (keys, first, second) are those of a bucket's chunks first and second; where both are the same, the pairs
    within that chunk are meant, else those between the two. counted: the same buckets as rows, if cheaper to count.
    """
    large = (rows if counted is None else counted).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > size)
    parts = F.coalesce(F.ceil(F.col("_n") / size), F.lit(1)).cast("int")
    chunk = F.pmod(F.xxhash64(member), parts).cast("int")
    each = rows.join(large, keys, "left").withColumn("chunk", chunk).withColumn("_other", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_n")
    each = each.withColumns({"first": F.least("chunk", "_other"), "second": F.greatest("chunk", "_other")}).drop("_other")
    by = [*keys, "first", "second"]
    return each.repartition(*by).sortWithinPartitions(*by)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Tables of whole groups of sorted batches, each with the places where its groups begin, and its end."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        n = table.num_rows
        if not n:
            continue
        new = np.zeros(n - 1, bool)
        for k in keys:
            column = table[k].combine_chunks()
            new |= pc.not_equal(column.slice(0, n - 1), column.slice(1)).to_numpy(zero_copy_only=False)
        at = (np.flatnonzero(new) + 1).tolist()
        if at:
            yield table.slice(0, at[-1]).combine_chunks(), [0, *at]
            held = table.slice(at[-1])
        else:
            held = table
    if held is not None and held.num_rows:
        yield held.combine_chunks(), [0, held.num_rows]
