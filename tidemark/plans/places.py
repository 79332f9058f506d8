"""Places in an order of all rows, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cut import cut


def with_places(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds each row's place from 0 in an order, as bigint; rows that are alike by it follow each other in any way.

    Rows are dealt out by ranges and sorted there.  A row's place is its own
    within its range after what the ranges before have; of those sizes, one for
    each partition, the sums come to the driver.
    """
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id())
    rows = cut(sorted_rows)  # places hold once ranges are settled
    # The id is the partition's number and, in the lower 33 bits, the row's within it.
    part = F.shiftright(name, 33)
    sizes = sorted((r.part, r.n) for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before, total = [], 0
    for k, n in sizes:
        before.append((k, total))
        total += n
    offsets = F.broadcast(df.sparkSession.createDataFrame(before, "__part long, __before long"))
    placed = rows.join(offsets, part == F.col("__part")).withColumn(name, F.col("__before") + (F.col(name) - F.shiftleft("__part", 33)))
    return placed.drop("__part", "__before")
