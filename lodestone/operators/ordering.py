"""Places in an order over whole tables, without bringing a group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut

#: monotonically_increasing_id is the task's number and, in this many bits below it, the row's in the task.
ROW_BITS = 33


def numbered(rows: DataFrame, by: tuple[str, ...], *order: Column | str) -> DataFrame:
    """rows with `place`, from 1 without gaps in the order within each group of `by`.

    Ranges of the order are sorted apart, by many tasks however large a group is; where a range's places
    begin follows from the sizes of those before it, one row for each range and group. Rows equal in the
    order come one after the other, in no stated order. Null is a group like any other; an empty table
    gives an empty one.
    """
    ranges = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    ranges = cut(ranges.withColumn("__id", F.monotonically_increasing_id()))
    ranges = ranges.withColumn("__range", F.shiftright("__id", ROW_BITS))
    before = F.sum("__n").over(Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    key = [*by, "__range"]
    begins = ranges.groupBy(*key).agg(F.count("*").alias("__n"), F.min("__id").alias("__first"))
    begins = begins.select(*[F.col(c).alias(f"__{i}") for i, c in enumerate(key)], (F.coalesce(before, F.lit(0)) - F.col("__first") + 1).alias("__shift"))
    same = [F.col(c).eqNullSafe(F.col(f"__{i}")) for i, c in enumerate(key)]
    return ranges.join(begins, same).select(*rows.columns, (F.col("__id") + F.col("__shift")).alias("place"))
