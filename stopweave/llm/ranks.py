"""Numbers and running sums in an order that no single task sees whole.

Rows are range-partitioned by their keys and order, sorted inside the partitions and put down with their place. What is
summed over all partitions is a row for each (keys, partition), so neither a hot key nor a single global order meets in
one task. Rows that agree in keys and order are split between partitions like others as long as ``order`` ends in a
column that tells them apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stopweave.llm.common import stage

_PLACE, _PART, _FIRST, _BEFORE = "__sw_place", "__sw_part", "__sw_first", "__sw_before"


def running(df: DataFrame, keys: list[str], order: list[Column], name: str, value: str | None = None, few_keys: bool = False) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows of the same keys that come before in the order.

    Without ``value`` rows are counted, so ``name`` numbers them from 0 without gaps. Keys must not be null. With
    ``few_keys`` the sums of the partitions are broadcast: at most one row for each partition and key, so the caller
    vouches for a bounded number of keys.
    """
    by = [*map(F.col, keys), *order]
    placed = stage(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(_PLACE, F.monotonically_increasing_id()))
    placed = placed.withColumn(_PART, F.shiftright(_PLACE, 33))
    step = F.count("*") if value is None else F.sum(value)
    sums = placed.groupBy(*keys, _PART).agg(F.min(_PLACE).alias(_FIRST), step.alias("__sw_sum"))
    earlier = Window.partitionBy(*keys).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn(_BEFORE, F.coalesce(F.sum("__sw_sum").over(earlier), F.lit(0))).drop("__sw_sum")
    out = placed.join(F.broadcast(sums) if few_keys else sums, [*keys, _PART])
    if value is None:
        own = F.col(_PLACE) - F.col(_FIRST)
    else:
        own = F.coalesce(F.sum(value).over(Window.partitionBy(*keys, _PART).orderBy(_PLACE).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return out.withColumn(name, F.col(_BEFORE) + own).select(*df.columns, name)
