"""Numbers in the order of keys, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import cut


def ordered(df: DataFrame, *keys: str, name: str = "at") -> DataFrame:
    """Numbers that follow the order of keys, with gaps; rows are dealt by range, so no task has more than its share."""
    return cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(name, F.monotonically_increasing_id()))


def ranked(df: DataFrame, *keys: str, name: str = "rank") -> DataFrame:
    """Numbers from 0 without gaps in the order of keys; the driver holds a number for each partition."""
    placed = ordered(df, *keys, name="__at")
    part = F.shiftright("__at", 33)
    sizes = sorted((r.p, r.n) for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    base, total = [], 0
    for p, n in sizes:
        base.append((p, total))
        total += n
    before = df.sparkSession.createDataFrame(base, "__p long, __before long")
    row = F.col("__at") - F.shiftleft(F.col("__p"), 33)
    return placed.withColumn("__p", part).join(F.broadcast(before), "__p").withColumn(name, F.col("__before") + row).drop("__p", "__at", "__before")
