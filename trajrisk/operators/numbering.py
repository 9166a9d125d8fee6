"""Dense numbers in an order, without a task that sorts all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stored


def numbered(rows: DataFrame, order: list[Column | str], name: str = "number", parts: int | None = None) -> DataFrame:
    """``rows`` with ``name``: 0, 1, 2 and so on in ``order``, which is to tell all rows apart.

    Rows are dealt out by ranges, numbered within each, and moved by the sizes of the ranges before. The ranged rows
    are stored before they are counted, as the ranges come from a sample.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(rows.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "ranged")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__k"))
    offsets = sizes.select("__part", F.coalesce(F.sum("__k").over(before), F.lit(0)).alias("__base"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    out = ranged.withColumn("__place", place).join(F.broadcast(offsets), "__part")
    return out.withColumn(name, F.col("__base") + F.col("__place")).drop("__part", "__place", "__base")
