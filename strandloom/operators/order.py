"""Numbers along an order without one task for a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.session import cut


def numbered(rows: DataFrame, group: list[str], order: list[str], name: str = "nth") -> DataFrame:
    """Rows with their number from 1 in their group.

    Rows are put into ranges of (group, order), so a group with a third of all rows
    is spread; a range's rows are numbered in it and the few counts of ranges before
    are added.  ``order`` must tell rows of a group apart.
    """
    ranged = rows.repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id())
    inside = Window.partitionBy("_range", *group).orderBy(*order)
    at = cut(ranged.withColumn("_in", F.row_number().over(inside)))
    counts = at.groupBy("_range", *group).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("_range").alias("_r"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(group)], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    on = [F.col("_range") == F.col("_r"), *[F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(group)]]
    return at.join(counts, on).select(*rows.columns, (F.col("_before") + F.col("_in")).alias(name))
