"""Prefix sums and row numbers in a global order, without a task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.plans.densest import cut_lineage


def prefix(df: DataFrame, order: list[Column | str], sums: dict[str, Column]) -> DataFrame:
    """df with the inclusive prefix sum of each column of sums, in the order given, which should have no ties.

    Rows are dealt into ranges of the order whose bounds Spark samples; a checkpoint fixes them. Sums run inside the
    ranges, and only the table of ranges is summed as a whole.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut_lineage(df.repartitionByRange(tasks, *order).withColumn("__p", F.spark_partition_id()))
    totals = rows.groupBy("__p").agg(*[F.sum(c).alias(f"__t_{n}") for n, c in sums.items()])
    ahead = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("__p", *[F.coalesce(F.sum(f"__t_{n}").over(ahead), F.lit(0)).alias(f"__b_{n}") for n in sums])
    inside = Window.partitionBy("__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = rows.select("*", *[F.sum(c).over(inside).alias(f"__o_{n}") for n, c in sums.items()])
    return own.join(F.broadcast(before), "__p").select(*df.columns, *[(F.col(f"__b_{n}") + F.col(f"__o_{n}")).alias(n) for n in sums])


def numbered(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """df with a number from 0 in the order given."""
    return prefix(df, order, {name: F.lit(1).cast("long")}).withColumn(name, (F.col(name) - 1).cast("long"))
