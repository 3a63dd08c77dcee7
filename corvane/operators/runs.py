"""Places and running sums in ordered groups of any size: no task holds a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import Tables


def running(rows: DataFrame, group: list[str], order: list[Column], cost: str | None = None, scratch: Tables | None = None) -> DataFrame:
    """rows with `rank` (int, from 1) and, with a cost, `used` (its sum up to and with the row) in each group's order.

    The rows are sorted in ranges of group and order, written once, and numbered run by run: a run
    starts after the sums of the group's runs before it, a row for each of them.  Ties in the order are
    broken by nothing: order has to tell all rows apart for the same result again.
    """
    scratch = scratch or Tables(rows.sparkSession)
    keys = [F.col(g) for g in group]
    ranged = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    ranged = scratch.table(ranged.withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()))
    paid = F.coalesce(F.col(cost).cast("long"), F.lit(0).cast("long")) if cost else F.lit(0).cast("long")
    here = Window.partitionBy("_p", *group).orderBy("_m")
    local = ranged.withColumn("_n", F.row_number().over(here)).withColumn("_u", F.sum(paid).over(here.rowsBetween(Window.unboundedPreceding, 0)))
    before = Window.partitionBy(*group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    runs = ranged.groupBy("_p", *group).agg(F.count("*").alias("_rows"), F.sum(paid).alias("_paid"))
    zero = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0).cast("long"))
    runs = runs.select(F.col("_p").alias("_q"), *(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)), zero("_rows").alias("_bn"), zero("_paid").alias("_bu"))
    same = F.col("_p") == F.col("_q")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    out = local.join(runs, same).withColumn("rank", (F.col("_n") + F.col("_bn")).cast("int"))
    out = out.withColumn("used", F.col("_u") + F.col("_bu")) if cost else out
    return out.drop("_p", "_m", "_n", "_u", "_q", "_bn", "_bu", *(f"_g{i}" for i in range(len(group))))
