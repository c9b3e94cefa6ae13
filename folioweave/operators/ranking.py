"""Numbers and ranks over groups of any size, no task ever seeing a whole group that is large.

Rows are range-partitioned by group and order, ranked within each part, and shifted by the sizes of the parts before. The
order columns must be distinct within a group, or ties are broken arbitrarily.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioweave.session import cut

SALTS = 32


def rank_within(rows: DataFrame, groups: list[str], orders: list[Column], name: str = "rank") -> DataFrame:
    """`rows` with each row's place, from 1, within its group (one group where `groups` is empty)."""
    width = max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = cut(rows.repartitionByRange(width, *[F.col(g).asc() for g in groups], *orders).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy(*groups, "_part").agg(F.count(F.lit(1)).alias("_n"))  # a group has at most `width` rows here
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*groups or [F.lit(0)]).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = sizes.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col("_part").alias("_p"), before.alias("_before"))
    same = F.col("_part") == F.col("_p")
    for i, g in enumerate(groups):
        same &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    place = F.row_number().over(Window.partitionBy("_part", *groups).orderBy(*orders))
    return parts.withColumn("_place", place).join(shift, same).withColumn(name, (F.col("_place") + F.col("_before")).cast("long")).select(*rows.columns, name)


def numbered(rows: DataFrame, order: str, name: str) -> DataFrame:
    """`rows` with consecutive numbers from 0 in the order of a distinct column."""
    return rank_within(rows, [], [F.col(order).asc()], name).withColumn(name, F.col(name) - 1)


def top_within(rows: DataFrame, groups: list[str], orders: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first `k` rows of every group with their place; each of SALTS parts of a group keeps its own first `k` before
    the group meets."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)))
    near = salted.withColumn(name, F.row_number().over(Window.partitionBy(*groups, "_salt").orderBy(*orders))).where(F.col(name) <= k)
    return near.withColumn(name, F.row_number().over(Window.partitionBy(*groups or [F.lit(0)]).orderBy(*orders))).where(F.col(name) <= k).select(*rows.columns, name)
