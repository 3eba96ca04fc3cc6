"""First k rows and ranks within a group, for groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pipewise.sources.scratch import materialize

Order = list[tuple[str, str]]
"""Column names with ``asc`` or ``desc``; must be a total order in a group."""


def _columns(order: Order) -> list[Column]:
    return [F.col(c).desc() if way == "desc" else F.col(c).asc() for c, way in order]


def top_k(df: DataFrame, keys: list[str], order: Order, k: int,
          rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group, numbered from 1.

    Groups are first cut to ``k`` rows within each input partition, a group of
    its own per partition, so a hot group is spread over as many tasks as it
    has partitions of input; only then are the rest brought together. The last
    task of a group sees at most ``k`` rows per input partition. The plan is
    the same for every ``k``; up to Spark's limit the first cut already
    happens before its shuffle.
    """
    if k <= 0:
        return df.withColumn(rank, F.lit(1)).where(F.lit(False))
    within = Window.partitionBy(*keys, "_input").orderBy(*_columns(order))
    cut = (
        df.withColumn("_input", F.spark_partition_id())
        .withColumn("_first", F.row_number().over(within))
        .where(F.col("_first") <= k)
        .drop("_input", "_first")
    )
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*_columns(order)))
    return cut.withColumn(rank, number).where(F.col(rank) <= k)


def first_row(df: DataFrame, keys: list[str], order: Order) -> DataFrame:
    """The first row of each group; one row per group leaves each map task."""
    return top_k(df, keys, order, 1, rank="_first").drop("_first")


def rank_in_group(df: DataFrame, keys: list[str], order: Order, rank: str = "rank",
                  parts: int | None = None) -> DataFrame:
    """Number all rows of each group from 1, whatever the size of a group.

    Eager: the rows are range partitioned by group and order and written once,
    numbered within their partition, and moved up by the number of rows of the
    same group in earlier partitions. A partition continues at most one group
    from the partition before it, so there are at most as many offsets as
    partitions; written, their size is known to Catalyst.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = [F.col(k) for k in keys] + _columns(order)
    ranged = materialize(
        df.repartitionByRange(parts, *spread).withColumn("_part", F.spark_partition_id()),
        "ranged",
    )
    earlier = (
        Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        ranged.groupBy(*keys, "_part")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_before", F.sum("_rows").over(earlier))
        .where(F.col("_before") > 0)
        .drop("_rows")
    )
    offsets = materialize(offsets, "offsets")
    local = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*_columns(order)))
    numbered = ranged.withColumn("_local", local)
    joined = numbered.join(offsets, on=[*keys, "_part"], how="left")
    return joined.withColumn(
        rank, (F.col("_local") + F.coalesce(F.col("_before"), F.lit(0))).cast("int")
    ).drop("_part", "_before", "_local")
