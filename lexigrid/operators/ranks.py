"""Row numbers within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexigrid.session import cut


def numbered(rows: DataFrame, group: str, order: list[Column | str], name: str = "pos") -> DataFrame:
    """rows with the column name: the row's place in its group, from 1. order must be total within a group; group isn't null.

    Rows are range-partitioned by group and order, numbered inside of each range and shifted by what stands before, so that a
    group with a third of all rows is spread over as many tasks as it takes.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Written, as another run of the range partitioning might draw other bounds.
    ranged = cut(rows.where(F.col(group).isNotNull()).repartitionByRange(n, group, *order).withColumn("__part", F.spark_partition_id()))
    counts = ranged.groupBy(group, "__part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(group).orderBy("__part")) - F.col("__n")
    inside = F.row_number().over(Window.partitionBy(group, "__part").orderBy(*order))
    out = ranged.withColumn("__in", inside).join(counts.select(group, "__part", before.alias("__before")), [group, "__part"])
    return out.withColumn(name, (F.col("__before") + F.col("__in")).cast("long")).drop("__part", "__in", "__before")
