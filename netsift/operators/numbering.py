"""Numbers of rows within a group, without a task that sorts the whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netsift.sources.folders import checkpointed

#: Values of the order column that one bucket spans; as they are distinct, a task sorts at most so many rows of a bucket.
SPAN = 1_000_000


def numbered(rows: DataFrame, starts: DataFrame, name: str, *, group: str = "case_id", order: str = "first_packet", span: int = SPAN) -> DataFrame:
    """rows with a number from 1 within the group, by a whole number that is distinct there; neither is null.

    Rows are sorted by bucket of the order column and numbered from what earlier buckets hold. Only the counts of
    buckets, one row for up to `span` rows, meet by group. `starts` has group and order of the same rows, and may be
    the cheaper way to them.
    """
    bucket = F.expr(f"`{order}` div {span}").alias("bucket")
    counts = starts.select(group, bucket).groupBy(group, "bucket").agg(F.count("*").alias("held"))
    earlier = F.sum("held").over(Window.partitionBy(group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(group, "bucket", F.coalesce(earlier, F.lit(0)).alias("earlier"))
    within = F.row_number().over(Window.partitionBy(group, "bucket").orderBy(order))
    return rows.select("*", bucket).join(counts, [group, "bucket"]).withColumn(name, F.col("earlier") + within).drop("bucket", "earlier")


def ranked(rows: DataFrame, name: str, *order: Column, group: str = "case_id") -> DataFrame:
    """rows with their place from 1 within the group in an order of any columns, which must tell its rows apart.

    Rows are dealt by ranges of group and order, kept in the shared folder so that ranges stay as they are, and numbered
    from what earlier ranges of the group hold. A task sorts one range, however large the group is.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpointed(rows.repartitionByRange(parts, group, *order).withColumn("_range", F.spark_partition_id()))
    earlier = F.sum("count").over(Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    counts = ranged.groupBy(group, "_range").count().select(group, "_range", F.coalesce(earlier, F.lit(0)).alias("_earlier"))
    within = F.row_number().over(Window.partitionBy(group, "_range").orderBy(*order))
    return ranged.join(counts, [group, "_range"]).withColumn(name, F.col("_earlier") + within).drop("_range", "_earlier")
