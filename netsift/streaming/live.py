"""Streaming forms of the traffic summary, of flows and of the review table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from netsift.operators.cases import upsert, validate_reviews
from netsift.operators.flows import aggregates, keyed_packets, shaped
from netsift.sources.folders import remove


def live_totals(packets: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Packets and bytes of each case and protocol by tumbling window."""
    w = F.window("timestamp", window)
    out = packets.withWatermark("timestamp", late).groupBy("case_id", "protocol", w).agg(F.count("*").alias("packets"), F.sum("packet_length").alias("bytes"))
    return out.select("case_id", "protocol", F.col("window.start").alias("start"), "packets", "bytes")


def live_flows(packets: DataFrame, gap: str = "2 hours", late: str = "1 day") -> DataFrame:
    """Flows that a gap closes, with all columns of `build_flows`; instead of a number, which needs all earlier flows, first_packet.

    The state of an open session is what a batch aggregate holds of a flow, so sessions that a late packet joins are merged,
    and direction and label are those of the first packet in capture order among the packets of the session.
    """
    keyed = keyed_packets(packets).withWatermark("timestamp", late)
    return shaped(keyed.groupBy("case_id", "low", "high", "protocol_number", F.session_window("timestamp", gap)).agg(*aggregates()), "first_packet")


def review_feed(reviews: DataFrame, path: str, checkpoint: str, findings: DataFrame | None = None, every: int = 20) -> StreamingQuery:
    """Keeps the newest good review of each flow as a table; with `findings`, only reviews that refer to one of these.

    A batch is written under its number and read with all before it, so that a batch that runs twice counts once. Each
    `every` batches a base is written: the whole state of the cases that these batches touched, and of no others. What a base has
    taken in goes with the next one, and so does a base of which no case is left.
    """

    def merge(batch: DataFrame, number: int) -> None:
        good = upsert(validate_reviews(batch).where("reason is null").drop("reason"))
        if findings is not None:
            good = good.join(findings.select("case_id", "flow_index").distinct(), ["case_id", "flow_index"], "left_semi")
        good.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if number % every == every - 1:
            write_base(batch.sparkSession, path, number, every)

    return reviews.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _bases(spark: SparkSession, path: str, upto: int | None = None) -> tuple[DataFrame, DataFrame] | None:
    """All rows of bases (before `upto`), and for each case its newest base; None if there is no base."""
    try:
        bases = spark.read.parquet(f"{path}/_bases")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    bases = bases if upto is None else bases.where(F.col("base") < upto)
    return bases, bases.groupBy("case_id").agg(F.max("base").alias("base"))


def write_base(spark: SparkSession, path: str, number: int, every: int) -> None:
    """The state of the cases touched since the base before `number`, as base `number`; then what nothing needs any more is removed."""
    before = _bases(spark, path, upto=number)
    taken = -1 if before is None else before[0].agg(F.max("base")).first()[0]
    taken = -1 if taken is None else taken
    fresh = spark.read.parquet(path).where((F.col("batch") > taken) & (F.col("batch") <= number)).drop("batch")
    if before is not None:
        touched = fresh.select("case_id").distinct()
        fresh = fresh.unionByName(before[0].join(before[1].join(touched, "case_id", "left_semi"), ["case_id", "base"], "left_semi").drop("base"))
    current_reviews(fresh).write.mode("overwrite").parquet(f"{path}/_bases/base={number}")
    for old in range(max(0, taken - every + 1), taken + 1):
        remove(spark, f"{path}/batch={old}")
    rows, newest = _bases(spark, path)
    wanted = {r[0] for r in newest.select("base").distinct().collect()} | {number}
    for (old,) in rows.select("base").distinct().collect():
        if old not in wanted:
            remove(spark, f"{path}/_bases/base={old}")


def fed_reviews(spark: SparkSession, path: str) -> DataFrame:
    """The table that a review feed has left: each case from its newest base, and the batches since the newest of all, newest review per flow."""
    log, found = spark.read.parquet(path), _bases(spark, path)
    if found is None:
        return current_reviews(log.drop("batch"))
    bases, newest = found
    last = bases.agg(F.max("base")).first()[0]
    held = bases.join(newest, ["case_id", "base"], "left_semi").drop("base")
    return current_reviews(held.unionByName(log.where(F.col("batch") > last).drop("batch")))


def current_reviews(log: DataFrame) -> DataFrame:
    """The newest review per flow of a log."""
    return upsert(log)
