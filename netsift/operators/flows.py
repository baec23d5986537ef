"""Bidirectional flows of packets, one for each pair of endpoints and protocol of a case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsift.operators.numbering import SPAN, numbered
from netsift.operators.traffic import canonical_key, endpoints, flag, with_ports
from netsift.sources.folders import checkpointed

FLAGS = {"S": "syn_count", "A": "ack_count", "F": "fin_count", "R": "rst_count", "P": "psh_count"}


def keyed_packets(packets: DataFrame) -> DataFrame:
    """Packets with both ports, their endpoints in order, and whether the lower one sent them."""
    a, _ = endpoints()
    return canonical_key(with_ports(packets)).withColumn("from_low", a == F.col("low"))


def aggregates() -> list[Column]:
    """What flows are made of, in buffers of a fixed width that can be merged; counts are kept for the lower endpoint as the sender."""
    label = F.when(F.col("protocol") == "TCP", 0).when(F.col("protocol") == "UDP", 1).otherwise(2)
    size = F.col("packet_length")
    return [
        F.min_by("from_low", "packet_number").alias("first_low"), F.min_by(label, "packet_number").alias("label"), F.min("packet_number").alias("first_packet"), F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time"),
        F.count("*").alias("total_packets"), F.sum(size).alias("total_bytes"), F.count_if("from_low").alias("low_packets"), F.sum(F.when(F.col("from_low"), size).otherwise(0)).alias("low_bytes"),
        F.avg(size).alias("packet_length_mean"), F.min(size).alias("packet_length_min"), F.max(size).alias("packet_length_max"), *[F.sum(flag(k)).alias(v) for k, v in FLAGS.items()],
    ]


def aggregated(packets: DataFrame) -> DataFrame:
    """One partial and one final hash aggregate."""
    return keyed_packets(packets).groupBy("case_id", "low", "high", "protocol_number").agg(*aggregates())


def shaped(grouped: DataFrame, number: str) -> DataFrame:
    """The columns of flows, `number` among them, of aggregated packets."""
    forward = lambda x: F.when(F.col("first_low"), F.col(f"low_{x}")).otherwise(F.col(f"total_{x}") - F.col(f"low_{x}"))
    source = lambda x: F.when(F.col("first_low"), F.col(f"low.{x}")).otherwise(F.col(f"high.{x}")).alias(f"source_{x}")
    destination = lambda x: F.when(F.col("first_low"), F.col(f"high.{x}")).otherwise(F.col(f"low.{x}")).alias(f"destination_{x}")
    protocol = F.when(F.col("label") == 0, "TCP").when(F.col("label") == 1, "UDP").otherwise("OTHER").alias("protocol")
    duration = F.unix_micros("end_time") - F.unix_micros("start_time")
    rate = lambda x: F.when(F.col("flow_duration") > 0, F.col(x) / (F.col("flow_duration") / 1e6)).otherwise(0.0)
    flows = grouped.select("*", forward("packets").alias("forward_packets"), forward("bytes").alias("forward_bytes"), duration.alias("flow_duration"))
    return flows.select(
        "case_id", number, source("ip"), source("port"), destination("ip"), destination("port"), protocol, "protocol_number", "start_time", "end_time", "flow_duration", "total_packets", "total_bytes", "forward_packets", "forward_bytes",
        (F.col("total_packets") - F.col("forward_packets")).alias("backward_packets"), (F.col("total_bytes") - F.col("forward_bytes")).alias("backward_bytes"), "packet_length_mean",
        "packet_length_min", "packet_length_max", *FLAGS.values(), rate("total_bytes").alias("bytes_per_second"), rate("total_packets").alias("packets_per_second"),
    )


def build_flows(packets: DataFrame, *, span: int = SPAN) -> DataFrame:
    """Flows, directed as their first packet in capture order is. Endpoints that are equal make every packet a forward one; durations are exact
    microseconds. Packets are read once: their aggregate, a row for each flow, is kept in the shared folder, and flows are numbered
    from it by their first packet, in buckets of `span` packets.
    """
    grouped = checkpointed(aggregated(packets))
    return shaped(numbered(grouped, grouped, "flow_id", span=span), "flow_id")
