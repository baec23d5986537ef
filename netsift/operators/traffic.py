"""Packet-level filters and the traffic summary of a case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_ports(packets: DataFrame) -> DataFrame:
    return packets.where(F.col("source_port").isNotNull() & F.col("destination_port").isNotNull())


def protocol_name(number: Column) -> Column:
    return F.when(number == 6, "TCP").when(number == 17, "UDP").otherwise("OTHER")


def protocol_number(name: Column, header: Column) -> Column:
    return F.when(name == "TCP", 6).when(name == "UDP", 17).otherwise(header)


def flag(letter: str) -> Column:
    """1 where a packet's flags hold the letter."""
    return F.coalesce(F.contains("tcp_flags", F.lit(letter)).cast("int"), F.lit(0))


def endpoints() -> tuple[Column, Column]:
    """Source and destination as (ip, port), which compare as text, then number."""
    return F.struct(F.col("source_ip").alias("ip"), F.col("source_port").alias("port")), F.struct(F.col("destination_ip").alias("ip"), F.col("destination_port").alias("port"))


def canonical_key(packets: DataFrame) -> DataFrame:
    """Columns low and high: the endpoints of a packet in order, whatever its direction."""
    a, b = endpoints()
    return packets.withColumn("low", F.when(a <= b, a).otherwise(b)).withColumn("high", F.when(a <= b, b).otherwise(a))


def totals(packets: DataFrame) -> DataFrame:
    return packets.groupBy("case_id").agg(F.count("*").alias("total_packets"), F.sum("packet_length").alias("total_bytes"))


def protocol_counts(packets: DataFrame) -> DataFrame:
    return packets.groupBy("case_id", "protocol").agg(F.count("*").alias("packets"))


def protocol_map(packets: DataFrame) -> DataFrame:
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("protocol", "packets"))))
    return protocol_counts(packets).groupBy("case_id").agg(entries.alias("protocols"))


def protocol_text(packets: DataFrame) -> DataFrame:
    """`TCP: 1,234, UDP: 5`, by name."""
    part = F.concat("protocol", F.lit(": "), F.format_number("packets", 0))
    return protocol_counts(packets).groupBy("case_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("protocol", part.alias("t")))), lambda x: x["t"]), ", ").alias("protocol_text"))


def top_ips(packets: DataFrame, column: str, n: int = 5) -> DataFrame:
    """The n addresses with most packets; of equal counts the one seen first."""
    seen = packets.where(F.trim(column) != "").groupBy("case_id", F.col(column).alias("ip")).agg(F.count("*").alias("packets"), F.min("packet_number").alias("first"))
    order = Window.partitionBy("case_id").orderBy(F.desc("packets"), "first")
    return seen.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).drop("first")


def capture_quality(flows: DataFrame, packets: DataFrame) -> DataFrame:
    """empty, low (under 50 flows) or normal."""
    both = totals(packets).join(flow_counts(flows), "case_id", "left").withColumn("total_flows", F.coalesce("total_flows", F.lit(0)))
    quality = F.when((F.col("total_packets") == 0) | (F.col("total_flows") == 0), "empty").when(F.col("total_flows") < 50, "low").otherwise("normal")
    return both.select("case_id", "total_packets", "total_flows", quality.alias("quality"))


def flow_counts(flows: DataFrame) -> DataFrame:
    return flows.groupBy("case_id").agg(F.count("*").alias("total_flows"))
