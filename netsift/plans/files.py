"""Registered queries over sources, sinks, guards, sort orders and the streaming forms run as batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsift.functions import text as T
from netsift.operators import cases, checks, model, scoring
from netsift.operators.numbering import ranked
from netsift.plans import queries as plain
from netsift.schema import COLUMNS, STAND_IN
from netsift.sources import captures, store
from netsift.sources.fixtures import packets
from netsift.sources.folders import checkpointed, new_folder
from netsift.streaming import live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
PACKET_COLUMNS = ("case_id", "packet_number", "source_ip", "destination_ip", "protocol", "protocol_number", "source_port", "destination_port", "packet_length", "tcp_flags", "header_length", "payload_length", "tcp_window")


def _query(name: str, sql: str):
    def register(f):
        QUERIES[name], ORACLES[name] = f, f"{plain._CTE} {sql}"
        return f

    return register


@_query("packets_from_file", f"SELECT {', '.join(PACKET_COLUMNS)}, epoch_us(timestamp) AS us FROM packets")
def packets_from_file(spark: SparkSession, d: str) -> DataFrame:
    """Packet tables written by case and read back under the contract's schema."""
    path = new_folder(spark, "packets")
    packets(spark, d).write.parquet(path)
    return captures.read_packets(spark, path).select(*PACKET_COLUMNS, F.unix_micros("timestamp").alias("us"))


def _hex(x, digits: int):
    return F.lpad(F.hex(x.cast("long")), digits, "0")


def raw_frames(rows: DataFrame) -> DataFrame:
    """Ethernet frames with the headers of IPv4 packets: TCP and UDP with their ports, any other protocol without."""
    tcp, udp = F.col("protocol") == "TCP", F.col("protocol") == "UDP"
    address = lambda c: F.array_join(F.transform(F.split(c, r"\."), lambda x: _hex(x, 2)), "")
    bits = sum((F.when(F.contains("tcp_flags", F.lit(letter)), 1 << i).otherwise(0) for i, letter in enumerate("FSRPAUEC")), F.lit(0))
    size = F.col("payload_length") + F.col("header_length")
    ports = F.concat(_hex(F.col("source_port"), 4), _hex(F.col("destination_port"), 4))
    beyond = F.when(tcp, F.concat(ports, F.lit("0" * 16 + "50"), _hex(bits, 2), _hex(F.coalesce("tcp_window", F.lit(0)), 4), F.lit("0" * 8))).when(udp, F.concat(ports, _hex(size, 4), F.lit("0000"))).otherwise("")
    ip = F.concat(F.lit("4500"), _hex(20 + size, 4), F.lit("0000000040"), _hex(F.col("protocol_number"), 2), F.lit("0000"), address("source_ip"), address("destination_ip"))
    return rows.select("case_id", "packet_number", F.unix_micros("timestamp").alias("us"), "packet_length", F.unhex(F.concat(F.lit("00" * 12 + "0800"), ip, beyond)).alias("frame"))


@_query("decoded_frames", "SELECT packet_number, epoch_us(timestamp) AS us, source_ip, destination_ip, protocol, protocol_number, source_port, destination_port, length(tcp_flags) AS flags, header_length, greatest(payload_length, 0) AS payload_length, tcp_window FROM packets WHERE payload_length >= 0")
def decoded_frames(spark: SparkSession, d: str) -> DataFrame:
    """Raw frames of packets, decoded again."""
    frames = raw_frames(packets(spark, d).where("payload_length >= 0"))
    out = captures.decode_frames(frames)
    return out.select("packet_number", F.unix_micros("timestamp").alias("us"), "source_ip", "destination_ip", "protocol", "protocol_number", "source_port", "destination_port", F.length("tcp_flags").alias("flags"), "header_length", "payload_length", "tcp_window")


@_query("checked_findings", "SELECT case_id, flow_index, predicted_class, round(confidence, 6) AS confidence, summary, CAST(6 AS INTEGER) AS width FROM scored JOIN advice USING (predicted_class)")
def checked_findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings with recommendation and explanation, written as cases; probabilities, classes and explanations are checked in the pass that writes
    them, and one case is replaced by itself. A third write whose checks fail leaves the table as it is."""
    path, scored = new_folder(spark, "findings"), plain._scored(spark, d)
    explained = scoring.explanations(scoring.top_contributors(scoring.contributions(scored))).select("case_id", "flow_index", "contributors")
    rows, scores = checks.checked_scores(scored)
    rows, advice = checks.checked_recommendations(rows)
    rows, told = checks.checked_explanations(rows.join(explained, ["case_id", "flow_index"], "left"), len(STAND_IN))
    shown = rows.select("case_id", "flow_index", "predicted_class", F.round("confidence", 6).alias("confidence"), "summary", F.size("contributors").alias("width"))
    store.replace_cases(shown, path, verify=lambda: [f() for f in (scores, advice, told)])
    kept = store.read_cases(spark, path)
    store.replace_cases(kept.where(F.col("case_id").endswith("5-000000")), path)
    bad, verify = checks.observed(kept.withColumn("width", F.lit(0)), wrong=F.col("width") == 0)
    try:
        store.replace_cases(bad, path, verify=verify)
    except ValueError:
        return store.read_cases(spark, path)
    raise AssertionError("faulty rows were taken")


@_query("sorted_rows", " UNION ALL ".join(f"SELECT '{k}' AS sort_key, case_id, flow_index, CAST(row_number() OVER (PARTITION BY case_id ORDER BY {'round(confidence, 9)' if k == 'confidence' else k}{' DESC' if k in ('confidence', 'source') else ''}, flow_index) AS INTEGER) AS position FROM triage" for k in cases.SORT_KEYS))
def sorted_rows(spark: SparkSession, d: str) -> DataFrame:
    """Positions of triage rows under each sort key that is offered, two of them from the top."""
    rows = checkpointed(plain._triage(spark, d).withColumn("confidence", F.round("confidence", 9)).select("case_id", "flow_index", "predicted_class", "priority_rank", "confidence", "source", "destination", "review"))
    out = None
    for key in cases.SORT_KEYS:
        mine = cases.sort_positions(rows, key, key in ("confidence", "source")).select(F.lit(key).alias("sort_key"), "case_id", "flow_index", "position")
        out = mine if out is None else out.unionByName(mine)
    return out


@_query("case_order", "SELECT case_id, CAST(row_number() OVER (ORDER BY case_id DESC) AS INTEGER) AS position FROM (SELECT DISTINCT case_id FROM packets)")
def case_order(spark: SparkSession, d: str) -> DataFrame:
    """Cases, newest first."""
    rows = packets(spark, d).select("case_id").distinct().withColumn("all", F.lit(0))
    return ranked(rows, "position", F.desc("case_id"), group="all").select("case_id", F.col("position").cast("int").alias("position"))


@_query("filled_fields", "SELECT event_id, coalesce(nullif(CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN event_type END, ''), nullif(props, ''), 'Unknown') AS name, CASE WHEN event_id % 4 > 1 AND value <> 0 THEN value ELSE CAST(event_id % 2 AS DOUBLE) END AS amount FROM events")
def filled_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fallback chains: empty text and zero count as missing, but for the last number."""
    events = spark.read.parquet(f"{d}/events.parquet")
    name = T.filled(F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_id") % 3 == 1, F.col("event_type")), F.col("props"), default="Unknown")
    return events.select("event_id", name.alias("name"), T.filled_number(F.when(F.col("event_id") % 4 > 1, F.col("value")), (F.col("event_id") % 2).cast("double")).alias("amount"))


@_query("windowed_totals", "SELECT case_id, protocol, epoch_us(time_bucket(INTERVAL 5 MINUTES, timestamp)) AS start_us, count(*) AS packets, CAST(sum(packet_length) AS BIGINT) AS bytes FROM packets GROUP BY 1, 2, 3")
def windowed_totals(spark: SparkSession, d: str) -> DataFrame:
    """The live traffic summary over a finished table."""
    return live.live_totals(packets(spark, d)).select("case_id", "protocol", F.unix_micros("start").alias("start_us"), "packets", "bytes")


_SESSION = "case_id, ip1, p1, ip2, p2, protocol_number"
_LIVE = ["total_packets", "total_bytes", "forward_packets", "forward_bytes", "packet_length_min", "packet_length_max", "syn_count", "ack_count", "fin_count", "rst_count", "psh_count", "flow_duration"]


@_query(
    "session_flows",
    f"""SELECT case_id, first_packet, source_ip, source_port, destination_ip, destination_port, protocol, start_us, end_us, {', '.join(_LIVE)} FROM (
SELECT case_id, min(packet_number) AS first_packet, any_value(s_ip) AS source_ip, any_value(s_port) AS source_port, any_value(t_ip) AS destination_ip, any_value(t_port) AS destination_port, any_value(label) AS protocol,
  min(us) AS start_us, max(us) AS end_us, count(*) AS total_packets, CAST(sum(packet_length) AS BIGINT) AS total_bytes, count(*) FILTER (source_ip = s_ip AND source_port = s_port) AS forward_packets, CAST(coalesce(sum(packet_length) FILTER (source_ip = s_ip AND source_port = s_port), 0) AS BIGINT) AS forward_bytes,
  min(packet_length) AS packet_length_min, max(packet_length) AS packet_length_max, {', '.join(f"count(*) FILTER (instr(tcp_flags, '{k}') > 0) AS {n}_count" for n, k in (('syn', 'S'), ('ack', 'A'), ('fin', 'F'), ('rst', 'R'), ('psh', 'P')))}, max(us) - min(us) AS flow_duration
FROM (SELECT *, first_value(source_ip) OVER o AS s_ip, first_value(source_port) OVER o AS s_port, first_value(destination_ip) OVER o AS t_ip, first_value(destination_port) OVER o AS t_port, first_value(protocol) OVER o AS label FROM (
  SELECT *, sum(new) OVER (PARTITION BY {_SESSION} ORDER BY us, packet_number) AS session FROM (
    SELECT k.* EXCLUDE (us), k.us, CASE WHEN k.us - lag(k.us) OVER w > {plain.HOURS} THEN 1 ELSE 0 END AS new FROM (SELECT *, epoch_us(timestamp) AS us FROM keyed) k WINDOW w AS (PARTITION BY {_SESSION} ORDER BY us, packet_number)))
  WINDOW o AS (PARTITION BY {_SESSION}, session ORDER BY packet_number))
GROUP BY {_SESSION}, session)""",
)
def session_flows(spark: SparkSession, d: str) -> DataFrame:
    """The live flows over a finished table: what two hours without a packet close."""
    return live.live_flows(packets(spark, d)).select("case_id", "first_packet", "source_ip", "source_port", "destination_ip", "destination_port", "protocol", F.unix_micros("start_time").alias("start_us"), F.unix_micros("end_time").alias("end_us"), *_LIVE)


_PARTS = " UNION ALL ".join(f"SELECT case_id, flow_index, '{c}' AS feature, round(((class_id * 7 + {f} * 13 + class_id * {f} * 3) % 11 - 5) / 100.0 * z{f}, 5) + 0.0 AS shap_value FROM named" for f, c in enumerate(COLUMNS))


@_query("contribution_rows", f"{plain._MODEL_SQL} SELECT case_id, flow_index, feature, shap_value FROM ({_PARTS})")
def contribution_rows(spark: SparkSession, d: str) -> DataFrame:
    """What each of the 74 features adds to the margin of each flow's class, feature by feature."""
    scored, bundle = plain._scored_features(spark, d)
    return model.feature_contributions(scored, bundle).select("case_id", "flow_index", "feature", (F.round("shap_value", 5) + 0.0).alias("shap_value"))
