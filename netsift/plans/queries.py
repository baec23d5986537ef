"""Registered queries over the packet tables, and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsift.functions import text as T
from netsift.operators import cases, flows, model, scoring, traffic, trees
from netsift.operators.features import flow_features
from netsift.schema import CLASSES, COLUMNS, RECOMMENDATIONS, STAND_IN, bias, snake, weight
from netsift.sources import captures
from netsift.sources.fixtures import DUCKDB, PACKETS_SQL, REVIEWS_SQL, fill, packets, review_log
from netsift.sources.folders import checkpointed, new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

HOURS = 7_200_000_000


def _flows(spark, d):
    return flows.build_flows(packets(spark, d))


def _scored(spark, d):
    return scoring.score(scoring.model_row(_flows(spark, d)))


def _contributed(spark, d):
    return scoring.contributions(_scored(spark, d))


def _good_log(spark, d):
    return cases.validate_reviews(review_log(spark, d)).where("reason is null").drop("reason")


def _reviews(spark, d):
    return cases.reviews_of_findings(cases.upsert(_good_log(spark, d)), _scored(spark, d))


def _newest(spark, d):
    """Newest reviews, those without a finding too: where they are joined to findings these fall away, without a second scoring."""
    return cases.upsert(_good_log(spark, d))


def _triage(spark, d):
    return cases.triage_rows(_scored(spark, d), _newest(spark, d))


def _case_reports(spark, d):
    scored = checkpointed(_scored(spark, d))  # used by the summary, the rows and the reviews
    return cases.case_report(scoring.case_summary(scored), cases.report_rows(scored, _newest(spark, d)), cases.reviews_of_findings(_newest(spark, d), scored))


# ---- SQL that the oracles are put together from, written apart from the operators
_MARGINS = ", ".join("round(" + " + ".join([str(bias(c)), *(f"({weight(c, f)}) * (x{f} - {STAND_IN[f][1]}) / {STAND_IN[f][2]}" for f in range(6))]) + f", 9) AS m{c}" for c in range(16))
_TOP = f"greatest({', '.join(f'm{c}' for c in range(16))})"
_SUM = " + ".join(f"exp(m{c} - top)" for c in range(16))
_CLASS_ID = "CASE " + " ".join(f"WHEN m{c} = top THEN {c}" for c in range(16)) + " END"
_NAME = "CASE class_id " + " ".join(f"WHEN {c} THEN '{name}'" for c, name in enumerate(CLASSES)) + " END"
_BASE = "CASE class_id " + " ".join(f"WHEN {c} THEN {bias(c)}" for c in range(16)) + " END"


def _weight(f: int) -> str:
    return "CASE class_id " + " ".join(f"WHEN {c} THEN {weight(c, f)}" for c in range(16)) + " END"


_CTE = f"""
WITH packets AS ({fill(PACKETS_SQL, DUCKDB)}), log AS ({fill(REVIEWS_SQL, DUCKDB)}),
keyed AS (
  SELECT *, CASE WHEN swap THEN destination_ip ELSE source_ip END AS ip1, CASE WHEN swap THEN destination_port ELSE source_port END AS p1,
    CASE WHEN swap THEN source_ip ELSE destination_ip END AS ip2, CASE WHEN swap THEN source_port ELSE destination_port END AS p2
  FROM (SELECT *, NOT (source_ip < destination_ip OR (source_ip = destination_ip AND source_port <= destination_port)) AS swap
        FROM packets WHERE source_port IS NOT NULL AND destination_port IS NOT NULL)),
opened AS (
  SELECT *, (source_ip = f_ip AND source_port = f_port) AS fwd, epoch_us(timestamp) AS us FROM (
    SELECT *, first_value(source_ip) OVER o AS f_ip, first_value(source_port) OVER o AS f_port, first_value(destination_ip) OVER o AS t_ip,
      first_value(destination_port) OVER o AS t_port, first_value(protocol) OVER o AS f_protocol
    FROM keyed WINDOW o AS (PARTITION BY case_id, ip1, p1, ip2, p2, protocol_number ORDER BY packet_number))),
grouped AS (
  SELECT case_id, ip1, p1, ip2, p2, protocol_number, min(packet_number) AS first_packet, any_value(f_ip) AS source_ip, any_value(f_port) AS source_port,
    any_value(t_ip) AS destination_ip, any_value(t_port) AS destination_port, any_value(f_protocol) AS protocol, min(timestamp) AS start_time, max(timestamp) AS end_time,
    max(us) - min(us) AS flow_duration, count(*) AS total_packets, CAST(sum(packet_length) AS BIGINT) AS total_bytes,
    count(*) FILTER (fwd) AS forward_packets, CAST(coalesce(sum(packet_length) FILTER (fwd), 0) AS BIGINT) AS forward_bytes,
    count(*) FILTER (NOT fwd) AS backward_packets, CAST(coalesce(sum(packet_length) FILTER (NOT fwd), 0) AS BIGINT) AS backward_bytes,
    sum(packet_length) / count(*) AS packet_length_mean, min(packet_length) AS packet_length_min, max(packet_length) AS packet_length_max,
    count(*) FILTER (instr(tcp_flags, 'S') > 0) AS syn_count, count(*) FILTER (instr(tcp_flags, 'A') > 0) AS ack_count, count(*) FILTER (instr(tcp_flags, 'F') > 0) AS fin_count,
    count(*) FILTER (instr(tcp_flags, 'R') > 0) AS rst_count, count(*) FILTER (instr(tcp_flags, 'P') > 0) AS psh_count
  FROM opened GROUP BY 1, 2, 3, 4, 5, 6),
flows AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY first_packet) AS flow_id FROM grouped),
rows_ AS (SELECT *, flow_id - 1 AS flow_index, CAST(flow_duration AS DOUBLE) AS x0, packet_length_mean AS x1, CAST(packet_length_max AS DOUBLE) AS x2,
  CAST(forward_packets AS DOUBLE) AS x3, CAST(syn_count AS DOUBLE) AS x4, CAST(forward_bytes AS DOUBLE) AS x5 FROM flows),
margins AS (SELECT *, {_TOP} AS top FROM (SELECT *, {_MARGINS} FROM rows_)),
chosen AS (SELECT *, {_CLASS_ID} AS class_id, {_SUM} AS total_exp FROM margins),
scored AS (SELECT *, {_NAME} AS predicted_class, 1.0 / total_exp AS confidence, class_id <> 1 AS is_threat, CAST({_BASE} AS DOUBLE) AS base_value FROM chosen),
parts AS ({' UNION ALL '.join(f"SELECT case_id, flow_index, predicted_class, confidence, base_value, top, {f} AS feature_id, '{STAND_IN[f][0]}' AS feature, x{f} AS raw_value, ({_weight(f)}) * ((x{f} - {STAND_IN[f][1]}) / {STAND_IN[f][2]}) AS shap_value FROM scored" for f in range(6))}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY case_id, flow_index ORDER BY round(abs(shap_value), 9) DESC, feature_id) AS rank,
  CASE WHEN round(shap_value, 9) > 0 THEN 'supports_prediction' WHEN round(shap_value, 9) < 0 THEN 'opposes_prediction' ELSE 'neutral' END AS direction FROM parts),
good AS (SELECT event_id, case_id, flow_index, decision, trim(notes) AS notes, review_timestamp FROM log WHERE decision IN ('Confirmed', 'Rejected', 'Inconclusive') AND flow_index >= 0),
newest AS (SELECT * FROM good g WHERE NOT EXISTS (SELECT 1 FROM good h WHERE h.case_id = g.case_id AND h.flow_index = g.flow_index
  AND (h.review_timestamp > g.review_timestamp OR (h.review_timestamp = g.review_timestamp AND h.event_id > g.event_id)))),
reviews AS (SELECT n.*, s.predicted_class FROM newest n JOIN scored s ON n.case_id = s.case_id AND n.flow_index = s.flow_index),
triage AS (
  SELECT s.case_id, s.flow_index, s.predicted_class, s.confidence, CASE WHEN s.confidence >= 0.9 THEN 'High' WHEN s.confidence >= 0.7 THEN 'Medium' ELSE 'Low' END AS priority,
    CASE WHEN s.confidence >= 0.9 THEN 1 WHEN s.confidence >= 0.7 THEN 2 ELSE 3 END AS priority_rank,
    s.source_ip || ':' || s.source_port AS source, s.destination_ip || ':' || s.destination_port AS destination, coalesce(r.decision, 'Unreviewed') AS review
  FROM scored s LEFT JOIN reviews r ON s.case_id = r.case_id AND s.flow_index = r.flow_index WHERE s.is_threat),
summaries AS (SELECT case_id, count(*) AS total_flows, count(*) FILTER (NOT is_threat) AS benign_flows, count(*) FILTER (is_threat) AS threat_flows,
  round_even(count(*) FILTER (is_threat) * 100.0 / count(*), 2) AS threat_percentage FROM scored GROUP BY 1),
review_sums AS (SELECT case_id, count(*) AS total_reviews, count(*) FILTER (decision = 'Confirmed') AS confirmed, count(*) FILTER (decision = 'Rejected') AS rejected,
  count(*) FILTER (decision = 'Inconclusive') AS inconclusive FROM reviews GROUP BY 1),
advice AS (SELECT * FROM (VALUES {', '.join("('" + c + "', '" + s.replace("'", "''") + f"', {len(a)})" for c, (s, a) in RECOMMENDATIONS.items())}) AS v(predicted_class, summary, n_actions))
"""


def _query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = f"{_CTE} {sql}"
        return f

    return register


_query("packets_with_ports", "SELECT case_id, packet_number, protocol, protocol_number, source_ip, source_port FROM packets WHERE source_port IS NOT NULL")(
    lambda s, d: traffic.with_ports(packets(s, d)).select("case_id", "packet_number", traffic.protocol_name(F.col("protocol_number")).alias("protocol"), traffic.protocol_number(F.col("protocol"), F.col("protocol_number")).alias("protocol_number"), "source_ip", "source_port")
)
_query("canonical_keys", "SELECT packet_number, ip1, p1, ip2, p2, CAST(instr(tcp_flags, 'S') > 0 AS INT) AS s, CAST(instr(tcp_flags, 'A') > 0 AS INT) AS a FROM keyed")(
    lambda s, d: traffic.canonical_key(traffic.with_ports(packets(s, d))).select("packet_number", F.col("low.ip").alias("ip1"), F.col("low.port").alias("p1"), F.col("high.ip").alias("ip2"), F.col("high.port").alias("p2"), traffic.flag("S").alias("s"), traffic.flag("A").alias("a"))
)
_query("traffic_totals", "SELECT case_id, count(*) AS total_packets, CAST(sum(packet_length) AS BIGINT) AS total_bytes FROM packets GROUP BY 1")(lambda s, d: traffic.totals(packets(s, d)))
_query("protocol_counts", "SELECT case_id, protocol, count(*) AS packets FROM packets GROUP BY 1, 2")(lambda s, d: traffic.protocol_counts(packets(s, d)))
_query("protocol_text", "SELECT case_id, string_agg(protocol || ': ' || format('{:,}', n), ', ' ORDER BY protocol) AS protocol_text FROM (SELECT case_id, protocol, count(*) AS n FROM packets GROUP BY 1, 2) GROUP BY 1")(lambda s, d: traffic.protocol_text(packets(s, d)))
for _side in ("source", "destination"):
    _query(f"top_{_side}_ips", f"SELECT case_id, ip, packets, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY case_id ORDER BY packets DESC, f) AS INTEGER) AS rank FROM (SELECT case_id, {_side}_ip AS ip, count(*) AS packets, min(packet_number) AS f FROM packets GROUP BY 1, 2)) WHERE rank <= 5")(
        lambda s, d, c=f"{_side}_ip": traffic.top_ips(packets(s, d), c)
    )

_FLOW = ["case_id", "flow_id", "source_ip", "source_port", "destination_ip", "destination_port", "protocol", "protocol_number", "flow_duration", "total_packets", "total_bytes", "forward_packets", "forward_bytes", "backward_packets", "backward_bytes", "packet_length_min", "packet_length_max", *flows.FLAGS.values()]
_query("flows", f"SELECT {', '.join(_FLOW)}, epoch_us(start_time) AS start_us, epoch_us(end_time) AS end_us, round(packet_length_mean, 6) AS packet_length_mean, CASE WHEN flow_duration > 0 THEN round(total_bytes / (flow_duration / 1e6), 6) ELSE 0.0 END AS bytes_per_second, CASE WHEN flow_duration > 0 THEN round(total_packets / (flow_duration / 1e6), 9) ELSE 0.0 END AS packets_per_second FROM flows")(
    lambda s, d: _flows(s, d).select(*_FLOW, F.unix_micros("start_time").alias("start_us"), F.unix_micros("end_time").alias("end_us"), F.round("packet_length_mean", 6).alias("packet_length_mean"), F.round("bytes_per_second", 6).alias("bytes_per_second"), F.round("packets_per_second", 9).alias("packets_per_second"))
)
_query("flow_counts", "SELECT case_id, count(*) AS total_flows FROM flows GROUP BY 1")(lambda s, d: traffic.flow_counts(_flows(s, d)))
_query("capture_quality", "SELECT p.case_id, p.n AS total_packets, coalesce(f.n, 0) AS total_flows, CASE WHEN p.n = 0 OR f.n IS NULL THEN 'empty' WHEN f.n < 50 THEN 'low' ELSE 'normal' END AS quality FROM (SELECT case_id, count(*) AS n FROM packets GROUP BY 1) p LEFT JOIN (SELECT case_id, count(*) AS n FROM flows GROUP BY 1) f USING (case_id)")(
    lambda s, d: traffic.capture_quality(_flows(s, d), packets(s, d))
)



def _kind(c: str) -> str:
    if "_iat_" in c or c.startswith(("active_", "idle_")):
        return c.rsplit("_", 1)[1]
    return "time" if c == "flow_duration" else "rate" if c in ("flow_packets_s", "flow_bytes_s", "fwd_bulk_rate_avg", "bwd_bulk_rate_avg") else "plain"


def _shown(c: str):
    return {"mean": F.floor(c).cast("double"), "std": F.round(F.col(c) / 1e6, 3), "rate": F.round(c, 6), "plain": F.round(c, 4)}.get(_kind(c), F.col(c))


def _shown_sql(c: str) -> str:
    x = f"CAST(coalesce({c}, 0) AS DOUBLE)"
    return {"mean": f"floor({x})", "std": f"round({x} / 1e6, 3)", "rate": f"round({x}, 6)", "plain": f"round({x}, 4)"}.get(_kind(c), x)


_stats_sql = lambda x, name, where="TRUE": ", ".join(f"coalesce({f}({x}) FILTER ({where}), 0.0) AS {name}_{n}" for f, n in (("max", "max"), ("avg", "mean"), ("min", "min"), ("stddev_samp", "std")))
_FLAG_SQL = ", ".join(f"count(*) FILTER (instr(tcp_flags, '{k}') > 0) AS {n}_flag_count" for n, k in (("fin", "F"), ("syn", "S"), ("rst", "R"), ("psh", "P"), ("ack", "A"), ("urg", "U"), ("cwr", "C"), ("ece", "E")))
_SIDE_SQL = ", ".join(f"count(*) FILTER ({w} AND instr(tcp_flags, '{k}') > 0) AS {d}_{n}_flags" for d, w in (("fwd", "fwd"), ("bwd", "NOT fwd")) for n, k in (("psh", "P"), ("urg", "U")))
_K = "case_id, ip1, p1, ip2, p2, protocol_number"
_on = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in _K.split(", "))
_FEATURES_SQL = f""", timed AS (SELECT *, us - lag(us) OVER w AS iat, us - lag(us) OVER v AS own_iat FROM opened
  WINDOW w AS (PARTITION BY {_K} ORDER BY us, packet_number), v AS (PARTITION BY {_K}, fwd ORDER BY us, packet_number)),
islands AS (SELECT *, sum(CASE WHEN iat > {HOURS} THEN 1 ELSE 0 END) OVER (PARTITION BY {_K} ORDER BY us, packet_number) AS island FROM timed),
spans AS (SELECT {_K}, island, max(us) - min(us) AS span FROM islands GROUP BY {_K}, island),
act AS (SELECT {_K}, {_stats_sql('span', 'active', 'span > 0')} FROM spans GROUP BY {_K}),
idle AS (SELECT {_K}, {_stats_sql('iat', 'idle', f'iat > {HOURS}')} FROM timed GROUP BY {_K}),
full_ AS (SELECT *, CASE WHEN lag(fwd) OVER w = fwd AND us - lag(us) OVER w <= {HOURS} THEN 0 ELSE 1 END AS new FROM opened WHERE payload_length > 0
  WINDOW w AS (PARTITION BY {_K} ORDER BY us, packet_number)),
runs AS (SELECT *, sum(new) OVER (PARTITION BY {_K} ORDER BY us, packet_number) AS island FROM full_),
bulk AS (SELECT {_K}, fwd, island, count(*) AS n, sum(payload_length) AS b, max(us) - min(us) AS us FROM runs GROUP BY {_K}, fwd, island HAVING count(*) >= 3),
bulks AS (SELECT {_K}, {', '.join(f"CASE WHEN count(*) FILTER ({w}) > 0 THEN sum(b) FILTER ({w}) / count(*) FILTER ({w}) ELSE 0.0 END AS {d}_bytes_bulk_avg, CASE WHEN count(*) FILTER ({w}) > 0 THEN sum(n) FILTER ({w}) / count(*) FILTER ({w}) ELSE 0.0 END AS {d}_packet_bulk_avg, CASE WHEN sum(us) FILTER ({w}) > 0 THEN sum(b) FILTER ({w}) / (sum(us) FILTER ({w}) / 1e6) ELSE 0.0 END AS {d}_bulk_rate_avg" for d, w in (("fwd", "fwd"), ("bwd", "NOT fwd")))} FROM bulk GROUP BY {_K}),
base AS (SELECT {_K}, min(packet_number) AS first_packet, any_value(t_port) AS dst_port, max(us) - min(us) AS flow_duration, {_FLAG_SQL}, {_SIDE_SQL},
  count(*) FILTER (fwd) AS total_fwd_packet, count(*) FILTER (NOT fwd) AS total_bwd_packets, coalesce(sum(payload_length) FILTER (fwd), 0) AS total_length_of_fwd_packet, coalesce(sum(payload_length) FILTER (NOT fwd), 0) AS total_length_of_bwd_packet,
  {_stats_sql('payload_length', 'fwd_packet_length', 'fwd')}, {_stats_sql('payload_length', 'bwd_packet_length', 'NOT fwd')}, {_stats_sql('payload_length', 'packet_length')}, coalesce(var_samp(payload_length), 0.0) AS packet_length_variance,
  {_stats_sql('iat', 'flow_iat')}, {_stats_sql('own_iat', 'fwd_iat', 'fwd')}, {_stats_sql('own_iat', 'bwd_iat', 'NOT fwd')}, coalesce(sum(own_iat) FILTER (fwd), 0) AS fwd_iat_total, coalesce(sum(own_iat) FILTER (NOT fwd), 0) AS bwd_iat_total,
  coalesce(sum(header_length) FILTER (fwd), 0) AS fwd_header_length, coalesce(sum(header_length) FILTER (NOT fwd), 0) AS bwd_header_length,
  coalesce(arg_min(tcp_window, packet_number) FILTER (fwd AND tcp_window IS NOT NULL), 0) AS fwd_init_win_bytes, coalesce(arg_min(tcp_window, packet_number) FILTER (NOT fwd AND tcp_window IS NOT NULL), 0) AS bwd_init_win_bytes,
  count(*) FILTER (iat > {HOURS}) AS subflows FROM timed GROUP BY {_K}),
wide AS (SELECT base.*, {', '.join(f'act.active_{n}, idle.idle_{n}' for n in ('max', 'mean', 'min', 'std'))}, {', '.join(f'bulks.{d}_{x}' for d in ('fwd', 'bwd') for x in ('bytes_bulk_avg', 'packet_bulk_avg', 'bulk_rate_avg'))}, base.protocol_number AS protocol,
  (total_length_of_fwd_packet + total_length_of_bwd_packet) / (total_fwd_packet + total_bwd_packets) AS average_packet_size,
  CASE WHEN total_fwd_packet > 0 THEN total_length_of_fwd_packet / total_fwd_packet ELSE 0 END AS fwd_segment_size_avg, CASE WHEN total_bwd_packets > 0 THEN total_length_of_bwd_packet / total_bwd_packets ELSE 0 END AS bwd_segment_size_avg,
  CASE WHEN flow_duration > 0 THEN (total_length_of_fwd_packet + total_length_of_bwd_packet) / (flow_duration / 1e6) ELSE 0 END AS flow_bytes_s, CASE WHEN flow_duration > 0 THEN (total_fwd_packet + total_bwd_packets) / (flow_duration / 1e6) ELSE 0 END AS flow_packets_s,
  CASE WHEN total_fwd_packet > 0 THEN total_bwd_packets / total_fwd_packet ELSE 0 END AS down_up_ratio,
  {', '.join(f"CASE WHEN subflows > 0 THEN {x} / subflows ELSE 0 END AS subflow_{n}" for n, x in (("fwd_bytes", "total_length_of_fwd_packet"), ("fwd_packets", "total_fwd_packet"), ("bwd_bytes", "total_length_of_bwd_packet"), ("bwd_packets", "total_bwd_packets")))},
  row_number() OVER (PARTITION BY base.case_id ORDER BY first_packet) AS flow_id
  FROM base LEFT JOIN act ON {_on('base', 'act')} LEFT JOIN idle ON {_on('base', 'idle')} LEFT JOIN bulks ON {_on('base', 'bulks')})
"""


@_query("flow_features_74", f"{_FEATURES_SQL} SELECT case_id, flow_id, {', '.join(f'{_shown_sql(c)} AS {c}' for c in COLUMNS)} FROM wide")
def flow_features_74(spark: SparkSession, d: str) -> DataFrame:
    """With thresholds at which the fixture's packets, hours apart, show activity and bulks.

    Means of times are shown in whole microseconds and their deviations in milliseconds, where engines agree.
    """
    out = flow_features(packets(spark, d), active_us=HOURS, subflow_us=HOURS, bulk_us=HOURS, bulk_least=3)
    return out.select("case_id", "flow_id", *[_shown(c).alias(c) for c in COLUMNS])


_query("coerced_features", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 0.0 ELSE round(value, 6) END AS x, CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 0 ELSE CAST(trunc(value) AS BIGINT) END AS i, CASE event_id % 4 WHEN 0 THEN 'inf' WHEN 1 THEN '' ELSE 'n' END AS t FROM events")(
    lambda s, d: s.read.parquet(f"{d}/events.parquet").withColumn("raw", F.expr("CASE event_id % 4 WHEN 0 THEN 'inf' WHEN 1 THEN NULL ELSE concat(' ', CAST(value AS STRING), ' ') END")).select("event_id", F.round(scoring.finite(scoring.number(F.col("raw"))), 6).alias("x"), scoring.safe_integer(F.col("raw")).alias("i"), scoring.safe_text(F.when(F.col("event_id") % 4 > 1, "n").otherwise(F.col("raw"))).alias("t"))
)
_query("feature_quality", "SELECT event_type AS feature, count(*) AS invalid FROM events WHERE event_id % 4 < 2 GROUP BY 1")(
    lambda s, d: scoring.quality_report(s.read.parquet(f"{d}/events.parquet").withColumn("raw", F.expr("CASE event_id % 4 WHEN 0 THEN 'inf' WHEN 1 THEN '' ELSE CAST(value AS STRING) END")).select("event_id", "event_type", "raw"), ["event_id", "event_type"], ["raw"]).groupBy(F.col("event_type").alias("feature")).agg(F.count("*").alias("invalid"))
)
_query("standardised", "SELECT case_id, flow_index, " + ", ".join(f"round((x{f} - {STAND_IN[f][1]}) / {STAND_IN[f][2]}, 9) AS z{f}" for f in range(6)) + " FROM rows_")(
    lambda s, d: scoring.model_row(_flows(s, d)).select("case_id", "flow_index", *[F.round((F.col("x_" + snake(n)) - m) / k, 9).alias(f"z{f}") for f, (n, m, k) in enumerate(STAND_IN)])
)
_query("flow_metadata", "SELECT case_id, flow_index, source_ip || '-' || destination_ip || '-' || source_port || '-' || destination_port || '-' || protocol_number AS flow_key, source_ip AS src_ip, strftime(start_time, '%Y-%m-%d %H:%M:%S') AS timestamp FROM rows_")(
    lambda s, d: scoring.model_row(_flows(s, d)).withColumn("m", scoring.metadata()).select("case_id", "flow_index", F.col("m.flow_id").alias("flow_key"), "m.src_ip", "m.timestamp")
)
_query("scored_flows", "SELECT case_id, flow_index, predicted_class, round(confidence, 9) AS confidence, is_threat FROM scored")(lambda s, d: _scored(s, d).select("case_id", "flow_index", "predicted_class", F.round("confidence", 9).alias("confidence"), "is_threat"))
_query("class_probabilities", " UNION ALL ".join(f"SELECT case_id, flow_index, '{n}' AS class_name, round(exp(m{c} - top) / total_exp, 9) AS probability FROM chosen" for c, n in enumerate(CLASSES)))(
    lambda s, d: _scored(s, d).select("case_id", "flow_index", F.explode("probabilities").alias("class_name", "p")).select("case_id", "flow_index", "class_name", F.round("p", 9).alias("probability"))
)
_query("case_summary", "SELECT * FROM summaries")(lambda s, d: scoring.case_summary(_scored(s, d)))
_query("class_counts", "SELECT case_id, predicted_class, flows, CAST(row_number() OVER (PARTITION BY case_id ORDER BY flows DESC, predicted_class) AS INTEGER) AS position FROM (SELECT case_id, predicted_class, count(*) AS flows FROM scored GROUP BY 1, 2)")(lambda s, d: cases.counts_by_size(scoring.class_counts(_scored(s, d))))
_TOPSQL = "SELECT case_id, flow_index, rank, feature, round(raw_value, 6) AS raw_value, round(shap_value, 9) + 0.0 AS shap_value, direction, base_value FROM ranked WHERE rank <= {n}"
for _name, _n in (("top_contributors", 10), ("printed_contributors", 5)):
    _query(_name, _TOPSQL.format(n=_n))(lambda s, d, n=_n: scoring.top_contributors(_contributed(s, d), n).select("case_id", "flow_index", "rank", "feature", F.round("raw_value", 6).alias("raw_value"), F.round("shap_value", 9).alias("shap_value"), "direction", "base_value"))
_query("additivity", "SELECT case_id, flow_index, abs(any_value(base_value) + sum(shap_value) - any_value(top)) < 1e-4 AS adds_up FROM parts GROUP BY 1, 2")(lambda s, d: scoring.additivity(_contributed(s, d)))
_query("global_importance", "SELECT predicted_class, feature, round(mean_abs_shap, 6) AS mean_abs_shap, round(mean_signed_shap, 6) AS mean_signed_shap, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY predicted_class ORDER BY round(mean_abs_shap, 6) DESC, feature_id) AS INTEGER) AS rank FROM (SELECT predicted_class, feature_id, feature, avg(abs(shap_value)) AS mean_abs_shap, avg(shap_value) AS mean_signed_shap FROM parts GROUP BY 1, 2, 3)) WHERE rank <= 12")(
    lambda s, d: scoring.global_importance(_contributed(s, d)).select("predicted_class", "feature", F.round("mean_abs_shap", 6).alias("mean_abs_shap"), F.round("mean_signed_shap", 6).alias("mean_signed_shap"), "rank")
)
_query("importance_sample", "SELECT case_id, flow_index, predicted_class FROM (SELECT *, row_number() OVER (PARTITION BY predicted_class ORDER BY md5(case_id || '/' || flow_index), case_id, flow_index) AS n FROM scored) WHERE n <= 500")(lambda s, d: scoring.stratified_sample(_scored(s, d), 500).select("case_id", "flow_index", "predicted_class"))
_query("explanations", f"SELECT case_id, flow_index, any_value(predicted_class) AS predicted_class, round(any_value(confidence), 9) AS confidence, any_value(base_value) AS base_value, CAST(count(*) AS INTEGER) AS n_contributors, string_agg(rank || ' ' || feature || ' ' || direction, ', ' ORDER BY rank) AS contributors, round(sum(raw_value), 3) AS raw_total, round(sum(shap_value), 6) + 0.0 AS shap_total FROM ranked WHERE rank <= 10 GROUP BY 1, 2")(
    lambda s, d: scoring.explanations(scoring.top_contributors(_contributed(s, d))).select(
        "case_id", "flow_index", "predicted_class", F.round("confidence", 9).alias("confidence"), "base_value", F.size("contributors").alias("n_contributors"),
        F.array_join(F.transform("contributors", lambda x: F.concat_ws(" ", x["rank"].cast("string"), x["feature"], x["direction"])), ", ").alias("contributors"),
        F.round(F.aggregate(F.transform("contributors", lambda x: x["raw_value"]), F.lit(0.0), lambda a, b: a + b), 3).alias("raw_total"),
        (F.round(F.aggregate(F.transform("contributors", lambda x: x["shap_value"]), F.lit(0.0), lambda a, b: a + b), 6) + 0.0).alias("shap_total"))
)
_query("features_by_flow", "SELECT case_id, CAST(count(DISTINCT flow_index) AS INTEGER) AS n_flows, CAST(count(*) AS INTEGER) AS n_features, string_agg(feature, ',' ORDER BY flow_index) FILTER (rank = 1) AS strongest FROM ranked WHERE rank <= 10 GROUP BY 1")(
    lambda s, d: scoring.features_by_flow(scoring.explanations(scoring.top_contributors(_contributed(s, d)))).select(
        "case_id", F.size("top_features_per_flow").alias("n_flows"), F.aggregate(F.map_values("top_features_per_flow"), F.lit(0), lambda a, x: a + F.size(x)).alias("n_features"),
        F.array_join(F.transform(F.array_sort(F.transform(F.map_entries("top_features_per_flow"), lambda e: F.struct(e["key"].cast("long").alias("k"), F.element_at(e["value"], 1)["feature"].alias("f")))), lambda x: x["f"]), ",").alias("strongest"))
)
_HEAD = "'The model classified this network flow as ' || predicted_class || ' with ' || printf('%.2f%%', confidence * 100) || ' confidence. The strongest SHAP contributor was \"' || feature || '\". Its observed value ' || CASE direction WHEN 'supports_prediction' THEN 'supported' WHEN 'opposes_prediction' THEN 'opposed' ELSE 'had a neutral effect on' END || ' the predicted class. The table below lists the most influential features for this prediction.'"
_query("headlines", f"SELECT case_id, flow_index, feature AS strongest, CASE direction WHEN 'supports_prediction' THEN 'Supports' WHEN 'opposes_prediction' THEN 'Opposes' ELSE 'Neutral' END AS effect, {_HEAD} AS headline FROM ranked WHERE rank = 1")(
    lambda s, d: scoring.explanations(scoring.top_contributors(_contributed(s, d))).withColumn("top", F.col("contributors")[0]).select("case_id", "flow_index", F.col("top.feature").alias("strongest"), scoring.direction_label(F.col("top.direction")).alias("effect"), T.headline(F.col("predicted_class"), F.col("confidence"), F.col("top")).alias("headline"))
)
_query("narrations", "SELECT case_id, flow_index, 'The XGBoost classifier predicted ''' || any_value(predicted_class) || '''.' || coalesce(' The strongest TreeSHAP features supporting this prediction were ' || array_to_string((list(feature ORDER BY rank) FILTER (shap_value > 0))[1:3], ', ') || '.', '') || coalesce(' Features that opposed the prediction included ' || array_to_string((list(feature ORDER BY rank) FILTER (shap_value < 0))[1:2], ', ') || '.', '') AS narration FROM ranked WHERE rank <= 10 GROUP BY 1, 2")(
    lambda s, d: scoring.explanations(scoring.top_contributors(_contributed(s, d))).select("case_id", "flow_index", T.narration(F.col("predicted_class"), F.col("contributors")).alias("narration"))
)
_LINE = "'- ' || feature || ': value ' || format('{:.6g}', raw_value) || ', contribution ' || format('{:.6g}', shap_value) || ', ' || direction"
_query("prompts", f"SELECT case_id, flow_index, 'Explain only from these facts.' || chr(10) || 'Predicted class: ' || any_value(predicted_class) || chr(10) || 'Confidence: ' || printf('%.2f%%', any_value(confidence) * 100) || chr(10) || string_agg({_LINE}, chr(10) ORDER BY rank) AS prompt FROM ranked WHERE rank <= 5 GROUP BY 1, 2")(lambda s, d: scoring.explanations(scoring.top_contributors(_contributed(s, d))).select("case_id", "flow_index", T.prompt(F.col("predicted_class"), F.col("confidence"), F.col("contributors")).alias("prompt")))
_query("recommended", "SELECT s.case_id, s.flow_index, s.predicted_class, a.summary, a.n_actions FROM scored s LEFT JOIN advice a USING (predicted_class)")(lambda s, d: cases.recommend(_scored(s, d)).select("case_id", "flow_index", "predicted_class", "summary", F.size("actions").alias("n_actions")))
_query("explained_threats", "SELECT s.case_id, s.flow_index, s.predicted_class, r.n AS n_contributors FROM scored s LEFT JOIN (SELECT case_id, flow_index, count(*) AS n FROM ranked WHERE rank <= 10 GROUP BY 1, 2) r USING (case_id, flow_index) WHERE s.is_threat")(
    lambda s, d: cases.with_explanations(_scored(s, d).where("is_threat"), scoring.explanations(scoring.top_contributors(_contributed(s, d)))).select("case_id", "flow_index", "predicted_class", F.size("contributors").cast("long").alias("n_contributors"))
)
_query("looked_up_findings", "SELECT k.case_id, k.flow_index, s.predicted_class, n AS n_contributors, s.case_id IS NOT NULL AS found FROM (SELECT DISTINCT case_id, flow_index FROM log) k LEFT JOIN scored s ON s.case_id = k.case_id AND s.flow_index = k.flow_index LEFT JOIN (SELECT case_id, flow_index, count(*) AS n FROM ranked WHERE rank <= 10 GROUP BY 1, 2) r ON r.case_id = k.case_id AND r.flow_index = k.flow_index")(
    lambda s, d: cases.look_up(review_log(s, d), _scored(s, d), scoring.explanations(scoring.top_contributors(_contributed(s, d)))).select("case_id", "flow_index", "predicted_class", F.size("contributors").cast("long").alias("n_contributors"), "found")
)


@_query("explanation_faults", "SELECT case_id, flow_index, CASE WHEN flow_index % 7 = 3 THEN 'missing' WHEN flow_index % 7 = 4 THEN 'width' WHEN flow_index % 7 = 5 THEN 'not finite' ELSE 'unknown class' END AS fault FROM scored WHERE flow_index % 7 BETWEEN 3 AND 6")
def explanation_faults(spark: SparkSession, d: str) -> DataFrame:
    """The faults of explanations that are spoiled by flow: none at all, one feature less, a value that is no number, an unknown class."""
    scored, k = _scored(spark, d), F.col("flow_index") % 7
    parts = scoring.contributions(scored).where((k != 3) & ((k != 4) | (F.col("feature_id") > 0)))
    parts = parts.withColumn("shap_value", F.when((k == 5) & (F.col("feature_id") == 2), float("nan")).otherwise(F.col("shap_value")))
    return scoring.explanation_faults(scored.withColumn("predicted_class", F.when(k == 6, "Unheard").otherwise(F.col("predicted_class"))), parts)


_query("validated_reviews", "SELECT event_id, trim(notes) AS notes, CASE WHEN decision = 'Maybe' THEN 'decision invalid' END AS reason FROM log")(lambda s, d: cases.validate_reviews(review_log(s, d)).select("event_id", "notes", "reason"))
_query("upserted_reviews", "SELECT case_id, flow_index, decision, notes, event_id FROM newest")(lambda s, d: cases.upsert(_good_log(s, d)).select("case_id", "flow_index", "decision", "notes", "event_id"))
_query("reviews_of_findings", "SELECT case_id, flow_index, decision, predicted_class FROM reviews")(lambda s, d: _reviews(s, d).select("case_id", "flow_index", "decision", "predicted_class"))
_query("reviews_without_finding", "SELECT case_id, flow_index, decision FROM newest n WHERE NOT EXISTS (SELECT 1 FROM scored s WHERE s.case_id = n.case_id AND s.flow_index = n.flow_index)")(lambda s, d: cases.reviews_without_finding(cases.upsert(_good_log(s, d)), _scored(s, d)).select("case_id", "flow_index", "decision"))
_T = "case_id, flow_index, predicted_class, priority, priority_rank, source, destination, review"
_query("triage_rows", f"SELECT {_T}, CAST(row_number() OVER (PARTITION BY case_id ORDER BY review <> 'Unreviewed', round(confidence, 9) DESC, flow_index) AS INTEGER) AS position FROM triage")(lambda s, d: cases.triage_order(_triage(s, d)).drop("confidence"))
_query("triage_search", f"SELECT {_T} FROM triage WHERE lower(predicted_class) LIKE '%over%' OR source LIKE '%over%' OR destination LIKE '%over%'")(lambda s, d: cases.search(_triage(s, d), " OVER ").drop("confidence"))
_query("triage_facets", f"SELECT {_T} FROM triage WHERE review = 'Unreviewed' AND priority = 'Low'")(lambda s, d: cases.facets(_triage(s, d), review="unreviewed", predicted_class="All Classes", priority="low").drop("confidence"))
_query("facet_classes", "SELECT DISTINCT case_id, predicted_class FROM triage")(lambda s, d: cases.class_values(_triage(s, d)))
_query("next_unreviewed", "SELECT case_id, flow_index, predicted_class FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY round(confidence, 9) DESC, flow_index) AS n FROM triage WHERE review = 'Unreviewed') WHERE n = 1")(lambda s, d: cases.next_unreviewed(_triage(s, d)).select("case_id", "flow_index", "predicted_class"))
_query("class_distribution", "SELECT case_id, predicted_class, flows, round_even(flows * 100.0 / sum(flows) OVER (PARTITION BY case_id), 4) AS percent, CAST(row_number() OVER (PARTITION BY case_id ORDER BY predicted_class <> 'Benign', flows DESC, lower(predicted_class)) AS INTEGER) AS position FROM (SELECT case_id, predicted_class, count(*) AS flows FROM scored GROUP BY 1, 2)")(lambda s, d: cases.class_distribution(_scored(s, d)))


@_query("summary_agrees", "SELECT s.case_id, s.total_flows = coalesce(f.n, 0) AND s.threat_flows = coalesce(f.t, 0) AS consistent FROM summaries s LEFT JOIN (SELECT case_id, count(*) AS n, count(*) FILTER (is_threat) AS t FROM scored WHERE NOT (right(case_id, 8) = '3-000000' AND flow_index = 0) AND right(case_id, 8) <> '5-000000' GROUP BY 1) f USING (case_id)")
def summary_agrees(spark: SparkSession, d: str) -> DataFrame:
    """Stored summaries against findings of which some cases lack one flow, and some lack all."""
    scored = _scored(spark, d)
    left = scored.where(~(F.col("case_id").endswith("3-000000") & (F.col("flow_index") == 0)) & ~F.col("case_id").endswith("5-000000"))
    return cases.summary_agrees(scoring.case_summary(scored), left)


_query("review_summary", "SELECT * FROM review_sums")(lambda s, d: cases.review_summary(_reviews(s, d)))
_query("triage_counts", "SELECT *, threats - reviewed AS unreviewed, CASE WHEN threats > 0 THEN round_even(reviewed * 100.0 / threats, 4) ELSE 0.0 END AS completion FROM (SELECT case_id, count(*) AS threats, count(*) FILTER (review = 'Confirmed') AS confirmed, count(*) FILTER (review = 'Rejected') AS rejected, count(*) FILTER (review = 'Inconclusive') AS inconclusive, count(*) FILTER (review <> 'Unreviewed') AS reviewed FROM triage GROUP BY 1)")(lambda s, d: cases.triage_counts(_triage(s, d)))
_query("report_status", "SELECT case_id, u AS unreviewed, CASE WHEN t = 0 THEN 'Report loaded successfully. No threat flows were identified.' WHEN u = 0 THEN 'Report loaded successfully. All ' || t || ' detected threat flows have investigator reviews.' ELSE 'Report loaded successfully. ' || n || ' of ' || t || ' detected threat flows have investigator reviews. ' || u || ' remain unreviewed.' END AS status FROM (SELECT case_id, threat_flows AS t, coalesce(total_reviews, 0) AS n, greatest(0, threat_flows - coalesce(total_reviews, 0)) AS u FROM summaries LEFT JOIN review_sums USING (case_id))")(lambda s, d: cases.report_status(scoring.case_summary(_scored(s, d)), _reviews(s, d)))
_query("report_rows", "SELECT s.case_id, s.flow_index, s.predicted_class, round(s.confidence, 9) AS confidence, coalesce(r.decision, 'Not Reviewed') AS review, coalesce(nullif(trim(r.notes), ''), '--') AS notes, a.summary AS recommendation, a.n_actions FROM scored s LEFT JOIN reviews r USING (case_id, flow_index) LEFT JOIN advice a ON a.predicted_class = s.predicted_class WHERE s.is_threat")(lambda s, d: cases.report_rows(_scored(s, d), _newest(s, d)).withColumn("confidence", F.round("confidence", 9)))
_query("case_reports", "SELECT m.case_id, m.total_flows, m.benign_flows, m.threat_flows, m.threat_percentage, r.total_reviews, r.confirmed, r.rejected, r.inconclusive, CAST(coalesce(t.n, 0) AS INTEGER) AS n_threats, coalesce(t.listed, '') AS listed FROM summaries m LEFT JOIN review_sums r USING (case_id) LEFT JOIN (SELECT s.case_id, count(*) AS n, string_agg(s.flow_index || ' ' || s.predicted_class || ' ' || coalesce(v.decision, 'Not Reviewed') || ' ' || coalesce(nullif(trim(v.notes), ''), '--') || ' ' || a.summary, chr(10) ORDER BY s.flow_index) AS listed FROM scored s LEFT JOIN reviews v USING (case_id, flow_index) LEFT JOIN advice a ON a.predicted_class = s.predicted_class WHERE s.is_threat GROUP BY 1) t USING (case_id)")(
    lambda s, d: _case_reports(s, d).select(
        "case_id", "total_flows", "benign_flows", "threat_flows", "threat_percentage", "total_reviews", "confirmed", "rejected", "inconclusive", F.greatest(F.lit(0), F.size("threats")).alias("n_threats"),
        F.coalesce(F.array_join(F.transform("threats", lambda x: F.concat_ws(" ", x["flow_index"].cast("string"), x["predicted_class"], x["review"], x["notes"], x["recommendation"])), "\n"), F.lit("")).alias("listed"))
)


@_query("run_summary", "SELECT s.case_id, p.total_packets, p.total_bytes, s.total_flows, s.threat_flows, s.threat_percentage, e.n AS explanations, e.n AS recommendations FROM summaries s JOIN (SELECT case_id, count(*) AS total_packets, CAST(sum(packet_length) AS BIGINT) AS total_bytes FROM packets GROUP BY 1) p USING (case_id) JOIN (SELECT case_id, count(*) AS n FROM scored GROUP BY 1) e USING (case_id)")
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    scored = _scored(spark, d)
    told = cases.recommend(scored).groupBy("case_id").agg(F.count("summary").alias("recommendations"))
    explained = _contributed(spark, d).groupBy("case_id").agg(F.count_distinct("flow_index").alias("explanations"))
    out = traffic.totals(packets(spark, d)).join(scoring.case_summary(scored).drop("benign_flows"), "case_id")
    return out.join(explained, "case_id").join(told, "case_id")


_query("text_expressions", "SELECT event_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.2f KB', round(n / 1024.0, 2)) ELSE printf('%.2f MB', round(n / 1048576.0, 2)) END AS size, CASE WHEN n < 1024 THEN format('{:,}', n) || ' bytes' WHEN n < 1048576 THEN format('{:,.2f}', n / 1024.0) || ' KB' ELSE format('{:,.2f}', n / 1048576.0) || ' MB' END AS report_size, 'FX-' || strftime(ts, '%Y%m%d-%H%M%S') AS case_id, TRUE AS valid, lower(event_type) AS k, CASE WHEN event_id % 3 = 0 THEN 'Unknown' WHEN event_id % 3 = 1 THEN event_type ELSE event_type || ':443' END AS endpoint, CASE WHEN event_id % 3 = 0 THEN '--' WHEN event_id % 3 = 1 THEN event_type ELSE event_type || ':443' END AS triage_endpoint FROM (SELECT *, event_id * 37 AS n FROM events)")(
    lambda s, d: s.read.parquet(f"{d}/events.parquet").withColumn("n", F.col("event_id") * 37).withColumn("ip", F.when(F.col("event_id") % 3 > 0, F.col("event_type")).otherwise(" ")).withColumn("port", F.when(F.col("event_id") % 3 == 2, 443)).select(
        "event_id", T.byte_size(F.col("n")).alias("size"), T.report_size(F.col("n")).alias("report_size"), T.case_id(F.col("ts").cast("timestamp")).alias("case_id"), T.is_case_id(T.case_id(F.col("ts").cast("timestamp"))).alias("valid"), T.class_key(F.concat(F.lit("_"), F.col("event_type"), F.lit("- "))).alias("k"),
        T.dashboard_endpoint(F.col("ip"), F.col("port")).alias("endpoint"), T.triage_endpoint(F.col("ip"), F.col("port")).alias("triage_endpoint"))
)


@_query("case_catalog", "SELECT p.case_id, CASE WHEN right(p.case_id, 8) = '1-000000' THEN 'Incomplete' ELSE 'Analyzed' END AS status, coalesce(r.total_reviews, 0) AS total_reviews, right(p.case_id, 8) <> '1-000000' AS openable FROM (SELECT DISTINCT case_id FROM packets) p LEFT JOIN review_sums r USING (case_id)")
def case_catalog(spark: SparkSession, d: str) -> DataFrame:
    """The catalog; cases of days that end in 1 stand for those not analysed yet."""
    scored = _scored(spark, d)
    documents = scoring.case_summary(scored.where(~F.col("case_id").endswith("1-000000"))).select("case_id", "total_flows", F.lit(True).alias("has_document"), F.lit(True).alias("readable"))
    return cases.case_catalog(packets(spark, d).select("case_id").distinct(), documents, _reviews(spark, d)).select("case_id", "status", "total_reviews", "openable")


@_query("case_details", "SELECT p.case_id, s.total_flows, s.benign_flows, s.threat_flows, s.threat_percentage, coalesce(r.total_reviews, 0) AS total_reviews, coalesce(r.confirmed, 0) AS confirmed, coalesce(r.rejected, 0) AS rejected, coalesce(r.inconclusive, 0) AS inconclusive FROM (SELECT DISTINCT case_id FROM packets) p LEFT JOIN summaries s USING (case_id) LEFT JOIN review_sums r USING (case_id)")
def case_details(spark: SparkSession, d: str) -> DataFrame:
    summary, reviews = scoring.case_summary(_scored(spark, d)), _reviews(spark, d)
    documents = summary.select("case_id", "total_flows", F.lit(True).alias("has_document"), F.lit(True).alias("readable"))
    catalog = cases.case_catalog(packets(spark, d).select("case_id").distinct(), documents, reviews)
    return cases.case_details(catalog.select("case_id", "total_reviews"), summary, reviews)


#: A small ensemble over total_packets, packet_length_mean and syn_count: tree, node, class_id, feature, threshold, left, right, value.
ENSEMBLE = (
    (0, 0, 0, 0, 3.0, 1, 2, 0.0), (0, 1, 0, 1, 120.0, 3, 4, 0.0), (0, 2, 0, -1, 0.0, 0, 0, -1.5), (0, 3, 0, -1, 0.0, 0, 0, 2.0), (0, 4, 0, -1, 0.0, 0, 0, 0.25),
    (1, 0, 1, 2, 1.0, 1, 2, 0.0), (1, 1, 1, -1, 0.0, 0, 0, -0.5), (1, 2, 1, -1, 0.0, 0, 0, 1.0), (2, 0, 2, 1, 90.0, 1, 2, 0.0), (2, 1, 2, -1, 0.0, 0, 0, 1.5), (2, 2, 2, -1, 0.0, 0, 0, 0.5),
)


@_query("tree_scored", "SELECT case_id, flow_id, m0, m1, m2, CASE WHEN m0 >= m1 AND m0 >= m2 THEN 0 WHEN m1 >= m2 THEN 1 ELSE 2 END AS class_id FROM (SELECT case_id, flow_id, CASE WHEN total_packets >= 3 THEN -1.5 WHEN packet_length_mean < 120 THEN 2.0 ELSE 0.25 END::DOUBLE AS m0, CASE WHEN syn_count < 1 THEN -0.5 ELSE 1.0 END::DOUBLE AS m1, CASE WHEN packet_length_mean < 90 THEN 1.5 ELSE 0.5 END::DOUBLE AS m2 FROM flows)")
def tree_scored(spark: SparkSession, d: str) -> DataFrame:
    """Margins and class of every flow under a small tree ensemble."""
    nodes = spark.createDataFrame(ENSEMBLE, "tree int, node int, class_id int, feature int, threshold double, left int, right int, value double")
    x = F.array(*[F.col(c).cast("double") for c in ("total_packets", "packet_length_mean", "syn_count")])
    out = trees.predicted(trees.tree_margins(_flows(spark, d).select("case_id", "flow_id", x.alias("x")), "x", nodes, 3))
    return out.select("case_id", "flow_id", *[F.col("margins")[c].alias(f"m{c}") for c in range(3)], "class_id")


# ---- the 74 features, scaled and scored by a model given as tables
def stand_in_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Weights and biases of a stand-in for the trained model, over all 74 features, by the rule of `schema.weight`."""
    classes = list(enumerate(CLASSES))
    weights = spark.createDataFrame([(c, name, f, weight(c, f) / 10) for c, name in classes for f in range(len(COLUMNS))], model.WEIGHTS)
    return weights, spark.createDataFrame([(c, name, bias(c)) for c, name in classes], model.BIASES)


def _features(spark, d):
    """Features kept once: the scaler is fitted to them before they are scored."""
    return checkpointed(flow_features(packets(spark, d), active_us=HOURS, subflow_us=HOURS, bulk_us=HOURS, bulk_least=3))


def _scored_features(spark, d):
    features = _features(spark, d)
    bundle = model.load_model(model.fit_scaler(features, COLUMNS), *stand_in_tables(spark))
    return model.score_features(model.described(features, _flows(spark, d)), bundle), bundle


_X = ", ".join(f"CAST(coalesce({c}, 0) AS DOUBLE) AS {c}" for c in COLUMNS)
_MODEL_SQL = f"""{_FEATURES_SQL}, xs AS (SELECT case_id, flow_id - 1 AS flow_index, {_X} FROM wide),
scaler AS (SELECT {', '.join(f"avg({c}) AS mean_{c}, CASE WHEN stddev_pop({c}) > 1e-9 * (1 + abs(avg({c}))) THEN stddev_pop({c}) ELSE 1.0 END AS scale_{c}" for c in COLUMNS)} FROM xs),
zs AS (SELECT case_id, flow_index, {', '.join(f"({c} - mean_{c}) / scale_{c} AS z{f}, {c} AS r{f}" for f, c in enumerate(COLUMNS))} FROM xs, scaler),
ms AS (SELECT *, {', '.join(f"round({bias(c)} + " + ' + '.join(f"({weight(c, f) / 10}) * z{f}" for f in range(len(COLUMNS))) + f", 9) AS m{c}" for c in range(16))} FROM zs),
tops AS (SELECT *, {_TOP} AS top FROM ms), named AS (SELECT *, {_CLASS_ID} AS class_id, {_SUM} AS total_exp FROM tops)"""
_query("scored_features", f"{_MODEL_SQL} SELECT case_id, flow_index, {_NAME} AS predicted_class, round(1.0 / total_exp, 6) AS confidence, class_id <> 1 AS is_threat FROM named")(
    lambda s, d: _scored_features(s, d)[0].select("case_id", "flow_index", "predicted_class", F.round("confidence", 6).alias("confidence"), "is_threat")
)
_query("scaled_features", f"{_MODEL_SQL} SELECT case_id, flow_index, {', '.join(f'round(z{f}, 5) + 0.0 AS {c}' for f, c in enumerate(COLUMNS))} FROM zs")(
    lambda s, d: (lambda x: model.scale(x.withColumn("flow_index", F.col("flow_id") - 1), model.fit_scaler(x, COLUMNS), ("case_id", "flow_index")).select("case_id", "flow_index", *[(F.round(c, 5) + 0.0).alias(c) for c in COLUMNS]))(_features(s, d))
)


@_query("feature_contributions", f"{_MODEL_SQL}, cs AS ({' UNION ALL '.join(f'SELECT case_id, flow_index, class_id, {f} AS feature_id, r{f} AS raw, ((class_id * 7 + {f} * 13 + class_id * {f} * 3) % 11 - 5) / 100.0 * z{f} AS shap FROM named' for f in range(len(COLUMNS)))}) SELECT case_id, flow_index, count(*) AS n, count(*) FILTER (round(shap, 6) > 0) AS supporting, round(sum(shap), 5) + 0.0 AS shap_total FROM cs GROUP BY 1, 2")
def feature_contributions(spark: SparkSession, d: str) -> DataFrame:
    """What all 74 features add to the margin of each flow's class, summed up by flow."""
    scored, bundle = _scored_features(spark, d)
    out = model.feature_contributions(scored, bundle).groupBy("case_id", "flow_index")
    return out.agg(F.count("*").alias("n"), F.count_if(F.round("shap_value", 6) > 0).alias("supporting"), (F.round(F.sum("shap_value"), 5) + 0.0).alias("shap_total"))


# ---- files: what is written for the fixture's cases is read back
@_query("features_from_file", "SELECT case_id, flow_id - 1 AS flow_index, CAST(flow_duration AS DOUBLE) AS flow_duration, CAST(total_packets AS DOUBLE) AS total_packets, 'extra' AS status FROM flows")
def features_from_file(spark: SparkSession, d: str) -> DataFrame:
    """A feature file of flows, written as CSV by case, read as text, and its columns held against the contract."""
    path = new_folder(spark, "features")
    rows = _flows(spark, d).select("case_id", F.col("flow_id").alias(" Flow ID "), F.col("flow_duration").alias("Flow Duration"), F.col("total_packets").alias("packets "))
    captures.write_features(rows, path)
    read = captures.read_features(spark, path)
    report = scoring.contract_report(read, ("Flow Duration", "ACK Flag Count")).where("column = 'packets'").select("status")
    out = scoring.ordered_features(read, ("Flow ID", "Flow Duration", "packets"), ("case_id",))
    number = lambda c: scoring.finite(scoring.number(F.col(c)))
    return out.select("case_id", (scoring.safe_integer(F.col("Flow ID")) - 1).alias("flow_index"), number("Flow Duration").alias("flow_duration"), number("packets").alias("total_packets")).join(F.broadcast(report))


_DOCUMENT_STATE = "CASE right(case_id, 8) WHEN '1-000000' THEN 'Incomplete' WHEN '2-000000' THEN 'Invalid' WHEN '3-000000' THEN 'Invalid' WHEN '4-000000' THEN 'Error' ELSE 'Analyzed' END"


@_query("catalog_from_documents", f"SELECT p.case_id, {_DOCUMENT_STATE} AS status, {_DOCUMENT_STATE} = 'Analyzed' AS openable, CASE WHEN {_DOCUMENT_STATE} = 'Analyzed' THEN s.total_flows END AS total_flows, CASE WHEN {_DOCUMENT_STATE} = 'Analyzed' THEN p.case_id || '.pcap' ELSE 'found.pcap' END AS file_name FROM (SELECT DISTINCT case_id FROM packets) p LEFT JOIN summaries s USING (case_id)")
def catalog_from_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents of cases written and read back: by the last digit of their day none, an empty one, a broken one, one without an analysis."""
    path, day = new_folder(spark, "documents"), F.substring("case_id", -8, 1)
    whole = F.to_json(F.struct("case_id", F.concat("case_id", F.lit(".pcap")).alias("file_name"), F.struct(F.struct("total_flows", "threat_flows").alias("summary")).alias("ml_analysis")))
    text = F.when(day == "2", "").when(day == "3", '{"case_id": ').when(day == "4", "{}").otherwise(whole)
    rows = scoring.case_summary(_scored(spark, d)).where(day != "1").select("case_id", text.alias("value")).repartition("case_id")
    rows.write.option("lineSep", " ").partitionBy("case_id").text(path)  # the empty one is a blank
    documents = captures.read_documents(spark, path).withColumn("case_id", F.regexp_replace("case_id", "^case_id=", ""))
    seen = packets(spark, d).select("case_id").distinct()
    names = cases.evidence_name(documents.select("case_id", "doc.file_name"), seen.withColumn("file_name", F.lit("found.pcap")))
    none = spark.createDataFrame([], "case_id string, decision string")
    return cases.case_catalog(seen, documents, none).join(names, "case_id").select("case_id", "status", "openable", "total_flows", "file_name")


@_query("stored_reviews", "SELECT case_id, flow_index, predicted_class, decision, notes FROM reviews")
def stored_reviews(spark: SparkSession, d: str) -> DataFrame:
    """Reviews written by case, one case replaced by itself, and read back."""
    path, columns = new_folder(spark, "reviews"), ["case_id", "flow_index", "predicted_class", "decision", "notes", "review_timestamp"]
    rows = _reviews(spark, d).select(*columns)
    captures.write_case(rows, path)
    captures.write_case(rows.where(F.col("case_id").endswith("5-000000")), path)
    return captures.read_reviews(spark, path).select("case_id", "flow_index", "predicted_class", "decision", "notes")


@_query("written_reports", "SELECT m.case_id, m.threat_flows, coalesce(t.n, 0) AS n_threats FROM summaries m LEFT JOIN (SELECT case_id, count(*) AS n FROM scored WHERE is_threat GROUP BY 1) t USING (case_id)")
def written_reports(spark: SparkSession, d: str) -> DataFrame:
    """Reports written as a JSON line by case and read back."""
    path = new_folder(spark, "reports")
    captures.write_reports(_case_reports(spark, d), path)
    out = spark.read.text(path).select("case_id", F.from_json("value", "threat_flows long, threats array<struct<flow_index: long>>").alias("r"))
    return out.select("case_id", "r.threat_flows", F.greatest(F.lit(0), F.size("r.threats")).cast("long").alias("n_threats"))


@_query("importance_from_file", "SELECT predicted_class AS class_name, feature, round(avg(abs(shap_value)), 6) AS mean_abs_shap, round(avg(shap_value), 6) + 0.0 AS mean_signed_shap FROM parts GROUP BY predicted_class, feature_id, feature")
def importance_from_file(spark: SparkSession, d: str) -> DataFrame:
    """Global importance as a document nested by class, written and read back."""
    path = new_folder(spark, "importance")
    rows = scoring.global_importance(_contributed(spark, d)).groupBy("predicted_class").agg(F.collect_list(F.struct("feature", "mean_abs_shap", "mean_signed_shap")).alias("rows"))
    rows.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("predicted_class", "rows"))).alias("classes")).select(F.to_json(F.struct("classes")).alias("value")).write.text(path)
    return captures.read_importance(spark, path).select("class_name", "feature", F.round("mean_abs_shap", 6).alias("mean_abs_shap"), (F.round("mean_signed_shap", 6) + 0.0).alias("mean_signed_shap"))


@_query("audited_files", "SELECT 'f' || b AS file_name, CASE b WHEN 1 THEN 'missing' WHEN 2 THEN 'size differs' WHEN 3 THEN 'hash differs' ELSE 'ok' END AS status, CAST(n AS BIGINT) AS n FROM (SELECT event_id % 5 AS b, count(*) AS n FROM events GROUP BY 1)")
def audited_files(spark: SparkSession, d: str) -> DataFrame:
    """Files of events against a manifest of which one entry has no file, one another size and one another hash."""
    path = new_folder(spark, "evidence")
    events = spark.read.parquet(f"{d}/events.parquet").select(F.concat(F.lit("f"), F.col("event_id") % 5).alias("file"), F.col("event_id").cast("string").alias("value"))
    counts = events.groupBy(F.col("file").alias("file_name")).agg(F.count("*").alias("n"))
    events.repartition(5, "file").sortWithinPartitions("file").where("file <> 'f1'").write.partitionBy("file").text(path)
    have = captures.evidence_catalog(spark, path, by_folder=True)
    manifest = have.select("file_name", (F.col("file_size") + (F.col("file_name") == "f2").cast("int")).alias("file_size"), F.when(F.col("file_name") == "f3", F.repeat(F.lit("0"), 64)).otherwise(F.col("sha256")).alias("sha256"))
    manifest = manifest.unionByName(spark.createDataFrame([("f1", 1, None)], "file_name string, file_size long, sha256 string"))
    return captures.audit_files(spark, path, manifest, by_folder=True).join(counts, "file_name")
