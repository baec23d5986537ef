"""Packet and review tables out of the driver's event table, by one SQL text for two engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SPARK = {"day": "date_format(ts, 'yyyyMMdd')", "S": "STRING", "k": "CAST(get_json_object(props, '$.k') AS INT)", "time": "CAST(ts AS TIMESTAMP)"}
DUCKDB = {"day": "strftime(ts, '%Y%m%d')", "S": "VARCHAR", "k": "CAST(json_extract_string(props, '$.k') AS INT)", "time": "ts"}

PACKETS_SQL = """
SELECT *, CASE protocol WHEN 'TCP' THEN 20 WHEN 'UDP' THEN 8 ELSE 0 END AS header_length, packet_length - 40 AS payload_length,
  CASE WHEN protocol = 'TCP' THEN 1000 + CAST(packet_number % 64000 AS INT) END AS tcp_window
FROM (
  SELECT concat('FX-', <day>, '-000000') AS case_id, event_id + 1 AS packet_number, <time> AS timestamp,
    CASE WHEN rev THEN sip ELSE cip END AS source_ip, CASE WHEN rev THEN cip ELSE sip END AS destination_ip,
    CASE event_type WHEN 'error' THEN 'OTHER' WHEN 'signup' THEN 'UDP' ELSE 'TCP' END AS protocol,
    CASE event_type WHEN 'error' THEN 1 WHEN 'signup' THEN 17 ELSE 6 END AS protocol_number,
    CASE WHEN event_type = 'error' THEN NULL WHEN rev THEN sport ELSE cport END AS source_port,
    CASE WHEN event_type = 'error' THEN NULL WHEN rev THEN cport ELSE sport END AS destination_port,
    40 + CAST(floor(value) AS BIGINT) AS packet_length,
    CASE WHEN event_type IN ('error', 'signup') THEN '' ELSE CASE event_id % 5 WHEN 0 THEN 'S' WHEN 1 THEN 'SA' WHEN 2 THEN 'A' WHEN 3 THEN 'PA'
      ELSE CASE WHEN event_id % 2 = 0 THEN 'FA' ELSE 'RA' END END END AS tcp_flags
  FROM (
    SELECT *, event_id % 3 = 0 AS rev,
      concat('10.0.0.', CAST(user_id % (CASE WHEN day(ts) % 2 = 1 THEN 4 ELSE 16 END) + 1 AS <S>)) AS cip,
      concat('192.168.1.', CAST(<k> % 3 + 1 AS <S>)) AS sip,
      CAST(40000 + user_id % (CASE WHEN day(ts) % 2 = 1 THEN 4 ELSE 16 END) AS INT) AS cport,
      CASE WHEN event_type = 'signup' THEN 53 ELSE 443 END AS sport FROM <events>) e) p
"""
REVIEWS_SQL = """
SELECT event_id, concat('FX-', <day>, '-000000') AS case_id, event_id % 40 AS flow_index,
  CASE event_id % 4 WHEN 0 THEN 'Confirmed' WHEN 1 THEN 'Rejected' WHEN 2 THEN 'Inconclusive' ELSE 'Maybe' END AS decision,
  concat('  ', props, ' ') AS notes, <time> AS review_timestamp
FROM <events> WHERE event_id % 5 = 0
"""


def fill(sql: str, words: dict[str, str], events: str = "events") -> str:
    for key, value in (words | {"events": events}).items():
        sql = sql.replace(f"<{key}>", value)
    return sql


def _of(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(fill(sql, SPARK, "{events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of(spark, sf_dir, PACKETS_SQL)


def review_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of(spark, sf_dir, REVIEWS_SQL)
