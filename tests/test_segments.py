"""Hot flows cut into segments give what whole flows give, and numbers of flows need no second reading of packets."""

import random
import re

import pytest
from pyspark.sql import functions as F

from netsift.operators import flows
from netsift.operators.features import directed, flow_features, flow_starts
from netsift.operators.segments import hot_flows, segmented
from netsift.schema import COLUMNS, PACKETS
from netsift.sources.fixtures import packets

SF = "/root/testdata/sf0.001"


def crowd(seed, n, ties):
    """Packets of few flows: bursts and pauses, times out of order, many at one time, empty payloads, equal endpoints."""
    import datetime as dt

    rnd, at, out = random.Random(seed), 0, []
    zero = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    for number in range(1, n + 1):
        if rnd.random() > ties:
            at += rnd.choice([1, 50, 300, 1200, 2500, 7000, 40_000])
        a, b = rnd.choice([(("10.0.0.1", 5), ("10.0.0.2", 80))] * 8 + [(("10.0.0.3", 7), ("10.0.0.3", 7)), (("10.0.0.9", 1), ("10.0.0.2", 53))])
        if rnd.random() < rnd.choice([0.1, 0.9]):
            a, b = b, a
        late = at - rnd.choice([0, 0, 0, 3000])
        out.append(("FX-20240101-000000", number, zero + dt.timedelta(microseconds=max(0, late)), a[0], b[0], "TCP", 6, a[1], b[1], 100, rnd.choice(["", "S", "PA", "U"]), 20, rnd.choice([0, 0, 60, 60, 500]), rnd.randrange(9) * 100))
    return out


def rounded(df):
    return sorted(tuple(v if isinstance(v, str) else round(v, 6) if abs(v) < 1e6 else round(v, 1) for v in r) for r in df.collect())


@pytest.mark.parametrize("ties", [0.0, 0.9])
@pytest.mark.parametrize("least", [3, 40])
def test_segments_change_nothing(spark, ties, least):
    rows = spark.createDataFrame(crowd(least, 600, ties), PACKETS).repartition(3)
    some = {"active_us": 2000, "subflow_us": 1000, "bulk_us": 1000, "bulk_least": 2}
    assert rounded(flow_features(rows, **some, least=least, most_segments=10_000)) == rounded(flow_features(rows, **some))


def test_segments_of_the_fixture_change_nothing(spark):
    hours = 7_200_000_000
    some = {"active_us": hours, "subflow_us": hours, "bulk_us": hours, "bulk_least": 3}
    assert rounded(flow_features(packets(spark, SF), **some, least=2, most_segments=10_000)) == rounded(flow_features(packets(spark, SF), **some))


@pytest.mark.parametrize("ties", [0.0, 1.0])
def test_one_hot_flow_uses_many_tasks(spark, ties):
    """A flow with nearly all packets: no segment holds more than its share of them, and they follow one another in time."""
    rows = spark.range(1, 20_001).select(
        F.lit("FX-20240101-000000").alias("case_id"), F.col("id").alias("packet_number"), F.timestamp_micros((F.col("id") * (1 - ties) * 37 + 1_000_000).cast("long")).alias("timestamp"),
        F.lit("10.0.0.1").alias("source_ip"), F.when(F.col("id") % 100 == 0, F.concat(F.lit("10.1.0."), F.col("id").cast("string"))).otherwise("10.0.0.2").alias("destination_ip"), F.lit(6).alias("protocol_number"), F.lit(5).alias("source_port"), F.lit(80).alias("destination_port"),
    )
    keyed = directed(rows)
    hot = hot_flows(keyed, flow_starts(keyed), least=1000, most_segments=16)
    assert hot.count() == 1
    held = segmented(keyed, hot).where("first_low is not null").groupBy("segment").agg(F.count("*").alias("n"), F.min(F.struct("us", "packet_number")).alias("lo"), F.max(F.struct("us", "packet_number")).alias("hi")).orderBy("segment").collect()
    assert len(held) >= 12 and max(r.n for r in held) <= 2 * 20_000 / 16
    assert all(a.hi < b.lo for a, b in zip(held, held[1:], strict=False))
    assert hot_flows(keyed, flow_starts(keyed)) is None


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_packets_are_read_once_for_flows_and_sorted_once_for_features(spark):
    rows = packets(spark, SF)
    assert "SortAggregate" not in _plan(flows.aggregated(rows))
    assert "FileScan" not in _plan(flows.build_flows(rows))  # what is left reads the kept aggregate
    plan = _plan(flow_features(rows))
    assert plan.count("FileScan parquet") == 1 and len(re.findall(r"Sort \[case_id[^\n]*us#", plan)) == 1
    assert len(COLUMNS) == 74
