import datetime as dt
import json
import struct

import duckdb
import pytest
from pyspark.sql import functions as F

from netsift.functions import text as T
from netsift.operators import cases, flows, model, scoring, traffic, trees
from netsift.operators.features import flow_features
from netsift.plans import queries
from netsift.schema import CLASSES, COLUMNS, FEATURES, PACKETS, REVIEWS
from netsift.sources import captures
from netsift.sources.fixtures import packets, review_log
from netsift.streaming import live

SF = "/root/testdata/sf0.001"
CASE = "FX-20240101-000000"


def packet(n, at, src, sport, dst, dport, length=100, flags="", protocol=6):
    time = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(microseconds=at)
    return (CASE, n, time, src, dst, {6: "TCP", 17: "UDP"}.get(protocol, "OTHER"), protocol, sport, dport, length, flags, 20, length - 40, 1000)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), PACKETS)


@pytest.mark.parametrize("name", ["flows", "flow_features_74", "scored_flows", "top_contributors", "triage_rows", "report_rows", "upserted_reviews", "text_expressions", "class_distribution", "report_status", "importance_sample", "prompts", "looked_up_findings", "explanation_faults", "case_details", "tree_scored", "explanations", "case_reports", "scored_features", "scaled_features", "catalog_from_documents", "features_from_file", "stored_reviews", "audited_files", "summary_agrees"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    cur = con.execute(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, SF)
    at = [[d[0] for d in cur.description].index(c) for c in got.columns]
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(str(tuple(r[i] for i in at)) for r in cur.fetchall())


def test_every_oracle_has_a_query():
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_direction_follows_capture_order(spark):
    rows = frame(spark, packet(1, 500, "10.0.0.9", 5, "10.0.0.10", 80, 60, "S"), packet(2, 100, "10.0.0.10", 80, "10.0.0.9", 5, 70, "SA"))
    r = flows.build_flows(rows).first()
    assert (r.source_ip, r.forward_packets, r.backward_packets, r.flow_duration, r.syn_count, r.ack_count) == ("10.0.0.9", 1, 1, 400, 2, 1)
    assert traffic.canonical_key(rows).first().low.ip == "10.0.0.10"


def test_equal_endpoints_and_single_packets(spark):
    rows = frame(spark, packet(1, 0, "a", 1, "a", 1), packet(2, 5, "a", 1, "a", 1), packet(3, 9, "b", 1, "c", 2, flags="CEUN"))
    a, b = flows.build_flows(rows).orderBy("flow_id").collect()
    assert (a.forward_packets, a.backward_packets) == (2, 0)
    assert (b.flow_duration, b.bytes_per_second, b.packets_per_second) == (0, 0.0, 0.0)
    assert b.syn_count + b.ack_count + b.fin_count + b.rst_count + b.psh_count == 0


@pytest.mark.parametrize("span", [1, 7, 10**6])
def test_numbers_do_not_depend_on_buckets(spark, span):
    rows = packets(spark, SF)
    first = {}
    for p in traffic.with_ports(rows).collect():
        ends = (p.case_id, *sorted([(p.source_ip, p.source_port), (p.destination_ip, p.destination_port)]), p.protocol_number)
        first[ends] = min(first.get(ends, p.packet_number), p.packet_number)
    want, seen = {}, {}
    for ends in sorted(first, key=first.get):
        want[ends] = seen[ends[0]] = seen.get(ends[0], 0) + 1
    made = flows.build_flows(rows, span=span)
    got = {(r.case_id, *sorted([(r.source_ip, r.source_port), (r.destination_ip, r.destination_port)]), r.protocol_number): r.flow_id for r in made.collect()}
    assert got == want


def test_flows_are_hash_aggregates(spark):
    plan = flows.build_flows(packets(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_top_ips_tie(spark):
    rows = frame(spark, *[packet(n, n, ip, 1, "z", 2) for n, ip in enumerate("fabcdeabcd")])
    assert [r.ip for r in traffic.top_ips(rows, "source_ip").orderBy("rank").collect()] == ["a", "b", "c", "d", "f"]


def test_features_keep_invariants(spark):
    out = flow_features(packets(spark, SF))
    assert out.columns == ["case_id", "flow_id", *COLUMNS] and len(COLUMNS) == 74
    total = packets(spark, SF).where("source_port is not null").count()
    assert out.agg(F.sum(F.col("total_fwd_packet") + F.col("total_bwd_packets"))).first()[0] == total


def test_probabilities_sum_to_one(spark):
    scored = scoring.require_probabilities(scoring.score(scoring.model_row(flows.build_flows(packets(spark, SF)))))
    off = scored.where(F.abs(F.aggregate(F.map_values("probabilities"), F.lit(0.0), lambda s, x: s + x) - 1) > 1e-9)
    assert off.count() == 0


@pytest.mark.parametrize("raw,want", [("inf", 0.0), ("-Infinity", 0.0), ("nan", 0.0), ("", 0.0), ("abc", 0.0), (" 7 ", 7.0), (None, 0.0), ("-2.9", -2.9)])
def test_coercion(spark, raw, want):
    r = spark.createDataFrame([(raw,)], "t string").select(scoring.finite(scoring.number(F.col("t"))).alias("x"), scoring.safe_integer(F.col("t")).alias("i")).first()
    assert (r.x, r.i) == (want, int(want))


def test_contract(spark):
    df = spark.createDataFrame([(1, 2)], ["﻿ACK Flag Count ", "odd"])
    assert len(scoring.missing_features(df, FEATURES)) == 73
    with pytest.raises(ValueError, match="Active Max"):
        scoring.require_features(df, FEATURES)
    assert {r.status for r in scoring.contract_report(df, FEATURES).collect()} == {"available", "missing", "extra"}
    scoring.check_bundle(list(FEATURES), list(CLASSES), 74, 74)
    with pytest.raises(ValueError, match="duplicate"):
        scoring.check_bundle([*FEATURES[:-1], FEATURES[0]], list(CLASSES), 74, 73)
    with pytest.raises(ValueError, match="empty"):
        scoring.require_rows(df.limit(0))


def test_recommendations(spark):
    df = spark.createDataFrame([(" BENIGN ",), ("DoS",)], "predicted_class string")
    assert [r[0] for r in df.select(scoring.is_threat(F.col("predicted_class"))).collect()] == [False, True]
    with pytest.raises(ValueError, match="BENIGN"):
        cases.recommend(df, strict=True)
    assert cases.recommend(df).where("summary is not null").count() == 1


def test_reviews(spark):
    rows = [("c", 1, "Confirmed", " x ", 5, 1), ("c", 1, "Rejected", None, 5, 2), ("c", -1, "Confirmed", "", 1, 3), ("", 1, "Confirmed", "", 1, 4), ("c", 2, "Maybe", "", 1, 5), ("c", 3, None, "", 1, 6)]
    log = cases.validate_reviews(spark.createDataFrame(rows, "case_id string, flow_index long, decision string, notes string, review_timestamp long, event_id long"))
    assert [r.reason for r in log.orderBy("event_id").collect()] == [None, None, "flow index invalid", "case missing", "decision invalid", "decision invalid"]
    assert [r.decision for r in cases.upsert(log.where("reason is null")).collect()] == ["Rejected"]


def test_text(spark):
    row = lambda c: spark.range(1).select(c).first()[0]
    assert row(T.general_value(F.lit(0.5))) == "0.5" and row(T.general_value(F.lit(None).cast("double"))) == "N/A" and row(T.general_value(F.lit(1234567.0))) == "1.23457e+06"
    assert row(T.report_size(F.lit(-1))) == "--" and row(T.report_size(F.lit(1023))) == "1,023 bytes" and row(T.byte_size(F.lit(3 * 1024**3))) == "3.00 GB"
    assert row(T.priority(F.lit(0.9))) == "High" and row(T.triage_endpoint(F.lit(" "), F.lit(1))) == "--" and row(scoring.direction(F.lit(0.0))) == "neutral"
    assert row(F.bround(F.lit(1) * 100.0 / F.lit(32), 2)) == 3.12


def test_documents(spark, tmp_path):
    for case, value in (("A", ""), ("B", "{bad"), ("C", json.dumps({"case_id": "C", "ml_analysis": {"summary": {"total_flows": 3}}, "traffic_summary": {"top_source_ips": [["1.1.1.1", 4]]}}))):
        (tmp_path / case).mkdir()
        (tmp_path / case / "analysis.json").write_text(value)
    docs = captures.read_documents(spark, str(tmp_path))
    reviews = spark.createDataFrame([], "case_id string, decision string")
    got = {r.case_id: (r.status, r.openable) for r in cases.case_catalog(spark.createDataFrame([("A",), ("B",), ("C",), ("D",)], "case_id string"), docs, reviews).collect()}
    assert got == {"A": ("Invalid", False), "B": ("Invalid", False), "C": ("Analyzed", True), "D": ("Incomplete", False)}


def test_frames(spark, tmp_path):
    ip = bytes([0x45, 0]) + struct.pack(">H", 40) + bytes(5) + bytes([6]) + bytes(2) + bytes([10, 0, 0, 1, 192, 168, 1, 2])
    tcp = struct.pack(">HHIIBBHHH", 40000, 443, 1, 2, 5 << 4, 0x12, 500, 0, 0)
    frames = [bytes(12) + b"\x08\x00" + ip[:8] + bytes([64]) + ip[9:] + tcp, bytes(12) + b"\x08\x06" + bytes(30)]
    data = struct.pack("<IHHIIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1) + b"".join(struct.pack("<IIII", 5, 7, len(f), len(f)) + f for f in frames)
    (tmp_path / "x.pcap").write_bytes(data)
    read = captures.read_captures(spark, str(tmp_path))
    assert read.count() == 2
    (r,) = captures.decode_frames(read).collect()
    assert (r.packet_number, r.us, r.source_ip, r.source_port, r.destination_ip, r.destination_port, r.protocol, r.tcp_window, r.header_length) == (1, 5_000_007, "10.0.0.1", 40000, "192.168.1.2", 443, "TCP", 500, 20)
    assert set(r.tcp_flags) == {"S", "A"}
    (item,) = captures.evidence_catalog(spark, str(tmp_path)).collect()
    assert item.allowed and item.file_size == len(data)
    manifest = spark.createDataFrame([("x.pcap", len(data), item.sha256.lower()), ("y.pcap", 1, None)], "file_name string, file_size long, sha256 string")
    assert {r.file_name: r.status for r in captures.audit_files(spark, str(tmp_path), manifest).collect()} == {"x.pcap": "ok", "y.pcap": "missing"}


def test_case_partitions_are_replaced(spark, tmp_path):
    out = str(tmp_path / "t")
    captures.write_case(spark.createDataFrame([("a", 1), ("b", 2)], "case_id string, x int"), out)
    captures.write_case(spark.createDataFrame([("b", 3)], "case_id string, x int"), out)
    assert sorted((r.case_id, r.x) for r in spark.read.parquet(out).collect()) == [("a", 1), ("b", 3)]


def test_trees(spark):
    nodes = spark.createDataFrame([(0, 0, 0, 0, 1.5, 1, 2, 0.0), (0, 1, 0, -1, 0.0, 0, 0, 2.0), (0, 2, 0, -1, 0.0, 0, 0, -1.0), (1, 0, 1, -1, 0.0, 0, 0, 0.5)], "tree int, node int, class_id int, feature int, threshold double, left int, right int, value double")
    rows = spark.createDataFrame([(1, [1.0]), (2, [1.5])], "k int, x array<double>")
    got = {r.k: (r.margins, r.class_id) for r in trees.predicted(trees.tree_margins(rows, "x", nodes, 2)).collect()}
    assert got == {1: ([2.0, 0.5], 0), 2: ([-1.0, 0.5], 1)}


def test_tree_contributions(spark):
    """Against the sum over all coalitions, and additive."""
    from itertools import combinations
    from math import factorial

    table = [(0, 0, 0, 0, 1.0, 1, 2, 0.0, 10.0), (0, 1, 0, 1, 0.0, 3, 4, 0.0, 6.0), (0, 2, 0, 0, 3.0, 5, 6, 0.0, 4.0), (0, 3, 0, -1, 0.0, 0, 0, 2.0, 2.0), (0, 4, 0, -1, 0.0, 0, 0, -1.0, 4.0), (0, 5, 0, 2, 5.0, 7, 8, 0.0, 3.0), (0, 6, 0, -1, 0.0, 0, 0, 4.0, 1.0), (0, 7, 0, -1, 0.0, 0, 0, 1.0, 1.0), (0, 8, 0, -1, 0.0, 0, 0, 7.0, 2.0)]
    nodes = spark.createDataFrame(table, "tree int, node int, class_id int, feature int, threshold double, left int, right int, value double, cover double")
    at = {r[1]: r for r in table}

    def expected(x, known, n=0):
        _, _, _, f, threshold, left, right, value, cover = at[n]
        if f < 0:
            return value
        if f in known:
            return expected(x, known, left if x[f] < threshold else right)
        return sum(at[k][8] / cover * expected(x, known, k) for k in (left, right))

    xs = [[0.0, -1.0, 9.0], [2.0, 1.0, 1.0], [5.0, 0.0, 5.0], [1.0, 0.0, 6.0]]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "k int, x array<double>")
    margins = {r.k: r.margins[0] for r in trees.tree_margins(rows, "x", nodes, 1).collect()}
    for r in trees.tree_contributions(rows, "x", nodes, 1).collect():
        assert r.base_values[0] == pytest.approx(expected(r.x, ())) and r.base_values[0] + sum(r.contributions[0]) == pytest.approx(margins[r.k])
        for f in range(3):
            others = [g for g in range(3) if g != f]
            value = sum(factorial(len(s)) * factorial(2 - len(s)) / 6 * (expected(r.x, (*s, f)) - expected(r.x, s)) for n in range(3) for s in combinations(others, n))
            assert r.contributions[0][f] == pytest.approx(value)


def test_streams_equal_batches(spark, tmp_path):
    packets(spark, SF).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(packets(spark, SF).schema).parquet(str(tmp_path / "in"))

    def all_of(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        return {tuple(map(str, r)) for r in spark.table(name).collect()}

    seen = packets(spark, SF).agg(F.max("timestamp")).first()[0]
    for name, form, closes, late in (("totals", live.live_totals, "start + interval 5 minutes", 600), ("live", live.live_flows, "end_time + interval 2 hours", 86_400)):
        mark = F.lit(seen) - F.expr(f"interval {late} seconds")
        batch = {tuple(map(str, r)) for r in form(packets(spark, SF)).where(F.expr(closes) <= mark).collect()}
        got = all_of(form(stream), name)
        assert got and got == batch
    log = review_log(spark, SF)
    log.coalesce(1).write.parquet(str(tmp_path / "log"))
    live.review_feed(spark.readStream.schema(log.schema).parquet(str(tmp_path / "log")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    want = cases.upsert(cases.validate_reviews(log).where("reason is null"))
    assert live.current_reviews(spark.read.parquet(str(tmp_path / "out"))).count() == want.count()
    rows = lambda df: sorted(str((r.case_id, r.flow_index, r.decision, r.event_id)) for r in df.collect())
    assert rows(live.fed_reviews(spark, str(tmp_path / "out"))) == rows(want)


def test_review_feed_of_findings_and_bases(spark, tmp_path):
    log = review_log(spark, SF).coalesce(1)
    findings = spark.createDataFrame([(r.case_id, r.flow_index) for r in log.where("flow_index < 20").select("case_id", "flow_index").distinct().collect()], "case_id string, flow_index long")
    for k in range(5):
        log.where(F.col("event_id") % 5 == 0).where(F.floor(F.col("event_id") / 5) % 5 == k).write.parquet(str(tmp_path / "log" / str(k)))
        stream = spark.readStream.schema(log.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "log"))
        live.review_feed(stream, str(tmp_path / "out"), str(tmp_path / "cp"), findings, every=2).awaitTermination()
    want = cases.upsert(cases.validate_reviews(log).where("reason is null")).join(findings, ["case_id", "flow_index"], "left_semi")
    rows = lambda df: sorted(str((r.case_id, r.flow_index, r.decision, r.event_id)) for r in df.collect())
    assert rows(live.fed_reviews(spark, str(tmp_path / "out"))) == rows(want)
    assert sorted(x.name for x in (tmp_path / "out" / "_bases").iterdir()) == ["base=1", "base=3"]


def test_explanations_are_guarded(spark):
    scored = spark.createDataFrame([("c", 1, "DoS"), ("c", 2, "DoS"), ("c", 3, "DoS"), ("c", 4, "odd"), ("c", 5, "DoS")], "case_id string, flow_index long, predicted_class string")
    rows = [("c", k, 0.5) for k in (1, 1, 2, 4, 4, 5)] + [("c", 5, float("nan"))]
    parts = spark.createDataFrame(rows, "case_id string, flow_index long, shap_value double")
    assert {r.flow_index: r.fault for r in scoring.explanation_faults(scored, parts, 2).collect()} == {2: "width", 3: "missing", 4: "unknown class", 5: "not finite"}
    with pytest.raises(ValueError, match="do not fit"):
        scoring.require_explanations(scored, parts, 2)


def test_fallbacks(spark):
    df = spark.createDataFrame([(None, "", "x", 0.0, None, 0.3), ("a", "b", "c", 0.9, 0.1, 0.2), ("", None, None, None, 0.0, None)], "p string, q string, r string, a double, b double, c double")
    got = df.select(T.filled(F.col("p"), F.col("q"), F.col("r"), default="Unknown").alias("t"), T.filled_number(F.col("a"), F.col("b"), F.col("c")).alias("n")).collect()
    assert [(r.t, r.n) for r in got] == [("x", 0.3), ("a", 0.9), ("Unknown", None)]


def test_names_reviews_and_feature_order(spark, tmp_path):
    documents = spark.createDataFrame([("A", "a.pcap"), ("B", " ")], "case_id string, file_name string")
    files = spark.createDataFrame([("A", "z.pcap"), ("B", "y.pcap"), ("B", "x.pcap"), ("C", "c.pcap")], "case_id string, file_name string")
    assert {r.case_id: r.file_name for r in cases.evidence_name(documents, files).collect()} == {"A": "a.pcap", "B": "x.pcap", "C": "c.pcap"}
    assert captures.read_reviews(spark, str(tmp_path / "none")).count() == 0
    spark.createDataFrame([("c", 2, "DoS", "Confirmed", "", None), ("c", 1, "DoS", "Rejected", "", None)], REVIEWS).write.parquet(str(tmp_path / "r"))
    assert [r.flow_index for r in captures.read_reviews(spark, str(tmp_path / "r")).collect()] == [1, 2]
    assert scoring.ordered_features(spark.createDataFrame([(1, 2, 3)], ["b/s ", "odd", "a"]), ("a", "b/s")).columns == ["a", "b/s"]


def _ethernet(kind, body, *tags):
    return bytes(12) + b"".join(b"\x81\x00" + struct.pack(">H", t) for t in tags) + struct.pack(">H", kind) + body


def _v4(body, protocol=6, offset=0, src=(10, 0, 0, 1), dst=(192, 168, 1, 2)):
    return struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(body), 1, offset, 64, protocol, 0) + bytes(src) + bytes(dst) + body


def _v6(body, following, src, dst):
    import ipaddress

    return struct.pack(">IHBB", 6 << 28, len(body), following, 64) + ipaddress.IPv6Address(src).packed + ipaddress.IPv6Address(dst).packed + body


def _tcp(payload=b"", flags=0x12, words=5):
    return struct.pack(">HHIIBBHHH", 40000, 443, 1, 2, words << 4, flags, 500, 0, 0) + bytes(4 * (words - 5)) + payload


def _capture(frames, link=1, magic=0xA1B2C3D4, order="<"):
    return struct.pack(f"{order}IHHIIII", magic, 2, 4, 0, 0, 65535, link) + b"".join(struct.pack(f"{order}IIII", 5, 7 + i, len(f), len(f)) + f for i, f in enumerate(frames))


def test_decoded_frames(spark, tmp_path):
    udp = struct.pack(">HHHH", 53, 5353, 12, 0) + b"abcd"
    options = bytes([17, 0]) + bytes(6)
    first, later = struct.pack(">BBHI", 17, 0, 1, 9), struct.pack(">BBHI", 17, 0, 64 << 3, 9)
    ethernet = [
        _ethernet(0x0800, _v4(_tcp(b"hello", words=6))), _ethernet(0x0800, _v4(_tcp(b"xyz")), 5), _ethernet(0x0800, _v4(udp, 17), 5, 6), _ethernet(0x0800, _v4(b"\xff" * 40, 6, offset=100)), _ethernet(0x0800, _v4(_tcp(), 6, offset=0x2000)), _ethernet(0x0806, bytes(30)),
        _ethernet(0x86DD, _v6(_tcp(b"q"), 6, "2001:db8::1", "fe80::")), _ethernet(0x86DD, _v6(options + udp, 0, "::1", "1:0:0:2:0:0:0:3")), _ethernet(0x86DD, _v6(first + udp, 44, "::ffff:1.2.3.4", "1:0:0:2:2:0:0:3")), _ethernet(0x86DD, _v6(later + udp, 44, "::1.2.3.4", "::")),
        _ethernet(0x0800, _v4(b"", 1)),
    ]
    (tmp_path / CASE).mkdir()
    (tmp_path / CASE / "a.PCAP").write_bytes(_capture(ethernet) + struct.pack("<IIII", 9, 9, 100, 100) + b"cut")
    got = {r.packet_number: r for r in captures.decode_frames(captures.read_captures(spark, str(tmp_path))).collect()}
    short = {n: (r.source_ip, r.destination_ip, r.protocol, r.protocol_number, r.source_port, r.header_length, r.payload_length) for n, r in got.items()}
    assert short == {
        1: ("10.0.0.1", "192.168.1.2", "TCP", 6, 40000, 24, 5), 2: ("10.0.0.1", "192.168.1.2", "TCP", 6, 40000, 20, 3), 3: ("10.0.0.1", "192.168.1.2", "UDP", 17, 53, 8, 4), 4: ("10.0.0.1", "192.168.1.2", "OTHER", 6, None, 0, 40),
        5: ("10.0.0.1", "192.168.1.2", "TCP", 6, 40000, 20, 0), 7: ("2001:db8::1", "fe80::", "TCP", 6, 40000, 20, 1), 8: ("::1", "1:0:0:2::3", "UDP", 17, 53, 8, 4), 9: ("::ffff:1.2.3.4", "1::2:2:0:0:3", "UDP", 17, 53, 8, 4), 10: ("::1.2.3.4", "::", "OTHER", 44, None, 0, 12),
        11: ("10.0.0.1", "192.168.1.2", "OTHER", 1, None, 0, 0),
    }
    assert {r.case_id for r in got.values()} == {CASE} and got[1].timestamp == dt.datetime(1970, 1, 1, 0, 0, 5, 7) and set(PACKETS.split()[::2]) <= set(got[1].asDict())


def test_other_capture_formats(spark, tmp_path):
    raw = _v4(_tcp())
    block = lambda kind, body: struct.pack("<II", kind, 12 + len(body)) + body + struct.pack("<I", 12 + len(body))
    section = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1))
    frame_ = _ethernet(0x0800, raw)
    enhanced = block(6, struct.pack("<IIIII", 0, 0, 3_000_000, len(frame_), len(frame_)) + frame_ + bytes(-len(frame_) % 4))
    nanos = block(1, struct.pack("<HHIHHB3xHH", 1, 0, 0, 9, 1, 9, 0, 0))
    files = {"ng.pcapng": section + nanos + enhanced, "raw.pcap": _capture([raw], 101), "cooked.pcap": _capture([bytes(14) + b"\x08\x00" + raw], 113, 0xA1B23C4D, ">"), "null.pcap": _capture([b"\2\0\0\0" + raw], 0)}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "notes.txt").write_text("no capture")
    got = {r.path.rsplit("/", 1)[1]: (r.us, r.source_ip, r.source_port) for r in captures.decode_frames(captures.read_captures(spark, str(tmp_path))).collect()}
    assert got == {"ng.pcapng": (3_000, "10.0.0.1", 40000), "raw.pcap": (5_000_007, "10.0.0.1", 40000), "cooked.pcap": (5_000_000, "10.0.0.1", 40000), "null.pcap": (5_000_007, "10.0.0.1", 40000)}


def test_from_captures_to_reports(spark, tmp_path):
    (tmp_path / CASE).mkdir()
    frames = [_ethernet(0x0800, _v4(_tcp(b"x" * (50 * k), 2 if k == 0 else 16), src=(10, 0, 0, 1 + k % 5))) for k in range(25)]
    (tmp_path / CASE / "a.pcap").write_bytes(_capture(frames))
    found = captures.decode_frames(captures.read_captures(spark, str(tmp_path)))
    made, features = flows.build_flows(found), flow_features(found)
    bundle = model.load_model(model.fit_scaler(features, COLUMNS), *queries.stand_in_tables(spark))
    scored = model.score_features(model.described(features, made), bundle)
    assert scored.count() == made.count() == 5 and scoring.require_probabilities(scored) is scored
    parts = scoring.require_explanations(scored, model.feature_contributions(scored, bundle), 74)
    assert all(r.adds_up for r in scoring.additivity(parts).collect())
    reviews = spark.createDataFrame([(CASE, 0, "Confirmed", "seen")], "case_id string, flow_index long, decision string, notes string")
    rows = cases.report_rows(scored, reviews).collect()
    assert {r.flow_index for r in rows} == {r.flow_index for r in scored.where("is_threat").collect()} and all(r.n_actions for r in rows)
    assert scoring.explanations(scoring.top_contributors(parts)).count() == 5


def test_bundles_that_disagree(spark):
    scaler = spark.createDataFrame([(0, "a", 1.0, 2.0), (1, "b", 0.0, 1.0)], model.SCALER)
    weights = spark.createDataFrame([(c, n, f, float(c + f)) for c, n in enumerate("xy") for f in (0, 1)], model.WEIGHTS)
    biases = spark.createDataFrame([(0, "x", 0.0), (1, "y", 0.5)], model.BIASES)
    bundle = model.load_model(scaler, weights, biases, n_features=2, n_classes=2)
    rows = spark.createDataFrame([(1, 3.0, None), (2, float("nan"), float("inf"))], "k int, a double, b double")
    got = {r.k: (r.z, r.margins, r.predicted_class) for r in model.score_features(rows, bundle).collect()}
    assert got == {1: ([1.0, 0.0], [0.0, 1.5], "y"), 2: ([-0.5, 0.0], [0.0, 0.0], "x")}
    assert {r.k: r.a for r in model.scale(rows, scaler, ("k",)).collect()} == {1: 1.0, 2: -0.5}
    for bad in ((scaler.where("feature_id = 0"), weights, biases), (scaler, weights.where("class_id = 0 or feature_id = 0"), biases), (scaler.withColumn("scale", F.lit(0.0)), weights, biases)):
        with pytest.raises(ValueError):
            model.load_model(*bad, n_features=2, n_classes=2)
    with pytest.raises(ValueError, match="finite"):
        scoring.require_probabilities(spark.createDataFrame([({"x": float("nan")},)], "probabilities map<string, double>"))


def test_the_last_explanation_counts(spark):
    findings = spark.createDataFrame([("c", 1, "DoS", 0.5), ("c", 2, "DoS", 0.5)], "case_id string, flow_index long, predicted_class string, confidence double")
    told = spark.createDataFrame([("c", 1, 0.1, ["a"], 3), ("c", 1, 0.2, ["b"], 7), ("c", 1, 0.3, ["z"], 5)], "case_id string, flow_index long, base_value double, contributors array<string>, nth int")
    assert {r.flow_index: r.contributors for r in cases.with_explanations(findings, told, "nth").collect()} == {1: ["b"], 2: None}


def test_prompts_without_a_confidence(spark):
    item = "array<struct<feature: string, raw_value: double, shap_value: double, direction: string>>"
    df = spark.createDataFrame([(None, None, None), ("DoS", None, [("f", 1.0, 0.5, "supports_prediction")])], f"p string, c double, x {item}")
    a, b = (r[0] for r in df.select(T.prompt(F.col("p"), F.col("c"), F.col("x"))).collect())
    assert a == "Explain only from these facts.\nPredicted class: Unknown\nConfidence: Not provided\n"
    assert b == "Explain only from these facts.\nPredicted class: DoS\nConfidence: Not provided\n- f: value 1, contribution 0.5, supports_prediction"
    empty = df.select(T.headline(F.col("p"), F.col("c"), F.lit(None).cast("struct<feature: string, direction: string>"))).collect()
    assert empty[1][0].endswith("but no SHAP contributors were available.")


def test_small_files_and_orders(spark, tmp_path):
    packets(spark, SF).limit(20).write.parquet(str(tmp_path / "p"))
    assert captures.read_packets(spark, str(tmp_path / "p")).count() == 20
    (tmp_path / "empty.csv").write_text("a,b\n")
    with pytest.raises(ValueError, match="no rows"):
        captures.read_features(spark, str(tmp_path / "empty.csv"))
    rows = spark.createDataFrame([("c", 2, "b"), ("c", 1, "a"), ("d", 0, "a"), ("c", 3, "b")], "case_id string, flow_index long, source string")
    assert [(r.case_id, r.flow_index) for r in cases.sort_rows(rows, "source", True).collect()] == [("c", 2), ("c", 3), ("c", 1), ("d", 0)]
    with pytest.raises(ValueError, match="sort by"):
        cases.sort_rows(rows, "notes")
    assert cases.stamp(rows).where("review_timestamp is not null").count() == 4
    mapped = traffic.protocol_map(packets(spark, SF)).first() if hasattr(traffic, "protocol_map") else None
    assert mapped is None or set(mapped[1]) <= {"TCP", "UDP", "OTHER"}


def test_default_thresholds_of_features(spark):
    """Active time, idle time and bulks at the usual thresholds, on packets that are close together."""
    at = [0, 100_000, 200_000, 300_000, 400_000, 7_000_000, 7_100_000, 20_000_000]
    rows = frame(spark, *[packet(n, t, "10.0.0.1", 5, "10.0.0.2", 80, 140 if n != 6 else 40) for n, t in enumerate(at, 1)])
    r = flow_features(rows).first()
    assert (r.active_max, r.active_min, r.active_mean) == (400_000, 100_000, 250_000) and (r.idle_max, r.idle_min) == (12_900_000, 6_600_000)
    assert (r.fwd_packet_bulk_avg, r.fwd_bytes_bulk_avg, r.fwd_bulk_rate_avg) == (5.0, 500.0, 1250.0) and r.bwd_packet_bulk_avg == 0
    assert (r.subflow_fwd_packets, r.flow_iat_max) == (4.0, 12_900_000)


def test_places_and_chunks_of_large_cases(spark):
    rows = spark.range(2000).select(F.when(F.col("id") % 10 < 8, "big").otherwise("small").alias("case_id"), F.col("id").alias("flow_index"), F.lit("DoS").alias("predicted_class"), (F.col("id") % 7 / 7).alias("confidence"), F.when(F.col("id") % 3 == 0, "Confirmed").otherwise("Unreviewed").alias("review"))
    got = {(r.case_id, r.flow_index): r.position for r in cases.triage_order(rows).collect()}
    for case in ("big", "small"):
        mine = sorted((r for r in rows.collect() if r.case_id == case), key=lambda r: (r.review != "Unreviewed", -round(r.confidence, 9), r.flow_index))
        assert [got[case, r.flow_index] for r in mine] == list(range(1, len(mine) + 1))
        assert (case, mine[0].flow_index) in {(r.case_id, r.flow_index) for r in cases.next_unreviewed(rows).collect()}
    told = rows.withColumns({"notes": F.lit("--"), "recommendation": F.lit("x")})
    summary = spark.createDataFrame([("big", 1600), ("small", 400), ("none", 0)], "case_id string, total_flows long")
    out = cases.case_report(summary, told, spark.createDataFrame([], "case_id string, decision string"), per_row=500).collect()
    assert sorted((r.case_id, r.chunk, len(r.threats or ())) for r in out) == [("big", k, 400) for k in range(4)] + [("none", 0, 0)] + [("small", k, 100) for k in range(4)]
    assert all(r.threats is None or [t.flow_index for t in r.threats] == sorted(t.flow_index for t in r.threats) for r in out)
