"""Cases are replaced whole or not at all; guards count faults in the pass that writes; live flows are those of a batch."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from netsift.operators import checks, flows, scoring
from netsift.plans import files, queries
from netsift.sources import store
from netsift.sources.fixtures import packets
from netsift.streaming import live

SF = "/root/testdata/sf0.001"


def table(spark, rows):
    return spark.createDataFrame(rows, "case_id string, x int")


def held(spark, path):
    return sorted((r.case_id, r.x) for r in store.read_cases(spark, path).collect())


def test_only_the_written_cases_are_replaced(spark, tmp_path):
    path = str(tmp_path / "t")
    assert store.read_cases(spark, path, "case_id string, x int").count() == 0
    with pytest.raises(ValueError, match="nothing has been written"):
        store.read_cases(spark, path)
    store.replace_cases(table(spark, [("1", 1), ("2", 2), ("2", 3)]), path)
    store.replace_cases(table(spark, [("2", 4), ("03", 5)]), path)
    assert held(spark, path) == [("03", 5), ("1", 1), ("2", 4)]
    store.replace_cases(table(spark, []), path, cases=spark.createDataFrame([("1",)], "case_id string"))
    assert held(spark, path) == [("03", 5), ("2", 4)]
    # a table may be replaced by what is read from it
    store.replace_cases(store.read_cases(spark, path).withColumn("x", F.col("x") + 1), path)
    assert held(spark, path) == [("03", 6), ("2", 5)]


@pytest.mark.parametrize("dies", ["rows", "manifest", "pointer"])
def test_a_write_that_dies_changes_nothing(spark, tmp_path, monkeypatch, dies):
    path = str(tmp_path / "t")
    store.replace_cases(table(spark, [("a", 1), ("b", 2)]), path)
    if dies == "rows":  # some tasks' files are in place, others never came
        table(spark, [("a", 9)]).withColumn("_case", F.col("case_id")).write.partitionBy("_case").parquet(f"{path}/rows/_version=vdead")
    elif dies == "manifest":
        with pytest.raises(RuntimeError):
            store.replace_cases(table(spark, [("a", 9)]), path, verify=lambda: (_ for _ in ()).throw(RuntimeError("killed")))
    else:
        def killed(*_):
            raise RuntimeError("killed")

        monkeypatch.setattr(store, "_point", killed)
        with pytest.raises(RuntimeError):
            store.replace_cases(table(spark, [("a", 9), ("c", 9)]), path)
        monkeypatch.undo()
    assert held(spark, path) == [("a", 1), ("b", 2)]
    store.replace_cases(table(spark, [("b", 3)]), path)
    assert held(spark, path) == [("a", 1), ("b", 3)]


def test_of_two_writers_none_is_lost(spark, tmp_path, monkeypatch):
    path, real = str(tmp_path / "t"), store._point
    store.replace_cases(table(spark, [("a", 1), ("b", 2)]), path)

    def late(*args):  # another writer is faster, once
        monkeypatch.setattr(store, "_point", real)
        store.replace_cases(table(spark, [("a", 5)]), path)
        return real(*args)

    monkeypatch.setattr(store, "_point", late)
    store.replace_cases(table(spark, [("b", 6)]), path)
    assert held(spark, path) == [("a", 5), ("b", 6)]


def test_vacuum_leaves_what_counts(spark, tmp_path):
    path = str(tmp_path / "t")
    for k in range(5):
        store.replace_cases(table(spark, [("a" if k % 2 else "b", k)]), path)
    store.vacuum(spark, path, keep=1)
    assert held(spark, path) == [("a", 3), ("b", 4)]
    assert len(os.listdir(f"{path}/_manifests")) == 1 and len([x for x in os.listdir(f"{path}/rows") if "=" in x]) == 2


def test_faults_are_counted_in_the_same_pass(spark, tmp_path):
    scored = scoring.score(scoring.model_row(flows.build_flows(packets(spark, SF))))
    rows, verify = checks.checked_scores(scored)
    rows.write.format("noop").mode("overwrite").save()
    assert verify()["rows"] == scored.count()
    for bad, said in (
        (scored.withColumn("probabilities", F.map_filter("probabilities", lambda k, _: k != "DoS")), "wrong width"), (scored.withColumn("probabilities", F.transform_values("probabilities", lambda k, v: F.when(k == "DoS", float("nan")).otherwise(v))), "not finite"),
        (scored.withColumn("probabilities", F.transform_values("probabilities", lambda _, v: v / 2)), "sum to one"), (scored.withColumn("predicted_class", F.lit("x")), "unknown classes"), (scored.withColumn("probabilities", F.lit(None).cast("map<string,double>")), "wrong width"), (scored.limit(0), "empty"),
    ):
        rows, verify = checks.checked_scores(bad)
        rows.write.format("noop").mode("overwrite").save()
        with pytest.raises(ValueError, match=said):
            verify()
    rows, verify = checks.checked_recommendations(scored.withColumn("predicted_class", F.lit("dos")))
    rows.write.format("noop").mode("overwrite").save()
    with pytest.raises(ValueError, match="without a recommendation"):
        verify()


def test_explanations_are_checked_by_width_and_number(spark):
    rows = "case_id string, contributors array<struct<shap_value: double>>"
    good = [("a", [(0.5,), (0.1,)])]
    for more, said in (([("b", None)], "missing: 1 of 2"), ([("b", [(0.5,)])], "wrong width: 1 of 2"), ([("b", [(0.5,), (float("inf"),)])], "not finite: 1 of 2"), ([], None)):
        out, verify = checks.checked_explanations(spark.createDataFrame(good + more, rows), 2)
        out.write.format("noop").mode("overwrite").save()
        if said is None:
            assert verify() == {"rows": 1, "explanations_missing": 0, "explanations_of_the_wrong_width": 0, "contributions_not_finite": 0}
        else:
            with pytest.raises(ValueError, match=said):
                verify()


def test_one_session_for_each_key_is_the_flow(spark):
    """With a gap that closes nothing, live flows are the flows, all columns but the number."""
    rows = packets(spark, SF)
    want = flows.shaped(flows.aggregated(rows), "first_packet")
    got = live.live_flows(rows, gap="1000 days")
    assert got.columns == want.columns and len(want.columns) == len(flows.build_flows(rows).columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("name", files.QUERIES)
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    cur = con.execute(files.ORACLES[name])
    got = files.QUERIES[name](spark, SF)
    at = [[d[0] for d in cur.description].index(c) for c in got.columns]
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(str(tuple(r[i] for i in at)) for r in cur.fetchall())
    assert not set(files.QUERIES) & set(queries.QUERIES)


def test_bases_hold_only_touched_cases_and_old_batches_go(spark, tmp_path):
    log = "case_id string, flow_index long, decision string, notes string, review_timestamp timestamp, event_id long"
    out, want = str(tmp_path / "out"), []
    for k in range(9):
        rows = [(f"FX-2024010{1 + (k // 2) % 3}-000000", f, ("Confirmed", "Rejected")[(k + f) % 2], f"{k}", None, 10 * k + f) for f in range(3)]
        want += rows
        spark.createDataFrame(rows, log).withColumn("review_timestamp", F.timestamp_seconds(F.col("event_id"))).coalesce(1).write.parquet(str(tmp_path / "log" / str(k)))
        live.review_feed(spark.readStream.schema(log).option("recursiveFileLookup", "true").parquet(str(tmp_path / "log")), out, str(tmp_path / "cp"), every=2).awaitTermination()
        newest = {(r[0], r[1]): r[5] for r in sorted(want, key=lambda r: r[5])}
        assert {(r.case_id, r.flow_index): r.event_id for r in live.fed_reviews(spark, out).collect()} == newest
    bases = {r.base: r.n for r in spark.read.parquet(f"{out}/_bases").groupBy("base").agg(F.count_distinct("case_id").alias("n")).collect()}
    assert bases == {3: 1, 5: 1, 7: 1}  # base 1 held a case that base 7 has again
    assert sorted(x for x in os.listdir(out) if x.startswith("batch=")) == ["batch=6", "batch=7", "batch=8"]


def test_evidence_is_hashed_as_it_is_read(spark, tmp_path, monkeypatch):
    import hashlib

    from netsift.sources import captures

    big = os.urandom(9_000_001)
    (tmp_path / "a b+c.pcap").write_bytes(big)
    (tmp_path / "empty.PCAPNG").write_bytes(b"")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "x.txt").write_bytes(b"x")
    got = {r.file_name: (r.file_size, r.sha256, r.allowed) for r in captures.evidence_catalog(spark, str(tmp_path)).collect()}
    digest = lambda x: hashlib.sha256(x).hexdigest().upper()
    assert got == {"a b+c.pcap": (len(big), digest(big), True), "empty.PCAPNG": (0, digest(b""), True), "x.txt": (1, digest(b"x"), False)}


def test_contributors_of_a_case_come_in_chunks(spark):
    rows = spark.range(25).select(F.lit("a").alias("case_id"), F.col("id").alias("flow_index"), F.array(F.struct(F.lit("f").alias("feature"))).alias("contributors"))
    got = scoring.features_by_flow(rows, per_row=10).collect()
    assert sorted((r.chunk, len(r.top_features_per_flow)) for r in got) == [(0, 10), (1, 10), (2, 5)]
