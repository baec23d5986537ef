"""Recommendations, reviews, triage and reports of cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netsift.functions.text import blank, or_default, priority, priority_rank, triage_endpoint
from netsift.operators.numbering import ranked
from netsift.schema import DECISIONS, RECOMMENDATIONS, REPORT_STATUS

FLOW = ["case_id", "flow_index"]


def recommendation_table(spark: SparkSession) -> DataFrame:
    rows = [F.struct(F.lit(c).alias("predicted_class"), F.lit(s).alias("summary"), F.array(*map(F.lit, a)).alias("actions")) for c, (s, a) in RECOMMENDATIONS.items()]
    return spark.range(1).select(F.inline(F.array(*rows)))


def unknown_classes(findings: DataFrame) -> DataFrame:
    """Predicted classes, compared exactly, that no recommendation names."""
    return findings.join(F.broadcast(recommendation_table(findings.sparkSession)), "predicted_class", "left_anti").select("predicted_class").distinct()


def recommend(findings: DataFrame, strict: bool = False) -> DataFrame:
    """Findings with summary and actions; strict: an unknown class is an error, at the cost of a pass."""
    if strict and (bad := [r[0] for r in unknown_classes(findings).limit(20).collect()]):
        raise ValueError(f"no recommendation for {', '.join(map(str, bad))}")
    return findings.join(F.broadcast(recommendation_table(findings.sparkSession)), "predicted_class", "left")


def review_reason() -> Column:
    """Why a review is rejected, null if it is good."""
    ok = F.col("decision").isin(*DECISIONS)
    return F.when(blank(F.col("case_id")), "case missing").when(F.col("flow_index").isNull() | (F.col("flow_index") < 0), "flow index invalid").when(F.coalesce(~ok, F.lit(True)), "decision invalid")


def validate_reviews(log: DataFrame) -> DataFrame:
    return log.withColumn("notes", F.trim(F.coalesce("notes", F.lit("")))).withColumn("reason", review_reason())


def stamp(reviews: DataFrame) -> DataFrame:
    return reviews.withColumn("review_timestamp", F.current_timestamp())


def upsert(log: DataFrame, sequence: str = "event_id") -> DataFrame:
    """The newest review of each flow, by partial aggregates: of a flow with many reviews a row for each task is exchanged."""
    whole = F.struct(*[F.col(f"`{c}`") for c in log.columns])
    return log.groupBy(*FLOW).agg(F.max_by(whole, F.struct(F.col("review_timestamp"), F.col(sequence))).alias("newest")).select("newest.*")


def reviews_of_findings(reviews: DataFrame, findings: DataFrame) -> DataFrame:
    """Reviews that refer to a finding, with its class."""
    return reviews.join(findings.select(*FLOW, "predicted_class"), FLOW)


def reviews_without_finding(reviews: DataFrame, findings: DataFrame) -> DataFrame:
    return reviews.join(findings, FLOW, "left_anti")


def with_explanations(findings: DataFrame, explained: DataFrame, sequence: str | None = None) -> DataFrame:
    """A left join. Where a flow may have several explanations, `sequence` names the column that orders them, and the last
    counts; without it each flow has one."""
    kept = ("base_value", "contributors")
    if sequence is not None:
        explained = explained.groupBy(*FLOW).agg(F.max_by(F.struct(*kept), sequence).alias("one")).select(*FLOW, *[F.col("one")[c].alias(c) for c in kept])
    return findings.join(explained.select(*FLOW, *kept), FLOW, "left")


def look_up(keys: DataFrame, findings: DataFrame, explained: DataFrame, sequence: str | None = None) -> DataFrame:
    """For every key asked for its finding and contributors; found tells whether there is a finding."""
    have = with_explanations(findings, explained, sequence).select(*FLOW, "predicted_class", "confidence", "contributors", F.lit(True).alias("found"))
    return keys.select(*FLOW).distinct().join(have, FLOW, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def missing(keys: DataFrame, findings: DataFrame) -> DataFrame:
    """Keys asked for that no finding has."""
    return keys.join(findings, FLOW, "left_anti")


def triage_rows(findings: DataFrame, reviews: DataFrame) -> DataFrame:
    """Threats with priority, endpoint texts and review state."""
    rows = findings.where("is_threat").join(reviews.select(*FLOW, "decision"), FLOW, "left")
    return rows.select(
        *FLOW, "predicted_class", "confidence", priority(F.col("confidence")).alias("priority"), priority_rank(F.col("confidence")).alias("priority_rank"),
        triage_endpoint(F.col("source_ip"), F.col("source_port")).alias("source"), triage_endpoint(F.col("destination_ip"), F.col("destination_port")).alias("destination"),
        F.coalesce("decision", F.lit("Unreviewed")).alias("review"),
    )


def search(rows: DataFrame, text: str | None) -> DataFrame:
    if not (text or "").strip():
        return rows
    q = F.lit(text.strip().lower())
    found = [F.contains(F.lower(F.col(c).cast("string")), q) for c in ("flow_index", "predicted_class", "source", "destination")]
    return rows.where(found[0] | found[1] | found[2] | found[3])


def facets(rows: DataFrame, review: str = "All", predicted_class: str = "All", priority: str = "All") -> DataFrame:
    for column, value in (("review", review), ("predicted_class", predicted_class), ("priority", priority)):
        if not value.lower().startswith("all"):
            rows = rows.where(F.lower(column) == value.lower())
    return rows


def class_values(rows: DataFrame) -> DataFrame:
    return rows.where(~blank(F.col("predicted_class"))).groupBy("case_id", F.lower("predicted_class").alias("k")).agg(F.min("predicted_class").alias("predicted_class")).drop("k")


def _triage_order() -> tuple[Column, ...]:
    return F.when(F.col("review") == "Unreviewed", 0).otherwise(1).asc(), F.desc(F.round("confidence", 9)), F.col("flow_index").asc()


def triage_order(rows: DataFrame) -> DataFrame:
    """position: unreviewed first, then confidence from the top, then flow; no task sorts a whole case."""
    return ranked(rows, "position", *_triage_order()).withColumn("position", F.col("position").cast("int"))


def next_unreviewed(rows: DataFrame) -> DataFrame:
    """The first of each case in triage order, by an aggregate."""
    key = F.struct((-F.round("confidence", 9)).alias("c"), "flow_index")
    out = rows.where("review = 'Unreviewed'").groupBy("case_id").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "case_id"]), key).alias("one"))
    return out.select("case_id", "one.*").select(*rows.columns)


SORT_KEYS = ("flow_index", "predicted_class", "priority_rank", "confidence", "source", "destination", "review")


def sort_rows(rows: DataFrame, key: str, descending: bool = False) -> DataFrame:
    if key not in SORT_KEYS:
        raise ValueError(f"sort by one of {', '.join(SORT_KEYS)}")
    return rows.orderBy("case_id", F.desc(key) if descending else F.asc(key), "flow_index")


def class_distribution(findings: DataFrame) -> DataFrame:
    """Classes of a case, ignoring case and blanks: flows, percent, and position: benign, then count, then name."""
    name = or_default(F.trim("predicted_class"), "Unknown")
    out = findings.select("case_id", name.alias("name")).groupBy("case_id", F.lower("name").alias("k")).agg(F.min("name").alias("predicted_class"), F.count("*").alias("flows"))
    share = F.bround(F.col("flows") * 100.0 / F.sum("flows").over(Window.partitionBy("case_id")), 4)
    order = Window.partitionBy("case_id").orderBy(F.when(F.col("k") == "benign", 0).otherwise(1), F.desc("flows"), "k")
    return out.withColumn("percent", share).withColumn("position", F.row_number().over(order)).drop("k")


def counts_by_size(counts: DataFrame) -> DataFrame:
    order = Window.partitionBy("case_id").orderBy(F.desc("flows"), "predicted_class")
    return counts.withColumn("position", F.row_number().over(order))


def summary_agrees(summary: DataFrame, findings: DataFrame) -> DataFrame:
    """Whether a case's stored summary fits its findings."""
    found = findings.groupBy("case_id").agg(F.count("*").alias("f_total"), F.count_if("is_threat").alias("f_threats"))
    fits = (F.col("total_flows") == F.coalesce("f_total", F.lit(0))) & (F.col("threat_flows") == F.coalesce("f_threats", F.lit(0)))
    return summary.join(found, "case_id", "left").select("case_id", fits.alias("consistent"))


def review_summary(reviews: DataFrame) -> DataFrame:
    """Counts over all reviews of a case, those of benign flows too."""
    return reviews.groupBy("case_id").agg(F.count("*").alias("total_reviews"), *[F.count_if(F.col("decision") == d).alias(d.lower()) for d in DECISIONS])


def triage_counts(rows: DataFrame) -> DataFrame:
    """Counts over threats: reviewed of each kind, unreviewed, and how much is done."""
    out = rows.groupBy("case_id").agg(F.count("*").alias("threats"), *[F.count_if(F.col("review") == d).alias(d.lower()) for d in DECISIONS])
    done = sum((F.col(d.lower()) for d in DECISIONS[1:]), F.col(DECISIONS[0].lower()))
    out = out.withColumn("reviewed", done).withColumn("unreviewed", F.col("threats") - F.col("reviewed"))
    return out.withColumn("completion", F.when(F.col("threats") > 0, F.bround(F.col("reviewed") * 100.0 / F.col("threats"), 4)).otherwise(0.0))


def report_status(summary: DataFrame, reviews: DataFrame) -> DataFrame:
    n = F.coalesce("total_reviews", F.lit(0))
    left = F.greatest(F.lit(0), F.col("threat_flows") - n)
    said = lambda text: F.format_string(text, n, F.col("threat_flows"), left)
    text = F.when(F.col("threat_flows") == 0, REPORT_STATUS["none"]).when(left == 0, said(REPORT_STATUS["all"])).otherwise(said(REPORT_STATUS["some"]))
    return summary.join(review_summary(reviews), "case_id", "left").select("case_id", left.alias("unreviewed"), text.alias("status"))


def report_rows(findings: DataFrame, reviews: DataFrame) -> DataFrame:
    """Threats as a report lists them."""
    rows = recommend(findings.where("is_threat")).join(reviews.select(*FLOW, "decision", "notes"), FLOW, "left")
    return rows.select(
        *FLOW, "predicted_class", "confidence", or_default(F.col("decision"), "Not Reviewed").alias("review"), or_default(F.col("notes"), "--").alias("notes"),
        or_default(F.col("summary"), "No recommendation available.").alias("recommendation"), F.coalesce(F.size("actions"), F.lit(0)).alias("n_actions"),
    )


def case_report(summary: DataFrame, rows: DataFrame, reviews: DataFrame, per_row: int = 10_000) -> DataFrame:
    """Nested rows of each case: the summary, review counts and threats in order. A row holds the threats of `per_row`
    flows, so that a case with more flows has several rows, told apart by `chunk`, and no row grows with its case."""
    item = F.struct("flow_index", "predicted_class", "confidence", "review", "notes", "recommendation")
    threats = rows.groupBy("case_id", F.expr(f"flow_index div {per_row}").alias("chunk")).agg(F.array_sort(F.collect_list(item)).alias("threats"))
    out = summary.join(review_summary(reviews), "case_id", "left").join(threats, "case_id", "left")
    return out.withColumn("chunk", F.coalesce("chunk", F.lit(0)))


def case_details(catalog: DataFrame, summary: DataFrame, reviews: DataFrame) -> DataFrame:
    """A catalog's cases with the figures of their analysis and reviews; without an analysis the figures are null."""
    counts = review_summary(reviews).drop("total_reviews")
    out = catalog.join(summary, "case_id", "left").join(counts, "case_id", "left")
    return out.fillna(0, [d.lower() for d in DECISIONS])


def evidence_name(documents: DataFrame, files: DataFrame) -> DataFrame:
    """case_id and file_name of every case: the name in its document, or else the first of its files."""
    first = files.groupBy("case_id").agg(F.min("file_name").alias("first"))
    named = documents.select("case_id", F.when(~blank(F.col("file_name")), F.col("file_name")).alias("named"))
    return first.join(named, "case_id", "full").select("case_id", F.coalesce("named", "first").alias("file_name"))


def case_catalog(cases: DataFrame, documents: DataFrame, reviews: DataFrame) -> DataFrame:
    """Cases with status: Incomplete without a document, Invalid where it cannot be read, Analyzed, else Error."""
    state = F.when(F.col("has_document").isNull(), "Incomplete").when(~F.col("readable"), "Invalid").when(F.col("total_flows").isNotNull(), "Analyzed").otherwise("Error")
    out = cases.join(documents, "case_id", "left").join(review_summary(reviews).select("case_id", "total_reviews"), "case_id", "left")
    out = out.withColumn("status", state).withColumn("total_reviews", F.coalesce("total_reviews", F.lit(0)))
    return out.withColumn("openable", F.col("has_document").isNotNull() & (F.lower("status") == "analyzed")).orderBy(F.desc("case_id"))


def sort_positions(rows: DataFrame, key: str, descending: bool = False) -> DataFrame:
    """rows with their position in each case in the order of `sort_rows`, numbered by ranges: no task sorts a whole case."""
    if key not in SORT_KEYS:
        raise ValueError(f"sort by one of {', '.join(SORT_KEYS)}")
    return ranked(rows, "position", F.desc(key) if descending else F.asc(key), F.col("flow_index").asc()).withColumn("position", F.col("position").cast("int"))
