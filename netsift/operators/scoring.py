"""Feature preparation, linear scoring, class summaries and signed contributions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netsift.schema import BENIGN, CLASSES, METADATA, STAND_IN, bias, snake, weight


def clean_name(name: str) -> str:
    return name.strip("﻿ \t\r\n")


def missing_features(df: DataFrame, features: tuple[str, ...]) -> list[str]:
    return [f for f in features if f not in {clean_name(c) for c in df.columns}]


def require_features(df: DataFrame, features: tuple[str, ...]) -> DataFrame:
    if missing := missing_features(df, features):
        raise ValueError(f"missing features: {', '.join(missing)}")
    return df


def ordered_features(df: DataFrame, features: tuple[str, ...], keys: tuple[str, ...] = ()) -> DataFrame:
    """The key columns and the features in the order of the contract; a missing feature is an error, extra columns go."""
    df = df.toDF(*[clean_name(c) for c in df.columns])
    return require_features(df, features).select(*[F.col(f"`{c}`") for c in (*keys, *features)])


def contract_report(df: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """One row per column or feature: available, missing or extra."""
    have = [clean_name(c) for c in df.columns]
    rows = [(f, "available" if f in have else "missing") for f in features] + [(c, "extra") for c in have if c not in features and c not in METADATA]
    return df.sparkSession.createDataFrame(rows, "column string, status string")


def check_bundle(features: list[str], classes: list[str], n_weights: int, n_scales: int, n_features: int = 74, n_classes: int = 16) -> None:
    """Raises on a model bundle whose parts disagree."""
    wrong = [
        *([f"{len(features)} features"] if len(features) != n_features else []), *(["duplicate features"] if len(set(features)) != len(features) else []),
        *([f"{len(classes)} classes"] if len(classes) != n_classes else []), *(["model and scaler widths differ"] if n_weights != n_scales else []),
    ]
    if wrong:
        raise ValueError("; ".join(wrong))


def number(text: Column) -> Column:
    """Text as a double; null where it is none."""
    return F.trim(text).try_cast("double")


def finite(x: Column) -> Column:
    """The value, 0.0 where it is null, infinite or not a number."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def safe_integer(text: Column) -> Column:
    """A whole number, cut towards zero; 0 where there is none."""
    return finite(number(text)).cast("long")


def safe_text(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def quality_report(df: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """Cells of text features that are no finite number: key, feature, value."""
    long = df.select(*keys, *[F.col(f).cast("string") for f in features]).unpivot(keys, features, "feature", "value")
    x = number(F.col("value"))
    return long.where(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def model_row(flows: DataFrame) -> DataFrame:
    """Flows with the features of the stand-in model under their column names."""
    named = {"Flow Duration": "flow_duration", "Packet Length Mean": "packet_length_mean", "Packet Length Max": "packet_length_max", "Total Fwd Packet": "forward_packets", "SYN Flag Count": "syn_count", "Total Length of Fwd Packet": "forward_bytes"}
    return flows.select("case_id", (F.col("flow_id") - 1).alias("flow_index"), "source_ip", "source_port", "destination_ip", "destination_port", "protocol_number", "start_time", *[finite(F.col(c).cast("double")).alias("x_" + snake(f)) for f, c in named.items()])


def _scaled(f: int) -> Column:
    name, mean, scale = STAND_IN[f]
    return (F.col("x_" + snake(name)) - mean) / scale


def margins() -> Column:
    """The margin of every class, one wide expression each, rounded so that summation order decides no label."""
    return F.array(*[F.round(reduce(lambda a, b: a + b, [F.lit(weight(c, f)) * _scaled(f) for f in range(len(STAND_IN))], F.lit(bias(c))), 9) for c in range(len(CLASSES))])


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Columns that are computed once: a generator of one row keeps the optimizer from copying them to every use."""
    made = F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.select("*", made)


def score(rows: DataFrame) -> DataFrame:
    """predicted_class (the lowest class id on ties), confidence, probabilities by class, is_threat."""
    return labelled(rows, margins(), list(CLASSES))


def labelled(rows: DataFrame, margins: Column, classes: list[str]) -> DataFrame:
    """The rows with their margins and what follows from these."""
    names = F.array(*map(F.lit, classes))
    out = once(once(rows, margins=margins), top=F.array_max("margins"))
    out = once(out, e=F.transform("margins", lambda x: F.exp(x - F.col("top"))))
    out = once(out, total=F.aggregate("e", F.lit(0.0), lambda s, y: s + y)).withColumn("class_id", F.array_position("margins", F.col("top")).cast("int") - 1)
    out = out.withColumn("predicted_class", F.element_at(names, F.col("class_id") + 1)).withColumn("confidence", 1.0 / F.col("total"))
    out = out.withColumn("probabilities", F.map_from_arrays(names, F.transform("e", lambda x: x / F.col("total"))))
    return out.withColumn("is_threat", is_threat(F.col("predicted_class"))).drop("top", "e", "total")


def is_threat(predicted: Column) -> Column:
    return F.lower(F.trim(predicted)) != BENIGN.lower()


def metadata() -> Column:
    at = F.concat_ws("-", "source_ip", "destination_ip", F.col("source_port").cast("string"), F.col("destination_port").cast("string"), F.col("protocol_number").cast("string"))
    return F.struct(at.alias("flow_id"), F.col("source_ip").alias("src_ip"), F.col("source_port").alias("src_port"), F.col("destination_ip").alias("dst_ip"), F.col("destination_port").alias("dst_port"), F.col("protocol_number").alias("protocol"), F.date_format("start_time", "yyyy-MM-dd HH:mm:ss").alias("timestamp"))


def require_rows(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise ValueError("the feature table is empty")
    return df


def require_probabilities(scored: DataFrame) -> DataFrame:
    p = F.map_values("probabilities")
    if not scored.where((F.size(p) != len(CLASSES)) | F.exists(p, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))).isEmpty():
        raise ValueError("probabilities are not finite or of the wrong width")
    return scored


def case_summary(scored: DataFrame) -> DataFrame:
    out = scored.groupBy("case_id").agg(F.count("*").alias("total_flows"), F.count_if(~F.col("is_threat")).alias("benign_flows"), F.count_if("is_threat").alias("threat_flows"))
    share = F.when(F.col("total_flows") > 0, F.bround(F.col("threat_flows") * 100.0 / F.col("total_flows"), 2)).otherwise(0.0)
    return out.withColumn("threat_percentage", share)


def class_counts(scored: DataFrame) -> DataFrame:
    return scored.groupBy("case_id", "predicted_class").agg(F.count("*").alias("flows"))


def direction(value: Column) -> Column:
    return F.when(value > 0, "supports_prediction").when(value < 0, "opposes_prediction").otherwise("neutral")


def direction_label(d: Column) -> Column:
    return F.when(d == "supports_prediction", "Supports").when(d == "opposes_prediction", "Opposes").otherwise("Neutral")


def contributions(scored: DataFrame) -> DataFrame:
    """A row for each flow and feature: what the feature adds to the margin of the predicted class."""
    per_class = lambda f: F.element_at(F.array(*[F.lit(weight(c, f)) for c in range(len(CLASSES))]), F.col("class_id") + 1)
    items = [F.struct(F.lit(f).alias("feature_id"), F.lit(STAND_IN[f][0]).alias("feature"), F.col("x_" + snake(STAND_IN[f][0])).alias("raw_value"), (per_class(f) * _scaled(f)).alias("shap_value")) for f in range(len(STAND_IN))]
    base = F.element_at(F.array(*[F.lit(bias(c)) for c in range(len(CLASSES))]), F.col("class_id") + 1)
    margin = F.element_at("margins", F.col("class_id") + 1)
    out = scored.select("case_id", "flow_index", "predicted_class", "confidence", base.alias("base_value"), margin.alias("margin"), F.inline(F.array(*items)))
    return out.withColumn("direction", direction(F.round("shap_value", 9)))


def top_contributors(contributed: DataFrame, n: int = 10) -> DataFrame:
    order = Window.partitionBy("case_id", "flow_index").orderBy(F.desc(F.round(F.abs("shap_value"), 9)), "feature_id")
    return contributed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def explanations(top: DataFrame) -> DataFrame:
    """Contributors nested per flow, by rank."""
    item = F.struct("rank", "feature", "raw_value", "shap_value", "direction")
    keys = ("case_id", "flow_index", "predicted_class", "confidence", "base_value")
    return top.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("contributors"))


#: Flows whose contributors one row of `features_by_flow` holds at most.
FLOWS_PER_ROW = 10_000


def features_by_flow(explained: DataFrame, per_row: int = FLOWS_PER_ROW) -> DataFrame:
    """case_id, chunk and the contributors of up to `per_row` flows as a map by flow index; a large case has many chunks."""
    entry = F.struct(F.col("flow_index").cast("string"), F.col("contributors"))
    chunk = F.expr(f"flow_index div {per_row}").alias("chunk")
    return explained.groupBy("case_id", chunk).agg(F.map_from_entries(F.collect_list(entry)).alias("top_features_per_flow"))


def additivity(contributed: DataFrame) -> DataFrame:
    out = contributed.groupBy("case_id", "flow_index", "base_value", "margin").agg(F.sum("shap_value").alias("total"))
    return out.select("case_id", "flow_index", (F.abs(F.col("base_value") + F.col("total") - F.col("margin")) < 1e-4).alias("adds_up"))


def explanation_faults(scored: DataFrame, contributed: DataFrame, n_features: int = len(STAND_IN)) -> DataFrame:
    """case_id, flow_index and fault of flows whose explanation is missing, of the wrong width, not finite or of an unknown class."""
    bad = F.col("shap_value").isNull() | F.isnan("shap_value") | (F.abs("shap_value") == float("inf"))
    seen = contributed.groupBy("case_id", "flow_index").agg(F.count("*").alias("width"), F.max(bad).alias("bad"))
    fault = F.when(F.col("width").isNull(), "missing").when(F.col("width") != n_features, "width").when(F.col("bad"), "not finite")
    fault = fault.when(F.coalesce(~F.col("predicted_class").isin(*CLASSES), F.lit(True)), "unknown class")
    found = scored.select("case_id", "flow_index", "predicted_class").join(seen, ["case_id", "flow_index"], "left")
    return found.select("case_id", "flow_index", fault.alias("fault")).where("fault is not null")


def require_explanations(scored: DataFrame, contributed: DataFrame, n_features: int = len(STAND_IN)) -> DataFrame:
    if not (faults := explanation_faults(scored, contributed, n_features)).isEmpty():
        raise ValueError(f"explanations do not fit the findings: {faults.first()}")
    return contributed


def global_importance(contributed: DataFrame, n: int = 12) -> DataFrame:
    out = contributed.groupBy("predicted_class", "feature_id", "feature").agg(F.avg(F.abs("shap_value")).alias("mean_abs_shap"), F.avg("shap_value").alias("mean_signed_shap"))
    order = Window.partitionBy("predicted_class").orderBy(F.desc(F.round("mean_abs_shap", 6)), "feature_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def stratified_sample(scored: DataFrame, per_class: int) -> DataFrame:
    """The same flows in every run: of each class those with the smallest hash of their key."""
    order = Window.partitionBy("predicted_class").orderBy(F.md5(F.concat_ws("/", "case_id", F.col("flow_index").cast("string"))), "case_id", "flow_index")
    return scored.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= per_class).drop("nth")
