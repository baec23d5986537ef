"""Linear models over any feature table: scaler and weights as tables, margins, scores and contributions.

A model is bounded by its features times its classes, so its tables are read into the plan as literals. Rows carry their
features as one array, in model order.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsift.operators.scoring import check_bundle, direction, finite, labelled

SCALER = "feature_id int, feature string, mean double, scale double"
WEIGHTS = "class_id int, class_name string, feature_id int, weight double"
BIASES = "class_id int, class_name string, bias double"


class LinearModel(NamedTuple):
    features: list[str]
    classes: list[str]
    means: list[float]
    scales: list[float]
    weights: list[list[float]]
    biases: list[float]


def fit_scaler(rows: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """Mean and population deviation of each feature, 1 where it does not vary; one aggregate of one pass."""
    of = [F.struct(F.lit(k).alias("feature_id"), F.lit(f).alias("feature"), F.avg(finite(F.col(f))).alias("mean"), F.stddev_pop(finite(F.col(f))).alias("scale")) for k, f in enumerate(features)]
    out = rows.agg(F.array(*of).alias("s")).select(F.inline("s"))
    return out.withColumn("mean", F.coalesce("mean", F.lit(0.0))).withColumn("scale", F.when(F.col("scale") > 1e-9 * (1 + F.abs("mean")), F.col("scale")).otherwise(1.0))


def scale(rows: DataFrame, scaler: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The keys and every feature of the scaler, standardised, under its own name."""
    table = sorted(scaler.collect(), key=lambda r: r["feature_id"])
    return rows.select(*keys, *[((finite(F.col(r["feature"]).cast("double")) - r["mean"]) / r["scale"]).alias(r["feature"]) for r in table])


def load_model(scaler: DataFrame, weights: DataFrame, biases: DataFrame, *, n_features: int = 74, n_classes: int = 16) -> LinearModel:
    """A model of its three tables; parts that disagree, or a number that is missing or not finite, are an error."""
    scaled, named = sorted(scaler.collect(), key=lambda r: r["feature_id"]), sorted(biases.collect(), key=lambda r: r["class_id"])
    held = {(r["class_id"], r["feature_id"]): r["weight"] for r in weights.collect()}
    features, classes = [r["feature"] for r in scaled], [r["class_name"] for r in named]
    check_bundle(features, classes, len({f for _, f in held}), len(scaled), n_features, n_classes)
    table = [[held.get((c["class_id"], f["feature_id"])) for f in scaled] for c in named]
    numbers = [*(x for row in table for x in row), *(r[k] for r in scaled for k in ("mean", "scale")), *(r["bias"] for r in named)]
    if any(x is None or x - x != 0 for x in numbers) or any(r["scale"] == 0 for r in scaled):
        raise ValueError("the model has missing, infinite or zero numbers")
    return LinearModel(features, classes, [r["mean"] for r in scaled], [r["scale"] for r in scaled], table, [r["bias"] for r in named])


def _literal(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _sum(values: Column, first: float) -> Column:
    return F.aggregate(values, F.lit(float(first)), lambda a, b: a + b)


def score_features(rows: DataFrame, model: LinearModel) -> DataFrame:
    """The rows, without their features, with x and z (raw and standardised, in model order), margins, and what `score` adds."""
    x = F.array(*[finite(F.col(f"`{f}`").cast("double")) for f in model.features])
    out = rows.select(*[c for c in rows.columns if c not in model.features], x.alias("x"))
    apart = F.zip_with("x", _literal(model.means), lambda a, b: a - b)
    out = out.withColumn("z", F.zip_with(apart, _literal(model.scales), lambda a, b: a / b))
    margins = F.array(*[F.round(_sum(F.zip_with("z", _literal(w), lambda a, b: a * b), b), 9) for w, b in zip(model.weights, model.biases, strict=True)])
    return labelled(out, margins, model.classes)


def feature_contributions(scored: DataFrame, model: LinearModel) -> DataFrame:
    """As `scoring.contributions`, a row for each flow and feature, of rows that `score_features` made."""
    weights, names = F.array(*map(_literal, model.weights)), F.array(*map(F.lit, model.features))
    of = lambda table: F.element_at(table, F.col("class_id") + 1)
    items = F.transform(F.arrays_zip(names.alias("feature"), F.col("x").alias("raw_value"), F.zip_with("z", of(weights), lambda a, b: a * b).alias("shap_value")), lambda i, n: F.struct(n.alias("feature_id"), i["feature"].alias("feature"), i["raw_value"].alias("raw_value"), i["shap_value"].alias("shap_value")))
    out = scored.select("case_id", "flow_index", "predicted_class", "confidence", of(_literal(model.biases)).alias("base_value"), of(F.col("margins")).alias("margin"), F.inline(items))
    return out.withColumn("direction", direction(F.round("shap_value", 9)))


def described(features: DataFrame, flows: DataFrame) -> DataFrame:
    """Feature rows with flow_index and what findings say about the flow."""
    told = flows.select("case_id", "flow_id", "source_ip", "source_port", "destination_ip", "destination_port", "protocol_number", "start_time")
    return features.join(told, ["case_id", "flow_id"]).withColumn("flow_index", F.col("flow_id") - 1).drop("flow_id")
