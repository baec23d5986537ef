"""Guards that need no run of their own: faults are counted while the rows pass, and looked at afterwards.

`observed` adds counts to a plan by `DataFrame.observe`; whatever action uses the rows fills them. The function that comes with the rows
raises if there were faults. `store.replace_cases` calls it between writing and showing, so a faulty table never counts.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from netsift.operators.cases import recommend
from netsift.schema import CLASSES


class Checked(NamedTuple):
    """Rows, and what to call when an action has used them all."""

    rows: DataFrame
    verify: Callable[[], dict[str, int]]


def observed(df: DataFrame, empty: str | None = None, **faults: Column) -> Checked:
    """df, with each fault (an expression; null counts as one) counted by name. `empty`: what to say if there are no rows."""
    seen = Observation()
    rows = df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(F.coalesce(x, F.lit(True))).alias(name) for name, x in faults.items()])

    def verify() -> dict[str, int]:
        counts = seen.get
        if empty and not counts["rows"]:
            raise ValueError(empty)
        if bad := {name: counts[name] for name in faults if counts[name]}:
            raise ValueError("; ".join(f"{name.replace('_', ' ')}: {n} of {counts['rows']} rows" for name, n in bad.items()))
        return counts

    return Checked(rows, verify)


def _not_finite(x: Column) -> Column:
    return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))


def checked_scores(scored: DataFrame) -> Checked:
    """Findings, of which there must be some, with 16 finite probabilities that sum to one, and a class that is known."""
    p = F.map_values("probabilities")
    return observed(
        scored, "the feature table is empty", probabilities_of_the_wrong_width=F.size("probabilities") != len(CLASSES), probabilities_not_finite=F.exists(p, _not_finite),
        probabilities_that_do_not_sum_to_one=F.abs(F.aggregate(p, F.lit(0.0), lambda a, b: a + b) - 1) > 1e-6, unknown_classes=~F.col("predicted_class").isin(*CLASSES),
    )


def checked_recommendations(findings: DataFrame) -> Checked:
    """Findings with summary and actions; a class that no recommendation names is a fault."""
    return observed(recommend(findings), classes_without_a_recommendation=F.col("summary").isNull())


def checked_explanations(explained: DataFrame, n_features: int, contributors: str = "contributors") -> Checked:
    """A row for each finding with its contributors: all there, each of the width of the model, and finite."""
    return observed(
        explained, explanations_missing=F.col(contributors).isNull(), explanations_of_the_wrong_width=F.coalesce(F.size(contributors), F.lit(n_features)) != n_features,
        contributions_not_finite=F.coalesce(F.exists(contributors, lambda x: _not_finite(x["shap_value"])), F.lit(False)),
    )
