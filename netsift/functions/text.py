"""Text and label expressions, all plain columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from netsift.schema import HEADLINE, NARRATION

CASE_ID = r"^FX-\d{8}-\d{6}$"


def priority(confidence: Column) -> Column:
    return F.when(confidence >= 0.90, "High").when(confidence >= 0.70, "Medium").otherwise("Low")


def priority_rank(confidence: Column) -> Column:
    return F.when(confidence >= 0.90, 1).when(confidence >= 0.70, 2).otherwise(3)


def blank(text: Column) -> Column:
    return text.isNull() | (F.trim(text) == "")


def or_default(text: Column, default: str) -> Column:
    return F.when(blank(text), F.lit(default)).otherwise(text)


def triage_endpoint(ip: Column, port: Column) -> Column:
    """`--` without an address; the port only where it is positive."""
    return F.when(blank(ip), "--").when(F.coalesce(port, F.lit(0)) <= 0, ip).otherwise(F.concat(ip, F.lit(":"), port.cast("string")))


def dashboard_endpoint(ip: Column, port: Column) -> Column:
    """Unknown, the address, the port, or both."""
    p = port.cast("string")
    return F.when(blank(ip) & blank(p), "Unknown").when(blank(p), ip).when(blank(ip), p).otherwise(F.concat(ip, F.lit(":"), p))


def byte_size(n: Column) -> Column:
    """B, KB, MB or GB with two places, as shown on acquisition."""
    of = lambda k, unit: F.format_string(f"%.2f {unit}", n / float(1024**k))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024**2, of(1, "KB")).when(n < 1024**3, of(2, "MB")).otherwise(of(3, "GB"))


def report_size(n: Column) -> Column:
    """bytes, KB, MB or GB with thousands separators; -- where negative."""
    of = lambda k, unit: F.concat(F.format_number(n / float(1024**k), 2), F.lit(f" {unit}"))
    out = F.when(n < 0, "--").when(n < 1024, F.concat(F.format_number(n, 0), F.lit(" bytes")))
    return out.when(n < 1024**2, of(1, "KB")).when(n < 1024**3, of(2, "MB")).otherwise(of(3, "GB"))


def is_case_id(text: Column) -> Column:
    return text.rlike(CASE_ID)


def case_id(time: Column) -> Column:
    return F.date_format(time, "'FX'-yyyyMMdd-HHmmss")


def class_key(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "[-_ ]", ""))


def general_value(x: Column) -> Column:
    """%.6g without trailing zeros of the mantissa; N/A for null. Ties are told by the exact binary value and go to even,
    as in C and Python: format_string rounds the shortest decimal up, format_number does not."""
    to_six = lambda y: F.call_function("format_number", y, F.lit("0.00000E0")).try_cast("double")
    # of a whole double Java doesn't know that its digits are exact, of a long it does
    six = F.when((F.abs(x) < 2.0**63) & (x == F.floor(x)), to_six(x.cast("long"))).otherwise(to_six(x))
    six = F.when(F.isnan(x) | (F.abs(x) == float("inf")) | (x == 0), x).otherwise(six)
    tidy = F.regexp_replace(F.regexp_replace(F.format_string("%.6g", six), r"(\.\d*?)0+(e|$)", "$1$2"), r"\.(e|$)", "$1")
    return F.when(x.isNull(), "N/A").otherwise(tidy)


def percent(share: Column) -> Column:
    """A share as %.2f%%, ties as in `general_value`."""
    return F.concat(F.call_function("format_number", share * 100, F.lit("0.00")), F.lit("%"))


def filled(*texts: Column, default: str | None = None) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.when(t != "", t) for t in texts], F.lit(default))


def filled_number(*values: Column) -> Column:
    """The first that is neither null nor zero; the last as it is."""
    return F.coalesce(*[F.when(v != 0, v) for v in values[:-1]], values[-1])


def headline(predicted: Column, confidence: Column, strongest: Column) -> Column:
    """The sentence on a flow's prediction and its strongest contributor, a struct with feature and direction."""
    sure = percent(confidence)
    did = F.when(strongest["direction"] == "supports_prediction", "supported").when(strongest["direction"] == "opposes_prediction", "opposed")
    did = did.when(strongest["direction"] == "neutral", "had a neutral effect on").otherwise("influenced")
    some = F.format_string(HEADLINE["some"], predicted, sure, strongest["feature"], did)
    return F.when(strongest.isNull(), F.format_string(HEADLINE["none"], predicted, sure)).otherwise(some)


def narration(predicted: Column, contributors: Column) -> Column:
    """Up to three supporting and two opposing features in words; contributors by rank."""
    names = lambda keep, n: F.array_join(F.slice(F.transform(F.filter(contributors, keep), lambda x: x["feature"]), 1, n), ", ")
    start = F.format_string(NARRATION["start"], predicted)
    yes, no = names(lambda x: x["shap_value"] > 0, 3), names(lambda x: x["shap_value"] < 0, 2)
    parts = F.array(start, F.when(yes != "", F.format_string(NARRATION["yes"], yes)), F.when(no != "", F.format_string(NARRATION["no"], no)))
    empty = F.concat(start, F.lit(NARRATION["empty"]))
    return F.when(contributors.isNull() | (F.size(contributors) == 0), empty).otherwise(F.array_join(parts, " "))


def prompt(predicted: Column, confidence: Column, contributors: Column, n: int = 5) -> Column:
    """A grounded prompt for one flow: its class, confidence and first n contributors. No model is called."""
    line = lambda x: F.concat(F.lit("- "), x["feature"], F.lit(": value "), general_value(x["raw_value"]), F.lit(", contribution "), general_value(x["shap_value"]), F.lit(", "), x["direction"])
    sure = F.when(confidence.isNull(), "Not provided").otherwise(percent(confidence))
    head = F.concat(F.lit("Explain only from these facts.\nPredicted class: "), F.coalesce(predicted, F.lit("Unknown")), F.lit("\nConfidence: "), sure, F.lit("\n"))
    lines = F.array_join(F.transform(F.slice(contributors, 1, n), line), "\n")
    return F.concat(head, F.coalesce(lines, F.lit("")))
