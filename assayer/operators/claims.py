"""Checking drafted numeric claims against computed metrics."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from assayer.functions.spreading import spread
from assayer.settings import ClaimSettings

# Fixed value: one fenced block around the whole text, with an optional json tag.
FENCE = r"(?s)^```(?:json)?\s*(.*?)\s*```$"
SMALLEST = 1e-9  # fixed value: floor of the magnitude a tolerance is relative to


def metric_stats(metrics: DataFrame) -> DataFrame:
    """Adds the interval width and the width relative to the value; NULL where undefined."""
    width = F.col("ci_high") - F.col("ci_low")
    return metrics.withColumn("ci_width", width).withColumn(
        "relative_ci_width",
        F.when(F.col("value") != 0, F.abs(F.try_divide(width, F.col("value")))),
    )


@F.pandas_udf(T.StringType())
def six_digits(values: pd.Series) -> pd.Series:
    """Six significant digits in the shortest C style, which the JVM formatter does not have."""
    return values.map(lambda v: None if v is None or pd.isna(v) else f"{v:.6g}")


def _digits_text(value: Column) -> Column:
    return F.when(F.isnan(value), "nan").otherwise(six_digits(value))


def grounding_facts(stats: DataFrame) -> DataFrame:
    """(metric_name, text): each metric spelled out with its interval."""
    shown = stats.select(
        F.col("name").alias("metric_name"),
        _digits_text(F.col("value")).alias("v"),
        six_digits("ci_low").alias("l"),
        six_digits("ci_high").alias("h"),
    )
    with_ci = F.concat(
        "metric_name", F.lit(" = "), "v", F.lit(" (95% CI ["), "l", F.lit(", "), "h", F.lit("])")
    )
    without = F.concat("metric_name", F.lit(" = "), "v", F.lit(" (no confidence interval available)"))
    both = F.col("l").isNotNull() & F.col("h").isNotNull()
    return shown.select("metric_name", F.when(both, with_ci).otherwise(without).alias("text"))


def parse_drafts(drafts: DataFrame, response: str = "response") -> DataFrame:
    """``drafts`` with ``claims`` (array of name, value, statement) and ``draft_error``.

    A response is taken whole or not at all: one bad element rejects it, and the error says why.
    """
    if not drafts.isStreaming:
        drafts = spread(drafts, drafts.count())  # parsing is heavy row work, and short texts come in few splits
    text = F.trim(F.regexp_replace(F.col(response), r"^\s+|\s+$", ""))
    inner = F.when(text.rlike(FENCE), F.regexp_extract(text, FENCE, 1)).otherwise(text)
    # each stage is a column of its own, so that the text is parsed once per form
    staged = (
        drafts.withColumn("_json", inner)
        .withColumn("_value", F.try_parse_json("_json"))
        .withColumn("_kind", F.schema_of_variant("_value"))
        .withColumn("_items", F.from_json("_json", "array<string>"))
        .withColumn("_fields", F.from_json("_json", "array<map<string,string>>"))
    )
    names = ("metric_name", "stated_value", "statement")

    def lacks(m: Column) -> Column:
        has = [F.map_contains_key(m, n) for n in names]
        return ~(has[0] & has[1] & has[2])

    not_object = F.exists("_items", lambda x: x.isNull() | ~F.ltrim(x).startswith("{"))
    error = (
        F.when(F.col("_value").isNull(), "the response is not valid JSON")
        .when(~F.col("_kind").startswith("ARRAY"), "the response is not a JSON array")
        .when(not_object, "an element is not a JSON object")
        .when(F.exists("_fields", lacks), "an element lacks a required field")
        .when(
            F.exists("_fields", lambda m: _as_number(m["stated_value"]).isNull()),
            "a stated_value is not a number",
        )
    )
    claims = F.transform(
        "_fields",
        lambda m: F.struct(
            # a JSON null is spelled out, as text
            F.coalesce(m["metric_name"], F.lit("None")).alias("metric_name"),
            _as_number(m["stated_value"]).alias("stated_value"),
            F.coalesce(m["statement"], F.lit("None")).alias("statement"),
        ),
    )
    empty = F.array().cast("array<struct<metric_name:string,stated_value:double,statement:string>>")
    return (
        staged.withColumn("draft_error", error)
        .withColumn("claims", F.when(F.col("draft_error").isNull(), claims).otherwise(empty))
        .drop("_json", "_value", "_kind", "_items", "_fields")
    )


def _as_number(text: Column) -> Column:
    """Numbers and numeric strings; JSON booleans count as 1 and 0."""
    return (
        F.when(text == "true", 1.0).when(text == "false", 0.0).otherwise(F.trim(text).try_cast("double"))
    )


def drafted_claims(parsed: DataFrame, keep: list[str]) -> DataFrame:
    """One row per claim with its position; rejected responses have none."""
    # the outer form, since the inner one has the optimizer infer a filter on the claims, which parses every response again
    listed = parsed.select(*keep, F.posexplode_outer("claims").alias("position", "_c")).where("position IS NOT NULL")
    return listed.select(*keep, "position", "_c.*")


def last_by_name(stats: DataFrame, order: str) -> DataFrame:
    """One row per metric name: of repeated names the last one counts."""
    rest = [c for c in stats.columns if c != "name"]
    # a null order counts as least, but its metric still counts
    rank = F.struct(F.col(order).isNotNull(), F.col(order))
    return stats.groupBy("name").agg(F.max_by(F.struct(*rest), rank).alias("_s")).select("name", "_s.*")


def verify_claims(
    claims: DataFrame, stats: DataFrame, settings: ClaimSettings | None = None, reasons: bool = True,
    order: str | None = None,
) -> DataFrame:
    """``claims`` with actual_value, relative_ci_width, verified and rejection_reason.

    One row per claim: of metrics with the same name the last by ``order`` counts, without it the largest value.

    A left join by metric name; the runtime plan broadcasts the metrics when they are measured to be
    small and otherwise splits a name that holds a large share of the claims.
    """
    s = settings or ClaimSettings()
    known = last_by_name(stats.select("name", "value", "relative_ci_width", *([order] if order else [])), order or "value")
    known = known.select(
        F.col("name").alias("_name"), F.col("value").alias("actual_value"), "relative_ci_width"
    )
    joined = claims.join(known, F.col("metric_name") == F.col("_name"), "left")
    allowed = F.greatest(F.abs("actual_value"), F.lit(SMALLEST)) * s.relative_tolerance
    close = F.abs(F.col("stated_value") - F.col("actual_value")) <= allowed
    out = joined.withColumn(
        "verified", F.col("_name").isNotNull() & F.coalesce(close, F.lit(False))
    )
    if reasons:
        off = F.concat(
            F.lit("stated "), _digits_text(F.col("stated_value")), F.lit(" but computed "),
            _digits_text(F.col("actual_value")), F.lit(", tolerance "), _digits_text(allowed),
        )
        unknown = F.concat(F.lit("no computed metric is named "), F.col("metric_name"))
        out = out.withColumn(
            "rejection_reason",
            F.when(F.col("_name").isNull(), unknown).when(~F.col("verified"), off),
        )
    return out.drop("_name")


def score_confidence(verified: DataFrame, settings: ClaimSettings | None = None) -> DataFrame:
    """Verified claims with confidence_label and confidence_score."""
    s = settings or ClaimSettings()
    w = F.col("relative_ci_width")
    label = (
        F.when(w.isNull(), "unknown")
        .when(w <= s.high_max_relative_width, "high")
        .when(w >= s.inconclusive_min_relative_width, "inconclusive")
        .otherwise("moderate")
    )
    return (
        verified.where("verified")
        .withColumn("confidence_label", label)
        .withColumn("confidence_score", 1.0 / (1.0 + w))
    )


def emit_or_flag(verified: DataFrame, settings: ClaimSettings | None = None) -> DataFrame:
    """All claims with a bucket: accepted, flagged or rejected."""
    scored = score_confidence(verified, settings)
    sure = F.col("confidence_label").isin("high", "moderate")
    kept = scored.withColumn("bucket", F.when(sure, "accepted").otherwise("flagged"))
    lost = (
        verified.where("NOT verified")
        .withColumn("confidence_label", F.lit(None).cast("string"))
        .withColumn("confidence_score", F.lit(None).cast("double"))
        .withColumn("bucket", F.lit("rejected"))
    )
    return kept.unionByName(lost)


def interval_95(mean: Column, deviation: Column, n: Column) -> tuple[Column, Column]:
    half = 1.96 * deviation / F.sqrt(n)
    return mean - half, mean + half


