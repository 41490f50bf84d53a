"""JSON in answers, placeholders, risks, and the scoring of reports."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vocab
from ..functions.text import is_placeholder, trim

_SIGN = re.compile(vocab.PLACEHOLDER)


def extract_json(text: Column) -> Column:
    """The JSON text in an answer: all of it, the first fenced block, or the first "{" to the last "}"; else null."""
    valid = lambda c: F.when(F.try_parse_json(c).isNotNull(), trim(c))
    fence = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    some = lambda c: F.nullif(trim(c), F.lit(""))
    return F.coalesce(valid(some(text)), valid(some(fence)), valid(some(braces)))


def report_root(text: Column) -> Column:
    """The report inside a stored run: under one of two names, else the whole, as JSON text."""
    v = F.try_parse_json(text)
    return F.to_json(F.coalesce(F.try_variant_get(v, "$.investment_research_report", "variant"), F.try_variant_get(v, "$.final_report", "variant"), v))


def _clean(x):
    if isinstance(x, list):
        return [_clean(i) for i in x if not (isinstance(i, str) and _SIGN.search(i))]
    if isinstance(x, dict):
        out = {}
        for k, v in x.items():
            if isinstance(v, str) and _SIGN.search(v):
                continue
            v = _clean(v)
            if v is None or v == [] or v == {}:
                continue
            out[k] = v
        return out
    return x


def clean(x):
    """A JSON value without placeholder members, null fields and empty fields."""
    return _clean(x)


@F.pandas_udf(T.StringType())
def remove_placeholders(texts: pd.Series) -> pd.Series:
    """JSON without placeholder members, null fields and empty fields, batch by batch; null for what isn't JSON."""

    def one(text):
        try:
            return json.dumps(_clean(json.loads(text)), separators=(",", ":"), ensure_ascii=False)
        except (TypeError, ValueError):
            return None

    return texts.map(one)


WALK = T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())]))


def _walk(x, path, out):
    if isinstance(x, dict):
        for k, v in x.items():
            _walk(v, f"{path}.{k}" if path else k, out)
    elif isinstance(x, list):
        for i, v in enumerate(x):
            _walk(v, f"{path}[{i}]", out)
    else:
        kind = "null" if x is None else "boolean" if isinstance(x, bool) else "number" if isinstance(x, (int, float)) else "string"
        out.append((path, kind, None if x is None else x if isinstance(x, str) else json.dumps(x)))
    return out


@F.pandas_udf(WALK)
def json_walk(texts: pd.Series) -> pd.Series:
    """Paths, kinds and values of all leaves of a JSON text; empty for what isn't JSON."""

    def one(text):
        try:
            return _walk(json.loads(text), "", [])
        except (TypeError, ValueError):
            return []

    return texts.map(one)


def leaves(rows: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, path, kind, value) of all leaves; one row of nulls for a text without any."""
    return rows.select(F.col(id_col).alias("id"), F.explode_outer(json_walk(json_col)).alias("leaf")).select("id", "leaf.*")


def quality(leaves_: DataFrame) -> DataFrame:
    """(id, placeholders, data_points, is_valid, issues): strings over ten characters and numbers are data points; issues are the paths of placeholders.

    What has no leaves, or isn't JSON, has no points and isn't valid.
    """
    bad = F.coalesce((F.col("kind") == "string") & is_placeholder(F.col("value")), F.lit(False))
    point = ~bad & F.coalesce(((F.col("kind") == "string") & (F.length(trim(F.col("value"))) > 10)) | (F.col("kind") == "number"), F.lit(False))
    counted = leaves_.groupBy("id").agg(F.count_if(bad).alias("placeholders"), F.count_if(point).alias("data_points"), F.array_join(F.array_sort(F.collect_list(F.when(bad, F.col("path")))), ",").alias("issues"))
    return counted.withColumn("is_valid", (F.col("placeholders") == 0) & (F.col("data_points") > 5))


def section_score(placeholders: Column, points: Column, citations: Column) -> Column:
    return F.greatest(F.lit(0), 100 - placeholders * 10 - F.when(points < 5, 20).when(points < 10, 10).otherwise(0) - F.when(citations == 0, 15).otherwise(0))


SECTIONS = ["executive_summary", "financial_analysis", "business_strategy", "risk_assessment", "valuation"]


def errors_in(report: Column) -> tuple[Column, Column]:
    """Whether a report's JSON (as VARIANT) names an error where its price target, and its current revenue, should be."""
    at = lambda path: F.coalesce(F.try_variant_get(report, path, "string").contains("Error"), F.lit(False))
    return at("$.executive_summary.price_target.target_price"), at("$.financial_analysis.revenue_analysis.current_revenue")


def report_score(sections: DataFrame) -> DataFrame:
    """(report, score, is_valid, missing, recommendations) of scored sections (report, section, placeholders, data_points, citations, and if known price_error, revenue_error).

    A missing section is an issue; the score is the mean of those present, rounded half up; valid from 60 without issues.
    """
    for c in ("price_error", "revenue_error"):
        if c not in sections.columns:
            sections = sections.withColumn(c, F.lit(False))
    s = sections.withColumn("score", section_score(F.col("placeholders"), F.col("data_points"), F.col("citations")))
    a = s.groupBy("report").agg(F.floor(F.avg("score") + 0.5).cast("int").alias("score"), F.array_sort(F.array_except(F.array(*map(F.lit, SECTIONS)), F.collect_set("section"))).alias("missing"), F.sum("placeholders").alias("p"), F.sum("data_points").alias("d"), F.sum("citations").alias("c"), F.array_sort(F.collect_list(F.when(F.col("score") < 60, F.col("section")))).alias("low"), F.bool_or("price_error").alias("price"), F.bool_or("revenue_error").alias("revenue"))
    advice = F.array_compact(F.array(F.when(F.col("p") > 0, F.lit("placeholders")), F.when(F.col("d") < 50, F.lit("data points")), F.when(F.col("c") < 20, F.lit("citations")), F.when(F.size("low") > 0, F.concat(F.lit("Focus on improving: "), F.array_join("low", ", "))), F.when(F.col("price"), F.lit("price target")), F.when(F.col("revenue"), F.lit("revenue"))))
    return a.select("report", "score", ((F.col("score") >= 60) & (F.size("missing") == 0)).alias("is_valid"), F.array_join("missing", ",").alias("missing"), F.array_join(advice, "; ").alias("recommendations"))


def section_rows(report: dict) -> list[tuple[str, str, int]]:
    """(section, JSON, citations) of the sections that a report has."""
    return [(name, json.dumps(report[name]), len(e) if isinstance(e := report[name].get("supporting_evidence") if isinstance(report[name], dict) else None, list) else 0) for name in SECTIONS if report.get(name)]


def compare(old: DataFrame, new: DataFrame) -> DataFrame:
    """(section, old_score, new_score, change) of the sections in both."""
    return old.select("section", F.col("score").alias("old_score")).join(new.select("section", F.col("score").alias("new_score")), "section").withColumn("change", F.col("new_score") - F.col("old_score"))


def risk_profile(risks: DataFrame) -> DataFrame:
    """(id, overall_risk_profile) of risks (id, impact, probability)."""
    both = F.count_if((F.col("impact") == "High") & (F.col("probability") == "High"))
    high = F.count_if(F.col("impact") == "High")
    return risks.groupBy("id").agg(F.when(both >= 3, "High Risk").when((both >= 1) | (high >= 5), "Aggressive").when(high >= 2, "Moderate").otherwise("Conservative").alias("overall_risk_profile"))


def risk_matrix(risks: DataFrame) -> DataFrame:
    """(id, three lists of risks by impact and probability, confidence, scenarios) of risks (id, pos, risk, impact, probability)."""
    listed = lambda i, p: F.array_join(F.transform(F.sort_array(F.collect_list(F.when((F.col("impact") == i) & (F.col("probability") == p), F.struct("pos", "risk")))), lambda x: x["risk"]), "|")
    scenarios = "; ".join(f"{name}: {text} ({p})" for name, text, p, _ in vocab.SCENARIOS)
    return risks.groupBy("id").agg(listed("High", "High").alias("high_high"), listed("High", "Medium").alias("high_medium"), listed("Medium", "High").alias("medium_high"), F.when(F.count("risk") > 0, "Medium").otherwise("Low").alias("confidence_level")).withColumn("scenarios", F.lit(scenarios))


def merged(answers: list[dict]) -> dict:
    """Partial answers as one: lists are joined without repeats, objects merged likewise, of anything else the last that is neither null nor a placeholder stays."""
    out: dict = {}
    for answer in answers:
        for key, value in answer.items():
            if value is None or isinstance(value, str) and _SIGN.search(value):
                continue
            have = out.get(key)
            if isinstance(value, list):
                have = have if isinstance(have, list) else []
                out[key] = have + [x for i, x in enumerate(value) if x not in have and x not in value[:i]]
            elif isinstance(value, dict) and isinstance(have, dict):
                out[key] = merged([have, value])
            else:
                out[key] = value
    return out


@F.pandas_udf(T.StringType())
def merge_json(lists: pd.Series) -> pd.Series:
    """merged() of arrays of JSON texts; what isn't a JSON object is left out."""

    def one(texts):
        found = []
        for t in texts if texts is not None else []:
            try:
                x = json.loads(t)
            except (TypeError, ValueError):
                continue
            found += [x] if isinstance(x, dict) else []
        return json.dumps(merged(found), separators=(",", ":"), ensure_ascii=False)

    return lists.map(one)


def merge_responses(rows: DataFrame) -> DataFrame:
    """(id, merged) of partial answers (id, pos, body), deeply merged in their order."""
    bodies = F.transform(F.sort_array(F.collect_list(F.struct("pos", "body"))), lambda x: x["body"])
    return rows.groupBy("id").agg(bodies.alias("bodies")).select("id", merge_json("bodies").alias("merged"))


def merge_partials(rows: DataFrame) -> DataFrame:
    """(id, field, value, items) of partial answers (id, pos, field, value, items): the last value that is neither null nor a placeholder, and all items in order, once each."""
    value = F.when(F.col("value").isNotNull() & ~is_placeholder(F.col("value")), F.col("value"))
    items = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("pos", "items"))), lambda x: F.coalesce(x["items"], F.array().cast("array<string>"))))
    return rows.groupBy("id", "field").agg(F.max_by(value, F.when(value.isNotNull(), F.col("pos"))).alias("value"), F.array_join(F.array_distinct(items), ",").alias("items"))


def report_status(report: Column) -> Column:
    return F.when(report.contains("Error:"), "partial").otherwise("complete")
