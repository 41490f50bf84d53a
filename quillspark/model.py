"""Schemas of answers and reports, and their checks."""

from __future__ import annotations

import json
import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators.quality import clean, extract_json

CITATION = "struct<section: string, page: int, quote: string, table_number: int>"
METRIC = "struct<name: string, value: string, period: string, trend: string>"
#: Answer schemas by route.
ANSWERS = {
    "base": f"answer string, citations array<{CITATION}>, confidence string",
    "ownership": f"answer string, owners array<struct<name: string, shares: string, percentage: string, voting_power: string>>, citations array<{CITATION}>, confidence string",
    "financial": f"answer string, metrics array<{METRIC}>, citations array<{CITATION}>, confidence string",
    "risk": f"answer string, risks array<struct<risk: string, category: string, severity: string>>, citations array<{CITATION}>, confidence string",
    "business": f"answer string, aspects array<struct<aspect: string, description: string>>, citations array<{CITATION}>, confidence string",
}


#: Sections of a report: the keys that each must hold; a confidence level is one of LEVELS.
LEVELS = ["High", "Medium", "Low"]
SECTION_KEYS = {
    "financial_analysis": ["revenue_analysis", "profitability_analysis", "cash_flow_analysis", "key_financial_metrics", "confidence_level", "supporting_evidence"],
    "business_strategy": ["market_opportunity", "competitive_positioning", "business_model", "growth_strategy", "customer_analysis", "confidence_level", "supporting_evidence"],
    "risk_assessment": ["risk_categories", "risk_matrix", "scenario_analysis", "confidence_level", "supporting_evidence"],
    "valuation": ["valuation_methodologies", "price_target", "sensitivity_analysis", "investment_thesis", "confidence_level", "supporting_evidence"],
    "executive_summary": ["investment_recommendation", "price_target", "key_investment_highlights", "financial_snapshot", "top_risks", "catalysts", "confidence_level", "supporting_evidence"],
}


#: What fields of a section may hold, and the most items of a list ("[]" stands for each item).
LEVELS_OF_RISK = {f"risk_categories.{kind}[].{field}": LEVELS for kind in ("market_risks", "operational_risks", "financial_risks", "regulatory_risks") for field in ("probability", "impact")}
TRENDS = ["Improving", "Declining", "Stable", "Unknown"]
VALUES = {
    "executive_summary": {
        "investment_recommendation": ["Strong Buy", "Buy", "Hold", "Sell", "Strong Sell"],
        "key_investment_highlights[].impact": ["Positive", "Negative", "Neutral"],
        "top_risks[].impact": LEVELS,
        "catalysts[].impact": LEVELS,
        "confidence_level": LEVELS,
    },
    "financial_analysis": {
        "revenue_analysis.revenue_model.revenue_streams[].growth_trajectory": ["Accelerating", "Stable", "Decelerating"],
        "profitability_analysis.gross_margins.trend": ["Improving", "Declining", "Stable"],
        "profitability_analysis.efficiency_metrics[].trend": TRENDS,
        "key_financial_metrics[].trend": TRENDS,
        "confidence_level": LEVELS,
    },
    "business_strategy": {
        "competitive_positioning.competitive_moats[].strength": ["Strong", "Moderate", "Weak"],
        "business_model.customer_segments[].growth_potential": LEVELS,
        "confidence_level": LEVELS,
    },
    "risk_assessment": LEVELS_OF_RISK | {"risk_matrix.overall_risk_profile": ["Conservative", "Moderate", "Aggressive", "High Risk"], "confidence_level": LEVELS},
    "valuation": {"confidence_level": LEVELS},
}
MOST = {"executive_summary": {"key_investment_highlights": 5, "top_risks": 3, "catalysts": 3}}


def parse_answer(text: Column, route: str) -> Column:
    """An answer's JSON as the struct of its route; fields that don't fit are null."""
    return F.from_json(extract_json(text), ANSWERS[route])


def json_in(text: str) -> Any:
    """The JSON value in a text: all of it, its first fenced block, or what its outer braces hold; None if there is none."""
    fence, braces = re.search(r"```(?:json)?\s*(.*?)```", text, re.S), re.search(r"\{.*\}", text, re.S)
    for part in (text, fence and fence[1], braces and braces[0]):
        try:
            return json.loads(part)
        except (TypeError, ValueError):
            continue
    return None


def misfits(value: Any, kind: T.DataType | list[str], path: str = "") -> list[str]:
    """Paths of a JSON value that don't fit a type, or keys of a list that it lacks; a missing field of a type fits."""
    if isinstance(kind, list):
        return [k for k in kind if not isinstance(value, dict) or k not in value]
    if value is None:
        return []
    if isinstance(kind, T.StructType):
        if not isinstance(value, dict):
            return [path]
        return [p for f in kind.fields for p in misfits(value.get(f.name), f.dataType, f"{path}.{f.name}".lstrip("."))]
    if isinstance(kind, T.ArrayType):
        return [p for i, x in enumerate(value) for p in misfits(x, kind.elementType, f"{path}[{i}]")] if isinstance(value, list) else [path]
    kinds = {T.StringType: str, T.IntegerType: int, T.LongType: int, T.DoubleType: (int, float), T.BooleanType: bool}
    return [] if isinstance(value, kinds.get(type(kind), object)) and (not isinstance(value, bool) or isinstance(kind, T.BooleanType)) else [path]


def at(value: Any, path: str, said: str = "") -> list[tuple[str, Any]]:
    """(path, value) of what a path names in a JSON value; each item of a list where it has "[]"."""
    head, _, rest = path.partition(".")
    name = head.removesuffix("[]")
    if not isinstance(value, dict) or name not in value:
        return []
    here = f"{said}.{name}".lstrip(".")
    found = [(f"{here}[{i}]", x) for i, x in enumerate(value[name])] if head.endswith("[]") and isinstance(value[name], list) else [] if head.endswith("[]") else [(here, value[name])]
    return [y for p, x in found for y in at(x, rest, p)] if rest else found


def out_of_bounds(value: Any, section: str) -> list[str]:
    """Paths of a section's fields that hold none of their values, and of lists with too many items."""
    wrong = [p for path, allowed in VALUES.get(section, {}).items() for p, x in at(value, path) if x not in allowed]
    return wrong + [p for path, most in MOST.get(section, {}).items() for p, x in at(value, path) if isinstance(x, list) and len(x) > most]


def parse_response(response: Any, kind: T.DataType | list[str] | str | None = None, strict: bool = False, section: str | None = None) -> tuple[Any, list[str]]:
    """An agent's answer without placeholders and nulls, and the paths in which it doesn't fit `kind` (a type, its DDL, or keys); (None, []) if it holds no data.

    section: of a report, whose fields' values and lists' lengths are checked too.

    A response is a text, or a mapping whose "object" is the data, whose "text" holds it, or which is the data. What
    doesn't fit is returned all the same, unless strict, when that and a response without data raise ValueError.
    """
    if isinstance(response, dict):
        found = response.get("object") or (json_in(response["text"]) if response.get("text") else response)
    else:
        found = json_in(response) if isinstance(response, str) else None
    if not found:
        if strict:
            raise ValueError("no data in the response")
        return None, []
    found = _without_nulls(clean(found))
    if isinstance(kind, str):
        kind = T.StructType.fromDDL(kind)
    wrong = (misfits(found, kind) if kind is not None else []) + (out_of_bounds(found, section) if section else [])
    if strict and wrong:
        raise ValueError(f"the response doesn't fit at {', '.join(wrong)}")
    return found, wrong


def _without_nulls(x: Any) -> Any:
    if isinstance(x, dict):
        return {k: _without_nulls(v) for k, v in x.items() if v is not None}
    return [_without_nulls(v) for v in x] if isinstance(x, list) else x
