"""The public surface end to end."""

import json

from quillspark.engine import AGENTS, Engine, complete_risks, prompt_context
from quillspark.plans.queries import ELEMENTS


def test_engine(spark):
    e = Engine.build(spark, ELEMENTS.literal.df(spark))
    assert e.healthy()
    assert e.vector_search("market risks", 3, section="RISK FACTORS", section_prefix=True).count() > 0
    assert e.vector_search("market", 3, page=11).count() >= 0
    assert e.enhanced_search("revenue growth?", hyde=True).count() > 0
    assert e.table_lookup(number=1).count() == 1
    assert e.read_table(number=1, row_text="revenue").count() == 1
    assert set(e.tools_of("valuation")) == {"enhanced_search", "read_table"} and len(AGENTS) == 7
    a = e.answer("What are the market risks?")
    assert a["query_type"] == "risk" and a["confidence"] in ("high", "medium", "low") and a["answer"]
    assert e.simple_answer("ownership").startswith("The beneficial")
    assert set(e.workflows()) == {"query", "simple", "research"} and e.workflows()["simple"]("growth")


class Writer:
    """Answers every prompt for a section with the same data, and fails where a passage is asked for."""

    def generate(self, prompt):
        if prompt.startswith("Write what a filing"):
            raise RuntimeError("no model")
        return 'Here it is:\n```json\n{"confidence_level": "High", "supporting_evidence": [{"section": "Risk Factors", "page": 1}], "notes": ["a long enough sentence", "another long sentence"], "x": "TBD", ' + ", ".join(f'"k{i}": {i}' for i in range(8)) + "}\n```"


def test_research_searches_writes_and_compiles(spark):
    e = Engine.build(spark, ELEMENTS.literal.df(spark), generator=Writer(), company="Acme")
    assert e.hypothetical("ownership").startswith("The beneficial")
    assert len(e.variants("revenue growth?", hyde=True)) == 3
    r = e.research("2025-01-01")
    body = r["investment_research_report"]
    assert list(body) == ["financial_analysis", "business_strategy", "risk_assessment", "valuation", "executive_summary"]
    assert r["research_context"]["chunk_count"] == e.chunks.count() and r["research_context"]["table_count"] == 2
    assert r["overall_confidence"] == "High" and r["status"] == "complete" and r["tiers"]["risk_assessment"] == "Comprehensive"
    assert "x" not in body["valuation"] and "price_target" in body["valuation"]["missing_fields"] and "risk_matrix" in body["risk_assessment"]
    v = e.validate(r)
    assert v["is_valid"] and v["missing"] == [] and "citations" in v["recommendations"]
    e.generator = None
    poor = e.research("2025-01-01", "quick_overview")
    assert poor["status"] == "partial" and poor["scopes"] == ["financial_analysis", "executive_summary"] and poor["overall_confidence"] == "Low"
    assert not e.validate({"final_report": {"executive_summary": {"price_target": {"target_price": "Error: none"}}}})["is_valid"]


def test_commands(spark, tmp_path, capsys):
    from quillspark.__main__ import main

    source, data = tmp_path / "elements.json", str(tmp_path / "data")
    source.write_text(json.dumps([{"type": "text", "text": "RISK FACTORS", "text_level": 1, "page_idx": 1}, {"type": "text", "text": "Competition may lower our revenue growth. " * 20, "page_idx": 2}, {"type": "table", "table_body": "<tr><td>Revenue</td><td>5</td></tr>", "page_idx": 3}]))
    got = main(["process", str(source), data], spark)
    assert got["total_tables"] == got["csv_files"] == 1 and got["indexed"] == got["total_chunks"] > 1
    assert (tmp_path / "data" / "csv" / "table_001_risk_factors.csv").read_text() == "Revenue,5"
    assert main(["init", data], spark) == {"healthy": True}
    assert main(["query", data, "revenue growth"], spark)[0]["search_method"] == "hybrid"
    assert main(["query", data, "competition", "--workflow"], spark)["answer"]
    assert main(["query", data, "risk of competition", "--structured"], spark)["schema"] == "risk"
    out = str(tmp_path / "r.json")
    assert main(["report", data, "--out", out], spark)["status"] == "partial"
    assert main(["validate", out, out], spark)["change"] == 0


def test_report(spark):
    e = Engine(spark, None, None)
    good = {f"k{i}": f"a long enough value {i}" for i in range(8)}
    r = e.report({"financial_analysis": good, "business_strategy": good, "valuation": good, "executive_summary": {"x": "TBD"}}, "2025-01-01")
    assert r["overall_confidence"] == "High" and r["status"] == "complete"
    assert r["investment_research_report"]["executive_summary"] == {}
    assert "scenario_analysis" in r["investment_research_report"]["risk_assessment"]
    assert e.report({"financial_analysis": {"x": "Error: none"}}, "t", "short")["status"] == "partial"


def test_risks_are_completed():
    r = complete_risks({"risk_categories": {"market_risks": [{"risk": "a", "impact": "High", "probability": "High"}]}})
    assert r["risk_matrix"]["high_impact_high_probability"] == ["a"] and r["risk_matrix"]["overall_risk_profile"] == "Aggressive"
    assert r["confidence_level"] == "Medium" and complete_risks({})["confidence_level"] == "Low"
    assert prompt_context({"a": {"x": [1, 2], "y": {"z": [1]}, "confidence_level": "Low"}}) == "a: confidence Low, 2 x, 1 y.z"


def test_memory_of_an_agent(spark):
    m = spark.createDataFrame([(1, i, "user", f"message about topic{i}") for i in range(40)], "conv_id long, turn long, role string, text string")
    e = Engine(spark, None, None)
    assert e.recall(m, "risk_assessment", "topic3").count() == 10
    assert e.recall(m, "filing_query", "topic3").where("turn = 3").count() == 1
