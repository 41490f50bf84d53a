"""The public surface: one object that ingests, indexes, searches, answers and reports.

Text generation and embedding sit behind protocols; the offline defaults are deterministic. Clock and year are
parameters, so results never depend on when they are made.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .functions import vocab
from .model import LEVELS, SECTION_KEYS, out_of_bounds, parse_response
from .operators import ann, hybrid, ingest, lexical, memory, quality, tables, vector, workflow
from .session import scratch

#: What each agent may call, and how much of a conversation it sees: (last messages, recalled messages, neighbours of each).
AGENTS = {
    "filing_query": (["vector_search", "rerank_search", "hybrid_search", "enhanced_search", "table_lookup", "read_table"], (20, 5, 10)),
    "financial_analysis": (["enhanced_search", "table_lookup", "read_table"], (10, 3, 5)),
    "business_strategy": (["enhanced_search"], (10, 0, 0)),
    "risk_assessment": (["enhanced_search"], (10, 0, 0)),
    "valuation": (["enhanced_search", "read_table"], (10, 0, 0)),
    "executive_summary": (["enhanced_search"], (15, 5, 10)),
    "structured_query": (["enhanced_search", "read_table"], (20, 5, 10)),
}
#: The workflows by name, as methods of Engine.
WORKFLOWS = {"query": "answer", "simple": "simple_answer", "research": "research"}
#: Sections of a report in the order they are written: names of the tiers of their quality, and what is searched for.
REPORT = {
    "financial_analysis": (("High", "Medium", "Low"), ["total revenue and growth", "gross margin and operating income", "operating cash flow"]),
    "business_strategy": (("High", "Medium", "Low"), ["market opportunity", "competition and competitive strengths", "growth strategy"]),
    "risk_assessment": (("Comprehensive", "Adequate", "Limited"), ["risk factors", "risks of operations", "legal and regulatory risks"]),
    "valuation": (("High", "Medium", "Low"), ["shares outstanding and capitalization", "use of proceeds", "revenue growth and margin"]),
    "executive_summary": (("High", "Medium", "Low"), ["business overview", "financial highlights"]),
}
#: Scopes of a report by its type, and how long it is said to take.
SCOPES = {
    "comprehensive": (["financial_analysis", "business_strategy", "risk_assessment", "valuation", "executive_summary"], "18-22 minutes"),
    "other": (["financial_analysis", "executive_summary"], "8-12 minutes"),
}
LIMITATIONS = ["Only the filing itself was read", "Markets and competitors may change", "Statements about the future are uncertain"]
SMOKE = ["revenue growth", "founder ownership", "risk factors", "financial performance"]
WORKING_MEMORY = "Question: {question}\nCompany: {company}\nFindings:\n{findings}"
HYDE = "Write what a filing of {company} would say in answer to: {query}\nUse the language of such filings, figures where they belong, and at most 100 words."
SECTION = "Write the section {section} on {company} as JSON with the keys {keys}.\nUse only the findings; leave out what they don't tell.\nEarlier sections: {earlier}\nFindings:\n{findings}"


@dataclass
class Engine:
    """chunks(id, content, section, page, embedding), their lexical index, and tables(filename, pos, cells) of one corpus.

    `build` makes them from page elements and writes them once; every question reads what is written.
    """

    spark: SparkSession
    chunks: DataFrame | None
    tables: DataFrame | None
    embedder: vector.Embedder = field(default_factory=vector.HashEmbedder)
    generator: workflow.TextGenerator | None = None
    as_of_year: int = 2025
    company: str = "Company"
    index: lexical.Index | None = None
    tree: ann.Tree | None = None

    @classmethod
    def build(cls, spark: SparkSession, elements: DataFrame, config: ingest.Config = ingest.Config(), embedder: vector.Embedder | None = None, path: str | None = None, tree: bool = False, **rest) -> Engine:
        """Writes chunks, index and tables below path, or a scratch folder; tree: and a tree of the vectors, for corpora too large to read them all in each search."""
        embedder, path = embedder or vector.HashEmbedder(), path or scratch(spark)
        made = ingest.chunks(elements, config)
        rows = vector.embed(made.select(F.concat_ws("/", "doc_id", "id").alias("id"), "content", F.col("section_hierarchy").alias("section"), F.col("page_idx").alias("page")), embedder, "content")
        rows.write.mode("overwrite").parquet(f"{path}/chunks")
        ingest.tables(elements).select("filename", F.posexplode("data").alias("pos", "cells")).write.mode("overwrite").parquet(f"{path}/tables")
        lexical.Index.build(spark.read.parquet(f"{path}/chunks"), f"{path}/index", "id", "content")
        if tree:
            ann.Tree.build(spark.read.parquet(f"{path}/chunks"), f"{path}/tree", "id")
        return cls.open(spark, path, embedder=embedder, **rest)

    @classmethod
    def open(cls, spark: SparkSession, path: str, **rest) -> Engine:
        """What `build` wrote below path."""
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/tree/shape/_SUCCESS")
        if "tree" not in rest and place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
            rest["tree"] = ann.Tree(spark, f"{path}/tree")
        return cls(spark, spark.read.parquet(f"{path}/chunks"), spark.read.parquet(f"{path}/tables"), index=lexical.Index(spark, f"{path}/index"), **rest)

    def tools(self) -> dict[str, Callable]:
        return {"vector_search": self.vector_search, "rerank_search": self.rerank_search, "hybrid_search": self.hybrid_search, "enhanced_search": self.enhanced_search, "table_lookup": self.table_lookup, "read_table": self.read_table}

    def tools_of(self, agent: str) -> dict[str, Callable]:
        known = self.tools()
        return {name: known[name] for name in AGENTS[agent][0]}

    def workflows(self) -> dict[str, Callable]:
        return {name: getattr(self, method) for name, method in WORKFLOWS.items()}

    def vector_of(self, text: str) -> list[float]:
        return self.embedder.embed([text])[0]

    def hypothetical(self, query: str) -> str:
        """A passage that would answer the query: the generator's, or the template's if there is none or it fails."""
        if self.generator:
            try:
                return self.generator.generate(HYDE.format(company=self.company, query=query))
            except Exception:  # noqa: BLE001  any failure of a remote model
                pass
        return self.spark.range(1).select(X.hypothetical(F.lit(query))).collect()[0][0]

    def variants(self, query: str, expand: bool = True, hyde: bool = False) -> list[tuple[str, list[float]]]:
        """The query, its first expansion and, if wanted, a hypothetical answer, each with its vector."""
        texts = [query]
        if expand:
            found = self.spark.range(1).select(X.expanded_queries(F.lit(query), self.company)).collect()[0][0]
            texts += [t for t in found[:2] if t != query]
        if hyde:
            texts.append(self.hypothetical(query))
        return [(t, self.vector_of(t)) for t in texts]

    def _near(self, query: str, k: int, where: Column | None = None) -> DataFrame:
        rows = self.chunks.where(where) if where is not None else self.chunks
        score = F.round(vector.cosine(F.col("embedding"), self.vector_of(query)), 6)
        return rows.select("id", "content", "section", "page", score.alias("score")).orderBy(F.desc("score"), "id").limit(k)

    def vector_search(self, query: str, k: int = 5, section: str | None = None, page: int | None = None, section_prefix: bool = False) -> DataFrame:
        where = F.lit(True)
        if section is not None:
            where = where & (F.col("section").startswith(section) if section_prefix else F.col("section") == section)
        if page is not None:
            where = where & (F.col("page") == page)
        return self._near(query, k, where)

    def rerank_search(self, query: str, k: int = 10, keep: int = 5, section: str | None = None, names: tuple[str, ...] = ()) -> DataFrame:
        """names: people of the company, in lower case, that count among the words of offices."""
        near = self._near(query, k, None if section is None else F.col("section") == section)
        return hybrid.rerank(near, query, keep, vocab.with_names(list(names)))

    def hybrid_search(self, query: str, k: int = 10, keep: int = 5, keyword_weight: float = 0.3) -> DataFrame:
        return hybrid.hybrid_rule(self._near(query, 2 * k), query, keep, keyword_weight)

    def enhanced_search(self, query: str, k: int = 10, vector_weight: float = 0.7, expand: bool = True, hyde: bool = False) -> DataFrame:
        return hybrid.enhanced(self.chunks, self.index, self.variants(query, expand, hyde), k, vector_weight, self.tree)

    def table_lookup(self, number: int | None = None, keyword: str | None = None, section: str | None = None) -> DataFrame:
        return tables.lookup(tables.catalog(self.tables), number, keyword, section)

    def read_table(self, number: int | None = None, keyword: str | None = None, row_text: str | None = None) -> DataFrame:
        return tables.read_table(self.tables, self.as_of_year, number, keyword, row_text)

    def healthy(self) -> bool:
        """The canned searches run."""
        for q in SMOKE:
            self.enhanced_search(q, 3).limit(1).collect()
        return True

    def analyse(self, query: str) -> dict:
        """The generator's reading of a query, with defaults for what it leaves out."""
        said = None
        if self.generator:
            said, _ = parse_response(self.generator.generate(query))
        route = self.spark.range(1).select(X.route(F.lit(query))).collect()[0][0]
        return {"query_type": route if route != "base" else "general", "search_terms": [query], "needs_tables": False, "sections": []} | (said if isinstance(said, dict) else {})

    def answer(self, query: str) -> dict:
        """Search by each term, dedupe, cite, rate and write; the few rows of an answer come to the driver."""
        read = self.analyse(query)
        rows = self.chunks if not read["sections"] else self.chunks.where(F.col("section") == read["sections"][0])
        found = workflow.fanout(rows, [(t, self.vector_of(t)) for t in read["search_terms"]])
        found = found.join(self.chunks.select("id", "page"), "id", "left")
        best = workflow.dedupe(found, ["content"], limit=10)
        best = self.spark.createDataFrame(best.collect(), best.schema).coalesce(1)
        listed = self.table_lookup(keyword=read["search_terms"][0]).select(F.lit(0).alias("pos"), "section", F.lit(None).cast("int").alias("page")) if read["needs_tables"] else best.select("pos", "section", "page").limit(0)
        out = {
            "query_type": read["query_type"],
            "context": workflow.context(best).collect()[0]["context"],
            "citations": [r.asDict() for r in workflow.citations(best, listed).orderBy("pos").collect()],
            "confidence": workflow.confidence(best).collect()[0]["confidence"],
        }
        prompt = WORKING_MEMORY.format(question=query, company=self.company, findings=out["context"])
        out["answer"] = (self.generator or workflow.TemplateGenerator(self.spark)).generate(prompt)
        return out

    def simple_answer(self, query: str) -> str:
        return (self.generator or workflow.TemplateGenerator(self.spark)).generate(query)

    def rated(self, body: dict[str, dict]) -> dict[str, str]:
        """The tier of each section by the quality of its data."""
        rows = self.spark.createDataFrame([(n, json.dumps(b)) for n, b in body.items()], "id string, j string")
        found = {r["id"]: r for r in quality.quality(quality.leaves(rows, "id", "j")).collect()}
        return {n: names[0] if found[n]["is_valid"] else names[1] if found[n]["data_points"] > 10 else names[2] for n, (names, _) in REPORT.items() if n in found}

    def report(self, sections: dict[str, dict], generated_at: str, scope: str = "comprehensive") -> dict:
        """A report of written sections, each cleaned and rated, with overall confidence and status.

        A missing section is empty; risks get an empty matrix and the scenarios. A section's confidence is what it says,
        or its tier.
        """
        scope = scope if scope in SCOPES else "other"
        body = {name: complete_risks(sections.get(name, {})) if name == "risk_assessment" else sections.get(name, {}) for name in REPORT}
        tiers = self.rated(body)
        as_level = {"Comprehensive": "High", "Adequate": "Medium", "Limited": "Low"}
        said = {n: sections.get(n, {}).get("confidence_level") for n in REPORT}
        levels = [said[n] if said[n] in LEVELS else as_level.get(t, t) for n, t in tiers.items()]
        overall = "High" if levels.count("High") >= 3 else "Medium" if levels.count("Medium") >= 3 else "Low"
        cleaned = {n: parse_response(b)[0] or {} for n, b in body.items()}
        status = "partial" if "Error:" in json.dumps(cleaned) else "complete"
        metadata = {"company": self.company, "report_date": generated_at[:10], "sections_completed": sum(map(bool, cleaned.values())), "confidence_score": f"{overall} confidence ({levels.count('High')} high, {levels.count('Medium')} medium sections)"}
        return {"generated_at": generated_at, "scopes": SCOPES[scope][0], "tiers": tiers, "overall_confidence": overall, "status": status, "report_metadata": metadata, "report_limitations": LIMITATIONS, "investment_research_report": cleaned}

    def section(self, name: str, earlier: dict[str, dict]) -> dict:
        """One section: searched for, written by the generator and parsed; a failure is a section that names it."""
        try:
            found: dict = {}
            for term in REPORT[name][1]:
                for r in self.enhanced_search(f"{term} of {self.company}", 3).collect():
                    found.setdefault(r["id"], r["content"])
            prompt = SECTION.format(section=name, company=self.company, keys=", ".join(SECTION_KEYS[name]), earlier=prompt_context(earlier), findings="\n\n".join(found.values()))
            body, missing = parse_response((self.generator or workflow.TemplateGenerator(self.spark)).generate(prompt), SECTION_KEYS[name])
            if not isinstance(body, dict):
                raise ValueError("the answer holds no data")
            if name == "risk_assessment":
                body = complete_risks(body)
                missing = [k for k in missing if k not in body]
            unfit = out_of_bounds(body, name)
            return body | ({"missing_fields": missing} if missing else {}) | ({"unfit_fields": unfit} if unfit else {})
        except Exception as reason:  # noqa: BLE001  a report goes on without a section
            return {"confidence_level": "Low", "supporting_evidence": [], "analysis_notes": [f"Error: {str(reason)[:200]}"]}

    def research(self, generated_at: str, analysis_type: str = "comprehensive") -> dict:
        """A report in seven steps: context, five sections in order, each knowing the earlier ones, and compilation."""
        scope = analysis_type if analysis_type in SCOPES else "other"
        context = {"document_available": not self.chunks.isEmpty(), "chunk_count": self.chunks.count(), "table_count": tables.catalog(self.tables).count(), "analysis_scope": SCOPES[scope][0], "estimated_duration": SCOPES[scope][1]}
        sections: dict[str, dict] = {}
        for name in REPORT:
            if name in SCOPES[scope][0]:
                sections[name] = self.section(name, sections)
        return self.report(sections, generated_at, scope) | {"research_context": context}

    def validate(self, report: dict) -> dict:
        """The score of a report and of its sections, what is missing, and advice."""
        body = report.get("investment_research_report") or report.get("final_report") or report
        rows = self.spark.createDataFrame(quality.section_rows(body), "section string, j string, citations int")
        counted = quality.quality(quality.leaves(rows, "section", "j")).withColumnRenamed("id", "section").join(rows.select("section", "citations"), "section")
        price, revenue = quality.errors_in(F.try_parse_json(F.lit(json.dumps(body))))
        parts = counted.select(F.lit("r").alias("report"), "section", "placeholders", "data_points", "citations", price.alias("price_error"), revenue.alias("revenue_error"))
        whole = quality.report_score(parts).collect()
        scores = {r["section"]: r["score"] for r in parts.withColumn("score", quality.section_score(F.col("placeholders"), F.col("data_points"), F.col("citations"))).collect()}
        if not whole:
            return {"score": 0, "is_valid": False, "sections": {}, "missing": quality.SECTIONS, "recommendations": []}
        r = whole[0]
        return {"score": r["score"], "is_valid": r["is_valid"], "sections": scores, "missing": [x for x in r["missing"].split(",") if x], "recommendations": [x for x in r["recommendations"].split("; ") if x]}

    def recall(self, messages: DataFrame, agent: str, query: str) -> DataFrame:
        """What an agent sees of a conversation: its last messages and, if it recalls, those like the query and their neighbours."""
        last, k, around = AGENTS[agent][1]
        seen = memory.last_messages(messages.select("conv_id", "turn", "role", "text"), last)
        if k:
            embedded = vector.embed(messages.select("conv_id", "turn", "role", "text"), self.embedder)
            seen = seen.unionByName(memory.semantic_recall(embedded, self.vector_of(query), k, around).drop("hit")).distinct()
        return seen


def complete_risks(section: dict) -> dict:
    """A risk section with categories, matrix, scenarios and confidence filled in where missing."""
    out = dict(section)
    kinds = ("market_risks", "operational_risks", "financial_risks", "regulatory_risks")
    groups = out.setdefault("risk_categories", {k: [] for k in kinds})
    risks = [r for k in kinds for r in groups.get(k) or []]
    of = lambda i, p: [r.get("risk") for r in risks if r.get("impact") == i and r.get("probability") == p]
    high, both = sum(r.get("impact") == "High" for r in risks), len(of("High", "High"))
    profile = "High Risk" if both >= 3 else "Aggressive" if both or high >= 5 else "Moderate" if high >= 2 else "Conservative"
    out.setdefault("risk_matrix", {"high_impact_high_probability": of("High", "High"), "high_impact_medium_probability": of("High", "Medium"), "medium_impact_high_probability": of("Medium", "High"), "overall_risk_profile": profile})
    names = {"base_case": "key_assumptions", "bull_case": "key_drivers", "bear_case": "key_risks"}
    out.setdefault("scenario_analysis", {k: {"scenario": text, "probability": p, names[k]: more} for k, text, p, more in vocab.SCENARIOS})
    out.setdefault("confidence_level", "Medium" if risks else "Low")
    out.setdefault("supporting_evidence", [])
    return out


def prompt_context(sections: dict[str, dict]) -> str:
    """What sections hold, for the prompts of later steps: their confidence, and how many items each of their lists has."""
    out = []
    for name, body in sections.items():
        sizes = [f"{len(v)} {k}" for k, v in body.items() if isinstance(v, list)]
        sizes += [f"{len(w)} {k}.{j}" for k, v in body.items() if isinstance(v, dict) for j, w in v.items() if isinstance(w, list)]
        out.append(f"{name}: " + ", ".join([f"confidence {body.get('confidence_level', 'unknown')}", *sizes]))
    return "; ".join(out)
