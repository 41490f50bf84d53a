"""Commands: process, init, query, report and validate, over a folder that `process` fills.

    python -m quillspark process elements.json data/
    python -m quillspark query data/ "What is the revenue growth?" --workflow
    python -m quillspark report data/ --out report.json
    python -m quillspark validate report.json [older.json]
"""

from __future__ import annotations

import argparse
import json
import time
from pathlib import Path

from pyspark.sql import functions as F

from .engine import Engine
from .functions import text as X
from .model import ANSWERS, parse_response
from .operators import ingest
from .session import make_session
from .sources import readers


def process(a: argparse.Namespace, spark) -> object:
    """Elements to chunks, tables, index and files; embedding is part of it."""
    found = readers.elements(spark, a.elements)
    if a.many:  # the names alone are numbered
        names = found.select("file").distinct()
        found = found.join(names.withColumn("doc_id", F.row_number().over(ingest.Window.orderBy("file")).cast("long")), "file")
    else:
        found = found.withColumn("doc_id", F.lit(1).cast("long"))
    config = ingest.Config(a.size, a.overlap)
    chunks, tables = ingest.chunks(found, config), ingest.tables(found)
    readers.write_chunks(chunks, f"{a.data}/text_chunks", a.date)
    readers.write_envelope(chunks, tables, a.elements, a.date, f"{a.data}/import")
    files = readers.write_table_files(tables, str(Path(a.data, "csv").absolute()) if "://" not in a.data else f"{a.data}/csv").count()
    engine = Engine.build(spark, found, config, path=a.data)
    return ingest.corpus_stats(chunks, tables).collect()[0].asDict() | {"csv_files": files, "indexed": engine.index.n_docs}


def init(a: argparse.Namespace, spark) -> object:
    return {"healthy": Engine.open(spark, a.data).healthy()}


def query(a: argparse.Namespace, spark) -> object:
    engine = Engine.open(spark, a.data, company=a.company)
    if a.workflow:
        return engine.answer(a.question)
    if a.structured:
        route = spark.range(1).select(X.route(F.lit(a.question))).collect()[0][0]
        said = engine.answer(a.question)
        body, wrong = parse_response({"object": {"answer": said["answer"], "confidence": said["confidence"]}}, ANSWERS[route])
        return {"schema": route, "object": body, "misfits": wrong}
    return [r.asDict() for r in engine.enhanced_search(a.question).collect()]


def report(a: argparse.Namespace, spark) -> object:
    began = time.monotonic()
    out = Engine.open(spark, a.data, company=a.company).research(a.date, a.type)
    out["execution_time_minutes"] = round((time.monotonic() - began) / 60, 2)
    Path(a.out).write_text(json.dumps(out, indent=2, ensure_ascii=False))
    return {k: out[k] for k in ("status", "overall_confidence", "tiers")} | {"file": a.out}


def validate(a: argparse.Namespace, spark) -> object:
    engine = Engine(spark, None, None)
    new = engine.validate(json.loads(Path(a.report).read_text()))
    if not a.older:
        return new
    old = engine.validate(json.loads(Path(a.older).read_text()))
    both = [s for s in new["sections"] if s in old["sections"]]
    return new | {"change": new["score"] - old["score"], "section_changes": {s: new["sections"][s] - old["sections"][s] for s in both}}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="quillspark", description=__doc__.split("\n")[0])
    sub = out.add_subparsers(required=True)

    def command(f, *names: str) -> argparse.ArgumentParser:
        one = sub.add_parser(f.__name__, help=f.__doc__)
        one.set_defaults(run=f)
        for n in names:
            one.add_argument(n, **({"nargs": "?"} if n == "older" else {}))
        return one

    p = command(process, "elements", "data")
    p.add_argument("--size", type=int, default=512)
    p.add_argument("--overlap", type=int, default=50)
    p.add_argument("--date", default="")
    p.add_argument("--many", action="store_true", help="each file is a document of its own")
    command(init, "data")
    p = command(query, "data", "question")
    p.add_argument("--workflow", "-w", action="store_true")
    p.add_argument("--structured", action="store_true")
    p.add_argument("--company", default="Company")
    p = command(report, "data")
    p.add_argument("--out", default="report.json")
    p.add_argument("--type", default="comprehensive")
    p.add_argument("--date", default="")
    p.add_argument("--company", default="Company")
    command(validate, "report", "older")
    return out


def main(argv: list[str] | None = None, spark=None) -> object:
    a = parser().parse_args(argv)
    result = a.run(a, spark or make_session("local[*]", **{"spark.ui.showConsoleProgress": "false"}))
    print(json.dumps(result, ensure_ascii=False, default=str))
    return result


if __name__ == "__main__":
    main()
