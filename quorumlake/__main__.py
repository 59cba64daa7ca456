"""Command line: fetch sources, build tables from snapshots, audit a build, profile a source, query a database."""

from __future__ import annotations

import argparse
import json
from pathlib import Path


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quorumlake", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build", help="reconcile snapshots by templates")
    b.add_argument("--root", required=True, help="folder of snapshots")
    b.add_argument("--templates", required=True, help="folder of templates")
    b.add_argument("--database", required=True)
    b.add_argument("--export", help="folder for public tables as Parquet")
    b.add_argument("--source", action="append", help="only these sources")
    b.add_argument("--test", action="store_true", help="replay the ledger against the tables afterwards")
    b.add_argument("--test-coverage", action="store_true", help="report which source fields reach the tables")
    g = sub.add_parser("fetch", help="bring the sources' documents into snapshots")
    g.add_argument("--config", required=True, help="registry of sources (YAML or JSON)")
    g.add_argument("--root", required=True)
    g.add_argument("--source", action="append", help="only these sources")
    g.add_argument("--force", action="store_true")
    r = sub.add_parser("load-arrays", help="every top-level array of a JSON document as a table")
    r.add_argument("--document", required=True)
    r.add_argument("--database", required=True)
    c = sub.add_parser("submit", help="append a CSV file of submissions")
    c.add_argument("--csv", required=True)
    c.add_argument("--folder", required=True)
    f = sub.add_parser("profile", help="draft a template from a document")
    for name in ("--root", "--source"):
        f.add_argument(name, required=True)
    f.add_argument("--endpoint", help="all documents of the source without it")
    f.add_argument("--previous", help="template to keep decisions of")
    q = sub.add_parser("sql", help="query the tables of a database")
    q.add_argument("--database", required=True)
    q.add_argument("text")
    return p


def main(argv: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    from quorumlake.operators import audit
    from quorumlake.operators.extract import unwrap
    from quorumlake.operators.profiling import detect_shape, draft_template, profile_source
    from quorumlake.plans.build import build_all, replay_build
    from quorumlake.plans.domains import Source
    from quorumlake.sources import sinks
    from quorumlake.sources.documents import read_document
    from quorumlake.sources.registry import fetch_all
    from quorumlake.sources.templates import load_templates, parse_config, template_from

    a = parser().parse_args(argv)
    if a.command == "fetch":
        found = fetch_all(parse_config(Path(a.config).read_text("utf-8")), a.root, a.source, a.force)
        print(json.dumps({k: str(v) for k, v in found.items()}))
        return 0 if all(isinstance(v, Path) for v in found.values()) else 1
    spark = SparkSession.builder.appName("quorumlake").getOrCreate()
    if a.command == "build":
        source = Source(a.root, load_templates(a.templates))
        print(json.dumps(build_all(spark, source, a.database, a.source, a.export)))
        if a.test:
            print(audit.markdown([r.asDict() for r in replay_build(spark, a.database).orderBy("source").collect()], "Ledger replay"))
        if a.test_coverage:
            tables = {p.name.removesuffix(".parquet"): spark.read.parquet(str(p)) for p in Path(a.database).glob("*.parquet")}
            sources = sorted({t.source_key for t in source.templates.values() if not a.source or t.source_key in a.source})
            print(audit.coverage_markdown([audit.source_coverage(spark, a.root, s, source.templates, tables, tables["_claims_ledger"]) for s in sources]))
    elif a.command == "load-arrays":
        text = spark.read.text(a.document, wholetext=True)
        print(json.dumps(sinks.write_arrays(text.selectExpr("parse_json(value) as doc"), a.database)))
    elif a.command == "submit":
        print(json.dumps({"submissions": sinks.append_submissions(spark, a.csv, a.folder)}))
    elif a.command == "profile" and not a.endpoint:
        print(json.dumps(profile_source(spark, a.root, a.source), indent=2, ensure_ascii=False))
    elif a.command == "profile":
        doc = read_document(spark, a.root, a.source, a.endpoint)
        row = doc.select("text").first()
        shape = detect_shape(json.loads(row["text"])) if row else None
        if shape is None:
            print("no records found")
            return 1
        how = {"source_key": a.source, "endpoint": a.endpoint, "record_extraction": {"unwrap_path": shape["path"], "iterate_mode": shape["mode"]}}
        previous = parse_config(Path(a.previous).read_text("utf-8")) if a.previous else None
        print(json.dumps(draft_template(unwrap(doc, template_from(how)), a.source, a.endpoint, shape, previous), indent=2, ensure_ascii=False))
    else:
        for p in Path(a.database).glob("*.parquet"):
            spark.read.parquet(str(p)).createOrReplaceTempView(p.stem)
        spark.sql(a.text).show(100, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
