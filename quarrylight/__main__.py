"""The lenses from a command line: python -m quarrylight LENS CHECKOUT [options]."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.operators.ordering import persisted
from quarrylight.plans import arch, ci, deadcode, drift, everything, opportunity, report, security, techdebt, triage
from quarrylight.session import ship
from quarrylight.sources import repo as sources


def parser() -> argparse.ArgumentParser:
    whole = argparse.ArgumentParser(prog="quarrylight", description="Ranks where attention is most valuable in a body of source code.")
    lenses = whole.add_subparsers(dest="lens", required=True)

    def lens(name: str, about: str, top: int | None, checkout: bool = True) -> argparse.ArgumentParser:
        p = lenses.add_parser(name, help=about, description=about)
        if checkout:
            p.add_argument("repo", nargs="?", default=".", help="a checkout")
            p.add_argument("--since", default="180 days ago", help="how far back commits count")
            p.add_argument("--ref", help="read files at this ref instead of the working tree")
        if top is not None:
            p.add_argument("--top", type=int, default=top, help="rows of the report")
            p.add_argument("--md", help="write the report to this file instead of printing it")
            p.add_argument("--json", help="write all rows to this folder")
        return p

    many = {"action": "append", "default": None}
    lens("techdebt", "churn x complexity", 40)
    p = lens("coverage", "churn x missing tests", 18)
    p.add_argument("--tests-dir", default="tests/")
    p.add_argument("--include", help="a part that paths must have (repeatable)", **many)
    p.add_argument("--min-impact", type=int, default=4)
    p.add_argument("--scores", help="rows that techdebt --json wrote")
    p = lens("security", "reach x risk", 40)
    p.add_argument("--src-root", help="a folder to look in (repeatable)", **many)
    p.add_argument("--auth-deps", help="names that mean authentication (repeatable)", **many)
    p.add_argument("--public-paths", help="routes that are public (repeatable)", **many)
    p.add_argument("--app-module", help="the file that mounts routers")
    lens("deadcode", "unreferenced x size", 40).add_argument("--src-root", **many)
    lens("drift", "copies that drifted apart", 25).add_argument("--lang", choices=("py", "ts"), default="py")
    p = lens("arch", "fan-in x tangle", 30)
    p.add_argument("--src-root")
    p.add_argument("--lang", choices=("auto", "py", "ts"), default="auto")
    p.add_argument("--layers", help="layers from the outermost: a|alias,b,c")
    p.add_argument("--strict-top-layer", action="store_true", help="no imports within the topmost layer of scripts")
    p = lens("ci", "runs x failure rate", None)
    p.add_argument("--forge", help="OWNER/NAME (default: asked for)")
    p.add_argument("--runs", help="a JSON file of runs instead")
    p.add_argument("--limit", type=int, default=300)
    p.add_argument("--md")
    p.add_argument("--json")
    p = lens("opportunity", "rise by evidence", 25)
    p.add_argument("--data", help="rows that techdebt --json wrote")
    p.add_argument("--gh-repo", help="OWNER/NAME (default: from the origin's address)")
    p.add_argument("--evidence", help="a file of notes (repeatable)", **many)
    p.add_argument("--audit", help="findings, an object a line")
    p.add_argument("--label")
    p = lens("all", "every lens, and an index", None)
    p.add_argument("--out", default="lens-out")
    p.add_argument("--top", type=int, default=10)
    p.add_argument("--report-top", type=int, default=40)
    p.add_argument("--src-root", **many)
    p.add_argument("--tests-dir", default="tests/")
    p.add_argument("--app-module")
    p.add_argument("--gh-repo")
    p.add_argument("--ci-limit", type=int, default=300)
    p.add_argument("--skip", help="a lens (repeatable)", **many)
    p.add_argument("--verbose", action="store_true")
    p.add_argument("--candidates", help="write triage candidates to this folder")
    p.add_argument("--skip-files", help="files that are no candidates (repeatable)", **many)
    p.add_argument("--skip-file", help="a file that lists more of them")
    for name, cap in triage.CAPS.items():
        p.add_argument(f"--cap-{name}", type=int, default=cap)
    p = lens("verdicts", "the report of triaged candidates", None, checkout=False)
    p.add_argument("--json", required=True, help="candidates with verdicts")
    p.add_argument("--header", help="a file to begin with")
    p.add_argument("--md", required=True)
    return whole


def _lines(path: str | None) -> list[str]:
    """Lines of a settings file; none where it is missing."""
    return Path(path).read_text(encoding="utf-8", errors="ignore").splitlines() if path and Path(path).is_file() else []


def _evidence(spark: SparkSession, repo: sources.Repo, forge: str | None, notes: list[str] | None, audit: str | None) -> None:
    """Adds what can be had of issues, merged changes, notes and findings."""
    issues, pulls = sources.fetch_issues(spark, forge) if forge else (None, None)
    found = {"issues": issues, "pulls": pulls, "notes": sources.read_notes(spark, notes) if notes else None, "findings": sources.read_findings(spark, audit) if audit else None}
    repo.tables.update({k: v for k, v in found.items() if v is not None})


def _give(text: str, rows: DataFrame | None, md: str | None, folder: str | None) -> int:
    if folder and rows is not None:
        report.write_json(rows, folder)
    if md:
        report.save(text, md)
    else:
        print(text)
    return 0


def run(spark: SparkSession, o: argparse.Namespace) -> int:
    """Runs one command; 1 if a lens failed."""
    ship(spark)
    if o.lens == "verdicts":
        rows = sources.read_saved(spark, o.json)
        head = "\n".join(_lines(o.header))
        return _give(report.verdicts(triage.sections(triage.valid_verdicts(rows)), head), None, o.md, None)
    if o.lens == "ci":
        runs = sources.read_runs(spark, o.runs) if o.runs else sources.fetch_runs(spark, o.forge or sources.ask_forge(o.repo), o.limit)
        rows = persisted(ci.ci(runs))
        said = report.ci(rows, runs.count())
        print(said)  # always, whatever else is written
        return _give(said, rows, o.md, o.json) if o.md else _give("", rows, None, o.json)
    repo = sources.scan(spark, o.repo, o.since, o.ref)
    if o.lens == "techdebt":
        rows = persisted(techdebt.techdebt(repo))
        return _give(report.techdebt(rows, repo.name, o.top), rows, o.md, o.json)
    if o.lens == "coverage":
        scores = sources.read_saved(spark, o.scores) if o.scores else None
        found = persisted(techdebt.tests(repo.files, o.tests_dir))
        rows = persisted(techdebt.coverage(techdebt.techdebt(repo) if scores is None else scores, found, o.include, o.min_impact))
        return _give(report.coverage(rows, techdebt.tests_label(found, o.tests_dir), found.count(), o.top), rows, o.md, o.json)
    if o.lens == "security":
        settled = lambda given, name: [*_lines(f"{o.repo}/.quarrylight-{name}"), *(given or [])]
        rows = persisted(security.security(repo, o.src_root, settled(o.public_paths, "public-paths"), settled(o.auth_deps, "auth-deps"), o.app_module))
        return _give(report.security(rows, o.top), rows, o.md, o.json)
    if o.lens == "deadcode":
        files, symbols = map(persisted, deadcode.deadcode(repo, o.src_root))
        return _give(report.deadcode(files, symbols, o.top), files.unionByName(symbols, allowMissingColumns=True), o.md, o.json)
    if o.lens == "drift":
        functions = persisted(drift.functions(repo, o.lang))
        groups, pairs = drift.drift(repo, o.lang, functions)
        return _give(report.drift(groups, pairs, functions.count(), o.top), groups, o.md, o.json)
    if o.lens == "arch":
        found = arch.arch(repo, o.lang, o.src_root, o.layers, o.strict_top_layer)
        return _give(report.arch(found, o.top), found["rows"], o.md, o.json)
    forge = o.gh_repo or sources.infer_forge(o.repo)
    if o.lens == "opportunity":
        _evidence(spark, repo, forge, o.evidence, o.audit)
        debt = sources.read_saved(spark, o.data) if o.data else None
        rows = persisted(opportunity.opportunity(repo, techdebt.techdebt(repo) if debt is None else debt, o.label or repo.name))
        return _give(report.opportunity(rows, o.top), rows, o.md or "TARGETS-v2.md", o.json)
    _evidence(spark, repo, forge, None, None)
    runs = sources.fetched(spark, sources.RUNS, sources.runs_command(forge, o.ci_limit)) if forge else None
    if runs is not None:
        repo.tables["runs"] = runs
    done = everything.run_all(repo, o.out, o.top, o.report_top, tuple(o.skip or ()), o.tests_dir, o.src_root, o.app_module)
    if o.candidates:
        caps = {k: getattr(o, f"cap_{k.replace('-', '_')}") for k in triage.CAPS}
        skip = [*(o.skip_files or []), *sources.words_of(_lines(o.skip_file))]
        out = spark.createDataFrame([(f,) for f in skip], "file string") if skip else None
        report.write_json(everything.candidates(done, repo.name, out, caps).withColumn("verdict", F.lit(None).cast("string")), o.candidates)
    for r in done["results"]:
        if o.verbose or r["status"] == "failed":
            print(f"{r['name']}: {r['status']} {r.get('reason') or ''}", file=sys.stderr)
    return int(any(r["status"] == "failed" for r in done["results"]))


def main(args: list[str] | None = None) -> int:
    options = parser().parse_args(args)
    spark = SparkSession.builder.appName(f"quarrylight {options.lens}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    return run(spark, options)


if __name__ == "__main__":
    sys.exit(main())
