"""All lenses in one go: what can't run is skipped with a reason, what fails does not stop the others."""

from __future__ import annotations

import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame

from quarrylight.operators.ordering import persisted
from quarrylight.plans import arch, ci, deadcode, drift, opportunity, report, security, techdebt, triage
from quarrylight.session import ship
from quarrylight.sources.repo import Repo

LENSES = ("techdebt", "coverage", "security", "deadcode", "arch", "drift", "drift-ts", "ci", "opportunity")


def run_all(repo: Repo, out: str | None = None, top: int = 10, report_top: int = 40, skip: tuple[str, ...] = (), tests_dir: str = "tests/", src_roots: list[str] | None = None, app_module: str | None = None) -> dict:
    """results (name, status, reason, call, took), frames by lens, and the index; reports and index go to the folder `out` if given."""
    ship(repo.spark)
    frames: dict[str, object] = {}
    results: list[dict] = []
    reports: dict[str, str] = {}
    lines: dict[str, list[str]] = {}

    def step(name: str, call: str, make: Callable[[], tuple[DataFrame, str, object]], reason: str | None = None, after: str | None = None) -> None:
        if name in skip:
            reason = "asked to skip"
        elif not reason and after and after not in frames:
            reason = f"needs {after}"
        if reason:
            results.append({"name": name, "status": "skipped", "reason": reason, "call": call})
            return
        began = time.time()
        try:
            shown, reports[name], frames[name] = make()
            lines[name] = [r.line for r in report.one_liners(name, shown, top).orderBy("position").collect()]
            results.append({"name": name, "status": "ok", "call": call, "took": round(time.time() - began, 1)})
        except Exception as e:  # one lens's failure is a line of the index
            frames.pop(name, None)
            results.append({"name": name, "status": "failed", "reason": str(e).strip().splitlines()[-1] if str(e).strip() else type(e).__name__, "call": call, "took": round(time.time() - began, 1)})

    def debt():
        rows = persisted(techdebt.techdebt(repo))
        return rows, report.techdebt(rows, repo.name, report_top), rows

    def cover():
        found = persisted(techdebt.tests(repo.files, tests_dir))
        rows = persisted(techdebt.coverage(frames["techdebt"], found))
        return rows, report.coverage(rows, techdebt.tests_label(found, tests_dir), found.count(), report_top), rows

    def secure():
        rows = persisted(security.security(repo, src_roots, app_module=app_module))
        return rows, report.security(rows, report_top), rows

    def dead():
        files, symbols = map(persisted, deadcode.deadcode(repo, src_roots))
        return files if files.limit(1).count() else symbols, report.deadcode(files, symbols, report_top), (files, symbols)

    def graph():
        found = arch.arch(repo)
        found["rows"] = persisted(found["rows"])
        return found["rows"], report.arch(found, report_top), found

    def copies(lang):
        def make():
            functions = persisted(drift.functions(repo, lang))
            groups, pairs = drift.drift(repo, lang, functions)
            groups = persisted(groups)
            return groups, report.drift(groups, pairs, functions.count(), report_top), groups

        return make

    def builds():
        rows = persisted(ci.ci(repo.table("runs")))
        return rows, report.ci(rows, repo.table("runs").count()), rows

    def risers():
        rows = persisted(opportunity.opportunity(repo, frames["techdebt"], repo.name))
        return rows, report.opportunity(rows, report_top), rows

    step("techdebt", "techdebt(repo)", debt)
    step("coverage", f"coverage(techdebt, tests(files, {tests_dir!r}))", cover, after="techdebt")
    step("security", f"security(repo, {src_roots}, app_module={app_module!r})", secure)
    step("deadcode", f"deadcode(repo, {src_roots})", dead)
    step("arch", "arch(repo)", graph)
    step("drift", "drift(repo, 'py')", copies("py"))
    step("drift-ts", "drift(repo, 'ts')", copies("ts"))
    step("ci", "ci(runs)", builds, None if repo.has("runs") else "no table of runs")
    evidence = any(repo.has(t) for t in ("issues", "notes", "findings"))
    step("opportunity", "opportunity(repo, techdebt)", risers, None if evidence else "no table of issues, notes or findings", "techdebt")
    index = report.index(repo.name, results, lines)
    if out:
        Path(out).mkdir(parents=True, exist_ok=True)
        for name, body in reports.items():
            report.save(body, f"{out}/REPORT-{name}.md")
        report.save(index, f"{out}/INDEX.md")
    return {"results": results, "frames": frames, "index": index, "reports": reports}


def candidates(done: dict, target: str, skip: DataFrame | None = None, caps: dict[str, int] = triage.CAPS) -> DataFrame:
    """Triage candidates of a run's frames."""
    f, parts = done["frames"], []
    if "techdebt" in f:
        parts.append(triage.techdebt_rows(f["techdebt"], target))
    if "security" in f:
        parts.append(triage.security_rows(f["security"], target))
    if "deadcode" in f:
        parts.append(triage.deadcode_rows(*f["deadcode"], target))
    parts += [triage.drift_rows(f[k], target) for k in ("drift",) if k in f]
    if "opportunity" in f:
        parts.append(triage.riser_rows(f["opportunity"], target))
    return triage.capped_union(parts, skip, caps)
