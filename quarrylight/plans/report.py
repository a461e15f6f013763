"""Markdown reports and JSON data of the lenses. Rows are cut to a report's length before they come to the driver."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions.text import squeezed
from quarrylight.plans import arch as arch_plan
from quarrylight.plans import ci as ci_plan
from quarrylight.plans import deadcode as dead_plan
from quarrylight.plans import drift as drift_plan
from quarrylight.plans import opportunity as opp_plan
from quarrylight.plans import security as sec_plan
from quarrylight.plans import techdebt as debt_plan


def write_json(rows: DataFrame, path: str) -> None:
    """All rows, in parts, to any store Spark writes."""
    rows.write.mode("overwrite").json(path)


def table(head: list[str], rows: list[list]) -> list[str]:
    line = lambda cells: "| " + " | ".join("-" if c is None else str(c) for c in cells) + " |"
    return [line(head), line(["---"] * len(head)), *map(line, rows)]


def techdebt(rows: DataFrame, title: str, top: int = 40) -> str:
    n, good = rows.count(), debt_plan.targets(rows)
    head = ["#", "score", "impact x opportunity", "file", "commits", "churned lines", "complexity", "cc", "loc", "depth"]
    cells = lambda df: [[i, r.score, f"{r.impact}x{r.opportunity}", f"`{r.file}`", r.commits, r.lines, r.complexity.raw, r.complexity.cc, r.complexity.loc, r.complexity.depth] for i, r in enumerate(debt_plan.ordered(df).limit(top).collect(), 1)]
    return "\n".join([f"# Tech debt: {title}", "", f"{n} code files, {good.count()} of them high on both axes.", "", "## Targets", "", *table(head, cells(good)), "", f"## First {top} that are not low on both axes", "", *table(head, cells(debt_plan.kept(rows)))]) + "\n"


def coverage(rows: DataFrame, label: str, n_tests: int, top: int = 18) -> str:
    found = rows.orderBy(F.desc("gap"), F.desc("file")).limit(top).collect()
    head = ["gap", "file", "commits", "complexity", "test files that mention it"]
    return "\n".join(["# Coverage gaps", "", f"{n_tests} test files read: {label}.", "", *table(head, [[r.gap, f"`{r.file}`", r.commits, r.complexity_raw, r.test_refs] for r in found])]) + "\n"


def security(rows: DataFrame, top: int = 40) -> str:
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("reach") >= 4) & (F.col("vuln") >= 4)).alias("hot")).first()
    gaps = rows.filter(F.size("auth_gaps") > 0).orderBy(F.desc(F.size("auth_gaps")), "file").limit(20).collect()
    hidden = sec_plan.suppressed_summary(rows).orderBy("reason").collect()
    most = lambda p: ", ".join(f"{k} x{v}" for k, v in sorted(p.items(), key=lambda kv: (-kv[1], kv[0]))[:4])
    line = lambda df: [[r.score, f"{r.reach}x{r.vuln}", f"`{r.file}`", r.imported_by, ", ".join(r.roles), most(r.patterns)] for r in sec_plan.ordered(df).limit(top).collect()]
    head = ["score", "reach x risk", "file", "imported by", "roles", "patterns"]
    out = ["# Security", "", f"{counts.n} files, {counts.hot} high on both axes.", "", *table(head, line(rows.filter("reach >= 4 and vuln >= 4"))), "", "## Handlers without authentication", ""]
    out += [f"- `{r.file}`: {', '.join(r.auth_gaps[:6])}" + (f" and {len(r.auth_gaps) - 6} more" if len(r.auth_gaps) > 6 else "") for r in gaps]
    out += ["", "## Handlers that a router's dependencies cover", "", *[f"- {r.handlers} handlers in {r.files} files: {r.reason}" for r in hidden], "", "## All", "", *table(head, line(rows.filter("reach >= 3 or vuln >= 3")))]
    return "\n".join(out) + "\n"


def deadcode(files: DataFrame, symbols: DataFrame, top: int = 40) -> str:
    whole, named = (dead_plan.ordered(df).limit(top).collect() for df in (files, symbols))
    out = ["# Dead code", "", f"{files.count()} files and {symbols.count()} symbols.", "", "## Files", ""]
    out += table(["file", "lines", "confidence", "tags", "tests only"], [[f"`{r.file}`", r.loc, r.confidence, ", ".join(r.fp_tags), "test-only" if r.test_only else ""] for r in whole])
    out += ["", "## Symbols", "", *table(["symbol", "file", "lines of the file", "tags"], [[f"`{r.symbol}`", f"`{r.file}`", r.loc, ", ".join(r.fp_tags)] for r in named])]
    return "\n".join(out) + "\n"


def drift(groups: DataFrame, pairs: DataFrame, n_functions: int, top: int = 25) -> str:
    out = ["# Drifted copies", "", f"{n_functions} functions, {groups.count()} groups that drifted, {pairs.filter('exact').count()} exact pairs.", ""]
    for i, g in enumerate(drift_plan.ordered(groups).limit(top).collect(), 1):
        out += [f"## {i}. {g['size']} copies, up to {g.max_loc} lines, alike to {g.best:.2f}", "", *[f"- `{m.file}:{m.line}` {m.name}" for m in g.members], ""]
    return "\n".join(out) + "\n"


def arch(found: dict, top: int = 30) -> str:
    rows = arch_plan.ordered(found["rows"]).limit(top).collect()
    head = ["score", "impact x opportunity", "module", "layer", "fan-in", "fan-out", "violations", "cycle"]
    out = ["# Architecture", "", f"{found['nodes'].count()} modules, {found['edges'].count()} imports; roots: {found['roots']}.", ""]
    out += table(head, [[r.score, f"{r.impact}x{r.opportunity}", f"`{r.module}`", r.layer, r.fan_in, r.fan_out, len(r.violations), "yes" if r.in_cycle else ""] for r in rows])
    cycles = found["cycles"].orderBy(F.desc(F.size("members")), "scc").limit(top).select(F.slice("members", 1, 8).alias("m"), F.size("members").alias("n")).collect()
    return "\n".join([*out, "", "## Cycles", "", *[f"- {r.n} modules: {', '.join(r.m)}" for r in cycles]]) + "\n"


def ci(rows: DataFrame, n_runs: int) -> str:
    found = ci_plan.ordered(rows).collect()  # one row a workflow
    head = ["score", "impact x opportunity", "workflow", "runs", "failure rate", "failed", "cancelled", "median minutes"]
    return "\n".join([f"# Continuous integration, last {n_runs} runs", "", *table(head, [[r.score, f"{r.impact}x{r.opportunity}", r.workflow, r.runs, f"{r.failure_rate:.0%}", r.failure, r.cancelled, r.p50_min] for r in found])]) + "\n"


def opportunity(rows: DataFrame, top: int = 25) -> str:
    head = ["rise", "rank", "file", "issues", "findings", "notes", "before", "after"]
    found = opp_plan.ordered(rows).limit(top).collect()
    cells = [[f"+{r.delta_rank}", f"{r.old_rank} to {r.new_rank}", f"`{r.file}`" + ("" if r.basename_unique else " (!)"), r.issues, r.audit, r.incidents, f"{r.impact}x{r.opportunity}", f"{r.impact}x{r.new_opportunity}"] for r in found]
    return "\n".join(["# Files that rose by evidence", "", *(table(head, cells) if cells else ["No file rose."])]) + "\n"


def verdicts(rows: DataFrame, header: str = "") -> str:
    """rows: sections() of triaged candidates."""
    v = F.col("verdict")
    flat = rows.select("section", "lens", "target", "file", "symbol", v["status"].alias("status"), v["klass"].alias("klass"), v["priority"].alias("priority"), squeezed(v["suggested_action"]).alias("action"),
                       *[squeezed(v["evidence"], n).alias(f"e{n}") for n in (200, 220, 300, 420)])
    by: dict[str, list] = {}
    for r in flat.orderBy(F.desc("priority"), "lens", "file").collect():
        by.setdefault(r.section, []).append(r)
    name = lambda r: f"`{r.file}`" + (f" `{r.symbol}`" if r.symbol else "")
    real, safe = by.get("real", []), by.get("security", [])
    out = [header, f"## Verified real ({len(real)})", "", *table(["priority", "lens", "target", "file", "class", "action"], [[r.priority, r.lens, r.target, name(r), r.klass, r.action] for r in real])]
    out += ["", "### Evidence", "", *[f"- {name(r)} ({r.lens}, p{r.priority}): {r.e420}" for r in real]]
    out += ["", f"## Security, all {len(safe)} rows whatever their verdict", "", *table(["target", "file", "verdict", "note"], [[r.target, f"`{r.file}`", r.status, r.e220] for r in safe])]
    for key, title in (("already-fixed", "Fixed before"), ("false-positive", "False positives"), ("unclear", "Unclear")):
        if by.get(key) or key != "unclear":
            out += ["", f"## {title} ({len(by.get(key, []))})", "", *[f"- {name(r)} ({r.lens}): {r.e300 if key == 'already-fixed' else r.e200}" for r in by.get(key, [])]]
    return "\n".join(out).lstrip("\n") + "\n"


# --- one-line summaries ----------------------------------------------------------------------------------------------

RANKS = {
    "techdebt": "churn x complexity", "coverage": "churn x missing tests", "security": "reach x risk", "deadcode": "unreferenced x size", "arch": "fan-in x tangle",
    "drift": "drifted Python copies", "drift-ts": "drifted script copies", "ci": "runs x failure rate", "opportunity": "rise by evidence",
}


def one_liners(name: str, rows: DataFrame, n: int) -> DataFrame:
    """position, line: the first n rows of a lens, a sentence each."""
    plural = lambda c, one: F.concat(F.col(c).cast("string"), F.lit(one))
    pair = lambda a, b: F.format_string("**%d** (%dx%d) ", "score", a, b)
    code = lambda c: F.concat(F.lit("`"), F.col(c), F.lit("`"))
    if name == "techdebt":
        order, line = [F.desc("score"), F.desc("churn_raw"), "file"], F.concat(pair("impact", "opportunity"), code("file"), F.format_string(", %d commits, cx %s", "commits", F.col("complexity.raw").cast("string")))
    elif name == "coverage":
        order, line = [F.desc("gap"), F.desc("file")], F.concat(F.lit("gap **"), F.col("gap").cast("string"), F.lit("** "), code("file"), F.lit(", "), plural("commits", " commits, in "), plural("test_refs", " test files"))
    elif name == "security":
        found = F.slice(F.array_sort(F.map_entries("patterns"), lambda a, b: F.when(a["value"] != b["value"], b["value"] - a["value"]).when(a["key"] < b["key"], -1).otherwise(1).cast("int")), 1, 3)
        said = F.array_join(F.transform(found, lambda e: F.concat(e["key"], F.lit("x"), e["value"].cast("string"))), ", ")
        order, line = [F.desc("score"), F.desc("vuln_raw"), F.desc("reach_raw"), "file"], F.concat(pair("reach", "vuln"), code("file"), F.lit(", "), F.when(said == "", "reach alone").otherwise(said))
    elif name == "deadcode":
        order = [F.desc(F.size("fp_tags") == 0), F.desc("score"), "file"]
        line = F.concat(code("file"), F.format_string(", %d lines, confidence %s", "loc", "confidence"))
        if "symbol" in rows.columns:
            line = F.concat(F.lit("symbol "), code("symbol"), F.lit(" in "), code("file"))
    elif name == "arch":
        order = [F.desc("score"), F.desc("fan_in"), "module"]
        extra = F.concat(F.when(F.size("violations") > 0, F.format_string(", %d violations", F.size("violations"))).otherwise(""), F.when(F.col("in_cycle"), ", in a cycle").otherwise(""))
        line = F.concat(pair("impact", "opportunity"), code("module"), F.format_string(", fan-in %d, fan-out %d", "fan_in", "fan_out"), extra)
    elif name in ("drift", "drift-ts"):
        head = F.element_at("members", 1)
        order, line = [F.desc("weight"), "component"], F.concat(F.format_string("%d copies, ", "size"), F.lit("`"), head["file"], F.lit(":"), head["line"].cast("string"), F.lit("` **"), head["name"], F.lit("**"))
    elif name == "ci":
        order, line = [F.desc("score"), F.desc("failure_rate"), F.desc("runs"), "workflow"], F.concat(F.format_string("**%d** ", "score"), code("workflow"), F.format_string(", %d runs, %d%% failed", "runs", F.floor(F.col("failure_rate") * 100).cast("int")))
    else:
        order, line = [F.desc("delta_rank"), F.desc("evidence_raw"), "new_rank"], F.concat(code("file"), F.format_string(" rose %d places (%d to %d), %d issues", "delta_rank", "old_score", "new_score", "issues"))
    first = rows.orderBy(*order).limit(n)
    return first.select(F.row_number().over(Window.orderBy(*order)).alias("position"), line.alias("line"))  # of n rows


def index(title: str, results: list[dict], lines: dict[str, list[str]]) -> str:
    """The index of a run: a status table, then each lens's first lines."""
    state = lambda r: r["status"] + (f": {r['reason']}" if r.get("reason") else "")
    out = [f"# Lenses over {title}", "", "Rows are candidates to confirm; scores are quintiles within this repository.", ""]
    out += table(["lens", "ranks", "status", "seconds"], [[r["name"], RANKS.get(r["name"], ""), state(r), r.get("took")] for r in results])
    for r in results:
        out += ["", f"## {r['name']}", "", f"Call: `{r['call']}`", ""]
        out += [state(r)] if r["status"] != "ok" else [f"{i}. {x}" for i, x in enumerate(lines.get(r["name"], []), 1)] or ["Nothing ranked."]
    return "\n".join(out) + "\n"


def save(text: str, path: str) -> None:
    Path(path).write_text(text, encoding="utf-8")


def to_json(rows: list[dict]) -> str:
    return json.dumps(rows, indent=1, default=str)
