"""Security: how far a file reaches times how many risky shapes it holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import auth, code, paths, risk, text
from quarrylight.operators.joins import longest_prefix, unique_values
from quarrylight.operators.ordering import persisted
from quarrylight.plans.techdebt import scored
from quarrylight.sources.repo import Repo


def imported_by(files: DataFrame, roots: tuple[str, ...]) -> DataFrame:
    """path, imported_by: import statements (every occurrence) that resolve to the file.

    Python: by dotted path, with or without a source root, else by the last part where only one file has that stem.
    Scripts: relative and @/ names, by a stem that only one file has.
    """
    path, py = F.col("path"), F.endswith(F.col("path"), F.lit(".py"))
    dotted = F.translate(F.regexp_replace(path, r"\.py$", ""), "/", ".")
    names = files.filter(py).select(path, dotted.alias("name"), F.lit(0).alias("prio"))
    for prefix in (r.replace("/", ".") for r in roots if r):
        bare = F.substring("name", F.lit(len(prefix) + 1), F.length("name"))
        names = names.union(names.filter((F.col("prio") == 0) & F.startswith("name", F.lit(prefix))).select("path", bare, F.lit(1)))
    modules = names.groupBy("name").agg(F.min_by("path", F.struct("prio", "path")).alias("by_module"))
    stems = unique_values(files.select(path, paths.stem(path).alias("stem")), "stem", "path").withColumnRenamed("path", "by_stem")
    specs = files.select(path, py.alias("py"), F.explode(text.graph_imports(F.col("src"), py)).alias("spec"))
    specs = specs.filter(F.col("py") | F.startswith("spec", F.lit(".")) | F.startswith("spec", F.lit("@/")))
    specs = specs.withColumn("name", F.when(F.col("py"), F.col("spec")))
    specs = specs.withColumn("stem", F.when(F.col("py"), F.element_at(F.split("spec", r"\."), -1)).otherwise(paths.stem(F.col("spec"))))
    found = specs.join(modules, "name", "left").join(stems, "stem", "left").withColumn("target", F.coalesce("by_module", "by_stem"))
    return found.filter("target <> path").groupBy(F.col("target").alias("path")).agg(F.count(F.lit(1)).cast("int").alias("imported_by"))


# What gives a file a role at the edge of requests.
ROUTE_PATHS = ("/routes/", "/api/", "route.ts")
AUTH_PATHS = ("auth", "rbac", "permission", "middleware")
REQUEST = r"(?U)request\.(?:json|form|body|query|args)|await\s+request\.|Body\(|Query\(|Form\("


def roles(path, src):
    """The roles of a file, in order."""
    low = F.lower(path)
    fits = {
        "route": paths.contains_any(low, ROUTE_PATHS),
        "auth": paths.contains_any(low, AUTH_PATHS),
        "webhook": F.contains(low, F.lit("webhook")) | F.contains(F.lower(src), F.lit("webhook")),
        "input-handler": src.rlike(REQUEST),
    }
    return F.array_compact(F.array(*[F.when(fits[r], F.lit(r)) for r in sorted(fits)]))


def grown_vocabulary(files: DataFrame, seed: tuple[str, ...], rounds: int = 4) -> tuple[str, ...]:
    """The names of `seed` and of injected functions whose signature, directly or through others found before, names one.

    Signatures are extracted once; a round is one filter over them, and only new names reach the driver.
    """
    py = files.filter(paths.is_python(F.col("path")))
    used = code.per_file(py, auth.injected, "path string, name string").select("name").distinct()
    defs = persisted(code.per_file(py, auth.helpers, "path string, name string, signature string").join(used, "name", "left_semi"))
    known = list(seed)
    for _ in range(rounds):
        pattern = F.lit("(?iU)\\b(?:" + "|".join("\\Q" + n + "\\E" for n in known if n) + ")")
        found = defs.filter(~F.regexp_like("name", pattern) & F.regexp_like("signature", pattern)).select("name").distinct()
        new = sorted(r[0] for r in found.collect() if r[0] not in known)
        if not new:
            break
        known += new
    return tuple(known)


def wiring_module(repo: Repo, roots: tuple[str, ...], requested: str | None = None) -> str | None:
    """The file that mounts routers: the requested one, or the first main.py of the usual places that exists."""
    tried = [requested] if requested else ["app/main.py", "main.py", "src/main.py", *(f"{r}main.py" for r in roots if r)]
    present = {r[0] for r in repo.files.filter(F.col("path").isin(*tried)).select("path").collect()}
    return next((t for t in tried if t in present), None)


def mounted_auth(repo: Repo, files: DataFrame, wiring: str | None, names: tuple[str, ...]) -> DataFrame:
    """path, reason of route files whose router is mounted with an authentication list."""
    spark = repo.spark
    if wiring is None:
        return spark.createDataFrame([], "path string, reason string")
    main = repo.files.filter(F.col("path") == wiring)
    refs = code.per_file(main, lambda p, s: auth.mounted(p, s, names), "path string, head string, parts array<string>").drop("path")
    bases = files.select("path", F.regexp_replace("path", r"(?:/__init__)?\.py$", "").alias("name"), F.endswith("path", F.lit("/__init__.py")).alias("init"))
    bases = bases.filter(F.endswith("path", F.lit(".py"))).groupBy("name").agg(F.min_by("path", "init").alias("path"))
    found = longest_prefix(refs, bases, sep="/").join(bases.withColumnRenamed("name", "target"), "target", "left")
    stems = unique_values(files.select("path", paths.stem(F.col("path")).alias("head")), "head", "path").withColumnRenamed("path", "by_stem")
    found = found.join(stems, "head", "left").select(F.coalesce("path", "by_stem").alias("path")).filter("path is not null").distinct()
    return found.withColumn("reason", F.lit(f"include_router(dependencies=[...]) in {wiring}"))


def security(
    repo: Repo,
    src_roots: list[str] | None = None,
    public_paths: list[str] | None = None,
    auth_deps: list[str] | None = None,
    app_module: str | None = None,
) -> DataFrame:
    """file, imported_by, roles, reach_raw, vuln_raw, patterns, auth_gaps, auth_suppressed, auth_suppressed_reason, reach, vuln, score."""
    path = F.col("path")
    present = [r for r in paths.SOURCE_ROOTS if repo.files.filter(F.startswith(path, F.lit(r + "/"))).limit(1).count()]
    roots = paths.source_roots(src_roots, present)
    files = repo.files.filter(paths.is_code(path) & ~paths.contains_any(path, paths.DENIED) & paths.under(path, roots))
    names = grown_vocabulary(files, tuple(auth.tokens([*auth.DEFAULTS, *(auth_deps or [])])))
    public = tuple(auth.tokens([*auth.PUBLIC, *(public_paths or [])]))
    py = F.endswith(path, F.lit(".py"))
    bodies = files.withColumn("body", text.without_comments(F.col("src"), py))
    open_ = code.per_file(
        bodies.filter(py), lambda p, b: auth.handlers(p, b, names, public), "path string, at int, handler string, own boolean", ("path", "body")
    )
    listed = open_.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("at", "handler"))).alias("l"), F.max("own").alias("own"))
    listed = listed.select("path", F.transform("l", lambda x: x["handler"]).alias("handlers"), "own")
    wiring = wiring_module(repo, roots, app_module)
    rows = bodies.join(imported_by(files, roots), "path", "left").join(listed, "path", "left").join(mounted_auth(repo, files, wiring, names), "path", "left")
    reason = F.coalesce("reason", F.when(F.col("own"), "APIRouter(dependencies=[...]) in this file"))
    none = F.array().cast("array<string>")
    rows = rows.withColumns({"why": reason, "handlers": F.coalesce("handlers", none)})
    gaps = F.when(F.col("why").isNull(), F.col("handlers")).otherwise(none)
    hidden = F.when(F.col("why").isNotNull(), F.col("handlers")).otherwise(none)
    found = risk.counts(F.col("body"), py)
    rows = rows.select(path.alias("file"), F.coalesce("imported_by", F.lit(0)).alias("imported_by"), roles(path, F.col("src")).alias("roles"), gaps.alias("auth_gaps"),
                       hidden.alias("auth_suppressed"), "why", *[n.alias(f"__{k}") for k, n in found.items()], risk.child_processes(F.col("body"), py).alias("__spawned"))
    counted = {k: F.col(f"__{k}") for k in found}
    every = counted | {"child_process_exec": F.col("__spawned"), "route_no_auth_dep": F.size("auth_gaps")}
    rows = rows.select(
        "file",
        "imported_by",
        "roles",
        (F.col("imported_by") + 2.0 * F.size("roles")).alias("reach_raw"),
        risk.score(counted, F.col("__spawned"), F.size("auth_gaps")).alias("vuln_raw"),
        risk.as_map(every).alias("patterns"),
        "auth_gaps",
        "auth_suppressed",
        F.when(F.size("auth_suppressed") > 0, F.col("why")).alias("auth_suppressed_reason"),
    )
    return scored(rows, "reach_raw", "vuln_raw").withColumnsRenamed({"impact": "reach", "opportunity": "vuln"})


def ordered(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc("score"), F.desc("vuln_raw"), F.desc("reach_raw"), "file")


def suppressed_summary(rows: DataFrame) -> DataFrame:
    """reason, files, handlers of what router-level authentication covers."""
    hidden = rows.filter("auth_suppressed_reason is not null").groupBy(F.col("auth_suppressed_reason").alias("reason"))
    return hidden.agg(F.count(F.lit(1)).alias("files"), F.sum(F.size("auth_suppressed")).alias("handlers"))
