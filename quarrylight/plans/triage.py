"""Triage: a capped union of the lenses' best rows, and the sections of a verdict report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.operators.joins import keep_first
from quarrylight.operators.ordering import top_per

CAPS = {"techdebt": 8, "security": 8, "deadcode": 12, "drift": 10, "v2-riser": 8}
GROUP = "array<struct<file:string,name:string,line:int>>"
VERDICT = T.StructType(
    [T.StructField(n, T.IntegerType() if n == "priority" else T.StringType()) for n in ("status", "klass", "evidence", "priority", "suggested_action")]
)
STATUSES = ("real", "already-fixed", "false-positive", "unclear")
KLASSES = ("point-fix", "architectural", "investigation", "delete-candidate", "n/a")


def _listed(items, empty: str = "none"):
    return F.when(F.size(items) > 0, F.array_join(items, ", ")).otherwise(empty)


def _rows(rows: DataFrame, lens: str, target: str, order: list, detail, symbol=None, group=None) -> DataFrame:
    """Candidate rows and their order within the lens, as a sortable struct of numbers and the file."""
    return rows.select(
        F.lit(lens).alias("lens"), F.lit(target).alias("target"), "file", detail.alias("detail"), (symbol if symbol is not None else F.lit(None).cast("string")).alias("symbol"),
        (group if group is not None else F.lit(None).cast(GROUP)).alias("group"), F.struct(*[F.coalesce(o.cast("double"), F.lit(0.0)).alias(f"o{i}") for i, o in enumerate(order)], F.col("file").alias("f"), F.coalesce(symbol, F.lit("")).alias("s") if symbol is not None else F.lit("").alias("s")).alias("order"),
    )


def techdebt_rows(rows: DataFrame, target: str) -> DataFrame:
    c = F.col("complexity")
    detail = F.format_string("score %d (churn bucket %d, complexity bucket %d; cc=%d, loc=%d, depth=%d)", "score", "impact", "opportunity", c["cc"], c["loc"], c["depth"])
    return _rows(rows, "techdebt", target, [-F.col("score"), -F.col("churn_raw")], detail)


def security_rows(rows: DataFrame, target: str) -> DataFrame:
    patterns = F.transform(F.map_entries("patterns"), lambda e: F.concat(e["key"], F.lit("x"), e["value"].cast("string")))
    head = F.format_string("reach %d (imported_by %d), vuln %d; patterns: ", "reach", "imported_by", "vuln")
    detail = F.concat(head, _listed(patterns), F.lit("; auth_gaps: "), _listed(F.col("auth_gaps")))
    return _rows(rows, "security", target, [-F.col("score"), -F.col("reach_raw")], detail)


def deadcode_rows(files: DataFrame, symbols: DataFrame, target: str) -> DataFrame:
    """Whole files first, then symbols by size."""
    tail = F.concat(F.format_string(" unreferenced? confidence=%s, loc=%d, fp_tags=", "confidence", "loc"), _listed(F.col("fp_tags")))
    tagged = F.when(F.size("fp_tags") > 0, 1).otherwise(0)
    whole = _rows(files, "deadcode", target, [F.lit(0), tagged, -F.col("score")], F.concat(F.lit("whole file"), tail))
    named = F.concat(F.lit("symbol `"), "symbol", F.lit("`"), tail)
    return whole.unionByName(_rows(symbols, "deadcode", target, [F.lit(1), -F.col("score"), tagged], named, F.col("symbol")))


def drift_rows(groups: DataFrame, target: str) -> DataFrame:
    said = F.transform("members", lambda m: F.concat(m["file"], F.lit("::"), m["name"], F.lit(" (line "), m["line"].cast("string"), F.lit(")")))
    rows = groups.withColumn("file", F.element_at("members", 1)["file"])
    return _rows(rows, "drift", target, [-F.col("weight")], F.concat(F.lit("diverged clone group: "), F.array_join(said, "; ")), group=F.col("members").cast(GROUP))


def riser_rows(rows: DataFrame, target: str) -> DataFrame:
    head = F.format_string("rank delta +%d from evidence: %d open issue(s), %d audit finding(s), %d incident note(s)", "delta_rank", "issues", "audit", "incidents")
    doubt = F.when(F.col("basename_unique"), "").otherwise("; basename NOT unique - low confidence")
    return _rows(rows, "v2-riser", target, [-F.col("delta_rank"), -F.col("evidence_raw"), F.col("new_rank")], F.concat(head, doubt))


def capped_union(parts: list[DataFrame], skip: DataFrame | None = None, caps: dict[str, int] = CAPS) -> DataFrame:
    """lens, target, file, detail, symbol, group: of each lens and target the first rows up to the lens's cap.

    parts: rows of the functions above (several may share a lens, if their orders fit). Files of `skip` (file) go before the caps count,
    and a group goes if any of its members is there. Rows of one lens, target, file and symbol are one, the first.
    """
    rows = None
    for p in parts:
        rank = F.struct(*[F.col("order")[f.name] for f in p.schema["order"].dataType.fields])
        ranked = p.withColumn("order", rank)
        lens_caps = F.coalesce(*[F.when(F.col("lens") == k, n) for k, n in caps.items()])
        if skip is not None:
            out = skip.select(F.col("file").alias("out")).distinct()
            ranked = ranked.join(out, ranked["file"] == out["out"], "left_anti")
            grouped = ranked.filter("group is not null").select("lens", "target", "file", F.explode("group.file").alias("out"))
            bad = grouped.join(out, "out", "left_semi").select("lens", "target", "file").distinct()
            ranked = ranked.filter("group is null").unionByName(ranked.filter("group is not null").join(bad, ["lens", "target", "file"], "left_anti").select(*ranked.columns))
        best = top_per(ranked, ["lens", "target"], [F.col("order")], lens_caps).drop("order")
        rows = best if rows is None else rows.unionByName(best)
    keys = [F.col("lens"), F.col("target"), F.col("file"), F.coalesce("symbol", F.lit(""))]
    return keep_first(rows, keys, F.col("position")).drop("position")


def valid_verdicts(rows: DataFrame) -> DataFrame:
    """Rows whose verdict keeps the contract: a known status and klass, a priority of 1 to 5, evidence and action given."""
    v = F.col("verdict")
    return rows.filter(v["status"].isin(*STATUSES) & v["klass"].isin(*KLASSES) & v["priority"].between(1, 5) & v["evidence"].isNotNull() & v["suggested_action"].isNotNull())


def sections(rows: DataFrame) -> DataFrame:
    """rows with `section`: one for each status, and once more all of the security lens whatever their status."""
    by_status = rows.filter(F.col("verdict.status").isin(*STATUSES)).withColumn("section", F.col("verdict.status"))
    always = rows.filter(F.col("lens") == "security").withColumn("section", F.lit("security"))
    return by_status.unionByName(always)
