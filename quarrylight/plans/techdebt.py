"""Tech debt: churn times complexity; and coverage gaps: churn without tests that mention the code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import code, paths, text
from quarrylight.operators.joins import mention_counts
from quarrylight.operators.ordering import persisted, quintile_above
from quarrylight.sources.repo import Repo

COMPLEXITY = "path string, loc int, cc int, depth int, funcs int, raw double"


def churn(numstat: DataFrame) -> DataFrame:
    """file, commits, lines: a row of numstat is a commit's touch; binary files (-) count no lines; renames count for the present name."""
    number = lambda c: F.when((F.col("added") != "-") & (F.col("deleted") != "-"), F.col(c).cast("int"))
    rows = numstat.select(paths.renamed(F.col("raw_path")).alias("file"), (number("added") + number("deleted")).alias("n"))
    return rows.groupBy("file").agg(F.count(F.lit(1)).cast("int").alias("commits"), F.coalesce(F.sum("n"), F.lit(0)).cast("int").alias("lines"))


def churn_raw() -> Column:
    return F.col("commits") + F.col("lines") / F.lit(1000.0)


def complexity(files: DataFrame) -> DataFrame:
    """file and complexity of code files; Python that can't be parsed is counted like a script."""
    py = files.filter(paths.is_python(F.col("path")))
    parsed = code.per_file(py, code.python_complexity, COMPLEXITY)
    parsed = parsed.select("path", F.struct("loc", "cc", "depth", "funcs", "raw").alias("parsed"))
    counted = files.select("path", text.script_complexity(F.col("src")).alias("counted"))
    return counted.join(parsed, "path", "left").select(F.col("path").alias("file"), F.coalesce("parsed", "counted").alias("complexity"))


def scored(rows: DataFrame, impact_raw: str, opportunity_raw: str, bucket=quintile_above) -> DataFrame:
    """rows with impact, opportunity (buckets 1 to 5 of the two axes) and score, their product."""
    rows = persisted(rows)
    rows = rows.withColumns({"impact": bucket(rows, impact_raw), "opportunity": bucket(rows, opportunity_raw)})
    return rows.withColumn("score", F.col("impact") * F.col("opportunity"))


def techdebt(repo: Repo) -> DataFrame:
    """file, commits, lines, churn_raw, complexity, impact, opportunity, score of all authored code files."""
    path = F.col("path")
    files = repo.files.filter(paths.is_code(path) & ~paths.contains_any(path, paths.DENIED))
    rows = complexity(files).join(churn(repo.table("numstat")), "file", "left").na.fill(0, ["commits", "lines"])
    rows = rows.select("file", "commits", "lines", churn_raw().alias("churn_raw"), "complexity", F.col("complexity.raw").alias("__raw"))
    return scored(rows, "churn_raw", "__raw").drop("__raw")


ORDER = (F.desc, ("score", "churn_raw"))


def ordered(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc("score"), F.desc("churn_raw"), "file")


def targets(rows: DataFrame, least: int = 4) -> DataFrame:
    """Rows high on both axes."""
    return rows.filter((F.col("impact") >= least) & (F.col("opportunity") >= least))


def kept(rows: DataFrame, least: int = 3) -> DataFrame:
    """Rows that are not low on both axes."""
    return rows.filter((F.col("impact") >= least) | (F.col("opportunity") >= least))


def tests(files: DataFrame, tests_dir: str = "tests/") -> DataFrame:
    """path, src, in_dir: files of the tests folder and files named like tests anywhere."""
    inside = F.startswith(F.col("path"), F.lit(tests_dir.rstrip("/") + "/")) if tests_dir else F.lit(False)
    return files.withColumn("in_dir", inside).filter(F.col("in_dir") | paths.is_named_test(F.col("path")))


def tests_label(found: DataFrame, tests_dir: str = "tests/") -> str:
    r = found.agg(F.count_if("in_dir").alias("inside"), F.count_if(~F.col("in_dir")).alias("beside")).first()
    if r.inside and r.beside:
        return f"`{tests_dir}` ({r.inside}) and {r.beside} test files beside the code"
    return f"`{tests_dir}`" if r.inside else f"test files beside the code (no `{tests_dir}`)" if r.beside else f"`{tests_dir}` (none found)"


def coverage(rows: DataFrame, found: DataFrame, include: list[str] | None = None, min_impact: int = 4) -> DataFrame:
    """file, gap, commits, impact, complexity_raw, test_refs: churn over one more than the test files that contain the file's stem.

    Of rows (as techdebt gives them) those of at least `min_impact` and, if given, with a part of `include` in the path. A package's
    __init__ is never a target and counts as 99 references.
    """
    hot = rows.filter(F.col("impact") >= min_impact)
    hot = hot.filter(paths.contains_any(F.col("file"), include)) if include else hot
    hot = persisted(hot.withColumn("term", paths.stem(F.col("file"))))
    refs = mention_counts(found.select(F.col("src").alias("body")), hot.filter("term <> '__init__'"))
    joined = hot.join(refs, "term", "left").withColumn("test_refs", F.when(F.col("term") == "__init__", 99).otherwise(F.coalesce("refs", F.lit(0))).cast("int"))
    gap = F.round(F.col("churn_raw") / (1 + F.col("test_refs")), 1)
    return joined.select("file", gap.alias("gap"), "commits", "impact", F.col("complexity.raw").alias("complexity_raw"), "test_refs")
