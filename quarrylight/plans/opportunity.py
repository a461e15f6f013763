"""Opportunity: the tech debt ranking again, after evidence from issues, findings and notes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import paths, text
from quarrylight.operators.joins import basename_mentions, still_standing
from quarrylight.operators.ordering import global_rank, persisted
from quarrylight.sources.repo import Repo


def open_issues(issues: DataFrame, pulls: DataFrame) -> DataFrame:
    """id, text of open issues that no merged pull request says to close."""
    shipped = pulls.select(F.explode(text.closed_issues(F.col("body"))).alias("number")).distinct()
    body = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("body", F.lit("")))
    return issues.join(shipped, "number", "left_anti").select(F.col("number").cast("string").alias("id"), body.alias("text"))


def open_notes(notes: DataFrame) -> DataFrame:
    """id, text of the notes of evidence files whose title doesn't say that they are settled."""
    return text.blocks(notes).filter(~text.is_resolved(F.col("text"))).select(F.concat_ws("#", "source", "block").alias("id"), "text")


def finding_counts(findings: DataFrame, changes: DataFrame) -> DataFrame:
    """file, audit: findings on files that did not change since."""
    timed = findings.filter("file is not null and file <> ''").select("file", text.iso_time(F.col("ts")).alias("at"))
    return still_standing(timed, changes).groupBy("file").agg(F.count(F.lit(1)).cast("int").alias("audit"))


def bonus(raw):
    """0, 1, 2, 3, 4 for evidence up to 0, 1, 2, 4 and beyond."""
    return F.when(raw <= 0, 0).when(raw <= 1, 1).when(raw <= 2, 2).when(raw <= 4, 3).otherwise(4)


def reranked(rows: DataFrame, target: str = "repo") -> DataFrame:
    """Rows of high churn with evidence_raw, new scores and both ranks, and delta_rank between them.

    rows: file, impact, opportunity, score, churn_raw, issues, audit, incidents. The old order is score, churn_raw, file.
    """
    rows = rows.filter("impact >= 3").withColumn("evidence_raw", F.col("issues") + 2 * F.col("audit") + 3 * F.col("incidents"))
    rows = rows.withColumn("new_opportunity", F.least(F.lit(5), F.col("opportunity") + bonus(F.col("evidence_raw"))).cast("int"))
    rows = rows.withColumn("new_score", F.col("impact") * F.col("new_opportunity"))
    rows = global_rank(rows, [F.desc("score"), F.desc("churn_raw"), F.asc("file")], "old_rank")
    rows = global_rank(rows, [F.desc("new_score"), F.desc("evidence_raw"), F.desc("churn_raw"), F.asc("old_rank")], "new_rank")
    return rows.withColumns({"delta_rank": F.col("old_rank") - F.col("new_rank"), "target": F.lit(target), "old_score": F.col("score")})


def movers(rows: DataFrame) -> DataFrame:
    """Rows that rose by evidence."""
    return rows.filter("delta_rank > 0 and evidence_raw > 0")


def opportunity(repo: Repo, techdebt: DataFrame, target: str = "repo", present: DataFrame | None = None) -> DataFrame:
    """Movers of a techdebt ranking by the repository's issues, findings and notes.

    Rows of files that `present` (path; default: the repository's files) lacks are dropped, unless it is empty. Issues and notes count for
    files whose basename no other row has.
    """
    present = repo.files.select("path") if present is None else present
    rows = techdebt
    if present.limit(1).count():
        rows = rows.join(present.select(F.col("path").alias("file")).distinct(), "file", "left_semi")
    rows = persisted(rows.filter("impact >= 3").withColumn("base", paths.basename(F.col("file"))))
    alone = rows.groupBy("base").agg((F.count(F.lit(1)) == 1).alias("basename_unique"))
    names = persisted(alone.filter("basename_unique").select("base"))
    issues = basename_mentions(open_issues(repo.table("issues"), repo.table("pulls")), names).withColumnRenamed("hits", "issues")
    notes = basename_mentions(open_notes(repo.table("notes")), names).withColumnRenamed("hits", "incidents")
    audit = finding_counts(repo.table("findings"), repo.table("changes"))
    joined = rows.join(alone, "base").join(issues, "base", "left").join(notes, "base", "left").join(audit, "file", "left").na.fill(0, ["issues", "incidents", "audit"])
    joined = joined.withColumns({c: F.col(c).cast("int") for c in ("issues", "incidents", "audit")})
    return movers(reranked(joined, target)).select(
        "target", "file", "delta_rank", "old_rank", "new_rank", "issues", "audit", "incidents", "evidence_raw", "basename_unique", "impact", "opportunity",
        "new_opportunity", "old_score", "new_score",
    )


def ordered(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc("delta_rank"), F.desc("evidence_raw"), "new_rank")
