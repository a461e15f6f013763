"""Continuous integration: how often a workflow runs times how often it fails."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.functions.text import iso_time
from quarrylight.operators.ordering import quintile_share
from quarrylight.plans.techdebt import scored


def health(runs: DataFrame) -> DataFrame:
    """workflow, runs, success, failure, cancelled, other, failure_rate (of success and failure), p50_min.

    runs: workflow, done, conclusion, seconds. p50_min is the upper median of all completed runs, waiting included, in minutes.
    """
    ended = lambda c: F.count_if(F.col("done") & F.coalesce(F.col("conclusion") == c, F.lit(False))).cast("int")
    each = runs.groupBy("workflow").agg(
        F.count(F.lit(1)).cast("int").alias("runs"),
        *[ended(c).alias(c) for c in ("success", "failure", "cancelled")],
        F.count_if("done").cast("int").alias("ended"),
        F.sort_array(F.collect_list(F.when(F.col("done"), F.col("seconds")))).alias("s"),
    )
    judged = F.col("success") + F.col("failure")
    rate = F.when(judged > 0, F.round(F.col("failure") / judged, 3)).otherwise(0.0)
    median = F.round(F.try_element_at("s", F.floor(F.size("s") / 2).cast("int") + 1) / F.lit(60.0), 1)
    other = F.col("ended") - F.col("success") - F.col("failure") - F.col("cancelled")
    return each.select("workflow", "runs", "success", "failure", "cancelled", other.alias("other"), rate.alias("failure_rate"), median.alias("p50_min"))


def ci(runs: DataFrame) -> DataFrame:
    """health of recorded runs (workflowName, conclusion, status, createdAt, updatedAt), with impact, opportunity and score."""
    took = iso_time(F.col("updatedAt")).cast("double") - iso_time(F.col("createdAt")).cast("double")
    rows = runs.select(F.col("workflowName").alias("workflow"), F.coalesce(F.col("status") == "completed", F.lit(False)).alias("done"), "conclusion", took.alias("seconds"))
    return scored(health(rows), "runs", "failure_rate", quintile_share)


def ordered(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc("score"), F.desc("failure_rate"), F.desc("runs"), "workflow")
