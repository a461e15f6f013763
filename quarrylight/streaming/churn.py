"""The churn rollup over a stream of commit touches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quarrylight.plans.techdebt import churn


def churn_stream(numstat: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Keeps file, commits, lines of a numstat stream (added, deleted, raw_path) up to date in an in-memory table; state is checkpointed."""
    return churn(numstat).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()
