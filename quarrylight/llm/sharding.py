"""Proportional stratified interleaving of documents into shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm.common import running_total, table

SHARDS, SEED = 16, 20240611


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """Deals documents to shards so that each shard has the corpus's mixture of sources.

    Within each source the rows are shuffled by a seeded hash and ranked; a row's fractional rank is
    (rank + 1/2) / rows of the source. All rows sorted by it are cut into `shards` runs whose sizes differ by one
    at most (law `rows`). A source's share of any shard is then its share of the corpus up to rounding.

    Both orders are made by range partitioning over columns that tell nearly all rows apart, so a source with a
    third of all rows spreads over as many tasks as its size needs. Only the columns named in `keep` travel along.

    Returns doc_id, source, size (UTF-8 bytes of text plus 1), text_crc32 (unsigned), shard, slot (from 0), and
    `keep`. A null text has no bytes and checksum 0; a null source is a stratum of its own; a null doc_id is
    placed as any other. Repeated rows each get a place. An empty table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        "source",
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(F.encode(text, "utf-8")).cast("long").alias("text_crc32"),
        *[c for c in keep if c not in ("doc_id", "source")],
    )
    rows = rows.withColumns(
        {
            "__stratum": F.coalesce(F.concat(F.lit("="), "source"), F.lit("")),
            "__mix": F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"), F.col("text_crc32").cast("string"))),
        }
    )
    tie = ["__mix", "doc_id", "text_crc32", "size"]
    ranked, total = running_total(rows, ["__stratum", *tie], "__pos")
    strata = ranked.groupBy("__stratum").agg(F.min("__pos").alias("__first"), F.count(F.lit(1)).alias("__rows"))
    mixed = ranked.join(strata, "__stratum").withColumn("__frac", (F.col("__pos") - F.col("__first") + F.lit(0.5)) / F.col("__rows"))
    dealt, _ = running_total(mixed.drop("__pos", "__first", "__rows"), ["__frac", "__stratum", *tie], "__at")
    n = max(total, 1)
    shard = F.expr(f"cast(__at * {shards} div {n} as int)")
    first = F.expr(f"(cast(shard as bigint) * {n} + {shards - 1}) div {shards}")
    dealt = dealt.withColumn("shard", shard).withColumn("slot", (F.col("__at") - first).cast("long"))
    return dealt.drop("__stratum", "__mix", "__frac", "__at")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Writes every column of docs to `path`, one folder a shard (shard=K), each file in slot order; returns the assignment with texts."""
    keep = tuple(c for c in docs.columns if c not in ("size", "text_crc32", "shard", "slot"))
    placed = shard_documents(docs, shards, seed, keep)
    placed.sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)
    return docs.sparkSession.read.parquet(path)


def op9_stratified_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return shard_documents(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source"
    )


QUERIES = {"op9_stratified_sharding": op9_stratified_sharding}
ORACLE_SQL: dict[str, str] = {}
