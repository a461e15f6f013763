"""Shared plumbing of the training-data operators: table access, lineage cuts and distributed running totals."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Rows of an Arrow batch between Spark and Python: texts are long, and a batch is held on both sides.
BATCH_ROWS = "1000"


def bounded(spark: SparkSession) -> SparkSession:
    """The session, with Arrow batches of BATCH_ROWS rows at most."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver tables, through Spark's own reader (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z alone; every other code point stays as it is."""
    return F.translate(text, UPPER, LOWER)


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where it is unset, a folder of this machine, and an error if executors run elsewhere."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="quarrylight-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Checkpoints df in the shared folder and returns what was written. Partitions keep their number and order."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Writes df as a table in the shared folder and returns it; `names` gets the table's path.

    Unlike a checkpoint the table is compressed, read by columns, and of a size that the planner knows: a join broadcasts it below
    spark.sql.autoBroadcastJoinThreshold and shuffles beyond. Order and partitions aren't kept.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if names is not None:
        names.append(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, names: list[str]) -> None:
    """Deletes stored tables. All that depends on them must have been written before."""
    for path in names:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    names.clear()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running_total(df: DataFrame, order: list[str], out: str, value: str | None = None) -> tuple[DataFrame, int]:
    """df with column `out`: the sum of `value` (1 a row if None) over all rows before it in `order`; and the sum over all.

    Rows are range partitioned and sorted, so no group or tie lands in one task unless its rows agree in every
    order column. The driver receives one number a partition. Ties keep an arbitrary but fixed order, since the
    sorted rows are cut before they are numbered. Rows come back sorted within partitions.
    """
    spark = df.sparkSession
    part = "__part"
    placed = df.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    placed = cut(placed.withColumn(part, F.spark_partition_id()))
    amount = F.count(F.lit(1)) if value is None else F.sum(value)
    sums = {r[0]: int(r[1] or 0) for r in placed.groupBy(part).agg(amount).collect()}
    base, total = {}, 0
    for p in sorted(sums):
        base[p] = total
        total += sums[p]
    schema = T.StructType([f for f in placed.schema.fields if f.name != part] + [T.StructField(out, T.LongType())])

    def number(batches):
        seen = 0
        for b in batches:
            if not b.num_rows:
                continue
            start = base[b.column(part)[0].as_py()] + seen
            if value is None:
                own = pa.array(range(start, start + b.num_rows), pa.int64())
                seen += b.num_rows
            else:
                v = pc.fill_null(b.column(value).cast(pa.int64()), 0)
                upto = pc.cumulative_sum(v)
                own = pc.add(pc.subtract(upto, v), start)
                seen += upto[-1].as_py()
            keep = [n for n in b.schema.names if n != part]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), own], names=[*keep, out])

    return placed.mapInArrow(number, schema), total
