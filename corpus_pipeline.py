"""A training corpus from raw documents: classify, deduplicate, cut repeats, decontaminate, pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm import decontaminate, packing, quality, simhash, suffixes
from quarrylight.llm.common import bounded, cut, stored, table
from quarrylight.session import ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps, from all labels of the corpus."""
    ship(bounded(spark))
    return quality.classify(docs, table(spark, sf_dir, "labels")).filter("keep").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that texts of five-word Jaccard similarity 0.8 or more link: the one with the smallest doc_id.

    Rows without doc_id come after all others. Of rows that share the group's smallest id the first in the order of the text's digest, lang,
    source, n_chars stays. A row belongs to its own text's group only, whatever other rows have its doc_id.
    """
    ship(bounded(spark))
    rows = simhash.near_copies(docs.select(*COLUMNS))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.md5("text").alias("digest"), "lang", "source", "n_chars", "row")
    one = rows.groupBy("group").agg(F.min(order).alias("one"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("group", F.col("one.row").alias("kept"))
    gone = stored(rows.select("group", "row").join(one, "group").filter("row <> kept").select("row"))
    return rows.join(gone, "row", "left_anti").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of over 50 words, or of 400 bytes, that also start elsewhere. A character that is cut within goes as a whole."""
    ship(bounded(spark))
    rest = suffixes.remove_repeats(docs.select(*COLUMNS), kept="text", words=suffixes.PASSAGE)
    return rest.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast(docs.schema["n_chars"].dataType).alias("n_chars"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    ship(bounded(spark))
    keyed = docs.select(*COLUMNS).withColumn("__key", F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))))
    hit = decontaminate.decontaminate(keyed.select("__key", "text"), table(spark, sf_dir, "benchmark"))
    return keyed.join(hit.filter("contaminated").select("__key").distinct(), "__key", "left_anti").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: a row a piece, with its ids, sequence and offset."""
    ship(bounded(spark))
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", classify_quality),
    ("simhash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack),
]
#: Models, fingerprints and tokens are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written to the shared folder before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs
