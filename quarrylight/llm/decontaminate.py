"""Benchmark decontamination: a prefix-filtered join of item windows with documents, in DataFrame operations alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm.common import LOWER, UPPER, cut, stored, table

WINDOW = 10
#: Bytes of windows that are broadcast at once; larger benchmarks are joined in blocks of this size.
BLOCK_BYTES = 8 << 20

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lowered; none for null."""
    lowered = F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    return F.filter(F.split(F.coalesce(lowered, F.lit("")), _GAP), lambda w: w != "")


def windows_of(items: DataFrame, width: int = WINDOW) -> DataFrame:
    """win (the distinct windows, as arrays of words) and items (ids that have it, sorted as strings)."""
    w = items.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - width, F.lit(0)))
    each = w.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, width))).alias("win"))
    return each.groupBy("win").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _anchored(windows: DataFrame, rarity: DataFrame) -> DataFrame:
    """Each window with its rarest word and that word's first place in it.

    A document that holds all words of a window holds its rarest: under exact containment the necessary prefix of
    the window's words, ordered from the rarest, is this one word.
    """
    words = windows.select("win", "items", F.posexplode("win").alias("place", "word"))
    least = words.join(rarity, "word", "left").groupBy("win").agg(
        F.first("items").alias("items"), F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "place")).alias("key")
    )
    return least.select("win", "items", F.col("key.word").alias("word"), F.col("key.place").alias("place"))


def hits(docs: DataFrame, items: DataFrame, width: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every column of docs but text, with n_words, spans (occurrences of windows: structs of first and last-plus-one word) and items.

    1. Words of the benchmark are counted over all documents: rarity.
    2. Every window is keyed by its rarest word (ties: alphabet, then place).
    3. Each document word that is some window's key proposes one start. Length and position bound it: the window
       must lie within the document. The proposal is verified word by word, inside the same stage.
    4. Verified occurrences, and one row a document, are grouped by a row number of the scan.

    The benchmark is broadcast in blocks of at most `block_bytes`, each against all documents in a pass of its own; one
    block is the rule. Only verified occurrences and one row a document are shuffled, never the words.
    """
    windows = cut(windows_of(items, width))
    size = windows.agg(F.sum(F.octet_length(F.array_join("win", " ")) + F.octet_length(F.array_join("items", " ")) + 256)).first()[0] or 0
    blocks = max(1, -(-int(size) // block_bytes))
    carried = [c for c in docs.columns if c != "text"]
    docs = docs.withColumn("__row", F.monotonically_increasing_id())
    if blocks > 1:  # several passes must see one numbering
        docs = stored(docs)
    base = docs.select("__row", F.struct(*carried).alias("__doc"), words_of(F.col("text")).alias("__w"))
    place = base.select("*", F.posexplode(F.array_append("__w", F.lit(""))).alias("__at", "word"))
    passes = []
    for i in range(blocks):
        block = windows if blocks == 1 else windows.filter(F.pmod(F.xxhash64("win"), F.lit(blocks)) == i)
        vocabulary = block.select(F.explode("win").alias("word")).distinct()
        seen = docs.select(F.explode(words_of(F.col("text"))).alias("word")).join(F.broadcast(vocabulary), "word")
        keyed = cut(_anchored(block, seen.groupBy("word").agg(F.count(F.lit(1)).alias("n"))))
        if i == 0:  # the row that stands for the document itself: no word is empty
            nothing = F.array().cast("array<string>")
            own = docs.sparkSession.range(1).select(nothing.alias("win"), nothing.alias("items"), F.lit("").alias("word"), F.lit(0).alias("place"))
            keyed = keyed.union(own)
        start, length = F.col("__at") - F.col("place"), F.size("win")
        itself = length == 0
        fits = (start >= 0) & (start + length <= F.size("__w"))
        same = F.slice("__w", F.greatest(start, F.lit(0)) + 1, length) == F.col("win")
        passes.append(
            place.join(F.broadcast(keyed), "word")
            .filter(itself | (fits & same))
            .select(
                "__row",
                F.when(itself, F.col("__doc")).alias("__doc"),
                F.when(itself, F.size("__w").cast("long")).alias("n_words"),
                F.when(~itself, F.struct(start.cast("long").alias("start"), (start + length).cast("long").alias("end"))).alias("span"),
                F.when(~itself, F.col("items")).alias("ids"),
            )
        )
    return (
        reduce(DataFrame.unionByName, passes)
        .groupBy("__row")
        .agg(
            F.first("__doc", ignorenulls=True).alias("__doc"),
            F.max("n_words").alias("n_words"),
            F.sort_array(F.collect_set("span")).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("items"),
        )
        .select("__doc.*", "n_words", "spans", "items")
    )


def hit_words() -> Column:
    """Words covered by the sorted occurrences in `spans`."""
    nothing = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))
    more = lambda acc, s: F.struct(
        (acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], acc["upto"]))).cast("long").alias("n"), F.greatest(acc["upto"], s["end"]).alias("upto")
    )
    return F.aggregate("spans", nothing, more, lambda acc: acc["n"])


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """Every column of docs but text, with n_words, n_hit, n_items, items_sha256, contaminated and spans; one row for each row of docs.

    Null, empty and wordless texts have no words and no hits. Null texts and wordless items have no windows; an item
    without an id is nobody's hit, though its windows count as hit words. Repeated rows and ids each keep their row.
    Items that share a window all count. Columns of docs with
    the names of results are replaced. Empty documents give an empty result, an empty benchmark no hits.
    """
    docs = docs.drop("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans", "items")
    found = hits(docs, items, width).withColumn("n_hit", hit_words())
    return found.select(
        *[c for c in docs.columns if c != "text"],
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "spans",
    )


def op5_prefix_filter_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).drop("spans")


QUERIES = {"op5_prefix_filter_decontamination": op5_prefix_filter_decontamination}
_SQL_WORDS = r"""list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""
ORACLE_SQL = {
    "op5_prefix_filter_decontamination": f"""WITH i AS (SELECT item_id::VARCHAR AS item, {_SQL_WORDS} AS w FROM benchmark),
    win AS (SELECT item, w[s:s + least(len(w), {WINDOW}) - 1] AS win FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
    d AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_WORDS} AS w FROM documents),
    lens AS (SELECT DISTINCT len(win) AS n FROM win),
    dw AS (SELECT r, s, n, w[s:s + n - 1] AS win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n)),
    h AS (SELECT r, s, n, item FROM dw JOIN win USING (win)),
    hw AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM h) GROUP BY 1),
    hi AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM h GROUP BY 1)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
        sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN hw USING (r) LEFT JOIN hi USING (r)""",
}
