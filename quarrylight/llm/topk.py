"""Exact top-k inner products by norm-bucketed retrieval."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.llm.common import cut, shuffle_partitions, table

K, SCALE = 10, 1024
#: The longest vectors, from which each query's first threshold comes: at most so many rows go through the driver.
SEEDS = 1024
#: Rows of a packed block of queries and of a bucket of candidates of like length.
QUERY_ROWS, BUCKET_ROWS = 4096, 4096
#: Above this local cosine threshold a bucket is pruned by a coordinate, else by length.
COORDINATE_FROM = 0.3
#: Below this product of lengths every partial sum is exact in a double.
EXACT = float(2**53)


def _matrix(blobs: list[bytes]) -> np.ndarray:
    """Vectors as rows; shorter ones are padded by zeros."""
    if len({len(b) for b in blobs}) <= 1:
        return np.frombuffer(b"".join(blobs), dtype="<f8").reshape(len(blobs), -1)
    out = np.zeros((len(blobs), max(map(len, blobs)) // 8))
    for row, b in zip(out, blobs, strict=True):
        row[: len(b) // 8] = np.frombuffer(b, dtype="<f8")
    return out


def _alike(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = max(a.shape[1], b.shape[1])
    return tuple(x if x.shape[1] == d else np.pad(x, ((0, 0), (0, d - x.shape[1]))) for x in (a, b))


def _products(c: np.ndarray, q: np.ndarray, longest: float) -> np.ndarray:
    """Exact integer products of rows of c with q (a row or rows), clipped to 64 bits."""
    if longest < EXACT:
        return (c @ q.T).astype(np.int64)
    wide = c.astype(object) @ q.T.astype(object)
    to = np.frompyfunc(lambda x: max(-(2**63), min(2**63 - 1, int(x))), 1, 1)
    return to(np.frompyfunc(int, 1, 1)(wide)).astype(np.int64)



def _best(score: np.ndarray, ids: np.ndarray, k: int, least: float) -> np.ndarray:
    """Positions of the k highest scores of at least `least`, ties to the smaller id."""
    at = np.flatnonzero(score >= least) if least > -np.inf else np.arange(len(score))
    if len(at) > k:
        kth = np.partition(score[at], len(at) - k)[len(at) - k]
        at = at[score[at] >= kth]
    return at[np.lexsort((ids[at], -score[at].astype(object) if len(at) and score[at].min() == -(2**63) else -score[at]))][:k]


def quantise(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v (little-endian doubles floor(scale * x)), len. Rows that take no part are gone: a null id, a null vector, or
    a null or non-finite component."""
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("v", T.BinaryType()), T.StructField("len", T.DoubleType())])

    def run(batches):
        for b in batches:
            ids, out, own = [], [], []
            for i, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if i is None or not x.is_valid or x.values.null_count:
                    continue
                v = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
                with np.errstate(over="ignore", invalid="ignore"):
                    v = np.floor(v * scale)
                if np.isfinite(v).all():
                    ids.append(i)
                    out.append(v.astype("<f8").tobytes())
                    own.append(float(np.sqrt(np.square(v).sum())))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary()), pa.array(own, pa.float64())], names=schema.names)

    return vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, schema)


def _packed(rows: DataFrame, size: int, extra: str | None = None) -> DataFrame:
    """Consecutive rows of each partition as blocks: block (unique), ids, v, len, rows, longest, and for queries theta and the least need."""
    names = ["block", "ids", "v", "len", "width", "longest"] + (["theta", "need"] if extra else [])
    kinds = [T.LongType(), T.BinaryType(), T.BinaryType(), T.BinaryType(), T.IntegerType(), T.DoubleType(), T.BinaryType(), T.DoubleType()]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=False)])

    def run(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        held: list[tuple] = []

        def give(rows):
            m = _matrix([r[1] for r in rows])
            own = np.array([r[2] for r in rows])
            out = [block, np.array([r[0] for r in rows], "<i8").tobytes(), np.ascontiguousarray(m).tobytes(), own.tobytes(), m.shape[1], float(own.max())]
            if extra:
                out += [np.array([r[3] for r in rows]).tobytes(), float(min(r[4] for r in rows))]
            return pa.RecordBatch.from_arrays([pa.array([x], s) for x, s in zip(out, _ARROW, strict=False)], names=names)

        for b in batches:
            held += zip(*(c.to_pylist() for c in b.columns), strict=True)
            while len(held) >= size:
                yield give(held[:size])
                held, block = held[size:], block + 1
        if held:
            yield give(held)

    return rows.mapInArrow(run, schema)


_ARROW = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.float64(), pa.binary(), pa.float64()]


def _bucket(qid, q, qlen, theta, cid, c, clen, k):
    """Yields (query position, candidate positions, scores) of the pairs in one bucket that may be among a query's k best.

    Candidates come longest first. A query's local cosine threshold is theta / (its length * the bucket's longest).
    Above 1 nothing in the bucket can do. A high one bounds the angle to the query's largest coordinate: candidates
    outside that range are left out. A low one bounds the length: a prefix of the bucket remains.
    """
    q, c = _alike(q, c)
    unit = None
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = np.where(theta > 0, theta / (qlen * clen[0]), -np.inf)
        need = np.where(theta > 0, theta / qlen, -np.inf)
    slack = 1e-9
    ends = np.searchsorted(-clen, -(need * (1 - slack)), side="right")
    by_length = []
    for i in np.flatnonzero(~(cosine > 1 + slack)):
        t = cosine[i]
        if t < COORDINATE_FROM:
            by_length.append(i)
            continue
        if unit is None:
            with np.errstate(divide="ignore", invalid="ignore"):
                unit = np.where(clen[:, None] > 0, c / clen[:, None], 0)
        f = int(np.abs(q[i]).argmax())
        phi, tau = np.arccos(np.clip(q[i, f] / qlen[i], -1, 1)), np.arccos(min(t, 1.0))
        low, high = np.cos(min(np.pi, phi + tau)), np.cos(max(0.0, phi - tau))
        own = unit[: ends[i], f]
        at = np.flatnonzero((own >= low - slack) & (own <= high + slack))
        at = at[cid[at] != qid[i]]
        if len(at):
            s = _products(c[at], q[i], qlen[i] * clen[0])
            best = _best(s, cid[at], k, theta[i])
            yield i, at[best], s[best]
    by_length = sorted(by_length, key=lambda i: ends[i])
    for j in range(0, len(by_length), 256):
        group = by_length[j : j + 256]
        end = ends[group[-1]]
        s = _products(c[:end], q[group], float(qlen[group].max() * clen[0]))
        for col, i in enumerate(group):
            at = np.flatnonzero(cid[: ends[i]] != qid[i])
            best = _best(s[at, col], cid[at], k, theta[i])
            yield i, at[best], s[at[best], col]


def top_k(vectors: DataFrame, query: Column, k: int = K, scale: int = SCALE) -> DataFrame:
    """The k largest inner products of each vector that `query` selects with all other vectors: query_id, rank, vec_id, score.

    vectors: vec_id, embedding. Components are floor(scale * x); products are exact integers (clipped to 64 bits);
    ties go to the smaller vec_id. A shorter vector counts as padded by zeros.

    1. The SEEDS longest vectors give each query a first threshold: its k-th best product with them.
    2. All vectors are range partitioned by length (and id, which splits a hot length) and packed into buckets of
       neighbouring lengths; the queries are packed by the length that a candidate needs to reach their threshold.
    3. A bucket meets only those query blocks whose need its longest vector reaches. Inside, each query chooses
       pruning by length or by a coordinate, and products of what remains are verified.
    4. Each meeting gives at most k rows a query, and the k best of these are the result.

    Null ids, null vectors, and vectors with null or non-finite components take no part. Rows that share a vec_id
    are candidates each, but never for queries of that id; such queries share one ranking. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = quantise(vectors, scale)
    seeds = rows.orderBy(F.desc("len"), "vec_id").limit(SEEDS).collect()
    queries = rows.filter(query)
    sid = np.array([r.vec_id for r in seeds], np.int64)
    sv = _matrix([bytes(r.v) for r in seeds]) if seeds else np.zeros((0, 0))
    slen = np.array([r.len for r in seeds])
    shared = spark.sparkContext.broadcast((sid, sv, slen))

    def first_threshold(batches):
        sid, sv, slen = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            ids, own = b.column(0).to_numpy(), b.column(2).to_numpy()
            q, s = _alike(_matrix(b.column(1).to_pylist()), sv)
            theta = np.full(len(ids), -np.inf)
            if len(sid) > k:
                p = _products(s, q, float(own.max() * slen[0]))
                for i in range(len(ids)):
                    rest = p[sid != ids[i], i]
                    if len(rest) >= k:
                        theta[i] = np.partition(rest, len(rest) - k)[len(rest) - k]
            with np.errstate(divide="ignore", invalid="ignore"):
                need = np.where((theta > 0) & (own > 0), theta / own, 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(theta), pa.array(need)], names=["vec_id", "v", "len", "theta", "need"])

    thresholds = T.StructType([*rows.schema.fields, T.StructField("theta", T.DoubleType()), T.StructField("need", T.DoubleType())])
    queries = cut(queries.mapInArrow(first_threshold, thresholds))
    n_blocks = max(1, -(-queries.count() // QUERY_ROWS))
    blocks = queries.repartitionByRange(n_blocks, F.desc("need"), "vec_id").coalesce(n_blocks).sortWithinPartitions(F.desc("need"), "vec_id")
    blocks = cut(_packed(blocks, QUERY_ROWS, "queries"))
    needs = [(r.block, r.need) for r in blocks.select("block", "need").collect()]
    parts = shuffle_partitions(spark)
    buckets = _packed(rows.repartitionByRange(parts, F.desc("len"), "vec_id").sortWithinPartitions(F.desc("len"), "vec_id"), BUCKET_ROWS)
    slots = 2 * parts
    meets = F.array(*[F.when(F.col("c_longest") >= need * (1 - 1e-9), F.lit(block)) for block, need in needs]) if needs else F.array(F.lit(None).cast("long"))
    sides = [
        df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns if c not in ("block", "need")], *more)
        for df, p, more in (
            (blocks, "q", [F.col("block").alias("meet"), F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot")]),
            (buckets, "c", [F.pmod(F.xxhash64("block"), F.lit(slots)).cast("int").alias("slot")]),
        )
    ]
    met = sides[1].withColumn("meet", F.explode(F.array_compact(meets))).join(sides[0], ["meet", "slot"])
    result = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])

    def verify(batches):
        for b in batches:
            for r in b.to_pylist():
                q, c = (np.frombuffer(r[f"{p}_v"], "<f8").reshape(-1, r[f"{p}_width"]) if r[f"{p}_width"] else np.zeros((len(r[f"{p}_ids"]) // 8, 0)) for p in "qc")
                qid, cid = (np.frombuffer(r[f"{p}_ids"], "<i8") for p in "qc")
                qlen, clen = (np.frombuffer(r[f"{p}_len"], "<f8") for p in "qc")
                theta = np.frombuffer(r["q_theta"], "<f8")
                found = list(_bucket(qid, q, qlen, theta, cid, c, clen, k))
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.repeat(qid[[i for i, _, _ in found]], [len(at) for _, at, _ in found])),
                            pa.array(cid[np.concatenate([at for _, at, _ in found])]),
                            pa.array(np.concatenate([s for _, _, s in found])),
                        ],
                        names=result.names,
                    )

    pairs = met.mapInArrow(verify, result)
    ranked = pairs.withColumn("rank", F.expr("row_number() over (partition by query_id order by score desc, vec_id)"))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_norm_bucketed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(100)) == 0)


QUERIES = {"op1_norm_bucketed_topk": op1_norm_bucketed_topk}
ORACLE_SQL = {
    "op1_norm_bucketed_topk": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    p AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
        FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
    r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM p)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
}
