"""Best-fit packing of documents into token sequences, with a matching of the large ones."""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.llm import tokens
from quarrylight.llm.common import dropped, shuffle_partitions, stored, table

CAPACITY, END = 1024, 2
#: Bits of monotonically_increasing_id that number the rows of a partition.
ROW_BITS = 33


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: all full but the first."""
    head = n % capacity
    return ([head] if head else []) + [capacity] * (n // capacity)


def tokenize(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END, payload: str = "ids") -> DataFrame:
    """One row a piece: doc_id, piece, start, length, and `ids` (array<int>) or, for payload "crc32", `ids_crc32`.

    Each document's ids end with `end`. A null or empty text is that id alone. Every row of docs is a document.
    """
    path = path or tokens.default_path()
    own = T.StructField("ids", T.ArrayType(T.IntegerType())) if payload == "ids" else T.StructField("ids_crc32", T.LongType())
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            own,
        ]
    )

    def run(batches):
        encode = tokens.encoder(path)
        for b in batches:
            if not b.num_rows:
                continue
            at, piece, start, length, out = [], [], [], [], []
            for i, text in enumerate(b.column("text")):
                ids = np.array([*encode(text.as_py() or ""), end], dtype="<u4")
                s = 0
                for k, n in enumerate(cut_lengths(len(ids), capacity)):
                    part = ids[s : s + n]
                    at.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    out.append(part.astype("<i4") if payload == "ids" else zlib.crc32(part.tobytes()))
                    s += n
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id").take(pa.array(at, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(out, pa.list_(pa.int32()) if payload == "ids" else pa.int64()),
                ],
                names=schema.names,
            )

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Packs `counts` (length -> pieces) as runs of equal bins; returns the placements and the number of bins.

    A placement (length, rank, n, bin, offset, per_bin) says that the pieces of `length` with ranks rank to
    rank + n - 1 go, per_bin at a time, to the bins from `bin` on, at `offset` and then one after another.

    Pieces above a third of the capacity meet at most in twos: from the longest down, each takes the longest
    partner that fits, which is a maximum matching. The others go, longest first, where the least room that
    suffices is left, else to new bins. The work and the result depend on the capacity, not on the number of pieces.
    """
    left, used, out = {n: c for n, c in counts.items() if c > 0}, dict.fromkeys(counts, 0), []
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens -> runs (first bin, bins)
    rooms: list[int] = []
    bins = 0

    def put(n: int, count: int, bin_: int, offset: int, per: int) -> None:
        out.append((n, used[n], count, bin_, offset, per))
        used[n] += count
        left[n] -= count

    def free(space: int, bin_: int, count: int) -> None:
        if count and space:
            if not room.get(space):
                bisect.insort(rooms, space)
            room.setdefault(space, []).append((bin_, count))

    large = sorted(n for n in left if 3 * n > capacity)
    for n in reversed(large):
        while left[n]:
            k = bisect.bisect_right(large, min(n, capacity - n)) - 1
            while k >= 0 and left[large[k]] < (2 if large[k] == n else 1):
                k -= 1
            other = large[k] if k >= 0 else None
            many = left[n] if other is None else left[n] // 2 if other == n else min(left[n], left[other])
            put(n, many, bins, 0, 1)
            if other is not None:
                put(other, many, bins, n, 1)
            free(capacity - n - (other or 0), bins, many)
            bins += many
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            k = bisect.bisect_left(rooms, n)
            if k == len(rooms):
                per = capacity // n
                many = -(-left[n] // per)
                free(capacity, bins, many)
                bins += many
                continue
            space = rooms[k]
            first, many = room[space].pop()
            if not room[space]:
                rooms.pop(k)
            per = space // n
            full = min(many, left[n] // per)
            if full:
                put(n, full * per, first, capacity - space, per)
                free(space - per * n, first, full)
            if full < many and left[n]:
                rest = left[n]  # fewer than per
                put(n, rest, first + full, capacity - space, rest)
                free(space - rest * n, first + full, 1)
                full += 1
            free(space, first + full, many - full)
    return out, bins


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (doc_id, piece, length, ...) with sequence_id (from 0) and offset, in as few sequences as best-fit finds.

    The driver sees the number of pieces of each length, at most `capacity` numbers, and plans on those alone. Each
    piece finds its place by its rank among pieces of its length, from one range-partitioned running count; a length
    that a third of all pieces share spreads over tasks by doc_id and piece. Sorted pieces are written once, compressed, each with
    its partition and place there, so they can be read in any order.
    """
    spark, order = pieces.sparkSession, ["length", "doc_id", "piece"]
    counts = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").agg(F.count(F.lit(1))).collect()}
    places, _ = plan(counts, capacity)
    before, first = 0, {}
    for n in sorted(counts):
        first[n] = before
        before += counts[n]
    rows = sorted((first[n] + rank, b, o, per) for n, rank, _, b, o, per in places)
    starts, bins, offsets, pers = (np.array(x, dtype=np.int64) for x in zip(*rows, strict=True)) if rows else [np.zeros(0, np.int64)] * 4
    names = pieces.columns
    schema = T.StructType([pieces.schema[c] for c in names] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    placed = pieces.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    placed = stored(placed.withColumn("__at", F.monotonically_increasing_id()))
    sums = {int(r[0]): int(r[1]) for r in placed.groupBy(F.shiftright("__at", ROW_BITS)).agg(F.count(F.lit(1))).collect()}
    base = np.zeros(max(sums, default=0) + 1, np.int64)
    for p in sorted(sums):
        base[p + 1 :] += sums[p]

    def place(batches):
        for b in batches:
            at, n = b.column("__at").to_numpy(), b.column("length").to_numpy()
            pos = base[at >> ROW_BITS] + (at & ((1 << ROW_BITS) - 1))
            k = np.searchsorted(starts, pos, side="right") - 1
            bin_, slot = np.divmod(pos - starts[k], pers[k])
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in names), pa.array(bins[k] + bin_, pa.int64()), pa.array(offsets[k] + slot * n, pa.int64())], names=schema.names
            )

    return placed.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END, payload: str = "ids") -> DataFrame:
    """Tokenizes docs (doc_id, text) and packs them: doc_id, piece, start, length, ids, sequence_id, offset.

    Only documents longer than `capacity` are cut; every piece but the first is full. Null and empty texts are
    one id long. Null doc_ids and repeated rows are documents like any other. Empty tables give an empty result.
    """
    scratch: list[str] = []
    pieces = stored(tokenize(docs, path, capacity, end, payload), scratch)  # the range sampling would tokenize again
    packed = pack(pieces, capacity)
    dropped(docs.sparkSession, scratch)
    return packed


def op2_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(table(spark, sf_dir, "documents"), payload="crc32")
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES = {"op2_bestfit_packing": op2_bestfit_packing}
ORACLE_SQL: dict[str, str] = {}
