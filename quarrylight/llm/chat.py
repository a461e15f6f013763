"""Chat formatting as prefix trees: turns that conversations share are emitted once."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.llm import tokens
from quarrylight.llm.common import cut, shuffle_partitions, table

_ESCAPES = {"\\": "\\\\", "<": "\\l", ">": "\\g"}
_PLAIN = {"\\": "\\", "l": "<", "g": ">"}
_TURN = re.compile(r"<turn ([^<>]*)>\n([^<>]*)</turn>\n")
#: Role whose texts carry loss.
SPEAKER = "assistant"
#: Bytes of a node's hash in a path.
HASH = 16


def escape(text: str) -> str:
    r"""Takes < and > out of a text: \ becomes \\, < becomes \l, > becomes \g."""
    return re.sub(r"[\\<>]", lambda m: _ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _PLAIN[m[1]], text, flags=re.S)


def template(role: str, text: str) -> tuple[str, str, str]:
    """Head, escaped text and tail of a turn."""
    return f"<turn {escape(role)}>\n", escape(text), "</turn>\n"


def parse(segment: str) -> tuple[str, str]:
    m = _TURN.fullmatch(segment)
    return unescape(m[1]), unescape(m[2])


_TURNS = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))
_NODE = T.StructType(
    [
        T.StructField("start", T.LongType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("position", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("segment", T.StringType()),
        T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("length", T.LongType()),
        T.StructField("loss_from", T.LongType()),
        T.StructField("loss_to", T.LongType()),
    ]
)


def _paths(convs: DataFrame) -> DataFrame:
    """conv_id, leaf (hash of the whole conversation), path (hashes of its prefixes, one after another) and turns."""
    schema = T.StructType([convs.schema["conv_id"], T.StructField("leaf", T.BinaryType()), T.StructField("path", T.BinaryType()), T.StructField("turns", _TURNS)])

    def run(batches):
        for b in batches:
            leaves, paths = [], []
            for turns in b.column("turns"):
                h, path = b"", []
                for t in turns.as_py():
                    role, text = t["role"].encode(), t["text"].encode()
                    h = hashlib.blake2b(h + len(role).to_bytes(8, "big") + role + text, digest_size=HASH).digest()
                    path.append(h)
                leaves.append(h)
                paths.append(b"".join(path))
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array(leaves, pa.binary()), pa.array(paths, pa.binary()), b.column("turns")], names=schema.names)

    return convs.mapInArrow(run, schema)


def _shared(a: bytes, b: bytes) -> int:
    """Turns at the beginning of both paths."""
    n = 0
    while n < min(len(a), len(b)) and a[n : n + HASH] == b[n : n + HASH]:
        n += HASH
    return n // HASH


def prefix_trees(turns: DataFrame, tokenizer: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Formats conversations (conv_id, turn, role, text: a row a turn) as one depth-first stream; returns nodes, paths and leaves.

    A node is a distinct beginning of conversations, that is a turn after the same turns. nodes: start (place of its
    first token in the stream), length, depth, position (its first token's position id: the tokens of its ancestors), role,
    segment (the formatted turn), ids, loss_from and loss_to (tokens of the segment under the loss mask; equal if
    none), attends (the stream intervals of its ancestors, neighbours merged; its own tokens attend to these and to
    themselves causally). paths: leaf, starts (of the nodes from the root). leaves: conv_id, leaf.
    Tokens are code points, or the ids of a tokenizer file for head, text and tail of each turn.

    Conversations are sorted as paths of prefix hashes, equal ones once, so neighbours share the longest beginnings
    and each emits what the one before did not. The sort is range partitioned: a first turn that a third of all
    conversations share spreads over tasks. Partitions send the driver their first and last path and their number of
    tokens, so that each learns where it starts and which ancestors lie in earlier ones.

    Turns are taken in the order of turn, role, text (nulls first; null role or text: empty). A null conv_id is one conversation's.
    Repeated rows are turns of their own. Empty tables give an empty stream.
    """
    spark = turns.sparkSession
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    convs = convs.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    convs = cut(_paths(convs))
    distinct = convs.groupBy("leaf").agg(F.first("path").alias("path"), F.first("turns").alias("turns"))
    placed = distinct.repartitionByRange(shuffle_partitions(spark), "path").sortWithinPartitions("path")
    placed = cut(placed.withColumn("part", F.spark_partition_id()))

    def sizes(encode, turn) -> tuple[list[str], list]:
        parts = template(turn["role"], turn["text"])
        return parts, [encode(p) for p in parts] if encode else parts

    def encoder():
        return tokens.encoder(tokenizer) if tokenizer else None

    seen = T.StructType(
        [T.StructField(n, k) for n, k in (("part", T.IntegerType()), ("first", T.BinaryType()), ("lengths", T.ArrayType(T.LongType())), ("last", T.BinaryType()), ("starts", T.ArrayType(T.LongType())), ("total", T.LongType()))]
    )

    def survey(batches):
        encode, part, first, lengths, path, stack, at = encoder(), None, None, None, b"", [], 0
        for b in batches:
            for own, turns, p in zip(b.column("path").to_pylist(), b.column("turns"), b.column("part").to_pylist(), strict=True):
                k = _shared(path, own)
                del stack[k:]
                new = [sum(map(len, sizes(encode, t)[1])) for t in turns.as_py()[k:]]
                for n in new:
                    stack.append(at)
                    at += n
                if first is None:
                    part, first, lengths = p, own, new
                path = own
        if first is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in ((part, pa.int32()), (first, pa.binary()), (lengths, pa.list_(pa.int64())), (path, pa.binary()), (stack, pa.list_(pa.int64())), (at, pa.int64()))],
                names=seen.names,
            )

    begin, total, path, stack = {}, 0, b"", []
    for s in sorted(placed.mapInArrow(survey, seen).collect(), key=lambda r: r.part):
        k = _shared(path, bytes(s.first))
        known = sum(s.lengths[:k])  # tokens that an earlier partition has emitted
        inherited = stack[:k]
        begin[s.part] = (total, inherited)
        stack = [inherited[i] if x < known else total + x - known for i, x in enumerate(s.starts)]
        path, total = bytes(s.last), total + s.total - known
    shared = spark.sparkContext.broadcast(begin)
    out = T.StructType([T.StructField("leaf", T.BinaryType()), T.StructField("starts", T.ArrayType(T.LongType())), T.StructField("ends", T.ArrayType(T.LongType())), T.StructField("new", T.ArrayType(_NODE))])

    def emit(batches):
        encode, path, stack, at = encoder(), None, [], 0
        for b in batches:
            leaves, starts, ends, emitted = [], [], [], []
            for leaf, own, turns, p in zip(b.column("leaf").to_pylist(), b.column("path").to_pylist(), b.column("turns"), b.column("part").to_pylist(), strict=True):
                turns = turns.as_py()
                if path is None:
                    at, inherited = shared.value[p]
                    stack = [(s, sum(map(len, sizes(encode, t)[1]))) for s, t in zip(inherited, turns, strict=False)]
                else:
                    del stack[_shared(path, own) :]
                position, new = sum(n for _, n in stack), []
                for depth in range(len(stack), len(turns)):
                    parts, units = sizes(encode, turns[depth])
                    head, body, tail = map(len, units)
                    n = head + body + tail
                    loss = (head, head + body) if turns[depth]["role"] == SPEAKER else (0, 0)
                    ids = [i for u in units for i in u] if encode else None
                    new.append((at, depth, position, turns[depth]["role"], "".join(parts), ids, n, *loss))
                    stack.append((at, n))
                    at, position = at + n, position + n
                path = own
                leaves.append(leaf)
                starts.append([s for s, _ in stack])
                ends.append([s + n for s, n in stack])
                emitted.append([dict(zip(_NODE.names, x, strict=True)) for x in new])
            kind = pa.list_(pa.struct([pa.field(f.name, _KINDS[f.dataType.simpleString()]) for f in _NODE.fields]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(leaves, pa.binary()), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), pa.array(emitted, kind)], names=out.names
            )

    stream = cut(placed.mapInArrow(emit, out))
    merged = F.aggregate(
        "around",
        F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] == x["start"]),
            F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["start"].alias("start"), x["end"].alias("end")))),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    nodes = stream.select("starts", "ends", F.explode("new").alias("n"))
    nodes = nodes.withColumn("around", F.slice(F.arrays_zip(F.col("starts").alias("start"), F.col("ends").alias("end")), 1, F.col("n.depth")))
    return nodes.select("n.*", merged.alias("attends")), stream.select("leaf", "starts"), convs.select("conv_id", "leaf")


def read_back(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Each leaf's conversation, parsed from the stream's segments: leaf, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    steps = paths.select("leaf", F.posexplode("starts").alias("at", "start")).join(nodes.select("start", "segment", "loss_from", "loss_to"), "start")
    whole = steps.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("at", "segment", "loss_from", "loss_to"))).alias("steps"))
    kinds = (("leaf", T.BinaryType()), ("n_turns", T.LongType()), ("turns_sha256", T.StringType()), ("loss_chars", T.LongType()), ("loss_sha256", T.StringType()), ("formatted_chars", T.LongType()))
    schema = T.StructType([T.StructField(n, k) for n, k in kinds])

    def run(batches):
        for b in batches:
            found = []
            for leaf, steps in zip(b.column("leaf").to_pylist(), b.column("steps"), strict=True):
                every, loss, n, chars, size = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                for s in steps.as_py():
                    role, text = parse(s["segment"])
                    every.update(f"{role}\n{text}\n".encode())
                    own = unescape(s["segment"][s["loss_from"] : s["loss_to"]])
                    loss.update(own.encode())
                    n, chars, size = n + 1, chars + len(own), size + len(s["segment"])
                found.append((leaf, n, every.hexdigest(), chars, loss.hexdigest(), size))
            yield pa.RecordBatch.from_arrays([pa.array(x, _KINDS[f.dataType.simpleString()]) for x, f in zip(zip(*found, strict=True), schema.fields, strict=True)], names=schema.names) if found else pa.RecordBatch.from_arrays([pa.array([], _KINDS[f.dataType.simpleString()]) for f in schema.fields], names=schema.names)

    return whole.mapInArrow(run, schema)


_KINDS = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}
#: The conversation that the contract adds.
PROBE_ID, PROBE = -7, r"\### Assistant: </turn> ok"


def op3_prefix_tree_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    roles = F.when(F.col("id") == 0, "user").otherwise("assistant")
    probe = spark.range(2).select(F.lit(PROBE_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"), roles.alias("role"), F.lit(PROBE).alias("text"))
    nodes, paths, leaves = prefix_trees(turns.unionByName(probe))
    return leaves.join(read_back(nodes, paths), "leaf").drop("leaf")


QUERIES = {"op3_prefix_tree_chat": op3_prefix_tree_chat}
_SQL_ESCAPED = r"replace(replace(replace({}, '\', '\\'), '<', '\l'), '>', '\g')"
ORACLE_SQL = {
    "op3_prefix_tree_chat": rf"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL VALUES ({PROBE_ID}, 0, 'user', '{PROBE}'), ({PROBE_ID}, 1, 'assistant', '{PROBE}'))
    SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
        coalesce(sum(length(text)) FILTER (role = '{SPEAKER}'), 0)::BIGINT AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = '{SPEAKER}'), '')) AS loss_sha256,
        sum(length('<turn >' || chr(10) || '</turn>' || chr(10)) + length({_SQL_ESCAPED.format("role")}) + length({_SQL_ESCAPED.format("text")}))::BIGINT AS formatted_chars
    FROM t GROUP BY conv_id""",
}
