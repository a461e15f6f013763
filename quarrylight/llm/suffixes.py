"""Removal of repeated byte strings: suffixes at content-chosen anchors, ordered by deep-shallow sorting."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.llm.common import dropped, shuffle_partitions, stored, table

#: A byte goes if a string of LENGTH bytes over it also starts elsewhere.
LENGTH = 400
#: A passage of over 50 words is one whatever its bytes.
PASSAGE = 51
#: Bytes, or words, of an anchor; every window holds the anchor whose hash is its least.
GRAM, WORD_GRAM = 32, 4
#: Multikey quicksort goes so many bytes deep; longer common prefixes are ordered by blind tries.
SHALLOW = 16
#: Contexts of one anchor that are compared in one task; larger groups are split by longer shared strings.
GROUP = 512
#: Bytes or words of a text whose anchors are sought at once; shorter texts are joined up to GATHERED.
CHUNK, GATHERED = 1 << 22, 1 << 18

_U = np.uint64


# --- sorting ---------------------------------------------------------------------------------------------------------


def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def _blind_trie(strings: list[bytes], at: list[int]) -> list[int]:
    """The positions `at` in the order of their strings, by a trie that keeps branching bytes only.

    A string is inserted by walking down on the bytes at the nodes' depths, blind to what lies between, to any leaf;
    its common prefix with that leaf's string tells where on the way it branches off.
    """
    char = lambda s, d: s[d] if d < len(s) else -1
    root: list = [at[0]]  # a leaf is a list of positions, a node a tuple (depth, children)
    for i in at[1:]:
        s, node = strings[i], root
        while isinstance(node, tuple):
            node = node[1].get(char(s, node[0])) or next(iter(node[1].values()))
        other = strings[node[0]]
        d = common(s, other)
        if d == len(s) == len(other):
            node.append(i)
            continue
        above, node = None, root
        while isinstance(node, tuple) and node[0] < d:
            above, node = node, node[1][char(s, node[0])]
        if isinstance(node, tuple) and node[0] == d:
            node[1][char(s, d)] = [i]
            continue
        fork = (d, {char(other, d): node, char(s, d): [i]})
        if above is None:
            root = fork
        else:
            above[1][char(s, above[0])] = fork
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, tuple):
            stack += [node[1][c] for c in sorted(node[1], reverse=True)]
        else:
            out += node
    return out


def deep_shallow(strings: list[bytes], shared: int = 0, shallow: int = SHALLOW) -> list[int]:
    """Positions of `strings`, which agree in `shared` bytes, in lexicographic order.

    Multikey quicksort on single bytes down to `shallow` bytes further, then a blind trie for each group that still agrees.
    """
    char = lambda i, d: strings[i][d] if d < len(strings[i]) else -1
    out: list[int] = []
    stack = [(list(range(len(strings))), shared)]
    while stack:
        at, depth = stack.pop()
        if len(at) < 2:
            out += at
        elif depth >= shared + shallow:
            out += _blind_trie(strings, at)
        else:
            pivot = sorted(char(at[k], depth) for k in (0, len(at) // 2, -1))[1]
            less, same, more = [], [], []
            for i in at:
                c = char(i, depth)
                (less if c < pivot else more if c > pivot else same).append(i)
            stack += [(more, depth), (same, depth + 1 if pivot >= 0 else shared + shallow), (less, depth)]
    return out


def _agreement(strings: list[bytes], shared: int = 0) -> np.ndarray:
    """Common prefix lengths of all pairs of a group, from the sorted order: the least of the neighbours' between them."""
    order, m = deep_shallow(strings, shared), len(strings)
    near = np.array([common(strings[a], strings[b]) for a, b in zip(order, order[1:], strict=False)], np.int32)
    out = np.zeros((m, m), np.int32)
    for i in range(m - 1):
        least = np.minimum.accumulate(near[i:])
        out[order[i], order[i + 1 :]] = least
        out[order[i + 1 :], order[i]] = least
    return out


def shared_windows(bodies: list[bytes], low: list[int], high: list[int], length: int = LENGTH, unit: int = 1) -> list[list[tuple[int, int]]]:
    """For distinct contexts of one anchor: each one's windows that another has too, as ranges of distances before the anchor.

    All is counted in units of `unit` bytes. Context i holds the windows that start low[i] to high[i] before the anchor, so the anchor is
    at its place high[i]. A window at distance d is shared with a context that agrees in d to the left and length - d to the right.
    """
    right = _agreement([b[h * unit :] for b, h in zip(bodies, high, strict=True)]) // unit
    left = _agreement([b[: h * unit][::-1] for b, h in zip(bodies, high, strict=True)]) // unit
    lo = np.maximum(np.array(low)[:, None], length - right)
    hi = np.minimum(np.array(high)[:, None], left)
    np.fill_diagonal(lo, length + 1)
    out = []
    for i in range(len(bodies)):
        own = lo[i] <= hi[i]
        merged: list[tuple[int, int]] = []
        for a, b in sorted(set(zip(lo[i][own].tolist(), hi[i][own].tolist(), strict=True))):
            if merged and a <= merged[-1][1] + 1:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        out.append(merged)
    return out


# --- words -----------------------------------------------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(29).integers(0, 1 << 63, 256, dtype=np.uint64)
_BYTE[_SPACE] = 0
#: Factors of a word's first, second, ... byte.
_PLACE = np.random.default_rng(31).integers(0, 1 << 63, 1024, dtype=np.uint64) | np.uint64(1)


def _word_starts(raw: np.ndarray) -> np.ndarray:
    """Where words begin: after ASCII white space, and at and after each character of Chinese or Japanese script (a word by itself)."""
    space, alone = _SPACE[raw], (raw >= 0xE3) & (raw <= 0xE9)
    begins = alone.copy()
    begins[:1] = True
    begins[1:] |= space[:-1]
    begins[3:] |= alone[:-3]
    return np.flatnonzero(begins & ~space)


def _words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a text, and where they begin."""
    starts = _word_starts(raw)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    place = np.arange(starts[0], len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))
    values = _BYTE[raw[starts[0] :]] * _PLACE[place % len(_PLACE)]
    values ^= (values >> np.uint64(32)) * (1 + place // len(_PLACE)).astype(np.uint64)
    return np.add.reduceat(values, starts - starts[0]), starts


def word_spans(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text begin and end."""
    given = np.frombuffer(raw, np.uint8)
    starts = _word_starts(given)
    ends = np.zeros(len(given) + 1, bool)
    ends[starts] = True
    ends[:-1] |= _SPACE[given]
    ends[-1] = True
    return starts, (np.flatnonzero(ends[1:] & ~np.append(True, _SPACE[given])[1:]) + 1 if len(given) else starts)


# --- anchors ---------------------------------------------------------------------------------------------------------


def _gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of every run of `gram` (a power of two) bytes, by doubling."""
    h = (raw.astype(_U) + _U(1)) * _U(0x9E3779B97F4A7C15)
    step = 1
    while step < gram:
        h ^= h >> _U(29)
        h = h[:-step] * _U(0xBF58476D1CE4E5B9) + h[step:]
        step *= 2
    h ^= h >> _U(32)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(29)
    return h


def _least(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of `width` values: suffix minima of a block against prefix minima of the next."""
    n = len(v) - width + 1
    padded = np.full(-(-len(v) // width) * width, np.iinfo(_U).max, _U)
    padded[: len(v)] = v
    blocks = padded.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def _anchored(units: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Hash, place, first and last window of the anchors of texts that lie between `bounds`, one after the other."""
    none = np.zeros(0, np.int64)
    if len(units) < length:
        return none, none, none, none
    h, place_bits = _gram_hashes(units, gram), _U((1 << 24) - 1)
    best = _least((h & ~place_bits) | np.arange(len(h), dtype=_U), length - gram + 1) & place_bits
    begin = np.flatnonzero(np.arange(length, length + len(best)) <= np.repeat(bounds[1:], np.diff(bounds))[: len(best)])
    if not len(begin):
        return none, none, none, none
    best = best[begin].astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (best[1:] != best[:-1]) | (begin[1:] != begin[:-1] + 1)]))
    at = best[new]
    return h[at].view(np.int64), at, begin[new], begin[np.append(new[1:], len(begin)) - 1]


def anchors_of(raw, length: int = LENGTH, gram: int = GRAM):
    """Yields (hash, place, low, high) of a text's anchors: the windows that start low to high before `place` are its own.

    A window's anchor is the run of `gram` bytes (or words, of an array of their hashes) within it with the least hash, the first of equals, so windows
    that are the same have the same anchor at the same distance. Long texts are taken in overlapping stretches.
    """
    units = np.frombuffer(raw, np.uint8) if isinstance(raw, bytes) else raw
    for begin in range(0, len(units) - length + 1, CHUNK):
        part = units[begin : begin + CHUNK + length - 1]
        key, at, first, last = _anchored(part, np.array([0, len(part)]), length, gram)
        yield from zip(key.tolist(), (at + begin).tolist(), (at - last).tolist(), (at - first).tolist(), strict=True)


def _gathered(texts: list[bytes], words: bool):
    """Yields (number of the first text, units, bounds) of short texts joined, and of long ones alone."""
    i = 0
    while i < len(texts):
        j, size = i + 1, len(texts[i])
        while j < len(texts) and size + len(texts[j]) <= GATHERED:
            size += len(texts[j])
            j += 1
        lens = np.array([len(t) for t in texts[i:j]])
        if words:
            units, starts = _words(np.frombuffer(b" ".join(texts[i:j]), np.uint8))
            yield i, units, np.append(0, np.searchsorted(starts, np.cumsum(lens + 1)))
        else:
            yield i, np.frombuffer(b"".join(texts[i:j]), np.uint8), np.append(0, np.cumsum(lens))
        i = j


def _context_hash(body, low: int, high: int) -> int:
    h = xxhash.xxh3_64(body, seed=low * 1024 + high)
    return h.intdigest() - (1 << 63)


#: n anchors of a batch have the key and context; the place is that of one of them. Rows with n = 0 are runs of a text from pos up to ctx.
_ANCHOR = T.StructType([T.StructField(n, k) for n, k in (("key", T.LongType()), ("ctx", T.LongType()), ("dk", T.BinaryType()), ("pos", T.LongType()), ("low", T.IntegerType()), ("high", T.IntegerType()), ("n", T.LongType()))])
_SPANS = T.ArrayType(T.StructType([T.StructField("lo", T.IntegerType()), T.StructField("hi", T.IntegerType())]))
_SPANS_ARROW = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))


def _anchors(texts: DataFrame, length: int, gram: int, words: bool) -> DataFrame:
    """Anchors of the bytes, or words, of every text (dk, raw): key (hash of the anchor), ctx (hash of all its windows together), place and windows.

    What a batch tells by itself is settled there: copies of a text are taken once (that they repeat is known from their number), and anchors
    that agree in key and context give one row, with their number, and the runs of their texts that so are known to repeat.
    """
    unit = 8 if words else 1

    def run(batches):
        for b in batches:
            dks, seen = b.column("dk").to_pylist(), {}
            for i, dk in enumerate(dks):
                seen.setdefault(dk, i)
            order = list(seen.values())
            raws = [x.as_py() for x in b.column("raw").take(pa.array(order, pa.int64()))] if order else []
            found, ctxs = [np.zeros((5, 0), np.int64)], []
            for first_text, units, bounds in _gathered(raws, words):
                view = memoryview(units).cast("B")
                for begin in range(0, len(units) - length + 1, CHUNK):  # several times for a long text only, which is alone
                    part = units[begin : begin + CHUNK + length - 1]
                    key, at, first, last = _anchored(part, np.minimum(bounds, len(part)) if begin == 0 else np.array([0, len(part)]), length, gram)
                    at, first, last = at + begin, first + begin, last + begin
                    low, high = at - last, at - first
                    ctxs += [_context_hash(view[a * unit : z * unit], x, y) for a, z, x, y in zip(first.tolist(), (last + length).tolist(), low.tolist(), high.tolist(), strict=True)]
                    text = np.searchsorted(bounds, at, "right") - 1
                    found.append(np.stack([key, text + first_text, at - bounds[text], low, high]))
            key, text, pos, low, high = np.concatenate(found, axis=1)
            ctx = np.array(ctxs, np.int64)
            by = np.lexsort((ctx, key))
            new = np.concatenate([[True], (key[by][1:] != key[by][:-1]) | (ctx[by][1:] != ctx[by][:-1])]) if len(by) else np.zeros(0, bool)
            one, group = by[new], np.cumsum(new) - 1
            n = np.bincount(group, minlength=len(one))
            many = np.sort(by[n[group] > 1])  # in the order of texts and places
            start, end = pos[many] - high[many], pos[many] - low[many] + length
            opens = np.concatenate([[True], (text[many][1:] != text[many][:-1]) | (start[1:] > end[:-1])]) if len(many) else np.zeros(0, bool)
            closes = np.append(opens[1:], True) if len(many) else opens
            zero = np.zeros(int(opens.sum()), np.int64)
            columns = [(key[one], zero), (ctx[one], end[closes]), (text[one], text[many][opens]), (pos[one], start[opens]), (low[one], zero), (high[one], zero), (n, zero)]
            key, ctx, text, pos, low, high, n = (np.concatenate(c).astype(np.int64) for c in columns)
            owners = b.column("dk").take(pa.array(np.array(order, np.int64)[text]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(ctx), owners.cast(pa.binary()), pa.array(pos), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)), pa.array(n)], names=_ANCHOR.names
            )

    least = 2 * length - 1 if words else length  # bytes of so many words of one byte each
    return texts.filter(F.octet_length("raw") >= least).mapInArrow(run, _ANCHOR)


def _contexts(texts: DataFrame, places: DataFrame, length: int, gram: int, words: bool, scratch: list[str]) -> DataFrame:
    """Columns of _CLASS for contexts (key, ctx, n, dk, pos, low, high), with their bytes, or hashes of words, out of one of the texts with that digest."""
    by_text = stored(places.groupBy("dk").agg(F.collect_list(F.struct("key", "ctx", "n", "pos", "low", "high")).alias("at")), scratch)
    held = texts.join(by_text.select("dk"), "dk", "left_semi").groupBy("dk").agg(F.first("raw").alias("raw"))
    unit = 8 if words else 1

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 16):
                out = []
                for raw, at in zip(b.column("raw")[i : i + 16], b.column("at")[i : i + 16].to_pylist(), strict=True):
                    body = _words(np.frombuffer(raw.as_py(), np.uint8))[0].tobytes() if words else raw.as_py()
                    out += [(a["key"], a["ctx"], a["n"], a["low"], a["high"], 0, length - gram, body[(a["pos"] - a["high"]) * unit : (a["pos"] - a["low"] + length) * unit]) for a in at]
                kinds = [pa.int64()] * 3 + [pa.int32()] * 4 + [pa.binary()]
                columns = list(zip(*out, strict=True)) if out else [()] * 8
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=_CLASS.names)

    return held.join(by_text, "dk").select("raw", "at").mapInArrow(run, _CLASS)


# --- groups ----------------------------------------------------------------------------------------------------------

_CLASS = T.StructType(
    [T.StructField(n, k) for n, k in (("key", T.LongType()), ("ctx", T.LongType()), ("n", T.LongType()), ("low", T.IntegerType()), ("high", T.IntegerType()), ("lo", T.IntegerType()), ("hi", T.IntegerType()), ("body", T.BinaryType()))]
)
_FOUND = T.StructType([T.StructField("key", T.LongType()), T.StructField("ctx", T.LongType()), T.StructField("spans", _SPANS)])


def _compare(classes: DataFrame, length: int, unit: int) -> DataFrame:
    """Groups of at most GROUP contexts with one key: the shared windows of each context that has any."""

    def settle(group: list[tuple]) -> list[tuple]:
        if len(group) < 2:
            return []
        spans = shared_windows([g[5] for g in group], [g[3] for g in group], [g[4] for g in group], length, unit)
        return [(g[0], g[1], s) for g, s in zip(group, spans, strict=True) if g[2] == 1 and s]

    def run(batches):
        group: list[tuple] = []
        for b in batches:
            out: list[tuple] = []
            for row in zip(*(b.column(c).to_pylist() for c in ("key", "ctx", "n", "low", "high", "body")), strict=True):
                if group and row[0] != group[0][0]:
                    out += settle(group)
                    group = []
                group.append(row)
            yield give(out)
        if group:
            yield give(settle(group))

    def give(out):
        spans = [[{"lo": a, "hi": z} for a, z in s] for _, _, s in out]
        return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array(spans, _SPANS_ARROW)], names=_FOUND.names)

    n = shuffle_partitions(classes.sparkSession)
    return classes.repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, _FOUND)


def _split(classes: DataFrame, length: int, unit: int) -> DataFrame:
    """Contexts of too large groups, cut into four ranges of windows; the key of a range is what all its windows share."""
    schema = T.StructType([T.StructField("of_key", T.LongType()), T.StructField("of_ctx", T.LongType()), *_CLASS.fields])

    def run(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                step = -(-(r["hi"] - r["lo"] + 1) // 4)
                for lo in range(r["lo"], r["hi"] + 1, step):
                    hi = min(lo + step - 1, r["hi"])
                    low, high = max(lo, r["low"]), min(hi, r["high"])
                    if low > high:
                        continue
                    at, body = r["high"], r["body"]  # the anchor's place in the context
                    core = body[(at - lo) * unit : (at + length - hi) * unit]
                    own = body[(at - high) * unit : (at + length - low) * unit]
                    key = xxhash.xxh3_64(core, seed=lo * 1024 + hi).intdigest() - (1 << 63)
                    out.append((r["key"], r["ctx"], key, _context_hash(own, low, high), r["n"], low, high, lo, hi, own))
            kinds = [pa.int64()] * 5 + [pa.int32()] * 4 + [pa.binary()]
            columns = list(zip(*out, strict=True)) if out else [()] * 10
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=schema.names)

    return classes.mapInArrow(run, schema)


def _whole() -> F.Column:
    return F.array(F.struct(F.col("low").alias("lo"), F.col("high").alias("hi")))


def _merged(spans: F.Column) -> F.Column:
    """Ranges of windows in order, overlapping and neighbouring ones as one."""
    last = lambda acc: F.try_element_at(acc, F.lit(-1))
    more = lambda acc, s: F.when(
        s["lo"] <= last(acc)["hi"] + 1,
        F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last(acc)["lo"].alias("lo"), F.greatest(last(acc)["hi"], s["hi"]).alias("hi")))),
    ).otherwise(F.concat(acc, F.array(s)))
    return F.aggregate(F.sort_array(spans), F.expr("cast(array() as array<struct<lo:int,hi:int>>)"), more)


def _resolve(classes: DataFrame, length: int, unit: int, scratch: list[str]) -> DataFrame:
    """Shared windows (key, ctx, spans) of contexts (columns of _CLASS) that are alone in having all their windows but share their key.

    Groups beyond GROUP contexts are not compared: their contexts are cut into ranges of windows, keyed by a longer
    shared string each, which parts the group or makes contexts equal; at the latest a range of one window does.
    """
    classes = stored(classes, scratch)
    sizes = stored(classes.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), scratch)
    if not sizes.filter(F.col("size") > GROUP).limit(1).count():
        return _compare(classes, length, unit)
    sized = classes.join(sizes, "key")
    small = _compare(sized.filter(F.col("size") <= GROUP).drop("size"), length, unit)
    ranges = stored(_split(sized.filter(F.col("size") > GROUP).drop("size"), length, unit), scratch)
    keys = ranges.groupBy("key").agg(F.sum("n").alias("copies"), F.min("ctx").alias("least"), F.max("ctx").alias("most")).filter("copies > 1")
    shared = stored(ranges.join(stored(keys, scratch), "key"), scratch)
    alike = shared.filter("least = most").select("of_key", "of_ctx", _whole().alias("spans"))
    open_ = shared.filter("least <> most")
    kept = open_.groupBy("key", "ctx").agg(
        F.sum("n").alias("n"), *[F.first(c).alias(c) for c in ("low", "high", "lo", "hi", "body")]
    )
    kept = stored(kept.select(*_CLASS.names), scratch)
    found = stored(_resolve(kept, length, unit, scratch), scratch)
    several = kept.filter("n > 1").select("key", "ctx", _whole().alias("spans"))
    inner = open_.select("of_key", "of_ctx", "key", "ctx").join(found.union(several), ["key", "ctx"]).select("of_key", "of_ctx", "spans")
    big = alike.union(inner).groupBy("of_key", "of_ctx").agg(_merged(F.flatten(F.collect_list("spans"))).alias("spans"))
    return small.union(big.select(F.col("of_key").alias("key"), F.col("of_ctx").alias("ctx"), "spans"))


def _keyed(docs: DataFrame) -> DataFrame:
    raw = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    return docs.withColumn("raw", raw).withColumn("dk", F.unhex(F.md5("raw")))


def repeated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """dk (16-byte digest of a text) and gone (byte ranges to remove, apart and in order: pairs of 64-bit numbers), for texts that have any."""
    return _repeated(_keyed(docs).select("dk", "raw"), length, GRAM, False)


def repeated_words(docs: DataFrame, words: int) -> DataFrame:
    """dk and gone_words (ranges of words, as in repeated), for texts with a run of `words` words that also starts elsewhere.

    A word is what ASCII white space parts, and each character of Chinese or Japanese script.
    """
    return _repeated(_keyed(docs).select("dk", "raw"), words, min(WORD_GRAM, words), True).withColumnRenamed("gone", "gone_words")


def _pairs(gone: bytes | None) -> np.ndarray:
    return np.frombuffer(gone or b"", np.int64).reshape(-1, 2)


def _word_ranges(raw: bytes, gone: np.ndarray) -> list[tuple[int, int]]:
    """Byte ranges, from ranges of words."""
    if not len(gone):
        return []
    starts, ends = word_spans(raw)
    return list(zip(starts[gone[:, 0]].tolist(), ends[gone[:, 1] - 1].tolist(), strict=True))


def _repeated(texts: DataFrame, length: int, gram: int, words: bool) -> DataFrame:
    unit, scratch = 8 if words else 1, []
    both = stored(_anchors(texts, length, gram, words), scratch)
    anchors = both.filter("n > 0")
    keys = anchors.groupBy("key").agg(F.sum("n").alias("copies"), F.min("ctx").alias("least"), F.max("ctx").alias("most"))
    keys = stored(keys.filter("copies > 1").drop("copies"), scratch)  # by itself, so that Spark may split the anchors of a frequent key in the join
    shared = stored(anchors.join(keys, "key").select(*_ANCHOR.names, (F.col("least") != F.col("most")).alias("open")), scratch)
    open_ = shared.filter("open")
    kinds = open_.groupBy("key", "ctx").agg(F.sum("n").alias("n"), F.min(F.struct("dk", "pos", "low", "high")).alias("one"))
    kinds = stored(kinds.select("key", "ctx", "n", "one.*"), scratch)
    found = stored(_resolve(_contexts(texts, kinds, length, gram, words, scratch), length, unit, scratch), scratch)
    several = kinds.filter("n > 1").select("key", "ctx", _whole().alias("spans"))
    part = open_.filter("n = 1").join(found.union(several), ["key", "ctx"]).select("dk", "pos", F.explode("spans").alias("s"))
    part = part.select("dk", "pos", F.col("s.lo").alias("low"), F.col("s.hi").alias("high"))
    every = shared.filter("not open and n = 1").select("dk", "pos", "low", "high").union(part)
    span = lambda a, z: F.struct(a.cast("long").alias("start"), z.cast("long").alias("end")).alias("run")
    runs = every.select("dk", span(F.col("pos") - F.col("high"), F.col("pos") - F.col("low") + length))
    runs = runs.union(both.filter("n = 0").select("dk", span(F.col("pos"), F.col("ctx")))).union(_copied(texts, length, words, scratch))
    schema = T.StructType([T.StructField("dk", T.BinaryType()), T.StructField("gone", T.BinaryType())])

    def merge(batches):
        for b in batches:
            out = []
            for own in b.column("runs"):
                x = np.array([(r["start"], r["end"]) for r in own.as_py()], np.int64)
                x = x[np.lexsort((x[:, 1], x[:, 0]))]
                upto = np.maximum.accumulate(x[:, 1])
                opens = np.flatnonzero(np.concatenate([[True], x[1:, 0] > upto[:-1]]))
                out.append(np.stack([x[opens, 0], upto[np.append(opens[1:], len(x)) - 1]], 1).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("dk"), pa.array(out, pa.binary())], names=schema.names)

    out = stored(runs.groupBy("dk").agg(F.collect_set("run").alias("runs")).mapInArrow(merge, schema))
    dropped(texts.sparkSession, scratch)
    return out


def _copied(texts: DataFrame, length: int, words: bool, scratch: list[str]) -> DataFrame:
    """Texts that occur more than once, if long enough, as one run each."""
    schema = T.StructType([T.StructField("dk", T.BinaryType()), T.StructField("size", T.LongType())])
    copied = texts.groupBy("dk").agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("raw")).cast("long").alias("size")).filter("n > 1").drop("n")

    def count(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("dk"), pa.array([len(_word_starts(np.frombuffer(x.as_py(), np.uint8))) for x in b.column("raw")], pa.int64())], names=schema.names)

    if words:
        held = texts.join(stored(copied.select("dk"), scratch), "dk", "left_semi").groupBy("dk").agg(F.first("raw").alias("raw"))
        copied = held.mapInArrow(count, schema)
    return copied.filter(F.col("size") >= length).select("dk", F.struct(F.lit(0).cast("long").alias("start"), F.col("size").alias("end")).alias("run"))


_GONE = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept", T.BinaryType())])


def _without(raw: bytes, gone: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """Removed bytes, maximal removed runs, and what is left."""
    left, upto, removed, runs = [], 0, 0, 0
    for start, end in sorted(gone):
        if start > upto or (start == 0 and not runs):
            runs += 1
            left.append(raw[upto:start])
            removed += end - start
        elif end > upto:
            removed += end - upto
        upto = max(upto, end)
    left.append(raw[upto:])
    return removed, runs, b"".join(left)


def remove_repeats(docs: DataFrame, length: int = LENGTH, kept: str | None = "bytes", words: int | None = None, remove_words: bool = True) -> DataFrame:
    """Every column of docs but text, with n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and kept: what is left, as "bytes", as
    "text" (without the bytes of characters that were cut within), or not at all (None).

    Removed is each byte of a text (UTF-8; null: empty) covered by a string of `length` bytes that also starts
    anywhere else in the corpus, the same text and copies of it included; overlaps count, and all is judged on the input.
    With `words`, n_repeated_words counts the words in runs of that many that also start elsewhere, whatever their bytes and the white space
    within; unless remove_words is False they go as well.

    1. Each window of `length` bytes has one anchor, the run of GRAM bytes with the least hash, so equal windows meet
       under equal anchors. An anchor's windows make up its context. A batch of texts settles by itself what repeats within it.
    2. Anchors whose bytes occur once are done: nothing there repeats. Those whose contexts are all equal are done too:
       all of it repeats. Both are counts by key, combined before the shuffle.
    3. One of each of the other, contested, contexts is fetched. Within a group the suffixes right of the anchor, and the
       reversed ones left of it, are put in order by deep-shallow sorting, and neighbours' common prefixes tell which windows are shared.
       Groups over GROUP contexts are split first by longer shared strings.
    4. The ranges go back to all texts that have the context.

    Contexts and texts count as equal if 128-bit digests (64 of the anchor, 64 of the context) agree. Texts shorter
    than `length` keep everything. Repeated rows are copies and lose all their windows. Columns of docs with the names of results
    are replaced. Empty tables give an empty result.
    """
    clash = [c for c in docs.columns if c in (*_GONE.names, "n_repeated_words", "kept_sha256", "dk", "raw", "gone", "gone_words")]
    rows = _keyed(docs.drop(*clash))
    names = [c for c in rows.columns if c not in ("text", "raw", "dk")]
    joined = rows.drop("text").join(repeated(docs.select("text"), length), "dk", "left")
    joined = (joined.join(repeated_words(docs.select("text"), words), "dk", "left") if words else joined).drop("dk")
    extra = [*_GONE.fields[:3], T.StructField("kept_sha256", T.StringType())]
    extra += [T.StructField("n_repeated_words", T.LongType())] if words else []
    extra += [T.StructField("kept", T.BinaryType() if kept == "bytes" else T.StringType())] if kept else []
    schema = T.StructType([*(docs.schema[c] for c in names), *extra])

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                sizes, removed, runs, digests, left, counts = [], [], [], [], [], []
                pairs = lambda c: [_pairs(x) for x in part.column(c).to_pylist()]  # noqa: B023, E731
                of_words = pairs("gone_words") if words else [_pairs(None)] * part.num_rows
                for raw, gone, more in zip(part.column("raw").to_pylist(), pairs("gone"), of_words, strict=True):
                    n, k, rest = _without(raw, [*map(tuple, gone.tolist())] + (_word_ranges(raw, more) if remove_words else []))
                    sizes.append(len(raw))
                    removed.append(n)
                    runs.append(k)
                    counts.append(int((more[:, 1] - more[:, 0]).sum()))
                    digests.append(hashlib.sha256(rest).hexdigest())
                    left.append(rest if kept == "bytes" else rest.decode("utf-8", "ignore") if kept else None)
                more = [pa.array(x, pa.int64()) for x in (sizes, removed, runs)] + [pa.array(digests, pa.string())]
                more += [pa.array(counts, pa.int64())] if words else []
                more += [pa.array(left, pa.binary() if kept == "bytes" else pa.string())] if kept else []
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *more], names=schema.names)

    return joined.mapInArrow(run, schema)


def op7_deep_shallow_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest's bytes, and beside them the words in passages of PASSAGE words or more that also start elsewhere."""
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), kept=None, words=PASSAGE, remove_words=False)


QUERIES = {"op7_deep_shallow_dedup": op7_deep_shallow_dedup}
ORACLE_SQL: dict[str, str] = {}
