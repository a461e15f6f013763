"""Near-duplicates by SimHash, joined through vantage-point trees."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.llm.common import cut, dropped, shuffle_partitions, stored, table
from quarrylight.llm.components import components

SHINGLE, RADIUS, SEED = 3, 2, 42
#: The upper tree is fitted on about so many fingerprints at most (a share chosen by hash), and aims at leaves of about so many.
SAMPLE, LEAF = 65536, 8192
#: Below so many fingerprints the pairs of a node are compared outright.
SMALL = 256
#: Vantage points tried at a node.
TRIES = 4


def _hashes(words: list[bytes], k: int) -> list[int]:
    if len(words) <= k:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    return [xxhash.xxh64_intdigest(s, SEED) for s in map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False))]


def fingerprints_of(texts: list[str | None], k: int = SHINGLE) -> np.ndarray:
    """SimHash of each text: a bit is 1 if it is set in over half the hashes of the text's word shingles, repeats included."""
    return np.array([_simhash(shingles_of(text, k)) for text in texts], dtype="<u8")


def shingles_of(text: str | None, k: int) -> np.ndarray:
    """Hashes of the text's word shingles, repeats included; a text of fewer words has one."""
    return np.array(_hashes((text or "").encode().lower().split(), k), dtype="<u8")  # bytes: only A-Z, only ASCII spaces


def _simhash(found: np.ndarray) -> int:
    ones, n = np.zeros(64, np.int64), len(found)
    for j in range(0, n, 65536):
        ones += np.unpackbits(found[j : j + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0]) if n else 0


def fingerprint(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every row of docs."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("fp", T.LongType())])

    def run(batches):
        for b in batches:
            fp = fingerprints_of([x.as_py() for x in b.column("text")], k)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _distance(a, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _split(points: np.ndarray, radius: int, rng: np.random.Generator) -> tuple[np.uint64, int] | None:
    """The vantage point and ball that leave the smaller larger side, of a few tried; None if no ball parts the points."""
    best = None
    for v in points[rng.integers(0, len(points), TRIES)]:
        upto = np.cumsum(np.bincount(_distance(points, v), minlength=65)) / len(points)
        beyond = 1 - np.concatenate([np.zeros(radius), upto])[:65]  # share farther than r - radius: the outer side
        worst = np.maximum(upto, beyond)
        r = int(worst.argmin())
        if worst[r] < 0.9 and (best is None or worst[r] < best[0]):
            best = (worst[r], v, r)
    return best and (best[1], best[2])


def fit(points: np.ndarray, total: int, radius: int = RADIUS, leaf: int = LEAF) -> list[tuple[int, int, int, int]]:
    """An upper tree over a sample of `total` fingerprints: nodes (vantage, ball, inside, outside); a child below 0 is the leaf -child - 1."""
    rng, nodes, leaves = np.random.default_rng(7), [], 0
    share = total / max(1, len(points))

    def grow(own: np.ndarray) -> int:
        nonlocal leaves
        cut_at = _split(own, radius, rng) if len(own) * share > leaf and len(own) >= 32 else None
        if cut_at is None:
            leaves += 1
            return -leaves
        at = len(nodes)
        nodes.append(None)
        d = _distance(own, cut_at[0])
        nodes[at] = (int(cut_at[0]), cut_at[1], grow(own[d <= cut_at[1]]), grow(own[d > cut_at[1] - radius]))
        return at

    grow(points)
    return nodes


def route(points: np.ndarray, nodes: list, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Positions and leaves: each point goes to its own side, and from inside a ball also outside if it lies within `radius` of the edge.

    Two points within `radius` of each other meet in a leaf: if a ball parts them, the triangle inequality puts the
    inner one in that rim.
    """
    out, stack = [], [(0 if nodes else -1, np.arange(len(points)))]
    while stack:
        node, at = stack.pop()
        if node < 0:
            out.append((at, np.full(len(at), -node - 1, np.int32)))
            continue
        v, r, inside, outside = nodes[node]
        d = _distance(points[at], np.uint64(v))
        stack += [(inside, at[d <= r]), (outside, at[d > r - radius])]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up


def link(points: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For distinct points: each one's component under distances up to `radius`, as the position of a member.

    A vantage-point tree is walked with the same rims as the upper one; only its small nodes compare pairs.
    """
    rng, parent = np.random.default_rng(11), np.arange(len(points))
    pairs: list[np.ndarray] = []
    held = 0

    def settle() -> None:
        nonlocal held
        if not pairs:
            return
        a, b = np.concatenate(pairs, axis=1)
        pairs.clear()
        held = 0
        while True:
            ra, rb = parent[a], parent[b]
            open_ = ra != rb
            if not open_.any():
                return
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
            parent[:] = _roots(parent)

    stack = [np.arange(len(points))]
    while stack:
        at = stack.pop()
        found = _split(points[at], radius, rng) if len(at) > SMALL else None
        if found:
            d = _distance(points[at], found[0])
            stack += [at[d <= found[1]], at[d > found[1] - radius]]
            continue
        for i in range(0, len(at), SMALL):  # one block, or more where no ball parts the points
            rows = at[i : i + SMALL]
            for j in range(i, len(at), 4096):
                cols = at[j : j + 4096]
                x, y = np.nonzero(_distance(points[rows][:, None], points[cols][None, :]) <= radius)
                own = rows[x] != cols[y]
                pairs.append(np.stack([rows[x[own]], cols[y[own]]]))
                held += int(own.sum())
            if held > 1_000_000:
                settle()
    settle()
    return _roots(parent)


def near_duplicates(docs: DataFrame, k: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Links documents whose fingerprints differ by `radius` bits or fewer: doc_id, fp, component_id (smallest doc_id reachable).

    1. Fingerprints of whole texts; equal ones are one point, represented by its smallest doc_id.
    2. An upper vantage-point tree, fitted on SAMPLE points or so, chosen by hash, deals every point to shards by its distances;
       points within `radius` inside a ball's edge also go outside it, so each pair meets in a shard.
    3. Each shard walks its own tree and returns a forest that spans its links: at most a row a point, however large
       a group of near copies is.
    4. Components of the forests, over all shards, by alternating stars.

    A null or empty text, or one without words, has fingerprint zero and links like any other. Rows that share a
    doc_id are one document to the links. A row without doc_id has a fingerprint and takes the component of its equals; where
    they have no doc_id either, the component is null. An empty table gives an empty result.
    """
    return _linked(cut(fingerprint(docs, k)), radius)


def _linked(prints: DataFrame, radius: int) -> DataFrame:
    """Steps 2 to 4 of near_duplicates, over doc_id and fp."""
    points = cut(prints.groupBy("fp").agg(F.min("doc_id").cast("long").alias("rep")))
    roots = components(_forest(points.filter("rep is not null"), radius))
    known = points.join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select("fp", F.coalesce("root", "rep").alias("component_id"))
    return prints.join(known, "fp").select("doc_id", "fp", "component_id")


def _forest(linked: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) that span the links among distinct fingerprints (fp, rep), at most one for each point of a shard."""
    spark = linked.sparkSession
    total = linked.count()
    share = 1.0 if total <= SAMPLE else SAMPLE / total
    least = np.iinfo(np.int64).min
    taken = linked if share == 1.0 else linked.filter(F.xxhash64("fp") < F.lit(int(least + share * 2.0**64)))
    fitted = np.sort(np.array([r.fp for r in taken.select("fp").collect()], np.int64)).view(np.uint64)
    nodes = fit(fitted, total, radius)
    tree = spark.sparkContext.broadcast(nodes)  # about SAMPLE / 32 nodes at most
    dealt = T.StructType([T.StructField("leaf", T.IntegerType()), T.StructField("fp", T.LongType()), T.StructField("rep", T.LongType())])

    def deal(batches):
        for b in batches:
            if b.num_rows:
                at, leaf = route(b.column("fp").to_numpy().view(np.uint64), tree.value, radius)
                yield pa.RecordBatch.from_arrays([pa.array(leaf), *(b.column(c).take(pa.array(at)) for c in ("fp", "rep"))], names=dealt.names)

    forest = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def join(batch: pa.Table) -> pa.Table:
        fp, rep = batch.column("fp").to_numpy().view(np.uint64), batch.column("rep").to_numpy()
        root = link(fp, radius)
        own = root != np.arange(len(fp))
        return pa.table({"a": pa.array(rep[own]), "b": pa.array(rep[root[own]])})

    shards = linked.select("fp", "rep").mapInArrow(deal, dealt).repartition(max(shuffle_partitions(spark), min(4096, len(nodes) + 1)), "leaf")
    return cut(shards.groupBy("leaf").applyInArrow(join, forest))


# --- near copies by similarity ---------------------------------------------------------------------------------------

#: Near copies share 4 of 5 of all their distinct shingles of WORDS words. Comparisons are of whole numbers: 5 both >= 4 all.
WORDS = 5
#: About so many documents tell which shingles are frequent; those, COMMON at most, come last in the order of shingles.
SURVEYED, COMMON = 8000, 10_000
#: Sets of an open shingle that one task compares with as many others.
BLOCK = 4096
#: Shingles of the texts that one task compares with as many others, as far as no text has more.
WEIGHT = 1 << 20
#: Bits of a set's parity bitmap at least, a power of two; larger sets have as many as shingles, or up to twice. They fold onto fewer.
BITS = 1024


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of shingles have a Jaccard similarity of 0.8 or more; two empty sets have."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def prefix(shingles: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles of a set (sorted) of which alike sets share one: n - ceil(0.8 n) + 1, common ones last.

    Alike sets share 0.8 of each set's shingles at least, and so the least shared one, in any order, is among them.
    """
    n = len(shingles)
    if not n:
        return shingles
    at = np.searchsorted(common, shingles)
    at[at == len(common)] = 0
    late = np.where(common[at] == shingles, rank[at], 0) if len(common) else np.zeros(n, np.int64)
    return shingles[np.lexsort((shingles, late))[: n - (4 * n + 4) // 5 + 1]]


def _frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many of some documents hold, sorted, and their counts. They set an order, so what is missed costs time only."""
    every = max(1, docs.count() // SURVEYED)

    def run(batches):
        for b in batches:
            found = [np.unique(shingles_of(x.as_py(), WORDS)) for x in b.column("text")]
            for i in range(0, len(found), 64):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found[i : i + 64]).view(np.int64))], names=["s"])

    some = docs.select("text").filter(F.pmod(F.xxhash64(F.reverse("text")), F.lit(every)) == 0)
    counts = some.mapInArrow(run, "s long").groupBy("s").agg(F.count(F.lit(1)).alias("n")).filter("n >= 8")
    rows = sorted((np.uint64(r.s & (1 << 64) - 1), r.n) for r in counts.orderBy(F.desc("n"), "s").limit(COMMON).collect())
    return np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.int64)


def _possible(n, m, a, b):
    """Whether sets of n and m shingles with parity bitmaps a and b may be alike: every shingle that only one has flips at most one bit."""
    return (5 * np.minimum(n, m) >= 4 * np.maximum(n, m)) & (9 * np.bitwise_count(a ^ b).sum(-1, dtype=np.int64) <= n + m)


def _bitmap(own: np.ndarray) -> bytes:
    size = max(BITS, 1 << len(own).bit_length())
    return np.packbits(np.bincount((own & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).tobytes()


def _folded(bits: bytes, size: int = BITS // 8) -> np.ndarray:
    return np.bitwise_xor.reduce(np.frombuffer(bits, np.uint64).reshape(-1, size // 8), axis=0)


def _bitmaps(column) -> np.ndarray:
    return np.array([_folded(x) for x in column.to_pylist()], np.uint64).reshape(-1, BITS // 64)


_PAIR = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _verified(pairs: DataFrame, sets: DataFrame, texts: DataFrame, scratch: list[str]) -> DataFrame:
    """Those pairs of nodes (a, b) whose texts are alike, as an edge table."""
    ends = lambda df, c, x: df.select(F.col("node").alias(c), *[F.col(n).alias(n + x) for n in df.columns if n != "node"])
    pairs = pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    measured = pairs.join(ends(sets, "a", "_a"), "a").join(ends(sets, "b", "_b"), "b")

    def sift(batches):
        for b in batches:
            n, m = (b.column(c).to_numpy() for c in ("n_a", "n_b"))
            own = _possible(n, m, _bitmaps(b.column("bits_a")), _bitmaps(b.column("bits_b")))
            for i in np.flatnonzero(own & (np.minimum(n, m) > BITS)):
                x, y = b.column("bits_a")[i].as_py(), b.column("bits_b")[i].as_py()
                own[i] = _possible(n[i], m[i], *(_folded(z, min(len(x), len(y))) for z in (x, y)))
            yield b.select(["a", "b"]).filter(pa.array(own))

    left = stored(measured.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(sift, _PAIR), scratch)
    nodes = stored(left.select(F.col("a").alias("node")).union(left.select("b")).distinct(), scratch)
    bodies = stored(texts.select("node", "text").join(nodes, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text")), scratch)

    def judge(batches):
        for b in batches:
            one = [np.unique(shingles_of(x.as_py(), WORDS)) for x in b.column("text_a")]
            two = (np.unique(shingles_of(x.as_py(), WORDS)) for x in b.column("text_b"))
            yield b.select(["a", "b"]).filter(pa.array([alike(x, y) for x, y in zip(one, two, strict=True)], pa.bool_()))

    return cut(left.join(ends(bodies, "a", "_a"), "a").join(ends(bodies, "b", "_b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(judge, _PAIR))


_LISTED = T.StructType([T.StructField(c, T.LongType()) for c in ("key", "s", "node", "n", "star", "star_n")])


def _starred(s: np.ndarray, node: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct (s, node) in order, with n and the position of the least node under the same s."""
    order = np.lexsort((node, s))
    s, node, n = s[order], node[order], n[order]
    own = np.concatenate([[True], (s[1:] != s[:-1]) | (node[1:] != node[:-1])]) if len(s) else np.zeros(0, bool)
    s, node, n = s[own], node[own], n[own]
    first = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
    return s, node, n, np.flatnonzero(first)[np.cumsum(first) - 1]


def _shared(rows: DataFrame, scratch: list[str]) -> DataFrame:
    """s, node, n, star, star_n: the nodes under each prefix shingle that several hold, each beside one of the others under it.

    A batch of documents lists one node a shingle, with which its others there pair, so a shingle that a third of all rows
    holds makes few rows to one key; the others are dealt by themselves. What is listed once is dropped where it is sorted.
    """

    def listed(batches):
        for b in batches:
            own = b.column("prefix").is_valid()
            b = b.filter(own)
            lens = b.column("prefix").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            s = b.column("prefix").flatten().to_numpy()
            s, node, n, at = _starred(s, *(np.repeat(b.column(c).to_numpy(), lens) for c in ("node", "n")))
            own = at == np.arange(len(s))
            alone = own & (np.bincount(at, minlength=len(s))[: len(s)] == 1)
            key = np.where(own, s, node)
            star = np.where(alone, 0, 1)  # of the listed: whether the batch has others under s
            columns = (key, s, node, n, np.where(own, star, node[at]), np.where(own, -1, n[at]))
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=_LISTED.names)

    def settle(batches):
        last = None  # the shingle at the end of the batch before: its least node and size
        held = None  # its only row so far, not yet given
        for b in batches:
            s, node, n, star, star_n = (b.column(c).to_numpy() for c in _LISTED.names[1:])
            out = []
            other = star_n >= 0
            if other.any():
                out.append([c[other] for c in (s, node, n, star, star_n)])
            s, node, n, local = (c[~other] for c in (s, node, n, star))
            if len(s):
                first = np.concatenate([[True], s[1:] != s[:-1]])
                group = np.cumsum(first) - 1
                at = np.flatnonzero(first)
                size = np.bincount(group)
                rep, rep_n = node[at].copy(), n[at].copy()
                many = (size > 1) | (np.bincount(group, local) > 0)
                joined = last is not None and s[0] == last[0]
                if joined:
                    rep[0], rep_n[0], many[0] = last[1], last[2], True
                if held is not None and joined:
                    out.append([np.array([x]) for x in held])
                held = None
                give = many[group]
                if not many[-1] and size[-1] == 1:
                    held = (s[-1], node[-1], n[-1], node[-1], n[-1])
                out.append([c[give] for c in (s, node, n, rep[group], rep_n[group])])
                last = (s[-1], rep[-1], rep_n[-1])
            for x in out:
                if len(x[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in x], names=_LISTED.names[1:])

    each = rows.filter("prefix is not null").select("node", "n", "prefix").mapInArrow(listed, _LISTED)
    each = each.repartition(shuffle_partitions(rows.sparkSession), "key").sortWithinPartitions("key", "s", "node")
    return stored(each.mapInArrow(settle, T.StructType(_LISTED.fields[1:])), scratch)


def _spanning(root: np.ndarray, n: np.ndarray, possible, judged) -> np.ndarray:
    """Pairs of positions that span, with equal roots, all links among sets in order of size n: fewer than there are sets.

    possible(k, at) tells which of the positions `at` may link to k, judged(k, m) whether k and m do.
    """
    label, out = np.unique(root, return_inverse=True)[1], []
    for k in range(len(n) - 1):
        upto = np.searchsorted(n, 5 * n[k] // 4, "right")  # sizes rise: those beyond 1.25 n are no candidates
        at = k + 1 + np.flatnonzero(label[k + 1 : upto] != label[k])
        for m in at[possible(k, at)] if len(at) else ():
            if label[m] != label[k] and judged(k, m):
                out.append((k, m))
                label[label == label[m]] = label[k]
    return np.array(out, np.int64).reshape(-1, 2)


def _dealt(rows: DataFrame) -> DataFrame:
    """rows (node, blocks, ...) with own, i and j: each row in every pair (i, j) of blocks that its own is one of."""
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = rows.select(*[c for c in rows.columns if c != "blocks"], own.alias("own"), other)
    return rows.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other")


def _met(batch: pa.Table):
    """Of a pair of blocks in order of n: root, n, possible(k, at) by sizes, folded bitmaps and blocks, and whole(k, m) by bitmaps of large sets."""
    root, n, part = (batch.column(c).to_numpy() for c in ("root", "n", "own"))
    alone = batch.column("i")[0].as_py() == batch.column("j")[0].as_py()
    each = batch.column("bits").to_pylist()
    bits = np.array([_folded(x) for x in each], np.uint64).reshape(-1, BITS // 64)

    def possible(k: int, at: np.ndarray) -> np.ndarray:
        return (alone | (part[at] != part[k])) & _possible(n[k], n[at], bits[k], bits[at])

    def whole(k: int, m: int) -> bool:
        return n[k] <= BITS or bool(_possible(n[k], n[m], *(_folded(x, min(len(each[k]), len(each[m]))) for x in (each[k], each[m]))))

    return root, n, possible, whole


def _across(shared: DataFrame, found: DataFrame, sets: DataFrame, texts: DataFrame, scratch: list[str]) -> DataFrame:
    """Edges (a, b) between alike nodes of different components (found: node, root) that span, with those, all links that are left.

    What sizes and bitmaps allow under a shingle is not listed in pairs: each block returns a forest over its components, and the components
    of all forests, few more than the true ones, hold every link that is left. In these the texts are compared, each again giving a forest.
    """
    placed = shared.select("s", "node").join(found, "node", "left").select("s", "node", F.coalesce("root", "node").alias("root")).distinct()
    nodes = F.bit_xor(F.xxhash64("node")).alias("nodes")
    open_ = placed.groupBy("s").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count(F.lit(1)).alias("held"), nodes).filter("held > 2 and x < y")
    open_ = open_.groupBy("held", "nodes").agg(F.min("s").alias("s"))  # copies share many shingles; one stands for all with the same nodes
    open_ = stored(open_.select("s", F.expr(f"cast(ceil(held / {BLOCK}) as int)").alias("blocks")), scratch)
    rows = _dealt(placed.join(open_, "s").join(sets, "node"))

    def meet(batch: pa.Table) -> pa.Table:
        at = _spanning(*(met := _met(batch.sort_by("n"))))
        root = met[0]
        return pa.table({"a": pa.array(root[at[:, 0]]), "b": pa.array(root[at[:, 1]])})

    near = components(rows.groupBy("s", "i", "j").applyInArrow(meet, _PAIR)).select(F.col("node").alias("root"), F.col("root").alias("near"))
    members = sets.join(found, "node", "left").withColumn("root", F.coalesce("root", "node")).join(near, "root")
    members = stored(members.select("node", "root", "near", "n", "bits"), scratch)
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / WEIGHT, F.lit(1))).cast("int").alias("blocks")
    bodies = texts.select("node", "text").join(members.select("node"), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    rows = _dealt(members.join(members.groupBy("near").agg(blocks), "near").join(bodies, "node"))

    def judge(batch: pa.Table) -> pa.Table:
        batch = batch.sort_by("n")
        node, (root, n, possible, whole) = batch.column("node").to_numpy(), _met(batch)
        own = [np.unique(shingles_of(x.as_py(), WORDS)) for x in batch.column("text")]
        at = _spanning(root, n, possible, lambda k, m: whole(k, m) and alike(own[k], own[m]))
        return pa.table({"a": pa.array(node[at[:, 0]]), "b": pa.array(node[at[:, 1]])})

    return stored(rows.groupBy("near", "i", "j").applyInArrow(judge, _PAIR), scratch)


def near_copies(docs: DataFrame) -> DataFrame:
    """docs with row (a number of its own) and group (long): rows of one group are linked by texts whose Jaccard similarity over word
    shingles (WORDS) is 0.8 or more.

    1. Texts with the same set of shingles are one node. Fingerprints of all, over the same shingles, are linked through vantage-point
       trees at RADIUS bits; what they link are candidates.
    2. No radius that parts a tree reaches down to 0.8 (such pairs differ in 10 bits on average), so every node is also listed under the
       shingles of its prefix: alike sets share one. First the nodes under a shingle are candidates with one of them, so large
       groups of copies become one component in as many pairs as nodes (and up to two nodes are done); then with all
       nodes under it in other components, in blocks of BLOCK, of which each returns a forest.
    3. Candidates that sizes and parity bitmaps allow are compared on their whole texts; only alike ones link. Pairs are listed
       at most once a node and shingle, however large a group of near copies is.

    No pair of alike texts is missed, up to equal 64-bit digests. Columns called row, node, fp, n, bits, prefix or group must not be in docs.
    """
    spark, scratch = docs.sparkSession, []
    common = spark.sparkContext.broadcast(_frequent(docs))
    extra = [T.StructField(c, t) for c, t in (("node", T.LongType()), ("fp", T.LongType()), ("n", T.LongType()), ("bits", T.BinaryType()), ("prefix", T.ArrayType(T.LongType())))]
    schema = T.StructType([*docs.schema.fields, *extra])

    def run(batches):
        for b in batches:
            nodes, fps, sizes, bits, firsts, seen = [], [], [], [], [], set()
            for x in b.column("text"):
                every = shingles_of(x.as_py(), WORDS)
                own = np.unique(every)
                nodes.append(xxhash.xxh64_intdigest(own.tobytes(), SEED) - (1 << 63))
                fps.append(_simhash(every))
                sizes.append(len(own))
                bits.append(None if nodes[-1] in seen else _bitmap(own))  # once a batch: thousands may have the same text
                firsts.append(None if nodes[-1] in seen else prefix(own, *common.value).view(np.int64))
                seen.add(nodes[-1])
            more = [pa.array(nodes, pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(bits, pa.binary()), pa.array(firsts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=schema.names)

    rows = stored(docs.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()))
    sets = stored(rows.filter("bits is not null").groupBy("node").agg(F.first("n").alias("n"), F.first("bits").alias("bits")), scratch)
    shared = _shared(rows, scratch)
    points = rows.groupBy("fp").agg(F.min("node").alias("rep"))
    forest = _forest(cut(points), RADIUS)
    equals = rows.select("fp", "node").distinct().join(points, "fp").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    stars = shared.filter("5 * least(n, star_n) >= 4 * greatest(n, star_n)").select(F.col("node").alias("a"), F.col("star").alias("b"))
    links = _verified(forest.union(equals).union(stars), sets, rows, scratch)
    found = stored(components(links))
    rest = _across(shared, found, sets, rows, scratch)
    if rest.limit(1).count():
        found = stored(components(links.union(rest)))
    dropped(spark, scratch)
    return rows.drop("fp", "n", "bits", "prefix").join(found, "node", "left").select(*docs.columns, "row", F.coalesce("root", "node").alias("group"))


def op6_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op6_simhash_vptree": op6_simhash_vptree}
ORACLE_SQL: dict[str, str] = {}
