"""Each operator against a brute-force version, with nulls, empty and long texts, ties, copies, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylight.llm import chat, components, decontaminate, langid, packing, quality, sharding, simhash, suffixes, tokens, topk, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, spans int, raw string, rank int"


def frame(spark, rows):
    """Documents with extra columns that bear names the operators use inside."""
    return spark.createDataFrame([(i, t, lang, src, None if t is None else len(t), "x", 1, "y", 2) for i, t, lang, src in rows], DOCS)


def words(rnd, n, alphabet="abcdefg"):
    return " ".join("".join(rnd.choice(alphabet) for _ in range(rnd.randrange(1, 5))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(5)
    base = words(rnd, 60)
    rows = [(i, words(rnd, rnd.randrange(0, 200)), rnd.choice(["en", "de", None]), rnd.choice(["a", "a", "a", "b", None])) for i in range(80)]
    rows += [(100 + i, base, "en", "hot") for i in range(40)] + [(200 + i, base + f" tail{i}", "en", "hot") for i in range(6)]
    rows += [(300, None, None, None), (301, "", "en", "a"), (302, " \n\t ", "en", "a"), (303, "9 9 9", "de", "b"), (None, base, "en", "a"), (None, None, None, None), (5, base, "en", "a"), (5, base, "en", "a")]
    rows += [(400, words(rnd, 60_000), "en", "a")]
    return rows


# --- 1 ---------------------------------------------------------------------------------------------------------------


def brute_top(rows, chosen, k):
    good = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = {}
    for q, a in good:
        if chosen(q):
            s = [(-max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b, strict=False)))), c) for c, b in good if c != q]
            out[q] = [(c, -n) for n, c in sorted(out.get(q, []) + sorted(s))[:k]] if False else [(c, -n) for n, c in sorted(s)[:k]]
    return out


@pytest.mark.parametrize("rows_per_block", [7, 4096])
def test_top_k(spark, monkeypatch, rows_per_block):
    for name in ("QUERY_ROWS", "BUCKET_ROWS"):
        monkeypatch.setattr(topk, name, rows_per_block)
    monkeypatch.setattr(topk, "SEEDS", 12)
    rnd = np.random.default_rng(3)
    rows = [(i, (rnd.normal(size=8) * rnd.choice([0.1, 1, 5])).astype(np.float32).tolist()) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(40)] + [(300, [0.0] * 8), (301, None), (302, [1.0, None]), (303, [float("nan")] * 8), (304, [float("inf")] * 8), (None, [1.0] * 8), (305, [1.0]), (306, [])]
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id long, embedding array<float>, len string")
    got = defaultdict(list)
    for r in topk.top_k(df, F.pmod("vec_id", F.lit(5)) == 0, 10).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    want = brute_top(rows, lambda q: q % 5 == 0, 10)
    assert {q: [(c, s) for _, c, s in sorted(v)] for q, v in got.items()} == want
    assert all([k for k, _, _ in sorted(v)] == list(range(1, len(v) + 1)) for v in got.values())


def test_top_k_of_huge_components_and_of_nothing(spark):
    rows = [(0, [3e7, 1.0]), (10, [3e7, -1.0]), (11, [2e30, 0.0]), (12, [-2e30, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r.vec_id, r.score) for r in topk.top_k(df, F.pmod("vec_id", F.lit(10)) == 0).orderBy("query_id", "rank").collect()]
    want = brute_top(rows, lambda q: q % 10 == 0, 10)
    assert got == [(q, c, s) for q in sorted(want) for c, s in want[q]]
    assert topk.top_k(df.limit(0), F.lit(True)).collect() == []
    assert topk.top_k(df.limit(1), F.lit(True)).collect() == []


# --- 2 ---------------------------------------------------------------------------------------------------------------


def test_packing_round_trip(spark, corpus):
    encode = tokens.encoder(tokens.default_path())
    got = packing.pack_documents(frame(spark, corpus)).collect()
    bins = defaultdict(dict)
    pieces = defaultdict(list)
    for r in got:
        assert len(r.ids) == r.length <= 1024
        bins[r.sequence_id][r.offset] = r.length
        pieces[r.doc_id].append((r.piece, r.start, r.ids))
    for b in bins.values():
        at = 0
        for offset in sorted(b):
            assert offset == at
            at += b[offset]
        assert at <= 1024
    want = Counter((i, tuple([*encode(t or ""), 2])) for i, t, _, _ in corpus)
    single = Counter({k: n for k, n in want.items() if k[0] not in (None, 5)})
    for (i, ids), n in single.items():
        assert n == 1 and tuple(x for _, _, p in sorted(pieces[i]) for x in p) == ids
        assert all(len(p) == 1024 for k, _, p in sorted(pieces[i])[1:])
    assert sum(r.length for r in got) == sum(len(k[1]) * n for k, n in want.items())
    crc = packing.tokenize(frame(spark, corpus[:3]), payload="crc32").collect()
    assert {r.ids_crc32 for r in crc} == {zlib.crc32(np.array([*encode(t or ""), 2], "<u4").tobytes()) for _, t, _, _ in corpus[:3]}
    assert packing.pack_documents(frame(spark, corpus).limit(0)).collect() == []


def test_packing_keeps_little_on_disk(spark, tmp_path):
    rnd = random.Random(7)
    df = spark.createDataFrame([(i, words(rnd, 700)) for i in range(400)], "doc_id long, text string").repartition(4)
    before = spark.sparkContext.getCheckpointDir()
    spark.sparkContext.setCheckpointDir(f"file://{tmp_path}")
    ids = sum(r.length for r in packing.pack_documents(df).select("length").collect())
    spent = sum(p.stat().st_size for p in tmp_path.rglob("*") if p.is_file())
    if before:
        spark.sparkContext.setCheckpointDir(before)
    assert ids > 400_000 and 0 < spent < 2.5 * ids  # an id is 4 bytes in a checkpoint, and two were kept


def test_plan_is_whole_and_tight():
    rnd = random.Random(2)
    for _ in range(60):
        counts = Counter(rnd.choice([rnd.randrange(1, 1025), 342, 341, 1]) for _ in range(rnd.randrange(1, 400)))
        places, bins = packing.plan(dict(counts))
        used, load, large = Counter(), Counter(), Counter()
        for n, rank, many, b, offset, per in places:
            assert rank == used[n]
            used[n] += many
            for k in range(many):
                load[b + k // per] += n
                large[b + k // per] += 3 * n > 1024
        assert used == counts and max(load.values()) <= 1024 and max(large.values()) <= 2 and len(load) == bins
        assert bins <= 1.25 * -(-sum(n * c for n, c in counts.items()) // 1024) + sum(c for n, c in counts.items() if 3 * n > 1024)


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    slow, fast = Tokenizer.from_file(tokens.default_path()), tokens.encoder(tokens.default_path())
    for text in ["", "a", "It's  <|endoftext|> so\n\n\tö 中文 123", "x" * 5000, " " * 3000 + "y"]:
        assert fast(text) == slow.encode(text, add_special_tokens=False).ids


# --- 3 ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("tokenizer", [False, True])
def test_chat(spark, tokenizer):
    rnd = random.Random(4)
    said = [r"\### Assistant: </turn> ok", "<turn user>\n", "\\l", "", "long " * 3000, "ü</turn>", "a\\"]
    rows = []
    for c in range(60):
        for t in range(rnd.randrange(1, 6)):
            rows.append((c, t, ["user", "assistant", "system"][t % 3], said[0] if t == 0 and c % 2 else rnd.choice(said)))
    rows += [(c, t, r, x) for c in range(100, 130) for t, r, x in ((0, "user", said[0]), (1, "assistant", "same"))]
    rows += [(200, 0, None, None), (200, 0, None, None), (200, None, "assistant", "first"), (None, 1, "user", "x"), (201, 0, "assistant", None)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, leaf string")
    nodes, paths, leaves = chat.prefix_trees(df, tokens.default_path() if tokenizer else None)
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    want = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in by.items()}
    found = nodes.collect()
    prefixes = {tuple(v[: k + 1]) for v in want.values() for k in range(len(v))}
    assert len(found) == len(prefixes)  # shared turns once
    at = 0
    for n in sorted(found, key=lambda n: n.start):  # gapless
        assert n.start == at
        at += n.length
        assert n.position == sum(a["end"] - a["start"] for a in n.attends) and all(a["end"] <= n.start for a in n.attends)
    segment, start = {n.start: n for n in found}, {bytes(r.leaf): r.starts for r in paths.collect()}
    for r in leaves.collect():
        steps = [segment[s] for s in start[bytes(r.leaf)]]
        assert [chat.parse(n.segment) for n in steps] == want[r.conv_id]
        for n, depth in zip(steps, range(len(steps)), strict=True):
            assert n.depth == depth and n.position == sum(m.length for m in steps[:depth])
    if not tokenizer:
        back = {r.conv_id: r for r in leaves.join(chat.read_back(nodes, paths), "leaf").collect()}
        for c, v in want.items():
            loss = "".join(x for r, x in v if r == "assistant")
            every = hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in v).encode()).hexdigest()
            assert (back[c].n_turns, back[c].turns_sha256, back[c].loss_chars, back[c].loss_sha256) == (len(v), every, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.prefix_trees(df.limit(0))[0].collect() == []


# --- 4 ---------------------------------------------------------------------------------------------------------------


def test_gradients():
    net = langid.Network(["a", "b", "c"], 4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    runs, y = [b"abc ", b"de", b"fghij "], np.array([0, 1, 2])
    _, g = net.gradients(runs, y)
    for k, p in net.p.items():
        flat, at = p.reshape(-1), int(np.abs(g[k]).argmax())
        old, both = flat[at], []
        for step in (1e-3, -1e-3):
            flat[at] = old + step
            both.append(net.gradients(runs, y)[0])
        flat[at] = old
        assert abs((both[0] - both[1]) / 2e-3 - g[k].reshape(-1)[at]) < 1e-4


def test_language(spark, monkeypatch):
    monkeypatch.setattr(langid, "STEPS", 150)
    rnd = random.Random(6)
    speak = {"en": "thand ofer ingly".split(), "de": "schön über keiten".split()}
    rows = [(i, " ".join(rnd.choice(speak[k]) for _ in range(40)), k, "s") for i in range(120) for k in [("en", "de")[i % 2]]]
    odd = [(900, None, "en", "s"), (901, "", "en", "s"), (902, "12 .. 3", "en", "s"), (903, rows[0][1] + " thand" * 40_000, None, "s"), (None, rows[1][1], "de", "s"), (0, rows[0][1], "en", "s")]
    df = frame(spark, rows + odd)
    got = langid.identify(df, F.col("doc_id") % 5 != 0).collect()
    pred = {r.doc_id: r for r in got}
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in got)
    assert [pred[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and pred[903].lang_pred == "en"
    assert np.mean([pred[i].lang_pred == k for i, _, k, _ in rows if i % 5 == 0]) == 1.0
    assert {r.lang_pred for r in langid.identify(df, F.lit(False)).collect()} == {"und"}
    assert langid.identify(df.limit(0), F.lit(True)).collect() == []


def test_whole_text_is_read(monkeypatch):
    monkeypatch.setattr(langid, "STRETCH", 70)
    monkeypatch.setattr(langid, "OVERLAP", 20)
    raw = random.Random(2).randbytes(400)
    assert b"".join(langid.runs_of("Ab  cdefghijk é\n" * 30)) == ("ab  cdefghijk é\n" * 30).encode()
    assert b"".join(own[a:z] for own, a, z in langid.stretches(raw)) == raw and langid.stretches(b"") == []
    assert all(own in raw and a in (0, 20) and len(own) - z in range(21) for own, a, z in langid.stretches(raw))


def test_states_are_carried_over_words_and_lanes():
    net = langid.Network(["a", "b", "c"], 4)
    rnd = random.Random(3)
    runs = [rnd.randbytes(n) for n in (40, 3, 90, 41, 1)]
    got = net.log_probs([(r, 0, len(r)) for r in runs])
    for r, own in zip(runs, got, strict=True):  # the layers that training goes through say the same
        x, mask = langid._padded([r])
        both = np.concatenate([net._layer(x, mask, d)[0] for d in "fb"], axis=2)
        z = both[0] @ net.p["V"] + net.p["o"]
        assert np.allclose((z - np.log(np.exp(z).sum(1, keepdims=True))).sum(0), own, atol=1e-3)
    text = b"far away   " + b"x" * 30
    one, other = (net.log_probs([(t, 40, 41)])[0] for t in (text, b"q" + text[1:]))
    assert np.abs(one - other).max() > 0  # the last byte's label depends on the first, forty bytes before


# --- 5 ---------------------------------------------------------------------------------------------------------------


def split_words(text):
    import re

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_hits(text, items):
    w, hit, ids = split_words(text), set(), set()
    for i, t in items:
        iw = split_words(t)
        for win in {tuple(iw[k : k + 10]) for k in range(max(1, len(iw) - 9))} if iw else ():
            for at in range(len(w) - len(win) + 1):
                if tuple(w[at : at + len(win)]) == win:
                    hit |= set(range(at, at + len(win)))
                    ids.add(i)
    ids = sorted(str(i) for i in ids if i is not None)
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block", [1 << 23, 1500])
def test_decontamination(spark, corpus, block, monkeypatch):
    monkeypatch.setattr(decontaminate.hits, "__defaults__", (10, block))
    rnd = random.Random(8)
    long = words(rnd, 30)
    items = [(1, long), (2, long), (3, "a b"), (4, None), (5, "?!"), (6, ""), (None, words(rnd, 12)), (7, "ÉA " * 15), (10, words(rnd, 25))]
    docs = [r for r in corpus if r[0] != 400] + [(500 + k, words(rnd, 20) + " " + " ".join(long.split()[k : k + 9 + k]).upper() + " a. b " + words(rnd, 9), "en", "a") for k in range(8)]
    docs += [(600, "Éa " * 40, "fr", "a"), (601, (long + " ") * 30, "en", "a"), (602, items[6][1], "en", "a")]
    got = decontaminate.decontaminate(frame(spark, docs), spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, word string")).collect()
    have = Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got)
    assert have == Counter((i, *brute_hits(t, items)) for i, t, _, _ in docs)
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in decontaminate.decontaminate(frame(spark, docs), none).collect())
    assert decontaminate.decontaminate(frame(spark, docs).limit(0), none).collect() == []


# --- 6 ---------------------------------------------------------------------------------------------------------------


def brute_components(ids, fps, radius=2):
    group = list(range(len(ids)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            same = ids[a] is not None and ids[a] == ids[b]
            if (int(fps[a]) ^ int(fps[b])).bit_count() <= radius and (fps[a] == fps[b] or None not in (ids[a], ids[b])) or same:
                group[root(a)] = root(b)
    least = {}
    for a, i in enumerate(ids):
        if i is not None:
            least[root(a)] = min(i, least.get(root(a), i))
    return [least.get(root(a)) for a in range(len(ids))]


def test_fingerprint():
    import xxhash

    text = "The quick\tBrown fox ÄB  jumps\x0b over\x85x"
    w = text.encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(len(w) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert list(simhash.fingerprints_of([text, None, "", "one two"])) == [want, 0, 0, xxhash.xxh64_intdigest(b"one two", 42)]


def test_near_duplicates(spark, corpus):
    df = frame(spark, corpus)
    got = simhash.near_duplicates(df).collect()
    fps = simhash.fingerprints_of([t for _, t, _, _ in corpus]).view(np.int64)
    known = [i for i, (d, *_) in enumerate(corpus) if d is not None]
    want = Counter(zip((corpus[i][0] for i in known), fps[known].tolist(), brute_components([corpus[i][0] for i in known], fps[known].view(np.uint64)), strict=True))
    assert Counter((r.doc_id, r.fp, r.component_id) for r in got if r.doc_id is not None) == want
    assert {(r.fp, r.component_id) for r in got if r.doc_id is None} <= {(f, c) for _, f, c in want}
    assert simhash.near_duplicates(df.limit(0)).collect() == []


def test_vantage_trees_lose_no_pair(monkeypatch):
    monkeypatch.setattr(simhash, "SMALL", 16)
    rng = np.random.default_rng(1)
    centers = rng.integers(0, 2**63, 150, dtype=np.uint64)
    near = centers[rng.integers(0, 150, 900)] ^ (np.uint64(1) << rng.integers(0, 64, 900, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 900, dtype=np.uint64))
    points = np.unique(np.concatenate([centers, near]))
    want = brute_components(list(range(len(points))), points)
    root = simhash.link(points)
    least = {r: min(np.flatnonzero(root == r)) for r in set(root.tolist())}
    assert [least[r] for r in root.tolist()] == want
    nodes = simhash.fit(points, len(points), leaf=100)
    at, leaf = simhash.route(points, nodes)
    assert len(nodes) > 3 and set(at.tolist()) == set(range(len(points)))
    homes = defaultdict(set)
    for a, x in zip(at.tolist(), leaf.tolist(), strict=True):
        homes[a].add(x)
    d = np.bitwise_count(points[:, None] ^ points[None, :])
    assert all(homes[a] & homes[b] for a, b in zip(*np.nonzero(d <= 2), strict=True))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3), (200, 201)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200}


# --- 7 ---------------------------------------------------------------------------------------------------------------


def brute_removed(texts, length=400):
    seen = Counter(hash(t[i : i + length]) for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[hash(t[i : i + length])] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(gone[i] and (i == 0 or not gone[i - 1]) for i in range(len(t)))
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def test_sorting():
    rnd = random.Random(1)
    for _ in range(150):
        base = bytes(rnd.randrange(3) for _ in range(60))
        strings = [base[: rnd.randrange(61)] + bytes(rnd.randrange(3) for _ in range(rnd.randrange(20))) for _ in range(rnd.randrange(1, 30))]
        order = suffixes.deep_shallow(strings, 0, rnd.choice([0, 2, 16]))
        assert [strings[i] for i in order] == sorted(strings)
        agree = suffixes._agreement(strings)
        assert all(agree[i, j] == suffixes.common(strings[i], strings[j]) for i in range(len(strings)) for j in range(len(strings)) if i != j)


@pytest.mark.parametrize("group", [4, 512])
def test_repeats(spark, monkeypatch, group):
    monkeypatch.setattr(suffixes, "GROUP", group)
    rnd = random.Random(3)
    w = lambda n: "".join(rnd.choice("abcdéfgh ") for _ in range(n))
    p, q, z = w(700), w(360), w(1500)
    texts = [w(rnd.randrange(300)) + p + w(rnd.randrange(300)) for _ in range(20)] + [w(200) + q + w(200) for _ in range(12)]
    texts += ["ab" * 600, "ab" * 500 + "x", None, "", "x" * 399, "y" * 400, "z" * 401] + [z] * 5 + [z[:k] + "!" + z[k + 1 :] for k in range(50, 1450, 100)]
    texts += [w(50) + p[:410] + w(30) + p[250:] for _ in range(5)] + [w(90_000) + p]
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in enumerate(texts)], "doc_id long, text string, kept string, gone int")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in suffixes.remove_repeats(df).collect()}
    for i, want in enumerate(brute_removed([(t or "").encode() for t in texts])):
        assert got[i][:4] == want and hashlib.sha256(got[i][4]).hexdigest() == want[3]
    assert suffixes.remove_repeats(df.limit(0)).collect() == []


def test_repeated_passages_are_counted_beside_the_digest(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "GATHERED", 4000)
    rnd = random.Random(7)
    long = lambda n: " ".join("".join(rnd.choice("abcdefghijk") for _ in range(rnd.randrange(1, 8))) for _ in range(n))
    passages = [long(n) for n in (50, 51, 55, 60, 75, 200)]
    texts = [f"{long(rnd.randrange(40))}\n{p}  {long(rnd.randrange(40))}" for p in passages for _ in range(rnd.randrange(2, 5))]
    near = long(150).split()
    texts += [" ".join([*near[:i], f"x{i}", *near[i + 1 :]]) for i in range(20, 130, 10)] + [long(120) for _ in range(20)]
    texts += [texts[-1], "one two", None, "", " \n", ("tick tock\n" * 60), "\u4e2d\u6587" * 40 + "\u65e5", "abc " + "\u4e2d\u6587" * 30, long(6000) + " " + passages[2]]
    rnd.shuffle(texts)
    split = [re.findall(r"[\u3000-\u9fff]|[^\s\u3000-\u9fff]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + 51]) for w in split for i in range(len(w) - 50))
    want = [len({j for i in range(len(w) - 50) if seen[tuple(w[i : i + 51])] > 1 for j in range(i, i + 51)}) for w in split]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = suffixes.remove_repeats(df, kept=None, words=51, remove_words=False).collect()
    assert {r.doc_id: r.n_repeated_words for r in rows} == dict(enumerate(want)) and sum(w > 0 for w in want) > 20
    for i, digest in enumerate(brute_removed([(t or "").encode() for t in texts])):
        assert next((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows if r.doc_id == i) == digest
    for t in texts:
        starts, ends = suffixes.word_spans((t or "").encode())
        assert [(t or "").encode()[a:z].decode() for a, z in zip(starts, ends, strict=True)] == re.findall(r"[\u3000-\u9fff]|[^\s\u3000-\u9fff]+", t or "")


def test_long_texts_in_stretches(monkeypatch):
    raw = bytes(random.Random(1).randrange(256) for _ in range(5000))
    whole = list(suffixes.anchors_of(raw))
    monkeypatch.setattr(suffixes, "CHUNK", 700)
    cut = list(suffixes.anchors_of(raw))
    starts = lambda found: {(at - d, key) for key, at, low, high in found for d in range(low, high + 1)}
    assert starts(whole) == starts(cut) and len({s for s, _ in starts(cut)}) == 5000 - 399


# --- 8 ---------------------------------------------------------------------------------------------------------------


def test_quality(spark):
    rnd = random.Random(9)
    rows, labels, bad = [], [], set()
    for i in range(600):
        text, kind = words(rnd, 40, "abcdefghijklmnop"), i % 6
        if kind == 0:
            text += " moronic scumbag"
        if kind == 1:
            text = text.replace(" ", " $$$ ")
        if kind < 2:
            bad.add(i)
        rows.append((i, text, "en", f"s{i % 7}"))  # a source tells nothing
        if i % 2:
            labels.append((i, int(kind != 1), int(kind == 0)))
        elif i % 4 == 0:
            labels.append((i, int(kind != 1), int(kind == 0)))
    rows += [(900, None, None, None), (901, "", "en", "s"), (None, words(rnd, 9), "en", "s"), (902, rows[0][1], "en", "s0"), (903, words(rnd, 20_000) + " moronic scumbag", "en", "s1")]
    labels += [(1, None, None), (None, 1, 1), (1, 0, 0)]
    df = frame(spark, rows).withColumn("keep", F.lit("clash"))
    got = {r.doc_id: r for r in quality.classify(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert len(got) == len(rows)
    unseen = [i for i in range(600) if i % 4 == 2]
    assert np.mean([got[i].keep != (i in bad) for i in unseen]) > 0.98
    assert not got[902].keep and not got[903].keep and all(0 <= r.p_good <= 1 and 0 <= r.p_toxic <= 1 for r in got.values())
    free = quality.classify(df, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert all(r.keep for r in free)
    assert quality.classify(df.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect() == []


@pytest.mark.parametrize("rare", [0, 1])
def test_both_views_count(rare):
    rnd, names = random.Random(4), (np.arange(40, dtype=np.uint64), np.arange(6, dtype=np.uint64))
    y = np.array([int(i % 25 == 3 if rare else i % 2) for i in range(200)])  # rare: no fifth row is positive
    rows = [(np.array(rnd.sample(range(40), 8), np.int32), np.array([k if rnd.random() < 0.9 else 1 - k, 2 + i % 4], np.int32)) for i, k in enumerate(y.tolist())]
    model = quality.CoTrained(rows, y, [], names)  # the words tell nothing, the metadata much
    assert (model.mix >= 0).all() and model.mix[1] > 0 and any(model.weights[1].values())
    p = model.predict([np.zeros(0, np.uint64)] * 2, [np.array([k], np.uint64) for k in (0, 1)])
    assert p[1] > p[0] + 0.1


@pytest.mark.parametrize("signal", [1, 0])
def test_weights_of_views(signal):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 400)
    z = np.stack([(2 * y - 1) + rng.normal(size=400), -(2 * y - 1) * (1 - signal) + signal * (2 * y - 1) + rng.normal(size=400)], 1)
    mix, bias = quality._combined(z, y)
    loss = lambda m, c: np.log1p(np.exp(-(2 * y - 1) * (z @ m + c))).mean() + 5e-3 * ((np.asarray(m) - 1) ** 2).sum()
    around = [loss(np.maximum(mix + [a, b], 0), bias + c) for a in (-0.02, 0, 0.02) for b in (-0.02, 0, 0.02) for c in (-0.02, 0, 0.02)]
    assert loss(mix, bias) <= min(around) + 1e-9 and mix[0] > 0.5 and (mix[1] > 0.5 if signal else mix[1] == 0)


# --- 9 ---------------------------------------------------------------------------------------------------------------


def test_sharding(spark, corpus, tmp_path):
    df = frame(spark, corpus)
    got = sharding.shard_documents(df, shards=7).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _, _ in corpus)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    mix = defaultdict(Counter)
    for r in got:
        slots[r.shard].append(r.slot)
        mix[r.shard][r.source] += 1
    sizes = [len(v) for v in slots.values()]
    assert len(slots) == 7 and max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    total = Counter(s for *_, s in corpus)
    for m in mix.values():
        assert all(abs(m[s] - n / 7) <= 2 for s, n in total.items())
    assert [r.asDict() for r in sharding.shard_documents(df, 7).orderBy("shard", "slot").limit(9).collect()] == [r.asDict() for r in sharding.shard_documents(df, 7).orderBy("shard", "slot").limit(9).collect()]
    assert sharding.shard_documents(df.limit(0)).collect() == []
    written = sharding.write_shards(df, str(tmp_path / "shards"), 7)
    assert Counter(r.text for r in written.collect()) == Counter(t for _, t, _, _ in corpus)


# --- 10 --------------------------------------------------------------------------------------------------------------


def test_urls(spark):
    given = {
        "http://A.Example.ORG/es/x?y": ("a.example.org", "/es/x", "example.org/es/", "block"),
        "https://example.org/en/12": ("example.org", "/en/12", "example.org/en/1", "block"),
        "https://example.org/en/2#f": ("example.org", "/en/2", "org/", "allow"),
        "ftp://x.com/de/": ("x.com", "/de/", "com/de/", "block"),
        "ftp://x.com/fr/a": ("x.com", "/fr/a", "com/fr/", "allow"),
        "http://example.org": ("example.org", "", None, "allow"),
        "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
        "a://b://c/d": ("b:", "//c/d", None, "allow"),
        "nothing": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "": ("", "", None, "allow"),
    }
    rows = list(enumerate(given)) + [(100 + i, f"http://bad.net/{i}") for i in range(30)] + [(200 + i, f"http://good{i % 9}.com/{i}") for i in range(60)] + [(300, "http://bad.net/new"), (301, "http://new.bad.net/q"), (300, "http://bad.net/new")]
    outcomes = [(100 + i, 0) for i in range(30)] + [(200 + i, 1) for i in range(60)] + [(205, None), (None, 0), (206, 1)]
    pages = spark.createDataFrame([(i, u, "h") for i, u in rows], "page_id long, url string, host string")
    got = urls.filter_urls(pages, spark.createDataFrame(outcomes, "page_id long, good int")).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for i, (u, want) in enumerate(given.items()):
        assert (by[i].host, by[i].path, by[i].rule, by[i].verdict) == want, u
    assert {by[i].verdict for i in (100, 300, 301)} == {"block"} and {by[200 + i].verdict for i in range(60)} == {"allow"}
    none = spark.createDataFrame([], "page_id long, good int")
    assert {r.verdict for r in urls.filter_urls(pages, none).collect() if r.rule is None} == {"allow"}
    assert urls.filter_urls(pages.limit(0), none).collect() == []
