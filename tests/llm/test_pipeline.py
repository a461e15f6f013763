"""Each stage on what its predecessor kept, against brute force; and the whole run."""

import random
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from test_operators import brute_hits, brute_removed, words

from quarrylight.llm import simhash, tokens

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rnd, out = random.Random(12), str(tmp_path_factory.mktemp("sf"))
    item, passage = words(rnd, 15), words(rnd, 300)
    rows, labels = [], []
    for i in range(240):
        toxic = i % 5 == 0
        rows.append((i, words(rnd, 60, "abcdefghijklmnopqrst") + " moronic scumbag" * toxic, "en", f"s{i % 7}"))
        if i % 4:
            labels.append((i, 1, int(toxic)))
    rows += [(300 + i, rows[1][1], "en", "s1") for i in range(9)] + [(320, item + " " + rows[2][1], "en", "s2")]
    rows += [(330 + i, f"{words(rnd, 40, 'abcdefghijklmnopqrst')} é{passage}é {words(rnd, 30, 'abcdefghijklmnopqrst')}", "en", "s3") for i in range(3)]
    rows += [(340, None, None, None), (341, "", "en", "s"), (None, rows[3][1], "en", "s"), (None, rows[3][1] + " more and more of it", "en", "s"), (350, words(rnd, 9000, "abcdefghijklmnopqrst"), "en", "s1")]
    spark.createDataFrame([(i, t, a, b, None if t is None else len(t)) for i, t, a, b in rows], DOCS).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out, [(1, item)]


def rows_of(df):
    return [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect()]


def test_stages(spark, sf_dir):
    out, items = sf_dir
    docs = spark.read.parquet(f"{out}/documents.parquet")
    before, whole = rows_of(docs), corpus_pipeline.run(spark, out)
    stages = [f for _, f in corpus_pipeline.STAGES]

    def through(stage, df):
        path = f"{out}/stage-{stage.__name__}"
        stage(spark, df, out).write.parquet(path)
        return spark.read.parquet(path)

    docs = through(stages[0], docs)
    kept = rows_of(docs)
    assert docs.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")
    gone = {r[0] for r in before} - {r[0] for r in kept}
    toxic = {i for i in range(240) if i % 5 == 0}
    assert toxic <= gone and len(gone - toxic) <= 2 and Counter(kept) <= Counter(before)

    docs = through(stages[1], docs)
    one = rows_of(docs)
    groups = {}
    for r, g in zip(kept, brute_groups([r[1] for r in kept]), strict=True):
        groups.setdefault(g, []).append(r)
    assert Counter(one) <= Counter(kept) and Counter(r[0] for r in one) == Counter(min((r[0] for r in g), key=lambda i: (i is None, i)) for g in groups.values())

    docs = through(stages[2], docs)
    cut = {r[0]: r for r in rows_of(docs)}
    split = [(r[1] or "").split() for r in one]
    seen = Counter(tuple(w[i : i + 51]) for w in split for i in range(len(w) - 50))
    for r, w, want in zip(one, split, brute_removed([(r[1] or "").encode() for r in one]), strict=True):
        text, passage = cut[r[0]][1], any(seen[tuple(w[i : i + 51])] > 1 for i in range(len(w) - 50))
        assert (text == (r[1] or "")) == (want[1] == 0 and not passage) and len(text.encode()) <= want[0] - want[1] and cut[r[0]][4] == len(text)
    assert {330, 331, 332} <= {i for i in cut if len(cut[i][1]) < 500}

    docs = through(stages[3], docs)
    clean = {r[0] for r in rows_of(docs)}
    assert clean == {i for i, r in cut.items() if not brute_hits(r[1], items)[4]} and 320 not in clean

    packed = stages[4](spark, docs, out).collect()
    encode = tokens.encoder(tokens.default_path())
    for i, text in ((r[0], r[1]) for r in rows_of(docs)):
        pieces = sorted((p.piece, p.ids) for p in packed if p.doc_id == i)
        assert [x for _, p in pieces for x in p] == [*encode(text or ""), 2]
    key = lambda rows: Counter((r.doc_id, r.piece, r.start, tuple(r.ids)) for r in rows)
    assert key(whole.collect()) == key(packed)
    assert np.all([r.length <= 1024 for r in packed])


def brute_groups(texts):
    """The least position that pairs of texts with a five-word Jaccard similarity of 0.8 or more reach."""
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, group = [shingles(t) for t in texts], list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and group[a] != group[b]:
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = [new if g == old else g for g in group]
    return group


def test_near_copies(spark):
    rnd = random.Random(8)
    texts = [None, "", " \n", "one two", "One  two", "one two three"]
    line = words(rnd, 12)
    for n in (8, 30, 60, 150, 400, 3000):
        for _ in range(6):
            base = words(rnd, n).split()
            texts.append(" ".join(base))
            for _ in range(rnd.randrange(5)):  # chains of edits, around 0.8
                for _ in range(max(1, rnd.randrange(n // 20 + 2))):
                    base[rnd.randrange(len(base))] = "new" + words(rnd, 1)
                texts.append(" ".join(base) + (" " + line) * rnd.randrange(2))
    hot = words(rnd, 80).split()
    texts += [" ".join([*hot[:i], f"x{i}", *hot[i:]]) for i in range(40)] + [words(rnd, 20) + " " + line for _ in range(30)]
    rnd.shuffle(texts)
    want = brute_groups(texts)
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    got = rows_of(corpus_pipeline.drop_near_duplicates(spark, df, ""))
    assert sorted(got, key=lambda r: r[0]) == [rows[i] for i in sorted(set(want))]
    assert corpus_pipeline.drop_near_duplicates(spark, df.limit(0), "").collect() == []


def test_a_large_group_of_near_copies_makes_few_pairs(spark, monkeypatch):
    rnd, made = random.Random(4), []
    base = words(rnd, 110).split()
    texts = []
    for _ in range(300):  # many pairs reach 0.8, few of them with the node that a shingle is listed with
        at = rnd.sample(range(40, 60), 2)
        texts.append(" ".join(f"x{rnd.random()}" if i in at else w for i, w in enumerate(base)))
    texts += [words(rnd, 30) for _ in range(5)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    want = [rows[i] for i in sorted(set(brute_groups(texts)))]
    df = spark.createDataFrame(rows, DOCS)

    def counted(df, names=None, f=simhash.stored):
        out = f(df, names)
        if out.columns == ["a", "b"]:
            made.append(out.count())
        return out

    monkeypatch.setattr(simhash, "stored", counted)
    assert sorted(rows_of(corpus_pipeline.drop_near_duplicates(spark, df, "")), key=lambda r: r[0]) == want
    assert len(texts) / 10 < max(made) < len(texts)
    monkeypatch.setattr(simhash, "BLOCK", 64)
    assert sorted(rows_of(corpus_pipeline.drop_near_duplicates(spark, df, "")), key=lambda r: r[0]) == want


def test_repeated_passages(spark):
    rnd = random.Random(9)
    long = lambda n: " ".join("".join(rnd.choice("abcdefghijklmnopqrst") for _ in range(rnd.randrange(3, 7))) for _ in range(n))
    passage, short, wide, bytes_only = long(55), long(50), long(68), "x".join(long(90).split())
    assert 250 < len(passage) < 330 and len(wide) < 395 and len(bytes_only) > 400
    own = [(long(30), long(30)) for _ in range(12)]
    middle = [passage, passage, passage.replace(" ", "\n"), short, short, wide, wide, long(20) + " " + " ".join(wide.split()[10:65]), bytes_only, bytes_only, "é" + passage, ""]
    texts = [f"{a} {m} {b}" for (a, b), m in zip(own, middle, strict=True)] + [None, "", short]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)
    got = {r[0]: r[1] for r in rows_of(corpus_pipeline.cut_repeats(spark, df, ""))}
    split = [(t or "").split() for t in texts]
    seen = Counter(tuple(w[i : i + 51]) for w in split for i in range(len(w) - 50))
    for i, w in enumerate(split):
        gone = {j for k in range(len(w) - 50) if seen[tuple(w[k : k + 51])] > 1 for j in range(k, k + 51)}
        if i not in (8, 9):
            assert got[i].split() == [x for j, x in enumerate(w) if j not in gone]
            assert gone or got[i] == (texts[i] or "")
    assert all(got[i].split() == f"{own[i][0]} {own[i][1]}".split() for i in (0, 1, 2)) and got[3] == texts[3]
    assert all(len(got[i]) < len(texts[i]) - 400 for i in (8, 9))


def test_rows_that_share_an_id(spark):
    rnd = random.Random(6)
    a, b = words(rnd, 60), words(rnd, 60)
    rows = [(3, a), (5, a + " x"), (5, b), (7, None), (7, words(rnd, 40)), (8, b), (5, b)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
    got = Counter((r[0], r[1]) for r in rows_of(corpus_pipeline.drop_near_duplicates(spark, df, "")))
    assert got == Counter([rows[0], rows[2], rows[3], rows[4]])
