"""Quality classifier by co-training: a text view and a metadata view teach each other."""

from __future__ import annotations

import logging
import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.llm.common import table

log = logging.getLogger(__name__)

#: About so many labelled and so many further documents are learned from, chosen by a hash of doc_id.
LABELLED, POOL = 5000, 3000
ROUNDS, EXCHANGED = 3, 0.02
#: Bytes of the beginnings of longer words that count as terms of their own.
STEMS = (4, 5, 6, 7)
#: Terms of a view's model at most.
TERMS = 400
TARGETS = ("good", "toxic")
#: Kept: the probability of good quality is at least, and that of toxicity is below, one half.
KEEP_GOOD, KEEP_TOXIC = 0.5, 0.5

_TERM = re.compile(rb"[a-z0-9\x80-\xff]+|[^\sa-z0-9\x80-\xff]+")


def text_terms(text: str | None) -> set[bytes]:
    """Distinct words, their stems and runs of signs of the whole text, the share of such runs, and how much words and lines repeat."""
    raw = (text or "").encode().lower()
    found = _TERM.findall(raw)
    out, n = set(found), max(1, len(found))
    signs = sum(1 for t in found if not (t[0] >= 128 or t.isalnum()))
    again = sum(map(bytes.__eq__, found, found[1:]))
    lines = raw.split(b"\n")
    kinds = len(out)
    for k in STEMS:
        out |= {w[:k] + b"~" for w in out if len(w) > k and w[-1] != 126}
    out |= {b"\0signs %d" % (10 * signs // n), b"\0words %d" % len(found).bit_length(), b"\0again %d" % (10 * again // n)}
    out |= {b"\0distinct %d" % (10 * kinds // n), b"\0lines %d" % (10 * len(set(lines)) // len(lines))}
    return out


def meta_terms(source: str | None, lang: str | None, n_chars: int | None) -> set[bytes]:
    size = -1 if n_chars is None else max(0, int(n_chars)).bit_length()
    source, lang = f"source {source}", f"lang {lang}"
    return {x.encode() for x in (source, lang, f"size {size}", f"{source} {lang}", f"{lang} {size}")}


def _apart(a: np.ndarray, b: np.ndarray, a_all: int, b_all: int) -> np.ndarray:
    """Square root of the likelihood ratio statistic of terms in a of a_all and b of b_all documents."""
    n = a_all + b_all
    total = np.zeros(len(a))
    for seen, row, col in ((a, a_all, a + b), (a_all - a, a_all, n - a - b), (b, b_all, a + b), (b_all - b, b_all, n - a - b)):
        with np.errstate(divide="ignore", invalid="ignore"):
            total += np.where(seen > 0, seen * np.log(seen * n / (row * col)), 0.0)
    return np.sqrt(np.maximum(0.0, 2 * total))


def _prob(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class View:
    """Logistic regression on the presence of the terms that tell a target's documents apart, with Platt calibration.

    Documents are arrays of term numbers below `kinds`.
    """

    def __init__(self, kinds: int):
        self.kinds, self.own, self.w, self.bias, self.scale, self.shift = kinds, np.zeros(0, np.int64), np.zeros(0), 0.0, 1.0, 0.0

    def _rows(self, docs: list[np.ndarray]) -> np.ndarray:
        place = np.full(self.kinds, -1, np.int32)
        place[self.own] = np.arange(len(self.own))
        x = np.zeros((len(docs), len(self.own)), np.float32)
        for row, d in zip(x, docs, strict=True):
            at = place[d]
            row[at[at >= 0]] = 1
        return x

    def _counts(self, docs: list[np.ndarray]) -> np.ndarray:
        return np.bincount(np.concatenate(docs), minlength=self.kinds) if docs else np.zeros(self.kinds, np.int64)

    def fit(self, docs: list[np.ndarray], y: np.ndarray, steps: int = 300) -> View:
        a, b = (self._counts([d for d, v in zip(docs, y, strict=True) if v == k]) for k in (1, 0))
        a_all, b_all = max(1, int(y.sum())), max(1, int((1 - y).sum()))
        least = math.sqrt(2 * math.log(max(2, int(((a + b) > 0).sum()))))  # what the luckiest of so many terms reaches by chance
        strength = np.where(a + b >= 3, _apart(a, b, a_all, b_all), 0.0)
        order = np.argsort(-strength, kind="stable")[:TERMS]
        self.own = order[strength[order] >= least]
        x, n = self._rows(docs), max(1, len(docs))
        self.w, self.bias = np.zeros(len(self.own)), math.log(a_all / b_all)
        m, v = np.zeros(len(self.own) + 1), np.zeros(len(self.own) + 1)
        for step in range(1, steps + 1):
            e = _prob(x @ self.w + self.bias) - y
            g = np.append(x.T @ e / n + 1e-3 * self.w, e.mean())
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            d = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            self.w, self.bias = self.w - d[:-1], self.bias - d[-1]
        return self

    def logit(self, docs: list[np.ndarray]) -> np.ndarray:
        return self.scale * (self._rows(docs) @ self.w + self.bias) + self.shift

    def calibrate(self, docs: list[np.ndarray], y: np.ndarray) -> View:
        """Platt scaling on documents that were not learned from."""
        s = self.logit(docs)
        a, b = 1.0, 0.0
        for _ in range(200):
            p = _prob(a * s + b)
            e, h = p - y, p * (1 - p) + 1e-6
            g = np.array([(e * s).mean() + 1e-3 * (a - 1), e.mean()])
            hess = np.array([[(h * s * s).mean() + 1e-3, (h * s).mean()], [(h * s).mean(), h.mean() + 1e-6]])
            da, db = np.linalg.solve(hess, g)
            a, b = a - 0.5 * np.clip(da, -1, 1), b - 0.5 * np.clip(db, -1, 1)
        self.scale, self.shift = max(a, 0.0), b
        return self


def _combined(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of 0 or more for the columns of calibrated logits z, and a constant, that make y most likely; slightly drawn to 1 each."""
    x, pull = np.column_stack([z, np.ones(len(z))]), np.array([1e-2] * z.shape[1] + [0.0])
    to = np.append(np.ones(z.shape[1]), 0.0)
    at, step = np.append(np.ones(z.shape[1]), -math.log(y.mean() / (1 - y.mean()))), 1 / (0.25 * np.linalg.eigvalsh(x.T @ x / len(x))[-1] + 1e-2)
    ahead, t = at, 1.0
    for _ in range(2000):  # accelerated projected gradient: the loss is convex, the bound a box
        new = ahead - step * (x.T @ (_prob(x @ ahead) - y) / len(x) + pull * (ahead - to))
        new[:-1] = np.maximum(new[:-1], 0.0)
        t, back = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        ahead, at = new + (back - 1) / t * (new - at), new
    return at[:-1], float(at[-1])


class CoTrained:
    """Both views of one target as weights by term hash, and how their calibrated logits combine."""

    def __init__(self, rows: list[tuple], y: np.ndarray, pool: list[tuple], names: tuple[np.ndarray, np.ndarray]):
        """rows and pool: documents as (text, meta) arrays of term numbers; names: the terms' hashes in either view."""
        y = y.astype(float)
        fold = np.zeros(len(rows), bool)
        for label in (0, 1):  # about a fifth of either class; a class of one is learned from
            own = np.flatnonzero(y == label)
            fold[own[::5]] = len(own) > 1
        learn, held = np.flatnonzero(~fold), np.flatnonzero(fold)
        sets = [([rows[i][v] for i in learn], list(y[learn])) for v in (0, 1)]
        fitted = lambda v: View(len(names[v])).fit(sets[v][0], np.array(sets[v][1]))
        left, n = np.ones(len(pool), bool), max(1, int(EXCHANGED * len(pool)))
        base = y[learn].mean() if len(learn) else 0.5
        for _ in range(ROUNDS if len(learn) else 0):
            views = [fitted(v) for v in (0, 1)]
            for v, view in enumerate(views):  # each view teaches the other its surest, in the classes' proportion
                at = np.flatnonzero(left)
                p = _prob(view.logit([pool[i][v] for i in at]))
                order = np.argsort(p, kind="stable")
                for chosen, label in ((order[::-1][: max(1, round(n * base))], 1.0), (order[: max(1, round(n * (1 - base)))], 0.0)):
                    for k in chosen:
                        if abs(p[k] - label) < 0.05 and left[at[k]]:
                            sets[1 - v][0].append(pool[at[k]][1 - v])
                            sets[1 - v][1].append(label)
                            left[at[k]] = False
        views = [fitted(v) for v in (0, 1)]
        share = np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6)
        self.mix, self.bias = np.ones(2), -math.log(share / (1 - share))  # independent views: logits add, less one prior
        if len(set(y[held])) == 2:
            for v, view in enumerate(views):
                view.calibrate([rows[i][v] for i in held], y[held])
            z = np.stack([view.logit([rows[i][v] for i in held]) for v, view in enumerate(views)], 1)
            self.mix, self.bias = _combined(z, y[held])
        self.const = float(y.mean()) if len(set(y)) < 2 and len(y) else None
        self.bias += sum(m * (view.scale * view.bias + view.shift) for m, view in zip(self.mix, views, strict=True))
        self.weights = [dict(zip(names[v][view.own].tolist(), (self.mix[v] * view.scale * view.w).tolist(), strict=True)) for v, view in enumerate(views)]

    def predict(self, text: list[np.ndarray], meta: list[np.ndarray]) -> np.ndarray:
        """Probabilities of documents given as arrays of term hashes."""
        if self.const is not None:
            return np.full(len(text), self.const)
        out = np.full(len(text), self.bias)
        for docs, weights in zip((text, meta), self.weights, strict=True):
            if weights:
                keys = np.array(sorted(weights), np.uint64)
                w = np.array([weights[k] for k in keys.tolist()])
                for i, d in enumerate(docs):
                    at = np.searchsorted(keys, d)
                    at[at == len(keys)] = 0
                    out[i] += w[at[keys[at] == d]].sum()
        return _prob(out)


def _hashed(terms: set[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, terms), np.uint64, len(terms))


def _views(batch) -> tuple[list[np.ndarray], list[np.ndarray]]:
    columns = [batch.column(c).to_pylist() for c in ("source", "lang", "n_chars")]
    return [_hashed(text_terms(x.as_py())) for x in batch.column("text")], [_hashed(meta_terms(*r)) for r in zip(*columns, strict=True)]


def _numbered(docs: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """Documents as arrays of term numbers, for the terms of at least three documents; and those terms' hashes."""
    every = np.concatenate([np.frombuffer(d, np.uint64) for d in docs]) if docs else np.zeros(0, np.uint64)
    names, counts = np.unique(every, return_counts=True)
    names = names[counts >= 3]
    out = []
    for d in docs:
        own = np.frombuffer(d, np.uint64)
        at = np.searchsorted(names, own)
        at[at == len(names)] = 0
        out.append(at[names[at] == own].astype(np.int32) if len(names) else np.zeros(0, np.int32))
    return out, names


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL) -> dict[str, CoTrained] | None:
    """Models for both targets; None if no document has a label.

    labels: doc_id, quality, toxic. Several labels of one document: its worst. The sample is bounded by `labelled`
    and `pool` (expected numbers, chosen by hash); its documents are reduced to hashes of their distinct terms on the executors.
    """
    known = labels.filter("doc_id is not null and quality is not null and toxic is not null")
    known = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("good"), F.max("toxic").cast("int").alias("toxic"))
    chance = lambda n, of: F.pmod(F.xxhash64(F.lit(n), "doc_id"), F.lit(1 << 30)) < int(min(1.0, n / max(1, of)) * (1 << 30))
    known = known.filter(chance(labelled, known.count()))
    narrow = docs.select("doc_id", "text", "source", "lang", F.col("n_chars").cast("long").alias("n_chars"))
    first = narrow.join(F.broadcast(known), "doc_id")  # at most about `labelled` rows of three numbers
    rest = narrow.filter(chance(pool, docs.count())).select("*", F.lit(None).cast("int").alias("good"), F.lit(None).cast("int").alias("toxic"))
    schema = T.StructType([T.StructField(n, k) for n, k in (("doc_id", T.LongType()), ("text", T.BinaryType()), ("meta", T.BinaryType()), ("good", T.IntegerType()), ("toxic", T.IntegerType()))])

    def reduce(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                arrays = [pa.array([np.sort(x).tobytes() for x in v], pa.binary()) for v in _views(part)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *arrays, *(part.column(t) for t in TARGETS)], names=schema.names)

    columns = ["doc_id", "text", "source", "lang", "n_chars", *TARGETS]
    got = [(r.doc_id or 0, bytes(r.text), bytes(r.meta), r.good, r.toxic) for r in first.select(columns).union(rest.select(columns)).mapInArrow(reduce, schema).collect()]
    got.sort(key=lambda r: (r[0], r[2], r[1]))
    rows, others, texts = [], [], set()
    for r in got:  # copies of a text would count as evidence again and again
        if r[3] is None:
            others.append(r)
        elif r[1] not in texts:
            texts.add(r[1])
            rows.append(r)
    if not rows:
        return None
    (text, text_names), (meta, meta_names) = (_numbered([r[v] for r in rows + others]) for v in (1, 2))
    every, y = list(zip(text, meta, strict=True)), np.array([r[3:5] for r in rows])
    models = {t: CoTrained(every[: len(rows)], y[:, k], every[len(rows) :], (text_names, meta_names)) for k, t in enumerate(TARGETS)}
    for t, model in models.items():
        log.info("%s: weight of the text view %.3f, of the metadata view %.3f", t, *model.mix)
    return models


def classify(docs: DataFrame, labels: DataFrame, models: dict[str, CoTrained] | None = None) -> DataFrame:
    """Every row of docs with p_good, p_toxic and keep, scored on its whole text and its metadata (source, lang, n_chars).

    Rejected are documents whose probability of good quality is below KEEP_GOOD or of toxicity at least KEEP_TOXIC. Null and
    empty texts have no words, null metadata are values of their own; without any label everything is kept, with
    probabilities 1 and 0. Columns of docs named p_good, p_toxic or keep are replaced. Repeated rows are judged alike.
    """
    docs = docs.drop("p_good", "p_toxic", "keep")
    models = models or train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(models)  # at most 4 * TERMS terms
    schema = T.StructType([*docs.schema.fields, T.StructField("p_good", T.DoubleType()), T.StructField("p_toxic", T.DoubleType()), T.StructField("keep", T.BooleanType())])

    def score(batches):
        models = shared.value
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                if models is None:
                    good, toxic = np.ones(part.num_rows), np.zeros(part.num_rows)
                else:
                    text, meta = _views(part)
                    good, toxic = (models[t].predict(text, meta) for t in TARGETS)
                keep = (good >= KEEP_GOOD) & (toxic < KEEP_TOXIC)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(good), pa.array(toxic), pa.array(keep)], names=schema.names)

    return docs.mapInArrow(score, schema)


def op8_cotraining_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "p_good", "p_toxic", "keep")


QUERIES = {"op8_cotraining_quality": op8_cotraining_quality}
ORACLE_SQL: dict[str, str] = {}
