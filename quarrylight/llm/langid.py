"""Language identification by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.llm.common import table

#: The training sample: about so many documents a language, so many characters from a place in each chosen by hash.
DOCS, CHARS = 400, 2000
HIDDEN, STEPS, BATCH, RATE = 8, 500, 64, 0.02
#: A text is read in stretches of STRETCH bytes; OVERLAP bytes more on either side are read, but labelled by the stretch that they belong to.
STRETCH, OVERLAP = 1024, 64
#: Backpropagation goes through so many steps.
TRAINED = 96
#: Stretches that are read side by side.
LANES = 1024
UNKNOWN = "und"


def runs_of(text: str, size: int = TRAINED) -> list[bytes]:
    """The whole text in runs of `size` bytes, A-Z lowered."""
    raw = text.encode().lower()
    return [raw[i : i + size] for i in range(0, len(raw), size)]


def stretches(raw: bytes) -> list[tuple[bytes, int, int]]:
    """What is read of a text at a time, and from where to where it is labelled: every byte once."""
    out = []
    for i in range(0, len(raw), STRETCH):
        first = max(0, i - OVERLAP)
        out.append((raw[first : i + STRETCH + OVERLAP], i - first, min(i + STRETCH, len(raw)) - first))
    return out


def _padded(runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    own = np.array([len(r) for r in runs])
    width = int(own.max())
    x = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in runs), np.uint8).reshape(len(runs), width)
    return x, np.arange(width)[None, :] < own[:, None]


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Network:
    """Two gated recurrent layers, one from each end, and a softmax over languages at every byte."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 5):
        rng, h = np.random.default_rng(seed), hidden
        self.langs, self.h = langs, h
        self.p = {}
        for d in "fb":
            self.p[f"W{d}"] = rng.normal(0, 0.3, (256, 3 * h)).astype(np.float32)
            self.p[f"U{d}"] = rng.normal(0, 1 / np.sqrt(h), (h, 3 * h)).astype(np.float32)
            self.p[f"c{d}"] = np.zeros(h, np.float32)
        self.p["V"] = rng.normal(0, 0.3, (2 * h, len(langs))).astype(np.float32)
        self.p["o"] = np.zeros(len(langs), np.float32)

    def _layer(self, x, mask, d, keep=False):
        """Hidden states at every position; where a run has ended the state stays."""
        w, u, c, h = self.p[f"W{d}"], self.p[f"U{d}"], self.p[f"c{d}"], self.h
        state, out, saved = np.zeros((len(x), h), np.float32), np.empty((*x.shape, h), np.float32), []
        order = range(x.shape[1]) if d == "f" else range(x.shape[1] - 1, -1, -1)
        for t in order:
            a, r = w[x[:, t]], state @ u
            gates = _sigmoid(a[:, : 2 * h] + r[:, : 2 * h])
            inner = r[:, 2 * h :] + c
            new = np.tanh(a[:, 2 * h :] + gates[:, h:] * inner)
            m = mask[:, t, None]
            nxt = np.where(m, gates[:, :h] * state + (1 - gates[:, :h]) * new, state)
            if keep:
                saved.append((t, state, gates, inner, new, m))
            state = out[:, t] = nxt
        return out, saved

    def _states(self, lanes: list[np.ndarray], d: str):
        """Yields, step by step, the number of lanes that go on (the first ones; lanes come longest first) and their logits from one end."""
        h, w, u, c = self.h, self.p[f"W{d}"], self.p[f"U{d}"], self.p[f"c{d}"]
        v = np.ascontiguousarray(self.p["V"][:h] if d == "f" else self.p["V"][h:])
        # whole arrays for each gate; sigmoid(x) = (tanh(x / 2) + 1) / 2
        (wz, wr, wn), (uz, ur, un) = ([np.ascontiguousarray(m[:, k * h : (k + 1) * h] * f) for k, f in enumerate((0.5, 0.5, 1.0))] for m in (w.astype(np.float32), u.astype(np.float32)))
        lens = np.array([len(x) for x in lanes])
        x = np.zeros((lens[0], len(lanes)), np.intp)
        for i, lane in enumerate(lanes):
            x[: len(lane), i] = lane
        state, c = np.zeros((len(lanes), h), np.float32), c.astype(np.float32)
        alive = np.searchsorted(-lens, -np.arange(1, lens[0] + 1), "right")
        for t in range(lens[0]):
            n = int(alive[t])
            state, own = state[:n], x[t, :n]
            keep = wz.take(own, 0)
            keep += state @ uz
            np.tanh(keep, out=keep)
            keep += 1
            keep *= 0.5
            reset = wr.take(own, 0)
            reset += state @ ur
            np.tanh(reset, out=reset)
            reset += 1
            reset *= 0.5
            inner = state @ un
            inner += c
            inner *= reset
            inner += wn.take(own, 0)
            np.tanh(inner, out=inner)
            state = state - inner
            state *= keep
            state += inner
            yield n, state @ v

    def log_probs(self, parts: list[tuple[bytes, int, int]]) -> np.ndarray:
        """Each stretch's sum over its labelled positions of the languages' log probabilities."""
        sums = np.zeros((len(parts), len(self.langs)), np.float64)
        order = sorted(range(len(parts)), key=lambda i: -len(parts[i][0]))
        for i in range(0, len(order), LANES):
            at = order[i : i + LANES]
            lanes = [np.frombuffer(parts[j][0], np.uint8) for j in at]
            lens = np.array([len(x) for x in lanes])
            ends = np.cumsum(lens)
            z = np.empty((ends[-1], len(self.langs)), np.float32)
            for t, (n, own) in enumerate(self._states(lanes, "f")):
                z[(ends - lens)[:n] + t] = own
            for t, (n, own) in enumerate(self._states([x[::-1] for x in lanes], "b")):
                z[ends[:n] - 1 - t] += own
            z += self.p["o"]
            z -= z.max(1, keepdims=True)
            z -= np.log(np.exp(z).sum(1, keepdims=True))
            upto = np.concatenate([np.zeros((1, z.shape[1])), np.cumsum(z, axis=0, dtype=np.float64)])
            first, last = (np.array([parts[j][k] for j in at]) for k in (1, 2))
            sums[at] = upto[ends - lens + last] - upto[ends - lens + first]
        return sums

    def gradients(self, runs: list[bytes], y: np.ndarray) -> tuple[float, dict]:
        """Mean cross-entropy over all positions and its gradients, by backpropagation through time."""
        x, mask = _padded(runs)
        h, g = self.h, {k: np.zeros_like(v) for k, v in self.p.items()}
        (hf, sf), (hb, sb) = (self._layer(x, mask, d, True) for d in "fb")
        both = np.concatenate([hf, hb], axis=2)
        z = both @ self.p["V"] + self.p["o"]
        z -= z.max(2, keepdims=True)
        q = np.exp(z)
        q /= q.sum(2, keepdims=True)
        n = mask.sum()
        loss = -float((np.log(np.take_along_axis(q, y[:, None, None], 2)[:, :, 0] + 1e-30) * mask).sum() / n)
        np.put_along_axis(q, y[:, None, None], np.take_along_axis(q, y[:, None, None], 2) - 1, 2)
        dz = (q * mask[:, :, None] / n).astype(np.float32)
        g["V"], g["o"] = np.tensordot(both, dz, ([0, 1], [0, 1])), dz.sum((0, 1))
        dboth = dz @ self.p["V"].T
        for d, saved, dout in (("f", sf, dboth[:, :, :h]), ("b", sb, dboth[:, :, h:])):
            u, back = self.p[f"U{d}"], np.zeros((len(x), h), np.float32)
            for t, state, gates, inner, new, m in reversed(saved):
                up = back + dout[:, t]
                zt, rt = gates[:, :h], gates[:, h:]
                own = up * m
                dnew = own * (1 - zt) * (1 - new * new)
                dzt, drt = own * (state - new) * zt * (1 - zt), dnew * inner * rt * (1 - rt)
                da = np.concatenate([dzt, drt, dnew], axis=1)
                dr = np.concatenate([dzt, drt, dnew * rt], axis=1)
                np.add.at(g[f"W{d}"], x[:, t], da)
                g[f"U{d}"] += state.T @ dr
                g[f"c{d}"] += (dnew * rt).sum(0)
                back = np.where(m, own * zt, up) + dr @ u.T
        return loss, g

    def fit(self, runs: list[bytes], y: np.ndarray, steps: int = STEPS, seed: int = 3) -> Network:
        """Adam over batches in which every language weighs the same."""
        rng = np.random.default_rng(seed)
        by = [np.flatnonzero(y == k) for k in range(len(self.langs))]
        m, v = ({k: np.zeros_like(p) for k, p in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            at = np.concatenate([rng.choice(b, BATCH // len(by) + 1) for b in by])
            _, g = self.gradients([runs[i] for i in at], y[at])
            rate = RATE * (1 - 0.9 * step / steps)
            for k in self.p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return self


def train(docs: DataFrame, learn: Column, per_lang: int = DOCS, chars: int = CHARS) -> Network | None:
    """A network for the languages of the rows that `learn` selects; None if there are none.

    The sample is bounded: of each language about `per_lang` documents, chosen by a hash of id and text, and `chars`
    characters of each, from a place given by the hash.
    """
    known = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return None
    langs = sorted(counts)
    pick = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    share = F.lit(0.0)
    for k in langs:
        share = F.when(F.col("lang") == k, F.lit(per_lang / counts[k])).otherwise(share)
    known = known.withColumn("__h", pick).filter(F.col("__h") < share * (1 << 30))
    start = F.pmod(F.xxhash64("__h"), F.greatest(F.length("text") - chars, F.lit(0)) + 1).cast("int") + 1
    sample = known.select("lang", F.col("text").substr(start, F.lit(chars)).alias("part"))
    runs, y = [], []
    for r in sorted(sample.collect()):
        own = runs_of(r.part)
        runs += own
        y += [langs.index(r.lang)] * len(own)
    present = sorted(set(y))
    if not present:
        return None
    y = np.searchsorted(present, y)
    return Network([langs[k] for k in present]).fit(runs, y)


def identify(docs: DataFrame, learn: Column, net: Network | None = None) -> DataFrame:
    """doc_id, lang_pred and score (0 to 1) of the whole text of every row of docs.

    The network labels every byte. It reads stretches of STRETCH bytes with OVERLAP bytes of what comes before and after, its states carried
    over all of them; a document's probabilities are the normalised geometric mean of all its positions'.
    Only the text is an input of a prediction. A text that is null or has no letter is `und`, score 0; so is every
    text if nothing could be learned. Repeated rows are judged alike. Empty tables give an empty result.
    """
    net = net or train(docs, learn)
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a few ten thousand weights
    schema = T.StructType([docs.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def predict(batches):
        net = shared.value
        for b in batches:
            lettered = b.column("lettered").to_numpy(zero_copy_only=False) & (net is not None)
            lang, score = [UNKNOWN] * b.num_rows, np.zeros(b.num_rows)
            i = 0
            while i < b.num_rows:
                parts, owner, size = [], [], 0
                while i < b.num_rows and size < 2 * LANES * STRETCH:
                    if lettered[i]:
                        raw = b.column("text")[i].as_py().encode().lower()
                        own = stretches(raw)
                        parts += own
                        owner += [i] * len(own)
                        size += len(raw)
                    i += 1
                if not parts:
                    continue
                rows, first = np.unique(owner, return_index=True)
                z = np.add.reduceat(net.log_probs(parts), first, axis=0)
                z /= np.add.reduceat([last - start for _, start, last in parts], first)[:, None]
                q = np.exp(z - z.max(1, keepdims=True))
                score[rows] = q.max(1) / q.sum(1)
                for row, k in zip(rows.tolist(), q.argmax(1).tolist(), strict=True):
                    lang[row] = net.langs[k]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score)], names=schema.names)

    rows = docs.select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    return rows.mapInArrow(predict, schema)


def op4_bigru_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = lambda: F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))  # noqa: E731  no id: never learned from
    return identify(docs, ~held_out()).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op4_bigru_langid": op4_bigru_langid}
ORACLE_SQL: dict[str, str] = {}
