"""Toxicity: a bidirectional gated recurrent network with attention pooling over windows of words.

Each word enters with word inputs (how much more often its hash occurs in toxic than in other training documents,
and how often at all) and character inputs (the largest, smallest and mean such value over its character
3- to 5-grams, word ends included). The network reads every overlapping window of a text in both directions, pools
the states by attention, and a text scores as its highest window. It is trained in numpy on a bounded sample of
labelled documents; the counts behind the inputs come from the other half of that sample while training, so that
the network meets rare words as it will meet them later. Probabilities are calibrated on a part held out of it.

Only texts are inputs. Null and empty texts are one window without words; repeated rows score alike; a repeated id
gives the sample one text, the smallest; an id labelled twice is toxic if one label says so; null ids and labels other
than 0 and 1 are not learnt from; ids of any type come back as they are; texts of any length are scored whole, and a
very long one enters the sample as stretches from all of it; without labels of both kinds every text scores the share
of toxic labels; other columns are not read, so names cannot clash; empty tables give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import learns

WINDOW, STRIDE = 64, 48
HIDDEN, INPUTS = 8, 5
BUCKETS = 1 << 18
GRAMS = (3, 4, 5)
#: Labelled documents of each kind in the training sample, chosen by hash. One with more characters than the second number
#: enters as that many, in stretches evenly spread over the whole of it.
SAMPLE, SAMPLE_CHARS, STRETCHES = 2000, 48_000, 48
#: Distinct words whose inputs a Python worker keeps.
CACHED_WORDS = 200_000


def word_buckets(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), dtype=np.int64, count=len(words)) % BUCKETS


def gram_buckets(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all character grams of ``words`` and the word that each belongs to, in order of words."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    text = np.frombuffer(b"^" + b"$^".join(words) + b"$", dtype=np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    packed, places = [], []
    for n in GRAMS:
        if len(text) < n:
            continue
        gram = np.full(len(text) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            gram = (gram << np.uint64(8)) | text[k : k + len(gram)]
        inside = owner[: len(gram)] == owner[n - 1 :]
        mixed = gram[inside] * np.uint64(0x9E3779B97F4A7C15)
        packed.append((mixed >> np.uint64(46)).astype(np.int64))
        places.append(owner[: len(gram)][inside])
    if not packed:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    place = np.concatenate(places)
    order = np.argsort(place, kind="stable")
    return np.concatenate(packed)[order], place[order]


@dataclass
class Evidence:
    """Shrunken log odds of toxic documents per bucket of words and of character grams."""

    word: np.ndarray
    known: np.ndarray
    gram: np.ndarray

    @staticmethod
    def count(texts: list[list[bytes]], labels: np.ndarray) -> Evidence:
        words, grams = np.zeros((2, BUCKETS)), np.zeros((2, BUCKETS))
        for split, label in zip(texts, labels.astype(int)):
            distinct = list(set(split))
            if distinct:
                words[label, np.unique(word_buckets(distinct))] += 1
                grams[label, np.unique(gram_buckets(distinct)[0])] += 1
        of = [max(1, int((labels == k).sum())) for k in (0, 1)]

        def odds(c):
            seen = c.sum(axis=0)
            return ((np.log((c[1] + 0.5) / of[1]) - np.log((c[0] + 0.5) / of[0])) * seen / (seen + 3)).astype(np.float32)

        return Evidence(odds(words), np.log1p(words.sum(axis=0)).astype(np.float32), odds(grams))

    def inputs(self, words: list[bytes]) -> np.ndarray:
        out = np.zeros((len(words), INPUTS), dtype=np.float32)
        at = word_buckets(words)
        out[:, 0], out[:, 1] = self.word[at], self.known[at] / 4
        grams, owner = gram_buckets(words)
        if len(grams):
            value = self.gram[grams]
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            out[owner[first], 2] = np.maximum.reduceat(value, first)
            out[owner[first], 3] = np.minimum.reduceat(value, first)
            out[owner[first], 4] = np.add.reduceat(value, first) / np.diff(np.r_[first, len(value)])
        return out


def windows_of(length: int) -> list[tuple[int, int]]:
    """Start and end of the overlapping windows that cover ``length`` words; an empty text has one."""
    starts = range(0, max(1, length - (WINDOW - STRIDE)), STRIDE)
    return [(s, min(s + WINDOW, length)) for s in starts]


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Network:
    """Weights: ``wx`` (inputs to the 6 gate rows of both directions), ``u`` (states to gates, per direction),
    ``att`` (state to attention score), ``out`` (pooled state to log odds)."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        f = np.float32
        self.w = {
            "wx": rng.normal(0, 0.3, (INPUTS, 6 * HIDDEN)).astype(f),
            "bx": np.zeros(6 * HIDDEN, dtype=f),
            "u": rng.normal(0, 0.25, (2, HIDDEN, 3 * HIDDEN)).astype(f),
            "att": rng.normal(0, 0.3, 2 * HIDDEN).astype(f),
            "out": rng.normal(0, 0.3, 2 * HIDDEN).astype(f),
            "b": np.zeros(1, dtype=f),
        }

    def project(self, inputs: np.ndarray) -> np.ndarray:
        return inputs @ self.w["wx"] + self.w["bx"]

    def forward(self, gates: np.ndarray, index: np.ndarray, size: np.ndarray, keep: bool = False):
        """Log odds of windows. ``index`` (windows, steps) picks rows of ``gates``; steps from ``size`` on are none."""
        n, steps = index.shape
        mask = np.arange(steps)[None, :] < size[:, None]
        states = np.zeros((n, steps, 2 * HIDDEN), dtype=np.float32)
        kept = []
        for d in (0, 1):
            h, u = np.zeros((n, HIDDEN), dtype=np.float32), self.w["u"][d]
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                g = gates[index[:, t], 3 * HIDDEN * d : 3 * HIDDEN * (d + 1)]
                a = h @ u
                rz = _sigmoid(g[:, : 2 * HIDDEN] + a[:, : 2 * HIDDEN])
                r, z = rz[:, :HIDDEN], rz[:, HIDDEN:]
                c = np.tanh(g[:, 2 * HIDDEN :] + r * a[:, 2 * HIDDEN :])
                new = c + z * (h - c)
                m = mask[:, t, None]
                if keep:
                    kept.append((d, t, h, r, z, c, a[:, 2 * HIDDEN :], m))
                h = np.where(m, new, h)
                states[:, t, HIDDEN * d : HIDDEN * (d + 1)] = h
        score = np.where(mask, states @ self.w["att"], -1e9)
        score -= score.max(axis=1, keepdims=True)
        weight = np.exp(score)
        weight /= weight.sum(axis=1, keepdims=True)
        pooled = (weight[:, None, :] @ states)[:, 0]
        return pooled @ self.w["out"] + self.w["b"][0], (states, weight, pooled, kept, mask)

    def gradients(self, inputs: np.ndarray, index: np.ndarray, size: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        gates = self.project(inputs)
        logit, (states, weight, pooled, kept, mask) = self.forward(gates, index, size, keep=True)
        dz = ((_sigmoid(logit) - y) / len(y)).astype(np.float32)
        g = {"out": pooled.T @ dz, "b": np.array([dz.sum()], dtype=np.float32)}
        dpool = np.outer(dz, self.w["out"])
        dstates = weight[:, :, None] * dpool[:, None, :]
        dweight = np.einsum("nts,ns->nt", states, dpool)
        dscore = weight * (dweight - (weight * dweight).sum(axis=1, keepdims=True)) * mask
        g["att"] = np.einsum("nt,nts->s", dscore, states)
        dstates += dscore[:, :, None] * self.w["att"]
        dgates = np.zeros_like(gates)
        g["u"] = np.zeros_like(self.w["u"])
        carry = {0: 0.0, 1: 0.0}
        for d, t, h, r, z, c, a, m in reversed(kept):
            dh = dstates[:, t, HIDDEN * d : HIDDEN * (d + 1)] + carry[d]
            dnew = np.where(m, dh, 0)
            dc = dnew * (1 - z) * (1 - c * c)
            dzg = dnew * (h - c) * z * (1 - z)
            drg = dc * a * r * (1 - r)
            da = np.concatenate((drg, dzg, dc * r), axis=1)
            carry[d] = np.where(m, dnew * z, dh) + da @ self.w["u"][d].T
            g["u"][d] += h.T @ da
            np.add.at(dgates, (index[:, t], slice(3 * HIDDEN * d, 3 * HIDDEN * (d + 1))), np.concatenate((drg, dzg, dc), axis=1))
        g["wx"], g["bx"] = inputs.T @ dgates, dgates.sum(axis=0)
        return g


@dataclass
class ToxicityModel:
    evidence: Evidence
    network: Network
    scale: tuple[float, float]
    share: float
    trained: bool


def _prepare(texts: list[list[bytes]], evidence: Evidence):
    """Inputs of the distinct words, windows as index rows, their sizes, and the text of each window."""
    known: dict[bytes, int] = {}
    rows, sizes, owner = [], [], []
    for n, words in enumerate(texts):
        at = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int32, count=len(words))
        for a, b in windows_of(len(words)):
            row = np.zeros(WINDOW, dtype=np.int32)
            row[: b - a] = at[a:b]
            rows.append(row), sizes.append(b - a), owner.append(n)
    inputs = evidence.inputs(list(known)) if known else np.zeros((1, INPUTS), dtype=np.float32)
    return inputs, np.stack(rows), np.array(sizes), np.array(owner)


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = 8, batch: int = 48, rate: float = 0.02, seed: int = 5) -> ToxicityModel:
    """Fit on labelled texts: evidence across two halves, the network on windows that score highest, Platt scaling."""
    split = [t.lower().split() for t in texts]
    share = float(labels.mean()) if len(labels) else 0.0
    evidence = Evidence.count(split, labels)
    network = Network(seed)
    if len(labels) < 10 or labels.min() == labels.max():
        return ToxicityModel(evidence, network, (1.0, 0.0), share, False)
    part = np.arange(len(texts)) % 10
    held, halves = part == 9, part % 2
    pick = lambda rows: [split[i] for i in rows]
    sets = {}
    for k in (0, 1):
        mine, others = np.flatnonzero((halves == k) & ~held), np.flatnonzero((halves != k) & ~held)
        if len(mine) and len(others):
            sets[k] = (_prepare(pick(mine), Evidence.count(pick(others), labels[others])), labels[mine])
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in network.w.items()}
    second = {k: np.zeros_like(v) for k, v in network.w.items()}
    step = 0
    weight_of = 1.0
    highest: dict[int, np.ndarray] = {}
    for epoch in range(epochs):
        for k, ((inputs, index, sizes, owner), y) in sets.items():
            starts = np.searchsorted(owner, np.arange(len(y) + 1))
            if epoch % 2 == 0:  # the highest windows move little from one epoch to the next
                gates = network.project(inputs)
                logit = np.concatenate([network.forward(gates, index[i : i + 2048], sizes[i : i + 2048])[0] for i in range(0, len(index), 2048)])
                highest[k] = np.array([a + int(np.argmax(logit[a:b])) for a, b in zip(starts[:-1], starts[1:])])
            best = highest[k]
            positive, negative = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
            for _ in range(max(6, len(y) // batch)):
                # equal shares of both kinds; clean texts also give windows at random, which are clean throughout
                p, q = rng.choice(positive, batch // 2), rng.choice(negative, batch // 2)
                any_window = starts[q] + (rng.random(len(q)) * (starts[q + 1] - starts[q])).astype(int)
                rows = np.concatenate((best[p], best[q], any_window[: batch // 4]))
                want = np.concatenate((np.ones(len(p)), np.zeros(len(q) + batch // 4)))
                used, local = np.unique(index[rows], return_inverse=True)
                step += 1
                for name, g in network.gradients(inputs[used], local.reshape(len(rows), WINDOW), sizes[rows], want).items():
                    first[name] = 0.9 * first[name] + 0.1 * g
                    second[name] = 0.99 * second[name] + 0.01 * g * g
                    network.w[name] -= (rate * weight_of * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        weight_of *= 0.8
    model = ToxicityModel(evidence, network, (1.0, 0.0), share, True)
    # the held part meets evidence without itself; every text counts once, so the sample's share of toxic texts holds
    fair = ToxicityModel(Evidence.count(pick(np.flatnonzero(~held)), labels[~held]), network, (1.0, 0.0), share, True)
    z, t = Scorer(fair).log_odds([texts[i] for i in np.flatnonzero(held)]), labels[held]
    a, b = 1.0, 0.0
    for _ in range(400):
        p = _sigmoid(a * z + b)
        a, b = a - 0.05 * (((p - t) * z).mean() + 0.05 * (a - 1)), b - 0.05 * ((p - t).mean() + 0.02 * b)
    model.scale = (float(max(a, 0.1)), float(b))
    return model


class Scorer:
    """Scores texts with a model, keeping the gate inputs of words already met."""

    def __init__(self, model: ToxicityModel):
        self.model = model
        self.forget()

    def forget(self):
        self.known: dict[bytes, int] = {}
        self.gates = np.empty((1 << 14, 6 * HIDDEN), dtype=np.float32)

    def _learn(self, split: list[list[bytes]]):
        if len(self.known) > CACHED_WORDS:
            self.forget()
        known = self.known
        new = list(dict.fromkeys(w for words in split for w in words if w not in known))
        for low in range(0, len(new), 50_000):
            part = new[low : low + 50_000]
            base = len(known)
            known.update(zip(part, range(base, base + len(part))))
            if len(known) > len(self.gates):
                self.gates = np.concatenate((self.gates[:base], np.empty((max(base, 2 * len(part)), 6 * HIDDEN), dtype=np.float32)))
            self.gates[base : len(known)] = self.model.network.project(self.model.evidence.inputs(part))

    def log_odds(self, texts: list[bytes]) -> np.ndarray:
        split = [t.lower().split() for t in texts]
        self._learn(split)
        best = np.full(len(texts), -np.inf)
        words = np.concatenate([np.fromiter((self.known[w] for w in s), dtype=np.int64, count=len(s)) for s in split] or [np.empty(0, dtype=np.int64)])
        lengths = np.array([len(s) for s in split], dtype=np.int64)
        begins = np.cumsum(lengths) - lengths
        counts = np.maximum(1, -(-(lengths - (WINDOW - STRIDE)) // STRIDE))
        owner = np.repeat(np.arange(len(texts)), counts)
        starts = (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)) * STRIDE
        sizes = np.minimum(WINDOW, lengths[owner] - starts)
        for low in range(0, len(owner), 1024):
            o, s, z = owner[low : low + 1024], starts[low : low + 1024], sizes[low : low + 1024]
            where = (begins[o] + s)[:, None] + np.minimum(np.arange(WINDOW)[None, :], np.maximum(z - 1, 0)[:, None])
            index = words[np.minimum(where, len(words) - 1)] if len(words) else np.zeros(where.shape, dtype=np.int64)
            np.maximum.at(best, o, self.model.network.forward(self.gates, index, z)[0])
        return best

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not self.model.trained:
            return np.full(len(texts), self.model.share)
        a, b = self.model.scale
        return _sigmoid(a * self.log_odds(texts) + b)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> ToxicityModel:
    """Fit on at most ``sample`` toxic and ``sample`` other labelled documents outside the held-out fifth."""
    usable = labels.where(F.col(label_col).isin(0, 1) & learns(F.col(id_col), 0)).select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    usable = usable.where("doc_id is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = usable.where("label = 1").orderBy(*by_hash).limit(sample).unionByName(usable.where("label = 0").orderBy(*by_hash).limit(sample))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size, part = F.length("text"), SAMPLE_CHARS // STRETCHES
    stretch = lambda i: F.substr("text", (i * (size - part) / (STRETCHES - 1) + 1).cast("int"), F.lit(part))
    sampled = F.when(size <= SAMPLE_CHARS, F.col("text")).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(STRETCHES - 1)), stretch), " "))
    # one text an id, so that repeated rows do not make the sample larger
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", sampled.alias("text")).groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    rows = rows.withColumn("mix", F.crc32(F.col("doc_id").cast("string"))).withColumn("text", F.col("text").cast("binary")).toPandas()
    rows = rows.sort_values(["mix", "doc_id"], ignore_index=True)
    return fit([bytes(t) for t in rows["text"]], rows["label"].to_numpy(dtype=float))


def toxicity(text: Column, model: ToxicityModel) -> Column:
    """Score (0 to 1) of a text column."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model)
        for texts in batches:
            raw = [t or b"" for t in texts]
            yield pd.Series(np.concatenate([scorer.scores(raw[i : i + 256]) for i in range(0, len(raw), 256)]) if raw else np.empty(0))

    return score(text.cast("binary"))


def score_documents(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    scored = docs.select(F.col(id_col).alias("doc_id"), (~learns(F.col(id_col), 0)).alias("held_out"), toxicity(F.col(text_col), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
