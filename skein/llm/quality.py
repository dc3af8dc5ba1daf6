"""Quality rules: document statistics and gradient-boosted trees over them.

The trees are grown here on labelled rows from binned statistics, with monotonic constraints on chosen features,
and flattened into node arrays that numpy walks for a whole batch at once. A document is kept if it passes the
base rules (at least 10 words, at most 20% of them in repeated 5-word windows) and the trees find it good.

Defined results: null text has no words. Statistics cover whole texts of any length. Repeated rows are judged alike; a
repeated id gives the sample all its rows; of splits that gain equally the first statistic's lowest is taken. Ids of
any type come back as they are; other columns are not read in ``judge_documents`` and kept as they are in
``keep_good``, so names cannot clash. A table without usable labels gives a model that keeps all that passes the base
rules; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 5
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
#: Labelled rows that the trees are fitted on, chosen by hash.
TRAINING_ROWS = 8_000

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Statistic and the direction in which it may move the score: -1 never up, 1 never down, 0 free.
FEATURES = {
    "log_words": 0,
    "word_length": 0,
    "symbol_share": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "upper_share": -1,
    "digit_share": 0,
    "other_share": 0,
    "pipe_share": -1,
    "exclaim_share": -1,
    "line_words": 0,
    "longest_word": 0,
}

_CONTINUES = np.zeros(256, dtype=bool)
_CONTINUES[0x80:0xC0] = True


def _repeats(words: list[bytes]) -> int:
    """Words covered by 5-word windows that occur at least twice, the first occurrence included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.uint64, count=len(words))
    bits = max(1, (len(known) - 1).bit_length())
    if bits * WINDOW <= 64:
        grams = ids[:n].copy()
        for k in range(1, WINDOW):
            grams = (grams << np.uint64(bits)) | ids[k : k + n]
    else:  # pairs are numbered again until a window fits in one integer: exact for any vocabulary
        grams = ids
        for k in range(1, WINDOW):
            pair = (np.unique(grams[:-1], return_inverse=True)[1].astype(np.uint64) << np.uint64(32)) | ids[k : k + len(grams) - 1]
            grams = np.unique(pair, return_inverse=True)[1].astype(np.uint64)
    order = np.argsort(grams, kind="stable")
    same = grams[order][1:] == grams[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(twice)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + WINDOW, -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


def statistics_of(text: bytes | None) -> tuple:
    """The base counts, then the features in the order of ``FEATURES``."""
    text = text or b""
    words = text.split()
    counts = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    points = int(counts[~_CONTINUES].sum())
    spaces = int(counts[list(SPACES)].sum())
    symbols = int(counts[list(SYMBOLS)].sum())
    lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
    dup_lines = len(lines) - len(set(lines))
    repeat = _repeats(words)
    n, chars = len(words), points - spaces
    some, some_chars = max(n, 1), max(chars, 1)
    features = (
        np.log1p(n),
        chars / some,
        symbols / some_chars,
        dup_lines / max(len(lines), 1),
        repeat / some,
        counts[65:91].sum() / some_chars,
        counts[48:58].sum() / some_chars,
        (points - counts[:128].sum()) / some_chars,
        counts[124] / some_chars,
        counts[33] / some_chars,
        n / max(len(lines), 1),
        float(max(map(len, words), default=0)),
    )
    return (n, chars, symbols, dup_lines, repeat, *map(float, features))


STATS_SCHEMA = ", ".join([f"{c} long" for c in COUNTS] + [f"{c} double" for c in FEATURES])


def statistics(text: Column) -> Column:
    """Base counts and features of a text column, as a struct."""

    @F.pandas_udf(STATS_SCHEMA)
    def measure(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([statistics_of(t) for t in texts], columns=[*COUNTS, *FEATURES])

    return measure(text.cast("binary"))


@dataclass
class Trees:
    """Node arrays of all trees: ``feature`` is -1 at a leaf, whose ``value`` is added; rows with a statistic at or
    below ``threshold`` go to ``left``, others to ``left + 1``."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root, dtype=np.int64)
            for _ in range(self.depth):
                f = self.feature[at]
                right = x[rows, np.maximum(f, 0)] > self.threshold[at]
                at = np.where(f < 0, at, self.left[at] + right)
            total += self.value[at]
        return total


def fit_trees(x: np.ndarray, y: np.ndarray, directions: list[int], rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, least: int = 8, l2: float = 1.0) -> Trees:
    """Boosted trees for the log odds of ``y`` (0 or 1); splits that break a direction are refused, and a node's
    children are bounded by the middle of a constrained split so that deeper leaves keep it too."""
    feature, threshold, left, value, roots = [], [], [], [], []
    positive = float(y.mean()) if len(y) else 1.0
    base = float(np.log(max(positive, 1e-3) / max(1 - positive, 1e-3)))
    if len(y) == 0 or positive in (0.0, 1.0):
        return Trees(np.array([-1]), np.zeros(1), np.zeros(1, dtype=np.int64), np.zeros(1), np.array([0]), 0, base)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    score = np.full(len(y), base)

    def leaf(g, h, low, high):
        return float(np.clip(-g / (h + l2), low, high))

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        roots.append(len(feature))
        feature.append(-1), threshold.append(0.0), left.append(0), value.append(0.0)
        todo = [(roots[-1], np.arange(len(y)), 0, -np.inf, np.inf)]
        while todo:
            node, rows, level, low, high = todo.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            value[node] = rate * leaf(gs, hs, low, high)
            best = (1e-6, None)
            if level < depth and len(rows) >= 2 * least:
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    b = binned[rows, f]
                    gl = np.cumsum(np.bincount(b, g[rows], len(e) + 1))[:-1]
                    hl = np.cumsum(np.bincount(b, h[rows], len(e) + 1))[:-1]
                    nl = np.cumsum(np.bincount(b, minlength=len(e) + 1))[:-1]
                    wl, wr = np.clip(-gl / (hl + l2), low, high), np.clip(-(gs - gl) / (hs - hl + l2), low, high)
                    gain = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
                    refused = (nl < least) | (len(rows) - nl < least) | ((wr - wl) * directions[f] < 0)
                    gain = np.where(refused, -np.inf, gain)
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (gain[k], (f, k, wl[k], wr[k]))
            if best[1] is None:
                score[rows] += value[node]
                continue
            f, k, wl, wr = best[1]
            feature[node], threshold[node], left[node] = f, float(edges[f][k]), len(feature)
            middle = (wl + wr) / 2
            bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[directions[f]]
            goes_right = binned[rows, f] > k
            for side, (a, b) in zip((rows[~goes_right], rows[goes_right]), bounds):
                todo.append((len(feature), side, level + 1, a, b))
                feature.append(-1), threshold.append(0.0), left.append(0), value.append(0.0)
    return Trees(np.array(feature), np.array(threshold), np.array(left), np.array(value), np.array(roots), depth, base)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAINING_ROWS) -> Trees:
    """Fit on at most ``rows`` labelled documents, the first by hash of their id."""
    labelled = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label"))
    chosen = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sample = texts.join(F.broadcast(chosen), "doc_id").select("label", statistics(F.col("text")).alias("s")).select("label", *[f"s.{c}" for c in FEATURES]).toPandas()
    sample = sample.sort_values(list(sample.columns), ignore_index=True)
    return fit_trees(sample[list(FEATURES)].to_numpy(dtype=float), sample["label"].to_numpy(dtype=float), list(FEATURES.values()))


def verdicts(text: Column, model: Trees, threshold: float = 0.5) -> Column:
    """A struct of the base counts, base_failed, score and kept for a text column."""
    cut = float(np.log(threshold / (1 - threshold)))

    @F.pandas_udf(", ".join([f"{c} long" for c in COUNTS] + ["base_failed boolean", "score double", "kept boolean"]))
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            stats = pd.DataFrame([statistics_of(t) for t in texts], columns=[*COUNTS, *FEATURES])
            odds = model.log_odds(stats[list(FEATURES)].to_numpy(dtype=float))
            failed = (stats["n_words"] < 10) | (100 * stats["n_repeat_words"] > 20 * stats["n_words"])
            yield stats[COUNTS].assign(base_failed=failed, score=1 / (1 + np.exp(-odds)), kept=~failed & (odds >= cut))

    return judge(text.cast("binary"))


def judge_documents(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, score, kept."""
    judged = docs.select(F.col(id_col).alias("doc_id"), verdicts(F.col(text_col), model).alias("v"))
    return judged.select("doc_id", "v.*")


def keep_good(docs: DataFrame, model: Trees, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text is kept; rows stay where they are, texts only visit Python."""
    return docs.where(verdicts(F.col(text_col), model).getField("kept"))
