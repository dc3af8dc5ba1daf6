r"""Secret scans: base rules plus a character convolutional network over every candidate.

Base rules find assignments, access keys and long hexadecimal runs, leftmost and non-overlapping per kind; their
spans always stay. Candidates are all base spans and every other token-like run of 8 or more characters that is not a
plain word (letters in one case, first letter aside, under 16 of them, a full stop or hyphen behind). The network reads each
candidate with its surrounding characters (candidates longer than its view in overlapping views, the best of which
counts) and gives each a calibrated probability; a candidate outside the base spans is added as kind ``model`` where it
reaches the threshold of the candidate's class. It is trained in numpy on labelled findings: all those of ``documents``
(base spans are secrets, other candidates are none) and a seeded set of further notations. A start is fitted on findings
chosen by hash; where documents have more, every one of them takes part in the rounds that follow: shards of findings each
go on from the common weights, and the weights are averaged. Base spans, other candidates and the seeded set keep the
weights that they have in the start. One document in five is held out; over all of these, probabilities are calibrated
and thresholds are the largest that keep the wanted recall, but no higher than ``CEILING``.

Null and empty texts have no spans; offsets are code points, end exclusive; a model span may reach beyond a base span
that it overlaps, but lies inside none; repeated rows are scanned each; ids of any type come back as they are; other
columns are not read, so names cannot clash; an empty table gives no rows. Whole texts are scanned.
"""

from __future__ import annotations

import bisect
import itertools
import random
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialise

# Fixed values of the base rules.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ("assign", "access", "hex", "model")

_IN_RUN = r"A-Za-z0-9+/_=.\-"
RUN = re.compile(rf"(?<![{_IN_RUN}])(?![A-Z]?[a-z]{{0,14}}[.\-]?(?![{_IN_RUN}]))[{_IN_RUN}]{{8,}}")

#: Characters of a view: context before, candidate, context after.
BEFORE, INSIDE, AFTER = 24, 48, 12
VIEW = BEFORE + INSIDE + AFTER
STRIDE = 32
CLASSES = ("hex", "upper", "mixed")
#: Share of held-out secrets that a class's threshold must keep, and its highest value: findings that separate
#: perfectly would else push it to 1, where unseen notations fail.
RECALL, CEILING = 0.95, 0.8
#: Findings of documents of each kind that the start is fitted on, chosen by hash; also the weight of all findings of the kind.
SAMPLE = 2000
#: Findings of a shard, rounds over all shards and their rate, and the unit that weights and log odds are rounded to, so that
#: sums do not depend on their order.
SHARD, ROUNDS, RATE = 32_000, 2, 0.003
WEIGHT_UNIT, ODDS_UNIT = 2.0**-32, 2.0**-7

#: text, start, end, label, and what findings are held out by (a document)
Finding = tuple[str, int, int, int, str]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base findings of a text, sorted."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    for start, word in long_words(text, LEAST["hex"]):
        found += [(start + m.start(), 2, start + m.end()) for m in HEX.finditer(word) if m.end() - m.start() >= LEAST["hex"]]
    return sorted(found)


def long_words(text: str, least: int) -> Iterator[tuple[int, str]]:
    """Position and text of the words of at least ``least`` characters. Words are found in order, and a long word
    can only occur inside a long word, so the next occurrence of each is its own."""
    at = 0
    for word in text.split():
        if len(word) >= least:
            at = text.index(word, at)
            yield at, word
            at += len(word)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Token-like runs that lie in no base span (``base`` is sorted)."""
    starts, reach = [a for a, _, _ in base], list(itertools.accumulate((b for _, _, b in base), max))
    found = []
    for m in RUN.finditer(text):
        before = bisect.bisect_right(starts, m.start())
        if not before or reach[before - 1] < m.end():
            found.append(m.span())
    return found


def class_of(run: str) -> int:
    if all(c in "0123456789abcdef-" for c in run):
        return 0
    return 1 if run.upper() == run else 2


def _views(text: str, start: int, end: int) -> np.ndarray:
    """Views of a candidate: a row of codes each, 0 for no character, 1 to 128 for ASCII and 129 for others, plus
    130 inside the candidate."""
    rows = []
    for at in range(start, max(start + 1, end - (INSIDE - STRIDE)), STRIDE):
        low = at - BEFORE
        codes = np.zeros(VIEW, dtype=np.int16)
        part = text[max(low, 0) : at + INSIDE + AFTER]
        points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        points = np.where(points < 128, points + 1, 129).astype(np.int16)
        begin = max(-low, 0)
        codes[begin : begin + len(points)] = points
        stop = min(end - low, BEFORE + INSIDE)
        codes[BEFORE:stop] += 130
        rows.append(codes)
    return np.stack(rows)


def seeded_findings(count: int = 8000, seed: int = 7) -> list[Finding]:
    """Seeded findings: random keys in many notations, and long tokens that are none."""
    rng = random.Random(seed)
    letters, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"

    def pick(alphabet, low, high):
        return "".join(rng.choice(alphabet) for _ in range(rng.randint(low, high)))

    def word():
        return pick(letters, 2, 9)

    def secret():
        kind = rng.randrange(7)
        if kind == 0:
            return pick(digits + "abcdef", 20, 31)
        if kind == 1:
            return pick(letters + upper + digits + "+/", 22, 64) + "=" * rng.randint(0, 2)
        if kind == 2:
            return rng.choice(["ghp_", "gho_", "xoxb-", "sk_live_", "pk-", "glpat-"]) + pick(letters + upper + digits, 20, 40)
        if kind == 3:
            return "eyJ" + pick(letters + upper + digits + "_-", 16, 30) + "." + pick(letters + upper + digits + "_-", 20, 40)
        if kind == 4:
            return pick(upper + digits, 20, 32)
        return pick(letters + upper + digits, 12, 44)

    def decoy():
        kind = rng.randrange(15)
        if kind == 0:
            return f"{word()}.{rng.randint(1, 999)}-mail{rng.randint(1, 9)}.example.com"
        if kind == 1:
            return f"mail{rng.randint(1, 99)}.{word()}.{rng.choice(['com', 'org', 'net'])}"
        if kind == 2:
            return f"20{rng.randint(10, 29)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{rng.randint(10, 23)}.{rng.randint(10, 59)}.000Z"
        if kind == 3:
            return "/".join(word() for _ in range(rng.randint(3, 6))) + f"{rng.randint(1, 99)}.{rng.choice(['py', 'html', 'java', 'txt'])}"
        if kind == 4:
            return "-".join(word() for _ in range(rng.randint(3, 6))) + f"-{rng.randint(1, 2000)}"
        if kind == 5:
            return "_".join(word() for _ in range(rng.randint(3, 5))) + f"_v{rng.randint(1, 30)}"
        if kind == 6:
            return f"v{rng.randint(0, 20)}.{rng.randint(0, 30)}.{rng.randint(0, 30)}-{word()}.{rng.randint(1, 9)}"
        if kind == 7:
            return word() + word() + word() + word() + str(rng.randint(1, 99))
        if kind == 8:
            return f"20{rng.randint(0, 29):02d}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}" + rng.choice(["", "T", f"T{rng.randint(0, 23):02d}", f"T{rng.randint(0, 23):02d}"])
        if kind == 9:
            return rng.choice(["", "/", "//www.", f"//{word()}.{rng.choice(['com', 'org', 'net'])}/"]) + "/".join(pick(letters, 1, 9) for _ in range(rng.randint(2, 6))) + rng.choice(["", "/", ".html", ".php", ".txt"])
        if kind == 10:
            return "-".join(word() for _ in range(rng.randint(2, 5)))
        if kind == 11:
            return pick(upper, 8, 14) + rng.choice(["", ".", "-"])
        if kind == 12:
            return ".".join(str(rng.randint(0, 255)) for _ in range(4))
        if kind == 13:
            return rng.choice([pick(digits, 8, 16), "=" * rng.randint(8, 40), "-" * rng.randint(8, 40), "." * rng.randint(8, 20), pick(letters, 16, 22)])
        return "-".join([pick(digits, 4, 4), word()] + [pick(digits, 3, 4) for _ in range(3)])

    found = []
    marks = ["key=", "key: ", "Bearer ", "auth = '", "credential ", "-H X-Key:", "", "", "", ""]
    plain = ["see ", "file ", "on ", "version ", "", "", "", "", "(", "at "]
    for n in range(count):
        label = n % 2
        run, lead = (secret(), rng.choice(marks)) if label else (decoy(), rng.choice(plain))
        head = " ".join(word() for _ in range(rng.randint(0, 6))) + " " + lead
        found.append((head + run + rng.choice([" ", ".", ", ", "\n", "", "'", ":", ":11:12"]) + " ".join(word() for _ in range(3)), len(head), len(head) + len(run), label, f"seeded {n}"))
    return found


def all_findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The base spans and other candidates of all documents, each as the text around it that a view holds; stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, text, spread in zip(*(batch.column(c).to_pylist() for c in ("name", "text", "spread"))):
                base = base_spans(text or "")
                found = [(a, b, 1) for a, _, b in base] + [(a, b, 0) for a, b in candidates(text or "", base)]
                for n, (a, b, label) in enumerate(found):
                    low = max(a - BEFORE, 0)
                    rows.append((zlib.crc32(f"{spread} {n}".encode()), text[low : a + INSIDE + AFTER], a - low, min(b, a + INSIDE + AFTER) - low, label, name, is_held_out(name)))
                if len(rows) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), kinds)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), kinds)], names)

    names = ["rank", "text", "start", "stop", "label", "name", "held"]
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    found = docs.select(name.alias("name"), F.col(text_col).alias("text"), F.xxhash64(name, F.col(text_col)).alias("spread"))
    return materialise(found.mapInArrow(run, "rank long, text string, start long, stop long, label long, name string, held boolean"), "findings")


def smallest_findings(found: DataFrame, sample: int = SAMPLE) -> list[Finding]:
    """At most ``sample`` base spans and ``sample`` other candidates of ``all_findings``, those with the smallest hashes."""
    smallest = [found.where(F.col("label") == label).orderBy("rank", "name", "text", "start").limit(sample).collect() for label in (0, 1)]
    return [(r.text, r.start, r.stop, r.label, r.name) for part in smallest for r in part]


def document_findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> list[Finding]:
    """The findings of documents that a start is fitted on."""
    return smallest_findings(all_findings(docs, id_col, text_col), sample)


def is_held_out(group: str) -> bool:
    return zlib.crc32(group.encode()) % 5 == 0


@dataclass
class CharNet:
    """Embedding, one convolution of width 5, maximum over the view, one dense layer; thresholds by class."""

    weights: dict[str, np.ndarray]
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: dict[int, float] = field(default_factory=dict)

    def logits(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(codes[i : i + 256])[0] for i in range(0, len(codes), 256)]) if len(codes) else np.empty(0)

    def probabilities(self, codes: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-(a * self.logits(codes) + b)))

    def _forward(self, codes: np.ndarray):
        w = self.weights
        x = w["embed"][codes]
        wide = np.lib.stride_tricks.sliding_window_view(x, WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(len(x), -1, WIDTH * x.shape[2])
        conv = np.maximum(wide @ w["conv"] + w["conv_b"], 0)
        top = conv.argmax(axis=1)
        pooled = np.concatenate((np.take_along_axis(conv, top[:, None, :], 1)[:, 0], conv.mean(axis=1)), axis=1)
        hidden = np.maximum(pooled @ w["dense"] + w["dense_b"], 0)
        return hidden @ w["out"] + w["out_b"][0], (wide, conv, top, pooled, hidden)

    def gradients(self, codes: np.ndarray, y: np.ndarray, share: np.ndarray | None = None) -> dict[str, np.ndarray]:
        w = self.weights
        share = np.full(len(y), 1 / len(y)) if share is None else share
        z, (wide, conv, top, pooled, hidden) = self._forward(codes)
        dz = (1 / (1 + np.exp(-z)) - y) * share
        g = {"out": hidden.T @ dz, "out_b": np.array([dz.sum()])}
        dh = np.outer(dz, w["out"]) * (hidden > 0)
        g["dense"], g["dense_b"] = pooled.T @ dh, dh.sum(axis=0)
        dp = dh @ w["dense"].T
        filters = conv.shape[2]
        dc = np.repeat(dp[:, None, filters:] / conv.shape[1], conv.shape[1], axis=1)
        np.put_along_axis(dc, top[:, None, :], np.take_along_axis(dc, top[:, None, :], 1) + dp[:, None, :filters], 1)
        dc *= conv > 0
        g["conv"], g["conv_b"] = np.tensordot(wide, dc, axes=([0, 1], [0, 1])), dc.sum(axis=(0, 1))
        dw = (dc @ w["conv"].T).reshape(len(codes), conv.shape[1], WIDTH, -1)
        dx = np.zeros((len(codes), VIEW, dw.shape[3]))
        for k in range(WIDTH):
            dx[:, k : k + conv.shape[1]] += dw[:, :, k]
        g["embed"] = np.zeros_like(w["embed"])
        np.add.at(g["embed"], codes, dx)
        return g


WIDTH, DIM, FILTERS, HIDDEN = 5, 8, 24, 16


def train(findings: list[Finding], epochs: int = 6, seed: int = 3) -> CharNet:
    """Fit on four fifths of the findings; calibrate probabilities and set thresholds on the rest."""
    rng = np.random.default_rng(seed)
    codes = np.concatenate([_views(t, a, b)[:1] for t, a, b, _, _ in findings])
    labels = np.array([f[3] for f in findings], dtype=float)
    classes = np.array([class_of(t[a:b]) for t, a, b, _, _ in findings])
    held = np.array([is_held_out(f[4]) for f in findings])
    net = CharNet(
        {
            "embed": rng.normal(0, 0.3, (260, DIM)),
            "conv": rng.normal(0, 1 / np.sqrt(WIDTH * DIM), (WIDTH * DIM, FILTERS)),
            "conv_b": np.zeros(FILTERS),
            "dense": rng.normal(0, 1 / np.sqrt(2 * FILTERS), (2 * FILTERS, HIDDEN)),
            "dense_b": np.zeros(HIDDEN),
            "out": rng.normal(0, 0.2, HIDDEN),
            "out_b": np.zeros(1),
        }
    )
    x, y = codes[~held], labels[~held]
    _descend(net, x, y, np.ones(len(y)), epochs, 0.01, rng)
    _calibrate(net, net.logits(codes[held]), labels[held], classes[held], np.ones(held.sum()))
    return net


def _descend(net: CharNet, x: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int, rate: float, rng: np.random.Generator) -> None:
    """Steps of Adam over the views, in an order drawn from ``rng``; a view counts by its weight."""
    first = {k: np.zeros_like(v) for k, v in net.weights.items()}
    second = {k: np.zeros_like(v) for k, v in net.weights.items()}
    step, mean = 0, weight.mean() if len(weight) else 1.0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for low in range(0, len(x), 64):
            rows, step = order[low : low + 64], step + 1
            for k, g in net.gradients(x[rows], y[rows], weight[rows] / (mean * len(rows))).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                net.weights[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)


def _calibrate(net: CharNet, z: np.ndarray, t: np.ndarray, classes: np.ndarray, weight: np.ndarray) -> None:
    """Scale and thresholds from held-out log odds, their labels and classes; each counts by its weight."""
    a, b = 1.0, 0.0
    for _ in range(200):  # Platt scaling by gradient steps, with a little decay against separable data
        p = 1 / (1 + np.exp(-(a * z + b)))
        off = (p - t) * weight / weight.sum()
        a, b = a - 0.05 * ((off * z).sum() + 0.01 * (a - 1)), b - 0.05 * off.sum()
    net.scale = (float(a), float(b))
    p = 1 / (1 + np.exp(-(a * z + b)))
    for c in range(len(CLASSES)):
        mine = (classes == c) & (t == 1)
        order = np.argsort(p[mine], kind="stable")
        true, reached = p[mine][order], np.cumsum(weight[mine][order])
        net.thresholds[c] = float(min(true[np.searchsorted(reached, (1 - RECALL) * reached[-1], side="right")], CEILING)) if len(true) else CEILING


def fit(docs: DataFrame, seeded: list[Finding], id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> CharNet:
    """The network of all findings of documents and the seeded ones."""
    found = all_findings(docs, id_col, text_col)
    net = train(smallest_findings(found, sample) + seeded)
    count = {(r.label, r.held): r["count"] for r in found.groupBy("label", "held").count().collect()}
    of_label = {label: count.get((label, False), 0) + count.get((label, True), 0) for label in (0, 1)}
    if max(of_label.values()) <= sample:
        return net  # the start has seen all of them
    share = {label: min(1.0, sample / max(n, 1)) for label, n in of_label.items()}
    shards = max(1, round((count.get((0, False), 0) + count.get((1, False), 0)) / SHARD))
    rows = found.where(~F.col("held")).withColumn("shard", F.pmod(F.xxhash64("rank", "name", "text", "start"), F.lit(shards)))
    kept = [f for f in seeded if not is_held_out(f[4])]
    for turn in range(ROUNDS):
        sums = rows.groupBy("shard").applyInPandas(_shard_steps(net, kept, share, shards, turn), "at long, total long").groupBy("at").agg(F.sum("total").alias("total"), F.count(F.lit(1)).alias("shards"))
        flat = np.array([r.total / r.shards for r in sums.orderBy("at").collect()]) * WEIGHT_UNIT
        net = CharNet(_unflatten(flat, net.weights))
    held = [(*key, n, share[key[1]]) for key, n in _held_odds(net, found).items()]
    apart = [f for f in seeded if is_held_out(f[4])]
    odds = net.logits(np.concatenate([_views(t, a, b)[:1] for t, a, b, _, _ in apart])) if apart else []
    held += [(class_of(f[0][f[1] : f[2]]), f[3], z, 1, 1.0) for f, z in zip(apart, odds)]
    classes, labels, z, n, each = (np.array(c, dtype=float) for c in zip(*held))
    _calibrate(net, z, labels, classes, n * each)
    return net


def _unflatten(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    ends = np.cumsum([v.size for v in like.values()])
    return {k: part.reshape(v.shape) for (k, v), part in zip(like.items(), np.split(flat, ends[:-1]))}


def _shard_steps(net: CharNet, seeded: list[Finding], share: dict[int, float], shards: int, turn: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """From the rows of a shard to the weights after an epoch over them and the seeded findings, in units."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["rank", "name", "text", "start", "stop", "label"])
        findings = [*zip(rows["text"], rows["start"], rows["stop"], rows["label"]), *(f[:4] for f in seeded)]
        weight = np.concatenate((rows["label"].map(share).to_numpy(float) * shards, np.ones(len(seeded))))
        own = CharNet({k: v.copy() for k, v in net.weights.items()})
        codes = np.concatenate([_views(t, a, b)[:1] for t, a, b, _ in findings])
        _descend(own, codes, np.array([f[3] for f in findings], dtype=float), weight, 1, RATE, np.random.default_rng([int(rows["shard"].iloc[0]), turn]))
        flat = np.concatenate([v.ravel() for v in own.weights.values()])
        return pd.DataFrame({"at": np.arange(len(flat)), "total": np.rint(flat / WEIGHT_UNIT).astype(np.int64)})

    return run


def _held_odds(net: CharNet, found: DataFrame) -> dict[tuple[int, int, float], int]:
    """How many held-out findings of documents have each class, label and log odds, these rounded down to units: a table whose
    size does not grow with the documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            places = list(zip(rows["text"], rows["start"], rows["stop"]))
            if places:
                odds = net.logits(np.concatenate([_views(t, a, b)[:1] for t, a, b in places]))
                yield pd.DataFrame({"class": [class_of(t[a:b]) for t, a, b in places], "label": rows["label"], "bin": np.floor(odds / ODDS_UNIT).astype(np.int64)})

    held = found.where("held").select("text", "start", "stop", "label").mapInPandas(run, "class long, label long, bin long")
    return {(r["class"], r.label, r.bin * ODDS_UNIT): r["count"] for r in held.groupBy("class", "label", "bin").count().orderBy("class", "label", "bin").collect()}


def scan(texts: list[str], net: CharNet) -> list[list[tuple[int, int, int, float]]]:
    """All spans (start, kind number, end, probability) of each text, sorted."""
    places, views = [], []
    for n, text in enumerate(texts):
        base = base_spans(text)
        for a, kind, b in [*base, *((a, 3, b) for a, b in candidates(text, base))]:
            rows = _views(text, a, b)
            places.append((n, a, kind, b, len(rows)))
            views.append(rows)
    found: list[list] = [[] for _ in texts]
    for low in range(0, len(places), 512):
        chances = net.probabilities(np.concatenate(views[low : low + 512]))
        at = 0
        for n, a, kind, b, rows in places[low : low + 512]:
            best = float(chances[at : at + rows].max())
            if kind < 3 or best >= net.thresholds[class_of(texts[n][a:b])]:
                found[n].append((a, kind, b, best))
            at += rows
    return [sorted(f) for f in found]


def find_secrets(docs: DataFrame, net: CharNet, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id and findings, an array of struct<kind, start, stop, score>, sorted."""

    @F.pandas_udf("array<struct<kind: string, start: long, stop: long, score: double>>")
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            listed = [t or "" for t in texts]
            all_found = [f for low in range(0, len(listed), 256) for f in scan(listed[low : low + 256], net)]
            yield pd.Series([[{"kind": KINDS[k], "start": a, "stop": b, "score": p} for a, k, b, p in found] for found in all_found])

    return docs.select(F.col(id_col).alias("doc_id"), spans(F.col(text_col)).alias("findings"))


def spans_text(findings: Column) -> Column:
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["stop"].cast("string"))), ",")
