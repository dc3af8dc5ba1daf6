"""Language-model scoring by logistic context mixing, with contexts that cross word borders.

A text is its words and one end. Reading it in order, every token is settled by the first of these that does:

1. *Passages.* Where a hash of the last four words says so (one place in ``2 ** ANCHOR_BITS``), the words up to the next
   such place form a passage. If training documents go on from these four words, a yes-or-no bit says whether the text goes
   on like one of them, and which one is coded by its share of their documents. Counts of passages are distributed
   and grow with the corpus; a training document is held out of its own.
2. *The text itself.* Where the last two words, or the last one, occurred before in the text, a bit says whether
   the same word follows again.
3. *Bytes.* Otherwise the word is spelt in bits. Its first byte (a space for the end) is predicted in contexts that
   cross the border: the previous word, the one before it, and the last two bytes. Its other bytes and closing space
   are predicted in contexts of the word so far (position, the last 1, 2, 3 and 5 bytes, all of it).

For every spelt bit, the hashed contexts look up counts. For bits after a word's first byte, their log odds are mixed with
weights chosen by a gate (bit number, longest context met before and how often), and the mixed probability is refined by an
adaptive map. For bits of a first byte, each context says how far its log odds are from those of all first bytes, held back by
as many imagined bits as suit all counts best, and fixed shares of that are added up. The
yes-or-no bits are refined alike by maps over their context, how often it was met and how it turned out before.
The sum is a text's log10 probability; ``bits_per_byte`` is it over the bytes of its words and borders.

Counts come from all training rows. The tables of the spelling grow with the number of distinct words up to
``MOST_BITS`` (what is sent to the tasks must fit in their memory); passage counts have no bound. The weights of the
spelling are learnt in every partition of the distinct words and averaged; what first bytes are held back by follows from
the counts of all training tokens, each left out of its own. Everything that tasks hand in is folded in a tree of tasks.
Bytes after a word's first depend on the word alone, so they are mixed once per distinct word.

Texts are read once: each task numbers the words and passages of a block of documents, and leaves the block's words,
passages and each document as numbers into them. Counts and scores come back per block, packed, and meet the documents there.

Null and empty texts are just the end; repeated rows count each (a repeated row is another document); a null id counts
as '' for the held-out rule; without training rows every spelt bit costs one bit; an empty table gives no rows. A text
or word of any length is scored whole. Only the id and text columns are read, so clashing names do not matter; ids of
any type come back as they are.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import materialise, shared_dir
from .words import learns

#: In-word contexts in bytes, 0 for the position alone, None for the whole word so far.
ORDERS = (0, 1, 2, 3, 5, None)
#: Size of the larger spelling tables as a power of two: distinct words over 8, within these bounds.
LEAST_BITS, MOST_BITS = 14, 20
#: Contexts of first bytes: none, the last two bytes, the word before the previous one, the previous word.
BORDER_BITS = 12
#: Shares of what the last two bytes, the word before the previous one and the previous word say, and the imagined bits tried.
BORDER_SHARES = (0.4, 0.7, 0.6)
IMAGINED = (0.1, 0.25, 0.5, 1, 2, 4, 8, 16, 32, 64, 128)
#: Tokens that ``train_borders`` learns on, the yardstick of tests; ``first_bytes`` takes no sample.
SAMPLE_UNITS = 40_000
#: How often a context was met, in levels; the gate is the bit number with the longest context met, its level and
#: whether it has seen one kind of bit only.
LEVELS = (1, 2, 4, 12, 60)
LEVEL_OF = np.searchsorted(LEVELS, np.arange(LEVELS[-1] + 1), side="right")
PRIOR = 0.4
#: Words of a block, bytes of documents read and scored together (a longer one is alone), and units that are mixed at a time.
BLOCK_WORDS, GROUP_BYTES, CHUNK_BYTES = 4_000_000, 3 << 20, 1 << 13
MAP_STEPS = 33
CHUNKS = 64
#: Rows of one partition of words or passages, and parts that one task folds.
PART_ROWS, FAN = 500_000, 16
ANCHOR_WORDS, ANCHOR_BITS = 4, 4
#: Numbers of the marks before words: nothing before a text, and its end.
START, END, SHIFT = 0, 1, 2
#: Cells of the yes-or-no bits: passages by level of the context and what came before; then words by order, times
#: met, last outcome there and whether the last word was foreseen.
PASSAGE_LEVELS = (1, 2, 3, 6, 21)
PASSAGE_CELLS, WORD_CELLS = 25, 36
CELLS = PASSAGE_CELLS + WORD_CELLS

_U = np.uint64
_STEP, _BACK = _U(0x9E3779B97F4A7C15), _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)


class Layout:
    """Count tables side by side, one per context: sizes as powers of two, where each begins, and the gates."""

    def __init__(self, bits: tuple[int, ...]):
        self.bits = bits
        self.offsets = np.concatenate(([0], np.cumsum([1 << b for b in bits])))
        self.places = 1 + 2 * len(bits) * len(LEVELS)
        self.gates = 8 * self.places

    @property
    def slots(self) -> int:
        return int(self.offsets[-1])

    def start_weights(self) -> np.ndarray:
        """Before learning, every context counts a little and longer ones more."""
        weights = np.zeros((self.gates, len(self.bits) + 1), dtype=np.float32)
        longest = np.arange(self.gates) % self.places
        weights[:, : len(self.bits)] = 0.05
        met = np.flatnonzero(longest)
        weights[met, (longest[met] - 1) // (2 * len(LEVELS))] = 0.8
        return weights


def word_layout(distinct: int) -> Layout:
    n = min(max(math.ceil(math.log2(max(distinct, 1))) - 3, LEAST_BITS), MOST_BITS)
    return Layout((12, min(n, 17), n, n, n, n))


BORDER_LAYOUT = Layout((8, BORDER_BITS + 8, BORDER_BITS + 8, BORDER_BITS + 8))


@dataclass
class Spelling:
    """The bytes of words after their first, each word closed by a space, with the contexts of every byte."""

    text: np.ndarray
    owner: np.ndarray
    contexts: list[np.ndarray]
    layout: Layout

    @staticmethod
    def of(words: list[bytes], layout: Layout) -> Spelling:
        text = np.frombuffer(b" ".join(words) + b" ", dtype=np.uint8)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
        owner = np.repeat(np.arange(len(words)), sizes)
        place = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        wide = text.astype(np.uint64) + _U(1)
        later = place > 0
        contexts = []
        for order in ORDERS:
            if order == 0:
                mixed = np.minimum(place, 3).astype(np.uint64)
            elif order is None:
                power = np.cumprod(np.full(int(sizes.max()), _STEP, dtype=np.uint64))
                summed = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(wide * power[place], dtype=np.uint64)))
                mixed = summed[:-1] - summed[np.arange(len(text)) - place]
            else:
                mixed = np.zeros(len(text), dtype=np.uint64)
                for back in range(1, order + 1):
                    earlier = np.zeros(len(text), dtype=np.uint64)
                    earlier[back:] = wide[:-back]
                    earlier[place < back] = _U(0)
                    mixed = mixed * _U(0x100000001B3) + earlier
            contexts.append((mixed[later] + _U(len(contexts) + 1)) * _U(0xD6E8FEB86659FD93))
        return Spelling(text[later], owner[later], contexts, layout)

    def bits(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[np.ndarray]]]:
        """For each of the 8 bit numbers: the bits, the bits of the byte before them (with a leading 1), and each
        context's slots."""
        for k in range(8):
            bit, node = _bit_and_node(self.text, k)
            salted = node.astype(np.uint64) * _U(0xA0761D6478BD642F)
            slots = [(((c ^ salted) * _U(0xE7037ED1A0B428DB)) >> _U(64 - b)).astype(np.int64) + o for c, b, o in zip(self.contexts, self.layout.bits, self.layout.offsets)]
            yield k, bit, node, slots


@dataclass
class Borders:
    """First bytes of words with the places of their contexts."""

    text: np.ndarray
    owner: np.ndarray
    places: list[np.ndarray]

    def bits(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[np.ndarray]]]:
        for k in range(8):
            bit, node = _bit_and_node(self.text, k)
            yield k, bit, node, [(p << 8) + node + o for p, o in zip(self.places, BORDER_LAYOUT.offsets)]


def _bit_and_node(text: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    node = (1 << k) | (text >> np.uint8(8 - k) if k else np.zeros(len(text), dtype=np.uint8)).astype(np.int64)
    return (text >> np.uint8(7 - k)) & np.uint8(1), node


def _pack_unit(previous: np.ndarray, before: np.ndarray, tail: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Contexts of a first byte and the byte itself as one number."""
    up = lambda x, n: x.astype(np.int64) << n
    return up(previous, 8 + 2 * BORDER_BITS) | up(before, 8 + BORDER_BITS) | up(tail, 8) | first.astype(np.int64)


def _borders_of(units: np.ndarray) -> Borders:
    ones = (1 << BORDER_BITS) - 1
    places = [np.zeros(len(units), dtype=np.int64)] + [(units >> (8 + n * BORDER_BITS)) & ones for n in range(3)]
    return Borders((units & 255).astype(np.uint8), np.arange(len(units)), places)


def chunked_words(words: list[bytes], weights: np.ndarray, layout: Layout) -> Iterator[tuple[Spelling, np.ndarray]]:
    """Spellings of about ``CHUNK_BYTES`` each, and the words' weights."""
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    cuts = np.unique(np.r_[0, np.searchsorted(ends, np.arange(CHUNK_BYTES, ends[-1], CHUNK_BYTES)), len(words)]) if len(words) else []
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield Spelling.of(words[a:b], layout), weights[a:b]


def chunked_units(units: np.ndarray) -> Iterator[tuple[Borders, np.ndarray]]:
    for low in range(0, len(units), CHUNK_BYTES):
        part = units[low : low + CHUNK_BYTES]
        yield _borders_of(part), np.ones(len(part))


def add_counts(tables: np.ndarray, chunks: Iterator[tuple[Spelling, np.ndarray]]):
    flat = tables.reshape(-1)
    for spelling, own in chunks:
        each = own[spelling.owner].astype(np.float64)
        for _, bit, _, slots in spelling.bits():
            for at in slots:
                np.add.at(flat, 2 * at + bit, each)


def border_tables(leaves: np.ndarray) -> np.ndarray:
    """Bit counts of all nodes from counts of whole first bytes: ``leaves`` has a row a place, the previous word's last."""
    every = np.concatenate((leaves[2 << BORDER_BITS :].sum(axis=0, keepdims=True), leaves)).astype(np.float64)
    tables = np.zeros((len(every), 256, 2), dtype=np.float32)
    current = every
    for k in range(7, -1, -1):
        tables[:, 1 << k : 2 << k, 0], tables[:, 1 << k : 2 << k, 1] = current[:, 0::2], current[:, 1::2]
        current = current[:, 0::2] + current[:, 1::2]
    return tables.reshape(-1, 2)


@dataclass
class FirstBytes:
    """Log odds of every bit of a first byte by place and node: those of all first bytes, then what each context adds."""

    says: np.ndarray

    def log10(self, chunks: Iterator[tuple[Borders, np.ndarray]]) -> np.ndarray:
        """log10 probability of each unit of the chunks."""
        out = []
        for units, own in chunks:
            total = np.zeros(len(own))
            for _, bit, _, slots in units.bits():
                z = sum(self.says[at] for at in slots)
                total -= np.logaddexp(0, np.where(bit == 1, -z, z))
            out.append(total / math.log(10))
        return np.concatenate(out) if out else np.empty(0)


def first_bytes(leaves: np.ndarray) -> FirstBytes:
    """The predictor of first bytes from counts over all training rows. A context's bits are held back by imagined bits that
    fall like those of all first bytes; their number is the one under which all training bits, each left out of its
    context's counts, are likeliest, for each context and bit number."""
    tables = border_tables(leaves.reshape(-1, 256)).astype(np.float64).reshape(-1, 256, 2)
    every = (tables[0] + PRIOR) / (tables[0] + PRIOR).sum(axis=1, keepdims=True)
    odds = np.log(every[:, 1]) - np.log(every[:, 0])
    says = np.zeros((len(tables), 256), dtype=np.float32)
    says[0] = odds
    for n, share in enumerate(BORDER_SHARES):
        places = slice(1 + (n << BORDER_BITS), 1 + ((n + 1) << BORDER_BITS))
        for k in range(8):
            nodes = slice(1 << k, 2 << k)
            counts, like = tables[places, nodes], every[nodes]
            others = np.maximum(counts.sum(axis=2, keepdims=True) - 1, 0)
            fit = lambda m: (counts * np.log((np.maximum(counts - 1, 0) + m * like) / (others + m))).sum()  # noqa: E731, B023
            held = counts + max(IMAGINED, key=fit) * like
            says[places, nodes] = share * (np.log(held[..., 1]) - np.log(held[..., 0]) - odds[nodes])
    return FirstBytes(says.reshape(-1))


@dataclass
class Evidence:
    """What each slot says: log odds of a 1, and how well it is known (0: never met, else by level and whether it has
    seen one kind of bit only). Worked out once a slot, so that looking up a context is one gather. With ``held_out``
    there are two entries a slot: without one 0, without one 1, for bits that take part in the counts themselves."""

    odds: np.ndarray
    place: np.ndarray
    held_out: bool

    @staticmethod
    def of(tables: np.ndarray, held_out: bool) -> Evidence:
        pairs = np.maximum(tables[:, None, :] - np.eye(2, dtype=np.float32), 0).reshape(-1, 2) if held_out else tables
        odds = np.log(pairs + np.float32(PRIOR))
        level = LEVEL_OF[np.minimum(pairs.sum(axis=1), LEVELS[-1]).astype(np.int64)]
        place = np.where(level > 0, 2 * level - 1 + (pairs.min(axis=1) == 0), 0).astype(np.int8)
        return Evidence(odds[:, 1] - odds[:, 0], place, held_out)


@dataclass
class Mixer:
    evidence: Evidence
    weights: np.ndarray
    layout: Layout
    refined: np.ndarray | None = None

    def __post_init__(self):
        if self.refined is not None:
            # the map as a line in the mixed chance of the bit: half of it, and half of what the counts make of it
            met = self.refined.sum(axis=2, keepdims=True) + 8
            self.slope = ((1 + 8 / met) / 2).astype(np.float32).reshape(-1)
            self.level = (self.refined / met / 2).astype(np.float32).reshape(-1)

    def inputs(self, k: int, bit: np.ndarray, slots: list[np.ndarray]):
        """Log odds by each context (and a constant), and the gate."""
        x = np.ones((len(slots) + 1, len(bit)), dtype=np.float32)
        longest = np.zeros(len(bit), dtype=np.int64)
        for n, slot in enumerate(slots):
            at = 2 * slot + bit if self.evidence.held_out else slot
            np.take(self.evidence.odds, at, out=x[n], mode="clip")
            place = self.evidence.place[at]
            np.copyto(longest, place + np.int64(2 * n * len(LEVELS)), where=place > 0)
        return x, k * self.layout.places + longest

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return np.clip(np.einsum("nk,kn->n", self.weights[gate], x), -16, 16)

    def chances(self, z: np.ndarray, node: np.ndarray, bit: np.ndarray) -> np.ndarray:
        """Refined chances of the bits that came."""
        p = 1 / (1 + np.exp(np.where(bit == 1, -z, z)))
        if self.refined is None:
            return p
        at = node * MAP_STEPS + _step(z)
        return self.slope[at] * p + self.level[2 * at + bit]

    def learn(self, chunks, rate: float = 0.03) -> int:
        """Online: after each chunk the weights of the gates met move against the coding error."""
        first, second = np.zeros_like(self.weights), np.zeros_like(self.weights)
        step = 0
        for spelling, own in chunks:
            each = own[spelling.owner] ** 0.75
            step += 1
            slope, seen = np.zeros_like(self.weights), np.zeros(self.layout.gates)
            for k, bit, _, slots in spelling.bits():
                x, gate = self.inputs(k, bit, slots)
                error = (1 / (1 + np.exp(-self.mixed(x, gate))) - bit) * each
                low, high = k * self.layout.places, (k + 1) * self.layout.places
                seen[low:high] += np.bincount(gate - low, each, self.layout.places)
                for n in range(len(x)):
                    slope[low:high, n] += np.bincount(gate - low, error * x[n], self.layout.places)
            met = seen > 0
            slope[met] /= seen[met, None]
            first = 0.9 * first + 0.1 * slope
            second = 0.99 * second + 0.01 * slope * slope
            self.weights -= (rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return step

    def outcomes(self, counts: np.ndarray, chunks):
        """Count how the bits turn out by node and mixed odds."""
        for spelling, own in chunks:
            each = own[spelling.owner].astype(np.float64)
            for k, bit, node, slots in spelling.bits():
                x, gate = self.inputs(k, bit, slots)
                low, size = (MAP_STEPS << k) * 2, (MAP_STEPS << k) * 2
                at = (node * MAP_STEPS + _step(self.mixed(x, gate))) * 2 + bit - low
                counts.reshape(-1)[low : low + size] += np.bincount(at, each, size)

    def log10(self, chunks) -> np.ndarray:
        """log10 probability of each word or unit of the chunks."""
        out = []
        for spelling, own in chunks:
            total = np.zeros(len(own))
            for k, bit, node, slots in spelling.bits():
                x, gate = self.inputs(k, bit, slots)
                total += np.bincount(spelling.owner, np.log10(self.chances(self.mixed(x, gate), node, bit)), len(own))
            out.append(total)
        return np.concatenate(out) if out else np.empty(0)


def _step(z: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(z * 1.5) + MAP_STEPS // 2, 0, MAP_STEPS - 1).astype(np.int64)


def no_outcomes() -> np.ndarray:
    return np.zeros((256, MAP_STEPS, 2))


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of equal length as all lowest bytes, then all next ones and so on, compressed: the high ones hardly vary."""
    planes = [np.ascontiguousarray(c.view(np.uint8).reshape(len(c), c.itemsize).T).tobytes() for c in columns]
    return pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def _unpack(packed: bytes, count: int, *kinds: type) -> list[np.ndarray]:
    sizes = [np.dtype(k).itemsize for k in kinds]
    raw = np.frombuffer(pa.decompress(packed, count * sum(sizes), codec="zstd", asbytes=True), dtype=np.uint8)
    columns, low = [], 0
    for size, kind in zip(sizes, kinds):
        columns.append(np.ascontiguousarray(raw[low : low + count * size].reshape(size, count).T).reshape(-1).view(kind))
        low += count * size
    return columns


class Numbers(dict):
    """Numbers keys in the order in which they are first met."""

    def __init__(self):
        super().__init__()
        self.listed = []

    def __missing__(self, key):
        number = self[key] = len(self.listed)
        self.listed.append(key)
        return number


def word_marks(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word: its hash, the first byte, the place of the word as a context, and that of its last two bytes."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes)
    begins = ends - sizes
    text = np.frombuffer(b"".join(words), dtype=np.uint8)
    place = np.arange(len(text)) - np.repeat(begins, sizes)
    power = np.cumprod(np.full(int(sizes.max(initial=1)), _STEP, dtype=np.uint64))
    summed = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum((text + _U(1)) * power[place], dtype=np.uint64)))
    hashes = _mix(summed[ends] - summed[begins])
    last = text[ends - 1].astype(np.uint64)
    tail = _mix(last << _U(8) | np.where(sizes > 1, text[np.maximum(ends - 2, 0)], 0).astype(np.uint64))
    # place 0 means that there is no such word
    as_place = lambda x: np.maximum(x >> _U(64 - BORDER_BITS), 1).astype(np.uint16)
    return hashes, text[begins], as_place(hashes), as_place(tail)


def lay_out(numbers: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents one after another, each with its end, as word numbers moved up by ``SHIFT``; and where each begins.
    ``numbers`` are those of all words, ``sizes`` the words of each document."""
    stops = np.cumsum(sizes + 1)
    tokens = np.full(int(sizes.sum()) + len(sizes), END, dtype=np.int64)
    inside = np.ones(len(tokens), dtype=bool)
    inside[stops - 1] = False
    tokens[inside] = numbers.astype(np.int64) + SHIFT
    return tokens, stops - sizes - 1


def before(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """What stands before each token of its document."""
    earlier = np.empty_like(tokens)
    earlier[1:] = tokens[:-1]
    earlier[starts] = START
    return earlier


def passages(tokens: np.ndarray, starts: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the anchors, and hashes of the words before each (the context) and of those with what follows up
    to and including the next anchor or the end. ``hashes`` is by token number."""
    value = hashes[tokens]
    context = np.zeros(len(tokens), dtype=np.uint64)
    back = value
    for _ in range(ANCHOR_WORDS):
        context = context * _U(0x100000001B3) + back
        back = np.concatenate((np.zeros(1, dtype=np.uint64), back[:-1]))
    context = _mix(context)
    sizes = np.diff(np.r_[starts, len(tokens)])
    place = np.arange(len(tokens)) - np.repeat(starts, sizes)
    at = np.flatnonzero((place >= ANCHOR_WORDS - 1) & (tokens != END) & (context >> _U(64 - ANCHOR_BITS) == 0))
    power = np.cumprod(np.full(len(tokens) + 1, _STEP, dtype=np.uint64))
    summed = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(value * power[:-1], dtype=np.uint64)))
    unpower = np.cumprod(np.full(len(tokens) + 1, _BACK, dtype=np.uint64))
    stop = passage_ends(at, tokens, starts)
    follows = _mix((summed[stop + 1] - summed[at + 1]) * unpower[at])
    return at, context[at], _mix(context[at] + follows * _U(3))


def passage_ends(at: np.ndarray, tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Last token of the passage behind each anchor: the next anchor of the document, or its end."""
    ends = np.r_[starts[1:], len(tokens)] - 1
    own_end = ends[np.searchsorted(starts, at, side="right") - 1]
    return np.minimum(np.r_[at[1:], len(tokens)], own_end) if len(at) else own_end


class Block:
    """What a task gathers of a block of documents, on demand with a sample of the units of first bytes."""

    def __init__(self, sampled: bool = True):
        self.sampled = sampled
        self.words, self.passages, self.size = Numbers(), Numbers(), 0
        self.train, self.documents = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 12, dtype=np.int64)
        self.first, self.whole, self.tail = np.array([32, 32], dtype=np.uint8), np.zeros(2, dtype=np.uint16), np.zeros(2, dtype=np.uint16)
        self.hashes, self.lengths = np.array([0, 1], dtype=np.uint64), np.zeros(2, dtype=np.int64)
        self.contexts: list[np.ndarray] = []
        self.leaves = np.zeros((3 << BORDER_BITS) * 256, dtype=np.uint32)
        self.units, self.ranks, self.limit = [], [], _U(0xFFFFFFFFFFFFFFFF)

    def add(self, texts: pa.Array, held: np.ndarray) -> tuple[np.ndarray, ...]:
        """Number the words and passages of documents. All words; words and bytes of each document; places of all passages in their
        documents, their numbers, and how many each document has."""
        numbers, sizes = self._number(texts)
        tokens, starts = lay_out(numbers, sizes)
        n_bytes = np.add.reduceat(self.lengths[tokens] + 1, starts)
        learning = np.repeat(~held, sizes + 1)
        self.train = _room(self.train, len(self.words))
        np.add.at(self.train, tokens[learning & (tokens != END)] - SHIFT, np.int64(1))
        self._count_borders(tokens, starts, learning)

        at, context, passage = passages(tokens, starts, self.hashes)
        known = len(self.passages)
        number = np.fromiter(map(self.passages.__getitem__, passage.view(np.int64).tolist()), dtype=np.uint32, count=len(at))
        owner = np.searchsorted(starts, at, side="right") - 1
        _, newest = np.unique(number, return_index=True)
        self.contexts.append(context[newest[number[newest] >= known]])
        self.documents = _room(self.documents, len(self.passages))
        once = np.unique((owner[learning[at]].astype(np.int64) << 32) | number[learning[at]])
        np.add.at(self.documents, once & 0xFFFFFFFF, np.int64(1))
        self.size += len(numbers)
        return numbers, sizes, n_bytes, (at - starts[owner]).astype(np.uint32), number, np.bincount(owner, minlength=len(sizes))

    def _number(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all words, and how many each text has. Arrow splits byte by byte, so it needs no valid UTF-8."""
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(pa.string())))
        coded = split.flatten().view(pa.binary()).dictionary_encode()
        distinct, blank = coded.dictionary.to_pylist(), pc.index(coded.dictionary, b"").as_py()
        if blank >= 0:  # white space at either end of a text
            del distinct[blank]
        known = len(self.words)
        number = np.fromiter(map(self.words.__getitem__, distinct), dtype=np.int64, count=len(distinct))
        number = np.insert(number, blank, -1) if blank >= 0 else number
        new = self.words.listed[known:]
        hashes, first, whole, tail = word_marks(new)
        self.first, self.whole, self.tail = np.r_[self.first, first], np.r_[self.whole, whole], np.r_[self.tail, tail]
        self.hashes, self.lengths = np.r_[self.hashes, hashes], np.r_[self.lengths, np.fromiter(map(len, new), dtype=np.int64, count=len(new))]
        every = number[coded.indices.to_numpy()]
        upto = np.concatenate(([0], np.cumsum(every >= 0)))
        borders = split.offsets.to_numpy() - split.offsets[0].as_py()
        return every[every >= 0].astype(np.uint32), upto[borders[1:]] - upto[borders[:-1]]

    def _count_borders(self, tokens, starts, learning):
        previous = before(tokens, starts)
        ahead = before(previous, starts)
        first = self.first[tokens]
        for n, place in enumerate((self.tail[previous], self.whole[ahead], self.whole[previous])):
            np.add.at(self.leaves, (((n << BORDER_BITS) + place[learning].astype(np.int64)) << 8) + first[learning], np.uint32(1))
        if not self.sampled:
            return
        units = _pack_unit(self.whole[previous], self.whole[ahead], self.tail[previous], first)[learning]
        # a sample of tokens by hash: the smallest hashes of blocks hold the smallest of all
        rank = _mix(self.hashes[tokens[learning]] + _U(5) * self.hashes[previous[learning]] + _U(7) * self.hashes[ahead[learning]] + np.arange(len(units), dtype=np.uint64))
        low = rank < self.limit
        self.units.append(units[low]), self.ranks.append(rank[low])
        if sum(map(len, self.units)) > 4 * SAMPLE_UNITS:
            self.units, self.ranks = ([x] for x in smallest(np.concatenate(self.units), np.concatenate(self.ranks)))
            self.limit = self.ranks[0].max()

    def sample(self) -> bytes:
        units, ranks = np.concatenate([np.empty(0, dtype=np.int64), *self.units]), np.concatenate([np.empty(0, dtype=np.uint64), *self.ranks])
        return join_sample(*smallest(units, ranks))


def smallest(units: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((units, ranks))[:SAMPLE_UNITS]
    return units[order], ranks[order]


def join_sample(units: np.ndarray, ranks: np.ndarray) -> bytes:
    return units.tobytes() + ranks.tobytes()


def split_sample(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    half = len(payload) // 2
    return np.frombuffer(payload[:half], dtype=np.int64), np.frombuffer(payload[half:], dtype=np.uint64)


def _room(counts: np.ndarray, size: int) -> np.ndarray:
    return counts if size <= len(counts) else np.concatenate((counts, np.zeros(max(len(counts), size), dtype=counts.dtype)))


def slices(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Texts in groups of about ``GROUP_BYTES``, each with its first row."""
    ends, low = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)), 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + GROUP_BYTES, side="right")))
        yield low, texts.slice(low, high - low)
        low = high


DOCUMENT, WORD, PASSAGE, LEAVES = range(4)


def encode_blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of four kinds per block. Documents: doc_id, held_out, place in the block (number), words (train), bytes (context)
    and passages (passage); the first of a group has the words and passages of all of it, packed. Words: the word, its number in
    the block and its count in the block's training documents. Passages: context, passage, number and training documents. Then one row
    of first-byte counts."""
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType
    schema = f"block long, kind int, doc_id {kind.simpleString()}, held_out boolean, number long, payload binary, train long, context long, passage long, marks binary"
    names = ["block", "kind", "doc_id", "held_out", "number", "payload", "train", "context", "passage", "marks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, turn, seen, block, doc_type = TaskContext.get().partitionId(), 0, 0, Block(sampled=False), None

        def rows(kind, n, **columns):
            given = {"block": pa.array(np.full(n, (task << 24) + turn)), "kind": pa.array(np.full(n, kind, dtype=np.int32)), **columns}
            types = {"doc_id": doc_type, "held_out": pa.bool_(), "payload": pa.binary(), "marks": pa.binary()}
            return pa.RecordBatch.from_arrays([given.get(c, pa.nulls(n, types.get(c, pa.int64()))) for c in names], names)

        def close():
            listed = block.words.listed
            for low in range(0, len(listed), 50_000):
                part = listed[low : low + 50_000]
                n = len(part)
                yield rows(WORD, n, number=pa.array(np.arange(low, low + n)), payload=pa.array(part, type=pa.binary()), train=pa.array(block.train[low : low + n]))
            n = len(block.passages)
            contexts = np.concatenate([np.empty(0, dtype=np.uint64), *block.contexts])
            yield rows(PASSAGE, n, number=pa.array(np.arange(n)), context=pa.array(contexts.view(np.int64)), passage=pa.array(block.passages.listed, type=pa.int64()), train=pa.array(block.documents[:n]))
            yield rows(LEAVES, 1, payload=pa.array([zlib.compress(block.leaves.astype(np.float64).tobytes(), 1)]))

        for batch in batches:
            doc_type = batch.schema.field(0).type
            for low, texts in slices(pc.fill_null(batch.column(1), b"")):
                part = batch.slice(low, len(texts))
                numbers, words, n_bytes, places, passage, found = block.add(texts, part.column(2).to_numpy(zero_copy_only=False))
                rest = [None] * (len(texts) - 1)
                yield rows(
                    DOCUMENT, len(texts), doc_id=part.column(0), held_out=part.column(2), number=pa.array(np.arange(seen, seen + len(texts))), train=pa.array(words), context=pa.array(n_bytes),
                    passage=pa.array(found), payload=pa.array([_pack(numbers), *rest], type=pa.binary()), marks=pa.array([_pack(places, passage), *rest], type=pa.binary()),
                )
                seen += len(texts)
                if block.size >= BLOCK_WORDS:
                    yield from close()
                    turn, seen, block = turn + 1, 0, Block(sampled=False)
        if doc_type is not None:
            yield from close()

    encoded = docs.select(F.col(id_col), F.col(text_col).cast("binary"), (~learns(F.col(id_col), 1)).alias("held_out")).mapInArrow(run, schema)
    path = f"{shared_dir(spark)}/skein-lm-blocks-{uuid.uuid4().hex}"
    encoded.write.partitionBy("kind").parquet(path)
    return spark.read.schema(encoded.schema).parquet(path)


def fold_tree(parts: DataFrame, fold: Callable[[list[bytes]], bytes], count: int) -> dict[int, bytes]:
    """Fold the payloads of stored ``parts`` (part, chunk, payload; ``count`` parts) by chunk, about ``FAN`` at a time, level by level on
    Spark; one payload a chunk comes to the driver."""
    schema = "part long, chunk long, payload binary"

    def one(key: tuple, rows: pa.Table) -> pa.Table:
        return pa.table({"part": [key[0].as_py()], "chunk": [key[1].as_py()], "payload": pa.array([fold(rows.column("payload").to_pylist())], type=pa.binary())})

    while count > 1:
        count = -(-count // FAN)
        parts = parts.groupBy(F.pmod(F.xxhash64("part"), F.lit(count)).alias("group"), "chunk").applyInArrow(one, schema)
        parts = materialise(parts, "lm-fold") if count > 1 else parts
    return {r["chunk"]: bytes(r["payload"]) for r in parts.select("chunk", "payload").collect()}


def add_floats(payloads: list[bytes]) -> bytes:
    """Sum of compressed arrays of doubles."""
    total = np.frombuffer(zlib.decompress(payloads[0])).copy()
    for p in payloads[1:]:
        total += np.frombuffer(zlib.decompress(p))
    return zlib.compress(total.tobytes(), 1)


def _of_blocks(rows: DataFrame) -> DataFrame:
    """One-row-a-block payloads as parts of one chunk."""
    return rows.select(F.col("block").alias("part"), F.lit(0).cast("long").alias("chunk"), "payload")


def _word_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            yield batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)


def _per_task(words: DataFrame, work: Callable[[Iterator[tuple[list[bytes], np.ndarray]]], list[np.ndarray]], name: str) -> dict[int, bytes]:
    """The sum of what every task makes of its words: one chunk an array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = work(_word_batches(batches))
        task, packed = TaskContext.get().partitionId(), [zlib.compress(np.asarray(a, dtype=np.float64).tobytes(), 1) for a in arrays]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(packed), task)), pa.array(np.arange(len(packed))), pa.array(packed, type=pa.binary())], ["part", "chunk", "payload"])

    parts = materialise(words.mapInArrow(run, "part long, chunk long, payload binary"), name)
    return fold_tree(parts, add_floats, parts.where("chunk = 0").count())


def _floats(payload: bytes | None, like: np.ndarray) -> np.ndarray:
    return np.frombuffer(zlib.decompress(payload)).reshape(like.shape) if payload else np.zeros(like.shape)


def train_spelling(words: DataFrame, layout: Layout) -> Mixer:
    """``words``: word (binary) and its count in the training rows, above 0."""
    spark = words.sparkSession
    chunk = layout.slots // CHUNKS + 1

    def count(batches):
        tables = np.zeros((layout.slots, 2))
        for listed, counts in batches:
            add_counts(tables, chunked_words(listed, counts, layout))
        return [tables[c * chunk : (c + 1) * chunk] for c in range(CHUNKS)]

    pieces = _per_task(words, count, "lm-bits")
    tables = np.concatenate([np.frombuffer(zlib.decompress(pieces[c])).astype(np.float32) for c in sorted(pieces)] or [np.zeros(2 * layout.slots, dtype=np.float32)]).reshape(-1, 2)
    sent = spark.sparkContext.broadcast(Evidence.of(tables, held_out=True))

    def learn(batches):
        mixer, steps = Mixer(sent.value, layout.start_weights(), layout), 0
        for listed, counts in batches:
            steps += mixer.learn(chunked_words(listed, counts, layout))
        return [np.r_[steps * mixer.weights.astype(np.float64).reshape(-1), steps]]

    learnt = _floats(_per_task(words, learn, "lm-weights").get(0), np.zeros(layout.start_weights().size + 1))
    weights = (learnt[:-1] / learnt[-1]).astype(np.float32).reshape(layout.start_weights().shape) if learnt[-1] else layout.start_weights()

    def observe(batches):
        mixer, counts = Mixer(sent.value, weights, layout), no_outcomes()
        for listed, own in batches:
            mixer.outcomes(counts, chunked_words(listed, own, layout))
        return [counts]

    refined = _floats(_per_task(words, observe, "lm-map").get(0), no_outcomes())
    sent.unpersist()
    return Mixer(Evidence.of(tables, held_out=False), weights, layout, refined)


def train_borders(leaves: np.ndarray, units: np.ndarray, epochs: int = 4) -> Mixer:
    """A predictor of first bytes whose weights are learnt on given units: the yardstick of ``first_bytes``, in no query."""
    tables = border_tables(leaves.reshape(-1, 256))
    learner = Mixer(Evidence.of(tables, held_out=True), BORDER_LAYOUT.start_weights(), BORDER_LAYOUT)
    for _ in range(epochs if len(units) else 0):
        learner.learn(chunked_units(units))
    refined = no_outcomes()
    learner.outcomes(refined, chunked_units(units))
    return Mixer(Evidence.of(tables, held_out=False), learner.weights, BORDER_LAYOUT, refined)


def _replies(rows: DataFrame, answer: Callable[[pa.Table], list[np.ndarray]], what: int) -> DataFrame:
    """Per block, packed: the numbers of ``rows`` (block, number and what ``answer`` reads) with their answers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def send():
            table = pa.Table.from_batches(held)
            block = table.column("block").to_numpy()
            columns = [table.column("number").to_numpy().astype(np.uint32), *answer(table)]
            order = np.argsort(block, kind="stable")
            cuts = np.flatnonzero(np.r_[True, block[order][1:] != block[order][:-1]])
            parts = [order[a:b] for a, b in zip(cuts, np.r_[cuts[1:], len(order)])]
            packed = [_pack(*[np.ascontiguousarray(c[p]) for c in columns]) for p in parts]
            return pa.RecordBatch.from_arrays(
                [pa.array(block[order][cuts]), pa.array(np.full(len(parts), what, dtype=np.int32)), pa.array([len(p) for p in parts], type=pa.int64()), pa.array(packed, type=pa.binary())],
                ["of_block", "what", "rows", "answers"],
            )

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= PART_ROWS // 2:
                yield send()
                held, size = [], 0
        if held:
            yield send()

    return rows.mapInArrow(run, "of_block long, what int, rows long, answers binary")


WORD_ANSWER = (np.uint32, np.int64, np.float32, np.uint8, np.uint16, np.uint16)
PASSAGE_ANSWER = (np.uint32, np.int64, np.int64)


def _gather(replies: pa.Table, what: int, kinds: tuple, marks: int) -> list[np.ndarray]:
    """Answers by number, behind ``marks`` empty places."""
    mine = [_unpack(a, n, *kinds) for w, n, a in zip(replies.column("what").to_pylist(), replies.column("rows").to_pylist(), replies.column("answers").to_pylist()) if w == what]
    size = marks + max((int(m[0].max()) + 1 for m in mine if len(m[0])), default=0)
    out = [np.zeros(size, dtype=k) for k in kinds[1:]]
    for number, *columns in mine:
        for column, values in zip(out, columns):
            column[number.astype(np.int64) + marks] = values
    return out


def passage_cells(count: np.ndarray, total: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each passage in order: is there a decision, does the text go on as known, and the cell of the decision."""
    exists, hit = total > 0, (total > 0) & (count > 0)
    outcome = np.where(exists, 1 + hit, 0)
    state = np.zeros(len(owner), dtype=np.int64)
    same = np.zeros(len(owner), dtype=bool)
    same[1:] = owner[1:] == owner[:-1]
    twice = np.zeros(len(owner), dtype=bool)
    twice[2:] = same[2:] & same[1:-1] & (outcome[:-2] == 2)
    earlier = np.zeros(len(owner), dtype=np.int64)
    earlier[1:] = outcome[:-1]
    state[same] = 1 + earlier[same]
    state[same & (earlier == 2) & twice] = 4
    level = np.searchsorted(PASSAGE_LEVELS, total, side="right") - 1
    return exists, hit, np.maximum(level, 0) * 5 + state


def earlier_alike(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each place: the last earlier place with the same key (or -1), how many there are, and the number of its key."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]] if len(keys) else np.empty(0, dtype=bool)
    group = np.cumsum(new) - 1
    begin = np.flatnonzero(new)
    earlier, times, number = (np.empty(len(keys), dtype=np.int64) for _ in range(3))
    earlier[order] = np.where(new, -1, np.r_[-1, order[:-1]])
    times[order] = np.arange(len(keys)) - begin[group]
    number[order] = group
    return earlier, times, number


def word_decisions(tokens: np.ndarray, starts: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray]:
    """For the last two words and for the last word: where a decision could be, whether the same word follows again, and
    the cell; then whether both foresee the same word."""
    sizes = np.diff(np.r_[starts, len(tokens)])
    owner = np.repeat(np.arange(len(starts)), sizes)
    previous = before(tokens, starts)
    ahead = before(previous, starts)
    earlier1, times1, number1 = earlier_alike((owner.astype(np.int64) << 32) | previous)
    earlier2, times2, _ = earlier_alike((number1 << 32) | ahead)
    found, guesses = [], []
    for earlier, times, able in ((earlier2, times2, ahead != START), (earlier1, times1, previous != START)):
        exists = able & (earlier >= 0)
        guess = np.where(exists, tokens[earlier], -1)
        hit = exists & (guess == tokens)
        last = np.where(exists & (times > 1), 1 + hit[earlier], 0)
        found.append((exists, hit, (np.minimum(np.maximum(times, 1), 3) - 1) * 3 + last))
        guesses.append(guess)
    foreseen = np.where(found[0][0], found[0][1], found[1][1])
    ok = np.zeros(len(tokens), dtype=np.int64)
    ok[1:] = foreseen[:-1]
    ok[starts] = 0
    cells = [(e, h, PASSAGE_CELLS + (n * 9 + c) * 2 + ok) for n, (e, h, c) in enumerate(found)]
    return cells, guesses[0] == guesses[1]


def tally(cells: np.ndarray, hits: np.ndarray, owner: np.ndarray, documents: int) -> np.ndarray:
    """Misses and hits by document and cell."""
    return np.bincount((owner * CELLS + cells) * 2 + hits, minlength=documents * CELLS * 2).reshape(documents, CELLS, 2)


class BlockScorer:
    """Scores the documents of a block, given the answers for its words and passages."""

    def __init__(self, borders: FirstBytes, replies: pa.Table, trained_docs: int, norm: float):
        self.borders, self.norm = borders, norm
        self.count, self.rest, self.first, self.whole, self.tail = _gather(replies, WORD, WORD_ANSWER, SHIFT)
        self.count[END], self.first[END] = trained_docs, 32
        self.passage_count, self.passage_total = _gather(replies, PASSAGE, PASSAGE_ANSWER, 0)

    def score(self, numbers: np.ndarray, sizes: np.ndarray, places: np.ndarray, number: np.ndarray, found: np.ndarray, held: np.ndarray):
        """Per document: known tokens, base score, spelt log10 probability, and the tally of its yes-or-no bits."""
        tokens, starts = lay_out(numbers, sizes)
        sizes = np.diff(np.r_[starts, len(tokens)])
        owner = np.repeat(np.arange(len(starts)), sizes)
        known = np.add.reduceat((self.count[tokens] > 0).astype(np.int64), starts)
        base = np.add.reduceat(np.log10(self.count[tokens] + 0.5) - self.norm, starts)

        of = np.repeat(np.arange(len(starts)), found)
        at = places.astype(np.int64) + starts[of]
        own = (~held[of]).astype(np.int64)
        count, total = np.maximum(self.passage_count[number] - own, 0), np.maximum(self.passage_total[number] - own, 0)
        exists, hit, cell = passage_cells(count, total, of)
        bits = tally(cell[exists], hit[exists].astype(np.int64), of[exists], len(starts))
        spelt = np.zeros(len(starts))
        spelt += np.bincount(of[hit], np.log10(count[hit] / total[hit]), len(starts))
        stop = passage_ends(at, tokens, starts)
        cover = np.zeros(len(tokens) + 1, dtype=np.int64)
        np.add.at(cover, at[hit] + 1, 1)
        np.add.at(cover, stop[hit] + 1, -1)
        open_ = np.cumsum(cover)[:-1] == 0

        (two, one), alike = word_decisions(tokens, starts)
        for n, (exists, hit, cell) in enumerate((two, one)):
            asked = open_ & exists
            if n:  # the second guess is only asked where the first was none or another word
                asked &= ~(alike & two[0])
            bits += tally(cell[asked], hit[asked].astype(np.int64), owner[asked], len(starts))
            open_ &= ~(asked & hit)

        previous = before(tokens, starts)
        ahead = before(previous, starts)
        units = _pack_unit(self.whole[previous[open_]], self.whole[ahead[open_]], self.tail[previous[open_]], self.first[tokens[open_]])
        distinct, place = np.unique(units, return_inverse=True)
        spelt += np.bincount(owner[open_], self.borders.log10(chunked_units(distinct))[place] + self.rest[tokens[open_]], len(starts))
        return known, base, spelt, bits


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    spark = docs.sparkSession
    blocks = encode_blocks(docs, id_col, text_col)
    in_block = blocks.where(F.col("kind") == WORD).select("block", F.col("payload").alias("word"), "number", "train")
    n_blocks = blocks.where(F.col("kind") == LEAVES).count()
    trained_docs = blocks.where((F.col("kind") == DOCUMENT) & ~F.col("held_out")).count()
    parts = 1 + in_block.count() // PART_ROWS
    same = W.partitionBy("word")
    counted = in_block.repartition(parts, "word").withColumns({"count": F.sum("train").over(same), "leads": F.row_number().over(same.orderBy("block")) == 1})
    words = materialise(counted.drop("train"), "lm-words")
    learning = words.where(F.col("leads") & (F.col("count") > 0)).select("word", "count")
    totals = learning.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    tokens, distinct = totals["n"] + trained_docs, totals["v"] + (trained_docs > 0)
    norm = float(np.log10(tokens + 0.5 * (distinct + 1)))

    spelling = spark.sparkContext.broadcast(train_spelling(learning, word_layout(totals["v"])))
    leaves = _floats(fold_tree(_of_blocks(blocks.where(F.col("kind") == LEAVES)), add_floats, n_blocks).get(0), np.zeros((3 << BORDER_BITS) * 256))
    borders = spark.sparkContext.broadcast(first_bytes(leaves))

    def spell(table: pa.Table) -> list[np.ndarray]:
        coded = table.column("word").combine_chunks().dictionary_encode()
        listed, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        mixer = spelling.value
        rest = mixer.log10(chunked_words(listed, np.ones(len(listed)), mixer.layout)).astype(np.float32)
        _, first, whole, tail = word_marks(listed)
        return [table.column("count").to_numpy(), rest[at], first[at], whole[at], tail[at]]

    going = blocks.where(F.col("kind") == PASSAGE).select("block", "number", "context", "passage", "train")
    known = going.repartition(1 + going.count() // PART_ROWS, "context")
    known = known.withColumn("count", F.sum("train").over(W.partitionBy("context", "passage"))).withColumn("total", F.sum("train").over(W.partitionBy("context")))
    replies = _replies(words.select("block", "number", "word", "count"), spell, WORD).unionByName(
        _replies(known.select("block", "number", "count", "total"), lambda t: [t.column("count").to_numpy(), t.column("total").to_numpy()], PASSAGE)
    )

    def total(listed: pa.Table, answers: pa.Table) -> pa.Table:
        scorer = BlockScorer(borders.value, answers, trained_docs, norm)
        listed = listed.sort_by("number")
        column = lambda name: listed.column(name).to_numpy()
        held, words, found = column("held_out"), column("train"), column("passage")
        heads = np.r_[np.flatnonzero(listed.column("payload").is_valid().to_numpy()), len(words)]
        known, base, spelt, bits = [], [], [], []
        for a, b in zip(heads[:-1].tolist(), heads[1:].tolist()):
            numbers = _unpack(listed.column("payload")[a].as_py(), int(words[a:b].sum()), np.uint32)[0]
            places, passage = _unpack(listed.column("marks")[a].as_py(), int(found[a:b].sum()), np.uint32, np.uint32)
            for out, part in zip((known, base, spelt, bits), scorer.score(numbers, words[a:b], places, passage, found[a:b], held[a:b])):
                out.append(part)
        gathered = np.concatenate(bits)[~held].sum(axis=0)
        none = pa.nulls(1, listed.column("doc_id").type)
        tallies = [x.tobytes() for part in bits for x in part.astype(np.uint32)]
        return pa.table(
            {
                "doc_id": pa.chunked_array([*listed.column("doc_id").chunks, none], type=none.type),
                "held_out": np.r_[held, False],
                "n_tokens": np.r_[words + 1, 0],
                "n_known": np.r_[np.concatenate(known), 0],
                "base_score": np.r_[np.concatenate(base), 0],
                "spelt": np.r_[np.concatenate(spelt), 0],
                "n_bytes": np.r_[column("context"), 0],
                "bits": pa.array([*tallies, zlib.compress(gathered.astype(np.float64).tobytes(), 1)], type=pa.binary()),
                # the last row holds what the block's training documents say of the yes-or-no bits
                "block": np.r_[np.full(len(words), -1), listed.column("block")[0].as_py()],
            }
        )

    kind = docs.schema[id_col].dataType.simpleString()
    texts = blocks.where(F.col("kind") == DOCUMENT).select("block", "doc_id", "held_out", "number", "payload", "train", "marks", "context", "passage")
    spread = max(n_blocks, 1)
    met = texts.repartition(spread, "block").groupBy("block").cogroup(replies.repartition(spread, "of_block").groupBy("of_block"))
    scored = materialise(met.applyInArrow(total, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, spelt double, n_bytes long, bits binary, block long"), "lm-scored")

    said = _floats(fold_tree(_of_blocks(scored.where("block >= 0").withColumnRenamed("bits", "payload")), add_floats, n_blocks).get(0), np.zeros((CELLS, 2)))
    chances = np.log10((said + 0.5) / (said.sum(axis=1, keepdims=True) + 1))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.frombuffer(b"".join(batch.column("bits").to_pylist()), dtype=np.uint32).reshape(-1, 2 * CELLS)
            score = batch.column("spelt").to_numpy() + bits @ chances.reshape(-1)
            bpb = -score / np.log10(2) / batch.column("n_bytes").to_numpy()
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score")], pa.array(score), pa.array(bpb)], out)

    out = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]
    rows = scored.where("block < 0").withColumn("train_tokens", F.lit(tokens).cast("long"))
    return rows.mapInArrow(settle, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")
