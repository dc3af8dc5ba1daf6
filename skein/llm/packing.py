"""Packing documents into fixed windows of tokens by best-fit decreasing.

A document's tokens are cut into full windows first; what is left (or a short document) is one piece. Pieces are
numbered where they are stored and dealt by their number into blocks of bounded size, whatever their documents; each
block is packed on its own: pieces in decreasing length, each into the tightest open window that still holds it,
found in a segment tree indexed by remaining capacity. Token ids never move between tasks: their digest, or the ids
themselves where asked for, are made where the text is read. White space separates tokens of the vocabulary, so a
task encodes each distinct word once.

Defined results: null text is empty (just the end token); ids of any type, null among them, come back as they are;
repeated rows give repeated pieces; pieces of equal length keep the order of their numbers; a text of any length is
encoded whole, alone in its group; other columns are not read, so their names cannot clash; empty tables give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialise
from .workers import giving_back

NUMBER = "piece_number"

#: Pieces packed together on average; a task holds one block.
BLOCK = 8192
#: Distinct words whose ids a Python worker keeps; beyond that it forgets them and goes on.
CACHED_WORDS = 700_000
#: Bytes of text encoded together (a longer document is a block of its own), and new words per call of the tokenizer.
BLOCK_BYTES, CALL_WORDS = 4 << 20, 4096


class WordEncoder:
    """Token ids of whole texts from a tokenizers file whose pre-tokens never cross ASCII white space.

    A block of texts is split and its words are numbered by Arrow; only words not met before visit the tokenizer, many
    in one call, parted by a special token of the vocabulary.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.separator = next(((i, t.content) for i, t in added.items() if t.special), None)
        self.added = [t.content for t in added.values()]
        normalizer = self.tokenizer.normalizer
        self.lowers = normalizer is not None and normalizer.normalize_str("Az") == "az"
        self.forget()

    def forget(self):
        self.known: dict[bytes, int] = {}
        self.ids = np.empty(1 << 16, dtype=np.uint32)
        self.starts = np.zeros(1 << 16, dtype=np.int64)

    def _ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after another, and the number of ids of each."""
        if self.separator:
            mark, text = self.separator
            ids = np.array(self.tokenizer.encode_batch_fast([text.join(words)], add_special_tokens=False)[0].ids, dtype=np.uint32)
            ends = np.flatnonzero(ids == mark)
            if len(ends) == len(words) - 1:
                return np.delete(ids, ends), np.diff(np.concatenate(([-1], ends, [len(ids)]))) - 1
        each = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.fromiter((i for ids in each for i in ids), dtype=np.uint32), np.fromiter(map(len, each), dtype=np.int64, count=len(each))

    def learn(self, words: list[bytes]):
        for low in range(0, len(words), CALL_WORDS):
            part = words[low : low + CALL_WORDS]
            ids, sizes = self._ids_of([w.decode("utf-8", "replace") for w in part])
            base = len(self.known)
            first = self.starts[base]
            if base + len(part) >= len(self.starts):
                self.starts = np.concatenate((self.starts, np.zeros(max(len(self.starts), len(part)), dtype=np.int64)))
            if first + len(ids) > len(self.ids):
                self.ids = np.concatenate((self.ids, np.empty(max(len(self.ids), len(ids)), dtype=np.uint32)))
            self.known.update(zip(part, range(base, base + len(part))))
            self.starts[base + 1 : base + len(part) + 1] = first + np.cumsum(sizes)
            self.ids[first : first + len(ids)] = ids

    def _folded(self, texts: pa.Array) -> pa.Array:
        """Texts with A-Z lowered, so that fewer words are new, where the tokenizer lowers them anyway and no added token
        (found before case is folded) appears or disappears."""
        if not self.lowers:
            return texts
        lowered = pc.ascii_lower(texts)
        clash = any(pc.any(pc.match_substring(t, c)).as_py() for c in self.added for t in (texts, lowered))
        return texts if clash else lowered

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (a binary array without nulls) one after another, and where each text's begin and end."""
        if len(self.known) > CACHED_WORDS:
            self.forget()
        split = pc.ascii_split_whitespace(self._folded(texts.view(pa.string())))  # byte by byte: needs no valid UTF-8
        words = split.flatten().view(pa.binary()).dictionary_encode()
        distinct = words.dictionary.to_pylist()
        self.learn([w for w in distinct if w not in self.known])
        number = np.fromiter(map(self.known.__getitem__, distinct), dtype=np.int64, count=len(distinct))
        at = number[words.indices.to_numpy()]
        begin = self.starts[at]
        sizes = self.starts[at + 1] - begin
        ends = np.concatenate(([0], np.cumsum(sizes)))
        where = np.repeat(begin - ends[:-1], sizes) + np.arange(ends[-1])
        borders = split.offsets.to_numpy() - split.offsets[0].as_py()
        return self.ids[where], ends[borders]


_encoders: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _blocks(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Slices of about ``BLOCK_BYTES`` with their first row."""
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    low = 0
    while low < len(texts):
        limit = (sizes[low - 1] if low else 0) + BLOCK_BYTES
        high = max(low + 1, int(np.searchsorted(sizes, limit, side="right")))
        yield low, texts.slice(low, high - low)
        low = high


def pieces(docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of every document: doc_id, start, length, ids_crc32, doc_tokens (and ids, if asked for)."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    end = np.array([end_id], dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path)
        for batch in batches:
            for low, texts in _blocks(pc.fill_null(batch.column(1), b"")):
                all_ids, borders = encoder.encode(texts)
                rows: list[list] = [[], [], [], [], [], []]
                for n in range(len(texts)):
                    ids = np.concatenate((all_ids[borders[n] : borders[n + 1]], end)).astype("<u4", copy=False)
                    for start in range(0, len(ids), window):
                        piece = ids[start : start + window]
                        for column, value in zip(rows, (low + n, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), piece.astype(np.int32) if with_ids else None)):
                            column.append(value)
                arrays = [batch.column(0).take(pa.array(rows[0], type=pa.int32())), *[pa.array(c, type=pa.int64()) for c in rows[1:5]]]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array(rows[5], type=pa.list_(pa.int32()))] * with_ids, names)

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col), F.col(text_col).cast("binary")).mapInArrow(giving_back(run), schema)


class OpenWindows:
    """Open windows by remaining capacity, in a segment tree: the tightest that holds a piece in log(window) steps."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, name: int):
        self.at[capacity].append(name)
        node = self.leaves + capacity
        while node:
            self.count[node] += 1
            node >>= 1

    def tightest(self, length: int) -> tuple[int, int] | None:
        """Take out the window with the least capacity of at least ``length``: (capacity, name)."""
        node = self.leaves + length
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        while node:
            self.count[node] -= 1
            node >>= 1
        return capacity, self.at[capacity].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each piece."""
    names, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    open_windows, opened = OpenWindows(window), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        found = open_windows.tightest(length) if length < window else None
        if found is None:
            found, opened = (window, opened), opened + 1
        capacity, name = found
        names[i], offsets[i] = name, window - capacity
        if capacity > length:
            open_windows.add(capacity - length, name)
    return names, offsets


def pack(rows: DataFrame, window: int = 2048) -> DataFrame:
    """Add sequence_id and offset to stored pieces with the columns length and ``NUMBER`` (distinct longs, dropped here)."""
    blocks = max(1, -(-rows.count() // BLOCK))
    out = [f for f in rows.schema if f.name != NUMBER]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out)

    def one_block(key: tuple, block: pa.Table) -> pa.Table:
        # Arrow tables keep 64-bit ids beside nulls as they are
        block = block.sort_by([("length", "descending"), (NUMBER, "ascending")])
        names, offsets = best_fit_decreasing(block.column("length").to_numpy(), window)
        placed = block.select([f.name for f in out])
        return placed.append_column("sequence_id", pa.array((key[0].as_py() << 32) + names)).append_column("offset", pa.array(offsets))

    dealt = rows.groupBy(F.pmod(F.xxhash64(NUMBER), F.lit(blocks)).alias("block"))
    return dealt.applyInArrow(one_block, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its place: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    cut = pieces(docs, tokenizer_path, window, end_id, id_col, text_col, with_ids)
    return pack(materialise(cut.withColumn(NUMBER, F.monotonically_increasing_id()), "pieces"), window)
