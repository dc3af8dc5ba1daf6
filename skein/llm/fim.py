"""Fill-in-the-middle: texts cut at two unit boundaries and reordered around sentinels.

A text is read as bytes by one automaton given as a table: its states know an open letter run, the start of a sentinel
and the continuation bytes still due, and its transitions say which byte starts a unit (a run of A-Za-z, or any other code
point), which starts a code point and which ends a sentinel. The scan gives the number of each kind of transition, block
by block; a second pass reads only the two blocks that hold the cuts.

Every state is settled by the three bytes before (a test walks the table for it), so a block is scanned by three table
look-ups for all of its bytes at once, instead of byte by byte.

The cuts and the form come from the SHA-256 of seed and id, so that reruns agree. Texts that are empty or hold a sentinel
stay plain. The output of the other forms holds each sentinel once, so ``restore`` finds the parts again.

Defined results: a null text is empty; a null id hashes as an empty one; repeated rows come out alike; texts of any length are
scanned whole, in blocks; bytes that are no UTF-8 count as a code point each; names of other columns do not matter; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Bytes scanned at once.
BLOCK = 1 << 16
#: Bytes of output handed over at once, about.
BATCH_BYTES = 1 << 23

# classes of bytes; NOTHING stands before a text
OTHER, LETTER, NAME, LESS, GREATER, TAIL, LEAD_2, LEAD_3, LEAD_4, NOTHING = range(10)
# states: between units, in a letter run, after '<', after '<' and a sentinel's letter, and 1 to 3 continuation bytes due
IDLE, WORD, OPENED, NAMED, DUE_1, DUE_2, DUE_3 = range(7)
# what a transition tells
UNIT, POINT, SENTINEL = 1, 2, 4


def byte_classes() -> np.ndarray:
    found = np.full(256, OTHER, dtype=np.uint8)
    for b in range(256):
        if chr(b) in "PSM":
            found[b] = NAME
        elif b < 128 and chr(b).isalpha():
            found[b] = LETTER
        elif b >= 0x80:
            found[b] = TAIL if b < 0xC0 else LEAD_2 if b < 0xE0 else LEAD_3 if b < 0xF0 else LEAD_4
    found[ord("<")], found[ord(">")] = LESS, GREATER
    return found


def transitions() -> tuple[np.ndarray, np.ndarray]:
    """Next state and emission, by state and class."""
    follow = np.empty((7, 10), dtype=np.uint8)
    emit = np.full((7, 10), UNIT | POINT, dtype=np.uint8)
    follow[:] = [IDLE, WORD, WORD, OPENED, IDLE, IDLE, DUE_1, DUE_2, DUE_3, IDLE]
    follow[OPENED, NAME] = NAMED
    for state in (WORD, NAMED):
        emit[state, [LETTER, NAME]] = POINT
    emit[NAMED, GREATER] |= SENTINEL
    for state in (DUE_1, DUE_2, DUE_3):
        follow[state, TAIL] = IDLE if state == DUE_1 else state - 1
        emit[state, TAIL] = 0
    emit[:, NOTHING] = 0
    return follow, emit


CLASS = byte_classes()
FOLLOW, EMIT = transitions()


def emissions(data: np.ndarray, start: int, stop: int) -> np.ndarray:
    """What the transition at each byte of the block tells."""
    before = CLASS[data[max(start - 3, 0) : start]]
    classes = np.concatenate([np.full(3 - len(before), NOTHING, dtype=np.uint8), before, CLASS[data[start:stop]]])
    size = stop - start
    state = FOLLOW[IDLE][classes[:size]]
    for back in (1, 2):
        state = FOLLOW.reshape(-1)[state * np.uint8(10) + classes[back : back + size]]
    return EMIT.reshape(-1)[state * np.uint8(10) + classes[3:]]


def counted(data: np.ndarray) -> np.ndarray:
    """First pass: units, code points and sentinels of each block."""
    rows = []
    for start in range(0, len(data), BLOCK):
        told = emissions(data, start, min(start + BLOCK, len(data)))
        rows.append([np.count_nonzero(told & kind) for kind in (UNIT, POINT, SENTINEL)])
    return np.array(rows, dtype=np.int64).reshape(-1, 3)


def locate(data: np.ndarray, blocks: np.ndarray, unit: int) -> tuple[int, int]:
    """Second pass: byte and code point at which a unit (counted from 0) starts; past the last, the end of the text."""
    ends = np.cumsum(blocks[:, 0])
    if unit >= (ends[-1] if len(ends) else 0):
        return len(data), int(blocks[:, 1].sum())
    block = int(np.searchsorted(ends, unit, side="right"))
    start = block * BLOCK
    told = emissions(data, start, min(start + BLOCK, len(data)))
    at = int(np.flatnonzero(told & UNIT)[unit - (ends[block] - blocks[block, 0])])
    return start + at, int(blocks[:block, 1].sum()) + int(np.count_nonzero(told[:at] & POINT))


def transform_text(doc_id: str, text: bytes, seed: int = 1, plain_from: int = 90, spm_below: int = 20) -> tuple[int, str, int | None, int | None, bytes]:
    """Units, form, code points of prefix and middle, and output of one text."""
    data = np.frombuffer(text, dtype=np.uint8)
    blocks = counted(data)
    n, _, sentinels = blocks.sum(axis=0).tolist()
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or sentinels or h3 % 100 >= plain_from:
        return n, "plain", None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    (a, a_points), (b, b_points) = locate(data, blocks, first), locate(data, blocks, second)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_below:
        return n, "spm", a_points, b_points - a_points, SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    return n, "psm", a_points, b_points - a_points, PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """One row per document: doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain), output.

    Of a hundred parts of the hash, those from ``plain_from`` on stay plain; of the others' hundred, those below
    ``spm_below`` put the suffix first.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held, low = [], 0, 0
            for at, (key, text) in enumerate(zip(batch.column(1), batch.column(2)), start=1):
                rows.append(transform_text(key.as_py() or "", text.as_py() or b"", seed, plain_from, spm_below))
                held += len(rows[-1][-1])
                if held >= BATCH_BYTES or at == batch.num_rows:
                    columns = [pa.array(c, type=t) for c, t in zip(zip(*rows), types)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, at - low), *columns], names)
                    rows, held, low = [], 0, at

    columns = [F.col(id_col).alias("doc_id"), F.col(id_col).cast("string").alias("key"), F.col(text_col).cast("binary").alias("text")]
    made = docs.select(*columns).mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output binary")
    return made.withColumn("output", F.col("output").cast("string"))


def restore(output: Column, form: Column) -> Column:
    """The text, rebuilt from output and form."""
    parts = F.split(output, "<[PSM]>")
    part = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)
