"""The one definition of a word: a run of code points other than space and U+0009 to U+000D; and hashes of word shingles."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

SEED = 42
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def count_words(text: Column) -> Column:
    """Number of words as a long; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def learns(doc_id: Column, remainder: int) -> Column:
    """False for the held-out fifth: crc32 of the id as text leaves ``remainder`` modulo 5. A null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 != remainder


def shingle_hashes(text: bytes | None, shingle: int = 3, seed: int = SEED) -> np.ndarray:
    """Hashes of the shingles of a text, repeats included; none for a text without words."""
    words = (text or b"").lower().split()
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, seed)] if words else [], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - shingle + 1
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist())], dtype=np.uint64)
