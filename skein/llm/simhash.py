"""SimHash near-dedup: fingerprints, an exact Hamming self-join by binary trie, connected classes.

Texts are lower-cased (A-Z only) and cut into words; each ``shingle``-word shingle, repeats included, is hashed
with XXH64 (seed 42). A fingerprint bit is 1 if set in more than half of the hashes. Fewer words than a shingle
count as one shingle; no words (null, empty, white space) give fingerprint 0, linked like any other.

The join works on distinct fingerprints, so exact copies cost nothing. Two fingerprints at distance <= d agree
on one of d+1 bit blocks, so each is sent to d+1 keys (block, value). A key's fingerprints form a binary trie:
node pairs are walked together from the root, differing bits add up, and a pair whose sum exceeds the budget is
dropped with everything below it. A key with more than ``LIMIT`` fingerprints is split again by the same rule on
the remaining bits, and what is still larger after ``LEVELS`` splits is walked as pairs of chunks: every link is
found, and no task holds more than one bounded key at a time. Links leave a key as stars (each fingerprint to
the smallest one it reaches there), never as all pairs. Classes are then found by label spreading with pointer
jumping over those links, on Spark, until nothing changes. Fingerprints and classes of very many rows are broadcast to
them.

``similar_representatives`` links by similarity instead: of the sets of ``shingle``-word shingles, the share of common ones
must reach ``similarity``. Texts with equal sets are one node. Here a text's keys are bands of min-hashes; under a key the
same trie walk finds the pairs within a wide Hamming budget that their min-hashes do not rule out, and hands them on as stars.
The stars' closure gives candidate classes, and within those every pair of sets is compared exactly, in chunks by bit
sets (``jaccard.connected_links``), so that no pair the walk finds goes unjudged. At similarity 0.8 and the parameters
below, a pair shares a key with probability 0.996 and is within the budget with 0.999.

Defined results: null ids rank after all others; repeated rows count each; texts without words are alike; texts of any
length are hashed whole, in blocks; names of other columns do not matter, as long as they are none of ``rows.PLACE``; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.labels import spread_labels

from .jaccard import connected_links
from .rows import FILE, PLACE, ROW, keep_rows, large_groups, meet_groups
from .storage import materialise
from .words import SEED, shingle_hashes
from .workers import giving_back

BITS = 64
#: Largest number of fingerprints walked under one key; larger keys are split.
LIMIT = 2048
#: How often a large key is split by blocks before it is cut into chunk pairs.
LEVELS = 2
#: Rows gathered before the keys among them are walked together.
WALK_ROWS = 40_000
#: Pairs that the keys walked together may have at most, but for a single key.
WALK_PAIRS = 1 << 22
#: Bands of min-hashes and hashes of a band, the Hamming budget that goes with similarity 0.8, what min-hashes may fall short of
#: the wanted similarity.
BANDS, BAND_HASHES, WIDE_BUDGET, SLACK = 14, 5, 20, 0.2


def print_of(hashes: np.ndarray) -> int:
    """The fingerprint that hashes vote for, unsigned."""
    ones = np.zeros(BITS, dtype=np.int64)
    for block in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[block : block + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint_of(text: bytes | None, shingle: int = 3, seed: int = SEED) -> int:
    """The fingerprint of one text, unsigned."""
    return print_of(shingle_hashes(text, shingle, seed))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of ``carry`` and fingerprint (the 64 bits as a signed long), one row per input row."""
    fields = [("doc_id", id_col), *[(c, c) for c in carry]]
    schema = ", ".join(f"`{name}` {docs.schema[c].dataType.simpleString()}" for name, c in fields)
    names = [name for name, _ in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint_of(t.as_py(), shingle) for t in batch.column(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(np.array(prints, dtype=np.uint64).view(np.int64))], [*names, "fingerprint"])

    return docs.select(*[F.col(c) for _, c in fields], F.col(text_col).cast("binary")).mapInArrow(run, f"{schema}, fingerprint long")


def trie_pairs(prints: np.ndarray, starts: np.ndarray, stops: np.ndarray, budget: int, other: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) within ``budget`` bits, for each range [start, stop) of ``prints`` (sorted within it),
    or between the ranges of ``starts, stops`` and those of ``other``. A range of a sorted array is a trie node;
    its children are the parts with the next bit 0 and 1."""
    a0, a1 = starts.astype(np.int64), stops.astype(np.int64)
    b0, b1 = (a0, a1) if other is None else (other[0].astype(np.int64), other[1].astype(np.int64))
    spent = np.zeros(len(a0), dtype=np.int8)
    found_i, found_j = [], []
    ones = np.concatenate(([0], np.cumsum(np.zeros(len(prints), dtype=np.int64))))
    for bit in range(BITS - 1, -1, -1):
        if not len(a0):
            break
        # few fingerprints on both sides: compare them at once instead of walking the rest of the path
        small = (a1 - a0) * (b1 - b0) <= 64
        if small.any():
            i, j = _leaves(prints, a0[small], a1[small], b0[small], b1[small], budget)
            found_i.append(i)
            found_j.append(j)
            a0, a1, b0, b1, spent = a0[~small], a1[~small], b0[~small], b1[~small], spent[~small]
            if not len(a0):
                break
        np.cumsum((prints >> np.uint64(bit)) & np.uint64(1), out=ones[1:], dtype=np.int64)
        # within a node the fingerprints share all higher bits, so those with this bit 0 come first
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        same = (a0 == b0) & (a1 == b1)
        grown = spent + 1
        parts = [(a0, am, b0, bm, spent, None), (am, a1, bm, b1, spent, None), (a0, am, bm, b1, grown, None), (am, a1, b0, bm, grown, ~same)]
        nexts = []
        for x0, x1, y0, y1, cost, also in parts:
            live = (x1 > x0) & (y1 > y0) & (cost <= budget)
            live &= ~((x0 == y0) & (x1 == y1) & (x1 - x0 < 2))
            if also is not None:
                live &= also
            nexts.append((x0[live], x1[live], y0[live], y1[live], cost[live]))
        a0, a1, b0, b1, spent = (np.concatenate(x) for x in zip(*nexts))
    if len(a0):
        i, j = _leaves(prints, a0, a1, b0, b1, budget)
        found_i.append(i)
        found_j.append(j)
    if not found_i:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    return np.concatenate(found_i), np.concatenate(found_j)


def _leaves(prints, a0, a1, b0, b1, budget, at_once: int = 1 << 20):
    """Compare all fingerprints of each node pair, about ``at_once`` comparisons at a time."""
    ends = np.cumsum((a1 - a0) * (b1 - b0))
    cuts = np.unique(np.r_[0, np.searchsorted(ends, np.arange(at_once, ends[-1] if len(ends) else 0, at_once)), len(ends)])
    pairs = [_compare(prints, a0[x:y], a1[x:y], b0[x:y], b1[x:y], budget) for x, y in zip(cuts[:-1], cuts[1:])]
    return np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])


def _compare(prints, a0, a1, b0, b1, budget):
    sizes = (a1 - a0) * (b1 - b0)
    node = np.repeat(np.arange(len(sizes)), sizes)
    within = np.arange(len(node)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    width = (b1 - b0)[node]
    i, j = a0[node] + within // width, b0[node] + within % width
    keep = i != j
    keep &= (i < j) | ~((a0 == b0) & (a1 == b1))[node]
    i, j = i[keep], j[keep]
    near = np.bitwise_count(prints[i] ^ prints[j]) <= budget
    return i[near], j[near]


def _stars(prints: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links as stars: each fingerprint with the smallest that it reaches through the links given."""
    label = np.arange(len(prints))
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    leaf = np.flatnonzero(label != np.arange(len(prints)))
    return prints[leaf], prints[label[leaf]]


def _walk_keys(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(keys, sides, prints):
            edge = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1])])
            stop = np.r_[edge[1:], len(keys)]
            ordered = prints.view(np.uint64)
            # a chunk pair has its second chunk behind the first, marked by side 1
            turn = np.add.reduceat((sides == 0).astype(np.int64), edge) + edge
            plain = turn == stop
            leaves, roots = [], []
            for keys_at in bounded(np.where(plain, stop - edge, np.maximum(turn - edge, stop - turn))):
                chosen = np.zeros(len(edge), dtype=bool)
                chosen[keys_at] = True
                several = chosen & plain & (stop - edge > 1)
                i, j = trie_pairs(ordered, edge[several], stop[several], budget)
                crossed = chosen & ~plain & (turn > edge)
                if crossed.any():
                    k, m = trie_pairs(ordered, edge[crossed], turn[crossed], budget, (turn[crossed], stop[crossed]))
                    i, j = np.r_[i, k], np.r_[j, m]
                # equal fingerprints of different keys are one node
                low, high = int(edge[keys_at.start]), int(stop[keys_at.stop - 1])
                nodes, place = np.unique(ordered[low:high], return_inverse=True)
                leaf, root = _stars(nodes, place[i - low], place[j - low])
                leaves.append(leaf), roots.append(root)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (leaves, roots)], ["leaf", "root"])

        for keys, sides, prints in whole_keys(batches):
            yield links(keys, sides, prints)

    return run


def bounded(sizes: np.ndarray) -> Iterator[slice]:
    """Runs of keys (of ``sizes`` rows) with at most ``WALK_PAIRS`` pairs together, or one key."""
    low, total = 0, 0
    for n, pairs in enumerate((sizes.astype(np.int64) ** 2).tolist()):
        if n > low and total + pairs > WALK_PAIRS:
            yield slice(low, n)
            low, total = n, 0
        total += pairs
    if len(sizes):
        yield slice(low, len(sizes))


def whole_keys(batches: Iterator[pa.RecordBatch], at_once: int = WALK_ROWS) -> Iterator[list[np.ndarray]]:
    """Columns of the rows of about ``at_once`` rows' keys at a time; the first column is the key, in order."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def take(last: bool):
        nonlocal held, rows
        table = pa.Table.from_batches(held)
        keys = table.column(0).to_numpy()
        cut = len(keys) if last else int(np.searchsorted(keys, keys[-1]))
        held = [] if cut == len(keys) else table.slice(cut).combine_chunks().to_batches()
        rows = len(keys) - cut
        return [table.column(c).slice(0, cut).to_numpy() for c in range(table.num_columns)] if cut else None

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= at_once and (ready := take(False)):
            yield ready
    if rows and (ready := take(True)):
        yield ready


def _blocks(low: int, high: int, parts: int) -> list[tuple[int, int]]:
    edges = [low + (high - low) * k // parts for k in range(parts + 1)]
    return list(zip(edges[:-1], edges[1:]))


def _bits(low: int, high: int):
    return F.shiftrightunsigned(F.col("fingerprint"), low).bitwiseAND(F.lit((1 << (high - low)) - 1))


def linked_prints(distinct: DataFrame, budget: int = 3) -> DataFrame:
    """Links (leaf, root) whose closure equals that of all pairs of ``distinct`` fingerprints within ``budget``."""
    parts = budget + 1
    blocks = _blocks(0, BITS, parts)
    keyed = distinct.select("fingerprint", F.posexplode(F.array(*[_bits(a, b) for a, b in blocks]))).select(
        "fingerprint", F.xxhash64("pos", "col").alias("key"), F.array("pos").alias("path")
    )
    ready = []
    for level in range(LEVELS + 1):
        large = materialise(keyed.groupBy("key").count().where(F.col("count") > LIMIT), "simhash-large")
        ready.append(keyed.join(large, "key", "left_anti").select("key", F.lit(0).alias("side"), "fingerprint"))
        over = keyed.join(large, "key")
        if large.isEmpty():
            break
        if level == LEVELS:
            ready.append(_chunk_pairs(over))
            break
        keyed = materialise(_split_again(over, blocks, parts), "simhash-split")
    rows = ready[0]
    for more in ready[1:]:
        rows = rows.unionByName(more)
    walked = rows.repartition("key").sortWithinPartitions("key", "side", F.expr("fingerprint < 0"), "fingerprint")
    return walked.mapInArrow(_walk_keys(budget), "leaf long, root long")


def _split_again(over: DataFrame, blocks: list[tuple[int, int]], parts: int) -> DataFrame:
    """Rows of large keys, once for each part of the bits outside the blocks that the key already fixes."""
    rest = F.array(*[F.lit(0).cast("long")])
    cases = None
    for fixed in range(len(blocks)):
        free = [k for k in range(len(blocks)) if k != fixed]
        # the free blocks are cut crosswise: part p takes an equal share of each, so parts differ from level to level
        shares = [[_blocks(*blocks[k], parts)[(p + n) % parts] for n, k in enumerate(free)] for p in range(parts)]
        value = F.array(*[F.xxhash64(*[_bits(a, b) for a, b in share]) for share in shares])
        deeper = F.array(*[F.xxhash64(*[_bits(*_blocks(a, b, parts)[p]) for share in shares for a, b in share]) for p in range(parts)])
        chosen = F.when(F.size("path") == 1, value).otherwise(deeper)
        cases = F.when(F.element_at("path", 1) == fixed, chosen) if cases is None else cases.when(F.element_at("path", 1) == fixed, chosen)
    exploded = over.select("fingerprint", "key", "path", F.posexplode(F.coalesce(cases, rest)))
    return exploded.select("fingerprint", F.xxhash64("key", "pos", "col").alias("key"), F.concat("path", F.array("pos")).alias("path"))


def _chunk_pairs(over: DataFrame) -> DataFrame:
    """Rows of keys that stay large, dealt into chunks; each pair of chunks of a key becomes a key of its own."""
    chunks = F.ceil(F.col("count") / LIMIT).cast("int")
    rest = [c for c in over.columns if c not in ("key", "count", "path")]
    dealt = over.withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("fingerprint"), F.col("chunks")).cast("int"))
    paired = dealt.select(*rest, "key", "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("with"))
    low, high = F.least("chunk", "with"), F.greatest("chunk", "with")
    return paired.select(F.xxhash64("key", low, high).alias("key"), F.when(F.col("chunk") > F.col("with"), 1).otherwise(0).alias("side"), *rest)


def simhash_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, budget: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, ``carry``, fingerprint (16 hexadecimal digits), component_id (smallest id
    reachable) and class_print (a fingerprint that names the class).

    Repeated rows stay repeated; null ids rank after all others; an empty table gives no rows.
    """
    prints = materialise(fingerprints(docs, id_col, text_col, shingle, carry), "simhash")
    distinct = materialise(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")), "simhash-distinct")
    classes = spread_labels(materialise(linked_prints(distinct.select("fingerprint"), budget), "simhash-links"))
    labelled = distinct.join(classes.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("label", F.coalesce("label", "fingerprint"))
    labelled = materialise(labelled, "simhash-labels")
    heads = materialise(labelled.groupBy("label").agg(F.min("first_id").alias("component_id"), F.count("*").alias("prints")), "simhash-heads")
    named = meet_groups(labelled, heads.drop("prints"), large_groups(heads, "label", "prints"), "label")
    named = materialise(named.select("fingerprint", "component_id", F.col("label").alias("class_print")), "simhash-named")
    digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint")
    return meet_groups(prints, named, large_groups(distinct, "fingerprint", "copies"), "fingerprint").select("doc_id", *carry, digits, "component_id", "class_print")


def min_hashes(hashes: np.ndarray) -> np.ndarray:
    """The smallest of ``BANDS * BAND_HASHES`` permuted values of the hashes each."""
    low = np.full(len(_FACTORS), 0xFFFFFFFF, dtype=np.uint32)
    for block in range(0, len(hashes), 1 << 13):
        part = hashes[block : block + (1 << 13), None]
        np.minimum(low, ((((part ^ (part >> np.uint64(31))) * _FACTORS) >> np.uint64(32)).astype(np.uint32)).min(axis=0), out=low)
    return low


_FACTORS = np.array([xxhash.xxh64_intdigest(b"%d" % n, SEED) | 1 for n in range(BANDS * BAND_HASHES)], dtype=np.uint64)


def set_digest(distinct: np.ndarray) -> int:
    """Names a set of hashes (sorted), signed."""
    return int(np.array([xxhash.xxh64_intdigest(distinct.tobytes(), SEED)], dtype=np.uint64).view(np.int64)[0])


def shingle_sets(rows: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """node and hashes (the sorted distinct shingle hashes) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, shingle)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([set_digest(x) for x in sets], type=pa.int64()), pa.array([x.tobytes() for x in sets], type=pa.binary())], ["node", "hashes"])

    return rows.select(F.col(text_col).cast("binary")).mapInArrow(giving_back(run), "node long, hashes binary")


def sketches(rows: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """doc_id and place of every row with its node, fingerprint, band keys and min-hashes."""
    kind = rows.schema[id_col].dataType.simpleString()
    names = ["doc_id", *PLACE, "node", "fingerprint", "bands", "sketch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            nodes, prints, bands, packed = [], [], [], []
            for text in batch.column(3).to_pylist():
                hashes = shingle_hashes(text, shingle)
                low = min_hashes(hashes)
                nodes.append(set_digest(np.unique(hashes))), prints.append(print_of(hashes)), packed.append(low.tobytes())
                bands.append([digest(part.tobytes(), n) for n, part in enumerate(low.reshape(BANDS, -1))])
            signed = lambda x: np.array(x, dtype=np.uint64).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(bands) + 1, dtype=np.int32) * BANDS), pa.array(signed(bands).reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(nodes, type=pa.int64()), pa.array(signed(prints)), lists, pa.array(packed, type=pa.binary())], names)

    columns = [F.col(id_col).alias("doc_id"), *PLACE, F.col(text_col).cast("binary").alias("text")]
    return rows.select(*columns).mapInArrow(giving_back(run), f"doc_id {kind}, {FILE} long, {ROW} long, node long, fingerprint long, bands array<long>, sketch binary")


def _walk_similar(budget: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, sides, prints, nodes, packed in whole_keys(batches, 8000):
            ordered = prints.view(np.uint64)
            sketch = np.frombuffer(b"".join(packed), dtype=np.uint32).reshape(len(keys), -1)
            edge = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            stop = np.r_[edge[1:], len(keys)]
            turn = np.add.reduceat((sides == 0).astype(np.int64), edge) + edge
            for a, t, b in zip(edge.tolist(), turn.tolist(), stop.tolist()):
                one = lambda *x: np.array(x)
                if t == b:
                    i, j = trie_pairs(ordered, one(a), one(b), budget)
                elif t > a:
                    i, j = trie_pairs(ordered, one(a), one(t), budget, (one(t), one(b)))
                else:
                    continue
                alike = np.concatenate([np.empty(0), *[(sketch[i[k : k + 8000]] == sketch[j[k : k + 8000]]).mean(axis=1) for k in range(0, len(i), 8000)]])
                leaf, root = _stars(nodes[a:b], i[alike >= least] - a, j[alike >= least] - a)
                if len(leaf):
                    yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(root)], ["leaf", "root"])

    return run


def candidate_stars(nodes: DataFrame, budget: int, least: float) -> DataFrame:
    """Links (leaf, root) whose closure equals that of all pairs of nodes that share a key, are within the budget and look alike
    enough."""
    keyed = materialise(nodes.select("node", F.explode("bands").alias("key")), "similar-keys")
    shared = keyed.groupBy("key").count().where("count > 1")
    live = materialise(keyed.join(shared, "key"), "similar-live")
    full = live.join(nodes.select("node", "fingerprint", "sketch"), "node").select("key", "count", "fingerprint", "node", "sketch")
    few = full.where(F.col("count") <= LIMIT).select("key", F.lit(0).alias("side"), "fingerprint", "node", "sketch")
    rows = few.unionByName(_chunk_pairs(full.where(F.col("count") > LIMIT)))
    walked = rows.repartition("key").sortWithinPartitions("key", "side", F.expr("fingerprint < 0"), "fingerprint")
    return walked.mapInArrow(giving_back(_walk_similar(budget, least)), "leaf long, root long").distinct()


def similar_representatives(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, budget: int = WIDE_BUDGET) -> DataFrame:
    """Places of one row of each class of similar texts: the one with the smallest id (null last), of equal ids the one that
    lies first. ``rows`` are ``numbered``."""
    told = materialise(sketches(rows, id_col, text_col, shingle), "similar-sketches")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *PLACE)
    # of equal sets, one keeps the others' place: equal sets have equal fingerprints, bands and min-hashes
    nodes = told.groupBy("node").agg(F.min(first).alias("first"), F.any_value("fingerprint").alias("fingerprint"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch"))
    nodes = materialise(nodes, "similar-nodes")
    stars = materialise(candidate_stars(nodes, budget, similarity - SLACK), "similar-stars")
    classes = materialise(spread_labels(stars), "similar-candidates")
    there = nodes.join(classes, "node", "left_semi").select("first.*").select(*PLACE)
    own = rows.select(*PLACE, F.col(text_col).alias("text"))
    sets = materialise(shingle_sets(keep_rows(own, there), "text", shingle), "similar-sets")
    # every pair of a candidate class is asked for: no token has to be shared beforehand
    sizes = sets.select("node", (F.octet_length("hashes") / 8).cast("long").alias("n"), F.col("hashes").alias("tokens"))
    lists = sizes.select("node", "n", F.lit(0).alias("matches"), F.lit(0).alias("width"), F.lit(1).cast("long").alias("copies"), "tokens")
    members = sizes.join(classes, "node").select("node", "label", "n", F.octet_length("tokens").alias("size"))
    links = materialise(connected_links(members, lists, round(100 * similarity)), "similar-links")
    labels = spread_labels(links.select(F.col("node").alias("leaf"), "root"))
    labelled = nodes.select("node", "first").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    return labelled.groupBy("label").agg(F.min("first").alias("first")).select(*[F.col(f"first.{c}").alias(c) for c in PLACE])
