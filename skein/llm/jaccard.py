"""Similarity join of documents by their sets of word shingles, exact: adaptive multi-match prefixes.

A document's set is that of its distinct ``shingle``-word shingles (A-Z in lower case; fewer words are one shingle; no words
give an empty set, which is linked with nothing). Two documents link when 100 * intersection >= share * union.

1. Equal texts are one node. Each node's shingles go to buckets by hash, which say how many of them no other node has.
   A node with so many of those that no partner can reach the share is out. This pass moves four bytes a shingle; a collision
   can only keep a node in.
2. The nodes left send their shingles once more. A bucket gives each shingle its number of nodes, and the tokens that several
   nodes have come back to their node, rarest first. All others cannot be common to two nodes, so the rest works on these.
3. Among the first |r| - ceil(share * |r|) + m tokens of two linked sets at least m are common. Each node takes the m with the
   least estimated cost: the nodes its prefix meets, and the candidates that the prefix lets through, at most one for every
   m of those nodes. Two nodes are compared if they share as many prefix tokens as the lesser of their m.
4. Nodes under a token of at most ``HOT`` nodes meet by a join on the token, and each candidate pair is compared. Nodes that
   hotter tokens connect are dealt into chunks by size and hash, and each pair of chunks is one task: it counts shared prefix
   tokens and then common tokens by bit sets, and hands on stars and numbers of links. No pair of them is a row.

Links are closed to classes by label spreading. Nothing is capped: each pair that can link is compared once.

Defined results: null ids rank after all others; repeated rows count each, and equal texts are links of each other; a null
text is empty; texts of any length are hashed whole, each within one task; ties between tokens are settled by their hash; names
of other columns do not matter; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.labels import spread_labels

from .rows import PLACE, keep_rows, large_groups, meet_groups, numbered
from .storage import materialise
from .words import SEED, shingle_hashes
from .workers import give_back

#: Shingles of a bucket, about; of the documents sent off together.
BUCKET, CHUNK = 1_000_000, 1_000_000
#: Nodes of a token up to which they meet as pairs.
HOT = 32
#: Nodes and bytes of a chunk of connected nodes, about.
LIMIT, LIMIT_BYTES = 512, 2 << 20
#: Bytes of a key's rows from which their memory is given back at once.
LARGE_KEY = 1 << 18
#: Greatest number of shared tokens asked for, and the cost of a comparison beside that of one node met, by tokens of the set.
MOST_MATCHES, COMPARISON = 8, 0.125


def least_overlap(sizes: np.ndarray, share: int) -> np.ndarray:
    """Common tokens that a set needs with any partner: ceil(share * size / 100)."""
    return -(-share * sizes.astype(np.int64) // 100)


def _binaries(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([a.tobytes() for a in arrays], type=pa.binary())


def dealt_shingles(nodes: DataFrame, buckets: int, shingle: int, width: int) -> DataFrame:
    """Shingles by chunk of documents and bucket of hashes: owners (documents of the chunk that have some there), counts
    (how many), values (their ``width`` low bytes, document by document); and a row a chunk, in some bucket, with its nodes and
    the sizes of their sets. ``nodes`` has node and text (binary)."""
    kind = np.dtype(f"u{width}")
    names = ["chunk", "bucket", "nodes", "owners", "counts", "values"]

    def send(ids: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        nodes = np.array(ids, dtype=np.int64)
        chunk = xxhash.xxh64_intdigest(nodes.tobytes(), SEED) >> 1
        sizes = np.array([len(s) for s in sets], dtype=np.uint32)
        values = np.concatenate(sets)
        # the high half of a hash tells its bucket, so that the low bytes stay evenly spread within one
        place = ((values >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(place, kind="stable")
        place, owner, values = place[order], np.repeat(np.arange(len(sets)), sizes)[order], values[order].astype(kind)
        edge = np.searchsorted(place, np.unique(place))
        owners, counts, parts = [], [], []
        for a, b in zip(edge, np.r_[edge[1:], len(place)]):
            there, times = np.unique(owner[a:b], return_counts=True)
            owners.append(there.astype(np.uint32)), counts.append(times.astype(np.uint32)), parts.append(values[a:b])
        columns = [
            pa.array([chunk] * (len(edge) + 1), type=pa.int64()),
            pa.array([*place[edge].tolist(), chunk % buckets], type=pa.int32()),
            pa.array([None] * len(edge) + [nodes.tobytes()], type=pa.binary()),
            _binaries([*owners, sizes[:0]]),
            _binaries([*counts, sizes]),
            _binaries([*parts, values[:0]]),
        ]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sets, held = [], [], 0
        for batch in batches:
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(node), sets.append(np.unique(shingle_hashes(text.as_py(), shingle)))
                held += len(sets[-1]) + 100
                if held >= CHUNK:
                    yield send(ids, sets)
                    ids, sets, held = [], [], 0
        if ids:
            yield send(ids, sets)

    return nodes.select("node", "text").mapInArrow(run, "chunk long, bucket int, nodes binary, owners binary, counts binary, values binary")


def _numbers(column: pa.ChunkedArray, kind) -> list[np.ndarray]:
    return [np.frombuffer(b, dtype=kind) for b in column.to_pylist()]


def _joined(arrays: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate([np.empty(0, dtype=kind), *arrays])


def _heads_and_parts(table: pa.Table) -> tuple[pa.Table, pa.Table]:
    return table.filter(table.column("nodes").is_valid()), table.filter(table.column("nodes").is_null())


def repeats(values: np.ndarray) -> np.ndarray:
    """How often each of the values occurs among them."""
    order = np.argsort(values)
    ordered = values[order]
    edge = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]][: len(values)])
    runs = np.diff(np.r_[edge, len(values)])
    found = np.empty(len(values), dtype=np.int64)
    found[order] = np.repeat(runs, runs)
    return found


def set_sizes(nodes: DataFrame, buckets: int, shingle: int, share: int) -> DataFrame:
    """node, n (size of its set) and live (other sets have enough of it for a link to be possible)."""

    def shared(table: pa.Table) -> pa.Table:
        heads, parts = _heads_and_parts(table)
        held = (repeats(_joined(_numbers(parts.column("values"), np.uint32), np.uint32)) > 1).astype(np.int64)
        total, found, at = np.r_[0, np.cumsum(held)], [], 0
        for counts in _numbers(parts.column("counts"), np.uint32):
            ends = at + np.cumsum(counts.astype(np.int64))
            found.append((total[ends] - total[ends - counts]).astype(np.uint32))
            at = int(ends[-1])
        columns = [heads.column(c).to_pylist() + parts.column(c).to_pylist() for c in ("chunk", "nodes", "owners")]
        columns.append(heads.column("counts").to_pylist() + [f.tobytes() for f in found])
        return pa.Table.from_arrays([pa.array(c, type=t) for c, t in zip(columns, _COUNTED)], ["chunk", "nodes", "owners", "counts"])

    def told(table: pa.Table) -> pa.Table:
        heads, parts = _heads_and_parts(table)
        ids, sizes = _joined(_numbers(heads.column("nodes"), np.int64), np.int64), _joined(_numbers(heads.column("counts"), np.uint32), np.uint32)
        owners, counts = _joined(_numbers(parts.column("owners"), np.uint32), np.int64), _joined(_numbers(parts.column("counts"), np.uint32), np.int64)
        common = np.bincount(owners.astype(np.int64), weights=counts, minlength=len(ids))
        live = (sizes > 0) & (common >= least_overlap(sizes, share))
        return pa.table({"node": ids, "n": sizes.astype(np.int64), "live": live})

    counted = dealt_shingles(nodes, buckets, shingle, 4).groupBy("bucket").applyInArrow(shared, "chunk long, nodes binary, owners binary, counts binary")
    return counted.groupBy("chunk").applyInArrow(told, "node long, n long, live boolean")


_COUNTED = [pa.int64(), pa.binary(), pa.binary(), pa.binary()]


def matches_wanted(n: int, met: np.ndarray, need: int) -> int:
    """Shared prefix tokens to ask for: those with the least estimated cost. ``met`` are the nodes that each common token meets, in
    order; a prefix that asks for m has len(met) - need + m of them."""
    most = min(MOST_MATCHES, need)
    nodes = np.cumsum(met)[len(met) - need : len(met) - need + most].astype(np.float64)
    return int(np.argmin(nodes * (1 + COMPARISON * n / np.arange(1, most + 1)))) + 1


def token_lists(nodes: DataFrame, buckets: int, shingle: int, share: int) -> DataFrame:
    """node, n, matches (shared prefix tokens it asks for), width (tokens of its prefix that other nodes have) and tokens (all that
    other nodes have, rarest first) of the nodes that can still have a link."""

    def counted(table: pa.Table) -> pa.Table:
        heads, parts = _heads_and_parts(table)
        values = _joined(_numbers(parts.column("values"), np.uint64), np.uint64)
        times = repeats(values)
        columns = [heads.column(c).to_pylist() for c in ("chunk", "nodes", "counts")] + [[None] * heads.num_rows for _ in range(2)]
        at = 0
        for chunk, owners, counts in zip(parts.column("chunk").to_pylist(), _numbers(parts.column("owners"), np.uint32), _numbers(parts.column("counts"), np.uint32)):
            several = np.flatnonzero(times[at : at + counts.sum()] > 1) + at
            row = [chunk, None, np.repeat(owners, counts)[several - at].tobytes(), values[several].tobytes(), times[several].astype(np.uint32).tobytes()]
            at += int(counts.sum())
            for column, value in zip(columns, row):
                column.append(value)
        types = [pa.int64()] + [pa.binary()] * 4
        return pa.Table.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types)], ["chunk", "nodes", "counts", "values", "times"])

    def gathered(table: pa.Table) -> pa.Table:
        heads, parts = _heads_and_parts(table)
        ids, sizes = _joined(_numbers(heads.column("nodes"), np.int64), np.int64), _joined(_numbers(heads.column("counts"), np.uint32), np.uint32).astype(np.int64)
        owners = _joined(_numbers(parts.column("counts"), np.uint32), np.int64).astype(np.int64)
        values, times = _joined(_numbers(parts.column("values"), np.uint64), np.uint64), _joined(_numbers(parts.column("times"), np.uint32), np.int64)
        order = np.lexsort((values, times, owners))
        values, times = values[order], times[order].astype(np.int64)
        edge = np.searchsorted(owners[order], np.arange(len(ids) + 1))
        rows = []
        for k, (a, b) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist())):
            n = int(sizes[k])
            need = int(least_overlap(sizes[k : k + 1], share)[0])
            if n and b - a >= need:
                matches = matches_wanted(n, times[a:b] - 1, need)
                rows.append((int(ids[k]), n, matches, b - a - need + matches, values[a:b].tobytes()))
        columns = zip(*rows) if rows else [()] * 5
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        return pa.Table.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types)], ["node", "n", "matches", "width", "tokens"])

    back = dealt_shingles(nodes, buckets, shingle, 8).groupBy("bucket").applyInArrow(counted, "chunk long, nodes binary, counts binary, values binary, times binary")
    return back.groupBy("chunk").applyInArrow(gathered, "node long, n long, matches int, width int, tokens binary")


def prefix_tokens(lists: DataFrame) -> DataFrame:
    """token, node, n and matches, a row for every token of a node's prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                width = part.column(3).to_numpy()
                tokens = [np.frombuffer(t, dtype=np.int64, count=w) for t, w in zip(part.column(4).to_pylist(), width)]
                columns = [_joined(tokens, np.int64), *[np.repeat(part.column(c).to_numpy(), width) for c in range(3)]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["token", "node", "n", "matches"])

    return lists.select("node", "n", "matches", "width", "tokens").mapInArrow(run, "token long, node long, n long, matches int")


def overlaps(rows: np.ndarray, columns: np.ndarray, left: np.ndarray, right: np.ndarray, total: int) -> np.ndarray:
    """Common columns of each row of ``left`` with each of ``right``. Columns that many rows have are rows of bits, a block of
    columns at a time; those that few have are counted through the pairs of their rows."""
    found = np.zeros((len(left), len(right)), dtype=np.int64)
    order = np.lexsort((rows, columns))
    rows, columns = rows[order], columns[order]
    edge = np.flatnonzero(np.r_[True, columns[1:] != columns[:-1]][: len(columns)])
    runs = np.diff(np.r_[edge, len(columns)])
    place_left, place_right = np.full(total, -1), np.full(total, -1)
    place_left[left], place_right[right] = np.arange(len(left)), np.arange(len(right))
    often = np.repeat(runs > FEW, runs)
    few_rows, few_columns = rows[~often], columns[~often]
    for apart in range(1, FEW):
        same = few_columns[apart:] == few_columns[:-apart]
        a, b = few_rows[apart:][same], few_rows[:-apart][same]
        for x, y in ((a, b), (b, a)):
            i, j = place_left[x], place_right[y]
            ok = (i >= 0) & (j >= 0)
            found += np.bincount(i[ok] * len(right) + j[ok], minlength=found.size).reshape(found.shape)
    rank = np.cumsum(np.r_[0, np.diff(columns[often]) != 0]) if often.any() else np.empty(0, dtype=np.int64)
    rows = rows[often]
    for low in range(0, int(rank[-1]) + 1 if len(rank) else 0, COLUMNS):
        here = slice(*np.searchsorted(rank, [low, low + COLUMNS]))
        sides = []
        for place, size in ((place_left, len(left)), (place_right, len(right))):
            marks = np.zeros((size, COLUMNS), dtype=bool)
            at = place[rows[here]]
            marks[at[at >= 0], rank[here][at >= 0] - low] = True
            sides.append(np.packbits(marks, axis=1).view(np.uint64))
        for n, bits in enumerate(sides[0]):
            found[n] += np.bitwise_count(sides[1] & bits).sum(axis=1, dtype=np.int64)
    return found


#: The side of a chunk that is compared with itself.
OWN = 2
#: Rows of a column up to which its pairs are counted one by one, and columns of a block (a multiple of 64).
FEW, COLUMNS = 12, 2048


def linked_pairs(n: np.ndarray, matches: np.ndarray, widths: np.ndarray, tokens: list[np.ndarray], sides: np.ndarray, share: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of linked sets: between sides 0 and 1 (of which one may be empty), or within side ``OWN``."""
    left, alone = np.flatnonzero(sides != 1), bool((sides == OWN).all())
    right = left if alone else np.flatnonzero(sides == 1)
    if not len(left) or not len(right):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    lengths = np.array([len(t) for t in tokens])
    row = np.repeat(np.arange(len(n), dtype=np.int32), lengths)
    column = np.unique(np.concatenate(tokens), return_inverse=True)[1].astype(np.int32)
    prefix = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths) < np.repeat(widths, lengths)
    shared = overlaps(row[prefix], column[prefix], left, right, len(n))
    a, b = n[left][:, None], n[right][None, :]
    wanted = (shared >= np.minimum(matches[left][:, None], matches[right][None, :])) & (100 * np.minimum(a, b) >= share * np.maximum(a, b))
    if alone:
        wanted &= np.arange(len(left))[:, None] < np.arange(len(left))[None, :]
    some = np.zeros(len(n), dtype=bool)
    some[left[wanted.any(axis=1)]] = some[right[wanted.any(axis=0)]] = True
    if not some.any():
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    left_some, right_some = some[left], some[right]
    mine = some[row]
    common = overlaps(row[mine], column[mine], left[left_some], right[right_some], len(n))
    a, b = n[left[left_some]][:, None], n[right[right_some]][None, :]
    i, j = np.nonzero(wanted[np.ix_(left_some, right_some)] & (100 * common >= share * (a + b - common)))
    return left[left_some][i], right[right_some][j]


def connected_links(members: DataFrame, lists: DataFrame, share: int) -> DataFrame:
    """Links between the nodes of a component: node, root (the smallest it reaches within its task) and links (documents it is
    linked with there). ``members`` has node, label, n and size (bytes of its list); ``lists`` those of ``token_lists`` with
    copies. Lists of whole sets with no prefix (matches and width 0) have all their pairs compared."""
    step = max(math.log(100 / share), 1e-3) * 1.001
    parts = materialise(members.groupBy("label").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes")), "jaccard-components")
    met = meet_groups(members, parts, large_groups(parts, "label", "rows"), "label")
    # sets that can link lie in one class of sizes, or in neighbouring ones
    whole = (F.col("rows") <= LIMIT) & (F.col("bytes") <= LIMIT_BYTES)
    band = F.when(whole, 0).otherwise(F.floor(F.log(F.col("n").cast("double")) / step)).cast("long")
    met = materialise(met.select("node", "label", "size", band.alias("band")).withColumn("unit", F.xxhash64("label", "band")), "jaccard-bands")
    units = met.groupBy("unit").agg(F.any_value("label").alias("label"), F.any_value("band").alias("band"), F.count("*").alias("rows"), F.sum("size").alias("bytes"))
    units = materialise(units.withColumn("chunks", F.greatest(F.ceil(F.col("rows") / LIMIT), F.ceil(F.col("bytes") / LIMIT_BYTES)).cast("int")), "jaccard-units")
    chunks = units.select("unit", "label", "band", "chunks", "rows")
    for name, apart in (("above", 1), ("below", -1)):
        beside = units.select(F.xxhash64("label", F.col("band") - apart).alias("unit"), F.col("chunks").alias(name))
        chunks = chunks.join(beside, "unit", "left")
    chunks = materialise(chunks.na.fill(0), "jaccard-chunks")
    dealt = meet_groups(met.drop("label", "band"), chunks, large_groups(chunks, "unit", "rows"), "unit")
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(7)), F.col("chunks")).cast("int"))

    def task(low_band, low, high_band, high, side):
        return F.struct(F.xxhash64("label", low_band, low, high_band, high).alias("key"), side.cast("int").alias("side"))

    def each(count, make):
        return F.transform(F.when(F.col(count) > 0, F.sequence(F.lit(0), F.col(count) - 1)).otherwise(F.array().cast("array<int>")), make)

    band, chunk = F.col("band"), F.col("chunk")
    within = each("chunks", lambda k: task(band, F.least(chunk, k), band, F.greatest(chunk, k), F.when(chunk == k, OWN).when(chunk > k, 1).otherwise(0)))
    above = each("above", lambda k: task(band, chunk, band + 1, k, F.lit(0)))
    below = each("below", lambda k: task(band - 1, k, band, chunk, F.lit(1)))
    narrow = dealt.select("node", F.explode(F.concat(within, above, below)).alias("task")).select("node", "task.*")
    rows = narrow.join(lists, "node").select("key", "side", "node", "n", "matches", "width", "copies", "tokens")

    def compare(table: pa.Table) -> pa.Table:
        node, n, matches, widths, copies, sides = (table.column(c).to_numpy() for c in ("node", "n", "matches", "width", "copies", "side"))
        order = np.argsort(node)
        node, n, matches, widths, copies, sides = (c[order] for c in (node, n, matches, widths, copies, sides))
        tokens = _numbers(table.column("tokens").take(pa.array(order)), np.uint64)
        i, j = linked_pairs(n, matches, widths, tokens, sides, share)
        label = smallest_reached(len(node), i, j)
        links = np.bincount(np.r_[i, j], weights=copies[np.r_[j, i]], minlength=len(node)).astype(np.int64)
        some = links > 0
        return pa.table({"node": node[some], "root": node[label[some]], "links": links[some]})

    def one_key(table: pa.Table) -> pa.Table:
        found = compare(table)
        if table.nbytes > LARGE_KEY:
            give_back()
        return found

    return rows.groupBy("key").applyInArrow(one_key, "node long, root long, links long")


def smallest_reached(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that each of ``n`` reaches through the pairs."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def paired_links(cold: DataFrame, lists: DataFrame, share: int) -> DataFrame:
    """Links between nodes that meet under rare tokens only: node, root, links. ``cold`` has token, node, n, matches, label."""
    a, b = cold.alias("a"), cold.alias("b")
    near = 100 * F.least("a.n", "b.n") >= share * F.greatest("a.n", "b.n")
    apart = F.col("a.label").isNull() | F.col("b.label").isNull() | (F.col("a.label") != F.col("b.label"))
    met = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.node") < F.col("b.node")) & near & apart)
    pairs = met.groupBy(F.col("a.node").alias("x"), F.col("b.node").alias("y")).agg(F.count("*").alias("shared"), F.any_value(F.least("a.matches", "b.matches")).alias("wanted"))
    pairs = pairs.where("shared >= wanted").select("x", "y")
    for end, side in (("x", "left"), ("y", "right")):
        pairs = pairs.join(lists.select(F.col("node").alias(end), F.col("n").alias(f"{end}_n"), F.col("copies").alias(f"{end}_copies"), F.col("tokens").alias(side)), end)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for p, q, x, y in zip(*(batch.column(c).to_pylist() for c in range(4))):
                common = len(np.intersect1d(np.frombuffer(p, dtype=np.uint64), np.frombuffer(q, dtype=np.uint64), assume_unique=True))
                found.append(100 * common >= share * (x + y - common))
            found = np.array(found, dtype=bool)
            x, y, x_copies, y_copies = (batch.column(c).to_numpy()[found] for c in range(4, 8))
            columns = [np.r_[x, y], np.r_[x, x], np.r_[y_copies, x_copies]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["node", "root", "links"])

    return pairs.select("left", "right", "x_n", "y_n", "x", "y", "x_copies", "y_copies").mapInArrow(compare, "node long, root long, links long")


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, share: int = 90) -> DataFrame:
    """One row per document: doc_id, n_shingles (size of its set), component_id (smallest id reachable by links, its own
    included) and n_links (other documents it is linked with). ``share`` is in hundredths."""
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit("").cast("binary"))
    rows = numbered(docs.select(F.col(id_col).alias("doc_id"), text.alias("text")))
    rows = rows.withColumn("node", F.xxhash64("text"))
    told = materialise(rows.select("doc_id", *PLACE, "node", F.octet_length("text").alias("size")), "jaccard-rows")
    nodes = told.groupBy("node").agg(F.min(F.struct(*PLACE)).alias("place"), F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.any_value("size").alias("size"))
    nodes = materialise(nodes, "jaccard-nodes")

    def buckets(of: DataFrame) -> int:
        return 1 + (of.agg(F.sum("size")).first()[0] or 0) // (6 * BUCKET)

    texts = rows.select("node", "text", *PLACE)
    sizes = materialise(set_sizes(keep_rows(texts, nodes.select("place.*")), buckets(nodes), shingle, share), "jaccard-sizes")
    live = materialise(nodes.join(sizes.where("live"), "node").select("node", "place", "size", "copies"), "jaccard-live")
    lists = token_lists(keep_rows(texts, live.select("place.*")), buckets(live), shingle, share)
    lists = materialise(lists.join(live.select("node", "copies"), "node"), "jaccard-lists")
    posted = materialise(prefix_tokens(lists), "jaccard-prefixes")
    groups = materialise(posted.groupBy("token").agg(F.count("*").alias("nodes"), F.min("node").alias("head")).where("nodes > 1"), "jaccard-tokens")
    met = materialise(meet_groups(posted, groups, large_groups(groups, "token", "nodes"), "token"), "jaccard-met")
    components = materialise(spread_labels(met.where(F.col("nodes") > HOT).select(F.col("node").alias("leaf"), F.col("head").alias("root"))), "jaccard-hot")
    members = lists.join(components, "node").select("node", "label", "n", F.octet_length("tokens").alias("size"))
    cold = met.where(F.col("nodes") <= HOT).join(components, "node", "left").select("token", "node", "n", "matches", "label")
    links = materialise(connected_links(members, lists, share).unionByName(paired_links(cold, lists, share)), "jaccard-links")
    labels = spread_labels(links.select(F.col("node").alias("leaf"), "root"))
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.join(sizes.select("node", "n"), "node").join(labels, "node", "left").join(counts, "node", "left")
    named = materialise(named.select("node", "n", "first_id", "copies", F.coalesce("label", "node").alias("label"), F.coalesce("links", F.lit(0)).alias("links")), "jaccard-named")
    heads = materialise(named.groupBy("label").agg(F.min("first_id").alias("component_id"), F.count("*").alias("members")), "jaccard-heads")
    named = meet_groups(named, heads.drop("members"), large_groups(heads, "label", "members"), "label")
    named = materialise(named.select("node", "n", "copies", "links", "component_id"), "jaccard-classes")
    full = meet_groups(told.select("doc_id", "node"), named, large_groups(nodes, "node", "copies"), "node")
    empty = F.col("n") == 0
    return full.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(empty, 0).otherwise(F.col("copies") - 1 + F.col("links")).cast("long").alias("n_links"),
    )
