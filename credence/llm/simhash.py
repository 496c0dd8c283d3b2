"""Near-duplicates by SimHash fingerprints and BK-trees.

Fingerprints of equal texts are merged first.  Two 64-bit fingerprints that differ in at most
`radius` bits agree in at least `blocks - radius` of `blocks` bit blocks, so each fingerprint is
sent to one bucket for every choice of that many blocks, and both ends of a link meet in one
bucket.  A bucket is the shard of a BK-tree: children hang at the edge numbered by their Hamming
distance to the parent, and a search for a fingerprint at distance d from a node follows only
the edges d - radius to d + radius.  All trees together grow with the corpus, so they are not
broadcast from the driver; the shuffle brings each shard and its queries to one task.

A bucket with more than `shard_rows` fingerprints is cut into shards.  Each has a tree of its
own, and in a second step every pair of shards of that bucket meets in a task of its own, so no
task holds more than two shards.  Tasks put out spanning links only, never all pairs.

`near_duplicates` links fingerprints of word shingles by their distance alone.  `similar_groups` is
for a Jaccard similarity of texts: its candidates are the fingerprints of the distinct shingles
within a wide radius, found in BK-trees, and an exact check of the hashed shingles follows.  With
such a radius no choice of bit blocks is equal in both ends of a link, so the trees are sharded by
bands of minimum hashes of the same shingles, in which both ends meet whatever the kind of edit.
Of the shards with the same members one is taken, and texts without a partner send no shingles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from credence.llm.common import (column, join_checked, packed, pieces, records, stored,
                                 unpacked)
from credence.llm.components import connected_components

_SKETCH_LONGS = 4       # 256 bits
_FOUND = pa.schema([("m", pa.int32()), ("v", pa.int64()), ("shard", pa.int32()),
                    ("a", pa.int64()), ("b", pa.int64()), ("fp", pa.int64()),
                    ("sketch", pa.list_(pa.int64()))])
_FOUND_SQL = "m int, v bigint, shard int, a bigint, b bigint, fp bigint, sketch array<bigint>"
_PAIR_BLOCK = 2_000_000     # (query, node) visits that are held at a time
_SEARCH_BLOCK = 250_000     # the same where the hashes of a shard are held beside them
_CHUNK = 65_536             # bucket rows per step of a task
_SHARD_HASHES = 1 << 20     # shingles of a shard of a bucket of similar texts


def _hashes(text: bytes, words: int) -> list[int]:
    """XXH64 of every shingle; of the whole sequence if there are fewer words."""
    found = text.lower().split()
    if not found:
        return []
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) < words:
        return [digest(joined, 42)]
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    return [digest(joined[a:b], 42) for a, b in
            zip(starts[:len(found) - words + 1].tolist(), ends[words - 1:].tolist())]


def fingerprint(text: bytes, words: int = 3, distinct: bool = False) -> int:
    """SimHash of the UTF-8 text as a signed integer; 0 if it has no word.  With `distinct` each
    different shingle counts once."""
    hashes = _hashes(text, words)
    if distinct:
        hashes = list(set(hashes))
    return _majority(hashes)


def _majority(hashes: list[int] | np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):   # a very long text is unpacked piece by piece
        part = np.array(hashes[at:at + (1 << 16)], np.uint64).astype(">u8").view(np.uint8)
        ones += np.unpackbits(part.reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


_MULTIPLY = np.random.default_rng(7).integers(0, 1 << 32, 256, dtype=np.uint32) | np.uint32(1)
_ADD = np.random.default_rng(8).integers(0, 1 << 32, 256, dtype=np.uint32)


def _least(shingles: np.ndarray) -> np.ndarray:
    """256 minimum hashes of uint64 shingle hashes."""
    hashes = np.unique(shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(256, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(hashes), 2048):
        mixed = hashes[at:at + 2048, None] * _MULTIPLY + _ADD
        least = np.minimum(least, mixed.min(0))
    return least


def _bits(least: np.ndarray) -> list[int]:
    bits = (least * np.uint32(0x9E3779B1)) >> np.uint32(31)
    return np.packbits(bits.astype(np.uint8)).view(">u8").astype(np.int64).tolist()


def sketch(text: bytes, words: int = 5) -> list[int]:
    """One bit of each of 256 minimum hashes of the shingles.  Of two texts with Jaccard
    similarity J about (1 + J) / 2 of the bits agree, with a standard error of J below 0.04."""
    return _bits(_least(np.array(_hashes(text, words) or [0], np.uint64)))


def _bands(least: np.ndarray, bands: int, band_rows: int) -> list[int]:
    """One hash of each of `bands` runs of `band_rows` minimum hashes."""
    runs = least[:bands * band_rows].astype("<u4").reshape(bands, band_rows)
    return [xxhash.xxh64_intdigest(r.tobytes(), i) - (1 << 63) for i, r in enumerate(runs)]


def signatures(df: DataFrame, id_column: str, text_column: str, words: int, bands: int,
               band_rows: int) -> DataFrame:
    """One row per row: doc_id, text_key, node (a hash of the set of shingles), size (of that
    set), fp (its fingerprint) and bands.  A null text has no shingles and no bands."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(parts):
            rows = []
            for (text,) in records(part, "text"):
                found = np.unique(np.array(_hashes(text or b"", words), np.uint64))
                rows.append((xxhash.xxh64_intdigest(found.astype("<u8").tobytes(), 7) - (1 << 63),
                             len(found), _majority(found),
                             _bands(_least(found), bands, band_rows) if len(found) else []))
            node, size, prints, keys = zip(*rows) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [part.column(part.schema.get_field_index("doc_id")),
                 part.column(part.schema.get_field_index("text_key")),
                 pa.array(node, pa.int64()), pa.array(size, pa.int64()),
                 pa.array(prints, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "text_key", "node", "size", "fp", "bands"])

    text = column(text_column).cast("string")
    return df.select(column(id_column).cast("bigint").alias("doc_id"),
                     F.xxhash64(text).alias("text_key"), text.cast("binary").alias("text")
                     ).mapInArrow(run, "doc_id bigint, text_key bigint, node bigint, "
                                       "size bigint, fp bigint, bands array<bigint>")


def fingerprints(df: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                 words: int = 3, distinct: bool = False, sketch_words: int | None = None
                 ) -> DataFrame:
    """One row per row: doc_id, fp bigint, text_key, and sketch if `sketch_words` is given (else
    null).  A null text has no words."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            prints, sketches = [], []
            for (text,) in records(part, "text"):
                prints.append(fingerprint(text or b"", words, distinct))
                sketches.append(sketch(text or b"", sketch_words) if sketch_words else None)
            yield pa.RecordBatch.from_arrays(
                [part.column(part.schema.get_field_index("doc_id")),
                 pa.array(prints, pa.int64()),
                 part.column(part.schema.get_field_index("text_key")),
                 pa.array(sketches, pa.list_(pa.int64()))],
                names=["doc_id", "fp", "text_key", "sketch"])

    text = column(text_column).cast("string")
    return df.select(column(id_column).cast("bigint").alias("doc_id"),
                     text.cast("binary").alias("text"), F.xxhash64(text).alias("text_key")
                     ).mapInArrow(run, "doc_id bigint, fp bigint, text_key bigint, "
                                       "sketch array<bigint>")


def _width(prints: np.ndarray) -> int:
    """How many distances there are: 65 for 64 bits."""
    return 64 * (prints.shape[1] if prints.ndim > 1 else 1) + 1


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    bits = np.bitwise_count(a ^ b)
    return (bits if bits.ndim == 1 else bits.sum(1)).astype(np.int64)


def bk_tree(prints: np.ndarray, roots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest over fingerprints; roots[i] is the index of the root of i's tree.

    A fingerprint is a uint64, or a row of them.  Returns the sorted edge numbers parent * width +
    distance (width: 65 for one uint64) and the child at each edge.  All rows descend together, one
    level a step; the first to come to an empty edge becomes its child.
    """
    going, width = np.flatnonzero(roots != np.arange(len(prints))), _width(prints)
    at, edges, children = roots[going], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    while len(going):
        edge = at * width + _distances(prints[going], prints[at])
        taken, first = np.unique(edge, return_index=True)
        edges.append(taken)
        children.append(going[first])
        at = going[first][np.searchsorted(taken, edge)]
        left = at != going
        going, at = going[left], at[left]
    edge, child = np.concatenate(edges), np.concatenate(children)
    order = np.argsort(edge)
    return edge[order], child[order]


def bk_search(queries: np.ndarray, starts: np.ndarray, prints: np.ndarray, edges: np.ndarray,
              children: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) index pairs within the radius; query i begins at the root starts[i]."""
    ask, node, hits, width = np.arange(len(queries)), starts, [], _width(prints)
    while len(ask):
        distance = _distances(queries[ask], prints[node])
        near = distance <= radius
        hits.append((ask[near], node[near]))
        # The edges of a node lie side by side, by their distance.
        first = np.searchsorted(edges, node * width + np.maximum(distance - radius, 0))
        last = np.searchsorted(edges, node * width + np.minimum(distance + radius, width - 1),
                               "right")
        count = last - first
        place = np.repeat(last - np.cumsum(count), count) + np.arange(count.sum())
        ask, node = np.repeat(ask, count), children[place]
    return (np.concatenate([h[0] for h in hits] or [np.empty(0, np.int64)]),
            np.concatenate([h[1] for h in hits] or [np.empty(0, np.int64)]))


def _spanning(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index linked to each index."""
    label = np.arange(size)
    while True:
        least = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, a, least)
        np.minimum.at(after, b, least)
        after = after[after]
        if np.array_equal(after, label):
            return label
        label = after


def _confirmed(a: np.ndarray, b: np.ndarray, sketches: np.ndarray | None, most: int
               ) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose sketches differ in at most `most` bits."""
    if sketches is None:
        return a, b
    near = np.bitwise_count(sketches[a] ^ sketches[b]).sum(1, dtype=np.int64) <= most
    return a[near], b[near]


def _tree_links(prints: np.ndarray, roots: np.ndarray, radius: int,
                sketches: np.ndarray | None = None, most: int = 0) -> tuple:
    """Spanning links of each tree's fingerprints, as two index arrays."""
    edges, children = bk_tree(prints, roots)
    sizes = np.bincount(roots, minlength=len(prints))[roots]
    ask = np.flatnonzero(sizes > 1)
    block = np.cumsum(sizes[ask]) // _PAIR_BLOCK
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for k in range(int(block[-1]) + 1 if len(ask) else 0):
        some = ask[block == k]
        q, node = bk_search(prints[some], roots[some], prints, edges, children, radius)
        found.append(_confirmed(some[q], node, sketches, most))
    label = _spanning(len(prints), *map(np.concatenate, zip(*found)))
    linked = np.flatnonzero(label != np.arange(len(prints)))
    return linked, label[linked]


def _cross_links(tree: np.ndarray, asked: np.ndarray, radius: int,
                 sketches: np.ndarray | None = None, most: int = 0) -> tuple:
    """Spanning links between two shards of one bucket; sketches are those of both."""
    edges, children = bk_tree(tree, np.zeros(len(tree), np.int64))
    step = max(1, _PAIR_BLOCK // len(tree))
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for at in range(0, len(asked), step):
        some = asked[at:at + step]
        q, node = bk_search(some, np.zeros(len(some), np.int64), tree, edges, children, radius)
        found.append(_confirmed(q + at + len(tree), node, sketches, most))
    label = _spanning(len(tree) + len(asked), *map(np.concatenate, zip(*found)))
    linked = np.flatnonzero(label != np.arange(len(label)))
    return linked, label[linked]


def _block_masks(blocks: int, radius: int) -> list[int]:
    """Signed 64-bit masks of every choice of blocks - radius blocks."""
    bounds = [64 * i // blocks for i in range(blocks + 1)]
    single = [((1 << (b - a)) - 1) << a for a, b in zip(bounds, bounds[1:])]
    masks = [sum(c) for c in combinations(single, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _table(m, v, shard, a, b, fp=None, sketches=None) -> pa.RecordBatch:
    n = len(a)
    fp = [None] * n if fp is None else fp
    sketches = [None] * n if sketches is None else list(sketches)
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(
        (m, v, shard, a, b, fp, sketches), _FOUND)], schema=_FOUND)


def _sketches(values: pa.Array | pa.ChunkedArray, n: int) -> np.ndarray | None:
    """A row of longs for each sketch; None if there are none."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if values.null_count:
        return None
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.uint64).reshape(
        n, _SKETCH_LONGS)


def links(prints: DataFrame, radius: int = 3, blocks: int = 5, shard_rows: int = 4096,
          most: int = 0) -> DataFrame:
    """Links (a, b) of nodes that connect all nodes within the radius of each other.

    `prints` has node bigint, fp bigint and sketch (array of four bigints, or null).  With
    sketches, those of two linked nodes differ in at most `most` bits.
    """
    if not 0 <= radius < blocks:
        raise ValueError("blocks must be more than radius")
    masks = _block_masks(blocks, radius)
    keyed = prints.select("node", "fp", "sketch", F.explode(F.array(*[
        F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(m)).alias("v"))
        for i, m in enumerate(masks)])).alias("k")).select("k.m", "k.v", "fp", "node", "sketch")

    def within(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted bucket rows: spanning links of each shard, and the rows of cut buckets."""
        held: list[np.ndarray] = [np.empty((0, 4), np.int64)]
        drawn: list[np.ndarray] = [np.empty((0, _SKETCH_LONGS), np.uint64)]
        count, shard, cut = 0, 0, None      # cut: the bucket whose earlier shards went out

        def work(rows: np.ndarray, sketches: np.ndarray | None, closed: bool
                 ) -> Iterator[pa.RecordBatch]:
            nonlocal shard, cut
            new = np.ones(len(rows), bool)
            new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
            first = np.flatnonzero(new)
            number = np.cumsum(new) - 1
            place = np.arange(len(rows)) - first[number]
            lead = shard if cut is not None and tuple(rows[0, :2]) == cut else 0
            piece = place // shard_rows
            roots = first[number] + piece * shard_rows
            a, b = _tree_links(rows[:, 2].astype(np.uint64), roots, radius, sketches, most)
            if len(a):
                yield _table(rows[a, 0], rows[a, 1], np.full(len(a), -1), rows[a, 3], rows[b, 3])
            piece = piece + np.where(number == 0, lead, 0)
            last = number == number[-1]
            size = np.bincount(number)[number]
            over = (size > shard_rows) | ((number == 0) & (lead > 0)) | (last & (not closed))
            if over.any():
                some = rows[over]
                yield _table(some[:, 0], some[:, 1], piece[over], some[:, 3], some[:, 3],
                             some[:, 2], None if sketches is None
                             else sketches[over].astype(np.int64))
            cut, shard = tuple(rows[-1, :2]), int(piece[-1]) + 1

        for part in parts:
            held.append(np.column_stack([part.column(i).to_numpy(zero_copy_only=False)
                                         .astype(np.int64) for i in range(4)]))
            own = _sketches(part.column(4), part.num_rows)
            drawn = None if own is None or drawn is None else [*drawn, own]
            count += part.num_rows
            if count < _CHUNK:
                continue
            rows, sketches = np.concatenate(held), drawn and np.concatenate(drawn)
            cutting = lambda a, b: None if sketches is None else sketches[a:b]
            last = np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(1))
            whole = int(last[-1]) + 1 if len(last) else 0      # buckets that have ended
            if whole:
                yield from work(rows[:whole], cutting(0, whole), True)
            full = whole
            if len(rows) - whole >= _CHUNK:     # one bucket alone: put out its full shards
                full += (len(rows) - whole) // shard_rows * shard_rows
                yield from work(rows[whole:full], cutting(whole, full), False)
            held, count = [rows[full:]], len(rows) - full
            drawn = None if sketches is None else [sketches[full:]]
        rows = np.concatenate(held)
        if len(rows):
            yield from work(rows, drawn and np.concatenate(drawn), True)

    found = stored(keyed.repartition("m", "v").sortWithinPartitions("m", "v", "fp", "node")
                   .mapInArrow(within, _FOUND_SQL), "bk-links")
    near = found.where("shard < 0").select("a", "b")
    cut = found.where("shard >= 0")
    if cut.isEmpty():
        return near

    def across(key: tuple, rows: pa.Table) -> pa.Table:
        i = key[2].as_py()
        order = np.argsort(rows.column("shard").to_numpy() != i, kind="stable")
        mine = int((rows.column("shard").to_numpy() == i).sum())
        prints = rows.column("fp").to_numpy().astype(np.uint64)[order]
        nodes = rows.column("node").to_numpy()[order]
        sketches = _sketches(rows.column("sketch"), rows.num_rows)
        a, b = _cross_links(prints[:mine], prints[mine:], radius,
                            None if sketches is None else sketches[order], most)
        return pa.table({"a": nodes[a], "b": nodes[b]})

    # Every row goes to the pairs of its shard with each other shard of its bucket.
    shards = cut.groupBy("m", "v").agg((F.max("shard") + 1).alias("n"))
    pairs = (cut.select("m", "v", "shard", "fp", F.col("a").alias("node"), "sketch")
             .join(shards, ["m", "v"])
             .select("m", "v", "shard", "fp", "node", "sketch", F.explode(F.expr(
                 "filter(sequence(0, n - 1), x -> x <> shard)")).alias("o"))
             .select("m", "v", "shard", "fp", "node", "sketch", F.least("shard", "o").alias("i"),
                     F.greatest("shard", "o").alias("j")))
    return near.union(pairs.groupBy("m", "v", "i", "j")
                      .applyInArrow(across, "a bigint, b bigint"))


def near_duplicates(df: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                    words: int = 3, radius: int = 3, blocks: int = 5, shard_rows: int = 4096
                    ) -> DataFrame:
    """The group of every row: doc_id, text_key, fp, component_id, root, n_rows.

    Rows whose fingerprints are linked, directly or over others, form a group; component_id is
    its smallest doc_id and root its smallest fingerprint.  A null or empty text has fingerprint
    0 and is linked like any other.  Repeated rows each get a row.  A null id is passed through
    and never is a component_id unless all ids of the group are null.  Other columns are ignored.
    """
    prints = stored(fingerprints(df, id_column, text_column, words).withColumn(
        "node", F.col("fp")), "fingerprints")
    return _grouped(prints, radius, blocks, shard_rows, 0)


def _searched(prints: np.ndarray, radius: int) -> Callable[[int, np.ndarray], np.ndarray]:
    """A function of a row and other rows: those whose fingerprints are within the radius.

    Equal fingerprints are one node of the BK-tree.  Searches run in blocks of nodes, each when it
    is first asked for.
    """
    distinct, of = np.unique(prints if prints.shape[1] > 1 else prints[:, 0], axis=0,
                             return_inverse=True)
    of, roots = of.reshape(-1), np.zeros(len(distinct), np.int64)
    edges, children = bk_tree(distinct, roots)
    step = max(1, _SEARCH_BLOCK // max(1, len(distinct)))
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def within(at: int, others: np.ndarray) -> np.ndarray:
        block, place = divmod(int(of[at]), step)
        if block not in held:
            some = distinct[block * step:(block + 1) * step]
            query, node = bk_search(some, roots[:len(some)], distinct, edges, children, radius)
            order = np.argsort(query, kind="stable")
            held[block] = (np.searchsorted(query[order], np.arange(len(some) + 1)),
                           node[order].astype(np.int32))
        starts, nodes = held[block]
        near = np.zeros(len(distinct), bool)
        near[nodes[starts[place]:starts[place + 1]]] = True
        return np.flatnonzero(near[of[others]])

    return within


def similar_links(hashes: np.ndarray, bounds: np.ndarray, prints: np.ndarray,
                  similarity: float, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span each group of sets with a Jaccard similarity of `similarity` or more.

    Set i is hashes[bounds[i]:bounds[i + 1]], sorted and without repeats, and prints[i] its
    fingerprint, one uint64 or more.  Each set is compared with those not yet reached whose
    fingerprints a BK-tree finds within the radius.
    """
    sizes, within = np.diff(bounds), _searched(prints, radius)
    left, a, b = np.arange(len(sizes)), [], []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            at = front.pop()
            own = hashes[bounds[at]:bounds[at + 1]]
            asked = within(at, left)
            small = np.minimum(sizes[left[asked]], sizes[at])
            asked = asked[small / np.maximum(sizes[left[asked]], sizes[at]) >= similarity]
            if not len(asked):
                continue
            some = left[asked]
            other = np.concatenate([hashes[bounds[i]:bounds[i + 1]] for i in some.tolist()])
            place = np.minimum(np.searchsorted(own, other), len(own) - 1)
            starts = np.cumsum(sizes[some]) - sizes[some]
            common = np.add.reduceat(own[place] == other, starts, dtype=np.int64)
            near = common / (len(own) + sizes[some] - common) >= similarity
            found = some[near]
            a.append(found)
            b.append(np.full(len(found), at))
            front += found.tolist()
            left = np.delete(left, asked[near])
    none = [np.empty(0, np.int64)]
    return np.concatenate(a or none), np.concatenate(b or none)


def _candidates(df: DataFrame, text_column: str, classes: DataFrame, n: int, words: int,
                shard_rows: int) -> DataFrame:
    """One row for each text and task that compares it: m, v, i, j, node, fp, hashes.

    A bucket is the texts with the hash v in band m.  One beyond `shard_rows` texts or
    _SHARD_HASHES shingles is cut into shards, and tasks compare each pair (i, j) of them.
    """
    keyed = classes.select("node", "size", F.posexplode("bands").alias("m", "v"))
    mixed = F.xxhash64("node")
    buckets = stored(
        keyed.groupBy("m", "v").agg(
            F.count("*").alias("n"), F.sum("size").alias("total"), F.bit_xor(mixed).alias("x"),
            F.min("node").alias("lo"), F.max("node").alias("hi")).where("n > 1")
        .groupBy("n", "total", "x", "lo", "hi").agg(F.min(F.struct("m", "v")).alias("k"))
        .select("k.m", "k.v", F.ceil(F.greatest(
            F.col("n") / shard_rows, F.col("total") / _SHARD_HASHES)).cast("int").alias("shards")),
        "buckets", n)
    members = stored(join_checked(keyed, buckets, ["m", "v"], "inner").select(
        "m", "v", "node", "shards"), "members")
    wanted = stored(classes.select("node", "text_key", "fp").join(
        members.select("node").distinct(), "node", "left_semi"), "wanted", n)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(parts):
            hashes = [np.unique(np.array(_hashes(text, words), np.uint64)).view(np.int64)
                      for (text,) in records(part, "text")]
            yield pa.RecordBatch.from_arrays(
                [part.column(part.schema.get_field_index("node")),
                 part.column(part.schema.get_field_index("fp")),
                 pa.array(hashes, pa.list_(pa.int64()))], names=["node", "fp", "hashes"])

    text = column(text_column).cast("string")
    texts = df.select(F.xxhash64(text).alias("text_key"), text.cast("binary").alias("text"))
    sets = join_checked(texts, wanted, ["text_key"], "inner").select(
        "node", "fp", "text").mapInArrow(
        run, "node bigint, fp bigint, hashes array<bigint>").groupBy("node").agg(
        F.any_value("fp").alias("fp"), F.any_value("hashes").alias("hashes"))
    shard = F.pmod(F.xxhash64("node", "m"), "shards").cast("int")
    others = F.expr("if(shards = 1, array(0), "
                    "filter(sequence(0, shards - 1), x -> x <> shard))")
    tasks = members.withColumn("shard", shard).select(
        "m", "v", "node", "shard", F.explode(others).alias("o")).select(
        "m", "v", "node", F.least("shard", "o").alias("i"), F.greatest("shard", "o").alias("j"))
    return tasks.join(sets, "node")


def similar_groups(df: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                   words: int = 5, similarity: float = 0.8, radius: int = 24, bands: int = 20,
                   band_rows: int = 5, shard_rows: int = 1024) -> DataFrame:
    """The group of every row (doc_id, text_key, component_id, root, n_rows), of texts whose
    `words`-word shingles have a Jaccard similarity of `similarity` or more, directly or over
    others.

    A pair of similarity J meets in a shard with probability 1 - (1 - J ** band_rows) ** bands:
    0.9996 at 0.8.  In the BK-tree of the shard it is a candidate if the fingerprints of its
    distinct shingles differ in at most `radius` of 64 bits: 9.7 are expected at 0.8, 12 for texts
    of a few shingles.  The exact similarity of the hashed shingles decides.  root is a number of the
    group.  Nulls, empty texts and repeated rows are treated as by `near_duplicates`.
    """
    if not 0 < similarity <= 1:
        raise ValueError("similarity must be above 0 and at most 1")
    if min(bands, band_rows) < 1 or bands * band_rows > 256:
        raise ValueError("bands must have 1 to 256 minimum hashes together")
    prints = stored(signatures(df, id_column, text_column, words, bands, band_rows), "signatures")
    n = prints.count()
    classes = stored(prints.groupBy("node").agg(
        F.any_value("size").alias("size"), F.any_value("fp").alias("fp"),
        F.any_value("bands").alias("bands"), F.min("text_key").alias("text_key"),
        F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "classes", n)

    def compare(rows: pa.Table) -> pa.Table:
        nodes = rows.column("node").to_numpy()
        sets = rows.column("hashes").combine_chunks()
        bounds = np.concatenate([[0], np.cumsum(sets.value_lengths().to_numpy())])
        a, b = similar_links(
            sets.flatten().to_numpy().view(np.uint64), bounds,
            rows.column("fp").to_numpy().view(np.uint64)[:, None], similarity, radius)
        return pa.table({"a": nodes[a], "b": nodes[b]})

    found = stored(_candidates(df, text_column, classes, n, words, shard_rows).groupBy(
        "m", "v", "i", "j").applyInArrow(compare, "a bigint, b bigint"), "similar-links")
    return _in_groups(prints.select("doc_id", "text_key", "node"), classes, found)


def _grouped(prints: DataFrame, radius: int, blocks: int, shard_rows: int, most: int
             ) -> DataFrame:
    classes = stored(prints.groupBy("node").agg(
        F.any_value("fp").alias("fp"), F.any_value("sketch").alias("sketch"),
        F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "classes", prints.count())
    return _in_groups(prints, classes, links(classes.select("node", "fp", "sketch"), radius,
                                             blocks, shard_rows, most)).select(
        "doc_id", "text_key", "fp", "component_id", "root", "n_rows")


def _in_groups(prints: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    """`prints` with component_id, root and n_rows of the components of the links."""
    root = connected_components(found)
    member = (classes.select("node", "first_id", "n").join(root, "node", "left")
              .withColumn("root", F.coalesce("root", "node")))
    group = member.groupBy("root").agg(F.min("first_id").alias("component_id"),
                                       F.sum("n").alias("n_rows"))
    return prints.join(member.select("node", "root").join(group, "root"), "node").drop("node")


def keep_one(df: DataFrame, id_column: str = "doc_id", text_column: str = "text",
             **options: float) -> DataFrame:
    """The rows of `df`, one of each group of similar texts: that with the smallest id, then the
    smallest text key.  Options are those of `similar_groups`.

    Of rows repeated with the same id and text one stays.  If all ids of a group are null, the
    row with the smallest text key stays.
    """
    groups = similar_groups(df, id_column, text_column, **options)
    first = stored(groups.groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("s"),
        F.count("*").alias("n")
    ).select(F.col("s.doc_id").alias("doc_id"), F.col("s.text_key").alias("text_key"), "n"),
        "survivors", df.count())
    key = F.col("row").getField(id_column).cast("bigint")
    text = F.col("row").getField(text_column).cast("string")
    # The null id gets a value of its own, so that the keys can be joined by equality.
    both = lambda d: d.withColumn("none", F.col("doc_id").isNull()).withColumn(
        "doc_id", F.coalesce("doc_id", F.lit(0).cast("bigint")))
    rows = both(packed(df).withColumn("doc_id", key).withColumn("text_key", F.xxhash64(text)))
    names = ["none", "doc_id", "text_key"]
    # The texts are shuffled once, at every size.
    kept = rows.join(both(first).select(*names), names, "left_semi")
    # Rows that repeat id and text are the only ones that still have to be made one.
    again = stored(both(groups.select("doc_id", "text_key")).groupBy(*names).agg(
        F.count("*").alias("n")).where("n > 1").select(*names), "repeated", df.count())
    if again.isEmpty():
        return unpacked(kept, df.columns)
    single = kept.join(again, names, "left_anti")
    several = kept.join(again, names, "left_semi").dropDuplicates(names)
    return unpacked(single.unionByName(several), df.columns)
