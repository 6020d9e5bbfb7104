"""SimHash near-duplicates: fingerprints linked through the anchors of a covering code."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.graph import components
from quarry.llm.shared import BROADCAST_ROWS, arrow_map, cut, free_names, id_key, own_columns, release, row_keys, table, text_key

SEED = 42
SHINGLE = 3
#: Bits by which linked fingerprints may differ.
THRESHOLD = 3
#: The 64 bits are two blocks; at THRESHOLD 3 one of them differs by one bit at most.
BLOCKS, BLOCK_THRESHOLD = 2, 1
#: Anchors: the words of the perfect Hamming code of this length, whose covering radius is one. A block's 32nd bit is not coded.
CODE_BITS, RADIUS = 31, 1
#: Fingerprints at home with one anchor that one task compares; a hot anchor is dealt out in tiles of so many.
TILE = 4096
#: Pairs that one vectorised comparison expands.
PAIRS = 1 << 20

_POSITIONS = np.arange(1, CODE_BITS + 1)
#: Parity masks of the code: bit j of a position's number takes part in check j.
_CHECKS = [int(sum(1 << (p - 1) for p in range(1, CODE_BITS + 1) if p >> j & 1)) for j in range(5)]
#: For each syndrome, pairs of bits whose flip leads to a code word: the anchors at distance two.
_PAIRS = np.zeros((CODE_BITS + 1, (CODE_BITS - 1) // 2), np.uint64)
for _s in range(1, CODE_BITS + 1):
    _PAIRS[_s] = [(1 << (p - 1)) | (1 << ((p ^ _s) - 1)) for p in range(1, CODE_BITS + 1) if p < p ^ _s]


def fingerprint(text: str | bytes | None) -> int:
    """The 64-bit SimHash of one text."""
    raw = text.encode() if isinstance(text, str) else text or b""
    words = raw.lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
    starts = [0, *[e + 1 for e in ends]]
    digest = xxhash.xxh64_digest
    if len(words) < SHINGLE:
        hashes = digest(joined, SEED)
    else:
        hashes = b"".join([digest(joined[s:e], SEED) for s, e in zip(starts, ends[SHINGLE - 1 :], strict=False)])
    rows = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    n, counts = len(rows), np.zeros(64, np.int64)
    for i in range(0, n, 65536):
        counts += np.unpackbits(rows[i : i + 65536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, _id, _k and fp (the 64 bits as a signed bigint) of every document; the text stays behind."""

    def work(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fps = np.fromiter((fingerprint(x.as_py()) for x in b.column("text").cast(pa.binary())), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("_id"), b.column("_k"), pa.array(fps.view(np.int64))], names=["doc_id", "_id", "_k", "fp"])

    d = own_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), id_key("doc_id").cast("long").alias("_id"), text_key("text").alias("_k"), "text")
    return arrow_map(d, work, "doc_id long, _id long, _k long, fp long")


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index into *fps* (uint64), anchor and whether it is the home anchor, for both blocks.

    The home anchor is the code word within RADIUS. The others lie within RADIUS + BLOCK_THRESHOLD,
    so a partner whose block differs by one bit has its home among them. The block's number is the anchor's top bit.
    """
    which, found, home = [], [], []
    for block in range(BLOCKS):
        v = (fps >> np.uint64(32 * block)) & np.uint64((1 << CODE_BITS) - 1)
        s = np.zeros(len(v), np.uint64)
        for j, mask in enumerate(_CHECKS):
            s |= (np.bitwise_count(v & np.uint64(mask)) & np.uint64(1)).astype(np.uint64) << np.uint64(j)
        s = s.astype(np.int64)
        flip = np.where(s > 0, np.uint64(1) << np.maximum(s - 1, 0).astype(np.uint64), np.uint64(0))
        tag = np.uint64(block << 32)
        i = np.arange(len(v))
        which.append(i), found.append((v ^ flip) | tag), home.append(np.ones(len(v), bool))
        far = np.flatnonzero(s)  # a code word has no other within distance two
        which.append(np.repeat(far, _PAIRS.shape[1])), found.append((v[far, None] ^ _PAIRS[s[far]]).ravel() | tag), home.append(np.zeros(len(far) * _PAIRS.shape[1], bool))
    return np.concatenate(which), np.concatenate(found), np.concatenate(home)


def _forest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node it reaches) that join the same nodes as the edges x, y: fewer than nodes."""
    if not len(x):
        return x, y
    nodes, ids = np.unique(np.concatenate([x, y]), return_inverse=True)
    a, b = ids[: len(x)], ids[len(x) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            deeper = new[new]
            if (deeper == new).all():
                break
            new = deeper
        if (new == label).all():
            break
        label = new
    far = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[far], nodes[label[far]]


def _compare(key: np.ndarray, fp: np.ndarray, home: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within groups of equal *key* (sorted): homes against all, PAIRS at a time, each reduced to a forest."""
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(edge, len(key)))
    h = np.flatnonzero(home)
    group = np.searchsorted(edge, h, "right") - 1
    h, group = h[size[group] > 1], group[size[group] > 1]
    ex, ey = [], []
    todo, i = size[group], 0
    ends = np.cumsum(todo)
    while i < len(h):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PAIRS, "right")))
        n = todo[i:j]
        left = np.repeat(h[i:j], n)
        right = np.repeat(edge[group[i:j]] - np.cumsum(n) + n, n) + np.arange(n.sum())
        x, y = fp[left], fp[right]
        near = (x != y) & (np.bitwise_count(x ^ y) <= threshold)
        a, b = _forest(x[near], y[near])
        ex.append(a), ey.append(b)
        i = j
    if not ex:
        return fp[:0], fp[:0]
    return _forest(np.concatenate(ex), np.concatenate(ey))


def links(fps: DataFrame, threshold: int = THRESHOLD, tile: int = TILE) -> DataFrame:
    """Edges a, b between distinct fingerprints (column fp) that have the same classes as all links within *threshold*."""
    assert threshold <= BLOCKS * (BLOCK_THRESHOLD + 1) - 1, "the covering is for a smaller threshold"

    def spread(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        v = b.column("fp").to_numpy().view(np.uint64)
        i, a, home = anchors(v)
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(v[i].view(np.int64)), pa.array(home)], names=["anchor", "fp", "home"])

    at = arrow_map(fps, spread, "anchor long, fp long, home boolean")
    hot = cut(at.filter("home").groupBy("anchor").count().filter(F.col("count") > tile).select("anchor", F.ceil(F.col("count") / tile).cast("int").alias("tiles")))
    if n := hot.count():
        at = at.join(F.broadcast(hot) if n <= BROADCAST_ROWS else hot, "anchor", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
        mine = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
        # a home row goes to its own tile, where it is compared; to the others it goes as a guest, like the rest
        at = at.select("anchor", "fp", F.col("home").alias("_home"), mine.alias("_mine"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"))
        at = at.select("anchor", "tile", "fp", (F.col("_home") & (F.col("tile") == F.col("_mine"))).alias("home"))
    else:
        at = at.withColumn("tile", F.lit(0))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: tuple[np.ndarray, ...] | None = None

        def out(k: np.ndarray, f: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
            x, y = _compare(k, f, h, threshold)
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["a", "b"])

        held, rows = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            key = b.column("anchor").to_numpy() + (b.column("tile").to_numpy().astype(np.int64) << 33)
            now = (key, b.column("fp").to_numpy().view(np.uint64), b.column("home").to_numpy(zero_copy_only=False))
            held.append(now)
            rows += b.num_rows
            if rows < 1 << 17:
                continue
            k, f, h = (np.concatenate([x[i] for x in held]) for i in range(3))
            cut_at = int(np.flatnonzero(k != k[-1])[-1]) + 1 if (k != k[-1]).any() else 0
            if cut_at:
                yield out(k[:cut_at], f[:cut_at], h[:cut_at])
            held, rows = [(k[cut_at:], f[cut_at:], h[cut_at:])], 0
        if held:
            k, f, h = (np.concatenate([x[i] for x in held]) for i in range(3))
            yield out(k, f, h)
        release()

    return at.repartition("anchor", "tile").sortWithinPartitions("tile", "anchor").mapInArrow(join, "a long, b long")


def simhash_groups(docs: DataFrame, threshold: int = THRESHOLD, tile: int = TILE) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id (smallest doc_id reachable) of every document.

    Words are runs without ASCII white space, A-Z lower-cased; shingles of three words, repeats
    included; a text of fewer words is one shingle, one without words (or null) has fingerprint zero and is linked like any other.
    Equal fingerprints are one representative before any comparison, so copies cost nothing. A pair
    within three bits differs by one bit at most in one of the two 32-bit blocks; there the home anchor
    of the one is within distance two of the other, which is replicated to every anchor that near. Per
    anchor the homes are compared with all and give a spanning forest, never all pairs. An anchor with
    more than *tile* homes is dealt out in tiles.

    Rows that repeat an id keep a row each; the smallest id counts, and null only where no other id is
    in the component. Extra columns are ignored; an empty table gives an empty result.
    """
    fp = cut(fingerprints(docs))
    return grouped(fp, threshold, tile).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def grouped(fp: DataFrame, threshold: int = THRESHOLD, tile: int = TILE) -> DataFrame:
    """*fp* (doc_id, fp, ...) with component_id and root, the component's smallest fingerprint."""
    distinct = cut(fp.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct.select("fp"), threshold, tile))
    known = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    return fp.join(known.join(least, "root").select("fp", "root", "component_id"), "fp")


def one_of_each(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """One document of each component, that of the smallest id (then text hash; null ids last), with the columns of *docs*."""
    g = grouped(cut(fingerprints(docs)), threshold)
    chosen = g.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "_id", "_k")).alias("m")).select("m._id", "m._k")
    i, k, n = free_names(docs, "_id", "_k", "_n")
    keys = row_keys(docs)
    rows = docs.withColumns({i: keys["_id"], k: keys["_k"]}).join(chosen.select(F.col("_id").alias(i), F.col("_k").alias(k)), [i, k])
    first = Window.partitionBy(i, k).orderBy(F.lit(0))  # equal in id and text; the join has dealt them out so
    return rows.withColumn(n, F.row_number().over(first)).filter(F.col(n) == 1).select(*[f"`{c}`" for c in docs.columns])


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))
