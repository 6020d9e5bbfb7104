"""Removal of repeated byte strings with suffix arrays built by induced sorting.

A 200-byte string is found equal to another only if both have the same anchor, the 32-byte gram of
smallest hash within them. Neighbouring strings that share an anchor are one slice of text; slices of
the same anchor meet in one shard, whose suffix array is made by induced sorting.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.shared import arrow_map, buffers, cut, cut_table, id_key, own_columns, steps, table, text_key

#: Bytes of a string that counts as repeated.
LENGTH = 200
#: Bytes of an anchor gram: a power of two.
GRAM = 32
#: Bytes of slices that one suffix array holds.
SHARD_BYTES = 1 << 19
#: Different slices of one anchor beyond which they are cut again, by anchors under another hash.
HOT = 4096
#: Times that slices are cut again at most; what is still together then is one shard.
LEVELS = 12

#: Text bytes that are cut into slices at a time: the hashes stay in a processor's cache.
STEP = 1 << 18

_MIX = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(t: np.ndarray, level: int = 0) -> np.ndarray:
    """64-bit hashes of the GRAM bytes from each place: words of eight bytes, combined at each doubling; others at each *level*."""
    h = np.ndarray(len(t) - 7, "<u8", np.ascontiguousarray(t), strides=(1,)) * (_MIX + np.uint64(2 * level))
    step = 8
    while step < GRAM:
        h ^= h >> np.uint64(32)
        h = h[:-step] * np.uint64(2 * step + 0xD6E8FEB86659FD93) + h[step:]
        step *= 2
    h ^= h >> np.uint64(29)
    h *= _MIX
    return h


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each *width* neighbours, by doubling."""
    step = 1
    while 2 * step <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    rest = width - step
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def slices(data: np.ndarray, offsets: np.ndarray, level: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, start, number of strings and anchor hash of every slice of the rows of one buffer."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none
    h = gram_hashes(data, level)
    packed = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    anchor = sliding_least(packed, LENGTH - GRAM + 1)
    n = np.diff(offsets) - LENGTH + 1
    rows = np.flatnonzero(n > 0)
    first, after = offsets[rows], offsets[rows] + n[rows]
    changes = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
    edges = np.unique(np.concatenate([changes, first, after]))
    row = np.searchsorted(first, edges, "right") - 1
    inside = (row >= 0) & (edges < np.append(after, 0)[row])
    size = np.diff(np.append(edges, edges[-1:] + 1))[inside]
    start = edges[inside]
    return rows[row[inside]], start, size, h[(anchor[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)].view(np.int64)


def types_of(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next (S); the sentinel is."""
    d = np.sign(np.diff(t.astype(np.int64 if t.itemsize > 1 else np.int16)))
    at = np.where(d != 0, np.arange(len(d)), len(d) - 1)
    at = np.minimum.accumulate(at[::-1])[::-1]
    return np.append(d[at] > 0, True)


def _before(t: np.ndarray, now: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffixes before *now* that are of the type *right*, stably by first byte; their bytes; how many of each byte."""
    b = now - 1
    b = b[(b >= 0)]
    b = b[right[b]]
    ch = t[b]
    order = np.argsort(ch, kind="stable")
    return b[order], ch[order], np.bincount(ch, minlength=256)


def induce(t: np.ndarray, s_type: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Suffix array from the leftmost-smaller suffixes *lms* in order, in two linear passes.

    Bucket after bucket, what a bucket holds is taken as one vector: the suffixes before its members
    go to the next free places of their own buckets, in order. Those that fall into the bucket itself
    are its next wave, so a run of one byte takes as many waves as it is long.
    """
    n = len(t)
    total = np.bincount(t, minlength=256)
    l_count = np.bincount(t[~s_type], minlength=256)
    start = np.cumsum(total) - total
    split = start + l_count
    stop = start + total
    sa = np.zeros(n, np.int32)
    l_type = ~s_type
    by = t[lms]
    order = np.argsort(by, kind="stable")
    lms, seeds = lms[order], np.searchsorted(by[order], np.arange(257))
    head = start.copy()
    for c in np.flatnonzero(total):
        done = start[c]
        while done < head[c]:
            now, done = sa[done : head[c]], int(head[c])
            b, ch, k = _before(t, now, l_type)
            sa[(head - np.cumsum(k) + k)[ch] + np.arange(len(ch))] = b
            head += k
        now = lms[seeds[c] : seeds[c + 1]]
        if len(now):
            b, ch, k = _before(t, now, l_type)
            sa[(head - np.cumsum(k) + k)[ch] + np.arange(len(ch))] = b
            head += k
    tail = stop.copy()
    tail[0] -= 1  # the sentinel's place
    sa[0] = n - 1
    for c in np.flatnonzero(total)[::-1]:
        done = int(stop[c])
        while True:
            now, low = sa[tail[c] : done][::-1], int(tail[c])
            if c == 0 or not len(now):
                break
            done = low
            b, ch, k = _before(t, now, s_type)
            sa[(tail + np.cumsum(k) - k)[ch] - 1 - np.arange(len(ch))] = b
            tail -= k
        now = sa[start[c] : split[c]][::-1] if c else sa[0:1]
        if len(now):
            b, ch, k = _before(t, now, s_type)
            sa[(tail + np.cumsum(k) - k)[ch] - 1 - np.arange(len(ch))] = b
            tail -= k
    return sa


def induced(t: list[int], s_type: list[bool], sizes: list[int], lms: list[int]) -> list[int]:
    """The same for the numbers of a reduced string, whose buckets are too many and small for vectors: one place at a time."""
    heads, at = [], 0
    for k in sizes:
        heads.append(at)
        at += k
    tails = [*heads[1:], at]
    sa, free = [-1] * len(t), tails.copy()
    for i in reversed(lms):
        c = t[i]
        free[c] -= 1
        sa[free[c]] = i
    for k in range(len(t)):
        i = sa[k] - 1
        if i >= 0 and not s_type[i]:
            c = t[i]
            sa[heads[c]] = i
            heads[c] += 1
    for k in range(len(t) - 1, -1, -1):
        i = sa[k] - 1
        if i >= 0 and s_type[i]:
            c = t[i]
            tails[c] -= 1
            sa[tails[c]] = i
    return sa


def leftmost_smaller(s_type: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each suffix is of type S after one of type L, and where those are."""
    is_lms = np.zeros(len(s_type), bool)
    is_lms[1:] = s_type[1:] & ~s_type[:-1]
    return is_lms, np.flatnonzero(is_lms).astype(np.int32)


def names_of(t: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, int]:
    """The reduced string: for each leftmost-smaller substring its rank, equal ones the same; and how many ranks there are."""
    length = np.zeros(len(t), np.int32)
    length[lms] = np.append(lms[1:], len(t) - 1) - lms
    x, y = ordered[:-1].astype(np.int64), ordered[1:].astype(np.int64)
    same = length[x] == length[y]
    live, step = np.flatnonzero(same), 0
    while len(live):
        live = live[length[x[live]] >= step]
        differs = t[x[live] + step] != t[y[live] + step]
        same[live[differs]] = False
        live = live[~differs]
        step += 1
    names = np.zeros(len(t), np.int64)
    names[ordered] = np.concatenate([[0], np.cumsum(~same)])
    return names[lms], int((~same).sum()) + 1


def reduced_order(names: np.ndarray, ranks: int) -> np.ndarray:
    """Order of the suffixes of a reduced string, whose last number is the only zero."""
    if ranks == len(names):
        return np.argsort(names)
    s_type = types_of(names)
    is_lms, lms = leftmost_smaller(s_type)
    t, types, sizes = names.tolist(), s_type.tolist(), np.bincount(names, minlength=ranks).tolist()
    sa = np.array(induced(t, types, sizes, lms.tolist()))
    smaller, k = names_of(names, lms, sa[is_lms[sa]])
    return np.array(induced(t, types, sizes, lms[reduced_order(smaller, k)].tolist()))


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array of bytes that end in the only zero, the sentinel.

    The leftmost-smaller substrings are sorted by inducing from their first bytes and named; the string
    of the names is sorted in the same way, recursively, and its order induces that of all suffixes.
    """
    s_type = types_of(t)
    is_lms, lms = leftmost_smaller(s_type)
    sa = induce(t, s_type, lms)
    names, ranks = names_of(t, lms, sa[is_lms[sa]])
    return induce(t, s_type, lms[reduced_order(names, ranks)])


def permuted_lcp(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix, by text position, with the one before it in the array.

    Where the bytes before both are equal it is one less than that of the position before; only the
    others are compared, eight bytes at a time.
    """
    n = len(t)
    phi = np.zeros(n, np.int64)
    phi[sa[1:]] = sa[:-1]
    at = np.arange(n)
    hard = np.ones(n, bool)
    hard[1:] = (t[:-1] != t[phi[1:] - 1]) | (phi[1:] == 0)
    hard[sa[0]] = True
    if sa[0] + 1 < n:
        hard[sa[0] + 1] = True
    padded = np.concatenate([t, np.zeros(8, np.uint8)])
    words = np.ndarray(n + 1, "<u8", padded, strides=(1,))
    x = np.flatnonzero(hard)
    x = x[x != sa[0]]
    y = phi[x]
    lcp = np.zeros(n, np.int64)
    live, done = np.arange(len(x)), 0
    while len(live):
        a, b = x[live] + done, y[live] + done
        live, a, b = (v[(a < n) & (b < n)] for v in (live, a, b))
        d = words[a] ^ words[b]
        equal = np.where(d == 0, 8, np.bitwise_count((d & (~d + np.uint64(1))) - np.uint64(1)) >> 3)
        lcp[x[live]] += equal
        live = live[equal == 8]
        done += 8
    from_ = np.maximum.accumulate(np.where(hard, at, 0))
    return lcp[from_] - (at - from_)


def repeated(texts: list[bytes], starts: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """For each slice, which of its *starts* first places begin a LENGTH-byte string with another occurrence.

    *weight* tells how often the slice itself occurs. The suffix array of all slices, apart by 0xFF,
    has equal strings side by side; their weights are summed.
    """
    t = np.frombuffer(b"\xff".join(texts) + b"\xff\xff", np.uint8).copy()
    gaps = np.cumsum([len(x) + 1 for x in texts]) - 1
    t += 1  # bytes of UTF-8 are below 0xFE
    t[gaps] = 0xFF
    t[-1] = 0
    sa = suffix_array(t)
    lcp = permuted_lcp(t, sa)
    begin = np.concatenate([[0], gaps[:-1] + 1])
    w = np.zeros(len(t), np.int64)
    for b, k, c in zip(begin.tolist(), starts.tolist(), weight.tolist(), strict=True):
        w[b : b + k] = c
    group = np.cumsum(np.concatenate([[True], lcp[sa[1:]] < LENGTH])) - 1
    twice = np.bincount(group, w[sa])[group] >= 2
    is_twice = np.zeros(len(t), bool)
    is_twice[sa] = twice
    return [is_twice[b : b + k] for b, k in zip(begin.tolist(), starts.tolist(), strict=True)]


def occurrences(docs: DataFrame) -> DataFrame:
    """Every slice of every text: key (anchor), slice (hash of its bytes), _id, _k, start and n."""

    def work(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        offsets, data = buffers(b.column("text"))
        ids, ks = b.column("_id").to_numpy(), b.column("_k").to_numpy()
        for i, j in steps(offsets, STEP):
            lo, hi = offsets[i], offsets[j]
            row, start, n, key = slices(data[lo:hi], offsets[i : j + 1] - lo)
            if not len(row):
                continue
            raw = data[lo:hi].tobytes()
            digest = xxhash.xxh3_64_intdigest
            h = np.fromiter((digest(raw[x:y]) for x, y in zip(start.tolist(), (start + n + LENGTH - 1).tolist(), strict=True)), np.uint64, len(start))
            at = (start - (offsets[i:j] - lo)[row]).astype(np.int32)
            columns = [pa.array(x) for x in (key, h.view(np.int64), ids[i:j][row], ks[i:j][row], at, n.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "slice", "_id", "_k", "start", "n"])

    return arrow_map(docs.select("_id", "_k", "text"), work, "key long, slice long, _id long, _k long, start int, n int")


def slice_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """*wanted* (key, slice, c, n, hot and a place _id, _k, start) with the bytes of each slice, from one of the rows that are equal in id and text."""
    per_doc = wanted.groupBy("_id", "_k").agg(F.collect_list(F.struct("key", "slice", "c", "start", "n", "hot")).alias("s"))
    both = docs.join(per_doc, ["_id", "_k"]).select("_id", "_k", "text", "s")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for b in batches:
            new = []
            for x in zip(b.column("_id").to_pylist(), b.column("_k").to_pylist(), strict=True):
                new.append(x not in seen)
                seen.add(x)
            b = b.filter(pa.array(new, pa.bool_()))
            if not b.num_rows:
                continue
            offsets, data = buffers(b.column("text"))
            s = b.column("s")
            flat = s.flatten()
            row = np.repeat(np.arange(len(s)), np.diff(s.offsets.to_numpy()))
            start = flat.field("start").to_numpy() + offsets[row]
            n = flat.field("n").to_numpy()
            raw = data.tobytes()
            for i in range(0, len(row), 50_000):
                j = min(len(row), i + 50_000)
                texts = [raw[x:y] for x, y in zip(start[i:j].tolist(), (start + n + LENGTH - 1)[i:j].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*[flat.field(c).slice(i, j - i) for c in ("key", "slice", "c", "n", "hot")], pa.array(texts, pa.binary())], names=["key", "slice", "c", "n", "hot", "bytes"])

    return both.mapInArrow(work, "key long, slice long, c long, n int, hot boolean, bytes binary")


def _runs(keys: list[int], hashes: list[int], marks: list[np.ndarray]) -> pa.RecordBatch:
    """Rows key, slice, from, count for the runs of marked places."""
    k, h, f, c = [], [], [], []
    for key, sl, m in zip(keys, hashes, marks, strict=True):
        d = np.flatnonzero(np.diff(np.concatenate([[0], m.view(np.int8), [0]])))
        for x, y in zip(d[::2].tolist(), d[1::2].tolist(), strict=True):
            k.append(key), h.append(sl), f.append(x), c.append(y - x)
    return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(h, pa.int64()), pa.array(f, pa.int32()), pa.array(c, pa.int32())], names=["key", "slice", "from", "count"])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices sorted by anchor, in shards of SHARD_BYTES that end between anchors."""
    rows: dict[tuple[int, int], tuple] = {}  # a slice that comes twice is the same one
    size, last = 0, None

    def done() -> pa.RecordBatch:
        marks = repeated([r[4] for r in rows.values()], np.array([r[3] for r in rows.values()]), np.array([r[2] for r in rows.values()]))
        return _runs([r[0] for r in rows.values()], [r[1] for r in rows.values()], marks)

    for b in batches:
        for r in zip(*[b.column(c).to_pylist() for c in ("key", "slice", "c", "n", "bytes")], strict=True):
            if size >= SHARD_BYTES and r[0] != last:
                yield done()
                rows, size = {}, 0
            if (r[0], r[1]) not in rows:
                rows[r[0], r[1]] = r
                size += len(r[4])
            last = r[0]
    if rows:
        yield done()


def _cut_again(hot: DataFrame, level: int) -> DataFrame:
    """The slices of hot anchors in parts by anchors under another hash: key2, slice2, c, n and bytes of the part, and key, slice and start of where it is.

    Equal strings have equal anchors under any hash, so they still meet.
    """

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i, j in steps(buffers(batch.column("bytes"))[0], STEP):
            b = batch.slice(i, j - i)
            offsets, data = buffers(b.column("bytes"))
            row, start, n, anchor = slices(data, offsets, level)
            raw, digest = data.tobytes(), xxhash.xxh3_64_intdigest
            parts = [raw[x:y] for x, y in zip(start.tolist(), (start + n + LENGTH - 1).tolist(), strict=True)]
            key = b.column("key").to_numpy()[row]
            key2 = (key.view(np.uint64) * _MIX) ^ anchor.view(np.uint64)
            columns = [key2.view(np.int64), np.fromiter(map(digest, parts), np.uint64, len(parts)).view(np.int64), b.column("c").to_numpy()[row], n.astype(np.int32), key, b.column("slice").to_numpy()[row], (start - offsets[row]).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(parts, pa.binary())], names=["key2", "slice2", "c", "n", "key", "slice", "start", "bytes"])

    return arrow_map(hot, work, "key2 long, slice2 long, c long, n int, key long, slice long, start int, bytes binary")


def _sorted_runs(texts: DataFrame) -> DataFrame:
    return texts.repartition("key").sortWithinPartitions("key").mapInArrow(_shards, "key long, slice long, from int, count int")


def _marked(texts: DataFrame, hot: int, level: int = 1) -> DataFrame:
    """key, slice, from and count of the repeated strings of slices with bytes; the slices of hot anchors are cut again until none is hot."""
    texts = cut_table(texts)
    parts = cut_table(_cut_again(texts.filter("hot"), level))
    kinds = parts.groupBy(F.col("key2").alias("key"), F.col("slice2").alias("slice")).agg(F.sum("c").alias("c"), F.first("n").alias("n"), F.first("bytes").alias("bytes"))
    busy = cut(kinds.groupBy("key").agg(F.count("*").alias("kinds")).filter(F.col("kinds") > hot).select("key", F.lit(True).alias("hot")))
    if level < LEVELS and busy.take(1):
        kinds = kinds.join(busy, "key", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
        deeper = _marked(kinds, hot, level + 1)
    else:
        deeper = _sorted_runs(kinds)
    deeper = deeper.select(F.col("key").alias("key2"), F.col("slice").alias("slice2"), "from", "count")
    found = parts.select("key2", "slice2", "key", "slice", "start").join(deeper, ["key2", "slice2"]).select("key", "slice", (F.col("start") + F.col("from")).alias("from"), "count")
    return _sorted_runs(texts.filter("not hot")).unionByName(found)


def repeated_runs(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """_id, _k and runs (array of from, count): the starts of strings that occur elsewhere too, for documents that have any."""
    found = occurrences(docs)
    shared = cut(found.groupBy("key").count().filter("count >= 2").select("key"))
    hits = cut_table(found.join(shared, "key", "left_semi"))
    # c copies of a slice, one of which stands for all: the firsts are of one row
    kinds = hits.groupBy("key", "slice").agg(F.count("*").alias("c"), F.first("_id").alias("_id"), F.first("_k").alias("_k"), F.first("start").alias("start"), F.first("n").alias("n"))
    kinds = cut_table(kinds)
    variety = kinds.groupBy("key").agg(F.count("*").alias("kinds"))
    # a shard of one slice needs no sorting: it has each of its strings as often as there are copies
    several = cut(variety.filter("kinds > 1"))
    whole = kinds.join(several, "key", "left_anti").select("key", "slice", F.lit(0).alias("from"), F.col("n").alias("count"))
    texts = slice_texts(docs, kinds.join(several.select("key", (F.col("kinds") > hot).alias("hot")), "key"))
    if several.filter(F.col("kinds") > hot).take(1):
        marked = _marked(texts.dropDuplicates(["key", "slice"]), hot)
    else:
        marked = _sorted_runs(texts)
    runs = cut_table(marked.unionByName(whole))
    # rows that are equal in id and text have the same runs: a set, combined before the shuffle, is no larger than one of them
    return hits.join(runs, ["key", "slice"]).groupBy("_id", "_k").agg(F.collect_set(F.struct((F.col("start") + F.col("from")).alias("from"), "count")).alias("runs"))


def remove_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document.

    Every byte within a 200-byte string that starts at another place too, in this document or another,
    is removed, judged on the input; matches never cross documents. A null text is empty. Texts are
    UTF-8. Rows that repeat an id and text are copies of one another; extra columns are ignored; an
    empty table gives an empty result. The copies of a slice are counted before the shuffle, and a slice
    is sorted once; the slices of an anchor that has more than *hot* different ones are cut again by further anchors.
    """
    d = own_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), id_key("doc_id").cast("long").alias("_id"), text_key("text").alias("_k"), F.coalesce("text", F.lit("")).alias("text"))
    runs = repeated_runs(d, hot)

    def work(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        offsets, data = buffers(b.column("text"))
        removed, spans, sha = [], [], []
        for i, r in enumerate(b.column("runs")):
            text = data[offsets[i] : offsets[i + 1]]
            if r.is_valid:
                starts, counts = (r.values.field(x).to_numpy().astype(np.int64) for x in ("from", "count"))
                edge = np.zeros(len(text) + 1, np.int64)
                np.add.at(edge, starts, 1)
                np.add.at(edge, starts + counts + LENGTH - 1, -1)
                gone = np.cumsum(edge[:-1]) > 0
                removed.append(int(gone.sum()))
                spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                text = text[~gone]
            else:
                removed.append(0), spans.append(0)
            sha.append(hashlib.sha256(text.tobytes()).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return arrow_map(d.join(runs, ["_id", "_k"], "left").select("doc_id", "text", "runs"), work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
