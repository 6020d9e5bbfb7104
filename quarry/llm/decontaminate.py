"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.shared import arrow_map, buffers, cut, id_key, own_columns, release, steps, table, text_key, without, words_at

#: Words of a seed; a shorter item is one seed of all its words.
GRAM = 3
#: A seed is rare if no more documents have it than so many times the median of its item's seeds.
RARE = 10
#: Alignment scores, and the share of an item's best possible score that counts as a copy.
MATCH, MISMATCH, GAP = 2, -1, -1
LEAK = 0.6
#: A passage is a copy as well if its alignment scores as many words in a row do, whatever share of the item that is.
PASSAGE = 13
#: A copy of an item of n words by substitutions that scores LEAK keeps SHARE_SEEDS * n - 2 seeds at least; so many, MOST_SEEDS at most, are asked of a passage.
SHARE_SEEDS, MOST_SEEDS = 0.2, 3
#: Characters of test items that are sent to the executors at once; more are taken in blocks.
BLOCK_CHARS = 16 << 20

_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[:1] = 1
    return np.cumprod(p)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of every word: letters, digits and whatever is not ASCII."""
    start, end = words_at(data, offsets, _IS_WORD)
    if not len(start):
        return start, end, np.zeros(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data)))])
    h = (sums[end] - sums[start]) * _powers(_INVERSE, len(data) + 1)[start]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return start, end, h ^ (h >> np.uint64(29))


def gram_hashes(h: np.ndarray, size: int) -> np.ndarray:
    g = h[: len(h) - size + 1].copy()
    for i in range(1, size):
        g = (g ^ (g >> np.uint64(32))) * np.uint64(0x94D049BB133111EB) + h[i : len(h) - size + 1 + i]
    return g


def lowered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of texts in lower case: the same function for items and documents."""
    return buffers(pc.utf8_lower(texts))


@dataclass
class Items:
    """Test items: their ids and word hashes, and where each seed stands in them."""

    ids: list[int]
    words: list[np.ndarray]
    lengths: np.ndarray
    grams: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    bits: np.ndarray
    rare: np.ndarray

    @property
    def sizes(self) -> list[int]:
        """Words of the seeds that occur."""
        return sorted({GRAM, *np.minimum(self.lengths, GRAM).tolist()})

    def hits(self, h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word and seed of every place where the words *h* of the rows *row* have a seed."""
        at, seeds = [], []
        for size in self.sizes:
            if len(h) < size:
                continue
            g = gram_hashes(h, size) + np.uint64(size)
            maybe = np.flatnonzero(self.bits[(g >> np.uint64(44)).astype(np.int64)])
            where = np.searchsorted(self.grams, g[maybe])
            ok = self.grams[np.minimum(where, len(self.grams) - 1)] == g[maybe]
            maybe, where = maybe[ok], where[ok]
            ok = row[maybe] == row[maybe + size - 1]
            at.append(maybe[ok]), seeds.append(where[ok])
        return np.concatenate([np.zeros(0, np.int64), *at]), np.concatenate([np.zeros(0, np.int64), *seeds])


def index_items(rows: list[tuple[int, str]]) -> Items:
    """The seeds of test items. An item without words has none."""
    ids, words, g, item, place = [], [], [], [], []
    offsets, data = lowered(pa.array([t for _, t in rows], pa.string()))
    for k, (item_id, _) in enumerate(rows):
        raw = data[offsets[k] : offsets[k + 1]]
        h = word_hashes(raw, np.array([0, len(raw)]))[2]
        if not len(h):
            continue
        size = min(GRAM, len(h))
        seeds = gram_hashes(h, size) + np.uint64(size)
        g.append(seeds), item.append(np.full(len(seeds), len(ids))), place.append(np.arange(len(seeds)))
        ids.append(item_id), words.append(h)
    g, item, place = (np.concatenate([np.zeros(0, k), *x]).astype(k) for x, k in ((g, np.uint64), (item, np.int64), (place, np.int64)))
    order = np.argsort(g, kind="stable")
    g, item, place = g[order], item[order], place[order]
    grams, first = np.unique(g, return_index=True)
    bits = np.zeros(1 << 20, bool)
    bits[(grams >> np.uint64(44)).astype(np.int64)] = True
    return Items(ids, words, np.array([len(w) for w in words], np.int64), grams, np.append(first, len(g)), item, place, bits, np.ones(len(g), bool))


def mark_rare(x: Items, spread: dict[int, int]) -> None:
    """Marks the seeds of each item whose document count (*spread*, by seed) is at most RARE times the median of the item's."""
    of_seed = np.array([spread.get(k, 0) for k in range(len(x.grams))], np.int64)
    df = np.repeat(of_seed, np.diff(x.first))
    order = np.lexsort((df, x.item))
    starts = np.searchsorted(x.item[order], np.arange(len(x.ids)))
    count = np.bincount(x.item, minlength=len(x.ids))
    seen = np.bincount(x.item, df > 0, minlength=len(x.ids)).astype(np.int64)  # the median of those that occur
    middle = df[order][np.minimum(starts + count - seen + seen // 2, len(df) - 1)]
    x.rare = df <= RARE * np.maximum(middle, 1)[x.item]


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment score of the word hashes *a* within *b*, and where it starts and ends in *b*.

    A cell carries its score and the earliest start of an alignment of that score, as one number.
    """
    n, shift = len(b), 32
    mask = (1 << shift) - 1
    fresh = (mask - np.arange(n + 1)).astype(np.int64)  # score zero, starting at the next word
    across = np.arange(n + 1) * (-GAP << shift)
    row, best, at = fresh.copy(), 0, 0
    for w in a:
        gain = np.where(b == w, MATCH << shift, MISMATCH << shift)
        new = np.empty(n + 1, np.int64)
        new[0] = fresh[0]
        np.maximum(row[:-1] + gain, row[1:] + (GAP << shift), out=new[1:])
        new = np.maximum(new, fresh)
        new = np.maximum.accumulate(new + across) - across
        new = np.where(new >> shift > 0, new, fresh)
        j = int(np.argmax(new))
        if new[j] > best:
            best, at = int(new[j]), j
        row = new
    return best >> shift, mask - (best & mask), at


def _words(b: pa.RecordBatch) -> Iterator[tuple]:
    """Parts of a batch: first row, row offsets, bytes, starts, ends, hashes and rows of the words."""
    offsets, data = lowered(b.column("text"))
    for i, j in steps(offsets, 1 << 18):
        off = offsets[i : j + 1] - offsets[i]
        part = data[offsets[i] : offsets[j]]
        start, end, h = word_hashes(part, off)
        if len(h):
            yield i, off, part, start, end, h, np.searchsorted(off, start, "right") - 1


def seed_counts(docs: DataFrame, items: Broadcast) -> DataFrame:
    """seed (its number) and df, the documents that have it: a row for each seed of the items at most."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x: Items = items.value
        total = np.zeros(len(x.grams), np.int64)
        for b in batches:
            for _, _, _, _, _, h, row in _words(b):
                at, seed = x.hits(h, row)
                each = np.unique(row[at] * len(x.grams) + seed) % len(x.grams)
                total += np.bincount(each, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["seed", "df"])
        release()

    return docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(work, "seed long, df long").groupBy("seed").agg(F.sum("df").alias("df"))


def candidates(docs: DataFrame, items: Broadcast) -> DataFrame:
    """_id, _k, item, n_seeds and a window of text for every passage that shares a rare seed, and seeds enough, with an item."""

    def work(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x: Items = items.value
        need = np.clip((SHARE_SEEDS * x.lengths).astype(np.int64) - 2, 1, MOST_SEEDS)
        ids, ks = b.column("_id").to_numpy(), b.column("_k").to_numpy()
        for i, off, part, start, end, h, row in _words(b):
            maybe, where = x.hits(h, row)
            if not len(maybe):
                continue
            many = x.first[where + 1] - x.first[where]
            hit = np.repeat(np.arange(len(maybe)), many)
            at = np.repeat(x.first[where] - np.cumsum(many) + many, many) + np.arange(many.sum())
            word, item, place, rare, seed = maybe[hit], x.item[at], x.place[at], x.rare[at], where[hit]
            order = np.lexsort((word, item, row[word]))
            word, item, place, rare, seed = word[order], item[order], place[order], rare[order], seed[order]
            length = x.lengths[item]
            new = np.ones(len(word), bool)
            new[1:] = (row[word[1:]] != row[word[:-1]]) | (item[1:] != item[:-1]) | (word[1:] - word[:-1] > length[1:])
            edge = np.append(np.flatnonzero(new), len(word))
            run = np.cumsum(new) - 1
            kinds = np.bincount(np.unique(np.stack([run, seed]), axis=1)[0], minlength=len(edge) - 1)  # different seeds
            good = (np.bincount(run, rare, minlength=len(edge) - 1) > 0) & (kinds >= need[item[edge[:-1]]])
            word_of_row = np.searchsorted(start, off)  # first word of each row
            out: list[list] = [[] for _ in range(6)]
            raw = part.tobytes()
            for k in np.flatnonzero(good).tolist():
                s, e = int(edge[k]), int(edge[k + 1])
                r, n = int(row[word[s]]), int(length[s])
                slack = n // 4 + GRAM
                lo = max(int(word_of_row[r]), int((word[s:e] - place[s:e]).min()) - slack)
                hi = min(int(word_of_row[r + 1]), int((word[s:e] - place[s:e]).max()) + n + slack)
                for c, v in enumerate((ids[i + r], ks[i + r], int(item[s]), int(kinds[k]), lo - int(word_of_row[r]), raw[start[lo] : end[hi - 1]])):
                    out[c].append(v)
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, types, strict=True)], names=["_id", "_k", "item", "n_seeds", "first", "window"])

    return arrow_map(docs.select("_id", "_k", F.coalesce("text", F.lit("")).alias("text")), work, "_id long, _k long, item int, n_seeds int, first long, window binary")


def _block(docs: DataFrame, rows: list[tuple[int, str]], leak: float) -> DataFrame:
    index, context = index_items(rows), docs.sparkSession.sparkContext
    if len(index.grams):
        mark_rare(index, {r.seed: r.df for r in seed_counts(docs, context.broadcast(index)).toLocalIterator()})  # bounded by the block
    items = context.broadcast(index)
    found = candidates(docs if len(index.grams) else docs.limit(0), items)

    def score(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x: Items = items.value
        offsets, data = buffers(b.column("window"))
        start, _, h = word_hashes(data, offsets)
        of_row = np.searchsorted(start, offsets)
        item = b.column("item").to_pylist()
        got = [align(x.words[k], h[of_row[i] : of_row[i + 1]]) for i, k in enumerate(item)]
        first = b.column("first").to_numpy()
        columns = [pa.array([x.ids[k] for k in item], pa.int64()), pa.array([s / (MATCH * len(x.words[k])) for (s, _, _), k in zip(got, item, strict=True)], pa.float64())]
        columns += [pa.array([s / MATCH for s, _, _ in got], pa.float64())]
        columns += [pa.array(first + np.array([v[i] for v in got], np.int64)) for i in (1, 2)]
        yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("_id", "_k", "n_seeds")], *columns], names=["_id", "_k", "n_seeds", "item_id", "score", "alike", "first_word", "end_word"])

    scored = arrow_map(found, score, "_id long, _k long, n_seeds int, item_id long, score double, alike double, first_word long, end_word long").filter((F.col("score") >= leak) | (F.col("alike") >= PASSAGE))
    best = F.max_by(F.struct("first_word", "end_word", "n_seeds"), F.struct(F.col("score"), -F.col("first_word")))
    return scored.groupBy("_id", "_k", "item_id").agg(F.max("score").alias("score"), best.alias("b")).select("_id", "_k", "item_id", "score", "b.*")


def leaks(docs: DataFrame, items: DataFrame, leak: float = LEAK, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, score, first_word, end_word and n_seeds of every document passage that copies a test item.

    Every gram of GRAM words of the items (all words of a shorter item) is looked up in every whole text, twice: first
    its documents are counted, and the count decides whether it is a rare seed of its item. Passages with a rare seed, and
    as many seeds as a copy keeps (MOST_SEEDS at most), are then aligned with the item word by word, which allows for words changed, put in or left out. The score is the
    share of the best possible one; from *leak* on it is a copy, and so is a part of a long item whose alignment
    scores as PASSAGE words in a row do. The best passage of each document and item is returned. A phrase that a text shares with an item by chance scores low.

    Test items are the stated query set: their total size is measured, and beyond *block_chars* they are
    taken in blocks, each against all documents. Null and empty texts have no passages, items without
    words are never found, and items without an id or text are left out; repeated items give a row each id; rows that repeat a document id and text give one row. Extra columns
    are ignored; an empty table gives an empty result.
    """
    d, out = _leaks(docs, items, leak, block_chars)
    return out.withColumn("doc_id", F.when(F.col("_id") != F.lit(-(2**63)), F.col("_id"))).select("doc_id", "item_id", "score", "first_word", "end_word", "n_seeds")


def _leaks(docs: DataFrame, items: DataFrame, leak: float, block_chars: int) -> tuple[DataFrame, DataFrame]:
    d = own_columns(docs, "doc_id", "text").select(id_key("doc_id").cast("long").alias("_id"), text_key("text").alias("_k"), "text")
    t = own_columns(items, "item_id", "text").filter("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    total = t.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_chars))
    out = None
    for k in range(blocks):
        part = t.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k) if blocks > 1 else t
        found = _block(d, [(r.item_id, r.text) for r in part.orderBy("item_id", "text").collect()], leak)
        out = found if out is None else out.unionByName(found)
    return d, out


def without_leaks(docs: DataFrame, items: DataFrame, leak: float = LEAK) -> DataFrame:
    """The documents that copy no test item, with their columns."""
    bad = cut(_leaks(docs, items, leak, BLOCK_CHARS)[1].select("_id", "_k").distinct())
    return without(docs, bad, "_id", "_k")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
