"""Exact vector search, alone or with a pattern."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators import rank


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for vectors of different length or without length."""
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), _dot(a, b) / norms).otherwise(0.0)


def vector_of(index: DataFrame, key: str, vector: str, value: object) -> list[float]:
    """The query vector of one row; one row of bounded size comes to the driver."""
    row = index.filter(F.col(key) == value).select(vector).first()
    if row is None:
        raise KeyError(value)
    return list(row[0])


def knn(index: DataFrame, key: str, vector: str, query: Sequence[float], k: int) -> DataFrame:
    """The *k* rows of highest cosine, ties by key; the limit is taken before anything is joined."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return index.select(key, cosine(F.col(vector), q).alias("score")).orderBy(F.desc("score"), key).limit(k)


#: Queries that are sent to the executors at once.
BLOCK = 2048


def knn_many(index: DataFrame, queries: DataFrame, key: str, vector: str, k: int, itself: bool = True, block: int = BLOCK) -> DataFrame:
    """query, key and score (six digits) of the *k* rows of *index* nearest to each row of *queries*, ties by key.

    The queries are taken in blocks, each against all rows. A task keeps *k* rows a query, and only these meet.
    Vectors of another length than the query's, or without length, score 0; null vectors have none.
    """
    n = queries.count()
    blocks, out = max(1, -(-n // block)), None
    for b in range(blocks):
        part = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64(key), F.lit(blocks)) == b)
        rows = part.filter(F.col(vector).isNotNull()).select(key, vector).orderBy(key).collect()  # about *block* rows
        found = _block_knn(index, [(r[0], r[1]) for r in rows], key, vector, k, itself)
        out = found if out is None else out.unionByName(found)
    return rank.top_per_key(out, ["query"], k, F.desc("score"), F.col(key))


def _block_knn(index: DataFrame, rows: list[tuple], key: str, vector: str, k: int, itself: bool) -> DataFrame:
    sizes: dict[int, tuple[list, list]] = {}
    for q, v in rows:
        names, vectors = sizes.setdefault(len(v), ([], []))
        names.append(q), vectors.append(v)
    sent = index.sparkSession.sparkContext.broadcast([(np.array(n), _unit(np.array(v, np.float64).reshape(len(n), size))) for size, (n, v) in sizes.items()])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict = {}
        for b in batches:
            ids, column = b.column(key).to_numpy(zero_copy_only=False), b.column(vector)
            lengths = pc.list_value_length(column).fill_null(-1).to_numpy()
            for names, units in sent.value:
                score = np.zeros((len(names), len(ids)))
                fit = np.flatnonzero(lengths == units.shape[1])
                if len(fit) and units.shape[1]:
                    mine = column.take(pa.array(fit)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(fit), -1)
                    score[:, fit] = np.round(units @ _unit(mine).T, 6)
                keep = lengths >= 0
                for i, q in enumerate(names.tolist()):
                    s, at = score[i][keep], ids[keep]
                    if not itself:
                        s, at = s[at != q], at[at != q]
                    old = best.get(q, (s[:0], at[:0]))
                    s, at = np.concatenate([old[0], s]), np.concatenate([old[1], at])
                    order = np.lexsort((at, -s))[:k]
                    best[q] = (s[order], at[order])
        for q, (s, at) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array([q] * len(s), id_type), pa.array(at, id_type), pa.array(s + 0.0)], names=["query", key, "score"])

    kind = index.schema[key].dataType.simpleString()
    id_type = pa.int64() if kind in ("bigint", "int") else pa.string()
    return index.select(F.col(key).cast("bigint" if id_type == pa.int64() else "string"), vector).mapInArrow(work, f"query {'bigint' if id_type == pa.int64() else 'string'}, {key} {'bigint' if id_type == pa.int64() else 'string'}, score double")


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, n, out=np.zeros_like(v), where=n > 0)


def match_context(source: Column, pattern: str, shown: int = 3, widest: int = 120) -> Column:
    """The lines of the first matches (the match itself of a wide line) between bars, and how many more there are; null without a match."""
    hits = F.regexp_extract_all(source, F.lit(f"({pattern})"), 1)
    lines = F.filter(F.split(source, "\n"), lambda x: x.rlike(pattern))
    each = F.flatten(F.transform(lines, lambda x: F.transform(F.regexp_extract_all(x, F.lit(f"({pattern})"), 1), lambda m: F.when(F.length(F.trim(x)) <= widest, F.trim(x)).otherwise(m))))
    n = F.size(hits)
    return F.when(n > 0, F.concat(F.array_join(F.slice(each, 1, shown), " | "), F.when(n > shown, F.concat(F.lit(" (+"), n - shown, F.lit(" more)"))).otherwise("")))


def similar_to(index: DataFrame, key: str, vector: str, value: object, k: int) -> DataFrame:
    """The *k* nearest of a row, without itself."""
    return knn(index.filter(F.col(key) != value), key, vector, vector_of(index, key, vector, value), k)


def boosted(score: Column, hits: Column, bonus: float = 0.2) -> Column:
    """A semantic score with a bonus for a pattern that matches, at most 1."""
    return F.when(hits > 0, F.least(score + bonus, F.lit(1.0))).otherwise(score)


def normalized(vector: Column) -> Column:
    """The vector over its L2 norm; as it is where that is zero."""
    n = F.sqrt(_dot(vector, vector))
    return F.when(n > 0, F.transform(vector, lambda x: x.cast("double") / n)).otherwise(F.transform(vector, lambda x: x.cast("double")))
