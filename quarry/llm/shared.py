"""Helpers that the training-data operators share: reading, keys, lineage cuts, whole-text batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a missing id in joins; the id itself stays null in results.
NO_ID = -(2**63)
#: Text bytes that one vectorised step works on; bounds the memory of a Python worker.
STEP_BYTES = 1 << 20
#: Largest data side, in rows, that an operator broadcasts after counting it.
BROADCAST_ROWS = 200_000
#: The same in bytes, for sides whose rows have no bounded width.
BROADCAST_BYTES = 64 << 20
#: Folders of the tables that are cut and not yet removed.
_TABLES: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table *name* under *sf_dir*."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise *df* in the shared checkpoint folder and cut its lineage there.

    The folder is spark.checkpoint.dir of the session; a temporary one is set only where
    that is unset and the master is local. Never a localCheckpoint: executors may be lost.
    """
    _folder(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_table(df: DataFrame) -> DataFrame:
    """The same for larger tables: a compressed Parquet table in the shared checkpoint folder."""
    path = f"{_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _TABLES.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_tables() -> list[str]:
    """The folders of the tables that cut_table wrote and that are still there."""
    return list(_TABLES)


def remove_tables(spark: SparkSession, paths: list[str]) -> None:
    """Deletes folders of cut_table, once nothing reads them any more."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        if path in _TABLES:
            _TABLES.remove(path)


def _folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quarry-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def literal_table(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """A small constant table made of literals, without Python on the executors; at least one row."""
    structs = [F.struct(*[F.lit(v).alias(k) for k, v in r.items()]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def own_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; a column that the table lacks becomes null."""
    kinds = {"doc_id": "bigint", "page_id": "bigint", "item_id": "bigint", "toxic": "int", "ts": "bigint", "revisit": "boolean", "headers": "map<string,string>"}
    have = {c.lower(): c for c in df.columns}
    return df.select(*[F.col(f"`{have[n]}`").alias(n) if n in have else F.lit(None).cast(kinds.get(n, "string")).alias(n) for n in names])


def with_text(df: DataFrame) -> DataFrame:
    """*df* with its text column named `text`, null where it lacks one."""
    have = next((c for c in df.columns if c.lower() == "text"), None)
    return df.withColumn("text", F.lit(None).cast("string")) if have is None else df.withColumnRenamed(have, "text") if have != "text" else df


def free_names(df: DataFrame, *names: str) -> list[str]:
    """*names*, each with as many underscores before it as it takes to clash with no column of *df*."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        out.append(n)
    return out


def text_key(text: str | Column) -> Column:
    """64-bit hash of a text; with the id it tells rows apart that repeat an id."""
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def id_key(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(NO_ID))


def row_keys(docs: DataFrame) -> dict[str, Column]:
    """What tells rows apart, by the name of each key: id, text hash, language and source; a column that the table lacks counts as null."""
    own = {c.lower(): F.col(f"`{c}`") for c in docs.columns}
    get = lambda c: own.get(c, F.lit(None).cast("string"))
    return {"_id": F.coalesce(get("doc_id").cast("long"), F.lit(NO_ID)), "_k": text_key(get("text")), "_lang": F.coalesce(get("lang"), F.lit("")), "_source": F.coalesce(get("source"), F.lit(""))}


def without(docs: DataFrame, bad: DataFrame, *keys: str) -> DataFrame:
    """The rows of *docs*, with their columns, whose keys (of row_keys) are not in *bad*, a table that is cut; no column of *docs* is touched."""
    names, own = free_names(docs, *keys), row_keys(docs)
    keyed = docs.withColumns({n: own[k] for n, k in zip(names, keys, strict=True)})
    bad = bad.select(*[F.col(k).alias(n) for n, k in zip(names, keys, strict=True)])
    return keyed.join(F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad, names, "left_anti").select(*[f"`{c}`" for c in docs.columns])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1, from 0) and bytes of a string array, without copying; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    if len(column) == 0 or off is None:
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    o = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return o - o[0], d[o[0] : o[-1]]


def steps(offsets: np.ndarray, size: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about *size* bytes each; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = j


def release() -> None:
    """Gives memory that is free in this worker back to the system; workers wait for the next task, beside others' memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def arrow_map(df: DataFrame, work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow over batches; *work* gets one batch and yields batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield from work(b)
        release()

    return df.mapInArrow(run, schema)


def words_at(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes; a run never crosses a row."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    w = is_word[data]
    first = np.empty(len(w), bool)
    first[0] = w[0]
    np.logical_and(w[1:], ~w[:-1], out=first[1:])
    last = np.empty(len(w), bool)
    last[-1] = w[-1]
    np.logical_and(w[:-1], ~w[1:], out=last[:-1])
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(w))]
    first[inner] = w[inner]
    last[inner - 1] = w[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1
