"""The vector index of a project: embedding, snapshots on disk, incremental upkeep and search.

A snapshot is a folder of Parquet tables under a root, one folder a version; the meta row is written last, so a
version without one does not exist for a reader. Versions are never changed, only followed by newer ones.
"""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import chunking, facts, joins, search

#: Version of the snapshot's layout; another one is rebuilt.
SCHEMA_VERSION = 6
#: Texts in one call of a provider at most, and chunks between two checkpoints of a build.
MOST_TEXTS, CHECKPOINT = 64, 500
#: Tries of a remote provider and seconds before the next one.
TRIES, WAITS = 3, (1, 2, 4)
#: Candidates of a search with a pattern: so many times the results, and no fewer than.
OVERFETCH, LEAST_CANDIDATES = 10, 100

META = "schema_version int, provider string, dimensions int, is_complete boolean, total_expected long, job_id string, n long, ts string"


class Provider(Protocol):
    """What turns texts into vectors; it is sent to the executors."""

    name: str
    dimensions: int

    def embed(self, texts: Sequence[str], is_query: bool = False) -> np.ndarray: ...


@dataclass(frozen=True)
class HashingProvider:
    """Vectors from hashes of words and neighbouring words; needs nothing but the text."""

    dimensions: int = 256
    name: str = "hashing"

    def embed(self, texts: Sequence[str], is_query: bool = False) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions), np.float32)
        for i, t in enumerate(texts):
            words = [w for w in "".join(c.lower() if c.isalnum() else " " for c in t or "").split() if w]
            for w in [*words, *map(" ".join, zip(words, words[1:]))]:
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, h % self.dimensions] += 1.0 if h >> 63 else -1.0
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, n, out=out, where=n > 0)


class Busy(Exception):
    """The server answers later: the call is tried again."""


def _post(url: str, body: dict, timeout: float) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return json.loads(answer.read())
    except urllib.error.HTTPError as e:
        if e.code == 503:
            raise Busy(str(e)) from e
        raise
    except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
        raise Busy(str(e)) from e


@dataclass(frozen=True)
class RemoteProvider:
    """A server that takes {"inputs", "is_query"} and gives {"embeddings"}; tried again while it is busy or cannot be reached."""

    url: str
    dimensions: int = 4096
    name: str = "remote"
    timeout: float = 60.0
    post: Callable[[str, dict, float], dict] = _post
    wait: Callable[[float], None] = time.sleep

    def embed(self, texts: Sequence[str], is_query: bool = False) -> np.ndarray:
        if len(texts) > MOST_TEXTS:
            return np.concatenate([self.embed(texts[i : i + MOST_TEXTS], is_query) for i in range(0, len(texts), MOST_TEXTS)])
        for i in range(TRIES):
            try:
                got = np.asarray(self.post(self.url, {"inputs": list(texts), "is_query": is_query}, self.timeout)["embeddings"], np.float32)
                break
            except Busy:
                if i == TRIES - 1:
                    raise
                self.wait(WAITS[i])
        if got.shape != (len(texts), self.dimensions):
            raise ValueError(f"expected {len(texts)} vectors of {self.dimensions} dimensions, got {got.shape}")
        return got


def embedded(texts: DataFrame, provider: Provider, key: str = "chunk_id", text: str = "text", batch: int = 48) -> DataFrame:
    """(*key*, embedding) of a table of texts, *batch* texts a call."""
    size = max(1, min(batch, MOST_TEXTS))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), size):
                part = b.iloc[i : i + size]
                yield pd.DataFrame({key: part[key], "embedding": list(provider.embed(part[text].fillna("").tolist()))})

    return texts.select(key, text).mapInPandas(work, f"{key} string, embedding array<float>")


def of_chunks(chunks: DataFrame, provider: Provider, batch: int = 48) -> DataFrame:
    """(chunk_id, file, kind, embedding) of chunks."""
    rows = chunks.groupBy("id").agg(F.max_by(F.struct("file", "kind", facts.embedding_text(chunks).alias("text")), F.struct("file", "line", "name")).alias("c")).select(F.col("id").alias("chunk_id"), "c.*")
    return rows.select("chunk_id", "file", "kind").join(embedded(rows, provider, batch=batch), "chunk_id")


def location(root: str, project: str) -> str:
    """The folder of a project's snapshots."""
    return f"{root.rstrip('/')}/{hashlib.sha256(project.encode()).hexdigest()}"


def _versions(spark: SparkSession, folder: str) -> list[int]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    found = [int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()]
    return sorted(v for v in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/v{v}/meta/_SUCCESS")))


def latest(spark: SparkSession, folder: str) -> int | None:
    """The newest complete version in a folder."""
    found = _versions(spark, folder)
    return found[-1] if found else None


def save(index: DataFrame, chunks: DataFrame, hashes: DataFrame, folder: str, provider: Provider, complete: bool = True, expected: int | None = None, job: str | None = None) -> int:
    """Writes the next version and gives its number. Two writers of one number collide on its folder, and the second one fails."""
    spark = index.sparkSession
    version = (latest(spark, folder) or 0) + 1
    root = f"{folder}/v{version}"
    index.write.mode("error").parquet(f"{root}/embeddings")
    chunks.write.parquet(f"{root}/chunks")
    hashes.select("path", "content_hash").write.parquet(f"{root}/hashes")
    n = spark.read.parquet(f"{root}/embeddings").count()
    meta = (SCHEMA_VERSION, provider.name, provider.dimensions, complete, n if expected is None else expected, job, n, time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()))
    spark.createDataFrame([meta], META).coalesce(1).write.json(f"{root}/meta")
    return version


@dataclass
class Snapshot:
    """One version of an index."""

    version: int
    meta: dict
    index: DataFrame
    chunks: DataFrame
    hashes: DataFrame

    def vector(self, chunk_id: str) -> list[float] | None:
        row = self.index.filter(F.col("chunk_id") == chunk_id).select("embedding").first()
        return list(row[0]) if row else None

    def chunk(self, chunk_id: str) -> DataFrame:
        return self.chunks.filter(F.col("id") == chunk_id)

    def ids(self) -> DataFrame:
        return self.index.select("chunk_id")

    def count(self) -> int:
        return self.index.count()


class Mismatch(ValueError):
    """A snapshot of another layout or of vectors of another size."""


def read(spark: SparkSession, folder: str, provider: Provider | None = None, version: int | None = None) -> Snapshot:
    """A version as it is, the newest by default. Another layout, or other dimensions than the provider's, is a Mismatch."""
    version = version or latest(spark, folder)
    if version is None:
        raise FileNotFoundError(f"no snapshot in {folder}")
    root = f"{folder}/v{version}"
    meta = spark.read.schema(META).json(f"{root}/meta").first().asDict()
    if meta["schema_version"] != SCHEMA_VERSION:
        raise Mismatch(f"layout {meta['schema_version']}, expected {SCHEMA_VERSION}")
    if provider is not None and meta["dimensions"] != provider.dimensions:
        raise Mismatch(f"{meta['dimensions']} dimensions, expected {provider.dimensions}")
    return Snapshot(version, meta, *[spark.read.parquet(f"{root}/{t}") for t in ("embeddings", "chunks", "hashes")])


def load(spark: SparkSession, folder: str, hashes: DataFrame, provider: Provider) -> tuple[Snapshot, DataFrame]:
    """The newest version without what belongs to changed files, and these (path, change): new, changed and deleted ones."""
    s = read(spark, folder, provider)
    changed = joins.difference(s.hashes, hashes, "path", "content_hash")
    gone = changed.select(F.col("path").alias("file"))
    return Snapshot(s.version, s.meta, s.index.join(gone, "file", "left_anti"), s.chunks.join(gone, "file", "left_anti"), s.hashes), changed


def reloaded(spark: SparkSession, folder: str, mine: int, indexing: bool, provider: Provider | None = None) -> Snapshot | None:
    """The newest version if another process wrote one after *mine* and none is being built here; else nothing."""
    newest = latest(spark, folder)
    return read(spark, folder, provider, newest) if newest and newest > mine and not indexing else None


def without_files(index: DataFrame, paths: DataFrame) -> DataFrame:
    """*index* without what belongs to the files *paths* (path)."""
    return index.join(paths.select(F.col("path").alias("file")), "file", "left_anti")


def without_virtual(index: DataFrame) -> DataFrame:
    return index.filter(~F.col("kind").isin(chunking.VIRTUAL))


def cleared(index: DataFrame) -> DataFrame:
    return index.limit(0)


def missing(chunks: DataFrame, index: DataFrame) -> DataFrame:
    """The chunks that have no vector yet: where a build goes on."""
    return chunks.join(index.select(F.col("chunk_id").alias("id")), "id", "left_anti")


def build(chunks: DataFrame, hashes: DataFrame, folder: str, provider: Provider, start: DataFrame | None = None, batch: int = 48, checkpoint: int = CHECKPOINT, stop_after: int | None = None) -> int:
    """Embeds what *start* lacks and writes versions: one that is not complete after each *checkpoint* batches of a cluster's tasks, a complete one at the end.

    A checkpoint takes the chunks of one hash bucket each, about *checkpoint* of them, so a build that broke off goes on with
    what is missing. *stop_after* ends after so many checkpoints (tests).
    """
    todo = chunks if start is None else missing(chunks, start)
    n, total = todo.count(), chunks.select("id").distinct().count()
    buckets = max(1, -(-n // checkpoint))
    index, version = start, 0
    for b in range(buckets):
        part = todo.filter(F.pmod(F.xxhash64("id"), F.lit(buckets)) == b) if buckets > 1 else todo
        new = of_chunks(part, provider, batch)
        done = new if index is None else index.unionByName(new)
        version = save(done, chunks, hashes, folder, provider, b == buckets - 1, total)
        index = read(chunks.sparkSession, folder, provider, version).index
        if stop_after and b + 1 >= stop_after:
            break
    return version


def reindex(files: DataFrame, nodes: DataFrame, folder: str, provider: Provider) -> int | None:
    """Brings the newest version up to date with *files*: only changed files are embedded again, and all virtual chunks; nothing if none changed."""
    spark = files.sparkSession
    old, changed = load(spark, folder, files, provider)
    if not changed.take(1):
        return None
    own = chunking.file_chunks(files, nodes)
    every = own.unionByName(chunking.virtual_chunks(own, files, nodes))
    touched = changed.filter("change <> 'deleted'").select(F.col("path").alias("file"))
    fresh = every.filter(F.col("kind").isin(chunking.VIRTUAL)).unionByName(own.join(touched, "file", "left_semi").select(own.columns))
    return save(without_virtual(old.index).select("chunk_id", "file", "kind", "embedding").unionByName(of_chunks(fresh, provider).select("chunk_id", "file", "kind", "embedding")), every, files, folder, provider)


def search_text(s: Snapshot, query: str, provider: Provider, k: int = 10) -> DataFrame:
    """The *k* chunks nearest to a text, with their rows; the chunks are joined after the limit."""
    near = search.knn(s.index, "chunk_id", "embedding", provider.embed([query], True)[0].tolist(), k)
    return s.chunks.join(F.broadcast(near), s.chunks.id == near.chunk_id).drop("chunk_id").orderBy(F.desc("score"), "id")  # k rows


def search_hybrid(s: Snapshot, files: DataFrame, provider: Provider, query: str | None, pattern: str | None, k: int = 10, required: bool = True) -> DataFrame:
    """Chunks by meaning, pattern or both: (id, file, line, score, n_matches, context).

    Without a query every chunk scores 0.5. A pattern drops what it does not match, or where it is not required lifts the
    score of what it does. The source of a candidate is the lines of its file, joined after the candidates are chosen.
    """
    if query is not None:
        near = search.knn(s.index, "chunk_id", "embedding", provider.embed([query], True)[0].tolist(), max(LEAST_CANDIDATES, k * OVERFETCH) if pattern else k)
    else:
        near = s.index.select("chunk_id", F.lit(0.5).alias("score"))
    c = s.chunks.select(F.col("id").alias("chunk_id"), "file", "line", "end_line").join(near, "chunk_id").join(files.select(F.col("path").alias("file"), "text"), "file", "left")
    source = F.array_join(F.slice(F.split(F.coalesce("text", F.lit("")), "\n"), F.greatest(F.col("line"), F.lit(1)), F.greatest(F.col("end_line") - F.col("line") + 1, F.lit(0))), "\n")
    d = c.withColumn("_s", source)
    hits = F.regexp_count("_s", F.lit(pattern)) if pattern else F.lit(0)
    d = d.withColumn("n_matches", hits).withColumn("context", search.match_context(F.col("_s"), pattern) if pattern else F.lit(None).cast("string"))
    if pattern and required:
        d = d.filter("n_matches > 0")
    score = search.boosted(F.col("score"), F.col("n_matches")) if pattern and not required else F.col("score")
    return d.select(F.col("chunk_id").alias("id"), "file", "line", score.alias("score"), "n_matches", "context").orderBy(F.desc("score"), "id").limit(k)


def status(spark: SparkSession, folder: str, indexing: bool = False, elapsed: float | None = None) -> dict:
    """Whether the index is ready, being built (percent, rate and seconds left) or not started."""
    version = latest(spark, folder)
    if version is None:
        return {"state": "indexing" if indexing else "not started", "n": 0}
    meta = read(spark, folder).meta
    n, total = meta["n"], meta["total_expected"]
    out = {"state": "ready" if meta["is_complete"] else "indexing" if indexing else "checkpoint", "version": version, "n": n, "total": total, "percent": 100 * n // total if total else 100}
    if elapsed and n and not meta["is_complete"]:
        rate = n / elapsed
        out |= {"chunks_per_second": round(rate, 1), "eta_seconds": round((total - n) / rate, 1)}
    return out
