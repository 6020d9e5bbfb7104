"""Toxicity of whole texts after noisy-channel deobfuscation."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.shared import cut, own_columns, table, text_key

#: Labelled rows that the classifier is fitted on at most (distinct texts, chosen by a hash of the id).
LABELLED = 20_000
#: Characters of history of the language model, and its symbols: a word's edge, a to z, any other letter.
HISTORY, SYMBOLS = 3, 28
#: Costs of the channel, in nats: a letter written as a look-alike, a repeated letter, a separator put between.
LOOKALIKE, REPEATED, INSERTED = 0.7, 0.4, 0.9
#: Cost of a look-alike character that stands for nothing: more than a letter in its place.
IDLE = 4.5
#: Tokens whose evidence a worker keeps.
KEEP = 500_000
#: Log odds of a document where no label tells anything: not toxic.
UNLABELLED = -4.0
#: A feature counts if so many toxic texts have it and its log odds are so many standard errors above zero.
MIN_TOXIC, SIGNIFICANT = 3, 3.0

#: Characters that look like letters.
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s",
}
_DECORATION = re.compile(r"^([^\w\s])\1+|([^\w\s])\2+$|^[\"'(\[{¿¡]+|[\"')\]}.,;:!?]+$")
_PLAIN = re.compile(r"[^\W\d_]*")
_TWICE = re.compile(r"([^\W\d_])\1")
_LOOKING = re.compile(f"[{re.escape(''.join(LOOKS))}]")
_SPACED = re.compile(r"(?<!\S)\S(?:\s+\S){2,}(?!\S)")
#: One letter for all that a look-alike may stand for, so that pieces of a word meet however they are written.
_FOLD = str.maketrans({k: v[0] for k, v in LOOKS.items()} | {"l": "i", "£": "i", "g": "b", "9": "b"})


def symbols(codes: np.ndarray) -> np.ndarray:
    """Language-model symbols of code points; what is no letter is an edge."""
    s = np.zeros(len(codes), np.int64)
    low = (codes >= 97) & (codes <= 122)
    s[low] = codes[low] - 96
    s[(codes >= 0xC0) & (codes != 0xD7) & (codes != 0xF7) & ((codes < 0x2000) | (codes >= 0x2E80))] = 27  # between them stand signs
    return s


def gram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of HISTORY + 1 symbols in a row over all texts; words without letters between count once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS ** (HISTORY + 1), np.int64)
        edge = " " * HISTORY  # apart enough that no history crosses texts

        def add(texts: list[str]) -> None:
            s = symbols(np.frombuffer((edge + edge.join(texts) + edge).lower().encode("utf-32-le", "replace"), "<u4"))
            g = s[: len(s) - HISTORY]
            for k in range(1, HISTORY + 1):
                g = g * SYMBOLS + s[k : len(s) - HISTORY + k]
            np.add(total, np.bincount(g, minlength=len(total)), out=total)

        for b in batches:
            held, size = [], 0
            for t in b.column("text"):
                held.append(t.as_py() or "")
                size += len(held[-1])
                if size > 1 << 20:
                    add(held)
                    held, size = [], 0
            add(held)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])

    rows = docs.select("text").mapInArrow(work, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    out = np.zeros(SYMBOLS ** (HISTORY + 1))
    for r in rows.toLocalIterator():  # bounded by the symbols
        out[r.gram] = r.n
    return out


def language_model(counts: np.ndarray) -> np.ndarray:
    """Cost (nats) of each symbol after each history, smoothed with the shorter histories' distribution."""
    shape = (SYMBOLS,) * (HISTORY + 1)
    c = counts.reshape(shape)
    p = np.full(SYMBOLS, 1 / SYMBOLS)
    for k in range(HISTORY + 1):
        sub = c.sum(axis=tuple(range(HISTORY - k))) if k < HISTORY else c
        p = (sub + 5.0 * np.broadcast_to(p, sub.shape)) / (sub.sum(axis=-1, keepdims=True) + 5.0)
    return -np.log(p).astype(np.float32)


@lru_cache(maxsize=65536)
def _symbol(ch: str) -> int:
    return int(symbols(np.array([ord(ch)]))[0])


def options(token: str) -> list[list[tuple[str, float]]]:
    """The lattice: what each character may stand for ("" for nothing) and the cost of it in the channel."""
    out, before = [], ""
    for ch in token:
        own = [(ch, 0.0)] if ch.isalpha() or ch == " " else []
        own += [(x, LOOKALIKE) for x in LOOKS.get(ch, "")]
        if ch == before:
            own.append(("", REPEATED))
        elif not ch.isalpha():
            own.append(("", IDLE if ch in LOOKS else INSERTED))
        if ch != " ":
            before = ch
        out.append(own)
    return out


def decode(token: str, costs: np.ndarray) -> str:
    """The likeliest word behind a token: Viterbi over its character lattice, exact.

    Each character is itself, a letter that it looks like, or nothing where it repeats the one before or is no letter.
    A space is the edge of a word, or was put between. A state is the last HISTORY symbols, all that the language
    model looks at, so of the paths to a state only the cheapest (then the first in order) can go on, and none is dropped else.
    """
    states: dict[tuple[int, ...], tuple[float, str]] = {(0,) * HISTORY: (0.0, "")}
    for own in options(token):
        letters = [(x, _symbol(x), extra) for x, extra in own if x]
        skipped = min((extra for x, extra in own if not x), default=None)
        new: dict[tuple[int, ...], tuple[float, str]] = {}
        for history, (cost, word) in states.items():
            if skipped is not None and (history not in new or (cost + skipped, word) < new[history]):
                new[history] = (cost + skipped, word)
            if letters:
                row, rest = costs[history], history[1:]
                for x, s, extra in letters:
                    found, key = (cost + extra + float(row[s]), word + x), (*rest, s)
                    if key not in new or found < new[key]:
                        new[key] = found
        states = new
    return min((c + float(costs[h][0]), w) for h, (c, w) in states.items())[1]


def stripped(token: str) -> str:
    """Without decoration at either end: marks, and repeated symbols."""
    if token.isalpha():
        return token
    while (t := _DECORATION.sub("", token)) != token:
        token = t
    return token


def readings(token: str, costs: np.ndarray) -> list[str]:
    """A token as it is, and decoded if anything in it is no letter, looks like another letter or is written twice in a row."""
    if " " in token:  # pieces: the words of the likeliest path
        return list(dict.fromkeys(decode(token, costs).split()))
    t = stripped(token)
    if not t:
        return []
    if _PLAIN.fullmatch(t) and not _TWICE.search(t) and (t.isascii() or not _LOOKING.search(t)):
        return [t]
    return list(dict.fromkeys([t, decode(t, costs)]))


def tokens(text: str) -> set[str]:
    """The distinct lower-cased tokens between spaces, full stops and commas, with each run of single characters as two more: glued, and with its spaces for the lattice to place words in."""
    low = spread(text)
    parts = low.split()
    found = runs(low, parts)
    return {*parts, *found, *(t.replace(" ", "") for t in found)}


def spread(text: str) -> str:
    return text.lower().replace(".", " ").replace(",", " ")


def runs(low: str, parts: list[str]) -> set[str]:
    """The runs of single characters, with one space between."""
    return {" ".join(m[0].split()) for m in _SPACED.finditer(low)} if sum(map((1).__eq__, map(len, parts))) >= 3 else set()


def broken(low: str, parts: list[str], starts: set[str], whole: set[str]) -> set[str]:
    """Neighbouring pieces that together are one of the folded words *whole*; *starts* are the beginnings of these."""
    folded, out = low.translate(_FOLD).split(), set()
    for i in [i for i, p in enumerate(folded) if p in starts]:
        joined, j = folded[i], i + 1
        while j < len(folded) and joined in starts:
            joined += folded[j]
            j += 1
            if joined in whole:
                out.add(" ".join(parts[i:j]))
    return out


def features(word: str) -> list[str]:
    return [word, *[f"{word[:k]}*" for k in (4, 5, 6) if len(word) >= k]]


class Reader(dict):
    """The features of each token, kept while there is room."""

    def __init__(self, costs: np.ndarray):
        super().__init__()
        self.costs = costs

    def __missing__(self, token: str) -> tuple[str, ...]:
        if len(self) >= KEEP:
            self.clear()
        got = self[token] = tuple({f for r in readings(token, self.costs) for f in features(r)})
        return got


@dataclass
class Model:
    """Language-model costs, evidence (log odds) of features, and the logistic weights of a document's evidence."""

    costs: np.ndarray
    evidence: dict[str, float]
    weights: np.ndarray


class Scorer(dict):
    """The evidence of each token, kept while there is room; documents' scores."""

    def __init__(self, model: Model):
        super().__init__()
        self.m = model
        self.whole = {w.translate(_FOLD) for w in model.evidence if len(w) >= 3 and not w.endswith("*")}
        self.starts = {w[:k] for w in self.whole for k in range(1, len(w))}

    def __missing__(self, token: str) -> float:
        if len(self) >= KEEP:
            self.clear()
        get = self.m.evidence.get
        got = 0.0
        for r in readings(token, self.m.costs):
            got = max(got, get(r, 0.0), get(r[:4] + "*", 0.0), get(r[:5] + "*", 0.0), get(r[:6] + "*", 0.0))
        self[token] = got
        return got

    def words(self, text: str) -> set[str]:
        """The distinct tokens, and the words of the best path of each run of single characters and each broken word."""
        low = spread(text)
        parts = low.split()
        out = set(parts)
        for t in runs(low, parts) | broken(low, parts, self.starts, self.whole):
            out.update(readings(t, self.m.costs))
        return out

    def vector(self, text: str | None) -> np.ndarray:
        """The three strongest tokens' evidence, how many tokens have any, and one."""
        found = sorted(filter(None, map(self.__getitem__, self.words(text or ""))), reverse=True)
        return np.array([*(found + [0.0] * 3)[:3], math.log1p(len(found)), 1.0])

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.vector(text) @ self.m.weights, -40, 40))))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, bound: int = LABELLED) -> Model:
    """The model: language model from all texts, classifier from at most *bound* labelled texts outside the held-out fold."""
    spark = docs.sparkSession
    costs = language_model(gram_counts(docs))
    sent = spark.sparkContext.broadcast(costs)
    lab = labels.filter("doc_id is not null and toxic is not null").filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    lab = lab.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    sample = docs.join(F.broadcast(lab), "doc_id").withColumn("_k", text_key("text")).groupBy("_k").agg(F.max("toxic").alias("toxic"), F.first("text").alias("text"))
    sample = cut(sample.orderBy(F.xxhash64("_k"), "_k").limit(bound).select("toxic", "text"))  # a repeated id may have many texts

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, reader = (Counter(), Counter()), Reader(sent.value)
        for b in batches:
            for t, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                seen[y > 0].update(set().union(*map(reader.__getitem__, tokens(t or ""))))
        names = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([seen[1][f] for f in names], pa.int64()), pa.array([seen[0][f] for f in names], pa.int64())], names=["feature", "t", "c"])

    n = sample.agg(F.count_if(F.col("toxic") > 0).alias("t"), F.count_if(F.col("toxic") <= 0).alias("c")).first()
    df = sample.mapInArrow(count, "feature string, t long, c long").groupBy("feature").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).filter(F.col("t") >= MIN_TOXIC)
    odds = F.log((F.col("t") + 0.5) / (n.t + 1)) - F.log((F.col("c") + 0.5) / (n.c + 1))
    error = F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    rows = df.select("feature", odds.alias("w"), error.alias("e")).filter(F.col("w") > SIGNIFICANT * F.col("e")).collect()  # bounded by the sample
    model = Model(costs, {r.feature: r.w - r.e for r in rows if r.w > r.e}, np.array([0, 0, 0, 0, UNLABELLED]))
    half = spark.sparkContext.broadcast(model)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(half.value)
        for b in batches:
            v = np.array([s.vector(t) for t in b.column("text").to_pylist()]).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([pa.array(v[:, i]) for i in range(5)] + [b.column("toxic")], names=[*"abcde", "y"])

    got = sample.mapInArrow(vectors, "a double, b double, c double, d double, e double, y int").collect()  # *bound* rows at most
    if not got:
        return model
    data = np.array([list(r) for r in got])
    model.weights = fit_logistic(data[:, :5], (data[:, 5] > 0).astype(float))
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, bound: int = LABELLED) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted of every document.

    A token that holds anything but plain letters, a look-alike letter, a letter twice in a row, or a run of single characters, is
    restored by Viterbi decoding of its character lattice (look-alikes, repetition, characters put
    between, spaces kept as edges or dropped) under a character language model counted over all texts. Neighbouring pieces
    that together could be a learned word are decoded in the same way, and every word of the best path counts. Words and word beginnings that
    labelled toxic texts have significantly more often are evidence; a document's strongest evidence goes through a
    logistic regression. The classifier sees at most *bound* labelled texts, never one whose crc32(doc_id) mod 5 is 0;
    doc_id, lang, source and labels take no part in a score.

    Null and empty texts get the score of no evidence; without any labels every score is
    that of UNLABELLED, and no document is toxic. Rows
    stay as they are, repeats too; extra columns are ignored; an empty table gives an empty result.
    """
    d = own_columns(docs, "doc_id", "text")
    model = d.sparkSession.sparkContext.broadcast(fit(d, own_columns(labels, "doc_id", "toxic"), bound))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(model.value)
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([s.score(t.as_py()) for t in part.column("text")], pa.float64())], names=["doc_id", "score"])

    kind = dict(d.dtypes)["doc_id"]
    out = d.mapInArrow(work, f"doc_id {kind}, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
