"""SentencePiece models run by the tokenizers library."""

from __future__ import annotations

import hashlib
import importlib
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.shared import own_columns, release, table, with_text

#: The model of the registered query; a parameter of the operator.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Threads that encode one batch of texts in a Python worker.
THREADS = 2
#: Bytes of text in one batch.
BATCH_BYTES = 1 << 19
#: The visible mark that stands for a space.
SPACE = "▁"
#: Stands before pieces that no text holds; not a character.
HIDDEN = "\U0010ffff"

#: Fixed values of the model file's format: kinds of models and of pieces.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


@dataclass
class Model:
    """What a model file says, as far as encoding and decoding need it."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unk_id: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    strip_extra: bool = True
    escape: bool = True


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protobuf message."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[i]
            value |= (b & 127) << shift
            i, shift = i + 1, shift + 7
            if b < 128:
                return value, i

    i = 0
    while i < len(data):
        tag, i = varint(i)
        kind = tag & 7
        if kind == 0:
            value, i = varint(i)
        else:
            size, i = varint(i) if kind == 2 else ({1: 8, 5: 4}[kind], i)
            value, i = data[i : i + size], i + size
        yield tag >> 3, value


def parse_model(data: bytes) -> Model:
    """The pieces, trainer and normaliser settings of a serialised model."""
    m = Model()
    for number, value in _fields(data):
        if number == 1:
            piece = {1: b"", 2: struct.pack("<f", 0.0), 3: NORMAL} | dict(_fields(value))
            m.pieces.append((piece[1].decode(), struct.unpack("<f", piece[2])[0], piece[3]))
        elif number == 2:
            t = dict(_fields(value))
            m.kind, m.byte_fallback, m.unk_id = t.get(3, UNIGRAM), bool(t.get(35, 0)), t.get(40, 0)
        elif number == 3:
            n = dict(_fields(value))
            m.charsmap, m.dummy_prefix, m.strip_extra, m.escape = n.get(2, b""), bool(n.get(3, 1)), bool(n.get(4, 1)), bool(n.get(5, 1))
    if m.kind not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models can be run")
    return m


def merges_of(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """Pairs of pieces that make a piece, best score first."""
    ids = {p: i for i, (p, _, _) in enumerate(pieces)}
    found = []
    for p, score, kind in pieces:
        if kind == NORMAL:
            found += [(-score, ids[p[:i]], ids[p[i:]], p[:i], p[i:]) for i in range(1, len(p)) if p[:i] in ids and p[i:] in ids]
    return [x[3:] for x in sorted(found)]


def build(model: Model) -> object:
    """The same model as a tokenizers Tokenizer: normaliser, space marks, scores or merges, byte fallback, decoder."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    own = sorted((p for p, _, kind in model.pieces if kind == USER_DEFINED), key=lambda p: (-len(p), p))
    if model.kind == UNIGRAM:
        # pieces that are never text must not be found in one; the user's always win, and the text is split at them
        best = 1.0 + max(s for _, s, _ in model.pieces)
        vocab = [(HIDDEN + p if kind in (UNKNOWN, CONTROL, UNUSED) else p, best if kind == USER_DEFINED else s) for p, s, kind in model.pieces]
        t = Tokenizer(models.Unigram(vocab, model.unk_id, model.byte_fallback))
    else:
        vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        unk = model.pieces[model.unk_id][0]
        t = Tokenizer(models.BPE(vocab, merges_of(model.pieces), unk_token=unk, fuse_unk=True, byte_fallback=model.byte_fallback, ignore_merges=bool(own)))
    if own:
        t.pre_tokenizer = pre_tokenizers.Split(Regex("|".join(map(re.escape, own))), "isolated")
    steps = []
    if model.charsmap:
        steps.append(normalizers.Precompiled(model.charsmap))
    if model.strip_extra:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(SPACE if model.escape else " "))
    if model.escape:
        steps.append(normalizers.Replace(" ", SPACE))
    if steps:
        t.normalizer = normalizers.Sequence(steps)
    parts = [decoders.Replace(HIDDEN, ""), decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse()]
    if model.dummy_prefix:
        parts.append(decoders.Strip(" ", 1, 0))
    t.decoder = decoders.Sequence(parts)
    return t


class Codec:
    """Encodes whole texts with the rebuilt tokenizer, decodes the ids again, and compares both with the reference library, text by text."""

    def __init__(self, data: bytes, parity: bool = True):
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        model = parse_model(data)
        self.tokenizer, self.parity = build(model), parity
        self.reference = importlib.import_module("sentencepiece").SentencePieceProcessor(model_proto=data)
        self.is_byte = np.array([kind == BYTE for _, _, kind in model.pieces])
        self.plain = not model.charsmap and not model.strip_extra
        self.mark = " " if model.dummy_prefix else ""
        self.raw = [bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(SPACE, " ").encode() for p, _, kind in model.pieces]

    def normal(self, texts: list[str]) -> list[str]:
        """The texts as the model normalises them, with spaces for the visible marks and without the first one that it adds."""
        if self.plain:
            return [x.replace(SPACE, " ") for x in texts]
        return [x.replace(SPACE, " ").removeprefix(self.mark) for x in map(self.reference.normalize, texts)]

    def decode(self, ids: list[int]) -> bytes:
        """The bytes that the pieces stand for, without the space that the model adds."""
        out = b"".join([self.raw[k] for k in ids])
        return out.removeprefix(self.mark.encode())

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, bool, bool | None]]:
        """The ids of each text, whether they decode to the normalised text, whether the reference library gives the same ids."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        same = [x == y for x, y in zip(ids, self.reference.encode(texts, num_threads=THREADS), strict=True)] if self.parity else [None] * len(ids)
        return [(np.asarray(i, "<i4"), self.decode(i) == w.encode(), s) for i, w, s in zip(ids, self.normal(texts), same, strict=True)]


@lru_cache(maxsize=4)
def _codec(data: bytes, parity: bool) -> Codec:
    return Codec(data, parity)


def encode_texts(docs: DataFrame, model_path: str = MODEL, parity: bool = True, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, n_byte_tokens, ids_sha256, round_trip and parity of every document; ids too on request.

    The model file (64 MB at most, checked) is read once by the driver and sent with the tasks.
    ids_sha256 is over the ids as little-endian 32-bit numbers. Whole texts are encoded, in batches, on several
    threads; every text's ids are decoded, and round_trip says whether that is the text as the model normalises it. parity says
    whether the reference library gives the same ids for the whole text, each one compared; it is null where *parity* is off.

    Null and empty texts, and all of a table without texts, have no tokens. Rows stay as they are, repeats too; extra columns
    are ignored (with *keep_ids* all columns stay and those named as a result are replaced).
    """
    with open(model_path, "rb") as f:
        data = f.read()
    if len(data) > 64 << 20:
        raise ValueError("the model file is too large to send with the tasks")
    return encode_with(docs, data, parity, keep_ids)


def encode_with(docs: DataFrame, data: bytes, parity: bool = True, keep_ids: bool = False) -> DataFrame:
    added = {"n_tokens": "long", "n_byte_tokens": "long", "ids_sha256": "string", "round_trip": "boolean", "parity": "boolean"} | ({"ids": "array<int>"} if keep_ids else {})
    d = with_text(docs.drop(*[c for c in docs.columns if c.lower() in added])) if keep_ids else own_columns(docs, "doc_id", "text")
    kept = [c for c in d.columns if keep_ids or c != "text"]
    sent = d.sparkSession.sparkContext.broadcast(data)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(sent.value, parity)
        for b in batches:
            at = 0
            while at < b.num_rows:
                texts, size = [], 0
                while at + len(texts) < b.num_rows and (not texts or size < BATCH_BYTES):
                    texts.append(b.column("text")[at + len(texts)].as_py() or "")
                    size += len(texts[-1])
                done = codec.encode(texts)
                arrays = [x for x, _, _ in done]
                out = [
                    pa.array([len(x) for x in arrays], pa.int64()),
                    pa.array([int(codec.is_byte[x].sum()) for x in arrays], pa.int64()),
                    pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in arrays]),
                    pa.array([x for _, x, _ in done], pa.bool_()),
                    pa.array([x for _, _, x in done], pa.bool_()),
                ]
                if keep_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(np.concatenate([*arrays, np.zeros(0, "<i4")]))))
                part = b.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], *out], names=[*kept, *added])
                at += len(texts)
        release()

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields if f.name in kept] + [f"{k} {v}" for k, v in added.items()])
    return d.mapInArrow(work, schema)


def decode_ids(ids: DataFrame, model_path: str = MODEL, column: str = "ids") -> DataFrame:
    """*ids* with the column decoded: the text of each array of ids (null for null)."""
    with open(model_path, "rb") as f:
        sent = ids.sparkSession.sparkContext.broadcast(f.read())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _codec(sent.value, False).tokenizer
        for b in batches:
            x = b.column(column).to_pylist()
            texts = iter(tokenizer.decode_batch([y for y in x if y is not None], skip_special_tokens=False))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([None if y is None else next(texts) for y in x], pa.string())], names=[*b.schema.names, "decoded"])

    d = ids.drop("decoded")
    return d.mapInArrow(work, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields] + ["decoded string"]))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"))
