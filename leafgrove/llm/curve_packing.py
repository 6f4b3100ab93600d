"""Packing along a space-filling curve.

A document's tokens are hashed into a signed count vector, which is projected to a few dimensions and put into the
cells of a grid; the cell's place on a Hilbert curve is the document's key. Documents are range-sorted by key (then by
id, so that any number of copies is dealt out), and each range is cut into sequences of the given length as it comes,
so that neighbours on the curve share sequences. What is left at the end of a range is cut into powers of two, which
need no padding.

Null and empty texts are one end token. Any text is taken whole; a long one is cut over as many sequences as it needs.
Repeated rows are packed each by itself; an empty table gives no piece; other columns do not matter.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgrove.llm import _wordbpe
from leafgrove.llm._shared import materialize, read

LENGTH = 2048
END = 1
#: Hashed vector, dimensions of the curve, bits a dimension.
BUCKETS, DIMENSIONS, BITS = 1024, 4, 10
#: Distinct chunks that a Python worker remembers; beyond it only those of the texts at hand stay.
MEMORY = 600_000


class Encoder:
    """Ids of a text as unsigned 16-bit integers, by the tokenizers library; each distinct chunk is encoded once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.bpe = _wordbpe.load(path)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = True
        #: The model alone, for lower-case words of ASCII letters: no normalizer or pattern changes or parts these.
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        bare = {"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "decoder": None, "model": model}
        self.model = Tokenizer.from_str(json.dumps(bare))
        #: Whether an id ends a pre-token.
        self.ends = np.zeros(max(self.bpe.strings) + 1, bool)
        self.ends[[i for i, t in self.bpe.strings.items() if t.endswith(self.bpe.suffix)]] = True
        self.special = {c: np.array([i], "<u2").tobytes() for c, i in self.bpe.special.items()}
        self.known: dict[str, bytes] = dict(self.special)
        self.words: dict[str, bytes] = {}

    def learn(self, held: set[str]) -> None:
        """Distinct pre-tokens of the chunks at hand go to the library many in one text: it parts them at the white space between."""
        chunks = held.difference(self.known)
        if len(self.known) + len(chunks) > MEMORY:
            self.known = self.special | {c: self.known[c] for c in held.difference(chunks)}
        if len(self.words) > MEMORY:
            self.words.clear()
        new = {c: self.bpe.parts(c) for c in chunks if not c.isalpha()}
        whole = chunks.difference(new)
        words = sorted(whole.union(*new.values()).difference(self.words), key=_odd)
        for at in range(0, len(words), 500):
            part = words[at : at + 500]
            ids = np.array(self._ids(" ".join(part)), "<u2")
            cuts = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(cuts) == len(part):
                raw, start = ids.tobytes(), 0
                for word, end in zip(part, cuts, strict=True):
                    self.words[word], start = raw[2 * start : 2 * end], end
            else:
                self.words.update({w: np.array(self._ids(w), "<u2").tobytes() for w in part})
        self.known.update(zip(whole, map(self.words.__getitem__, whole), strict=True))
        for chunk, ps in new.items():
            self.known[chunk] = b"".join([self.words[p] for p in ps])

    def _ids(self, text: str) -> list[int]:
        """Ids of lower-case words by the library, which here need not find the places of the tokens."""
        library = self.model if text.isascii() and text.replace(" ", "").isalpha() else self.library
        return library.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def encode(self, texts: list[str]) -> list[bytes]:
        with _wordbpe.no_gc():
            split = [self.bpe.chunks(t) for t in texts]
            self.learn(set().union(*split))
        return [b"".join(map(self.known.__getitem__, cs)) for cs in split]


def _odd(word: str) -> bool:
    return not (word.isascii() and word.isalpha())


class Curve:
    """Keys of documents on the curve."""

    def __init__(self, vocabulary: int, seed: int = 20):
        mixed = (np.arange(vocabulary, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        self.bucket = (mixed % np.uint64(BUCKETS)).astype(np.int64)
        self.sign = np.where(mixed >> np.uint64(63), 1.0, -1.0)
        self.project = np.random.default_rng(seed).standard_normal((BUCKETS, DIMENSIONS))

    def keys(self, documents: list[np.ndarray]) -> np.ndarray:
        hashed = np.array([np.bincount(self.bucket[ids], self.sign[ids], BUCKETS) for ids in documents])
        norm = np.sqrt((hashed * hashed).sum(1, keepdims=True))
        # Not by @: threads of the linear algebra library would wait busily while the next texts are encoded.
        at = np.einsum("ij,jk->ik", hashed / np.maximum(norm, 1e-9), self.project)
        cells = (1 << BITS) / (1 + np.exp(-1.7 * at))
        return hilbert(np.minimum(cells.astype(np.int64), (1 << BITS) - 1))


def hilbert(cells: np.ndarray) -> np.ndarray:
    """Places on the Hilbert curve of grid cells (one row for each point, BITS bits a dimension).

    Skilling's transform ("Programming the Hilbert curve", 2004): undo the curve's turns from the top bit down, then
    Gray-decode, and interleave the bits.
    """
    x = cells.T.astype(np.int64).copy()
    n = len(x)
    for bit in range(BITS - 1, 0, -1):
        low = (1 << bit) - 1
        for i in range(n):
            turned = (x[i] >> bit & 1).astype(bool)
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(turned, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for bit in range(BITS - 1, 0, -1):
        flip ^= np.where(x[n - 1] >> bit & 1, (1 << bit) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for bit in range(BITS - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> bit & 1)
    return key


_encoders: dict[str, tuple[Encoder, Curve]] = {}


def encoded(df: DataFrame, id_col: str, text_col: str, path: str) -> DataFrame:
    """id, curve key, and ids (16 bits each, the end token last)."""
    kind = df.schema[id_col].dataType.simpleString()
    end = np.array([END], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            encoder = Encoder(path)
            _encoders[path] = encoder, Curve(max(encoder.bpe.strings) + 1)
        encoder, curve = _encoders[path]
        for batch in batches:
            at = 0
            for texts in _wordbpe.grouped(x.as_py() for x in batch.column(1)):
                ids = [x + end for x in encoder.encode(texts)]
                keys = curve.keys([np.frombuffer(x, "<u2") for x in ids])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(keys, pa.int64()), pa.array(ids, pa.binary())], [id_col, "_curve", "_ids"])
                at += len(texts)

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, _curve long, _ids binary")


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, path: str | None = None) -> DataFrame:
    """Pieces of documents in sequences.

    id, start (its document's ids before it), length, ids (binary, little-endian unsigned 32-bit), doc_tokens (with the
    end token), sequence_id, offset (in the sequence, gapless from 0). Encoding is written out once, so that the range
    sort's sampling does not encode again.
    """
    path = path or _wordbpe.default_path()
    kind = df.schema[id_col].dataType.simpleString()
    table = materialize(encoded(df, id_col, text_col, path), "encoded")
    dealt = table.repartitionByRange("_curve", id_col, F.crc32("_ids")).sortWithinPartitions("_curve", id_col, F.crc32("_ids"))
    names = [id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        held: list[tuple] = []  # pieces of the sequence that is being filled
        filled, sequence = 0, first
        rows: list[tuple] = []

        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [id_type, *[pa.int64()] * 2, pa.binary(), *[pa.int64()] * 3], strict=True)], names)

        id_type = pa.int64()
        for batch in batches:
            id_type = batch.column(0).type
            for doc, ids in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                ids = np.frombuffer(ids.as_buffer(), "<u2").astype("<u4")
                at = 0
                while at < len(ids):
                    n = min(length - filled, len(ids) - at)
                    held.append((doc, at, n, ids[at : at + n].tobytes(), len(ids)))
                    filled, at = filled + n, at + n
                    if filled == length:
                        place = 0
                        for piece in held:
                            rows.append((*piece, sequence, place))
                            place += piece[2]
                        held, filled, sequence = [], 0, sequence + 1
            if rows:
                yield out(rows)
                rows = []
        rows = []
        for doc, start, n, ids, total in held:  # the rest of the range, in sequences of powers of two
            at = 0
            while at < n:
                if not rows or place == size:
                    sequence += bool(rows)
                    size, place = 1 << filled.bit_length() - 1, 0
                    filled -= size
                take = min(size - place, n - at)
                rows.append((doc, start + at, take, ids[4 * at : 4 * (at + take)], total, sequence, place))
                place, at = place + take, at + take
        if rows:
            yield out(rows)

    return dealt.mapInArrow(run, f"`{id_col}` {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def op5_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(read(spark, sf_dir, "documents"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
