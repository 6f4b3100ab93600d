"""Language-model scores from a probabilistic suffix tree over words.

Tokens are words and one end for each text. Counts come from all training texts. The tree's contexts are word sequences
of up to ORDER - 1 tokens. Every sequence that occurs MIN_COUNT times or more is looked at, so their number grows with
the corpus; of the contexts, the ones whose next-symbol distribution diverges from their suffix's stay (Ron, Singer and
Tishby, 1996). Next-symbol distributions are smoothed by absolute discounting towards those of the suffix, and at the
root by the add-one distribution of single tokens. A text is scored by the longest suffix of what precedes each token
that is a state.

Words and sequences are 64-bit hashes in tables, joined by shuffles. A text's score is a sum of one value for each of
its words and sequences: a word's own log probability and its weight as a context; a sequence's gain over its suffix
less its context's weight, and its own weight as a context. The HOT most frequent values are broadcast and added where
the text is read; the others are joined. A broadcast bitmap of a fixed size leaves out of the shuffles what is in no
table for sure; results do not depend on either. Sequences are counted, and values looked up, in SLICES parts of the hash
space one after another, so what a shuffle writes at a time is a part of the corpus; all parts are worked on.

What is as large as the corpus is shuffled as arrays: a task deals the hashes of about CHUNK tokens by their first bits and
sends one row of bytes for each part. A part's entries are sorted and added up, or looked up, at once. Equal sequences are
added up before they are sent, and the most frequent values are broadcast, so no part is much larger than others.

Null and empty texts are one end. Texts are taken whole. Repeated rows are scored each by itself; a null id is held out.
Ties of count decide only what is broadcast. Without training texts
every count is 0 and all scores are those of one unseen symbol. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgrove.llm._shared import collected, fold, materialize, read, release, scratch, slices, small_batches

#: Longest sequences that are counted (contexts are one shorter).
ORDER = 3
#: Least number of occurrences in training texts of a sequence that is looked at.
MIN_COUNT = 2
#: Values that are broadcast; 64-bit words of a bitmap; parts of the hash space (a power of two).
HOT, BITMAP, SLICES = 200_000, 1 << 21, 4
#: Sequences that a task holds before it sends them; tokens of the corpus for each part of the hash space, and parts that a corpus has if each has FEW.
CHUNK, PART, PARTS, FEW = 1_000_000, 2_000_000, 64, 20_000
#: Counts of values beyond it are alike when the least count of the most frequent ones is sought.
LEVELS = 10_000
#: Rows of texts, and of tables without texts, that a Python worker gets at once.
TEXTS, ROWS = 500, 20_000
#: Texts repeat words: a dictionary of so many bytes makes their hashes a third of the size on disk.
DICTIONARY = {"parquet.dictionary.page.size": 1 << 24}
#: Discount of each count; nats that a context's distribution must be better than its suffix's over all its occurrences, and for each.
DISCOUNT, MIN_GAIN, MIN_DIVERGENCE = 0.75, 20.0, 0.002
#: Distinct words whose hashes a Python worker remembers.
MEMORY = 150_000
#: The end of a text, as a word that no text has.
END = b" "


def words(text: str | None) -> list[bytes]:
    """bytes.lower() changes A-Z only, bytes.split() cuts at 0x20 and 0x09-0x0D only."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def hashed(word: bytes) -> int:
    """64-bit hash as a signed number."""
    h = xxhash.xxh3_64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


@dataclass
class Tree:
    """The model of a small corpus in memory, which tests hold against the tables: words by hash (sorted) with their counts, and for each length the retained sequences.

    keys[k]: sorted numbers of sequences of length k + 2: place of the sequence without its last word, times 2^20, plus
    the last word. logp: log10 probability of the last word after the rest; back: log10 back-off weight of a sequence as
    a context (of a word for k = -1, in root_back).
    """

    hashes: np.ndarray
    counts: np.ndarray
    total: int
    distinct: int
    keys: list[np.ndarray] = field(default_factory=list)
    logp: list[np.ndarray] = field(default_factory=list)
    back: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.unit = np.log10(self.total + self.distinct + 1)
        self.root = np.log10(self.counts + 1.0) - self.unit if len(self.counts) else np.empty(0)
        at = np.searchsorted(self.hashes, hashed(END))
        self.end = int(at) if at < len(self.hashes) and self.hashes[at] == hashed(END) else -1
        self.root_back = np.zeros(len(self.hashes))

    def places(self, ids: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        """For each length from 1, the place of the sequence of that length that ends at each token; -1: not retained.

        ids: words' places (-1: rare) of texts one after another; first: whether a token is the first of its text.
        """
        out = [ids]
        for keys in self.keys:
            before = np.concatenate([[-1], out[-1][:-1]])
            inside = ~first & (before >= 0) & (out[-1] >= 0)
            key = np.where(inside, before << 20 | np.maximum(ids, 0), -1)
            at = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
            out.append(np.where(inside & (keys[at] == key), at, -1) if len(keys) else np.full(len(ids), -1))
        return out

    def scores(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log10 probability of each token; of a rare one without its own log10 probability."""
        places = self.places(ids, first)
        out = np.where(ids >= 0, self.root[np.maximum(ids, 0)], 0.0) if len(self.root) else np.zeros(len(ids))
        for k in range(len(self.keys)):
            # The context is the sequence of length k + 1 that ends one token earlier.
            context = np.concatenate([[-1], places[k][:-1]])
            context = np.where(first, -1, context)
            back = self.root_back if k == 0 else self.back[k - 1]
            out = out + (np.where(context >= 0, back[np.maximum(context, 0)], 0.0) if len(back) else 0.0)
            if len(self.keys[k]):
                out = np.where(places[k + 1] >= 0, self.logp[k][np.maximum(places[k + 1], 0)], out)
        return out

    def grow(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Add the sequences of the next length (sorted keys); contexts that don't diverge are given no say."""
        k = len(self.keys)
        context, last = keys >> 20, keys & (1 << 20) - 1
        size = (self.counts if k == 0 else self.sizes)[context].astype(float)  # occurrences of the context
        lower = self.root[last] if k == 0 else self.logp[k - 1][self._suffix(context, last)]
        own = (counts - DISCOUNT) / size
        n = len(self.counts if k == 0 else self.sizes)
        left = np.maximum(1 - np.bincount(context, own, n), 1e-9)
        p = own + left[context] * 10**lower
        gain = np.bincount(context, counts * (np.log(p) - lower * np.log(10)), n)
        size_of = np.ones(n)
        size_of[context] = size
        covered = np.bincount(context, counts, n)
        gain += (size_of - covered) * np.log(left)
        stays = (gain >= MIN_GAIN) & (gain >= MIN_DIVERGENCE * size_of)
        back = np.where(stays, np.log10(left), 0.0)
        if k == 0:
            self.root_back = back
        else:
            self.back[k - 1] = back
        self.keys.append(keys)
        self.logp.append(np.where(stays[context], np.log10(p), lower))
        self.back.append(np.zeros(len(keys)))
        self.sizes = counts

    def _suffix(self, context: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Places of the sequences without their first word, by their context (a sequence one shorter) and last word."""
        k = len(self.keys)
        tail = self.keys[k - 1][context] & (1 << 20) - 1 if k == 1 else self._suffix_at(k - 1, context)
        return np.searchsorted(self.keys[k - 1], tail << 20 | last)

    def _suffix_at(self, k: int, place: np.ndarray) -> np.ndarray:
        """Place, among sequences one shorter, of a sequence of length k + 2 without its first word."""
        rest, last = self.keys[k][place] >> 20, self.keys[k][place] & (1 << 20) - 1
        tail = self.keys[k - 1][rest] & (1 << 20) - 1 if k == 1 else self._suffix_at(k - 1, rest)
        return np.searchsorted(self.keys[k - 1], tail << 20 | last)


def mixed(context: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """Hash of a sequence from those of its parts without the last and without the first token, as F.xxhash64(context, suffix)."""
    p1, p2, p3, p4, p5 = map(np.uint64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, n: x << np.uint64(n) | x >> np.uint64(64 - n)
    h = np.full(len(context), 42, np.uint64)
    for part in (context, suffix):
        h = h + p5 + np.uint64(8) ^ turn(part.view(np.uint64) * p2, 31) * p1
        h = turn(h, 27) * p1 + p4
        h = (h ^ h >> np.uint64(33)) * p2
        h = (h ^ h >> np.uint64(29)) * p3
        h = h ^ h >> np.uint64(32)
    return h.view(np.int64)


def encoded(docs: DataFrame) -> DataFrame:
    """row (a number), id, train and tokens (hashes of words, the end last) of each text."""

    class Hashes(dict):
        def __missing__(self, word: bytes) -> int:
            if len(self) >= MEMORY:
                self.clear()
            found = self[word] = hashed(word)
            return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in slices(batches):
            own = [[*words(text.as_py()), END] for text in batch.column(3)]
            tokens = [np.fromiter(map(hashes.__getitem__, x), np.int64, len(x)) for x in own]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(tokens, pa.list_(pa.int64()))], ["row", "id", "train", "tokens"])

    return docs.select(F.monotonically_increasing_id().alias("row"), "id", "train", "text").mapInArrow(run, "row long, id long, train boolean, tokens array<long>")


def slice_of(h: np.ndarray) -> np.ndarray:
    return h >> 20 & SLICES - 1


def in_slice(h: str, k: int) -> Column:
    return F.shiftright(h, 20).bitwiseAND(F.lit(SLICES - 1)) == k


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of lists one after another as 64-bit numbers, where a list begins, and the lists' lengths."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(column.offsets.to_numpy()).astype(np.int64)
    first = np.zeros(len(values), bool)
    first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    return values, first, sizes


def parts_for(tokens: int) -> int:
    """Parts of the hash space for a corpus: their entries of one slice are what a Python worker holds at a time."""
    return max(1, min(PARTS, tokens // FEW), min(tokens // PART, 60_000))


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """Part of each hash, by its first bits: hashes of a part follow each other."""
    return ((h.view(np.uint64) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.uint16)


def packed(sizes: np.ndarray, columns: Iterable[np.ndarray]) -> list[pa.Array]:
    """Entries one after another as bytes, so many of them in each row."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return [pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((ends * x.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))]) for x in columns]


def unpacked(table: pa.Table, name: str, kind: type = np.int64) -> np.ndarray:
    """Entries of all rows one after another."""
    out = [np.empty(0, kind)]
    for x in table.column(name).chunks:
        if len(x) and x.buffers()[2]:
            ends = np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x) + 1]
            out.append(np.frombuffer(x.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind))
    return np.concatenate(out)


def dealt(h: np.ndarray, parts: int, columns: dict[str, np.ndarray]) -> dict[str, pa.Array]:
    """A row for each part that has entries, by the entries' hashes."""
    part = part_of(h, parts)
    order = np.argsort(part, kind="stable")
    sizes = np.bincount(part, minlength=parts)
    there = np.flatnonzero(sizes)
    blobs = packed(sizes[there], (x[order] for x in columns.values()))
    return {"part": pa.array(there, pa.int32())} | dict(zip(columns, blobs, strict=True))


def runs(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of hashes by unsigned value, and where in it each distinct one begins."""
    own = h.view(np.uint64)
    order = np.argsort(own)
    own = own[order]
    return order, np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]) if len(own) else [])


def united(table: DataFrame, parts: int, sums: list[str], without: Broadcast | None = None) -> DataFrame:
    """A row for each part: its hashes h in order, the sums of the columns (doubles) for each, and at, bits: its piece of a bitmap.

    without: sorted hashes that are left out.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            columns = {c: np.concatenate([x.column(k).to_numpy() for x in waiting]) for k, c in enumerate(["h", *sums])}
            if without is not None and len(without.value[0]):
                stays = ~place(without.value, columns["h"])[1]
                columns = {c: x[stays] for c, x in columns.items()}
            return pa.RecordBatch.from_pydict(dealt(columns["h"], parts, columns))

        for batch in batches:
            waiting.append(batch)
            if sum(x.num_rows for x in waiting) > CHUNK:
                yield out()
                waiting.clear()
        if waiting:
            yield out()

    def unite(table: pa.Table) -> pa.Table:
        h = unpacked(table, "h")
        order, starts = runs(h)
        h = h[order][starts]
        word = (h.view(np.uint64) >> np.uint64(43)).astype(np.int64)
        begin = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        bits = np.zeros(word[-1] - word[0] + 1, np.int64)
        bits[word[begin] - word[0]] = np.bitwise_or.reduceat(np.int64(1) << (h & 63), begin)
        columns = [np.add.reduceat(unpacked(table, c, np.float64)[order], starts) for c in sums]
        row = {"part": table.column("part")[:1], "h": [h.tobytes()]} | {c: [x.tobytes()] for c, x in zip(sums, columns, strict=True)}
        return pa.table(row | {"at": pa.array([word[0]], pa.int64()), "bits": [bits.tobytes()]})

    blobs = "".join(f", {c} binary" for c in ["h", *sums])
    sent = table.select("h", *sums).mapInArrow(send, f"part int{blobs}")
    return sent.groupBy("part").applyInArrow(unite, f"part int{blobs}, at long, bits binary")


def bitmap(table: DataFrame) -> Broadcast:
    """Bits of the hashes in a table of united parts; a hash whose bit is not set is not in it."""
    bits = np.zeros(BITMAP, np.int64)
    for row in table.select("at", "bits").toLocalIterator():
        piece = np.frombuffer(row.bits, np.int64)
        bits[row.at : row.at + len(piece)] |= piece
    return table.sparkSession.sparkContext.broadcast(bits)


def place(hot: list[np.ndarray], h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of hashes among the sorted ones, the first of hot, and whether they are there; the last of hot has a flag for their first 22 bits."""
    at, found = np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    likely = np.flatnonzero(hot[-1][h.view(np.uint64) >> np.uint64(42)])
    if len(likely):
        own = h[likely]
        at[likely] = np.minimum(np.searchsorted(hot[0], own), len(hot[0]) - 1)
        found[likely] = hot[0][at[likely]] == own
    return at, found


def held(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    return (bits[h.view(np.uint64) >> np.uint64(43)] >> (h & 63) & 1).astype(bool)


def longer(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sequences of a length by their last token: the contexts, suffixes and last tokens of those one longer."""
    at = np.flatnonzero(~first[1:]) + 1
    return h[at - 1], h[at], at


def count_words(texts: DataFrame) -> DataFrame:
    """h, c of every token of the training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            h, counts = np.unique(np.concatenate(waiting), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(counts, pa.int64())], ["h", "c"])

        for batch in batches:
            waiting.append(_flat(batch.column(0))[0])
            if sum(map(len, waiting)) > CHUNK:
                yield out()
                waiting.clear()
        if sum(map(len, waiting)):
            yield out()

    return texts.where("train").select("tokens").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def count_sequences(texts: DataFrame, size: int, bits: Broadcast, parts: int, k: int) -> DataFrame:
    """context, suffix and c of the sequences of a size that occur often enough in training texts, of one slice of the contexts, packed by the part of the suffix.

    bits: bitmap of those one shorter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            context, suffix = (np.concatenate(x) for x in zip(*waiting, strict=True))
            h = mixed(context, suffix)
            order, starts = runs(h)
            counts = np.diff(np.append(starts, len(h))).astype(np.int32)
            first = order[starts]
            return pa.RecordBatch.from_pydict(dealt(h[first], parts, {"context": context[first], "suffix": suffix[first], "c": counts}))

        for batch in slices(batches):
            h, first, _ = _flat(batch.column(0))
            for _ in range(size - 2):
                context, suffix, at = longer(h, first)
                h, first = mixed(context, suffix), first[at - 1]
            context, suffix, _ = longer(h, first)
            mine = slice_of(context) == k
            context, suffix = context[mine], suffix[mine]
            # A sequence is no more frequent than its parts.
            often = held(bits.value, context) & held(bits.value, suffix)
            waiting.append((context[often], suffix[often]))
            if sum(len(x) for x, _ in waiting) > CHUNK:
                yield out()
                waiting.clear()
        if sum(len(x) for x, _ in waiting):
            yield out()

    def add(table: pa.Table) -> pa.Table:
        context, suffix, c = unpacked(table, "context"), unpacked(table, "suffix"), unpacked(table, "c", np.int32)
        order, starts = runs(mixed(context, suffix))
        c = np.add.reduceat(c[order].astype(np.int64), starts)
        often = c >= MIN_COUNT
        first = order[starts[often]]
        return pa.table(dealt(suffix[first], parts, {"context": context[first], "suffix": suffix[first], "c": c[often]}))

    blobs = "part int, context binary, suffix binary, c binary"
    return texts.where("train").select("tokens").mapInArrow(run, blobs).groupBy("part").applyInArrow(add, blobs)


def grown(shorter: DataFrame, texts: DataFrame, size: int, parts: int) -> tuple[DataFrame, DataFrame]:
    """Sequences of the next size: h, c, logp and gain (over suffix and context's weight), and h, back of the contexts that stay.

    shorter: h, c, logp of the sequences one shorter. All sequences of a context are in one slice. A slice's counts go once
    its level is written, so that those of one slice are on disk at a time.
    """
    found = []
    with scratch():
        with small_batches(texts.sparkSession, ROWS):
            shorter = materialize(united(shorter.where(F.col("c") >= MIN_COUNT).withColumn("c", F.col("c").cast("double")), parts, ["c", "logp"]), "shorter")
        bits = bitmap(shorter)
        for k in range(SLICES):
            with collected() as tables:
                counted = materialize(count_sequences(texts, size, bits, parts, k), "sequences")
            found.append(materialize(_grown(shorter, counted, parts), "level", outer=True))
            release(tables)
        bits.unpersist()
    every = reduce(DataFrame.union, found)
    return every.where("back is null").select("h", "c", "logp", "gain"), every.where("back is not null").select("h", "back")


def found_at(own: pa.Table, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of hashes that are among a part's united ones: their places in h, and their places there."""
    keys = unpacked(own, "h").view(np.uint64)
    if not len(keys):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(keys, h.view(np.uint64)), len(keys) - 1)
    there = np.flatnonzero(keys[at] == h.view(np.uint64))
    return there, at[there]


def _grown(shorter: DataFrame, counted: DataFrame, parts: int) -> DataFrame:
    """h, c, logp and gain of the sequences, and h, back of the contexts that stay. Sequences go to the part of their suffix and then to that of their context."""

    def below(asked: pa.Table, own: pa.Table) -> pa.Table:
        names = ("context", "suffix", "c")
        columns = {c: unpacked(asked, c) for c in names}
        there, at = found_at(own, columns["suffix"])
        columns = {c: x[there] for c, x in columns.items()} | {"lower": unpacked(own, "logp", np.float64)[at]}
        return pa.table(dealt(columns["context"], parts, columns))

    def judged(asked: pa.Table, own: pa.Table) -> pa.Table:
        context = unpacked(asked, "context")
        order, _ = runs(context)
        there, at = found_at(own, context[order])
        order = order[there]
        context, suffix, c = context[order], unpacked(asked, "suffix")[order], unpacked(asked, "c")[order]
        lower, size = unpacked(asked, "lower", np.float64)[order], unpacked(own, "c", np.float64)[at]
        starts = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]) if len(context) else [])
        n = np.diff(np.append(starts, len(context)))
        total = lambda x: np.add.reduceat(x, starts) if len(starts) else np.empty(0, x.dtype)
        covered, whole = total(c), size[starts]
        left = np.maximum(1 - (covered - DISCOUNT * n) / whole, 1e-9)
        p = (c - DISCOUNT) / size + np.repeat(left, n) * 10.0**lower
        gain = total(c * (np.log(p) - lower * np.log(10))) + (whole - covered) * np.log(left)
        states = (gain >= MIN_GAIN) & (gain >= MIN_DIVERGENCE * whole)
        stays, back = np.repeat(states, n), np.log10(left)
        logp = np.log10(p)
        level = {"h": mixed(context, suffix), "c": c, "logp": np.where(stays, logp, lower), "gain": np.where(stays, logp - lower - np.repeat(back, n), 0.0), "back": pa.nulls(len(c), pa.float64())}
        some = int(states.sum())
        weights = {"h": context[starts[states]], "c": np.zeros(some, np.int64), "logp": pa.nulls(some, pa.float64()), "gain": pa.nulls(some, pa.float64()), "back": back[states]}
        return pa.concat_tables([pa.table(level), pa.table(weights)])

    own = shorter.select("part", "h", "c", "logp").groupBy("part")
    sent = counted.groupBy("part").cogroup(own).applyInArrow(below, "part int, context binary, suffix binary, c binary, lower binary")
    return sent.groupBy("part").cogroup(own).applyInArrow(judged, "h long, c long, logp double, gain double, back double")


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score and score of each row; rows where train holds are learned from."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text_col).alias("text"))
    with scratch(), small_batches(docs.sparkSession, TEXTS):
        texts = materialize(encoded(docs), "texts", **DICTIONARY)
        parts = parts_for(texts.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()[0])
        table = materialize(count_words(texts), "words")
        total, distinct = table.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
        unit = float(np.log10(total + distinct + 1))
        log = F.log10(F.col("c") + 1.0)
        level = table.select("h", "c", (log - unit).alias("logp"))
        none = F.lit(0.0)
        values = table.select("h", "c", log.alias("base"), log.alias("own"))
        for size in range(2, order + 1):
            level, states = grown(level, texts, size, parts)
            for part, own in ((level.where("gain <> 0"), "gain"), (states.withColumn("c", F.lit(0)), "back")):
                values = values.unionByName(part.select("h", "c", none.alias("base"), F.col(own).alias("own")))
        sums = materialize(_looked_up(texts, values, order, parts), "sums", outer=True)
    out = sums.groupBy("row").agg(*(F.max(c).alias(c) for c in ("id", "n_tokens")), *(F.sum(c).alias(c) for c in ("n_known", "base", "own")))
    less = F.col("n_tokens") * unit
    return out.select(F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), (F.col("base") - less).alias("base_score"), (F.col("own") - less).alias("score"))


def _sequences(tokens: pa.ListArray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words and sequences up to a size, the place of the text that each is in, and the texts' sizes."""
    h, first, sizes = _flat(tokens)
    number = np.repeat(np.arange(len(sizes)), sizes)
    every, at = [h], [number]
    for _ in range(order - 1):
        context, suffix, last = longer(h, first)
        h, first, number = mixed(context, suffix), first[last - 1], number[last]
        every.append(h)
        at.append(number)
    return np.concatenate(every), np.concatenate(at), sizes


def _looked_up(texts: DataFrame, values: DataFrame, order: int, parts: int) -> DataFrame:
    """row, id, n_tokens, n_known, base and own: several rows for each text, to be added up (id and n_tokens are in the first alone)."""
    spark = texts.sparkSession
    counted = values.where("c > 0").select("h", "c")
    levels = counted.groupBy(F.least("c", F.lit(LEVELS)).alias("c")).agg(F.count("*").alias("n")).orderBy(F.desc("c")).collect()
    # The least count that HOT values reach: only they are put in order.
    reach = np.flatnonzero(np.cumsum([x.n for x in levels]) >= HOT)
    counted = counted.where(F.col("c") >= levels[reach[0]].c) if len(reach) else counted
    most = materialize(counted.orderBy(F.desc("c"), "h").limit(HOT).select("h").distinct(), "hot")
    hot = values.join(F.broadcast(most), "h").groupBy("h").agg(F.sum("base").alias("base"), F.sum("own").alias("own")).toArrow().sort_by("h")
    own = [hot[c].to_numpy() for c in ("h", "base", "own")]
    flags = np.zeros(1 << 22, bool)
    flags[own[0].view(np.uint64) >> np.uint64(42)] = True
    shared = spark.sparkContext.broadcast([*own, flags])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            h, number, sizes = _sequences(batch.column(2), order)
            at, found = place(shared.value, h)
            at, number = at[found], number[found]
            base, own = (x[at] for x in shared.value[1:3])
            known, base, own = (np.bincount(number, x, len(sizes)) for x in (base > 0, base, own))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes), pa.array(known.astype(np.int64)), pa.array(base, pa.float64()), pa.array(own, pa.float64())], ["row", "id", "n_tokens", "n_known", "base", "own"])

    def rest(k: int, bits: Broadcast):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            waiting: list[tuple[np.ndarray, np.ndarray]] = []

            def out() -> pa.RecordBatch:
                h, row = (np.concatenate(x) for x in zip(*waiting, strict=True))
                sent = dealt(h, parts, {"h": h, "row": row})
                return pa.RecordBatch.from_pydict(sent | {"chunk": pa.array(np.full(len(sent["part"]), row[0]))})

            for batch in slices(batches):
                h, number, _ = _sequences(batch.column(1), order)
                mine = np.flatnonzero(slice_of(h) == k)
                mine = mine[held(bits.value, h[mine])]
                mine = mine[~place(shared.value, h[mine])[1]]
                waiting.append((h[mine], batch.column(0).to_numpy()[number[mine]]))
                if sum(len(x) for x, _ in waiting) > CHUNK // 2:
                    yield out()
                    waiting.clear()
            if sum(len(x) for x, _ in waiting):
                yield out()

        return run

    def find(asked: pa.Table, own: pa.Table) -> pa.Table:
        row = unpacked(asked, "row")
        sender = np.repeat(np.arange(asked.num_rows), pc.binary_length(asked.column("h")).to_numpy() // 8)
        found, at = found_at(own, unpacked(asked, "h"))
        row, sender = row[found], sender[found]
        starts = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (sender[1:] != sender[:-1])]) if len(row) else [])
        base, gain = (unpacked(own, c, np.float64)[at] for c in ("base", "own"))
        sums = [np.add.reduceat(x, starts, dtype=x.dtype) if len(starts) else x for x in ((base > 0).astype(np.int32), base, gain)]
        blobs = packed(np.bincount(sender[starts], minlength=asked.num_rows), [row[starts], *sums])
        return pa.Table.from_arrays([asked.column("chunk"), *blobs], ["chunk", "row", "n_known", "base", "own"])

    def total(table: pa.Table) -> pa.Table:
        row, at = np.unique(unpacked(table, "row"), return_inverse=True)
        known, base, own = (np.bincount(at, unpacked(table, c, kind), len(row)) for c, kind in (("n_known", np.int32), ("base", np.float64), ("own", np.float64)))
        return pa.table({"row": row, "n_known": known.astype(np.int64), "base": base.astype(float), "own": own.astype(float)})

    sums = [materialize(texts.select("row", "id", "tokens").mapInArrow(add, "row long, id long, n_tokens long, n_known long, base double, own double"), "hot_sums")]
    for k in range(SLICES):
        with scratch():
            with small_batches(spark, ROWS):
                own = materialize(united(values.where(in_slice("h", k)), parts, ["base", "own"], shared), "values")
            bits = bitmap(own)
            asked = texts.select("row", "tokens").mapInArrow(rest(k, bits), "part int, h binary, row binary, chunk long")
            found = asked.groupBy("part").cogroup(own.select("part", "h", "base", "own").groupBy("part")).applyInArrow(find, "chunk long, row binary, n_known binary, base binary, own binary")
            found = found.groupBy("chunk").applyInArrow(total, "row long, n_known long, base double, own double")
            sums.append(materialize(found, "slice_sums", outer=True).withColumns({"id": F.lit(None).cast("long"), "n_tokens": F.lit(None).cast("long")}))
            bits.unpersist()
    return reduce(DataFrame.unionByName, sums)


def op4_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score(read(spark, sf_dir, "documents"), fold("doc_id", 7) != 2)
    return out.select("doc_id", F.coalesce(fold("doc_id", 7) == 2, F.lit(True)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
