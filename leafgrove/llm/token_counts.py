"""Token counts by rank-synchronous array merging.

Distinct pre-tokens of a batch are held as one ragged numpy array of symbols. In each round every sequence finds its
lowest-ranked adjacent pair, and all its occurrences are merged at once (of overlapping ones the leftmost), for all
sequences together; a sequence without a known pair leaves, and its surviving symbols are counted.

Null and empty texts have 0 tokens. Any length of text is counted whole. Rows pass through one by one: repeated rows,
ties and other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgrove.llm import _wordbpe
from leafgrove.llm._shared import read

#: Distinct chunks whose counts a Python worker remembers; beyond it the memory starts anew.
MEMORY = 500_000
_NONE = np.int32(2**31 - 1)


class RankMerger:
    """Counts symbols of pre-tokens; merge tables as sorted arrays."""

    def __init__(self, bpe: _wordbpe.WordBpe):
        self.bpe = bpe
        pairs = sorted((a << 20 | b, rank, made) for (a, b), (rank, made) in bpe.merges.items())
        self.keys = np.array([*(k for k, _, _ in pairs), 2**62], np.int64)
        self.ranks = np.array([*(r for _, r, _ in pairs), _NONE], np.int32)
        self.made = np.zeros(len(bpe.merges) + 1, np.int32)
        for _, rank, made in pairs:
            self.made[rank] = made

    def counts(self, pretokens: list[str]) -> np.ndarray:
        """Symbols left of each pre-token."""
        left = np.zeros(len(pretokens), np.int64)
        if not pretokens:
            return left
        symbols = np.fromiter((s for p in pretokens for s in self.bpe.symbols(p)), np.int64)
        owner = np.repeat(np.arange(len(pretokens)), np.fromiter(map(len, pretokens), np.int64, len(pretokens)))
        while len(symbols):
            same = owner[1:] == owner[:-1]
            key = np.where(same, symbols[:-1] << 20 | symbols[1:], -1)
            at = np.searchsorted(self.keys, key)
            rank = np.append(np.where(self.keys[at] == key, self.ranks[at], _NONE), _NONE)
            starts = np.flatnonzero(np.append(True, ~same))
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(symbols)))
            done = best == _NONE
            left[owner[starts[done]]] = sizes[done]
            hit = (rank == np.repeat(best, sizes)) & (rank != _NONE)
            # Of hits in a row (a pair that overlaps itself), every second one counts, from the left.
            spots = np.flatnonzero(hit)
            if not len(spots):
                break
            first = np.append(True, np.diff(spots) > 1)
            run = np.cumsum(first) - 1
            chosen = spots[(np.arange(len(spots)) - np.flatnonzero(first)[run]) % 2 == 0]
            symbols[chosen] = self.made[rank[chosen]]
            keep = np.repeat(~done, sizes)
            keep[chosen + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        return left


class Counter:
    """Tokens of texts; remembers up to MEMORY distinct chunks."""

    def __init__(self, path: str):
        self.bpe = _wordbpe.load(path)
        self.merger = RankMerger(self.bpe)
        self.known: dict[str, int] = {}

    def learn(self, chunks: set[str]) -> None:
        new = [c for c in chunks if c not in self.known]
        parts = [[] if c in self.bpe.special else self.bpe.pretokens(c) for c in new]
        distinct = {p: k for k, p in enumerate({p for ps in parts for p in ps})}
        counts = self.merger.counts(list(distinct)).tolist()
        for chunk, ps in zip(new, parts, strict=True):
            self.known[chunk] = 1 if chunk in self.bpe.special else sum([counts[distinct[p]] for p in ps])

    def count(self, texts: list[str]) -> list[int]:
        split = [self.bpe.chunks(t) for t in texts]
        distinct = set().union(*split)
        if len(self.known) + len(distinct) > MEMORY:
            self.known.clear()
        with _wordbpe.no_gc():
            self.learn(distinct)
        return [sum(map(self.known.__getitem__, cs)) for cs in split]


_counters: dict[str, Counter] = {}


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row for each row of df: id, n_bytes (UTF-8) and n_tokens."""
    path = path or _wordbpe.default_path()
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counters.get(path) or _counters.setdefault(path, Counter(path))
        for batch in batches:
            ids, sizes, counts = batch.column(0), [], []
            for texts in _wordbpe.grouped(x.as_py() for x in batch.column(1)):
                counts += counter.count(texts)
                sizes += [len(t.encode("utf-8")) for t in texts]
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], [id_col, "n_bytes", "n_tokens"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > 2048)
