"""BPE encoding and decoding by traversing a trie of the distinct words.

A BPE encoding of a prefix is fixed by the last token of the prefix: it is the only token that is a suffix of the
prefix, stands as one token by itself, and stays apart from the last token of what precedes it. Distinct words of a
batch go into a trie over symbols; a depth-first walk gives each node its last token from its ancestors' last tokens,
so a prefix that many words share is encoded once. The encoding of a word is read backwards from its end node.

Null and empty texts encode to no ids and decode to the empty text. Texts are taken whole. Rows pass through one by
one: repeated rows and other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from leafgrove.llm import _wordbpe
from leafgrove.llm._shared import read

#: Distinct chunks that a Python worker remembers, and tested token pairs; beyond it the memory starts anew.
MEMORY = 350_000
PAIRS = 1_000_000


class TrieEncoder:
    """Encodes sets of pre-tokens with one trie walk for each set."""

    def __init__(self, bpe: _wordbpe.WordBpe):
        self.bpe = bpe
        self.apart: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}
        self.edges: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        self.made_by = {made: (rank, pair) for pair, (rank, made) in sorted(bpe.merges.items(), key=lambda x: -x[1][0])}
        suffix = bpe.suffix
        chars = set(bpe.byte_char)
        #: Tokens by their characters: those inside words, those that end one.
        self.inner = {t: i for t, i in bpe.vocab.items() if not t.endswith(suffix) or t in chars}
        self.final = {t[: -len(suffix)]: i for t, i in bpe.vocab.items() if t.endswith(suffix) and len(t) > len(suffix)}
        self.parts = {i: [bpe.base[c] for c in t] for t, i in self.inner.items() if set(t) <= chars}
        self.parts |= {i: bpe.symbols(t) for t, i in self.final.items() if set(t) <= chars}
        self.inner = {t: i for t, i in self.inner.items() if i in self.parts}
        self.final = {t: i for t, i in self.final.items() if i in self.parts}
        self.longest = max(map(len, self.final))
        #: States of the walk: ends of paths that begin a token.
        self.begins = {t[:k] for t in self.inner for k in range(len(t) + 1)}
        self.texts, self.states, self.ending = [""], {"": 0}, [[]]
        self.steps: dict[int, int] = {}

    def merged(self, symbols: list[int]) -> list[int]:
        """Plain merging, for single tokens."""
        symbols = list(symbols)
        while len(symbols) > 1:
            known = [(self.bpe.merges[p], k) for k, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in self.bpe.merges]
            if not known:
                break
            (_, made), k = min(known, key=lambda x: (x[0][0], x[1]))
            symbols[k : k + 2] = [made]
        return symbols

    def stands(self, token: int) -> bool:
        if (found := self.alone.get(token)) is None:
            found = self.alone[token] = self.merged(self.parts[token]) == [token]
        return found

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether the two tokens' symbols together merge into just these two tokens.

        Merging goes by rank, so what stands at each side of the seam changes at known ranks; the seam is lost only if
        some pair across it has a rank at which both its symbols stand there (at one rank the left place comes first).
        """
        key = left << 20 | right
        if (found := self.apart.get(key)) is None:
            if len(self.apart) >= PAIRS:
                self.apart.clear()
            found = True
            for a, born_a, gone_a in self.edge(left, 1):
                for b, born_b, gone_b in self.edge(right, 0):
                    made = self.bpe.merges.get((a, b))
                    if made and born_a < made[0] < gone_a and born_b < made[0] <= gone_b:
                        found = False
            self.apart[key] = found
        return found

    def edge(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """The symbols that stand at a token's left (0) or right (1) edge as it is merged: symbol, ranks from and to."""
        if (found := self.edges.get((token, side))) is None:
            found, gone = [], 1 << 60
            while True:
                rank, pair = self.made_by.get(token, (-1, None))
                found.append((token, rank, gone))
                if pair is None:
                    break
                token, gone = pair[side], rank
            self.edges[(found[0][0], side)] = found
        return found

    def encode(self, words: Iterable[str]) -> dict[str, list[int]]:
        """Ids of each distinct pre-token."""
        children: list[dict[str, int]] = [{}]
        ends: dict[int, list[str]] = {}
        for word in words:
            node = 0
            for char in word[:-1]:
                if (step := children[node].get(char)) is None:
                    step = children[node][char] = len(children)
                    children.append({})
                node = step
            ends.setdefault(node, []).append(word)
        out: dict[str, list[int]] = {}
        last: list[int] = []  # the last token of each prefix of the path
        stack = [(0, 0, 0, "")]
        apart, steps, ending = self.apart, self.steps, self.ending
        while stack:
            node, depth, state, char = stack.pop()
            if depth:
                del last[depth - 1 :]
                key = state << 21 | ord(char)
                state = steps[key] if key in steps else self._step(state, char)
                for token, size in ending[state]:
                    if size == depth:
                        break
                    key = last[depth - size - 1] << 20 | token
                    if apart[key] if key in apart else self.stay_apart(key >> 20, token):
                        break
                last.append(token)
            for word in ends.get(node, ()):
                out[word] = self._read_back(self._final(word, last), last)
            if children[node]:
                stack.extend([(n, depth + 1, state, c) for c, n in children[node].items()])
        return out

    def _step(self, state: int, char: str) -> int:
        """The state after char: the longest end of the path that begins some token; with it, the tokens that end there."""
        text = self.texts[state] + char
        while text not in self.begins:
            text = text[1:]
        if (found := self.states.get(text)) is None:
            found = self.states[text] = len(self.texts)
            self.texts.append(text)
            tokens = [(self.inner[text[k:]], len(text) - k) for k in range(len(text)) if text[k:] in self.inner]
            self.ending.append([x for x in tokens if self.stands(x[0])])
        self.steps[state << 21 | ord(char)] = found
        return found

    def _final(self, word: str, last: list[int]) -> int:
        """The token that ends a word; last: the last tokens of its shorter prefixes."""
        n = len(word)
        for at in range(max(0, n - self.longest), n):
            token = self.final.get(word[at:])
            if token is not None and self.stands(token) and (at == 0 or self.stay_apart(last[at - 1], token)):
                return token
        raise ValueError("the vocabulary lacks a single byte")

    def _read_back(self, token: int, last: list[int]) -> list[int]:
        ids, at = [token], len(last) + 1
        while (at := at - len(self.parts[token])) > 0:
            token = last[at - 1]
            ids.append(token)
        return ids[::-1]


class Codec:
    """Ids and decoded text; remembers up to MEMORY distinct chunks."""

    def __init__(self, path: str):
        self.bpe = _wordbpe.load(path)
        self.trie = TrieEncoder(self.bpe)
        self.known: dict[str, tuple[int, str, str]] = {}
        self.words: dict[str, tuple[int, str, str]] = {}

    def learn(self, chunks: set[str]) -> None:
        new = {c: self.bpe.pretokens(c) for c in chunks if c not in self.known and c not in self.bpe.special}
        if len(self.words) > MEMORY:
            self.words.clear()
        for word, ids in self.trie.encode({p for ps in new.values() for p in ps if p not in self.words}).items():
            self.words[word] = (len(ids), " ".join(map(str, ids)), self.decode(ids))
        for chunk, ps in new.items():
            own = [self.words[p] for p in ps]
            self.known[chunk] = own[0] if len(own) == 1 else (sum([x[0] for x in own]), " ".join([x[1] for x in own]), " ".join([x[2] for x in own]))
        for token, i in self.bpe.special.items():
            self.known[token] = (1, str(i), token[1:])

    def encode(self, texts: list[str]) -> list[list[tuple[int, str, str]]]:
        """For each text its chunks' (number of ids, ids as text, decoded text)."""
        split = [self.bpe.chunks(t) for t in texts]
        distinct = set().union(*split)
        if len(self.known) + len(distinct) > MEMORY:
            self.known.clear()
        with _wordbpe.no_gc():
            self.learn(distinct)
        return [[x for x in map(self.known.__getitem__, cs) if x[0]] for cs in split]

    def decode(self, ids: list[int]) -> str:
        """Token strings joined by a space: the file names no decoder. Special tokens stay."""
        return " ".join([self.bpe.strings[i] for i in ids])


_codecs: dict[str, Codec] = {}


def encode_decode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row for each row of df: id, n_tokens, ids (decimal, joined by one space) and decoded text."""
    path = path or _wordbpe.default_path()
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codecs.get(path) or _codecs.setdefault(path, Codec(path))
        for batch in batches:
            at = 0
            for texts in _wordbpe.grouped(x.as_py() for x in batch.column(1)):
                coded = codec.encode(texts)
                columns = [pa.array([sum(x[0] for x in c) for c in coded], pa.int64()), pa.array([" ".join(x[1] for x in c) for c in coded]), pa.array([" ".join(x[2] for x in c) for c in coded])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *columns], [id_col, "n_tokens", "ids", "decoded"])
                at += len(texts)

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids string, decoded string")


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """As encode_decode, with SHA-256 digests in place of ids and text; hashed where they are made, so that they need not travel."""
    path = path or _wordbpe.default_path()
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codecs.get(path) or _codecs.setdefault(path, Codec(path))
        for batch in batches:
            at = 0
            for texts in _wordbpe.grouped(x.as_py() for x in batch.column(1)):
                coded = codec.encode(texts)
                hexes = [pa.array([sha256(" ".join([x[k] for x in c]).encode()).hexdigest() for c in coded]) for k in (1, 2)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array([sum([x[0] for x in c]) for c in coded], pa.int64()), *hexes], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])
                at += len(texts)

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"))
