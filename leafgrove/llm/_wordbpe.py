"""The word-level BPE of a tokenizers file: pre-tokens of a text, and the merge tables.

The file normalizes to NFC, turns white space to single spaces and lower-cases; no alternative of its split pattern
crosses white space. So a text may be lower-cased and cut at white space first, and each distinct chunk encoded once.
"""

from __future__ import annotations

import gc
import json
import unicodedata
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import regex

#: White space as the file's split pattern has it (Unicode White_Space).
_SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
#: str.split() also cuts at these, the file's pattern does not.
_EXTRA = "\x1c\x1d\x1e\x1f"
_BY_SPACE = regex.compile(f"[{_SPACE}]+")
#: Characters of texts that are worked on together.
_BATCH_CHARS = 4_000_000


@contextmanager
def no_gc() -> Iterator[None]:
    """For code that makes many objects and no cycles: looking for cycles takes a third of its time."""
    collects = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if collects:
            gc.enable()


class WordBpe:
    """Tables of one tokenizers file of this kind.

    Symbols are vocabulary ids. A pre-token becomes its UTF-8 bytes as symbols, the last one with the end-of-word mark.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"]
        #: Special tokens as chunks: a leading space, which no other chunk has, tells them from the same string in lower-cased text.
        self.special = {" " + t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace("\\s", _SPACE))
        self.specials = regex.compile("(" + "|".join(regex.escape(x[1:]) for x in sorted(self.special, key=len, reverse=True)) + ")")
        self.strings = {i: t for t, i in self.vocab.items()} | {i: t[1:] for t, i in self.special.items()}
        self.byte_char = _byte_chars()
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault((self.vocab[a], self.vocab[b]), (rank, self.vocab[a + b]))
        self.base = {c: self.vocab[c] for c in self.byte_char}
        self.last = {c: self.vocab[c + self.suffix] for c in self.byte_char}

    def chunks(self, text: str) -> list[str]:
        """Lower-cased pieces of a text between white space; strings of special tokens stand alone."""
        if "<|" in text:
            return [y for x in self.specials.split(text) for y in ([" " + x] if " " + x in self.special else self._split(x))]
        return self._split(text)

    def _split(self, text: str) -> list[str]:
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")  # else lower() looks at its neighbours
        text = text.lower()
        return [x for x in _BY_SPACE.split(text) if x] if any(c in text for c in _EXTRA) else text.split()

    def parts(self, chunk: str) -> list[str]:
        """Pre-tokens of a chunk that is no special token."""
        if chunk.isalpha():
            return [chunk]
        if chunk[-1] in ".,!?:;" and chunk[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        return self.pattern.findall(chunk)

    def pretokens(self, chunk: str) -> list[str]:
        """As parts, spelled."""
        return list(map(self.spelled, self.parts(chunk)))

    def spelled(self, pretoken: str) -> str:
        """A pre-token with one printable character for each byte."""
        return pretoken if pretoken.isascii() and pretoken.isprintable() else "".join(map(self.byte_char.__getitem__, pretoken.encode("utf-8")))

    def symbols(self, spelled: str) -> list[int]:
        return [*map(self.base.__getitem__, spelled[:-1]), self.last[spelled[-1]]]


def _byte_chars() -> "_Bytes":
    return _Bytes()


class _Bytes(dict):
    """Byte to printable character, as byte-level vocabularies have it: printable Latin-1 stands for itself, the rest follow from 256 on.

    Iterating gives the characters.
    """

    def __init__(self) -> None:
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(own)]
        super().__init__({b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)})

    def __iter__(self):
        return iter(self.values())


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def grouped(texts: Iterable[str | None]) -> Iterator[list[str]]:
    """Texts (null: empty) in lists of about _BATCH_CHARS characters; a longer text stands alone."""
    held, size = [], 0
    for text in texts:
        held.append(text or "")
        size += len(held[-1])
        if size >= _BATCH_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
