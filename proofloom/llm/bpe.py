"""Byte-level BPE by backtracking, exact and in linear time, and decoding by an offset table.

A piece of text is encoded from the left: take the longest token that matches here (all matches of a piece come from one pass of an
Aho-Corasick automaton), keep it if it is compatible with the token before, else try its next shorter prefix, and step back if none is left.
Two neighbouring tokens are compatible exactly if merging their joined bytes gives these two tokens again; the answers are kept in a table.
"""

from __future__ import annotations

import base64
import os
from array import array
from dataclasses import dataclass

import numpy as np

PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHED_PIECES = 1 << 18
CACHED_LENGTH = 64


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the vocabulary files lie: the folder in PROOFLOOM_TOKENIZERS, or the installed public_tokenizers."""
    folder = os.environ.get("PROOFLOOM_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


@dataclass(frozen=True)
class Vocabulary:
    """Token bytes back to back with their offsets (the decoding table); size is fixed by the vocabulary, about a megabyte."""

    blob: bytes
    offsets: np.ndarray
    pattern: str = PATTERN

    @classmethod
    def load(cls, path: str, pattern: str = PATTERN) -> Vocabulary:
        """From lines of base64 token and rank, ranks 0, 1, 2, ... without gaps."""
        with open(path, "rb") as lines:
            pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in (line.split() for line in lines if line.strip()))
        if [r for r, _ in pairs] != list(range(len(pairs))):
            raise ValueError(f"{path}: ranks have gaps")
        return cls(b"".join(t for _, t in pairs), np.cumsum([0, *(len(t) for _, t in pairs)]), pattern)

    def tokens(self) -> list[bytes]:
        edge = self.offsets.tolist()
        return [self.blob[a:b] for a, b in zip(edge, edge[1:])]

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``; an empty list is the empty text. Ids outside the vocabulary raise IndexError."""
        n = len(self.offsets) - 1
        edge, blob = self.offsets, self.blob
        if any(not 0 <= i < n for i in ids):
            raise IndexError("no such token")
        return b"".join(blob[edge[i] : edge[i + 1]] for i in ids).decode("utf-8", errors="replace")


class Encoder(dict):
    """Piece of text -> token ids; the dict holds pieces seen before, a bounded memory of exact answers."""

    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick
        import regex

        super().__init__()
        tokens = [t.decode("latin-1") for t in vocabulary.tokens()]
        self.find = regex.compile(vocabulary.pattern).findall
        self.length = [len(t) for t in tokens]
        self.ids = {t: i for i, t in enumerate(tokens)}
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(tokens):
            self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        self.shorter = [next((self.ids[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.ids), -1) for t in tokens]
        self.parts: list[tuple[int, int] | None] = [None] * len(tokens)  # the two tokens whose merge makes this one
        self.merged: dict[tuple[int, int], int] = {}
        self.fit: dict[tuple[int, int], bool] = {}
        for i, t in enumerate(tokens):
            for k in range(1, len(t)):
                a, b = self.ids.get(t[:k], i), self.ids.get(t[k:], i)
                if a < i and b < i and self._compatible(a, b):
                    self.parts[i] = (a, b)
                    self.merged[a, b] = i
                    break
        self.fit.clear()

    def _compatible(self, a: int, b: int) -> bool:
        """Go back in time at the border of a and b, undoing the later merge each time; a merge across the border that would have come
        first rules the pair out. Of equal merges the one further left comes first."""
        before = len(self.parts)
        while True:
            across = self.merged.get((a, b))
            if across is not None and across < before:
                return False
            pa, pb = self.parts[a], self.parts[b]
            if pa is None and pb is None:
                return True
            if pb is None or (pa is not None and a > b):
                before, a = a, pa[1]
            else:
                before, b = b + 1, pb[0]

    def compatible(self, a: int, b: int) -> bool:
        known = self.fit.get((a, b))
        if known is None:
            if len(self.fit) > 1 << 20:
                self.fit.clear()
            known = self.fit[a, b] = self._compatible(a, b)
        return known

    def encode_bytes(self, piece: str) -> list[int]:
        """``piece``: bytes as latin-1 characters."""
        whole = self.ids.get(piece)
        if whole is not None:
            return [whole]
        n, length, shorter = len(piece), self.length, self.shorter
        longest = array("i", [-1]) * n
        for end, token in self.automaton.iter(piece):
            start = end - length[token] + 1
            if longest[start] < 0 or length[longest[start]] < length[token]:
                longest[start] = token
        dead = bytearray(n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            end = at + length[token]
            if not dead[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = end
                if at < n:
                    token = longest[at]
                continue
            token = shorter[token]
            while token < 0:  # nothing fits here: never come back to this place, and shorten the token before
                dead[at] = 1
                last = out.pop()
                at -= length[last]
                token = shorter[last]
        return out

    def __missing__(self, piece: str) -> list[int]:
        ids = self.encode_bytes(piece.encode("utf-8").decode("latin-1"))
        if len(piece) <= CACHED_LENGTH:
            if len(self) >= CACHED_PIECES:
                self.clear()
            self[piece] = ids
        return ids

    def encode_into(self, text: str, out: array) -> None:
        for piece in self.find(text):
            out.extend(self[piece])

    def encode(self, text: str | None) -> list[int]:
        out = array("i")
        if text:
            self.encode_into(text, out)
        return out.tolist()


_ready: dict[tuple, Encoder] = {}


def encoder(vocabulary: Vocabulary) -> Encoder:
    """One encoder per process and vocabulary."""
    key = (hash(vocabulary.blob), vocabulary.pattern)
    if key not in _ready:
        _ready[key] = Encoder(vocabulary)
    return _ready[key]
