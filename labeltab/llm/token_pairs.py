"""Tokens of two tokenizers over the same bytes, cut into groups where both end a token.

Tokenizer A is a byte-level BPE (``tokenizers`` file), B a SentencePiece model that puts a space before
the text. A slice of documents is aligned at once with numpy.
"""

from __future__ import annotations

import json
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

# The split pattern of the byte-level BPE and its byte alphabet (printable Latin-1
# bytes stand for themselves, the others for the code points from 256 on, in order).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PLAIN_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_alphabet() -> dict[str, int]:
    other = [b for b in range(256) if b not in set(PLAIN_BYTES)]
    return {chr(b): b for b in PLAIN_BYTES} | {chr(256 + i): b for i, b in enumerate(other)}


class Pieces:
    """Byte strings of a vocabulary: lengths, and one buffer to gather from."""

    def __init__(self, pieces: list[bytes]):
        self.length = np.array([len(p) for p in pieces], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.data = np.frombuffer(b"".join(pieces), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        n = self.length[ids]
        first = np.cumsum(n) - n
        return self.data[np.repeat(self.start[ids] - first, n) + np.arange(n.sum())]


@lru_cache(maxsize=1 << 16)
def _settled(c: str) -> bool:
    """Whether the character's class is the same in old and new Unicode tables, so that all libraries agree."""
    kind = unicodedata.category(c)
    return kind != "Cn" and kind == unicodedata.ucd_3_2_0.category(c)


class ByteLevel:
    """Tokenizer A. The merges are those of the file in every case; texts of settled characters
    go through the faster of two libraries that give the same ids for them."""

    def __init__(self, path: str):
        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        special = {t["content"] for t in spec["added_tokens"]}
        pieces = [b""] * self.slow.get_vocab_size()
        for token, i in self.slow.get_vocab().items():
            pieces[i] = token.encode() if token in special else bytes(alphabet[c] for c in token)
        self.pieces = Pieces(pieces)
        ranks = {p: i for i, p in enumerate(pieces) if p and i not in {t["id"] for t in spec["added_tokens"]}}
        self.fast = tiktoken.Encoding("byte_level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if text.isascii() or all(map(_settled, set(text))):
            return self.fast.encode_ordinary(text)
        return self.slow.encode(text, add_special_tokens=False).ids


class PieceModel:
    """Tokenizer B."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = []
        for i in range(self.model.get_piece_size()):
            p = self.model.id_to_piece(i)
            pieces.append(bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode())
        self.pieces = Pieces(pieces)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@lru_cache(maxsize=4)
def byte_level(path: str) -> ByteLevel:
    return ByteLevel(path)


@lru_cache(maxsize=4)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    out = np.empty(int(n.sum()), np.int64)
    at = 0
    for x in lists:
        out[at: at + len(x)] = x
        at += len(x)
    return out, n


@dataclass
class Aligned:
    """Tokens of a slice of texts. Texts whose tokens do not spell space + text have none."""

    a: np.ndarray
    b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    end_a: np.ndarray  # whether the token ends a group
    end_b: np.ndarray
    size_b: int

    @property
    def keys(self) -> np.ndarray:
        """One number for the id pair of each link: the last tokens of each group."""
        return self.a[self.end_a] * self.size_b + self.b[self.end_b]

    @property
    def n_groups(self) -> np.ndarray:
        bounds = np.concatenate([[0], np.cumsum(self.n_a)])
        done = np.concatenate([[0], np.cumsum(self.end_a)])
        return done[bounds[1:]] - done[bounds[:-1]]

    def texts(self) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each text: the ids of its groups in order."""
        group = np.concatenate([np.cumsum(self.end_a) - self.end_a, np.cumsum(self.end_b) - self.end_b])
        words = np.concatenate([_numerals(",")[self.a], _numerals(",")[self.b]])
        words[: len(self.a)][self.end_a] = _numerals("|")[self.a[self.end_a]]
        words[len(self.a):][self.end_b] = _numerals(";")[self.b[self.end_b]]
        words = words[np.argsort(group, kind="stable")].tolist()
        bounds = np.concatenate([[0], np.cumsum(self.n_a + self.n_b)]).tolist()
        return ["".join(words[s:e])[:-1] for s, e in zip(bounds[:-1], bounds[1:])]


@lru_cache(maxsize=4)
def _numerals(tail: str) -> np.ndarray:
    return np.array([f"{i}{tail}" for i in range(1 << 17)], object)


def align(texts: list[str], path_a: str, path_b: str) -> Aligned:
    """Align texts (no nulls) under tokenizers A and B."""
    one, two = byte_level(path_a), piece_model(path_b)
    lists_a = [one.encode(" " + t) if t else [] for t in texts]
    lists_b = two.encode(texts) if texts else []
    lists_b = [x if t else [] for t, x in zip(texts, lists_b)]
    raw = [(" " + t).encode() if t else b"" for t in texts]
    a, n_a = _flat(lists_a)
    b, n_b = _flat(lists_b)
    want = np.frombuffer(b"".join(raw), np.uint8)
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    keep = _spells(a, n_a, one.pieces, want, size) & _spells(b, n_b, two.pieces, want, size)
    if not keep.all():
        a, b = a[np.repeat(keep, n_a)], b[np.repeat(keep, n_b)]
        n_a, n_b, size = np.where(keep, n_a, 0), np.where(keep, n_b, 0), np.where(keep, size, 0)
    at_a, at_b = np.cumsum(one.pieces.length[a]), np.cumsum(two.pieces.length[b])
    seen = np.zeros((2, int(size.sum()) + 1), bool)
    seen[0, at_a] = True
    seen[1, at_b] = True
    return Aligned(a, b, n_a, n_b, seen[1, at_a], seen[0, at_b], len(two.pieces.length))


def _spells(ids: np.ndarray, n: np.ndarray, pieces: Pieces, want: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the pieces of each text join to its bytes."""
    bounds = np.concatenate([[0], np.cumsum(n)])
    length = np.concatenate([[0], np.cumsum(pieces.length[ids])])
    ok = length[bounds[1:]] - length[bounds[:-1]] == size
    if not ok.all():
        ids, want = ids[np.repeat(ok, n)], want[np.repeat(ok, size)]
    bad = np.concatenate([[0], np.cumsum(pieces.joined(ids) != want)])
    at = np.concatenate([[0], np.cumsum(np.where(ok, size, 0))])
    return ok & (bad[at[1:]] == bad[at[:-1]])
