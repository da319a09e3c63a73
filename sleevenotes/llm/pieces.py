"""Pieces of a public subword vocabulary, for the segmentations that `langid` sums over and `encoding` maximises over.

The vocabulary file is only read (on the driver, from a path that is a parameter) and never changed or trained. Its
scores are ranks; a piece's log probability is taken from its rank by Zipf's law, in whole millionths, so that sums of
scores are exact in any order. Spaces stand for themselves here: a piece that begins a word begins with a space, and
the vocabulary's own space mark, when it occurs in a text, is an ordinary character.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE_MARK = "▁"
#: Score of one byte of a character that has no piece: below every piece.
BYTE_SCORE = -14_000_000
NEVER = -(1 << 60)


@dataclass
class Vocabulary:
    surfaces: list[str]  # by id; empty for control and byte pieces
    first_byte: int  # id of byte 0
    scores: list[int]  # by id
    longest: int = 0
    ids: dict[str, int] = field(default_factory=dict)
    pairs: frozenset[str] = frozenset()  # neighbouring characters in pieces
    starts: dict[str, int] = field(default_factory=dict)  # beginnings of pieces; -1 if not a piece

    def __post_init__(self) -> None:
        self.ids = {s: i for i, s in enumerate(self.surfaces) if s}
        self.longest = max(map(len, self.ids), default=1)
        self.pairs = frozenset(s[i : i + 2] for s in self.ids for i in range(len(s) - 1))
        self.starts = {s[:j]: -1 for s in self.ids for j in range(1, len(s))} | self.ids

    def character(self, c: str) -> tuple[int, ...]:
        """Byte pieces of a character that has no piece of its own."""
        return tuple(self.first_byte + b for b in c.encode("utf-8", "surrogatepass"))

    def edges(self, text: str, i: int) -> list[tuple[int, tuple[int, ...], int]]:
        """(end, ids, score) of what can start at i: pieces, or the bytes of a character without a piece."""
        found, starts = [], self.starts
        for j in range(i + 1, min(len(text), i + self.longest) + 1):
            k = starts.get(text[i:j])
            if k is None:
                break
            if k >= 0:
                found.append((j, (k,), self.scores[k]))
        if text[i] not in self.ids:
            b = self.character(text[i])
            found.append((i + 1, b, BYTE_SCORE * len(b)))
        return found


class PieceTable:
    """Pieces found by hash, for whole arrays of strings at a time: two tables of slots, a piece is in one of its two."""

    BITS = 20
    FACTOR = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, ids: dict[str, int]):
        self.keys = np.zeros((2, 1 << self.BITS), np.uint64)
        self.ids = np.full((2, 1 << self.BITS), -1, np.int32)
        by_size: dict[int, list[str]] = {}
        for piece in ids:
            by_size.setdefault(len(piece), []).append(piece)
        late: list[tuple[int, int]] = []
        for n, pieces in by_size.items():
            h = self.seed(len(pieces))
            codes = np.array(pieces, f"<U{n}").view(np.uint32).reshape(len(pieces), n)
            for j in range(n):
                h = self.extend(h, codes[:, j])
            slots, own = self._slots(h)[0], np.array([ids[p] for p in pieces], np.int32)
            _, first = np.unique(slots, return_index=True)
            first = first[self.ids[0, slots[first]] < 0]
            self.keys[0, slots[first]], self.ids[0, slots[first]] = h[first], own[first]
            rest = np.setdiff1d(np.arange(len(pieces)), first)
            late += zip(h[rest].tolist(), own[rest].tolist(), strict=True)
        for key, k in late:  # few: they go to the other table; an earlier piece there makes room in its own other one
            where = 1
            for _ in range(64):
                slot = int(self._slots(np.array([key], np.uint64))[where][0])
                key, k, self.keys[where, slot], self.ids[where, slot] = int(self.keys[where, slot]), int(self.ids[where, slot]), key, k
                if k < 0:
                    break
                where = 1 - where
            else:
                raise ValueError("pieces do not fit")

    def seed(self, n: int) -> np.ndarray:
        return np.full(n, np.uint64(0x2545F4914F6CDD1D))

    def extend(self, hashes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        h = (hashes ^ codes) * self.FACTOR
        return h ^ (h >> np.uint64(29))

    def _slots(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (h >> np.uint64(64 - self.BITS)).astype(np.int64), (h & np.uint64((1 << self.BITS) - 1)).astype(np.int64)

    def look_up(self, h: np.ndarray) -> np.ndarray:
        """Ids, or -1."""
        a, b = self._slots(h)
        out = np.where(self.keys[0, a] == h, self.ids[0, a], np.int32(-1))
        return np.where(self.keys[1, b] == h, self.ids[1, b], out)


def load(path: str = DEFAULT_MODEL) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    surfaces, scores, first = [], [], -1
    for i in range(model.get_piece_size()):
        plain = not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
        surfaces.append(model.id_to_piece(i).replace(SPACE_MARK, " ") if plain else "")
        scores.append(round(-1e6 * math.log(10 - model.get_score(i))) if plain else BYTE_SCORE)
        if model.is_byte(i) and first < 0:
            first = i
    return Vocabulary(surfaces, first, scores)
