"""Indel ratios of one name with all names of a block, in numpy: the rules of functions.similarity, for many pairs.

A block's letters are kept as bits of places, a row of machine words each. One step of the fold over the quoted name's letters
moves all of the block's names at once. Every word has a blank before it, so that words can be masked out of a text.
"""

from __future__ import annotations

import re

import numpy as np

#: Places in one machine word; the bits above hold a carry.
BITS = 62
_EVERY = np.uint64((1 << BITS) - 1)
_BITS = np.uint64(BITS)
_SPACE = re.compile("[ \t\n\x0b\f\r]+")


def _split(name: str) -> list[str]:
    return [w for w in _SPACE.split(name) if w]


def _spaced(words: list[str]) -> str:
    return "".join(f" {w}" for w in words)


class _Places:
    """For each letter where it stands in each of texts: array (machine words, texts)."""

    def __init__(self, texts: list[str]):
        wide = max(1, *map(len, texts))
        codes = np.zeros((wide, len(texts)), np.uint32)
        for i, t in enumerate(texts):
            codes[: len(t), i] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.width = -(-wide // BITS)
        self.bits = {c: np.zeros((self.width, len(texts)), np.uint64) for c in set().union(*texts)}
        for c, out in self.bits.items():
            found = codes == ord(c)
            for at in np.flatnonzero(found.any(1)):
                out[at // BITS] |= found[at].astype(np.uint64) << np.uint64(at % BITS)
        self.counts = {c: np.bitwise_count(b).sum(0, dtype=np.int64) for c, b in self.bits.items()}


def _common(letters: list[tuple[np.ndarray, np.ndarray | None]], width: int, n: int) -> np.ndarray:
    """Longest common subsequences of a text with each of n texts: of each of its letters the bits, and which texts it counts for."""
    rows = np.full((width, n), _EVERY)
    for bits, counts in letters:
        hit = rows & bits
        if counts is not None:
            hit &= counts
        total = rows + hit
        for k in range(width - 1):
            total[k + 1] += total[k] >> _BITS
        rows = (total | (rows - hit)) & _EVERY
    return BITS * width - np.bitwise_count(rows).sum(0, dtype=np.int64)


class Block:
    """Names of about one length, prepared for ratios with any other name."""

    def __init__(self, names: list[str]):
        split = [_split(n) for n in names]
        words = [sorted(set(s)) for s in split]
        self.n = len(names)
        self.places = _Places([_spaced(w) for w in words])
        self.size = np.array([max(len(_spaced(w)) - 1, 0) for w in words])
        self.words = np.array([len(w) for w in words])
        repeats = any(len(s) > len(w) for s, w in zip(split, words))
        self.sorted = _Places([_spaced(sorted(s)) for s in split]) if repeats else self.places
        self.sorted_size = np.array([max(len(_spaced(s)) - 1, 0) for s in split])
        held: dict[str, tuple[list[int], list[int]]] = {}
        for i, ws in enumerate(words):
            at = 0
            for w in ws:
                rows, starts = held.setdefault(w, ([], []))
                rows.append(i)
                starts.append(at)
                at += len(w) + 1
        self.held = {w: (np.array(rows), np.array(starts)) for w, (rows, starts) in held.items()}

    def _span(self, word: str) -> np.ndarray:
        """The places of a word in the names that hold it."""
        rows, starts = self.held[word]
        out = np.zeros((self.places.width, self.n), np.uint64)
        for k in range(len(word) + 1):
            at = starts + k
            out[at // BITS, rows] |= np.uint64(1) << (at % BITS).astype(np.uint64)
        return out

    def reachable(self, name: str, least: float) -> np.ndarray:
        """Numbers of the names whose set ratio with name may reach least: by letters in common, or by a shared word."""
        words = sorted(set(_split(name)))
        text = _spaced(words)
        both = np.zeros(self.n, np.int64)
        for c in set(text):
            if c in self.places.counts:
                both += np.minimum(self.places.counts[c], text.count(c))
        may = 200.0 * (both - 1) >= least * (self.size + len(text) - 1) - 1e-6
        for w in words:
            if w in self.held:
                may[self.held[w][0]] = True
        return np.flatnonzero(may)

    def set_ratios(self, name: str, of: np.ndarray | None = None) -> np.ndarray:
        """token_set_ratio of name with each name, or with those numbered `of`."""
        pick = (lambda x: x) if of is None else (lambda x: x[..., of])
        words = sorted(set(_split(name)))
        size, n = max(len(_spaced(words)) - 1, 0), self.n if of is None else len(of)
        keep: np.ndarray | None = None
        shared, both, alive = np.zeros(n, np.int64), np.zeros(n, np.int64), {}
        for w in words:
            if w in self.held:
                span = pick(self._span(w))
                has = span.any(0)
                if has.any():
                    shared += has
                    both += has * (len(w) + 1)
                    alive[w] = np.where(has, np.uint64(0), _EVERY)
                    keep = ~span if keep is None else keep & ~span
        kept: dict[str, np.ndarray] = {}
        letters = []
        for w in words:
            for c in f" {w}":
                if c in self.places.bits:
                    if c not in kept:
                        kept[c] = pick(self.places.bits[c]) if keep is None else pick(self.places.bits[c]) & keep
                    letters.append((kept[c], alive.get(w)))
        common = _common(letters, self.places.width, n)
        sizes, least = pick(self.size) + size, np.minimum(pick(self.size), size)
        some, both = shared > 0, both - 1
        # shared words stand first on both sides, so they are common to the end; the blank before the rest is common too
        whole = 200.0 * np.where(some, both + common, common - 1) / np.maximum(sizes, 1)
        out = np.where(some, np.maximum(whole, 200.0 * both / np.maximum(both + least, 1)), whole)
        out[some & ((shared == len(words)) | (shared == pick(self.words)))] = 100.0
        out[least == 0] = 0.0
        return out

    def sort_ratios(self, name: str, of: np.ndarray | None = None) -> np.ndarray:
        """token_sort_ratio of name with each name, or with those numbered `of`."""
        pick = (lambda x: x) if of is None else (lambda x: x[..., of])
        text = _spaced(sorted(_split(name)))
        n = self.n if of is None else len(of)
        bits = {c: pick(self.sorted.bits[c]) for c in set(text) if c in self.sorted.bits}
        common = _common([(bits[c], None) for c in text if c in bits], self.sorted.width, n)
        own, total = pick(self.sorted_size), pick(self.sorted_size) + max(len(text) - 1, 0)
        out = 200.0 * (common - 1) / np.maximum(total, 1)
        out[(own == 0) | (not text)] = 0.0
        out[total == 0] = 100.0
        return out


def blocks(names: list[str]) -> list[tuple[np.ndarray, Block]]:
    """Blocks of names that fill the same number of machine words, each with the numbers of its names."""
    width = np.array([(len(n) + 1) // BITS for n in names])
    return [(at, Block([names[i] for i in at])) for at in (np.flatnonzero(width == w) for w in np.unique(width))]
