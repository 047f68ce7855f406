"""Array helpers for tasks: words of a text, word numbers, whole groups out of sorted batches, forests."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Maps UTF-8 bytes: A-Z to a-z, every other ASCII byte that isn't a digit or a-z to a blank.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def raw_texts(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text; null is empty."""
    return (t.as_py() or b"" for t in column.cast(pa.binary()))


def low_words(text: bytes) -> list[bytes]:
    """The words of _common.lower_words, in UTF-8."""
    return text.translate(LOWER).split()


def frugal(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """task, after which Arrow's memory that nothing uses goes back: Spark keeps its workers, and they would keep that for the tasks to come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        pa.default_memory_pool().release_unused()

    return run


class WordNumbers(dict):
    """64-bit hashes of words, held for up to `limit` words."""

    def __init__(self, limit: int = 500_000):
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        n = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 48:
            self[word] = n
        return n

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of 64-bit values; wraps around."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def grams(numbers: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n word numbers; of all words together where there are fewer, but not none."""
    if not len(numbers):
        return numbers
    n = min(n, len(numbers))
    out = np.zeros(len(numbers) - n + 1, np.uint64)
    for j in range(n):
        out = mixed(out + np.uint64(2 * j + 1)) + numbers[j : j + len(out)]
    return mixed(out)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, least: int = 4096) -> Iterator[pa.Table]:
    """Regroups batches that are sorted by key so that no key spans two tables, of `least` rows or more each.

    What is held back is one group, so groups must be bounded by those who form them.
    """
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        table = pa.Table.from_batches(held)
        keys = table.column(key).to_numpy(zero_copy_only=False)
        last = len(keys) - 1
        changes = np.flatnonzero(keys != keys[last])
        cut = int(changes[-1]) + 1 if len(changes) else 0
        if cut:
            yield table.slice(0, cut)
            held, rows = table.slice(cut).to_batches(), len(keys) - cut
    if rows:
        yield pa.Table.from_batches(held)


def group_starts(keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys, and the end."""
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]) if len(keys) else np.zeros(1, int)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index reachable from each of n nodes over the edges a-b."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        while (more := new[new]).tolist() != new.tolist():
            new = more
        new = new[root]
        if (new == root).all():
            break
        root = new
        keep = root[a] != root[b]
        a, b = a[keep], b[keep]
    return root
