"""Token counts by a count-only Viterbi search over a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary's pieces that end at each position; the search keeps
only the best score and the number of pieces up to there, so no segmentation is built. Ties follow the
tokenizer: a candidate replaces the held one only if it scores strictly more, and candidates come from the
earliest start, which is the longest piece. A character without a piece of its own scores the least piece
score less 10 and counts one piece for each of its UTF-8 bytes.

Blanks become U+2581 and one is put before the text. As long as no piece has that mark after another
character, the best segmentation of a text is that of its words side by side; words are then looked up in a
bounded cache of counts and searched only when missing there. Otherwise texts are searched whole.

The vocabulary's size bounds what each task gets. Edge cases: null and empty texts have 0 tokens; repeated
rows give equal rows; texts of any length are searched in time linear in their length; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
PENALTY = 10.0
#: Words whose counts a worker holds, and the longest word that is held.
CACHE_WORDS, CACHE_CHARS = 500_000, 48
_RUNS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece model's ordinary pieces; control, unknown and byte pieces are left out."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    special = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size()) if not special(i)]


class Counter(dict):
    """Piece counts of words; missing ones are searched on the way."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.unknown = min(s for _, s in pieces) - PENALTY
        self.by_word = not any(MARK in p.lstrip(MARK) for p, _ in pieces)

    def __missing__(self, word: str) -> int:
        n = self.search(MARK + word)
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = n
        return n

    def search(self, text: str) -> int:
        """Pieces of the best segmentation of a text whose blanks are marks."""
        none = float("-inf")
        best, pieces, settled = [0.0] + [none] * len(text), [0] * (len(text) + 1), 0
        single, unknown = self.single, self.unknown

        def settle(upto: int) -> None:
            nonlocal settled
            while settled < upto:
                settled += 1
                if (c := text[settled - 1]) not in single and (score := best[settled - 1] + unknown) > best[settled]:
                    best[settled], pieces[settled] = score, pieces[settled - 1] + len(c.encode("utf-8", "surrogatepass"))

        for last, (length, score) in self.automaton.iter(text):
            if settled < last:
                settle(last)
            start = last + 1 - length
            if (score := best[start] + score) > best[last + 1]:
                best[last + 1], pieces[last + 1] = score, pieces[start] + 1
        settle(len(text))
        return pieces[-1]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.by_word:
            if MARK not in text and "  " not in text and text[0] != " ":
                return sum(map(self.__getitem__, text.split(" ")))
            # runs of blanks belong to the word after them
            return sum(self[x[1:]] if x[0] == MARK else self.search(x) for x in _RUNS.findall(MARK + text.replace(" ", MARK)))
        return self.search(MARK + text.replace(" ", MARK))


#: The counter that this worker built last, by its vocabulary's digest.
_held: dict[str, Counter] = {}


def token_counts(docs: DataFrame, pieces: list[tuple[str, float]]) -> DataFrame:
    """doc_id and n_tokens of each row of docs (doc_id, text). pieces: the vocabulary with its scores."""
    shipped = docs.sparkSession.sparkContext.broadcast(pieces)
    digest = hashlib.md5(repr(pieces).encode()).hexdigest()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if digest not in _held:
            _held.clear()
            _held[digest] = Counter(shipped.value)
        count = _held[digest].count
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([count(t.as_py()) for t in batch.column(1)], pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(task, "doc_id long, n_tokens long")
