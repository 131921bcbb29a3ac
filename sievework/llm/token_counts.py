"""Token counts under a unigram vocabulary, without making tokens.

An Aho-Corasick automaton over the vocabulary lists every piece that ends at each place of a word; dynamic programming
carries the best score and its number of pieces. Ties go as in the unigram tokenizer: of paths that reach a place with
equal scores, the one whose last piece starts first wins. Characters without a piece of their own count as their UTF-8
bytes (byte fallback), at a score of 10 below the vocabulary's least.

Pieces do not cross spaces, so a text's count is the sum over its words; counts of words are kept while they are fewer
than a bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import arrow, arrow_map

SPACE = "▁"
UNKNOWN = 10.0
KEPT = 300_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def scored_pieces(path: str) -> list[tuple[str, float]]:
    """The pieces of a sentencepiece file with their scores, by id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter(dict):
    """Counts of words (with their leading space mark), found by need."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        super().__init__()
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN
        self.single = {piece for piece, _ in pieces if len(piece) == 1}

    def best(self, word: str) -> tuple[float, int]:
        """Score and number of pieces of the best path."""
        n = len(word)
        score, count = [0.0] + [0.0] * n, [0] * (n + 1)
        ends: dict[int, list[tuple[int, float]]] = {}
        for end, found in self.automaton.iter(word):
            ends.setdefault(end + 1, []).append(found)
        for at in range(1, n + 1):
            top = None
            for size, own in ends.get(at, ()):  # longest first: the earliest start
                s = score[at - size] + own
                if top is None or s > top:
                    top, c = s, count[at - size] + 1
            if word[at - 1] not in self.single:
                s = score[at - 1] + self.unknown
                if top is None or s > top:
                    top, c = s, count[at - 1] + len(word[at - 1].encode("utf-8"))
            score[at], count[at] = top, c
        return score[n], count[n]

    def __missing__(self, word: str) -> int:
        c = sum(self.best(SPACE + w)[1] for w in word.split(SPACE))
        if len(self) >= KEPT:
            self.clear()
        self[word] = c
        return c

    def count(self, text: str) -> int:
        if not text:
            return 0
        words = text.split(" ")
        if not words[0] and len(words) > 1:  # a text that starts with a space gets no other one
            words = words[1:]
        elif words[0].startswith(SPACE):
            words[0] = words[0][1:]
        return sum(map(self.__getitem__, words))


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(scored_pieces(path))


COUNTED = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("n_tokens", pa.int64())])


def _count(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            yield arrow(COUNTED, doc_id=batch.column("doc_id"), n_chars=np.array([len(t) for t in texts], np.int64), n_tokens=np.array([own.count(t) for t in texts], np.int64))

    return count


def token_counts(docs: DataFrame, vocabulary: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_chars (code points) and n_tokens of each row. Null and empty texts have none; each row counts by itself; an empty table gives none; other columns are ignored."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).transform(arrow_map(_count(vocabulary or default_vocabulary()), "doc_id long, n_chars long, n_tokens long"))
