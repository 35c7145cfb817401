"""Operator 9, token counts by a count-only Viterbi search over a unigram vocabulary.

An Aho-Corasick automaton of the vocabulary gives all pieces that end at each character of a word. Dynamic programming
carries the best score and its number of pieces, no path. The rules are those of unigram tokenizers: words begin with the
word mark; a character that no piece of one character matches may be skipped as unknown at the worst score less a
penalty; of equal scores the path whose last piece begins first is kept; an unknown character counts as its UTF-8 bytes
(byte fallback). Texts are cut before each run of spaces, which pieces of several marks may match; no piece spans two
such chunks, so a chunk's result is found once per cached chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tsveil.llm.base import CACHE_WORDS, map_batches
from tsveil.llm.pieces import MARK, UNKNOWN_PENALTY, VOCABULARY, automaton, chunks, read_pieces


class Counter(dict):
    """chunk -> (best score, pieces); starts anew when full."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.matches = automaton([(p, s) for p, s in pieces]).iter
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        if any(MARK in p.lstrip(MARK) for p, _ in pieces):
            raise ValueError("a piece holds the mark behind another character, so texts can't be cut at marks")
        self.single = {p for p, _ in pieces if len(p) == 1}

    def __missing__(self, chunk: str) -> tuple[float, int]:
        if len(self) >= CACHE_WORDS:
            self.clear()
        word, n = chunk, len(chunk)
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        first = [n] * (n + 1)  # where the kept last piece begins; n: none yet
        at, single, unknown = 1, self.single, self.unknown

        def skip(end: int) -> None:
            # characters up to end whose only one-character step is "unknown": it loses ties, as it begins last
            nonlocal at
            while at <= end:
                c = word[at - 1]
                if c not in single and (first[at] == n or score[at - 1] + unknown > score[at]):
                    score[at], count[at], first[at] = score[at - 1] + unknown, count[at - 1] + len(c.encode()), at - 1
                at += 1

        for last, (size, value) in self.matches(word):
            end = last + 1
            if end > at:
                skip(end - 1)
            start = end - size
            s = score[start] + value
            if first[end] == n or s > score[end] or (s == score[end] and start < first[end]):
                score[end], count[end], first[end] = s, count[start] + 1, start
        skip(n)
        self[chunk] = found = (score[n], count[n])
        return found


SCHEMA = "n_tokens long, n_words long, score double"


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | list[tuple[str, float]] = VOCABULARY) -> DataFrame:
    """One row per row of df: id_col, n_tokens, n_words (runs of spaces with the word behind them), score (of the best segmentation).

    A null or empty text has 0 tokens, 0 words and score 0. Texts are read whole; repeated rows give repeated rows, an
    empty table an empty result. Other columns aren't read. The vocabulary is a file on the driver or (piece, score)
    pairs; it is sent to the executors once.
    """
    pieces = df.sparkSession.sparkContext.broadcast(read_pieces(vocabulary) if isinstance(vocabulary, str) else vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(pieces.value)
        for b in batches:
            tokens, words, scores = [], [], []
            for text in b.column(1).to_pylist():
                found = list(map(counter.__getitem__, chunks(text or "")))
                tokens.append(sum(f[1] for f in found))
                words.append(len(found))
                scores.append(sum(f[0] for f in found) if found else 0.0)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(tokens, pa.int64()), pa.array(words, pa.int64()), pa.array(scores, pa.float64())],
                names=[id_col, "n_tokens", "n_words", "score"],
            )

    return map_batches(df.select(id_col, text_col), run, f"`{id_col}` {dict(df.dtypes)[id_col]}, {SCHEMA}")
