"""An existing subword vocabulary with scores, read from a sentencepiece model file, and its matches in words."""

from __future__ import annotations

import math
import re
from functools import lru_cache

import ahocorasick

#: The public vocabulary that the registered queries use; a parameter of every operator that takes pieces.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Fixed values of unigram tokenizers: the mark of a word's start, and by how much an unknown character is worse than the worst piece.
MARK = "▁"
UNKNOWN_PENALTY = 10.0


def read_pieces(path: str = VOCABULARY) -> list[tuple[str, float]]:
    """(piece, score) in the order of their ids, read on the driver; a vocabulary has a bounded size, so it is sent whole."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


def automaton(pieces: list[tuple[str, object]]) -> ahocorasick.Automaton:
    """piece -> (its characters, value). A piece given twice keeps its last value."""
    found = ahocorasick.Automaton()
    for piece, value in pieces:
        if piece:
            found.add_word(piece, (len(piece), value))
    found.make_automaton()
    return found


#: A run of marks and the word behind it.
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")


def chunks(text: str) -> list[str]:
    """The text with marks for spaces and one in front, if it has none there, cut before each run of marks: "a  b" gives _a, __b.

    The empty text has none. Where no piece holds a mark behind another character, no piece spans two chunks.
    """
    if not text:
        return []
    marked = text.replace(" ", MARK)
    return CHUNK.findall(marked if marked[0] == MARK else MARK + marked)


@lru_cache(maxsize=4)
def zipf_constant(n: int, shift: float = 2.7) -> float:
    return math.log(sum(1 / (r + shift) for r in range(1, n + 1)))
