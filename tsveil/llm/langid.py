"""Operator 3, language identification by cross-parsing.

For each language a suffix automaton holds a running labelled text. A document is parsed greedily against it: each
phrase is the longest match that begins where the last one ended (a character that the language's text lacks is a
phrase of its own). Phrases run across words. A phrase costs a pointer into the language's text, log2 of its length in
bits, so bits per character estimate the cross entropy; the language of the fewest bits wins.

Texts are read as their letters in lower case, words apart by one space; a letter is what str.isalpha() says, and marks
that combine with letters stay. The automata are fitted on a bounded sample of the labelled rows: SAMPLE_ROWS rows of
each language in the order of a hash of their id, of which each is used that still fits in SAMPLE_CHARS characters; of
a language whose texts are all longer, the beginning of one. No phrase spans two sampled texts. Every label is learned,
and all rows are then classified, whole.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tsveil.llm.base import map_batches

SAMPLE_ROWS = 200
SAMPLE_CHARS = 40_000
UNDETERMINED = "und"
#: Bits a character beyond those of evenly drawn letters with which a text still counts as one of a language.
SLACK_BITS = 2.5
#: Cells up to which an automaton is also a table; characters that texts are stepped through together, and least number of such texts.
TABLE_CELLS, STRETCH, TOGETHER = 4_000_000, 256, 64
#: Between sampled texts; no parsed text has it.
END = "\n"


class Letters(dict):
    """For str.translate: letters and combining marks stay, all else is a space."""

    def __missing__(self, code: int) -> int:
        c = chr(code)
        self[code] = kept = code if c.isalpha() or unicodedata.category(c)[0] == "M" else 32
        return kept


LETTERS = Letters()


def running(text: str | None) -> str:
    """The text's words of letters in lower case, with a space around each; empty without a letter."""
    found = text.lower().translate(LETTERS).split() if text else []
    return f" {' '.join(found)} " if any(c.isalpha() for w in found for c in w) else ""


class SuffixAutomaton:
    """All substrings of a text. A state is a map from a character to the next state; states[0] is nowhere, states[1] the start."""

    def __init__(self, text: str):
        start: dict[str, dict] = {}
        self.size = len(text)
        self.states = states = [{}, start]
        link, size, last = [0, 0], [0, 0], 1
        at = {id(start): 1}
        for c in text:
            new, made = len(states), {}
            states.append(made)
            at[id(made)] = new
            size.append(size[last] + 1)
            link.append(1)
            p = last
            while p and c not in states[p]:
                states[p][c] = made
                p = link[p]
            if p:
                q = at[id(states[p][c])]
                if size[p] + 1 == size[q]:
                    link[new] = q
                else:
                    copy, copied = len(states), dict(states[q])
                    states.append(copied)
                    at[id(copied)] = copy
                    size.append(size[p] + 1)
                    link.append(link[q])
                    while p and states[p].get(c) is states[q]:
                        states[p][c] = copied
                        p = link[p]
                    link[q] = link[new] = copy
            last = new
        letters = sorted(start)
        self.alphabet = len(letters)
        # the same as a table, by state and character: 0 is no step, and no character of the text
        self.codes = np.zeros(0x110000, np.uint16 if len(letters) < 1 << 16 else np.int32)
        self.codes[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.table = None
        if len(states) * (len(letters) + 1) <= TABLE_CELLS:
            number = {c: k for k, c in enumerate(letters, 1)}
            self.table = np.zeros((len(states), len(letters) + 1), np.int32)
            for k, steps in enumerate(states):
                for c, to in steps.items():
                    self.table[k, number[c]] = at[id(to)]

    def phrases(self, text: str, state: int = 0) -> int:
        """Phrases of the greedy parse of a text that begin in it, from a state."""
        start, nowhere, now, count = self.states[1], self.states[0], self.states[state], 0
        for c in text:
            now = now.get(c)
            if now is None:
                # c begins a phrase, which ends with it if the text lacks c
                count += 1
                now = start.get(c, nowhere)
        return count

    def phrases_of(self, texts: list[str]) -> np.ndarray:
        """phrases() of each text: all texts at once, one character of each a step, as long as TOGETHER texts go on."""
        if self.table is None:
            return np.array([self.phrases(t) for t in texts], np.int64)
        lengths = np.array([len(t) for t in texts])
        order = np.argsort(-lengths, kind="stable")
        sorted_lengths, points = lengths[order], [np.frombuffer(texts[i].encode("utf-32-le", "surrogatepass"), np.uint32) for i in order]
        counts, states, table, first = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), self.table.reshape(-1), self.table[1]
        width, p = self.table.shape[1], 0
        while (active := int(np.searchsorted(-sorted_lengths, -p, "left"))) >= TOGETHER:
            ends = np.minimum(sorted_lengths[:active] - p, STRETCH)
            chars = np.zeros((active, STRETCH), np.uint32)
            for k in range(active):
                chars[k, : ends[k]] = points[k][p : p + ends[k]]
            codes = np.ascontiguousarray(self.codes[chars].T).astype(np.int64)
            for j in range(int(ends[0])):
                n = int(np.searchsorted(-ends, -j, "left"))
                c = codes[j, :n]
                to = table[states[:n] * width + c]
                begun = to == 0
                counts[:n] += begun
                states[:n] = np.where(begun, first[c], to)
            p += STRETCH
        for k in range(active):
            counts[k] += self.phrases(texts[order[k]][p:], int(states[k]))
        out = np.empty(len(texts), np.int64)
        out[order] = counts
        return out


class Classifier:
    """Cross-parses texts against the running text of each language."""

    def __init__(self, texts: list[tuple[str, str]]):
        self.languages = [name for name, _ in texts]
        self.automata = [SuffixAutomaton(text) for _, text in texts]
        self.bits = [math.log2(max(2, a.size)) for a in self.automata]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text: how far the second language's bits exceed the first's, from 0 to 1; (UNDETERMINED, 0) without letters."""
        found = [running(t) for t in texts]
        out = [(UNDETERMINED, 0.0)] * len(texts)
        at = [i for i, x in enumerate(found) if x]
        if not at or not self.languages:
            return out
        parsed = [found[i] for i in at]
        costs = np.stack([a.phrases_of(parsed) * b for a, b in zip(self.automata, self.bits, strict=True)], axis=1)
        for i, cost in zip(at, costs.tolist(), strict=True):
            first, *more = sorted(cost)
            out[i] = self.languages[cost.index(first)], (more[0] - first) / more[0] if more else 1.0
        return out

    def told(self, texts: list[str | None]) -> list[bool]:
        """Whether each text is in a learned language: it has a letter, and some language's phrases code it with at most
        SLACK_BITS more bits a character than letters drawn evenly from that language's alphabet need. The phrase that the
        text's end cuts off isn't counted. A text is parsed until a language tells it."""
        found = [running(t) for t in texts]
        out = [bool(x) and not self.languages for x in found]
        left = [i for i, x in enumerate(found) if x]
        for a, b in zip(self.automata, self.bits, strict=True):
            phrases = a.phrases_of([found[i] for i in left]) if left else []
            for i, n in zip(left, phrases, strict=True):
                out[i] = bool((n - 1) * b <= len(found[i]) * (math.log2(max(2, a.alphabet)) + SLACK_BITS))
            left = [i for i in left if not out[i]]
        return out


def held_out(key: Column, of: int = 4, fold: int = 2) -> Column:
    """Whether crc32(key as text) mod `of` is `fold`; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(of)) == fold


def training_texts(df: DataFrame, text_col: str, lang_col: str, id_col: str, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> list[tuple[str, str]]:
    """(language, its text for the automaton) of the bounded sample of df's labelled rows; most frequent language first."""
    own = df.select(
        F.col(id_col).alias("__id"),
        F.col(text_col).alias("__text"),
        F.col(lang_col).alias("__lang"),
    ).where("__lang is not null and __text is not null")
    known = [r[0] for r in own.groupBy("__lang").count().orderBy(F.desc("count"), "__lang").collect()]
    digest = F.xxhash64("__id", "__text")
    order = W.partitionBy("__lang").orderBy(F.col("__n") > chars, F.xxhash64("__id"), "__id", "__hash")
    drawn_from = own.select("__id", "__lang", F.length("__text").alias("__n"), digest.alias("__hash")).where("__n > 0")
    drawn = drawn_from.withColumn("__at", F.row_number().over(order)).where(F.col("__at") <= rows).collect()
    left, chosen = dict.fromkeys(known, chars), []
    for r in sorted(drawn, key=lambda r: (r["__lang"], r["__at"])):
        # a longer text only if nothing fits: its first characters
        n = min(r["__n"], chars)
        if n <= left[r["__lang"]]:
            left[r["__lang"]] -= n
            chosen.append((r["__id"], r["__lang"], r["__hash"]))
    learned: dict[str, list[str]] = {k: [] for k in known}
    if chosen:
        picked = F.broadcast(df.sparkSession.createDataFrame(chosen, drawn_from.select("__id", "__lang", "__hash").schema))
        texts = (
            own.withColumn("__hash", digest)
            .join(picked, ["__id", "__lang", "__hash"], "left_semi")
            .dropDuplicates(["__id", "__lang", "__hash"])
        )
        for r in texts.select("__id", "__lang", F.substring("__text", 1, chars).alias("__text")).orderBy("__id", "__text").collect():
            learned[r["__lang"]].append(running(r["__text"]))
    return [(k, END.join(v)) for k, v in learned.items() if any(v)]


def identify(df: DataFrame, texts: list[tuple[str, str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id_col, lang_pred, score, by automata of the given (language, text) pairs.

    A null text or one without a letter gives UNDETERMINED and score 0, as does an empty list of languages. Ties go to
    the language that comes first in `texts`. Texts are read whole; repeated rows give repeated rows, an empty table an
    empty result. Other columns aren't read.
    """
    model = df.sparkSession.sparkContext.broadcast(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(model.value)
        for b in batches:
            found = classifier.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=[id_col, "lang_pred", "score"],
            )

    return map_batches(df.select(id_col, text_col), run, f"`{id_col}` {dict(df.dtypes)[id_col]}, lang_pred string, score double")


def identify_held_out(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """identify() for all rows of df, fitted on its rows that aren't held out; adds held_out. Null labels aren't learned from."""
    texts = training_texts(df.where(~held_out(F.col(id_col))), text_col, lang_col, id_col)
    return identify(df, texts, id_col, text_col).select(id_col, held_out(F.col(id_col)).alias("held_out"), "lang_pred", "score")


def keep_identified(df: DataFrame, texts: list[tuple[str, str]], text_col: str = "text") -> DataFrame:
    """The rows of df, all columns unchanged, whose text is in one of the given languages; see Classifier.told().

    A null text or one without a letter goes. With no language given, texts with a letter stay.
    """
    model = df.sparkSession.sparkContext.broadcast(texts)
    schema = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(model.value)
        for b in batches:
            yield b.filter(pa.array(classifier.told(b.column(at).to_pylist()), pa.bool_()))

    at = df.columns.index(text_col)
    return map_batches(df, run, schema)
