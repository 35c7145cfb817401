"""Operator 5, language-model scoring by the likelihood of a subword lattice.

An existing vocabulary scores its pieces. The lattice of a word has an edge for every piece that matches a span of it;
the sum over all paths of the products of the pieces' weights is the word's marginal probability, found by a forward
recursion in log space, with no segmentation chosen. Pieces that begin with the word mark end the word before them, so
these probabilities sum to one over all words.

What the corpus adds: the vocabulary's scores are turned into weights, and EM_STEPS steps of expectation maximisation
over all distinct training words (forward and backward recursion) fit these weights to each class of training documents
(their label; the vocabulary itself never changes). A counted word is one more piece of the lattice, which spans it
whole. Its weight is its discounted count plus, by corpus frequency, half of what the discount took off; the other
half is spread over the paths of vocabulary pieces. A document's probability is the sum over the classes of the class's
share times the product of these marginals over the document's words and its end, so no label of a scored document is used.

Words are counted and scored once per distinct word, in a table spread over the cluster. The TOP_WORDS most frequent of
them are sent to all executors (a fixed bound); a document's other words meet the table in one shuffled join.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsveil.llm.base import Workspace, map_batches, utf8
from tsveil.llm.langid import held_out
from tsveil.llm.pieces import MARK, VOCABULARY, read_pieces, zipf_constant

FOLDS, FOLD = 7, 2
TOP_WORDS = 150_000
#: Words of a vectorised step, and distinct words that a counting task holds before it passes them on.
WORD_BATCH, HELD_WORDS = 40_000, 300_000
#: A vocabulary of ranks: weight of rank r is 1 / (r + ZIPF_SHIFT), normalised. Uses that the prior stands for, and fitting steps.
ZIPF_SHIFT, PRIOR_ROWS, EM_STEPS = 2.7, 100.0, 2
#: Share of the weight that covers characters outside the vocabulary, even over 256 byte values.
UNKNOWN_SHARE = 1e-6
NO_PATH = -1e300
#: The mark of a word's start as one byte that UTF-8 never has.
START = b"\xff"
LN10 = math.log(10)


def prior_weights(pieces: list[tuple[str, float]]) -> tuple[list[bytes], np.ndarray]:
    """Pieces as bytes, and the natural logarithms of their weights, which sum to 1 - UNKNOWN_SHARE.

    Scores that are all integers are ranks (0 or negative, as merge-based vocabularies have); others are log
    probabilities. Control pieces (<...>), pieces that hold the mark after their start, and unusably low scores are left out.
    """
    used = [(p, s) for p, s in pieces if p and MARK not in p[1:] and not (p[0] == "<" and p[-1] == ">" and len(p) > 2) and s > -1e8]
    scores = np.array([s for _, s in used])
    if len(used) and np.all(scores == np.round(scores)):
        logs = -np.log(ZIPF_SHIFT - np.minimum(scores, 0)) - zipf_constant(len(used), ZIPF_SHIFT)
    else:
        logs = scores
    top = logs.max(initial=0.0)
    logs = logs - top - np.log(np.exp(logs - top).sum()) + math.log1p(-UNKNOWN_SHARE) if len(used) else logs
    return [p.replace(MARK, START.decode("latin1"), 1).encode("latin1") if p == MARK else START + p[1:].encode() if p[0] == MARK else p.encode() for p, _ in used], logs


class Lattice:
    """Matches of a vocabulary in many words at once: a hash table of all prefixes of the pieces."""

    BASE = np.uint64(0x100000001B3)
    SPREAD = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pieces: list[bytes]):
        ids: dict[int, int] = {}
        for k, piece in enumerate(pieces):
            h = 0
            for i, c in enumerate(piece):
                h = (h * int(self.BASE) + c + 1) & (1 << 64) - 1
                ids[h] = k if i == len(piece) - 1 else ids.get(h, -1)
        self.longest = max(map(len, pieces), default=1)
        self.bits = max(4, (4 * len(ids)).bit_length())
        self.keys, self.ids = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -2, np.int32)
        for h, k in ids.items():
            at = (h * int(self.SPREAD) & (1 << 64) - 1) >> 64 - self.bits
            while self.ids[at] != -2:
                at = (at + 1) & (1 << self.bits) - 1
            self.keys[at], self.ids[at] = h, k

    def find(self, h: np.ndarray) -> np.ndarray:
        """-2: no piece begins so; -1: only a beginning; else the piece."""
        at = ((h * self.SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)
        out = self.ids[at]
        miss = np.flatnonzero((out != -2) & (self.keys[at] != h))
        while len(miss):
            at[miss] = (at[miss] + 1) & (1 << self.bits) - 1
            out[miss] = self.ids[at[miss]]
            miss = miss[(out[miss] != -2) & (self.keys[at[miss]] != h[miss])]
        return out

    def edges(self, words: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, rows, pieces or -bytes of an unknown character) of words (rows, length) by ascending start."""
        n, m = words.shape
        lead = words.astype(np.int16)
        width = np.where(
            lead < 0x80,
            1,
            np.where(lead < 0xC0, 0, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, np.where(lead < 0xF8, 4, 1)))),
        )
        for s in range(m):
            rows = np.flatnonzero(width[:, s])
            if not len(rows):
                continue
            known = np.zeros(n, bool)
            alive, h = rows, np.zeros(len(rows), np.uint64)
            for e in range(s + 1, min(m, s + self.longest) + 1):
                h = h * self.BASE + words[alive, e - 1].astype(np.uint64) + np.uint64(1)
                found = self.find(h)
                hit = found >= 0
                if hit.any():
                    yield s, e, alive[hit], found[hit]
                    known[alive[hit & (width[alive, s] == e - s)]] = True
                go = found != -2
                alive, h = alive[go], h[go]
                if not len(alive):
                    break
            lost = rows[~known[rows]]
            for w in range(1, 5) if len(lost) else ():
                some = lost[width[lost, s] == w]
                if len(some):
                    yield s, min(m, s + w), some, np.full(len(some), -w)


def by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(their places, the words with the mark as a matrix of bytes) for each length."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    for some in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
        if len(some):
            yield some, np.frombuffer(b"".join([START + words[i] for i in some]), np.uint8).reshape(len(some), -1)


def forward(lattice: Lattice, weights: np.ndarray, words: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Log marginals (length + 1, rows, classes) of all beginnings of words; weights: (pieces, classes), natural logs."""
    unknown = math.log(UNKNOWN_SHARE / 256)
    f = np.full((words.shape[1] + 1, len(words), weights.shape[1]), NO_PATH)
    f[0] = 0
    for s, e, rows, piece in lattice.edges(words):
        w = weights[piece] if piece[0] >= 0 else np.broadcast_to((-piece * unknown)[:, None], (len(rows), weights.shape[1]))
        f[e, rows] = np.logaddexp(f[e, rows], f[s, rows] + w)
        if keep is not None:
            keep.append((s, e, rows, piece, w))
    return f


def marginals(lattice: Lattice, weights: np.ndarray, words: list[bytes]) -> np.ndarray:
    """(words, classes): natural log of the sum over all segmentations of each word."""
    out = np.zeros((len(words), weights.shape[1]))
    for places, matrix in by_length(words):
        out[places] = forward(lattice, weights, matrix)[-1]
    return out


def expected(lattice: Lattice, weights: np.ndarray, words: list[bytes]) -> np.ndarray:
    """Expected uses of each piece over all segmentations of the words, by one set of weights (pieces)."""
    out = np.zeros(len(weights))
    for _, matrix in by_length(words):
        edges: list = []
        f = forward(lattice, weights[:, None], matrix, edges)[..., 0]
        b = np.full(f.shape, NO_PATH)
        b[-1] = 0
        for s, e, rows, piece, w in reversed(edges):
            down = b[e, rows] + w[:, 0]
            b[s, rows] = np.logaddexp(b[s, rows], down)
            if piece[0] >= 0:
                out += np.bincount(piece, np.exp(np.minimum(0, f[s, rows] + down - f[-1, rows])), len(out))
    return out


def fitted_weights(prior: np.ndarray, uses: np.ndarray) -> np.ndarray:
    """(pieces, classes): uses plus PRIOR_ROWS by the prior, normalised to 1 - UNKNOWN_SHARE in each class; natural logs."""
    rows = uses + PRIOR_ROWS * np.exp(prior)[:, None]
    return np.log(rows) - np.log(rows.sum(axis=0)) + math.log1p(-UNKNOWN_SHARE)


class Totals:
    """Corpus-wide numbers: of each class its training documents, words and distinct words, and of all the count-of-counts discount."""

    def __init__(self, docs: list[int], words: list[int], types: list[int], known_types: int, ones: int, twos: int):
        self.docs, self.words, self.types, self.known_types = docs, words, types, known_types
        self.tokens = sum(words) + sum(docs)  # N
        self.distinct = known_types + (sum(docs) > 0)  # V
        self.discount = ones / (ones + 2 * twos) if ones else 0.5

    def share(self) -> np.ndarray:
        d = np.array(self.docs, float)
        return np.log10((d + 1) / (d + 1).sum())

    def base(self, count):
        return np.log10((count + 1) / (self.tokens + self.distinct + 1))

    def word(self, counts: np.ndarray, lattice: np.ndarray) -> np.ndarray:
        """log10 marginals (words, classes) of words by their counts per class and the natural logs of their vocabulary paths' sum.

        What the discount takes off goes half to the whole words by corpus frequency, which sums to one if any word was counted, and half to the paths.
        """
        n, t = np.array(self.words, float), np.array(self.types, float)
        every = counts.sum(axis=1, keepdims=True) / max(1, sum(self.words))
        half = 0.5 if sum(self.words) else 0.0
        top = np.maximum(counts - self.discount, 0) + (self.discount * t + 1) * half * every
        rest = np.log10((self.discount * t + 1) * (1 - half)) + lattice / LN10
        with np.errstate(divide="ignore"):
            joint = np.logaddexp(np.log(top), rest * LN10) / LN10
        return joint - np.log10(n + np.array(self.docs) + 2)

    def end(self) -> np.ndarray:
        return np.log10((np.array(self.docs, float) + 1) / (np.array(self.words) + np.array(self.docs) + 2))


SCHEMA = "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", class_col: str | None = "lang", vocabulary: str | list[tuple[str, float]] = VOCABULARY) -> DataFrame:
    """One row per row of df: id_col and the columns of SCHEMA.

    Trains on the rows whose id is in none of the held-out folds, of any label; labels are only used to group training
    rows into classes (null: one more class), and time grows with their number. A null or empty text is its end
    alone. Scores are rounded to 6 places, beyond which sums depend on their order. Texts are read whole; repeated rows each count and each get a row; an empty table gives an empty result.
    Other columns aren't read.
    """
    spark = df.sparkSession
    space = Workspace(spark, "lm")
    own = df.select(
        F.col(id_col).alias("id"),
        F.col(text_col).alias("text"),
        (F.col(class_col).cast("string") if class_col else F.lit(None).cast("string")).alias("class"),
        held_out(F.col(id_col), FOLDS, FOLD).alias("held"),
    )
    names = [r[0] for r in own.where("not held and class is not null").select("class").distinct().orderBy("class").collect()]
    kind = F.lit(len(names))
    if names:
        known = F.create_map(*(x for k, name in enumerate(names) for x in (F.lit(name), F.lit(k))))
        kind = F.coalesce(F.element_at(known, F.col("class")), kind)
    own = own.select("id", "text", "held", F.when(F.col("held"), F.lit(-1)).otherwise(kind).cast("int").alias("kind"))
    n_classes = len(names) + 1
    columns = [f"n{k}" for k in range(n_classes)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = [Counter() for _ in range(n_classes + 1)]

        def flush() -> pa.RecordBatch:
            words = list(set().union(*counters))
            out = pa.RecordBatch.from_arrays(
                [pa.array(words, pa.binary()), *(pa.array([c[w] for w in words], pa.int64()) for c in counters[:n_classes])],
                names=["word", *columns],
            )
            for c in counters:
                c.clear()
            return out

        for b in batches:
            for text, k in zip(utf8(b.column(0)), b.column(1).to_pylist(), strict=True):
                if text:
                    counters[k].update(text.lower().split())
            if sum(map(len, counters)) >= HELD_WORDS:
                yield flush()
        yield flush()

    counted = own.select("text", "kind").transform(map_batches, count, "word binary, " + ", ".join(f"{c} long" for c in columns))
    table = space.save(counted.groupBy("word").agg(*(F.sum(c).alias(c) for c in columns)), "words")
    every = sum((F.col(c) for c in columns), F.lit(0))
    docs = {r[0]: r[1] for r in own.where("kind >= 0").groupBy("kind").count().collect()}
    sums = table.agg(
        *(F.sum(c) for c in columns),
        *(F.count_if(F.col(c) > 0) for c in columns),
        F.count_if(every > 0),
        F.count_if(every == 1),
        F.count_if(every == 2),
    ).first()
    sums = [int(x or 0) for x in sums]
    totals = Totals([docs.get(k, 0) for k in range(n_classes)], sums[:n_classes], sums[n_classes : 2 * n_classes], *sums[2 * n_classes :])

    pieces, prior = prior_weights(read_pieces(vocabulary) if isinstance(vocabulary, str) else vocabulary)

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], np.ndarray]]:
        words, counts = [], []
        for b in batches:
            words += b.column(0).to_pylist()
            counts.append(np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns[1:]], axis=1))
            if len(words) >= WORD_BATCH:
                yield words, np.concatenate(counts)
                words, counts = [], []
        if words:
            yield words, np.concatenate(counts)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, weights = model.value
        lattice, uses = Lattice(pieces), np.zeros((len(pieces), n_classes))
        for words, counts in gathered(batches):
            for k in range(n_classes):
                uses[:, k] += expected(lattice, weights[:, k], [words[i] for i in np.flatnonzero(counts[:, k])])
        at = np.argwhere(uses > 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at[:, 0], pa.int32()), pa.array(at[:, 1], pa.int32()), pa.array(uses[at[:, 0], at[:, 1]])],
            names=["piece", "kind", "uses"],
        )

    model = spark.sparkContext.broadcast((pieces, np.repeat(prior[:, None], n_classes, axis=1)))
    for _ in range(EM_STEPS):
        uses = np.zeros((len(pieces), n_classes))
        found = (
            table.where(every > 0)
            .transform(map_batches, fit, "piece int, kind int, uses double")
            .groupBy("piece", "kind")
            .agg(F.sum("uses").alias("uses"))
            .toArrow()
        )
        uses[found["piece"].to_numpy(), found["kind"].to_numpy()] = found["uses"].to_numpy()
        model = spark.sparkContext.broadcast((pieces, fitted_weights(prior, uses)))
    logs = [f"p{k}" for k in range(n_classes)]

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, weights = model.value
        lattice = Lattice(pieces)
        for words, counts in gathered(batches):
            p = totals.word(counts, marginals(lattice, weights, words))
            c = counts.sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(words, pa.binary()),
                    pa.array(c),
                    pa.array(totals.base(c)),
                    *(pa.array(np.ascontiguousarray(p[:, k])) for k in range(n_classes)),
                ],
                names=["word", "c", "base", *logs],
            )

    rated = space.save(map_batches(table, rate, "word binary, c long, base double, " + ", ".join(f"{c} double" for c in logs)), "rated")
    space.drop("words")
    top = rated.orderBy(F.desc("c"), "word").limit(TOP_WORDS).toArrow()
    sent_top = spark.sparkContext.broadcast(
        (
            [] if not top.num_rows else top["word"].to_pylist(),
            np.stack([(top["c"].to_numpy() > 0).astype(float), *(top[c].to_numpy() for c in ["base", *logs])], axis=1),
        )
    )
    width = n_classes + 2

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, values = sent_top.value
        place = {w: i for i, w in enumerate(words)}
        values = np.concatenate([values, np.zeros((1, width))])
        missing, row = len(words), TaskContext.get().partitionId() << 36
        for b in batches:
            split = [t.lower().split() if t else [] for t in utf8(b.column(1))]
            sizes = np.fromiter(map(len, split), np.int64, len(split))
            ends = np.cumsum(sizes)
            sums = np.zeros((len(split), width))
            keys, rows, rare, times = [], [], [], []
            for i, found in enumerate(split):
                key = row + i
                if found:
                    at = np.array([place.get(w, missing) for w in found])
                    sums[i] = values[at].sum(axis=0)
                    for w, n in Counter([found[j] for j in np.flatnonzero(at == missing)]).items():
                        keys.append(key)
                        rare.append(w)
                        times.append(n)
            own = np.arange(row, row + len(split))
            row += len(split)
            # a document's own row has a key that is no word, as it holds a space: it meets nothing in the table
            rare_rows = len(rare)
            out = [
                pa.concat_arrays([pa.array(own), pa.array(keys, pa.int64())]),
                pa.concat_arrays([pa.array([b" %d" % k for k in own], pa.binary()), pa.array(rare, pa.binary())]),
                pa.concat_arrays([pa.array(np.ones(len(own), np.int64)), pa.array(times, pa.int64())]),
            ]
            out.append(pa.concat_arrays([b.column(0), pa.nulls(rare_rows, b.column(0).type)]))
            out.append(pa.concat_arrays([b.column(2), pa.nulls(rare_rows, pa.bool_())]))
            out.append(pa.concat_arrays([pa.array(sizes + 1), pa.nulls(rare_rows, pa.int64())]))
            out += [pa.concat_arrays([pa.array(np.ascontiguousarray(sums[:, k])), pa.nulls(rare_rows, pa.float64())]) for k in range(width)]
            yield pa.RecordBatch.from_arrays(out, names=fields)

    fields = ["row", "word", "times", "id", "held", "n_tokens", *(f"s{k}" for k in range(width))]
    id_kind = dict(df.dtypes)[id_col]
    parts = map_batches(
        own.select("id", "text", "held"),
        add,
        f"row long, word binary, times long, id {id_kind}, held boolean, n_tokens long, " + ", ".join(f"s{k} double" for k in range(width)),
    )
    joined = parts.join(rated.withColumnRenamed("word", "__word"), F.col("word") == F.col("__word"), "left")
    weigh = [
        F.sum(F.coalesce(F.col(f"s{k}"), F.col("times") * c)) for k, c in enumerate(
            [(F.col("c") > 0).cast("double"), F.col("base"), *map(F.col, logs)]
        )
    ]
    summed = joined.groupBy("row").agg(
        F.max("id").alias("id"),
        F.max("held").alias("held"),
        F.max("n_tokens").alias("n_tokens"),
        *(w.alias(f"s{k}") for k, w in enumerate(weigh)),
    )
    each = [
        F.col(f"s{k + 2}") + F.lit(float(e)) + F.lit(float(s)) for k, (e, s) in enumerate(zip(totals.end(), totals.share(), strict=True))
    ]
    best = F.greatest(*each) if len(each) > 1 else each[0]
    known_end, end_base = int(sum(totals.docs) > 0), float(totals.base(sum(totals.docs)))
    return summed.select(
        F.col("id").alias(id_col),
        F.col("held").alias("held_out"),
        "n_tokens",
        (F.round("s0").cast("long") + known_end).alias("n_known"),
        F.lit(totals.tokens).cast("long").alias("train_tokens"),
        F.round(F.col("s1") + end_base, 6).alias("base_score"),
        F.round(best + F.log10(sum((F.pow(F.lit(10.0), e - best) for e in each), F.lit(0.0))), 6).alias("score"),
    )
