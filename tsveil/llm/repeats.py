"""Operator 10, substring dedup by seed and extend.

Seeds are winnowed anchors: of every window of `length` words its run of ANCHOR_WORDS words of least hash. The choice
looks at nothing but the window, so equal windows have equal anchors at equal places. Documents are joined on anchors; an
anchor that occurs once can't lie in a repeat. From each repeated anchor the match is extended both ways as far as windows
keep it as their anchor, which gives the anchor's context, a span of up to 2 * length - ANCHOR_WORDS words.

Equal contexts are matched first, as wholes, by a 128-bit hash: all windows of a context but its earliest occurrence are
repeats. Only where an anchor has several different contexts are the windows of their earliest occurrences compared one
by one. Of equal windows the earliest (least document, then least start) is kept. Repeated windows that overlap or touch
merge into the maximal repeated spans of a document.

Documents whose whole text occurs in an earlier document are settled by a hash of the text, without anchors. Hot anchors,
contexts and windows are reduced before they are shuffled (map-side), and met again through joins on unique keys, which
adaptive execution can split.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsveil.llm.base import BROADCAST_ROWS, Powers, Words, Workspace, carried, grams, keyed, map_batches, mix, signed, small, utf8

LENGTH = 20
ANCHOR_WORDS = 8
#: Numbers in a table of lists up to which it is broadcast.
BROADCAST_PLACES = 12_000_000
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Multipliers of the two hashes of a span, odd.
BASES = (0xD6E8FEB86659FD93, 0xA24BAED4963EE407)


def anchor_of_windows(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` consecutive hashes the place of its least one, the first of equal ones."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at, size = np.arange(len(h)), 1
    while size * 2 <= width:
        a, b = at[:-size], at[size:]
        at, size = np.where(h[b] < h[a], b, a), size * 2
    a, b = at[:n], at[width - size : width - size + n]
    return np.where(h[b] < h[a], b, a)


class SpanHash:
    """Two independent 64-bit hashes of spans of a document's words."""

    def __init__(self):
        self.powers = [Powers(base) for base in BASES]

    def of(self, h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """Hashes of words starts[i] to ends[i] - 1."""
        size = (ends - starts).astype(np.uint64)
        return [mix(p.spans(mix(h + p.base), starts, ends) + size) for p in self.powers]


#: A run of windows as one number: first start * RUN + further windows.
RUN = 64


def covered(runs: np.ndarray, words: int, length: int) -> np.ndarray:
    """Which of the words lie in a window of the runs."""
    edge = np.zeros(words + 1, np.int64)
    np.add.at(edge, runs // RUN, 1)
    np.add.at(edge, np.minimum(runs // RUN + runs % RUN + length, words), -1)
    return np.cumsum(edge[:-1]) > 0


def repeated_runs(df: DataFrame, space: Workspace, id_col: str, text_col: str, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """(df's id, text, key, copy; (__key, __id, runs) of documents with repeats).

    key names a text with its id; copy: the whole text occurs in an earlier document. runs: the repeated windows of
    documents that are no copies.
    """
    if not ANCHOR_WORDS < length < ANCHOR_WORDS + RUN:
        raise ValueError(f"length must be from {ANCHOR_WORDS + 1} to {ANCHOR_WORDS + RUN - 1} words")
    id_kind = dict(df.dtypes)[id_col]
    own = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    digest = F.md5(F.col("text").cast("binary"))
    texts = (
        own.where("text is not null")
        .select("id", digest.alias("digest"))
        .groupBy("digest")
        .agg(F.count("*").alias("n"), F.min("id").alias("first"))
    )
    texts = space.save(
        texts.where("n > 1 and first is not null").select(F.col("digest").alias("__digest"), F.col("first").alias("__first")),
        "texts",
    )
    marked = own.withColumn("key", F.xxhash64("id", "text")).join(small(texts, texts.count()), digest == F.col("__digest"), "left")
    marked = marked.select("id", "text", "key", (F.col("__digest").isNotNull() & ~F.col("id").eqNullSafe(F.col("__first"))).alias("copy"))
    sources = marked.where("not copy and text is not null")
    width = length - ANCHOR_WORDS + 1

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(lower=False)
        for b in batches:
            found, keys, places = [], [], []
            for key, h in zip(b.column(0).to_pylist(), words.of(b.column(1)), strict=True):
                if len(h) >= length:
                    h = grams(h, ANCHOR_WORDS)
                    at = np.unique(anchor_of_windows(h, width))
                    found.append(h[at])
                    keys.append(np.full(len(at), key))
                    places.append(at.astype(np.int32))
            if found:
                yield pa.RecordBatch.from_arrays(
                    [signed(np.concatenate(found)), pa.array(np.concatenate(keys)), pa.array(np.concatenate(places))],
                    names=["anchor", "key", "place"],
                )

    anchors = space.save(map_batches(sources.select("key", "text"), seed, "anchor long, key long, place int"), "anchors")
    shared = space.save(
        anchors.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select(F.col("anchor").alias("__anchor")),
        "shared",
    )
    met = anchors.join(keyed(shared), F.col("anchor") == F.col("__anchor"), "left_semi")
    places = space.save(met.groupBy("key").agg(F.collect_set("place").alias("places")).withColumnRenamed("key", "__key"), "places")
    space.drop("anchors", "shared")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, hasher = Words(lower=False), SpanHash()
        for b in batches:
            out = []
            ends, flat = b.column(3).offsets.to_numpy(), b.column(3).values.to_numpy()
            for i, h in enumerate(words.of(b.column(2))):
                g = grams(h, ANCHOR_WORDS)
                anchor = anchor_of_windows(g, width)
                seeds = np.zeros(len(h) + 1, bool)
                mine = flat[ends[i] : ends[i + 1]]
                seeds[mine[mine < len(h)]] = True
                # windows of one anchor follow each other
                first = np.flatnonzero(np.diff(anchor, prepend=-1))
                last = np.append(first[1:], len(anchor)) - 1
                keep = seeds[anchor[first]] if len(first) else np.zeros(0, bool)
                first, last = first[keep], last[keep]
                if len(first):
                    one, two = hasher.of(h, first, last + length)
                    again = np.ones(len(first), bool)
                    again[np.unique(one, return_index=True)[1]] = False
                    out.append((g[anchor[first]], one, two, np.full(len(first), i), first * RUN + last - first, again))
            if out:
                g, one, two, which, runs, again = (np.concatenate(x) for x in zip(*out, strict=True))
                take = pa.array(which)
                yield pa.RecordBatch.from_arrays(
                    [signed(g), signed(one), signed(two), b.column(0).take(take), b.column(1).take(take), pa.array(runs), pa.array(again)],
                    names=["anchor", "a", "b", "id", "key", "run", "again"],
                )

    seeded = sources.join(few(places, "places"), F.col("key") == F.col("__key")).select("id", "key", "text", "places")
    contexts = space.save(
        map_batches(seeded, extend, f"anchor long, a long, b long, id {id_kind}, key long, run long, again boolean"),
        "contexts",
    )
    space.drop("places")
    own_again = contexts.where("again").select("key", "id", "run")
    contexts = contexts.where("not again")
    earliest = contexts.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.min("anchor").alias("anchor"))
    several = (
        contexts.select("anchor", "a")
        .groupBy("anchor")
        .agg(F.min("a").alias("low"), F.max("a").alias("high"))
        .where("low <> high")
        .select(F.col("anchor").alias("__anchor"), F.lit(True).alias("several"))
    )
    ranked = earliest.join(several, F.col("anchor") == F.col("__anchor"), "left").where("n > 1 or several")
    ranked = ranked.select(F.col("a").alias("__a"), F.col("b").alias("__b"), "least", F.coalesce("several", F.lit(False)).alias("several"))
    later = F.col("least").isNotNull() & ~F.col("id").eqNullSafe(F.col("least"))
    placed = (
        contexts.join(ranked, (F.col("a") == F.col("__a")) & (F.col("b") == F.col("__b")))
        .select("key", "id", "run", later.alias("later"), "several")
        .where("later or several")
    )
    placed = space.save(placed, "placed")
    singles = space.save(
        placed.where("not later").groupBy("key").agg(F.collect_set("run").alias("runs")).withColumnRenamed("key", "__key"),
        "singles",
    )

    def windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, hasher = Words(lower=False), SpanHash()
        for b in batches:
            out = []
            ends, flat = b.column(3).offsets.to_numpy(), b.column(3).values.to_numpy()
            for i, h in enumerate(words.of(b.column(2))):
                runs = np.sort(flat[ends[i] : ends[i + 1]])
                first, more = runs // RUN, runs % RUN
                at = np.repeat(first, more + 1) + np.arange(int((more + 1).sum())) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1)
                at = at[at <= len(h) - length]
                if len(at):
                    one, two = hasher.of(h, at, at + length)
                    again = np.ones(len(at), bool)
                    again[np.unique(one, return_index=True)[1]] = False
                    out.append((one, two, np.full(len(at), i), at * RUN, again))
            if out:
                one, two, which, runs, again = (np.concatenate(x) for x in zip(*out, strict=True))
                take = pa.array(which)
                yield pa.RecordBatch.from_arrays(
                    [signed(one), signed(two), b.column(0).take(take), b.column(1).take(take), pa.array(runs), pa.array(again)],
                    names=["a", "b", "id", "key", "run", "again"],
                )

    seeded = sources.join(few(singles, "runs"), F.col("key") == F.col("__key")).select("id", "key", "text", "runs")
    windows = space.save(map_batches(seeded, windows_of, f"a long, b long, id {id_kind}, key long, run long, again boolean"), "windows")
    least = (
        windows.where("not again")
        .groupBy("a", "b")
        .agg(F.count("*").alias("n"), F.min("id").alias("least"))
        .where("n > 1")
        .select(F.col("a").alias("__a"), F.col("b").alias("__b"), "least")
    )
    repeated = (
        windows.where("not again")
        .join(least, (F.col("a") == F.col("__a")) & (F.col("b") == F.col("__b")))
        .where(later)
        .select("key", "id", "run")
    )
    every = (
        own_again.unionByName(placed.where("later").select("key", "id", "run"))
        .unionByName(windows.where("again").select("key", "id", "run"))
        .unionByName(repeated)
    )
    runs = space.save(
        (
            every.groupBy("key", "id")
            .agg(F.collect_set("run").alias("runs"))
            .select(F.col("key").alias("__key"), F.col("id").alias("__id"), "runs")
        ),
        "runs",
    )
    space.drop("contexts", "placed", "singles", "windows")
    return marked, runs


def few(table: DataFrame, lists: str) -> DataFrame:
    """A saved table of lists with a broadcast hint if it is small, by its rows and by the numbers in its lists."""
    rows, total = table.agg(F.count("*"), F.sum(F.size(lists))).first()
    return small(table, rows if (total or 0) <= BROADCAST_PLACES else BROADCAST_ROWS + 1)


def with_runs(marked: DataFrame, runs: DataFrame) -> DataFrame:
    return marked.join(few(runs, "runs"), (F.col("key") == F.col("__key")) & F.col("id").eqNullSafe(F.col("__id")), "left")


def gone(words: int, copy: bool, runs: list[int] | None, length: int) -> np.ndarray | None:
    """Which words go; None: none does."""
    if words < length or not (copy or runs):
        return None
    return np.ones(words, bool) if copy else covered(np.asarray(runs), words, length)


def cut(text: bytes, lost: np.ndarray) -> bytes:
    """The text without the lost words and the white space that follows each of them; else unchanged."""
    out, at = [], 0
    spans = [m.span() for m in WORD.finditer(text)]
    for k, (begin, _) in enumerate(spans):
        if lost[k]:
            out.append(text[at:begin])
            at = spans[k + 1][0] if k + 1 < len(spans) else len(text)
    return b"".join([*out, text[at:]])


def spans(lost: np.ndarray) -> list[tuple[int, int]]:
    """(first word, word after the last) of each maximal run of lost words."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], lost.view(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per row of df: id_col, n_words, n_removed, kept_sha256 (of the kept words, joined by spaces), spans (array of
    [first word, word after the last] of the removed runs).

    A null or empty text has no words. Of equal windows the one in the least id is kept; null ids come last. Rows of one
    id are none earlier than the other, so equal windows in several of them are kept in all; null ids count as one id. A
    text shorter than a window keeps all. An empty table gives an empty result. Other columns aren't read.
    """
    space = Workspace(df.sparkSession, "repeats")
    marked, found = repeated_runs(df, space, id_col, text_col, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, removed, digests, runs = [], [], [], []
            for text, copy, at in zip(utf8(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                words = (text or b"").split()
                lost = gone(len(words), copy, at, length)
                kept = words if lost is None else [words[i] for i in np.flatnonzero(~lost)]
                n.append(len(words))
                removed.append(len(words) - len(kept))
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                runs.append([] if lost is None else spans(lost))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array(n, pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array(digests, pa.string()),
                    pa.array(runs, pa.list_(pa.list_(pa.int32()))),
                ],
                names=[id_col, "n_words", "n_removed", "kept_sha256", "spans"],
            )

    rows = with_runs(marked, found).select("id", "text", "copy", "runs")
    return map_batches(
        rows,
        run,
        f"`{id_col}` {dict(df.dtypes)[id_col]}, n_words long, n_removed long, kept_sha256 string, spans array<array<int>>",
    )


def cut_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = "n_chars", length: int = LENGTH) -> DataFrame:
    """df with the repeats cut out of its texts (remove_repeats() says which), and their characters counted anew in count_col; other columns unchanged."""
    space = Workspace(df.sparkSession, "cut")
    marked, found = repeated_runs(df, space, id_col, text_col, length)
    cuts = (
        with_runs(marked, found)
        .where("copy or runs is not null")
        .select(F.col("key").alias("__k"), "copy", "runs")
        .dropDuplicates(["__k"])
    )
    cuts = space.save(cuts, "cuts")
    met = carried(df, id_col, text_col).join(few(cuts, "runs"), F.xxhash64("id", "text") == F.col("__k"), "left")
    joined = met.select("row.*", F.coalesce("copy", F.lit(False)).alias("__copy"), F.col("runs").alias("__runs"))
    at = df.columns.index(text_col)
    counted = df.columns.index(count_col) if count_col in df.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, copies, lists = utf8(b.column(at)), b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist()
            columns = b.columns[:-2]
            changed = False
            for i, text in enumerate(texts):
                if text and (copies[i] or lists[i]):
                    lost = gone(len(text.split()), copies[i], lists[i], length)
                    if lost is not None:
                        texts[i], changed = cut(text, lost), True
            if changed:
                out = pa.array(texts, pa.binary()).cast(pa.string())
                if counted is not None:
                    columns[counted] = pa.array([None if t is None else len(t.decode()) for t in texts], columns[counted].type)
                columns[at] = out.cast(columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = df.columns
    return map_batches(joined, run, df.schema)


def repeats_sql(source: str = "documents", length: int = LENGTH) -> str:
    """DuckDB SQL for remove_repeats() over unique ids, without spans, by comparing all windows as texts."""
    return rf"""
WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM {source}
), windows AS (
  SELECT doc_id, p, array_to_string(words[p:p + {length - 1}], ' ') AS win
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - {length - 2}, 1))) AS p FROM w)
), later AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY win ORDER BY doc_id, p) AS k FROM windows) WHERE k > 1
), lost AS (SELECT DISTINCT doc_id, p + d AS p FROM later, range({length}) t(d)
), kept AS (
  SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.p) AS text, count(*) AS n
  FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w) w ANTI JOIN lost l ON l.doc_id = w.doc_id AND l.p = w.p
  GROUP BY w.doc_id
)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, CAST(len(w.words) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM w LEFT JOIN kept k ON k.doc_id = w.doc_id
"""
