"""What the operators share: bounded Arrow batches, word hashing, and joins on checked sides; tables are those of the main library."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsveil.workspace import BROADCAST_ROWS, Workspace, small

__all__ = ["BROADCAST_ROWS", "Workspace", "small"]

#: Rows and bytes of an Arrow batch that a Python stage sees at once, far below Spark's defaults; a longer text is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 1024, 4 << 20
#: Rows up to which a side of a few numbers per row is broadcast; above, both sides are shuffled.
BROADCAST_KEYS = 100_000
#: Entries after which a worker's cache of words starts anew.
CACHE_WORDS = 200_000


def bound_batches(spark: SparkSession) -> None:
    """Lowers Spark's rows and bytes per Arrow batch to BATCH_ROWS, where the session has more, and BATCH_BYTES."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def map_batches(df: DataFrame, per_task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with batches of bounded rows and bytes; a task's memory goes back to the system at its end, as workers are used again."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from per_task(batches)
        release()

    return df.mapInArrow(run, schema)


def release() -> None:
    """Hands freed memory back to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def utf8(column: pa.Array) -> list[bytes | None]:
    """The strings of an Arrow column as UTF-8 bytes, without decoding them."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


#: Bytes of texts whose words are hashed at once.
SLICE_BYTES = 1 << 20
#: White space of the word rule [^\\x20\\x09-\\x0D]+, fixed values.
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: A random number per byte value, the same after lower-casing A-Z, and the odd base of a word's polynomial.
PER_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
PER_LOWER = PER_BYTE[[b + 32 if 65 <= b <= 90 else b for b in range(256)]]
WORD_BASE = 0xB5026F5AA96619E9


class Powers:
    """Powers of an odd number modulo 2**64 and of its inverse, as many as asked for so far."""

    def __init__(self, base: int):
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            one = np.ones(1, np.uint64)
            self.up = np.cumprod(np.concatenate([one, np.full(n + n // 4, self.base)]))
            self.down = np.cumprod(np.concatenate([one, np.full(n + n // 4, self.inverse)]))

    def spans(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each span the sum of its values times the powers 0, 1, ... of the base."""
        self.reach(len(values) + 1)
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=sums[1:])
        return (sums[ends] - sums[starts]) * self.down[starts]


class Words:
    """Hashes the words of texts, many texts at once: 64 bits per word, from a polynomial in its bytes."""

    def __init__(self, lower: bool):
        self.values, self.powers = PER_LOWER if lower else PER_BYTE, Powers(WORD_BASE)

    def hash(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of all words, each text's number of words) of texts that end at these places of data."""
        space = np.ones(len(data) + 1, bool)
        space[:-1] = SPACE[data]
        start = ~space
        start[1:] &= space[:-1]
        stop = space.copy()
        stop[1:] &= ~space[:-1]
        stop[0] = False
        # a text's end ends a word, and the next text begins another
        at = ends[(ends > 0) & (ends < len(data))]
        touching = at[~space[at] & ~space[at - 1]]
        start[touching] = True
        stop[touching] = True
        starts, stops = np.flatnonzero(start), np.flatnonzero(stop)
        h = mix(self.powers.spans(self.values[data], starts, stops) + (stops - starts).astype(np.uint64))
        return h, np.diff(np.searchsorted(starts, ends, "left"), prepend=0)

    def of(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The word hashes of each text of a column; of a null text none."""
        texts = column.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, "right")) - 1)
            h, n = self.hash(data[offsets[i] : offsets[j]], offsets[i + 1 : j + 1] - offsets[i])
            yield from np.split(h, np.cumsum(n)[:-1])
            i = j


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def grams(h: np.ndarray, n: int, seed: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """64-bit hashes of all runs of n word hashes; empty if there are fewer than n words."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    if n <= 6:
        out = np.zeros(m, np.uint64)
        for j in range(n):
            out = out * np.uint64(0xD6E8FEB86659FD93) + mix(h[j : j + m] + np.uint64(seed))
        return mix(out)
    # longer runs by doubling: a run of n is two overlapping or adjacent runs of powers of two
    out, size = mix(h + np.uint64(seed)), 1
    while size * 2 <= n:
        out = mix(out[:-size] * np.uint64(0xD6E8FEB86659FD93) + out[size:])
        size *= 2
    return out if size == n else mix(out[:m] * np.uint64(0xC2B2AE3D27D4EB4F) + out[n - size : n - size + m])


def signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def keyed(table: DataFrame) -> DataFrame:
    """A saved table of unique numbers, a few a row, for a join: broadcast if its counted rows are few, else as it is, for a shuffled join that can spill."""
    return small(table, table.count(), BROADCAST_KEYS)


def carried(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, text): df's rows as one column, so that joins can add columns of any name; select("row.*") gives them back."""
    return df.select(
        F.struct(*(df[f"`{c}`"] for c in df.columns)).alias("row"),
        df[f"`{id_col}`"].alias("id"),
        df[f"`{text_col}`"].alias("text"),
    )
