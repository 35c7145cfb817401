"""Operator 6, packing: length buckets of least padding, and batches of a token budget inside each bucket.

A row of n tokens in a bucket with boundary b >= n costs b - n tokens of padding. The lengths of all rows are counted
into one histogram (a row per distinct length, of which n need texts of n * n / 2 tokens together: the driver holds all);
dynamic programming over it finds the boundaries of least total padding. The cost is Monge, so the best predecessor moves monotonically and each
bucket takes n log n steps. A batch then holds floor(budget / boundary) rows of one bucket, one row at least.

Rows of a bucket are dealt to lanes of about LANE_ROWS rows by a hash of id and length, and numbered inside a lane, so that no
task holds a whole bucket; each lane ends in at most one batch that isn't full.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKETS = 8
BUDGET = 16_384
LANE_ROWS = 50_000
#: White space of the word rule, fixed values: space, and tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"


def n_words(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text; 0 for null."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(F.coalesce(F.length(bare), F.lit(0)) == 0, F.lit(0)).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).cast("bigint")


def best_boundaries(lengths: list[int], counts: list[int], buckets: int = BUCKETS) -> list[int]:
    """The boundaries, ascending, of at most `buckets` buckets with the least padding over a histogram of ascending lengths.

    Of equally good choices each bucket, from the last one down, begins as early as possible. Empty for no lengths.
    """
    n = len(lengths)
    if not n:
        return []
    size = np.asarray(lengths, np.int64)
    rows = np.concatenate([[0], np.cumsum(np.asarray(counts, np.int64))])
    tokens = np.concatenate([[0], np.cumsum(size * np.asarray(counts, np.int64))])
    padding = lambda i, j: size[j - 1] * (rows[j] - rows[i]) - (tokens[j] - tokens[i])  # noqa: E731  of one bucket over lengths i to j - 1
    cost = np.concatenate([[0], padding(np.zeros(n, np.int64), np.arange(1, n + 1))])
    choices = [np.zeros(n + 1, np.int64)]
    for b in range(1, min(buckets, n)):
        new, choice = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        todo = [(b + 1, n, b, n - 1)]
        while todo:
            lo, hi, first, last = todo.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            i = np.arange(first, min(last, mid - 1) + 1)
            total = cost[i] + padding(i, mid)
            at = int(np.argmin(total))
            new[mid], choice[mid] = total[at], i[at]
            todo += [(lo, mid - 1, first, i[at]), (mid + 1, hi, i[at], last)]
        cost = new
        choices.append(choice)
    out, j = [], n
    for choice in reversed(choices):
        out.append(int(size[j - 1]))
        j = int(choice[j])
    return out[::-1]


def pack(df: DataFrame, tokens: Column, id_col: str = "doc_id", budget: int = BUDGET, buckets: int = BUCKETS) -> DataFrame:
    """One row per row of df: id_col, n_tokens, bucket, boundary, lane, batch, slot (all long but id_col).

    (bucket, lane, batch) names a batch; its rows times its boundary are at most the budget, except for a row that is
    longer than the budget, which is alone. A null or negative number of tokens counts as 0. Null ids of one length share a lane per
    bucket; ties and repeated rows are numbered in any order. An empty table gives an empty result. Other
    columns aren't read.
    """
    rows = df.select(F.col(id_col).alias("__id"), F.greatest(F.coalesce(tokens, F.lit(0)), F.lit(0)).cast("bigint").alias("n_tokens"))
    histogram = rows.groupBy("n_tokens").agg(F.count("*").alias("n")).orderBy("n_tokens").toArrow()
    lengths, counts = (histogram.column(k).to_pylist() for k in range(2))
    bounds = best_boundaries(lengths, counts, buckets)
    held = [0] * len(bounds)
    for length, n in zip(lengths, counts, strict=True):
        held[int(np.searchsorted(bounds, length))] += n
    bucket = lanes = boundary = F.lit(None).cast("bigint")
    for k in reversed(range(len(bounds))):
        inside = F.col("n_tokens") <= bounds[k]
        bucket, boundary = F.when(inside, F.lit(k)).otherwise(bucket), F.when(inside, F.lit(bounds[k])).otherwise(boundary)
        lanes = F.when(inside, F.lit(-(-held[k] // LANE_ROWS))).otherwise(lanes)
    name = F.concat_ws(":", F.coalesce(F.col("__id").cast("string"), F.lit("")), F.col("n_tokens").cast("string"))
    lane = F.pmod(F.conv(F.substring(F.md5(name.cast("binary")), 1, 15), 16, 10).cast("bigint"), lanes.cast("bigint"))
    placed = rows.select(
        "__id",
        "n_tokens",
        bucket.cast("bigint").alias("bucket"),
        boundary.cast("bigint").alias("boundary"),
        lane.alias("lane"),
    )
    at = F.row_number().over(W.partitionBy("bucket", "lane").orderBy("n_tokens", "__id")) - 1
    full = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("boundary"))).cast("bigint")
    numbered = placed.withColumn("__at", at)
    return numbered.select(
        F.col("__id").alias(id_col),
        "n_tokens",
        "bucket",
        "boundary",
        "lane",
        F.floor(F.col("__at") / full).cast("bigint").alias("batch"),
        (F.col("__at") % full).cast("bigint").alias("slot"),
    )


def pack_documents(df: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """pack() with a text's words and one end token as its length."""
    return pack(df, n_words(F.col(text_col)) + 1, **options)


def packing_sql(source: str = "documents", buckets: int = BUCKETS, budget: int = BUDGET) -> str:
    """DuckDB SQL for pack_documents(), with the dynamic programming as a common table expression per bucket."""
    steps = "".join(
        f""", dp{b} AS (
  SELECT h.j, min(p.cost + h.len * (h.rows - q.rows) - (h.toks - q.toks)) AS cost,
         arg_min(p.j, (p.cost + h.len * (h.rows - q.rows) - (h.toks - q.toks)) * 1000000 + p.j) AS prev
  FROM hist h JOIN dp{b - 1} p ON p.j < h.j JOIN hist q ON q.j = p.j GROUP BY h.j)"""
        for b in range(2, buckets + 1)
    )
    k = f"least({buckets}, (SELECT max(j) FROM hist))"
    back = f"SELECT (SELECT max(j) FROM hist) AS j, {k} AS b"
    walk = " UNION ALL ".join(f"SELECT j, prev, {b} AS b FROM dp{b}" for b in range(1, buckets + 1))
    return f"""
WITH RECURSIVE len AS (
  SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) + 1 AS BIGINT) AS n_tokens FROM {source}
), cells AS (SELECT n_tokens AS len, count(*) AS n FROM len GROUP BY 1
), hist AS (
  SELECT CAST(row_number() OVER (ORDER BY len) AS BIGINT) AS j, len, CAST(sum(n) OVER (ORDER BY len) AS BIGINT) AS rows, CAST(sum(n * len) OVER (ORDER BY len) AS BIGINT) AS toks FROM cells
), dp1 AS (SELECT j, len * rows - toks AS cost, CAST(0 AS BIGINT) AS prev FROM hist){steps}
, walk AS ({walk}
), back AS ({back} UNION ALL SELECT w.prev, back.b - 1 FROM back JOIN walk w ON w.j = back.j AND w.b = back.b WHERE back.b > 1
), bounds AS (
  SELECT h.len AS boundary, CAST(back.b - 1 AS BIGINT) AS bucket, h.rows - lag(h.rows, 1, 0) OVER (ORDER BY back.b) AS held,
         lag(h.len, 1, -1) OVER (ORDER BY back.b) AS below FROM back JOIN hist h USING (j)
), placed AS (
  SELECT l.doc_id, l.n_tokens, b.bucket, b.boundary,
         CAST('0x' || substr(md5(coalesce(CAST(l.doc_id AS VARCHAR), '') || ':' || CAST(l.n_tokens AS VARCHAR)), 1, 15) AS BIGINT) % CAST(ceil(b.held / {LANE_ROWS}.0) AS BIGINT) AS lane
  FROM len l JOIN bounds b ON l.n_tokens > b.below AND l.n_tokens <= b.boundary
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY bucket, lane ORDER BY n_tokens, doc_id) - 1 AS place, greatest(1, {budget} // boundary) AS full_rows FROM placed
)
SELECT doc_id, n_tokens, bucket, boundary, lane, CAST(place // full_rows AS BIGINT) AS batch, CAST(place % full_rows AS BIGINT) AS slot FROM numbered
"""
