"""Operator 7, placement by a permutation-filled lookup table (the consistent hash of Eisenbud et al., NSDI 2016).

Each shard has a permutation of the slots of a table of prime size, (offset + k * skip) mod slots. The shards take
turns; each claims the first slot of its permutation that is still free, until the table is full. A key's place is the
shard at the key's slot. The table has a fixed number of slots, so it is sent to all executors as it is.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A hash is the first 15 hexadecimal digits of an MD5, so that it fits a signed 64-bit number in any SQL dialect.
HEX_DIGITS = 15
SHARDS = 32
SLOTS = 4099


def digest(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:HEX_DIGITS], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """slot -> index of the shard that claimed it. ValueError if slots is no prime or there are more shards than slots."""
    if not is_prime(slots) or not 0 < len(set(shards)) == len(shards) <= slots:
        raise ValueError("slots must be a prime, shards distinct, at least one and at most as many as slots")
    at = [digest(f"{s}/offset") % slots for s in shards]
    skip = [digest(f"{s}/skip") % (slots - 1) + 1 for s in shards]
    table, free = [-1] * slots, slots
    while True:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % slots
            table[at[i]] = i
            free -= 1
            if not free:
                return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key; a null key has the slot of the empty string."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, HEX_DIGITS), 16, 10).cast("bigint"), F.lit(slots))


def place(df: DataFrame, key: str = "doc_id", shards: list[str] | int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """One row per row of df: key, slot (long), shard (string).

    Null keys go where the empty string goes; equal keys and repeated rows go to the same shard; an empty table gives
    an empty result. Other columns of df aren't read, so their names may clash with the result's.
    """
    names = [f"shard-{i:03d}" for i in range(shards)] if isinstance(shards, int) else list(shards)
    filled = fill_table(names, slots)
    spark = df.sparkSession
    owners = F.split(F.lit(",".join(map(str, filled))), ",")
    table = spark.range(1).select(F.posexplode(owners).alias("slot", "owner")).select(
        F.col("slot").cast("bigint").alias("slot"), F.element_at(F.array(*map(F.lit, names)), F.col("owner").cast("int") + 1).alias("shard")
    )
    placed = df.select(F.col(key), slot_of(F.col(key), slots).alias("__slot"))
    return placed.join(
        F.broadcast(table.withColumnRenamed("slot", "__at")),
        F.col("__slot") == F.col("__at"),
        "left",
    ).select(F.col(key), F.col("__slot").alias("slot"), "shard")


def placement_sql(shards: int = SHARDS, slots: int = SLOTS) -> str:
    """DuckDB SQL for place() over documents: fills the table anew, one claimed slot at a time."""
    h = lambda x: f"CAST('0x' || substr(md5({x}), 1, {HEX_DIGITS}) AS BIGINT)"
    return f"""
WITH RECURSIVE shards AS (
  SELECT i, printf('shard-%03d', i) AS name FROM range({shards}) t(i)
), prefs AS (
  SELECT i, name, {h("name || '/offset'")} % {slots} AS o, {h("name || '/skip'")} % {slots - 1} + 1 AS s FROM shards
), lists AS (
  SELECT list(o ORDER BY i) AS os, list(s ORDER BY i) AS ss FROM prefs
), fill AS (
  SELECT 0 AS step, bitstring('0', {slots}) AS taken, CAST(NULL AS BIGINT) AS slot
  UNION ALL
  SELECT step + 1, set_bit(taken, CAST(nxt AS INTEGER), 1), nxt FROM (
    SELECT step, taken, arg_min((os[step % {shards} + 1] + k * ss[step % {shards} + 1]) % {slots}, k) AS nxt
    FROM fill, lists, range({slots}) r(k)
    WHERE step < {slots} AND get_bit(taken, CAST((os[step % {shards} + 1] + k * ss[step % {shards} + 1]) % {slots} AS INTEGER)) = 0
    GROUP BY step, taken)
)
SELECT d.doc_id, d.slot, printf('shard-%03d', (f.step - 1) % {shards}) AS shard
FROM (SELECT doc_id, {h("coalesce(CAST(doc_id AS VARCHAR), '')")} % {slots} AS slot FROM documents) d
JOIN fill f ON f.slot = d.slot
"""
