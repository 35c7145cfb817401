"""Envelopes of groups and what publishing them loses (survey rows B13-B15, E1, E3). A group's loss depends only on its size and envelope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def envelopes(rows: DataFrame, length: int, *keys: str) -> DataFrame:
    """(keys, n, lo, hi) per group: one aggregation with a least and a greatest value per position, all summed map-side."""
    at = [F.get("series", F.lit(k)) for k in range(length)]
    found = rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        *(F.min(x).alias(f"lo{k}") for k, x in enumerate(at)),
        *(F.max(x).alias(f"hi{k}") for k, x in enumerate(at)),
    )
    return found.select(
        *keys,
        "n",
        F.array(*(f"lo{k}" for k in range(length))).alias("lo"),
        F.array(*(f"hi{k}" for k in range(length))).alias("hi"),
    )


def certainty_penalty(n: Column, lo: Column, hi: Column, dom_min: Column, dom_max: Column) -> Column:
    """n times the sum over positions of the envelope's width by the domain's; a position whose domain is one value adds 0."""
    width = F.zip_with(hi, lo, lambda h, x: h - x)
    domain = F.zip_with(dom_max, dom_min, lambda h, x: h - x)
    return n * F.aggregate(F.zip_with(width, domain, lambda w, d: F.when(d > 0, w / d).otherwise(0.0)), F.lit(0.0), lambda x, y: x + y)


def value_loss(n: Column, lo: Column, hi: Column) -> Column:
    """n times the root mean square of the envelope's widths."""
    return n * F.sqrt(F.aggregate(F.zip_with(hi, lo, lambda h, x: (h - x) * (h - x)), F.lit(0.0), lambda x, y: x + y) / F.size(lo))


def global_value_loss(groups: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: total value loss of the groups (n, lo, hi), and its mean over all rows, suppressed ones included."""
    n = rows.agg(F.count("*").alias("rows"))
    total = groups.agg(F.coalesce(F.sum(value_loss(F.col("n"), F.col("lo"), F.col("hi"))), F.lit(0.0)).alias("total"))
    return total.crossJoin(F.broadcast(n)).select(
        F.col("total").alias("tot_value_loss"),
        (F.col("total") / F.col("rows")).alias("avg_value_loss"),
    )


def whole_number(x: Column) -> Column:
    """A value as text: without a fraction if it has none."""
    return F.when(x == F.floor(x), F.floor(x).cast("bigint").cast("string")).otherwise(x.cast("string"))


def envelope_texts(lo: Column, hi: Column) -> Column:
    """[lo|hi] of each position."""
    return F.transform(
        F.arrays_zip(lo.alias("l"), hi.alias("h")), lambda z: F.concat(
            F.lit("["),
            whole_number(z["l"]),
            F.lit("|"),
            whole_number(z["h"]),
            F.lit("]"),
        )
    )


def parse_envelope(text: Column) -> Column:
    """struct(lo, hi) of a text [lo|hi]; nulls for anything else."""
    number = r"(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)"
    pattern = rf"^\[{number}\|{number}\]$"
    part = lambda k: F.nullif(F.regexp_extract(text, pattern, k), F.lit("")).cast("double")
    return F.struct(part(1).alias("lo"), part(2).alias("hi"))
