"""Sources of series tables. A series table has id BIGINT, sensitive BIGINT, series ARRAY<DOUBLE> of one length (survey rows A1-A4, A10)."""

from __future__ import annotations

import argparse
import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG = logging.getLogger(__name__)
FIRST_YEAR, QUARTERS = 1995, 28
FIRST_DAY, DAYS = "2024-01-01", 30
DIMENSIONS = 64


@dataclass(frozen=True)
class SeriesTable:
    """A series table and the length of its series."""

    rows: DataFrame
    length: int


def part_quarter(spark: SparkSession, sf_dir: str) -> SeriesTable:
    """Quantity sold per part and quarter, 1995 to 2001; one aggregation with map-side sums."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    quarter = (F.year("l_shipdate") - FIRST_YEAR) * 4 + F.quarter("l_shipdate") - 1
    sums = [F.sum(F.when(F.col("q") == k, F.col("l_quantity"))).alias(f"q{k}") for k in range(QUARTERS)]
    sold = items.select("l_partkey", "l_quantity", quarter.alias("q")).groupBy("l_partkey").agg(*sums)
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size")
    series = F.array(*(F.coalesce(f"q{k}", F.lit(0.0)) for k in range(QUARTERS)))
    return SeriesTable(
        parts.join(sold, F.col("p_partkey") == F.col("l_partkey"), "left").select(
            F.col("p_partkey").alias("id"),
            F.col("p_size").cast("bigint").alias("sensitive"),
            series.alias("series"),
        ),
        QUARTERS,
    )


def user_day(spark: SparkSession, sf_dir: str) -> SeriesTable:
    """Events per user and day of January 2024; sensitive: the user's error events."""
    return SeriesTable(day_counts(spark.read.parquet(f"{sf_dir}/events.parquet")), DAYS)


def day_counts(events: DataFrame) -> DataFrame:
    day = F.datediff(F.to_date("ts"), F.lit(FIRST_DAY).cast("date"))
    counts = [F.count(F.when(F.col("d") == k, 1)).cast("double") for k in range(DAYS)]
    rows = events.select("user_id", "event_type", day.alias("d"))
    return (
        rows.groupBy("user_id")
        .agg(F.count_if(F.col("event_type") == "error").alias("sensitive"), F.array(*counts).alias("series"))
        .select(F.col("user_id").alias("id"), "sensitive", "series")
    )


def embedding(spark: SparkSession, sf_dir: str) -> SeriesTable:
    """Embedding vectors; sensitive: their label."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return SeriesTable(
        rows.select(
            F.col("vec_id").alias("id"),
            F.col("label").cast("bigint").alias("sensitive"),
            F.col("embedding").cast("array<double>").alias("series"),
        ),
        DIMENSIONS,
    )


def read_wide_csv(spark: SparkSession, path: str, infer: bool = False) -> tuple[SeriesTable, list[str]]:
    """(table, names of the series columns) of a CSV with a header: the first column is the id, the last the sensitive value.

    Ids that occur twice raise a ValueError, as does a file of fewer than three columns. With infer the id keeps an
    inferred type, else it is a BIGINT.
    """
    head = spark.read.csv(path, header=True, inferSchema=infer)
    if len(head.columns) < 3:
        raise ValueError(f"{path}: an id, at least one value and a sensitive column are needed")
    key, *names, sensitive = head.columns
    if not infer:
        fields = [
            T.StructField(key, T.LongType()),
            *(T.StructField(n, T.DoubleType()) for n in names),
            T.StructField(sensitive, T.LongType()),
        ]
        head = spark.read.schema(T.StructType(fields)).csv(path, header=True)
    twice = head.groupBy(key).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{path}: the id {twice[0][0]} occurs {twice[0][1]} times")
    rows = head.select(
        F.col(f"`{key}`").alias("id"),
        F.col(f"`{sensitive}`").cast("bigint").alias("sensitive"),
        F.array(*(F.col(f"`{n}`").cast("double") for n in names)).alias("series"),
    )
    return SeriesTable(rows, len(names)), names


def from_long(rows: DataFrame, length: int, id_col: str = "id", position_col: str = "t", value_col: str = "value", sensitive: DataFrame | None = None) -> SeriesTable:
    """A series table of rows (id, position, value); missing positions are 0. sensitive: (id, sensitive), 0 if left out."""
    values = [F.coalesce(F.max(F.when(F.col(position_col) == k, F.col(value_col))), F.lit(0.0)).cast("double") for k in range(length)]
    out = rows.groupBy(F.col(id_col).alias("id")).agg(F.array(*values).alias("series"))
    out = out.join(sensitive, "id", "left") if sensitive is not None else out.withColumn("sensitive", F.lit(0))
    return SeriesTable(out.select("id", F.col("sensitive").cast("bigint").alias("sensitive"), "series"), length)


def write_wide_csv(table: SeriesTable, path: str, names: list[str] | None = None) -> None:
    """The table as a CSV with a header, a folder of part files."""
    names = names or [f"q{k}" for k in range(table.length)]
    (
        table.rows.select("id", *(F.get("series", F.lit(k)).alias(n) for k, n in enumerate(names)), "sensitive").write
        .mode("overwrite")
        .csv(path, header=True)
    )


def bounds(table: SeriesTable) -> DataFrame:
    """One row: dom_min and dom_max, the least and greatest value at each position; nulls in an empty table."""
    at = [F.get("series", F.lit(k)) for k in range(table.length)]
    return table.rows.agg(F.array(*map(F.min, at)).alias("dom_min"), F.array(*map(F.max, at)).alias("dom_max"))


def head(table: SeriesTable, sizes: list[int]) -> dict[int, DataFrame]:
    """size -> the rows of the `size` least ids, for sizes up to the number of rows; others are left out."""
    n = table.rows.count()
    return {size: table.rows.orderBy("id").limit(size) for size in sizes if 0 < size <= n}


def split_path(path: str) -> tuple[str, str]:
    """(folder, name without its ending) of a path or URL; the folder of a bare name is "."."""
    folder, _, name = path.rstrip("/").rpartition("/")
    return folder or ("." if not path.startswith("/") else ""), name.rpartition(".")[0] or name


def write_downsampled(table: SeriesTable, path: str, sizes: list[int], names: list[str] | None = None) -> dict[int, str]:
    """size -> the CSV <folder of path>/downsampled/<name>_<size>.csv with the rows of the `size` least ids; a size that is over the number of rows is logged and left out."""
    (folder, name), out = split_path(path), {}
    for size, rows in head(table, sizes).items():
        out[size] = f"{folder}/downsampled/{name}_{size}.csv"
        write_wide_csv(SeriesTable(rows, table.length), out[size], names)
    for size in sizes:
        if size not in out:
            LOG.error("%s doesn't have %d rows to keep", name, size)
    return out


def main(argv: list[str] | None = None) -> None:
    """downsample a wide CSV: FILE SIZE[,SIZE...]; writes one CSV per size and prints their paths."""
    parser = argparse.ArgumentParser(description=main.__doc__)
    parser.add_argument("file")
    parser.add_argument("sizes", type=lambda x: [int(n) for n in x.split(",")])
    args = parser.parse_args(argv)
    table, names = read_wide_csv(SparkSession.builder.appName("tsveil").getOrCreate(), args.file, infer=True)
    print(*write_downsampled(table, args.file, args.sizes, names).values(), sep="\n")


def published_path(path: str, strategy: str, folder: str = "anonymized", skip: str = "downsampled") -> str:
    """Where the published form of a data set goes: <its folder>/anonymized/<name>_<strategy>_anon.csv, beside a `downsampled` folder rather than inside."""
    parent, name = split_path(path)
    if parent.rpartition("/")[2] == skip:
        parent = parent.rpartition("/")[0] or "."
    return f"{parent}/{folder}/{name}_{strategy}_anon.csv"



if __name__ == "__main__":
    main()
