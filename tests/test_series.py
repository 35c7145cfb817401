"""Sources and column functions on hand-made rows."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tsveil.functions import penalty, symbolic
from tsveil.sources import series
from tsveil.sources.series import SeriesTable

SCHEMA = "id long, sensitive long, series array<double>"


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x array<double>").select(column(F.col("x")).alias("y")).first()["y"]


def paa_brute(x, w):
    n = len(x)
    return [round(sum(x[i // w] for i in range(j * n, (j + 1) * n)) / n, 9) for j in range(w)]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-50, 50).map(lambda v: round(v, 3)), min_size=2, max_size=15), st.integers(1, 6))
def test_paa_and_znorm(spark, x, w):
    found = one(spark, x, lambda c: symbolic.paa(c, len(x), w))
    assert found == pytest.approx(paa_brute(x, w), abs=2e-9)
    mean = sum(x) / len(x)
    sd = math.sqrt(sum((v - mean) ** 2 for v in x) / len(x))
    z = one(spark, x, symbolic.znorm)
    assert z == pytest.approx(x if sd < 0.01 else [(v - mean) / sd for v in x], abs=1e-6)


def test_constant_series_and_ties(spark):
    assert one(spark, [5.0] * 4, symbolic.znorm) == [5.0] * 4
    assert one(spark, [0.0] * 6, lambda c: symbolic.sax(symbolic.paa(c, 6, 3), 3, 2)) == "bbb"  # a value at a cut belongs above it
    assert one(spark, [0.0] * 6, lambda c: symbolic.sax(symbolic.paa(c, 6, 3), 3, 1)) == "aaa"


def test_reconstruct_and_cosine(spark):
    def row(p, level=None):
        return spark.range(1).select(symbolic.reconstruct(F.lit(p), level).alias("y")).first()["y"]

    assert row("aaa") == [0.0, 0.0, 0.0]
    assert row("ab") == pytest.approx([-0.674490, 0.674490], abs=1e-6)
    assert row("ab", 3) == pytest.approx([-0.967422, 0.0], abs=1e-6)
    d = lambda u, v: spark.createDataFrame([(u, v)], "u array<double>, v array<double>").select(symbolic.cosine_distance(F.col("u"), F.col("v"))).first()[0]
    assert d([0.0, 0.0], [0.0, 0.0]) == 0 and d([1.0, 0.0], [0.0, 0.0]) == 1
    assert d([1.0, -1.0], [2.0, -2.0]) == pytest.approx(0) and d([1.0, 0.0], [-1.0, 0.0]) == pytest.approx(2)
    assert spark.range(1).select(symbolic.pattern_loss(F.array(F.lit(1.0)), F.lit(None).cast("string"))).first()[0] == 1


def test_envelope_round_trip(spark):
    rows = spark.createDataFrame([(1, [1.0, -2.5]), (1, [3.0, 4.0]), (2, [0.0, 0.0])], "g long, series array<double>")
    got = {r["g"]: r for r in penalty.envelopes(rows, 2, "g").collect()}
    assert (got[1]["n"], got[1]["lo"], got[1]["hi"]) == (2, [1.0, -2.5], [3.0, 4.0])
    text = spark.createDataFrame([([1.0, -2.5, 1e-7], [3.0, 4.0, 2e20])], "lo array<double>, hi array<double>").select(F.explode(penalty.envelope_texts(F.col("lo"), F.col("hi"))).alias("t"))
    back = [tuple(r["z"]) for r in text.select(penalty.parse_envelope(F.col("t")).alias("z")).collect()]
    assert back[:2] == [(1.0, 3.0), (-2.5, 4.0)] and back[2][0] == pytest.approx(1e-7)
    assert [r[0] for r in text.collect()][0] == "[1|3]"
    assert tuple(spark.range(1).select(penalty.parse_envelope(F.lit(" - ")).alias("z")).first()["z"]) == (None, None)


def test_degenerate_domain_adds_nothing(spark):
    found = spark.range(1).select(penalty.certainty_penalty(F.lit(2), *(F.array(*map(F.lit, x)) for x in ([1.0, 0.0], [1.0, 5.0], [1.0, 0.0], [1.0, 10.0])))).first()[0]
    assert found == 1.0


def test_wide_csv(spark, tmp_path):
    rows = spark.createDataFrame([(1, 7, [1.0, 2.0]), (2, 8, [3.0, 4.5])], SCHEMA)
    series.write_wide_csv(SeriesTable(rows, 2), str(tmp_path / "w"), ["a", "b"])
    table, names = series.read_wide_csv(spark, str(tmp_path / "w"))
    assert names == ["a", "b"] and sorted(map(tuple, table.rows.collect())) == [(1, 7, [1.0, 2.0]), (2, 8, [3.0, 4.5])]
    series.write_wide_csv(SeriesTable(rows.unionByName(rows), 2), str(tmp_path / "d"))
    with pytest.raises(ValueError, match="occurs 2 times"):
        series.read_wide_csv(spark, str(tmp_path / "d"))


def test_long_rows_head_and_paths(spark):
    long = spark.createDataFrame([(1, 0, 2.0), (1, 2, 4.0)], "id long, t int, value double")
    table = series.from_long(long, 3)
    assert table.rows.first()["series"] == [2.0, 0.0, 4.0]
    assert set(series.head(table, [1, 5])) == {1}
    assert series.published_path("data/x.csv", "value_first") == "data/anonymized/x_value_first_anon.csv"
    assert series.published_path("data/downsampled/x_5.csv", "pattern_first") == "data/anonymized/x_5_pattern_first_anon.csv"
    assert series.published_path("viewfs://store/in/x.csv", "s") == "viewfs://store/in/anonymized/x_s_anon.csv"
    assert series.published_path("x.csv", "s") == "./anonymized/x_s_anon.csv"


def test_downsampled_files(spark, tmp_path, caplog, capsys):
    rows = spark.createDataFrame([(i, i % 3, [float(i), 0.5]) for i in range(9, 0, -1)], SCHEMA)
    path = str(tmp_path / "w.csv")
    series.write_wide_csv(SeriesTable(rows, 2), path, ["a", "b"])
    series.main([path, "4,100,2"])
    assert capsys.readouterr().out.split() == [str(tmp_path / f"downsampled/w_{n}.csv") for n in (4, 2)]
    assert "100" in caplog.text
    table, names = series.read_wide_csv(spark, str(tmp_path / "downsampled/w_4.csv"))
    assert names == ["a", "b"] and sorted(r["id"] for r in table.rows.collect()) == [1, 2, 3, 4]


def test_stream_of_days(spark, tmp_path):
    from tsveil.streaming.day_counts import daily_counts, series_of

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    q = daily_counts(stream).writeStream.outputMode("complete").format("memory").queryName("days").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {r["id"]: (r["sensitive"], r["series"]) for r in series_of(spark.table("days")).rows.collect()}
    want = {r["id"]: (r["sensitive"], r["series"]) for r in series.user_day(spark, "/root/testdata/sf0.001").rows.collect()}
    assert got == want
