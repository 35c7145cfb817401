"""Registered queries by survey row, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsveil.functions import penalty, symbolic
from tsveil.operators import bisect, diversity, pattern_tree, publish
from tsveil.operators.agglomerate import agglomerate
from tsveil.plans import pipelines, sql
from tsveil.sources import series
from tsveil.sources.series import SeriesTable
from tsveil.workspace import Workspace

W, P, K, L = 6, 3, 16, 3
HEAD = 100
#: Rows of a leaf in the query of suppressed rows.
MANY = 10
#: Ids of a root of the value-first tree query.
BUCKET = 64
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def patterns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    table = series.part_quarter(spark, sf_dir)
    return pattern_tree.with_patterns(table, W), table.length


def exploded(rows: DataFrame, column: str, *keys: str) -> DataFrame:
    # an inner explode filters by the array's size, a filter that is pushed down and repeats the array's whole expression
    return rows.select(*keys, F.posexplode_outer(column).alias("pos", "v")).where("pos is not null").select(
        *keys,
        F.col("pos").cast("bigint").alias("pos"),
        rounded("v").alias("value"),
    )


def rounded(column) -> F.Column:
    return F.round(column, 6) + 0.0


F1 = sql.base("part_quarter")
N1 = series.QUARTERS
GROUPS = sql.envelope("s2", N1)


@query(f"WITH {F1} SELECT s3 AS pattern, n, round({sql.value_loss('n', 'lo', 'hi')}, 6) AS loss FROM ({sql.envelope('s3', N1, extra=', s3')}) WHERE n >= {P}")
def flagship_pattern_groups(spark, sf_dir):
    """Groups of one level-3 pattern with P rows or more, and the value loss of their envelopes."""
    rows, n = patterns(spark, sf_dir)
    groups = penalty.envelopes(rows, n, "s3").where(F.col("n") >= P)
    return groups.select(
        F.col("s3").alias("pattern"),
        "n",
        F.round(penalty.value_loss(F.col("n"), F.col("lo"), F.col("hi")), 6).alias("loss"),
    )


@query(f"WITH {sql.fixture('part_quarter')[0]} {sql.exploded('f', 'series', N1)}")
def load_wide_series(spark, sf_dir):
    """The table written as a wide CSV and read again."""
    table = series.part_quarter(spark, sf_dir)
    path = f"{Workspace(spark, 'wide').path}/csv"
    series.write_wide_csv(table, path)
    read, _ = series.read_wide_csv(spark, path)
    return exploded(read.rows, "series", "id")


@query(f"WITH {sql.fixture('part_quarter')[0]} SELECT pos, min(value) AS dom_min, max(value) AS dom_max FROM ({sql.exploded('f', 'series', N1)}) GROUP BY pos")
def qi_bounds(spark, sf_dir):
    both = series.bounds(series.part_quarter(spark, sf_dir)).select(F.posexplode(F.arrays_zip("dom_min", "dom_max")).alias("pos", "z"))
    return both.select(F.col("pos").cast("bigint").alias("pos"), "z.dom_min", "z.dom_max")


@query(f"WITH {sql.fixture('part_quarter')[0]} SELECT id, sensitive, list_sum(series) AS total FROM f ORDER BY id LIMIT {HEAD}")
def downsample_head(spark, sf_dir):
    rows = series.head(series.part_quarter(spark, sf_dir), [HEAD])[HEAD]
    return rows.select("id", "sensitive", symbolic.total(F.col("series")).alias("total"))


@query(f"WITH {F1} {sql.exploded('r', 'zs', N1)}")
def znorm(spark, sf_dir):
    rows = series.part_quarter(spark, sf_dir).rows
    return exploded(rows.select("id", symbolic.znorm(F.col("series")).alias("z")), "z", "id")


@query(f"SELECT 'part_quarter' AS fixture, * FROM (WITH {F1} {sql.exploded('r', 'means', W)}) UNION ALL SELECT 'user_day', * FROM (WITH {sql.base('user_day')} {sql.exploded('r', 'means', W)})")
def paa(spark, sf_dir):
    """Piecewise means of 28 values (fractional segments) and of 30."""
    out = [
        exploded(
            t.rows.select("id", F.lit(name).alias("fixture"), symbolic.paa(symbolic.znorm(F.col("series")), t.length, W).alias("m")),
            "m",
            "fixture",
            "id",
        )
        for name, t in (("part_quarter", series.part_quarter(spark, sf_dir)), ("user_day", series.user_day(spark, sf_dir)))
    ]
    return out[0].unionByName(out[1])


@query(f"WITH {sql.base('embedding')} {sql.exploded('r', 'means', W)}")
def feature_vector(spark, sf_dir):
    t = series.embedding(spark, sf_dir)
    return exploded(t.rows.select("id", symbolic.paa(symbolic.znorm(F.col("series")), t.length, W).alias("m")), "m", "id")


@query(f"WITH {F1} SELECT id, s3 AS pattern FROM r")
def sax_l3(spark, sf_dir):
    return patterns(spark, sf_dir)[0].select("id", F.col("s3").alias("pattern"))


@query(f"WITH {F1} SELECT id, {sql.PATTERN_COLUMNS} FROM r")
def sax_levels(spark, sf_dir):
    return patterns(spark, sf_dir)[0].select("id", *pattern_tree.PATTERNS)


@query(f"WITH {F1} SELECT id, CAST(j AS BIGINT) AS pos, CAST(ascii(substr(s3, CAST(j + 1 AS BIGINT), 1)) - 97 AS BIGINT) AS letter FROM r, range({W}) t(j)")
def letter_index(spark, sf_dir):
    rows = patterns(spark, sf_dir)[0].select("id", F.posexplode(symbolic.letter_indexes(F.col("s3"))).alias("pos", "letter"))
    return rows.select("id", F.col("pos").cast("bigint").alias("pos"), F.col("letter").cast("bigint").alias("letter"))


@query(f"WITH {F1}, d AS (SELECT DISTINCT s4 AS id FROM r) SELECT id AS pattern, pos, value FROM ({sql.exploded('(SELECT id, ' + sql.medians_of('id') + ' AS fv FROM d)', 'fv', W)})")
def reconstruct_fv(spark, sf_dir):
    rows = patterns(spark, sf_dir)[0].select(F.col("s4").alias("pattern")).distinct()
    return exploded(rows.select("pattern", symbolic.reconstruct(F.col("pattern")).alias("fv")), "fv", "pattern")


@query(f"WITH {F1}, v AS (SELECT id, means, {sql.medians_of('s4')} AS fv FROM r) SELECT id, round({sql.cosine('means', 'fv')}, 6) + 0.0 AS distance FROM v")
def cosine_distance(spark, sf_dir):
    return patterns(spark, sf_dir)[0].select(
        "id",
        rounded(symbolic.cosine_distance(F.col("means"), symbolic.reconstruct(F.col("s4")))).alias("distance"),
    )


@query(f"WITH {F1}, v AS (SELECT id, s3, means, {sql.medians_of('s3')} AS fv FROM r) SELECT id, s3 AS pattern, round({sql.cosine('means', 'fv')}, 6) + 0.0 AS loss FROM v")
def pattern_loss_rows(spark, sf_dir):
    return patterns(spark, sf_dir)[0].select(
        "id",
        F.col("s3").alias("pattern"),
        rounded(symbolic.pattern_loss(F.col("means"), F.col("s3"))).alias("loss"),
    )


@query(f"WITH {F1}, d AS (SELECT DISTINCT s3 AS p FROM r) SELECT a.p AS p, b.p AS q, CAST({sql.hamming('a.p', 'b.p')} AS BIGINT) AS distance FROM d a JOIN d b ON a.p < b.p")
def pattern_hamming(spark, sf_dir):
    """Distances of all pairs of distinct patterns: there are 3 ** 6 patterns at most."""
    found = patterns(spark, sf_dir)[0].select(F.col("s3").alias("p")).distinct()
    pairs = found.join(F.broadcast(found.withColumnRenamed("p", "q")), F.col("p") < F.col("q"))
    return pairs.select("p", "q", symbolic.hamming(F.col("p"), F.col("q")).cast("bigint").alias("distance"))


@query(f"WITH {F1}, g AS ({GROUPS}) SELECT gid, n, CAST(pos AS BIGINT) AS pos, lo, hi FROM (SELECT gid, n, unnest(range(0, {N1})) AS pos, unnest(lo) AS lo, unnest(hi) AS hi FROM g)")
def group_envelope(spark, sf_dir):
    rows, n = patterns(spark, sf_dir)
    groups = penalty.envelopes(rows, n, "s2").select(
        F.col("s2").alias("gid"),
        "n",
        F.posexplode(F.arrays_zip("lo", "hi")).alias("pos", "z"),
    )
    return groups.select("gid", "n", F.col("pos").cast("bigint").alias("pos"), "z.lo", "z.hi")


DOMAIN = f"d AS (SELECT [{', '.join(f'max(series[{k + 1}]) - min(series[{k + 1}])' for k in range(N1))}] AS w FROM f)"
NCP = "n * list_sum(list_transform(list_zip(list_transform(list_zip(hi, lo), lambda z: z[1] - z[2]), w), lambda z: CASE WHEN z[2] > 0 THEN z[1] / z[2] ELSE 0.0 END))"


@query(f"WITH {F1}, {DOMAIN}, g AS ({GROUPS}) SELECT gid, n, round({NCP}, 6) AS loss FROM g, d")
def group_ncp(spark, sf_dir):
    table = series.part_quarter(spark, sf_dir)
    rows = pattern_tree.with_patterns(table, W)
    groups = penalty.envelopes(rows, table.length, "s2").crossJoin(F.broadcast(series.bounds(table)))
    return groups.select(
        F.col("s2").alias("gid"),
        "n",
        F.round(penalty.certainty_penalty(*map(F.col, ("n", "lo", "hi", "dom_min", "dom_max"))), 6).alias("loss"),
    )


@query(f"WITH {F1}, g AS ({GROUPS}) SELECT gid, n, round({sql.value_loss('n', 'lo', 'hi')}, 6) AS loss FROM g")
def group_vl(spark, sf_dir):
    rows, n = patterns(spark, sf_dir)
    groups = penalty.envelopes(rows, n, "s2")
    return groups.select(F.col("s2").alias("gid"), "n", F.round(penalty.value_loss(*map(F.col, ("n", "lo", "hi"))), 6).alias("loss"))


BASE_ROW = "b AS (SELECT id AS base_id, series AS base FROM f ORDER BY id LIMIT 1)"
PAIR_WIDTH = "list_transform(list_zip(series, base), lambda z: abs(z[1] - z[2]))"


def farthest(spark, sf_dir, kind: str) -> DataFrame:
    table = series.part_quarter(spark, sf_dir)
    dom = series.bounds(table).first()
    metric = bisect.Metric(kind, tuple(float(b - a) for a, b in zip(dom["dom_min"], dom["dom_max"], strict=True)))
    return bisect.farthest_row(table.rows, table.rows.orderBy("id").limit(1), metric)


@query(f"WITH {sql.fixture('part_quarter')[0]}, {DOMAIN}, {BASE_ROW} SELECT id, base_id, round(2 * list_sum(list_transform(list_zip({PAIR_WIDTH}, w), lambda z: CASE WHEN z[2] > 0 THEN z[1] / z[2] ELSE 0.0 END)), 6) AS loss FROM f, d, b WHERE id <> base_id ORDER BY loss DESC, id LIMIT 1")
def farthest_by_ncp(spark, sf_dir):
    return farthest(spark, sf_dir, "ncp")


@query(f"WITH {sql.fixture('part_quarter')[0]}, {BASE_ROW} SELECT id, base_id, round(2 * sqrt(list_sum(list_transform({PAIR_WIDTH}, lambda x: x * x)) / len(series)), 6) AS loss FROM f, b WHERE id <> base_id ORDER BY loss DESC, id LIMIT 1")
def farthest_by_vl(spark, sf_dir):
    return farthest(spark, sf_dir, "vl")


UNION_WIDTH = "list_transform(list_zip(a.hi, b.hi, a.lo, b.lo), lambda z: greatest(z[1], z[2]) - least(z[3], z[4]))"


@query(f"""WITH {F1}, g AS ({GROUPS}), m AS (
  SELECT a.gid, b.gid AS nearest, round((a.n + b.n) * sqrt(list_sum(list_transform({UNION_WIDTH}, lambda x: x * x)) / len(a.lo)), 6) AS loss FROM g a JOIN g b ON a.gid <> b.gid
), k AS (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY loss, nearest) AS k FROM m) SELECT gid, nearest, loss FROM k WHERE k = 1""")
def nearest_group_vl(spark, sf_dir):
    rows, n = patterns(spark, sf_dir)
    groups = Workspace(spark, "nearest").save(penalty.envelopes(rows, n, "s2").withColumnRenamed("s2", "gid"), "groups")
    return bisect.nearest_groups(groups, groups)


@query(f"WITH {F1} SELECT s2, s3, count(*) AS n FROM r GROUP BY s2, s3")
def pattern_counts(spark, sf_dir):
    return patterns(spark, sf_dir)[0].groupBy("s2", "s3").agg(F.count("*").alias("n"))


SAME = ", ".join(f"min(s{a}) = max(s{a}) AS same{a}, min(s{a}) AS s{a}" for a in range(2, 7))


@query(f"WITH {F1}, g AS (SELECT s3 AS node, count(*) AS n, min(s1) AS s1, {SAME} FROM r GROUP BY s3), h AS (SELECT *, {sql.run_of(3)} AS lv FROM g) SELECT node, n, CAST(lv AS BIGINT) AS level, {sql.pattern_at('lv')} AS pr FROM h")
def maximize_level(spark, sf_dir):
    """Level-3 groups, raised while their rows share one pattern."""
    found = pattern_tree.maximize(patterns(spark, sf_dir)[0], "s3", 3)
    return found.withColumn("level", F.col("level").cast("bigint"))




def leaf(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(*more, "id", F.col("level").cast("bigint").alias("level"), "pr", "status")


LEAF_SQL = "id, CAST(level AS BIGINT) AS level, pr, status"


@query(f"WITH {F1}, {sql.tree(P)} SELECT {LEAF_SQL} FROM leaves")
def pattern_tree_leaves(spark, sf_dir):
    rows = patterns(spark, sf_dir)[0]
    return leaf(pattern_tree.on_records(rows, pattern_tree.split(pattern_tree.classes(rows), P, Workspace(spark, "tree"))))


ROOT_SQL = f"id // {BUCKET}"


def bucket() -> F.Column:
    return F.floor(F.col("id") / BUCKET).cast("string")


@query(f"WITH {F1}, {sql.tree(P, root=ROOT_SQL)} SELECT root, {LEAF_SQL} FROM leaves")
def pattern_tree_by_root(spark, sf_dir):
    rows = patterns(spark, sf_dir)[0]
    leaves = pattern_tree.split(pattern_tree.classes(rows, bucket()), P, Workspace(spark, "tree"))
    return leaf(pattern_tree.on_records(rows, leaves, bucket()), "root")


@query(f"WITH {F1}, {sql.tree(P, root=ROOT_SQL)}, {sql.merged()} SELECT root, {LEAF_SQL} FROM placed")
def merge_bad_leaves(spark, sf_dir):
    rows = patterns(spark, sf_dir)[0]
    leaves = pattern_tree.value_first_leaves(rows, bucket(), P, Workspace(spark, "tree"))
    return leaf(pattern_tree.on_records(rows, leaves, bucket()), "root")


@query(f"WITH {F1}, {sql.tree(P)}, {sql.recycled(P)} SELECT {LEAF_SQL} FROM placed")
def recycle_leaves(spark, sf_dir):
    rows = patterns(spark, sf_dir)[0]
    return leaf(pattern_tree.on_records(rows, pattern_tree.pattern_first_leaves(rows, P, Workspace(spark, "tree"))))


@query(f"WITH {sql.base('user_day')}, {sql.tree(MANY)}, {sql.recycled(MANY)} SELECT {LEAF_SQL} FROM placed")
def suppressed_records(spark, sf_dir):
    """Recycling with leaves so large that rows can stay bad at every level."""
    table = series.user_day(spark, sf_dir)
    rows = pattern_tree.with_patterns(table, W)
    return leaf(pattern_tree.on_records(rows, pattern_tree.pattern_first_leaves(rows, MANY, Workspace(spark, "tree"))))


@query(f"WITH {F1} SELECT s3 AS gid, count(*) AS n FROM r GROUP BY s3 HAVING count(*) < {K}")
def undersized_groups(spark, sf_dir):
    return patterns(spark, sf_dir)[0].groupBy(F.col("s3").alias("gid")).agg(F.count("*").alias("n")).where(F.col("n") < K)


def grouped(spark, sf_dir) -> tuple[DataFrame, DataFrame, int]:
    """(published rows under groups of level-2 and patterns of level-3 pattern, rows, length)."""
    rows, n = patterns(spark, sf_dir)
    rows = Workspace(spark, "grouped").save(rows, "rows")
    own = rows.select("id", "series", F.col("s2").alias("group_id"), F.col("s3").alias("pr"), F.col("sensitive").alias("sensitive_out"))
    return publish.published(own, n), rows, n


TEXTS = "list_transform(list_zip(lo, hi), lambda z: '[' || CAST(CAST(z[1] AS BIGINT) AS VARCHAR) || '|' || CAST(CAST(z[2] AS BIGINT) AS VARCHAR) || ']')"


@query(f"WITH {F1}, g AS ({GROUPS}) SELECT id, array_to_string({TEXTS}, ' ') AS envelope, s3 AS sax, sensitive AS \"as\", gid AS \"group\" FROM r JOIN g ON s2 = gid")
def publish_envelope(spark, sf_dir):
    table, _, n = grouped(spark, sf_dir)
    text = publish.as_text(table, n)
    return text.select("id", F.concat_ws(" ", *(f"q{k}" for k in range(n))).alias("envelope"), "sax", "as", "group")


@query(f"WITH {F1}, g AS ({GROUPS}) SELECT id, CAST(pos AS BIGINT) AS pos, lo, hi FROM (SELECT id, unnest(range(0, {N1})) AS pos, unnest(lo) AS lo, unnest(hi) AS hi FROM r JOIN g ON s2 = gid)")
def parse_envelope(spark, sf_dir):
    """Published texts parsed again."""
    table, _, n = grouped(spark, sf_dir)
    text = publish.as_text(table, n).select("id", F.posexplode(F.array(*(f"q{k}" for k in range(n)))).alias("pos", "t"))
    return text.select(
        "id",
        F.col("pos").cast("bigint").alias("pos"),
        penalty.parse_envelope(F.col("t")).alias("z"),
    ).select("id", "pos", "z.lo", "z.hi")


@query(f"WITH {F1}, g AS ({GROUPS}) SELECT round(sum(loss), 6) AS tot_value_loss, round(sum(loss) / sum(n), 6) AS avg_value_loss FROM (SELECT n, {sql.value_loss('n', 'lo', 'hi')} AS loss FROM g)")
def global_value_loss(spark, sf_dir):
    rows, n = patterns(spark, sf_dir)
    found = penalty.global_value_loss(penalty.envelopes(rows, n, "s2"), rows)
    return found.select(*(F.round(c, 6).alias(c) for c in found.columns))


@query(f"WITH {F1}, v AS (SELECT means, {sql.medians_of('s3')} AS fv FROM r) SELECT round(sum(loss), 6) AS tot_pattern_loss, round(avg(loss), 6) AS avg_pattern_loss FROM (SELECT {sql.cosine('means', 'fv')} AS loss FROM v)")
def global_pattern_loss(spark, sf_dir):
    table, rows, n = grouped(spark, sf_dir)
    return publish.losses(table, rows, n).select(*(F.round(c, 6).alias(c) for c in ("tot_pattern_loss", "avg_pattern_loss")))


@query(f"""WITH {F1}, g AS ({GROUPS}), v AS (SELECT means, {sql.medians_of('s3')} AS fv FROM r),
pl AS (SELECT round(sum(loss), 3) AS tot_pattern_loss, round(avg(loss), 3) AS avg_pattern_loss FROM (SELECT {sql.cosine('means', 'fv')} AS loss FROM v))
SELECT pl.*, round(sum(loss), 3) AS tot_value_loss, round(sum(loss) / sum(n), 3) AS avg_value_loss FROM pl, (SELECT n, {sql.value_loss('n', 'lo', 'hi')} AS loss FROM g) GROUP BY ALL""")
def evaluate_published_file(spark, sf_dir):
    """A published CSV, written and evaluated from the file."""
    table, _, n = grouped(spark, sf_dir)
    path = f"{Workspace(spark, 'published').path}/csv"
    publish.write_published(table, n, path)
    return pipelines.evaluate(series.part_quarter(spark, sf_dir), path, W)


SIZES = (4, 16, 64)
STAT = " UNION ALL ".join(
    f"SELECT '{a}' AS algorithm, {k}.0 AS tuned_value, (SELECT coalesce(sum(n), 0.0) FROM (SELECT count(*) AS n FROM r GROUP BY {c}) WHERE n >= {k}) AS value" for a, c in (("value_first", "s2"), ("pattern_first", "s3")) for k in SIZES
)


@query(f"WITH {F1} SELECT 'kept_rows' AS metric, 'P' AS fixed_param, {P}.0::DOUBLE AS fixed_value, algorithm, tuned_value::DOUBLE AS tuned_value, 'part_quarter' AS dataset, value::DOUBLE AS value FROM ({STAT})")
def stat_file(spark, sf_dir):
    """A stat file of rows in groups of k or more, written as text and read again."""
    rows = patterns(spark, sf_dir)[0]
    path = f"{Workspace(spark, 'stat').path}/text"
    lines = spark.range(1).select(F.lit(f"kept_rows P {P}").alias("value"))
    for name, column in (("value_first", "s2"), ("pattern_first", "s3")):
        sizes = rows.groupBy(column).agg(F.count("*").alias("n"))
        kept = sizes.agg(*(F.coalesce(F.sum(F.when(F.col("n") >= k, F.col("n"))), F.lit(0)).alias(f"k{k}") for k in SIZES))
        each = F.explode(F.array(*(F.concat_ws(" ", F.lit(name), f"k{k}", F.lit(str(k)), F.lit("part_quarter")) for k in SIZES)))
        lines = lines.unionByName(kept.select(each.alias("value")))
    lines.write.text(path)
    return pipelines.read_stat_file(spark, path, list(pipelines.STRATEGIES), ["part_quarter"])


@query(f"WITH {sql.fixture('part_quarter')[0]} SELECT id, sensitive, list_sum(series) AS total FROM f ORDER BY id LIMIT {HEAD}")
def downsampled_file(spark, sf_dir):
    """The rows of least ids, written as the CSV of a smaller data set and read again."""
    table = series.part_quarter(spark, sf_dir)
    path = f"{Workspace(spark, 'downsampled').path}/part.csv"
    written = series.write_downsampled(table, path, [HEAD])
    read, _ = series.read_wide_csv(spark, written[HEAD])
    return read.rows.select("id", "sensitive", symbolic.total(F.col("series")).alias("total"))


def subgroups(spark, sf_dir) -> DataFrame:
    return patterns(spark, sf_dir)[0].select("id", F.col("s2").alias("group_id"), F.col("s3").alias("pr"), "sensitive")


CLASSES = f"{F1}, c AS (SELECT s2 AS group_id, s3 AS pr, sensitive, count(*) AS ec, CAST(sum(count(*)) OVER (PARTITION BY s2, s3) AS BIGINT) AS ps FROM r GROUP BY s2, s3, sensitive)"


@query(f"WITH {CLASSES} SELECT * FROM c WHERE ec * {L} > ps")
def ldiv_violations(spark, sf_dir):
    return diversity.violations(subgroups(spark, sf_dir), L)


@query(f"WITH {F1} SELECT s2 AS group_id, s3 AS pr, count(DISTINCT sensitive) AS values FROM r GROUP BY s2, s3")
def sensitive_distinct(spark, sf_dir):
    return diversity.distinct_values(subgroups(spark, sf_dir))


@query(f"WITH {CLASSES}, k AS (SELECT id, group_id, pr, r.sensitive, row_number() OVER (PARTITION BY group_id, pr, r.sensitive ORDER BY id) AS k, ec - ps // {L} AS over FROM r JOIN c ON s2 = group_id AND s3 = pr AND r.sensitive = c.sensitive WHERE ec * {L} > ps) SELECT id, group_id, pr, sensitive FROM k WHERE k <= over")
def ldiv_plan(spark, sf_dir):
    return diversity.plan(subgroups(spark, sf_dir), L)


@query()
def ldiv_enforce(spark, sf_dir):
    return diversity.enforce(subgroups(spark, sf_dir), L)


@query(f"WITH {CLASSES} SELECT group_id, pr, sensitive, ec - ps // {L} AS changed FROM c WHERE ec * {L} > ps")
def ldiv_changed(spark, sf_dir):
    """How many rows of each sensitive value got another one: as many as are over its share."""
    rows = subgroups(spark, sf_dir)
    out = diversity.enforce(rows, L).withColumnRenamed("id", "id_")
    changed = rows.join(out, F.col("id") == F.col("id_")).where(F.col("sensitive") != F.col("sensitive_out"))
    return changed.groupBy("group_id", "pr", "sensitive").agg(F.count("*").alias("changed"))


def clustered(spark, sf_dir, repaired: bool) -> DataFrame:
    table = series.part_quarter(spark, sf_dir)
    dom = series.bounds(table).first()
    metric = bisect.Metric("ncp", tuple(float(b - a) for a, b in zip(dom["dom_min"], dom["dom_max"], strict=True)))
    return bisect.clusters(
        table.rows.select(F.lit("r").alias("root"), "id", "series"),
        K,
        metric,
        0,
        Workspace(spark, "clusters"),
        "c",
        repaired,
    ).select("id", "cluster")


@query()
def topdown_clusters(spark, sf_dir):
    return clustered(spark, sf_dir, False)


@query()
def repair_clusters(spark, sf_dir):
    return clustered(spark, sf_dir, True)


@query()
def kanon_topdown(spark, sf_dir):
    """Sizes and value losses of repaired clusters."""
    table = series.part_quarter(spark, sf_dir)
    found = clustered(spark, sf_dir, True).withColumnRenamed("id", "id_")
    groups = penalty.envelopes(table.rows.join(found, F.col("id") == F.col("id_")), table.length, "cluster")
    return groups.select("cluster", "n", F.round(penalty.value_loss(*map(F.col, ("n", "lo", "hi"))), 6).alias("loss"))


@query()
def bottomup_groups(spark, sf_dir):
    rows, n = patterns(spark, sf_dir)
    space = Workspace(spark, "bottomup")
    good = pattern_tree.on_records(rows, pattern_tree.pattern_first_leaves(rows, P, space)).where("status = 'good'")
    return agglomerate(space.save(good.select("id", "node", "pr", "series"), "good"), n, P, K, 0, space)


def audited(stage: str, found: DataFrame, group: str, wrong) -> DataFrame:
    """(stage, rows, ids, wrong): rows and distinct ids of a grouping, and groups whose size is wrong."""
    sizes = found.groupBy(group).agg(F.count("*").alias("n"))
    ids = found.agg(F.count("*").alias("rows"), F.countDistinct("id").alias("ids"))
    return ids.crossJoin(sizes.agg(F.count_if(wrong(F.col("n"))).alias("wrong"))).select(F.lit(stage).alias("stage"), "rows", "ids", "wrong")


GOOD_ROWS = f"SELECT count(*) FROM (WITH {F1}, {sql.tree(P)}, {sql.recycled(P)} SELECT id FROM placed WHERE status = 'good')"


@query(
    f"""SELECT stage, n AS rows, n AS ids, CAST(0 AS BIGINT) AS wrong FROM (
  SELECT unnest(['bisected', 'repaired']) AS stage, (SELECT count(*) FROM part) AS n UNION ALL SELECT 'joined', ({GOOD_ROWS}))"""
)
def grouping_audit(spark, sf_dir):
    """Every row is in one group: bisected ones have under 2 * K rows, repaired and joined ones K at least."""
    out = audited("bisected", clustered(spark, sf_dir, False), "cluster", lambda n: n >= 2 * K)
    out = out.unionByName(audited("repaired", clustered(spark, sf_dir, True), "cluster", lambda n: n < K))
    return out.unionByName(audited("joined", bottomup_groups(spark, sf_dir), "group_id", lambda n: n < K))


PARAMS = pipelines.Params(K, P, W, 2)


def anonymized(spark, sf_dir, strategy: str) -> DataFrame:
    return pipelines.anonymize(series.part_quarter(spark, sf_dir), strategy, PARAMS)


@query()
def anonymize_value_first(spark, sf_dir):
    return anonymized(spark, sf_dir, "value_first").select(
        "id",
        "group_id",
        "pr",
        "sensitive_out",
        "perturb_round",
        "lo",
        "hi",
        "suppressed",
    )


@query()
def anonymize_pattern_first(spark, sf_dir):
    return anonymized(spark, sf_dir, "pattern_first").select(
        "id",
        "group_id",
        "pr",
        "sensitive_out",
        "perturb_round",
        "lo",
        "hi",
        "suppressed",
    )


VIOLATIONS = ("small_group", "small_subgroup", "undiverse", "outside", "lost", "doubled")


@query("SELECT violation, CAST(0 AS BIGINT) AS rows, strategy FROM (VALUES " + ", ".join(f"('{v}', '{s}')" for v in VIOLATIONS for s in pipelines.STRATEGIES) + ") t(violation, strategy)")
def anonymity_audit(spark, sf_dir):
    """How often either pipeline's output breaks a promise: always 0."""
    table = series.part_quarter(spark, sf_dir)
    found = [
        publish.audit(
            anonymized(spark, sf_dir, s),
            table.rows,
            PARAMS.k,
            PARAMS.p,
            PARAMS.l,
        ).withColumn("strategy", F.lit(s)) for s in pipelines.STRATEGIES
    ]
    return found[0].unionByName(found[1])


@query()
def run_report(spark, sf_dir):
    return pipelines.report(series.part_quarter(spark, sf_dir), "pattern_first", PARAMS, "part_quarter")


@query()
def perturb_round_hist(spark, sf_dir):
    """Widening rounds on labels, of which there are few values."""
    table = series.embedding(spark, sf_dir)
    rows = pattern_tree.with_patterns(table, W).select("id", F.col("s2").alias("group_id"), F.lit("all").alias("pr"), "sensitive")
    return diversity.round_histogram(diversity.enforce(rows, 8), (0, 1, 2, 3))


def small_sweep(spark, sf_dir) -> DataFrame:
    return pipelines.sweep({"user_day": series.user_day(spark, sf_dir)}, ((4, 2), (8, 2)))


@query()
def sweep_report(spark, sf_dir):
    """The published grid on three data sets, both strategies; combinations that a table is too small for have their error."""
    tables = {f.__name__: f(spark, sf_dir) for f in (series.part_quarter, series.user_day, series.embedding)}
    return pipelines.sweep(tables, pipelines.GRID)


@query()
def stat_series(spark, sf_dir):
    return pipelines.stat_series(small_sweep(spark, sf_dir), "p", 2, "k")


@query()
def stat_pivot(spark, sf_dir):
    return pipelines.stat_pivot(pipelines.stat_series(small_sweep(spark, sf_dir), "p", 2, "k"))
