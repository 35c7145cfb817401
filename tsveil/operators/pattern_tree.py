"""The pattern tree: splitting nodes by ever finer patterns, merging and recycling what is too small (survey rows G4-G8).

Rows of equal patterns at all levels always share a leaf, so the tree runs over *classes* (root, s1..s6, n, first id), found
by one aggregation, and never over records. Where no root has many classes, a task holds whole roots and all levels are windows
over them, in one plan. Else a level is one aggregation per node and child and a join back; levels are
written, since each is read twice. Alphabets aren't nested, so children are keyed by their path and pattern.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tsveil.functions.symbolic import MAX_ALPHABET, hamming, paa, sax, znorm
from tsveil.sources.series import SeriesTable
from tsveil.workspace import Workspace

#: The level at which nodes aren't split further.
LAST_LEVEL = 5
#: Classes of a root up to which a task holds the whole root.
ROOT_CLASSES = 100_000
PATTERNS = [f"s{a}" for a in range(1, MAX_ALPHABET + 1)]


def with_patterns(table: SeriesTable, w: int) -> DataFrame:
    """The table's rows with means (w piecewise means of the normalised series) and s1 to s6, the patterns of each alphabet."""
    # the normalised series is a column of its own, so that it is found once a row and not once for each of its values
    normal = table.rows.select("*", znorm(F.col("series")).alias("z_"))
    means = normal.withColumn("means", paa(F.col("z_"), table.length, w)).drop("z_")
    return means.select("*", *(sax(F.col("means"), w, a).alias(f"s{a}") for a in range(1, MAX_ALPHABET + 1)))


def classes(rows: DataFrame, root: Column | None = None) -> DataFrame:
    """(root, s1..s6, n, first): rows of equal patterns under one root; first is their least id."""
    return (
        rows.select((root if root is not None else F.lit("r")).cast("string").alias("root"), *PATTERNS, "id")
        .groupBy("root", *PATTERNS)
        .agg(F.count("*").alias("n"), F.min("id").alias("first"))
    )


def same_run(level: Column) -> Column:
    """The highest level reachable from `level` while every level on the way has one pattern in the node (columns same2..same6)."""
    out = level
    for a in range(2, MAX_ALPHABET + 1):
        out = F.when((out == a - 1) & F.col(f"same{a}"), F.lit(a)).otherwise(out)
    return out


def pattern_at(level: Column, prefix: str = "s") -> Column:
    out = F.col(f"{prefix}1")
    for a in range(2, MAX_ALPHABET + 1):
        out = F.when(level == a, F.col(f"{prefix}{a}")).otherwise(out)
    return out


def split_by_root(found: DataFrame, p: int) -> DataFrame:
    """What split() returns, by windows over each root: one shuffle, and no table in between."""
    at = found.repartition(F.col("root")).select(
        "*", F.col("root").alias("node"), F.lit(1).alias("level"), F.col("s1").alias("pr"), F.lit("open").alias("status")
    )
    node = W.partitionBy("root", "node")
    for level in range(1, LAST_LEVEL):
        child = f"s{level + 1}"
        counted = at.withColumn("c", F.sum("n").over(W.partitionBy("root", "node", child)))
        counted = counted.select(
            "*",
            F.max("c").over(node).alias("largest"),
            F.sum("n").over(node).alias("rows"),
            F.sum(F.when(F.col("c") < p, F.col("n")).otherwise(0)).over(node).alias("rest"),
            *((F.min(f"s{a}").over(node) == F.max(f"s{a}").over(node)).alias(f"same{a}") for a in range(2, MAX_ALPHABET + 1)),
        )
        # all classes of a node have one status; those of a leaf stay as they are
        moved = stepped(level, p)
        at = counted.select(
            "root",
            *PATTERNS,
            "n",
            "first",
            *(F.when(F.col("status") == "open", new).otherwise(F.col(c)).alias(c) for c, new in moved.items()),
        )
    return at.withColumn("status", F.when(F.col("status") == "open", "good").otherwise(F.col("status")))


def stepped(level: int, p: int) -> dict[str, Column]:
    """node, level, pr and status after a level of the tree, of a class with c (rows of its child), largest, rows, rest and same2 to same6 of its node."""
    child = f"s{level + 1}"
    few, small_node = F.col("rows") < p, F.col("rows") < 2 * p
    stays = F.col("largest") < p
    merged = (F.col("c") < p) & (F.col("rest") >= p)
    lost = (F.col("c") < p) & (F.col("rest") < p)
    rest = ~(few | small_node | stays | merged)
    run = same_run(F.lit(level))
    return {
        "node": F.when(few | small_node | stays, F.col("node"))
        .when(merged, F.concat("node", F.lit("/tb")))
        .otherwise(F.concat("node", F.lit("/"), F.col(child))),
        "level": F.when(few, F.lit(level)).when(small_node, run).when(stays | merged, F.lit(level)).otherwise(F.lit(level + 1)),
        "pr": F.when(~few & small_node & (run > level), pattern_at(run)).when(rest, F.col(child)).otherwise(F.col("pr")),
        "status": F.when(few, "bad").when(small_node | stays | merged, "good").when(lost, "bad").otherwise("open"),
    }


def split(found: DataFrame, p: int, space: Workspace, root_classes: int = ROOT_CLASSES) -> DataFrame:
    """classes with node, level, pr and status good or bad, by the rules of the tree; p: rows that a leaf needs."""
    found = space.save(found, "classes")
    if (found.groupBy("root").count().agg(F.max("count")).first()[0] or 0) <= root_classes:
        return space.save(split_by_root(found, p), "leaves")
    open_ = found.select("*", F.col("root").alias("node"), F.lit(1).alias("level"), F.col("s1").alias("pr"))
    done: list[DataFrame] = []
    out = ["root", *PATTERNS, "n", "first", "node", "level", "pr"]
    for level in range(1, LAST_LEVEL):
        child = f"s{level + 1}"
        per = open_.groupBy("node", F.col(child).alias("child")).agg(F.sum("n").alias("c"))
        shares = [
            F.max("c").alias("largest"),
            F.sum("c").alias("rows"),
            F.sum(F.when(F.col("c") < p, F.col("c")).otherwise(0)).alias("rest"),
        ]
        nodes = per.groupBy("node").agg(*shares)
        same = open_.groupBy("node").agg(*((F.min(f"s{a}") == F.max(f"s{a}")).alias(f"same{a}") for a in range(2, MAX_ALPHABET + 1)))
        known = per.join(nodes.join(same, "node"), "node").withColumnsRenamed({"node": "node_", "child": "child_"})
        at = open_.join(known, (F.col("node") == F.col("node_")) & (F.col(child) == F.col("child_")))
        step = at.select("root", *PATTERNS, "n", "first", *(new.alias(c) for c, new in stepped(level, p).items()))
        step = space.save(step, f"step{level}")
        done.append(step.where("status <> 'open'"))
        open_ = step.where("status = 'open'").select(*out)
    done.append(open_.withColumn("status", F.lit("good")))
    every = done[0]
    for part in done[1:]:
        every = every.unionByName(part)
    return space.save(every, "leaves")


def maximize(rows: DataFrame, node: str, level: int) -> DataFrame:
    """(node, n, level, pr) of each node: its level raised while all its rows share one pattern."""
    found = rows.groupBy(F.col(node).alias("node")).agg(
        F.count("*").alias("n"),
        *(F.min(f"s{a}").alias(f"m{a}") for a in range(1, MAX_ALPHABET + 1)),
        *((F.min(f"s{a}") == F.max(f"s{a}")).alias(f"same{a}") for a in range(2, MAX_ALPHABET + 1)),
    )
    return found.withColumn("level", same_run(F.lit(level))).select("node", "n", "level", pattern_at(F.col("level"), "m").alias("pr"))


def nodes_of(leaves: DataFrame, status: str) -> DataFrame:
    """(root, node, level, pr, n, first and f1..f6, the patterns of the first row) of the leaves of one status."""
    first = F.min(F.struct("first", *PATTERNS)).alias("f")
    found = leaves.where(F.col("status") == status).groupBy("root", "node", "level", "pr").agg(F.sum("n").alias("n"), first)
    return found.select(
        "root",
        "node",
        "level",
        "pr",
        "n",
        F.col("f.first").alias("first"),
        *(F.col(f"f.s{a}").alias(f"f{a}") for a in range(1, MAX_ALPHABET + 1)),
    )


def merge_bad(leaves: DataFrame) -> DataFrame:
    """The leaves, each bad one merged into the good leaf of its root whose pattern differs in fewest places.

    Of equally near ones the one of fewer rows (before merging), then of the least node name. Leaves of a root are as
    many as its rows at most, and roots are k-groups here, so pairs stay few. A root without a good leaf raises no error: its rows stay bad.
    """
    good = nodes_of(leaves, "good").select(
        "root",
        F.col("node").alias("to"),
        F.col("level").alias("to_level"),
        F.col("pr").alias("to_pr"),
        F.col("n").alias("size"),
    )
    bad = nodes_of(leaves, "bad").select("root", "node", "level", "pr")
    best = (
        bad.join(good, "root")
        .groupBy("root", "node", "level", "pr")
        .agg(F.min(F.struct(hamming(F.col("pr"), F.col("to_pr")).alias("d"), "size", "to", "to_level", "to_pr")).alias("b"))
    )
    moved = best.select(
        F.col("root").alias("root_"),
        F.col("node").alias("node_"),
        F.col("level").alias("level_"),
        F.col("pr").alias("pr_"),
        "b.to",
        "b.to_level",
        "b.to_pr",
    )
    same = (F.col("status") == "bad") & (F.col("root") == F.col("root_")) & (F.col("node") == F.col("node_")) & (
        F.col("level") == F.col("level_")
    ) & (F.col("pr") == F.col("pr_"))
    rows = leaves.join(moved, same, "left")
    return rows.select(
        "root",
        *PATTERNS,
        "n",
        "first",
        F.coalesce("to", "node").alias("node"),
        F.coalesce("to_level", "level").alias("level"),
        F.coalesce("to_pr", "pr").alias("pr"),
        F.when(F.col("to").isNotNull(), "good").otherwise(F.col("status")).alias("status"),
    )


def recycle(bad: DataFrame, p: int, space: Workspace) -> DataFrame:
    """(source, node, level, pr, status good or suppressed) for each bad node (node, level, pr, n, first, f1..f6).

    From the deepest level up, while p rows or more are bad: bad nodes of a level that share a pattern merge, which makes
    a good leaf of p rows or more; what stays bad moves up a level, under the pattern of its first row there. At level 1
    all patterns are equal, so few rows stay; those are suppressed.
    """
    firsts = [f"f{a}" for a in range(1, MAX_ALPHABET + 1)]
    left = bad.select(F.col("node").alias("source"), F.col("node"), "level", "pr", "n", "first", *firsts)
    done: list[DataFrame] = []
    top = left.agg(F.max("level")).first()[0] or 0
    for level in range(top, 0, -1):
        if total_of(left) < p:
            break
        # of merged nodes the first row is that of the least id
        merged = (
            left.where(F.col("level") == level)
            .dropDuplicates(["node", "pr"])
            .groupBy(F.col("pr").alias("pr_"))
            .agg(F.sum("n").alias("rows"), F.min(F.struct("first", *firsts)).alias("f"))
        )
        joined = left.where(F.col("level") == level).join(merged, F.col("pr") == F.col("pr_"))
        good = joined.where(F.col("rows") >= p).select(
            "source",
            F.concat(F.lit(f"recycled{level}/"), "pr").alias("node"),
            F.lit(level).alias("level"),
            "pr",
            F.lit("good").alias("status"),
        )
        up = F.struct(F.concat(F.lit(f"up{level}/"), "pr").alias("node"), F.lit(max(1, level - 1)).alias("level"))
        stay = joined.where(F.col("rows") < p).select(
            "source",
            up["node"].alias("node"),
            up["level"].alias("level"),
            F.col(f"f.f{max(1, level - 1)}").alias("pr"),
            F.col("rows").alias("n"),
            F.col("f.first").alias("first"),
            *(F.col(f"f.{c}").alias(c) for c in firsts),
        )
        lower = left.where(F.col("level") < level).unionByName(stay).withColumn("status", F.lit(None).cast("string"))
        step = space.save(lower.unionByName(good, allowMissingColumns=True), f"recycled{level}")
        done.append(step.where("status = 'good'").select(*good.columns))
        left = step.where("status is null").drop("status")
        if level == 1:
            break
    out = left.select("source", "node", "level", "pr", F.lit("suppressed").alias("status"))
    for part in done:
        out = out.unionByName(part)
    return out


def total_of(left: DataFrame) -> int:
    """Rows of bad nodes; nodes that merged stand once per source."""
    return left.dropDuplicates(["node", "pr"]).agg(F.sum("n")).first()[0] or 0


def value_first_leaves(rows: DataFrame, root: Column, p: int, space: Workspace) -> DataFrame:
    """The classes of each root's tree, bad leaves merged."""
    return merge_bad(split(classes(rows, root), p, space))


def pattern_first_leaves(rows: DataFrame, p: int, space: Workspace) -> DataFrame:
    """The classes of the tree over all rows, bad leaves recycled; status good or suppressed."""
    leaves = split(classes(rows), p, space)
    again = recycle(nodes_of(leaves, "bad").drop("root"), p, space).select(
        F.col("source").alias("source_"),
        F.col("node").alias("node_"),
        F.col("level").alias("level_"),
        F.col("pr").alias("pr_"),
        F.col("status").alias("status_"),
    )
    rows_ = leaves.join(again, (F.col("status") == "bad") & (F.col("node") == F.col("source_")), "left")
    return space.save(
        rows_.select("root", *PATTERNS, "n", "first", *(F.coalesce(f"{c}_", c).alias(c) for c in ("node", "level", "pr", "status"))),
        "recycled",
    )


def on_records(rows: DataFrame, leaves: DataFrame, root: Column | None = None) -> DataFrame:
    """rows with their leaf's node, level, pr and status, by their patterns (and root)."""
    own = rows.withColumn("root", (root if root is not None else F.lit("r")).cast("string"))
    found = leaves.select(F.col("root").alias("root_"), *(F.col(c).alias(f"{c}_") for c in PATTERNS), "node", "level", "pr", "status")
    meet = F.col("root") == F.col("root_")
    for c in PATTERNS:
        meet = meet & (F.col(c) == F.col(f"{c}_"))
    return own.join(found, meet).drop("root_", *(f"{c}_" for c in PATTERNS))
