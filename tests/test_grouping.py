"""Trees, clusters, groups and diversity: against brute force on small tables, and by their invariants."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tsveil.operators import bisect, diversity, pattern_tree
from tsveil.operators.agglomerate import agglomerate, group_block
from tsveil.operators.bisect import Metric
from tsveil.operators.publish import audit, read_published
from tsveil.plans import catalogue, pipelines
from tsveil.plans.pipelines import Params, anonymize, read_stat_file, sweep
from tsveil.sources.series import SeriesTable, read_wide_csv, write_wide_csv
from tsveil.workspace import Workspace

P = 3
SF = "/root/testdata/sf0.001"


def brute_tree(rows, p):
    """{id: (level, pr, status)} of rows {id: [s1..s6]}, by recursion over records."""
    out = {}

    def walk(ids, level, pr):
        n = len(ids)
        if n < p:
            return out.update((i, (level, pr, "bad")) for i in ids)
        if level == 5:
            return out.update((i, (5, pr, "good")) for i in ids)
        if n < 2 * p:
            top = level
            while top < 6 and len({rows[i][top] for i in ids}) == 1:
                top += 1
            new = rows[ids[0]][top - 1] if top > level else pr
            return out.update((i, (top, new, "good")) for i in ids)
        kids = defaultdict(list)
        for i in ids:
            kids[rows[i][level]].append(i)
        small = [i for v in kids.values() if len(v) < p for i in v]
        if all(len(v) < p for v in kids.values()):
            return out.update((i, (level, pr, "good")) for i in ids)
        if len(small) >= p:
            out.update((i, (level, pr, "good")) for i in small)
        else:
            out.update((i, (level + 1, rows[i][level], "bad")) for i in small)
        for k, v in kids.items():
            if len(v) >= p:
                walk(v, level + 1, k)

    walk(sorted(rows), 1, rows[min(rows)][0])
    return out


def random_patterns(n, seed):
    r = random.Random(seed)
    pool = [["aaaa"] + ["".join(r.choice("abcdef"[:a]) for _ in range(4)) for a in range(2, 7)] for _ in range(6)]
    return {i: [x if k == 0 or r.random() < 0.9 else "".join(r.choice("abcdef"[: k + 1]) for _ in range(4)) for k, x in enumerate(r.choice(pool))] for i in range(n)}


@pytest.mark.parametrize(("n", "seed"), [(1, 0), (2, 1), (5, 2), (40, 3), (90, 4)])
def test_split_like_brute_force(spark, n, seed):
    rows = random_patterns(n, seed)
    df = spark.createDataFrame([(i, *v) for i, v in rows.items()], f"id long, {', '.join(f'{c} string' for c in pattern_tree.PATTERNS)}")
    leaves = pattern_tree.split(pattern_tree.classes(df), P, Workspace(spark, "t"))
    got = {r["id"]: (r["level"], r["pr"], r["status"]) for r in pattern_tree.on_records(df, leaves).collect()}
    assert got == brute_tree(rows, P)


def test_split_by_windows_like_level_by_level(spark):
    df = spark.createDataFrame([(i, *v) for i, v in random_patterns(150, 7).items()], f"id long, {', '.join(f'{c} string' for c in pattern_tree.PATTERNS)}")
    found = pattern_tree.classes(df, F.col("id") % 3)
    a, b = (Counter(map(tuple, pattern_tree.split(found, P, Workspace(spark, "t"), n).collect())) for n in (0, 1000))
    assert a == b and len({r[0] for r in a}) == 3 and "open" not in {r[-1] for r in a}


def test_recycling_keeps_every_row(spark):
    rows = random_patterns(70, 9)
    df = spark.createDataFrame([(i, *v) for i, v in rows.items()], f"id long, {', '.join(f'{c} string' for c in pattern_tree.PATTERNS)}")
    out = pattern_tree.on_records(df, pattern_tree.pattern_first_leaves(df, P, Workspace(spark, "t"))).collect()
    assert Counter(r["id"] for r in out) == Counter(list(rows))
    good = Counter((r["node"], r["pr"]) for r in out if r["status"] == "good")
    assert all(n >= P for n in good.values()) and sum(r["status"] == "suppressed" for r in out) < P


@settings(max_examples=30, deadline=None)
@given(st.integers(2, 60), st.integers(1, 6), st.integers(0, 10**6), st.sampled_from(["vl", "ncp"]))
def test_bisect_and_repair(n, size, seed, kind):
    x = np.random.default_rng(seed).integers(0, 4, (n, 3)).astype(float)
    metric = Metric(kind, (3.0, 3.0, 0.0))
    found = bisect.bisect(list(range(n)), x, size, metric, seed)
    assert sorted(np.concatenate([at for _, at in found]).tolist()) == list(range(n))
    assert all(len(at) < 2 * size for _, at in found)
    again = bisect.bisect(list(range(n)), x, size, metric, seed)
    assert [(p, a.tolist()) for p, a in found] == [(p, a.tolist()) for p, a in again]
    fixed = bisect.repair(x, found, size, metric)
    assert sorted(np.concatenate(fixed).tolist()) == list(range(n))
    assert all(len(at) >= min(size, n) for at in fixed)


def test_large_nodes_are_halved(spark):
    rows = spark.createDataFrame([("r", i, [float(i % 7), float(i % 5)]) for i in range(300)], "root string, id long, series array<double>")
    out = bisect.clusters(rows, 5, Metric("vl"), 1, Workspace(spark, "t"), "c", node_rows=40).collect()
    sizes = Counter(r["cluster"] for r in out)
    assert sorted(r["id"] for r in out) == list(range(300)) and min(sizes.values()) >= 5
    same = spark.createDataFrame([("r", i, [1.0]) for i in range(200)], "root string, id long, series array<double>")
    out = bisect.clusters(same, 5, Metric("vl"), 1, Workspace(spark, "t"), "c", node_rows=40).collect()
    assert sorted(r["id"] for r in out) == list(range(200))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 9), min_size=1, max_size=25), st.integers(1, 20))
def test_group_block(sizes, k):
    n = np.array(sizes)
    lo = np.arange(len(n), dtype=float)[:, None]
    group = group_block(n, lo, lo + 1, k)
    if n.sum() < k:
        assert (group == -1).all()
    else:
        assert all(n[group == g].sum() >= k for g in set(group)) and (group >= 0).all()


def test_agglomerate_in_blocks(spark):
    rows = spark.createDataFrame([(i, f"n{i // 3}", "ab" if i < 60 else "ba", [float(i), 0.0]) for i in range(120)], "id long, node string, pr string, series array<double>")
    out = agglomerate(rows, 2, 3, 8, 0, Workspace(spark, "t"), block_subgroups=10).collect()
    sizes = Counter(r["group_id"] for r in out)
    assert sorted(r["id"] for r in out) == list(range(120)) and min(sizes.values()) >= 8
    # blocks of a few subgroups, of which some hold fewer than k rows
    out = agglomerate(rows, 2, 3, 20, 0, Workspace(spark, "t"), block_subgroups=3).collect()
    sizes = Counter(r["group_id"] for r in out)
    assert sorted(r["id"] for r in out) == list(range(120)) and min(sizes.values()) >= 20
    with pytest.raises(ValueError):
        agglomerate(rows.limit(4), 2, 3, 8, 0, Workspace(spark, "t"))


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 9), st.integers(0, 30), min_size=1, max_size=6), st.integers(0, 1000))
def test_drawn_values(wanted, seed):
    found = diversity.drawn(sorted(wanted), sorted(wanted.items()), np.random.default_rng(seed))
    assert [(v, at) for v, at, _, _ in found] == [(v, at) for v, n in sorted(wanted.items()) for at in range(1, n + 1)]
    taken = set(wanted)
    for v, _, new, turn in found:
        # a round is only entered when all nearer values are taken
        assert new not in taken and abs(new - v) <= 3 + turn
        assert not turn or all(v + d in taken for d in range(-2 - turn, 3 + turn))
        taken.add(new)


def test_numbers_in_buckets(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 3 == 0]) for i in range(300)], "id long, k string")
    out = diversity.numbered(rows, ["k"], F.xxhash64("id"))
    at = defaultdict(list)
    for r in out.collect():
        at[r["k"]].append(r["at"])
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in at.values()) and sum(map(len, at.values())) == 300


def test_enforce(spark):
    rows = spark.createDataFrame([(i, "g", "a" if i < 9 else "b", 5 if i < 12 else i) for i in range(20)] + [(90, None, None, 1)], "id long, group_id string, pr string, sensitive long")
    out = {r["id"]: r for r in diversity.enforce(rows, 3).collect()}
    assert len(out) == 21 and out[90]["sensitive_out"] == 1
    for ids in (range(9), range(9, 20)):
        top = Counter(out[i]["sensitive_out"] for i in ids).most_common(1)[0][1]
        assert top * 3 <= len(ids)
    unchanged = diversity.enforce(rows, 1).collect()
    assert all(r["perturb_round"] == 0 for r in unchanged) and {r["sensitive_out"] for r in unchanged if r["id"] < 12} == {5}
    assert {r["id"]: r for r in diversity.enforce(rows, 3).collect()} == out


@pytest.mark.parametrize("strategy", ["value_first", "pattern_first"])
def test_pipelines_keep_their_promises(spark, strategy):
    r = random.Random(5)
    rows = [(i, r.randrange(4), [float(r.randrange(20)) if i % 4 else 3.0 for _ in range(7)]) for i in range(60)]
    table = SeriesTable(spark.createDataFrame(rows, "id long, sensitive long, series array<double>"), 7)
    out = anonymize(table, strategy, Params(6, 3, 4, 2))
    assert [x for x in audit(out, table.rows, 6, 3, 2).collect() if x["rows"]] == []
    small = SeriesTable(table.rows.where(F.col("id") < 4), 7)
    with pytest.raises(ValueError):
        anonymize(small, strategy, Params(6, 3, 4, 2))
    with pytest.raises(ValueError):
        Params(2, 3)


def test_sweep_records_errors(spark):
    table = SeriesTable(spark.createDataFrame([(i, i, [float(i), 1.0]) for i in range(8)], "id long, sensitive long, series array<double>"), 2)
    out = sweep({"t": table}, ((4, 2), (64, 6)), ("value_first",), 2).collect()
    assert [r["error"] is None for r in out] == [True, False] and out[0]["avg_value_loss"] >= 0


def test_stat_file(spark, tmp_path):
    f = tmp_path / "s.txt"
    f.write_text("eta P 6\none 8.3 16 sales\nTwo 4.2 16 sales\n")
    rows = read_stat_file(spark, str(f), ["one", "two"], ["sales"]).collect()
    assert sorted((r["algorithm"], r["value"], r["tuned_value"]) for r in rows) == [("one", 8.3, 16.0), ("two", 4.2, 16.0)]
    with pytest.raises(ValueError):
        read_stat_file(spark, str(f), ["one"], ["sales"])


@pytest.mark.parametrize("strategy", ["value_first", "pattern_first"])
def test_repeated_and_null_ids_are_refused(spark, strategy):
    rows = [(i, i % 4, [float(i % 5), float(i % 7), 1.0]) for i in range(30)]
    for more in ([(3, 1, [1.0, 1.0, 1.0])], [(None, 1, [1.0, 1.0, 1.0])]):
        table = SeriesTable(spark.createDataFrame(rows + more, "id long, sensitive long, series array<double>"), 3)
        with pytest.raises(ValueError, match="occurs 2 times|id is null"):
            anonymize(table, strategy, Params(6, 3, 3, 1))


def test_equal_rows_of_one_id_end(spark):
    rows = spark.createDataFrame([("r", None, [1.0])] * 60, "root string, id long, series array<double>")
    with pytest.raises(ValueError, match="ids repeat"):
        bisect.clusters(rows, 5, Metric("vl"), 1, Workspace(spark, "t"), "c", node_rows=40).collect()


def test_audit_reports_lost_and_doubled_ids(spark):
    schema = "id long, series array<double>, lo array<double>, hi array<double>, group_id string, pr string, sensitive_out long, suppressed boolean"
    out = spark.createDataFrame([(i, [2.0], [1.0], [3.0 if i else 1.5], "g", "a", i, False) for i in (0, 0, 1, 2)], schema)
    original = spark.createDataFrame([(0,), (1,), (2,), (3,), (None,)], "id long")
    found = {r["violation"]: r["rows"] for r in audit(out, original, 5, 5, 2).collect()}
    assert found == {"small_group": 1, "small_subgroup": 1, "undiverse": 0, "outside": 2, "lost": 2, "doubled": 1}


def test_command_line_and_evaluation_of_its_files(spark, tmp_path, monkeypatch, capsys):
    r = random.Random(2)
    rows = spark.createDataFrame([(i, r.randrange(6), [float(r.randrange(9)) for _ in range(6)]) for i in range(40)], "id long, sensitive long, series array<double>")
    path = str(tmp_path / "d.csv")
    write_wide_csv(SeriesTable(rows, 6), path)
    pipelines.main(["pattern_first", "8", "3", "3", "1", path, "--results", str(tmp_path / "results")])
    printed = dict(line.split() for line in capsys.readouterr().out.splitlines())
    saved = spark.read.csv(str(tmp_path / "results/d_pattern_first_k8_P3_paa3_l1.csv"), header=True).first().asDict()
    assert saved == printed and list(saved) == list(pipelines.METRICS)
    table, _ = read_wide_csv(spark, path)
    published = read_published(spark, str(tmp_path / "anonymized/d_pattern_first_anon.csv"))
    assert published.count() == 40 and published.where("suppressed").count() < 3
    inside = published.join(table.rows, "id").where("not suppressed and exists(arrays_zip(series, lo, hi), z -> z.series < z.lo or z.series > z.hi)")
    assert inside.count() == 0
    again = pipelines.evaluate(table, str(tmp_path / "anonymized/d_pattern_first_anon.csv"), 3).first().asDict()
    assert {k: str(v) for k, v in again.items()} == {k: v for k, v in saved.items() if k != "eta"}


def test_sweep_goes_on_after_any_error(spark, monkeypatch):
    def fail(*_):
        raise AnalysisException("no such table")

    monkeypatch.setattr(pipelines, "report", fail)
    out = sweep({"t": SeriesTable(spark.range(1), 1)}, ((1, 1),)).collect()
    assert len(out) == 2 and all("no such table" in r["error"] for r in out)


def test_runs_of_a_sweep_share_steps(spark, monkeypatch):
    r, calls = random.Random(9), Counter()
    rows = [(i, i % 3, [float(r.randrange(9)) for _ in range(4)]) for i in range(30)]
    table = SeriesTable(spark.createDataFrame(rows, "id long, sensitive long, series array<double>"), 4)
    alone = pipelines.report(table, "pattern_first", Params(6, 2, 2), "t").first().asDict()
    for name in ("with_patterns", "clusters", "pattern_first_leaves", "enforce"):
        monkeypatch.setattr(pipelines, name, lambda *a, f=getattr(pipelines, name), n=name: (calls.update([n]), f(*a))[1])
    out = {(r["algorithm"], r["k"], r["p"]): r.asDict() for r in sweep({"t": table}, ((4, 2), (4, 3), (6, 2)), w=2).collect()}
    assert calls == {"with_patterns": 1, "clusters": 2, "pattern_first_leaves": 2}
    assert len(out) == 6 and all(r["error"] is None and r["eta"] > 0 for r in out.values())
    same = out["pattern_first", 6, 2]
    assert all(same[c] == alone[c] for c in pipelines.METRICS if c != "eta")


def test_nearest_groups(spark, monkeypatch):
    monkeypatch.setattr(bisect, "QUERY_GROUPS", 3)
    groups = [(f"g{i}", i + 1, [float(i)], [float(i) + i % 3]) for i in range(9)]
    df = spark.createDataFrame(groups, "gid string, n long, lo array<double>, hi array<double>")

    def nearest(gid, ignored=()):
        _, n, lo, hi = next(g for g in groups if g[0] == gid)
        found = [((n + m) * (max(hi[0], b[0]) - min(lo[0], a[0])), other) for other, m, a, b in groups if other != gid and other not in ignored]
        return min(found)[1]

    assert {r["gid"]: r["nearest"] for r in bisect.nearest_groups(df, df).collect()} == {g[0]: nearest(g[0]) for g in groups}
    some = bisect.nearest_groups(df.where("gid in ('g4', 'g7')"), df, ["g3", "g5"]).collect()
    assert {r["gid"]: r["nearest"] for r in some} == {g: nearest(g, ("g3", "g5")) for g in ("g4", "g7")}


# --- plain Python on a whole fixture


def vl(n, lo, hi):
    return n * math.sqrt(sum((h - x) ** 2 for x, h in zip(lo, hi, strict=True)) / len(lo))


def ncp(widths):
    return lambda n, lo, hi: n * sum((h - x) / w for x, h, w in zip(lo, hi, widths, strict=True) if w > 0)


def box_of(rows):
    return [min(c) for c in zip(*rows, strict=True)], [max(c) for c in zip(*rows, strict=True)]


def plain_bisect(rows, size, loss, seed, path="o"):
    """{path: ids} of rows {id: series}, by recursion."""
    if len(rows) < 2 * size:
        return {path: sorted(rows)}
    order = sorted(sorted(rows), key=lambda i: hashlib.blake2b(f"{seed}:{i}".encode(), digest_size=8).digest())
    sides, last = ([order[0]], []), order[0]
    for turn in range(6):
        free = [i for i in sorted(rows) if i not in sides[0] and i not in sides[1]]
        if not free:
            break
        last = min(free, key=lambda i: (-round(loss(2, *box_of([rows[i], rows[last]])), 9), i))  # noqa: B023
        sides[1 - turn % 2].append(last)
    for i in order:
        if i not in sides[0] and i not in sides[1]:
            a, b = (loss(len(s) + 1, *box_of([rows[j] for j in [*s, i]])) for s in sides)
            sides[0 if a <= b else 1].append(i)
    out = {}
    for side, name in zip(sides, "ab", strict=True):
        own = {i: rows[i] for i in side}
        out |= plain_bisect(own, size, loss, seed, path + name) if len(own) >= size else {path + name: sorted(own)}
    return out


def plain_repair(rows, clusters, size, loss):
    live = {p: list(v) for p, v in clusters.items()}
    whole = lambda *paths: round(loss(sum(len(live[p]) for p in paths), *box_of([rows[i] for p in paths for i in live[p]])), 9)
    while len(live) > 1 and (small := [p for p, v in live.items() if len(v) < size]):
        bad = min(small, key=lambda p: (len(p), p))
        lack, others = size - len(live[bad]), sorted(p for p in live if p != bad)
        mate = bad[:-1] + "ab"[bad[-1] == "a"]
        if mate not in live:
            mate = min(others, key=lambda p: (whole(bad, p), p))
        best, taken_from, taken = whole(bad, mate), mate, None
        for donor in others:
            if len(live[donor]) >= size + lack:
                left, mine = sorted(live[donor]), list(live[bad])
                for _ in range(lack):
                    i = min(left, key=lambda i: (round(loss(len(mine) + 1, *box_of([rows[j] for j in [*mine, i]])), 9), i))  # noqa: B023
                    left.remove(i)
                    mine.append(i)
                found = round(loss(size, *box_of([rows[j] for j in mine])), 9)
                if found < best:
                    best, taken_from, taken = found, donor, mine[len(live[bad]) :]
        if taken is None:
            live[taken_from] += live.pop(bad)
        else:
            live[taken_from] = [i for i in live[taken_from] if i not in taken]
            live[bad] += taken
    return sorted(sorted(v) for v in live.values())


def plain_groups(sizes, boxes, k):
    """Lists of subgroups, greedily joined to k rows or more."""
    join = lambda some: (sum(sizes[i] for i in some), *(box_of([b for i in some for b in boxes[i]])))
    groups, free = [[i] for i in sorted(sizes) if sizes[i] >= k], [i for i in sorted(sizes) if sizes[i] < k]
    while sum(sizes[i] for i in free) >= k:
        group = [min(free, key=lambda i: (round(vl(*join([i])), 9), i))]
        free.remove(group[0])
        while sum(sizes[i] for i in group) < k:
            group.append(min(free, key=lambda i: (round(vl(*join([*group, i])), 9), i)))  # noqa: B023
            free.remove(group[-1])
        groups.append(group)
    for i in free:
        min(groups, key=lambda g: round(vl(*join([*g, i])), 9)).append(i)  # noqa: B023
    return sorted(sorted(g) for g in groups)


@pytest.fixture(scope="module")
def quarters(spark):
    rows = catalogue.patterns(spark, SF)[0].collect()
    return {r["id"]: r for r in rows}


def test_clusters_like_plain_python(spark, quarters):
    rows = {i: list(r["series"]) for i, r in quarters.items()}
    lo, hi = box_of(list(rows.values()))
    loss = ncp([h - x for x, h in zip(lo, hi, strict=True)])
    found = plain_bisect(rows, catalogue.K, loss, 0)
    for name, want in (("topdown_clusters", sorted(found.values())), ("repair_clusters", plain_repair(rows, found, catalogue.K, loss))):
        got = defaultdict(list)
        for r in catalogue.QUERIES[name](spark, SF).collect():
            got[r["cluster"]].append(r["id"])
        assert sorted(map(sorted, got.values())) == want, name
    groups = catalogue.kanon_topdown(spark, SF).collect()
    assert sorted((r["n"], r["loss"]) for r in groups) == sorted((len(v), round(vl(len(v), *box_of([rows[i] for i in v])), 6)) for v in want)


def test_bottomup_like_plain_python(spark, quarters):
    leaves = brute_tree({i: [r[f"s{a}"] for a in range(1, 7)] for i, r in quarters.items()}, P)
    space = Workspace(spark, "t")
    df = catalogue.patterns(spark, SF)[0]
    placed = pattern_tree.on_records(df, pattern_tree.pattern_first_leaves(df, P, space)).collect()
    assert {i for i, (_, _, status) in leaves.items() if status == "good"} <= {r["id"] for r in placed if r["status"] == "good"}
    nodes = defaultdict(dict)
    for r in placed:
        if r["status"] == "good":
            nodes[r["node"]][r["id"]] = list(r["series"])
    sizes, boxes, members = {}, {}, {}
    for node, rows in nodes.items():
        for k, ids in enumerate(plain_repair(rows, plain_bisect(rows, P, vl, 0), P, vl)):
            name = (node, k)
            sizes[name], boxes[name], members[name] = len(ids), box_of([rows[i] for i in ids]), ids
    got = defaultdict(list)
    for r in catalogue.bottomup_groups(spark, SF).collect():
        got[r["group_id"]].append(r["id"])
    want = [sorted(i for s in g for i in members[s]) for g in plain_groups(sizes, boxes, catalogue.K)]
    assert sorted(map(sorted, got.values())) == sorted(want)


def test_enforced_diversity_of_a_whole_fixture(spark, quarters):
    out = {r["id"]: r for r in catalogue.ldiv_enforce(spark, SF).collect()}
    assert set(out) == set(quarters)
    subgroups = defaultdict(list)
    for i, r in quarters.items():
        subgroups[r["s2"], r["s3"]].append(i)
    for ids in subgroups.values():
        before = Counter(quarters[i]["sensitive"] for i in ids)
        changed = [i for i in ids if out[i]["sensitive_out"] != quarters[i]["sensitive"]]
        # as many rows of each value as are over its share get a new value, unlike all others
        assert Counter(quarters[i]["sensitive"] for i in changed) == Counter({v: n - len(ids) // catalogue.L for v, n in before.items() if n * catalogue.L > len(ids)})
        new = [out[i]["sensitive_out"] for i in changed]
        assert len(set(new)) == len(new) and not set(new) & set(before)
        assert all(abs(out[i]["sensitive_out"] - quarters[i]["sensitive"]) <= 3 + out[i]["perturb_round"] for i in changed)
    hist = {r["over"]: r["rows"] for r in diversity.round_histogram(catalogue.ldiv_enforce(spark, SF), (0, 1)).collect()}
    assert hist == {t: sum(r["perturb_round"] > t for r in out.values()) for t in (0, 1)}
