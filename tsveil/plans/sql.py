"""DuckDB SQL for the registered queries: common table expressions for fixtures, patterns and trees, written apart from the Spark code."""

from __future__ import annotations

#: Fixed values, written apart from those of the Spark code: quantiles of the standard normal distribution (cuts and medians of
#: parts of equal probability, by alphabet), the deviation under which a series stays as it is, places of means, fixtures.
CUTS = {
    1: [],
    2: [0.0],
    3: [-0.43072729929545744, 0.43072729929545733],
    4: [-0.6744897501960817, 0.0, 0.6744897501960817],
    5: [-0.8416212335729142, -0.2533471031357998, 0.2533471031357998, 0.8416212335729142],
    6: [-0.9674215661017014, -0.43072729929545744, 0.0, 0.43072729929545733, 0.9674215661017014],
}
MEDIANS = {
    1: [0.0],
    2: [-0.6744897501960817, 0.6744897501960817],
    3: [-0.9674215661017014, 0.0, 0.9674215661017014],
    4: [-1.1503493803760079, -0.31863936396437514, 0.31863936396437514, 1.1503493803760079],
    5: [-1.2815515655446008, -0.5244005127080407, 0.0, 0.5244005127080407, 1.2815515655446008],
    6: [-1.3829941271006387, -0.6744897501960817, -0.2104283942479247, 0.21042839424792484, 0.6744897501960817, 1.382994127100638],
}
FLAT, PLACES, MAX_ALPHABET = 0.01, 9, 6
FIRST_YEAR, QUARTERS, FIRST_DAY, DAYS, DIMENSIONS = 1995, 28, "2024-01-01", 30, 64

LEVELS = range(1, MAX_ALPHABET + 1)
PATTERN_COLUMNS = ", ".join(f"s{a}" for a in LEVELS)


def fixture(name: str) -> tuple[str, int]:
    """(CTE f(id, sensitive, series), length)."""
    if name == "part_quarter":
        sums = ", ".join(f"sum(l_quantity) FILTER (WHERE q = {k}) AS q{k}" for k in range(QUARTERS))
        series = ", ".join(f"coalesce(q{k}, 0.0)" for k in range(QUARTERS))
        return f"""f AS (
  SELECT p_partkey AS id, CAST(p_size AS BIGINT) AS sensitive, CAST([{series}] AS DOUBLE[]) AS series FROM part LEFT JOIN (
    SELECT l_partkey, {sums} FROM (SELECT l_partkey, l_quantity, (year(l_shipdate) - {FIRST_YEAR}) * 4 + quarter(l_shipdate) - 1 AS q FROM lineitem) GROUP BY l_partkey
  ) ON p_partkey = l_partkey)""", QUARTERS
    if name == "user_day":
        counts = ", ".join(f"count(*) FILTER (WHERE d = {k})" for k in range(DAYS))
        return f"""f AS (
  SELECT user_id AS id, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS sensitive, CAST([{counts}] AS DOUBLE[]) AS series
  FROM (SELECT user_id, event_type, date_diff('day', DATE '{FIRST_DAY}', CAST(ts AS DATE)) AS d FROM events) GROUP BY user_id)""", DAYS
    return "f AS (SELECT vec_id AS id, CAST(label AS BIGINT) AS sensitive, CAST(embedding AS DOUBLE[]) AS series FROM embeddings)", DIMENSIONS


def paa(column: str, n: int, w: int) -> str:
    parts = []
    for j in range(w):
        terms = [f"{column}[{t + 1}] * {float(x)}" for t in range(n) if (x := max(0, min((t + 1) * w, (j + 1) * n) - max(t * w, j * n)))]
        parts.append(f"round(({' + '.join(terms)}) / {float(n)}, {PLACES}) + 0.0")
    return f"[{', '.join(parts)}]"


def sax(w: int, a: int) -> str:
    if a == 1:
        return f"'{'a' * w}'"
    index = lambda j: " + ".join(f"CAST(means[{j + 1}] >= {c!r} AS INTEGER)" for c in CUTS[a])
    return " || ".join(f"substr('abcdef', 1 + {index(j)}, 1)" for j in range(w))


def base(name: str, w: int = 6) -> str:
    """CTEs f, and r(id, sensitive, series, zs, means, s1..s6)."""
    f, n = fixture(name)
    return f"""{f}, f1 AS (SELECT *, list_sum(series) / len(series) AS m FROM f
), f2 AS (SELECT *, sqrt(list_sum(list_transform(series, lambda x: (x - m) * (x - m))) / len(series)) AS d FROM f1
), z AS (SELECT id, sensitive, series, CASE WHEN d < {FLAT} THEN series ELSE list_transform(series, lambda x: (x - m) / d) END AS zs FROM f2
), p AS MATERIALIZED (SELECT *, {paa("zs", n, w)} AS means FROM z
), r AS MATERIALIZED (SELECT *, {", ".join(f"{sax(w, a)} AS s{a}" for a in LEVELS)} FROM p)"""


def exploded(source: str, column: str, n: int, value: str = "round(v, 6) + 0.0", name: str = "value") -> str:
    return f"SELECT id, CAST(pos AS BIGINT) AS pos, {value} AS {name} FROM (SELECT id, unnest(range(0, {n})) AS pos, unnest({column}) AS v FROM {source})"


def envelope(group: str, n: int, source: str = "r", extra: str = "") -> str:
    """SELECT of (gid, n, lo, hi)."""
    lo = ", ".join(f"min(series[{k + 1}])" for k in range(n))
    hi = ", ".join(f"max(series[{k + 1}])" for k in range(n))
    return f"SELECT {group} AS gid{extra}, count(*) AS n, [{lo}] AS lo, [{hi}] AS hi FROM {source} GROUP BY {group}"


def value_loss(n: str, lo: str, hi: str) -> str:
    return f"({n} * sqrt(list_sum(list_transform(list_zip({hi}, {lo}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) / len({lo})))"


def medians_of(pattern: str, w: int = 6) -> str:
    """The reconstruction of a pattern, by the alphabet up to its greatest letter."""
    table = "[" + ", ".join("[" + ", ".join(repr(m) for m in MEDIANS[a]) + "]" for a in LEVELS) + "]"
    top = f"greatest({', '.join(f'ascii(substr({pattern}, {j + 1}, 1)) - 96' for j in range(w))})"
    return "[" + ", ".join(f"({table})[{top}][ascii(substr({pattern}, {j + 1}, 1)) - 96]" for j in range(w)) + "]"


def cosine(u: str, v: str) -> str:
    dot = f"list_sum(list_transform(list_zip({u}, {v}), lambda z: z[1] * z[2]))"
    uu, vv = (f"list_sum(list_transform({x}, lambda e: e * e))" for x in (u, v))
    return f"(CASE WHEN {uu} < 1e-18 AND {vv} < 1e-18 THEN 0.0 WHEN {uu} < 1e-18 OR {vv} < 1e-18 THEN 1.0 ELSE 1.0 - {dot} / sqrt({uu} * {vv}) END)"


def hamming(a: str, b: str, w: int = 6) -> str:
    return "(" + " + ".join(f"CAST(substr({a}, {j + 1}, 1) <> substr({b}, {j + 1}, 1) AS INTEGER)" for j in range(w)) + ")"


def run_of(level: int) -> str:
    """The highest level up to which a node has one pattern at each level after `level`."""
    out = str(MAX_ALPHABET)
    for a in range(MAX_ALPHABET, level, -1):
        out = f"CASE WHEN same{a} THEN {out} ELSE {a - 1} END"
    return out


def pattern_at(level: str) -> str:
    return f"CASE {level} " + " ".join(f"WHEN {a} THEN s{a}" for a in LEVELS) + " END"


def tree(p: int, source: str = "r", root: str = "'r'") -> str:
    """CTEs up to leaves(root, s1..s6, id, node, level, pr, status)."""
    keep = f"root, {PATTERN_COLUMNS}, id"
    out = [
        f"o1 AS (SELECT CAST({root} AS VARCHAR) AS root, {PATTERN_COLUMNS}, id, CAST({root} AS VARCHAR) AS node, 1 AS level, s1 AS pr FROM {source})"
    ]
    for level in range(1, 5):
        child = f"s{level + 1}"
        same = ", ".join(
            f"min(s{a}) OVER (PARTITION BY node) = max(s{a}) OVER (PARTITION BY node) AS same{a}" for a in range(2, MAX_ALPHABET + 1)
        )
        out.append(
            f"w{level} AS (SELECT *, count(*) OVER (PARTITION BY node) AS nn, count(*) OVER (PARTITION BY node, {child}) AS c, {same} FROM o{level})"
        )
        out.append(
            f"x{level} AS (SELECT *, max(c) OVER (PARTITION BY node) AS mx, sum(CAST(c < {p} AS INTEGER)) OVER (PARTITION BY node) AS tb, {run_of(level)} AS run FROM w{level})"
        )
        out.append(f"""y{level} AS (SELECT {keep},
  CASE WHEN nn < {2 * p} OR mx < {p} THEN node WHEN c < {p} AND tb >= {p} THEN node || '/tb' ELSE node || '/' || {child} END AS node,
  CASE WHEN nn < {p} THEN {level} WHEN nn < {2 * p} THEN run WHEN mx < {p} OR (c < {p} AND tb >= {p}) THEN {level} ELSE {level + 1} END AS level,
  CASE WHEN nn < {p} THEN pr WHEN nn < {2 * p} THEN CASE WHEN run > {level} THEN {pattern_at("run")} ELSE pr END WHEN mx < {p} OR (c < {p} AND tb >= {p}) THEN pr ELSE {child} END AS pr,
  CASE WHEN nn < {p} THEN 'bad' WHEN nn < {2 * p} OR mx < {p} OR (c < {p} AND tb >= {p}) THEN 'good' WHEN c < {p} THEN 'bad' ELSE 'open' END AS status FROM x{level})""")
        out.append(f"o{level + 1} AS (SELECT {keep}, node, level, pr FROM y{level} WHERE status = 'open')")
    parts = [f"SELECT {keep}, node, level, pr, status FROM y{level} WHERE status <> 'open'" for level in range(1, 5)]
    out.append("leaves AS (" + " UNION ALL ".join([*parts, f"SELECT {keep}, node, level, pr, 'good' AS status FROM o5"]) + ")")
    return ", ".join(out)


def merged() -> str:
    """CTEs up to placed(root, id, level, pr, status) after merging bad leaves, from leaves."""
    return f"""sizes AS (SELECT root, node, level, pr, status, count(*) AS n FROM leaves GROUP BY ALL
), near AS (SELECT b.root, b.node, b.level, b.pr, g.level AS to_level, g.pr AS to_pr,
    row_number() OVER (PARTITION BY b.root, b.node, b.level, b.pr ORDER BY {hamming("b.pr", "g.pr")}, g.n, g.node, g.level, g.pr) AS k
  FROM sizes b JOIN sizes g ON g.root = b.root AND b.status = 'bad' AND g.status = 'good'
), placed AS (SELECT l.root, l.id, coalesce(m.to_level, l.level) AS level, coalesce(m.to_pr, l.pr) AS pr, CASE WHEN m.to_pr IS NOT NULL THEN 'good' ELSE l.status END AS status
  FROM leaves l LEFT JOIN near m ON m.k = 1 AND l.status = 'bad' AND m.root = l.root AND m.node = l.node AND m.level = l.level AND m.pr = l.pr)"""


def recycled(p: int) -> str:
    """CTEs up to placed(id, level, pr, status) after recycling bad leaves, from leaves."""
    firsts = ", ".join(f"f{a}" for a in LEVELS)
    first_of = ", ".join(f"arg_min(s{a}, id) AS f{a}" for a in LEVELS)
    out = [
        f"left5 AS (SELECT node AS source, node, level, pr, count(*) AS n, min(id) AS first, {first_of} FROM leaves WHERE status = 'bad' GROUP BY node, level, pr)"
    ]
    for level in range(5, 0, -1):
        up = max(1, level - 1)
        again = ", ".join(f"arg_min(f{a}, first) AS f{a}" for a in LEVELS)
        out.append(f"t{level} AS (SELECT coalesce(sum(n), 0) AS t FROM (SELECT DISTINCT node, pr, n FROM left{level}))")
        out.append(
            f"m{level} AS (SELECT pr AS mpr, sum(n) AS total, min(first) AS mfirst, {again} FROM (SELECT DISTINCT node, pr, n, first, {firsts} FROM left{level} WHERE level = {level}) GROUP BY pr)"
        )
        out.append(
            f"g{level} AS (SELECT l.source, {level} AS level, l.pr FROM left{level} l JOIN m{level} ON mpr = l.pr, t{level} WHERE l.level = {level} AND t >= {p} AND total >= {p})"
        )
        out.append(
            f"left{level - 1} AS (SELECT source, node, level, pr, n, first, {firsts} FROM left{level}, t{level} WHERE level <> {level} OR t < {p} "
            f"UNION ALL SELECT l.source, 'up{level}/' || l.pr, {up}, m.f{up}, m.total, m.mfirst, {', '.join(f'm.f{a}' for a in LEVELS)} FROM left{level} l JOIN m{level} m ON mpr = l.pr, t{level} WHERE l.level = {level} AND t >= {p} AND total < {p})"
        )
    ends = " UNION ALL ".join(
        [
            *(f"SELECT source, level, pr, 'good' AS status FROM g{level}" for level in range(5, 0, -1)),
            "SELECT source, level, pr, 'suppressed' AS status FROM left0",
        ]
    )
    out.append(f"ends AS ({ends})")
    out.append(
        "placed AS (SELECT l.id, coalesce(e.level, l.level) AS level, coalesce(e.pr, l.pr) AS pr, coalesce(e.status, l.status) AS status FROM leaves l LEFT JOIN ends e ON l.status = 'bad' AND e.source = l.node)"
    )
    return ", ".join(out)
