"""Operator 2, n-gram Jaccard join with adaptive multi-match prefixes.

All sets are ordered alike. Of two sets that overlap enough, the prefixes that leave out all but (overlap - m) of either
set share at least m members, for any m (Wang, Li & Feng, SIGMOD 2012). Each set picks its own m from 1 to MATCHES by the estimated cost of
its candidates: a longer prefix meets more lists, but asks for more shared members before a pair is verified. A pair is
held to the smaller m of its two sets, whose prefixes both sets emit. Pairs that pass are verified exactly.

The order: shingles that are frequent come last, the others by their hash. A shingle counts as frequent if it occurs
LOCAL_COUNT times in some stretch of WINDOW shingles of one task; the most frequent FREQUENT of these are sent to all
executors. The order decides how many candidates there are, never which links are found.

Equal sets are one node. For components, lists of one shingle aren't paired off: in each of a few rounds every set of a
list meets the list's leader only, and links found contract; what remains are the pairs between different
components, all of which are then met. So large groups of near copies cost their size, not its square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsveil.llm.base import Words, Workspace, carried, grams, keyed, map_batches, mix, signed, small
from tsveil.llm.components import components

SHINGLE = 5
#: The least similarity, as a fraction in whole numbers.
SIMILARITY = (80, 100)
MATCHES = 4
#: Cost of verifying a candidate, in members of a list met.
VERIFY_COST = 20
LOCAL_COUNT, WINDOW, FREQUENT = 2, 2_000_000, 300_000
#: Rounds of meeting leaders at most, pairs per prefix member beyond which there is another, and the least share of links among a round's candidates to go on.
ROUNDS, PAIRS_PER_MEMBER, USEFUL = 6, 2, 0.02
#: Shared shingles before one that its row lists, so that a pair is met at its first shared shingle only.
BEFORE = 64
#: Nodes that a task remembers, so as not to emit copies again.
SEEN = 200_000


def shingles(h: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles, from those of its words: runs of n words; of fewer words the whole; empty without words."""
    if not len(h):
        return h
    return np.unique(grams(h, n)) if len(h) >= n else mix(grams(h, len(h)) + np.uint64(len(h)))


def name_of(s: np.ndarray) -> int:
    """A 64-bit name of a set: equal for equal sets."""
    total = int(mix(mix(s) + np.uint64(len(s))).sum(dtype=np.uint64)) + len(s) * 0x9E3779B97F4A7C15
    return int(mix(np.array([total & (1 << 64) - 1], np.uint64)).view(np.int64)[0])


def alike(n: str, k: str, similarity: tuple[int, int]) -> Column:
    """Whether sets of sizes n and k can be similar enough."""
    a, b = similarity
    return F.least(n, k) * b >= F.greatest(n, k) * a


def lists_of(column: pa.Array) -> list[np.ndarray]:
    """The lists of a column as arrays."""
    return np.split(column.flatten().to_numpy(), np.cumsum(column.value_lengths().to_numpy())[:-1])


class Join:
    """The steps shared by linked_pairs() and link_components(); see the module's text."""

    def __init__(self, df: DataFrame, id_col: str, text_col: str, shingle: int, similarity: tuple[int, int]):
        if not 0 < similarity[0] <= similarity[1]:
            raise ValueError("the similarity must be over 0 and at most 1")
        self.spark, self.shingle, self.similarity = df.sparkSession, shingle, similarity
        self.space = Workspace(self.spark, "jaccard")
        self.own = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("t", F.xxhash64("text"))
        self.id_kind = dict(df.dtypes)[id_col]
        self.sets()
        self.prefixes()

    def overlap(self, n: str) -> Column:
        a, b = self.similarity
        return F.expr(f"({a}L * {n} + {b - 1}L) div {b}L")

    def reach(self, n: str, m: str) -> Column:
        """Members of the prefix of a set of n for m matches."""
        return F.col(n) - self.overlap(n) + F.col(m)

    def sets(self) -> None:
        """docs: (id, t, n, node) of each row, t a hash of its text, node null for an empty set; and the frequent shingles, sent to all executors."""
        n_gram = self.shingle

        def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words, held, size = Words(lower=True), [], 0

            def frequent() -> pa.RecordBatch:
                found, counts = np.unique(np.concatenate(held), return_counts=True)
                often = counts >= LOCAL_COUNT
                k = int(often.sum())
                return pa.RecordBatch.from_arrays(
                    [pa.nulls(k, kind), pa.nulls(k, pa.int64()), pa.array(counts[often]), signed(found[often]), pa.array(np.ones(k, bool))],
                    names=names,
                )

            for b in batches:
                kind = b.column(0).type
                sets = [shingles(h, n_gram) for h in words.of(b.column(1))]
                n = np.fromiter(map(len, sets), np.int64, len(sets))
                nodes = pa.array([name_of(s) if len(s) else None for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(2), pa.array(n), nodes, pa.array(np.zeros(len(sets), bool))],
                    names=names,
                )
                held += sets
                size += int(n.sum())
                if size >= WINDOW:
                    yield frequent()
                    held, size = [], 0
            if held:
                yield frequent()

        names = ["id", "t", "n", "node", "shingle"]
        both = self.space.save(map_batches(self.own, describe, f"id {self.id_kind}, t long, n long, node long, shingle boolean"), "docs")
        self.docs = both.where("not shingle").drop("shingle")
        often = both.where("shingle").groupBy("node").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "node").limit(FREQUENT).toArrow()
        values, counts = often["node"].to_numpy().astype(np.int64).view(np.uint64), often["n"].to_numpy()
        order = np.argsort(values)
        self.often = self.spark.sparkContext.broadcast((values[order], counts[order]))

    def prefixes(self) -> None:
        """lists: (node, n, m, shingles, places), a row per set: its prefix's shingles that lie in two sets or more;
        texts: (id, text) of one row per node."""
        n_gram, (a, b_), often = self.shingle, self.similarity, self.often
        least = F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("least")
        firsts = self.docs.where("node is not null").groupBy("node").agg(F.count("*").alias("rows"), least)
        self.firsts = self.space.save(firsts.select("node", "rows", F.col("least.id").alias("first")), "firsts")
        shared = self.firsts.where("rows > 1").select(F.col("node").alias("__node"), "first")
        copies = (
            self.docs.join(shared, F.col("node") == F.col("__node"))
            .where("id <> first")
            .select(F.col("id").alias("__id"), F.col("t").alias("__t"))
            .distinct()
        )
        copies = self.space.save(copies, "copies")
        self.texts = self.own.join(
            small(copies, copies.count()),
            (F.col("id") == F.col("__id")) & (F.col("t") == F.col("__t")),
            "left_anti",
        )

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words, seen = Words(lower=True), set()
            values, counts = often.value
            for batch in batches:
                out: list[tuple] = []
                for h in words.of(batch.column(0)):
                    s = shingles(h, n_gram)
                    n = len(s)
                    name = name_of(s) if n else 0
                    if not n or name in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(name)
                    size = min(n, n - (a * n + b_ - 1) // b_ + MATCHES)
                    key = mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))
                    if len(values):
                        at = np.minimum(np.searchsorted(values, s), len(values) - 1)
                        rank = np.where(values[at] == s, counts[at], 0)
                        order = np.lexsort((key, rank))[:size]
                    else:
                        order = np.argsort(key)[:size]
                    out.append((s[order], np.full(size, name), np.arange(size, dtype=np.int32), np.full(size, n, np.int32)))
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [signed(np.concatenate([o[0] for o in out])), *(pa.array(np.concatenate([o[k] for o in out])) for k in (1, 2, 3))],
                        names=["shingle", "node", "place", "n"],
                    )

        emitted = self.space.save(map_batches(self.texts.select("text"), emit, "shingle long, node long, place int, n int"), "emitted")
        often_met = self.space.save(
            emitted.groupBy("shingle").agg(F.count("*").alias("sets")).where("sets > 1").withColumnRenamed("shingle", "__shingle"),
            "often",
        )
        met = self.space.save(
            (
                emitted.join(keyed(often_met), F.col("shingle") == F.col("__shingle"))
                .select("shingle", "node", "place", "n", "sets")
                .dropDuplicates(["shingle", "node"])
            ),
            "met",
        )
        self.space.drop("emitted")
        # each set's m: the cost of the lists that a prefix meets, and of verifying at most lists / m candidates
        lists = [
            F.sum(
                F.when(F.col("place") < F.col("n") - self.overlap("n") + m, F.col("sets") - 1).otherwise(0)
            ) for m in range(1, MATCHES + 1)
        ]
        priced = met.groupBy("node").agg(F.max("n").alias("n"), *(x.alias(f"c{m}") for m, x in enumerate(lists, 1)))
        costs = [
            F.when(
                F.lit(m) <= self.overlap("n"),
                F.struct((F.col(f"c{m}") * (1 + VERIFY_COST / m)).alias("cost"), F.lit(m).alias("m")),
            ) for m in range(1, MATCHES + 1)
        ]
        chosen = priced.select(F.col("node").alias("__node"), F.least(*costs)["m"].alias("m"))
        inside = met.join(chosen, F.col("node") == F.col("__node")).where(F.col("place") < self.reach("n", "m"))
        lists = inside.groupBy("node").agg(
            F.any_value("n").alias("n"),
            F.any_value("m").alias("m"),
            F.array_sort(F.collect_list(F.struct("place", "shingle"))).alias("list"),
        )
        self.lists = self.space.save(
            lists.select("node", "n", "m", F.col("list.shingle").alias("shingles"), F.col("list.place").alias("places")),
            "lists",
        )
        self.space.drop("met")
        self.n_members = self.lists.agg(F.sum(F.size("shingles"))).first()[0] or 0

    def whole(self, nodes: DataFrame, name: str) -> DataFrame:
        """(node, members) of the named nodes: their whole sets, from the text of their first row."""
        n_gram = self.shingle
        nodes = self.space.save(nodes, f"{name}-nodes")
        ids = self.firsts.join(small(nodes, count := nodes.count()), "node", "left_semi").select(F.col("first").alias("__first"))
        chosen = self.own.join(small(ids, count), F.col("id").eqNullSafe(F.col("__first")), "left_semi")

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = Words(lower=True)
            for batch in batches:
                sets = [s for s in (shingles(h, n_gram) for h in words.of(batch.column(0))) if len(s)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    names=["node", "members"],
                )

        # rows that share an id with a named one come along; they name themselves
        return self.space.save(
            map_batches(chosen.select("text"), gather, "node long, members binary").join(small(nodes, count), "node", "left_semi"),
            f"{name}-sets",
        )

    def reaching(self, rows: DataFrame) -> DataFrame:
        """Of rows (members' columns of x and y) for a shared shingle those whose pair can still be similar.

        As all sets have one order, what two sets share before a shared shingle lies in both prefixes: it is at most the
        smaller rank of the shingle, and what they share behind it at most the shorter rest.
        """
        low = F.least("m_x", "m_y")
        rest = F.least(F.col("n_x") - F.col("place_x"), F.col("n_y") - F.col("place_y")) - 1
        inside = (
            F.col("place_x") < F.col("n_x") - self.overlap("n_x") + low
        ) & (F.col("place_y") < F.col("n_y") - self.overlap("n_y") + low)
        return rows.where(inside & (F.least("rank_x", "rank_y") + rest >= self.needed()))

    def needed(self) -> Column:
        """The least overlap of similar sets of n_x and n_y members."""
        a, b_ = self.similarity
        return F.expr(f"({a}L * (n_x + n_y) + {a + b_ - 1}L) div {a + b_}L")

    def prefix_matches(self, pairs: DataFrame) -> DataFrame:
        """Of distinct pairs (x, y) those whose prefixes for the smaller m share m shingles, and that can reach the overlap with what lies behind the last of these."""
        x = self.lists.select(*(F.col(c).alias(f"{c}_x") for c in self.lists.columns))
        y = self.lists.select(*(F.col(c).alias(f"{c}_y") for c in self.lists.columns))
        rows = (
            pairs.join(x, F.col("x") == F.col("node_x"))
            .join(y, F.col("y") == F.col("node_y"))
            .select("x", "y", "n_x", "m_x", "shingles_x", "places_x", "n_y", "m_y", "shingles_y", "places_y")
        )
        a, b_ = self.similarity

        def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                nx, mx, ny, my = (batch.column(c).to_numpy().tolist() for c in (2, 3, 6, 7))
                sx, px, sy, py = (lists_of(batch.column(c)) for c in (4, 5, 8, 9))
                for i in range(batch.num_rows):
                    n, k, low = nx[i], ny[i], min(mx[i], my[i])
                    to_x = np.searchsorted(px[i], n - (a * n + b_ - 1) // b_ + low)
                    to_y = np.searchsorted(py[i], k - (a * k + b_ - 1) // b_ + low)
                    both, at_x, at_y = np.intersect1d(sx[i][:to_x], sy[i][:to_y], assume_unique=True, return_indices=True)
                    if len(both) >= low:
                        rest = min(n - int(px[i][at_x.max()]), k - int(py[i][at_y.max()])) - 1
                        if len(both) + rest >= (a * (n + k) + a + b_ - 1) // (a + b_):
                            keep.append(i)
                at = pa.array(keep, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["x", "y"])

        return map_batches(rows, test, "x long, y long")

    def verified(self, pairs: DataFrame, name: str) -> DataFrame:
        """(x, y, shared, size) of the saved pairs that are similar enough, by their whole sets."""
        a, b_ = self.similarity
        whole = self.whole(pairs.select(F.explode(F.array("x", "y")).alias("node")).distinct(), name)
        x = whole.select(F.col("node").alias("__x"), F.col("members").alias("mx"))
        y = whole.select(F.col("node").alias("__y"), F.col("members").alias("my"))
        rows = pairs.join(x, F.col("x") == F.col("__x")).join(y, F.col("y") == F.col("__y")).select("x", "y", "mx", "my")

        def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep, shared, size = [], [], []
                for i, (p, q) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                    p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    if both * b_ >= a * (len(p) + len(q) - both):
                        keep.append(i)
                        shared.append(both)
                        size.append(len(p) + len(q) - both)
                at = pa.array(keep, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(shared, pa.int64()), pa.array(size, pa.int64())],
                    names=["x", "y", "shared", "size"],
                )

        found = self.space.save(map_batches(rows, test, "x long, y long, shared long, size long"), f"{name}-links")
        self.space.drop(f"{name}-sets")
        return found

    def cross_pairs(self, labelled: DataFrame) -> DataFrame:
        """Candidate pairs (x, y) of different labels; labelled: see labelled().

        On each list, sets outside the list's most frequent label meet all sets of other labels, so a list of one label costs nothing.
        """
        counts = labelled.groupBy("shingle", "c").count()
        top = (
            counts.groupBy("shingle")
            .agg(F.max(F.struct("count", "c"))["c"].alias("top"), F.count("*").alias("labels"))
            .where("labels > 1")
            .select(F.col("shingle").alias("__shingle"), "top")
        )
        rows = (
            labelled.join(top, F.col("shingle") == F.col("__shingle"))
            .withColumn("odd", F.col("c") != F.col("top"))
            .drop("__shingle", "top")
        )
        one = rows.where("odd").select(*(F.col(c).alias(f"{c}_x") for c in rows.columns))
        two = rows.select(*(F.col(c).alias(f"{c}_y") for c in rows.columns))
        meet = (F.col("shingle_x") == F.col("shingle_y")) & (F.col("c_x") != F.col("c_y")) & (
            ~F.col("odd_y") | (F.col("node_x") < F.col("node_y"))
        ) & alike("n_x", "n_y", self.similarity)
        # a pair is met at its first shared shingle; again only where the shingles before aren't listed
        first = F.col("before_x").isNull() | F.col("before_y").isNull() | ~F.arrays_overlap("before_x", "before_y")
        pairs = (
            self.reaching(one.join(two, meet & first))
            .select(F.least("node_x", "node_y").alias("x"), F.greatest("node_x", "node_y").alias("y"))
            .distinct()
        )
        return self.prefix_matches(self.space.save(pairs, "met-pairs"))

    def labelled(self, labels: DataFrame | None) -> DataFrame:
        """(shingle, node, place, n, m, rank, before, c): the members of all lists with their set's label c, its own node if it has none.

        Labels are joined to sets, not to members. rank counts a set's members; before lists its first ones (null if they are over BEFORE).
        """
        if labels is None:
            sets = self.lists.withColumn("c", F.col("node"))
        else:
            known = labels.select(F.col("node").alias("__labelled"), F.col("c").alias("__label"))
            sets = self.lists.join(known, F.col("node") == F.col("__labelled"), "left").withColumn("c", F.coalesce("__label", "node"))
        members = sets.select("node", "n", "m", "c", "shingles", F.posexplode(F.arrays_zip("shingles", "places")).alias("at", "member"))
        before = F.when(F.col("at") <= BEFORE, F.slice("shingles", F.lit(1), F.col("at")))
        return members.select(
            "member.shingles",
            "node",
            "member.places",
            "n",
            "m",
            (F.col("at") + 1).alias("rank"),
            before.alias("before"),
            "c",
        ).toDF("shingle", "node", "place", "n", "m", "rank", "before", "c")

    def linked(self, links: DataFrame, labels: DataFrame | None, name: str) -> DataFrame:
        """The labels after links (x, y) between labelled nodes."""
        if labels is None:
            return components(links, self.space, name)
        at = labels.select(F.col("node").alias("__n"), "c")
        ends = (
            links.join(at, F.col("x") == F.col("__n"), "left")
            .select(F.coalesce("c", "x").alias("x"), "y")
            .join(at, F.col("y") == F.col("__n"), "left")
            .select("x", F.coalesce("c", "y").alias("y"))
        )
        new = components(ends, self.space, name).select(F.col("node").alias("__n"), F.col("c").alias("to"))
        every = labels.unionByName(
            (
                links.select(F.explode(F.array("x", "y")).alias("node"))
                .distinct()
                .join(labels, "node", "left_anti")
                .select("node", F.col("node").alias("c"))
            )
        )
        return self.space.save(
            every.join(new, F.col("c") == F.col("__n"), "left").select("node", F.coalesce("to", "c").alias("c")),
            f"{name}-labels",
        )

    def labels(self) -> DataFrame | None:
        """(node, c) of the components, for nodes that have a link."""
        labels = None
        for turn in range(ROUNDS):
            rows = self.space.save(self.labelled(labels).drop("before"), f"rows{turn}")
            counts = (
                rows.groupBy("shingle", "c")
                .count()
                .groupBy("shingle")
                .agg(F.sum("count").alias("sets"), F.sum(F.col("count") * F.col("count")).alias("squares"), F.count("*").alias("labels"))
            )
            lists = self.space.save(
                counts.where("labels > 1").select(
                    F.col("shingle").alias("list"),
                    ((F.col("sets") * F.col("sets") - F.col("squares")) / 2).alias("pairs"),
                ),
                f"lists{turn}",
            )
            pairs, n_lists = lists.agg(F.sum("pairs"), F.count("*")).first()
            if (pairs or 0) <= PAIRS_PER_MEMBER * self.n_members:
                break
            # twice as many leaders per set as in the round before, for fewer sets
            own = rows.join(
                small(lists.select("list"), n_lists),
                F.col("shingle") == F.col("list"),
                "left_semi",
            ).withColumn("seat", F.pmod(F.xxhash64("shingle"), F.lit(2 << turn)))
            # by turns the set with fewest members of its own before the shingle, which is nearest to the others, or any
            own_members = (F.col("place") - F.col("rank") if turn % 2 == 0 else F.lit(0)).alias("own")
            order = F.xxhash64("node", F.lit(turn), "seat").alias("order")
            lead = own.groupBy("shingle").agg(
                F.min(F.struct(own_members, order, F.col("node").alias("y"), F.col("n").alias("k"), F.col("c").alias("d"))).alias("lead")
            )
            lead = lead.select(F.col("shingle").alias("__shingle"), "lead.y", "lead.k", "lead.d")
            met = (
                own.join(lead, F.col("shingle") == F.col("__shingle"))
                .where((F.col("c") != F.col("d")) & alike("n", "k", self.similarity))
                .select(F.least("node", "y").alias("x"), F.greatest("node", "y").alias("y"))
                .distinct()
            )
            candidates = self.space.save(self.prefix_matches(met), f"pairs{turn}")
            links = self.verified(candidates, f"turn{turn}")
            n_links, n_candidates = links.count(), candidates.count()
            if n_links:
                labels = self.linked(links, labels, f"turn{turn}")
            self.space.drop(f"rows{turn}", f"lists{turn}")
            if n_links <= USEFUL * n_candidates:
                break
        pairs = self.space.save(self.cross_pairs(self.labelled(labels)), "pairs")
        links = self.verified(pairs, "last")
        return labels if links.isEmpty() else self.linked(links, labels, "last")


def components_of_rows(df: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """(id, t, n, component) of each row of df; t: a hash of its text."""
    join = Join(df, id_col, text_col, shingle, similarity)
    labels = join.labels()
    join.space.drop("copies", "often", "lists", "pairs", "met-pairs")
    firsts = join.firsts.select(F.col("node").alias("__node"), "first")
    if labels is not None:
        named = firsts.join(labels, F.col("__node") == F.col("node")).select("__node", "c", "first")
        best = named.groupBy("c").agg(F.min("first").alias("least")).withColumnRenamed("c", "__c")
        linked = named.join(best, F.col("c") == F.col("__c")).select(F.col("__node").alias("__linked"), "least")
        firsts = firsts.join(linked, F.col("__node") == F.col("__linked"), "left").select(
            "__node",
            F.coalesce("least", "first").alias("first"),
        )
    out = join.docs.join(firsts, F.col("node") == F.col("__node"), "left")
    return out.select("id", "t", "n", F.coalesce("first", "id").alias("component"))


def link_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """One row per row of df: id_col, n_shingles (of its set), component_id (the least id reachable by links, its own included).

    Two rows link if similarity[1] * |A and B| >= similarity[0] * |A or B| for their sets of shingles. A text without words, or
    null, has the empty set and links with nothing; its component is its own id. A null id is never the least one while
    there is another. Rows that repeat an id keep their own sets; equal sets always link. An empty table gives an empty
    result. Other columns aren't read.
    """
    rows = components_of_rows(df, id_col, text_col, shingle, similarity)
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def linked_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(pairs, classes): all links between different sets, as (left_id, right_id, shared, size) of the least ids of the sets;
    and (id_col, n_shingles, class_id) of every row, class_id being the least id of its set (null for an empty set).
    Links between rows of one class aren't listed: they hold for all of them. The number of pairs is that of the links."""
    join = Join(df, id_col, text_col, shingle, similarity)
    links = join.verified(join.space.save(join.cross_pairs(join.labelled(None)), "pairs"), "last").distinct()
    x, y = (join.firsts.select(F.col("node").alias(f"__{s}"), F.col("first").alias(f"f{s}")) for s in "xy")
    pairs = (
        links.join(x, F.col("x") == F.col("__x"))
        .join(y, F.col("y") == F.col("__y"))
        .select(F.least("fx", "fy").alias("left_id"), F.greatest("fx", "fy").alias("right_id"), "shared", "size")
    )
    at = join.firsts.select(F.col("node").alias("__node"), "first")
    classes = join.docs.join(at, F.col("node") == F.col("__node"), "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.col("first").alias("class_id"),
    )
    return pairs, classes


def keep_firsts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df, all columns unchanged, that have the least id of their component (of equal ids all stay)."""
    rows = components_of_rows(df, id_col, text_col).where(~F.col("id").eqNullSafe(F.col("component")))
    gone = Workspace(df.sparkSession, "firsts").save(rows.select(F.col("id").alias("__id"), F.col("t").alias("__t")).distinct(), "gone")
    return (
        carried(df, id_col, text_col)
        .join(small(gone, gone.count()), F.col("id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__t")), "left_anti")
        .select("row.*")
    )


def components_sql(source: str = "documents") -> str:
    """DuckDB SQL for link_components() over unique ids, by comparing all sets that share a shingle."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
    a, b = SIMILARITY
    return f"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, {words} AS words FROM {source}
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(words[p:p + {SHINGLE - 1}], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - {SHINGLE - 1}, least(len(words), 1)) + 1)) AS p FROM w)
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), links AS MATERIALIZED (
  SELECT x.doc_id AS x, y.doc_id AS y FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id
  JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id HAVING {b} * count(*) >= {a} * (any_value(nx.n) + any_value(ny.n) - count(*))
), reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(w.doc_id, min(r.y)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN reach r ON r.x = w.doc_id GROUP BY w.doc_id
"""
