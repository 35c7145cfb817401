"""Operator 4, benchmark decontamination by SimHash over item-sized windows. DataFrame functions only.

Words are runs of letters and digits in lower case, so punctuation, case and markup between words don't hide a passage.
A shingle is SHINGLE words (an item of fewer words is one shingle of all of them) and weighs ln(1 + items / items that
hold it), 1 holding it at least. A document contains an item if one of its windows of the item's number of words has a
weighted Jaccard similarity of at least SIMILARITY with it.

1. Documents. What a similar window shares with the item weighs SIMILARITY of the item at least; so does then what the
   whole document shares. An item's lightest shingles, together below that, can be left out at first: documents meet
   items on the others, which are the rarest, so a line that many items share pairs nothing off. Nothing is lost.
2. Windows. In documents of that weight, every window of the item's number of words that holds one of its shingles is
   fingerprinted; all others have similarity 0. A bit of a SimHash is the sign of the weighted votes of all shingles.
3. Multi-index: fingerprints are cut into BLOCKS blocks. Within RADIUS bits, at least one block differs by at most
   RADIUS / BLOCKS bits, so items are listed under each block and all its neighbours that near, and every window meets
   all items of its size within the radius. The radius is over three standard deviations beyond what the least
   similarity makes likely.
4. Verification: the exact weighted similarity of all pairs within the radius.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tsveil.llm.base import Workspace, carried, keyed, small

SHINGLE = 5
SIMILARITY = 0.8
BITS, BLOCKS, RADIUS = 64, 8, 20
WIDTH = BITS // BLOCKS
#: Votes are whole numbers of 1 / SCALE; the lowest bits of both halves of 64. A half holds the votes of over a million shingles.
SCALE, HALVES = 64, (1 << 32) + 1
NOT_A_WORD = r"[^\p{L}\p{N}]+"


def words_of(text: Column) -> Column:
    """The words of a text as an array; empty for null or without words."""
    bare = F.trim(F.regexp_replace(F.lower(text), NOT_A_WORD, " "))
    return F.when(F.coalesce(F.length(bare), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, " "))


def with_grams(df: DataFrame, words: str, size: int) -> DataFrame:
    """A row for each run of `size` words of an array column, instead of it: place, gram (a hash)."""
    n = F.greatest(F.size(words) - (size - 1), F.lit(0))
    runs = F.arrays_zip(*(F.slice(F.col(words), F.lit(i + 1), n).alias(f"w{i}") for i in range(size)))
    kept = [c for c in df.columns if c != words]
    rows = df.where(F.size(words) >= size).select(*kept, F.posexplode(runs).alias("place", "run"))
    return rows.select(*kept, "place", F.xxhash64(*(F.col(f"run.w{i}") for i in range(size)), F.lit(size)).alias("gram"))


def every_gram(df: DataFrame, words: str, sizes: list[int]) -> DataFrame:
    out = with_grams(df, words, sizes[0])
    for size in sizes[1:]:
        out = out.unionByName(with_grams(df, words, size))
    return out


def gram_hashes(words: str, size: int) -> Column:
    """The hashes that with_grams() gives, as an array in the order of places."""
    at = F.sequence(F.lit(1), F.size(words) - (size - 1))
    return F.transform(at, lambda i: F.xxhash64(*(F.element_at(words, i + j) for j in range(size)), F.lit(size)))


def fingerprints(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, print, weight) of rows (keys, gram, w), one per distinct gram.

    A bit is set if the grams that have it weigh over half of all, in whole numbers of 1 / SCALE. The weights of bits b and b + 32
    are added up in the halves of one number.
    """
    part = F.round(F.col("w") * SCALE).cast("bigint")
    both = [F.sum(F.shiftrightunsigned("gram", b).bitwiseAND(F.lit(HALVES)) * F.col("part")).alias(f"v{b}") for b in range(BITS // 2)]
    voted = rows.withColumn("part", part).groupBy(*keys).agg(*both, F.sum("part").alias("parts"), F.sum("w").alias("weight"))
    zero, bits = F.lit(0).cast("bigint"), F.lit(0).cast("bigint")
    for b in range(BITS):
        votes = F.shiftrightunsigned(f"v{b % 32}", 32) if b >= 32 else F.col(f"v{b}").bitwiseAND(F.lit((1 << 32) - 1))
        bits = bits.bitwiseOR(F.when(2 * votes > F.col("parts"), F.lit(1 << b if b < 63 else -(1 << 63)).cast("bigint")).otherwise(zero))
    return voted.select(*keys, bits.alias("print"), "weight")


def blocks(df: DataFrame, flips: int) -> DataFrame:
    """df with a row for each block of its print and each way to flip up to `flips` of the block's bits: block, value."""
    masks = [sum(1 << i for i in some) for n in range(flips + 1) for some in combinations(range(WIDTH), n)]
    cut = F.explode(
        F.array(
            *(
                F.struct(
                    F.lit(b).alias("block"),
                    F.shiftrightunsigned("print", b * WIDTH).bitwiseAND(F.lit((1 << WIDTH) - 1).cast("bigint")).alias("value"),
                ) for b in range(BLOCKS)
            )
        )
    )
    rows = df.withColumn("__at", cut).select(*df.columns, "__at.block", "__at.value")
    return rows if not flips else rows.withColumn("__m", F.explode(F.array(*map(F.lit, masks)))).withColumn(
        "value",
        F.col("value").bitwiseXOR(F.col("__m").cast("bigint")),
    ).drop("__m")


def contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(key and id of df's rows by text; matches): see matches(). key: a hash of a row's id and text."""
    space = Workspace(df.sparkSession, "decontamination")
    own = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("key", F.xxhash64("id", "text"))
    items = benchmark.select(F.col(item_col).alias("item"), words_of(F.col(item_text_col)).alias("words")).where(F.size("words") > 0)
    items = space.save(items.groupBy("words").agg(F.min("item").alias("item")).select("item", "words", F.size("words").alias("n")), "items")
    n_items = items.count()
    short = [r[0] for r in items.where(F.col("n") < SHINGLE).select("n").distinct().orderBy("n").collect()]
    grams = with_grams(items.where(F.col("n") >= SHINGLE), "words", SHINGLE)
    for size in short:
        grams = grams.unionByName(with_grams(items.where(F.col("n") == size), "words", size))
    grams = space.save(grams.select("item", "n", "gram").distinct(), "item-words")
    weights = space.save(grams.groupBy("gram").agg(F.log(1 + F.lit(float(n_items)) / F.count("*")).alias("w")), "weights")
    item_grams = space.save(grams.join(keyed(weights), "gram"), "item-grams")
    n_grams = item_grams.count()
    item_prints = space.save(fingerprints(item_grams, "item", "n").withColumnRenamed("weight", "item_weight"), "item-prints")

    # 1: documents that share enough of an item; rest: the weight of a shingle and of all more frequent ones
    rest = F.sum("w").over(W.partitionBy("item").orderBy("w", "gram"))
    heads = item_grams.withColumn("rest", rest).join(item_prints.select("item", "item_weight"), "item")
    heads = space.save(heads.where(F.col("rest") >= SIMILARITY * F.col("item_weight") - 1e-6).select("gram", "item"), "heads")
    doc_grams = every_gram(own.select("key", words_of(F.col("text")).alias("words")), "words", [SHINGLE, *short])
    known = weights.select(F.col("gram").alias("__gram"))
    hits = space.save(doc_grams.join(keyed(known), F.col("gram") == F.col("__gram")).select("key", "gram", "place").distinct(), "hits")
    pairs = hits.select("key", "gram").distinct().join(small(heads, n_grams), "gram").select("key", "item").distinct()
    matched = space.save(pairs.join(small(item_grams, n_grams), "item").join(hits, ["key", "gram"]), "matched")
    shared = matched.select("key", "item", "gram", "w").distinct().groupBy("key", "item").agg(F.sum("w").alias("shared"))
    heavy = F.round(F.col("shared") / F.col("item_weight"), 9) >= SIMILARITY
    enough = space.save(shared.join(item_prints.select("item", "item_weight"), "item").where(heavy).select("key", "item"), "enough")

    # 2: fingerprints of all their windows with a shared shingle
    gram_words = F.least("n", F.lit(SHINGLE))
    first = F.greatest(F.col("place") - F.col("n") + gram_words, F.lit(0))
    held = matched.join(small(enough, enough.count()), ["key", "item"])
    starts = held.select("key", "n", F.explode(F.sequence(first, F.col("place"))).alias("start"))
    windows = space.save(starts.groupBy("key").agg(F.collect_set(F.struct("n", "start")).alias("windows")), "windows")
    texts = own.join(small(windows.select("key"), windows.count()), "key", "left_semi").dropDuplicates(["key"])
    sizes = [SHINGLE, *short]
    worded = texts.select("key", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    hashed = [
        F.when(
            F.size("words") >= size,
            gram_hashes("words", size),
        ).otherwise(F.array().cast("array<bigint>")).alias(f"h{size}") for size in sizes
    ]
    texts = space.save(worded.select("key", F.size("words").alias("size"), *hashed), "texts")
    unseen = F.log(1 + F.lit(float(n_items)))

    def cut(windows: DataFrame) -> DataFrame:
        """(key, n, start, grams: their distinct shingles) of windows (key, windows: an array of n and start)."""
        met = texts.join(windows.withColumnRenamed("key", "__key"), F.col("key") == F.col("__key"))
        parts = [cut_size(met, size) for size in sizes]
        return reduce(DataFrame.unionByName, parts)

    def cut_size(met: DataFrame, size: int) -> DataFrame:
        def own(x: Column) -> Column:
            inside = x["start"] <= F.greatest(F.col("size") - x["n"], F.lit(0))
            return inside & (F.col("size") >= size) & (x["n"] >= size if size == SHINGLE else x["n"] == size)

        def grams(x: Column) -> Column:
            run = F.slice(f"h{size}", x["start"] + 1, x["n"] - (size - 1))
            return F.struct(x["n"].alias("n"), x["start"].alias("start"), F.array_distinct(run).alias("grams"))

        return met.select("key", F.explode(F.transform(F.filter("windows", own), grams)).alias("x")).select("key", "x.*")

    known = weights.select(F.col("gram").alias("__gram"), "w")
    votes = (
        cut(windows)
        .select("key", "n", "start", F.explode("grams").alias("gram"))
        .join(keyed(known), F.col("gram") == F.col("__gram"), "left")
    )
    votes = votes.select("key", "n", "start", "gram", F.coalesce("w", unseen).alias("w"))
    prints = space.save(fingerprints(votes, "key", "n", "start"), "prints")

    # 3: all windows and items of a size within the radius
    listed = blocks(item_prints.select("item", "n", "print", "item_weight"), RADIUS // BLOCKS).withColumnRenamed("print", "item_print")
    listed = space.save(listed, "listed")
    near = (
        blocks(prints, 0)
        .join(small(listed, listed.count()), ["block", "value", "n"])
        .where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS)
    )
    near = space.save(near.select("key", "n", "start", "weight", "item", "item_weight").distinct(), "near")

    # 4: exact similarity
    kept = cut(near.groupBy("key").agg(F.collect_set(F.struct("n", "start")).alias("windows")))
    lists = item_grams.groupBy("item").agg(F.collect_list(F.struct("gram", "w")).alias("of_item"))
    common = F.filter("of_item", lambda x: F.array_contains("grams", x["gram"]))
    shared = F.aggregate(common, F.lit(0.0), lambda total, x: total + x["w"])
    total = (
        near.join(kept, ["key", "n", "start"])
        .join(small(lists, n_grams), "item")
        .select("key", "n", "start", "item", "weight", "item_weight", shared.alias("shared"))
    )
    similarity = F.round(F.col("shared") / (F.col("weight") + F.col("item_weight") - F.col("shared")), 9)
    best = total.withColumn("similarity", similarity).where(F.col("similarity") >= SIMILARITY)
    best = best.groupBy("key", "item").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), "n")).alias("top"))
    found = space.save(best.select("key", "item", "top.similarity", (-F.col("top.back")).alias("start"), "top.n"), "found")
    space.drop(
        "items",
        "item-words",
        "weights",
        "item-grams",
        "item-prints",
        "heads",
        "hits",
        "matched",
        "enough",
        "windows",
        "texts",
        "prints",
        "listed",
        "near",
    )
    return own, found


def matches(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and benchmark item that it contains: id_col, item_col, similarity (rounded to 6 places), start, n_words (of the
    most similar window, in words; of equal ones the first).

    Null or empty texts and items match nothing. Items of equal words are one item, the least id. A document shorter than
    an item is one window. Rows that repeat id and text give equal rows; rows of one id and other texts are searched apart.
    Texts are read whole. Empty tables give an empty result. Other columns aren't read.
    """
    own, found = contaminated(df, benchmark, id_col, text_col, item_col, item_text_col)
    rows = own.select("id", F.col("key").alias("__key")).join(small(found, found.count()), F.col("__key") == F.col("key"))
    return rows.select(
        F.col("id").alias(id_col),
        F.col("item").alias(item_col),
        F.round("similarity", 6).alias("similarity"),
        F.col("start").cast("long").alias("start"),
        F.col("n").cast("long").alias("n_words"),
    )


def keep_clean(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df, all columns unchanged, that contain no item of the benchmark."""
    _, found = contaminated(df, benchmark, id_col, text_col)
    keys = found.select(F.col("key").alias("__key")).distinct()
    return (
        carried(df, id_col, text_col)
        .join(small(keys, found.count()), F.xxhash64("id", "text") == F.col("__key"), "left_anti")
        .select("row.*")
    )


def matches_sql(source: str = "documents", benchmark: str = "benchmark") -> str:
    """DuckDB SQL for matches(): all windows that hold a shingle of the item are compared exactly, without fingerprints."""
    words = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
    gram = f"array_to_string(words[p:p + g - 1], ' ')"
    return f"""
WITH items AS (
  SELECT min(item_id) AS item, words, len(words) AS n, least(len(words), {SHINGLE}) AS g
  FROM (SELECT item_id, {words} AS words FROM {benchmark}) WHERE len(words) > 0 GROUP BY words
), placed AS (
  SELECT item, n, g, p - 1 AS off, {gram} AS gram FROM (SELECT *, unnest(range(1, n - g + 2)) AS p FROM items)
), weights AS (
  SELECT g, gram, ln(1 + (SELECT count(*) FROM items)::DOUBLE / count(DISTINCT item)) AS w FROM placed GROUP BY g, gram
), item_grams AS (SELECT DISTINCT item, n, g, gram, w FROM placed JOIN weights USING (g, gram)
), item_weights AS (SELECT item, sum(w) AS item_weight FROM item_grams GROUP BY item
), docs AS (SELECT doc_id, words, len(words) AS size FROM (SELECT DISTINCT doc_id, {words} AS words FROM {source})
), doc_grams AS (
  SELECT doc_id, g, p - 1 AS place, {gram} AS gram
  FROM (SELECT doc_id, words, g, unnest(range(1, size - g + 2)) AS p FROM docs, (SELECT DISTINCT g FROM items))
), starts AS (
  SELECT DISTINCT doc_id, item, n, g, unnest(range(greatest(place - n + g, 0), place + 1)) AS start
  FROM (SELECT DISTINCT d.doc_id, p.item, p.n, p.g, d.place FROM doc_grams d JOIN placed p USING (g, gram))
), wins AS (
  SELECT s.* FROM starts s JOIN docs d USING (doc_id) WHERE s.start <= greatest(d.size - s.n, 0)
), win_grams AS (
  SELECT DISTINCT w.doc_id, w.item, w.n, w.start, w.g, d.gram FROM wins w JOIN doc_grams d
  ON d.doc_id = w.doc_id AND d.g = w.g AND d.place >= w.start AND d.place <= w.start + w.n - w.g
), sums AS (
  SELECT x.doc_id, x.item, x.n, x.start, sum(coalesce(k.w, ln(1 + (SELECT count(*) FROM items)::DOUBLE))) AS weight,
         sum(CASE WHEN i.item IS NOT NULL THEN i.w ELSE 0 END) AS shared
  FROM win_grams x LEFT JOIN weights k ON k.g = x.g AND k.gram = x.gram LEFT JOIN item_grams i ON i.item = x.item AND i.gram = x.gram AND i.g = x.g
  GROUP BY ALL
), rated AS (
  SELECT s.*, round(shared / (weight + item_weight - shared), 9) AS similarity FROM sums s JOIN item_weights USING (item)
), best AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item ORDER BY similarity DESC, start) AS r FROM rated WHERE similarity >= {SIMILARITY}
)
SELECT doc_id, item AS item_id, round(similarity, 6) AS similarity, CAST(start AS BIGINT) AS start, CAST(n AS BIGINT) AS n_words FROM best WHERE r = 1
"""
