"""Column functions on series: normalisation, piecewise means, symbols and their reconstruction (survey rows B1-B12)."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = "abcdef"
MAX_ALPHABET = 6
#: Standard deviations below which a series is left as it is.
FLAT = 0.01
#: Places to which piecewise means are rounded before they become letters, so that two engines agree on ties.
PLACES = 9


def cuts(a: int) -> list[float]:
    """The a - 1 cuts of the standard normal distribution into a parts of equal probability."""
    return [0.0 if 2 * i == a else NormalDist().inv_cdf(i / a) for i in range(1, a)]


def medians(a: int) -> list[float]:
    """The median of each of those parts."""
    return [0.0 if 2 * i + 1 == a else NormalDist().inv_cdf((2 * i + 1) / (2 * a)) for i in range(a)]


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda x, y: x + y)


def znorm(series: Column, threshold: float = FLAT) -> Column:
    """(x - mean) / population standard deviation; unchanged if the deviation is under the threshold."""
    mean = total(series) / F.size(series)
    # arrays of one struct bind mean and deviation, so that each is found once per row
    centred = F.transform(
        F.array(mean), lambda m: F.struct(
            m.alias("m"),
            F.sqrt(total(F.transform(series, lambda x: (x - m) * (x - m))) / F.size(series)).alias("d"),
        )
    )
    bound = F.transform(
        centred, lambda p: F.when(p["d"] < threshold, series).otherwise(F.transform(series, lambda x: (x - p["m"]) / p["d"]))
    )
    return bound[0]


def paa(series: Column, n: int, w: int) -> Column:
    """w means of a series of n values; if w doesn't divide n, border values count in both segments by their share."""
    out = []
    for j in range(w):
        terms = None
        for t in range(n):
            # value t covers places t * w to (t + 1) * w - 1 of n * w, segment j covers j * n to (j + 1) * n - 1
            weight = max(0, min((t + 1) * w, (j + 1) * n) - max(t * w, j * n))
            if weight:
                term = F.get(series, F.lit(t)) * float(weight)
                terms = term if terms is None else terms + term
        out.append(F.round((terms if terms is not None else F.lit(0.0)) / float(n), PLACES) + 0.0)
    return F.array(*out)


def letter(value: Column, a: int) -> Column:
    """The symbol of a value: as many steps after 'a' as there are cuts at or below it."""
    index = sum((F.when(value >= c, 1).otherwise(0) for c in cuts(a)), F.lit(0))
    return F.substr(F.lit(LETTERS), index + 1, F.lit(1))


def sax(means: Column, w: int, a: int) -> Column:
    """The pattern of w piecewise means under an alphabet of a letters; of one letter, w times 'a'."""
    if a <= 1:
        return F.lit("a" * w)
    return F.concat(*(letter(F.get(means, F.lit(j)), a) for j in range(w)))


def letter_indexes(pattern: Column) -> Column:
    """0 for 'a', 1 for 'b', ... of each letter of a pattern."""
    return F.transform(F.split(pattern, ""), lambda c: F.ascii(c) - 97)


def reconstruct(pattern: Column, level: int | None = None) -> Column:
    """The interval medians of a pattern's letters. Without a level the alphabet ends at the greatest letter that occurs."""
    table = F.array(*(F.array(*map(F.lit, medians(a))) for a in range(1, MAX_ALPHABET + 1)))
    indexes = letter_indexes(pattern)
    row = table[level - 1] if level else F.element_at(table, F.array_max(indexes) + 1)
    pair = F.transform(
        F.array(F.struct(row.alias("t"), indexes.alias("i"))), lambda p: F.transform(p["i"], lambda i: F.element_at(p["t"], i + 1))
    )
    return pair[0]


def cosine_distance(u: Column, v: Column) -> Column:
    """1 - cosine; 0 between two zero vectors, 1 if only one is zero. By the norms, so signs and rounding don't matter."""
    dot, uu, vv = total(F.zip_with(u, v, lambda x, y: x * y)), total(F.transform(u, lambda x: x * x)), total(F.transform(v, lambda x: x * x))
    none = 1e-18
    return F.when((uu < none) & (vv < none), 0.0).when((uu < none) | (vv < none), 1.0).otherwise(1.0 - dot / F.sqrt(uu * vv))


def pattern_loss(means: Column, pattern: Column, level: int | None = None) -> Column:
    """How far a published pattern is from the series' piecewise means; 1 for a suppressed row (null pattern)."""
    return F.when(pattern.isNull(), 1.0).otherwise(cosine_distance(means, reconstruct(pattern, level)))


def hamming(p: Column, q: Column) -> Column:
    """Differing places of two patterns, over the shorter of them."""
    n = F.least(F.length(p), F.length(q))
    cut = lambda x: F.split(F.substr(x, F.lit(1), n), "")
    return F.size(F.filter(F.zip_with(cut(p), cut(q), lambda x, y: x != y), lambda x: x))
