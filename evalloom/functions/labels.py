"""Ordinal labels: ranks, medians, distances and distributions, as Column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# They must be these for equal results.
LABELS = ("A", "B", "C", "D")  # D is the most severe
ORDINAL = {"A": 1.0, "A|B": 1.5, "B": 2.0, "B|C": 2.5, "C": 3.0, "C|D": 3.5, "D": 4.0}
SOFT = {
    "A": (1.0, 0.0, 0.0, 0.0),
    "A|B": (0.5, 0.5, 0.0, 0.0),
    "B": (0.0, 1.0, 0.0, 0.0),
    "B|C": (0.0, 0.5, 0.5, 0.0),
    "C": (0.0, 0.0, 1.0, 0.0),
    "C|D": (0.0, 0.0, 0.5, 0.5),
    "D": (0.0, 0.0, 0.0, 1.0),
}
LEVELS = {1: "D", 2: "C", 3: "C", 4: "B", 5: "A", 6: "A"}
GOLD_TEXT = {"A": "A", "B": "B", "C": "C", "D": "D", "A/B": "A|B", "B/C": "B|C", "C/D": "C|D"}
REMOVE, REMOVE_VOTES, DISAGREEMENT = "Remove", 3, 0.75


def lookup(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def is_label(c: Column) -> Column:
    """True for A to D; never null."""
    return F.coalesce(c.isin(*LABELS), F.lit(False))


def rank(c: Column) -> Column:
    """0 to 3, null for anything but a clear label."""
    return F.when(is_label(c), F.ascii(c) - F.ascii(F.lit("A")))


def ordinal(c: Column) -> Column:
    """1.0 to 4.0 in half steps, null for anything else."""
    return F.try_element_at(lookup(ORDINAL), c)


def rating(value: Column) -> Column:
    return F.try_element_at(lookup({v: k for k, v in ORDINAL.items()}), value)


def _half(v: Column) -> Column:
    return F.when(v % 1 != 0, F.lit(0.5)).otherwise(F.lit(0.0))


def set_distance(a: Column, b: Column) -> Column:
    """Squared gap between two ratings, a half step standing for either neighbour."""
    return F.pow(F.greatest(F.lit(0.0), F.abs(a - b) - _half(a) - _half(b)), F.lit(2.0))


def pairs_sum(values: Column) -> Column:
    """Sum of the distances of all pairs of a short array."""
    each = F.transform(values, lambda v, i: F.aggregate(F.slice(values, i + 2, F.size(values)), F.lit(0.0), lambda acc, w: acc + set_distance(v, w)))
    return F.aggregate(each, F.lit(0.0), lambda acc, x: acc + x)


def pairs_mean(values: Column) -> Column:
    """Mean distance of a short array's pairs; 0 where there is no pair."""
    n = F.size(values)
    return F.when(n >= 2, pairs_sum(values) / (n * (n - 1) / 2)).otherwise(F.lit(0.0))


def ordinal_median(values: Column) -> Column:
    """Median on the half-step scale: between two middles their mean if it is a half step, else the upper."""
    s = F.array_sort(values)
    n = F.size(values)
    half = F.floor(n / 2).cast("int")
    return F.when(n == 0, F.lit(None)).otherwise(_middle(n, F.get(s, half - 1), F.get(s, half)))


def _middle(n: Column, lower: Column, upper: Column) -> Column:
    mid = (lower + upper) / 2
    return F.when((n % 2 == 1) | (lower == upper), upper).when(mid.isin(1.5, 2.5, 3.5), mid).otherwise(upper)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def level_label(level: Column) -> Column:
    """(label, is_edge) of a numeric level: a half between two labels is a boundary, others round to even."""
    table = lookup(LEVELS)
    fraction = F.bround(F.pmod(level, F.lit(1.0)), 6)
    low = F.try_element_at(table, F.floor(level).cast("int"))
    high = F.try_element_at(table, (F.floor(level) + 1).cast("int"))
    near = F.coalesce(F.try_element_at(table, F.when(fraction == 0, F.floor(level)).otherwise(F.bround(level, 0)).cast("int")), F.lit("D"))
    edge = F.coalesce((fraction == 0.5) & (low != high), F.lit(False))
    label = F.when(edge, F.concat_ws("|", F.least(low, high), F.greatest(low, high))).when(fraction == 0.5, F.coalesce(low, F.lit("D"))).otherwise(near)
    return F.struct(label.alias("label"), edge.alias("is_edge"))


def soft_distribution(votes: Column) -> Column:
    """Mean soft vector of an array of labels; unknown ones are skipped, none at all is null."""
    known = F.filter(votes, lambda v: F.coalesce(F.trim(v).isin(*SOFT), F.lit(False)))

    def share(k: int) -> Column:
        weights = F.transform(known, lambda v: F.try_element_at(lookup({x: p[k] for x, p in SOFT.items()}), F.trim(v)))
        return F.aggregate(weights, F.lit(0.0), lambda acc, x: acc + x) / F.size(known)

    return F.when(F.size(known) > 0, F.array(*[share(k) for k in range(4)]))


def jensen_shannon(p: Column, q: Column) -> Column:
    """Natural-log divergence of two arrays of probabilities."""
    mid = F.zip_with(p, q, lambda a, b: (a + b) / 2)

    def kl(x: Column) -> Column:
        terms = F.zip_with(x, mid, lambda a, m: F.when((a > 0) & (m > 0), a * F.log(a / m)).otherwise(F.lit(0.0)))
        return F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)

    return 0.5 * kl(p) + 0.5 * kl(q)


def wasserstein(p: Column, q: Column) -> Column:
    """1-Wasserstein distance over ordered bins one apart."""
    gaps = F.zip_with(p, q, lambda a, b: a - b)
    sums = F.transform(F.sequence(F.lit(1), F.size(p)), lambda n: F.abs(F.aggregate(F.slice(gaps, 1, n), F.lit(0.0), lambda acc, x: acc + x)))
    return F.aggregate(sums, F.lit(0.0), lambda acc, x: acc + x)


def consensus_change(votes: Column, prediction: Column, gold: Column) -> Column:
    """(rate, mean_delta) over the votes given: each in turn becomes the prediction; how far does the median move?

    votes: ordinals with nulls for slots left open. Null without a clear prediction, a gold label or a vote.
    """
    p, g = ordinal(F.when(is_label(prediction), prediction)), ordinal(gold)

    def deltas_of(s: Column) -> Column:
        """s: the given votes in order. The k-th of all but the i-th and p is p held between the neighbours it falls between."""
        n = F.size(s)
        half = F.floor(n / 2).cast("int")

        def at(i: Column, k: Column) -> Column:
            other = lambda j: F.get(s, F.when(j < i, j).otherwise(j + 1))
            return F.least(F.greatest(p, F.when(k > 0, other(k - 1))), other(k))

        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.abs(_middle(n, at(i, half - 1), at(i, half)) - g))

    given = F.array_sort(F.filter(votes, lambda v: v.isNotNull()))
    deltas = F.when(p.isNotNull() & (F.size(given) > 0), _let(given, deltas_of)).otherwise(F.array().cast("array<double>"))
    n = F.size(deltas)
    moved = F.size(F.filter(deltas, lambda d: d > 0)) / n
    mean = F.aggregate(deltas, F.lit(0.0), lambda acc, d: acc + d) / n
    return F.when(p.isNotNull() & g.isNotNull() & (n > 0), F.struct(moved.alias("rate"), mean.alias("mean_delta")))
