"""Distributions and vectors as array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x.cast("double"))


def _with(value: Column, use) -> Column:
    """use(value), with the value computed once: a lambda binds it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def softmax(xs: Column, temperature: float = 1.0) -> Column:
    """Softmax of an array, shifted by its maximum. Maximum and sum are bound once, so it is linear in the length."""
    raised = _with(F.array_max(xs).cast("double"), lambda top: F.transform(xs, lambda x: F.exp((x.cast("double") - top) / F.lit(float(temperature)))))
    return _with(raised, lambda r: _with(total(r), lambda s: F.transform(r, lambda x: x / s)))


def entropy(ps: Column) -> Column:
    """Entropy in nats; zero probabilities add nothing."""
    return -total(F.transform(ps, lambda p: F.when(p > 0, p * F.log(p)).otherwise(F.lit(0.0))))


def kl(ps: Column, qs: Column, least: float = 1e-12) -> Column:
    """Kullback-Leibler divergence; probabilities of q are held at least at `least`."""
    return total(F.zip_with(ps, qs, lambda p, q: F.when(p > 0, p * F.log(p / F.greatest(q, F.lit(least)))).otherwise(F.lit(0.0))))


def js(ps: Column, qs: Column) -> Column:
    """Jensen-Shannon divergence."""
    middle = F.zip_with(ps, qs, lambda p, q: (p + q) / 2)
    return 0.5 * kl(ps, middle) + 0.5 * kl(qs, middle)


def top_two_margin(xs: Column) -> Column:
    order = F.reverse(F.array_sort(xs))
    return F.try_element_at(order, F.lit(1)) - F.try_element_at(order, F.lit(2))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, least: float = 1e-12) -> Column:
    """Cosine held in [-1, 1]; null when a norm is no more than `least`."""
    def of(n: Column) -> Column:
        return F.when((n["a"] > least) & (n["b"] > least), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / (n["a"] * n["b"]))))

    return _with(F.struct(norm(a).alias("a"), norm(b).alias("b")), of)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def unit(a: Column, least: float = 1e-12) -> Column:
    """The vector at length 1; null when its norm is no more than `least`."""
    return _with(norm(a), lambda n: F.when(n > least, F.transform(a, lambda x: x.cast("double") / n)))


def mean_vector(vectors: Column, width: int) -> list[Column]:
    """Aggregates for the mean of each of the `width` dimensions."""
    return [F.avg(vectors[i].cast("double")).alias(f"m{i}") for i in range(width)]


def layer_summary(xs: Column) -> Column:
    """struct(mean, max, min, first, last, rise) over the layers of an array; nulls in an empty one."""
    n = F.size(xs)
    return F.struct(
        F.when(n > 0, total(xs) / n).alias("mean"), F.array_max(xs).cast("double").alias("max"), F.array_min(xs).cast("double").alias("min"), F.try_element_at(xs, F.lit(1)).cast("double").alias("first"), F.try_element_at(xs, F.lit(-1)).cast("double").alias("last"),
        (F.try_element_at(xs, F.lit(-1)) - F.try_element_at(xs, F.lit(1))).cast("double").alias("rise"),
    )


def slope(xs: Column) -> Column:
    """Least-squares slope of an array over its positions; null for fewer than two."""
    n = F.size(xs)
    mean_i = (n - 1) / 2
    mean_x = total(xs) / n
    pairs = F.transform(xs, lambda x, i: F.struct((i - mean_i).alias("d"), (x.cast("double") - mean_x).alias("e")))
    return F.when(n > 1, F.aggregate(pairs, F.lit(0.0), lambda s, p: s + p["d"] * p["e"]) / F.aggregate(pairs, F.lit(0.0), lambda s, p: s + p["d"] * p["d"]))


def rotated(xs: Column) -> Column:
    """The array moved on by one place, the last first."""
    return F.when(F.size(xs) > 0, F.concat(F.array(F.element_at(xs, -1)), F.slice(xs, F.lit(1), F.size(xs) - 1))).otherwise(xs)


def expected(ps: Column) -> Column:
    """Expected position under a distribution."""
    return F.aggregate(F.transform(ps, lambda p, i: p * i), F.lit(0.0), lambda s, x: s + x)


def top_overlap(a: Column, b: Column, k: int) -> Column:
    """Share of the first k of one list that the first k of the other hold."""
    return F.size(F.array_intersect(F.slice(a, 1, k), F.slice(b, 1, k))) / F.greatest(F.lit(1), F.least(F.lit(k), F.size(a), F.size(b)))


def finite(x: Column) -> Column:
    """The value as double, or null unless it is finite."""
    d = x.try_cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), None).otherwise(d)


def logprob_summary(xs: Column) -> Column:
    """struct(count, mean, perplexity) of token log probabilities, finite ones only."""
    clean = F.filter(F.transform(xs, finite), lambda x: x.isNotNull())
    mean = F.when(F.size(clean) > 0, total(clean) / F.size(clean))
    return F.struct(F.size(clean).alias("count"), mean.alias("mean"), F.when(mean < 700, F.exp(-mean)).alias("perplexity"))
