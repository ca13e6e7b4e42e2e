"""Array algebra on ``ARRAY<DOUBLE>`` columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NORM_FLOOR = 1e-8


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row.

    An expression named inside a lambda is otherwise computed again for every
    element of the array.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(NORM_FLOOR)) * F.greatest(norm(b), F.lit(NORM_FLOOR)))


def unit(a: Column) -> Column:
    return bind(F.greatest(norm(a), F.lit(NORM_FLOOR)), lambda length: F.transform(a, lambda v: v / length))


def scaled_dot(query: Column, key: Column) -> Column:
    """Dot product over the square root of the dimension."""
    return dot(query, key) / F.sqrt(F.size(key).cast("double"))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def _exps(x: Column) -> Column:
    """Exponentials of the entries, shifted so that the largest is 1."""
    return bind(x, lambda y: bind(F.array_max(y), lambda top: F.transform(y, lambda v: F.exp(v - top))))


def softmax(x: Column) -> Column:
    return bind(_exps(x), lambda e: bind(total(e), lambda scale: F.transform(e, lambda v: v / scale)))


def argmax(x: Column) -> Column:
    """0-based place of the largest entry, the first one on ties."""
    return bind(x, lambda y: F.array_position(y, F.array_max(y)) - 1).cast("int")


def log_sum_exp(x: Column) -> Column:
    return bind(x, lambda y: F.log(total(_exps(y))) + F.array_max(y))


def cross_entropy(logits: Column, target: Column, smoothing: float = 0.0) -> Column:
    """Negative log-softmax at a 0-based target, optionally smoothed over all classes."""

    def loss(x: Column) -> Column:
        nll = log_sum_exp(x) - F.get(x, target)
        if not smoothing:
            return nll
        spread = log_sum_exp(x) - total(x) / F.size(x)
        return (1 - smoothing) * nll + smoothing * spread

    return bind(logits, loss)


def margin_loss(scores: Column, margin: float = 0.02) -> Column:
    """Mean hinge of the first score against each later one."""

    def loss(s: Column) -> Column:
        rest = F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0)))
        hinges = F.transform(rest, lambda x: F.greatest(F.lit(0.0), margin - (F.get(s, F.lit(0)) - x)))
        return F.when(F.size(rest) > 0, total(hinges) / F.size(rest))

    return bind(scores, loss)


def contrastive_loss(scores: Column) -> Column:
    """Cross-entropy of temperature-scaled scores whose first entry is the right one."""
    return cross_entropy(scores, F.lit(0))


def first_token(token_vectors: Column) -> Column:
    return F.element_at(token_vectors, 1)


def masked_mean(token_vectors: Column, mask: Column, dim: int) -> Column:
    """Mean of the token vectors whose mask entry is 1."""
    weights = F.transform(mask, lambda m: m.cast("double"))
    weighted = F.zip_with(token_vectors, weights, lambda v, w: F.transform(v, lambda x: x * w))
    zero = F.array_repeat(F.lit(0.0), dim)
    summed = F.aggregate(weighted, zero, lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y))
    return bind(
        F.greatest(total(weights), F.lit(1e-9)), lambda weight: F.transform(summed, lambda x: x / weight)
    )


def micro_text(x: Column) -> Column:
    """A vector as comma-joined whole millionths, for exact comparison across engines."""
    return F.array_join(
        F.transform(x, lambda v: F.round(v * 1000000, 0).cast("bigint").cast("string")), ","
    )
