"""Expressions over class-score vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def group_scores(probs: Column, groups: Sequence[Sequence[int]]) -> Column:
    """Sum the class scores of each group, in the order given (background last)."""
    return F.array(*(sum((probs[i] for i in g[1:]), probs[g[0]]) for g in groups))


def top_group(scores: Column, names: Sequence[str]) -> Column:
    """The first group with the largest score."""
    return F.get(F.array(*(F.lit(n) for n in names)), (F.array_position(scores, F.array_max(scores)) - 1).cast("int"))


def softmax(values: Column) -> Column:
    e = F.transform(values, lambda x: F.exp(x.cast("double") - F.array_max(values).cast("double")))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def margin(probs: Column) -> Column:
    """Largest less second largest score; null for fewer than two."""
    s = F.sort_array(probs, asc=False)
    return F.get(s, F.lit(0)) - F.get(s, F.lit(1))


def entropy(probs: Column) -> Column:
    return -F.aggregate(probs, F.lit(0.0), lambda a, p: a + p * F.log(F.greatest(p, F.lit(1e-12))))


def checked(probs: Column, classes: int) -> Column:
    """The vector, or an error where its width is not that of the class table."""
    return F.when(F.size(probs) == classes, probs).otherwise(F.raise_error(F.concat(F.lit(f"expected {classes} scores, found "), F.size(probs).cast("string"))))
