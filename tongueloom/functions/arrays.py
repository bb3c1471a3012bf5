"""Array expressions shared by the classifiers and taggers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def argmax_index(scores: Column) -> Column:
    """0-based index of the largest element, first one on ties."""
    return F.array_position(scores, F.array_max(scores)) - F.lit(1)


def label_index(label: Column, labels: Sequence[str], what: str = "label") -> Column:
    """Position of ``label`` in a fixed list; a label outside the list fails the job."""
    known = F.array(*[F.lit(x) for x in labels])
    at = F.array_position(known, label)
    return F.when(at > 0, at - F.lit(1)).otherwise(
        F.raise_error(F.concat(F.lit(f"unknown {what}: "), F.coalesce(label, F.lit("null")))).cast("bigint")
    )


def label_indices(array: Column, labels: Sequence[str], what: str = "label") -> Column:
    """``label_index`` of every element; the array is searched for unknown ones once, not at each."""
    known = F.array(*[F.lit(x) for x in labels])
    at = F.transform(array, lambda x: F.coalesce(F.array_position(known, x), F.lit(0)) - F.lit(1))
    return F.transform(F.array(at), lambda a: F.when(F.array_position(a, F.lit(-1)) > 0, F.transform(
        array, lambda x: label_index(x, labels, what))).otherwise(a))[0]  # bound once; the first unknown one ends the job
