"""Labels, generator names and caption or model matching."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from imgaudit.functions.common import ColumnLike, col


def generator(model: ColumnLike) -> Column:
    """Generator name: null or empty is ``unknown``, slashes become underscores."""
    named = F.coalesce(F.nullif(col(model), F.lit("")), F.lit("unknown"))
    return F.replace(named, F.lit("/"), F.lit("_"))


def encode_label(label: ColumnLike) -> Column:
    return F.when(col(label) == "fake", 1).otherwise(0)


def normalize_source(model: ColumnLike, label: ColumnLike) -> Column:
    prefix = F.when(col(label) == "fake", "of_").otherwise("of_real_")
    return F.concat(prefix, generator(model))


def text_match(text: ColumnLike, pattern: str) -> Column:
    """Case-insensitive search over the whole text; null never matches unless '' does."""
    return F.coalesce(col(text), F.lit("")).rlike(f"(?i){pattern}")


def family_match(source: ColumnLike, prefixes: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [col(source).startswith(p) for p in prefixes])


def pick_pair_side(pairs: list[tuple[ColumnLike, ColumnLike]], needle: str) -> Column:
    """The image of the first (image, model) pair whose model names ``needle``, else null."""
    picked = None
    for image, model in pairs:
        found = F.contains(F.lower(F.coalesce(col(model), F.lit(""))), F.lit(needle))
        picked = F.when(found, col(image)) if picked is None else picked.when(found, col(image))
    return picked
