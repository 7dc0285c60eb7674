"""Caps, strides, splits, balancing and augmentation plans.

``order`` is one column or several that together are unique per row, such as
``("file", "row_index")``; "first" always means first in that order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from imgaudit import fixed_values as fixed
from imgaudit.functions import labels
from imgaudit.functions.common import ColumnLike, col, round_half_even
from imgaudit.functions.draws import draw, draw_int, draw_unit, hash_order
from imgaudit.operators.ranking import (
    first_n,
    key_sizes,
    null_safe_join,
    order_value,
    value_at_rank,
    with_position,
    within_edge,
)
from imgaudit.operators.row_fetch import fetch
from imgaudit.session import stored

def _lookup(table: Mapping[str, object], key: ColumnLike, default) -> Column:
    entries = [F.lit(v) for pair in table.items() for v in pair]
    if not entries:
        return F.lit(default)
    return F.coalesce(F.try_element_at(F.create_map(*entries), col(key)), F.lit(default))


def cap_per_key(df: DataFrame, key: str, order, cap: int | Mapping[str, int],
                default: int = fixed.DEFAULT_CAP, payload: str | None = None) -> DataFrame:
    """First rows per key up to a cap, the same for all keys or from a key -> cap table.

    Rows without a payload use up the cap and are dropped afterwards.
    """
    limit = _lookup(cap, key, default) if isinstance(cap, Mapping) else cap
    kept = first_n(df, order, limit, [key])
    return kept.filter(F.col(payload).isNotNull()) if payload else kept


def cap_class(df: DataFrame, n: int, order, label: str = "label", value: object = 0,
              payload: str | None = None) -> DataFrame:
    """First n rows of one class; rows without a payload use up the cap."""
    kept = first_n(df.filter(F.col(label) == value), order, n)
    return kept.filter(F.col(payload).isNotNull()) if payload else kept


def take_first_nonnull(df: DataFrame, n: int, order, payload: str,
                       keys: Sequence[str] = ()) -> DataFrame:
    """First n rows that have a payload; rows without one do not use up the cap."""
    return first_n(df.filter(F.col(payload).isNotNull()), order, n, keys)


def capped_corpus(df: DataFrame, order, cap: int | Mapping[str, int], real_cap: int,
                  subset: str, payload: str, default: int = fixed.DEFAULT_CAP) -> DataFrame:
    """Shard rows (label, model, payload) -> capped manifest rows with the payload kept."""
    named = df.withColumn("generator", labels.generator("model"))
    fakes = cap_per_key(named.filter(F.col("label") == "fake"), "generator", order, cap,
                        default, payload)
    reals = first_n(named.filter(~F.col("label").eqNullSafe("fake")), order, real_cap).filter(
        F.col(payload).isNotNull())
    return fakes.unionByName(reals).withColumns({
        "source": labels.normalize_source("model", "label"),
        "label": labels.encode_label("label"),
        "subset": F.lit(subset),
    })


def _addresses(address: tuple[str, str] | None) -> list[Column]:
    return [] if address is None else [F.col(c).alias(name) for c, name in zip(address, ("_at_file", "_at_row"))]


def stride_sample(df: DataFrame, stride: int | Mapping[str, int], order,
                  source: str = "source", default: int = 1, needs: str | None = None,
                  address: tuple[str, str] | None = None) -> DataFrame:
    """Positions 0, s, 2s, ... of every source.

    Rows without a payload hold positions too, unless ``needs`` names the column that must
    not be null, as the picked image of a pair. Positions are taken on the source and the
    order alone. With ``address``, the columns of a row's file and number in it, wide rows
    are filtered where they are read; without, they pass a semi-join with what was kept.
    """
    df = df if needs is None else df.filter(F.col(needs).isNotNull())
    step = F.lit(stride) if isinstance(stride, int) else _lookup(stride, source, default)
    narrow = df.select(source, order_value(order).alias("_order"), *_addresses(address))
    kept = with_position(narrow, "_order", [source]).filter(F.pmod(F.col("position"), step) == 0)
    if address is not None:
        return fetch(df, kept.select(F.col("_at_file").alias(address[0]), F.col("_at_row").alias(address[1])), address)
    kept = kept.select(source, "_order")
    return null_safe_join(df.withColumn("_order", order_value(order)), kept,
                          [source, "_order"], "left_semi").drop("_order")


def seeded_take(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """n rows of a repeatable shuffle by a unique key."""
    return first_n(df, [hash_order(key, seed), key], n)


def subsample_if_larger(df: DataFrame, cap: int, seed: int, key: str) -> DataFrame:
    """All rows, or a repeatable shuffle's first ``cap`` when there are more."""
    return seeded_take(df, cap, seed, key)


def head_holdout(df: DataFrame, holdout: int, seed: int, key: str) -> DataFrame:
    """Add ``split``: the first rows of a repeatable shuffle are held out, the rest train."""
    order = [hash_order(key, seed), key]
    targets = key_sizes(df).filter(F.col("_rows") > holdout).select(
        F.lit(holdout).cast("bigint").alias("_target"))
    return _as_split(within_edge(df, order, value_at_rank(df, order, targets)))


def tail_holdout(df: DataFrame, holdout: int | Mapping[str, int], order,
                 source: str = "source") -> DataFrame:
    """Add ``split``: a contiguous tail of each source, at most a fifth of it, is held out."""
    wanted = (_lookup(holdout, source, 0) if isinstance(holdout, Mapping) else F.lit(holdout))
    held = F.least(wanted, F.floor(F.col("_rows") / 5))
    targets = key_sizes(df, [source]).select(source, (F.col("_rows") - held + 1).alias("_target"))
    edges = value_at_rank(df, order, targets, [source])
    return _as_split(within_edge(df, order, edges, [source], last=True))


def shard_disjoint_split(df: DataFrame, file: str, order, train_cap: int, holdout_cap: int,
                         payload: str) -> DataFrame:
    """The last shard file is held out, the others train; each side has its own cap."""
    last = df.select(F.max(file)).scalar()
    train = take_first_nonnull(df.filter(F.col(file) < last), train_cap, order, payload)
    heldout = take_first_nonnull(df.filter(F.col(file) == last), holdout_cap, order, payload)
    return train.withColumn("split", F.lit("train")).unionByName(
        heldout.withColumn("split", F.lit("heldout")))


def total_cap(df: DataFrame, cap: int | Mapping[str, int], order,
              source: str = "source") -> DataFrame:
    """Stop each source at its train plus held-out total."""
    return cap_per_key(df, source, order, cap, default=0)


@dataclass(frozen=True)
class Spec:
    """How one source is curated: stride, caps, and which rows count at all.

    ``where`` filters rows, such as a caption or a date that must match. ``pair`` names a
    model: a row's image is then the side that this model made, and rows without such a side
    take no position of the stride. In all other sources a null payload holds its position.
    """

    stride: int
    train: int
    holdout: int
    where: Column | None = None
    pair: str | None = None


def curate_sources(df: DataFrame, specs: Mapping[str, Spec], order, payload: str,
                   source: str = "source", sides: Sequence[tuple[ColumnLike, ColumnLike]] = (),
                   address: tuple[str, str] | None = None) -> DataFrame:
    """Curate many sources at once: filter, stride, drop rows without a payload, cap, hold out.

    ``sides`` are the (image, model) columns of pair rows. All choices are made on the
    source, the order and whether there is a payload. With ``address``, the columns of a
    row's file and number in it, the picked rows are then taken where they are read; without,
    they find their payloads by one join.
    """
    counts, image = F.lit(False), F.col(payload)
    for name, spec in specs.items():
        own = F.col(source) == name
        if spec.pair is not None:
            image = F.when(own, labels.pick_pair_side(list(sides), spec.pair)).otherwise(image)
        counts = F.when(own, F.lit(True) if spec.where is None else F.coalesce(
            spec.where, F.lit(False))).otherwise(counts)
    pairs = [name for name, spec in specs.items() if spec.pair is not None]
    wanted = df.filter(F.col(source).isin(list(specs)) & counts).withColumn(payload, image)
    wanted = wanted.filter(~F.col(source).isin(pairs) | F.col(payload).isNotNull())
    narrow = wanted.select(source, order_value(order).alias("_order"),
                           F.col(payload).isNotNull().alias("_has"), *_addresses(address))
    step = _lookup({k: s.stride for k, s in specs.items()}, source, 1)
    strided = with_position(narrow, "_order", [source]).filter(
        (F.pmod(F.col("position"), step) == 0) & F.col("_has")).drop("_has", "position")
    caps = {k: s.train + s.holdout for k, s in specs.items()}
    capped = stored(first_n(stored(strided, "strided"), "_order", _lookup(caps, source, 0),
                            [source]), "curated")
    picked = tail_holdout(capped, {k: s.holdout for k, s in specs.items()}, "_order", source)
    if address is not None:
        return fetch(wanted, picked.select(F.col("_at_file").alias(address[0]), F.col("_at_row").alias(address[1]),
                                           "split"), address)
    picked = picked.withColumnsRenamed({source: "_source", "_order": "_at"})
    same = (F.col(source) == F.col("_source")) & (order_value(order) == F.col("_at"))
    return wanted.join(picked, same).drop("_source", "_at")


def _as_split(df: DataFrame) -> DataFrame:
    split = F.when(F.col("_within"), "heldout").otherwise("train")
    return df.withColumn("split", split).drop("_within")


def drop_failures(df: DataFrame, z: str = "z") -> DataFrame:
    """Drop rows that could not be decoded: a null or NaN value."""
    return df.filter(F.col(z).isNotNull() & ~F.isnan(z))


# ------------------------------------------------------------------ balancing

def _class_sizes(df: DataFrame, label: str) -> Column:
    """Rows per class as one struct, so that a plan reads the labels once for all uses."""
    return df.select(F.struct(F.count_if(F.col(label) == 1).alias("fake"),
                              F.count_if(F.col(label) != 1).alias("real"))).scalar()


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Add ``weight``: each class sums to one half."""
    size = F.when(F.col(label) == 1, F.col("_sizes.fake")).otherwise(F.col("_sizes.real"))
    return df.withColumn("_sizes", _class_sizes(df, label)).withColumn(
        "weight", F.lit(0.5) / F.greatest(size, F.lit(1))).drop("_sizes")


def balanced_resample(df: DataFrame, key: str, seed: int, label: str = "label") -> DataFrame:
    """As many draws with replacement as there are rows, each class equally likely.

    Every row makes one draw: a class and a position within that class. Draws meet keys on
    (class, position), so no class is gathered anywhere; only keys and classes are ranked,
    and the drawn keys then find their rows by one join. With one class missing, all draws
    come from the other.
    """
    fair = F.pmod(draw(key, f"{seed}:class"), F.lit(2)).cast("int")
    wanted = F.when(F.col("_sizes.real") == 0, 1).when(F.col("_sizes.fake") == 0, 0).otherwise(fair)
    size = F.when(F.col("_class") == 1, F.col("_sizes.fake")).otherwise(F.col("_sizes.real"))
    narrow = df.select(key, F.when(F.col(label) == 1, 1).otherwise(0).alias("_class"))
    draws = df.select(key, _class_sizes(df, label).alias("_sizes")).withColumn(
        "_class", wanted).withColumn("_position", F.pmod(draw(key, f"{seed}:row"), size)).select(
        F.col(key).alias("draw_key"), "_class", "_position")
    rows = with_position(narrow, key, ["_class"], "_position")
    picked = draws.join(rows, ["_class", "_position"]).select("draw_key", key)
    return picked.join(df, key)


# ------------------------------------------------------------------ image plans

def small_copies_plan(df: DataFrame, key: str, seed: int, cap: int = 8000, holdout: int = 800,
                      prefixes: tuple[str, ...] = fixed.FRAGILE_PREFIXES) -> DataFrame:
    """A repeatable pick of weak-family rows with target size, JPEG quality and split."""
    picked = seeded_take(df.filter(labels.family_match("source", prefixes)),
                         cap + holdout, seed, key)
    split = head_holdout(picked, holdout, seed, key)
    target = draw_int(key, f"{seed}:side", 180, 320)
    shortest = F.least("w", "h")
    scale = F.col("target") / shortest
    out = {f"out_{c}": F.when(shortest > F.col("target"),
                              F.greatest(F.lit(64), round_half_even(F.col(c) * scale)))
           .otherwise(F.col(c)) for c in ("w", "h")}
    return (split.withColumn("target", target).withColumns(out).withColumns({
        "quality": draw_int(key, f"{seed}:quality", 45, 80),
        "source": F.concat("source", F.lit("_small")),
        "label": F.lit(1),
    }))


INTERPOLATIONS = ("nearest", "bilinear", "bicubic", "lanczos")


def augmentation_plan(df: DataFrame, key: str, epoch: int, thumb_p: float = 0.25,
                      crop: int = fixed.INPUT_SIZE,
                      shorter: int = fixed.RESIZE_SHORTER_SIDE) -> DataFrame:
    """Per image and epoch: rescale, re-encodings, resize, crop offsets and flip.

    Only the plan is computed, as columns; no pixels are touched.
    """
    def unit(name):
        return draw_unit(key, f"{epoch}:{name}")

    def whole(name, low, high):
        return draw_int(key, f"{epoch}:{name}", low, high)

    regime = (F.when(unit("thumb") < thumb_p, "thumb")
              .when(unit("rescale") < 0.7, "rescale").otherwise("none"))
    shortest = F.least("w", "h")
    target = whole("target", 180, 320)
    factor = (F.when(F.col("regime") == "rescale", F.lit(0.4) + unit("factor") * F.lit(0.9))
              .when((F.col("regime") == "thumb") & (shortest > target), target / shortest))
    sized = {f"w{i}": F.when(F.col("factor").isNull(), F.col(c).cast("bigint")).otherwise(
        F.greatest(F.lit(64), round_half_even(F.col(c) * F.col("factor"))))
        for i, c in ((1, "w"), (2, "h"))}
    df = df.withColumn("regime", regime).withColumn("factor", factor).withColumns(sized)
    df = df.withColumnsRenamed({"w1": "scaled_w", "w2": "scaled_h"})
    picked = F.get(F.lit(list(INTERPOLATIONS)), whole("filter", 0, 3).cast("int"))
    encodings = {}
    for i, chance in ((1, 0.85), (2, 0.3)):
        on = unit(f"encode{i}") < chance
        encodings[f"format{i}"] = F.when(
            on, F.when(unit(f"webp{i}") < 0.25, "webp").otherwise("jpeg"))
        encodings[f"quality{i}"] = F.when(on, whole(f"quality{i}", 30, 95))
    scale = F.lit(shorter) / F.least("scaled_w", "scaled_h")
    resized = {f"resized_{c}": F.greatest(F.lit(crop).cast("bigint"),
                                          round_half_even(F.col(f"scaled_{c}") * scale))
               for c in ("w", "h")}
    df = df.withColumns({"filter": F.when(F.col("factor").isNotNull(), picked),
                         **encodings, **resized})
    return df.withColumns({
        "x0": whole("x", F.lit(0), F.col("resized_w") - crop),
        "y0": whole("y", F.lit(0), F.col("resized_h") - crop),
        "flip": unit("flip") < 0.5,
    })
