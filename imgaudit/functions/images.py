"""Image bytes, file names, sizes and resize geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from imgaudit import fixed_values as fixed
from imgaudit.functions.common import ColumnLike, col, magic, round_half_even, round_half_up


def _head(content: ColumnLike, length: int, start: int = 1) -> Column:
    return F.substring(col(content), start, length)


def is_png(content: ColumnLike) -> Column:
    return _head(content, 8) == magic(fixed.PNG_MAGIC)


def is_jpeg(content: ColumnLike) -> Column:
    return _head(content, 3) == magic(fixed.JPEG_MAGIC)


def sniff_format(content: ColumnLike) -> Column:
    """File extension by leading bytes; anything unknown counts as JPEG."""
    webp = (_head(content, 4) == F.lit(b"RIFF")) & (_head(content, 4, 9) == F.lit(b"WEBP"))
    return (F.when(is_jpeg(content), ".jpg").when(is_png(content), ".png")
            .when(webp, ".webp").otherwise(".jpg"))


def is_appledouble(content: ColumnLike) -> Column:
    return _head(content, 4) == magic(fixed.APPLEDOUBLE_MAGIC)


def basename(path: ColumnLike) -> Column:
    return F.substring_index(col(path), "/", -1)


def parent_name(path: ColumnLike) -> Column:
    return F.substring_index(F.substring_index(col(path), "/", -2), "/", 1)


def is_hidden(path: ColumnLike) -> Column:
    return basename(path).startswith(".")


def has_extension(path: ColumnLike, extensions: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for extension in extensions:
        found = found | F.lower(basename(path)).endswith(extension.lower())
    return found


def eligible(w: ColumnLike, h: ColumnLike, disp_w: ColumnLike, disp_h: ColumnLike,
             force: Column | None = None, min_side: int = fixed.MIN_SIDE,
             min_display: int = fixed.MIN_DISPLAY_SIDE) -> Column:
    """Large enough both as a file and on screen; ``force`` passes either gate."""
    natural = F.least(col(w), col(h)) >= max(fixed.MIN_ICON_SIDE, min_side)
    displayed = F.least(col(disp_w), col(disp_h)) >= min_display
    gate = natural & displayed
    return gate if force is None else force | gate


def too_small(w: ColumnLike, h: ColumnLike) -> Column:
    """The error text ``too-small``, or null."""
    return F.when(F.least(col(w), col(h)) < fixed.MIN_DECODED_SIDE, "too-small")


def _size(w: Column, h: Column) -> Column:
    return F.struct(w.cast("bigint").alias("w"), h.cast("bigint").alias("h"))


def view_geometry(w: ColumnLike, h: ColumnLike, view: ColumnLike) -> Column:
    """``struct(w, h, quality)`` after the degradation of a view; clean has no quality."""
    w, h, view = col(w), col(h), col(view)
    target = F.lit(None).cast("int")
    quality = F.lit(None).cast("int")
    for name, degradation in fixed.VIEWS.items():
        if degradation is not None:
            target = F.when(view == name, degradation[0]).otherwise(target)
            quality = F.when(view == name, degradation[1]).otherwise(quality)
    longest = F.greatest(w, h)
    scale = target / longest
    shrink = longest > target
    return F.struct(
        *[F.when(shrink, F.greatest(F.lit(1), round_half_even(side * scale)))
          .otherwise(side).cast("bigint").alias(name) for side, name in ((w, "w"), (h, "h"))],
        quality.alias("quality"),
    )


def web_tier_geometry(w: ColumnLike, h: ColumnLike) -> Column:
    w, h = col(w), col(h)
    shortest = F.least(w, h)
    scale = F.lit(fixed.WEB_TIER_SIDE) / shortest
    shrink = shortest > fixed.WEB_TIER_SIDE
    return _size(*[F.when(shrink, round_half_even(side * scale)).otherwise(side)
                   for side in (w, h)])


def model_geometry(w: ColumnLike, h: ColumnLike, shorter: int = fixed.RESIZE_SHORTER_SIDE,
                   crop: int = fixed.INPUT_SIZE, rounding: str = "half_even") -> Column:
    """``struct(w, h, x0, y0)``: resized sides and centre-crop offsets."""
    rounded = {"half_even": round_half_even, "half_up": round_half_up}[rounding]
    w, h = col(w), col(h)
    scale = F.lit(shorter) / F.least(w, h)
    rw, rh = (F.greatest(F.lit(crop), rounded(side * scale)).cast("bigint") for side in (w, h))
    return F.struct(rw.alias("w"), rh.alias("h"),
                    F.floor((rw - crop) / 2).alias("x0"), F.floor((rh - crop) / 2).alias("y0"))


def native_crop(w: ColumnLike, h: ColumnLike, crop: int = fixed.INPUT_SIZE) -> Column:
    """``struct(x0, y0)`` of a crop without resizing; null when the image is smaller."""
    w, h = col(w), col(h)
    return F.when(F.least(w, h) >= crop,
                  F.struct(F.floor((w - crop) / 2).alias("x0"),
                           F.floor((h - crop) / 2).alias("y0")))
