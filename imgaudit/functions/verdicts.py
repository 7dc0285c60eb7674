"""Calibrated scores, verdict bands, second views and moderation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from imgaudit import fixed_values as fixed
from imgaudit.functions.common import ColumnLike, col, round_half_up


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def _number(value: Column | float | None, default: float) -> Column:
    """A setting as a double; missing or zero falls back to the default."""
    value = value if isinstance(value, Column) else F.lit(value).cast("double")
    return F.coalesce(F.nullif(value, F.lit(0.0)), F.lit(default))


def calibrated_score(z: ColumnLike, temperature: Column | float | None = 1.0,
                     bias: Column | float | None = 0.0) -> Column:
    return sigmoid(col(z) / _number(temperature, 1.0) + _number(bias, 0.0))


def _softmax2(out: Column, index: int) -> Column:
    first, second = out[0], out[1]
    top = F.greatest(first, second)
    a, b = F.exp(first - top), F.exp(second - top)
    return (b if index else a) / (a + b)


OUTPUT_MODES = {
    "logit_sigmoid": lambda out: sigmoid(out[0]),
    "prob": lambda out: out[0],
    "softmax2_idx1": lambda out: _softmax2(out, 1),
    "softmax2_idx0": lambda out: _softmax2(out, 0),
}


def to_score(out: ColumnLike, mode: str) -> Column:
    """Score of a raw model output array under one of ``OUTPUT_MODES``."""
    return OUTPUT_MODES[mode](col(out))


def band(score: ColumnLike, threshold: float = fixed.FLAG_THRESHOLD) -> Column:
    score = col(score)
    return (F.when(score >= threshold, "AI")
            .when(score >= fixed.UNSURE_THRESHOLD, "unsure")
            .when(score.isNotNull(), "low"))


def percent(score: ColumnLike) -> Column:
    return round_half_up(col(score) * 100).cast("int")


def badge_text(score: ColumnLike, threshold: float = fixed.FLAG_THRESHOLD) -> Column:
    shown = F.concat(percent(score).cast("string"), F.lit("%"))
    name = band(score, threshold)
    return F.when(name == "low", shown).otherwise(F.concat(name, F.lit(" "), shown))


def is_quiet(score: ColumnLike, display: ColumnLike,
             threshold: float = fixed.FLAG_THRESHOLD) -> Column:
    """A badge below the threshold is quiet when only flags are displayed."""
    return (col(score) < threshold) & (col(display) == "flags")


def in_band(score: ColumnLike, low: float = fixed.TTA_BAND[0],
            high: float = fixed.TTA_BAND[1]) -> Column:
    return (col(score) >= low) & (col(score) <= high)


def selective_tta(z_std: ColumnLike, z_native: ColumnLike, w: ColumnLike, h: ColumnLike,
                  bias: Column | float | None = 0.0, temperature: Column | float | None = 1.0,
                  enabled: bool = True, band_lo: float = fixed.TTA_BAND[0],
                  band_hi: float = fixed.TTA_BAND[1], min_side: int | None = None,
                  input_size: int = fixed.INPUT_SIZE) -> Column:
    """``struct(z, score, tta)``: the mean of both logits where the first is uncertain."""
    z_std, z_native = col(z_std), col(z_native)
    first = calibrated_score(z_std, temperature, bias)
    fires = (F.lit(enabled) & in_band(first, band_lo, band_hi)
             & (F.least(col(w), col(h)) >= (min_side or input_size)) & z_native.isNotNull())
    z = F.when(fires, (z_std + z_native) / 2).otherwise(z_std)
    return F.struct(z.alias("z"), calibrated_score(z, temperature, bias).alias("score"),
                    F.coalesce(fires, F.lit(False)).alias("tta"))


def resolve_verdict(metadata_hit: ColumnLike, error: ColumnLike, score: ColumnLike) -> Column:
    """Score by precedence: metadata marker, then error (null score), then the model."""
    return (F.when(F.coalesce(col(metadata_hit), F.lit(False)), F.lit(fixed.METADATA_SCORE))
            .when(col(error).isNull(), col(score)))


def flag_action(action: ColumnLike, blur: ColumnLike) -> Column:
    """The effective policy; an old ``blur = false`` turns the blur action into a badge."""
    action, blur = col(action), F.coalesce(col(blur), F.lit(False))
    return (F.when((action == "blur") & ~blur, "badge")
            .when(action.isin("badge", "blur", "hide"), action)
            .when(blur, "blur").otherwise("badge"))


def moderation_action(score: ColumnLike, action: ColumnLike, blur: ColumnLike,
                      threshold: float = fixed.FLAG_THRESHOLD) -> Column:
    """What happens to the image; null below the threshold."""
    return F.when(col(score) >= threshold, flag_action(action, blur))
