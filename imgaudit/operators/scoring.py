"""Batch scoring, input tensors and second-view candidates."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imgaudit import fixed_values as fixed
from imgaudit.functions.images import model_geometry, native_crop
from imgaudit.functions.verdicts import calibrated_score, in_band
from imgaudit.session import small_batches

Scorer = Callable[[np.ndarray], np.ndarray]


def linear_scorer(weights: Sequence[float], bias: float) -> Scorer:
    """Dot product with fixed weights; stands where a loaded model would."""
    w = np.asarray(weights, np.float64)

    def score(inputs: np.ndarray) -> np.ndarray:
        return inputs @ w + bias

    return score


def _matrix(vectors: pa.Array, width: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors are whole and of the asked width, and these as one matrix."""
    sizes = np.diff(vectors.offsets.to_numpy())
    whole = ~vectors.is_null().to_numpy(zero_copy_only=False)
    if width is None:
        width = int(sizes[whole][0]) if whole.any() else 0
    start = vectors.offsets.to_numpy()[:-1]
    gaps = np.concatenate([[0], np.cumsum(vectors.values.is_null().to_numpy(zero_copy_only=False))])
    usable = whole & (sizes == width) & (gaps[start + sizes] == gaps[start])
    values = vectors.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    if usable.all() and len(values) == len(vectors) * width:
        return usable, values.reshape(-1, width)
    return usable, values[start[usable][:, None] + np.arange(width)]


def score_table(df: DataFrame, scorer: Scorer, inputs: str, keep: Sequence[str],
                width: int | None = None, name: str = "z") -> DataFrame:
    """Score every row in Arrow batches; an input that cannot be used has a null score.

    ``scorer`` maps a matrix, one input vector per row, to one number each. Vectors that
    are null, hold a null or have another width are not scored; without a width, that of a
    batch's first vector counts. Only the kept columns and the input travel to Python.
    """
    kept = df.select(*keep, inputs)
    schema = kept.drop(inputs).schema.add(name, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            usable, matrix = _matrix(batch.column(len(keep)), width)
            z = np.zeros(batch.num_rows)
            if usable.any():
                z[usable] = scorer(matrix)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(z, mask=~usable)], names=[*keep, name])

    return kept.mapInArrow(run, schema)


def tta_candidates(scores: DataFrame, bias: float = 0.0,
                   band_lo: float = fixed.TTA_BAND[0], band_hi: float = fixed.TTA_BAND[1],
                   crop: int = fixed.INPUT_SIZE) -> DataFrame:
    """Rows whose score is uncertain, with the geometry of the three extra views.

    v1 resizes the shorter side to 512, v2 mirrors the standard view, v3 is a crop at
    native size and null for images smaller than it.
    """
    score = calibrated_score("z", 1.0, bias)
    return scores.filter(F.col("z").isNotNull() & ~F.isnan("z")
                         & in_band(score, band_lo, band_hi)).withColumns({
        "v1": model_geometry("w", "h", 512, crop),
        "v2": model_geometry("w", "h", fixed.RESIZE_SHORTER_SIDE, crop),
        "v3": native_crop("w", "h", crop),
    })


def band_sizes(scores: DataFrame, bias: float = 0.0, band_lo: float = fixed.TTA_BAND[0],
               band_hi: float = fixed.TTA_BAND[1]) -> DataFrame:
    """Images inside the uncertainty band, per view."""
    score = calibrated_score("z", 1.0, bias)
    usable = F.col("z").isNotNull() & ~F.isnan("z")
    return scores.groupBy("view").agg(
        F.count_if(usable & in_band(score, band_lo, band_hi)).alias("in_band"),
        F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ tensors

BAND = 32  # outputs per block of the filter matrix
STACK_BYTES = 4 << 20  # pixels, or values of tensors, resampled together


@lru_cache(maxsize=256)
def triangle_taps(source: int, size: int, start: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Where ``count`` outputs from ``start`` read, and with which weights; rows sum to one.

    An antialiased triangle filter, as wide as an output is apart from the next: each output
    has a few taps, however many pixels there are.
    """
    scale = source / size
    width = max(scale, 1.0)
    centre = (np.arange(start, start + count) + 0.5) * scale
    first = np.maximum(np.floor(centre - width).astype(np.int64), 0)
    taps = first[:, None] + np.arange(int(np.ceil(2 * width)) + 2)
    weights = np.clip(1.0 - np.abs(taps + 0.5 - centre[:, None]) / width, 0.0, None)
    weights[taps >= source] = 0.0
    return np.minimum(taps, source - 1), weights / weights.sum(axis=1, keepdims=True)


@lru_cache(maxsize=256)
def triangle_bands(source: int, size: int, start: int, count: int) -> list[tuple[slice, slice, np.ndarray]]:
    """The filter as blocks of a banded matrix: outputs, the inputs they read, and the weights.

    ``BAND`` neighbouring outputs read nearly the same inputs, so a block is mostly filled.
    """
    taps, weights = triangle_taps(source, size, start, count)
    bands = []
    for at in range(0, count, BAND):
        out = slice(at, min(at + BAND, count))
        low, high = int(taps[out].min()), int(taps[out].max()) + 1
        block = np.zeros((out.stop - at, high - low))
        np.add.at(block, (np.arange(out.stop - at)[:, None], taps[out] - low), weights[out])
        bands.append((out, slice(low, high), block))
    return bands


def _resample(images: np.ndarray, bands: list[tuple[slice, slice, np.ndarray]]) -> np.ndarray:
    """Weighted sums along the second axis of a stack of images, one matrix product a band."""
    count, _, *rest = images.shape
    out = np.empty((count, bands[-1][0].stop, *rest))
    flat = out.reshape(count, out.shape[1], -1)
    for rows, read, block in bands:
        np.matmul(block, images[:, read].reshape(count, read.stop - read.start, -1).astype(np.float64),
                  out=flat[:, rows])
    return out


def input_tensors(pixels: np.ndarray, shorter: int, crop: int, mean: np.ndarray,
                  std: np.ndarray) -> np.ndarray:
    """Resize, centre-crop and normalise a stack of RGB images of one size; channels first.

    Only the rows and columns that the crop reads are resampled.
    """
    height, width = pixels.shape[1:3]
    scale = shorter / min(height, width)
    rows, cols = (max(crop, int(np.floor(side * scale + 0.5))) for side in (height, width))
    across = triangle_bands(width, cols, (cols - crop) // 2, crop)
    left, right = min(read.start for _, read, _ in across), max(read.stop for _, read, _ in across)
    across = [(out, slice(read.start - left, read.stop - left), block) for out, read, block in across]
    high = _resample(pixels[:, :, left:right], triangle_bands(height, rows, (rows - crop) // 2, crop))
    small = _resample(np.ascontiguousarray(high.swapaxes(1, 2)), across)  # image, column, row, channel
    whole = np.clip(np.floor(small + 0.5), 0, 255)
    return ((whole / 255.0 - mean) / std).transpose(0, 3, 2, 1).astype(np.float32)


def _one_size(batch: pa.RecordBatch, crop: int) -> Iterator[tuple[list[int], np.ndarray]]:
    """Row numbers and pixels (RGB) of the batch's images, size by size.

    Some megabytes at a time, both of the pixels and of the tensors that are made of them.
    """
    sizes: dict[tuple, list[int]] = {}
    for i, shape in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)))):
        sizes.setdefault(shape, []).append(i)
    for shape, rows in sizes.items():
        height, width, channels = shape
        together = max(1, STACK_BYTES // max(height * width * max(channels, 3), 3 * crop * crop * 8))
        for at in range(0, len(rows), together):
            part = rows[at:at + together]
            pixels = np.stack([np.frombuffer(batch.column(4)[i].as_buffer(), np.uint8).reshape(shape) for i in part])
            yield part, pixels[..., 2::-1] if shape[2] >= 3 else np.repeat(pixels, 3, axis=3)


def prepare_tensors(images: DataFrame, shorter: int = fixed.RESIZE_SHORTER_SIDE,
                    crop: int = fixed.INPUT_SIZE, preset: str = "imagenet",
                    key: str = "path") -> DataFrame:
    """Decoded images (key, height, width, channels, data in BGR) -> (key, tensor).

    The tensor is 3 x crop x crop, flattened. Images of one size that come in the same Arrow
    batch are resampled together.
    """
    small_batches(images.sparkSession)
    mean, std = (np.asarray(v) for v in fixed.NORM_PRESETS[preset])
    key_type = images.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, pixels in _one_size(batch, crop):
                tensors = input_tensors(pixels, shorter, crop, mean, std).reshape(len(rows), -1)
                ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * tensors.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)),
                     pa.ListArray.from_arrays(ends, pa.array(tensors.ravel()))], names=[key, "tensor"])

    return images.select(key, "height", "width", "channels", "data").mapInArrow(
        run, f"{key} {key_type}, tensor array<float>")
