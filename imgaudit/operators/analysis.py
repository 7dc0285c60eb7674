"""Verdicts end to end: gate, dedupe, markers, degenerate inputs, model, bands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imgaudit.functions.images import eligible, too_small
from imgaudit.functions.verdicts import band, calibrated_score, resolve_verdict
from imgaudit.operators.degenerate import degenerate_reason, image_stats
from imgaudit.operators.forensics import first_hits
from imgaudit.operators.scoring import Scorer, score_table
from imgaudit.session import stored


def analyse(requests: DataFrame, files: DataFrame, rasters: DataFrame, inputs: DataFrame,
            scorer: Scorer, width: int, key: str = "url", bias: float = 0.0) -> DataFrame:
    """Add ``eligible``, ``reason``, ``error``, ``score`` and ``band`` to image requests.

    ``requests`` carry ``w, h, disp_w, disp_h``; ``files`` have ``content``, ``rasters`` are
    decoded images and ``inputs`` the model's vectors in ``vector``, all by ``key``. Each
    step works only on what the one before left open: every url that passes the gate once,
    pixels only of files without a marker, the model only for images that are neither too
    small nor degenerate. An image without a usable vector has no score.
    """
    gate = F.coalesce(eligible("w", "h", "disp_w", "disp_h"), F.lit(False))
    asked = requests.withColumn("eligible", gate)
    urls = asked.filter("eligible").groupBy(key).agg(F.min("w").alias("w"), F.min("h").alias("h"))
    marked = first_hits(files.join(urls.select(key), key, "left_semi"), key)
    marked = stored(urls.join(marked, key, "left"), "marked")
    open_ = marked.filter(~F.coalesce("hit", F.lit(False))).select(key, "w", "h")
    pixels = rasters.withColumnRenamed(key, "path").join(
        open_.select(F.col(key).alias("path")), "path", "left_semi")
    stats = image_stats(pixels).withColumnRenamed("path", key)
    error = F.coalesce(too_small("w", "h"), F.concat(F.lit("degenerate-"), degenerate_reason()))
    gated = stored(open_.join(stats, key, "left").select(key, error.alias("error")), "gated")
    sound = gated.filter("error IS NULL").select(key)
    scored = score_table(inputs.join(sound, key, "left_semi"), scorer, "vector", [key], width)
    found = marked.select(key, "hit", "reason").join(gated, key, "left").join(scored, key, "left")
    found = found.withColumn("score", resolve_verdict("hit", "error", calibrated_score("z", bias=bias)))
    found = found.select(key, "reason", "error", "score", band("score").alias("band"))
    named = found.withColumnRenamed(key, "_found")
    return asked.join(named, F.col("eligible") & (F.col(key) == F.col("_found")), "left").drop("_found")
