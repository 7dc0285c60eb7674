"""Streaming verdict requests: page counts and image discovery."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imgaudit.functions import web
from imgaudit.operators.metrics import page_stats

running_page_stats = page_stats


def discover_images(pages: DataFrame, time: str, delay: str, tag: str = "img",
                    attribute: str = "src") -> DataFrame:
    """New image references of arriving pages; a changed reference counts as new.

    ``delay`` bounds the state: a reference that comes again later than that counts as new,
    and a page that arrives later than that behind the newest one is dropped.
    """
    found = pages.withWatermark(time, delay).select(
        "page_id", time, F.explode(web.references("html", tag, attribute)).alias("src"))
    return found.filter(web.fetchable("src")).dropDuplicatesWithinWatermark(["page_id", "src"])
