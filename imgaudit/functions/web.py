"""Page urls, image references in HTML and analysis errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from imgaudit.functions.common import ColumnLike, col


def fetchable(url: ColumnLike) -> Column:
    """Not empty and not a ``blob:`` reference; ``data:`` urls count."""
    url = F.coalesce(col(url), F.lit(""))
    return (F.length(url) > 0) & ~url.startswith("blob:")


def url_base(url: ColumnLike) -> Column:
    return F.substring_index(col(url), "?", 1)


def is_permanent(error: ColumnLike) -> Column:
    return (col(error) == "too-small") | col(error).startswith("degenerate")


def error_class(error: ColumnLike) -> Column:
    """``permanent`` or ``transient``; null when there is no error."""
    return (F.when(col(error).isNull(), F.lit(None).cast("string"))
            .when(is_permanent(error), "permanent").otherwise("transient"))


def tag_pattern(tag: str, attribute: str) -> str:
    """A pattern whose first group is an attribute value, quotes included."""
    return rf"""(?i)<{tag}\b[^>]*?\s{attribute}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def references(html: ColumnLike, tag: str = "img", attribute: str = "src") -> Column:
    """All values of one attribute of one tag, in document order."""
    raw = F.regexp_extract_all(col(html), F.lit(tag_pattern(tag, attribute)), F.lit(1))
    return F.transform(raw, lambda value: F.btrim(value, F.lit("\"'")))
