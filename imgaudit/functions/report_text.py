"""Parsing of misclassification reports written as markdown forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from imgaudit import fixed_values as fixed
from imgaudit.functions.common import ColumnLike, col


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def extract_section(body: ColumnLike, heading: str) -> Column:
    """Trimmed text below ``### heading`` up to the next heading; null if it is absent.

    ``heading`` is a pattern. An empty section takes in the heading that follows it.
    """
    pattern = rf"(?i)###\s*{heading}\s*\n+([\s\S]*?)(?=\n###|\z)"
    return F.when(col(body).rlike(pattern), _trim(F.regexp_extract(col(body), pattern, 1)))


def parse_verdict(said: ColumnLike) -> Column:
    """``struct(score, analyzed)`` read from a verdict text."""
    text = F.lower(_trim(col(said)))
    skipped = F.coalesce(text.rlike(r"not\s*analy[sz]ed|_no response_"), F.lit(False))
    digits = F.nullif(F.regexp_extract(text, r"(\d{1,3}(?:\.\d+)?)\s*%", 1), F.lit(""))
    value = digits.cast("double") / 100
    usable = ~skipped & value.between(0.0, 1.0)
    return F.struct(F.when(usable, value).alias("score"),
                    F.when(skipped, False).when(usable, True).alias("analyzed"))


def parse_truth(actually: ColumnLike) -> Column:
    text = F.lower(col(actually))
    return (F.when(text.rlike("ai[- ]generated"), "ai")
            .when(text.rlike("real|human[- ]made"), "real")
            .when(text.rlike("not certain"), "uncertain"))


def classify_report(truth: ColumnLike, score: ColumnLike, analyzed: ColumnLike,
                    flag: float = fixed.FLAG_THRESHOLD,
                    unsure: float = fixed.UNSURE_THRESHOLD) -> Column:
    truth, score, analyzed = col(truth), col(score), col(analyzed)
    known = F.coalesce(truth.isin("ai", "real"), F.lit(False))
    return (F.when(~known, "needs-review")
            .when(score.isNull() & F.coalesce(~analyzed, F.lit(False)), "not-analyzed")
            .when(score.isNull(), "needs-review")
            .when((truth == "real") & (score >= flag), "false-positive")
            .when((truth == "ai") & (score < unsure), "false-negative")
            .when((truth == "ai") & (score < flag), "borderline-miss")
            .when((truth == "real") & (score >= unsure), "unsure-on-real")
            .otherwise("consistent"))
