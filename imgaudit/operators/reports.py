"""Mining misclassification reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from imgaudit import fixed_values as fixed
from imgaudit.functions.common import ColumnLike, col
from imgaudit.functions.report_text import (
    classify_report,
    extract_section,
    parse_truth,
    parse_verdict,
)


def classify_reports(issues: DataFrame) -> DataFrame:
    """Add ``klass``, ``score`` and ``truth`` read from each body.

    Sections, verdict and class are separate projections: one nested expression would
    repeat the section patterns at every use of the score.
    """
    body = F.coalesce(F.col("body"), F.lit(""))
    sections = issues.withColumns({"_said": extract_section(body, fixed.SAID_HEADING),
                                   "_actually": extract_section(body, fixed.ACTUAL_HEADING)})
    parsed = sections.withColumns({"_verdict": parse_verdict("_said"),
                                   "truth": parse_truth("_actually")})
    parsed = parsed.withColumns({"score": F.col("_verdict.score"),
                                 "_analyzed": F.col("_verdict.analyzed")})
    return parsed.withColumn("klass", classify_report("truth", "score", "_analyzed")).drop(
        "_said", "_actually", "_verdict", "_analyzed")


def mine_reports(issues: DataFrame, evidence_chars: int | None = None) -> DataFrame:
    """Issues (number, body, createdAt) -> one classified, training-ready row each.

    The evidence is kept whole unless ``evidence_chars`` cuts it.
    """
    body = F.coalesce(F.col("body"), F.lit(""))
    links = F.regexp_extract_all(body, F.lit(f"({fixed.ATTACHMENT})"), F.lit(1))
    evidence = F.coalesce(extract_section(body, fixed.EVIDENCE_HEADING), F.lit(""))
    return classify_reports(issues).select(
        F.col("number").alias("issue"), F.col("createdAt").alias("created"),
        "klass", "score", "truth",
        F.coalesce(extract_section(body, fixed.URL_HEADING), F.lit("")).alias("image_url"),
        F.array_join(links, " ").alias("attachments"),
        (evidence if evidence_chars is None else F.substring(evidence, 1, evidence_chars)
         ).alias("evidence"))


def is_report(title: ColumnLike, current: ColumnLike) -> Column:
    """The title or a label says it is a misclassification report."""
    title = F.lower(F.coalesce(col(title), F.lit("")))
    return (F.contains(title, F.lit(fixed.REPORT_LABEL))
            | F.array_contains(col(current), fixed.REPORT_LABEL))


def reconcile_labels(issues: DataFrame) -> DataFrame:
    """Issues with ``current`` labels and ``klass`` -> labels to remove and to add.

    Issues that are no reports are left out.
    """
    managed = F.lit(list(fixed.REPORT_CLASSES))
    keep = F.array("klass")
    return issues.withColumn("current", F.coalesce("current", F.array().cast("array<string>"))
                             ).filter(is_report("title", "current")).withColumns({
        "remove": F.array_except(F.array_intersect(managed, F.col("current")), keep),
        "add": F.array(F.lit(fixed.REPORT_LABEL), F.col("klass")),
    })


def label_changes(issues: DataFrame) -> DataFrame:
    """Classify issues and reconcile their labels: (number, klass, remove, add)."""
    named = classify_reports(issues).withColumn(
        "current", F.transform("labels", lambda label: label["name"]))
    return reconcile_labels(named).select("number", "klass", "remove", "add")
