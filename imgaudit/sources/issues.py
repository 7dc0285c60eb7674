"""Issue reports in, mined reports out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from imgaudit import fixed_values as fixed
from imgaudit import schemas


def labelled(issues: DataFrame, label: str = fixed.REPORT_LABEL) -> DataFrame:
    return issues.filter(F.exists("labels", lambda entry: entry["name"] == label))


def read_issues(spark: SparkSession, path: str, label: str = fixed.REPORT_LABEL,
                limit: int | None = None, multi_line: bool = True) -> DataFrame:
    """All issues with a label, open or closed, or only the newest ``limit`` of them."""
    issues = spark.read.schema(schemas.ISSUE).option("multiLine", multi_line).json(path)
    found = labelled(issues, label)
    if limit is None:
        return found
    return found.orderBy(F.col("createdAt").desc(), F.col("number").desc()).limit(limit)


def one_line(df: DataFrame) -> DataFrame:
    """Nulls as empty text and newlines as spaces in all text columns."""
    return df.withColumns({
        name: F.regexp_replace(F.coalesce(F.col(name), F.lit("")), "\n", " ")
        for name, kind in df.dtypes if kind == "string"})


def write_reports_csv(reports: DataFrame, path: str, mode: str = "error") -> None:
    one_line(reports).write.mode(mode).options(
        header=True, quote='"', escape='"', nullValue="", emptyValue="").csv(path)
