"""Streaming queries run over the whole tables until their input is used up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, TimestampType

from imgaudit import schemas
from imgaudit.functions.web import tag_pattern
from imgaudit.plans import views
from imgaudit.plans.evidence import MINED
from imgaudit.plans.registry import Tables, query, rounded
from imgaudit.plans.views import sql
from imgaudit.session import shared_dir
from imgaudit.streaming import pages, sinks, stateful, verdicts


def _event_stream(t: Tables) -> DataFrame:
    return t.stream("events").selectExpr(*views.EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))


def _run(t: Tables, name: str, stream: DataFrame, schema: str, mode: str = "append") -> DataFrame:
    root = shared_dir(t.spark, name)
    sinks.drain(stream, sinks.table_writer(f"{root}/table"), f"{root}/checkpoint", mode)
    return sinks.read_table(t.spark, f"{root}/table", schema)


def _parts(t: Tables, name: str, df: DataFrame, order: str, count: int = 3) -> str:
    """Rows written as files that follow each other in an order, so that streams run several batches."""
    root = shared_dir(t.spark, f"{name}-input")
    for i in range(count):
        df.filter(F.pmod(F.col(order), F.lit(count)) == i).repartition(1).write.mode("append").parquet(root)
    return root


def _event_parts(t: Tables, name: str) -> DataFrame:
    root = _parts(t, name, views.verdict_events(t).withColumn("ts", F.col("ts").cast("timestamp")), "event_id")
    schema = t.spark.read.parquet(root).schema
    return t.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(root)


@query(sql("verdict_events", """
    parts AS (SELECT *, min(event_id % 3) OVER (PARTITION BY url) AS batch FROM verdict_events
        WHERE error IS NULL)
    SELECT url, min(event_id) AS event_id, round(arg_min(score, event_id), 6) AS score FROM parts
    WHERE event_id % 3 = batch GROUP BY url"""))
def stream_dedupe(t: Tables) -> DataFrame:
    """Three batches: a url is served by its first success in the first batch that has one."""
    events = _event_parts(t, "stream-dedupe").filter("error IS NULL").select("url", "event_id", "score")
    root = shared_dir(t.spark, "stream-dedupe")
    sink = sinks.FirstPerUrl(f"{root}/table", "url string, event_id long, score double")
    sinks.drain(events, sink.write, f"{root}/checkpoint")
    return rounded(sink.read(t.spark).select("url", "event_id", "score"), "score")


@query(sql("verdict_events", """
    runs AS (SELECT page, url, event_id, error, sum(CASE WHEN error IS NULL THEN 1 ELSE 0 END) OVER (
        PARTITION BY page, url ORDER BY event_id) AS run FROM verdict_events),
    counted AS (SELECT *, sum(CASE WHEN error = 'fetch 503' THEN 1 ELSE 0 END) OVER (
        PARTITION BY page, url, run ORDER BY event_id) AS failures FROM runs)
    SELECT event_id, CAST(failures AS BIGINT) AS failures, CASE WHEN error IS NULL THEN 'ok'
        WHEN error = 'too-small' THEN 'never' WHEN failures <= 3 THEN 'retry' ELSE 'give-up' END
        AS decision FROM counted"""))
def stream_retry(t: Tables) -> DataFrame:
    retries = sinks.Retries(shared_dir(t.spark, "stream-retry"), forget="3650 days")
    sinks.drain(_event_stream(t), retries.write, f"{retries.root}/checkpoint")
    return retries.read(t.spark).select("event_id", "failures", "decision")


@query(sql("verdict_events", """
    runs AS (SELECT page, url, event_id, ts, error, sum(CASE WHEN error IS NULL THEN 1 ELSE 0 END) OVER (
        PARTITION BY page, url ORDER BY event_id) AS run FROM verdict_events),
    counted AS (SELECT *, sum(CASE WHEN error = 'fetch 503' THEN 1 ELSE 0 END) OVER (
        PARTITION BY page, url, run ORDER BY event_id) AS failures,
        row_number() OVER (PARTITION BY page, url ORDER BY event_id DESC) AS age FROM runs),
    decided AS (SELECT *, CASE WHEN error IS NULL THEN 'ok' WHEN error = 'too-small' THEN 'never'
        WHEN failures <= 3 THEN 'retry' ELSE 'give-up' END AS decision FROM counted)
    SELECT event_id, CAST(failures AS BIGINT) AS failures, decision FROM decided
    UNION ALL SELECT event_id, CAST(failures AS BIGINT), 'due' FROM decided
    WHERE age = 1 AND decision = 'retry' AND epoch_ms(ts) + 3000 * failures
        < (SELECT max(epoch_ms(ts)) FROM verdict_events)"""))
def stream_due_retries(t: Tables) -> DataFrame:
    """Decisions, and the retries that fall due by the events' own clock before their end."""
    found = stateful.retries(_event_stream(t), clock="event", forget="3650 days")
    return _run(t, "stream-due", found.select("event_id", "failures", "decision"),
                "event_id long, failures long, decision string").drop("batch")


@query(sql("verdict_events", """
    SELECT page, count(score) AS analyzed, count(*) FILTER (score >= 0.65e0) AS flagged
    FROM verdict_events GROUP BY page"""))
def stream_page_windows(t: Tables) -> DataFrame:
    """Days that end behind the watermark are folded into the base table; no row comes late."""
    root = shared_dir(t.spark, "stream-windows")
    events = views.verdict_events(t).withColumn("ts", F.col("ts").cast("timestamp"))
    last = events.agg(F.max("event_id") + 1).scalar()
    for i in range(4):  # files of rising time: each append is newer than the one before
        events.filter(F.floor(F.col("event_id") * 4 / last) == i).write.mode("append").parquet(f"{root}/input")
    arriving = t.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 4).parquet(f"{root}/input")
    totals = pages.PageTotals(f"{root}/totals", "15 days", every=2)
    sinks.drain(pages.windowed_page_stats(arriving, "ts", "15 days", "1 day"), totals.write,
                f"{root}/checkpoint", "update")
    return totals.read(t.spark)


_IN_FLIGHT = 900  # events between a request and its result


@query(sql("verdict_events", f"""
    after AS (SELECT a.event_id, min(b.event_id) AS following FROM verdict_events a
        LEFT JOIN verdict_events b ON a.url = b.url AND b.event_id > a.event_id + {_IN_FLIGHT} GROUP BY ALL),
    granted AS (SELECT e.event_id, e.url, e.error, e.score, n.following FROM verdict_events e
        JOIN after n ON e.event_id = n.event_id),
    leases AS (SELECT * FROM granted WHERE event_id IN (SELECT min(event_id) FROM verdict_events GROUP BY url)
        UNION ALL SELECT g.* FROM leases l JOIN granted g ON g.event_id = l.following WHERE l.error IS NOT NULL),
    owned AS (SELECT e.event_id, max(l.event_id) AS lease FROM verdict_events e
        JOIN leases l ON l.url = e.url AND l.event_id <= e.event_id GROUP BY ALL)
    SELECT o.event_id, CASE WHEN o.event_id = o.lease THEN 'infer'
        WHEN o.event_id <= o.lease + {_IN_FLIGHT} THEN 'joined' ELSE 'cached' END AS action, o.lease,
        round(CASE WHEN o.event_id > o.lease + {_IN_FLIGHT} THEN l.score END, 6) AS score
    FROM owned o JOIN leases l ON l.event_id = o.lease
    UNION ALL SELECT event_id, CASE WHEN error IS NULL THEN 'done' ELSE 'failed' END, event_id,
        round(score, 6) FROM leases""").replace("WITH ", "WITH RECURSIVE ", 1))
def stream_leases(t: Tables) -> DataFrame:
    """Every event asks; its result, if it is the one that infers, comes some events later."""
    events = _event_stream(t).withColumn("id", F.col("event_id"))
    asked = events.select("url", "id", "ts", (F.col("id") * 2).alias("at"))
    told = events.select("url", "id", "ts", "score", "error", ((F.col("id") + _IN_FLIGHT) * 2 + 1).alias("at"))
    found = stateful.leases(asked, told, clock="event", lease="3650 days", keep="3650 days")
    rows = _run(t, "stream-leases", found.select("id", "action", "lease", "score"),
                "id long, action string, lease long, score double")
    return rounded(rows.filter("action != 'ignored'").select(
        F.col("id").alias("event_id"), "action", "lease", "score"), "score")


@query(sql("verdict_events", """
    SELECT page, count(score) AS analyzed, count(*) FILTER (score >= 0.65e0) AS flagged
    FROM verdict_events GROUP BY page"""))
def stream_page_stats(t: Tables) -> DataFrame:
    updates = _run(t, "stream-pages", verdicts.running_page_stats(_event_stream(t)),
                   "page long, analyzed long, flagged long", "update")
    return sinks.latest(updates, "page")


@query(sql("verdict_events", """
    parts AS (SELECT *, min(event_id % 3) OVER (PARTITION BY url) AS batch FROM verdict_events
        WHERE error IS NULL)
    SELECT url, min(event_id) AS seq, round(arg_min(score, event_id), 6) AS score,
        'cur' AS model_version
    FROM parts WHERE event_id % 3 = batch GROUP BY url ORDER BY seq DESC LIMIT 390"""))
def stream_mirror(t: Tables) -> DataFrame:
    """Two runs of three batches: the second finds the mirror of another model and drops it.

    The first capacity evicts. The second holds all urls, of which the newest are compared.
    """
    root = shared_dir(t.spark, "stream-mirror")
    events = _event_parts(t, "stream-mirror").select("url", "score", F.col("event_id").alias("seq"))
    mirrors = [sinks.Mirror(f"{root}/mirror", lambda _, v=v: v, n) for v, n in (("old", 50), ("cur", 400))]
    sinks.drain(events, mirrors[0].write, f"{root}/checkpoint-old")
    sinks.drain(events, lambda batch, i: mirrors[1].write(batch, i + 3), f"{root}/checkpoint-cur")
    kept = mirrors[1].read(t.spark, 5).orderBy(F.desc("seq")).limit(390)
    return rounded(kept, "score")


@query(rf"""
    SELECT DISTINCT page_id, src FROM (SELECT page_id, unnest([trim(x, '"''') FOR x IN
        regexp_extract_all(html, '{tag_pattern("a", "href").replace("'", "''")}', 1)]) AS src FROM pages)
    WHERE src <> '' AND NOT starts_with(src, 'blob:')""")
def stream_discovery(t: Tables) -> DataFrame:
    pages = t.stream("pages").select(
        "page_id", "html", F.col("_metadata.file_modification_time").alias("seen"))
    found = verdicts.discover_images(pages, "seen", "3650 days", "a", "href")
    return _run(t, "stream-discovery", found.select("page_id", "src"),
                "page_id long, src string").drop("batch")


@query(sql("reports", f"""
    {MINED} SELECT issue AS number, klass, concat('misclassification,', klass) AS added,
        CASE WHEN issue % 3 = 0 AND klass <> 'consistent' THEN 'consistent'
            WHEN issue % 3 = 1 AND klass <> 'false-positive' THEN 'false-positive' ELSE '' END AS removed
    FROM classed WHERE issue % 5 <> 0 OR issue % 3 = 0"""))
def stream_reports(t: Tables) -> DataFrame:
    """Issues arriving three times in as many batches; the latest edit comes in the middle."""
    root = shared_dir(t.spark, "stream-reports")
    issues = views.report_bodies(t)
    unread = issues.withColumn("body", F.lit("### What did it say?\n\nno idea"))
    for version, edited in ((unread, 1), (issues, 3), (unread, 2)):
        version.withColumn("edited", F.timestamp_seconds(F.lit(edited))).repartition(1).write.mode(
            "append").json(f"{root}/issues")
    schema = StructType([*schemas.ISSUE.fields, StructField("edited", TimestampType())])
    arriving = t.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{root}/issues")
    sinks.drain(arriving, sinks.label_writer(f"{root}/table"), f"{root}/checkpoint")
    return sinks.read_labels(t.spark, f"{root}/table").select(
        "number", "klass", F.array_join("add", ",").alias("added"), F.array_join("remove", ",").alias("removed"))
