"""Streams against their batch twins, over several micro-batches."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from imgaudit import schemas
from imgaudit.operators import serving
from imgaudit.streaming import pages, sinks, verdicts

EVENTS = "event_id long, ts timestamp, page long, url string, error string, score double"


def _rows(start, stop):
    out = []
    for i in range(start, stop):
        error = (None, "fetch 503", "fetch 503", "too-small", "fetch 503")[i * 7 % 5]
        out.append((i, f"2025-01-01 00:{i // 60:02d}:{i % 60:02d}", i % 3, f"u{i % 11}", error,
                    None if error else i / 1000))
    return out


@pytest.fixture()
def feed(spark, tmp_path):
    """A folder fed file by file, and the stream that reads one file per batch."""
    folder = tmp_path / "feed"

    def add(start, stop):
        df = spark.createDataFrame(_rows(start, stop), EVENTS.replace("timestamp", "string"))
        df.coalesce(1).withColumn("ts", F.to_timestamp("ts")).write.mode("append").parquet(str(folder))
    add(0, 1)
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(folder))
    return add, stream, spark.read.schema(EVENTS).parquet(str(folder)).schema, str(folder)


def test_retries_carry_over_batches(spark, feed, tmp_path):
    add, stream, _, folder = feed
    retries = sinks.Retries(str(tmp_path / "retries"), "3650 days")
    for start in (1, 60, 120):
        add(start, {1: 60, 60: 120, 120: 200}[start])
        sinks.drain(stream, retries.write, str(tmp_path / "checkpoint"))
    columns = ["event_id", "failures", "decision", "delay_ms"]
    streamed = retries.read(spark).select(columns)
    batch = serving.retry_plan(spark.read.schema(EVENTS).parquet(folder), ["page", "url"],
                               "event_id").select(columns)
    assert sorted(map(tuple, streamed.collect()), key=repr) == sorted(map(tuple, batch.collect()), key=repr)
    due = retries.due(spark, F.current_timestamp() + F.expr("INTERVAL 1 HOUR"))
    assert {r.decision for r in due.collect()} == {"retry"}
    assert retries.due(spark, F.current_timestamp() - F.expr("INTERVAL 1 HOUR")).count() == 0


def test_repeated_batch_replaces_itself(spark, tmp_path):
    retries = sinks.Retries(str(tmp_path / "r"), "1 day")
    batch = spark.createDataFrame(_rows(0, 40), EVENTS.replace("timestamp", "string")).withColumn(
        "ts", F.to_timestamp("ts"))
    for _ in range(2):
        retries.write(batch, 0)
    assert retries.read(spark).count() == 40


def test_page_stats_update(spark, feed, tmp_path):
    add, stream, _, folder = feed
    add(1, 90)
    add(90, 150)
    root = str(tmp_path / "stats")
    sinks.drain(verdicts.running_page_stats(stream), sinks.table_writer(f"{root}/t"), f"{root}/c",
                "update")
    updates = sinks.read_table(spark, f"{root}/t", "page long, analyzed long, flagged long")
    found = sinks.latest(updates, "page")
    twin = verdicts.running_page_stats(spark.read.schema(EVENTS).parquet(folder))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, twin.collect()))


def test_mirror_keeps_newest_and_drops_other_models(spark, tmp_path):
    def batch(urls, start):
        return spark.createDataFrame([(u, 0.5, start + i) for i, u in enumerate(urls)],
                                     "url string, score double, seq long")
    version = ["m1"]
    mirror = sinks.Mirror(str(tmp_path / "mirror"), lambda _: version[0], capacity=3)
    mirror.write(batch(["a", "b", "c", "d"], 0), 0)
    assert {r.url for r in mirror.read(spark, 0).collect()} == {"b", "c", "d"}
    mirror.write(batch(["b", "e"], 10), 1)  # b is held already and keeps its place
    assert {r.url for r in mirror.read(spark, 1).collect()} == {"c", "d", "e"}
    version[0] = "m2"
    mirror.write(batch(["c"], 20), 2)
    assert [(r.url, r.model_version) for r in mirror.read(spark, 2).collect()] == [("c", "m2")]
    mirror.write(batch(["c"], 20), 2)  # the same batch again
    assert mirror.read(spark, 2).count() == 1


def test_first_request_per_url_over_batches(spark, tmp_path):
    def batch(rows):
        return spark.createDataFrame(rows, "url string, event_id long, score double")
    sink = sinks.FirstPerUrl(str(tmp_path / "t"), "url string, event_id long, score double")
    sink.write(batch([("a", 3, 0.3), ("a", 1, 0.1), ("b", 2, 0.2)]), 0)
    for _ in range(2):  # the second batch is repeated
        sink.write(batch([("a", 0, 0.0), ("c", 9, 0.9), ("c", 8, 0.8), ("d", 7, 0.7)]), 1)
    rows = sink.read(spark).select("url", "event_id", "score").collect()
    assert sorted(map(tuple, rows)) == [("a", 1, 0.1), ("b", 2, 0.2), ("c", 8, 0.8), ("d", 7, 0.7)]


def test_latest_edit_of_an_issue_wins_over_batches(spark, tmp_path):
    def issue(said, edited):
        body = f"### What is the image actually?\n\nAI-generated\n\n### What did it say?\n\n{said}\n"
        return (7, "misclassification", body, None, [("consistent",)], edited)
    fields = schemas.ISSUE.simpleString()[len("struct<"):-1]

    def batch(*rows):
        return spark.createDataFrame(rows, "struct<" + fields + ",edited:string>").withColumn(
            "edited", F.to_timestamp("edited"))
    write, root = sinks.label_writer(str(tmp_path / "labels")), str(tmp_path / "labels")
    write(batch(issue("AI 99%", "2025-01-01"), issue("12%", "2025-01-03")), 0)
    write(batch(issue("AI 51%", "2025-01-02")), 1)  # an older edit that comes late
    rows = sinks.read_labels(spark, root).collect()
    assert [(r.number, r.klass, r.remove) for r in rows] == [(7, "false-negative", ["consistent"])]
    write(batch(issue("AI 51%", "2025-01-04")), 2)
    assert [r.klass for r in sinks.read_labels(spark, root).collect()] == ["borderline-miss"]


def test_silent_images_are_forgotten(spark, tmp_path):
    retries = sinks.Retries(str(tmp_path / "r"), forget="10 seconds")
    batch = spark.createDataFrame(
        [(0, "2025-01-01 00:00:00", 1, "a", "fetch 503", None), (1, "2025-01-01 00:01:00", 2, "b", "fetch 503", None)],
        EVENTS.replace("timestamp", "string")).withColumn("ts", F.to_timestamp("ts"))
    retries.write(batch, 0)
    later = F.current_timestamp() + F.expr("INTERVAL 1 HOUR")
    assert [r.url for r in retries.due(spark, later).collect()] == ["b"]


def test_mirror_restores_only_matching_entries(spark):
    cache = spark.createDataFrame([("a", 0.1, 1)], "url string, score double, seq long")
    mirror = spark.createDataFrame([("a", 0.9, 5, "m1"), ("b", 0.9, 6, "m1"), ("c", 0.9, 7, "m0")],
                                   "url string, score double, seq long, model_version string")
    restored = serving.restore_cache(cache, mirror, "m1").collect()
    assert {(r.url, r.score) for r in restored} == {("a", 0.1), ("b", 0.9)}


def test_restored_query_keeps_rows_that_share_a_url(spark, tmp_path):
    pages = [(0, "a"), (2, "a"), (4, None), (6, "b"), (8, "c"), (12, None), (14, "b"), (16, "a"), (18, "a"), (22, None)]
    spark.createDataFrame([(*p, "") for p in pages], "page_id long, url string, html string").write.parquet(
        f"{tmp_path}/pages.parquet")
    found = driver.queries()["invalidate_on_model_change"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = con.execute(driver.oracle_sql()["invalidate_on_model_change"]).fetchall()
    assert sorted(r.seq for r in found.collect()) == sorted(seq for seq, _ in want) and len(want) == 9


def _hours(start, stop):
    """Events of ``start`` to ``stop`` hours, every ten minutes, of five pages and one without an id."""
    rows = []
    for i in range(start * 6, stop * 6):
        score = None if i % 4 == 0 else (i * 37 % 100) / 100
        rows.append((i, f"2025-01-{1 + i // 144:02d} {i // 6 % 24:02d}:{i % 6 * 10:02d}:00",
                     (0, 1, 2, 3, None)[i % 5], f"u{i}", None, score))
    return rows


def test_page_windows_end_and_totals_stay(spark, tmp_path):
    """Twenty batches, half of them after a restart: state stays as small, totals equal the batch query."""
    feed, root, rows = str(tmp_path / "feed"), str(tmp_path / "totals"), []
    (tmp_path / "feed").mkdir()
    totals = pages.PageTotals(root, "3 hours", every=4)
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(feed)
    seen = []
    for start in (0, 10):
        for i in range(start, start + 10):
            new = _hours(i * 4, i * 4 + 4) + (_hours(i * 4 - 2, i * 4 - 1) if i else [])  # an hour twice, in time
            rows += new
            spark.createDataFrame(new, EVENTS.replace("timestamp", "string")).coalesce(1).withColumn(
                "ts", F.to_timestamp("ts")).write.mode("append").parquet(feed)
        query = sinks.start(pages.windowed_page_stats(stream, "ts", "3 hours", "1 hour"), totals.write,
                            str(tmp_path / "checkpoint"), "update")
        query.awaitTermination()
        seen += [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert len(seen) >= 20 and max(seen) <= 5 * (4 + 3 + 4 + 1)
    frame = spark.createDataFrame(rows, EVENTS.replace("timestamp", "string"))
    want = sorted(map(tuple, verdicts.running_page_stats(frame).collect()), key=repr)
    assert sorted(map(tuple, totals.read(spark).collect()), key=repr) == want
    import os
    kinds = [name.split("-")[0] for name in os.listdir(root)]
    assert kinds.count("open") <= 2 and kinds.count("base") <= 2 and kinds.count("closed") <= 8


def test_page_window_batch_may_be_repeated(spark, tmp_path):
    totals = pages.PageTotals(str(tmp_path / "t"), "1 hour", every=2)

    def batch(*rows):
        return spark.createDataFrame(rows, "start string, end string, page long, analyzed long, flagged long").withColumns(
            {c: F.to_timestamp(c) for c in ("start", "end")})
    first = batch(("2025-01-01 00:00", "2025-01-01 01:00", 1, 5, 1), ("2025-01-01 01:00", "2025-01-01 02:00", 1, 2, 0))
    second = batch(("2025-01-01 01:00", "2025-01-01 02:00", 1, 4, 2), ("2025-01-01 05:00", "2025-01-01 06:00", 2, 1, 1))
    third = batch(("2025-01-01 05:00", "2025-01-01 06:00", 2, 3, 1))
    for i, rows in enumerate((first, first, second, second, third, third)):
        totals.write(rows, i // 2)
    assert sorted(map(tuple, totals.read(spark).collect())) == [(1, 9, 3), (2, 3, 1)]
    assert pages.PageTotals(str(tmp_path / "none"), "1 hour").read(spark).count() == 0
