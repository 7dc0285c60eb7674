"""Timed retries and leases: against replays, over restarts, and by the processing clock."""

import random
import time as clock_time

import pytest
from pyspark.sql import functions as F

from imgaudit.operators import serving
from imgaudit.streaming import stateful

EVENTS = "event_id long, ts timestamp, page long, url string, error string, score double"
START = 1_700_000_000_000


@pytest.fixture()
def feed(spark, tmp_path):
    """A folder fed file by file, the stream that reads one file per batch, and where it goes."""
    def make(schema):
        folder = str(tmp_path / "feed")

        def add(rows):
            plain = schema.replace("ts timestamp", "ts long")
            spark.createDataFrame(rows, plain).coalesce(1).withColumn(
                "ts", F.timestamp_millis("ts")).write.mode("append").parquet(folder)
        add([])
        return add, lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return make


def _run(stream, root, every=None):
    writer = stream.writeStream.format("parquet").option("path", f"{root}/out").option(
        "checkpointLocation", f"{root}/checkpoint")
    if every:
        return writer.trigger(processingTime=every).start()
    writer.trigger(availableNow=True).start().awaitTermination()
    return None


def _out(spark, root):
    return spark.read.parquet(f"{root}/out")


def _events(rng, n, start=0):
    rows = []
    for i in range(start, start + n):
        error = rng.choice([None, "fetch 503", "fetch 503", "fetch 503", "too-small"])
        rows.append((i, START + i * 700, rng.choice([1, 2, None]), f"u{rng.randrange(6)}", error, None if error else 0.5))
    return rows


def _due(rows):
    """Retries that fall due before the key's next attempt, replayed one by one."""
    state, found, last = {}, [], {}
    for i, ts, page, url, error, _ in rows:
        key = (page, url)
        failures = state.get(key, 0)
        if key in last and last[key] is not None and last[key][1] < ts:
            found.append(last[key])
        last[key] = None
        failures = 0 if error is None else failures + (error == "fetch 503")
        if error == "fetch 503" and failures <= 3:
            last[key] = (i, ts + 3000 * failures, failures)
        state[key] = failures
    return found, [v for v in last.values() if v]


def test_retries_over_batches_equal_the_batch_twin(spark, feed, tmp_path):
    add, stream = feed(EVENTS)
    rows = _events(random.Random(1), 400)
    for at in range(0, 400, 100):  # the query stops and starts again between any two files
        add(rows[at:at + 100])
        _run(stateful.retries(stream(), clock="event", forget="365 days", buckets=4), str(tmp_path))
    add([(1000, START + 10**7, 9, "end", None, 0.5)])
    _run(stateful.retries(stream(), clock="event", forget="365 days", buckets=4), str(tmp_path))
    out = _out(spark, tmp_path)
    batch = spark.createDataFrame(rows, EVENTS.replace("ts timestamp", "ts long")).withColumn(
        "ts", F.timestamp_millis("ts"))
    want = serving.retry_plan(batch, ["page", "url"], "event_id").select("event_id", "failures", "decision")
    got = out.filter("decision != 'due' and event_id < 1000").select("event_id", "failures", "decision")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    due = {(r.event_id, r.failures) for r in out.filter("decision = 'due'").collect()}
    between, last = _due(rows)
    assert {(i, n) for i, _, n in last} <= due <= {(i, n) for i, _, n in between + last}


def test_state_ends(spark, feed, tmp_path):
    """After a success at once, after a silence when it has lasted."""
    add, stream = feed(EVENTS)
    add([(0, START, 1, "ok", "fetch 503", None), (1, START + 1, 1, "ok", None, 0.5),
         (2, START + 2, 1, "open", "fetch 503", None)])
    add([(3, START + 3_600_000, 2, "later", None, 0.5)])
    add([(4, START + 7_200_000, 2, "later", None, 0.5)])
    query = stateful.retries(stream(), clock="event", forget="30 minutes", buckets=2).writeStream.format(
        "memory").queryName("ends").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(rows) == 1 and rows[-1] == 0
    assert [(r.event_id, r.decision) for r in spark.table("ends").filter("url = 'open'").collect()] == [
        (2, "retry"), (2, "due")]


def test_due_retry_comes_out_unasked_after_a_restart(spark, feed, tmp_path):
    """The stream stops between the failure and its time, and no row arrives any more."""
    add, stream = feed(EVENTS)
    add([(0, START, 1, "a", "fetch 503", None), (1, START, 1, "b", None, 0.4)])
    for wanted in ("retry", "due"):
        query = _run(stateful.retries(stream(), buckets=2), str(tmp_path), every="500 milliseconds")
        try:
            for _ in range(120):
                clock_time.sleep(0.5)
                if query.exception():
                    raise query.exception()
                done = query.lastProgress is not None and (tmp_path / "out").exists()
                if done and wanted in {r.decision for r in _out(spark, tmp_path).filter("event_id = 0").collect()}:
                    break
            else:
                raise AssertionError(f"no {wanted}")
        finally:
            query.stop()
            query.awaitTermination(30)
    rows = _out(spark, tmp_path).filter("event_id = 0").orderBy("decision").collect()
    assert [(r.decision, r.failures) for r in rows] == [("due", 1), ("retry", 1)]


REQUESTS = "ts timestamp, url string, id long, at long, asks boolean, score double, error string"


def _replay(rows, lease, keep):
    """Lease decisions one by one; only for rows within one batch of their time."""
    state, out = {}, []
    for ts, url, own, _, asks, score, error in rows:
        holder, cached, ends = state.get(url, (None, None, 0))
        if holder is not None and ts >= ends:
            if cached is None:
                out.append((holder, "expired", holder, None))
            holder = cached = None
        if asks:
            if holder is None:
                holder, ends = own, ts + lease
                out.append((own, "infer", own, None))
            else:
                out.append((own, "joined" if cached is None else "cached", holder, cached))
        elif holder != own or cached is not None:
            out.append((own, "ignored", holder, None))
        elif error is None:
            cached, ends = score, ts + keep
            out.append((own, "done", own, score))
        else:
            out.append((own, "failed", own, None))
            holder = None
        state[url] = (holder, cached, ends)
    return out


def test_leases_equal_a_replay(spark, feed, tmp_path):
    add, stream = feed(REQUESTS)
    rng = random.Random(2)
    rows = []
    for i in range(600):
        asks = rng.random() < 0.6
        error = None if asks or rng.random() < 0.5 else "fetch 503"
        rows.append((START + i * 1000, f"u{rng.randrange(8)}", i if asks else rng.randrange(max(0, i - 40), i + 1),
                     i, asks, None if asks or error else i / 1000, error))
    for at in range(0, 600, 200):
        add(rows[at:at + 200])
    arriving = stream()
    found = stateful.leases(arriving.filter("asks"), arriving.filter("not asks"), clock="event", lease="20 seconds",
                            keep="90 seconds", buckets=3)
    _run(found, str(tmp_path))
    got = _out(spark, tmp_path).select("id", "action", "lease", "score").collect()
    want = _replay(rows, 20_000, 90_000)

    def without_ends(found):  # a last lease may still be open, as nothing came after it
        return sorted((tuple(r) for r in found if r[1] != "expired"), key=repr)

    assert without_ends(got) == without_ends(want)
    expired = [r[0] for r in want if r[1] == "expired"]
    assert set(expired) <= {r.id for r in got if r.action == "expired"} and expired
    infers = sum(r.action == "infer" for r in got)
    assert infers == sum(r[1] == "infer" for r in want) < 200


def test_lost_worker_lets_the_next_request_infer(spark, feed, tmp_path):
    add, stream = feed(REQUESTS)
    add([(START, "u", 1, 1, True, None, None), (START + 10, "u", 2, 2, True, None, None)])
    add([(START + 70_000, "u", 3, 3, True, None, None), (START + 70_500, "u", 1, 4, False, 0.9, None),
         (START + 71_000, "u", 3, 5, False, 0.3, None), (START + 71_500, "u", 4, 6, True, None, None)])
    for _ in range(2):  # the second run starts from the checkpoint and finds nothing new
        arriving = stream()
        _run(stateful.leases(arriving.filter("asks"), arriving.filter("not asks"), clock="event", buckets=1), str(tmp_path))
    got = _out(spark, tmp_path).collect()
    assert sorted((r.id, r.action, r.lease) for r in got) == sorted([
        (1, "infer", 1), (2, "joined", 1), (1, "expired", 1), (3, "infer", 3), (1, "ignored", 3), (3, "done", 3),
        (4, "cached", 3)])
    assert [r.score for r in got if r.action == "cached"] == [0.3]


def test_unknown_clock(spark, feed):
    with pytest.raises(ValueError):
        stateful.retries(feed(EVENTS)[1](), clock="wall")
