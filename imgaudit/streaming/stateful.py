"""Retries that fall due and inference leases, as keyed state with timeouts.

Keys are dealt into buckets by a hash, and the state of a bucket holds a few numbers per open
key, which go when the key is over. State and rows travel in the same Arrow batches, so a key
costs neither a call nor a table of its own, and a bucket wakes at the earliest time that any of
its keys waits for. ``clock`` says what time is: ``processing``, for streams that run on, where
a timeout fires with the trigger after it; or ``event``, by the rows' own times and the
watermark, which gives the same result on every run, and drops rows that come later than
``delay`` behind the newest, which the query's progress counts. A stream of the first kind never
runs out of work, so start it with an interval; one of the second kind may also run until its
input is used up. The number of buckets is fixed for the life of a checkpoint.

A bucket's rows of one batch are put in order by a column, so only narrow columns are held; rows
without a value there are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from imgaudit import fixed_values as fixed
from imgaudit.functions.web import error_class

CLOCKS = {"processing": GroupStateTimeout.ProcessingTimeTimeout, "event": GroupStateTimeout.EventTimeTimeout}
BUCKETS = 256
WHOLE = ("bigint", "int", "smallint", "tinyint")

#: What becomes of a key: its new values, the last of which is the time to wake, or None.
Entry = tuple | None


def _millis(interval: str) -> int:
    return int(pd.Timedelta(interval).total_seconds() * 1000)


def _plain(values: list, kind: str) -> list:
    """Python values of a column; a missing one is None and whole numbers stay whole."""
    return [None if pd.isna(v) else int(v) if kind in WHOLE else v for v in values]


def _bucketed(rows: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], output: Sequence[str],
              held: Sequence[str], arrives: Callable[..., Entry], wakes: Callable[..., Entry], clock: str,
              buckets: int) -> DataFrame:
    """Run two transitions over the keys of every bucket; both may append rows to a list.

    ``arrives(key, entry, now, order, values, out)`` is called for each row in order, and
    ``wakes(key, entry, out)`` for a key whose time has come and that has no row in the batch.
    ``output`` and ``held`` are "name type" of the result and of an entry's values.
    """
    types, n = dict(rows.dtypes), len(keys)
    read = [order, "_time", *keys, *columns]
    kinds = [types[c] for c in read]
    names = [c.split()[0].strip("`") for c in output]
    event = clock == "event"
    schema = ", ".join([f"k{i} array<{types[k]}>" for i, k in enumerate(keys)]
                       + ["{} array<{}>".format(*f.split()) for f in held])

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = {row[:n]: row[n:] for row in zip(*state.get)} if state.exists else {}
        clock_now = None if event else state.getCurrentProcessingTimeMs()
        out, touched = [], set()
        if not state.hasTimedOut:
            read_rows = [row for frame in frames for row in zip(*(
                _plain(frame[c].tolist(), kind) for c, kind in zip(read, kinds)))]
            for row in sorted((row for row in read_rows if row[0] is not None), key=lambda row: row[0]):
                own = row[2:2 + n]
                touched.add(own)
                known[own] = arrives(own, known.get(own), row[1] if event else clock_now, row[0], row[2 + n:], out)
        over = state.getCurrentWatermarkMs() if event else clock_now + 1
        for own, entry in known.items():
            if entry is not None and own not in touched and entry[-1] < over:
                known[own] = wakes(own, entry, out)
        known = {own: entry for own, entry in known.items() if entry is not None}
        if known:
            state.update(tuple(list(c) for c in zip(*(own + entry for own, entry in known.items()))))
            first = min(entry[-1] for entry in known.values())
            if event:
                state.setTimeoutTimestamp(max(first, state.getCurrentWatermarkMs() + 1))
            else:
                state.setTimeoutDuration(max(1, first - clock_now))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in zip(names, zip(*out))})

    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    return dealt.groupBy("_bucket").applyInPandasWithState(
        step, ", ".join(output), schema, "append", CLOCKS[clock])


def _timed(df: DataFrame, time: str, delay: str, clock: str) -> DataFrame:
    """Add ``_time`` in milliseconds; the time itself stays, as it carries the watermark.

    By the processing clock a row of nulls comes in every second: a query that starts again
    runs no batch before a row arrives, and so would miss what falls due until then.
    """
    if clock not in CLOCKS:
        raise ValueError(f"clock must be one of {sorted(CLOCKS)}")
    if clock == "event":
        df = df.withWatermark(time, delay)
    elif df.isStreaming:
        ticks = df.sparkSession.readStream.format("rate").option("rowsPerSecond", 1).load()
        df = df.unionByName(ticks.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema]))
    return df.withColumn("_time", F.unix_millis(F.col(time).cast("timestamp")))


# ------------------------------------------------------------------ retries

def retries(attempts: DataFrame, keys: Sequence[str] = ("page", "url"), order: str = "event_id",
            time: str = "ts", clock: str = "processing", delay: str = "0 seconds",
            forget: str = "7 days", thrown: Column | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Decisions on attempts, and the retries themselves when they fall due, as one stream.

    One row per attempt: keys, the order column, ``decision`` (ok, never, again, retry, give-up),
    ``failures`` since the last success, and ``due`` for retries. When that time comes and no
    other attempt was made, a row with decision ``due`` comes out unasked. State ends with a
    success; after the last retry, a give-up or a silence it ends when ``forget`` has passed, and
    until then further failures go on counting, as ``retry_plan`` counts them.
    """
    silence, names = _millis(forget), list(keys)
    kind = F.when(F.lit(False) if thrown is None else F.coalesce(thrown, F.lit(False)), "thrown").otherwise(
        F.coalesce(error_class("error"), F.lit("ok")))
    rows = _timed(attempts, time, delay, clock).select(
        *names, order, "_time", kind.alias("_kind"), F.col(time).alias("_watermark"))
    types = dict(rows.dtypes)
    output = [f"`{c}` {types[c]}" for c in (*names, order)] + ["decision string", "failures long", "_due long"]
    held = ["failures long", f"at {types[order]}", "due long", "seen long", "wake long"]

    def arrives(key, entry, now, at, values, out) -> Entry:
        failures, due, (kind,) = entry[0] if entry else 0, None, values
        decision = {"permanent": "never", "thrown": "again"}.get(kind, kind)
        if kind == "ok":
            failures = 0
        elif kind == "transient":
            failures += 1
            decision = "retry" if failures <= fixed.MAX_RETRIES else "give-up"
            due = now + fixed.RETRY_STEP_MS * failures if decision == "retry" else None
        out.append((*key, at, decision, failures, due))
        return (failures, at, due, now, now + silence if due is None else due) if failures else None

    def wakes(key, entry, out) -> Entry:
        failures, at, due, seen, _ = entry
        if due is None:
            return None
        out.append((*key, at, "due", failures, due))
        return failures, at, None, seen, seen + max(silence, due - seen + 1)

    found = _bucketed(rows, names, order, ["_kind"], output, held, arrives, wakes, clock, buckets)
    return found.withColumn("due", F.timestamp_millis("_due")).drop("_due")


# ------------------------------------------------------------------ leases

def leases(requests: DataFrame, results: DataFrame, order: str = "at", time: str = "ts",
           clock: str = "processing", delay: str = "0 seconds", lease: str = "1 minute",
           keep: str = "30 days", buckets: int = BUCKETS) -> DataFrame:
    """Who infers a url: of many requests, in a batch and across batches, exactly one at a time.

    ``requests`` have url, id, the order and the time; ``results`` have url, the id of the
    request they answer (``id``), ``score`` or ``error``, order and time. One row per request
    with ``action``: ``infer`` for the one that gets the lease, ``joined`` while that is in
    flight, ``cached`` with the score afterwards. ``lease`` names the request that infers. Its
    result comes out once, as ``done`` or ``failed``, for all that joined; results of others are
    ``ignored``. A lease without a result ends after its time, as ``expired``: the next request
    infers again. State is a few numbers per url, which end ``keep`` after the success.
    """
    patience, lasting = _millis(lease), _millis(keep)
    asked = requests.select("url", "id", order, time, F.lit(None).cast("double").alias("score"),
                            F.lit(None).cast("string").alias("error"), F.lit(True).alias("_asks"))
    told = results.select("url", "id", order, time, F.col("score").cast("double").alias("score"), "error",
                          F.lit(False).alias("_asks"))
    rows = _timed(asked.unionByName(told), time, delay, clock).select(
        "url", "id", order, "_time", "score", "error", "_asks", F.col(time).alias("_watermark"))
    id_type = dict(rows.dtypes)["id"]
    output = ["url string", f"id {id_type}", "action string", f"lease {id_type}", "score double", "error string"]
    held = [f"holder {id_type}", "score double", "wake long"]

    def arrives(key, entry, now, at, values, out) -> Entry:
        own, value, error, asks = values
        if entry and now >= entry[-1]:
            entry = wakes(key, entry, out)
        holder, score, _ = entry or (None, None, None)
        if asks and entry is None:
            out.append((*key, own, "infer", own, None, None))
            return own, None, now + patience
        if asks:
            out.append((*key, own, "joined" if score is None else "cached", holder, score, None))
        elif holder != own or score is not None:
            out.append((*key, own, "ignored", holder, None, error))
        elif error is None and value is not None:
            out.append((*key, own, "done", own, value, None))
            return own, value, now + lasting
        else:
            out.append((*key, own, "failed", own, None, error))
            return None
        return entry

    def wakes(key, entry, out) -> Entry:
        holder, score, _ = entry
        if score is None:
            out.append((*key, holder, "expired", holder, None, None))
        return None

    return _bucketed(rows, ["url"], order, ["id", "score", "error", "_asks"], output, held, arrives, wakes,
                     clock, buckets)
