"""Periodic runs of words, by an online sparse diagonal DP over earlier occurrences.

The plain DP compares every word with all of its earlier occurrences: an occurrence ``lag``
words back makes the match length of diagonal ``lag`` one longer, and a diagonal that ends
with enough matches is a run. Its cost is the square of a word's frequency. Here the diagonals
are sparse, and none that could carry a run is left out:

* at scale K (1, 2, 4, ...) the symbol of a word is the K words that begin with it;
* of its earlier occurrences only the nearest one, at a lag of more than K / 2 and at most K,
  makes a diagonal longer. A run of smallest period q holds at least 4 q words, so with
  q <= K < 2 q the K words from any of its places after the first period occur q back, and no
  nearer: a nearer occurrence inside the run would give the run a smaller period. Its diagonal
  therefore grows from the first word of the second period to K words before the run's end,
  with no gap, and gives start, length and period exactly;
* a diagonal that ends with fewer than ``max(6, 4 * lag)`` words in all is dropped, one with
  enough is a run and its lag is the smallest period, as a smaller one had been nearer.

Only places whose K words occur elsewhere in the text go on to scale 2 K, so texts without
repeats leave after two or three scales, and a text of n words costs n log n for each of at most
log n scales, however often one word occurs. All texts of a slice of a batch are worked on at
once, as arrays; symbols are exact numbers of words, not hashes. Nothing is shuffled.

Defined cases: a null or empty text, or one of white space, has no words and no run (four nulls
and the hashes of the empty text); an empty table gives no rows; a text of any length is read
whole by the one task that holds its row, in memory in proportion to its words; among runs of
equal length / period the smallest start, then the smallest period is shown, compared as
fractions; repeated rows and ids give one row each; a null id is carried through; other columns
are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imgaudit.llm.common import as_bytes, slices

LEAST = 6  # words of a run
POWER = 4  # periods of a run
RUNS = "doc_id long, start long, length long, period long"
DIGESTS = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
           "runs_sha256 string, collapsed_sha256 string")


# ------------------------------------------------------------------ the diagonals

def _names(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each different pair, dense from 0."""
    return np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1]


def _ended(place: np.ndarray, lag: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and lag of the diagonals that hold enough words when they end.

    ``place`` rises; a diagonal goes on while the next word has the same lag.
    """
    ends = np.ones(len(place), bool)
    ends[:-1] = (place[1:] != place[:-1] + 1) | (lag[1:] != lag[:-1])
    last = np.flatnonzero(ends)
    first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    period = lag[last]
    length = place[last] - place[first] + k + period
    enough = length >= np.maximum(LEAST, POWER * period)
    return (place[first] - period)[enough], length[enough], period[enough]


def find_runs(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of all runs, by start and period.

    ``words`` numbers the words of all texts; text t has those from ``bounds[t]`` to
    ``bounds[t + 1]``. No run crosses texts. Starts count over all texts.
    """
    n, k = len(words), 1
    end = np.repeat(bounds[1:], np.diff(bounds))
    name = _names(np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)), words) if n else words
    place = np.arange(n)
    found = []
    while len(place):
        order = np.argsort(name, kind="stable")  # by name, then place
        same = name[order[1:]] == name[order[:-1]]
        earlier = np.full(len(place), -1)
        earlier[order[1:][same]] = place[order[:-1][same]]
        lag = place - earlier
        hit = (earlier >= 0) & (2 * lag > k) & (lag <= k)
        found.append(_ended(place[hit], lag[hit], k))
        again = np.zeros(len(place), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        place, name = place[again], name[again]
        at = np.searchsorted(place, place + k)
        there = at < len(place)
        there[there] = place[at[there]] == place[there] + k
        there &= place + 2 * k <= end[place]
        place, name, k = place[there], _names(name[there], name[at[there]]), 2 * k
    start, length, period = (np.concatenate(c).astype(np.int64) for c in zip(*found)) \
        if found else (np.zeros(0, np.int64),) * 3
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


# ------------------------------------------------------------------ texts

def _periodic(key: int, n: int) -> np.ndarray | None:
    """Which original word each place holds, for texts the contract makes periodic; else None."""
    h = zlib.crc32(str(key).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([np.arange(a), a + np.arange(n - a) % p])


def _read(keys: list, texts: list[bytes], damaged: bool) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """The words of every text, their numbers in one array, and where each text begins."""
    numbers: dict[bytes, int] = {}
    words, codes = [], []
    for key, text in zip(keys, texts):
        own = text.split()  # for bytes: runs other than 0x20 and 0x09 to 0x0D
        coded = np.fromiter((numbers.setdefault(w, len(numbers)) for w in own), np.int64, len(own))
        chosen = _periodic(key, len(own)) if damaged and key is not None else None
        if chosen is not None:
            own, coded = [own[i] for i in chosen.tolist()], coded[chosen]
        words.append(own)
        codes.append(coded)
    bounds = np.concatenate([[0], np.cumsum([len(c) for c in codes])]).astype(np.int64)
    return words, np.concatenate(codes) if codes else np.zeros(0, np.int64), bounds


def _strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The run of greatest length / period; the earlier one, then the shorter period on ties."""
    best = runs[0]
    for run in runs[1:]:
        if run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def _kept(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words outside of all runs or in a run's first period only."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    keep = np.cumsum(change[:-1]) == 0
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from slices(batch, batch.schema.names[1])


def _of_slice(batch: pa.RecordBatch, damaged: bool):
    """Id, words and runs (start, length, period, by start) of every text of a slice."""
    keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    words, codes, bounds = _read(keys, texts, damaged)
    start, length, period = find_runs(codes, bounds)
    cuts = np.searchsorted(start, bounds)
    for t, (key, own) in enumerate(zip(keys, words)):
        a, b = cuts[t], cuts[t + 1]
        yield key, own, list(zip((start[a:b] - bounds[t]).tolist(), length[a:b].tolist(), period[a:b].tolist()))


def _rows(documents: DataFrame, text: str, doc_id: str) -> DataFrame:
    return documents.select(F.col(doc_id).cast("long").alias("doc_id"), as_bytes(text).alias("body"))


def periodic_runs(documents: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per run of the texts as they are: first word, words, and smallest period."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            rows = [(key, *r) for key, _, runs in _of_slice(batch, False) for r in runs]
            if rows:
                yield _batch(rows, RUNS)

    return _rows(documents, text, doc_id).mapInArrow(run, RUNS)


def collapse_runs(documents: DataFrame, text: str = "text") -> DataFrame:
    """The documents with every run shortened to its first period; other columns as they were.

    Words are then joined by single spaces; a null text stays null.
    """
    place = documents.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body = batch.column(place).cast(pa.binary())
            whole = pa.RecordBatch.from_arrays(
                [pa.nulls(len(body), pa.int64()), body.fill_null(b"")], ["doc_id", "body"])
            texts = [b" ".join(_kept(words, runs)).decode()
                     for part in slices(whole, "body") for _, words, runs in _of_slice(part, False)]
            new = pa.array(texts, batch.schema.field(place).type, mask=body.is_null().to_numpy(False))
            yield batch.set_column(place, batch.schema.field(place), new)

    return documents.mapInArrow(run, documents.schema)


def run_digests(documents: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per document, a tenth of them made periodic first: its runs, the strongest, two hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            rows = []
            for key, words, runs in _of_slice(batch, True):
                best = _strongest(runs) if runs else None
                shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
                listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
                rows.append((key, len(runs), *shown, hashlib.sha256(listed.encode()).hexdigest(),
                             hashlib.sha256(b" ".join(_kept(words, runs))).hexdigest()))
            if rows:
                yield _batch(rows, DIGESTS)

    return _rows(documents, text, doc_id).mapInArrow(run, DIGESTS)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [c.split() for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds[kind]) for c, (_, kind) in zip(zip(*rows), fields)], [n for n, _ in fields])
