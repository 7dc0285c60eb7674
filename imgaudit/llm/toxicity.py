"""Toxic texts by a support vector machine over a subsequence string kernel.

Two words are as alike as the letter triples they share, in order but with gaps: a triple
that spans n letters weighs ``DECAY ** n``, and a word is marked at both ends. Punctuation
inside a word is dropped first, and a run of single letters reads as one word, so insults
that are stretched, spaced or filled with other characters keep most of their triples. The
kernel is approximated from landmark words (Nyström), in whose space a linear machine is
trained. A sentence is as toxic as its most toxic word and a text as its most toxic
sentence; since labels say only that a text holds one, training alternates between choosing
each toxic text's witnesses and fitting the machine on witnesses against words of clean texts.
The machine folds into one weight per triple, so scoring a word reads a table. Scores are
calibrated to the share of toxic texts among all labelled ones.

Learning uses at most ``SAMPLE`` labelled texts of each class, none longer than ``LONGEST``
bytes, chosen by a hash of their ids; scoring reads every whole text.

Defined cases: a null or empty text, or one without letters, gets the score of a text
without any toxic word; a null id is never learnt from and not held out; repeated labels of
an id count once, as toxic if any is; without toxic labels every score is 0; an empty table
gives no rows; labels, language, source and ids are no inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from imgaudit.llm.common import as_bytes, flat_bytes, lower_ascii, mix, slices, span_hashes, words, written

DECAY, SPAN = 0.7, 7
SAMPLE, LONGEST = 1500, 20_000
TOXIC_LANDMARKS, CLEAN_LANDMARKS = 160, 96
WITNESSES, NEGATIVES, ROUNDS, PENALTY = 3, 6000, 4, 2.0
COPIES = 4  # of each witness with a letter put in, so that the machine learns to bear it
STRETCHED = 0.1  # weight of such words in the calibration, against that of all toxic texts
SPELLED = 4  # single letters in a row that read as one word
THRESHOLD = 0.7
LETTERS = 64
#: Class of every byte: 0 dropped, 1 and 2 the word's ends, then letters, digits, other scripts.
CLASS = np.zeros(256, np.uint8)
CLASS[97:123] = np.arange(3, 29)
CLASS[48:58] = np.arange(29, 39)
CLASS[128:] = 39 + np.arange(128) % 25
_OFFSETS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]


# ------------------------------------------------------------------ words

@dataclass
class Words:
    """Marked words: classes of all letters end to end, the bounds of words, their rows."""

    letters: np.ndarray
    bounds: np.ndarray
    row: np.ndarray

    def only(self, chosen: np.ndarray) -> Words:
        size = np.diff(self.bounds)[chosen]
        start = self.bounds[:-1][chosen]
        place = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
        return Words(self.letters[place], np.concatenate([[0], np.cumsum(size)]), self.row[chosen])

    def span(self, at: int, to: int) -> Words:
        bounds = self.bounds[at:to + 1]
        return Words(self.letters[bounds[0]:bounds[-1]], bounds - bounds[0], self.row[at:to])

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every distinct word and, for every word, its place among them."""
        return np.unique(span_hashes(self.letters, self.bounds[:-1], self.bounds[1:]),
                         return_inverse=True)


def read_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """The words of all rows; runs of single letters follow as words of their own."""
    start, end, row = words(data, offsets)
    kept = CLASS[lower_ascii(data)]
    if not len(start):
        return Words(np.zeros(0, np.uint8), np.zeros(1, np.int64), row)
    place = np.flatnonzero(kept)
    word = np.searchsorted(start, place, "right") - 1
    real, word = np.unique(word, return_inverse=True)
    size, row = np.bincount(word, minlength=len(real)), row[real]
    letters, first = kept[place], np.cumsum(size) - size
    # a code point of two bytes is a single letter too
    code_points = np.add.reduceat(((data[place] & 0xC0) != 0x80).astype(np.int64), first) \
        if len(real) else np.zeros(0, np.int64)
    single = code_points == 1
    fresh = np.ones(len(real), bool)
    fresh[1:] = ~(single[1:] & single[:-1] & (row[1:] == row[:-1]))
    heads = np.flatnonzero(fresh)
    length = np.diff([*heads, len(real)])
    runs = heads[(length >= SPELLED) & single[heads]] if len(heads) else heads
    stops = runs + length[np.searchsorted(heads, runs)] if len(heads) else runs
    letters = np.concatenate([letters, *[letters[first[a]:first[b - 1] + size[b - 1]]
                                         for a, b in zip(runs, stops)]])
    size = np.concatenate([size, [size[a:b].sum() for a, b in zip(runs, stops)]]).astype(np.int64)
    row = np.concatenate([row, row[runs]])
    bounds = np.concatenate([[0], np.cumsum(size + 2)])
    marked = np.zeros(int(bounds[-1]), np.uint8)
    marked[bounds[:-1]], marked[bounds[1:] - 1] = 1, 2
    marked[np.arange(len(letters)) + 2 * np.repeat(np.arange(len(size)), size) + 1] = letters
    return Words(marked, bounds, row)


def read_texts(texts: list[bytes], block: int = 200) -> Words:
    """The words of many texts, read some texts at a time."""
    parts = []
    for at in range(0, len(texts), block):
        some = texts[at:at + block]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in some])])
        part = read_words(np.frombuffer(b"".join(some), np.uint8), offsets)
        parts.append(Words(part.letters, part.bounds, part.row + at))
    starts = np.cumsum([0] + [len(p.letters) for p in parts])
    bounds = [p.bounds[:-1] + start for p, start in zip(parts, starts)]
    return Words(np.concatenate([p.letters for p in parts]), np.concatenate([*bounds, starts[-1:]]),
                 np.concatenate([p.row for p in parts]))


def triples(found: Words) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For every pair of offsets: word, code and weight of the triples that fit into a word."""
    word = np.repeat(np.arange(len(found.bounds) - 1), np.diff(found.bounds))
    letters = found.letters.astype(np.int64)
    for a, b in _OFFSETS:
        at = np.flatnonzero(word[b:] == word[:-b]) if len(word) > b else np.zeros(0, np.int64)
        code = (letters[at] * LETTERS + letters[at + a]) * LETTERS + letters[at + b]
        yield word[at], code, DECAY ** (b + 1)


def weigh(found: Words, table: np.ndarray) -> np.ndarray:
    """The machine's value of every word: its triples' weights over the word's own norm."""
    out = []
    for at in range(0, len(found.bounds) - 1, 1 << 15):
        part = found.span(at, at + (1 << 15))
        n = len(part.bounds) - 1
        total, norm = np.zeros(n), np.zeros(n)
        for word, code, weight in triples(part):
            total += weight * np.bincount(word, table[code], n)
            norm += weight * weight * np.bincount(word, minlength=n)
        out.append(total / np.sqrt(np.maximum(norm, 1e-12)))
    return np.concatenate(out) if out else np.zeros(0)


def profiles(found: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word, code and weight of the distinct triples of some words, scaled to their norms."""
    n = len(found.bounds) - 1
    parts = list(triples(found))
    word, code = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    weight = np.concatenate([np.full(len(p[0]), p[2]) for p in parts])
    norm = np.bincount(word, weight * weight, n)
    both, place = np.unique(word * LETTERS ** 3 + code, return_inverse=True)
    word, code = both // LETTERS ** 3, both % LETTERS ** 3
    return word, code, np.bincount(place, weight, len(both)) / np.sqrt(norm[word])


class Landmarks:
    """Kernel values against landmark words, over the triples that these have."""

    def __init__(self, found: Words):
        word, code, weight = profiles(found)
        self.codes, column = np.unique(code, return_inverse=True)
        self.weights = np.zeros((len(self.codes), len(found.bounds) - 1))
        self.weights[column, word] = weight

    def kernel(self, found: Words, block: int = 128) -> np.ndarray:
        out = []
        for at in range(0, len(found.bounds) - 1, block):
            part = found.only(np.arange(at, min(at + block, len(found.bounds) - 1)))
            word, code, weight = profiles(part)
            column = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            met = self.codes[column] == code
            dense = np.zeros((len(part.bounds) - 1, len(self.codes)))
            dense[word[met], column[met]] = weight[met]
            out.append(dense @ self.weights)
        return np.concatenate(out) if out else np.zeros((0, self.weights.shape[1]))

    def table(self, direction: np.ndarray) -> np.ndarray:
        """One weight per triple, so that a word's value is a sum over its triples."""
        out = np.zeros(LETTERS ** 3, np.float32)
        out[self.codes] = self.weights @ direction
        return out


# ------------------------------------------------------------------ learning

@dataclass
class Model:
    table: np.ndarray
    slope: float
    intercept: float
    lowest: float


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(documents: DataFrame, labels: DataFrame, text: str, doc_id: str) -> tuple[list, dict]:
    """Bounded texts with labels, and how many learnable texts there are of each class."""
    marked = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(
        F.max("toxic").alias("toxic"))
    rows = documents.select(F.col(doc_id).alias("doc_id"), as_bytes(text).alias("body"))
    sizes = rows.select("doc_id", F.octet_length("body").alias("size")).join(
        marked.filter(~held_out(F.col("doc_id"))), "doc_id")
    sizes = written(sizes, "learnable")
    counts = {r.toxic: r.n for r in sizes.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    # ids are chosen first, so that only the sample's texts are moved
    short = sizes.filter(F.col("size") <= LONGEST).select("doc_id", "toxic").distinct()
    label = {r.doc_id: r.toxic for value in (1, 0) for r in short.filter(F.col("toxic") == value).orderBy(
        F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).collect()}
    chosen = rows.filter(F.col("doc_id").isin(list(label)) & (F.octet_length("body") <= LONGEST)).collect()
    chosen = sorted((-label[r.doc_id], r.doc_id, bytes(r.body)) for r in chosen)
    return [(body, -toxic) for toxic, _, body in chosen], counts


def _root(kernel: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eigh(kernel)
    good = values > 1e-6 * values.max()
    return vectors[:, good] / np.sqrt(values[good])


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by Newton steps on the rows inside the margin."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(30):
        inside = y * (x @ w) < 1
        part = x[inside] * (PENALTY * weight[inside])[:, None]
        new = np.linalg.solve(ridge + part.T @ x[inside], part.T @ y[inside])
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w[:-1], float(w[-1])


def _spread(found: Words, candidates: np.ndarray, most: int) -> np.ndarray:
    """Words spread over the candidates: each is little like those already chosen."""
    part = found.only(candidates)
    word, code, weight = profiles(part)
    cuts = np.searchsorted(word, np.arange(len(candidates) + 1))
    code = np.unique(code, return_inverse=True)[1]
    near = np.zeros((int(code.max(initial=0)) + 1, most), np.float32)
    chosen = []
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        if len(chosen) == most:
            break
        alike = weight[a:b] @ near[code[a:b], :len(chosen)] if b > a and chosen else np.zeros(1)
        if b > a and alike.max(initial=0.0) < 0.8:
            near[code[a:b], len(chosen)] = weight[a:b]
            chosen.append(candidates[i])
    return np.array(chosen, np.int64)


def learn(texts: list[tuple[bytes, int]], counts: dict) -> Model:
    """Fit on the sampled texts; deterministic, as their order is."""
    label = np.array([toxic for _, toxic in texts])
    if not (label == 1).any() or not (label == 0).any():
        certain = 0.0 if not (label == 1).any() else 1.0
        return Model(np.zeros(LETTERS ** 3, np.float32), 0.0, np.inf if certain else -np.inf, 0.0)
    found = read_texts([t for t, _ in texts])
    _, kind = found.distinct()
    first = np.unique(kind, return_index=True)[1]
    pairs = np.stack(np.divmod(np.unique(kind * len(texts) + found.row), len(texts)))
    toxic = label[pairs[1]] == 1
    n = len(first)
    in_toxic = np.bincount(pairs[0][toxic], minlength=n)
    in_clean = np.bincount(pairs[0][~toxic], minlength=n)
    share = (label == 1).sum(), (label == 0).sum()
    association = np.log((in_toxic + 0.1) / share[0]) - np.log((in_clean + 0.5) / share[1])
    association[in_toxic < 2] = -np.inf
    order = mix(np.arange(n, dtype=np.uint64) + np.uint64(1)).argsort()
    suspects = np.argsort(-association, kind="stable")
    suspects = suspects[association[suspects] > 1]
    clean = order[in_clean[order] > in_toxic[order]]
    marks = np.concatenate([_spread(found, first[suspects[:2000]], TOXIC_LANDMARKS),
                            _spread(found, first[clean[:600]], CLEAN_LANDMARKS)])
    landmarks = Landmarks(found.only(marks if len(marks) else first[:1]))
    root = _root(landmarks.kernel(found.only(marks if len(marks) else first[:1])))

    def embed(kinds: np.ndarray) -> np.ndarray:
        return landmarks.kernel(found.only(first[kinds])) @ root

    unique = found.only(first)
    value, hard, common = association.copy(), clean[:0], clean[:0]
    table, bias = np.zeros(LETTERS ** 3, np.float32), 0.0
    for turn in range(ROUNDS):
        witness = _witnesses(pairs[0][toxic], pairs[1][toxic], value, 1.0 if turn == 0 else 0.0)
        if not len(witness):
            break
        good, times = np.unique(witness, return_counts=True)
        bad = np.setdiff1d(np.concatenate([clean[:NEGATIVES], hard]), good)
        common = good[times > 1]
        odd = landmarks.kernel(_stretched(found.only(first[common]))) @ root
        x = np.vstack([embed(good), odd, embed(bad)])
        y = np.concatenate([np.ones(len(good) + len(odd)), -np.ones(len(bad))])
        # a word that is a witness more often counts more, and more than one of clean texts
        w, bias = _machine(x, y, np.concatenate([
            np.sqrt(times), np.repeat(np.sqrt(times[times > 1]) / COPIES, COPIES), np.ones(len(bad))]))
        table = landmarks.table(root @ w)
        value = weigh(unique, table) + bias
        only_clean = np.flatnonzero((in_clean > 0) & (in_clean >= in_toxic))
        hard = only_clean[np.argsort(-value[only_clean], kind="stable")[:NEGATIVES // 3]]
    best = np.full(len(texts), value.min())
    np.maximum.at(best, pairs[1], value[pairs[0]])
    weight = np.where(label == 1, counts[1] / share[0], counts[0] / share[1])
    # toxic texts mostly hold several plain insults; a stretched one alone shall do as well
    alone = weigh(_stretched(found.only(first[common])), table) if len(common) else np.zeros(0)
    slope, intercept = _calibrate(
        np.concatenate([best - bias, alone]), np.concatenate([label, np.ones(len(alone))]),
        np.concatenate([weight, np.full(len(alone), STRETCHED * counts[1] / max(1, len(alone)))]))
    return Model(table, slope, intercept, float(value.min() - bias))


def _witnesses(word: np.ndarray, row: np.ndarray, value: np.ndarray, least: float) -> np.ndarray:
    """The ``WITNESSES`` most toxic words of every text, as far as they are above ``least``."""
    order = np.lexsort((word, -value[word], row))
    word, row = word[order], row[order]
    starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    rank = np.arange(len(row)) - np.repeat(starts, np.diff([*starts, len(row)]))
    return word[(rank < WITNESSES) & (value[word] > least)]


def _stretched(found: Words) -> Words:
    """The words again, each ``COPIES`` times with a letter put in somewhere inside."""
    rng = np.random.default_rng(0)
    n = len(found.bounds) - 1
    chosen = np.repeat(np.arange(n), COPIES)
    size = np.diff(found.bounds)[chosen]
    bounds = np.concatenate([[0], np.cumsum(size + 1)])
    at = bounds[:-1] + 2 + np.floor(rng.random(len(chosen)) * np.maximum(size - 3, 1)).astype(np.int64)
    letters = np.zeros(int(bounds[-1]), np.uint8)
    new = np.zeros(len(letters), bool)
    new[at] = True
    letters[~new] = found.only(chosen).letters
    letters[new] = rng.integers(3, 29, len(chosen))
    return Words(letters, bounds, chosen)


def _calibrate(x: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic curve, by Newton steps with a light ridge."""
    a, b = 0.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        r, h = weight * (label - p), weight * p * (1 - p)
        gradient = np.array([(r * x).sum() - 1e-3 * a, r.sum() - 1e-3 * b])
        curve = np.array([[(h * x * x).sum() + 1e-3, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(curve, gradient)
        step *= min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
        a, b = a + step[0], b + step[1]
    return max(float(a), 0.0), float(b)


def fit(documents: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> Model:
    return learn(*sample(documents, labels, text, doc_id))


# ------------------------------------------------------------------ scoring

def score_rows(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The score of every row's text."""
    found = read_words(data, offsets)
    best = np.full(len(offsets) - 1, model.lowest)
    if len(found.row):
        kinds, kind = found.distinct()
        first = np.unique(kind, return_index=True)[1]
        np.maximum.at(best, found.row, weigh(found.only(first), model.table)[kind])
    return 1 / (1 + np.exp(-np.clip(model.slope * best + model.intercept, -30, 30)))


def _text_scores(model: Model, column: pa.Array) -> np.ndarray:
    body = column.cast(pa.binary()).fill_null(b"")
    batch = pa.RecordBatch.from_arrays([body], ["body"])
    parts = [score_rows(model, *flat_bytes(part["body"])) for part in slices(batch, "body", 1 << 20)]
    return np.concatenate(parts) if parts else np.zeros(0)


def score(documents: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per document: whether it was held out, its score from 0 to 1, and the decision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(_text_scores(model, batch.column(1)))], ["doc_id", "score"])

    kind = documents.select(F.col(doc_id).alias("doc_id")).schema["doc_id"].dataType.simpleString()
    scored = documents.select(F.col(doc_id).alias("doc_id"), F.col(text)).mapInArrow(
        run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def reject(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents below the threshold, with all their columns; nothing is shuffled."""
    place = documents.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_text_scores(model, batch.column(place)) < THRESHOLD))

    return documents.mapInArrow(run, documents.schema)
