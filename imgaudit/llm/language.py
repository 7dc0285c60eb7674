"""Language identification by hierarchical discrimination.

A text's language family is told first, by one linear support vector machine per family
against the others. Only then do one-versus-one linear machines separate the languages of that
family; the language that wins most pairs is taken. Features are the shares of a text's letter
pairs and triples, words being lowered and set apart by one blank, hashed into ``BUCKETS``
numbers and scaled by how common each bucket is. Since a machine is linear in these shares, a
text's margin is the mean of its pairs' and triples' weights: scoring reads whole texts once,
in slices, and shuffles nothing.

Learning takes at most ``PER_LANGUAGE`` texts of each language, those with the least hashes of
their ids; Spark counts the languages and filters by a hash bound per language, so the driver
gets only the sample, in proportion to the number of language codes. Of each sampled text one
window of ``WINDOW`` letters and one of ``SHORT`` letters is learned from, at places set by the
hash, so that short texts are told apart as well. Languages not in ``FAMILIES`` are each a
family of their own.

Defined cases: a null text or one without a letter is ``und`` with score 0, and so is every text
where nothing could be learned; with one learned language every other text is that one, with
score 1; a text of any length counts whole, in parts of ``PART`` letters (a pair or triple
across two parts is not counted); equal votes go to the larger sum of margins, then the lesser
code; repeated rows and ids give one row each; a null id is carried through and not held out;
an empty table gives no rows; other columns are not read, so their names do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from imgaudit.llm.common import slices, written

PER_LANGUAGE, WINDOW, SHORT = 300, 2000, 60
BUCKETS = 1 << 13
PART = 1 << 18
SLOPE = 3.0  # of the logistic curve from a margin to a score
UNKNOWN = "und"

# Language codes by family.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk",
    "indo-aryan": "hi ur bn mr gu pa ne si",
    "dravidian": "ta te kn ml",
    "semitic": "ar he mt am",
    "austronesian": "id ms tl jv",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family(lang: str) -> str:
    """The family of a code; regions such as in ``en-GB`` do not matter."""
    code = lang.lower().replace("_", "-").split("-")[0]
    return _FAMILY.get(code, "only " + lang)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


# ------------------------------------------------------------------ features

@cache
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all letter pairs and triples, and the text of each; texts in order."""
    pieces, owner = [], []
    for t, text in enumerate(texts):
        for at in range(0, len(text), PART):
            pieces.append(" " + text[at:at + PART].lower() + " ")
            owner.append(t)
    if not pieces:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32)
    row = np.repeat(owner, [len(p) for p in pieces])
    letter = _letters()[code]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of what lies between two words, its first
    keep[:-1] |= letter[1:] & ~letter[:-1] & (row[1:] != row[:-1])
    code, row = np.where(letter, code, 0)[keep].astype(np.uint64), row[keep]
    if len(code) < 3:
        pairs = np.flatnonzero((row[1:] == row[:-1]) & ((code[1:] | code[:-1]) != 0)) if len(code) > 1 else []
        return _bucket(code, np.asarray(pairs, np.int64), 2), row[np.asarray(pairs, np.int64)]
    two = np.flatnonzero((row[1:] == row[:-1]) & ((code[1:] | code[:-1]) != 0))
    three = np.flatnonzero((row[2:] == row[:-2]) & (code[1:-1] != 0))
    at = np.concatenate([two, three])
    bucket = np.concatenate([_bucket(code, two, 2), _bucket(code, three, 3)])
    order = np.argsort(row[at], kind="stable")
    return bucket[order], row[at][order]


def _bucket(code: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    value = np.full(len(at), size, np.uint64)
    for i in range(size):
        value = (value * np.uint64(0x110001) + code[at + i]) * np.uint64(0x9E3779B97F4A7C15)
    return (value >> np.uint64(64 - 13)).astype(np.int64)


def _shares(texts: list[str]) -> np.ndarray:
    """One row of bucket shares per text."""
    bucket, row = _grams(texts)
    counts = np.bincount(row * BUCKETS + bucket, minlength=len(texts) * BUCKETS)
    counts = counts.reshape(len(texts), BUCKETS).astype(np.float64)
    return counts / np.maximum(counts.sum(1, keepdims=True), 1)


# ------------------------------------------------------------------ learning

@dataclass
class Model:
    """Families in order, weights per family, and per family its languages, pairs and weights."""

    families: list[str]
    across: np.ndarray  # bucket, family
    across_bias: np.ndarray
    languages: list[list[str]]
    within: list[np.ndarray]  # bucket, pair
    within_bias: list[np.ndarray]


def _machine(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """A linear support vector machine by dual coordinate ascent over the Gram matrix.

    Both classes weigh alike. The bias is the weight of a constant feature.
    """
    x = np.hstack([x, np.ones((len(x), 1))])
    gram = x @ x.T
    limit = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum()) * len(y)
    rng = np.random.default_rng(0)
    signed = np.zeros(len(y))  # dual value times label
    for _ in range(40):
        before = signed.copy()
        for i in rng.permutation(len(y)):
            slack = 1 - y[i] * (gram[i] @ signed)
            signed[i] = y[i] * min(max(y[i] * signed[i] + slack / gram[i, i], 0.0), limit[i])
        if np.abs(signed - before).max() < 1e-4:
            break
    w = signed @ x
    return w[:-1], float(w[-1])


def learn(texts: list[tuple[str, str]]) -> Model:
    """Fit on (language, text) rows; the same rows in the same order give the same model."""
    names = [lang for lang, _ in texts]
    kin = np.array([family(lang) for lang in names], dtype=object)
    langs = np.array(names, dtype=object)
    x = _shares([text for _, text in texts])
    scale = 1 / np.sqrt(x.mean(0) + 1e-5) if len(x) else np.ones(BUCKETS)
    x *= scale
    families = sorted(set(kin))
    across, across_bias, languages, within, within_bias = [], [], [], [], []
    for one in families:
        if len(families) > 1:
            w, b = _machine(x, np.where(kin == one, 1.0, -1.0))
        else:
            w, b = np.zeros(BUCKETS), np.inf
        across.append(w * scale)
        across_bias.append(b)
        own = sorted(set(langs[kin == one]))
        pairs = []
        for first, second in combinations(own, 2):
            rows = (langs == first) | (langs == second)
            pairs.append(_machine(x[rows], np.where(langs[rows] == first, 1.0, -1.0)))
        languages.append(own)
        within.append(np.array([w * scale for w, _ in pairs]).reshape(len(pairs), BUCKETS).T.astype(np.float32))
        within_bias.append(np.array([b for _, b in pairs]))
    return Model(families, np.array(across).reshape(len(families), BUCKETS).T.astype(np.float32),
                 np.array(across_bias), languages, within, within_bias)


def sample(documents: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id",
           per_language: int = PER_LANGUAGE) -> list[tuple[str, str]]:
    """At most ``per_language`` texts of every language, two windows of each."""
    draw = F.xxhash64(F.col(doc_id)).bitwiseAND(F.lit((1 << 62) - 1))
    rows = documents.filter(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")
                            & ~held_out(F.col(doc_id))).select(
        F.col(lang).alias("lang"), draw.alias("draw"), F.col(text).alias("text"))
    counts = written(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")), "languages")
    # twice the share that is wanted: as good as never too few, and never many more
    bound = F.when(F.col("rows") <= 2 * per_language, F.lit(1.0)).otherwise(
        2.0 * per_language / F.col("rows")) * F.lit(float(1 << 62))
    bounds = counts.select(F.col("lang").alias("_lang"), bound.alias("_bound"))
    near = rows.join(bounds, (F.col("lang") == F.col("_lang")) & (F.col("draw") <= F.col("_bound")))
    near = near.select("lang", "draw", F.expr(
        f"substring(text, cast(draw % (greatest(length(text) - {WINDOW}, 0) + 1) as int) + 1, {WINDOW})")
        .alias("text"))
    near = written(near, "language-sample")
    found = []
    for code in sorted(r.lang for r in counts.select("lang").collect()):
        chosen = near.filter(F.col("lang") == code).orderBy("draw", "text").limit(per_language)
        for r in chosen.collect():
            at = r.draw % (max(len(r.text) - SHORT, 0) + 1)
            found += [(code, t) for t in (r.text, r.text[at:at + SHORT]) if any(map(str.isalpha, t))]
    return found


def fit(documents: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Model:
    return learn(sample(documents, text, lang, doc_id))


# ------------------------------------------------------------------ prediction

def _margins(weights: np.ndarray, bias: np.ndarray, bucket: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Per text the mean weight of its pairs and triples, plus the bias; no text is empty."""
    sums = np.zeros((len(cuts) - 1, weights.shape[1]))
    step = 1 << 20
    for at in range(0, len(bucket), step):
        first = int(np.searchsorted(cuts, at, "right")) - 1
        last = int(np.searchsorted(cuts, min(at + step, len(bucket)), "left"))
        starts = np.maximum(cuts[first:last], at) - at
        sums[first:last] += np.add.reduceat(weights[bucket[at:at + step]], starts, axis=0, dtype=np.float64)
    return sums / np.diff(cuts)[:, None] + bias


def _sure(margin: np.ndarray) -> np.ndarray:
    return np.where(np.isposinf(margin), 1.0, 1 / (1 + np.exp(-np.clip(SLOPE * margin, -30, 30))))


def classify(model: Model, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Language and score of every text."""
    langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    bucket, row = _grams(texts)
    if not model.families or not len(row):
        return langs, scores
    cuts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1], [True]]))
    known = row[cuts[:-1]]
    margin = _margins(model.across, model.across_bias, bucket, cuts)
    kin = margin.argmax(1)
    sure = _sure(margin[np.arange(len(kin)), kin])
    for k, names in enumerate(model.languages):
        own = np.flatnonzero(kin == k)
        if not len(own):
            continue
        best, sure_of = np.zeros(len(own), int), np.ones(len(own))
        if len(names) > 1:
            size = np.diff(cuts)[own]
            places = np.concatenate([[0], np.cumsum(size)])
            part = bucket[np.repeat(cuts[own] - places[:-1], size) + np.arange(places[-1])]
            best, sure_of = _votes(len(names), _margins(model.within[k], model.within_bias[k], part, places))
        for i, b, s in zip(own.tolist(), best.tolist(), sure_of.tolist()):
            langs[known[i]], scores[known[i]] = names[b], sure[i] * s
    return langs, scores


def _votes(count: int, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The language that wins most pairs, and the least sure of its own pairs."""
    pairs = list(combinations(range(count), 2))
    votes, sums, least = (np.zeros((len(margin), count)) for _ in range(3))
    least += np.inf
    for p, (a, b) in enumerate(pairs):
        m = margin[:, p]
        for lang, own in ((a, m), (b, -m)):
            votes[:, lang] += (own > 0) if lang == b else (own >= 0)
            sums[:, lang] += own
            least[:, lang] = np.minimum(least[:, lang], own)
    best = np.lexsort((np.broadcast_to(-np.arange(count), votes.shape), sums, votes), axis=1)[:, -1]
    return best, _sure(least[np.arange(len(best)), best])


def identify(documents: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per document: whether it was held out, its language, and how sure that is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body = batch.column(1).cast(pa.binary()).fill_null(b"")
            for part in slices(pa.RecordBatch.from_arrays([batch.column(0), body], ["doc_id", "body"]), "body"):
                langs, scores = classify(model, [t.decode() for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                    ["doc_id", "lang_pred", "score"])

    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
