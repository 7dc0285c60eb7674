"""Personal data in texts: exact patterns, and boosted trees over further candidates.

All work on rows is built-in functions. Four exact patterns give the base spans. Two wide
generators, one for addresses and one for numbers, propose candidates that may overlap the
base and each other; every candidate has a few small integer features of its format and of
the characters around it. What the base misses has no labels, so base spans are spelled
anew where they stand, each in the style of ``STYLES`` that a hash of it chooses, and these
are the positives. Candidates that overlap no base span are unlabelled. In one style as many
may be hidden as base spans are spelled in all styles together; only the excess is negative.

Spark counts both by feature values; trees are boosted on these counts, which are as many as
there are feature values and not rows. A threshold per generator is calibrated on documents
that the trees have not seen. Candidates at or above it that overlap no base span are added.

Patterns are written so that each run of characters is tried once: repeats give nothing
back, and a match may only start where a run starts or where the last match ended. That
keeps their leftmost matches and makes the time linear.

Defined cases: a null or empty text has no spans; positions count code points; rows that
repeat an id are read each on its own; a null id is carried through; without any candidate
nothing is added; spans of different kinds at one place are all listed, by kind; very long
texts and texts of many spans are read whole, in time linear in their length but for a sort
of their spans; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from imgaudit.llm.common import aside, written

KINDS = ("email", "ip", "card", "phone")
LOCAL, HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@{HOST}++(?:\.{HOST}++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
AT = r"(?:@|\x20?[(\[]at[)\]]\x20?|\x20at\x20)"
DOT = r"(?:\.|\x20?[(\[]dot[)\]]\x20?|\x20dot\x20)"
GENERATORS = {
    "address": rf"(?:(?<!{LOCAL})|\G){LOCAL}++{AT}{HOST}++(?:{DOT}{HOST}++)++",
    "number": r"(?<![0-9])[+(]{0,2}[0-9](?:[\x20().:/-]{0,2}[0-9]){6,}+",
}
#: What each feature says; the values are cut into a few steps by its list of bounds.
FEATURES = {
    "digits": (8, 9, 11, 13, 16, 17, 20), "signs": (1, 2, 3, 4, 6), "longest_group": (4, 5, 7, 10, 16),
    "luhn": (1,), "bracket": (1,), "dotted_quad": (1,), "letter_before": (1,), "letter_after": (1,),
    "quoted": (1,), "named": (1,), "spelled_at": (1,), "spelled_dot": (1,), "dated": (1,),
}
#: Kind to (generator, the span's value spelled anew); a value that keeps its form gives none.
STYLES = {
    "email": ("address", lambda v: [F.concat(F.substring_index(v, "@", 1), F.lit(at), F.regexp_replace(
        F.substring_index(v, "@", -1), r"\.", dot)) for at, dot in (
            (" at ", " dot "), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" (at) ", "."), ("@", " dot "))]),
    "phone": ("number", lambda v: [F.when(v.rlike(r"[\x20().-]"), F.regexp_replace(v, start, "")) for start in (
        r"^\+", r"^\+[0-9]{1,3}[\x20.-]+(?=[(0-9])")]),
    "card": ("number", lambda v: [F.regexp_replace(
        only_digits(v), "([0-9]{4})(?=[0-9])", "$1" + sign) for sign in ("\\.", "/", ":")]),
}
HIDDEN = {"address": 5, "number": 2}  # unlabelled per positive that may be hidden: the styles of a span
NAMED = "(?i)(?:phone|tel|call|mobile|fax|card|visa|mail|contact|address|ip)[^\\p{L}0-9]*$"
SPAN = "array<struct<start:int,end:int,value:string,before:string,after:string>>"
ROUNDS, RESTING, RATE, PRECISION, CONTEXT = 15, 4, 0.5, 0.99, 24
RUN = 256  # numbers in a block of running totals


# ------------------------------------------------------------------ spans

def matches(text: Column, pattern: str, gate: Column | None = None) -> Column:
    """All leftmost matches with positions and a little of the text around them.

    The text between matches gives the positions, so no match is searched for again.
    """
    none = F.array().cast("array<string>")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    found = found if gate is None else F.when(gate, found).otherwise(none)
    gaps = F.when(F.size(found) > 0, F.split(text, pattern, -1)).otherwise(none)
    zipped = F.arrays_zip(found.alias("value"), gaps.alias("gap"),
                          F.slice(gaps, 2, F.size(found)).alias("next"))

    def placed(m, last):
        return F.struct((last - F.char_length(m["value"])).alias("start"), last.alias("end"),
                        m["value"].alias("value"),
                        F.substring(m["gap"], -CONTEXT, CONTEXT).alias("before"),
                        F.substring(m["next"], 1, 1).alias("after"))

    def spans(real):
        lengths = F.transform(real, lambda m: F.char_length(m["gap"]) + F.char_length(m["value"]))
        return F.zip_with(real, running(lengths, lambda a, b: a + b), placed)

    return let(F.filter(zipped, lambda m: m["value"].isNotNull()), spans).cast(SPAN)


def let(value: Column, use) -> Column:
    """A column of a value that is worked out once, also where ``use`` reads it in a lambda."""
    return F.transform(F.array(value), use)[0]


def running(numbers: Column, combine) -> Column:
    """Running totals of integers under ``combine``, which must have 0 as its neutral element.

    Totals grow an array within blocks, and blocks are then put in line, so that the time is
    linear where one array that grows over all numbers would take the square.
    """
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    lined = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("out"))

    def step(done, n):
        return let(combine(done["at"], n), lambda at: F.struct(
            at.alias("at"), F.concat(done["out"], F.array(at)).alias("out")))

    def line(done, block):
        shifted = F.transform(block["out"], lambda n: combine(done["at"], n))
        return F.struct(combine(done["at"], block["at"]).alias("at"),
                        F.concat(done["out"], F.array(shifted)).alias("out"))

    def over(own):
        firsts = F.sequence(F.lit(1), F.greatest(F.size(own), F.lit(1)), F.lit(RUN))
        blocks = F.transform(firsts, lambda i: F.aggregate(F.slice(own, i, RUN), start, step))
        return F.flatten(F.aggregate(blocks, lined, line, lambda done: done["out"]))

    return let(numbers, over)


def luhn(digits: Column) -> Column:
    """Whether a string of digits of a card's length passes the check sum."""
    def add(total, i):
        digit = F.substring(digits, -i, F.lit(1)).cast("int") * (2 - i % 2)
        return total + F.when(digit > 9, digit - 9).otherwise(digit)
    total = F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), add)
    return F.when(F.char_length(digits).between(13, 19), total % 10 == 0).otherwise(False)


def only_digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def valid(kind: str, span: Column) -> Column:
    value = span["value"]
    count = F.char_length(only_digits(value))
    if kind == "card":
        return luhn(only_digits(value))
    if kind == "ip":
        return ~F.exists(F.split(value, r"\."), lambda part: ~part.rlike(
            "^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    return count.between(9, 15) if kind == "phone" else F.lit(True)


def with_base(documents: DataFrame, text: str, doc_id: str) -> DataFrame:
    """Ids, texts, and one array of valid spans per kind."""
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    body = F.col("text")
    gates = {"email": F.contains(body, F.lit("@")), "phone": F.contains(body, F.lit("+"))}
    return rows.select("doc_id", "text", *[
        F.filter(matches(body, PATTERNS[k], gates.get(k)), partial(valid, k)).alias(k)
        for k in KINDS])


# ------------------------------------------------------------------ candidates

def features(span: Column | dict[str, Column]) -> Column:
    """The feature values of a candidate, each cut into steps, in the order of ``FEATURES``."""
    value, digits = span["value"], only_digits(span["value"])
    groups = F.transform(F.split(value, "[^0-9]+"), lambda g: F.char_length(g))
    raw = {
        "digits": F.char_length(digits),
        "signs": F.char_length(value) - F.char_length(digits),
        "longest_group": F.array_max(groups),
        "luhn": luhn(digits),
        "bracket": value.rlike(r"[()\[\]]"),
        "dotted_quad": value.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"),
        "letter_before": span["before"].rlike(r"\p{L}$"),
        "letter_after": span["after"].rlike(r"^\p{L}"),
        "quoted": span["before"].rlike("[\"'=]\\s?[A-Za-z0-9]{0,20}$"),
        "named": span["before"].rlike(NAMED),
        "spelled_at": ~F.contains(value, F.lit("@")),
        "spelled_dot": value.rlike(r"(?:[\x20(\[])dot(?:[\x20)\]])"),
        "dated": value.rlike(r"(?:^|[^0-9])(?:19|20)[0-9]{2}(?:[^0-9]|$)"),
    }

    def cut(bounds, number):
        return reduce(lambda n, bound: n + F.when(number >= bound, 1).otherwise(0), bounds, F.lit(0))

    # an array of one, so that a value is worked out once and not for every bound
    return F.concat(*[F.transform(F.array(raw[name].cast("int")), partial(cut, bounds))
                      for name, bounds in FEATURES.items()])


def overlapping(spans: Column, base: Column) -> Column:
    """Per span, whether it overlaps a base span; the spans must be sorted and apart.

    In the order of base starts and span ends, a span overlaps a base span if one of those
    that start before its end ends after its start.
    """
    ends = F.transform(spans, lambda s: F.struct(
        s["end"].alias("at"), F.lit(0).alias("base"), s["start"].alias("other")))
    starts = F.transform(base, lambda b: F.struct(
        b["start"].alias("at"), F.lit(1).alias("base"), b["end"].alias("other")))

    def judged(events):
        reach = running(F.transform(events, lambda e: e["base"] * e["other"]), F.greatest)
        met = F.zip_with(events, reach, lambda e, end: F.when(e["base"] == 0, end > e["other"]))
        return F.filter(met, lambda known: known.isNotNull())

    return let(F.array_sort(F.concat(ends, starts)), judged)


def kind_of(generator: str, span: Column) -> Column:
    if generator == "address":
        return F.lit("email")
    count = F.char_length(only_digits(span["value"]))
    return (F.when(span["value"].rlike(r"^[0-9]+(?:\.[0-9]+){3}$"), "ip")
            .when(count.between(13, 19) & ~span["value"].rlike("[+(]"), "card").otherwise("phone"))


def with_candidates(rows: DataFrame) -> DataFrame:
    """Add per generator the candidates with features and whether they overlap a base span."""
    body = F.col("text")
    base = F.concat(*KINDS)
    gates = {"address": body.rlike(AT), "number": body.rlike("[0-9]")}

    def candidates(name, found):
        return F.zip_with(found, overlapping(found, base), lambda s, known: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), kind_of(name, s).alias("kind"),
            features(s).alias("features"), known.alias("known")))

    def anew(styles, s):
        """Features of one span in one of its styles; none if all are still in the base's form."""
        spelled = F.filter(F.array(*styles(s["value"])), lambda v: v.isNotNull() & ~v.startswith("+"))
        turn = F.crc32(s["value"].cast("binary"))
        one = let(spelled, lambda own: F.slice(
            own, (turn % F.greatest(F.size(own), F.lit(1)) + 1).cast("int"), 1))
        return F.transform(one, lambda v: features(
            {"value": v, "before": s["before"], "after": s["after"]}))

    def respelled(name):
        return F.concat(*[F.flatten(F.transform(F.col(kind), partial(anew, styles)))
                          for kind, (generator, styles) in STYLES.items() if generator == name])

    return rows.withColumns({
        name: let(matches(body, pattern, gates[name]), partial(candidates, name))
        for name, pattern in GENERATORS.items()} | {
        f"{name}_anew": respelled(name) for name in GENERATORS})


# ------------------------------------------------------------------ boosted trees

def boost(counts: Sequence[tuple[Sequence[int], float, float]]) -> list:
    """Trees of two levels on rows of (features, positives, negatives), by Newton steps.

    A tree is a number or (feature, bound, tree below the bound, tree from the bound on).
    A tree does without the features at the roots of those just before it, so that features
    that say the same share the weight and no single one is needed.
    """
    margin = [0.0] * len(counts)
    trees = []
    for _ in range(ROUNDS):
        resting = {tree[0] for tree in trees[-RESTING:] if isinstance(tree, tuple)}
        slope, weight = [], []
        for (_, good, bad), m in zip(counts, margin):
            p = 1 / (1 + math.exp(-m))
            slope.append(good - (good + bad) * p)
            weight.append((good + bad) * max(p * (1 - p), 1e-6))
        tree = _grow(counts, slope, weight, list(range(len(counts))), 2, resting)
        trees.append(tree)
        margin = [m + evaluate(tree, c[0]) for c, m in zip(counts, margin)]
    return trees


def _grow(counts, slope, weight, rows, levels, resting):
    def gain(part):
        s, w = sum(slope[i] for i in part), sum(weight[i] for i in part)
        return s * s / (w + 1)

    best = (1e-9, None)
    if levels:
        for feature, bounds in enumerate(FEATURES.values()):
            if feature in resting:
                continue
            for bound in range(1, len(bounds) + 1):
                low = [i for i in rows if counts[i][0][feature] < bound]
                high = [i for i in rows if counts[i][0][feature] >= bound]
                if low and high:
                    best = max(best, (gain(low) + gain(high) - gain(rows), (feature, bound, low, high)),
                               key=lambda found: found[0])
    if best[1] is None:
        total = sum(weight[i] for i in rows) + 1
        return RATE * sum(slope[i] for i in rows) / total
    feature, bound, low, high = best[1]
    return (feature, bound, _grow(counts, slope, weight, low, levels - 1, resting),
            _grow(counts, slope, weight, high, levels - 1, resting))


def evaluate(tree, values) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if values[tree[0]] < tree[1] else tree[3]
    return tree


def as_column(trees: list, values: Column) -> Column:
    """The same sum of trees as a column."""
    def branch(tree):
        if not isinstance(tree, tuple):
            return F.lit(float(tree))
        feature, bound, low, high = tree
        return F.when(values[feature] < bound, branch(low)).otherwise(branch(high))
    return reduce(lambda a, b: a + b, [branch(tree) for tree in trees], F.lit(0.0))


def excess(counts: Sequence[tuple[Sequence[int], float, float]], styles: int) -> list:
    """(features, positives, negatives) of (features, positives, unlabelled).

    A positive stands for one of each style, and as many of the unlabelled may be hidden data.
    """
    return [(values, good, max(0.0, free - styles * good)) for values, good, free in counts]


def calibrated(trees: list, counts: Sequence[tuple[Sequence[int], float, float]],
               styles: int = 1) -> float:
    """The margin from which on unseen candidates are right often enough, from unlabelled counts.

    Groups of equal margin are taken from the highest down; it lies halfway between the last
    group that holds more positives than negatives, with all so far right often enough, and
    the next one below. It is infinite if there is none.
    """
    levels = {}
    for values, good, free in counts:
        margin = sum(evaluate(t, values) for t in trees)
        g, f = levels.get(margin, (0.0, 0.0))
        levels[margin] = (g + good, f + free)
    order = sorted(levels, reverse=True)
    best, good, bad = math.inf, 0.0, 0.0
    for i, margin in enumerate(order):
        (_, g, b), = excess([((), *levels[margin])], styles)
        good, bad = good + g, bad + b
        if g > b and good >= PRECISION * (good + bad):
            best = (margin + order[i + 1]) / 2 if i + 1 < len(order) else margin
    return best


def fit(rows: DataFrame) -> dict[str, tuple[list, float]]:
    """Trees and threshold per generator, from counts over all documents.

    A fifth of the documents is kept for the thresholds.
    """
    unseen = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0

    def tagged(name, anew, values):
        return F.struct(F.lit(name).alias("generator"), values.alias("features"), F.lit(anew).alias("anew"))

    def free(name, c):
        return tagged(name, False, c["features"])

    named = F.concat(*[F.concat(
        F.transform(F.col(f"{name}_anew"), partial(tagged, name, True)),
        F.transform(F.filter(F.col(name), lambda c: ~c["known"]), partial(free, name)))
        for name in GENERATORS])
    counted = rows.select(unseen.alias("unseen"), F.explode(named).alias("c")).groupBy(
        "unseen", "c.generator", "c.features").agg(
        F.count_if("c.anew").alias("good"), F.count_if(~F.col("c.anew")).alias("free")).collect()
    models = {}
    for name in GENERATORS:
        own = [r for r in counted if r.generator == name]
        seen, held = ([(r.features, float(r.good), float(r.free)) for r in sorted(own, key=repr)
                       if r.unseen == flag] for flag in (False, True))
        trees = boost(excess(seen, HIDDEN[name])) if seen else []
        models[name] = (trees, calibrated(trees, held, HIDDEN[name]) if trees else math.inf)
    return models


# ------------------------------------------------------------------ the operator

def personal_data(documents: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per document: base counts and digest, all spans as text, and how many the trees added."""
    def places(spans):
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))

    found = with_candidates(with_base(documents, text, doc_id))
    found = written(found.select("doc_id", *[places(F.col(k)).alias(k) for k in KINDS], *GENERATORS,
                                 *[f"{name}_anew" for name in GENERATORS]), "candidates")
    models = fit(found)

    def accepted(trees, least, c):
        return ~c["known"] & (as_column(trees, c["features"]) >= F.lit(least))

    added = F.concat(*[F.transform(
        F.filter(F.col(name), partial(accepted, trees, least)),
        lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
        for name, (trees, least) in models.items()])
    rows = found.withColumn("_added", added)  # generators give different kinds, so none is there twice

    def spell(kind, spans):
        return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))

    def of_kind(kind, s):
        return s["kind"] == kind

    base = F.concat(*[spell(k, F.col(k)) for k in KINDS])
    everything = F.concat(*[spell(k, F.array_sort(F.concat(F.col(k), places(
        F.filter("_added", partial(of_kind, k)))))) for k in KINDS])
    return rows.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(everything, ",").alias("spans"), F.size("_added").cast("long").alias("n_added"))


def redact(documents: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Documents with every span replaced by its kind in brackets; ids must be unique."""
    spans = personal_data(documents, text, doc_id).select(F.col("doc_id").alias("_id"), "spans")
    parsed = F.transform(F.filter(F.split("spans", ","), lambda s: s != ""), lambda s: F.struct(
        F.split(s, ":")[1].cast("int").alias("start"), F.split(s, ":")[2].cast("int").alias("end"),
        F.split(s, ":")[0].alias("kind")))
    inner, (own_text, own_id) = aside(documents, text, doc_id)
    body = F.coalesce(F.col(own_text), F.lit(""))

    def piece(wide, at, to):
        """Code points [at, to) of a text whose code points take four bytes each."""
        return F.decode(F.substring(wide, 4 * at + 1, 4 * (to - at)), "UTF-32")

    def pieces(own):
        ordered, wide = own["spans"], own["wide"]
        reach = running(F.transform(ordered, lambda s: s["end"]), F.greatest)
        before = F.concat(F.array(F.lit(0)), reach)  # one more than spans, the last one for the rest
        cut = F.transform(F.filter(F.arrays_zip(ordered.alias("s"), before.alias("at")), lambda z: (
            z["s"].isNull() | (z["s"]["start"] >= z["at"]))), lambda z: F.concat(
            piece(wide, z["at"], F.coalesce(z["s"]["start"], (F.length(wide) / 4).cast("int"))),
            F.coalesce(F.concat(F.lit("["), z["s"]["kind"], F.lit("]")), F.lit(""))))
        return F.array_join(cut, "")

    cut = let(F.struct(F.array_sort(parsed).alias("spans"), F.encode(body, "UTF-32").alias("wide")), pieces)
    joined = inner.join(spans, F.col(own_id).eqNullSafe(F.col("_id"))).withColumn(own_text, cut)
    return joined.drop("_id", "spans").toDF(*documents.columns)
