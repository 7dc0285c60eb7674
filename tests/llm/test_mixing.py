from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from imgaudit.llm import mixing as op


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdefgh") | st.none(), st.integers(1, 60), min_size=1, max_size=8))
def test_every_source_is_on_time(slots):
    """At every time each source has its share to within less than one block."""
    plan, period = op.schedule(slots), sum(slots.values())
    assert [slot for *_, slot in plan] == list(range(period))
    done = Counter()
    for name, j, slot in plan:
        assert j == done[name]
        done[name] += 1
        for other, n in slots.items():
            assert abs(done[other] - Fraction(n, period) * (slot + 1)) < 1
    assert done == Counter(slots)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.text(max_size=3), st.floats(0, 1e6), max_size=12), st.integers(1, 40))
def test_whole_slots(weights, period):
    slots = op.whole_slots(weights, period)
    assert slots.keys() == {n for n, w in weights.items() if w > 0}
    assert not slots or sum(slots.values()) == max(period, len(slots))
    assert all(n >= 1 for n in slots.values())


def test_negative_weight():
    with pytest.raises(ValueError):
        op.whole_slots({"a": 1, "b": -1}, 10)


def check(rows, found, slots, block):
    """The slots of all blocks follow the schedule computed one slot after the other."""
    period = sum(slots.values())
    sizes = Counter(r[2] for r in rows)
    want, horizon = {}, None
    for name, n in sizes.items():
        if name not in slots:
            continue
        table = {j: slot for s, j, slot in op.schedule(slots) if s == name}
        blocks = -(-n // block)
        for b in range(blocks + 1):
            want[name, b] = b // slots[name] * period + table[b % slots[name]]
        end = want.pop((name, blocks))
        horizon = end if horizon is None else min(horizon, end)
    assert Counter(r.doc_id for r in found) == Counter(r[0] for r in rows)
    per_block = defaultdict(list)
    for r in found:
        per_block[r.source, r.block].append(r)
    for (name, b), group in per_block.items():
        assert len(group) == min(block, sizes[name] - b * block)
        if name in slots:
            assert {r.slot for r in group} == {want[name, b]}
            assert all(r.in_mix == (r.slot < horizon) for r in group)
        else:
            assert not any(r.in_mix for r in group)
    assert len({r.place for r in found if r.source in slots}) == sum(sizes[n] for n in slots)


@pytest.mark.parametrize("rows", [
    [],
    [(1, "t", "a"), (1, "t", "a"), (None, None, "a"), (2, "", None), (3, "x", "b")],
    [(i, f"t{i}", "hot" if i % 3 else f"s{i % 5}") for i in range(600)],
])
def test_tempered(documents, rows):
    sizes = Counter(r[2] for r in rows)
    slots = op.whole_slots(op.tempered(sizes, 0.7), op.PERIOD)
    check(rows, op.mixed(documents(rows)).collect(), slots, op.BLOCK)


def test_given_weights(documents):
    rows = [(i, "t", "ab"[i % 2]) for i in range(400)] + [(1000 + i, "t", "c") for i in range(40)]
    found = op.mixed(documents(rows), {"a": 3, "b": 1, "unknown": 5}).collect()
    check(rows, found, op.whole_slots({"a": 3, "b": 1}, op.PERIOD), op.BLOCK)
    mix = [r for r in sorted(found, key=lambda r: r.place) if r.in_mix]
    assert {r.source for r in mix} == {"a", "b"}
    for at in range(1, len(mix) // op.BLOCK + 1):
        share = sum(r.source == "a" for r in mix[:at * op.BLOCK]) / op.BLOCK
        assert abs(share - 0.75 * at) < 1


def test_in_order_keeps_rows(documents):
    rows = [(i, f"t{i}", "hot" if i % 3 else "cold") for i in range(200)]
    df = documents(rows)
    out = op.in_order(df, {"hot": 1, "cold": 1})
    assert out.schema == df.schema
    got = out.collect()
    assert sorted(r.doc_id for r in got) == list(range(200))
    places = {r.doc_id: r.place for r in op.mixed(df, {"hot": 1, "cold": 1}).collect()}
    assert [places[r.doc_id] for r in got] == sorted(places.values())


def on_time(found, weights):
    """Every block in the mix lies in the window of the unrounded weights."""
    exact = {name: Fraction(w) for name, w in weights.items()}
    total = sum(exact.values())
    for name, block, slot in found:
        share = exact[name] / total
        assert block < share * (slot + 1) and share * slot < block + 1


@pytest.mark.parametrize("weights, blocks", [
    ({f"s{i}": (10_000 / i) ** 0.7 for i in range(1, 21)}, {f"s{i}": 10_000 // i for i in range(1, 21)}),
    ({"a": 1.0, "b": 0.0001}, {"a": 20_000, "b": 2}),
    ({i: (1200 / (i + 1)) ** 0.7 for i in range(1200)}, {i: 1200 // (i + 1) for i in range(1200)}),
])
def test_unrounded_weights(weights, blocks):
    whole = op.whole_weights(weights)
    plan = list(op.exact_schedule(whole, blocks))
    on_time(plan, weights)
    assert len({slot for *_, slot in plan}) == len(plan) == sum(blocks.values()) + len(blocks)
    slots = op.whole_slots(weights, op.PERIOD)
    assert not op.keeps_windows(op.schedule(slots), slots, whole, blocks)


def test_more_sources_than_slots(documents):
    rows = [(i, "t", "hot") for i in range(800)] + [(1000 + i, "t", f"s{i}") for i in range(1200)]
    found = op.mixed(documents(rows)).collect()
    assert len(found) == len(rows) and len({r.place for r in found}) == len(rows)
    on_time({(r.source, r.block, r.slot) for r in found}, op.tempered(Counter(r[2] for r in rows), 0.7))


def test_rare_source(documents):
    """A source below one slot of the period is not raised, so the mix does not end early."""
    rows = [(i, "t", "a") for i in range(32_000)] + [(40_000, "t", "b")]
    found = op.mixed(documents(rows), {"a": 1.0, "b": 0.0001}).collect()
    assert all(r.in_mix for r in found if r.source == "a")
