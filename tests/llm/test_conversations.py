"""Repairs against a brute-force search over edits, with long and odd conversations."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from imgaudit.llm import conversations as cv
from imgaudit.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, _key string, part int, audit string"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            out.append((conv, None))
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, (turn, role, text))] * (2 if kind == 3 else 1)
    return out


def _search(rows):
    """Uniform-cost search over (row, grammar state), least cost first, then the least audit."""
    heap = [(0, "", 0, 0, ())]
    done = set()
    step = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
    keep = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    while True:
        cost, audit, at, state, made = heapq.heappop(heap)
        if at == len(rows) and state in (0, 3):
            return cost, audit, made
        if (at, state) in done:
            continue
        done.add((at, state))
        role, after = step[state]
        heapq.heappush(heap, (cost + 5, audit + "I", at, after, made + (f"{role}:",)))
        if at < len(rows):
            own, text, fault = rows[at]
            heapq.heappush(heap, (cost + 2, audit + "D", at + 1, state, made))
            if fault not in ("blank", "duplicate"):
                late = 5 if fault == "truncated" else 0
                if (state, own[:1]) in keep:
                    heapq.heappush(heap, (cost + late, audit + "K", at + 1, keep[state, own[:1]], made + (f"{own}:{text}",)))
                heapq.heappush(heap, (cost + late + 1, audit + "R", at + 1, after, made + (f"{role}:{text}",)))


def expected(rows, harm=True):
    groups = {}
    for conv, row in damage(rows) if harm else [(r[0], r[1:]) for r in rows]:
        groups.setdefault(conv, [])
        if row:
            groups[conv].append(row)
    out = {}
    for conv, own in groups.items():
        own = sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(
            f"{len(r[1])}:{r[1]}:{r[2]}".encode()).digest()))
        seen, faults = set(), []
        for _, role, text in own:
            solid = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen
                          else "truncated" if solid[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {t for t, _, _ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        initials = [r[1][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, made = _search([(r[1], r[2], f) for r, f in zip(own, faults)])
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal,
                     cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest())
    return out


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, "KK") for r in rows], SCHEMA)


def _random_rows(rng, conversations, most=9):
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randrange(0, most)):
            if rng.random() < 0.9:
                rows.append((conv, turn, rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "s", ""]),
                             rng.choice(["a.", "b?", "c", " ", "", "d!\n", "e. \t", "f.\xa0", "g\x0b"])))
    return rows


ODD = [(1000, None, None, None), (1000, None, "user", "x."), (None, 3, "user", "hi."), (None, 4, "assistant", None),
       (None, None, "assistant", "hm"), (1001, 5, "user", "same."), (1001, 5, "user", "same."),
       (1001, 5, "assistant", "same."), (1002, -7, "u", "é."), (1002, 10**12, "assistant", "."),
       (1003, 1, "user", "long " * 400_000 + "."), (1004, -2**63, "user", "a."), (1004, 2**63 - 1, "assistant", "b.")]


def _got(spark, frame):
    return {r[0]: tuple(r)[1:] for r in frame.collect()}


def test_damaged_conversations_equal_a_search(spark):
    rows = _random_rows(random.Random(1), 400) + ODD
    want = expected(rows)
    frame = cv.audits(cv.damaged(_frame(spark, rows)))
    got = _got(spark, frame)
    assert got.keys() == want.keys()
    big = 2**63 - 1
    for key, row in want.items():
        assert got[key] == (min(row[0], big), *row[1:]), key


def test_undamaged_conversations_and_repaired_rows(spark):
    rows = [r for r in _random_rows(random.Random(2), 60) if r[2] and r[3]]
    want = expected(rows, harm=False)
    frame = _frame(spark, rows)
    assert _got(spark, cv.audits(cv.plain(frame))) == want
    made = {}
    for r in sorted(cv.repaired(cv.plain(frame)).collect(), key=lambda r: (r.conv_id, r.place)):
        made.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for key, row in want.items():
        assert hashlib.sha256("\n".join(made.get(key, [])).encode()).hexdigest() == row[-1]


@pytest.mark.parametrize("rows_of_block", [1, 2, 7])
def test_long_conversations_are_cut_and_joined(spark, monkeypatch, rows_of_block):
    rng = random.Random(rows_of_block)
    rows = [(7, t, rng.choice(["system", "user", "assistant", "tool"]),
             rng.choice(["same.", "same.", f"{t}.", f"{t}", " "])) for t in range(400)]
    rows += [(8, 3, "user", "copy.")] * 90 + _random_rows(rng, 30)
    cut = cv._cut

    def small(batches):
        whole, cv.ROWS = cv.ROWS, rows_of_block
        yield from cut(batches)
        cv.ROWS = whole

    monkeypatch.setattr(cv, "_cut", small)
    assert cv.blocks(cv.plain(_frame(spark, rows))).filter("conv_id = 7").count() >= 400 // rows_of_block
    assert _got(spark, cv.audits(cv.damaged(_frame(spark, rows)))) == expected(rows)


def test_nodes_are_shared_by_ends():
    ends = sorted(["ua", "sua", "uua", "Uua", "xua", "ua", "aua"], key=lambda s: s[::-1])
    automaton = cv.Automaton(True)
    for signature in ends:
        automaton.of(signature)
    assert automaton.built == len({s[i:] for s in ends for i in range(len(s))})


def test_empty_table(spark):
    frame = _frame(spark, ODD).filter("conv_id = 5")
    assert cv.audits(cv.damaged(frame)).count() == 0
    assert cv.repaired(cv.plain(frame)).count() == 0


def test_query_on_the_given_table(spark, small):
    rows = [tuple(r) for r in small("conversations").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op11_conversation_repair"](spark, "/root/testdata/sf0.001")
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                           "repaired_sha256"]
    assert _got(spark, got) == expected(rows)
