import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from gaugeframe.llm import conversation_repair as cr

SPACE = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        word = lambda v: " " if v is None else str(v)
        fate = zlib.crc32(f"{word(conv)}:{word(turn)}".encode()) % 20
        role, text = word(role), word(text)
        if fate == 1:
            text = ""
        if fate == 2:
            text = re.sub("[.!?]", "", text)
        if fate == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(fate, 1)
    return out


def order(row):
    _, turn, role, text = row
    key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
    return (turn is not None, turn or 0, role, key)


def brute_repair(rows):
    """Dijkstra-free: all edits by a table over (row, state) with whole strings kept."""
    seen, faults = set(), []
    for role, text in rows:
        kept = text.rstrip(SPACE)
        faults.append("blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else "")
        seen.add((role, text))
    nxt = {"": "u", "s": "u", "a": "u", "u": "a"}
    names = {"u": "user", "a": "assistant"}
    best = {"": (0, "", ())}

    def widen(best):
        for _ in range(3):
            for state, (cost, audit, out) in list(best.items()):
                way = (cost + 2, audit + "I", (*out, (names[nxt[state]], "")))
                if nxt[state] not in best or way[:2] < best[nxt[state]][:2]:
                    best[nxt[state]] = way
        return best

    for (role, text), fault in zip(rows, faults):
        new = {}

        def offer(state, way):
            if state not in new or way[:2] < new[state][:2]:
                new[state] = way

        for state, (cost, audit, out) in widen(best).items():
            offer(state, (cost + 3, audit + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            extra = fault == "truncated"
            first = role[:1]
            if (first == "s" and state == "") or (first == "u" and state != "u") or (first == "a" and state == "u"):
                offer(first, (cost + extra, audit + "K", (*out, (role, text))))
            offer(nxt[state], (cost + 2 + extra, audit + "R", (*out, (names[nxt[state]], text))))
        best = new
    ends = [w for s, w in widen(best).items() if s in ("", "a")]
    cost, audit, out = min(ends, key=lambda w: w[:2])
    return faults, cost, audit, out


def brute(rows):
    convs = {r[0]: [] for r in rows}
    for row in damage(rows):
        convs[row[0]].append(row)
    result = {}
    for conv, own in convs.items():
        own.sort(key=order)
        faults, cost, audit, out = brute_repair([(r[2], r[3]) for r in own]) if own else ([], 0, "", ())
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(own, own[1:])]
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
        result[conv] = (
            gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest,
        )
    return result


def made(seed, convs, longest, nulls=True):
    draw = random.Random(seed)
    rows = []
    for conv in range(convs):
        for turn in range(draw.randrange(1, longest)):
            if draw.random() < 0.85:
                role = draw.choice(["user", "assistant", "system", "tool", "user", "assistant"] + [None, ""] * nulls)
                text = draw.choice(["Yes.", "Yes", "No!", " \n", "a? ", "x\ny", f"t{draw.random()}.", f"t{draw.random()}"] + [None, ""] * nulls)
                rows.append((conv, draw.choice([turn, turn, turn, None]) if nulls else turn, role, text))
    return rows


SCHEMA = "conv_id int, turn int, role string, text string"


def summary(spark, rows, schema=SCHEMA):
    turns = spark.createDataFrame(rows, schema).repartition(3)
    repair = cr.Repair(cr.damaged(turns, "conv_id", "turn", "role", "text"))
    got = cr.summarize(turns, "conv_id", repair).collect()
    return {r.conv_id: tuple(r)[1:] for r in got}, len(got)


@pytest.mark.parametrize("segment", [7, 1 << 16])
def test_equals_brute_force(spark, monkeypatch, segment):
    rows = made(1, 120, 14) + [(None, 3, "user", "Hi."), (None, 4, "assistant", "Yo."), (None, None, None, None)]
    rows += rows[:9]  # repeated rows
    monkeypatch.setattr(cr, "SEGMENT_ROWS", segment)
    got, n = summary(spark, rows)
    expected = brute(rows)
    assert n == len(expected)
    for conv, row in expected.items():
        assert got[conv] == row, conv


def test_one_conversation_holds_most_rows(spark):
    rows = made(2, 5, 6, nulls=False) + [(99, i, random.Random(i).choice(["user", "assistant"]), f"t{i}.") for i in range(3000)]
    got, _ = summary(spark, rows)
    for conv, row in brute(rows).items():
        assert got[conv] == row, conv


@pytest.mark.parametrize("seed", range(4))
def test_grammar_equals_rows_one_by_one(seed):
    draw = random.Random(seed)
    sequences = [np.array(draw.choices(range(cr.SYMBOLS), k=draw.randrange(0, 12))) for _ in range(60)] + [np.full(33, 2)]
    plain = lambda m: [[(c[0], str(c[1])) if c else None for c in line] for line in m]
    for sequence, found in zip(sequences, cr.matrices(sequences)):
        whole = cr.NOTHING
        for symbol in sequence:
            whole = cr.product(whole, cr.row_matrix(symbol))
        assert plain(found) == plain(whole)


def test_re_pair_leaves_no_pair_twice_and_spells_the_rows():
    draw = random.Random(8)
    row = np.array([draw.choice([0, 0, 1, 2, -1]) for _ in range(400)] + [-1])
    short, rules = cr.re_pair(row, 3)
    spell = lambda s: [s] if s < 3 else spell(rules[s - 3][0]) + spell(rules[s - 3][1])
    assert [x for s in short.tolist() for x in spell(s)] == row.tolist()
    count = defaultdict(list)
    for i, (x, y) in enumerate(itertools.pairwise(short.tolist())):
        if x >= 0 and y >= 0:
            count[x, y].append(i)
    assert all(max(v) - min(v) < 2 for v in count.values())


def test_ropes_compare_as_strings():
    draw = random.Random(4)
    ropes = [cr.Rope(draw.choice("DIKR") * draw.randrange(0, 3)) for _ in range(40)]
    for _ in range(400):
        ropes.append(draw.choice(ropes) + draw.choice(ropes))
    for _ in range(3000):
        x, y = draw.choice(ropes), draw.choice(ropes)
        assert (x < y) == (str(x) < str(y)) and x.size == len(str(x))


def test_empty_table_text_ids_and_other_columns(spark):
    assert summary(spark, [])[1] == 0
    rows = [("b", 0, "user", "Hi.", 1), ("a", 0, "user", None, 2)]
    got, _ = summary(spark, rows, "conv_id string, turn bigint, role string, text string, pos int")
    assert got == brute([r[:4] for r in rows])


def test_repaired_turns(spark):
    turns = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "Yo")], "conv int, turn int, role string, text string")
    rows = sorted(map(tuple, cr.Repair(turns).turns().collect()))
    assert rows == [(1, 0, "K", "user", "Hi."), (1, 1, "R", "assistant", "Yo")]
