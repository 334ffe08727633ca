import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, kind int, audit string, place int"
LEGAL = re.compile(r"(s?(ua)+)?")
WORD = re.compile(r"[^\x20\x09-\x0D]")


def frame(spark, rows):
    return spark.createDataFrame([(*r, 9, "x", 1) for r in rows], SCHEMA).repartition(3)


def cheapest_of(symbols):
    """The same automaton row by row, letters as plain strings."""
    def close(best):
        for _ in range(2):
            for source, target in ((0, 2), (1, 2), (3, 2), (2, 3)):
                if best[source] is not None:
                    now = (best[source][0] + 5, best[source][1] + "I")
                    best[target] = now if best[target] is None else min(best[target], now)
        return best

    best = close([(0, ""), None, None, None])
    for sym in symbols:
        role, fault = divmod(sym, 3)
        after = [None] * 4

        def offer(target, cost, letters):
            after[target] = (cost, letters) if after[target] is None else min(after[target], (cost, letters))
        for state, entry in enumerate(best):
            if entry is None:
                continue
            offer(state, entry[0] + 2, entry[1] + "D")
            if fault < 2:
                turned = 3 if state == 2 else 2
                offer(turned, entry[0] + 1 + 5 * fault, entry[1] + "R")
                if (role, state) == (0, 0):
                    offer(1, entry[0] + 5 * fault, entry[1] + "K")
                if role == 1 and state != 2 or role == 2 and state == 2:
                    offer(turned, entry[0] + 5 * fault, entry[1] + "K")
        best = close(after)
    return min(x for x in (best[0], best[3]) if x is not None)


def every_edit(symbols, longest):
    """All letter strings up to a length, tried out."""
    best = None
    for n in range(longest + 1):
        for letters in itertools.product("DIKR", repeat=n):
            if sum(x != "I" for x in letters) != len(symbols):
                continue
            rows, out, cost = iter(symbols), "", 0
            for letter in letters:
                if letter == "I":
                    cost += 5
                    out += "a" if out[-1:] == "u" else "u"
                    continue
                role, fault = divmod(next(rows), 3)
                if letter == "D":
                    cost += 2
                elif fault == 2:
                    break
                else:
                    cost += 5 * fault + (letter == "R")
                    out += "suax"[role] if letter == "K" else "a" if out[-1:] == "u" else "u"
            else:
                if LEGAL.fullmatch(out):
                    entry = (cost, "".join(letters))
                    best = entry if best is None else min(best, entry)
    return best


def test_grammar_gives_what_a_plain_walk_gives():
    rng = random.Random(1)
    sequences = [bytes(rng.randrange(12) for _ in range(rng.choice([0, 1, 2, 5, 9, 40, 300]))) for _ in range(200)]
    sequences += [bytes([3, 6] * 500), bytes([3]) * 257, bytes([0, 3, 6]) * 99]
    found = repair.edits(sequences)
    for s in sequences:
        assert found[s] == cheapest_of(s)


@pytest.mark.parametrize("length", [0, 1, 2, 3])
def test_cheapest_of_all_edit_strings(length):
    rng = random.Random(length)
    for symbols in itertools.product(range(12), repeat=length) if length < 2 else [rng.choices(range(12), k=length) for _ in range(25)]:
        assert repair.edits([bytes(symbols)])[bytes(symbols)] == every_edit(symbols, length + 3)


def test_re_pair_leaves_no_pair_twice_and_expands_back():
    rng = np.random.default_rng(2)
    sequences = [rng.integers(0, 4, n) for n in (0, 1, 2, 50, 400)] + [np.zeros(33, int), np.tile([1, 2], 64)]
    rules, short = repair.re_pair(sequences, 4)

    def expand(symbol):
        return [symbol] if symbol < 4 else expand(rules[symbol - 4][0]) + expand(rules[symbol - 4][1])
    for s, c in zip(sequences, short):
        assert [x for symbol in c.tolist() for x in expand(symbol)] == s.tolist()
    seen = {}
    for n, c in enumerate(short):
        for i, pair in enumerate(zip(c.tolist(), c.tolist()[1:])):
            last = seen.get(pair)
            assert last is None or pair[0] == pair[1] and last == (n, i - 1), pair
            seen.setdefault(pair, (n, i))
    assert len(short[-1]) <= 2 and len(rules) > 10


def plain(rows, conversations):
    """The contract, read row by row."""
    out = []
    for conv in {c for c in conversations}:
        mine = sorted(((t is not None, t or 0, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv),
                      key=lambda r: (r[0], r[1], r[2].encode(), r[3].encode()))
        turns, seen, symbols = [r[1] for r in mine if r[0]], set(), []
        counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, role, text in mine:
            words = WORD.findall(text)
            fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            symbols.append(("sua".index(role[0]) if role[:1] in tuple("sua") else 3) * 3
                           + (0 if not fault else 1 if fault == "truncated" else 2))
        initials = [r[2][:1] for r in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, letters = cheapest_of(symbols)
        lines, rest, last = [], iter(mine), ""
        for letter in letters:
            _, _, role, text = (0, 0, "", "") if letter == "I" else next(rest)
            if letter == "D":
                continue
            role = role if letter == "K" else "assistant" if last == "u" else "user"
            last = role[0]
            lines.append(f"{role}:{text}")
        assert LEGAL.fullmatch("".join(x[0] for x in lines))
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *counts.values(), illegal, cost, letters,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


ODD = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (2, 0, "user", "No end"), (2, 2, "user", "Hi."), (2, 2, "user", "Hi."),
       (3, None, None, None), (3, 5, "tool", "x."), (3, 5, "", "y."), (None, 0, "system", "S."), (None, None, "user", "é?"),
       (None, 1, "user", " "), (4, 7, "assistant", ""), (4, 9, "assistant", " \n\t"), (5, 0, "system", "Only."),
       (6, 0, "user", "a. " * 200_000), (6, 1, "assistant", "b" * 400_000), (7, 3, "User", "Q."), (7, 4, "assistant", "A."),
       (8, 1, "assistant", "漢字。"), (8, 0, "user", "Z!\r\n")]


def rows_of(df):
    return sorted(((r.conv_id, r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256)
                   for r in df.collect()), key=str)


def test_odd_rows(spark):
    known = frame(spark, ODD + [(99, 0, "user", "dropped")])
    assert rows_of(repair.repair(frame(spark, ODD), known)) == plain(ODD, [r[0] for r in ODD] + [99])


def test_one_row_a_partition_and_no_rows(spark):
    assert rows_of(repair.repair(frame(spark, ODD).repartition(40))) == plain(ODD, [r[0] for r in ODD])
    assert repair.repair(frame(spark, [])).collect() == []
    alone = repair.repair(frame(spark, []), frame(spark, ODD[:1])).collect()[0]
    assert (alone.cost, alone.audit, alone.repaired_sha256) == (0, "", hashlib.sha256(b"").hexdigest())


def test_a_conversation_of_a_third_of_all_rows(spark):
    rng = random.Random(4)
    rows = [(0, t, rng.choice(["user", "assistant"]), f"say {t}" + rng.choice([".", ""])) for t in range(15_000)]
    rows += [(c, t, "ua"[t % 2].replace("u", "user").replace("a", "assistant"), f"{t}.") for c in range(1, 10_000) for t in range(3)]
    found = {r.conv_id: r for r in repair.audit(frame(spark, rows)).where("conv_id < 3").collect()}
    hot = [r for r in rows if r[0] == 0]
    want = plain(hot, [0])[0]
    assert (found[0].gaps, found[0].truncated, found[0].illegal, found[0].cost, found[0].audit) == (want[1], want[4], want[5], *want[6:8])
    assert found[1].audit == found[2].audit == "KKD"


def test_rewritten_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Again."), (2, 0, "assistant", "Lone.")]
    source = frame(spark, rows)
    back = repair.rewrite(source, repair.audit(source)).orderBy("conv_id", "place").collect()
    assert [tuple(r) for r in back] == [(1, 0, "user", "Hi.", "K"), (1, 1, "assistant", "Again.", "R")]


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(40) for t in range(3)] + [(None, 1, None, None), (5, None, "system", "S?")]
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        want += [(c, t, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    got = [tuple(r) for r in repair.damage(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert repair.damage(frame(spark, rows)).where(F.col("text") == "").count() > 0
