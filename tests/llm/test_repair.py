"""Conversation repair against all edits of short conversations, and a plain reading."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from adloom.llm import glr, repair
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?")


def all_repairs(kinds, most=2):
    """The least (cost, audit) by trying all edits, with up to ``most`` inserts at a place."""
    inserts = ["", *("u", "a"), *("ua", "au")][: 5 if most > 1 else 3]
    best = None

    def extend(at, text, cost, audit):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        for more in inserts:
            now, paid, said = text + more, cost + 5 * len(more), audit + "I" * len(more)
            if at == len(kinds):
                if LEGAL.fullmatch(now) and (best is None or (paid, said) < best[:2]):
                    best = paid, said, now
                continue
            symbol, extra, lost = kinds[at]
            extend(at + 1, now, paid + 2, said + "D")
            if not lost:
                if symbol in "sua":
                    extend(at + 1, now + symbol, paid + extra, said + "K")
                for role in "ua":
                    extend(at + 1, now + role, paid + 1 + extra, said + "R")

    extend(0, "", 0, "")
    return best


def applied(kinds, edits):
    out = ""
    for (symbol, _, _), each in itertools.zip_longest(kinds, edits, fillvalue=("", 0, False)):
        for edit in each:
            if edit != "D":
                out += symbol if edit == "K" else "a" if out.endswith("u") else "u"
    return out


def test_repair_is_the_cheapest_of_all():
    parse, codes = repair.parser(), list(repair.KINDS.values())
    rng = random.Random(5)
    for _ in range(250):
        kinds = [rng.choice(codes) for _ in range(rng.randint(0, 5))]
        cost, edits = parse.repair(kinds)
        want = all_repairs(kinds)
        assert (cost, "".join(edits)) == want[:2], kinds
        assert applied(kinds, edits) == want[2]


def by_states(kinds):
    """The same by the four states of the regular expression, with audits as texts."""
    moves = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    def with_inserts(front):
        for _ in range(3):
            for (state, symbol), after in moves.items():
                if state in front and symbol != "s":
                    cost, audit = front[state]
                    front[after] = min(front.get(after, (9e9, "")), (cost + 5, audit + "I"))
        return front

    front = {0: (0, "")}
    for symbol, extra, lost in kinds:
        new = {}
        for state, (cost, audit) in with_inserts(front).items():
            offers = [(state, cost + 2, "D")]
            if not lost:
                offers.append((moves.get((state, symbol)), cost + extra, "K"))
                offers += [(moves.get((state, r)), cost + extra + 1, "R") for r in "ua"]
            for after, paid, edit in offers:
                if after is not None:
                    new[after] = min(new.get(after, (9e9, "")), (paid, audit + edit))
        front = new
    front = with_inserts(front)
    return min(front[s] for s in (0, 3) if s in front)


def test_long_conversations_need_few_sets_of_stacks():
    parse, codes = repair.parser(), list(repair.KINDS.values())
    rng = random.Random(6)
    for size in (30, 200, 1500):
        for _ in range(12):
            kinds = [rng.choice(codes) for _ in range(size)]
            cost, edits = parse.repair(kinds)
            assert (cost, "".join(edits)) == by_states(kinds)
    assert len(parse.sets) < 3000


def test_grammar_of_unbounded_depth():
    """Another grammar: brackets, of which one may be missing."""
    parse = glr.Parser([("S", ()), ("S", ("S", "(", "S", ")"))], "()", glr.Costs(margin=20))
    for text, cost in (("(())", 0), ("(()", 2), ("())", 2), ("))", 1), ("", 0), ("(" * 9, 6)):
        assert parse.repair([(c, 0, False) for c in text])[0] == cost


def damage(rows):
    """Rows in order after damage, by conversation."""
    found = {}
    for conv_id, turn, role, text in rows:
        key = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        kept = found.setdefault(conv_id, [])
        hit = zlib.crc32(key.encode()) % 20
        if hit == 1:
            text = ""
        if hit == 2:
            text = re.sub("[.!?]", "", text)
        if hit == 4:
            role = "user"
        if hit:
            kept += [(turn, role, text)] * (2 if hit == 3 else 1)
    for kept in found.values():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0,
                                 hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
    return found


def expected(rows):
    result = {}
    for conv_id, kept in damage(rows).items():
        counts, kinds, seen = {"blank": 0, "duplicate": 0, "truncated": 0}, [], set()
        for _, role, text in kept:
            bare = text.strip(" \t\n\x0b\f\r")
            fault = None
            if not bare:
                fault = "blank"
            elif (role, text) in seen:
                fault = "duplicate"
            elif bare[-1] not in ".!?":
                fault = "truncated"
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            kinds.append((role[:1] or "x", 5 * (fault == "truncated"), fault in ("blank", "duplicate")))
        turns = [t for t, _, _ in kept if t is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(kept, kept[1:])]
        cost, audit = by_states(kinds)
        left, source = [], iter(kept)
        for edit in audit:
            role, text = (None, "") if edit == "I" else next(source)[1:]
            if edit in "IR":
                role = "assistant" if left and left[-1].startswith("u") else "user"
            if edit != "D":
                left.append(f"{role}:{text}")
        result[conv_id] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *counts.values(),
            sum(p not in ("su", "ua", "au") for p in pairs),
            cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest(),
        )
    return result


def random_rows(seed, n):
    rng = random.Random(seed)
    texts = ["Fine.", "Good!", "cut off", "", " \t", None, "Why?", "é.", "long " * 40 + "."]
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant"]
    rows = []
    for conv_id in [None, *range(n)]:
        turns = [rng.choice([None, *range(-2, 9)]) for _ in range(rng.randint(1, 9))]
        rows += [(conv_id, t, rng.choice(roles), rng.choice(texts)) for t in turns]
    return rows


def answers(spark, rows):
    table = spark.createDataFrame(rows, SCHEMA).withColumn("digest", F.lit("clash"))
    found = repair.digests(table.repartition(3)).collect()
    assert len(found) == len({r.conv_id for r in found})
    return {r.conv_id: tuple(r)[1:] for r in found}


@pytest.mark.parametrize("block", [4 << 20, 30])
def test_reports_equal_a_plain_reading(spark, monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK_BYTES", block)
    rows = random_rows(7, 120)
    # One conversation with a third of all rows, over several ranges.
    turns = random.Random(8).choices(range(400), k=300)
    rows += [(1000, t, ("user", "assistant")[t % 2], f"Turn {t % 90}.") for t in turns]
    assert answers(spark, rows) == expected(rows)


def test_nothing_and_only_dropped_rows(spark):
    assert answers(spark, []) == {}
    turn = next(t for t in range(999) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    assert answers(spark, [(5, turn, "user", "Hi.")]) == {5: (0, 0, 0, 0, 0, 0, "", empty)}
