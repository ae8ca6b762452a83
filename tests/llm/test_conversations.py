from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest

from epistola.llm import conversations
from epistola.llm.queries import QUERIES, damaged

SCHEMA = "conv_id long, turn long, role string, text string"


def space(x):
    return " " if x is None else x


def damage(rows):
    for conv, turn, role, text in rows:
        code = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(code, text)
        for _ in range({0: 0, 3: 2}.get(code, 1)):
            yield conv, turn, "user" if code == 4 else role, text


def cheapest(turns):
    """(cost, audit, lines) by trying every edit of every turn and up to two insertions before each and at the end."""
    best = None
    for edits in itertools.product("KRD", repeat=len(turns)):
        if any(forced and e != "D" for e, (_, _, forced, _) in zip(edits, turns, strict=True)):
            continue
        row_cost = sum({"K": 0, "R": 1, "D": 2}[e] + (5 if cut and e != "D" else 0) for e, (_, _, _, cut) in zip(edits, turns, strict=True))
        for gaps in itertools.product(range(3), repeat=len(turns) + 1):
            cost = row_cost + 5 * sum(gaps)
            if best and cost > best[0]:
                continue
            audit = "".join("I" * g + e for g, e in itertools.zip_longest(gaps, edits, fillvalue=""))
            if best and (cost, audit) >= best[:2]:
                continue
            lines, initials, rows = [], "", iter(turns)
            for letter in audit:
                free = "u" if not initials or initials[-1] in "sa" else "a"
                if letter == "D":
                    next(rows)
                    continue
                role, text = {"u": "user", "a": "assistant"}[free], ""
                if letter != "I":
                    kept, text = next(rows)[:2]
                    role = kept if letter == "K" else role
                lines.append(f"{role}:{text}")
                initials += role[:1] or "-"
            if re.fullmatch("(s?(ua)+)?", initials):
                best = (cost, audit, lines)
    return best


def brute(rows, is_damaged=False):
    out = {}
    names = {c for c, *_ in rows}
    rows = list(rows) if is_damaged else list(damage(rows))
    for name in names:
        own = sorted((r for r in rows if r[0] == name), key=lambda r: (r[1] is not None, r[1] or 0, space(r[2]), space(r[3])))
        own = [(n, t, space(role), space(text)) for n, t, role, text in own]
        seen, turns, counts = set(), [], dict(blank=0, duplicate=0, truncated=0, illegal=0)
        for _, _, role, text in own:
            said = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            turns.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        counts["illegal"] = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        numbers = [t for _, t, _, _ in own if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        cost, audit, lines = cheapest(turns)
        out[name] = (gaps, *counts.values(), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def odd_conversations(seed=3, n=50, most=5):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "cut off", "", " \t\n", None, "Why?", "end. ", "nl.\n", "sep. ", "Long " * 300 + "end."]
    rows = []
    for conv in [*range(n), None]:
        for turn in range(r.randint(1, most)):
            rows.append((conv, r.choice([turn, turn, turn, turn * 3, None, -2]), r.choice(["user", "assistant", "user", "assistant", "system", None, "", "User", "umpire"]), r.choice(texts)))
    return rows


def table_at(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).write.mode("overwrite").parquet(f"{folder}/conversations.parquet")
    return str(folder)


def answer(frame):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    rows = [(r.conv_id, tuple(r[n] for n in names)) for r in frame.collect()]
    assert len(dict(rows)) == len(rows)
    return dict(rows)


def test_query_equals_brute_force(spark, tmp_path):
    rows = odd_conversations()
    assert answer(QUERIES["op11_conversation_repair"](spark, table_at(spark, tmp_path, rows))) == brute(rows)


@pytest.mark.parametrize("part", [1, 2, 3])
def test_parts_chain_to_the_same_repair(spark, tmp_path, monkeypatch, part):
    monkeypatch.setattr(conversations, "PART", part)
    rows = odd_conversations(seed=part, n=40)
    assert answer(QUERIES["op11_conversation_repair"](spark, table_at(spark, tmp_path, rows))) == brute(rows)


def test_long_conversations_equal_one_part(spark, tmp_path, monkeypatch):
    r = random.Random(5)
    rows = [(c, t, r.choice(["user", "assistant", "assistant", "system"]), r.choice(["a.", "b.", "c"]) + str(r.randrange(300)) + r.choice([".", ""])) for c in range(3) for t in range(700)]
    folder = table_at(spark, tmp_path, rows)
    whole = answer(QUERIES["op11_conversation_repair"](spark, folder))
    monkeypatch.setattr(conversations, "PART", 64)
    assert answer(QUERIES["op11_conversation_repair"](spark, folder)) == whole


def test_repaired_turns_are_sound(spark):
    rows = odd_conversations(seed=9)
    fixed = conversations.repaired_turns(conversations.repair(damaged(spark.createDataFrame(rows, SCHEMA)), present="present")).collect()
    by = {}
    for t in sorted(fixed, key=lambda t: (t.conv_id is None, t.conv_id, t.part, t.position)):
        by.setdefault(t.conv_id, []).append(t.role[:1])
    assert by and all(re.fullmatch("s?(ua)+", "".join(v)) for v in by.values())


def test_empty_tables_absent_turns_and_clashing_names(spark):
    frame = spark.createDataFrame([(1, 1, "user", "a.", "x", 1), (1, 2, "assistant", "b.", "y", 2)], SCHEMA + ", part string, place int")
    got = conversations.repair(frame).collect()
    assert [(r.conv_id, r.cost, r.audit, len(r.repaired)) for r in got] == [(1, 0, "KK", 2)]
    assert conversations.repair(frame.limit(0)).count() == 0
    gone = conversations.repair(frame.selectExpr("*", "false as here"), present="here").collect()
    assert [(r.conv_id, r.gaps, r.blank, r.cost, r.audit, r.repaired) for r in gone] == [(1, 0, 0, 0, "", [])]
