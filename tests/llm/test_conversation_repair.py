"""Operator 12 against an exhaustive search, and its edge cases."""

from __future__ import annotations

import hashlib
import itertools
import os
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest

from eventide.llm import conversation_repair as cr

SF = "/root/testdata/sf0.01"
GOOD = re.compile(r"(s?(ua)+)?")
SPACE = " \t\n\x0b\x0c\r"
TURNS = "conv_id long, turn long, role string, text string, seg string, place int, body string"


def faults(rows):
    """(blank, duplicate, truncated) flags of a conversation's rows, first fault only."""
    out, said = [], set()
    for _, role, text in rows:
        t = text.strip(SPACE)
        kind = "blank" if not t else "duplicate" if (role, text) in said else "truncated" if t[-1] not in ".!?" else ""
        said.add((role, text))
        out.append(kind)
    return out


def cheapest(initials, kinds):
    """Least (cost, audit) and its role initials, over all repairs with up to two insertions in a gap."""

    @lru_cache(maxsize=None)
    def best(i, roles):
        # roles so far only matter up to the pair that is open
        if i == len(initials):
            ends = [(3 * len(x), "I" * len(x)) for k in range(3) for x in itertools.product("ua", repeat=k)
                    if GOOD.fullmatch(roles + "".join(x))]
            return min(ends, default=None)
        found = []
        for k in range(3):
            for x in itertools.product("ua", repeat=k):
                now = roles + "".join(x)
                steps = [(4, "D", "")]
                if kinds[i] not in ("blank", "duplicate"):
                    more = 3 if kinds[i] == "truncated" else 0
                    steps += [(more, "K", initials[i])] if initials[i] else []
                    steps += [(3 + more, "R", r) for r in "ua" if r != initials[i]]
                for cost, edit, role in steps:
                    after = now + role
                    if not any(GOOD.fullmatch(after + z) for z in ("", "a", "ua")):
                        continue
                    rest = best(i + 1, short(after))
                    if rest:
                        found.append((3 * k + cost + rest[0], "I" * k + edit + rest[1]))
        return min(found, default=None)

    def short(roles):
        while roles.endswith("uaua"):
            roles = roles[:-2]
        return roles

    return best(0, "")


def rendered(rows, audit):
    out, i, roles = [], 0, ""
    for edit in audit:
        due = "a" if roles.endswith("u") else "u"
        if edit == "I":
            out.append((cr.ROLES[due], ""))
            roles += due
            continue
        _, role, text = rows[i]
        i += 1
        if edit == "K":
            out.append((role, text))
            roles += role[:1]
        elif edit == "R":
            out.append((cr.ROLES[due], text))
            roles += due
    assert GOOD.fullmatch(roles)
    return out


def expected(rows):
    kinds = faults(rows)
    initials = [r[1][:1] for r in rows]
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, audit = cheapest(tuple(initials), tuple(kinds)) if rows else (0, "")
    text = "\n".join(f"{r}:{t}" for r, t in rendered(rows, audit))
    return (gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit,
            hashlib.sha256(text.encode()).hexdigest())


def ordered(rows):
    clean = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    return sorted(clean, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def by_hand(conversations):
    """Damage and repair of rows (conv_id, turn, role, text), in Python."""
    kept = defaultdict(list)
    for c, t, role, text in conversations:
        rows = kept[c]
        role, text = " " if role is None else role, " " if text is None else text
        way = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if way == 0:
            continue
        text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
        rows += [(t, "user" if way == 4 else role, text)] * (2 if way == 3 else 1)
    return {c: expected(ordered(rows)) for c, rows in kept.items()}


def report(df):
    return {r.conv_id: (*(r[c] for c in [*cr.COUNTS, "cost"]), r.audit, r.repaired_sha256) for r in df.collect()}


def whole(spark, rows, segment=cr.SEGMENT_ROWS):
    reports, repaired = cr.repair(spark.createDataFrame([(*r, "x", 7, None) for r in rows], TURNS).repartition(3), segment)
    sha = {r.conv_id: r.repaired_sha256 for r in cr.digests(repaired).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    return {r.conv_id: (*(r[c] for c in [*cr.COUNTS, "cost"]), r.audit, sha.get(r.conv_id, empty))
            for r in reports.collect()}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_query_equals_search(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet")
            .select("conv_id", "turn", "role", "text").collect()]
    assert report(cr.conversation_repair(spark, SF)) == by_hand(rows)


@pytest.mark.parametrize("segment", [1, 2, 1024])
def test_random_conversations_equal_search(spark, segment):
    rng = random.Random(segment)
    texts = ["Yes.", "No!", "open end", "", " ", None, "Yes."]
    rows = []
    for c in range(120):
        for k in range(rng.randrange(1, 7)):
            rows.append((c if c else None, rng.choice([None, k, k, k, k + 3]),
                         rng.choice(["user", "user", "assistant", "assistant", "system", "tool", None, ""]),
                         rng.choice(texts) if rng.random() < 0.5 else f"Text {c} {k}."))
    convs = defaultdict(list)
    for r in rows:
        convs[r[0]].append(r[1:])
    assert whole(spark, rows, segment) == {c: expected(ordered(r)) for c, r in convs.items()}


def test_segments_from_every_top_combine_to_the_same_repair():
    rng = random.Random(5)
    for _ in range(300):
        turns = [(rng.choice("suat "), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randrange(1, 12))]
        front = {cr.START: (0, "")}
        for t in turns:
            front = cr.advanced(front, *t)
        at = rng.randrange(len(turns) + 1)
        parts = {cr.START: (0, "")}
        for piece in (turns[:at], turns[at:]):
            table = {}
            for top in range(4):
                f = {top: (0, "")}
                for t in piece:
                    f = cr.advanced(f, *t)
                table[top] = f
            parts = cr.combined(parts, table)
        assert cr.accepted(parts) == cr.accepted(front)


def test_one_conversation_over_many_tasks(spark):
    """A third of all rows in one conversation, with repeats far apart."""
    rows = [(7, k, ("user", "assistant")[k % 2], f"Turn {k % 997}.") for k in range(3000)]
    rows += [(100 + k // 4, k % 4, ("user", "assistant")[k % 2], f"Other {k}.") for k in range(6000)]
    rows = [r for r in rows if r[1] != 11]
    got = whole(spark, rows)
    kinds = faults(ordered([r[1:] for r in rows if r[0] == 7]))
    assert got[7][:5] == (1, 0, kinds.count("duplicate"), 0, 1)
    front = {cr.START: (0, "")}
    mine = ordered([r[1:] for r in rows if r[0] == 7])
    for (_, role, _), kind in zip(mine, kinds):
        front = cr.advanced(front, role[:1], kind == "duplicate", False)
    cost, audit = cr.accepted(front)
    text = "\n".join(f"{r}:{t}" for r, t in rendered(mine, audit))
    assert got[7][5:] == (cost, audit, hashlib.sha256(text.encode()).hexdigest())
    assert all(v[5:7] == (0, "KKKK") for c, v in got.items() if c != 7)


def test_empty_tables_and_tables_without_turns(spark, tmp_path):
    none = spark.createDataFrame([], TURNS)
    reports, repaired = cr.repair(none)
    assert reports.count() == repaired.count() == cr.digests(repaired).count() == 0
    none.write.parquet(f"{tmp_path}/a/conversations.parquet")
    assert cr.conversation_repair(spark, f"{tmp_path}/a").count() == 0
    dropped = [c for c in range(2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:5]
    rows = [(c, 0, "user", "Hello.", "x", 1, None) for c in dropped]
    spark.createDataFrame(rows, TURNS).write.parquet(f"{tmp_path}/b/conversations.parquet")
    empty = hashlib.sha256(b"").hexdigest()
    assert report(cr.conversation_repair(spark, f"{tmp_path}/b")) == {c: (0, 0, 0, 0, 0, 0, "", empty) for c in dropped}
