"""The prefix trie and the repair against brute force over whole conversations."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest

from rosterloom.llm import conversation_repair as cr
from rosterloom.llm import prefix_trie as pt

SCHEMA = "conv_id bigint, turn bigint, role string, text string, pos string, kind int, depth string, c int, state string, block string"
INK = re.compile(r"[^\x20\x09-\x0D]")


def table_of(spark, rows):
    return spark.createDataFrame([(*r, "p", 1, "d", 2, "s", "b") for r in rows], SCHEMA).repartition(3)


def some_conversations(seed, convs=70):
    """Shared beginnings, gaps in the ids, one long conversation, nulls in every column, repeated rows, empty and long texts."""
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        if c % 20 == 7:
            continue
        n = 150 if c == 43 else rng.choice([1, 2, 2, 3, 4, 6])
        begin = rng.randrange(3)
        for t in range(n):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ("user", "assistant")[t % 2]
            role = "system" if t == 0 and rng.random() < 0.3 else role
            text = f"shared {begin} words." if t < 2 else rng.choice(["yes.", "no", "so it is!", "", " \t ", "again? ", "x y z " * rng.randrange(3) + "end"])
            rows.append((c, t, role, text))
    rows += [(61, None, "user", "no turn."), (61, 0, None, None), (62, 5, "tool", "odd role."), (62, 9, "", "empty role"), (-3, 0, "user", "below zero."), (101, 0, "user", "w " * 30000 + ".")]
    rows += [rows[3], rows[3]]
    return rows


def digest(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def crc(s):
    return zlib.crc32(str(s).encode())


def in_order(rows):
    convs = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, digest(role or "", text or ""), role or "", text or ""))
    return {c: [(r[3], r[4]) for r in sorted(turns)] for c, turns in convs.items()}


def trie_by_hand(paths):
    members, ends = defaultdict(list), defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children = defaultdict(set)
    for p in members:
        if p:
            children[p[:-1]].add(p)
    out = []
    for p in members:
        below = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in below if q)
        ids = ",".join(map(str, sorted(ends[p])))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children[p]), sum(not children[q] for q in below), saved, hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def got_trie(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def rebuilt_by_hand(convs):
    out = {}
    for c in convs:
        h = crc(c) % 4
        base = convs.get(c - (abs(c) % 20) * (1 if c >= 0 else -1), [])
        out[c] = tuple(base[:h] + convs[c][h:])
    return out


@pytest.fixture(scope="module")
def rows_of_conversations():
    return some_conversations(5)


def test_trie_of_rebuilt_conversations(spark, rows_of_conversations):
    rebuilt, members = pt.borrowed(pt.numbered_turns(table_of(spark, [*rows_of_conversations, (None, 1, "user", "nobody's.")])))
    got = pt.trie(pt.prefixes(rebuilt, ["part", "pos"]), members)
    assert got_trie(got) == trie_by_hand(rebuilt_by_hand(in_order(rows_of_conversations)))


def test_trie_over_several_levels_of_splitters(spark, monkeypatch):
    """Lists are split several times, hot parents are broadcast, pieces of ends are short."""
    monkeypatch.setattr(pt, "PIECE", 10)
    monkeypatch.setattr("rosterloom.llm.common.HOT_ROWS", 3)
    monkeypatch.setattr("rosterloom.llm.common.HOT_KEYS", 10**6)
    whole = pt.ranked
    monkeypatch.setattr(pt, "ranked", lambda arcs, level=0, *_: whole(arcs, level, 3, 5))
    rows = [(c, t, "user", f"{c % 3 if t else 0} text" if t < 3 else f"{c}.{t}") for c in range(90) for t in range(c % 6)] + [(200, 0, "user", "0 text")]
    assert got_trie(pt.prefix_trie(table_of(spark, rows))) == trie_by_hand({c: tuple(p) for c, p in in_order(rows).items()})


def test_trie_of_nothing_and_of_turnless(spark):
    assert got_trie(pt.prefix_trie(table_of(spark, []))) == []
    rows = [(41, 0, "user", "lost")]  # its base does not exist and h is not 0
    h = crc(41) % 4
    rebuilt, members = pt.borrowed(pt.numbered_turns(table_of(spark, rows)))
    assert got_trie(pt.trie(pt.prefixes(rebuilt, ["part", "pos"]), members)) == trie_by_hand({41: tuple([("user", "lost")][h:])})
    assert h > 0


# ---- repair


def cheapest(kinds):
    """Least cost and the ASCII-least edits, by looking at every way."""

    @lru_cache(None)
    def best(i, state, inserted):
        found = [(0, "")] if i == len(kinds) and state in ("", "a") else []
        wants = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
        if inserted < 3:
            r = "a" if state == "u" else "u"
            found.append((3, "I", best(i, r, inserted + 1)))
        if i < len(kinds):
            fault, initial = kinds[i][0], kinds[i][1:]
            found.append((4, "D", best(i + 1, state, 0)))
            if fault not in "bd":
                more = 3 if fault == "t" else 0
                if initial and initial in wants:
                    found.append((more, "K", best(i + 1, initial, 0)))
                r = "a" if state == "u" else "u"
                found.append((3 + more, "R", best(i + 1, r, 0)))
        ways = [f if len(f) == 2 else (f[0] + f[2][0], f[1] + f[2][1]) for f in found if len(f) == 2 or f[2] is not None]
        return min(ways, default=None)

    return best(0, "", 0)


def repair_by_hand(rows):
    convs = defaultdict(list)
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        tie, k = digest(role, text), crc(f"{' ' if c is None else c}:{' ' if t is None else t}") % 20
        if k == 0:
            convs[c]
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        convs[c] += [(t is not None, t or 0, tie, t, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    out = []
    for c, turns in convs.items():
        turns.sort(key=lambda r: r[:3])
        seen, kinds = set(), []
        for *_, role, text in turns:
            ink = INK.findall(text)
            fault = "b" if not ink else "d" if (role, text) in seen else "t" if ink[-1] not in ".!?" else "-"
            seen.add((role, text))
            kinds.append(fault + role[:1])
        numbers = [r[3] for r in turns if r[3] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        pairs = [a[4][:1] + b[4][:1] for a, b in zip(turns, turns[1:])]
        cost, audit = cheapest(tuple(kinds)) if len(kinds) < 60 else (None, None)
        faults = "".join(k[0] for k in kinds)
        lines, i, state = [], 0, ""
        for e in audit or "":
            if e in "KRD":
                i += 1
            if e != "D":
                role = turns[i - 1][4] if e == "K" else "assistant" if state == "u" else "user"
                lines.append(f"{role}:{turns[i - 1][5] if e in 'KR' else ''}")
                state = role[:1]
        sha = None if audit is None else hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((c, gaps, faults.count("b"), faults.count("d"), faults.count("t"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0))


COUNTS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def got_repairs(df):
    return sorted((tuple(r) for r in df.select(*COUNTS).collect()), key=lambda r: (r[0] is not None, r[0] or 0))


def repaired(spark, rows):
    conversations = table_of(spark, rows)
    return got_repairs(cr.repair(cr.damaged(conversations), conversations, ["tie"]))


@pytest.fixture(scope="module")
def whole(spark):
    rows = [*some_conversations(9), (None, 3, "user", "nobody's."), (None, None, None, None)]
    return rows, repaired(spark, rows)


def test_repair_by_hand(whole):
    rows, got = whole
    wanted = repair_by_hand(rows)
    assert [g[:6] for g in got] == [w[:6] for w in wanted]
    for g, w in zip(got, wanted):
        assert w[6] is None or g == w
    assert any(set("KRDI") <= set(g[7]) for g in got)


def test_blocks_do_not_change_the_repair(spark, whole, monkeypatch):
    """Blocks of two rows for all but long conversations, whose blocks are the root of their length; pieces of a few bytes."""
    monkeypatch.setattr(cr, "hot_limit", lambda total: 4)
    monkeypatch.setattr(cr, "PIECE", 20)
    assert repaired(spark, whole[0]) == whole[1]


def test_repair_of_nothing(spark):
    assert repaired(spark, []) == []
    c, t = next((c, t) for c in range(50) for t in range(20) if crc(f"{c}:{t}") % 20 == 0)
    assert repaired(spark, [(c, t, "user", "gone.")]) == [(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_walk_is_the_least_tight_way():
    rng = random.Random(1)
    for _ in range(400):
        kinds = [rng.choice("bdt---") + rng.choice(["u", "a", "s", "x", ""]) for _ in range(rng.randrange(7))]
        steps = cr.Steps()
        vector = tuple(cr.at_end())
        for k in reversed(kinds):
            vector = steps.back(k, vector)
        audit, state = cr.walk(kinds, cr.at_end(), cr.START, True, steps)
        assert (vector[cr.START], audit) == cheapest(tuple(kinds)) and state in (cr.START, cr.ASSISTANT)
        matrix, after = cr.fold(kinds, steps), cr.at_end()
        assert [min(m + a for m, a in zip(row, after)) for row in matrix][cr.START] == vector[cr.START]
