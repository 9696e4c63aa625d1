"""Containment, similarity and pairing against brute force."""

import hashlib
import itertools
import random
import re
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterloom.functions import similar
from rosterloom.functions.bloom import filter_of
from rosterloom.functions.contain import _met, contained, terms_in_texts
from rosterloom.functions.similar import block_ratios, edit_similarities, matcher_ratio, nearest, ratio_pairs, similar_pairs
from rosterloom.operators import pairing
from rosterloom.operators import reconcile as rc
from rosterloom.operators import resolve as rs


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def sim(a, b):
    return 1 - edits(a, b) / max(len(a), len(b))


def noisy_names(seed, n):
    rng = random.Random(seed)
    stems = ["station alpha", "customer 000123", "north yard", "gas", "a much longer name of a power station unit", "ab"]
    out = set()
    while len(out) < n:
        s = list(rng.choice(stems))
        for _ in range(rng.randrange(0, 7)):
            at = rng.randrange(len(s) + 1)
            kind = rng.random()
            if kind < 0.4 and s:
                s[at % len(s)] = rng.choice("abc01 ")
            elif kind < 0.7:
                s.insert(at, rng.choice("abc01"))
            elif len(s) > 1:
                s.pop(at % len(s))
        out.add("".join(s).strip() or "x")
    return sorted(out)


@pytest.fixture(scope="module")
def sides(spark):
    names = noisy_names(11, 120)
    a = [(i % 2, n) for i, n in enumerate(names[::2])]
    b = [(i % 2, n) for i, n in enumerate(names[1::2])]
    return a, b, spark.createDataFrame(a, "g int, x string"), spark.createDataFrame(b, "g int, y string")


@pytest.mark.parametrize("threshold", [0.7, 0.82, 0.88])
def test_similar_pairs_are_complete(sides, threshold):
    a, b, da, db = sides
    got = {(r.g, r.a_name, r.b_name) for r in similar_pairs(da, "x", db, "y", ["g"], threshold).collect()}
    want = {(g, x, y) for (g, x), (h, y) in itertools.product(a, b) if g == h and sim(x, y) >= threshold}
    assert got == want


@pytest.mark.parametrize("threshold", [0.75, 0.82])
def test_nearest_is_the_best(sides, threshold):
    a, b, da, db = sides
    got = {(r.g, r.a_name): r.b_name for r in nearest(da, "x", db, "y", ["g"], threshold).collect()}
    want = {}
    for g, x in a:
        best = min(((-sim(x, y), y) for h, y in b if h == g and sim(x, y) >= threshold), default=None)
        if best:
            want[(g, x)] = best[1]
    assert got == want


@pytest.mark.parametrize("threshold", [0.7, 0.82])
def test_nearest_by_blocks(sides, threshold):
    a, b, da, db = sides
    ratio = lambda x, y: SequenceMatcher(None, x, y).ratio()
    got = {(r.g, r.a_name): (r.b_name, r.similarity) for r in nearest(da, "x", db, "y", ["g"], threshold, blocks=True).collect()}
    want = {}
    for g, x in a:
        best = min(((-ratio(x, y), y) for h, y in b if h == g and ratio(x, y) >= threshold), default=None)
        if best:
            want[(g, x)] = (best[1], -best[0])
    assert got == want and want


@pytest.mark.parametrize("blocks", [False, True])
def test_nearest_of_a_dense_block_leaves_only_the_best(spark, blocks, monkeypatch):
    """Names of one block that begin alike: what meets does not leave the tasks, and cells of any size give the same."""
    from rosterloom.functions import similar

    met = []
    monkeypatch.setattr(similar, "_scored", lambda *args: met.append(args))
    monkeypatch.setattr(similar, "CELL", 50)
    a = [f"customer#{i:06d}".replace("tomer", "tmoer") if i % 2 else f"customer#{i:06d}".replace("0", "O") for i in range(0, 1000, 7)]
    b = [f"customer#{i:06d}" for i in range(0, 1000, 3)]
    threshold = 0.9 if blocks else 0.78
    da = spark.createDataFrame([(1, x) for x in a] + [(None, "customer#000001")], "g int, x string")
    db = spark.createDataFrame([(1, x) for x in b] + [(None, "customer#000002")], "g int, y string")
    got = {r.a_name: (r.b_name, r.similarity) for r in nearest(da, "x", db, "y", ["g"], threshold, blocks).collect()}
    score = (lambda x, y: SequenceMatcher(None, x, y).ratio()) if blocks else sim
    want = {}
    for x in a:
        best = min(((-score(x, y), y) for y in b if score(x, y) >= threshold), default=None)
        if best:
            want[x] = (best[1], -best[0])
    assert got == want and want and not met


def test_edit_similarities():
    rng = random.Random(3)
    pairs = [("", "a"), ("abc", "")] + [tuple("".join(rng.choice("abc") for _ in range(rng.randrange(12))) for _ in "xy") for _ in range(400)]
    a, b = zip(*[(x, y) for x, y in pairs if x or y])
    pairs = list(zip(a, b))
    assert edit_similarities(a, b).tolist() == pytest.approx([sim(x, y) for x, y in pairs])


def test_block_ratios_equal_the_standard_library():
    rng = random.Random(2)
    pairs = [("", ""), ("", "a"), ("a" * 30, "a" * 7), ("日本語😀x", "x😀本")]
    pairs += [tuple("".join(rng.choice("ab c") for _ in range(rng.randrange(30))) for _ in "xy") for _ in range(3000)]
    pairs += list(itertools.product(noisy_names(3, 40), noisy_names(4, 40)))
    a, b = zip(*pairs)
    assert block_ratios(a, b).tolist() == [SequenceMatcher(None, x, y).ratio() for x, y in pairs]


def test_low_thresholds_are_refused(sides):
    _, _, da, db = sides
    for threshold, blocks in ((0.5, False), (0.66, True)):
        with pytest.raises(ValueError):
            similar_pairs(da, "x", db, "y", ["g"], threshold, blocks)


def test_matcher_ratio(spark):
    long = ["abc" * 90 + "d", "ab cd" * 60]
    df = spark.createDataFrame([("abcd", "bcde"), ("x", "x"), tuple(long)], "a string, b string")
    assert [r[0] for r in df.select(matcher_ratio("a", "b")).collect()] == [0.75, 1.0, SequenceMatcher(None, *long).ratio()]


def test_names_within_two_edits_are_settled_before_the_cells(spark, monkeypatch):
    """Of a dense block only names without a partner within two edits are compared with all; ties, short and long names too."""
    rng = random.Random(11)
    right = sorted({f"customer {rng.randrange(2000):09d}" for _ in range(150)} | {"ab", "abcdef", "abcxyz", "x" * 40, "y" * 33})
    swapped = [n.replace("tomer", "tmoer") for n in right[:60] if "tomer" in n]
    left = [*swapped, "cusztomeq 000000100", "customer 99999", "abcdxf", "ba", "é𝄞customer 000000100", "x" * 38 + "yy", "q" * 32]
    da, db = (spark.createDataFrame([(g, n) for g in (None, 1) for n in side], f"g int, {c} string") for side, c in ((left, "x"), (right, "y")))
    compared, cells = [], similar._nearest_in_cells

    def seen(a, *rest):
        compared.extend(r.a_name for r in a.collect())
        return cells(a, *rest)

    monkeypatch.setattr(similar, "_nearest_in_cells", seen)
    block = F.struct("g").alias("g")
    got = {(r.g.g, r.a_name): (r.b_name, r.similarity) for r in nearest(da.select(block, "x"), "x", db.select(block, "y"), "y", ["g"], 0.82).collect()}
    want = {}
    for a in left:
        best = min(((-sim(a, b), b) for b in right if sim(a, b) >= 0.82), default=None)
        if best:
            want |= {(g, a): (best[1], -best[0]) for g in (None, 1)}
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)
    assert not set(compared) & set(swapped)  # all of them before
    assert "x" * 38 + "yy" in compared


def test_contained(spark):
    names = noisy_names(5, 80) + ["gas", "gas yard", "north yard gas yard"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = {tuple(r) for r in contained(df.select(F.col("n").alias("l")), "l", df.select(F.col("n").alias("s")), "s", 3).collect()}
    assert got == {(x, y) for x in names for y in names if y in x and len(y) >= 3}


def test_names_of_digits_meet_few(spark):
    """Names that share all their runs of four with many others meet by longer runs; no pair is lost."""
    short = ["unit " + np.base_repr(i * 7 % 6561, 3).zfill(8) for i in range(2000)] + ["unit 1", "unit 12", "nit", "9999"]
    long = [f"{s}{i % 3}" for i, s in enumerate(short[:2000])] + ["unit", "a unit 12 of a long name, longer than all runs"]
    lo, sh = (spark.createDataFrame([(x,) for x in side], f"{c} string") for side, c in ((long, "l"), (short, "s")))
    want = {(x, y) for x in long for y in short if y in x}
    assert {tuple(r) for r in contained(lo, "l", sh, "s", 3).collect()} == want
    assert _met(lo, "l", sh, "s", 3).count() < 2 * len(want)


@pytest.mark.parametrize("most", [0, 1000])
def test_terms_in_texts(spark, most):
    texts = ["The quick, brown fox", "quicker than a fox - or not", "", "foxes;;run", "Über quick brownies", "no ; ; here", "a,b"]
    terms = ["e", "ow", "nie", "quic", "foxes", "es;;r", "quick", "QUICK, brown", "fox - or", "fox", "than a fox - or not", ";;", "brown fox jumps", "ü", " ; ", "r than a f", ", b", "k, b"]
    dt = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    dq = spark.createDataFrame([(q,) for q in terms], "term string")
    got = {tuple(r) for r in terms_in_texts(dt, "id", "text", dq, "term", most).collect()}
    assert got == {(i, q) for i, x in enumerate(texts) for q in terms if q.lower() in x.lower()}


def test_texts_are_scanned_once_and_not_exchanged(spark):
    dt = spark.createDataFrame([(i, f"text {i} of many words") for i in range(50)], "id long, text string")
    terms = spark.createDataFrame([("xt 7",), ("of many words",), ("nothing of it",)], "term string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = terms_in_texts(dt, "id", "text", terms, "term")
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert got.count() == 51 and "SortMergeJoin" not in plan.split("Subquery")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bloom_filter(spark):
    keys = spark.range(500).selectExpr("CAST(id * 7 AS STRING) AS k")
    bits, test = filter_of(keys, "k", 500)
    other = spark.range(20000).selectExpr("CAST(id AS STRING) AS v").select("v", bits.alias("f"))
    passed = {int(r.v) for r in other.where(test(F.col("f"), F.col("v"))).collect()}
    assert set(range(0, 3500, 7)) <= passed and len(passed) < 500 + 0.02 * 20000


def test_match_contains_prefers_close_length(spark, rows):
    d = spark.createDataFrame([(1, "north"), (2, "north yard"), (3, "north yard two"), (4, "abc")], "id long, n string")
    k = spark.createDataFrame([("north yard tw",), ("orth",), ("abcd",), ("zzz",)], "k string")
    assert rows(rs.match_contains(k, "k", d, "id", "n"), "k", "id") == [("north yard tw", 3), ("orth", 1)]


def greedy(missing, extra, score):
    """Best-first one-to-one assignment of rows."""
    tie = lambda a, b: hashlib.md5(f"{a}\x01{b}".encode()).hexdigest()
    pairs = sorted((s, tie(mn, en), mn, en, m, e) for m, mn in missing for e, en in extra if (s := score(mn, en)) is not None)
    used, out = set(), []
    for *_, m, e in pairs:
        if ("m", m) not in used and ("e", e) not in used:
            used |= {("m", m), ("e", e)}
            out.append((m, e))
    return out


def test_pair_fuzzy_equals_best_first(spark):
    rng = random.Random(4)
    words = ["red plate bay", "red plato bay", "red plate bays", "old rod line 7", "old rod line 8", "olde rod line 8", "hot"]
    data = [(i, "S", "Employee", rng.choice(["Missing", "Extra"]), rng.choice(words)) for i in range(60)]
    df = spark.createDataFrame(data, "finding_id long, station string, category string, issue string, name string")
    got = sorted((r.missing_id, r.extra_id) for r in rc.pair_fuzzy(df, 0.88).collect())
    side = lambda kind: [(d[0], d[4]) for d in data if d[3] == kind and len(d[4]) >= 4]
    want = greedy(side("Missing"), side("Extra"), lambda a, b: 1 - sim(a, b) if sim(a, b) >= 0.88 else None)
    assert got == sorted(want)
    assert len({m for m, _ in got}) == len(got) == len({e for _, e in got})


@pytest.mark.parametrize("threshold", [0.75, 0.88])
def test_ratio_pairs_are_complete(sides, threshold):
    from difflib import SequenceMatcher

    a, b, da, db = sides
    got = {(r.g, r.a_name, r.b_name) for r in ratio_pairs(da, "x", db, "y", ["g"], threshold).collect()}
    want = {(g, x, y) for (g, x), (h, y) in itertools.product(a, b) if g == h and SequenceMatcher(None, x, y).ratio() >= threshold}
    assert got == want


def test_suggest_place_moves_equals_best_first(spark):
    rng = random.Random(9)
    names = ["Alpha", "Alpha North", "Alpha North Yard", "Beta", "Beta 2", "Gamma", "1. Gamma"]
    data = [(i, rng.choice(names), "Switchyard", rng.choice(["Missing", "Extra"]), "x") for i in range(40)]
    df = spark.createDataFrame(data, "finding_id long, station string, category string, issue string, name string")
    got = rc.suggest_place_moves(df, "Switchyard").collect()
    key = lambda s: s.split(". ")[-1].lower()
    side = lambda kind: [(d[0], key(d[1])) for d in data if d[3] == kind]
    overlap = lambda a, b: float(abs(len(a) - len(b))) if a in b or b in a else None
    want = dict(greedy(side("Missing"), side("Extra"), overlap))
    assert {r.missing_id: r.extra_id for r in got} == {m: want.get(m) for m, _ in side("Missing")}


def test_equal_scores_take_few_rounds(spark, monkeypatch):
    """Rounds do not grow with the number of equally good names."""
    calls = []
    real = pairing.durable
    monkeypatch.setattr(pairing, "durable", lambda df: calls.append(1) or real(df))
    n = 150
    edges = spark.sql(f"SELECT 1L AS _b, 'a' || x.id AS a_name, 'b' || y.id AS b_name, 0.0D AS score FROM range({n}) x, range({n}) y")
    names = lambda side: spark.sql(f"SELECT 1L AS _b, '{side}' || id AS name, 1L AS n FROM range({n})")
    got = pairing.assign_names(edges, ["_b"], names("a"), names("b")).collect()
    assert len(got) == len({r["a_name"] for r in got}) == len({r["b_name"] for r in got}) == n
    assert (len(calls) - 1) / 2 <= 15


def test_pair_artifacts_one_partner_each(spark, rows):
    data = [
        (1, "Beta", "Control Room", "Missing", "Main - Room"), (2, "Beta", "Control Room", "Extra", "MAIN room"),
        (3, "Beta", "Control Room", "Extra", "main room"), (4, "Beta", "Control Room", "Missing", "Control Room"),
        (5, "Beta", "Control Room", "Extra", "2. Beta"), (6, "Beta", "Switchyard", "Missing", "Control Room"),
        (7, "Beta", "Employee", "Missing", "A"), (8, "Beta", "Employee", "Extra", "a"),
    ]
    df = spark.createDataFrame(data, "finding_id long, station string, category string, issue string, name string")
    assert rows(rc.pair_artifacts(df)) == [(1, 2, "equal label"), (4, 5, "generic label")]


def test_pairs_of_a_dense_block_are_compared_in_cells(spark, monkeypatch):
    """By either score, whichever way a block goes, the pairs are those of a loop; names that share their pieces go through cells."""
    from rosterloom.functions import similar

    a = [(g, f"hot bolt {i:03x} bay {i % 7}") for g in ("x", "y") for i in range(0, 300, 3)] + [(None, "hot bolt 001 bay 1")]
    b = [(g, f"hat bolt {i:03x} bay {i % 5}") for g in ("x", "z", "y") for i in range(0, 300, 5)] + [(None, "hot bolt 001 bay 1")]
    da, db = spark.createDataFrame(a, "g string, x string"), spark.createDataFrame(b, "g string, y string")
    kept = similar._scored
    for blocks in (False, True):
        score = (lambda p, q: SequenceMatcher(None, p, q).ratio()) if blocks else (lambda p, q: edit_similarities([p], [q])[0])
        want = sorted((g, p, q) for g, p in a for h, q in b if g is not None and g == h and score(p, q) >= 0.9)
        assert want
        for asked, meeting in ((10000, 100), (0, 100), (0, 0)):  # small, dense, told apart
            monkeypatch.setattr(similar, "ASKED", asked)
            monkeypatch.setattr(similar, "MEETING", meeting)
            sent = []
            monkeypatch.setattr(similar, "_scored", lambda na, *rest: sent.append(na.count()) or kept(na, *rest))
            got = sorted((r.g, r.a_name, r.b_name) for r in similar.similar_pairs(da, "x", db, "y", ["g"], 0.9, blocks).collect())
            assert got == want and sum(sent) == (200 if meeting == 0 else 0)


def test_common_signs_rule_out_no_pair():
    """No pair at the threshold is left out before its ratio, and few others get one."""
    from rosterloom.functions.similar import ratios, ratios_from

    a = [f"large ring {i % 251:03x} bay {i % 19}" for i in range(3000)] + ["", "x" * 64, "y" * 65, "é" * 3]
    b = [f"larga rong {i * 7 % 251:03x} bay {i % 17}" for i in range(3000)] + ["", "x" * 63, "y" * 70, "é" * 3]
    all_, some = ratios(a, b), ratios_from(a, b, 0.85)
    assert ((all_ >= 0.85) == (some >= 0.85)).all() and (all_ >= 0.85).sum() > 10
    assert (some[all_ >= 0.85] == all_[all_ >= 0.85]).all() and (some > 0).sum() < 0.2 * len(a)


def broadcasts(df):
    """How many sides the plan that ran sends to all tasks through the driver."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_containment_sends_no_names_through_the_driver(spark, rows):
    """the estimated size of names and their runs does not follow their number, so none is broadcast."""
    keys = spark.createDataFrame([(f"unit {i}",) for i in range(0, 3000, 7)], "key string")
    names = spark.createDataFrame([(i, f"unit {i}") for i in range(300)], "org_id long, org_name string")
    best = rs.match_contains(keys, "key", names, "org_id", "org_name")
    assert broadcasts(best) == 0

    def closest(key):
        found = [(abs(len(key) - len(f"unit {i}")), i) for i in range(300) if f"unit {i}" in key or key in f"unit {i}"]
        return min(found, default=None)

    want = sorted((f"unit {i}", c[1], f"unit {c[1]}", c[0]) for i in range(0, 3000, 7) if (c := closest(f"unit {i}")))
    assert rows(best, "key", "org_id", "name", "gap") == sorted(want, key=lambda r: tuple((v is not None, str(v)) for v in r))


def test_similar_names_are_not_sent_through_the_driver(spark, monkeypatch):
    """of what is joined for the best partners, only sizes of blocks are broadcast, never names."""
    plans, durable = [], similar.durable
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(similar, "durable", lambda df: plans.append(plan(df)) or durable(df))
    left = spark.range(200).selectExpr("id AS a_id", "id % 3 AS g", "'Cust' || lpad(id, 5, '0') AS name")
    right = spark.range(0, 400, 3).selectExpr("id AS b_id", "id % 3 AS g", "'cusd' || lpad(id, 5, '0') AS name")
    for blocks, threshold in ((False, 0.82), (True, 0.8)):
        found = rs.fuzzy_candidates(left, "a_id", right, "b_id", "name", "g", threshold, blocks)
        assert found.count() > 20
        plans.append(plan(found))
    joined = [keys for text in plans for keys in re.findall(r"BroadcastHashJoin \[([^\]]*)\]", text)]
    assert all(re.fullmatch(r"g#\d+L", keys) for keys in joined)
    assert not any("NestedLoop" in text or "BuildLeft" in text for text in plans)


@pytest.mark.parametrize("blocks", [False, True])
@pytest.mark.parametrize("tree, asking, front, looks", [(262144, 32768, 1 << 20, 4096), (40, 30, 25, 4096), (40, 30, 400, 30)])
def test_trees_find_the_best(spark, monkeypatch, blocks, tree, asking, front, looks):
    """Names in trees and groups of any size, walked in any portion, and those that look at too much: as by comparing all."""
    for name, value in (("TREE", tree), ("ASKING", asking), ("FRONT", front), ("LOOKS", looks), ("FEW", 100)):
        monkeypatch.setattr(similar, name, value)
    rng = random.Random(5)
    right = {f"unit {rng.randrange(300):06d}" for _ in range(150)} | {"a", "ab", "ba", "日本語😀", "日本", "z" * 31, "z" * 36, "x" * 300, "unit"}
    left = {f"unit {rng.randrange(300):05d}" for _ in range(60)} | {f"nuit {rng.randrange(300):06d}" for _ in range(60)}
    left |= {"b", "abc", "日本😀", "z" * 32, "z" * 33, "x" * 299, "uint", *list(right)[:10]}
    # with and without a block, whose null meets nothing
    da = spark.createDataFrame([(g, n) for n in sorted(left) for g in (1, 2, None)], "g int, x string")
    db = spark.createDataFrame([(g, n) for n in sorted(right) for g in (1, None)], "g int, y string")
    score = (lambda x, y: SequenceMatcher(None, x, y).ratio()) if blocks else sim
    for threshold in (0.7, 0.9):
        want = {}
        for x in left:
            best = min(((-score(x, y), y) for y in right if abs(len(x) - len(y)) <= 40 and score(x, y) >= threshold), default=None)
            if best:
                want[(1, x)] = (best[1], -best[0])
        got = {(r.g, r.a_name): (r.b_name, r.similarity) for r in nearest(da, "x", db, "y", ["g"], threshold, blocks).collect()}
        assert got == want and want


@pytest.mark.parametrize("blocks", [False, True])
def test_names_of_a_dense_block_are_not_compared_with_all(spark, monkeypatch, blocks):
    """names that all begin alike look at few others, so none is left for the cells, whose time is the square of a block."""
    cells = []
    monkeypatch.setattr(similar, "_nearest_in_cells", lambda *args: cells.append(args))
    names = [f"customer#{i:09d}" for i in range(0, 9000, 3)]
    left = [n.replace("0", "o") if i % 3 == 0 else n.replace("tomer", "tmoer") if i % 3 == 1 else n[1:] for i, n in enumerate(names)]
    da = spark.createDataFrame([(1, n) for n in left], "g int, x string")
    db = spark.createDataFrame([(1, n) for n in names], "g int, y string")
    got = {r.a_name: (r.b_name, r.similarity) for r in nearest(da, "x", db, "y", ["g"], 0.9 if blocks else 0.82, blocks).collect()}
    assert not cells
    length = len(names[0])
    near = {x: y for i, (x, y) in enumerate(zip(left, names)) if i % 3}
    whole = [2 * (length - 1) / (2 * length), 2 * (length - 1) / (2 * length - 1)] if blocks else [1 - 2 / length, 1 - 1 / length]
    assert got == {x: (y, whole[len(x) < length]) for x, y in near.items()}
