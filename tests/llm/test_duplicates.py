import os
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from conftest_llm import prose, texts_of
from pyspark.sql import functions as F

from rosterloom.llm import itq, minhash, simhash
from rosterloom.llm.common import forget, landed
from rosterloom.llm.components import components
from rosterloom.llm.minhash import BATCH, least_matches


def shingles(text, width=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return frozenset([tuple(w)] if 0 < len(w) < width else zip(*[w[i:] for i in range(width)]))


def brute_components(texts, percent=85):
    """(n_shingles, smallest id reachable) per row."""
    sets = [(i, shingles(t)) for i, t in texts]
    parent = list(range(len(sets)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(sets)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            parent[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    return Counter((i, len(s), i if not s else least.get(top(k))) for k, (i, s) in enumerate(sets))


def found(df):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect())


def edited(text, *places):
    w = text.split()
    for p in places:
        w[p % len(w)] = f"edit{p}"
    return " ".join(w)


def test_minhash_odd_rows(odd, empty):
    got = minhash.near_duplicates(odd)
    assert found(got) == brute_components(texts_of(odd))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.collect())
    assert minhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("block, miss", [(512, 1e-6), (8, 1e-6)])
def test_minhash_against_brute_force(spark, monkeypatch, block, miss):
    """Chains, a group around the threshold, copies and strangers; also when buckets are cut into small blocks."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    texts, base = [], prose(77, 120)
    for i in range(40):  # each near to the base, not all to each other
        texts.append(edited(base, *range(i, i + 3)))
    chain = prose(78, 150)
    for i in range(12):  # only neighbours are near
        texts.append(chain)
        chain = edited(chain, 13 * i, 13 * i + 6)
    texts += [prose(79, 200)] * 9 + [prose(100 + i, 60) for i in range(30)]
    short = [f"w{i} w{i + 1} w{i + 2} w{i + 3}" for i in range(8)]
    docs = spark.createDataFrame([(3 * i, t) for i, t in enumerate(texts + short)], "doc_id bigint, text string").repartition(4)
    assert found(minhash.near_duplicates(docs, miss=miss)) == brute_components(texts_of(docs))


def test_rows_without_ids_join_once(spark):
    """Classes whose first row has no id are looked up by text as well, so such rows do not all meet each other."""
    rows = [(None if i % 4 else 5, prose(i // 2, 30) + (" more" if i % 2 else "")) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    signed = minhash.shingled(docs, 3, "doc_id", "text").where("cls IS NOT NULL")
    wanted = signed.groupBy("cls").agg(F.min(F.struct("id", "text_hash")).alias("pick"))
    texts = docs.select(F.col("doc_id").alias("id"), "text").withColumn("text_hash", F.xxhash64("text"))
    met = texts.join(wanted, texts["id"].eqNullSafe(wanted["pick.id"]) & (texts["text_hash"] == wanted["pick.text_hash"]))
    assert met.count() <= 2 * len(rows)
    assert minhash.full_sets(docs, wanted, 3, "doc_id", "text").count() == wanted.count() == 600
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(rows) and {r["component_id"] for r in got} == {None, 5}


def test_least_matches_bound_the_miss():
    """The dropping bound is the largest m whose posterior tail is below the miss probability."""
    t, miss = 0.85, 1e-6
    rng = np.random.default_rng(1)
    needed = least_matches(t, 144, miss)
    assert len(needed) == 144 // BATCH and needed == sorted(needed)
    for n, m in zip(range(BATCH, 145, BATCH), needed):
        assert m == 0 or (rng.binomial(n + 1, t, 200_000) < m).mean() < 1e-4
        assert m / n < t


def test_banding():
    for t in (0.5, 0.8, 0.85, 0.95):
        bands, rows = minhash.banding(t)
        assert bands * rows <= minhash.PLACES and (1 - t**rows) ** bands <= minhash.BAND_MISS
    assert minhash.banding(0.85) == (24, 6) and minhash.banding(0.8) == (28, 5)


@pytest.mark.parametrize("width, percent", [(5, 80), (2, 60)])
def test_other_widths_and_thresholds(spark, width, percent):
    base = prose(31, 150)
    texts = [edited(base, *range(0, 7 * (i % 9), 7)) for i in range(27)] + [prose(200 + i, 90) for i in range(10)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, width, percent).collect()}
    sets = [shingles(t, width) for t in texts]
    label = list(range(len(texts)))
    for a, b in combinations(range(len(texts)), 2):
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            low, high = sorted((label[a], label[b]))
            label = [low if x == high else x for x in label]
    assert [got[i] for i in range(len(texts))] == label


def test_one_of_each(odd, empty):
    kept = minhash.one_of_each(odd)
    assert kept.schema == odd.schema and minhash.one_of_each(empty).count() == 0
    ids = Counter(i for i, _ in texts_of(kept))
    assert 7 not in ids and ids[6] >= 1 and ids[0] == ids[1] == ids[None] == 1


@pytest.mark.parametrize("parts", [1, 5])
def test_one_of_each_decides_per_row(spark, parts):
    """Repeated rows, copies without an id, and an id that a near copy shares with a clean text."""
    a, b, c, d, e = (prose(300 + i, 120) for i in range(5))
    rows = [(3, a, 0), (7, edited(a, 4), 1), (7, b, 2)]
    rows += [(9, c, 3)] * 4 + [(None, d, 4)] * 3 + [(None, e, 5), (12, edited(e, 60), 6), (12, e, 7)]
    rows += [(None, None, 8), (None, None, 8), (20, "", 9), (20, "", 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _row int").repartition(parts)
    kept = minhash.one_of_each(docs)
    assert kept.schema == docs.schema
    got = Counter(map(tuple, kept.collect()))
    one = [r for r in got if r[0] == 12]
    assert len(one) == 1 and one[0] in [(12, edited(e, 60), 6), (12, e, 7)]
    assert got == Counter([(3, a, 0), (7, b, 2), (9, c, 3), (None, d, 4), one[0], (None, None, 8), (None, None, 8), (20, "", 9), (20, "", 9)])


def test_components(spark):
    long = [(i, i + 1) for i in range(0, 300, 2)] + [(i, i + 1) for i in range(1, 200, 2)]
    hub = [(1000, 1001 + i) for i in range(200)]
    links = spark.createDataFrame([*long, *hub, (5, 5), (None, 7), (7, None)], "a bigint, b bigint")
    got = dict(components(links).collect())
    assert all(got[i] == 0 for i in range(201)) and all(got[i] == i - i % 2 for i in range(202, 300))
    assert all(got[i] == 1000 for i in range(1000, 1201)) and len(got) == 302 + 201 - 2 + (1 if 301 in got else 0) - (0 if 301 in got else 0)
    assert components(links.limit(0)).count() == 0


def test_forget_removes_landed_copies_alone(spark, tmp_path):
    kept = spark.range(5)
    kept.write.parquet(f"{tmp_path}/own")
    own, made = spark.read.parquet(f"{tmp_path}/own"), landed(spark.range(7), "forget-test")
    assert made.count() == 7
    folder = made.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:").replace("//", "/")
    assert os.path.isdir(folder)
    forget(made)
    forget(own)
    assert not os.path.isdir(folder) and own.count() == 5


def vectors(seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(60, 24))
    rows = [list(map(float, v)) for v in base]
    for k in range(40):  # a dense group and pairs at various angles
        rows.append(list(map(float, base[0] + 0.05 * rng.normal(size=24))))
        rows.append(list(map(float, base[k] + (0.02 + 0.008 * k) * rng.normal(size=24))))
    rows += [rows[3], rows[3], [2 * x for x in rows[4]], [0.0] * 24, [], None, [1.0, None] + [0.0] * 22, [float("nan")] + [1.0] * 23, [float("inf")] + [1.0] * 23, rows[5][:12]]
    return rows


@pytest.mark.parametrize("block", [1024, 8])
def test_embeddings_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(itq, "BLOCK", block)
    rows = vectors()
    df = spark.createDataFrame([(i, v, 0, "x", 1) for i, v in enumerate(rows)], "vec_id bigint, embedding array<float>, label int, code string, n_links bigint").repartition(3)
    got = {r["vec_id"]: r for r in itq.near_vectors(df).collect()}
    x = np.zeros((len(rows), 24))
    fine = [v is not None and len(v) > 0 and None not in v and bool(np.isfinite(v).all()) and any(v) for v in rows]
    for i, v in enumerate(rows):
        if fine[i]:
            x[i, : len(v)] = np.array(v, dtype=np.float32)
            x[i] /= np.linalg.norm(x[i])
    near = (x @ x.T >= 0.95) & np.array(fine)[:, None]
    np.fill_diagonal(near, False)
    want = near.sum()
    assert len(got) == len(rows) and all(r["n_links"] <= near[i].sum() for i, r in got.items())
    assert sum(r["n_links"] for r in got.values()) >= 0.9 * want
    for i, r in got.items():
        assert r["kept"] == (r["component_id"] == i) and (fine[i] or (r["n_links"], r["component_id"]) == (0, i))
        if r["n_links"] == near[i].sum():
            assert all(got[j]["component_id"] == r["component_id"] for j in np.flatnonzero(near[i]) if got[j]["n_links"] == near[j].sum())
    assert itq.near_vectors(df.limit(0)).count() == 0


def test_embeddings_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.orderBy("vec_id").collect()
    x = np.array([r["embedding"] for r in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.95).sum(axis=1) - 1
    got = [r["n_links"] for r in itq.near_vectors(df).orderBy("vec_id").collect()]
    assert all(g <= n for g, n in zip(got, near)) and sum(got) >= 0.9 * near.sum()


@pytest.mark.parametrize("mean", [0.0, 0.7, 0.9])
def test_embeddings_recall_with_a_common_direction(spark, mean):
    """Pairs just above the threshold, around a mean of this length."""
    rng = np.random.default_rng(8)
    away = rng.normal(size=(600, 48))
    away[:, 0] = 0
    x = np.sqrt(1 - mean * mean) * away / np.linalg.norm(away, axis=1, keepdims=True)
    x[:, 0] = mean
    pairs = [itq.partners_at(x, c, 21) for c in (0.952, 0.96, 0.97)]
    rows = np.concatenate([x, *pairs])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id bigint, embedding array<double>").repartition(4)
    near = (rows @ rows.T >= 0.95).sum(axis=1) - 1
    got = [r["n_links"] for r in itq.near_vectors(df).orderBy("vec_id").collect()]
    assert all(g <= n for g, n in zip(got, near)) and sum(got) >= 0.9 * near.sum() > 0


def test_wide_vectors_are_learned_from_fewer_rows(spark, monkeypatch):
    monkeypatch.setattr(itq, "SAMPLE_NUMBERS", 24 * 30)
    seen, learn = [], itq.tables_for
    monkeypatch.setattr(itq, "tables_for", lambda x, *a: (seen.append(x.shape), learn(x, *a))[1])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors())], "vec_id bigint, embedding array<float>")
    assert itq.near_vectors(df).count() == len(vectors()) and seen == [(30, 24)]


def test_simhash_odd_rows(odd, empty):
    import hashlib

    got = simhash.fingerprint_documents(odd).collect()
    texts = texts_of(odd)
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in texts)
    by_text = {}
    for r in got:
        n = [t for i, t in texts if i == r["doc_id"] and len(t) == r["n_chars"]]
        assert n
        by_text.setdefault(n[0], set()).add(r["fingerprint"])
    assert all(len(f) == 1 for f in by_text.values())
    assert by_text[""] == by_text[" \n\t "] == {"0" * 16}
    unique = [i for i, c in Counter(i for i, _ in texts).items() if c == 1 and i is not None and i + 1 < 12 and i not in (5, 6)]
    text = dict(texts)
    for r in got:
        if r["doc_id"] in unique:
            t, after = text[r["doc_id"]], text[r["doc_id"] + 1]
            q = len(t) // 4
            assert r["edited_sha256"] == hashlib.sha256((t[: len(t) - q] + after[:q]).encode()).hexdigest()
    assert simhash.fingerprint_documents(empty).count() == 0


def test_simhash_votes_by_hand(spark):
    """The packed sums give the same signs as 64 plain sums, also beyond one run of terms."""
    text = " ".join(f"w{i % 700}x{i % 13}" for i in range(40_000))
    df = spark.createDataFrame([(1, text), (2, "a bb cccc dddddddd"), (3, "")], "k int, t string")
    got = {r["k"]: r["fp"] & (2**64 - 1) for r in simhash.votes(df, ["k"], "t").select("k", simhash.signs().alias("fp")).collect()}
    terms = df.select("k", F.split("t", " ").alias("w")).select("k", "w", F.posexplode("w").alias("p", "a"))
    terms = terms.withColumn("b", F.get("w", F.col("p") + 1)).select("k", "a", F.xxhash64("a", "b").alias("h")).collect()
    for k in (1, 2, 3):
        total = np.zeros(64)
        for r in terms:
            if r["k"] == k and r["a"]:
                bits = np.array([(r["h"] >> i) & 1 for i in range(64)])
                total += (2 * bits - 1) * (3 if len(r["a"]) >= 8 else 2 if len(r["a"]) >= 4 else 1)
        assert got[k] == sum(1 << i for i in range(64) if total[i] > 0)


def by_hand(spark, text):
    """The fingerprint of a text by 64 plain sums."""
    words, total = text.split(" "), np.zeros(64)
    terms = Counter(zip(words, [*words[1:], None]))
    df = spark.createDataFrame([(a, b, n) for (a, b), n in terms.items()], "a string, b string, n int")
    for r in df.select("a", "n", F.xxhash64("a", "b").alias("h")).collect():
        bits = np.array([(r["h"] >> i) & 1 for i in range(64)])
        total += r["n"] * (2 * bits - 1) * (3 if len(r["a"]) >= 8 else 2 if len(r["a"]) >= 4 else 1)
    return f"{sum(1 << i for i in range(64) if total[i] > 0):016x}"


@pytest.mark.parametrize("words, copies", [(["elephant"] * 40_000, 1), (["bear"] * 40_000, 1), (["elephant", "crocodile"] * 1_500, 40)])
def test_simhash_repetitive(spark, words, copies):
    """A run of equal terms and rows that repeat id and text do not outgrow the packed sums."""
    text = " ".join(words)
    df = spark.createDataFrame([(5, text)] * copies, "doc_id bigint, text string")
    got = simhash.fingerprint_documents(df).collect()
    assert len(got) == copies and {r["fingerprint"] for r in got} == {by_hand(spark, text)}


@pytest.mark.parametrize("radius, blocks", [(3, 6), (2, 4), (5, 8)])
def test_block_tables_find_all(spark, radius, blocks):
    rng = np.random.default_rng(2)
    prints = {int(x) for x in rng.integers(-(2**63), 2**63 - 1, 60)}
    for x in list(prints)[:30]:
        for n in range(1, radius + 3):
            y = x & (2**64 - 1)
            for b in rng.choice(64, n, replace=False):
                y ^= 1 << int(b)
            prints.add(y - 2**64 if y >= 2**63 else y)
    df = spark.createDataFrame([(x,) for x in prints], "fp bigint")
    got = {(r["q"], r["f"]): r["distance"] for r in simhash.within_radius(df, df, radius, blocks).collect()}
    want = {(a, b): ((a ^ b) & (2**64 - 1)).bit_count() for a in prints for b in prints}
    assert got == {k: d for k, d in want.items() if d <= radius}
    assert simhash.within_radius(df, df, radius, blocks).count() == len(got)


def test_the_sample_of_vectors_is_a_matrix_at_once():
    """No Python object for each number: the driver holds the matrix and little else."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from rosterloom.llm import itq

    rng = np.random.default_rng(1)
    rows = [rng.normal(size=rng.integers(1, 64)).tolist() for _ in range(3000)] + [[3.0, 4.0]]
    column = pa.chunked_array([pa.array(rows[:1000], pa.list_(pa.float64())), pa.array(rows[1000:], pa.list_(pa.float64()))])
    want = itq.unit_vectors(rows, 64)
    tracemalloc.start()
    got = itq.unit_matrix(column, 64)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(got, want) and peak < 4 * got.nbytes
