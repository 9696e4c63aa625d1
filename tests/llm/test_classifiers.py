import pickle
import zlib

import numpy as np
import pytest
from conftest_llm import prose, texts_of

from rosterloom.llm import labelled, licenses, quality, toxicity
from rosterloom.llm.common import table

SF = "/root/testdata/sf0.1"


def area(score, y):
    rank = np.empty(len(score))
    rank[np.argsort(score, kind="stable")] = np.arange(1, len(score) + 1)
    good = y.sum()
    return (rank[y == 1].sum() - good * (good + 1) / 2) / good / (len(y) - good)


@pytest.mark.parametrize("module, label, least", [(quality, "quality", 0.97), (toxicity, "toxic", 0.97)])
def test_held_out_accuracy(spark, module, label, least):
    score = quality.quality_scores if module is quality else toxicity.toxicity_scores
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = score(docs, labels).where("held_out").join(labels, "doc_id").toPandas()
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]) and got["score"].between(0, 1).all()
    assert area(got["score"].to_numpy(), got[label].to_numpy()) > least


@pytest.mark.parametrize("score", [quality.quality_scores, toxicity.toxicity_scores])
def test_odd_rows(spark, odd, empty, labels, score):
    got = score(odd, labels).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in texts_of(odd))
    assert all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert score(empty, labels).count() == 0
    assert {r["score"] for r in score(odd, labels.limit(0)).collect()} <= {0.5}


def test_filters_keep_rows_whole(odd, labels):
    kept = quality.good_documents(odd, labels, threshold=0.0)
    assert kept.schema == odd.schema and sorted(map(str, kept.collect())) == sorted(map(str, odd.collect()))
    assert toxicity.clean_documents(odd, labels, threshold=0.0).count() == 0


def test_quality_scores_each_text_alone():
    texts = [prose(i, 20 + 37 * i) for i in range(12)] + ["", "a", "a a a a a a a a " * 40, "x | y | " * 50]
    net = pickle.loads(quality.fit(texts, [1] * 12 + [0] * 4, epochs=2))
    together = quality.forward(texts, net)
    alone = [quality.forward([t], net)[0] for t in texts]
    assert np.allclose(together, alone, atol=1e-5)


def test_quality_covers_the_whole_document():
    """Junk at the far end of a long text lowers its score."""
    good = [prose(i, 150) for i in range(60)]
    bad = [prose(i, 100) + " %%% &&&" * 60 for i in range(60)]
    net = pickle.loads(quality.fit(good + bad, [1] * 60 + [0] * 60, epochs=8))
    clean, late = prose(901, 4000), prose(902, 4000) + " %%% &&&" * 60
    scores = quality.forward([clean, late], net)
    assert scores[0] > 0.5 > scores[1]


def test_quality_gradients():
    texts, y = [prose(1, 60), "q q q q q q q q " * 9, ""], np.array([1, 0, 1], dtype=np.float32)
    net = {k: v.astype(np.float64) for k, v in pickle.loads(quality.fit(texts, [1, 0, 1], epochs=1)).items()}

    def loss(n):
        p = np.array(quality.forward(texts, n))
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    g, rng = quality.gradients(texts, y, net), np.random.default_rng(0)
    for name in ("first", "second", "bias", "out", "vectors"):
        flat = g[name].ravel()
        for at in [*rng.choice(len(flat), 4), int(np.abs(flat).argmax())]:
            moved = []
            for step in (1e-4, -1e-4):
                n = {k: v.copy() for k, v in net.items()}
                n[name].ravel()[at] += step
                moved.append(loss(n))
            assert abs((moved[0] - moved[1]) / 2e-4 - flat[at]) < 2e-3


def test_toxic_words_and_sparsity():
    texts = [prose(i, 40) + (" vile brute" if i % 3 == 0 else "") for i in range(200)]
    model = pickle.loads(toxicity.fit(texts, [int(i % 3 == 0) for i in range(200)]))
    score = toxicity.scorer(model)
    assert len(model[1]) < 2000
    low, high, empty = score([prose(999, 3000), prose(998, 3000) + " VILE BRUTE " + prose(997, 100), ""])
    assert low < 0.5 < high and empty < 0.5


def test_licenses_against_brute_force(odd, empty, rows):
    got = {}
    for r in licenses.scan_licenses(odd).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for i, t in texts_of(odd):
        words = licenses.words_of(t)
        places = [(k, label) for phrase, label in licenses.PHRASES for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.encode().split()]
        starts = [k for k, _ in places]
        base = ",".join(sorted({label for _, label in places}))
        want = (len(words), len(places), min(starts, default=None), max(starts, default=None), base)
        assert want in [(r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got[i]]
    assert got[11][0]["labels"] == "apache,apache-2.0,gpl,gpl-3,mit" and got[11][0]["score"] == 1.0
    assert got[0][0]["score"] == 0.0 and got[0][0]["labels"] == ""
    assert licenses.scan_licenses(empty).count() == 0


def test_license_templates_in_long_files(spark):
    """A held template tolerates a changed word; without its mandatory phrase it does not hold."""
    text = {label: passage for label, passage, _ in reversed(licenses.TEMPLATES)}
    changed = text["bsd"].replace("conditions", "terms")
    broken = text["bsd"].replace("source and binary", "object")
    rows = [(1, prose(1, 700) + " " + changed + " " + prose(2, 300)), (2, prose(3, 50) + " " + broken), (3, prose(4, 400)), (4, prose(5, 90) + " " + text["mit-text"])]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1]["labels"] == "bsd" and 0.8 < got[1]["score"] < 1
    assert got[2]["labels"] == got[3]["labels"] == "" and got[4]["labels"] == "mit-text" and got[4]["score"] == 1
    assert got[4]["base_labels"] == ""


def test_every_license_passage_is_known_by_itself(spark):
    """Each passage inside other words has its own label alone (and those of lines within it); BSD-3 is not BSD-2."""
    rows = [(i, f"{prose(i, 40)} {passage} {prose(i + 50, 40)}") for i, (_, passage, _) in enumerate(licenses.TEMPLATES)]
    text = {label: passage for label, passage, _ in licenses.TEMPLATES}
    third = text["bsd-2"].replace("THIS SOFTWARE", text["bsd-3"] + ". THIS SOFTWARE")
    rows += [(100, text["bsd"] + " " + text["bsd-2"]), (101, text["bsd"] + " " + third), (102, "x " * (3 << 20) + text["agpl-3"])]
    got = {r["doc_id"]: r["labels"].split(",") for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    own = {"apache", "gpl", "apache-2.0"}  # phrases and the line that a longer notice holds
    for i, (label, _, _) in enumerate(licenses.TEMPLATES):
        assert label in got[i] and set(got[i]) <= {label} | own, (label, got[i])
    assert "bsd-2" in got[100] and "bsd-3" not in got[100] and "bsd-3" in got[101] and "bsd-2" not in got[101] and got[102] == ["agpl-3"]


def test_sample_is_bounded(spark, monkeypatch):
    """Ids with many texts give one each; rows and bytes in all are bounded; no text goes through a shuffle but the chosen."""
    rows = [(i % 40, f"text {i} " * (1 + i % 7)) for i in range(2000)] + [(None, "no id"), (3, None), (5, "x" * (labelled.SAMPLE_BYTES + 1))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, 1), (None, 1), (4, None)], "doc_id bigint, toxic int")
    learned = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5]
    got = labelled.sample(docs, labels, "toxic", 1000).collect()
    assert sorted(r["id"] for r in got) == learned and all(r["y"] == (1 if r["id"] == 3 else r["id"] % 2) for r in got)
    assert labelled.sample(docs, labels, "toxic", 7).count() <= 7
    plan = labelled.sample(docs, labels, "toxic", 7)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    monkeypatch.setattr(labelled, "ALL_BYTES", 100)
    few = labelled.sample(docs, labels, "toxic", 1000).collect()
    assert 0 < len(few) < len(learned) and sum(len(r["text"]) for r in few) <= 100


def test_quality_of_long_texts_in_slices(monkeypatch):
    """Slices of any size give the same scores; a text of many slices, empty ones and its neighbours."""
    texts = ["", "a", prose(1, 40), prose(2, 9000), "é" * 3000, prose(3, 30), "x y " * 200000]
    net = pickle.loads(quality.fit([prose(i, 30 + i) for i in range(40)] + ["!! " * i for i in range(40)], [1] * 40 + [0] * 40, epochs=1))
    whole = quality.forward(texts, net)
    for size in (1, 64, 1 << 40):
        monkeypatch.setattr(quality, "SLICE", size)
        assert np.allclose(quality.forward(texts, net), whole, atol=1e-6)
    assert np.allclose([quality.forward([t], net)[0] for t in texts], whole, atol=1e-6)
