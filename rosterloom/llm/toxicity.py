"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document's features are its words, pairs of neighbouring words and pairs of words one apart,
hashed to ``1 << BITS`` places; each counts once, however often it occurs.  FTRL-proximal gives
every place its own learning rate, and its L1 term keeps a weight at exactly zero until there is
evidence, so the model is a short list of places and weights that travels with the scoring
tasks.  Scoring sums the weights of the features present.

Words are runs of letters, digits and bytes above 127, lower-cased (A-Z), as bytes.

Defined cases: a null text is an empty one; an empty text has the score of the bias alone; very long
texts are scored whole, and are not learned from above ``labelled.SAMPLE_BYTES``; rows that repeat an id, or have none, have a
result each, and ids do not matter to a score; an empty table gives no rows; a corpus without labels gives 0.5; further
columns are kept out of the result.
"""

from __future__ import annotations

import pickle

import numpy as np
from pyspark.sql import DataFrame

from rosterloom.llm.common import by_value, table
from rosterloom.llm.labelled import fitted, kept_documents, sample, scored

by_value(__name__)

SAMPLE = 16_000  # labelled documents learned from, at most
BITS = 22
EPOCHS = 12
ALPHA, BETA, L1, L2 = 6.0, 1.0, 4.0, 0.0
REJECT = 0.5


def word_table() -> bytes:
    """Byte to byte: lower case for words, a space for all else."""
    keep = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
    return bytes((b + 32 if 0x41 <= b <= 0x5A else b if b in keep else 0x20) for b in range(256))


def features(text: str, words: bytes = word_table()):
    """Places of the features present, each once."""
    import numpy as np
    import xxhash

    found = text.encode("utf-8", "surrogatepass").translate(words).split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), dtype=np.uint64, count=len(found))
    with np.errstate(over="ignore"):
        one, two = h * np.uint64(0x9E3779B97F4A7C15), h * np.uint64(0xC2B2AE3D27D4EB4F)
        pairs, skips = (one[:-1] ^ (two[1:] >> np.uint64(1))) * np.uint64(0xFF51AFD7ED558CCD), (one[:-2] + two[2:]) * np.uint64(0xC4CEB9FE1A85EC53)
    return (np.concatenate([one, pairs, skips]) >> np.uint64(64 - BITS)).astype(np.int64)


def fit(texts: list[str], labels: list[int], epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> bytes:
    """(bias, places, weights) after ``epochs`` passes in the given order; the bias is not regularised."""
    import pickle

    import numpy as np

    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias = [0.0, 0.0]
    known = [np.unique(features(t)).astype(np.int32) for t in texts]
    for _ in range(epochs):
        for at, y in zip(known, labels):
            za, na = z[at], n[at]
            w = np.where(np.abs(za) > l1, (np.sign(za) * l1 - za) / ((beta + np.sqrt(na)) / alpha + l2), 0.0)
            b = -bias[0] * alpha / (beta + bias[1] ** 0.5)
            p = 1 / (1 + np.exp(-min(max(w.sum() + b, -35.0), 35.0)))
            g = p - y
            root = np.sqrt(na + g * g)
            z[at] = za + g - (root - np.sqrt(na)) / alpha * w
            n[at] = na + g * g
            root = (bias[1] + g * g) ** 0.5
            bias[0] += g - (root - bias[1] ** 0.5) / alpha * b
            bias[1] += g * g
    live = np.flatnonzero(np.abs(z) > l1)
    weights = (np.sign(z[live]) * l1 - z[live]) / ((beta + np.sqrt(n[live])) / alpha + l2)
    return pickle.dumps((-bias[0] * alpha / (beta + bias[1] ** 0.5), live.astype(np.int32), weights.astype(np.float32)))


def scorer(model: tuple):
    """Function from texts to probabilities.  The weights are spread over all places once per task."""
    bias, places, weights = model
    spread: list = []

    def score(texts: list[str]) -> list[float]:
        import numpy as np

        if not spread:
            spread.append(np.zeros(1 << BITS, dtype=np.float32))
            spread[0][places] = weights
        out = []
        for t in texts:
            at = features(t)
            at = np.unique(at[spread[0][at] != 0])
            out.append(float(1 / (1 + np.exp(-np.clip(bias + spread[0][at].sum(dtype=np.float64), -500, 500)))))
        return out

    return score


def toxicity_scorer(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", rows: int = SAMPLE):
    return scorer(pickle.loads(fitted(sample(docs, labels, label_col, rows), fit)))


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = REJECT) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    return scored(docs, toxicity_scorer(docs, labels), threshold)


def clean_documents(docs: DataFrame, labels: DataFrame, threshold: float = REJECT) -> DataFrame:
    """The documents that are not rejected as toxic."""
    return kept_documents(docs, toxicity_scorer(docs, labels), lambda p: p < threshold)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
