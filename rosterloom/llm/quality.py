"""Quality classifier: a byte-level convolutional network in numpy.

Every byte has a learned vector.  Learned filters, ``2 * BLOCK`` bytes wide, slide over the
document a block at a time; they also see how many words of the block begin a run of
``ECHO`` bytes that occurred before, near by or further up.  The filters' responses are averaged over
overlapping chunks of ``CHUNK`` blocks that cover the whole document, the averages are
max-pooled over the chunks, and one logistic unit combines them into a probability.

The network is fitted by gradient descent on a bounded sample of labelled texts, in one task;
its weights (a few thousand numbers) travel with the scoring tasks.

Defined cases: a null text is an empty one; an empty text has one chunk of one padded block; very long texts are scored
whole, a slice of blocks at a time, in about 15 bytes of memory per byte of text, and are not learned from; a
document is scored by itself, whatever it is batched with; rows that repeat an id, or have none, have a result
each, and ids do not matter to a score; an empty table gives no rows; an unlabelled corpus or one with a single label gives the constant rate of the sample
(0.5 without any); further columns are kept out of the result.
"""

from __future__ import annotations

import pickle

import numpy as np
from pyspark.sql import DataFrame

from rosterloom.llm.common import by_value, table
from rosterloom.llm.labelled import fitted, kept_documents, sample, scored

by_value(__name__)

SAMPLE = 3000  # labelled documents learned from, at most
EPOCHS = 6
RATE = 0.01
BLOCK = 8  # bytes
WIDTH = 8  # numbers per byte
FILTERS = 24
CHUNK = 32  # blocks; chunks begin every half of it
ECHO = 16  # bytes
NEAR = 64  # bytes
KEEP = 0.3
SLICE = 1 << 14  # blocks


def blocks_of(texts: list[str]):
    """(codes, echoes, first block and block count of each text).

    Codes are bytes, 256 for padding; each text is followed by two blocks of padding.
    """
    import numpy as np

    raws = [t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter(map(len, raws), dtype=np.int64, count=len(raws))
    counts = np.maximum(-(-sizes // BLOCK), 1)
    starts = np.concatenate([[0], np.cumsum(counts + ECHO // BLOCK)])
    total = int(starts[-1]) * BLOCK
    data = np.frombuffer(b"".join([r.ljust((int(c) + ECHO // BLOCK) * BLOCK, b"\0") for r, c in zip(raws, counts)]), dtype=np.uint8)
    del raws
    codes = data.astype(np.int16)
    for begin, size, end in zip((starts * BLOCK).tolist(), sizes.tolist(), (starts[1:] * BLOCK).tolist()):
        codes[begin + size : end] = 256

    space = (data <= 32) | (codes == 256)
    begins = np.flatnonzero(~space[1:] & space[:-1]) + 1
    if len(data) and not space[0]:
        begins = np.concatenate([[0], begins])
    ahead = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(ECHO, np.uint8)]), ECHO)[begins]
    halves = np.ascontiguousarray(ahead).view(np.uint64).reshape(-1, 2)
    with np.errstate(over="ignore"):
        mixed = (halves[:, 0] * np.uint64(0x9E3779B97F4A7C15)) ^ (halves[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F))
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + (np.searchsorted(starts * BLOCK, begins, side="right") - 1).astype(np.uint64)
    order = np.argsort(mixed, kind="stable")
    again = np.flatnonzero(mixed[order[1:]] == mixed[order[:-1]])
    later, earlier = begins[order[again + 1]], begins[order[again]]
    near = later - earlier <= NEAR
    echoes = np.zeros((total // BLOCK, 2), dtype=np.float32)
    np.add.at(echoes[:, 0], later[near] // BLOCK, 1)
    np.add.at(echoes[:, 1], later[~near] // BLOCK, 1)
    return codes.reshape(-1, BLOCK), echoes, starts[:-1], counts


def inputs_of(codes, echoes, vectors):
    import numpy as np

    return np.concatenate([vectors[codes].reshape(len(codes), -1), echoes], axis=1)


def responses(x, net):
    """Rectified filter responses of every block with the block after it."""
    import numpy as np

    both = x @ np.concatenate([net["first"], net["second"]], axis=1)
    y = both[:, :FILTERS] + net["bias"]
    y[:-1] += both[1:, FILTERS:]
    return np.maximum(y, 0, out=y)


def chunk_places(starts, counts):
    """(first chunk of each text, first block of each chunk, blocks of each chunk)."""
    import numpy as np

    half = CHUNK // 2
    n = np.maximum(-(-counts // half) - 1, 1)
    firsts = np.concatenate([[0], np.cumsum(n)])
    owner = np.repeat(np.arange(len(n)), n)
    at = (np.arange(firsts[-1]) - firsts[owner]) * half
    return firsts[:-1], starts[owner] + at, np.minimum(CHUNK, counts[owner] - at)


def chunk_averages(y, begin, length):
    import numpy as np

    sums = np.add.reduceat(y, np.stack([begin, begin + length], axis=1).ravel(), axis=0)[::2]
    return sums / length[:, None].astype(np.float32)


def chunks_of(y, starts, counts):
    """(chunk averages, first chunk of each text, first block of each chunk, blocks of each chunk)."""
    firsts, begin, length = chunk_places(starts, counts)
    return chunk_averages(y, begin, length), firsts, begin, length


def forward(texts: list[str], net):
    """Probability of each text.

    The responses are computed for ``SLICE`` blocks at a time, cut where chunks begin, and only the greatest average
    of each filter is kept, so a long text needs little more memory than its bytes.
    """
    import numpy as np

    if "rate" in net:
        return [net["rate"]] * len(texts)
    codes, echoes, starts, counts = blocks_of(texts)
    firsts, begin, length = chunk_places(starts, counts)
    owner = np.repeat(np.arange(len(starts)), np.diff(np.append(firsts, len(begin))))
    pooled = np.full((len(starts), FILTERS), -np.inf, dtype=np.float32)
    c = 0
    while c < len(begin):
        stop = max(c + 1, int(np.searchsorted(begin, begin[c] + SLICE)))
        low, high = begin[c], int((begin[c:stop] + length[c:stop]).max()) + 1  # a block sees the one after it
        y = responses(inputs_of(codes[low:high], echoes[low:high], net["vectors"]), net)
        averages = chunk_averages(y, begin[c:stop] - low, length[c:stop])
        own = owner[c:stop]
        here = slice(own[0], own[-1] + 1)  # every text has a chunk
        best = np.maximum.reduceat(averages, np.searchsorted(own, np.arange(own[0], own[-1] + 1)), axis=0)
        pooled[here] = np.maximum(pooled[here], best)
        c = stop
    return (1 / (1 + np.exp(-(pooled.astype(np.float64) @ net["out"].astype(np.float64) + net["level"])))).tolist()


def gradients(texts: list[str], y_true, net):
    """Gradients of the log loss; only the chunk that won the pooling passes any back."""
    import numpy as np

    codes, echoes, starts, counts = blocks_of(texts)
    x = inputs_of(codes, echoes, net["vectors"])
    y = responses(x, net)
    averages, firsts, begin, length = chunks_of(y, starts, counts)
    pooled = np.maximum.reduceat(averages, firsts, axis=0)
    p = 1 / (1 + np.exp(-(pooled @ net["out"] + net["level"])))
    error = ((p - y_true) / len(texts)).astype(np.float32)
    g = {k: np.zeros_like(v) for k, v in net.items()}
    g["out"], g["level"] = pooled.T @ error, np.array(error.sum(), dtype=np.float32)
    ends = np.append(firsts[1:], len(averages))
    dy = np.zeros_like(y)
    for i in range(len(texts)):
        best = averages[firsts[i] : ends[i]].argmax(axis=0) + firsts[i]
        for f, c in enumerate(best):
            dy[begin[c] : begin[c] + length[c], f] += error[i] * net["out"][f] / length[c]
    dy *= y > 0
    rows = np.flatnonzero(dy.any(axis=1))
    d, here, after = dy[rows], x[rows], x[np.minimum(rows + 1, len(x) - 1)]
    g["first"], g["second"], g["bias"] = here.T @ d, after.T @ d, d.sum(axis=0)
    byte_part = BLOCK * WIDTH
    for blocks, weights in ((rows, net["first"]), (np.minimum(rows + 1, len(x) - 1), net["second"])):
        back = (d @ weights[:byte_part].T).reshape(-1, WIDTH)
        flat = codes[blocks].ravel()
        for k in range(WIDTH):
            g["vectors"][:, k] += np.bincount(flat, back[:, k], 257).astype(np.float32)
    g["vectors"][256] = 0
    return g


def fit(texts: list[str], labels: list[int], epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> bytes:
    """Adam over shuffled batches of 32."""
    import pickle

    import numpy as np

    if len(set(labels)) < 2:
        return pickle.dumps({"rate": float(np.mean(labels)) if labels else 0.5})
    rng, y = np.random.default_rng(seed), np.array(labels, dtype=np.float32)
    width = BLOCK * WIDTH + 2
    share = float(np.clip(y.mean(), 0.01, 0.99))
    net = {
        "vectors": rng.normal(0, 0.5, (257, WIDTH)), "first": rng.normal(0, 0.12, (width, FILTERS)), "second": rng.normal(0, 0.12, (width, FILTERS)),
        "bias": np.zeros(FILTERS), "out": rng.normal(0, 0.3, FILTERS), "level": np.array(np.log(share / (1 - share))),
    }
    net = {k: v.astype(np.float32) for k, v in net.items()}
    net["vectors"][256] = 0
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), 32):
            some = order[at : at + 32]
            g = gradients([texts[i] for i in some], y[some], net)
            step += 1
            slow = rate * (1 - epoch / epochs) + rate * 0.05
            for k in net:
                m, v = moments[k]
                m += 0.1 * (g[k] - m)
                v += 0.001 * (g[k] * g[k] - v)
                net[k] -= (slow * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
    return pickle.dumps(net)


def quality_scorer(docs: DataFrame, labels: DataFrame, label_col: str = "quality", rows: int = SAMPLE):
    """Fit on the labelled rows; returns a function from texts to probabilities."""
    net = pickle.loads(fitted(sample(docs, labels, label_col, rows), fit))
    return lambda texts: forward(texts, net)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = KEEP) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    return scored(docs, quality_scorer(docs, labels), threshold)


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = KEEP) -> DataFrame:
    """The documents that the classifier does not reject."""
    return kept_documents(docs, quality_scorer(docs, labels), lambda p: p >= threshold)


def op2_quality(spark, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
