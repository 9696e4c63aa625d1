"""Near-equal names, without comparing all pairs of a block.

Two scores: by edits, ``1 - levenshtein / greatest(length)``, native in Spark; and by longest matching
blocks, as ``difflib.SequenceMatcher.ratio`` gives it, in numpy over whole Arrow batches.

Pairs meet on pieces: k edits leave at least one of k + 1 pieces of the shorter name whole, at a place
that has moved by few positions.  So the shorter name is indexed under its pieces, by block, length, piece number and
piece, and the longer one asks for the substrings that can be such a piece.  Both grow with the length of a name, not
with its square, and every pair at or above the threshold is found.

The best partner of a name alone is looked for in prefix trees of the names of its block.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from rosterloom.functions.joins import shuffled
from rosterloom.session import durable, spread

# the Python functions travel by value, so workers need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LONG = 200  # the standard matcher treats frequent signs of longer texts apart
EPS = 1e-9


def similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def _signs(texts: Sequence[str], pad: int):
    """A row of code points for each text, filled up with ``pad``."""
    import numpy as np

    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    out = np.full((len(texts), lengths.max(initial=0)), pad, dtype=np.int32)
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<i4")
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out


def block_ratios(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """Longest-matching-blocks ratio of each pair, all pairs side by side.

    In a wave, the longest common run of every open segment is found (the first in ``a``, then in ``b``), and what lies
    left and right of it are the segments of the next wave.
    """
    import numpy as np

    sa, sb = _signs(a, -1), _signs(b, -2)
    la, lb = np.array([len(x) for x in a], dtype=np.int64), np.array([len(x) for x in b], dtype=np.int64)
    matched = np.zeros(len(la), dtype=np.int64)
    zero = np.zeros(len(la), dtype=np.int64)
    segments = np.stack([np.arange(len(la)), zero, la, zero, lb], axis=1)
    while True:
        segments = segments[(segments[:, 2] > segments[:, 1]) & (segments[:, 4] > segments[:, 3])]
        if not len(segments):
            break
        k, alo, ahi, blo, bhi = segments.T
        cols = np.arange((bhi - blo).max())
        at = blo[:, None] + cols
        right = np.where(at < bhi[:, None], sb[k[:, None], np.minimum(at, sb.shape[1] - 1)], -2)
        runs = np.zeros((len(k), len(cols) + 1), dtype=np.int16)
        rows = np.arange(len(k))
        size, end_a, end_b = np.zeros((3, len(k)), dtype=np.int64)
        for i in range((ahi - alo).max()):
            x = alo + i
            left = np.where(x < ahi, sa[k, np.minimum(x, sa.shape[1] - 1)], -1)
            here = (runs[:, :-1] + np.int16(1)) * (right == left[:, None])
            runs[:, 1:] = here
            j = here.argmax(axis=1)
            most = here[rows, j]
            better = np.flatnonzero(most > size)
            size[better], end_a[better], end_b[better] = most[better], i, j[better]
        np.add.at(matched, k, size)
        a0, b0 = alo + end_a + 1 - size, blo + end_b + 1 - size
        some = size > 0
        before = np.stack([k, alo, a0, blo, b0], axis=1)[some]
        after = np.stack([k, a0 + size, ahi, b0 + size, bhi], axis=1)[some]
        segments = np.concatenate([before, after])
    both = la + lb
    return np.where(both > 0, 2.0 * matched / np.maximum(both, 1), 1.0)


def ratios(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """Longest-matching-blocks ratios, equal to the standard library's."""
    from difflib import SequenceMatcher

    import numpy as np

    long = np.array([len(x) >= LONG or len(y) >= LONG for x, y in zip(a, b)], dtype=bool)
    out = np.zeros(len(a))
    short = np.flatnonzero(~long)
    for part in np.array_split(short, max(1, len(short) // 1024)):
        out[part] = block_ratios([a[i] for i in part], [b[i] for i in part])
    for i in np.flatnonzero(long):
        out[i] = SequenceMatcher(None, a[i], b[i]).ratio()
    return out


def edit_similarities(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """``similarity`` of each pair, all pairs side by side, a row of the table of edits at a time."""
    import numpy as np

    sa, sb = _signs(a, -1), _signs(b, -2)
    la, lb = np.array([len(x) for x in a], dtype=np.int64), np.array([len(x) for x in b], dtype=np.int64)
    cols = np.arange(sb.shape[1] + 1, dtype=np.int32)
    row = np.repeat(cols[None, :], len(la), axis=0)
    edits = row[np.arange(len(la)), lb].astype(np.int64)  # of an empty a
    for i in range(sa.shape[1]):
        new = row + 1
        np.minimum(new[:, 1:], row[:, :-1] + (sb != sa[:, i : i + 1]), out=new[:, 1:])
        row = np.minimum.accumulate(new - cols, axis=1) + cols
        ends = np.flatnonzero(la == i + 1)
        edits[ends] = row[ends, lb[ends]]
    longest = np.maximum(la, lb)
    return np.where(longest > 0, 1 - edits / np.maximum(longest, 1), 1.0)


@F.pandas_udf(DoubleType())
def matcher_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Longest-matching-blocks ratio, equal to the standard library's."""
    return pd.Series(ratios(a.tolist(), b.tolist()))


WORD = 64  # signs of the longest names of which a table of common signs is a word a row


def common_signs(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """Length of the longest common subsequence of each pair, of which ``a`` has ``WORD`` signs at most, all pairs side by side.

    A row of the table is a word of bits, in which a zero is a sign more in common.
    """
    import numpy as np

    sa, sb = _signs(a, -1), _signs(b, -2)
    equal = np.zeros((len(sa), sb.shape[1], WORD), dtype=bool)
    equal[:, :, : sa.shape[1]] = sb[:, :, None] == sa[:, None, :]
    masks = np.packbits(equal, axis=2, bitorder="little").view("<u8")[:, :, 0]
    row = np.full(len(sa), ~np.uint64(0))
    for j in range(masks.shape[1]):
        hit = row & masks[:, j]
        row = (row + hit) | (row - hit)
    return np.bitwise_count(~row).astype(np.int64)


def ratios_from(a: Sequence[str], b: Sequence[str], threshold: float) -> np.ndarray:
    """``ratios`` of the pairs that reach the threshold, 0 for others that their common signs rule out.

    Matching blocks are a common subsequence, so no ratio exceeds that of the longest.
    """
    import numpy as np

    la, lb = np.array([len(x) for x in a], dtype=np.int64), np.array([len(x) for x in b], dtype=np.int64)
    may = np.ones(len(la), dtype=bool)
    short = np.flatnonzero((la <= WORD) & (lb <= WORD) & (la + lb > 0))
    for part in np.array_split(short, max(1, len(short) // 1024)):
        common = common_signs([a[i] for i in part], [b[i] for i in part])
        may[part] = 2.0 * common / (la[part] + lb[part]) >= threshold
    out = np.zeros(len(la))
    rest = np.flatnonzero(may)
    out[rest] = ratios([a[i] for i in rest], [b[i] for i in rest])
    return out


def matcher_ratio_from(threshold: float):
    """``matcher_ratio`` of the pairs that reach the threshold; others may get 0."""

    @F.pandas_udf(DoubleType())
    def ratio_from(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(ratios_from(a.tolist(), b.tolist(), threshold))

    return ratio_from


@dataclass(frozen=True)
class Measure:
    """A score with its bounds: the edits that a pair may have whose shorter name has length l (``edits``) or whose lengths
    are n and l (``between``), l's least value, and whether two sets of signs (see ``_signature``) allow a pair."""

    score: object
    edits: object
    between: object
    shortest: object
    allows: object


def _only_in(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseAND(F.bitwise_not(b)))


def by_edits(threshold: float) -> Measure:
    """t leaves at most (1 - t) of the longer name as edits; an edit takes one sign from each set at most."""
    if threshold <= 0.5:
        raise ValueError("a threshold above 0.5 is needed")
    return Measure(
        similarity,
        lambda l: F.floor(l * ((1 - threshold) / threshold) + EPS).cast("int"),
        lambda n, l: F.floor(n * (1 - threshold) + EPS).cast("int"),
        lambda m: F.ceil(m * threshold - EPS).cast("int"),
        lambda a, b, la, lb: F.greatest(_only_in(a, b), _only_in(b, a)) <= F.floor(F.greatest(la, lb) * (1 - threshold) + EPS),
    )


def by_blocks(threshold: float) -> Measure:
    """A ratio t leaves 1 - t of both lengths together unmatched, each sign of it an edit."""
    if threshold <= 2 / 3:
        raise ValueError("a threshold above 2/3 is needed")
    return Measure(
        matcher_ratio_from(threshold),
        lambda l: F.floor(l * (2 * (1 - threshold) / threshold) + EPS).cast("int"),
        lambda n, l: F.floor((n + l) * (1 - threshold) + EPS).cast("int"),
        lambda m: F.ceil(m * (threshold / (2 - threshold)) - EPS).cast("int"),
        lambda a, b, la, lb: _only_in(a, b) + _only_in(b, a) <= F.floor((la + lb) * (1 - threshold) + EPS),
    )


def measure(threshold: float, blocks: bool = False) -> Measure:
    return by_blocks(threshold) if blocks else by_edits(threshold)


def _signature(name: str, n: int = 1) -> Column:
    """A long in which every sign of the name (or run of ``n``), a repeated one with its number, sets one bit.

    A bit that one name has and another lacks is a sign that only the one has, so the bits in which two names
    differ never exceed the signs in which they do.
    """
    signs = F.split(name, "") if n == 1 else F.when(
        F.length(name) >= n, F.transform(F.sequence(F.lit(1), F.length(name) - (n - 1)), lambda i: F.substring(F.col(name), i, F.lit(n)))
    ).otherwise(F.array().cast("array<string>"))
    nth = F.transform(signs, lambda c, i: F.concat(c, F.size(F.filter(F.slice(signs, F.lit(1), i + 1), lambda d: d == c)).cast("string")))
    bit = lambda g: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.xxhash64(g), F.lit(64)).cast("int"))
    return F.aggregate(nth, F.lit(0).cast("bigint"), lambda acc, g: acc.bitwiseOR(bit(g)))


def _pieces(rows: DataFrame) -> DataFrame:
    """Adds ``_i``, ``_start`` (from 0) and ``_size`` of the ``_k`` + 1 pieces of length ``_l``; the last are one longer if need be."""
    plain = (F.col("_k") + 1) - F.pmod(F.col("_l"), F.col("_k") + 1)  # pieces without the extra sign
    base = F.floor(F.col("_l") / (F.col("_k") + 1)).cast("int")
    rows = rows.select("*", base.alias("_base"), plain.alias("_plain"), F.explode(F.sequence(F.lit(0), F.col("_k"))).alias("_i"))
    start = F.col("_i") * F.col("_base") + F.greatest(F.col("_i") - F.col("_plain"), F.lit(0))
    return rows.withColumns({"_start": start, "_size": F.col("_base") + F.when(F.col("_i") >= F.col("_plain"), 1).otherwise(0)}).drop("_base", "_plain")


def _key(block: Sequence[str], side: int, piece: Column) -> Column:
    """One long for block, side, length, piece number and piece; two that meet by chance fail the score."""
    return F.xxhash64(*block, F.lit(side), "_l", "_i", piece).alias("_key")


def _indexed(names: DataFrame, block: Sequence[str], name: str, m: Measure, side: int) -> DataFrame:
    """(key, block, _x, _x_sig): a name under each of its pieces."""
    l = F.length(name)
    rows = _pieces(names.select(*block, name, "_sig", l.alias("_l"), m.edits(l).alias("_k")))
    piece = F.substring(F.col(name), F.col("_start") + 1, F.col("_size"))
    return rows.select(_key(block, side, piece), *[F.col(c).alias(f"_b_{c}") for c in block], F.col(name).alias("_x"), F.col("_sig").alias("_x_sig"), F.lit(side).alias("_s"))


def _asked(names: DataFrame, block: Sequence[str], name: str, m: Measure, side: int) -> DataFrame:
    """(key, block, _y, _y_sig): the substrings that can be a piece of a partner that is not longer (side 0: is shorter).

    A pair of these lengths has at most ``e`` edits, fewer perhaps than the shorter name has pieces for, so its last e + 1
    pieces are enough: names that differ begin alike more often than they end alike.  Piece r of these has moved by at
    most r edits before it, and by at most e - r after it.
    """
    n = F.length(name)
    rows = names.select(*block, name, "_sig", n.alias("_n"), F.greatest(m.shortest(n), F.lit(1)).alias("_least"), (n - int(side == 0)).alias("_most"))
    rows = rows.where(F.col("_least") <= F.col("_most")).select("*", F.explode(F.sequence("_least", "_most")).alias("_l"))
    rows = rows.withColumns({"_k": m.edits(F.col("_l")), "_e": m.between(F.col("_n"), F.col("_l"))})
    gap = F.col("_n") - F.col("_l")
    rows = _pieces(rows.where(gap <= F.col("_e"))).withColumn("_r", F.col("_i") - (F.col("_k") - F.least("_k", "_e"))).where("_r >= 0")
    after = F.least("_k", "_e") - F.col("_r")
    first = F.greatest(F.lit(0), F.col("_start") - F.col("_r"), F.col("_start") + gap - after)
    last = F.least(F.col("_n") - F.col("_size"), F.col("_start") + F.col("_r"), F.col("_start") + gap + after)
    rows = rows.withColumns({"_first": first, "_last": last}).where(F.col("_first") <= F.col("_last"))
    rows = rows.select(*block, name, "_sig", "_l", "_i", "_size", F.explode(F.sequence("_first", "_last")).alias("_at"))
    piece = F.substring(F.col(name), F.col("_at") + 1, F.col("_size"))
    return rows.select(_key(block, side, piece), *block, F.col(name).alias("_y"), F.col("_sig").alias("_y_sig"))


def _names(df: DataFrame, block: Sequence[str], col: str, out: str, signed: bool = True) -> DataFrame:
    # checkpointed: the steps below read the distinct names again
    names = spread(df.where(F.length(col) > 0).select(*block, F.col(col).alias(out)).distinct(), *block, out)
    return durable(names.withColumn("_sig", _signature(out)) if signed else names)


def _scored(a: DataFrame, b: DataFrame, block: Sequence[str], threshold: float, m: Measure) -> DataFrame:
    """(block, a_name, b_name, similarity) of all pairs at the threshold; a pair comes once per piece it shares."""
    index = _indexed(a, block, "a_name", m, 0).unionByName(_indexed(b, block, "b_name", m, 1))
    asks = _asked(b, block, "b_name", m, 0).unionByName(_asked(a, block, "a_name", m, 1))
    # dealt over all tasks: a small input can have many candidates
    met = spread(index, "_key").join(spread(asks, "_key"), "_key")
    for c in block:
        met = met.where(F.col(c) == F.col(f"_b_{c}"))
    # names that differ in too many signs are left out before anything is computed from both
    met = met.where(m.allows(F.col("_x_sig"), F.col("_y_sig"), F.length("_x"), F.length("_y")))
    first = F.col("_s") == 0
    pairs = met.select(
        *block, F.when(first, F.col("_x")).otherwise(F.col("_y")).alias("a_name"), F.when(first, F.col("_y")).otherwise(F.col("_x")).alias("b_name")
    )
    if m.score is similarity:  # within a band about the diagonal first
        longest = F.greatest(F.length("a_name"), F.length("b_name"))
        most = F.floor(longest * (1 - threshold) + EPS).cast("int")
        pairs = pairs.where(F.call_function("levenshtein", F.col("a_name"), F.col("b_name"), most) >= 0)
    else:  # scoring costs more than making the pairs distinct
        pairs = pairs.distinct()
    return pairs.withColumn("similarity", m.score(F.col("a_name"), F.col("b_name"))).where(F.col("similarity") >= threshold)


def _met(a: DataFrame, b: DataFrame, block: Sequence[str], m: Measure) -> DataFrame:
    """(block, met): how often names of a block meet on pieces."""
    index = _indexed(a, block, "a_name", m, 0).unionByName(_indexed(b, block, "b_name", m, 1))
    index = index.groupBy(*[F.col(f"_b_{c}").alias(c) for c in block], "_key").agg(F.count(F.lit(1)).alias("_in"))
    asks = _asked(b, block, "b_name", m, 0).unionByName(_asked(a, block, "a_name", m, 1))
    asks = asks.groupBy(*block, "_key").agg(F.count(F.lit(1)).alias("_out"))
    return index.join(asks, [*block, "_key"]).groupBy(*block).agg(F.sum(F.col("_in").cast("double") * F.col("_out")).alias("_met"))


def similar_pairs(
    a: DataFrame, a_col: str, b: DataFrame, b_col: str, block: Sequence[str], threshold: float, blocks: bool = False
) -> DataFrame:
    """Every distinct pair of names in a block with a similarity of at least ``threshold``, by edits or by matching ``blocks``.

    Names meet on pieces where these tell them apart; a block that is small, or whose names share most of their pieces, is
    compared in cells, where looking at a pair costs about a hundredth of a meeting.
    """
    na, nb = _names(a, block, a_col, "a_name"), _names(b, block, b_col, "b_name")
    m = measure(threshold, blocks)
    count = lambda df, out: df.groupBy(*block).agg(F.count(F.lit(1)).cast("double").alias(out))
    large = durable(count(na, "_a").join(count(nb, "_b"), list(block)).where(F.col("_a") * F.col("_b") > ASKED * (F.col("_a") + F.col("_b"))))
    if large.isEmpty():
        return _pairs_in_cells(na, nb, block, threshold, blocks)
    within = lambda df, some, how: df.join(some.select(*block), list(block), how)
    met = _met(within(na, large, "left_semi"), within(nb, large, "left_semi"), block, m)
    told = durable(large.join(met, list(block), "left").where(F.coalesce("_met", F.lit(0.0)) * MEETING < F.col("_a") * F.col("_b")))
    pieces = _scored(within(na, told, "left_semi"), within(nb, told, "left_semi"), block, threshold, m).distinct()
    return pieces.unionByName(_pairs_in_cells(within(na, told, "left_anti"), within(nb, told, "left_anti"), block, threshold, blocks))


def ratio_pairs(
    a: DataFrame, a_col: str, b: DataFrame, b_col: str, block: Sequence[str], threshold: float
) -> DataFrame:
    """``similar_pairs`` by the longest-matching-blocks ratio."""
    return similar_pairs(a, a_col, b, b_col, block, threshold, blocks=True)


def _best(scored: DataFrame, block: Sequence[str]) -> DataFrame:
    order = F.struct(-F.col("similarity"), F.col("b_name"))
    return scored.groupBy(*block, "a_name").agg(F.min_by("b_name", order).alias("b_name"), F.max("similarity").alias("similarity"))


BLOCKS = 100_000  # blocks whose sizes may be sent to all tasks


def _sizes(a: DataFrame, b: DataFrame, block: Sequence[str], size_a: int, size_b: int) -> DataFrame:
    """(block, _ci, _cj): in how many parts of so many names the sides of each block are cut; few blocks are broadcast, and never the names."""
    count = lambda df, size, out: df.groupBy(*block).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(out))
    sizes = durable(count(a, size_a, "_ci").join(shuffled(count(b, size_b, "_cj")), list(block)))
    return F.broadcast(sizes) if sizes.count() <= BLOCKS else shuffled(sizes)


def _dealt(rows: DataFrame, name: str, block: Sequence[str], own: str, other: str, sizes: DataFrame) -> DataFrame:
    """The rows of one side, by the cells (_i, _j) of their block that they take part in."""
    cut = F.pmod(F.xxhash64(F.lit(7), name), F.col(own)).cast("int")
    places = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
    i, j = (cut, places) if own == "_ci" else (places, cut)
    return spread(rows.join(sizes, list(block)).select(*rows.columns, i.alias("_i"), j.alias("_j")), *block, "_i", "_j")


SHORT = 32  # signs of the longest names that are looked up in a tree
TREE = 262144  # names of a tree
ASKING = 32768  # names that are looked up in a tree in one group
FRONT = 1 << 18  # nodes that are looked at side by side
FEW = 2048  # pairs of a block that are compared at once
LOOKS = 4096  # nodes that a name may look at in any tree; in a large one, as many as a quarter of its names


def _tree(names: Sequence[str]):
    """The levels of the prefix tree of distinct names in order: for each node of the level above its first child and the one
    after its last, and of each child its sign, its first name, and whether that ends there."""
    import numpy as np

    signs, lengths = _signs(names, -1), np.array([len(t) for t in names], dtype=np.int64)
    levels, differs = [], np.arange(len(names)) == 0
    low, high = np.zeros(1, dtype=np.int64), np.array([len(names)])
    for d in range(signs.shape[1]):
        differs[1:] |= signs[1:, d] != signs[:-1, d]
        at = np.flatnonzero(differs)
        end = np.append(at[1:], len(names))
        deep = lengths[at] > d
        at, end = at[deep], end[deep]
        levels.append((np.searchsorted(at, low), np.searchsorted(at, high), signs[at, d], at, lengths[at] == d + 1))
        low, high = at, end
    return levels


def _in_tree(levels, signs, lengths, pad: int, k: int, blocks: bool, most: int):
    """(name, row, edits) of all names of the tree within ``k`` edits (or, by ``blocks``, signs that only one of two has), and which
    names were given up, as they would look at over ``most`` nodes; nothing if too many are looked at side by side.

    ``signs`` have ``pad`` signs before and after them that no name has.  A node has a row of the table of edits, as far as
    ``k`` from the diagonal, and is left once none of it is within ``k``.
    """
    import numpy as np

    far, band = 100, 2 * k + 1
    row = np.arange(len(lengths))
    node = np.zeros(len(lengths), dtype=np.int64)
    edits = np.repeat(np.array([o - k if o >= k else far for o in range(band)], dtype=np.int8)[:, None], len(row), axis=1)
    seen, given = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=bool)
    found = []
    for d, (first, last, sign, at, ends) in enumerate(levels):
        children = last[node] - first[node]
        seen += np.bincount(row, children, minlength=len(seen)).astype(np.int64)
        if (seen > most).any():
            given |= seen > most
            stay = np.flatnonzero(~given[row])
            row, node, edits, children = row[stay], node[stay], edits[:, stay], children[stay]
        total = int(children.sum())
        if not total:
            break
        if total > FRONT and len(lengths) > 1:
            return None
        which = np.repeat(np.arange(len(row)), children)
        node = (first[node] - (np.cumsum(children) - children))[which] + np.arange(total)
        row, old = row[which], edits[:, which]
        here = np.ascontiguousarray(signs[:, pad + d - k : pad + d + k + 1].T)[:, row] == sign[node]
        edits = np.where(here, old, np.int8(far) if blocks else old + np.int8(1))
        np.minimum(edits[:-1], old[1:] + np.int8(1), out=edits[:-1])
        for o in range(1, band):
            np.minimum(edits[o], edits[o - 1] + np.int8(1), out=edits[o])
        np.minimum(edits, np.int8(far), out=edits)
        near = np.flatnonzero(edits.min(axis=0) <= k)
        row, node, edits = row[near], node[near], edits[:, near]
        whole = np.flatnonzero(ends[node])
        o = lengths[row[whole]] - (d + 1) + k
        whole, o = whole[(o >= 0) & (o < band)], o[(o >= 0) & (o < band)]
        got = edits[o, whole]
        hit = whole[got <= k]
        found.append((row[hit], at[node[hit]], got[got <= k].astype(np.int64)))
    found = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, dtype=np.int64)] * 3
    stay = ~given[found[0]]
    return tuple(c[stay] for c in found), given


def _nearest_in_trees(a: DataFrame, b: DataFrame, block: Sequence[str], threshold: float, blocks: bool) -> DataFrame:
    """(block, a_name, b_name, similarity): for each name of up to ``SHORT`` signs the best of each tree; without ``b_name`` if it was given up.

    The names of a block are a prefix tree, which is walked with a row of the table of edits as long as that is within some edits:
    one, then two, as far as they can give the best.  So the time of a name follows the names near it and not its block, also where
    all names begin alike; one that would look at a quarter of them is given up.
    """
    sizes = _sizes(a, b, block, ASKING, TREE)
    left, right = _dealt(a, "a_name", block, "_ci", "_cj", sizes), _dealt(b, "b_name", block, "_cj", "_ci", sizes)
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in a.select(*block).schema]

    def work(x: pa.Table, y: pa.Table) -> pa.Table:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        names = x["a_name"].to_pylist()
        order = pc.sort_indices(y["b_name"])  # the first of the best has the least name
        others = y["b_name"].take(order).to_pylist()
        n, l = [np.array([len(t) for t in side], dtype=np.int64) for side in (names, others)]
        whole = (lambda m, l: m + l) if blocks else np.maximum
        fit = np.flatnonzero(l <= n.max(initial=0) * ((2 - threshold) if blocks else 1) / threshold + EPS)  # longer ones are too far
        others, l = [others[i] for i in fit], l[fit]
        top = int(whole(n.max(initial=0), l.max(initial=0)) * (1 - threshold) + EPS)
        best, best_j = np.full(len(n), -1.0), np.zeros(len(n), dtype=np.int64)
        given = np.zeros(len(n), dtype=bool)

        def take(i, j, score):
            fine = np.flatnonzero(score >= threshold)
            rank = fine[np.lexsort((j[fine], -score[fine], i[fine]))]
            rank = rank[np.unique(i[rank], return_index=True)[1]]
            was = best[i[rank]]
            rank = rank[(score[rank] > was) | ((score[rank] == was) & (j[rank] < best_j[i[rank]]))]
            best[i[rank]], best_j[i[rank]] = score[rank], j[rank]

        if 0 < len(n) * len(l) <= FEW:
            i, j = np.divmod(np.arange(len(n) * len(l)), len(l))
            pairs = [names[q] for q in i], [others[q] for q in j]
            take(i, j, ratios_from(*pairs, threshold) if blocks else edit_similarities(*pairs))
        elif len(l) and len(n):
            levels = _tree(others)
            signs = np.full((len(n), max(n.max(), l.max()) + 2 * top + 1), -2, dtype=np.int32)
            own = _signs(names, -2)
            signs[:, top : top + own.shape[1]] = own
            for k in range(1, top + 1):
                # the most that a pair can score that is k apart, by the length of the name
                could = np.full(n.max() + 1, -1.0)
                for m in np.unique(n).tolist():
                    fits = np.unique(l[(abs(l - m) <= k) & (((l + m - k) % 2 == 0) | (not blocks))])
                    could[m] = (1 - k / whole(m, fits)).max(initial=-1.0) + EPS
                ask = np.flatnonzero((could[n] >= threshold) & (could[n] >= best) & ~given)
                todo = [ask[s : s + 2048] for s in range(0, len(ask), 2048)]
                while todo:
                    some = todo.pop()
                    got = _in_tree(levels, signs[some], n[some], top, k, blocks, max(LOOKS, len(l) // 4))
                    if got is None:
                        todo += np.array_split(some, 2)
                        continue
                    (i, j, edits), up = got
                    given[some[up]] = True
                    i = some[i]
                    score = 1 - edits / whole(n[i], l[j])
                    likely = np.flatnonzero((score >= threshold - EPS) & (score + EPS >= best[i]))
                    i, j, score = i[likely], j[likely], score[likely]
                    take(i, j, ratios([names[q] for q in i], [others[q] for q in j]) if blocks else score)
        at = np.flatnonzero((best >= 0) | given)
        out = x.select([*block, "a_name"]).take(pa.array(at))
        out = out.append_column("b_name", pa.array([None if given[q] else others[best_j[q]] for q in at], pa.string()))
        return out.append_column("similarity", pa.array(best[at]))

    keys = [*block, "_i", "_j"]
    schema = ", ".join([*kinds, "a_name string", "b_name string", "similarity double"])
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(work, schema)


CELL = 16384  # names of a side that are compared with as many of the other in one group


PAIRS = 4096  # the same where all pairs at the threshold leave the group
ASKED = 10000  # pairs that are looked at in cells in the time that a name takes to ask by its pieces
MEETING = 100  # and in that of a meeting


def _cells(rows: DataFrame, name: str, block: Sequence[str], own: str, other: str, sizes: DataFrame) -> DataFrame:
    """The names of one side with their signatures, by the cells (_i, _j) of their block that they take part in."""
    rows = rows.select(*block, name, F.length(name).alias("_n"), "_sig", _signature(name, 2).alias("_runs"))
    return _dealt(rows, name, block, own, other, sizes)


def _nearest_in_cells(a: DataFrame, b: DataFrame, block: Sequence[str], threshold: float, blocks: bool) -> DataFrame:
    """(block, a_name, b_name, similarity): for each name the best of each cell, of all pairs of a block.

    Every pair is looked at, but nearly all by two longs of signs and runs of two only, a few nanoseconds each; what
    these allow is scored in the same task and the best alone leave it.  So memory and shuffle follow the names, also where all
    names of a block share most of their pieces.
    """
    sizes = _sizes(a, b, block, CELL, CELL)
    left, right = _cells(a, "a_name", block, "_ci", "_cj", sizes), _cells(b, "b_name", block, "_cj", "_ci", sizes)
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in a.select(*block).schema]

    def work(x: pa.Table, y: pa.Table) -> pa.Table:
        import numpy as np
        import pyarrow as pa

        names = [t[c].to_pylist() for t, c in ((x, "a_name"), (y, "b_name"))]
        (n, sx, rx), (l, sy, ry) = [
            (t["_n"].to_numpy().astype(np.int64), t["_sig"].to_numpy().view(np.uint64), t["_runs"].to_numpy().view(np.uint64)) for t in (x, y)
        ]
        # names in order, so the first of the best has the least name
        order = np.array(sorted(range(len(l)), key=lambda k: names[1][k].encode("utf-8")), dtype=np.int64)
        l, sy, ry = l[order], sy[order], ry[order]
        bits = np.bitwise_count
        share = lambda edits, m, l: 1 - edits / np.maximum(m + l if blocks else np.maximum(m, l), 1)
        at, to, score = [], [], []
        for k in range(0, len(n), 128):
            own = np.arange(k, min(k + 128, len(n)))
            p, r = sx[own, None], rx[own, None]
            if blocks:  # least number of signs left unmatched; each changes three runs at most
                least = np.maximum(bits(p ^ sy), (bits(r ^ ry) + 2) // 3)
            else:  # least number of edits; each takes a sign and two runs from a side at most
                least = np.maximum(np.maximum(bits(p & ~sy), bits(sy & ~p)), (np.maximum(bits(r & ~ry), bits(ry & ~r)) + 1) // 2)
            best, best_j = np.full(len(own), -1.0), np.zeros(len(own), dtype=np.int64)
            longest = l.max(initial=0)
            for level in range(int(least.max(initial=0)) + 1):
                # the likeliest first: a name whose best no farther pair can reach is done
                could = share(level, n[own], longest) + EPS
                open_ = np.flatnonzero((could >= threshold) & (could >= best))
                if not len(open_):
                    break
                i, j = np.nonzero(least[open_] == level)
                i = open_[i]
                for s in range(0, len(i), 16384):
                    some_i, some_j = i[s : s + 16384], j[s : s + 16384]
                    could = share(level, n[own[some_i]], l[some_j]) + EPS
                    some = (could >= threshold) & (could >= best[some_i])
                    some_i, some_j = some_i[some], some_j[some]
                    pairs = [names[0][own[q]] for q in some_i], [names[1][order[q]] for q in some_j]
                    if not len(some_i):
                        continue
                    got = ratios(*pairs) if blocks else edit_similarities(*pairs)
                    fine = np.flatnonzero(got >= threshold)
                    rank = fine[np.lexsort((some_j[fine], -got[fine], some_i[fine]))]
                    rank = rank[np.unique(some_i[rank], return_index=True)[1]]
                    was = best[some_i[rank]]
                    rank = rank[(got[rank] > was) | ((got[rank] == was) & (some_j[rank] < best_j[some_i[rank]]))]
                    best[some_i[rank]], best_j[some_i[rank]] = got[rank], some_j[rank]
            hit = np.flatnonzero(best >= 0)
            at.append(own[hit])
            to.append(order[best_j[hit]])
            score.append(best[hit])
        none = np.zeros(0, dtype=np.int64)
        at, to = np.concatenate([none, *at]), np.concatenate([none, *to])
        out = x.select([*block, "a_name"]).take(pa.array(at))
        out = out.append_column("b_name", y["b_name"].take(pa.array(to)))
        return out.append_column("similarity", pa.array(np.concatenate([np.zeros(0), *score])))

    keys = [*block, "_i", "_j"]
    schema = ", ".join([*kinds, "a_name string", "b_name string", "similarity double"])
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(work, schema)


def _pairs_in_cells(a: DataFrame, b: DataFrame, block: Sequence[str], threshold: float, blocks: bool) -> DataFrame:
    """(block, a_name, b_name, similarity) of all pairs at the threshold, looked at as in ``_nearest_in_cells``."""
    # columns of their own, as both sides may come from one table
    a, b = [df.select(*[F.col(c).alias(c) for c in df.columns]) for df in (a, b)]
    sizes = _sizes(a, b, block, PAIRS, PAIRS)
    left, right = _cells(a, "a_name", block, "_ci", "_cj", sizes), _cells(b, "b_name", block, "_cj", "_ci", sizes)
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in a.select(*block).schema]

    def work(x: pa.Table, y: pa.Table) -> pa.Table:
        import numpy as np
        import pyarrow as pa

        names = [t[c].to_pylist() for t, c in ((x, "a_name"), (y, "b_name"))]
        (n, sx, rx), (l, sy, ry) = [
            (t["_n"].to_numpy().astype(np.int64), t["_sig"].to_numpy().view(np.uint64), t["_runs"].to_numpy().view(np.uint64)) for t in (x, y)
        ]
        bits = np.bitwise_count
        at, to, score = [], [], []
        for k in range(0, len(n), 128):
            own = np.arange(k, min(k + 128, len(n)))
            p = sx[own, None]
            # signs that are left unmatched, or edits: each takes a sign from a side at most
            least = bits(p ^ sy) if blocks else np.maximum(bits(p & ~sy), bits(sy & ~p))
            both = n[own, None] + l if blocks else np.maximum(n[own, None], l)
            i, j = np.nonzero(least <= np.floor(both * (1 - threshold) + EPS))
            r, q = rx[own[i]], ry[j]
            if blocks:  # and changes three runs of two at most
                some = (bits(r ^ q) + 2) // 3 <= np.floor(both[i, j] * (1 - threshold) + EPS)
            else:  # or two of a side
                some = (np.maximum(bits(r & ~q), bits(q & ~r)) + 1) // 2 <= np.floor(both[i, j] * (1 - threshold) + EPS)
            i, j = own[i[some]], j[some]
            for s in range(0, len(i), 16384):
                some_i, some_j = i[s : s + 16384], j[s : s + 16384]
                pairs = [names[0][v] for v in some_i], [names[1][v] for v in some_j]
                got = ratios_from(*pairs, threshold) if blocks else edit_similarities(*pairs)
                fine = got >= threshold
                at.append(some_i[fine])
                to.append(some_j[fine])
                score.append(got[fine])
        none = np.zeros(0, dtype=np.int64)
        at, to = np.concatenate([none, *at]), np.concatenate([none, *to])
        out = x.select([*block, "a_name"]).take(pa.array(at))
        out = out.append_column("b_name", y["b_name"].take(pa.array(to)))
        return out.append_column("similarity", pa.array(np.concatenate([np.zeros(0), *score])))

    keys = [*block, "_i", "_j"]
    schema = ", ".join([*kinds, "a_name string", "b_name string", "similarity double"])
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(work, schema)


def nearest(
    a: DataFrame, a_col: str, b: DataFrame, b_col: str, block: Sequence[str], threshold: float, blocks: bool = False
) -> DataFrame:
    """Best partner of each distinct name of ``a`` in its block, ties by name, by edits or by matching ``blocks``.

    Equal names are settled first, then others in the trees of their blocks; those that are long or would look at much of a tree
    are compared in cells.
    """
    measure(threshold, blocks)  # refuses low thresholds
    na, nb = _names(a, block, a_col, "a_name", False), _names(b, block, b_col, "b_name", False)
    equal = na.join(shuffled(nb.select(*block, F.col("b_name").alias("a_name"))), [*block, "a_name"], "left_semi")
    near = durable(equal.select(*block, "a_name", F.col("a_name").alias("b_name"), F.lit(1.0).alias("similarity")))
    left = durable(na.join(shuffled(near.select(*block, "a_name")), [*block, "a_name"], "left_anti"))
    found = durable(_nearest_in_trees(left.where(F.length("a_name") <= SHORT), nb, block, threshold, blocks))
    given = found.where("b_name IS NULL").select(*block, "a_name").distinct()
    left = durable(left.where(F.length("a_name") > SHORT).unionByName(left.join(shuffled(given), [*block, "a_name"], "left_semi")))
    near = near.unionByName(found.where("b_name IS NOT NULL"))
    if not left.isEmpty():
        left, nb = [df.withColumn("_sig", _signature(name)) for df, name in ((left, "a_name"), (nb, "b_name"))]
        near = near.unionByName(_nearest_in_cells(left, nb, block, threshold, blocks))
    return _best(near, block)
