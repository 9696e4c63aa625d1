"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables.

1. Vectors are scaled to length one; equal vectors are a class with a count.
2. A rotation is learned on a bounded sample (``SAMPLE`` vectors, ``SAMPLE_NUMBERS`` numbers): principal axes, then
   alternately the signs of the rotated vectors and the rotation that fits these signs best.  The signs are
   ``BITS`` balanced bits; short vectors get several rotations, long ones their main axes.
3. The code is cut into ``TABLES`` parts.  A vector is stored under each part and probes each
   part with one of its zero bits set, so two codes that differ in at most one bit of a
   part meet in that part's table exactly once.  Pairs count in the first part in which they meet, and
   only within a radius of bits in all.
4. One set of tables is sure to find pairs up to 2 * TABLES - 1 = 7 differing bits and misses some beyond.  Vectors with a
   strong common direction differ in more bits at the same cosine.  So sets with further learned rotations are
   added until, of partners made at the very threshold for the sample's vectors, ``WANTED`` are found (``tables_for``);
   the radius is chosen from the same partners.  Measured in 64 dimensions: 1 set without a common mean, 2 with one of length 0.7, 7 with 0.9.
5. Members of a bucket that have such a partner there are given their vectors, and the original
   vectors of these pairs are compared in double precision.  A bucket hands over link counts and a
   spanning forest of its links, never the pairs.

Large buckets are cut into blocks of ``BLOCK`` members, each two of which are a group of their own, so a bucket of m
members costs about m * m / BLOCK rows; more members than that is what balanced bits avoid.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with
nothing; vectors of different length are compared as if the shorter ended in zeros; equal vectors are linked;
a null id takes part and is never the smallest of its component unless all are null; rows that repeat
an id are vertices of their own with one component id; an empty table gives no rows; long vectors lower the number of
vectors learned from; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterloom.llm.common import block_pairs, by_value, landed, shuffle_partitions, table
from rosterloom.llm.components import components

by_value(__name__)

SAMPLE = 20_000
SAMPLE_NUMBERS = SAMPLE * 256
WANTED, MOST_SETS = 0.97, 12
ROUNDS = 40
BITS, TABLES = 64, 4
PART = BITS // TABLES
RADIUS = 14  # at least
BLOCK = 1024


def unit_vectors(rows: list, width: int):
    """Matrix of the vectors at length one, in double precision, padded with zeros."""
    import numpy as np

    x = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        x[i, : len(r)] = r
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def unit_matrix(vectors: pa.ChunkedArray, width: int):
    """``unit_vectors`` of an Arrow column, without a Python object for each number."""
    import numpy as np

    lists = vectors.combine_chunks()
    lengths = np.diff(lists.offsets.to_numpy())
    x = np.zeros((len(lists), width))
    x[np.arange(width) < lengths[:, None]] = lists.flatten().to_numpy()
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x


def learn_rotation(x, bits: int = BITS, rounds: int = ROUNDS, seed: int = 5):
    """(mean, projection): the sign of ``(x - mean) @ projection`` is the code."""
    import numpy as np

    rng = np.random.default_rng(seed)
    mean = x.mean(axis=0)
    centred = x - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    parts, left = [], bits
    while left > 0:
        n = min(left, x.shape[1])
        main = axes[:, ::-1][:, :n]
        v = centred @ main
        r = np.linalg.qr(rng.normal(size=(n, n)))[0]
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        parts.append(main @ r)
        left -= n
    return mean, np.concatenate(parts, axis=1)


def codes_of(x, mean, projection):
    import numpy as np

    bits = ((x - mean) @ projection >= 0).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()


def partners_at(x, cosine: float, seed: int):
    """For each unit vector one at this cosine, half of them in any direction, half in a direction of the data."""
    import numpy as np

    rng = np.random.default_rng(seed)
    away = rng.normal(size=x.shape)
    away[::2] = (x - x.mean(axis=0))[rng.permutation(len(x))][::2]
    away -= np.einsum("ij,ij->i", away, x)[:, None] * x
    length = np.linalg.norm(away, axis=1, keepdims=True)
    return cosine * x + np.sqrt(1 - cosine * cosine) * away / np.where(length > 0, length, 1.0)


def tables_for(x, cosine: float, wanted: float = WANTED, most: int = MOST_SETS):
    """([(mean, projection)], radius): as many learned sets as find enough partners at the cosine."""
    import numpy as np

    if len(x) < 2 or x.shape[1] < 2:
        return [learn_rotation(x)], BITS
    part = (1 << PART) - 1
    y = partners_at(x, cosine, 11)
    sets, found, far = [], np.zeros(len(x), dtype=bool), RADIUS
    while len(sets) < most:
        learned = learn_rotation(x, seed=5 + len(sets))
        sets.append(learned)
        differ = codes_of(x, *learned) ^ codes_of(y, *learned)
        near = np.zeros(len(x), dtype=bool)
        for t in range(TABLES):
            near |= np.bitwise_count(differ >> np.uint64(t * PART) & np.uint64(part)) <= 1
        if near.any():
            far = max(far, int(np.quantile(np.bitwise_count(differ)[near], 0.999)))
        found |= near
        if min(found[::2].mean(), found[1::2].mean()) >= wanted:
            break
    return sets, far


def usable(vector: str):
    """The vector has components, all are there and finite, and some is not zero."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False))


def coded(classes: DataFrame, width: int, sets) -> DataFrame:
    """cls and codes, one of each set of tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            x = unit_vectors(b["vector"].to_pylist(), width)
            codes = np.stack([codes_of(x, *s).astype(np.int64) for s in sets], axis=1) if b.num_rows else np.zeros((0, len(sets)), np.int64)
            ends = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * len(sets))
            yield pa.record_batch([b["cls"], pa.ListArray.from_arrays(ends, pa.array(codes.ravel()))], names=["cls", "codes"])

    return classes.select("cls", "vector").mapInArrow(run, "cls bigint, codes array<bigint>")


def bucket_rows(codes: DataFrame, n_sets: int) -> DataFrame:
    """(t, key, probe, cls, codes): a vector under each part of each of its codes, and its probes."""
    entries = []
    for t in range(n_sets * TABLES):
        part = F.shiftrightunsigned(F.col("codes")[t // TABLES], t % TABLES * PART).bitwiseAND(F.lit((1 << PART) - 1))
        entries.append(F.struct(F.lit(t).alias("t"), part.alias("key"), F.lit(False).alias("probe")))
        for i in range(PART):
            probe = F.struct(F.lit(t).alias("t"), part.bitwiseOR(F.lit(1 << i)).alias("key"), F.lit(True).alias("probe"))
            entries.append(F.when(part.bitwiseAND(F.lit(1 << i)) == 0, probe))
    rows = codes.select("cls", "codes", F.explode(F.array(*entries)).alias("e")).where(F.col("e").isNotNull())
    return rows.select("e.t", "e.key", "e.probe", "cls", "codes")


def meets(codes_a, codes_b, probe_a, probe_b, t: int, radius: int):
    """Matrix: the pair meets in this bucket for the first time and is within the radius of its set."""
    import numpy as np

    own, ok = t // TABLES, ~(probe_a[:, None] & probe_b[None, :])
    for s in range(own + 1):
        x = codes_a[:, s][:, None] ^ codes_b[:, s][None, :]
        near = np.bitwise_count(x) <= radius
        met = np.zeros(x.shape, dtype=bool)
        for earlier in range(t % TABLES if s == own else TABLES):
            met |= np.bitwise_count(x >> np.uint64(earlier * PART) & np.uint64((1 << PART) - 1)) <= 1
        ok &= ~met & near if s == own else ~(met & near)
    return ok


def tops(n: int, a, b):
    """Smallest member reachable, for n members and links a-b."""
    import numpy as np

    top = np.arange(n)
    while True:
        low = top.copy()
        least = np.minimum(top[a], top[b])
        np.minimum.at(low, a, least)
        np.minimum.at(low, b, least)
        low = low[low]
        if (low == top).all():
            return top
        top = low


def by_group(rows: DataFrame, columns: list[str], schema: str, work) -> DataFrame:
    """``work`` on the rows of every group (t, key, _i, _j), none of which is larger than two blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch[c].to_numpy().astype(np.int64) for c in ("t", "key", "_i", "_j")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for x, y in zip(cuts, cuts[1:]):
                here = tuple(keys[x].tolist())
                if here != last:
                    if sum(b.num_rows for b in held) > 1:
                        yield from work(pa.Table.from_batches(held).combine_chunks())
                    held, last = [], here
                held.append(batch.slice(x, y - x))
        if sum(b.num_rows for b in held) > 1:
            yield from work(pa.Table.from_batches(held).combine_chunks())

    dealt = rows.repartition(shuffle_partitions(rows.sparkSession), "t", "key", "_i", "_j").sortWithinPartitions("t", "key", "_i", "_j")
    return dealt.select("t", "key", "_i", "_j", "_b", "probe", "cls", "codes", *columns).mapInArrow(run, schema)


def sides(t):
    """Places of the two sides of a group, and whether they are one block."""
    import numpy as np

    i, j, block = t["_i"][0].as_py(), t["_j"][0].as_py(), t["_b"].to_numpy()
    return np.flatnonzero(block == i), np.flatnonzero(block == j), i == j


def met_pairs(t, radius: int):
    """(a, b): places of the pairs of a group that meet in it first and are within the radius."""
    import numpy as np

    code = t["codes"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(t.num_rows, -1)
    probe, part = t["probe"].to_numpy(zero_copy_only=False), t["t"][0].as_py()
    left, right, one = sides(t)
    found_a, found_b = [], []
    for at in range(0, len(left), 256):
        some = left[at : at + 256]
        a, b = np.nonzero(meets(code[some], code[right], probe[some], probe[right], part, radius))
        a, b = some[a], right[b]
        keep = a < b if one else a >= 0
        found_a.append(a[keep])
        found_b.append(b[keep])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found_a]), np.concatenate([none, *found_b])


def partnered(rows: DataFrame, radius: int) -> DataFrame:
    """The members (t, key, _i, _j, _b, probe, cls, codes) that have a partner in their group."""

    def work(t):
        import numpy as np

        a, b = met_pairs(t, radius)
        live = np.unique(np.concatenate([a, b]))
        if len(live):
            yield from t.take(pa.array(live)).to_batches()

    return by_group(rows, [], "t int, key bigint, _i int, _j int, _b int, probe boolean, cls bigint, codes array<bigint>", work)


def linked(rows: DataFrame, width: int, cosine: float, radius: int) -> DataFrame:
    """Per group: (a, null, n) the links of member a counted in copies, and (a, b, 0) a spanning forest of the links."""

    def work(t):
        import numpy as np

        a, b = met_pairs(t, radius)
        x = unit_vectors(t["vector"].to_pylist(), width)
        copies, cls = t["copies"].to_numpy(), t["cls"].to_numpy()
        close = np.concatenate([np.zeros(0, bool), *[np.einsum("ij,ij->i", x[a[k : k + 65536]], x[b[k : k + 65536]]) >= cosine for k in range(0, len(a), 65536)]])
        a, b = a[close], b[close]
        if not len(a):
            return
        n = np.bincount(a, copies[b], len(cls)) + np.bincount(b, copies[a], len(cls))
        some = np.flatnonzero(n)
        top = tops(len(cls), a, b)
        tree = np.flatnonzero(top != np.arange(len(cls)))
        ends = pa.array([None] * len(some) + cls[top[tree]].tolist(), pa.int64())
        counts = np.concatenate([n[some], np.zeros(len(tree))]).astype(np.int64)
        yield pa.record_batch([pa.array(np.concatenate([cls[some], cls[tree]])), ends, pa.array(counts)], names=["a", "b", "n"])

    return by_group(rows, ["vector", "copies"], "a bigint, b bigint, n bigint", work)


def near_vectors(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """Per row: id, n_links, component_id, kept."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), usable(vector_col).alias("fine"))
    fine = rows.where("fine").groupBy("vector").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    classes = landed(fine.withColumn("cls", F.monotonically_increasing_id()), "vector-classes")
    width = classes.agg(F.max(F.size("vector"))).head()[0]
    out = rows.select("id", F.when(F.col("fine"), F.col("vector")).alias("vector")).join(classes, "vector", "left").select("id", "cls", "copies")
    if width is None:
        return out.select(F.col("id").alias(id_col), F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    sample = max(2, min(sample, SAMPLE_NUMBERS // width))
    chosen = classes.orderBy(F.xxhash64(F.lit(3), "vector"), "vector").limit(sample).select("vector")
    sets, radius = tables_for(unit_matrix(chosen.toArrow()["vector"], width), cosine)
    codes = landed(coded(classes, width, sets), "codes")
    members = block_pairs(bucket_rows(codes, len(sets)), ["t", "key"], "cls", BLOCK)
    members = landed(partnered(members, radius), "partners").join(classes.select("cls", "vector", "copies"), "cls")
    found = landed(linked(members, width, cosine, radius), "vector-links")
    counts = found.where(F.col("b").isNull()).groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("links"))
    roots = components(found.where(F.col("b").isNotNull()))
    placed = classes.select("cls", "first_id").join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = placed.groupBy("root").agg(F.min("first_id").alias("component"))
    named = placed.join(least, "root").join(counts, "cls", "left").select("cls", "component", F.coalesce("links", F.lit(0)).alias("links"))
    out = out.join(named, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("component"))
    links = F.when(F.col("cls").isNull(), F.lit(0)).otherwise(F.col("links") + F.col("copies") - 1).cast("bigint")
    return out.select(F.col("id").alias(id_col), links.alias("n_links"), component.alias("component_id")).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def op6_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
