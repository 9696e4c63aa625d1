"""MinHash near-duplicates with sequential Bayesian verification.

1. Every document is reduced to its set of word shingles (64-bit hashes), a digest of the set and a
   MinHash signature.  Documents with one digest are a class; only classes go on.
2. Signatures meet in buckets by bands.  Of buckets with the same members only the one of the first
   band stays, and a pair counts only in the first band in which it agrees.
3. In a bucket, signatures are compared ``BATCH`` places at a time.  After n places with m matches
   and a uniform prior, the similarity is at least t with probability P(Bin(n + 1, t) <= m);
   a pair is dropped as soon as that is below ``miss``.
4. Of the survivors a bucket hands over a spanning forest, most alike first; these links are verified on
   the full sets and join classes into components.
5. Survivors between different components are left.  Their members are given their full sets, and
   each pair is verified in its bucket's task, which again hands over a spanning forest only.

So a large group of near copies costs about one verified link per member and bucket, pairs are never
written out, and no link between components is lost.

Buckets above ``BLOCK`` members are cut into blocks; first pairs inside a block are compared, then
members outside the bucket's largest component with all blocks.  A task holds two blocks at a time.

Defined cases: a null text is an empty one; texts without words have an empty set and link with nothing; texts
with fewer words than a shingle have the whole sequence as their only shingle; equal sets are linked
whatever their ids; a null id is never the smallest of its component unless all are null; rows
that repeat an id are looked at each by its own text; very long texts are reduced to their whole sets, one text at a time; an empty table gives no rows; further columns are not
looked at.  A pair at the threshold t misses all bands with probability (1 - t ** rows) ** bands, which
``banding`` holds below ``BAND_MISS``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterloom.llm.common import by_value, landed, shuffle_partitions, small, table, whole
from rosterloom.llm.components import components
from rosterloom.llm.pretokens import text_parts

by_value(__name__)

PLACES = 144
BAND_MISS = 1e-4
BATCH = 16
MISS = 1e-6
BLOCK = 1024
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def shingle_set(text: str, width: int):
    """Sorted distinct 64-bit hashes of the word shingles."""
    import numpy as np
    import xxhash

    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = len(words) - width + 1
    mixed = np.zeros(n, dtype=np.uint64)
    for i in range(width):
        mixed = (mixed ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def digest_of(shingles) -> bytes | None:
    import hashlib

    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def multipliers(places: int):
    import numpy as np

    rng = np.random.default_rng(20)
    return rng.integers(1, 1 << 63, places, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, places, dtype=np.uint64)


def signature(shingles, factors, offsets):
    """The least hash of the set under each of the functions, 32 bits of it."""
    import numpy as np

    least = np.full(len(factors), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 512):
        hashed = np.multiply.outer(factors, shingles[at : at + 512])
        hashed += offsets[:, None]
        np.minimum(least, hashed.min(axis=1), out=least)
    return (least >> np.uint64(32)).astype("<u4")


def banding(threshold: float) -> tuple[int, int]:
    """(bands, rows): the longest bands that miss a pair at the threshold seldom enough."""
    for rows in range(12, 0, -1):
        bands = PLACES // rows
        if (1 - threshold**rows) ** bands <= BAND_MISS:
            return bands, rows
    return PLACES, 1


def least_matches(threshold: float, places: int, miss: float) -> list[int]:
    """For each count of places that is a multiple of ``BATCH``: the matches below which a pair is dropped."""
    from math import comb

    out = []
    for n in range(BATCH, places + 1, BATCH):
        below, m = 0.0, 0
        while m <= n:
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= miss:
                break
            m += 1
        out.append(m)
    return out


def survivors(left, right, same: bool, apart, needed: list[int], band: int, rows: int):
    """(i, j, matches) of the pairs of rows that no batch drops and whose first common band this is; ``apart(i, j)`` says which pairs count."""
    import numpy as np

    found = []
    for at in range(0, len(left), 128):
        part = left[at : at + 128]
        matches = (part[:, None, :BATCH] == right[None, :, :BATCH]).sum(axis=2, dtype=np.int16)
        i, j = np.nonzero(matches >= needed[0])
        m = matches[i, j].astype(np.int64)
        i = i + at
        keep = apart(i, j) & (i < j) if same else apart(i, j)
        i, j, m = i[keep], j[keep], m[keep]
        for k in range(1, len(needed)):
            places = slice(k * BATCH, (k + 1) * BATCH)
            m = m + (left[i, places] == right[j, places]).sum(axis=1)
            keep = m >= needed[k]
            i, j, m = i[keep], j[keep], m[keep]
        upto = (band + 1) * rows
        agree = (left[i, :upto] == right[j, :upto]).reshape(len(i), band + 1, rows).all(axis=2)
        keep = agree[:, band] & ~agree[:, :band].any(axis=1)
        found.append((i[keep], j[keep], m[keep]))
    return [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64)] * 3


def forest(a, b, matches, labels: list):
    """Places of the links of a spanning forest over the labels, most alike first."""
    import numpy as np

    parent: dict = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for k in np.lexsort((b, a, -matches)).tolist():
        x, y = top(labels[a[k]]), top(labels[b[k]])
        if x != y:
            parent[x] = y
            out.append(k)
    return out


def shingled(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """Per document: id, text_hash, n_shingles, cls (digest of the set, null if it is empty), sig."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, offsets = multipliers(PLACES)
        for batch in batches:
            n, cls, sig = [], [], []
            for _, texts in text_parts(batch["text"]):
                for text in texts:
                    s = shingle_set(text, width)
                    n.append(len(s))
                    cls.append(digest_of(s))
                    sig.append(signature(s, factors, offsets).tobytes() if len(s) else None)
            columns = [batch["id"], batch["text_hash"], pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(sig, pa.binary())]
            yield pa.record_batch(columns, names=["id", "text_hash", "n_shingles", "cls", "sig"])

    rows = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text_hash bigint, n_shingles bigint, cls binary, sig binary")


def full_sets(docs: DataFrame, wanted: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(cls, shingles) of the wanted classes, from the text of one document of each.

    It is found by id and hash of the text, so that rows without id, or with an id that repeats, each meet
    their own class alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for at, texts in text_parts(batch["text"]):
                sets = [shingle_set(t, width) for t in texts]
                cls = [digest_of(s) for s in sets]
                sets = [s if c == w else s[:0] for s, c, w in zip(sets, cls, batch["cls"].slice(at, len(texts)).to_pylist())]
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                flat = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
                yield pa.record_batch([pa.array(cls, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["cls", "shingles"])

    texts = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    rows = texts.join(wanted, texts["id"].eqNullSafe(wanted["pick.id"]) & (texts["text_hash"] == wanted["pick.text_hash"])).select("text", "cls")
    sets = rows.mapInArrow(run, "cls binary, shingles array<bigint>").where(F.size("shingles") > 0)
    return sets.dropDuplicates(["cls"])


def buckets(classes: DataFrame, bands: int, rows: int) -> DataFrame:
    """(band, bucket, n, cls): members of every bucket of two or more; of buckets with the same members that of the first band."""
    width = 4 * rows
    keys = F.array(*[F.struct(F.lit(b).alias("band"), F.xxhash64(F.substring("sig", 1 + b * width, width)).alias("bucket")) for b in range(bands)])
    members = classes.select("cls", F.explode(keys).alias("k")).select("k.band", "k.bucket", "cls")
    sizes = members.groupBy("band", "bucket").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("cls")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "cls")).alias("y")
    )
    one = sizes.where(F.col("n") > 1).groupBy("n", "x", "y").agg(F.min(F.struct("band", "bucket")).alias("k")).select("k.band", "k.bucket", "n")
    return members.join(one, ["band", "bucket"]).select("band", "bucket", "n", "cls")


def grouped(members: DataFrame, first_round: bool) -> DataFrame:
    """Adds the group (_i, _j) and the block _b: see the module's text on large buckets.

    In the first round a member is in the group of its own block.  Later, buckets of one
    label are left out; members of the bucket's most frequent label meet the blocks that hold
    other labels, and members of other labels meet all blocks.
    """
    k = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    rows = members.withColumn("_k", k).withColumn("_b", F.pmod(F.xxhash64("cls"), F.col("_k")).cast("int"))
    if first_round:
        return rows.withColumns({"_i": F.col("_b"), "_j": F.col("_b")}).drop("_k")
    bucket = ["band", "bucket"]
    per_label = rows.groupBy(*bucket, "label").agg(F.count(F.lit(1)).alias("_c"))
    most = per_label.groupBy(*bucket).agg(F.max(F.struct("_c", "label"))["label"].alias("_most"), F.count(F.lit(1)).alias("_labels"))
    rows = rows.join(most.where(F.col("_labels") > 1).drop("_labels"), bucket)
    minor = rows.where(F.col("label") != F.col("_most")).select(*bucket, F.col("_b").alias("_o")).distinct()
    major = rows.where(F.col("label") == F.col("_most")).join(minor, bucket)
    other = rows.where(F.col("label") != F.col("_most")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    both = major.select(*other.columns).union(other)
    return both.withColumns({"_i": F.least("_b", "_o"), "_j": F.greatest("_b", "_o")}).drop("_k", "_o", "_most")


KEYS = ["band", "bucket", "_i", "_j"]


def by_group(members: DataFrame, columns: list[str], schema: str, work) -> DataFrame:
    """``work`` on the rows of every group, none of which is much larger than two blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch[c].to_numpy().astype(np.int64) for c in KEYS], axis=1)
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

    dealt = members.repartition(shuffle_partitions(members.sparkSession), *KEYS).sortWithinPartitions(*KEYS)
    return dealt.select(*KEYS, "_b", "cls", "label", "sig", *columns).mapInArrow(run, schema)


def surviving(t, needed: list[int], rows: int):
    """(a, b, matches): places of the pairs of a group with different labels that survive, and the label codes."""
    import numpy as np

    label = np.unique(np.array([x.hex() for x in t["label"].to_pylist()]), return_inverse=True)[1]
    sig = np.frombuffer(b"".join(t["sig"].to_pylist()), dtype="<u4").reshape(len(label), -1)
    i, j, block = t["_i"][0].as_py(), t["_j"][0].as_py(), t["_b"].to_numpy()
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    a, b, m = survivors(sig[left], sig[right], i == j, lambda a, b: label[left[a]] != label[right[b]], needed, t["band"][0].as_py(), rows)
    return left[a], right[b], m, label.tolist()


def links_of(t, a, b) -> pa.RecordBatch:
    import pyarrow as pa

    cls = t["cls"].combine_chunks()
    return pa.record_batch([cls.take(pa.array(x)).cast(pa.binary()) for x in (a, b)], names=["a", "b"])


def likely_links(members: DataFrame, needed: list[int], rows: int) -> DataFrame:
    """Of every group a spanning forest of the survivors."""

    def work(t):
        a, b, m, label = surviving(t, needed, rows)
        if len(a):
            picked = forest(a, b, m, label)
            yield links_of(t, a[picked], b[picked])

    return by_group(members, [], "a binary, b binary", work)


def undecided(members: DataFrame, needed: list[int], rows: int) -> DataFrame:
    """The members, with their signatures, that have a survivor with another label in their group."""

    def work(t):
        import numpy as np

        a, b, _, _ = surviving(t, needed, rows)
        if len(a):
            yield from t.take(pa.array(np.unique(np.concatenate([a, b])))).to_batches()

    return by_group(members, [], "band int, bucket bigint, _i int, _j int, _b int, cls binary, label binary, sig binary", work)


def exact_links(members: DataFrame, needed: list[int], rows: int, percent: int) -> DataFrame:
    """Of every group a spanning forest of the survivors whose full sets (``shingles``) are alike enough."""

    def work(t):
        import numpy as np

        a, b, m, label = surviving(t, needed, rows)
        sets = t["shingles"].combine_chunks()
        sizes = np.diff(sets.offsets.to_numpy())
        values, ids = np.unique(sets.flatten().to_numpy(), return_inverse=True)
        starts, mark = np.concatenate([[0], np.cumsum(sizes)]), np.zeros(len(values), dtype=bool)
        order = np.argsort(a, kind="stable")
        good = []
        for part in np.split(order, np.flatnonzero(np.diff(a[order])) + 1):
            if not len(part):
                continue
            i, others = a[part[0]], b[part]
            mark[ids[starts[i] : starts[i + 1]]] = True
            both = np.array([np.count_nonzero(mark[ids[starts[j] : starts[j + 1]]]) for j in others])
            mark[ids[starts[i] : starts[i + 1]]] = False
            good.append(part[100 * both >= percent * (sizes[i] + sizes[others] - both)])
        good = np.concatenate([np.zeros(0, np.int64), *good])
        if len(good):
            picked = good[forest(a[good], b[good], m[good], label)]
            yield links_of(t, a[picked], b[picked])

    return by_group(members, ["shingles"], "a binary, b binary", work)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are alike enough."""
    s = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("sa"))
    t = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    counted = pairs.join(s, "a").join(t, "b").select("a", "b", both.alias("both"), (F.size("sa") + F.size("sb") - both).alias("any"))
    return counted.where(100 * F.col("both").cast("bigint") >= percent * F.col("any").cast("bigint")).select("a", "b")


def near_duplicates(
    docs: DataFrame, width: int = 3, percent: int = 85, miss: float = MISS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per document: id, n_shingles, component_id (smallest id reachable by links), kept."""
    needed = least_matches(percent / 100, PLACES, miss)
    bands, rows = banding(percent / 100)
    signed = landed(shingled(docs, width, id_col, text_col), "signatures")
    classes = landed(
        signed.where(F.col("cls").isNotNull()).groupBy("cls").agg(
            F.min("id").alias("first_id"), F.min(F.struct("id", "text_hash")).alias("pick"), F.first("sig").alias("sig")
        ),
        "classes",
    )
    members = landed(buckets(classes, bands, rows), "buckets")
    signatures = classes.select("cls", "sig")

    def sets_of(wanted: DataFrame) -> DataFrame:
        wanted = landed(wanted.join(classes.select("cls", "pick"), "cls"), "wanted")
        return landed(full_sets(docs, small(wanted), width, id_col, text_col), "sets")

    first = grouped(members.withColumn("label", F.col("cls")), True).join(signatures, "cls")
    likely = landed(likely_links(first, needed, rows).distinct(), "likely")
    sets = sets_of(likely.select(F.col("a").alias("cls")).union(likely.select("b")).distinct())
    links = landed(verified(likely, sets, percent), "verified")
    roots = components(links)

    labelled = members.join(roots.select(F.col("node").alias("cls"), F.col("root")), "cls", "left").withColumn("label", F.coalesce("root", "cls")).drop("root")
    left = landed(undecided(grouped(labelled, False).join(signatures, "cls"), needed, rows), "undecided")
    if not left.isEmpty():
        more = sets_of(left.select("cls").distinct().join(sets.select("cls"), "cls", "left_anti"))
        left = left.join(sets.union(more), "cls")
        late = landed(exact_links(left, needed, rows, percent), "late-links")
        if not late.isEmpty():
            roots = components(links.union(late))
    named = classes.select("cls", "first_id")
    placed = named.join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").select("cls", "first_id", F.coalesce("root", "cls").alias("root"))
    least = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = placed.join(least, "root").select("cls", "component_id")
    out = signed.select("id", "n_shingles", "cls").join(named, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id")).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without all but one of each component, in the order of id (null last), text's hash and row.

    Rows are told apart by their numbers in a landed copy, not by ids, so rows that repeat an id or have none
    are decided one by one: copies leave one row, other texts stay.  Only the numbers of the rows to drop are moved.
    """
    row = "_row"
    while row.lower() in {c.lower() for c in docs.columns}:
        row = f"_{row}"
    copy = landed(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    groups = near_duplicates(copy, width, percent, id_col=row, text_col=text_col)
    later = landed(groups.where(~F.col("kept")).select(F.col(row).alias("row"), F.col("component_id").alias("component")), "later")
    several = later.union(later.select(F.col("component").alias("row"), "component").distinct())
    place = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(whole(text_col)).alias("tie"), F.col(row).alias("row"))
    order = copy.select(F.col(row).alias("row"), place.alias("place"))
    several = landed(several.join(order, "row").select("component", "place"), "several")
    first = several.groupBy("component").agg(F.min("place").alias("place")).select("place.row")
    dropped = landed(several.select("place.row").join(first, "row", "left_anti"), "dropped")
    gone = small(dropped)
    return copy.join(gone, copy[row] == gone["row"], "left_anti").drop(row)


def op10_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


# Exact: pairs meet on one of a set's rarest shingles (a set of n can miss at most 15 % of n), then full sets are compared.
OP10_SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
    FROM documents
), s AS (
    SELECT DISTINCT doc_id, g FROM (
        SELECT doc_id, unnest(CASE WHEN len(words) = 0 THEN []
                                   WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
                                   ELSE [words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] for i in range(1, len(words) - 1)] END) AS g
        FROM w)
), n AS (
    SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), f AS (
    SELECT g, count(*) AS df FROM s GROUP BY g
), r AS (
    SELECT s.doc_id, s.g, n.n, row_number() OVER (PARTITION BY s.doc_id ORDER BY f.df, s.g) AS place
    FROM s JOIN f USING (g) JOIN n USING (doc_id)
), c AS (
    SELECT DISTINCT a.doc_id AS a, b.doc_id AS b
    FROM r a JOIN r b ON a.g = b.g AND a.doc_id < b.doc_id
    WHERE a.place <= a.n - (85 * a.n + 99) // 100 + 1 AND b.place <= b.n - (85 * b.n + 99) // 100 + 1
      AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
), shared AS (
    SELECT c.a, c.b, count(*) AS k FROM c JOIN s x ON x.doc_id = c.a JOIN s y ON y.doc_id = c.b AND y.g = x.g GROUP BY c.a, c.b
), link AS (
    SELECT a, b FROM shared JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 85 * (na.n + nb.n - k)
), either AS (
    SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach AS (
    SELECT a AS doc_id, a AS other FROM either
    UNION
    SELECT reach.doc_id, either.b FROM reach JOIN either ON either.a = reach.other
), comp AS (
    SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(comp.component_id, w.doc_id) AS component_id,
       w.doc_id = coalesce(comp.component_id, w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN comp USING (doc_id)
"""
