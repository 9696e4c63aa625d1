"""Conversation prefix trie: shared prefixes of conversations as nodes, subtrees by an Euler tour.

A node is a distinct sequence of first turns (role, text).  It is told by its depth and two 64-bit exclusive
ors over hashes of (position, turn), which a running state gives for every turn, so a conversation
of any length is never in one task; it is named by its smallest member and its depth.

Subtrees are read off an Euler tour.  Every node has an enter and an exit arc, and each arc knows the
one before it: a node is entered from its previous sibling's exit or its parent's enter, and left
from its last child's exit or its own enter.  The list is ranked distributedly: arcs chosen by a hash, one in
``SPLIT``, are splitters; all arcs jump along their pointers, with doubling steps, until
they point at a splitter, which takes a logarithmic number of rounds; the splitters are a list ``SPLIT`` times
shorter and are ranked in the same way.  A list of at most ``LAST`` splitters is walked by one task.  Prefix sums
over the positions then give each subtree as the difference between its exit and its enter arc.
Every round is written to the shared folder, so a lost executor repeats one round at most.

Defined cases: null role or text is empty; turns of a conversation go by turn, nulls first, ties by the md5 of role and
text; repeated rows are turns of their own; rows without conv_id belong to no conversation; a conversation
without turns is a member of the root and ends there; an empty table has no nodes; very long texts and
conversations change nothing, as only hashes and word counts of texts are kept; further columns are not looked at.
The digest of a node's ends hashes their numbers in order, so the bytes of one node go through one
task, as a stream of pieces of ``PIECE`` bytes that many tasks have made before.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterloom.functions.skew import carry
from rosterloom.llm.common import by_value, join_groups, landed, shuffle_partitions, table

by_value(__name__)

WORDS = r"[^\x20\x09-\x0D]+"
SPLIT = 16
LAST = 1 << 16
PIECE = 1 << 16
NODE = ["depth", "x1", "x2"]
ARC = ["c", "d", "out"]


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), turn_hash, words: the turns in order, without their texts."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        "turn",
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("turn_hash"),
        F.regexp_count(text, F.lit(WORDS)).cast("bigint").alias("words"),
    )
    turns = carry(turns, ["conv_id"], ["turn", "turn_hash"], number="pos")
    return landed(turns.select("conv_id", "pos", "turn_hash", "words"), "turns")


def prefixes(turns: DataFrame, order: list[str]) -> DataFrame:
    """conv_id, depth, words and the node and parent keys of every turn."""
    steps = carry(turns, ["conv_id"], order, number="depth")
    marks = {"x1": F.xxhash64("depth", "turn_hash"), "x2": F.xxhash64("turn_hash", F.lit("second"), "depth")}
    steps = carry(steps, ["conv_id"], ["depth"], xors=marks)
    above = [F.col(k).bitwiseXOR(marks[k]).alias(f"p_{k}") for k in marks]
    return landed(steps.select("conv_id", "depth", "words", "x1", "x2", *above), "prefixes")


def trie_nodes(steps: DataFrame, members: DataFrame) -> DataFrame:
    """One row per node: keys, conv_id, parent_conv_id, n_convs, words, n_children, last_child."""
    nodes = steps.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"),
        F.max("p_x1").alias("p_x1"), F.max("p_x2").alias("p_x2"),
    )
    zero = F.lit(0).cast("bigint")
    root = members.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(
        zero.alias("depth"), zero.alias("x1"), zero.alias("x2"), "conv_id", "n_convs", zero.alias("words"),
        F.lit(None).cast("bigint").alias("p_x1"), F.lit(None).cast("bigint").alias("p_x2"),
    )
    nodes = landed(nodes.unionByName(root), "nodes")
    kids = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p_x1").alias("x1"), F.col("p_x2").alias("x2"))
    kids = kids.agg(F.count(F.lit(1)).alias("n_children"), F.max("conv_id").alias("last_child"))
    nodes = landed(nodes.join(kids, NODE, "left").fillna({"n_children": 0}), "nodes")
    parents = nodes.where("n_children > 0").select(
        (F.col("depth") + 1).alias("depth"), F.col("x1").alias("p_x1"), F.col("x2").alias("p_x2"), F.col("conv_id").alias("parent_conv_id"), "n_children"
    )
    n = nodes.count()
    below = join_groups(nodes.withColumnRenamed("n_children", "_kids"), parents, ["depth", "p_x1", "p_x2"], "n_children", n, "conv_id")
    return landed(below.withColumnRenamed("_kids", "n_children").drop("p_x1", "p_x2"), "nodes")


def tour(nodes: DataFrame) -> DataFrame:
    """The arcs of the Euler tour: c, d, out and the arc before (p_c, p_d, p_out; null for the first)."""
    n = shuffle_partitions(nodes.sparkSession)
    sides = carry(nodes, ["parent_conv_id", "depth"], ["conv_id"], lag={"sibling": F.col("conv_id")}, ranges=n)
    enter = sides.select(
        F.col("conv_id").alias("c"), F.col("depth").alias("d"), F.lit(False).alias("out"),
        F.coalesce("sibling", "parent_conv_id").alias("p_c"),
        F.when(F.col("sibling").isNotNull(), F.col("depth")).when(F.col("depth") > 0, F.col("depth") - 1).alias("p_d"),
        F.when(F.col("depth") > 0, F.col("sibling").isNotNull()).alias("p_out"),
    )
    leave = nodes.select(
        F.col("conv_id").alias("c"), F.col("depth").alias("d"), F.lit(True).alias("out"),
        F.coalesce("last_child", "conv_id").alias("p_c"),
        F.when(F.col("last_child").isNotNull(), F.col("depth") + 1).otherwise(F.col("depth")).alias("p_d"),
        F.col("last_child").isNotNull().alias("p_out"),
    )
    return landed(enter.unionByName(leave).withColumn("w", F.when(F.col("p_c").isNull(), 0).otherwise(1).cast("bigint")), "tour")


def ranked(arcs: DataFrame, level: int = 0, split: int = SPLIT, last: int = LAST) -> DataFrame:
    """(c, d, out, rank): how far each arc is from the one without an arc before."""
    head = arcs.where(F.col("p_c").isNull()).select(*ARC)  # one row
    first = head.head()
    if first is None:
        return arcs.select(*ARC, F.col("w").alias("rank"))
    key = lambda p: [F.col(f"{p}{c}") for c in ARC]
    is_first = lambda p: F.lit(True) & (F.col(f"{p}c") == first.c) & (F.col(f"{p}d") == first.d) & (F.col(f"{p}out") == first.out)
    chosen = lambda p: (F.pmod(F.xxhash64(F.lit(level), *key(p)), F.lit(split)) == 0) | is_first(p)
    rows = arcs
    while True:
        halt = F.col("p_c").isNull() | chosen("p_")
        going = rows.where(~halt)
        if going.isEmpty():
            break
        step = rows.select(*[F.col(c).alias(f"_{c}") for c in rows.columns])
        met = going.join(step, [going[f"p_{c}"] == step[f"_{c}"] for c in ARC]).select(
            *ARC, *[F.col(f"_p_{c}").alias(f"p_{c}") for c in ARC], (F.col("w") + F.col("_w")).alias("w")
        )
        rows = landed(rows.where(halt).unionByName(met), f"tour-{level}")
    splitters = landed(rows.where(chosen("")), f"splitters-{level}")
    places = walked(splitters) if splitters.count() <= last else ranked(splitters, level + 1, split, last)
    before = places.select(*[F.col(c).alias(f"_{c}") for c in ARC], F.col("rank").alias("_rank"))
    joined = rows.where(F.col("p_c").isNotNull()).join(before, [F.col(f"p_{c}") == F.col(f"_{c}") for c in ARC])
    joined = joined.select(*ARC, (F.col("w") + F.col("_rank")).alias("rank"))
    return landed(joined.unionByName(rows.where(F.col("p_c").isNull()).select(*ARC, F.col("w").alias("rank"))), f"ranks-{level}")


def walked(splitters: DataFrame) -> DataFrame:
    """Ranks of a list of at most ``LAST`` rows, by one task."""

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        after, at = {}, None
        for b in batches:
            for c, d, out, pc, pd, pout, w in zip(*(x.to_pylist() for x in b.columns)):
                if pc is None:
                    at = (c, d, out)
                else:
                    after[pc, pd, pout] = (c, d, out, w)
        rows, rank = [], 0
        while at is not None:
            rows.append((*at, rank))
            nxt = after.get(at)
            at, rank = (nxt[:3], rank + nxt[3]) if nxt else (None, rank)
        columns = list(zip(*rows)) or [[]] * 4
        yield pa.record_batch([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.bool_(), pa.int64()))], names=["c", "d", "out", "rank"])

    rows = splitters.select("c", "d", "out", "p_c", "p_d", "p_out", "w").coalesce(1)
    return landed(rows.mapInArrow(walk, "c bigint, d bigint, out boolean, rank bigint"), "walked")


def subtrees(nodes: DataFrame, ranks: DataFrame) -> DataFrame:
    """conv_id, depth, n_leaves, saved_tokens: differences of the prefix sums at a node's two arcs."""
    own = nodes.select(
        F.col("conv_id").alias("c"), F.col("depth").alias("d"), F.lit(False).alias("out"),
        (F.col("n_children") == 0).cast("bigint").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
    )
    weighted = ranks.join(own, ARC, "left").fillna({"leaf": 0, "saved": 0})
    sums = carry(landed(weighted, "tour-weights"), [], ["rank"], sums={"leaves": F.col("leaf"), "all_saved": F.col("saved")})
    return sums.groupBy(F.col("c").alias("conv_id"), F.col("d").alias("depth")).agg(
        (F.max("leaves") - F.min("leaves") + F.max("leaf")).alias("n_leaves"),
        (F.max("all_saved") - F.min("all_saved") + F.max("saved")).alias("saved_tokens"),
    )


def ends_digests(steps: DataFrame, members: DataFrame) -> DataFrame:
    """(node key, ends_sha256) of the nodes at which conversations end."""
    n = shuffle_partitions(steps.sparkSession)
    last = steps.groupBy("conv_id").agg(F.max(F.struct("depth", "x1", "x2")).alias("e"))
    ends = members.join(last, "conv_id", "left").select(*[F.coalesce(F.col(f"e.{k}"), F.lit(0)).cast("bigint").alias(k) for k in NODE], "conv_id")

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        def batch(rows):
            kinds = (pa.int64(),) * 4 + (pa.string(),)
            return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=["depth", "x1", "x2", "first", "piece"])

        key, first, held, size, rows = None, None, [], 0, []
        for b in batches:
            for *k, c in zip(*(x.to_pylist() for x in b.columns)):
                if held and (k != key or size > PIECE):
                    rows.append((*key, first, ",".join(held)))
                    held, size = [], 0
                    if len(rows) >= 1000:
                        yield batch(rows)
                        rows = []
                if not held:
                    key, first = k, c
                held.append(str(c))
                size += len(held[-1]) + 1
        if held:
            rows.append((*key, first, ",".join(held)))
        if rows:
            yield batch(rows)

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        import pyarrow as pa

        def batch(rows):
            kinds = (pa.int64(),) * 3 + (pa.string(),)
            return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=["depth", "x1", "x2", "ends_sha256"])

        key, sha, rows = None, None, []
        for b in batches:
            for *k, piece in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 4))):
                if k != key:
                    if key is not None:
                        rows.append((*key, sha.hexdigest()))
                    key, sha = k, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(piece.encode())
                if len(rows) >= 1000:
                    yield batch(rows)
                    rows = []
        if key is not None:
            rows.append((*key, sha.hexdigest()))
        if rows:
            yield batch(rows)

    cut = ends.repartitionByRange(n, *NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    made = cut.mapInArrow(pieces, "depth bigint, x1 bigint, x2 bigint, first bigint, piece string")
    made = made.repartition(n, *NODE).sortWithinPartitions(*NODE, "first")
    return made.mapInArrow(digests, "depth bigint, x1 bigint, x2 bigint, ends_sha256 string")


def trie(steps: DataFrame, members: DataFrame) -> DataFrame:
    """The nodes of the trie of ``steps`` (see ``prefixes``) and ``members`` (conv_id, distinct)."""
    nodes = trie_nodes(steps, members)
    sums = subtrees(nodes, ranked(tour(nodes)))
    nothing = F.sha2(F.lit(""), 256)
    return (
        nodes.join(sums, ["conv_id", "depth"])
        .join(ends_digests(steps, members), NODE, "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", F.col("n_children").cast("bigint").alias("n_children"),
            "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
        )
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations (conv_id, turn, role, text) as they are."""
    turns = numbered_turns(conversations)
    return trie(prefixes(turns, ["pos"]), landed(turns.select("conv_id").distinct(), "members"))


def borrowed(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations: each begins with the first h turns of its base, the last multiple of ``every``
    toward zero, then its own turns after its first h; h = crc32(conv_id) % ``most``.

    A base lends to fewer than ``2 * every`` conversations, ``most`` - 1 turns at most.
    """
    lent = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    members = landed(turns.select("conv_id").distinct(), "members")
    own = turns.where(F.col("pos") > lent).select("conv_id", F.lit(1).alias("part"), "pos", "turn_hash", "words")
    heads = turns.where((F.col("conv_id") % every == 0) & (F.col("pos") < most)).select(F.col("conv_id").alias("base"), "pos", "turn_hash", "words")
    begun = members.select("conv_id", lent.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("base")).join(heads, "base")
    begun = begun.where(F.col("pos") <= F.col("h")).select("conv_id", F.lit(0).alias("part"), "pos", "turn_hash", "words")
    return landed(begun.unionByName(own), "rebuilt"), members


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    rebuilt, members = borrowed(numbered_turns(table(spark, sf_dir, "conversations")))
    return trie(prefixes(rebuilt, ["part", "pos"]), members)


# the usual CRC-32 of decimal ids, byte by byte: table of the 256 remainders, then one step per sign
CRC_CTES = """
bits(b, k, v) AS (
    SELECT CAST(range AS BIGINT), 0, CAST(range AS BIGINT) FROM range(256)
    UNION ALL
    SELECT b, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM bits WHERE k < 8
), remainders AS (
    SELECT b, v FROM bits WHERE k = 8
), crc_steps(s, i, v) AS (
    SELECT s, 0, CAST(4294967295 AS BIGINT) FROM signs
    UNION ALL
    SELECT s, i + 1, xor(crc_steps.v // 256, remainders.v)
    FROM crc_steps JOIN remainders ON remainders.b = xor(crc_steps.v % 256, CAST(ascii(substr(s, i + 1, 1)) AS BIGINT))
    WHERE i < length(s)
), crcs AS (
    SELECT s, xor(v, 4294967295) AS crc FROM crc_steps WHERE i = length(s)
)"""

OP12_SQL = rf"""
WITH RECURSIVE ids AS (
    SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL
), signs AS (
    SELECT CAST(conv_id AS VARCHAR) AS s FROM ids
), {CRC_CTES}, hashed AS (
    SELECT conv_id, turn, md5(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS t,
           CAST(len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS BIGINT) AS words
    FROM conversations WHERE conv_id IS NOT NULL
), turns AS (
    SELECT conv_id, t, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, t) AS pos FROM hashed
), lent AS (
    SELECT conv_id, conv_id - conv_id % 20 AS base, crc % 4 AS h FROM ids JOIN crcs ON s = CAST(conv_id AS VARCHAR)
), rebuilt AS (
    SELECT lent.conv_id, 0 AS part, pos, t, words FROM lent JOIN turns ON turns.conv_id = lent.base AND pos <= h
    UNION ALL
    SELECT lent.conv_id, 1, pos, t, words FROM lent JOIN turns ON turns.conv_id = lent.conv_id AND pos > h
), steps AS (
    SELECT conv_id, words, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth,
           string_agg(t, '') OVER (PARTITION BY conv_id ORDER BY part, pos) AS key
    FROM rebuilt
    UNION ALL
    SELECT conv_id, 0, 0, '' FROM ids
), nodes AS (
    SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words FROM steps GROUP BY ALL
), linked AS (
    SELECT n.*, p.key AS parent_key, q.conv_id AS parent_conv_id
    FROM nodes n LEFT JOIN steps p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1 LEFT JOIN nodes q ON q.depth = p.depth AND q.key = p.key
), kids AS (
    SELECT depth - 1 AS depth, parent_key AS key, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY ALL
), filled AS (
    SELECT linked.*, coalesce(n_children, 0) AS n_children FROM linked LEFT JOIN kids ON kids.depth = linked.depth AND kids.key = linked.key
), sums AS (
    SELECT s.depth, s.key, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum((n_convs - 1) * f.words) AS BIGINT) AS saved_tokens
    FROM filled f JOIN steps s ON s.conv_id = f.conv_id AND s.depth <= f.depth GROUP BY ALL
), ends AS (
    SELECT depth, key, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends
    FROM (SELECT conv_id, max(depth) AS depth, arg_max(key, depth) AS key FROM steps GROUP BY conv_id) GROUP BY ALL
)
SELECT f.conv_id, f.depth, f.parent_conv_id, f.n_convs, f.n_children, sums.n_leaves, sums.saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM filled f JOIN sums ON sums.depth = f.depth AND sums.key = f.key LEFT JOIN ends ON ends.depth = f.depth AND ends.key = f.key
"""
