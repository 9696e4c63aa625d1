"""Document fingerprints by SimHash, and all fingerprints within a Hamming radius.

A document's terms are its lower-cased words, each together with the word after it.
Every occurrence votes, with the term's weight (longer terms are rarer and weigh more), for or
against each of 64 bits by the bits of its hash; the signs of the sums are the
fingerprint.  Sixteen long sums hold the votes: each adds up four bits of the hash at
once in fields of 16 bits, per run of ``RUN`` terms of a document, so that no field
overflows; the runs are then added in wider fields.  Nothing here leaves the JVM.

``within_radius`` cuts fingerprints into ``blocks`` blocks.  Two of them within
``radius`` bits agree in at least ``blocks - radius`` whole blocks, so there is one table for each
choice of so many blocks; rows meet in a table on the chosen blocks, put first.

Defined cases: a null text is an empty one; a text without words has the fingerprint of
all zeros; equal texts have equal fingerprints; a null id is an id of its own; rows that
repeat an id are ordered by a hash of their text, and rows that also repeat the text
are one document in the order, with a result row each; a single document is its own
next; very long texts vote in runs whose sums cannot overflow; an empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterloom.functions.skew import numbered_by_range
from rosterloom.llm.common import landed, table, whole

BITS = 64
LANES = 16  # bits i, i + 16, i + 32, i + 48 share a long
RUN_BITS = 13
RUN = 1 << RUN_BITS  # terms whose weights (3 at most) add up in 15 bits: the top field of a long holds its sign
FIELD = 0x0001000100010001
HALF = 0x0000FFFF0000FFFF


def votes(rows: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """Per ``keys``: the weight for each bit as ``v0`` .. ``v31`` (two bits in each) and the ``total`` weight.

    Every row has keys of its own: the fields hold the weights of one text.  An empty word (the
    text begins or ends with space, or is empty) has no weight, but keeps the row.
    """
    words = rows.select(*keys, F.split(F.lower(F.col(text)), r"[\x00-\x20]+").alias("_a"))
    words = words.select(*keys, "_a", F.slice("_a", F.lit(2), F.size("_a")).alias("_b"))
    single = words.select(*keys, F.posexplode(F.arrays_zip("_a", "_b")).alias("_pos", "_t"))
    length = F.length(F.col("_t._a"))
    weight = F.when(length >= 8, 3).when(length >= 4, 2).when(length >= 1, 1).otherwise(0).cast("bigint")
    single = single.select(
        *keys, F.shiftright("_pos", RUN_BITS).alias("_run"), F.xxhash64(F.col("_t._a"), F.col("_t._b")).alias("_h"), weight.alias("_w")
    )
    lanes = [F.sum(F.shiftrightunsigned("_h", i).bitwiseAND(F.lit(FIELD)) * F.col("_w")).alias(f"l{i}") for i in range(LANES)]
    runs = single.groupBy(*keys, "_run").agg(F.sum("_w").alias("_w"), *lanes)
    wide = []
    for i in range(LANES):
        wide.append(F.sum(F.col(f"l{i}").bitwiseAND(F.lit(HALF))).alias(f"v{i}"))
        wide.append(F.sum(F.shiftrightunsigned(f"l{i}", 16).bitwiseAND(F.lit(HALF))).alias(f"v{i + 16}"))
    return runs.groupBy(*keys).agg(F.sum("_w").alias("total"), *wide)


def signs(total: str = "total") -> Column:
    """The fingerprint as a long: a bit is set where more weight voted for it than against."""
    out = F.lit(0).cast("bigint")
    low = F.lit(0xFFFFFFFF)
    for i in range(32):
        for bit, count in ((i, F.col(f"v{i}").bitwiseAND(low)), (i + 32, F.shiftrightunsigned(f"v{i}", 32))):
            out = out.bitwiseOR(F.when(count * 2 > F.col(total), F.shiftleft(F.lit(1).cast("bigint"), bit)).otherwise(F.lit(0).cast("bigint")))
    return out


def as_text(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    return (F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))).cast("double")


def block_keys(fingerprint: str, radius: int, blocks: int) -> Column:
    """Array of (table, key): for each choice of ``blocks - radius`` blocks, these blocks packed together."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    out = []
    for t, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        key, shift = F.lit(0).cast("bigint"), 0
        for b in chosen:
            width = edges[b + 1] - edges[b]
            part = F.shiftrightunsigned(fingerprint, edges[b]).bitwiseAND(F.lit((1 << width) - 1))
            key, shift = key.bitwiseOR(F.shiftleft(part, shift)), shift + width
        out.append(F.struct(F.lit(t).alias("t"), key.alias("k")))
    return F.array(*out)


def within_radius(queries: DataFrame, index: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """All pairs (q, f, distance) of a query fingerprint and an index fingerprint within ``radius`` bits.

    Both inputs hold distinct fingerprints in ``fp``.  A pair that meets in several tables is
    kept in the first of them.
    """
    q = queries.select(F.col("fp").alias("q"), F.explode(block_keys("fp", radius, blocks)).alias("s")).select("q", "s.t", "s.k")
    f = index.select(F.col("fp").alias("f"), F.explode(block_keys("fp", radius, blocks)).alias("s")).select("f", "s.t", "s.k")
    x = F.col("q").bitwiseXOR(F.col("f"))
    near = F.bit_count(x) <= radius
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    equal = [x.bitwiseAND(F.lit(_signed(((1 << (b - a)) - 1) << a))) == 0 for a, b in zip(edges, edges[1:])]
    first = F.lit(None).cast("int")
    for t, chosen in reversed(list(enumerate(combinations(range(blocks), blocks - radius)))):
        every = F.lit(True)
        for b in chosen:
            every = every & equal[b]
        first = F.when(every, F.lit(t)).otherwise(first)
    joined = q.alias("a").join(f.alias("b"), (F.col("a.t") == F.col("b.t")) & (F.col("a.k") == F.col("b.k")) & near & (first == F.col("a.t")))
    return joined.select("q", "f", F.bit_count(x).alias("distance"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def edited_and_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(order, texts): per document its number, n_chars and copies; and the text with its edited text.

    The order and the lengths come from ids, lengths and hashes alone.  The texts are
    shuffled once by id; only the heads that the documents before them need are moved again.
    """
    t = whole(text_col)
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("\u0000"))
    docs = docs.select(F.col(id_col).alias("id"), key.alias("key"), F.xxhash64(t).alias("tie"), t.alias("text"))
    meta = docs.groupBy("id", "key", "tie").agg(F.max(F.char_length("text")).cast("bigint").alias("n_chars"), F.count(F.lit(1)).alias("copies"))
    order = landed(numbered_by_range(meta, [], ["id", "tie"], "number"), "order")
    n = order.count()
    head = F.floor(F.col("n_chars") / 4).cast("int")
    owner = order.select((F.col("number") % max(n, 1) + 1).alias("number"), F.col("key").alias("owner_key"), F.col("tie").alias("owner_tie"), head.alias("owner_head"))
    links = landed(order.join(owner, "number").select("key", "tie", "number", (F.col("n_chars") - head).cast("int").alias("keep"), "owner_key", "owner_tie", "owner_head"), "links")
    placed = docs.select("key", "tie", "text").join(links.hint("shuffle_hash"), ["key", "tie"])
    heads = (
        placed.select(F.col("owner_key").alias("key"), F.col("owner_tie").alias("tie"), F.substring(F.col("text"), F.lit(1), F.col("owner_head")).alias("next_head"))
        .groupBy("key", "tie").agg(F.max("next_head").alias("next_head"))
    )
    texts = placed.join(heads.hint("shuffle_hash"), ["key", "tie"])
    return order, texts.select("key", "tie", "number", "text", F.concat(F.substring(F.col("text"), F.lit(1), F.col("keep")), "next_head").alias("edited"))


def fingerprint_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, blocks: int = 6, query_every: int = 50
) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, compared with each other and with the next document's.

    ``n_near`` counts the other documents within ``radius`` bits, for the documents
    whose id ``query_every`` divides (else null); documents with one fingerprint are a class
    and are counted by its size, so copies are never paired.
    """
    order, texts = edited_and_next(docs, id_col, text_col)
    both = texts.select("key", "tie", "number", F.explode(F.array(
        F.struct(F.lit("").alias("sha"), F.col("text").alias("t")),
        F.struct(F.sha2("edited", 256).alias("sha"), F.col("edited").alias("t")),
    )).alias("x")).select("key", "tie", "number", "x.sha", "x.t", F.monotonically_increasing_id().alias("copy"))
    # rows that repeat id and text vote each by itself: their sums would outgrow the fields
    prints = votes(both, ["key", "tie", "number", "sha", "copy"], "t").select("number", "sha", signs().alias("fp"))
    own, edited = F.when(F.col("sha") == "", F.col("fp")), F.when(F.col("sha") != "", F.col("fp"))
    prints = landed(prints.groupBy("number").agg(F.max(own).alias("fp"), F.max(edited).alias("edited_fp"), F.max("sha").alias("edited_sha256")), "prints")

    members = order.select("number", "id", "copies").join(prints.select("number", "fp"), "number")
    asked = F.col("id").cast("bigint") % query_every == 0
    classes = landed(members.groupBy("fp").agg(F.sum("copies").alias("members"), F.max(asked).alias("asked")), "fingerprint-classes")
    found = within_radius(classes.where("asked"), classes, radius, blocks)
    near = found.join(classes.select(F.col("fp").alias("f"), "members"), "f").groupBy(F.col("q").alias("fp")).agg((F.sum("members") - 1).alias("n_near"))
    near = members.where(asked).join(near, "fp").select("number", "n_near")

    n = order.count()
    after = prints.select(F.when(F.col("number") == 1, n).otherwise(F.col("number") - 1).alias("number"), F.col("fp").alias("next_fp"))
    out = order.join(prints, "number").join(after, "number").join(near, "number", "left")
    return out.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select(
        F.col("id").alias(id_col),
        "n_chars",
        "edited_sha256",
        as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        "n_near",
    )


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))
