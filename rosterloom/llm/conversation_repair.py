"""Conversation structure repair: the cheapest edits that make roles read ``(system? (user assistant)+)?``.

The repair is a shortest path over the rows of a conversation and four states (nothing yet, after a
system turn, after a user turn, after an assistant turn).  It is a square-root checkpointed dynamic
programme: a conversation of n rows is cut into blocks of about the square root of n rows, and only at the
blocks' ends is the backward vector (the cost from each state to the end) stored.

1. Every block is folded into a 4 x 4 matrix of least costs (from a state before it to a state after it).
2. The matrices of a conversation, one small row per block, are multiplied from its end: the checkpoints.
3. Every block recomputes its backward vectors from its checkpoint and walks forward once for every state in
   which it may begin, at each step taking the ASCII-least edit that stays on a cheapest path (a tight one).
4. The blocks' ways are chained from the start, and the edits are put to the rows.

So a conversation that holds a third of all rows is many tasks' work; only one row per block meets in one
task.  Conversations of up to ``hot_limit`` rows share one block length, the root of that limit, as there are too many
of them for a length each.  The repaired text's digest hashes the text of a conversation in order, so its
bytes go through one task, as a stream of pieces that the blocks have made before.

Edits: Keep 0, Rerole (to user or assistant) 3, Delete 4, Insert (an empty user or assistant turn, anywhere) 3; a
truncated row that is not deleted adds 3; blank and duplicate rows are deleted.  The way is unique: given the edits' initials, the
place in the order tells every role.

Defined cases: null role or text is one space, so such text is blank and such a role never fits; rows go by turn, nulls
first, ties by ``tie`` columns; rows equal in all of these are interchangeable; a null conv_id is a conversation of its own; a
repeated row is a duplicate; very long texts are written in pieces; an empty table has no rows; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterloom.functions.joins import join_on
from rosterloom.functions.skew import carry
from rosterloom.llm.common import by_value, hot_limit, landed, shuffle_partitions, table
from rosterloom.llm.prefix_trie import CRC_CTES

by_value(__name__)

INK = r"[^\x20\x09-\x0D]"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
NEVER = 1 << 50
START, SYSTEM, USER, ASSISTANT = range(4)
# state -> initial of the next role -> state
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
PIECE = 1 << 18


def options(kind: str, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost, next state) of one row, in ASCII order; kind is the fault's initial and the role's initial."""
    fault, initial = kind[:1], kind[1:]
    if fault in "bd":
        return [("D", DELETE, state)]
    more = TRUNCATED if fault == "t" else 0
    out = [("D", DELETE, state)]
    if initial in NEXT[state]:
        out.append(("K", KEEP + more, NEXT[state][initial]))
    wanted = "a" if state == USER else "u"
    return [*out, ("R", REROLE + more, NEXT[state][wanted])]


def with_inserts(costs: list[int]) -> list[int]:
    """Cost from each state when turns may be inserted first.  Two inserts lead back to where one began."""
    one = [c if c <= costs[NEXT[s]["a" if s == USER else "u"]] + INSERT else costs[NEXT[s]["a" if s == USER else "u"]] + INSERT for s, c in enumerate(costs)]
    return [min(c, one[NEXT[s]["a" if s == USER else "u"]] + INSERT) for s, c in enumerate(one)]


def before_row(kind: str, after: Sequence[int]) -> list[int]:
    """Backward vector before a row, from the one after it."""
    return with_inserts([min(cost + after[nxt] for _, cost, nxt in options(kind, s)) for s in range(4)])


def at_end() -> list[int]:
    return with_inserts([0, NEVER, NEVER, 0])


class Steps:
    """Backward steps, remembered: vectors less their least part take few forms."""

    def __init__(self):
        self.known = {}

    def back(self, kind: str, after: Sequence[int]) -> tuple[int, ...]:
        least = min(after)
        key = (kind, *[min(x - least, NEVER) for x in after])
        if key not in self.known:
            self.known[key] = tuple(min(x, NEVER) for x in before_row(kind, key[1:]))
        return tuple(min(x + least, NEVER) for x in self.known[key])


def fold(kinds: Sequence[str], steps: Steps) -> list[tuple[int, ...]]:
    """4 x 4: least cost from each state (row) before the rows to each state (column) after them."""
    columns = []
    for end in range(4):
        vector = tuple(0 if s == end else NEVER for s in range(4))
        for kind in reversed(kinds):
            vector = steps.back(kind, vector)
        columns.append(vector)
    return list(zip(*columns))


def walk(kinds: Sequence[str], checkpoint: Sequence[int], state: int, last: bool, steps: Steps) -> tuple[str, int]:
    """ASCII-least tight edits from a state before the rows, and the state after them.

    After the last block the checkpoint is the vector at the conversation's end, and turns may be inserted there.
    """
    vectors = [tuple(checkpoint)]
    for kind in reversed(kinds):
        vectors.append(steps.back(kind, vectors[-1]))
    vectors.reverse()
    out, i = [], 0
    while i < len(kinds) or last:
        here = vectors[i][state]
        ways = options(kinds[i], state) if i < len(kinds) else []
        nxt = NEXT[state]["a" if state == USER else "u"]
        if i == len(kinds) and here == 0:
            break
        found = None
        for edit, cost, to in ways[:1]:  # D comes first in ASCII order, then I, K, R
            if cost + vectors[i + 1][to] == here:
                found = edit, to, 1
        if found is None and INSERT + vectors[i][nxt] == here:
            found = "I", nxt, 0
        for edit, cost, to in ways[1:]:
            if found is None and cost + vectors[i + 1][to] == here:
                found = edit, to, 1
        if found is None:
            raise ValueError("no tight edit")
        out.append(found[0])
        state, i = found[1], i + found[2]
    return "".join(out), state


def grouped_rows(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Runs of rows with equal first columns, from sorted batches; each run is an iterator."""
    from itertools import groupby

    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
    for key, run in groupby(rows, key=lambda r: r[:keys]):
        yield key, (r[keys:] for r in run)


def out_batches(rows: Iterable[tuple], names: Sequence[str], kinds: Sequence, size: int = 2000) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``size`` rows."""
    from itertools import islice

    import pyarrow as pa

    rows = iter(rows)
    while part := list(islice(rows, size)):
        yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*part), kinds)], names=list(names))


def placed_rows(rows: DataFrame, tie: Sequence[str]) -> DataFrame:
    """conv_id, pos, block, turn, role, text, initial, digest, blank, cut, before: rows in order, with their block."""
    sizes = landed(rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")), "repair-sizes")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    limit = hot_limit(total)
    root = lambda n: F.ceil(F.sqrt(n)).cast("bigint")
    long = sizes.where(F.col("n") > limit).select(F.col("conv_id").alias("_long"), root(F.col("n")).alias("_length"))  # fewer than HOT_KEYS
    initial = F.substring("role", 1, 1)
    last_sign = F.regexp_extract("text", rf"({INK})[\x20\x09-\x0D]*\z", 1)
    rows = rows.select(
        "conv_id", "turn", *tie, "role", "text", initial.alias("initial"), F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")).alias("digest"),
        (last_sign == "").alias("blank"), (~last_sign.isin(".", "!", "?")).alias("cut"),
    )
    rows = carry(rows, ["conv_id"], ["turn", *tie], number="pos", lag={"before": F.col("initial")})
    rows = rows.join(F.broadcast(long), F.col("conv_id").eqNullSafe(F.col("_long")) & F.col("_length").isNotNull(), "left")
    length = F.coalesce("_length", root(F.lit(limit)))
    return landed(rows.withColumn("block", F.floor((F.col("pos") - 1) / length).cast("bigint")).drop("_long", "_length", *tie), "repair-rows")


def kinds_of(placed: DataFrame) -> DataFrame:
    """conv_id, block, pos, kind: first fault (b, d, t or -) and role initial."""
    first = placed.groupBy("conv_id", "digest").agg(F.min("pos").alias("pos")).select(F.col("conv_id").alias("_c"), F.col("pos").alias("_p"))
    seen = placed.select("conv_id", "block", "pos", "initial", "blank", "cut").join(first, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("pos") == F.col("_p")), "left")
    fault = F.when(F.col("blank"), "b").when(F.col("_p").isNull(), "d").when(F.col("cut"), "t").otherwise("-")
    return landed(seen.select("conv_id", "block", "pos", F.concat(fault, "initial").alias("kind")), "repair-kinds")


def block_ways(kinds: DataFrame) -> DataFrame:
    """conv_id, block, letters, state, cost: the edits of every block, the state it begins in, and at a first block the whole cost."""
    n = shuffle_partitions(kinds.sparkSession)
    key = dict(kinds.dtypes)["conv_id"]

    def folded(batches):
        import pyarrow as pa

        steps = Steps()
        rows = ((*k, [x for row in fold([r[1] for r in run], steps) for x in row]) for k, run in grouped_rows(batches, 2))
        yield from out_batches(rows, ["conv_id", "block", "matrix"], (pa.int64(), pa.int64(), pa.list_(pa.int64())))

    def chained(batches):
        import pyarrow as pa

        def checkpoints():
            for (conv,), blocks in grouped_rows(batches, 1):
                after, last = at_end(), True
                for block, matrix in blocks:
                    yield conv, block, list(after), last
                    after = [min(min(matrix[4 * s + t] + after[t] for t in range(4)), NEVER) for s in range(4)]
                    last = False

        yield from out_batches(checkpoints(), ["conv_id", "block", "checkpoint", "last"], (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.bool_()))

    def walked(batches):
        import pyarrow as pa

        steps = Steps()

        def ways():
            for (conv, block), run in grouped_rows(batches, 2):
                head, *rows = run  # the checkpoint's row has position 0
                checkpoint, last, row_kinds = head[2], head[3], [r[1] for r in rows]
                begins = range(4) if block else (START,)
                found = [walk(row_kinds, checkpoint, s, last, steps) for s in begins]
                cost = None
                if not block:
                    vector = tuple(checkpoint)
                    for kind in reversed(row_kinds):
                        vector = steps.back(kind, vector)
                    cost = vector[START]
                yield conv, block, [w for w, _ in found], [s for _, s in found], cost

        yield from out_batches(ways(), ["conv_id", "block", "letters", "ends", "cost"], (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.int64()))

    def chosen(batches):
        import pyarrow as pa

        def picks():
            for (conv,), blocks in grouped_rows(batches, 1):
                state = START
                for block, letters, ends, cost in blocks:
                    yield conv, block, letters[state], state, cost
                    state = ends[state]

        yield from out_batches(picks(), ["conv_id", "block", "letters", "state", "cost"], (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()))

    by_block = kinds.repartition(n, "conv_id", "block").sortWithinPartitions("conv_id", "block", "pos").select("conv_id", "block", "pos", "kind")
    matrices = by_block.mapInArrow(folded, f"conv_id {key}, block bigint, matrix array<bigint>")
    back = matrices.repartition(n, "conv_id").sortWithinPartitions("conv_id", F.col("block").desc())
    points = back.mapInArrow(chained, f"conv_id {key}, block bigint, checkpoint array<bigint>, last boolean")
    nothing = [F.lit(None).cast("array<bigint>").alias("checkpoint"), F.lit(None).cast("boolean").alias("last")]
    zero = F.lit(0).cast("bigint")
    both = points.select("conv_id", "block", zero.alias("pos"), F.lit("").alias("kind"), "checkpoint", "last").unionByName(kinds.select("conv_id", "block", "pos", "kind", *nothing))
    both = both.repartition(n, "conv_id", "block").sortWithinPartitions("conv_id", "block", "pos")
    ways = both.mapInArrow(walked, f"conv_id {key}, block bigint, letters array<string>, ends array<bigint>, cost bigint")
    forth = ways.repartition(n, "conv_id").sortWithinPartitions("conv_id", "block")
    return landed(forth.mapInArrow(chosen, f"conv_id {key}, block bigint, letters string, state bigint, cost bigint"), "repair-ways")


def repaired_pieces(placed: DataFrame, ways: DataFrame) -> DataFrame:
    """conv_id, block, seq, lines, piece, audit: the repaired ``role:text`` lines of every block, in pieces of about ``PIECE`` bytes."""
    n = shuffle_partitions(placed.sparkSession)
    key = dict(placed.dtypes)["conv_id"]

    def edited(batches):
        import pyarrow as pa

        def pieces():
            for (conv, block), run in grouped_rows(batches, 2):
                _, letters, _, state = next(run)  # the way has position 0
                seq, held, size, audit = 0, [], 0, letters
                for edit in letters:
                    _, role, text, _ = next(run) if edit != "I" else (None, "", "", None)
                    if edit == "D":
                        continue
                    if edit != "K":
                        role = "assistant" if state == USER else "user"
                    state = NEXT[state][role[:1]]
                    held.append(f"{role}:{text}")
                    size += len(held[-1])
                    if size > PIECE:
                        yield conv, block, seq, len(held), "\n".join(held), audit
                        seq, held, size, audit = seq + 1, [], 0, ""
                if held or audit:
                    yield conv, block, seq, len(held), "\n".join(held), audit

        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.large_string(), pa.large_string())
        yield from out_batches(pieces(), ["conv_id", "block", "seq", "lines", "piece", "audit"], kinds, size=50)

    zero = F.lit(0).cast("bigint")
    heads = ways.select("conv_id", "block", zero.alias("pos"), F.col("letters").alias("role"), F.lit(None).cast("string").alias("text"), "state")
    rows = placed.select("conv_id", "block", "pos", "role", "text", F.lit(None).cast("bigint").alias("state"))
    both = heads.unionByName(rows).repartition(n, "conv_id", "block").sortWithinPartitions("conv_id", "block", "pos")
    return both.mapInArrow(edited, f"conv_id {key}, block bigint, seq bigint, lines bigint, piece string, audit string")


def repairs(pieces: DataFrame) -> DataFrame:
    """conv_id, audit, repaired_sha256."""
    n = shuffle_partitions(pieces.sparkSession)
    key = dict(pieces.dtypes)["conv_id"]

    def hashed(batches):
        import hashlib

        import pyarrow as pa

        def rows():
            for (conv,), run in grouped_rows(batches, 1):
                sha, lines, audit = hashlib.sha256(), 0, []
                for _, _, n_lines, piece, letters in run:
                    if n_lines:
                        sha.update((("\n" if lines else "") + piece).encode())
                    lines += n_lines
                    audit.append(letters)
                yield conv, "".join(audit), sha.hexdigest()

        yield from out_batches(rows(), ["conv_id", "audit", "repaired_sha256"], (pa.int64(), pa.large_string(), pa.string()))

    rows = pieces.repartition(n, "conv_id").sortWithinPartitions("conv_id", "block", "seq")
    return rows.mapInArrow(hashed, f"conv_id {key}, audit string, repaired_sha256 string")


def structure(placed: DataFrame, kinds: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal."""
    legal = F.concat("before", "initial").isin("su", "ua", "au")
    turns = placed.where(F.col("turn").isNotNull()).groupBy("conv_id", "turn").agg(
        F.count(F.lit(1)).alias("_n")
    ).groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).alias("gaps"))
    pairs = placed.groupBy("conv_id").agg(F.count_if(F.col("before").isNotNull() & ~legal).alias("illegal"))
    fault = lambda f, name: F.count_if(F.substring("kind", 1, 1) == f).alias(name)
    faults = kinds.groupBy("conv_id").agg(fault("b", "blank"), fault("d", "duplicate"), fault("t", "truncated"))
    return join_on(join_on(faults, pairs, "conv_id"), turns, "conv_id", "left").fillna({"gaps": 0})


def repair(rows: DataFrame, conversations: DataFrame, tie: Sequence[str] = ()) -> DataFrame:
    """Audit of every conversation of ``conversations`` (conv_id), from its ``rows`` (conv_id, turn, role, text and ``tie``).

    Returns conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = rows.select("conv_id", "turn", *tie, blank("role").alias("role"), blank("text").alias("text"))
    placed = placed_rows(rows, tie)
    kinds = kinds_of(placed)
    ways = block_ways(kinds)
    costs = ways.where("cost IS NOT NULL").select("conv_id", "cost")
    found = join_on(join_on(structure(placed, kinds), costs, "conv_id"), repairs(repaired_pieces(placed, ways)), "conv_id", "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    out = join_on(conversations.select("conv_id").distinct(), found, "conv_id", "left")
    return out.select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows damaged by crc32(conv_id:turn) % 20 (nulls: one space): 0 drops the row, 1 empties its text, 2 removes its
    ``[.!?]``, 3 repeats it, 4 sets role user.  ``tie`` is a hash of the row as it was.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    by = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    role, text = shown("role"), shown("text")
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), by.alias("_by")).where("_by <> 0")
    rows = rows.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn",
        F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")).alias("tie"),
        F.when(F.col("_by") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_by") == 1, "").when(F.col("_by") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("_by") == 3, 2).otherwise(1).alias("_times"),
    )
    return rows.select("*", F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_copy")).drop("_times", "_copy")


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return repair(damaged(conversations), conversations, ["tie"])


def _sql() -> str:
    """The same by a plain backward recursion over whole conversations; a state's value is its cost in nine digits and its edits."""
    add = lambda edit, cost, v: f"(lpad(CAST(CAST(substr({v}, 1, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || '{edit}' || substr({v}, 10))"
    more = f"(CASE fault WHEN 't' THEN {TRUNCATED} ELSE 0 END)"
    whole = "fault NOT IN ('b', 'd')"
    keep = lambda initial, v: f"CASE WHEN {whole} AND initial = '{initial}' THEN {add('K', more, v)} END"
    rerole = lambda v: f"CASE WHEN {whole} THEN {add('R', f'{REROLE} + {more}', v)} END"
    raw = {
        "st": [add("D", DELETE, "st"), keep("s", "sy"), keep("u", "us"), rerole("us")],
        "sy": [add("D", DELETE, "sy"), keep("u", "us"), rerole("us")],
        "us": [add("D", DELETE, "us"), keep("a", "aa"), rerole("aa")],
        "aa": [add("D", DELETE, "aa"), keep("u", "us"), rerole("us")],
    }
    least = ", ".join(f"least({', '.join(v)}) AS {k}" for k, v in raw.items())
    order = "turn NULLS FIRST, tie, copy"
    return rf"""
WITH RECURSIVE signs AS (
    SELECT DISTINCT coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS s FROM conversations
), {CRC_CTES}, whole AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, crc % 20 AS k
    FROM conversations JOIN crcs ON s = coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')
), damaged AS (
    SELECT conv_id, turn, copy, md5(CAST(length(role) AS VARCHAR) || ':' || role || text) AS tie, CASE k WHEN 4 THEN 'user' ELSE role END AS role,
           CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM whole, (VALUES (1), (2)) copies(copy) WHERE k <> 0 AND (copy = 1 OR k = 3)
), placed AS (
    SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY {order}) AS pos,
           lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY {order}) AS before,
           row_number() OVER (PARTITION BY conv_id, role, text ORDER BY {order}) AS again,
           regexp_extract(text, '([^ 	-
])[ 	-
]*\z', 1) AS last_sign
    FROM damaged
), kinds AS (
    SELECT *, CASE WHEN last_sign = '' THEN 'b' WHEN again > 1 THEN 'd' WHEN last_sign NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS fault FROM placed
), counts AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
           count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
    FROM kinds GROUP BY conv_id
), back(conv_id, pos, st, sy, us, aa) AS (
    SELECT conv_id, n + 1, '000000000', '000000006II', '000000003I', '000000000' FROM counts
    UNION ALL
    SELECT conv_id, pos, least(st, {add('I', INSERT, 'u1')}), least(sy, {add('I', INSERT, 'u1')}), u1, least(aa, {add('I', INSERT, 'us')})
    FROM (SELECT *, least(us, {add('I', INSERT, 'aa')}) AS u1
          FROM (SELECT kinds.conv_id, kinds.pos, {least} FROM back JOIN kinds ON kinds.conv_id IS NOT DISTINCT FROM back.conv_id AND kinds.pos = back.pos - 1))
), best AS (
    SELECT conv_id, CAST(substr(st, 1, 9) AS BIGINT) AS cost, substr(st, 10) AS audit FROM back WHERE pos = 1
), edits AS (
    SELECT conv_id, i, substr(audit, i, 1) AS e FROM best, unnest(range(1, length(audit) + 1)) places(i)
), numbered AS (
    SELECT *, count(*) FILTER (e <> 'I') OVER (PARTITION BY conv_id ORDER BY i) AS row_no, count(*) FILTER (e <> 'D') OVER (PARTITION BY conv_id ORDER BY i) AS out_no FROM edits
), met AS (
    SELECT numbered.*, role, text, max(CASE WHEN e = 'K' AND out_no = 1 AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY numbered.conv_id) AS has_system
    FROM numbered LEFT JOIN kinds ON kinds.conv_id IS NOT DISTINCT FROM numbered.conv_id AND kinds.pos = row_no AND e <> 'I'
), repaired AS (
    SELECT conv_id, sha256(string_agg(CASE WHEN e = 'K' THEN role WHEN (out_no - has_system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY i)) AS sha
    FROM met WHERE e <> 'D' GROUP BY conv_id
)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM ids.conv_id
LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN repaired ON repaired.conv_id IS NOT DISTINCT FROM ids.conv_id
"""


OP13_SQL = _sql()
