"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

A pre-token is its bytes.  Each position that begins a live part holds the rank of merging that part with the
next (none: ``NO_RANK``).  The segment tree's leaves are these ranks, and each inner node
stores the least of ``rank * size + position`` below it, so the root is the leftmost pair of minimum
rank.  A merge joins two parts, unlinks the right one from its neighbours, and updates the three leaves
that changed with their paths to the root, a logarithmic number of nodes.

The trees of many short pre-tokens are kept side by side in one array and each round merges
once in every tree that still has a pair.  Long pre-tokens have a tree of their own.  Which
two parts merge is looked up by their ids among all splits of a vocabulary entry into two entries.

Defined cases: a null text is an empty one without ids (and the digest of nothing); special tokens are not
known; very long texts are encoded whole, and a very long match of the pattern by one segment tree; rows that repeat an
id, or have none, have a result each; an empty table gives no rows; further columns are kept out of the result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterloom.llm.common import by_value, table, whole, worker_store
from rosterloom.llm.pretokens import PreTokens, text_parts

by_value(__name__)

NO_RANK = 1 << 30
SHORT = 64  # bytes; longer pre-tokens have a tree of their own


def read_ranks(path: str) -> list[bytes]:
    """The vocabulary of a rank file: entry i has rank and id i."""
    import base64

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    vocabulary = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        vocabulary[rank] = token
    return vocabulary


class Ranks:
    """Vocabulary with its merges: (left id, right id) -> merged id, which is the merge's rank."""

    def __init__(self, vocabulary: list[bytes]):
        import numpy as np

        self.vocabulary = vocabulary
        self.id_of = {t: i for i, t in enumerate(vocabulary) if t}
        self.alone = {t: i.to_bytes(4, "little") for t, i in self.id_of.items()}
        self.byte_id = np.array([self.id_of[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {}
        for token, merged in self.id_of.items():
            for cut in range(1, len(token)):
                left, right = self.id_of.get(token[:cut]), self.id_of.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = merged
        self.pairs = pairs
        keys = np.fromiter(pairs, dtype=np.int64, count=len(pairs))
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.merged = np.append(np.fromiter(pairs.values(), dtype=np.int64, count=len(pairs))[order], NO_RANK)

    def ranks_of(self, left, right):
        """Rank (and id) of merging each pair, ``NO_RANK`` where the vocabulary has none."""
        import numpy as np

        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.merged[at], NO_RANK)


def encode_long(token: bytes, ranks: Ranks) -> bytes:
    """Ids (32-bit) of one pre-token by a segment tree of its own."""
    import numpy as np

    n = len(token)
    size = 1 << max(n - 1, 1).bit_length()
    ids = ranks.byte_id[list(token)].tolist()
    follows, before = list(range(1, n + 1)), list(range(-1, n - 1))
    none = NO_RANK * size
    merge_of = ranks.pairs.get
    tree = [none] * (2 * size)
    for i in range(n - 1):
        tree[size + i] = merge_of(ids[i] << 32 | ids[i + 1], NO_RANK) * size + i
    for node in range(size - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])

    def put(i: int) -> None:
        j = follows[i]
        rank = merge_of(ids[i] << 32 | ids[j], NO_RANK) if j < n else NO_RANK
        node = size + i
        tree[node] = rank * size + i
        node >>= 1
        while node:
            least = min(tree[2 * node], tree[2 * node + 1])
            if tree[node] == least:
                break  # nothing changes further up
            tree[node] = least
            node >>= 1

    while tree[1] < none:
        rank, i = divmod(tree[1], size)
        j = follows[i]
        ids[i], follows[i] = rank, follows[j]
        if follows[i] < n:
            before[follows[i]] = i
        follows[j] = n  # no longer begins a part: it has no pair
        put(j)
        put(i)
        if before[i] >= 0:
            put(before[i])
        ids[j] = -1
    out, i = [], 0
    while i < n:
        out.append(ids[i])
        i = follows[i]
    return np.array(out, dtype="<u4").tobytes()


def encode_side_by_side(tokens: list[bytes], ranks: Ranks, size: int) -> list[bytes]:
    """Ids (32-bit) of many pre-tokens of 2 to ``size`` bytes, one merge in every tree a round."""
    import numpy as np

    count = len(tokens)
    n = np.fromiter(map(len, tokens), dtype=np.int64, count=count)
    place = np.arange(size)
    inside = place < n[:, None]
    ids = np.full((count, size), -1, dtype=np.int64)
    ids[inside] = ranks.byte_id[np.frombuffer(b"".join(tokens), dtype=np.uint8)]
    follows = np.tile(place + 1, (count, 1))
    before = np.tile(place - 1, (count, 1))
    pair = np.full((count, size), NO_RANK, dtype=np.int64)
    has = place[:-1] + 1 < n[:, None]
    pair[:, :-1][has] = ranks.ranks_of(ids[:, :-1][has], ids[:, 1:][has])
    tree = np.empty((count, 2 * size), dtype=np.int64)
    tree[:, size:] = pair * size + place
    width = size
    while width > 1:
        width //= 2
        tree[:, width : 2 * width] = np.minimum(tree[:, 2 * width : 4 * width : 2], tree[:, 2 * width + 1 : 4 * width : 2])
    none = NO_RANK * size

    def put(rows, i, rank) -> None:
        node = size + i
        tree[rows, node] = rank * size + i
        node = node >> 1
        while node[0]:  # all leaves are equally deep
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            node = node >> 1

    def rank_at(rows, i):
        """Rank of the pair that begins at i."""
        j = follows[rows, i]
        ok = j < n[rows]
        rank = np.full(len(rows), NO_RANK, dtype=np.int64)
        rank[ok] = ranks.ranks_of(ids[rows[ok], i[ok]], ids[rows[ok], j[ok]])
        return rank

    rows = np.flatnonzero(tree[:, 1] < none)
    while len(rows):
        rank, i = np.divmod(tree[rows, 1], size)
        j = follows[rows, i]
        after = follows[rows, j]
        ids[rows, i] = rank
        ids[rows, j] = -1
        follows[rows, i] = after
        live = after < n[rows]
        before[rows[live], after[live]] = i[live]
        put(rows, j, np.full(len(rows), NO_RANK, dtype=np.int64))
        put(rows, i, rank_at(rows, i))
        left = before[rows, i]
        some = left >= 0
        if some.any():
            put(rows[some], left[some], rank_at(rows[some], left[some]))
        rows = rows[tree[rows, 1] < none]
    live = ids >= 0
    raw = ids[live].astype("<u4").tobytes()
    ends = (live.sum(axis=1).cumsum() * 4).tolist()
    return [raw[a:b] for a, b in zip([0, *ends], ends)]


def encode_tokens(tokens: Iterable[bytes], ranks: Ranks) -> dict[bytes, bytes]:
    """Ids of pre-tokens, as little-endian unsigned 32-bit integers."""
    out: dict[bytes, bytes] = {}
    classes: dict[int, list[bytes]] = {}
    for t in tokens:
        if t in ranks.alone:
            out[t] = ranks.alone[t]  # a vocabulary entry is its own only token
        elif len(t) > SHORT:
            out[t] = encode_long(t, ranks)
        else:
            classes.setdefault(1 << (len(t) - 1).bit_length(), []).append(t)
    for size, same_size in classes.items():
        for at in range(0, len(same_size), 1 << 16):
            part = same_size[at : at + (1 << 16)]
            out.update(zip(part, encode_side_by_side(part, ranks, size)))
    return out


class Encoder:
    """Encodes texts; ids are little-endian unsigned 32-bit integers."""

    def __init__(self, vocabulary: list[bytes], pattern: str):
        import regex

        self.ranks, self.cut_any = Ranks(vocabulary), regex.compile(pattern).findall
        self.pre_tokens = PreTokens(pattern, self.encode_many)

    def encode_many(self, pre_tokens: Iterable[str]) -> dict[str, bytes]:
        coded = {p: p.encode() for p in pre_tokens}
        ids = encode_tokens(coded.values(), self.ranks)
        return {p: ids[b] for p, b in coded.items()}

    def encode(self, texts: list[str]) -> list[bytes]:
        cuts = self.pre_tokens.cut(texts)
        ids_of = self.pre_tokens.known.__getitem__
        return [b"".join(map(ids_of, words)) if words is not None else self.alone(t) for t, words in zip(texts, cuts)]

    def alone(self, text: str) -> bytes:
        words = self.cut_any(text)
        ids = self.encode_many(set(words))
        return b"".join(map(ids.__getitem__, words))


def decode(ids, vocabulary: list[bytes]) -> bytes:
    return b"".join(map(vocabulary.__getitem__, ids))


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Per document: id, n_tokens, ids_sha256, decoded_sha256; with ``keep_ids`` also ``ids`` (little-endian 32-bit integers)."""
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(path))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        import numpy as np

        store = worker_store("bpe")
        if path not in store:
            vocabulary = shared.value
            store[path] = Encoder(vocabulary, pattern), [str(i).encode() for i in range(len(vocabulary))]
        encoder, decimals = store[path]
        vocabulary = encoder.ranks.vocabulary
        for batch in batches:
            for start, texts in text_parts(batch["text"]):
                n, coded, digests, decoded = [], [], [], []
                for raw in encoder.encode(texts):
                    ids = np.frombuffer(raw, dtype="<u4").tolist()
                    n.append(len(ids))
                    digests.append(hashlib.sha256(b",".join(map(decimals.__getitem__, ids))).hexdigest())
                    decoded.append(hashlib.sha256(decode(ids, vocabulary)).hexdigest())
                    if keep_ids:
                        coded.append(raw)
                columns = [batch["id"].slice(start, len(n)), pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
                names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    columns, names = [*columns, pa.array(coded, pa.binary())], [*names, "ids"]
                yield pa.record_batch(columns, names=names)

    rows = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids
    return rows.mapInArrow(encode, schema).withColumnRenamed("id", id_col)


def op5_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
