"""Token ids in Arrow files of fixed-size-list batches, with random access by sequence and by document.

Documents are put in ascending order of their id by range partitioning; each range is encoded and
written by one task as one or more files.  A file (Arrow IPC) is a run of tokens cut
into sequences of equal length, ``BATCH`` sequences a record batch: column ``ids`` is a
fixed-size list of the narrowest unsigned integers that hold the vocabulary, column
``mask`` a fixed-size list of booleans, false on the padding that ends a file.  As every
batch but the last has equally many sequences, sequence k is row k % BATCH of batch k // BATCH, and
its values are a view into the mapped file.

The index has a row per document: file, offset in it and length.  A file's name holds the
attempt that wrote it and only the rows of successful tasks get into the index, so files of lost
or repeated tasks are never read.  A document's global start is the sum of the files before
its own (one row per file) and its offset.

Defined cases: a null text is an empty one, of the end id alone; null ids come first; rows that repeat an
id are ordered by a hash of their text; an empty table gives no files and no rows;
very long texts are one document that spans sequences, and a file ends after the document that fills it;
special strings inside a text are what the library makes of them; further columns are not looked at.
The folder must be one that pyarrow can write to (local and shared mounts, hdfs, s3, gs).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rosterloom.llm.common import by_value, landed, table, whole, worker_store
from rosterloom.llm.pretokens import PreTokens, bytes_of_signs, text_parts
from rosterloom.session import run_dir

by_value(__name__)

SEQUENCE = 2048
BATCH = 64
FILE_TOKENS = 1 << 24
REMEMBERED = 500_000  # pre-tokens in a generation
LINES = 500  # pre-tokens given to the library in one text
# the pattern of byte-level pre-tokenizers that have none of their own
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class LibraryEncoder:
    """The ids that the tokenizers library gives; little-endian, ``width`` bytes each."""

    def __init__(self, tokenizer_json: str, width: int):
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.kind = Tokenizer.from_str(tokenizer_json), f"<u{width}"
        self.signs = str.maketrans({b: sign for sign, b in bytes_of_signs().items()})
        self.line_end = self.tokenizer.token_to_id("\n".translate(self.signs))
        specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pre_tokens = PreTokens(PATTERN, self.encode_many, specials, limit=REMEMBERED)

    def encode_many(self, pre_tokens: Iterable[str]) -> dict[str, bytes]:
        """Give unknown pre-tokens to the library together, a line each.

        A line break that a pre-token follows is a pre-token of its own, so its token marks where
        the one before ends.  White space is given to the library's model alone.
        """
        import numpy as np

        words, out = [], {}
        for p in pre_tokens:
            if p.isspace():
                ids = [t.id for t in self.tokenizer.model.tokenize(p.encode().decode("latin-1").translate(self.signs))]
                out[p] = np.array(ids, dtype=self.kind).tobytes()
            else:
                words.append(p)
        some = [words[at : at + LINES] for at in range(0, len(words), LINES)]
        encoded = self.tokenizer.encode_batch_fast(["\n".join(part) + "\n." for part in some], add_special_tokens=False)
        for part, e in zip(some, encoded):
            ids = np.array(e.ids, dtype=self.kind)
            ends = (np.flatnonzero(ids == self.line_end) * ids.itemsize).tolist()
            if len(ends) != len(part):
                raise ValueError("line breaks do not stand alone in this vocabulary")
            raw, width = ids.tobytes(), ids.itemsize
            out.update(zip(part, [raw[a:b] for a, b in zip([0, *[x + width for x in ends]], ends)]))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        cuts = self.pre_tokens.cut(texts)
        ids_of = self.pre_tokens.known.__getitem__
        return [b"".join(map(ids_of, words)) if words is not None else self.alone(t) for t, words in zip(texts, cuts)]

    def alone(self, text: str) -> bytes:
        import numpy as np

        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.kind).tobytes()


def file_schema(width: int, sequence: int) -> pa.Schema:
    kind = {1: pa.uint8(), 2: pa.uint16(), 4: pa.uint32()}[width]
    return pa.schema([pa.field("ids", pa.list_(kind, sequence)), pa.field("mask", pa.list_(pa.bool_(), sequence))])


class TokenWriter:
    """Writes runs of ids to one file, a batch at a time."""

    def __init__(self, filesystem, path: str, width: int, sequence: int, batch: int):
        import pyarrow as pa

        self.schema, self.width, self.sequence = file_schema(width, sequence), width, sequence
        self.full = batch * sequence * width
        self.out = filesystem.open_output_stream(path)
        self.file = pa.ipc.new_file(self.out, self.schema)
        self.pending, self.held, self.tokens = [], 0, 0

    def add(self, raw: bytes) -> int:
        """Offset of the run in the file."""
        at = self.tokens
        self.tokens += len(raw) // self.width
        self.pending.append(raw)
        self.held += len(raw)
        if self.held >= self.full:
            data = b"".join(self.pending)
            cut = len(data) // self.full * self.full
            for i in range(0, cut, self.full):
                self.put(data[i : i + self.full])
            self.pending, self.held = [data[cut:]], len(data) - cut
        return at

    def put(self, data: bytes) -> None:
        import numpy as np
        import pyarrow as pa

        n = len(data) // self.width
        rows = -(-n // self.sequence)
        ids = np.zeros(rows * self.sequence, dtype=f"<u{self.width}")
        ids[:n] = np.frombuffer(data, dtype=ids.dtype)
        mask = np.arange(len(ids)) < n
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x, t.type.value_type), self.sequence) for x, t in zip((ids, mask), self.schema)]
        self.file.write_batch(pa.record_batch(columns, schema=self.schema))

    def close(self) -> None:
        if self.held:
            self.put(b"".join(self.pending))
            self.pending, self.held = [], 0
        self.file.close()
        self.out.close()


class TokenReader:
    """Random access to one file."""

    def __init__(self, filesystem, path: str):
        import pyarrow as pa
        from pyarrow import fs

        source = pa.memory_map(path) if isinstance(filesystem, fs.LocalFileSystem) else filesystem.open_input_file(path)
        self.file = pa.ipc.open_file(source)
        self.length = self.file.schema.field("ids").type.list_size
        self.batch = self.file.get_batch(0).num_rows if self.file.num_record_batches else 0
        self.last = (-1, None, None)

    def _batch(self, b: int):
        """Ids (a view into the file) and mask of batch b."""
        if self.last[0] != b:
            batch = self.file.get_batch(b)
            self.last = (b, batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy(zero_copy_only=False))
        return self.last[1:]

    def sequence(self, k: int):
        """Ids and mask of sequence k; the ids are a view into the file."""
        row = k % self.batch
        at = slice(row * self.length, (row + 1) * self.length)
        return [column[at] for column in self._batch(k // self.batch)]

    def tokens(self, offset: int, n: int):
        """Ids of a run of n tokens."""
        import numpy as np

        whole_batch, parts = self.batch * self.length, []
        while n:
            b, at = divmod(offset, whole_batch)
            ids, mask = self._batch(b)
            take = min(n, whole_batch - at)
            if len(ids) < at + take or not mask[at : at + take].all():
                raise ValueError("the run reaches into the padding")
            parts.append(ids[at : at + take])
            offset, n = offset + take, n - take
        return np.concatenate(parts) if parts else np.zeros(0, dtype="<u4")


def open_folder(folder: str):
    """(filesystem, path) of a Hadoop-style folder name."""
    import re

    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/*", "file:///", folder))


def qualified(spark, folder: str) -> str:
    """The folder with its scheme, so that every executor means the same one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def write_token_files(
    docs: DataFrame, folder: str, path: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text",
    sequence: int = SEQUENCE, batch: int = BATCH, file_tokens: int = FILE_TOKENS,
) -> DataFrame:
    """Encode, write and return the index: id, part, file_no, file, offset, n_tokens."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    with open(path, encoding="utf-8") as f:
        tokenizer_json = f.read()
    largest = max([*Tokenizer.from_str(tokenizer_json).get_vocab().values(), end_id or 0])
    width = 2 if largest < 1 << 16 else 4
    shared = spark.sparkContext.broadcast(tokenizer_json)
    folder = qualified(spark, folder)
    open_folder(folder)[0].create_dir(open_folder(folder)[1], recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        import pyarrow as pa
        from pyspark import TaskContext

        store = worker_store("token_files")
        key = (path, width)
        if key not in store:
            store[key] = LibraryEncoder(shared.value, width)
        encoder, end = store[key], b"" if end_id is None else end_id.to_bytes(width, "little")
        filesystem, top = open_folder(folder)
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex[:12]
        file_no, writer, name = -1, None, ""
        try:
            for rows in batches:
                places = []
                for _, texts in text_parts(rows["text"]):
                    for ids in encoder.encode(texts):
                        if writer is None or writer.tokens >= file_tokens:
                            if writer is not None:
                                writer.close()
                            file_no += 1
                            name = f"tokens-{part:06d}-{file_no:04d}-{attempt}.arrow"
                            writer = TokenWriter(filesystem, f"{top}/{name}", width, sequence, batch)
                        raw = ids + end
                        places.append((part, file_no, name, writer.add(raw), len(raw) // width))
                if places:
                    columns = [pa.array(x, t) for x, t in zip(zip(*places), (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))]
                    yield pa.record_batch([rows["id"], *columns], names=["id", "part", "file_no", "file", "offset", "n_tokens"])
        finally:
            if writer is not None:
                writer.close()

    rows = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    kind = rows.schema["id"].dataType.simpleString()
    return landed(ordered.mapInArrow(write, f"id {kind}, part int, file_no int, file string, offset bigint, n_tokens bigint"), "token-index")


def read_documents(index: DataFrame, folder: str) -> DataFrame:
    """Documents read back from the files: id, part, file_no, offset, n_tokens, ids_crc32."""
    folder = qualified(index.sparkSession, folder)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        import pyarrow as pa

        filesystem, top = open_folder(folder)
        opened, reader = None, None
        for rows in batches:
            crc = []
            for name, offset, n in zip(*(rows[c].to_pylist() for c in ("file", "offset", "n_tokens"))):
                if name != opened:
                    opened, reader = name, TokenReader(filesystem, f"{top}/{name}")
                crc.append(zlib.crc32(reader.tokens(offset, n).astype("<u4").tobytes()))
            names = ["id", "part", "file_no", "offset", "n_tokens"]
            yield pa.record_batch([*[rows[c] for c in names], pa.array(crc, pa.int64())], names=[*names, "ids_crc32"])

    kind = index.schema["id"].dataType.simpleString()
    return index.mapInArrow(read, f"id {kind}, part int, file_no int, offset bigint, n_tokens bigint, ids_crc32 bigint")


def with_start(documents: DataFrame, index: DataFrame) -> DataFrame:
    """Adds ``start``: the tokens of all documents before.  The running sum has one row per file."""
    files = index.groupBy("part", "file_no").agg(F.sum("n_tokens").alias("_tokens"))
    before = F.coalesce(F.sum("_tokens").over(W.orderBy("part", "file_no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    files = files.select("part", "file_no", before.alias("_before"))
    return documents.join(files, ["part", "file_no"]).withColumn("start", (F.col("_before") + F.col("offset")).cast("bigint")).drop("_before")


def op1_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = run_dir(spark, "token-files")
    index = write_token_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return with_start(read_documents(index, folder), index).select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")
