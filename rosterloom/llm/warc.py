"""WARC archives: one gzip member per record, written and read as streams.

Writing.  A first pass over the pages takes each payload's length and digest; payloads that occur more than once
have one response, at their smallest id, and all other records revisit it.  A second pass writes the
records where their rows are: every task writes its own files, a new one after ``FILE_BYTES``.  The payload
itself is shuffled only where repeated payloads are too many for a broadcast.  A file's name
holds the attempt that wrote it, and only files of successful tasks get into the manifest, so files of
lost or repeated tasks are never read.

Reading.  A file is read from its start to its end by one task, a chunk at a time: a gzip member is inflated
incrementally, its header block is taken up to the blank line, the content length frames the block, the HTTP head is
taken off, and both digests are computed as the bytes pass, so a payload is held only when it is asked for.  Every
member must hold one whole record, end with the two line breaks and match its digests; gzip's own
checksum is verified too.  A damaged member is an error, or with ``strict=False`` a row whose ``fault`` says what is
wrong, after which the reader goes on at the next member that begins a record.

Defined cases: a null payload is an empty one; payloads below ``least`` bytes are never revisits; of rows with
equal payloads those with the smallest id are responses (all of them, if a row is repeated whole), nulls last; a null id or
url is written without its field and read as null; line breaks and control signs in a url are percent-encoded; an empty
table gives no files and no rows; very long payloads are written and digested in chunks; further columns are not looked at.
The folder must be one that pyarrow can write to (local and shared mounts, hdfs, s3, gs).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterloom.llm.common import BROADCAST_ROWS, by_value, join_groups, landed, table
from rosterloom.llm.token_files import open_folder, qualified
from rosterloom.session import run_dir

by_value(__name__)

LEAST = 100
FILE_BYTES = 1 << 28
CHUNK = 1 << 16
# fixed values of the format
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP = b"\x1f\x8b\x08"
HEAD_LIMIT = 1 << 20


def record_types(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST) -> DataFrame:
    """id, url, payload (binary), payload_bytes, payload_digest, record_type, refers_to."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"),
        F.octet_length(payload).cast("bigint").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_digest"),
    )
    groups = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    groups = landed(groups.where("n > 1").select("payload_digest", "n", F.struct("first").alias("group")), "payloads")
    found = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).head()
    if found[0] <= BROADCAST_ROWS:
        side = groups.select(F.col("payload_digest").alias("_d"), "group")
        rows = rows.join(F.broadcast(side), F.col("payload_digest") == F.col("_d"), "left").drop("_d")
    else:
        rows = join_groups(rows, groups, ["payload_digest"], "n", found[1], "payload_digest")
    revisit = F.col("group").isNotNull() & ~F.col("group.first").eqNullSafe(F.col("id"))
    return rows.select(
        "id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("group.first")).alias("refers_to"),
    )


def record_id(page_id, digest: str) -> str:
    """The same for the same id and payload, so that a revisit can name its response."""
    import uuid

    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def safe(url: str) -> str:
    return "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in url)


def http_head(payload_bytes: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()


class WarcWriter:
    """One file; ``add`` appends a record as a gzip member."""

    def __init__(self, out, date: str, level: int = 6):
        self.out, self.date, self.level, self.size, self.records = out, date, level, 0, 0
        self.member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id("warcinfo", date)), ("Content-Type", "application/warc-fields")], b"", b"format: WARC File Format 1.1\r\n")

    def member(self, fields: list[tuple[str, str]], head: bytes, body: bytes) -> None:
        import hashlib
        import zlib

        block = hashlib.sha256(head)
        block.update(body)
        fields = [*fields, ("WARC-Date", self.date), ("WARC-Block-Digest", f"sha256:{block.hexdigest()}"), ("Content-Length", str(len(head) + len(body)))]
        packer = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        top = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n"
        self.put(packer.compress(top + head))
        view = memoryview(body)
        for at in range(0, len(body), CHUNK):
            self.put(packer.compress(view[at : at + CHUNK]))
        self.put(packer.compress(b"\r\n\r\n") + packer.flush())

    def put(self, data: bytes) -> None:
        if data:
            self.out.write(data)
            self.size += len(data)

    def add(self, page_id, url: str | None, payload: bytes, digest: str, refers_to, revisit: bool) -> None:
        fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, digest))]
        fields += [("WARC-Target-URI", safe(url))] if url is not None else []
        fields += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}")]
        fields += [("X-Page-Id", str(page_id))] if page_id is not None else []
        if revisit:
            fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to, digest))]
            fields += [("X-Refers-To-Page-Id", str(refers_to))] if refers_to is not None else []
        self.member(fields, http_head(len(payload)), b"" if revisit else payload)
        self.records += 1


class Damaged(ValueError):
    """A member that is no whole record, or whose bytes do not match its digests."""


class WarcReader:
    """Records of one file, in order: (offset, fields, payload length, payload digest, payload or None).

    ``read`` gives the next bytes of the file.  With ``strict=False`` a damaged member is given as (offset, fault).
    """

    def __init__(self, read, keep: bool = False, strict: bool = True):
        self.read, self.keep, self.strict = read, keep, strict
        self.buffer, self.offset = b"", 0  # bytes not yet inflated, and where in the file they begin

    def fill(self) -> bool:
        if not self.buffer:
            self.buffer = self.read(CHUNK)
        return bool(self.buffer)

    def __iter__(self):
        while self.fill():
            at = self.offset
            try:
                yield self.record(at)
            except Damaged as e:
                if self.strict:
                    raise Damaged(f"offset {at}: {e}") from None
                yield at, str(e)
                self.seek_member()

    def inflated(self):
        """The bytes of one member, a chunk at a time; ends with the member."""
        import zlib

        unpack = zlib.decompressobj(31)
        while not unpack.eof:
            if not self.fill():
                raise Damaged("the file ends inside a member")
            data, self.buffer = self.buffer, b""
            try:
                out = unpack.decompress(data, CHUNK)
                rest = unpack.unused_data if unpack.eof else unpack.unconsumed_tail
            except zlib.error as e:
                self.offset += 1  # go on behind the member's first byte
                self.buffer = data[1:]
                raise Damaged(f"member cannot be inflated: {e}") from None
            self.offset += len(data) - len(rest)
            self.buffer = rest
            if out:
                yield out

    def seek_member(self) -> None:
        """Go to the next place where a record's member may begin."""
        while True:
            place = self.buffer.find(GZIP)
            if place >= 0:
                import zlib

                more = self.read(CHUNK) if len(self.buffer) - place < CHUNK else b""
                self.buffer += more
                try:
                    begins = zlib.decompressobj(31).decompress(self.buffer[place:], len(VERSION)).startswith(VERSION)
                except zlib.error:
                    begins = False
                step = place if begins else place + 1
                self.buffer, self.offset = self.buffer[step:], self.offset + step
                if begins:
                    return
                continue
            step = max(0, len(self.buffer) - len(GZIP) + 1)
            self.buffer, self.offset = self.buffer[step:], self.offset + step
            more = self.read(CHUNK)
            if not more:
                self.offset += len(self.buffer)
                self.buffer = b""
                return
            self.buffer += more

    @staticmethod
    def up_to_blank_line(held: bytearray, chunks) -> bytes:
        """The bytes before the first blank line; ``held`` keeps what follows it."""
        searched = 0
        while (end := held.find(b"\r\n\r\n", searched)) < 0:
            searched = max(0, len(held) - 3)
            piece = next(chunks, None)
            if piece is None or len(held) > HEAD_LIMIT:
                raise Damaged("no end of the header")
            held += piece
        head = bytes(held[:end])
        del held[: end + 4]
        return head

    @staticmethod
    def fields_of(head: bytes, first: bytes) -> dict[str, str]:
        lines = head.split(b"\r\n")
        if not lines[0].startswith(first):
            raise Damaged("not a record header")
        pairs = (line.decode("utf-8", "replace").partition(":") for line in lines[1:])
        return {k.strip().lower(): v.strip() for k, _, v in pairs}

    def record(self, at: int):
        import hashlib

        held, chunks = bytearray(), self.inflated()
        fields = self.fields_of(self.up_to_blank_line(held, chunks), b"WARC/")
        length = fields.get("content-length", "")
        if not length.isdigit():
            raise Damaged("no content length")
        left, block, payload, size, kept = int(length), hashlib.sha256(), hashlib.sha256(), 0, []
        http = None if fields.get("content-type", "").startswith("application/http") else {}
        if http is None:
            http_bytes = self.up_to_blank_line(held, chunks) + b"\r\n\r\n"
            http = self.fields_of(http_bytes[:-4], b"HTTP/")
            block.update(http_bytes)
            left -= len(http_bytes)
            if left < 0:
                raise Damaged("the content length ends inside the HTTP head")
        while True:
            take = bytes(held[:left]) if len(held) > left else bytes(held)
            del held[: len(take)]
            left -= len(take)
            block.update(take)
            payload.update(take)
            size += len(take)
            if self.keep and take:
                kept.append(take)
            if not left:
                break
            piece = next(chunks, None)
            if piece is None:
                raise Damaged("the member ends before its content length")
            held += piece
        for piece in chunks:
            held += piece
            if len(held) > 4:
                break
        if bytes(held) != b"\r\n\r\n":
            raise Damaged("the member goes on behind its record")
        if fields.get("warc-block-digest", f"sha256:{block.hexdigest()}") != f"sha256:{block.hexdigest()}":
            raise Damaged("block digest")
        digest, claimed = payload.hexdigest(), fields.get("warc-payload-digest")
        if fields.get("warc-type") == "revisit":
            size, digest = int(http.get("content-length", 0)), (claimed or "").removeprefix("sha256:")
        elif claimed not in (None, f"sha256:{digest}"):
            raise Damaged("payload digest")
        return at, fields, size, digest, b"".join(kept) if self.keep else None


def write_warc(records: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write rows of ``record_types`` and return the manifest: file, records, bytes."""
    folder = qualified(records.sparkSession, folder)
    open_folder(folder)[0].create_dir(open_folder(folder)[1], recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        import pyarrow as pa
        from pyspark import TaskContext

        filesystem, top = open_folder(folder)
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex[:12]
        done, writer, name = [], None, ""

        def close():
            writer.out.close()
            done.append((name, writer.records, writer.size))

        for rows in batches:
            names = ("id", "url", "payload", "payload_digest", "refers_to", "record_type")
            for page_id, url, payload, digest, refers_to, kind in zip(*(rows[c].to_pylist() for c in names)):
                if writer is None:
                    name = f"pages-{part:06d}-{len(done):04d}-{attempt}.warc.gz"
                    writer = WarcWriter(filesystem.open_output_stream(f"{top}/{name}", compression=None), date)
                writer.add(page_id, url, payload, digest, refers_to, kind == "revisit")
                if writer.size >= file_bytes:
                    close()
                    writer = None
        if writer is not None:
            close()
        if done:
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*done), (pa.string(), pa.int64(), pa.int64()))], names=["file", "records", "bytes"])

    return landed(records.mapInArrow(write, "file string, records bigint, bytes bigint"), "warc-manifest")


def read_warc(manifest: DataFrame, folder: str, keep_payload: bool = False, strict: bool = True) -> DataFrame:
    """Records of the manifest's files, without the warcinfo: file, offset, record_type, page_id, url, payload_bytes, payload_digest,
    refers_to, fault, and with ``keep_payload`` the payload of responses."""
    spark = manifest.sparkSession
    folder = qualified(spark, folder)
    n = max(1, manifest.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        filesystem, top = open_folder(folder)
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        names = ["file", "offset", "record_type", "page_id", "url", "payload_bytes", "payload_digest", "refers_to", "fault", "payload"]
        width = len(names) if keep_payload else len(names) - 1

        def batch(rows):
            return pa.record_batch([pa.array(x, t) for x, t in zip(list(zip(*rows))[:width], kinds)], names=names[:width])

        number = lambda v: None if v is None else int(v)
        rows, held = [], 0
        for b in batches:
            for name in b["file"].to_pylist():
                with filesystem.open_input_stream(f"{top}/{name}", compression=None) as source:
                    for found in WarcReader(source.read, keep_payload, strict):
                        if len(found) == 2:
                            rows.append((name, found[0], *[None] * 6, found[1], None))
                        else:
                            at, f, size, digest, payload = found
                            kind = f.get("warc-type")
                            if kind == "warcinfo":
                                continue
                            ids = number(f.get("x-page-id")), f.get("warc-target-uri"), size, digest, number(f.get("x-refers-to-page-id"))
                            rows.append((name, at, kind, *ids, None, payload if kind == "response" else None))
                            held += len(payload or b"")
                        if len(rows) >= 1000 or held > 1 << 24:
                            yield batch(rows)
                            rows, held = [], 0
        if rows:
            yield batch(rows)

    columns = "file string, offset bigint, record_type string, page_id bigint, url string, payload_bytes bigint, payload_digest string, refers_to bigint, fault string"
    files = manifest.select("file").repartitionByRange(n, "file")
    return files.mapInArrow(read, columns + (", payload binary" if keep_payload else ""))


def unresolved_revisits(records: DataFrame) -> DataFrame:
    """(refers_to, payload_digest, payload_bytes, revisits) of revisits without a response of that id, digest and length.

    Revisits are counted per response before they meet it.
    """
    keys = ["refers_to", "payload_digest", "payload_bytes"]
    asked = records.where("record_type = 'revisit'").groupBy(*keys).agg(F.count(F.lit(1)).alias("revisits"))
    given = records.where("record_type = 'response'").select(*[F.col(c).alias(f"_{c}") for c in ("page_id", *keys[1:])]).distinct()
    on = asked["refers_to"].eqNullSafe(given["_page_id"]) & (asked["payload_digest"] == given["_payload_digest"]) & (asked["payload_bytes"] == given["_payload_bytes"])
    return asked.join(given, on, "left_anti")


def archive(pages: DataFrame, folder: str, **options) -> DataFrame:
    """Write the pages' archives to the folder and return their manifest."""
    return write_warc(record_types(pages, **options), folder)


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = run_dir(spark, "warc")
    manifest = archive(table(spark, sf_dir, "pages"), folder)
    return read_warc(manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP11_SQL = f"""
WITH p AS (
    SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
    SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first, payload_bytes >= {LEAST} AS long FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN long AND first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN long AND first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM f
"""
