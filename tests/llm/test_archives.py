"""WARC files against gzip and plain parsing; damaged members; the contract's columns by brute force."""

import gzip
import hashlib
import io
import random
import zlib

import pytest

from rosterloom.llm import warc
from rosterloom.session import run_dir

SCHEMA = "page_id bigint, url string, html string, id string, payload_digest int, record_type string, n int, file string"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", 2, "z") for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefgh <>\r\n") for _ in range(3_000_000))
    same = "<p>" + "copy " * 40
    return [
        (1, "http://a/1", same), (5, None, same), (3, "http://a/3 \r\nX-Page-Id: 9", same), (3, "http://a/3", same + "!"),
        (7, "u", None), (8, "u", ""), (9, "u", "short"), (10, "u", "short"), (11, "http://ü/é", "日本語😀" * 30), (12, "u", "日本語😀" * 30),
        (None, "u", same), (None, "u", "only here " * 20), (None, None, "only here " * 20), (2, "u", "r" * 100), (2, "u", "r" * 100), (4, "u", "r" * 100),
        (20, "u", long), (21, "u", long), (22, "u", "\r\n\r\nHTTP/1.1 200 OK\r\nContent-Length: 5\r\n\r\nWARC/1.1" * 3),
    ]


def expected(rows):
    least = {}
    for i, _, html in rows:
        b = (html or "").encode()
        if len(b) >= 100:
            least.setdefault(b, []).append(i)
    first = {b: min([i for i in ids if i is not None], default=None) for b, ids in least.items()}
    out = []
    for i, _, html in rows:
        b = (html or "").encode()
        revisit = b in first and first[b] != i
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", first[b] if revisit else None))
    return sorted(out, key=str)


def written(spark, rows, **options):
    folder = run_dir(spark, "warc-test")
    return folder, warc.write_warc(warc.record_types(pages_of(spark, rows)), folder, **options)


def test_round_trip_of_odd_pages(spark, odd_rows):
    folder, manifest = written(spark, odd_rows, file_bytes=2000)
    got = warc.read_warc(manifest, folder, keep_payload=True).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(odd_rows)
    payloads = {(r.page_id, r.payload_digest): bytes(r.payload) for r in got if r.record_type == "response"}
    assert all(hashlib.sha256(p).hexdigest() == d for (_, d), p in payloads.items())
    assert all(r.payload is None for r in got if r.record_type == "revisit")
    assert {r.url for r in got if r.page_id == 5} == {None} and any("%0D%0AX" in (r.url or "") for r in got)
    assert manifest.count() > 3 and manifest.agg({"records": "sum"}).head()[0] == len(odd_rows)
    assert warc.unresolved_revisits(warc.read_warc(manifest, folder)).count() == 0


def test_joins_groups_beyond_a_broadcast(spark, odd_rows, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    monkeypatch.setattr("rosterloom.llm.common.HOT_ROWS", 2)
    monkeypatch.setattr("rosterloom.llm.common.HOT_KEYS", 10**6)
    got = warc.record_types(pages_of(spark, odd_rows)).collect()
    assert sorted(((r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(odd_rows)


def test_empty_table(spark):
    folder, manifest = written(spark, [])
    assert manifest.count() == 0 and warc.read_warc(manifest, folder).count() == 0


def file_of(spark, rows):
    folder, manifest = written(spark, rows)
    paths = [f"{folder}/{r.file}" for r in manifest.collect()]
    return b"".join(open(p.removeprefix("file:"), "rb").read() for p in paths)


def members(data):
    out = []
    while data:
        unpack = zlib.decompressobj(31)
        out.append(unpack.decompress(data))
        assert unpack.eof
        data = unpack.unused_data
    return out


def test_files_are_plain_warc(spark, odd_rows):
    data = file_of(spark, odd_rows)
    parts = members(data)
    assert gzip.decompress(data) == b"".join(parts)
    kinds, ids = [], set()
    for m in parts:
        head, _, rest = m.partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n") and rest.endswith(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        block = rest[:-4]
        assert len(block) == int(fields["Content-Length"]) and fields["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(block).hexdigest()
        kinds.append(fields["WARC-Type"])
        if fields["WARC-Type"] == "response":
            ids.add(fields["WARC-Record-ID"])
            assert fields["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(block.partition(b"\r\n\r\n")[2]).hexdigest()
        assert all(line.count("\r") == 0 for line in fields)
    asked = {line.split(": ")[1] for m in parts for line in m.partition(b"\r\n\r\n")[0].decode().split("\r\n") if line.startswith("WARC-Refers-To:")}
    assert asked <= ids and kinds.count("revisit") == sum(r[3] == "revisit" for r in expected(odd_rows))


def records(data, chunk=None, **options):
    source = io.BytesIO(data)
    return list(warc.WarcReader((lambda n: source.read(min(n, chunk))) if chunk else source.read, **options))


def archive(payloads):
    out = io.BytesIO()
    writer = warc.WarcWriter(out, "2020-01-01T00:00:00Z")
    places = []
    for i, p in enumerate(payloads):
        places.append(out.tell())
        writer.add(i, f"http://x/{i}", p, hashlib.sha256(p).hexdigest(), None, False)
    return out.getvalue(), places


PAYLOADS = [b"first " * 50, bytes(range(256)) * 40, b"", b"last " * 900]


@pytest.mark.parametrize("chunk", [1, 7, 1000, None])
def test_reads_in_chunks_of_any_size(chunk):
    data, places = archive(PAYLOADS)
    got = records(data, chunk, keep=True)[1:]
    assert [(r[0], r[2], r[3], r[4]) for r in got] == [(at, len(p), hashlib.sha256(p).hexdigest(), p) for at, p in zip(places, PAYLOADS)]


def test_damaged_members_are_told_and_passed():
    data, places = archive(PAYLOADS)
    ends = [*places[1:], len(data)]
    for k in range(len(PAYLOADS)):
        for at in {places[k], places[k] + 1, places[k] + 12, (places[k] + ends[k]) // 2, ends[k] - 6}:
            bad = data[:at] + bytes([data[at] ^ 0x55]) + data[at + 1 :]
            with pytest.raises(warc.Damaged):
                records(bad)
            got = records(bad, strict=False)
            whole = [int(r[1]["x-page-id"]) for r in got if len(r) > 2 and "x-page-id" in r[1]]
            assert whole == [i for i in range(len(PAYLOADS)) if i != k] and any(len(r) == 2 for r in got)
    for end in (places[1] + 3, ends[2] + 1, len(data) - 1):
        with pytest.raises(warc.Damaged):
            records(data[:end])


def test_wrong_digest_and_wrong_length_are_found():
    for old, new in ((b"first first", b"fIrst first"), (b"Content-Length: 300\r\n\r\nfirst", b"Content-Length: 300\r\n\r\nfirsT")):
        data, places = archive(PAYLOADS)
        member = zlib.decompressobj(31).decompress(data[places[0] :])
        assert old in member
        data = data[: places[0]] + gzip.compress(member.replace(old, new, 1)) + data[places[1] :]
        faults = [r[1] for r in records(data, strict=False) if len(r) == 2]
        assert faults == ["block digest"]
    data, places = archive(PAYLOADS)
    member = zlib.decompressobj(31).decompress(data[places[0] :])
    top, _, rest = member.partition(b"\r\n\r\n")
    length = int(top.rpartition(b"Content-Length: ")[2])
    for wrong, fault in ((length - 9, "goes on behind"), (length + 9, "before its content length"), (3, "inside the HTTP head")):
        bad = top.replace(b"Content-Length: %d" % length, b"Content-Length: %d" % wrong) + b"\r\n\r\n" + rest
        faults = [r[1] for r in records(data[: places[0]] + gzip.compress(bad) + data[places[1] :], strict=False) if len(r) == 2]
        assert len(faults) == 1 and fault in faults[0]
