"""WARC records in ZIP archives: writing, and range reads by way of the central directory.

Each task writes archives of its own under the shared folder: stored (uncompressed) members
`records-N.warc` of a warcinfo record and concatenated WARC/1.1 records, each followed by `records-N.idx`
with one line "offset length" per page's record. Sizes and offsets stand in ZIP64 fields. The manifest, a table of
archive paths, is written by Spark; archives of lost attempts are not in it. Reading finds the end
record, the ZIP64 directory and the members, then fetches single records by byte range.

A page whose payload (at least `min_bytes` long) also stands on a page with a larger id is written as a
revisit that names the largest such id; the payload itself is stored once. Pages whose payload stands on no other
page are written where they are read: a filter of fixed size, made from the digests that several pages have,
tells them; of the others only the one html of each payload that is kept is shuffled. With `min_bytes` above 0,
shorter payloads are all responses. A null html is an empty payload. Pages with the same id and
payload are all responses, or all revisits, alike; pages with a null id are
responses unless another page has their payload, and are referred to only by pages without an id. A record's id
is made from its page's id and digest, so only rows that repeat both repeat it. An empty
table gives an empty result. Other columns than id, url and html are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from typing import BinaryIO

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.llm import common

#: A member is closed at this many bytes, an archive at so many members.
MEMBER_BYTES = 16 << 20
MEMBERS = 64

SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"

# Fixed values of the ZIP format: signatures, sizes of the records without their variable parts.
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
_FULL = 0xFFFFFFFF


def open_shared(path: str, mode: str) -> BinaryIO:
    if path.startswith("file:"):
        return open("/" + path[5:].lstrip("/"), mode)
    if "://" not in path:
        return open(path, mode)
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path)
    return system.open_output_stream(at) if "w" in mode else system.open_input_file(at)


class ZipWriter:
    """Stored members only; nothing is patched, so any output stream will do."""

    def __init__(self, out: BinaryIO) -> None:
        self.out, self.at, self.entries = out, 0, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, data: bytes) -> None:
        raw, crc, start = name.encode(), zlib.crc32(data), self.at
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data))
        self._put(LOCAL + struct.pack("<HHHHHIIIHH", 45, 0x800, 0, 0, 33, crc, _FULL, _FULL, len(raw), len(extra)) + raw + extra)
        self._put(data)
        self.entries.append((raw, crc, len(data), start))

    def close(self) -> None:
        start = self.at
        for raw, crc, n, at in self.entries:
            extra = struct.pack("<HHQQQ", 1, 24, n, n, at)
            self._put(CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0x800, 0, 0, 33, crc, _FULL, _FULL, len(raw), len(extra), 0, 0, 0, 0, _FULL) + raw + extra)
        size, end, n = self.at - start, self.at, len(self.entries)
        self._put(END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, size, start))
        self._put(LOCATOR64 + struct.pack("<IQI", 0, end, 1))
        self._put(END + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, _FULL, _FULL, 0))


def read_at(f: BinaryIO, offset: int, size: int) -> bytes:
    f.seek(offset)
    data = f.read(size)
    if len(data) < size:
        raise ValueError(f"archive ends inside {offset}+{size}")
    return data


def zip_members(f: BinaryIO) -> dict[str, tuple[int, int]]:
    """Offset and size of the data of every stored member, from the central directory (ZIP or ZIP64)."""
    f.seek(0, 2)
    length = f.tell()
    tail = read_at(f, (base := max(0, length - 65_557)), length - base)
    at = tail.rfind(END)
    if at < 0:
        raise ValueError("no ZIP end record")
    n, size, start = struct.unpack("<HII", tail[at + 10 : at + 20])
    if at >= 20 and tail[at - 20 : at - 16] == LOCATOR64:
        n, size, start = struct.unpack("<QQQ", read_at(f, struct.unpack("<Q", tail[at - 12 : at - 4])[0], 56)[32:56])
    directory, p, members = read_at(f, start, size), 0, {}
    for _ in range(n):
        if directory[p : p + 4] != CENTRAL:
            raise ValueError("bad central directory")
        method, = struct.unpack("<H", directory[p + 10 : p + 12])
        packed, plain, n_name, n_extra, n_note = struct.unpack("<IIHHH", directory[p + 20 : p + 34])
        local, = struct.unpack("<I", directory[p + 42 : p + 46])
        name = directory[p + 46 : p + 46 + n_name].decode()
        extra, e = directory[p + 46 + n_name : p + 46 + n_name + n_extra], 0
        while e + 4 <= len(extra):
            kind, k = struct.unpack("<HH", extra[e : e + 4])
            if kind == 1:
                wide = list(struct.unpack(f"<{k // 8}Q", extra[e + 4 : e + 4 + k // 8 * 8]))
                plain = wide.pop(0) if plain == _FULL else plain
                packed = wide.pop(0) if packed == _FULL else packed
                local = wide.pop(0) if local == _FULL else local
            e += 4 + k
        if method:
            raise ValueError(f"{name}: only stored members can be read by range")
        head = read_at(f, local, 30)
        members[name] = local + 30 + sum(struct.unpack("<HH", head[26:30])), packed
        p += 46 + n_name + n_extra + n_note
    return members


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _block(lines: list[str], body: bytes) -> bytes:
    head = "".join(f"{x}\r\n" for x in ["WARC/1.1", *lines, f"Content-Length: {len(body)}"])
    return head.encode() + b"\r\n" + body + b"\r\n\r\n"


def _urn(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}/{digest}')}>"


def info(name: str, date: str) -> bytes:
    """The warcinfo record that a member begins with."""
    body = b"format: WARC File Format 1.1\r\n"
    return _block(["WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields"], body)


def record(page_id: int | None, url: str, payload: bytes, digest: str, size: int, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC/1.1 record: a response with its HTTP head, or a revisit, which has no block but the payload's digest and length."""
    clean = "".join(x for x in url if x > " ")
    lines = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id, digest)}", f"WARC-Date: {date}", f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Page-ID: {page_id}", f"Payload-Length: {size}"]
    if revisit:
        return _block([*lines, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to, digest)}", f"Refers-To-Page-ID: {refers_to}"], b"")
    return _block(lines, b"HTTP/1.1 200 OK\r\nContent-Type: text/html;charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size + payload)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.decode().split(": ", 1) for x in head.split(b"\r\n")[1:] if b": " in x)
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("record of another length than its header says")
    return fields, rest[:size]


def _write(batches: Iterator[pa.RecordBatch], folder: str, date: str) -> Iterator[pa.RecordBatch]:
    archive = out = path = None
    block, index, member, records = bytearray(), [], 0, 0

    def flush() -> None:
        nonlocal block, index, member
        archive.add(f"records-{member}.warc", bytes(block))
        archive.add(f"records-{member}.idx", "".join(f"{a} {n}\n" for a, n in index).encode())
        block, index, member = bytearray(), [], member + 1

    def finish() -> pa.RecordBatch:
        nonlocal archive, member, records
        if block:
            flush()
        archive.close()
        out.close()
        row = pa.RecordBatch.from_arrays([pa.array([path]), pa.array([records], pa.int64()), pa.array([archive.at], pa.int64())], ["archive", "n_records", "n_bytes"])
        archive, member, records = None, 0, 0
        return row

    for batch in batches:
        for rows, texts in common.slices(batch, "html"):
            for page, url, sha, size, to, revisit, html in zip(*[rows.column(c).to_pylist() for c in ("page_id", "url", "digest", "n", "latest", "revisit")], texts, strict=True):
                if archive is None:
                    path = f"{folder}/{uuid.uuid4().hex}.zip"
                    out = open_shared(path, "wb")
                    archive = ZipWriter(out)
                if not block:
                    block += info(f"records-{member}.warc", date)
                data = record(page, url or "", html.as_py(), base64.b32encode(bytes.fromhex(sha)).decode(), size, to, revisit, date)
                index.append((len(block), len(data)))
                block += data
                records += 1
                if len(block) >= MEMBER_BYTES:
                    flush()
                    if member >= MEMBERS:
                        yield finish()
    if archive is not None:
        yield finish()


def _alone(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Pages whose payload no other page has, as responses."""
    for batch in batches:
        own = batch.filter(pa.array(~common.passing(batch.column("h"), shared)))
        yield pa.RecordBatch.from_arrays([*[own.column(c) for c in ("page_id", "url", "html", "digest", "n")], pa.nulls(own.num_rows, pa.int64()), pa.array([False] * own.num_rows, pa.bool_())], ["page_id", "url", "html", "digest", "n", "latest", "revisit"])


def _copies(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """The other pages; html is null where it is certain that it stands in another page's response."""
    for batch in batches:
        own = batch.filter(pa.array(common.passing(batch.column("h"), shared)))
        kept = pa.array(common.passing(own.column("k"), shared))
        html = pc.if_else(kept, own.column("html"), pa.scalar(None, own.column("html").type))
        yield pa.RecordBatch.from_arrays([own.column("page_id"), own.column("url"), html, own.column("digest"), own.column("n")], ["page_id", "url", "html", "digest", "n"])


def write_archives(pages: DataFrame, folder: str, *, min_bytes: int = 0, date: str | None = None) -> DataFrame:
    """Writes the archives under folder (shared by all executors); returns the manifest. date: of the records, now by default."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("html"))
    rows = rows.withColumn("digest", F.sha1("html")).withColumn("n", F.octet_length("html").cast("long"))
    copied = rows.filter(F.col("n") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("latest"), F.count("*").alias("copies"), F.lit(True).alias("found")).filter("copies > 1")
    copied = common.materialize(copied, "copied")
    named, kept = F.xxhash64("digest"), lambda page: F.xxhash64(F.lit("kept"), "digest", F.coalesce(F.col(page).cast("string"), F.lit("")))
    shared = common.bit_filter(copied.select(F.explode(F.array(named, kept("latest"))).alias("h")))
    rows = rows.withColumn("h", named).withColumn("k", kept("page_id"))
    if folder.startswith("file:") or "://" not in folder:
        import os

        os.makedirs("/" + folder.removeprefix("file:").lstrip("/"), exist_ok=True)
    copies = rows.mapInArrow(lambda it: _copies(it, shared), "page_id long, url string, html binary, digest string, n long")
    copies = common.join_unique(copies, copied, "digest", weight="copies")
    copies = copies.select("page_id", "url", "html", "digest", "n", "latest", F.coalesce(F.col("found") & ~F.col("page_id").eqNullSafe(F.col("latest")), F.lit(False)).alias("revisit"))
    manifest = "archive string, n_records long, n_bytes long"
    alone = rows.mapInArrow(lambda it: _write(_alone(it, shared), folder, date), manifest)
    out = common.materialize(alone.unionAll(copies.mapInArrow(lambda it: _write(it, folder, date), manifest)), "manifest")
    shared.destroy()
    common.discard(copied)
    return out


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("archive").to_pylist():
            with open_shared(path, "rb") as f:
                members = zip_members(f)
                for name, (at, size) in members.items():
                    if name.endswith(".idx"):
                        base = members[name.removesuffix(".idx") + ".warc"][0]
                        rows = [tuple(map(int, x.split())) for x in read_at(f, at, size).decode().splitlines()]
                        yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array([base + a for a, _ in rows], pa.int64()), pa.array([n for _, n in rows], pa.int64())], ["archive", "at", "size"])


def _page(text: str) -> int | None:
    return None if text == "None" else int(text)


def _fetch(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    opened, f = None, None
    for batch in batches:
        out: list[list] = [[] for _ in range(7)]
        held = 0

        def full() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])

        for path, at, size in zip(batch.column("archive").to_pylist(), batch.column("at").to_pylist(), batch.column("size").to_pylist(), strict=True):
            if path != opened:
                if f:
                    f.close()
                opened, f = path, open_shared(path, "rb")
            fields, block = parse_record(read_at(f, at, size))
            kind, digest, n = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["Payload-Length"])
            if kind == "response":
                block = block.partition(b"\r\n\r\n")[2]
                if digest32(block) != digest or len(block) != n:
                    raise ValueError(f"{path}: payload at {at} doesn't match its digest")
            values = [_page(fields["Page-ID"]), fields["WARC-Target-URI"], n, digest, kind, _page(fields["Refers-To-Page-ID"]) if kind == "revisit" else None, block if payloads and kind == "response" else None]
            for column, value in zip(out, values, strict=True):
                column.append(value)
            held += len(block) if payloads else 0
            if held >= common.SLICE_BYTES:
                yield full()
                out, held = [[] for _ in range(7)], 0
        yield full()
    if f:
        f.close()


def read_archives(manifest: DataFrame, *, payloads: bool = True) -> DataFrame:
    """Every record of the archives (SCHEMA); revisits have no payload of their own."""
    index = manifest.select("archive").mapInArrow(_index, "archive string, at long, size long")
    total = manifest.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    parts = min(total // MEMBER_BYTES + 1, 32 * manifest.sparkSession.sparkContext.defaultParallelism)
    dealt = index.repartition(int(parts), F.col("archive"), F.expr(f"at div {MEMBER_BYTES // 4}")).sortWithinPartitions("archive", "at")
    return dealt.mapInArrow(lambda it: _fetch(it, payloads), SCHEMA)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(common.table(spark, sf_dir, "pages"), common.scratch_path(spark, "archives"))
    return read_archives(manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op8_warc": op8_warc}

#: DuckDB has no base 32; its alphabet is looked up five bits at a time.
ORACLES = {
    "op8_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS x FROM p),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789abcdef', substr(x, i, 1))]), '') AS bits FROM d),
e AS (SELECT *, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(list_sum(list_transform(range(1, 6), lambda j: CAST(substr(bits, CAST(i * 5 + j AS BIGINT), 1) AS BIGINT) * CAST(2 ** (5 - j) AS BIGINT))) AS BIGINT) + 1, 1)), '') AS digest,
  max(page_id) OVER (PARTITION BY x) AS latest FROM b)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id IS DISTINCT FROM latest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM latest THEN latest END AS refers_to FROM e
"""
}
