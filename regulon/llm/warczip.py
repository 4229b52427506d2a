"""WARC records in ZIP packages, read back by ranges without extraction.

Writing: each page is a WARC record. Of pages with equal payloads of at least
``MIN_REVISIT`` bytes the one with the smallest ``page_id`` is a response and the
others are revisits that refer to it. Records go to packages of about
``PACKAGE_BYTES``: ZIP files whose members are *stored*, ``archive/data.warc`` and
an index, ``indexes/index.jsonl``, with the offset and length of each record.
A package is a row with a binary value in Parquet, so any store that Spark reaches
will do.

Reading: the end-of-central-directory record is found from the end, ZIP64
records and fields are followed where they are present, the central directory
gives the members, a member's local header its first byte. The index member is
read, and each record by the range the index names. Everything goes through
``read(offset, size)``, so a package may as well lie in an object store.

``read_archives`` reads ZIP files that lie at paths, whoever wrote them: the files are
listed by Spark, a task reads a file's directory and its indexes (``indexes/*``: CDXJ
lines, or the own form) by seeking in it, and gives out the ranges of the records of
all ``archive/*`` members; the ranges are dealt out over all tasks, each of which seeks
and reads its records. So one large archive is read by many tasks, and neither it nor
a member is held whole. Members without an index are walked record by record; records
of ``.gz`` members are unpacked on their own.

Defined cases: null html is an empty payload, a null url has no target header;
of rows with the same smallest id and payload each is a response; a null
``page_id`` counts as the largest and its record is named by its payload's digest; an
empty table gives no rows and no package. Pages have no time of their own, so all
records of a package carry the date that the writer is given (``date``).
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import common

MIN_REVISIT = 100
PACKAGE_BYTES = 8 << 20
DATA, INDEX = "archive/data.warc", "indexes/index.jsonl"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:page:"
DATE = "1970-01-01T00:00:00Z"

Read = Callable[[int, int], bytes]


# ── WARC records ──────────────────────────────────────────────────────────


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One record; a revisit holds the headers alone."""
    revisit = refers_to is not None
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:sha256:{digest}>" if page_id is None else f"<{URN}{page_id}>",
        "WARC-Date": date,
        "WARC-Target-URI": None if url is None else "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in url),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Payload-Length": len(payload),
        "WARC-Profile": PROFILE if revisit else None,
        "WARC-Refers-To": f"<{URN}{refers_to}>" if revisit else None,
        "Content-Type": "text/html; charset=utf-8",
        "Content-Length": 0 if revisit else len(payload),
    }
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None) + "\r\n"
    return head.encode() + (b"" if revisit else payload) + b"\r\n\r\n"


@dataclass(frozen=True)
class Record:
    headers: dict[str, str]
    payload: bytes

    def page(self, name: str) -> int | None:
        value = self.headers.get(name, "")
        return int(value[len(URN) + 1 : -1]) if value.startswith(f"<{URN}") else None


def parse_record(data: bytes) -> Record:
    head, mark, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not mark or not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines)
    size = int(headers["Content-Length"])
    if len(rest) < size or rest[size:] != b"\r\n\r\n":
        raise ValueError("a WARC record of another length than its header says")
    return Record(headers, rest[:size])


# ── ZIP packages ──────────────────────────────────────────────────────────

LOCAL, CENTRAL, END = b"PK\3\4", b"PK\1\2", b"PK\5\6"
END64, LOCATOR64 = b"PK\6\6", b"PK\6\7"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


def package(members: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A ZIP file of stored members; ``zip64`` writes the large forms whatever the sizes."""
    body, central = bytearray(), bytearray()
    for name, data in members:
        raw, crc, at = name.encode(), zlib.crc32(data), len(body)
        large = zip64 or max(at, len(data)) >= FULL32
        size = FULL32 if large else len(data)
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if large else b""
        body += LOCAL + struct.pack("<HHHHHIIIHH", 45, 0x800, 0, 0, 0x21, crc, size, size, len(raw), len(extra)) + raw + extra + data
        extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), at) if large else b""
        central += CENTRAL + struct.pack(
            "<HHHHHHIIIHHHHHII", 45, 45, 0x800, 0, 0, 0x21, crc, size, size, len(raw), len(extra), 0, 0, 0, 0, FULL32 if large else at
        ) + raw + extra
    start, n = len(body), len(members)
    large = zip64 or start >= FULL32 or n >= FULL16
    tail = b""
    if large:
        tail = END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, len(central), start)
        tail += LOCATOR64 + struct.pack("<IQI", 0, start + len(central), 1)
    few = FULL16 if large else n
    tail += END + struct.pack("<HHHHIIH", 0, 0, few, few, FULL32 if large else len(central), FULL32 if large else start, 0)
    return bytes(body + central + tail)


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    offset: int  # of the local header
    crc: int


def directory(read: Read, size: int) -> dict[str, Member]:
    """The members of a ZIP file by name, from its central directory."""
    reach = min(size, 22 + FULL16)
    tail = read(size - reach, reach)
    at = tail.rfind(END)
    while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
        at = tail.rfind(END, 0, at)  # the signature inside the comment
    if at < 0:
        raise ValueError("no end of central directory")
    disk, _, _, n, length, start, _ = struct.unpack_from("<HHHHIIH", tail, at + 4)
    where = size - reach + at - 20
    locator = read(where, 20) if where >= 0 else b""
    if locator[:4] == LOCATOR64:
        _, end64, disks = struct.unpack_from("<IQI", locator, 4)
        head = read(end64, 56)
        if head[:4] != END64 or disks > 1:
            raise ValueError("a broken or divided ZIP64 directory")
        n, length, start = struct.unpack_from("<QQQ", head, 32)
    elif disk:
        raise ValueError("a ZIP file in several parts")
    data, at, found = read(start, length), 0, {}
    for _ in range(n):
        if data[at : at + 4] != CENTRAL:
            raise ValueError("a broken central directory")
        _, _, flags, method, _, _, crc, _, plain, n_name, n_extra, n_comment, _, _, _, offset = struct.unpack_from("<HHHHHHIIIHHHHHII", data, at + 4)
        packed = struct.unpack_from("<I", data, at + 20)[0]
        name = data[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = data[at + 46 + n_name : at + 46 + n_name + n_extra]
        wide = extra64(extra)
        # the large fields stand in this order, and only those whose small one is full
        plain, packed, offset = (wide.pop(0) if x == FULL32 and wide else x for x in (plain, packed, offset))
        found[name] = Member(name, method, packed, offset, crc)
        at += 46 + n_name + n_extra + n_comment
    return found


def extra64(extra: bytes) -> list[int]:
    """The 64-bit values of the ZIP64 extra field, if there is one."""
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            return list(struct.unpack_from(f"<{size // 8}Q", extra, at + 4))
        at += 4 + size
    return []


def first_byte(read: Read, member: Member) -> int:
    """Where a stored member's data starts."""
    if member.method != 0:
        raise ValueError(f"{member.name} is compressed; only stored members can be read by ranges")
    head = read(member.offset, 30)
    if head[:4] != LOCAL:
        raise ValueError(f"no local header of {member.name}")
    return member.offset + 30 + sum(struct.unpack_from("<HH", head, 26))


def records(read: Read, size: int) -> Iterator[Record]:
    """All records of a package: the index first, then each record's range."""
    members = directory(read, size)
    index = members[INDEX]
    data = first_byte(read, members[DATA])
    for line in read(first_byte(read, index), index.size).splitlines():
        at, length = json.loads(line)["range"]
        yield parse_record(read(data + at, length))


def find(read: Read, size: int, page_id: int) -> Record | None:
    """One page's record: the directory, the index and one range are read."""
    members = directory(read, size)
    index = members[INDEX]
    for line in read(first_byte(read, index), index.size).splitlines():
        entry = json.loads(line)
        if entry["page"] == page_id:
            return parse_record(read(first_byte(read, members[DATA]) + entry["range"][0], entry["range"][1]))
    return None


# ── Spark ─────────────────────────────────────────────────────────────────

PACKAGE_SCHEMA = pa.schema([("n_records", pa.int64()), ("package", pa.binary())])
RESULT_SCHEMA = pa.schema(
    [
        ("page_id", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
    ]
)


def revisits(pages: DataFrame, least: int) -> DataFrame:
    """(page_id, digest, refers_to) of pages whose payload an earlier one has.

    Only digests are shuffled; the smallest id of each is combined in the task
    first, and a digest that many pages share is a join that Spark can split.
    """
    narrow = pages.where(F.octet_length("html") >= least).select("page_id", "digest")
    shared = narrow.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n"))
    shared = shared.where("n > 1 and refers_to is not null").drop("n")
    return narrow.join(shared, "digest").where("page_id is null or page_id > refers_to").distinct()


def write_packages(pages: DataFrame, path: str, least: int = MIN_REVISIT, package_bytes: int = PACKAGE_BYTES, date: str = DATE) -> None:
    """Pages (page_id, url, html) -> packages in Parquet files at ``path``."""
    rows = common.pick(pages, page_id="long", url="string", html="string")
    rows = rows.withColumn("html", F.coalesce("html", F.lit(""))).withColumn("digest", F.sha2("html", 256))
    again = revisits(rows, least).toDF(*(f"r_{c}" for c in ("digest", "page_id", "refers_to")))
    same = (F.col("digest") == F.col("r_digest")) & F.col("page_id").eqNullSafe(F.col("r_page_id"))
    rows = rows.join(again, same, "left").select("page_id", "url", "html", "digest", F.col("r_refers_to").alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, index = bytearray(), []

        def flush() -> pa.RecordBatch:
            whole = package([(DATA, bytes(data)), (INDEX, "".join(index).encode())])
            return common.batch_of(PACKAGE_SCHEMA, [[len(index)], [whole]])

        for batch in batches:
            for page_id, url, html, digest, refers_to in common.rows_of(batch, "page_id", "url", "html", "digest", "refers_to"):
                one = record(page_id, url, html.encode(), digest, refers_to, date)
                if index and len(data) + len(one) > package_bytes:
                    yield flush()
                    data, index = bytearray(), []
                index.append(json.dumps({"page": page_id, "range": [len(data), len(one)]}) + "\n")
                data += one
        if index:
            yield flush()

    rows.mapInArrow(run, "n_records long, package binary").write.parquet(path)


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """One row a record, from the packages alone; a response's digest is taken anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column("package"):
                data = memoryview(value.as_buffer())
                out = []
                for r in records(lambda at, n: bytes(data[at : at + n]), len(data)):  # noqa: B023
                    kind, digest = r.headers["WARC-Type"], r.headers["WARC-Payload-Digest"].removeprefix("sha256:")
                    size = int(r.headers["WARC-Payload-Length"])
                    if kind == "response" and (len(r.payload), common.sha256_hex(r.payload)) != (size, digest):
                        raise ValueError(f"payload of {r.headers.get('WARC-Record-ID')} does not have its digest")
                    out.append((r.page("WARC-Record-ID"), size, digest, kind, r.page("WARC-Refers-To")))
                yield common.batch_of(RESULT_SCHEMA, [list(c) for c in zip(*out)])

    files = spark.read.schema("n_records long, package binary").parquet(path)
    return files.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def warc_packages(pages: DataFrame, **options) -> DataFrame:
    """The contract's digest: write the packages, read them back."""
    path = scratch_path(pages.sparkSession, "warc")
    write_packages(pages, path, **options)
    return read_packages(pages.sparkSession, path)


# ── archives that lie at paths ────────────────────────────────────────────

STEP = 1 << 20  # bytes of an index read at once
RANGES_SCHEMA = pa.schema([("path", pa.string()), ("member", pa.string()), ("at", pa.int64()), ("n", pa.int64()), ("gz", pa.bool_())])
ARCHIVE_SCHEMA = pa.schema(
    [
        ("path", pa.string()),
        ("member", pa.string()),
        ("record_id", pa.string()),
        ("record_type", pa.string()),
        ("target_uri", pa.string()),
        ("date", pa.string()),
        ("content_bytes", pa.int64()),
        ("content_sha256", pa.string()),
        ("content", pa.binary()),
    ]
)


def opened(path: str):
    """A file of any file system that Arrow knows, for reading by ranges."""
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri("file:///" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path)
    return system.open_input_file(name)


def reads(file) -> Read:
    return lambda at, n: file.read_at(n, at)


def lines_of(read: Read, start: int, size: int) -> Iterator[bytes]:
    """Lines of a stored member, a step at a time."""
    rest = b""
    for at in range(0, size, STEP):
        *whole, rest = (rest + read(start + at, min(STEP, size - at))).split(b"\n")
        yield from whole
    if rest:
        yield rest


def indexed(line: bytes, members: dict[str, Member]) -> tuple[str, int, int] | None:
    """(member, offset, length) that an index line names: an own line, or CDXJ (key, time, JSON)."""
    start = line.find(b"{")
    if start < 0:
        return None
    entry = json.loads(line[start:])
    if "range" in entry:
        return DATA, *entry["range"]
    name = f"archive/{entry.get('filename', '')}"
    if name not in members or "offset" not in entry or "length" not in entry:
        return None
    return name, int(entry["offset"]), int(entry["length"])


def walked(read: Read, start: int, size: int) -> Iterator[tuple[int, int]]:
    """(offset, length) of the records of a plain member without an index, header after header."""
    at = 0
    while at < size:
        head = read(start + at, min(1 << 16, size - at))
        end = head.find(b"\r\n\r\n")
        length = next((int(x.split(b":")[1]) for x in head[: max(end, 0)].split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
        if length is None:
            raise ValueError("not a WARC record")
        n = end + 4 + length + 4
        yield at, n
        at += n


def archive_ranges(read: Read, size: int) -> Iterator[tuple[str, int, int, bool]]:
    """(member, first byte in the file, length, whether packed) of every record of an archive."""
    members = directory(read, size)
    data = {m.name: first_byte(read, m) for m in members.values() if m.name.startswith("archive/") and m.size}
    seen: set[str] = set()
    for index in (m for m in members.values() if m.name.startswith("indexes/") and m.method == 0):
        if index.name.endswith((".gz", ".idx")):
            continue  # packed indexes: the members are walked
        for line in lines_of(read, first_byte(read, index), index.size):
            if found := indexed(line, members):
                name, at, n = found
                seen.add(name)
                yield name, data[name] + at, n, name.endswith(".gz")
    for name in sorted(data.keys() - seen):
        if name.endswith(".gz"):
            yield name, data[name], members[name].size, True  # one range: its records follow each other
        else:
            for at, n in walked(read, data[name], members[name].size):
                yield name, data[name] + at, n, False


def unpacked(data: bytes) -> Iterator[bytes]:
    """The records of packed bytes, each a stream of its own."""
    while data:
        stream = zlib.decompressobj(31)
        yield stream.decompress(data) + stream.flush()
        data = stream.unused_data


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row a record of the ZIP packages at ``path`` (a file, a folder or a pattern), with its content.

    Columns: path, member, record_id, record_type, target_uri, date, content_bytes,
    content_sha256 (taken anew), content.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length")  # the contents are not read here

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, size in common.rows_of(batch, "path", "length"):
                out = []
                with opened(name) as file:
                    for row in archive_ranges(reads(file), size):
                        out.append((name, *row))
                        if len(out) == 10_000:
                            yield common.batch_of(RANGES_SCHEMA, [list(c) for c in zip(*out)])
                            out = []
                if out:
                    yield common.batch_of(RANGES_SCHEMA, [list(c) for c in zip(*out)])

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for batch in common.slices(batches, 100):
            out = []
            for path, member, at, n, packed in common.rows_of(batch, "path", "member", "at", "n", "gz"):
                if path != name:
                    name, file = path, opened(path)
                data = file.read_at(n, at)
                for one in unpacked(data) if packed else (data,):
                    r = parse_record(one)
                    get = r.headers.get
                    out.append((path, member, get("WARC-Record-ID"), get("WARC-Type"), get("WARC-Target-URI"), get("WARC-Date"),
                                len(r.payload), common.sha256_hex(r.payload), r.payload))
            if out:
                yield common.batch_of(ARCHIVE_SCHEMA, [list(c) for c in zip(*out)])

    dealt = files.repartition(common.partitions(spark), "path").mapInArrow(ranges, "path string, member string, at long, n long, gz boolean")
    dealt = dealt.repartitionByRange(common.partitions(spark), "path", "at").sortWithinPartitions("path", "at")
    return dealt.mapInArrow(
        contents, "path string, member string, record_id string, record_type string, target_uri string, date string, "
        "content_bytes long, content_sha256 string, content binary")  # fmt: skip
