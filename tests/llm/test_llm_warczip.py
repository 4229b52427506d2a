import gzip
import hashlib
import io
import json
import zipfile

import pytest

from regulon.llm import warczip

PAGES = "page_id long, url string, html string"


def reader(data):
    """(read, bytes read so far)."""
    log = []

    def read(at, n):
        assert at >= 0
        log.append(n)
        return data[at : at + n]

    return read, log


@pytest.mark.parametrize("large", [False, True])
def test_directory_and_ranges(large):
    members = [("a.txt", b"x" * 1000), ("dir/é.bin", b""), ("b", b"PK\5\6 PK\1\2")]
    data = warczip.package(members, zip64=large)
    with zipfile.ZipFile(io.BytesIO(data)) as z:  # another reader agrees
        assert [(n, z.read(n)) for n in z.namelist()] == members
    read, log = reader(data)
    found = warczip.directory(read, len(data))
    assert list(found) == [n for n, _ in members]
    for name, body in members:
        at = warczip.first_byte(read, found[name])
        assert data[at : at + found[name].size] == body


def test_reads_other_writers_files():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        with z.open("big", "w", force_zip64=True) as f:
            f.write(b"stored with a ZIP64 local header")
        z.writestr("packed", b"a" * 1000, compress_type=zipfile.ZIP_DEFLATED)
        z.comment = b"a comment with PK\5\6 in it" + b"." * 30
    data = out.getvalue()
    read, _ = reader(data)
    found = warczip.directory(read, len(data))
    at = warczip.first_byte(read, found["big"])
    assert data[at : at + found["big"].size] == b"stored with a ZIP64 local header"
    with pytest.raises(ValueError):
        warczip.first_byte(read, found["packed"])
    with pytest.raises(ValueError):
        warczip.directory(reader(b"no zip at all")[0], 13)


def test_one_record_reads_little_of_the_package():
    records = [warczip.record(k, "u", b"z" * 20_000, "00", None) for k in range(50)]
    index, at = "", 0
    for k, r in enumerate(records):
        index += f'{{"page": {k}, "range": [{at}, {len(r)}]}}\n'
        at += len(r)
    data = warczip.package([(warczip.DATA, b"".join(records)), (warczip.INDEX, index.encode())], zip64=True)
    read, log = reader(data)
    assert warczip.find(read, len(data), 33).payload == b"z" * 20_000
    assert sum(log) < 20_000 + 80_000 < len(data) / 5
    assert warczip.find(read, len(data), 99) is None


def test_record_round_trip_and_damage():
    one = warczip.record(5, "http://x/\r\ny é", "pay\r\n\r\nload é".encode(), "ab", None)
    back = warczip.parse_record(one)
    assert back.payload.decode() == "pay\r\n\r\nload é" and back.page("WARC-Record-ID") == 5
    assert back.headers["WARC-Target-URI"] == "http://x/%0D%0Ay%2028é"
    for broken in (one[:-1], one + b"x", b"HTTP" + one):
        with pytest.raises(ValueError):
            warczip.parse_record(broken)


def brute(rows):
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, i), i)
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        to = first.get(h) if len(raw) >= 100 else None
        to = None if to is None or i is not None and i <= to else to
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


def test_pages_against_brute_force(spark):
    body, small = "é" * 50, "s" * 99
    rows = [(i, f"u{i}", body) for i in (7, 3, 9, 3)] + [(i, None, small) for i in (1, 2)]
    rows += [(20, "a", None), (21, "b", ""), (None, "c", body), (None, "d", "alone " * 40), (30, "e", "p" * 300_000), (31, "e", "p" * 300_000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], PAGES + ", digest string, r_page_id int").repartition(4)
    got = warczip.warc_packages(df, package_bytes=1000).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)
    assert warczip.warc_packages(spark.createDataFrame([], PAGES)).count() == 0


def warc(k, body, kind="response"):
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{k}>\r\nWARC-Date: 2024-01-0{k % 9 + 1}T00:00:00Z\r\n"
    return (head + f"WARC-Target-URI: http://x/{k}\r\nContent-Length: {len(body)}\r\n\r\n").encode() + body + b"\r\n\r\n"


def foreign(path, plain, packed, unlisted):
    """A package as other tools write it: several archive members, a CDXJ index, other files, ZIP64 members."""
    members, lines = {}, []
    for name, rows, pack in (("one.warc", plain, False), ("two.warc.gz", packed, True), ("three.warc", unlisted, False), ("four.warc.gz", unlisted[:1], True)):
        data = b""
        for k, body in rows:
            one = gzip.compress(warc(k, body)) if pack else warc(k, body)
            if name in ("one.warc", "two.warc.gz"):
                entry = {"url": f"http://x/{k}", "filename": name, "offset": str(len(data)), "length": str(len(one))}
                lines.append(f"x)/{k} 20240101000000 {json.dumps(entry)}\n")
            data += one
        members[f"archive/{name}"] = data
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("datapackage.json", "{}", compress_type=zipfile.ZIP_DEFLATED)
        for name, data in members.items():
            with z.open(name, "w", force_zip64=True) as f:
                f.write(data)
        z.writestr("indexes/index.cdxj", "".join(lines))
        z.writestr("pages/pages.jsonl", "{}\n")
    return [*plain, *packed, *unlisted, unlisted[0]]


def test_foreign_packages_on_disk(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warczip, "STEP", 37)  # index lines lie over several steps
    want = []
    for n in range(3):
        bodies = [(100 * n + k, f"body {k} é\r\n\r\n".encode() * (k + 1)) for k in range(12)]
        want += [(f"{n}.wacz", k, b) for k, b in foreign(tmp_path / f"{n}.wacz", bodies[:4], bodies[4:8], bodies[8:])]
    got = warczip.read_archives(spark, str(tmp_path / "*.wacz")).collect()
    assert sorted((r["path"].rsplit("/", 1)[1], r["record_id"], bytes(r["content"])) for r in got) == sorted((p, f"<urn:uuid:{k}>", b) for p, k, b in want)
    for r in got:
        assert r["content_sha256"] == hashlib.sha256(r["content"]).hexdigest() and r["content_bytes"] == len(r["content"])
        assert r["record_type"] == "response" and r["date"].startswith("2024-01-0") and r["target_uri"].startswith("http://x/")


def test_own_packages_as_files(spark, tmp_path):
    path = warczip.scratch_path(spark, "test-warc")
    rows = [(k, f"u{k}", f"page {k % 5} " * 30) for k in range(40)] + [(None, None, "x")]
    warczip.write_packages(spark.createDataFrame(rows, PAGES), path, package_bytes=2000, date="2024-05-06T07:08:09Z")
    for k, r in enumerate(spark.read.parquet(path).collect()):
        (tmp_path / f"{k}.zip").write_bytes(r["package"])
    got = warczip.read_archives(spark, str(tmp_path)).collect()
    assert len(got) == 41 and {r["date"] for r in got} == {"2024-05-06T07:08:09Z"} and all(r["record_id"] for r in got)
    assert sorted(bytes(r["content"]).decode() for r in got if r["record_type"] == "response") == sorted([*(f"page {k} " * 30 for k in range(5)), "x"])


def test_damaged_archives_are_refused(spark, tmp_path):
    (tmp_path / "bad.zip").write_bytes(warczip.package([("archive/data.warc", b"no record at all")]))
    with pytest.raises(Exception, match="not a WARC record"):
        warczip.read_archives(spark, str(tmp_path)).collect()
