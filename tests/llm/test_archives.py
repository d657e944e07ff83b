"""Packaged web archives: exact round trip, ranges, damaged and foreign packages."""

import gzip
import hashlib
import io
import json
import random
import zipfile

import pytest

from tavola.llm import zip_archives as Z

SCHEMA = "page_id long, url string, html string, digest string, id string, first int, package int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", None, 1, 2) for r in rows], SCHEMA)


def hard_rows():
    rng = random.Random(5)
    long = "ä" * 400_000 + "\r\n\r\nWARC/1.1\r\n"
    same = "<p>" + "copy " * 40 + "</p>"
    rows = [(i, f"http://h/{i}", "<html>" + "é\n" * rng.randrange(0, 300)) for i in range(60)]
    rows += [(100 + i, f"http://copy/{i}", same) for i in range(50)]
    rows += [(90, "http://first/", same), (7, "http://h/again", rows[7][2]), (200, None, None), (201, "", ""),
             (202, "http://x/ü\r\nX: 1", "x" * 99), (203, "u", "x" * 99), (204, "u", "y" * 100), (205, "u", "y" * 100),
             (206, "u", long), (207, "u", long), (None, "http://n/", "z" * 500), (None, "http://n/", "z" * 500),
             (-3, "u", "w" * 300), (300, "u", "w" * 300), (None, "u", "w" * 300)]
    return rows


def brute(rows):
    """A row each; of rows repeated with one id and payload one is the response."""
    first, out, had = {}, [], set()
    for page, _, html in rows:
        body = (html or "").encode()
        if len(body) >= 100 and page is not None:
            first[body] = min(page, first.get(body, page))
    for page, _, html in rows:
        body = (html or "").encode()
        least = first.get(body, None)
        revisit = len(body) >= 100 and (page != least or (page, body) in had)
        had.add((page, body))
        out.append((page, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", least if revisit else None))
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, v or 0) if not isinstance(v, str) else (True, v) for v in r))


@pytest.fixture(scope="module")
def written(spark):
    roll, Z.ROLL = Z.ROLL, 20_000
    try:
        yield Z.write_packages(frame(spark, hard_rows()))
    finally:
        Z.ROLL = roll


def test_round_trip(spark, written, monkeypatch):
    monkeypatch.setattr(Z, "RANGE", 2_000)
    records = Z.read_packages(written)
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in records.collect()]
    assert order(got) == order(brute(hard_rows()))
    full = [(r["page_id"], bytes(r["payload"]).decode()) for r in Z.resolved(records).collect()]
    assert order(full) == order([(p, h or "") for p, _, h in hard_rows()])
    assert Z.read_packages(written, payloads=False).filter("payload IS NOT NULL").count() == 0


def test_query(spark, tmp_path):
    frame(spark, hard_rows()).write.parquet(str(tmp_path / "pages.parquet"))
    assert order(map(tuple, Z.op11_zip_archives(spark, str(tmp_path)).collect())) == order(brute(hard_rows()))


def test_packages_are_plain_zip_and_warc(written):
    """Other readers understand them: zipfile, gzip, and offsets in the index."""
    n = 0
    for p in written.collect():
        z = zipfile.ZipFile(p["package"])
        assert z.testzip() is None and z.namelist() == [Z.ARCHIVE, Z.INDEX, Z.PACKAGE]
        assert all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())
        archive, index = z.read(Z.ARCHIVE), z.read(Z.INDEX)
        assert gzip.decompress(archive).count(b"WARC/1.1\r\nWARC-Type: ") == p["records"]
        assert json.loads(z.read(Z.PACKAGE))["resources"][1]["hash"] == "sha256:" + hashlib.sha256(index).hexdigest()
        for line in index.decode().splitlines():
            e = json.loads(line.split(" ", 1)[1])
            assert gzip.decompress(archive[e["offset"]: e["offset"] + e["length"]]).startswith(b"WARC/1.1\r\n")
            n += 1
    assert n == len(hard_rows()) and written.count() > 1


def test_find_one_record(written):
    found = {}
    for p in written.collect():
        f = Z.Ranges(p["package"])
        for page in (0, 33, 90, 206, 5555):
            r = Z.find_record(f, page)
            if r:
                found[page] = r
    assert sorted(found) == [0, 33, 90, 206] and found[33]["url"] == "http://h/33"
    assert found[206]["payload"].decode() == next(h for p, _, h in hard_rows() if p == 206)


class Bytes:
    """Range reads of bytes, counted; ``shift`` pretends that much lies in front."""

    def __init__(self, data):
        self.data, self.size, self.read = data, len(data), 0

    def read_at(self, n, at):
        self.read += n
        return self.data[at: at + n]


def test_directory_of_foreign_packages():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("stored.txt", b"0123456789" * 20_000)
        z.writestr(zipfile.ZipInfo("ünï.txt"), b"abc")
        z.writestr("packed.txt", b"a" * 1000, compress_type=zipfile.ZIP_DEFLATED)
        z.comment = b"a comment with PK\5\6 inside"
    f = Bytes(out.getvalue())
    found = Z.members(f, f.size)
    assert sorted(found) == ["stored.txt", "ünï.txt"]
    for name, body in (("stored.txt", b"0123456789" * 20_000), ("ünï.txt", b"abc")):
        at, n = found[name]
        assert f.data[at: at + n] == body
    assert f.read < 70_000  # directory and headers, not the members


def test_many_members_need_zip64():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i in range(66_000):
            z.writestr(f"m{i}", b"%d" % i)
    f = Bytes(out.getvalue())
    found = Z.members(f, f.size)
    assert len(found) == 66_000
    at, n = found["m65999"]
    assert f.data[at: at + n] == b"65999"


def test_members_beyond_four_gigabytes():
    """A directory whose offsets need ZIP64, over a file that is mostly a hole."""
    hole = 5 << 30

    class Far(Bytes):
        def read_at(self, n, at):
            return super().read_at(n, at - hole)

    out = io.BytesIO()
    out.close_ = out.close
    out.close = lambda: None
    z = Z.ZipWriter(out)
    z.at = hole
    z.open("a")
    z.write(b"far away")
    z.close_member()
    z.finish()
    f = Far(out.getvalue())
    start, n = Z.members(f, hole + f.size)["a"]
    assert f.read_at(n, start) == b"far away" and start > hole


def test_damaged_packages(spark, tmp_path):
    with pytest.raises(Z.BadPackage):
        Z.members(Bytes(b"not a package" * 10), 130)
    pack = [r["package"] for r in Z.write_packages(frame(spark, [(1, "u", "text " * 100)])).collect()][0]
    data = bytearray(open(pack, "rb").read())
    f = Bytes(bytes(data))
    start, n = Z.members(f, f.size)[Z.ARCHIVE]
    record = Z.zlib.decompress(bytes(data[start: start + n]), 31)
    with pytest.raises(Z.BadPackage):
        Z.parse_record(record.replace(b"text text", b"test text", 1))


def test_no_rows(spark):
    packages = Z.write_packages(frame(spark, []))
    assert packages.count() == 0 and Z.read_packages(packages).count() == 0
