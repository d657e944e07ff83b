"""Web archives packaged in ZIP files: written by tasks, read back by byte ranges.

A package is a ZIP file with stored (not compressed) members: ``archive/data.warc.gz``
(one gzip member for each record), ``indexes/index.cdxj`` (a line for each
record with its offset and length, sorted by key) and ``datapackage.json``. As
nothing is compressed at ZIP level, a record lies in the package as it lies in the
archive: the reader parses the end record, the ZIP64 records and the central
directory, finds where the members start, and reads the ranges that the index
names. Nothing is extracted.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tavola.llm.common import map_rows, stored, table
from tavola.session import scratch_path

ARCHIVE, INDEX, PACKAGE = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
SMALLEST = 100                 # bytes of a payload from which copies become revisits
ROLL = 256 << 20               # bytes of archive after which a task opens the next package
RANGE = 4 << 20                # bytes of archive that one read covers
SALTS = 32
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAX32, MAX16 = 0xFFFFFFFF, 0xFFFF


# ---- ZIP: what a package needs

class ZipWriter:
    """Writes stored members one after the other to a stream that cannot seek.

    Sizes follow each member in a data descriptor; every entry carries ZIP64
    fields, and ZIP64 end records are written, so no member or file is too long.
    """

    def __init__(self, out):
        self.out, self.at, self.entries = out, 0, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def open(self, name: str) -> None:
        self.name, self.header, self.crc = name.encode(), self.at, 0
        # version 4.5, sizes in the descriptor (bit 3), names in UTF-8 (bit 11), stored, 1980-01-01
        zip64 = struct.pack("<HHQQ", 1, 16, 0, 0)
        self._put(struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 0x0808, 0, 0, 0x21, 0, MAX32, MAX32, len(self.name), len(zip64))
                  + self.name + zip64)
        self.begin = self.at

    def write(self, data: bytes) -> None:
        self.crc = zlib.crc32(data, self.crc)
        self._put(data)

    @property
    def size(self) -> int:
        """Bytes of the open member so far."""
        return self.at - self.begin

    def close_member(self) -> None:
        n = self.size
        self._put(struct.pack("<IIQQ", 0x08074B50, self.crc, n, n))
        self.entries.append((self.name, self.crc, n, self.header))

    def finish(self) -> None:
        start = self.at
        for name, crc, n, header in self.entries:
            zip64 = struct.pack("<HHQQQ", 1, 24, n, n, header)
            self._put(struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0x0808, 0, 0, 0x21, crc, MAX32, MAX32,
                                  len(name), len(zip64), 0, 0, 0, 0, MAX32) + name + zip64)
        end, n = self.at, len(self.entries)
        self._put(struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, end - start, start))
        self._put(struct.pack("<IIQI", 0x07064B50, 0, end, 1))
        self._put(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, MAX16, MAX16, MAX32, MAX32, 0))
        self.out.close()


class BadPackage(ValueError):
    """The file is not a package that can be read by ranges."""


def members(f, size: int) -> dict[str, tuple[int, int]]:
    """``name: (start, bytes)`` of the stored members of a ZIP file, from its
    directory alone. ``f`` needs ``read_at(n, offset)``. Members that are
    compressed or encrypted are left out: their bytes cannot be read by ranges."""
    tail_at = max(0, size - (22 + MAX16 + 20))
    tail = f.read_at(size - tail_at, tail_at)
    at = tail.rfind(b"PK\5\6")
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(b"PK\5\6", 0, at)  # the signature may stand in a comment
    if at < 0:
        raise BadPackage("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    if MAX16 == count or MAX32 in (length, start):
        if at < 20 or tail[at - 20: at - 16] != b"PK\6\7":
            raise BadPackage("no ZIP64 locator")
        where = struct.unpack_from("<Q", tail, at - 12)[0]
        end = f.read_at(56, where)
        if end[:4] != b"PK\6\6":
            raise BadPackage("no ZIP64 end record")
        count, length, start = struct.unpack_from("<QQQ", end, 32)
    found, directory, at = {}, f.read_at(length, start), 0
    for _ in range(count):
        if directory[at: at + 4] != b"PK\1\2":
            raise BadPackage("central directory damaged")
        flags, method = struct.unpack_from("<HH", directory, at + 8)
        packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", directory, at + 20)
        header = struct.unpack_from("<I", directory, at + 42)[0]
        name = directory[at + 46: at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = directory[at + 46 + n_name: at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            tag, n = struct.unpack_from("<HH", extra)
            if tag == 1:  # ZIP64: the fields that are at their limit, in this order
                longs = iter(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                plain = next(longs) if plain == MAX32 else plain
                packed = next(longs) if packed == MAX32 else packed
                header = next(longs) if header == MAX32 else header
            extra = extra[4 + n:]
        at += 46 + n_name + n_extra + n_comment
        if method == 0 and not flags & 1 and packed == plain:
            local = f.read_at(30, header)
            if local[:4] != b"PK\3\4":
                raise BadPackage(f"no local header of {name}")
            found[name] = header + 30 + sum(struct.unpack_from("<HH", local, 26)), plain
    return found


# ---- WARC: records

def _plain(value: str) -> str:
    """A header value on one line: blanks, controls and characters beyond ASCII percent-encoded."""
    return "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in value)


def record_bytes(page: int | None, copy: int, url: str | None, payload: bytes, digest: str, refers: int | None,
                 is_revisit: bool, date: str) -> bytes:
    """One WARC/1.1 record (not yet compressed). A revisit holds the response's HTTP
    header, which names the length of the full payload, but no payload."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = http if is_revisit else http + payload
    name = "null" if page is None else page
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}",
            f"WARC-Record-ID: <urn:page:{name}:{copy}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_plain(url)}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if is_revisit:
        head += [f"WARC-Refers-To: <urn:page:{'null' if refers is None else refers}:0>", f"WARC-Profile: {REVISIT}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(data: bytes) -> tuple[dict[str, str], int]:
    """Header fields (names in lower case) and where the block behind them starts."""
    end = data.index(b"\r\n\r\n")
    lines = data[:end].decode("utf-8", "surrogatepass").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, end + 4


def parse_record(data: bytes) -> dict:
    """Fields of one record; the digest of a payload that is there must be right."""
    head, at = headers(data)
    block = data[at: at + int(head["content-length"])]
    http, body = headers(block)
    payload, digest = block[body:], head["warc-payload-digest"].removeprefix("sha256:")
    page = head["warc-record-id"].split(":")[2]
    refers = head.get("warc-refers-to", "::null:").split(":")[2]
    kind, n = head["warc-type"], int(http["content-length"])
    if kind == "response" and (len(payload) != n or hashlib.sha256(payload).hexdigest() != digest):
        raise BadPackage(f"payload of page {page} is damaged")
    return {"page_id": None if page == "null" else int(page), "url": head.get("warc-target-uri"), "record_type": kind,
            "refers_to": None if refers == "null" else int(refers), "payload_bytes": n, "payload_digest": digest,
            "payload": payload if kind == "response" else None}


# ---- files of any store that pyarrow knows (local, HDFS, object stores)

def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Ranges:
    """Range reads of one file."""

    def __init__(self, path: str):
        store, name = _filesystem(path)
        self.f = store.open_input_file(name)
        self.size = self.f.size()

    def read_at(self, n: int, at: int) -> bytes:
        return self.f.read_at(n, at)

    def close(self) -> None:
        self.f.close()


class PackageWriter:
    """One package: the archive first, then its index, then its description."""

    def __init__(self, folder: str):
        # A new name for each attempt: a repeated task never meets the file of a lost one.
        self.path = f"{folder}/{uuid.uuid4().hex}.wacz"
        store, name = _filesystem(self.path)
        store.create_dir(name.rsplit("/", 1)[0], recursive=True)
        self.zip = ZipWriter(store.open_output_stream(name))
        self.zip.open(ARCHIVE)
        self.lines: list[str] = []

    def add(self, page: int | None, url: str | None, kind: str, digest: str, raw: bytes) -> None:
        at, packed = self.zip.size, zlib.compressobj(6, zlib.DEFLATED, 31)
        data = packed.compress(raw) + packed.flush()
        self.zip.write(data)
        entry = {"url": url, "digest": f"sha256:{digest}", "mime": "warc/revisit" if kind == "revisit" else "text/html",
                 "offset": at, "length": len(data), "filename": ARCHIVE.rsplit("/", 1)[1]}
        key = f"page:{0 if page is None else page:020d}"
        self.lines.append(f"{key} {json.dumps(entry)}\n")

    def finish(self) -> dict:
        n, bytes_ = len(self.lines), self.zip.size
        self.zip.close_member()
        self.zip.open(INDEX)
        index = hashlib.sha256()
        for line in sorted(self.lines):
            data = line.encode("utf-8", "surrogatepass")
            index.update(data)
            self.zip.write(data)
        n_index = self.zip.size
        self.zip.close_member()
        self.zip.open(PACKAGE)
        self.zip.write(json.dumps({"profile": "data-package", "resources": [
            {"name": "data.warc.gz", "path": ARCHIVE, "bytes": bytes_},
            {"name": "index.cdxj", "path": INDEX, "bytes": n_index, "hash": f"sha256:{index.hexdigest()}"}]}).encode())
        self.zip.close_member()
        self.zip.finish()
        return {"package": self.path, "records": n, "bytes": self.zip.at}


def with_refers(pages: DataFrame, id_col: str, payload_col: str, smallest: int = SMALLEST) -> DataFrame:
    """``id, url.., body, digest, refers``: ``refers`` is the smallest id with an equal payload of
    at least ``smallest`` bytes where that is another one (null ids count as larger than any)."""
    body = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    thin = pages.select(F.col(id_col).cast("long").alias("id"), F.sha2(body, 256).alias("digest"), F.length(body).alias("n"))
    thin = thin.filter(F.col("n") >= smallest).groupBy("id", "digest").agg(F.count(F.lit(1)).alias("n"))
    # A payload may be that of a third of all pages: the few firsts of copied payloads
    # are repeated for each salt, so its pages are dealt out.
    firsts = thin.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("ids")).filter("ids > 1")
    firsts = firsts.select(F.col("digest").alias("d"), "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    salted = thin.withColumn("salt", F.pmod(F.hash("id"), F.lit(SALTS)))
    later = (salted.join(firsts, (F.col("digest") == F.col("d")) & (F.col("salt") == F.col("s")))
             .filter("id IS NULL OR id > first").select(F.col("id").alias("i"), "d", "first"))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), body.alias("body"), F.sha2(body, 256).alias("digest"),
                        *[F.col(c).cast("string").alias("url") for c in pages.columns if c.lower() == "url"][:1])
    if "url" not in rows.columns:
        rows = rows.withColumn("url", F.lit(None).cast("string"))
    return (rows.join(later, rows["id"].eqNullSafe(F.col("i")) & (rows["digest"] == F.col("d")), "left")
            .select("id", "url", "body", "digest", F.col("first").alias("refers")))


def write_packages(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", payload_col: str = "html",
                   smallest: int = SMALLEST, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write every row as a WARC record into packages below ``folder`` (default: the
    shared folder of the session); returns the written packages ``package, records, bytes``.

    The payload is the text in UTF-8 (null: empty). Of equal payloads of at least
    ``smallest`` bytes the row with the smallest id is a response, the others are
    revisits of it. Of rows repeated with one id and payload the first written is
    taken as the response. A null id comes after all others; a null or missing
    ``url`` is left out; other columns are ignored. Each task writes a package and
    starts the next after ``ROLL`` bytes, so it holds one record and the index lines of
    one package. No rows give no package.
    """
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, f"llm-packages-{uuid.uuid4().hex}")
    rows = with_refers(pages, id_col, payload_col, smallest).sortWithinPartitions("id", "digest", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, done, last, copy, same = None, [], (), 0, 0
        for batch in batches:
            for r in range(batch.num_rows):
                page, url, body, digest, refers = (c[r].as_py() for c in batch.columns)
                copy = copy + 1 if last and last[0] == page else 0
                same = same + 1 if last == (page, digest) else 0
                last = page, digest
                is_revisit = refers is not None or same > 0 and len(body) >= smallest
                raw = record_bytes(page, copy, url, body, digest, page if refers is None else refers, is_revisit, date)
                out = out or PackageWriter(folder)
                out.add(page, url, "revisit" if is_revisit else "response", digest, raw)
                if out.zip.size >= ROLL:
                    done.append(out.finish())
                    out = None
        if out:
            done.append(out.finish())
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("package", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return stored(rows.mapInArrow(run, "package string, records long, bytes long"), "packages")


def index_entries(f: Ranges) -> tuple[int, list[dict]]:
    """Where the archive of a package starts, and the entries of its index in archive order."""
    found = members(f, f.size)
    if ARCHIVE not in found or INDEX not in found:
        raise BadPackage("no stored archive or index")
    at, n = found[INDEX]
    entries = [json.loads(line.split(" ", 1)[1]) for line in f.read_at(n, at).decode("utf-8", "surrogatepass").splitlines()]
    start, size = found[ARCHIVE]
    if any(e["offset"] + e["length"] > size for e in entries):
        raise BadPackage("the index points beyond the archive")
    return start, sorted(entries, key=lambda e: e["offset"])


def find_record(f: Ranges, page: int) -> dict | None:
    """One record of a package by its page, read alone: the index member is searched
    by bisection with small range reads, then the record's range is read."""
    found = members(f, f.size)
    (start, _), (base, n) = found[ARCHIVE], found[INDEX]
    want, low, high, step = f"page:{page:020d} ".encode(), 0, n, 4096

    def line_from(at: int) -> tuple[int, bytes]:
        """The first whole line that starts at or after ``at``, and where it starts."""
        data, read = b"", max(at - 1, 0)
        while True:
            more = f.read_at(min(step, n - read - len(data)), base + read + len(data))
            data += more
            begin = 0 if at == 0 else data.find(b"\n") + 1
            end = data.find(b"\n", begin) if at == 0 or begin else -1
            if end >= 0:
                return read + begin, data[begin: end]
            if not more:
                return n, b""

    while low < high:  # the least start whose next line is not before the wanted one
        mid = (low + high) // 2
        at, line = line_from(mid)
        if at < n and line < want:
            low = at + 1
        else:
            high = mid
    _, line = line_from(low)
    if not line.startswith(want):
        return None
    e = json.loads(line.split(b" ", 1)[1])
    return parse_record(zlib.decompress(f.read_at(e["length"], start + e["offset"]), 31))


RECORD = ("page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, "
          "payload binary, package string, offset long, length long")


def read_packages(packages: DataFrame, payloads: bool = True) -> DataFrame:
    """Records of the packages listed in column ``package``, read by ranges.

    First each package's directory and index are read and neighbouring records
    form ranges of about ``RANGE`` bytes; then the ranges are dealt to tasks, each
    record is unpacked alone and the digest of a response's payload is checked. Columns as in
    ``RECORD``; the payload of a revisit is null (see ``resolved``), with
    ``payloads=False`` all are. Damaged packages raise ``BadPackage``.
    """
    def ranges():
        def each(cols):
            for path in cols[0]:
                f = Ranges(path)
                start, entries = index_entries(f)
                f.close()
                held: list[dict] = []
                for i, e in enumerate(entries):
                    held.append(e)
                    last = i + 1 == len(entries)
                    if last or entries[i + 1]["offset"] + entries[i + 1]["length"] - held[0]["offset"] > RANGE:
                        yield {"package": [path], "start": [start], "offsets": [[x["offset"] for x in held]],
                               "lengths": [[x["length"] for x in held]]}
                        held = []
        return each

    def records():
        def each(cols):
            for path, start, offsets, lengths in zip(*cols, strict=True):
                f = Ranges(path)
                first, end = offsets[0], offsets[-1] + lengths[-1]
                data = memoryview(f.read_at(end - first, start + first))
                f.close()
                out = {name: [] for name in names}
                for at, n in zip(offsets, lengths, strict=True):
                    r = parse_record(zlib.decompress(data[at - first: at - first + n], 31))
                    if not payloads:
                        r["payload"] = None
                    for name, v in {**r, "package": path, "offset": at, "length": n}.items():
                        out[name].append(v)
                yield out
        return each

    names = [x.split()[0] for x in RECORD.split(", ")]
    found = map_rows(packages.select("package").repartition("package"),
                     "package string, start long, offsets array<long>, lengths array<long>", ranges)
    return map_rows(found.repartition("package", F.col("offsets")[0]), RECORD, records)


def resolved(records: DataFrame) -> DataFrame:
    """Records with the payload of every revisit taken from its response (of equal digest).

    A response may be that of a third of all records, so the responses that are referred to
    are repeated for each of ``SALTS`` salts and the revisits are dealt over them.
    """
    revisits = records.filter("record_type = 'revisit'").withColumn("salt", F.pmod(F.xxhash64("page_id", "package", "offset"), F.lit(SALTS)))
    wanted = revisits.select(F.col("payload_digest").alias("d")).distinct()
    bodies = records.filter("record_type = 'response'").select(F.col("payload_digest").alias("d"), F.col("payload").alias("full"))
    bodies = bodies.join(wanted, "d", "left_semi").dropDuplicates(["d"])
    bodies = bodies.select("d", "full", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    filled = revisits.join(bodies, (F.col("payload_digest") == F.col("d")) & (F.col("salt") == F.col("s")), "left")
    filled = filled.withColumn("payload", F.col("full")).select(*records.columns)
    return records.filter("record_type <> 'revisit'").unionByName(filled)


def op11_zip_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page into packaged archives, read all records back by ranges."""
    records = read_packages(write_packages(table(spark, sf_dir, "pages")), payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP11_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest AS d, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first < page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON d = payload_digest
"""
