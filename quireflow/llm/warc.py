"""WARC records in ZIP packages: writing, and range-reading them without extraction."""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import struct
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs as afs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import record_batch, scratch_path, small_batches, stage_table

DATA, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
BIG = 0xFFFFFFFF
#: Bytes of records that one task reads, or so.
READ_BYTES = 64 << 20
#: What stands before a payload in a record's block; and the date of records whose pages have none.
HTTP, NO_DATE = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n", "1970-01-01T00:00:00Z"


class PackageWriter:
    """A ZIP file of stored members, written front to back; ZIP64 where a size or place needs it or on demand."""

    def __init__(self, out, zip64: bool = False):
        self.out, self.zip64, self.at, self.members = out, zip64, 0, []

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        raw = name.encode()
        self.members.append([raw, self.at, 0, 0])
        self.put(struct.pack("<4s5H3I2H", b"PK\3\4", 45, 0x0808, 0, 0, 0x21, 0, 0, 0, len(raw), 0) + raw)

    def add(self, data: bytes) -> int:
        """Append to the open member; gives the place in it."""
        m = self.members[-1]
        place, m[2], m[3] = m[2], m[2] + len(data), zlib.crc32(data, m[3])
        self.put(data)
        return place

    def finish(self) -> None:
        _, _, n, crc = self.members[-1]
        self.put(struct.pack("<4sIQQ" if n >= BIG else "<4s3I", b"PK\7\x08", crc, n, n))

    def close(self) -> None:
        start = self.at
        for name, at, n, crc in self.members:
            wide = self.zip64 or max(n, at) >= BIG
            extra = struct.pack("<2H3Q", 1, 24, n, n, at) if wide else b""
            self.put(struct.pack("<4s6H3I5H2I", b"PK\1\2", 45, 45, 0x0808, 0, 0, 0x21, crc, BIG if wide else n, BIG if wide else n, len(name), len(extra), 0, 0, 0, 0, BIG if wide else at) + name + extra)
        size, count = self.at - start, len(self.members)
        if wide := self.zip64 or start >= BIG:
            end = self.at
            self.put(struct.pack("<4sQ2H2I4Q", b"PK\6\6", 44, 45, 45, 0, 0, count, count, size, start))
            self.put(struct.pack("<4sIQI", b"PK\6\7", 0, end, 1))
        self.put(struct.pack("<4s4H2IH", b"PK\5\6", 0, 0, 0xFFFF if wide else count, 0xFFFF if wide else count, BIG if wide else size, BIG if wide else start, 0))
        self.out.close()


class PackageReader:
    """Finds stored members by the central directory and reads byte ranges of them."""

    def __init__(self, path: str):
        store, at = afs.FileSystem.from_uri(path)
        self.file = store.open_input_file(at)
        self.members = self.directory()

    def read(self, at: int, n: int) -> bytes:
        return self.file.read_at(n, at)

    def directory(self) -> dict[str, tuple[int, int]]:
        """name -> (place of its local header, size)."""
        total = self.file.size()
        tail = self.read(max(0, total - 65_557), min(total, 65_557))
        i = tail.rfind(b"PK\5\6")
        if i < 0:
            raise ValueError("no end of central directory")
        count, size, start = struct.unpack_from("<H2I", tail, i + 10)
        if BIG in (size, start) or count == 0xFFFF:
            place = struct.unpack_from("<Q", tail, tail.rfind(b"PK\6\7", 0, i) + 8)[0]
            count, size, start = struct.unpack_from("<3Q", self.read(place, 56), 32)
        raw, at, out = self.read(start, size), 0, {}
        for _ in range(count):
            method, = struct.unpack_from("<H", raw, at + 10)
            n, full, name, extra, note = struct.unpack_from("<2I3H", raw, at + 20)
            place, = struct.unpack_from("<I", raw, at + 42)
            key = raw[at + 46 : at + 46 + name].decode()
            x, end = at + 46 + name, at + 46 + name + extra
            while x + 4 <= end:
                kind, length = struct.unpack_from("<2H", raw, x)
                if kind == 1:
                    wide = iter(struct.unpack_from(f"<{length // 8}Q", raw, x + 4))
                    full = next(wide) if full == BIG else full
                    n = next(wide) if n == BIG else n
                    place = next(wide) if place == BIG else place
                x += 4 + length
            if method:
                raise ValueError(f"{key} is not stored")
            out[key] = (place, n)
            at = end + note
        return out

    def data_at(self, name: str) -> tuple[int, int]:
        place, n = self.members[name]
        a, b = struct.unpack("<2H", self.read(place + 26, 4))
        return place + 30 + a + b, n


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def urn(page) -> str:
    return f"<urn:page:{'null' if page is None else page}>"


def record(page, url, payload: bytes, winner, date: str = NO_DATE) -> bytes:
    """One gzip member: a response with its payload, or where winner is another page a revisit without."""
    kind = "response" if winner is None or winner == page else "revisit"
    body = HTTP if kind == "revisit" else HTTP + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {urn(page)}", f"WARC-Date: {date}", "Content-Type: application/http; msgtype=response", f"WARC-Target-URI: {re.sub(r'[\r\n]', ' ', url or '')}", f"WARC-Payload-Digest: sha1:{digest(payload)}", f"X-Payload-Length: {len(payload)}", f"Content-Length: {len(body)}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {urn(winner)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", 4, mtime=0)


def parse_record(raw: bytes) -> dict:
    data = gzip.decompress(raw)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    return fields | {"payload": rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]}


def page_of(mark: str | None):
    return None if mark is None or mark == urn(None) else int(mark[10:-1])


def winners(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html) plus winner: the largest page_id among equal payloads, if there are several.

    Payloads are equal if their SHA-256 is. Counting is a partial aggregate; the few repeated payloads join
    back, so that a payload of very many pages is split like any skewed join.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    key = F.sha2(F.col("html").cast("binary"), 256)
    many = p.select("page_id", key.alias("key"), F.octet_length("html").alias("n")).where(F.col("n") >= least_bytes).groupBy("key").agg(F.max("page_id").alias("winner"), F.count("*").alias("copies")).where("copies > 1").select("key", "winner")
    return p.withColumn("key", key).join(many, "key", "left").drop("key")


def write_packages(pages: DataFrame, folder: str, least_bytes: int = 0, roll_bytes: int = 256 << 20, zip64: bool = False) -> DataFrame:
    """Write a record per page into ZIP packages under folder (any store pyarrow opens); rows: path, records, bytes.

    The rows are staged: only files named in them count, so a task that ran twice leaves no double. A task
    holds one record and its package's index. Null html is an empty payload, a null url empty; rows with
    equal page_id and payload are all responses; a null page_id neither refers nor is referred to.
    """
    out = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
    store = afs.FileSystem.from_uri(folder)
    store[0].create_dir(store[1], recursive=True)
    small_batches(pages.sparkSession, 500)

    def run(batches):
        done, zipped, index, path = [], None, [], ""

        def close():
            zipped.finish()
            zipped.begin(INDEX)
            zipped.add("".join(index).encode())
            zipped.finish()
            zipped.close()
            done.append((path, len(index), zipped.at))

        for b in batches:
            for page, url, html, winner in zip(*(b.column(i).to_pylist() for i in range(4))):
                if zipped is None:
                    path, index = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.zip", []
                    own, at = afs.FileSystem.from_uri(path)
                    own.create_dir(at.rsplit("/", 1)[0], recursive=True)
                    zipped = PackageWriter(own.open_output_stream(at), zip64)
                    zipped.begin(DATA)
                raw = record(page, url, html.encode(), winner)
                index.append(json.dumps({"page": page, "offset": zipped.add(raw), "length": len(raw)}) + "\n")
                if zipped.at >= roll_bytes:
                    close()
                    zipped = None
        if zipped is not None:
            close()
        if done:
            yield record_batch(out, dict(zip(out.names, zip(*done))))

    made = winners(pages, least_bytes).select("page_id", "url", "html", "winner").mapInArrow(run, "path string, records long, bytes long")
    return stage_table(made, "packages")


def read_packages(packages: DataFrame, per_read: int = 200) -> DataFrame:
    """Every record of the packages (path, bytes): page_id, url, record_type, payload, payload_bytes, payload_digest, refers_to.

    Directories and indexes are read first; then runs of neighbouring records are dealt out, to as many tasks as
    the packages' bytes ask for (READ_BYTES each; shuffle partitions at least), and each run is
    read as one byte range. A run is a row of a few numbers, so sizes of rows say nothing about the work. A response's length and digest come from its bytes and must equal its header's.
    """
    found = pa.schema([("path", pa.string()), ("at", pa.int64()), ("lengths", pa.list_(pa.int64()))])
    out = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])

    def locate(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                zipped = PackageReader(path)
                base, _ = zipped.data_at(DATA)
                lines = [json.loads(x) for x in zipped.read(*zipped.data_at(INDEX)).splitlines()]
                runs = [lines[i : i + per_read] for i in range(0, len(lines), per_read)]
                yield record_batch(found, {"path": [path] * len(runs), "at": [base + r[0]["offset"] for r in runs], "lengths": [[x["length"] for x in r] for r in runs]})

    def read(batches):
        for b in batches:
            for path, at, lengths in zip(*(b.column(i).to_pylist() for i in range(3))):
                raw, rows, x = PackageReader(path).read(at, sum(lengths)), [], 0
                for n in lengths:
                    r = parse_record(raw[x : x + n])
                    x += n
                    size, sha, kind = int(r["X-Payload-Length"]), r["WARC-Payload-Digest"].removeprefix("sha1:"), r["WARC-Type"]
                    if kind == "response" and (size, sha) != (len(r["payload"]), digest(r["payload"])):
                        raise ValueError(f"{path}: a record of {r['WARC-Record-ID']} is damaged")
                    rows.append((page_of(r["WARC-Record-ID"]), r["WARC-Target-URI"], kind, r["payload"], size, sha, page_of(r.get("WARC-Refers-To"))))
                yield record_batch(out, dict(zip(out.names, zip(*rows))))

    n, total = packages.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    tasks = max(int(packages.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // READ_BYTES))
    runs = packages.select("path").repartition(max(1, min(n, tasks)), "path").mapInArrow(locate, "path string, at long, lengths array<long>")
    return runs.repartition(tasks, "path", "at").mapInArrow(read, "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long")


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write pages to packages in the shared folder and read them back; no rows for an empty table."""
    return read_packages(write_packages(pages, scratch_path(pages.sparkSession, "warc"), least_bytes))


_FIVE = "list_transform(range(0, 8), lambda i: ('0x' || substr(sha1(h), 5 * i + 1, 5))::BIGINT)"
_LETTER = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> {s}) & 31)::INT + 1, 1)"
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
w AS (SELECT h, max(page_id) AS winner FROM p GROUP BY h HAVING count(*) > 1)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
  array_to_string(list_transform({_FIVE}, lambda v: {" || ".join(_LETTER.format(s=s) for s in (15, 10, 5, 0))}), '') AS payload_digest,
  CASE WHEN winner <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN winner <> page_id THEN winner END AS refers_to
FROM p LEFT JOIN w USING (h)
"""
