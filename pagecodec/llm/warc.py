"""WARC: archives of pages, and a normaliser of monolithic gzip.

``write_monolithic`` writes every page as a WARC response record, many records in one gzip stream per archive.
``normalise`` inflates each such stream once, front to back, and rewrites every record as a gzip member of its own,
with a sidecar index of offsets (one JSON line per record) beside each archive; records whose payload another record
already has become revisits. ``read_back`` seeks to members by the sidecar and inflates only them.

Identity of payloads is decided between the two by a combinable aggregation over digests, so payloads are never
shuffled. Archives are written under names of their own, and only names in the committed manifest count: a task that
is lost and runs again leaves at most an unused file. Archives lie in the shared folder (spark.checkpoint.dir),
reached through Arrow's file systems.

Cases: null html is an empty payload; of equal payloads of at least ``min_bytes`` bytes the least (page id, archive,
place) is the response, null ids last, and the others revisit it; repeated rows are records of their own; null urls
and line breaks in urls are made safe; an empty table gives an empty table; a damaged archive fails the job, or with
``salvage`` gives its whole leading records; headers that aren't UTF-8 are kept byte for byte. One record at a time is held in memory.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LEVEL = 4
CHUNK = 1 << 20
#: Inflated bytes after which a monolithic archive is closed and another begun.
ARCHIVE_BYTES = 1 << 30
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _create(folder: str, name: str) -> tuple[str, BinaryIO]:
    f, root = _fs(folder)
    f.create_dir(root, recursive=True)
    return f"{folder}/{name}", f.open_output_stream(f"{root}/{name}", compression=None)


def _open(path: str):
    f, p = _fs(path)
    return f.open_input_file(p)


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """The bytes of one WARC record."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode(errors="surrogateescape") + b"\r\n" + block + b"\r\n\r\n"


def record_id(archive: str, place: int) -> str:
    """Of the record at a place of an archive, whose name is its own."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive.rpartition('/')[2]}#{place}')}>"


def target(url: str | None) -> str:
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "urn:unknown")


def response(page_id: int | None, url: str | None, payload: bytes, sha: str, own_id: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [
        ("WARC-Type", "response"), ("WARC-Record-ID", own_id), ("WARC-Date", DATE),
        ("WARC-Target-URI", target(url)), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{sha}"),
    ]
    return record(headers + ([("X-Page-Id", str(page_id))] if page_id is not None else []), http + payload)


def revisit(headers: list[tuple[str, str]], block: bytes, refers_to: int | None, response_id: str, url: str | None) -> bytes:
    """A response record made a revisit of another: the HTTP header stays, with the full payload's length, the payload goes."""
    gone = {"warc-type", "content-length"}
    new = [("WARC-Type", "revisit"), ("WARC-Profile", PROFILE), ("WARC-Refers-To", response_id), ("WARC-Refers-To-Target-URI", target(url)), ("WARC-Refers-To-Date", DATE), *((k, v) for k, v in headers if k.lower() not in gone)]
    return record(new + ([("X-Refers-To-Page-Id", str(refers_to))] if refers_to is not None else []), block[: block.index(b"\r\n\r\n") + 4])


class Inflater:
    """Buffered reading of a gzip file of one or many members, inflated front to back once."""

    def __init__(self, raw: BinaryIO):
        self.raw, self.buffer, self.at, self.z, self.over, self.begun = raw, bytearray(), 0, zlib.decompressobj(31), False, False

    def more(self) -> bool:
        if self.at > CHUNK:
            del self.buffer[: self.at]
            self.at = 0
        while not self.over:
            if self.z.eof:
                rest = self.z.unused_data or self.raw.read(CHUNK)
                if not rest:
                    self.over = True
                    break
                self.z = zlib.decompressobj(31)
                data = self.z.decompress(rest, CHUNK)
            else:
                fed = self.z.unconsumed_tail or self.raw.read(CHUNK)
                self.begun |= bool(fed)
                data = self.z.decompress(fed, CHUNK)
                if not data and not self.z.unconsumed_tail and not self.z.eof:
                    tail = self.raw.read(CHUNK)
                    if not tail and not self.begun:  # an empty file has no records
                        self.over = True
                        break
                    if not tail:
                        raise ValueError("the gzip stream ends early")
                    data = self.z.decompress(tail, CHUNK)
            self.begun = True
            if data:
                self.buffer += data
                return True
        return False

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to and with ``mark``; None at the end of the stream."""
        start = self.at
        while (found := self.buffer.find(mark, start)) < 0:
            seen = len(self.buffer) - self.at
            if not self.more():
                if seen:
                    raise ValueError("the last record ends early")
                return None
            start = self.at + max(0, seen - len(mark))
        out = bytes(self.buffer[self.at : found + len(mark)])
        self.at = found + len(mark)
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) - self.at < n:
            if not self.more():
                raise ValueError("the last record ends early")
        out = bytes(self.buffer[self.at : self.at + n])
        self.at += n
        return out


def records(raw: BinaryIO, *, salvage: bool = False) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """Headers and block of each record of a gzip WARC file. A damaged file fails; with ``salvage`` it gives its whole leading records."""
    src = Inflater(raw)
    while True:
        try:
            head = src.until(b"\r\n\r\n")
            if head is None:
                return
            lines = head.decode(errors="surrogateescape").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError("not a WARC record")
            headers = [(k, v.strip()) for k, _, v in (x.partition(":") for x in lines[1:] if x)]
            length = next((v for k, v in headers if k.lower() == "content-length"), None)
            if length is None:
                raise ValueError("a record has no length")
            block = src.take(int(length))
            if src.take(4) != b"\r\n\r\n":
                raise ValueError("a record's block has another length than its header says")
        except (ValueError, zlib.error) as e:
            if salvage:
                return
            raise ValueError(str(e)) from e
        yield headers, block


_MANIFEST = "archive string, place long, page_id long, payload_digest string, payload_bytes long, url string"


def write_monolithic(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", level: int = LEVEL) -> DataFrame:
    """Write one gzip stream of records per partition (and ``ARCHIVE_BYTES``); the manifest's rows, one per record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, out, z, size, place = "", None, None, 0, 0
        for b in common.slices(batches):
            rows = []
            for page_id, url, html in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if out is None:
                    path, out = _create(folder, f"raw-{uuid.uuid4().hex}.warc.gz")
                    z, size, place = zlib.compressobj(level, wbits=31), 0, 0
                payload = (html or "").encode()
                sha = digest(payload)
                data = response(page_id, url, payload, sha, record_id(path, place))
                out.write(z.compress(data))
                rows.append((path, place, page_id, sha, len(payload), url))
                size, place = size + len(data), place + 1
                if size >= ARCHIVE_BYTES:
                    out.write(z.flush())
                    out.close()
                    out = None
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()), strict=True)], names=["archive", "place", "page_id", "payload_digest", "payload_bytes", "url"])
        if out is not None:
            out.write(z.flush())
            out.close()

    src = common.pick(pages, page_id=id_col, url=url_col, html=html_col).withColumn("page_id", F.col("page_id").cast("long"))
    return common.map_arrow(src, run, _MANIFEST)


def revisits(manifest: DataFrame, min_bytes: int = 0) -> DataFrame:
    """The manifest with ``refers_to`` and whether the record ``is_revisit``."""
    order = F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("page"), F.col("archive").alias("a"), F.col("place").alias("p"), F.col("url").alias("u"))
    firsts = manifest.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("payload_digest", "first")
    marked = manifest.join(firsts, "payload_digest", "left")
    again = F.col("first").isNotNull() & (F.col("payload_bytes") >= min_bytes) & ~((F.col("first.a") == F.col("archive")) & (F.col("first.p") == F.col("place")))
    return marked.select("archive", "place", again.alias("is_revisit"), F.when(again, F.col("first.page")).alias("refers_to"), *(F.when(again, F.col(f"first.{c}")).alias(n) for c, n in (("a", "first_archive"), ("p", "first_place"), ("u", "first_url"))))


def normalise(roles: DataFrame, folder: str, *, level: int = LEVEL, salvage: bool = False) -> DataFrame:
    """Rewrite each archive named in ``roles`` record by record; a row per new archive: ``archive, sidecar, records``.

    A group is the roles of one archive, bounded by the archive's size. A damaged archive fails the job; with ``salvage``
    its whole leading records are rewritten.
    """
    cells = ("place", "is_revisit", "refers_to", "first_archive", "first_place", "first_url")

    def run(group: pa.Table) -> pa.Table:
        source = group.column("archive")[0].as_py()
        again = {p: (r, record_id(a, f), u) for p, v, r, a, f, u in zip(*(group.column(c).to_pylist() for c in cells), strict=True) if v}
        name = f"member-{uuid.uuid4().hex}.warc.gz"
        path, out = _create(folder, name)
        sidecar, index = _create(folder, f"{name}.idx")
        offset = n = 0
        with _open(source) as raw:
            for place, (headers, block) in enumerate(records(raw, salvage=salvage)):
                data = revisit(headers, block, *again[place]) if place in again else record([h for h in headers if h[0].lower() != "content-length"], block)
                z = zlib.compressobj(level, wbits=31)
                member = z.compress(data) + z.flush()
                out.write(member)
                index.write((json.dumps({"offset": offset, "length": len(member)}) + "\n").encode())
                offset, n = offset + len(member), n + 1
        if n != group.num_rows and not salvage:
            raise ValueError(f"{source} holds {n} records, its manifest {group.num_rows}")
        out.close()
        index.close()
        return pa.table({"archive": [path], "sidecar": [sidecar], "records": pa.array([n], pa.int64())})

    common.ship(roles.sparkSession)
    # roles are small and archives aren't, so their partitions mustn't be put together by size
    parts = int(roles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return roles.repartition(parts, "archive").groupBy("archive").applyInArrow(run, "archive string, sidecar string, records long")


def read_record(raw: BinaryIO, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """One member by its place in the archive."""
    raw.seek(offset)
    data = zlib.decompress(raw.read(length), 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = {k: v.strip() for k, _, v in (x.partition(":") for x in head.decode(errors="surrogateescape").split("\r\n")[1:])}
    return headers, rest[: int(headers["Content-Length"])]


def read_back(archives: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every record of member-wise archives."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def page(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for b in batches:
            for path, sidecar in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = []
                with _open(path) as raw, _open(sidecar) as lines:
                    for line in lines.read().splitlines():
                        at = json.loads(line)
                        headers, block = read_record(raw, at["offset"], at["length"])
                        http, _, payload = block.partition(b"\r\n\r\n")
                        kind, sha = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        size = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: ")).removeprefix("Content-Length: "))
                        if kind == "response" and (digest(payload) != sha or len(payload) != size):
                            raise ValueError(f"a record of {path} has another payload than its header says")
                        own, ref = headers.get("X-Page-Id"), headers.get("X-Refers-To-Page-Id")
                        rows.append((own and int(own), size, sha, kind, ref and int(ref)))
                        if len(rows) == 10_000:
                            yield page(rows)
                            rows = []
                if rows:
                    yield page(rows)

    parts = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    src = archives.select("archive", "sidecar").repartition(parts, "archive")
    return common.map_arrow(src, run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def normalised_pages(pages: DataFrame, *, min_bytes: int = 0, **columns: str) -> DataFrame:
    """Write ``pages`` as monolithic archives, normalise them and read the result back."""
    spark = pages.sparkSession
    raw, new = common.shared_path(spark, "op2-raw"), common.shared_path(spark, "op2-warc")
    manifest = common.table(write_monolithic(pages, raw, **columns), "op2-manifest")
    done = common.table(normalise(revisits(manifest, min_bytes), new), "op2-archives")
    common.remove(spark, raw)
    return read_back(done)


ORACLE = """
with p as (select page_id, coalesce(html, '') as h from pages),
d as (select page_id, strlen(h)::bigint as payload_bytes, upper(sha1(h)) as hex, min(page_id) over (partition by h) as low from p),
b as (select *, [('0x' || substr(hex, 5 * i + 1, 5))::bigint for i in range(8)] as quads from d)
select page_id, payload_bytes,
    list_aggregate(list_transform(quads, lambda q: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((q >> 15) & 31)::int + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((q >> 10) & 31)::int + 1, 1)
        || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((q >> 5) & 31)::int + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (q & 31)::int + 1, 1)), 'string_agg', '') as payload_digest,
    case when page_id = low then 'response' else 'revisit' end as record_type, case when page_id <> low then low end as refers_to from b
"""
