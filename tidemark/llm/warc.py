"""WARC archives as seekable Zstandard bundles.

A bundle is what a .warc.zst file holds: groups of WARC records, each an independent Zstandard
frame, then a skippable frame with the seek table (compressed and decompressed size of each frame)
and its footer. An index maps each record identifier to its frame, its offset inside the
decompressed frame and its length, so that one record is read by decompressing one frame.

Bundles are rows of a Parquet table in a folder that all executors share: (bundle_id, bundle,
index). They are committed by Spark's writer, so a task that is lost is written anew, whole or not at
all. A bundle is closed at BUNDLE_BYTES, a frame at FRAME_BYTES, so a task holds one bundle.

A response's block is an HTTP head and the payload. Of records with equal payloads of at least 100
bytes, that with the smallest page_id is the response; the others are revisit records that name it and
carry no payload. Record identifiers are made of page_id, digest and url, and of a number for rows that
repeat all three, so they are unique, and the same in every run.

Defined results: a null html is an empty payload and a null url an empty one; smaller payloads are all
responses; of rows with the smallest page_id the one with the least url is the response, and of rows
that repeat that too just one is (the SQL, which is for unique page ids, calls all of them responses);
a row with a null page_id revisits another only if one with a page_id has the payload; an empty table
gives an empty result; further columns are ignored. A very long payload has a frame of its own where it
exceeds FRAME_BYTES.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.runtime import settle, ship

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 4 << 20
MIN_REVISIT_BYTES = 100
# Fixed values of the seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
BUNDLE_SCHEMA = "bundle_id string, bundle binary, index array<struct<record_id:string,page_id:bigint,frame:int,offset:bigint,length:bigint>>"
READ_SCHEMA = "page_id long, record_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
#: A fixed capture time: the pages carry none, and a retried task must write the same record.
CAPTURED = "1970-01-01T00:00:00Z"


def identifier(page_id: int | None, digest: str, url: str, number: int = 1) -> str:
    return str(uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {digest} {url}" + (f" {number}" if number > 1 else "")))


def record(record_id: str, page_id: int | None, url: str, payload: bytes, size: int, digest: str, refers_to: int | None, refers_url: str | None) -> bytes:
    """One WARC record, headers and block. A revisit has an empty block."""
    revisit = refers_to is not None
    headers = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{record_id}>", f"WARC-Date: {CAPTURED}",
        f"WARC-Target-URI: {clean(url)}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Page-Id: {'' if page_id is None else page_id}", f"X-Payload-Length: {size}",
    ]
    if revisit:
        headers += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{identifier(refers_to, digest, refers_url)}>", f"WARC-Refers-To-Target-URI: {clean(refers_url)}", f"WARC-Refers-To-Date: {CAPTURED}", f"X-Refers-To-Page-Id: {refers_to}"]
    block = b"" if revisit else f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + payload
    headers += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(headers).encode() + block + b"\r\n\r\n"


def clean(value: str) -> str:
    """A header value on one line: percent signs, line ends and control characters are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if c == "%" or ord(c) < 32 or ord(c) == 127 else c for c in value)


def unclean(value: str) -> str:
    head, *rest = value.split("%")
    return head + "".join(chr(int(x[:2], 16)) + x[2:] for x in rest)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    if len(block) != int(headers["Content-Length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a WARC record is cut off")
    return headers, block


class Bundle:
    """A bundle that is being written."""

    def __init__(self, level: int = 3):
        import zstandard

        self.compressor = zstandard.ZstdCompressor(level=level)
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.pending: list[bytes] = []
        self.held = self.written = 0
        self.index: list[dict] = []

    def add(self, record_id: str, page_id: int | None, data: bytes) -> None:
        if self.held and self.held + len(data) > FRAME_BYTES:
            self.close_frame()
        self.index.append({"record_id": record_id, "page_id": page_id, "frame": len(self.frames), "offset": self.held, "length": len(data)})
        self.pending.append(data)
        self.held += len(data)

    def close_frame(self) -> None:
        if self.pending:
            frame = self.compressor.compress(b"".join(self.pending))
            self.frames.append(frame)
            self.sizes.append((len(frame), self.held))
            self.written += len(frame)
            self.pending, self.held = [], 0

    def close(self) -> bytes:
        """The frames, then the seek table in a skippable frame."""
        self.close_frame()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes)
        footer = struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE_MAGIC, len(table) + len(footer)) + table + footer


class Reader:
    """Random access to the frames of a bundle by its seek table."""

    def __init__(self, bundle: bytes):
        import zstandard

        n, _, magic = struct.unpack("<IBI", bundle[-9:])
        if magic != SEEKABLE_MAGIC:
            raise ValueError("no seek table")
        self.bundle, self.decompressor = bundle, zstandard.ZstdDecompressor()
        self.sizes = [struct.unpack_from("<II", bundle, len(bundle) - 9 - 8 * (n - i)) for i in range(n)]
        self.starts = [0]
        for packed, _ in self.sizes:
            self.starts.append(self.starts[-1] + packed)
        self.last: tuple[int, bytes] = (-1, b"")

    def frame(self, i: int) -> bytes:
        if self.last[0] != i:
            self.last = (i, self.decompressor.decompress(self.bundle[self.starts[i] : self.starts[i + 1]], max_output_size=self.sizes[i][1]))
        return self.last[1]

    def record(self, frame: int, offset: int, length: int) -> bytes:
        return self.frame(frame)[offset : offset + length]


def with_referrals(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, size, digest, number, refers_to and refers_url of each record; a revisit
    has no payload. The least page_id of each payload is found by partial aggregation; small payloads
    have keys of their own, so they meet in no group. Rows equal in page_id, digest and url are counted,
    and written as many times."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload").cast("long")})
    key = ["digest", "page_id", "url"]
    counted = rows.groupBy(F.unhex("digest").alias("sha"), "page_id", "url").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size"))
    least = F.min(F.struct(F.col("page_id").isNull(), "page_id", "url")).alias("least")
    first = counted.filter(F.col("size") >= MIN_REVISIT_BYTES).groupBy("sha").agg(least, F.sum("n").alias("total")).filter("total > 1 and least.page_id is not null")
    first = settle(first.select(F.lower(F.hex("sha")).alias("key"), F.col("least.page_id").alias("first_id"), F.col("least.url").alias("first_url")), "first-pages")
    again = settle(counted.filter("n > 1").select(F.lower(F.hex("sha")).alias("digest"), "page_id", "url", "n"), "repeated-pages")
    rows = rows.withColumn("number", F.lit(1).cast("long"))
    if not again.isEmpty():
        same = [rows["digest"] == again["digest"], rows["page_id"].eqNullSafe(again["page_id"]), rows["url"] == again["url"]]
        one = rows.drop("number").join(again.drop("n"), same, "left_semi").groupBy(*key).agg(F.first("payload").alias("payload"), F.first("size").alias("size"))
        both = [one["digest"] == again["digest"], one["page_id"].eqNullSafe(again["page_id"]), one["url"] == again["url"]]
        # Numbers from 2 on keep the payload only where it is small; a large one's are revisits.
        one = one.join(again, both).select(*[one[c] for c in one.columns], F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("number"))
        rows = rows.join(again.drop("n"), same, "left_anti").unionByName(one)
    key = F.when(F.col("size") >= MIN_REVISIT_BYTES, F.col("digest")).otherwise(F.concat(F.lit("small-"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))))
    joined = rows.withColumn("key", key).join(first, "key", "left")
    is_first = F.col("page_id").eqNullSafe(F.col("first_id")) & F.col("url").eqNullSafe(F.col("first_url")) & (F.col("number") == 1)
    named = lambda c: F.when(~is_first, F.col(c))
    joined = joined.withColumns({"refers_to": named("first_id"), "refers_url": named("first_url")})
    return joined.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "size", "digest", "number", "refers_to", "refers_url")


def write_bundles(pages: DataFrame) -> DataFrame:
    """The bundles of all pages, as rows of BUNDLE_SCHEMA."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, schema = None, pa.schema([("bundle_id", pa.string()), ("bundle", pa.binary()), ("index", pa.list_(pa.struct([("record_id", pa.string()), ("page_id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])))])

        def done() -> pa.RecordBatch:
            data = bundle.close()
            return pa.RecordBatch.from_arrays([pa.array([uuid.UUID(bytes=hashlib.sha256(data).digest()[:16]).hex]), pa.array([data], pa.binary()), pa.array([bundle.index], schema.field("index").type)], schema=schema)

        for batch in batches:
            page, url, size, digest, number, refers, refers_url = (batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5, 6, 7))
            for i in range(batch.num_rows):
                payload = batch.column(2)[i].as_py()
                record_id = identifier(page[i], digest[i], url[i], number[i])
                bundle = bundle or Bundle()
                bundle.add(record_id, page[i], record(record_id, page[i], url[i], payload, size[i], digest[i], refers[i], refers_url[i]))
                if bundle.written + bundle.held >= BUNDLE_BYTES:
                    yield done()
                    bundle = None
        if bundle:
            yield done()

    return with_referrals(pages).mapInArrow(run, BUNDLE_SCHEMA)


def read_bundles(bundles: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of the bundles, by its index entry; responses are held against their digest."""
    ship(bundles.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in range(batch.num_rows):
                reader, rows = Reader(batch.column(0)[b].as_py()), []
                for x in batch.column(1)[b].as_py():
                    headers, block = parse(reader.record(x["frame"], x["offset"], x["length"]))
                    digest, kind = headers["WARC-Payload-Digest"].removeprefix("sha256:"), headers["WARC-Type"]
                    size = int(headers["X-Payload-Length"])
                    block = block.partition(b"\r\n\r\n")[2]
                    if kind == "response" and (len(block) != size or hashlib.sha256(block).hexdigest() != digest):
                        raise ValueError(f"record {x['record_id']} doesn't have its digest")
                    page, refers = headers["X-Page-Id"], headers.get("X-Refers-To-Page-Id")
                    rows.append((int(page) if page else None, x["record_id"], unclean(headers["WARC-Target-URI"]), size, digest, kind, int(refers) if refers else None, block if payloads else None))
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in READ_SCHEMA.split(", ")])

    return bundles.select("bundle", "index").mapInArrow(run, READ_SCHEMA)


def archive_digests(pages: DataFrame) -> DataFrame:
    """Write all pages to bundles in the shared folder, and read the archives back."""
    read = read_bundles(settle(write_bundles(pages), "warc"), payloads=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def export_bundles(bundles: DataFrame, folder: str) -> DataFrame:
    """Write each bundle as folder/BUNDLE_ID.warc.zst through pyarrow's file systems (a URI or a path
    that all executors reach); returns bundle_id and the file. Repeating it writes the same files."""
    ship(bundles.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        for batch in batches:
            files = []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                files.append(f"{path}/{name}.warc.zst")
                with system.open_output_stream(f"{files[-1]}.part") as out:
                    out.write(data)
                system.move(f"{files[-1]}.part", files[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, pa.string())], ["bundle_id", "file"])

    return bundles.select("bundle_id", "bundle").mapInArrow(run, "bundle_id string, file string")


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= {MIN_REVISIT_BYTES} GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN f.first_id <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first_id <> p.page_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f ON f.payload_digest = p.payload_digest
"""
