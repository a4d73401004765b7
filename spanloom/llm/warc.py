"""WARC archives in Zstandard, one frame per record, with a leading dictionary.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the
dictionary, as it is or as a Zstandard frame itself; every record is a frame of its
own. The reader loads the dictionary from there - archives without one are read, too,
and other skippable frames are skipped - decodes frame by frame and validates: the
version line, the mandatory headers, Content-Length against the block, digests and
the payload's length as far as they are given, the blank lines at the end, and a
frame cut short is an error. Archives of other writers are read alike: header names
in any case, WARC/1.0 and 1.1, payloads within HTTP messages, digests in SHA-1 or
SHA-256, in hex or base 32.

Records with equal payloads of at least ``least`` bytes are stored once: the page
with the smallest id is the response, the others revisit it. Responses are
compressed where the pages are read, so only frames and digests are exchanged, not
pages; the smallest id of a digest is a map-side-combined minimum. Tasks write
archives into the folder that all executors share, under names of the attempt's own,
begin a new one after ROLL_BYTES, and list only what they finished.

Defined cases: a null html is an empty payload; a null url is written as an empty
target; pages with equal ids are records of their own, and of equal pages with
equal ids all are responses; null ids never become a response that others revisit
(such a page is a response itself); an empty table gives no archives and no rows;
other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import stage, stage_path
from .textops import slices, utf8

MAGIC = 0x184D2A5D
#: The magic number of a Zstandard frame, and of the skippable frames without its last four bits.
FRAME, SKIPPABLE = 0xFD2FB528, 0x184D2A50
#: Bytes after which a task begins another archive.
ROLL_BYTES = 1 << 30
LEAST = 100
#: Pages and bytes from which the dictionary is trained.
SAMPLE_PAGES, SAMPLE_BYTES, DICT_BYTES = 400, 8192, 32768
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"


def train_dictionary(pages: DataFrame, html_col: str = "html") -> bytes:
    """A dictionary from a bounded sample: the heads of SAMPLE_PAGES pages. Empty if there is too little to learn from."""
    heads = [r[0].encode() for r in pages.where(F.length(html_col) > 0).select(F.substring(html_col, 1, SAMPLE_BYTES)).limit(SAMPLE_PAGES).collect()]
    if len(heads) < 20 or sum(map(len, heads)) < 8 * DICT_BYTES:
        return b""
    return zstandard.train_dictionary(DICT_BYTES, heads).as_bytes()


def record(kind: str, page: object, url: str, payload: bytes, digest: str, refers: object = None, length: int | None = None) -> bytes:
    """A record's bytes. A revisit has no payload but its digest and length."""
    length = len(payload) if length is None else length
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:{'' if page is None else page}>\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: {' '.join(url.split())}\r\nWARC-Payload-Digest: sha256:{digest}\r\nX-Payload-Length: {length}\r\n"
    if kind == "revisit":
        head += f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:{refers}>\r\n"
    head += f"Content-Type: application/octet-stream\r\nContent-Length: {len(payload)}\r\n\r\n"
    return head.encode() + payload + b"\r\n\r\n"


class BadArchive(ValueError):
    """An archive that does not hold what its headers say."""


#: Headers that every record has; fixed values.
MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")


def _matches(digest: str, data: bytes) -> bool:
    """Whether a labelled digest is that of the data; digests of other kinds are not checked."""
    kind, _, value = digest.partition(":")
    tool = {"sha1": hashlib.sha1, "sha256": hashlib.sha256}.get(kind.lower().replace("-", ""))
    if tool is None or not value:
        return True
    raw = tool(data).digest()
    return value.lower() == raw.hex() or value.upper().rstrip("=") == base64.b32encode(raw).decode().rstrip("=")


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and payload of a record, checked."""
    head, cut, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not cut or lines[0] not in ("WARC/1.1", "WARC/1.0"):
        raise BadArchive("no WARC/1.0 or WARC/1.1 record")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if line[:1] in " \t" and headers:  # a folded line goes on with the header above
            name = next(reversed(headers))
            headers[name] = f"{headers[name]} {line.strip()}"
        elif not colon:
            raise BadArchive(f"no header: {line}")
        else:
            headers[name.strip().lower()] = value.strip()
    for name in MANDATORY:
        if name not in headers:
            raise BadArchive(f"{name} is missing")
    if not headers["content-length"].isdigit() or len(rest) != int(headers["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise BadArchive("Content-Length does not match the block")
    block = rest[:-4]
    if not _matches(headers.get("warc-block-digest", ""), block):
        raise BadArchive("the block is not what its digest says")
    payload = block
    if headers.get("content-type", "").lower().startswith("application/http"):
        payload = block.partition(b"\r\n\r\n")[2]
    if headers["warc-type"] == "revisit":
        # a revisit may keep the HTTP headers, never the payload
        if payload or not ({"warc-refers-to", "warc-refers-to-target-uri", "warc-payload-digest"} & set(headers)):
            raise BadArchive("a revisit has no payload and refers to a record")
    elif not _matches(headers.get("warc-payload-digest", ""), payload) or int(headers.get("x-payload-length", len(payload))) != len(payload):
        raise BadArchive("the payload is not what its digest says")
    return headers, payload


def _dictionary(body: bytes) -> zstandard.ZstdCompressionDict | None:
    """The dictionary that a leading frame holds, as it is or compressed."""
    if body[:4] == struct.pack("<I", FRAME):
        body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
    return zstandard.ZstdCompressionDict(body) if body else None


class _Source:
    """Bytes of a stream, with as many ahead as are asked for."""

    def __init__(self, source):
        self.source, self.held = source, b""

    def peek(self, n: int) -> bytes:
        while len(self.held) < n:
            more = self.source.read(max(1 << 18, n - len(self.held)))
            if not more:
                break
            self.held += more
        return self.held[:n]

    def take(self, n: int) -> bytes:
        out = self.peek(n)
        self.held = self.held[n:]
        return out


def read_archive(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of an archive from a binary stream."""
    data = _Source(source)
    reader, first = zstandard.ZstdDecompressor(), True
    while head := data.peek(8):
        magic = struct.unpack("<I", head[:4])[0] if len(head) >= 4 else 0
        if magic & ~0xF == SKIPPABLE:
            if len(head) < 8:
                raise BadArchive("a frame is cut short")
            size = struct.unpack("<II", data.take(8))[1]
            body = data.take(size)
            if len(body) != size:
                raise BadArchive("the dictionary is cut short" if first else "a frame is cut short")
            if first and magic == MAGIC:
                trained = _dictionary(body)
                reader = zstandard.ZstdDecompressor(dict_data=trained) if trained else reader
            first = False
            continue
        if magic != FRAME:
            raise BadArchive("no Zstandard frame")
        first = False
        frame, parts = reader.decompressobj(), []
        while not frame.eof:
            part = data.take(len(data.held) or len(data.peek(1 << 18)))
            if not part:
                raise BadArchive("a frame is cut short")
            parts.append(frame.decompress(part))
            if frame.eof:
                data.held = frame.unused_data + data.held
        yield parse_record(b"".join(parts))


_FRAMES = "page_id long, url string, n long, digest string, frame binary"


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    trained = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=trained) if trained else zstandard.ZstdCompressor(level=LEVEL)


def _compress(dictionary: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = _compressor(dictionary)
        for whole in batches:
            for batch in slices(whole, 2, 8 << 20):
                pages, urls, bodies = batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2))
                digests = [hashlib.sha256(b).hexdigest() for b in bodies]
                frames = [tool.compress(record("response", p, u or "", b, d)) for p, u, b, d in zip(pages, urls, bodies, digests, strict=True)]
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array([len(b) for b in bodies], pa.int64()), pa.array(digests), pa.array(frames, pa.binary())], names=["page_id", "url", "n", "digest", "frame"])

    return run


def _open(path: str):
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _write(folder: str, dictionary: bytes, roll: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = _compressor(dictionary)
        store, base = _open(folder)
        name, out, count = "", None, 0

        def finish() -> pa.RecordBatch:
            out.close()
            store.move(name + ".part", name)
            return pa.record_batch([pa.array([f"{folder}/{name.rsplit('/', 1)[1]}"]), pa.array([count], pa.int64())], names=["path", "records"])

        for batch in batches:
            for page, url, n, digest, refers, frame in zip(*(batch.column(j).to_pylist() for j in range(6)), strict=True):
                if out is None:
                    store.create_dir(base, recursive=True)
                    name, count = f"{base}/{uuid.uuid4().hex}.warc.zst", 0
                    out = store.open_output_stream(name + ".part", compression=None)
                    out.write(struct.pack("<II", MAGIC, len(dictionary)) + dictionary)
                out.write(frame if refers is None else tool.compress(record("revisit", page, url or "", b"", digest, refers, n)))
                count += 1
                if out.tell() >= roll:
                    yield finish()
                    out = None
        if out is not None:
            yield finish()

    return run


_RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, payload binary"


def _number(urn: str) -> int | None:
    """The page of a record of our own; null for others."""
    digits = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits.lstrip("-").isdigit() else None


def _row(headers: dict[str, str], payload: bytes, payloads: bool) -> tuple:
    kind = headers["warc-type"]
    refers = _number(headers.get("warc-refers-to", "")) if kind == "revisit" else None
    label, _, value = headers.get("warc-payload-digest", "").partition(":")
    length = headers.get("x-payload-length")
    if kind == "revisit":  # what the revisited payload was, as far as the record says
        size, digest = (int(length) if length else None), (value if label == "sha256" else None)
    else:
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
    return _number(headers["warc-record-id"]), headers.get("warc-target-uri", ""), size, digest, kind, refers, headers["warc-record-id"], payload if payloads else None


def _read(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _RECORDS.split(", ")]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for path, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, name = _open(path)
                rows: list[tuple] = []
                seen = 0
                with store.open_input_stream(name, compression=None) as source:
                    for h, body in read_archive(source):
                        seen += 1
                        rows.append(_row(h, body, payloads))
                        if len(rows) >= (200 if payloads else 5000):
                            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                            rows = []
                if count is not None and seen != count:
                    raise BadArchive(f"{path} has {seen} records instead of {count}")
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return run


def write_archives(pages: DataFrame, folder: str | None = None, least: int = LEAST, roll: int = ROLL_BYTES) -> DataFrame:
    """Write page_id, url, html as archives; returns the staged table of path and number of records."""
    spark = pages.sparkSession
    folder = folder or stage_path(spark, "warc")
    dictionary = train_dictionary(pages)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    frames = rows.mapInArrow(_compress(dictionary), _FRAMES)
    digests = rows.where("page_id is not null").select("page_id", F.octet_length(F.coalesce("html", F.lit(""))).alias("n"), F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256).alias("digest"))
    shared = digests.where(F.col("n") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first <> last")
    # only the pages that revisit meet their response; the frames join by page
    revisits = digests.where(F.col("n") >= least).join(shared, "digest").where("page_id <> first").select(F.col("page_id").alias("p"), F.col("digest").alias("d"), F.col("first").alias("refers"))
    joined = frames.join(revisits.distinct(), (F.col("page_id") == F.col("p")) & (F.col("digest") == F.col("d")), "left")
    chosen = joined.select("page_id", "url", "n", "digest", "refers", F.when(F.col("refers").isNull(), F.col("frame")).alias("frame"))
    return stage(chosen.mapInArrow(_write(folder, dictionary, roll), "path string, records long"), "archives")


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of the archives listed by path and records (their number; null: not known)."""
    spread = archives.repartition(max(1, archives.count()))  # one archive a task
    return spread.mapInArrow(_read(payloads), _RECORDS)


def op9_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return read_archives(write_archives(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= {LEAST} GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
  CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d AND n >= {LEAST}
"""
