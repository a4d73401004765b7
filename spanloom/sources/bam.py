"""BAM files as a Python data source: header, records, tags; only asked columns are decoded.

The files are blocked gzip: a file is cut into ranges of bytes, a task each. A task
finds the first block that begins in its range and the first record that begins in
that block - the first place from which plausible records follow one another - and
reads the records that begin in its blocks. Files of plain gzip are one task.
"""

from __future__ import annotations

import gzip
import os
import shutil
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from contextlib import suppress
from itertools import chain

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.reads import flag, mates
from .files import open_input, save

#: Letters of packed bases and of CIGAR operations, in code order; fixed values.
SEQ_LETTERS = "=ACMGRSVTWYHKDBN"
CIGAR_LETTERS = "MIDNSHP=X"
SCHEMA = "name string, seqname string, pos long, length long, flag int, mapq int, bin int, cigar string, mate_seqname string, mate_pos long, template_length long, sequence string, qual string, tags map<string,string>"
_CONSUMES = {0, 2, 3, 7, 8}
_SIZES = {"A": ("c", 1), "c": ("b", 1), "C": ("B", 1), "s": ("h", 2), "S": ("H", 2), "i": ("i", 4), "I": ("I", 4), "f": ("f", 4), "d": ("d", 8)}


def _header(file) -> tuple[str, list[tuple[str, int]]]:
    if file.read(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    text = file.read(struct.unpack("<i", file.read(4))[0]).rstrip(b"\0").decode()
    refs = []
    for _ in range(struct.unpack("<i", file.read(4))[0]):
        name = file.read(struct.unpack("<i", file.read(4))[0]).rstrip(b"\0").decode()
        refs.append((name, struct.unpack("<i", file.read(4))[0]))
    return text, refs


def parse_tags(data: bytes) -> dict[str, str]:
    out, at = {}, 0
    while at < len(data):
        key, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind in "ZH":
            end = data.index(b"\0", at)
            out[key], at = data[at:end].decode(), end + 1
        elif kind == "B":
            sub = chr(data[at])
            n = struct.unpack_from("<i", data, at + 1)[0]
            code, size = _SIZES[sub]
            out[key] = ",".join(str(x) for x in struct.unpack_from(f"<{n}{code}", data, at + 5))
            at += 5 + n * size
        else:
            code, size = _SIZES[kind]
            value = struct.unpack_from("<" + code, data, at)[0]
            out[key], at = value.decode() if kind == "A" else str(value), at + size
    return out


_BLOCK_HEAD = b"\x1f\x8b\x08\x04"
#: Compressed bytes that a task reads, and decompressed bytes in which it looks for the first record.
SPLIT_BYTES, LOOK_BYTES = 64 << 20, 1 << 18
#: Records that must follow one another for a place to count as a record's start.
CHAIN = 8
BATCH_RECORDS = 4096


def block_size(head: bytes) -> int | None:
    """The size of the gzip block that begins with these bytes; None if it is not a blocked one."""
    if len(head) < 18 or head[:4] != _BLOCK_HEAD:
        return None
    extra, at = struct.unpack_from("<H", head, 10)[0], 12
    end = min(len(head), 12 + extra)
    while at + 4 <= end:
        kind, size = head[at : at + 2], struct.unpack_from("<H", head, at + 2)[0]
        if kind == b"BC" and size == 2 and at + 6 <= end:
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + size
    return None


def _inflate(raw: bytes) -> bytes:
    extra = struct.unpack_from("<H", raw, 10)[0]
    return zlib.decompress(raw[12 + extra : -8], -15)


def _blocks(file, at: int) -> Iterator[tuple[int, bytes]]:
    """(place, data) of the blocks from ``at`` on."""
    while True:
        file.seek(at)
        head = file.read(18)
        if not head:
            return
        size = block_size(head)
        if size is None:
            raise ValueError(f"no block at byte {at}")
        yield at, _inflate(head + file.read(size - 18))
        at += size


def _first_block(file, start: int, stop: int) -> int | None:
    """The first block that begins in a range of bytes; the block that it points to must be one, too."""
    at = start
    while at < stop:
        file.seek(at)
        window = file.read(1 << 17)
        found = window.find(_BLOCK_HEAD)
        while found >= 0 and at + found < stop:
            size = block_size(window[found : found + 64])
            if size is not None:
                file.seek(at + found + size)
                after = file.read(18)
                if not after or block_size(after) is not None:
                    return at + found
            found = window.find(_BLOCK_HEAD, found + 1)
        if len(window) < 1 << 17:
            return None
        at += len(window) - 18
    return None


def _plausible(data: bytes, at: int, lengths: list[int]) -> int | None:
    """Where the next record would begin if one begins here; None if none can."""
    if at + 36 > len(data):
        return None
    size, ref, pos, n_name, _, _, n_cigar, _, n_seq, mate, mate_pos, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
    fits = 32 <= size < 1 << 28 and -1 <= ref < len(lengths) and -1 <= mate < len(lengths) and n_name > 0 and n_seq >= 0
    if not fits or pos < -1 or mate_pos < -1 or (ref >= 0 and pos > lengths[ref]) or (mate >= 0 and mate_pos > lengths[mate]):
        return None
    if 32 + n_name + 4 * n_cigar + (n_seq + 1) // 2 + n_seq > size:
        return None
    name = data[at + 36 : at + 36 + n_name]
    if len(name) == n_name and (name[-1] or not all(33 <= c <= 126 for c in name[:-1])):
        return None
    return at + 4 + size


def first_record(data: bytes, lengths: list[int]) -> int | None:
    """The first place from which CHAIN plausible records, or plausible records to the end of the data, follow one another."""
    for start in range(len(data) - 36):
        at, n = start, 0
        while n < CHAIN:
            after = _plausible(data, at, lengths)
            if after is None:
                break
            at, n = after, n + 1
            if at + 36 > len(data):
                n = CHAIN
        if n >= CHAIN:
            return start
    return None


def _bodies(path: str, start: int, stop: int | None) -> Iterator[bytes]:
    """The records that begin in the blocks of a range; stop None: of the whole file, which may be plain gzip."""
    with open_input(path) as file:
        if stop is None:
            with gzip.open(file, "rb") as plain:  # blocked gzip is a gzip of many members
                _header(plain)
                while head := plain.read(4):
                    yield plain.read(struct.unpack("<i", head)[0])
            return
        with gzip.open(file, "rb") as plain:
            _, refs = _header(plain)
            header_size = plain.tell()
        lengths = [n for _, n in refs]
        at = _first_block(file, start, stop)
        if at is None:
            return
        held, place, own = b"", 0, True
        blocks = _blocks(file, at)
        edges: list[tuple[int, bool]] = []  # where a block's data end in ``held``, and whether the block is in the range
        if start == 0:
            skipped = header_size
            for where, data in blocks:
                if skipped >= len(data):
                    skipped -= len(data)
                    continue
                held, place, own = data, skipped, where < stop
                edges.append((len(held), own))
                break
        else:
            for where, data in blocks:
                held += data
                edges.append((len(held), where < stop))
                if len(held) >= LOOK_BYTES:
                    break
            found = first_record(held, lengths)
            if found is None:
                return
            place = found
        while True:
            # the record at ``place`` begins in the first block whose data end behind it
            while edges and edges[0][0] <= place:
                edges.pop(0)
            if edges and not edges[0][1]:
                return
            need = place + 4
            size = struct.unpack_from("<i", held, place)[0] if need <= len(held) else None
            if size is not None:
                need += size
            if need > len(held):
                got = next(blocks, None)
                if got is None:
                    if place < len(held):
                        raise ValueError(f"{path}: a record is cut short")
                    return
                held, edges = held[place:], [(e - place, o) for e, o in edges]
                place = 0
                held += got[1]
                edges.append((len(held), got[0] < stop))
                continue
            yield held[place + 4 : need]
            place = need


def decode(body: bytes, refs: list[tuple[str, int]], columns: set[str]) -> tuple:
    """A record's columns; the larger ones only if asked for."""
    ref, pos, n_name, mapq, index, n_cigar, flags, n_seq, mate, mate_pos, size = struct.unpack_from("<iiBBHHHiiii", body)
    at = 32 + n_name
    ops = struct.unpack_from(f"<{n_cigar}I", body, at)
    at += 4 * n_cigar
    length = sum(o >> 4 for o in ops if o & 15 in _CONSUMES)
    seq_at, qual_at, tags_at = at, at + (n_seq + 1) // 2, at + (n_seq + 1) // 2 + n_seq
    cigar = "".join(f"{o >> 4}{CIGAR_LETTERS[o & 15]}" for o in ops) if "cigar" in columns else None
    seq = "".join(SEQ_LETTERS[b >> 4] + SEQ_LETTERS[b & 15] for b in body[seq_at:qual_at])[:n_seq] if "sequence" in columns else None
    qual = "".join(chr(min(q, 93) + 33) for q in body[qual_at:tags_at]) if "qual" in columns else None
    name = body[32 : 31 + n_name].decode() if "name" in columns else None
    tags = list(parse_tags(body[tags_at:]).items()) if "tags" in columns else None
    ref_name = lambda i: refs[i][0] if i >= 0 else None
    return name, ref_name(ref), pos, length, flags, mapq, index, cigar, ref_name(mate), mate_pos, size, seq, qual, tags


class _Split(InputPartition):
    def __init__(self, path: str, start: int, stop: int | None):
        self.path, self.start, self.stop = path, start, stop


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = options["path"].split(",")
        self.split = int(options.get("splitBytes", SPLIT_BYTES))
        every = {c.split()[0] for c in SCHEMA.split(", ")}
        self.columns = set(options["columns"].split(",")) if "columns" in options else every

    def partitions(self):
        out = []
        for path in self.paths:
            with open_input(path) as file:
                blocked = block_size(file.read(18)) is not None
                size = file.seek(0, 2)
            cuts = range(0, size, self.split) if blocked else []
            out += [_Split(path, a, min(size, a + self.split)) for a in cuts] or [_Split(path, 0, None)]
        return out

    def read(self, partition):
        import pyarrow as pa

        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "map<string,string>": pa.map_(pa.string(), pa.string())}
        types = [kinds[c.split()[1]] for c in SCHEMA.split(", ")]
        with open_input(partition.path) as file, gzip.open(file, "rb") as plain:
            _, refs = _header(plain)
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for body in _bodies(partition.path, partition.start, partition.stop):
            rows.append(decode(body, refs, self.columns))
            if len(rows) >= BATCH_RECORDS:
                yield batch()
                rows = []
        if rows:
            yield batch()


class BamSource(DataSource):
    """spark.read.format("bam").option("columns", ...).load(path); several files by comma, cut by splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_bam(spark: SparkSession, path: str, columns: list[str] | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    spark.dataSource.register(BamSource)
    reader = spark.read.format("bam").option("splitBytes", split_bytes)
    return (reader.option("columns", ",".join(columns)) if columns else reader).load(path)


def read_genome(spark: SparkSession, path: str) -> DataFrame:
    with open_input(path) as raw, gzip.open(raw, "rb") as file:
        _, refs = _header(file)
    return spark.createDataFrame([(i, *r) for i, r in enumerate(refs)], "idx int, seqname string, length long")


def single_end_ranges(alignments: DataFrame, meta: list[str] = ()) -> DataFrame:
    """Mapped records as ranges with flag, mapq and the asked columns."""
    rows = alignments.where(F.col("seqname").isNotNull() & ~flag("flag", "unmapped"))
    return rows.select(F.monotonically_increasing_id().alias("row_id"), "seqname", F.col("pos").alias("from"), (F.col("pos") + F.col("length")).alias("to"), F.when(flag("flag", "reverse"), "-").otherwise("+").alias("strand"), "flag", "mapq", *meta)


def paired_end_ranges(alignments: DataFrame) -> DataFrame:
    """Proper pairs on one sequence as ranges from the first mate's start to the second's end; mates by occurrence."""
    rows = alignments.where(flag("flag", "proper_pair") & ~flag("flag", "secondary") & F.col("seqname").isNotNull())
    a, b = F.col("e")[0], F.get("e", F.lit(1))
    ends = mates(rows).where((F.size("e") == 2) & (a["seqname"] == b["seqname"]))
    return ends.select(F.monotonically_increasing_id().alias("row_id"), a["seqname"].alias("seqname"), a["pos"].alias("from"), (b["pos"] + b["length"]).alias("to"), F.lit("*").alias("strand"), a["flag"].alias("flag1"), b["flag"].alias("flag2"), a["mapq"].alias("mapq1"), b["mapq"].alias("mapq2"))


#: The empty block that ends a blocked gzip file; a fixed value.
_LAST_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def _pack(data: bytes) -> bytes:
    """Data as one block of blocked gzip."""
    tool = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = tool.compress(data) + tool.flush()
    head = _BLOCK_HEAD + b"\0\0\0\0\0\xff" + struct.pack("<H2sHH", 6, b"BC", 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def _file_head(refs: list[tuple[str, int]]) -> bytes:
    out = [b"BAM\1", struct.pack("<i", 0), struct.pack("<i", len(refs))]
    for name, length in refs:
        out.append(struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", length))
    return b"".join(out)


def _record(r: dict) -> bytes:
    name, seq = r["name"].encode() + b"\0", r.get("seq", "")
    ops = b"".join(struct.pack("<I", n << 4 | CIGAR_LETTERS.index(op)) for n, op in r.get("cigar", []))
    codes = [SEQ_LETTERS.index(x) for x in seq] + [0] * (len(seq) % 2)
    packed = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True))
    body = struct.pack("<iiBBHHHiiii", r.get("ref", 0), r["pos"], len(name), r.get("mapq", 0), r.get("bin", 0), len(r.get("cigar", [])), r["flag"], len(seq), -1, -1, 0) + name + ops + packed + bytes([30] * len(seq)) + r.get("tags", b"")
    return struct.pack("<i", len(body)) + body


def _write_blocks(file, pieces: Iterable[bytes], block: int) -> None:
    """Pieces of data as blocks of so many bytes; a block's worth is held at a time."""
    held = bytearray()
    for piece in pieces:
        held += piece
        while len(held) >= block:
            file.write(_pack(bytes(held[:block])))
            del held[:block]
    if held:
        file.write(_pack(bytes(held)))


def write_bam(path: str, refs: list[tuple[str, int]], rows: Iterable[dict], block: int = 65280) -> None:
    """A small BAM file, in blocks of so many bytes, from dictionaries (name, ref, pos, flag, mapq, cigar as (n, op) pairs, seq), for tests."""
    with open(path, "wb") as file:
        _write_blocks(file, chain([_file_head(refs)], map(_record, rows)), block)
        file.write(_LAST_BLOCK)


def write_alignments(rows: DataFrame, record: Callable[[dict], dict], path: str, refs: list[tuple[str, int]], block: int = 65280) -> None:
    """A BAM file of a table's rows in their order; ``record`` makes a row (as a dictionary) the dictionary that write_bam takes.

    Tasks encode and compress their rows into parts beside the file, in a folder that
    driver and executors share; a part is whole blocks, so the driver, which learns the
    parts' names only, lays them end to end.
    """
    import pyarrow as pa

    folder = path + ".parts"
    os.makedirs(folder, exist_ok=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"{folder}/{task.partitionId():08d}-{task.taskAttemptId()}"
        with open(name, "wb") as out:
            _write_blocks(out, (_record(record(r)) for batch in batches for r in batch.to_pylist()), block)
        yield pa.record_batch([pa.array([task.partitionId()], pa.int32()), pa.array([name])], names=["part", "name"])

    parts = rows.mapInArrow(run, "part int, name string").collect()  # a row a task
    with save(path) as out:
        _write_blocks(out, [_file_head(refs)], block)
        for _, name in sorted(tuple(p) for p in parts):
            with open(name, "rb") as part:
                shutil.copyfileobj(part, out, 1 << 20)
            os.remove(name)
        out.write(_LAST_BLOCK)
    with suppress(OSError):  # a failed task's part may be left
        os.rmdir(folder)
