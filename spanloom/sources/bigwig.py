"""BigWig files: codec, a Python data source with range push-down, and a writer.

The layout follows the published format: header, zoom headers, chromosome B+ tree,
compressed data sections, R tree. A reader plans one partition per run of leaf
blocks that the asked range touches, so a query reads only its blocks.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..operators.stats import bin_statistic
from ..operators.tracks import dense_bins
from .files import open_input, save

MAGIC, BPT_MAGIC, IDX_MAGIC = 0x888FFC26, 0x78CA8C91, 0x2468ACE0
SCHEMA = "seqname string, `from` long, `to` long, value double"
ZOOM_SCHEMA = "seqname string, `from` long, `to` long, valid double, min double, max double, sum double, sum_sq double"
#: Bins that a task encodes at a time.
CHUNK = 65536


class BigWig:
    """An open file: chromosomes, zoom levels and block index."""

    def __init__(self, path: str):
        self.file = open_input(path)
        head = self.file.read(64)
        self.order = "<" if struct.unpack("<I", head[:4])[0] == MAGIC else ">"
        if struct.unpack(self.order + "I", head[:4])[0] != MAGIC:
            raise ValueError("not a bigWig file")
        _, self.version, zooms, self.tree_at, self.data_at, self.index_at, _, _, _, self.summary_at, self.buffer, _ = struct.unpack(self.order + "IHHQQQHHQQIQ", head)
        raw = self.file.read(24 * zooms)
        self.zooms = [struct.unpack_from(self.order + "IIQQ", raw, 24 * i) for i in range(zooms)]
        self.chroms = self._chroms()

    def close(self) -> None:
        self.file.close()

    def _chroms(self) -> dict[str, tuple[int, int]]:
        self.file.seek(self.tree_at)
        magic, _, key, _, _, _ = struct.unpack(self.order + "IIIIQQ", self.file.read(32))
        if magic != BPT_MAGIC:
            raise ValueError("bad chromosome tree")
        out: dict[str, tuple[int, int]] = {}

        def walk(at: int) -> None:
            self.file.seek(at)
            leaf, _, n = struct.unpack(self.order + "BBH", self.file.read(4))
            body = self.file.read(n * (key + 8))
            for i in range(n):
                name = body[i * (key + 8) : i * (key + 8) + key].rstrip(b"\0").decode()
                rest = body[i * (key + 8) + key : (i + 1) * (key + 8)]
                if leaf:
                    out[name] = struct.unpack(self.order + "II", rest)
                else:
                    walk(struct.unpack(self.order + "Q", rest)[0])

        walk(self.tree_at + 32)
        return out

    def blocks(self, chrom: int | None = None, start: int = 0, stop: int = 2**32, index_at: int | None = None) -> list[tuple[int, int]]:
        """(offset, size) of the leaf blocks that meet a range."""
        root = self.index_at if index_at is None else index_at
        self.file.seek(root)
        if struct.unpack(self.order + "I", self.file.read(4))[0] != IDX_MAGIC:
            raise ValueError("bad block index")
        out: list[tuple[int, int]] = []

        def walk(at: int) -> None:
            self.file.seek(at)
            leaf, _, n = struct.unpack(self.order + "BBH", self.file.read(4))
            size = 32 if leaf else 24
            body = self.file.read(n * size)
            for i in range(n):
                c1, s, c2, e, offset = struct.unpack_from(self.order + "IIIIQ", body, i * size)
                if chrom is not None and ((c2, e) <= (chrom, start) or (c1, s) >= (chrom, stop)):
                    continue
                if leaf:
                    out.append((offset, struct.unpack_from(self.order + "Q", body, i * size + 24)[0]))
                else:
                    walk(offset)

        walk(root + 48)
        return out

    def _bytes(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        raw = self.file.read(size)
        return zlib.decompress(raw) if self.buffer else raw

    def records(self, offset: int, size: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        """Chromosome id, starts, ends and values of a raw block."""
        data = self._bytes(offset, size)
        chrom, start, _, step, span, kind, _, n = struct.unpack(self.order + "IIIIIBBH", data[:24])
        o = self.order
        if kind == 1:
            x = np.frombuffer(data, np.dtype([("s", o + "u4"), ("e", o + "u4"), ("v", o + "f4")]), n, 24)
            return chrom, x["s"].astype(np.int64), x["e"].astype(np.int64), x["v"].astype(float)
        if kind == 2:
            x = np.frombuffer(data, np.dtype([("s", o + "u4"), ("v", o + "f4")]), n, 24)
            return chrom, x["s"].astype(np.int64), x["s"].astype(np.int64) + span, x["v"].astype(float)
        v = np.frombuffer(data, o + "f4", n, 24).astype(float)
        s = start + step * np.arange(n, dtype=np.int64)
        return chrom, s, s + span, v

    def zoom_block(self, offset: int, size: int) -> np.ndarray:
        """The records of a zoom level's block."""
        o = self.order
        fields = [(n, o + "u4") for n in ("chrom", "from", "to", "valid")] + [(n, o + "f4") for n in ("min", "max", "sum", "sum_sq")]
        return np.frombuffer(self._bytes(offset, size), np.dtype(fields))

    def zoom_records(self, level: int) -> list[tuple]:
        """(chrom id, from, to, valid, min, max, sum, sum of squares) of a zoom level."""
        found = [self.zoom_block(*b) for b in self.blocks(index_at=self.zooms[level][3])]
        return [r.item() for block in found for r in block]

    def zoom_for(self, bin_size: int) -> int | None:
        """The last level whose reduction divides the bin size; None: raw data."""
        best = None
        for i, z in enumerate(self.zooms):
            if bin_size >= z[0] and bin_size % z[0] == 0:
                best = i
        return best

    def bin_size(self) -> int:
        """The span of the first record; bedGraph records have no span of their own."""
        for offset, size in self.blocks():
            if self._bytes(offset, size)[20] == 1:
                raise ValueError("the file's records are bedGraph: it has no bin size of its own")
            _, s, e, _ = self.records(offset, size)
            return int(e[0] - s[0])
        raise ValueError("no data")

    def names(self, pattern: str) -> list[str]:
        """The sequences whose whole name matches, in the order of their ids."""
        every = sorted(self.chroms, key=lambda n: self.chroms[n][0])
        return [n for n in every if re.fullmatch(pattern, n)]


class _Part(InputPartition):
    def __init__(self, path: str, blocks: list[tuple[int, int]], wanted: list[str] | None):
        self.path, self.blocks, self.wanted = path, blocks, wanted


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.per_task = int(options.get("blocksPerTask", 256))
        self.pattern = options.get("seqnames")
        self.zoom = int(options["zoom"]) if "zoom" in options else None
        self.seqname, self.start, self.stop = None, 0, 2**32

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) else None
            if isinstance(f, EqualTo) and name == "seqname":
                self.seqname = f.value
            elif isinstance(f, (LessThan, LessThanOrEqual)) and name == "from":
                self.stop = min(self.stop, f.value + 1)
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)) and name == "to":
                self.start = max(self.start, f.value - 1)
            yield f  # Spark still filters the rows of the blocks

    def partitions(self):
        bw = BigWig(self.path)
        try:
            names = None if self.pattern is None else bw.names(self.pattern)
            if self.seqname is not None:
                names = [n for n in ([self.seqname] if names is None else names) if n == self.seqname and n in bw.chroms]
            index_at = None if self.zoom is None else bw.zooms[self.zoom][3]
            if names is None:
                found = bw.blocks(None, index_at=index_at)
            else:
                each = [bw.blocks(bw.chroms[n][0], self.start, self.stop, index_at) for n in names]
                found = list(dict.fromkeys(b for part in each for b in part))
        finally:
            bw.close()
        cuts = range(0, max(1, len(found)), self.per_task)
        return [_Part(self.path, found[i : i + self.per_task], names) for i in cuts]

    def read(self, partition):
        import pyarrow as pa

        bw = BigWig(partition.path)
        names = {i: n for n, (i, _) in bw.chroms.items()}
        try:
            for offset, size in partition.blocks:
                if self.zoom is None:
                    c, s, e, v = bw.records(offset, size)
                    if partition.wanted is None or names[c] in partition.wanted:
                        yield pa.record_batch([pa.array([names[c]] * len(s)), pa.array(s), pa.array(e), pa.array(v)], names=["seqname", "from", "to", "value"])
                    continue
                z = bw.zoom_block(offset, size)
                z = z[[partition.wanted is None or names[int(c)] in partition.wanted for c in z["chrom"]]]
                columns = [pa.array([names[int(c)] for c in z["chrom"]], pa.string())]
                columns += [pa.array(z[k].astype(np.int64)) for k in ("from", "to")]
                columns += [pa.array(z[k].astype(float)) for k in ("valid", "min", "max", "sum", "sum_sq")]
                yield pa.record_batch(columns, names=["seqname", "from", "to", "valid", "min", "max", "sum", "sum_sq"])
        finally:
            bw.close()


class BigWigSource(DataSource):
    """spark.read.format("bigwig").load(path): seqname, from, to, value.

    Options: seqnames (a regular expression for whole names), zoom (a level; then the
    rows are pre-aggregated records), blocksPerTask.
    """

    @classmethod
    def name(cls) -> str:
        return "bigwig"

    def schema(self) -> str:
        return ZOOM_SCHEMA if "zoom" in self.options else SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_bigwig(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(BigWigSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("bigwig").options(**options).load(path)


def query(spark: SparkSession, path: str, seqnames: str, start: int, stop: int, bin_size: int) -> DataFrame:
    """seqname, from, to, valid, min, max, sum, sum_sq by bins of the asked range.

    Sequences match by a regular expression. The range is widened to whole bins; a
    record counts if it lies in it, in each bin with the bases they share (sums and
    valid are weighted by bases). The last zoom level that divides the bin size is
    read instead of the data, if there is one. A bin size of 0 gives the records as
    they are.
    """
    if bin_size == 0:
        rows = read_bigwig(spark, path, seqnames=seqnames).where((F.col("from") >= start) & (F.col("to") <= stop))
        size, v = (F.col("to") - F.col("from")).cast("double"), F.col("value")
        return rows.select("seqname", "from", "to", size.alias("valid"), v.alias("min"), v.alias("max"), (v * size).alias("sum"), (v * v * size).alias("sum_sq"))
    low, high = start // bin_size * bin_size, -(-stop // bin_size) * bin_size
    bw = BigWig(path)
    level = bw.zoom_for(bin_size)
    bw.close()
    if level is None:
        rows = read_bigwig(spark, path, seqnames=seqnames).where(~F.isnan("value"))
        size, v = F.col("to") - F.col("from"), F.col("value")
        rows = rows.select("seqname", "from", "to", size.cast("double").alias("valid"), v.alias("min"), v.alias("max"), (v * size).alias("sum"), (v * v * size).alias("sum_sq"))
    else:
        rows = read_bigwig(spark, path, seqnames=seqnames, zoom=str(level))
    inside = rows.where((F.col("from") >= low) & (F.col("to") <= high) & (F.col("from") < F.col("to")))
    return _by_bin(inside, 0, bin_size).select("seqname", (F.col("bin") * bin_size).alias("from"), ((F.col("bin") + 1) * bin_size).alias("to"), "valid", "min", "max", "sum", "sum_sq")


def _by_bin(rows: DataFrame, start: int, bin_size: int) -> DataFrame:
    """Moments by bin (from ``start`` on) of records with moments; a record's sums are spread over its bases."""
    cells = rows.withColumn("bin", F.explode(F.expr(f"sequence((`from` - {start}) div {bin_size}, (`to` - 1 - {start}) div {bin_size})")))
    shared = F.least("to", (F.col("bin") + 1) * bin_size + start) - F.greatest("from", F.col("bin") * bin_size + start)
    share = shared / (F.col("to") - F.col("from"))
    sums = [F.sum(F.col(c) * share).alias(c) for c in ("valid", "sum", "sum_sq")]
    return cells.groupBy("seqname", "bin").agg(*sums, F.min("min").alias("min"), F.max("max").alias("max"))


def _statistic(moments: DataFrame, statistic: str, overlap: int, n_bins: str) -> DataFrame:
    """seqname, bin, value: the statistic of each bin with ``overlap`` neighbours on either side."""
    if overlap:
        near = F.explode(F.sequence(F.col("bin") - overlap, F.col("bin") + overlap))
        spread = moments.withColumn("bin", near)
        sums = [F.sum(c).alias(c) for c in ("valid", "sum", "sum_sq")]
        moments = spread.groupBy("seqname", "bin", n_bins).agg(*sums, F.min("min").alias("min"), F.max("max").alias("max"))
    kept = moments.where((F.col("bin") >= 0) & (F.col("bin") < F.col(n_bins)) & (F.col("valid") > 0))
    return kept.select("seqname", "bin", bin_statistic(statistic, "valid").alias("value"))


def read_track(spark: SparkSession, path: str, bin_size: int = 0, statistic: str = "mean", overlap: int = 0, init: float | None = None) -> DataFrame:
    """A file as a track: one value a bin, by a bin statistic over the bases (and ``overlap`` bins around).

    A bin size of 0 takes the file's own. Bins without data are left out, or have the
    value ``init`` if it is given.
    """
    bw = BigWig(path)
    bin_size = bin_size or bw.bin_size()
    bw.close()
    genome = read_genome(spark, path)
    n_bins = genome.select("seqname", F.expr(f"length div {bin_size}").alias("n_bins"))
    moments = query(spark, path, ".*", 0, 2**31, bin_size).withColumn("bin", F.expr(f"`from` div {bin_size}"))
    track = _statistic(moments.join(F.broadcast(n_bins), "seqname"), statistic, overlap, "n_bins")  # a file's sequences
    if init is None:
        return track
    return dense_bins(genome, bin_size).join(track, ["seqname", "bin"], "left").withColumn("value", F.coalesce("value", F.lit(float(init))))


def query_slice(spark: SparkSession, path: str, seqnames: str, start: int, stop: int, bin_size: int = 0, statistic: str = "mean", overlap: int = 0, init: float = float("nan")) -> DataFrame:
    """seqname, bin, value: the bins of [start, stop) of the sequences that match, numbered from start; ``init`` without data.

    A bin size of 0 takes the file's own, and its records as they are.
    """
    bw = BigWig(path)
    names = bw.names(seqnames)
    bin_size = bin_size or bw.bin_size()
    bw.close()
    n = (stop - start) // bin_size
    rows = query(spark, path, seqnames, start // bin_size * bin_size, -(-stop // bin_size) * bin_size, 0)
    rows = rows.where(~F.isnan("min") & (F.col("from") >= start) & (F.col("to") <= stop))
    moments = _by_bin(rows, start, bin_size).withColumn("n_bins", F.lit(n))
    found = _statistic(moments, statistic, overlap, "n_bins")
    every = spark.createDataFrame([(x,) for x in names], "seqname string").crossJoin(spark.range(n).withColumnRenamed("id", "bin"))  # the asked bins
    return every.join(found, ["seqname", "bin"], "left").withColumn("value", F.coalesce("value", F.lit(float(init))))


def query_sequence(spark: SparkSession, path: str, seqname: str, bin_size: int = 0, statistic: str = "mean", overlap: int = 0, init: float = float("nan")) -> DataFrame:
    """query_slice over a whole sequence, which must be in the file."""
    bw = BigWig(path)
    known = bw.chroms.get(seqname)
    bw.close()
    if known is None:
        raise ValueError(f"no sequence {seqname}")
    return query_slice(spark, path, re.escape(seqname), 0, known[1], bin_size, statistic, overlap, init)


def read_genome(spark: SparkSession, path: str) -> DataFrame:
    bw = BigWig(path)
    rows = [(i, n, length) for n, (i, length) in sorted(bw.chroms.items(), key=lambda x: x[1])]
    bw.close()
    return spark.createDataFrame(rows, "idx int, seqname string, length long")


def _tree(items: list[tuple], block: int, at: int, leaf_size: int, pack_leaf, pack_node) -> bytes:
    """Levels of a tree written root first; items are (key..., payload) for the leaves."""
    levels = [[items[i : i + block] for i in range(0, len(items), block)] or [[]]]
    while len(levels[0]) > 1:
        levels.insert(0, [levels[0][i : i + block] for i in range(0, len(levels[0]), block)])
    offsets, pos = [], at
    for depth, level in enumerate(levels):
        size = leaf_size if depth == len(levels) - 1 else (24 if leaf_size == 32 else leaf_size)
        own = []
        for node in level:
            own.append(pos)
            pos += 4 + len(node) * size
        offsets.append(own)
    out = []
    for depth, level in enumerate(levels):
        last = depth == len(levels) - 1
        child = iter(offsets[depth + 1]) if not last else None
        for node in level:
            out.append(struct.pack("<BBH", int(last), 0, len(node)))
            out += [pack_leaf(x) if last else pack_node(x, next(child)) for x in node]
    return b"".join(out)


def _leaves(node) -> Iterator[tuple]:
    if isinstance(node, tuple):
        yield node
    else:
        for x in node:
            yield from _leaves(x)


def _rtree(boxes: list[tuple], at: int, end: int, per_slot: int, block: int = 256) -> bytes:
    """boxes: (chrom, from, chrom, to, offset, size)."""
    first, last = (boxes[0], boxes[-1]) if boxes else ((0, 0, 0, 0), (0, 0, 0, 0))
    head = struct.pack("<IIQIIIIQII", IDX_MAGIC, block, len(boxes), first[0], first[1], last[2], max((b[3] for b in boxes if b[2] == last[2]), default=0), end, per_slot, 0)

    def node(x, offset: int) -> bytes:
        own = list(_leaves(x))
        top = max((b[2], b[3]) for b in own)
        return struct.pack("<IIIIQ", own[0][0], own[0][1], *top, offset)

    return head + _tree(boxes, block, at + 48, 32, lambda b: struct.pack("<IIIIQQ", *b), node)


_ZOOM = np.dtype([(n, "<u4") for n in ("chrom", "from", "to", "valid")] + [(n, "<f8") for n in ("min", "max", "sum", "sum_sq")])
_ZOOM_DISK = np.dtype([(n, "<u4") for n in ("chrom", "from", "to", "valid")] + [(n, "<f4") for n in ("min", "max", "sum", "sum_sq")])


def reductions_of(longest: int, bin_size: int, per_slot: int) -> list[int]:
    """The bases that a record of each zoom level stands for."""
    out, r = [], max(100, 4 * bin_size)
    while longest / r > per_slot and len(out) < 11:
        out.append(r)
        r *= 4 * bin_size if bin_size > 1 else 4
    return out


def encode(chrom: int, first: int, values: np.ndarray, bin_size: int, reductions: list[int], per_slot: int = 1024) -> Iterator[tuple]:
    """Sections of bins from ``first`` on: start, stop, packed bytes, their size unpacked; the last item has the zoom records and moments.

    Runs of bins are fixedStep where most bins have values, else variableStep.
    """
    v = np.asarray(values, dtype="<f4")
    good = np.flatnonzero(~np.isnan(v))
    dense = 2 * len(good) > len(v)
    runs = np.split(good, np.flatnonzero(np.diff(good) != 1) + 1) if dense and len(good) else [good]
    for run in runs:
        for a in range(0, len(run), per_slot):
            part = run[a : a + per_slot]
            at = part + first
            start, stop = int(at[0]) * bin_size, (int(at[-1]) + 1) * bin_size
            head = struct.pack("<IIIIIBBH", chrom, start, stop, bin_size if dense else 0, bin_size, 3 if dense else 2, 0, len(part))
            if dense:
                body = v[part].tobytes()
            else:
                rec = np.empty(len(part), np.dtype([("s", "<u4"), ("v", "<f4")]))
                rec["s"], rec["v"] = at * bin_size, v[part]
                body = rec.tobytes()
            yield start, stop, zlib.compress(head + body), 24 + len(body)
    x = v[good].astype(float)
    levels = []
    for red in reductions:
        cell = (good + first) * bin_size // red
        cut = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.empty(0, np.int64)
        z = np.zeros(len(cut), _ZOOM)
        if len(cut):
            z["chrom"], z["from"], z["to"] = chrom, cell[cut] * red, (cell[cut] + 1) * red
            z["valid"] = np.diff(np.append(cut, len(cell)))
            z["min"], z["max"] = np.minimum.reduceat(x, cut), np.maximum.reduceat(x, cut)
            z["sum"], z["sum_sq"] = np.add.reduceat(x, cut), np.add.reduceat(x * x, cut)
        levels.append(z.tobytes())
    yield levels, (len(x), float(x.min(initial=math.inf)), float(x.max(initial=-math.inf)), float(x.sum()), float((x * x).sum()))


def _joined(parts: list[bytes]) -> np.ndarray:
    """A level's zoom records in order; neighbours of one cell, cut by a chunk's border, become one."""
    z = np.frombuffer(b"".join(parts), _ZOOM)
    if not len(z):
        return z.astype(_ZOOM_DISK)
    same = (z["chrom"][1:] == z["chrom"][:-1]) & (z["from"][1:] == z["from"][:-1])
    cut = np.flatnonzero(np.concatenate([[True], ~same]))
    out = z[cut].copy()
    out["valid"] = np.add.reduceat(z["valid"], cut)
    out["sum"], out["sum_sq"] = np.add.reduceat(z["sum"], cut), np.add.reduceat(z["sum_sq"], cut)
    out["min"], out["max"] = np.minimum.reduceat(z["min"], cut), np.maximum.reduceat(z["max"], cut)
    return out.astype(_ZOOM_DISK)


def assemble(path: str, lengths: list[tuple[str, int]], sections: Iterator[tuple], reductions: list[int], per_slot: int = 1024) -> None:
    """The file from encoded sections (chrom, then what ``encode`` gives) in the order of the sequences."""
    ids = {n: i for i, (n, _) in enumerate(lengths)}
    key = max((len(n.encode()) for n, _ in lengths), default=1)
    tree_at = 64 + 24 * len(reductions)
    sorted_chroms = sorted((n.encode().ljust(key, b"\0"), ids[n], x) for n, x in lengths)
    pack_leaf = lambda x: x[0] + struct.pack("<II", x[1], x[2])
    pack_node = lambda x, off: next(_leaves(x))[0] + struct.pack("<Q", off)
    tree = struct.pack("<IIIIQQ", BPT_MAGIC, 256, key, 8, len(lengths), 0) + _tree(sorted_chroms, 256, tree_at + 32, key + 8, pack_leaf, pack_node)
    summary_at = tree_at + len(tree)
    data_at = summary_at + 40
    with save(path) as out:
        out.write(b"\0" * data_at)
        out.write(struct.pack("<Q", 0))
        boxes: list[tuple] = []
        zoomed: list[list[bytes]] = [[] for _ in reductions]
        n, low, high, total, squares, largest = 0, math.inf, -math.inf, 0.0, 0.0, 1
        for chrom, *item in sections:
            if len(item) == 2:
                levels, (m, least, most, plus, square) = item
                n, total, squares = n + m, total + plus, squares + square
                low, high = min(low, least), max(high, most)
                for level, part in zip(zoomed, levels, strict=True):
                    level.append(part)
                continue
            start, stop, packed, size = item
            boxes.append((chrom, start, chrom, stop, out.tell(), len(packed)))
            largest = max(largest, size)
            out.write(packed)
        sections_n, index_at = len(boxes), out.tell()
        out.write(_rtree(boxes, index_at, index_at, per_slot))
        zoom_heads = []
        for red, parts in zip(reductions, zoomed, strict=True):
            rows = _joined(parts)
            zoom_at = out.tell()
            out.write(struct.pack("<I", len(rows)))
            boxes = []
            edges = np.flatnonzero(np.diff(rows["chrom"])) + 1 if len(rows) else []
            for own in np.split(rows, edges) if len(rows) else []:
                for a in range(0, len(own), per_slot):
                    part = own[a : a + per_slot]
                    body = part.tobytes()
                    largest = max(largest, len(body))
                    packed = zlib.compress(body)
                    chrom = int(part["chrom"][0])
                    boxes.append((chrom, int(part["from"][0]), chrom, int(part["to"][-1]), out.tell(), len(packed)))
                    out.write(packed)
            zoom_index = out.tell()
            out.write(_rtree(boxes, zoom_index, zoom_index, per_slot))
            zoom_heads.append(struct.pack("<IIQQ", red, 0, zoom_at, zoom_index))
        out.write(struct.pack("<I", MAGIC))
        out.seek(0)
        head = struct.pack("<IHHQQQHHQQIQ", MAGIC, 4, len(reductions), tree_at, data_at, index_at, 0, 0, 0, summary_at, largest, 0)
        out.write(head + b"".join(zoom_heads) + tree)
        out.write(struct.pack("<Qdddd", n, low if n else 0.0, high if n else 0.0, total, squares))
        out.seek(data_at)
        out.write(struct.pack("<Q", sections_n))


def write_file(path: str, lengths: list[tuple[str, int]], values, bin_size: int, per_slot: int = 1024) -> None:
    """One bigWig file from (seqname, array of bin values); sequences in the order of ``lengths``."""
    ids = {n: i for i, (n, _) in enumerate(lengths)}
    reductions = reductions_of(max((x for _, x in lengths), default=0), bin_size, per_slot)
    parts = ((ids[name], *item) for name, v in values for item in encode(ids[name], 0, v, bin_size, reductions, per_slot))
    assemble(path, lengths, parts, reductions, per_slot)


_SECTIONS = "chrom int, chunk long, start long, stop long, packed binary, size long, levels array<binary>, moments array<double>"


def write_bigwig(track: DataFrame, genome: DataFrame, path: str, bin_size: int, per_slot: int = 1024) -> None:
    """A track as one bigWig file.

    Tasks encode and compress the sections, a chunk of bins at a time; the format is
    one sequential file with its index behind the data, so one writer lays the
    finished sections end to end, in order, as they arrive.
    """
    import pyarrow as pa

    lengths = [(r["seqname"], r["length"]) for r in genome.orderBy("idx").collect()]  # a genome's sequences
    ids = {n: i for i, (n, _) in enumerate(lengths)}
    n_bins = [x // bin_size for _, x in lengths]
    reductions = reductions_of(max((x for _, x in lengths), default=0), bin_size, per_slot)
    names = [x.split()[0] for x in _SECTIONS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, values = None, None

        def flush() -> pa.RecordBatch:
            chrom, chunk = key
            rows = []
            for item in encode(chrom, chunk * CHUNK, values, bin_size, reductions, per_slot):
                rows.append((chrom, chunk, None, None, None, None, item[0], list(item[1])) if len(item) == 2 else (chrom, chunk, *item, None, None))
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.float64())]
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            chroms, chunks, bins, found = (batch.column(j).to_numpy(zero_copy_only=False) for j in range(4))
            cut = np.flatnonzero(np.concatenate([[True], (chroms[1:] != chroms[:-1]) | (chunks[1:] != chunks[:-1]), [True]])) if len(bins) else []
            for a, b in zip(cut, cut[1:], strict=False):
                own = (int(chroms[a]), int(chunks[a]))
                if own != key:
                    if key is not None:
                        yield flush()
                    key = own
                    values = np.full(min(CHUNK, n_bins[own[0]] - own[1] * CHUNK), np.nan, np.float32)
                values[bins[a:b] - own[1] * CHUNK] = found[a:b]
        if key is not None:
            yield flush()

    number = F.create_map(*[x for n, i in ids.items() for x in (F.lit(n), F.lit(i))]) if ids else F.create_map()
    size = F.create_map(*[x for (n, _), m in zip(lengths, n_bins, strict=True) for x in (F.lit(n), F.lit(m))]) if ids else F.create_map()
    rows = track.select(number[F.col("seqname")].cast("int").alias("chrom"), "bin", F.col("value").cast("double").alias("value"), size[F.col("seqname")].alias("n"))
    rows = rows.where("chrom is not null and bin >= 0 and bin < n").select("chrom", F.expr(f"bin div {CHUNK}").alias("chunk"), "bin", "value")
    done = rows.repartitionByRange("chrom", "chunk").sortWithinPartitions("chrom", "chunk").mapInArrow(run, _SECTIONS)
    # range partitions come in order, and sections in order within a partition

    def arriving() -> Iterator[tuple]:
        for r in done.toLocalIterator():
            if r["packed"] is None:
                n, *rest = r["moments"]
                yield r["chrom"], [bytes(x) for x in r["levels"]], (int(n), *rest)
            else:
                yield r["chrom"], r["start"], r["stop"], bytes(r["packed"]), r["size"]

    assemble(path, lengths, arriving(), reductions, per_slot)


def rename_chromosomes(source: str, target: str, pattern: str, replacement: str) -> None:
    """A copy of a file with a regular expression replaced in its sequence names."""
    bw = BigWig(source)
    size = bw.bin_size()
    new = [(re.sub(pattern, replacement, n), i, x) for n, (i, x) in sorted(bw.chroms.items(), key=lambda c: c[1])]

    def arrays():
        for name, chrom, length in new:
            v = np.full(-(-length // size), np.nan, np.float32)
            for offset, n in bw.blocks(chrom, 0, length):
                c, s, _, x = bw.records(offset, n)
                if c == chrom:
                    v[s // size] = x
            yield name, v

    write_file(target, [(n, x) for n, _, x in new], arrays(), size)
    bw.close()
