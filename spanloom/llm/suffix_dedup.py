"""Removal of repeated byte strings by longest-previous-factor arrays.

A byte goes if a string of ``length`` bytes covers it that also starts elsewhere
in the corpus. Which starts those are is a property of suffix order: with the
suffixes sorted, the nearest suffixes above and below that begin at a smaller
position give a start's longest previous factor (LPF), and those that begin at a
larger position its longest next factor (LNF). LPF >= length marks later copies;
with LNF the first copy is marked as well.

No machine can hold the corpus' suffix array, so suffixes are first dealt into
buckets that keep equal strings together. Every window of ``length`` bytes picks
its smallest k-gram by hash (a minimizer, the leftmost on ties): equal windows
pick equal k-grams at equal offsets, and consecutive windows mostly share one.
A run of windows with one anchor is a segment.

1. Segments are counted by (anchor, content) with map-side combination, so that
   copies by the thousand collapse: of equal segments only the first and the last go
   on, and the others share the last one's verdict.
2. The segments' texts are cut out and dealt by anchor, and LPF/LNF arrays are built
   bucket by bucket. They say which windows go.
3. An anchor with more than ``hot_segments`` different segments is not gathered into
   one bucket: its windows are dealt by 128-bit fingerprints of all their bytes. A
   bucket then holds equal windows only, whose LPF is known without sorting: the
   length, for all but the first. Counts and minima are combined map-side.

Defined cases: null and empty texts have 0 bytes and no spans; repeated rows are
copies of each other (with keep_first, rows equal in id and text count as one);
with keep_first the copy at the smallest (doc_id, start) stays, null ids first;
ids may be null or repeated; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import stage
from .textops import mix64, slices, utf8

#: Bytes hashed at a time, so that the arrays stay small whatever a document's length.
PIECE = 1 << 19
#: Different segments of one anchor that are still sorted in one task (at 672 bytes each: 5 MB).
HOT_SEGMENTS = 8192
#: Bytes of windows that are compared at a time.
SORT_BYTES = 24 << 20

_BYTE_HASH = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_C1, _C2 = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)


def gram_size(length: int) -> int:
    """The anchors' k: the largest power of two that is at most a third of the length."""
    k = 1
    while k * 2 * 3 <= length:
        k *= 2
    return k


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _C1 + b
    x ^= x >> np.uint64(29)
    x *= _C2
    x ^= x >> np.uint64(32)
    return x


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k bytes from each position (k a power of two), by doubling."""
    h, m = _BYTE_HASH[data], 1
    while m < k:
        h = _pair(h[:-m], h[m:])
        m *= 2
    return h


def leftmost_minima(h: np.ndarray, w: int) -> np.ndarray:
    """For every window of w hashes, the position of its leftmost minimum."""
    v, at, m = h, np.arange(len(h), dtype=np.int32), 1
    while m < w:
        step = min(m, w - m)
        left = v[:-step] <= v[step:]
        at = np.where(left, at[:-step], at[step:])
        v = np.minimum(v[:-step], v[step:])
        m += step
    return at


def segments(data: np.ndarray, ends: np.ndarray, length: int):
    """Runs of windows with one anchor in texts laid end to end.

    Returns anchor hash, content hash, first window and number of windows. A text
    ends at each of ``ends``; no window reaches across.
    """
    k = gram_size(length)
    none = np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    if len(data) < length:
        return none
    h = gram_hashes(data, k)
    anchor = leftmost_minima(h, length - k + 1)
    start = np.arange(len(anchor), dtype=np.int64)
    owner_end = ends[np.searchsorted(ends, start, side="right")]
    valid = start + length <= owner_end
    head = valid.copy()
    head[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    first = np.flatnonzero(head)
    if not len(first):
        return none
    tail = valid.copy()
    tail[:-1] &= (anchor[1:] != anchor[:-1]) | ~valid[1:]
    n = np.flatnonzero(tail) - first + 1
    spot, last = anchor[first].astype(np.int64), first + n - 1 + length - k
    content = mix64((n * 1024 + spot - first).astype(np.uint64))
    at = first.copy()
    while (at < last).any():
        content = _pair(content, h[np.minimum(at, last)])
        at += k
    return h[spot], _pair(content, h[last]), first, n


def _pieces(texts: list[bytes], length: int):
    """Texts joined to about PIECE bytes, long ones cut with an overlap: list of (text, offset, size), bytes."""
    group: list[tuple[int, int, int]] = []
    held: list[bytes] = []
    size = 0
    for i, t in enumerate(texts):
        if len(t) < length:
            continue
        for a in range(0, len(t) - length + 1, PIECE):
            part = t[a : a + PIECE + length - 1]
            if held and size + len(part) > PIECE:
                yield group, b"".join(held)
                group, held, size = [], [], 0
            group.append((i, a, len(part)))
            held.append(part)
            size += len(part)
    if held:
        yield group, b"".join(held)


_SEGMENT = "anchor long, content long, doc_id long, k1 long, k2 long, start long, n int"


def _extract(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 3, 8 << 20):
                texts = utf8(batch.column(3))
                for group, data in _pieces(texts, length):
                    index, offset, size = (np.array(x, dtype=np.int64) for x in zip(*group, strict=True))
                    ends = np.cumsum(size)
                    a, c, first, n = segments(np.frombuffer(data, np.uint8), ends, length)
                    part = np.searchsorted(ends, first, side="right")
                    start = first - (ends - size)[part] + offset[part]
                    ids = batch.select(["doc_id", "k1", "k2"]).take(pa.array(index[part]))
                    yield pa.record_batch([pa.array(a.view(np.int64)), pa.array(c.view(np.int64)), *ids.columns, pa.array(start), pa.array(n.astype(np.int32))], names=["anchor", "content", "doc_id", "k1", "k2", "start", "n"])

    return run


def nearest_smaller(p: np.ndarray, lcp: np.ndarray, strict: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix in suffix order, the nearest one above with a smaller position, and their common prefix.

    lcp[i] is the common prefix of i-1 and i. Pointers jump until all rest: what
    lies between a suffix and its pointer never has a smaller position.
    """
    n = len(p)
    at = np.arange(n) - 1
    low = lcp.copy()
    while True:
        go = np.flatnonzero((at >= 0) & (p[at] >= p if strict else p[at] > p))
        if not len(go):
            break
        via = at[go]
        low[go], at[go] = np.minimum(low[go], low[via]), at[via]
    low[at < 0] = 0
    return at, low


def lpf(p: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """Longest previous factor of each suffix, from the smaller positions before and after it in suffix order."""
    n = len(p)
    _, above = nearest_smaller(p, lcp)
    turned = np.zeros(n, dtype=lcp.dtype)
    turned[1:] = lcp[1:][::-1]
    _, below = nearest_smaller(p[::-1], turned)
    return np.maximum(above, below[::-1])


def repeated_windows(rows: np.ndarray, order: np.ndarray, length: int, keep_first: bool) -> np.ndarray:
    """Which windows (rows of ``length`` bytes at global positions ``order``) are removed, by LPF (and LNF)."""
    n = len(rows)
    if n < 2:
        return np.zeros(n, dtype=bool)
    suffix = np.argsort(np.ascontiguousarray(rows).view(f"S{length}").ravel(), kind="stable")
    lcp = np.zeros(n, dtype=np.int32)
    for a in range(1, n, max(1, SORT_BYTES // length)):
        b = min(n, a + max(1, SORT_BYTES // length))
        differ = rows[suffix[a - 1 : b - 1]] != rows[suffix[a:b]]
        lcp[a:b] = np.where(differ.any(1), differ.argmax(1), length)
    p = order[suffix]
    out = np.zeros(n, dtype=bool)
    out[suffix] = lpf(p, lcp) >= length
    if not keep_first:
        out[suffix] |= lpf(-p, lcp) >= length
    return out


_RUNS = "anchor long, content long, later int, at int, n int"


def _bucket(texts: list[bytes], n: np.ndarray, rank: np.ndarray, length: int, keep_first: bool) -> list[tuple[int, int, int]]:
    """Removed runs of windows in whole buckets: (segment, first window, number)."""
    total = int(n.sum())
    segment = np.repeat(np.arange(len(n)), n)
    offset = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    base = np.cumsum(lengths) - lengths
    data = np.frombuffer(b"".join(texts), np.uint8)
    views = np.lib.stride_tricks.sliding_window_view(data, length)
    # equal windows have equal heads: sort a bounded number of windows at a time, dealt by a hash of their first bytes
    at = base[segment] + offset
    parts = max(1, -(-total * length // SORT_BYTES))
    head = np.zeros(total, dtype=np.uint64)
    if parts > 1:
        grams = gram_hashes(data, gram_size(length))
        head = grams[at] % np.uint64(parts)
    removed = np.zeros(total, dtype=bool)
    span = np.int64(1) << np.int64(32)
    for part in range(parts):
        own = np.flatnonzero(head == part) if parts > 1 else np.arange(total)
        order = rank[segment[own]] * span + offset[own]
        removed[own] = repeated_windows(views[at[own]], order, length, keep_first)
    edge = np.diff(np.concatenate([[0], removed.astype(np.int8), [0]]))
    runs = []
    for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
        while a < b:  # a run may go on into the next segment
            s = segment[a]
            stop = min(b, a + n[s] - offset[a])
            runs.append((int(s), int(offset[a]), int(stop - a)))
            a = stop
    return runs


def _sort_buckets(length: int, keep_first: bool):
    def flush(rows: list[dict]) -> pa.RecordBatch:
        # the total order of copies: (doc_id, nulls first, then start); with keep_first equal places have equal ranks
        place = [((x["doc_id"] is not None, x["doc_id"] or 0), x["start"], x["k1"], 0 if keep_first else x["later"]) for x in rows]
        ranks = {v: i for i, v in enumerate(sorted(set(place)))}
        rank = np.array([ranks[v] for v in place], dtype=np.int64)
        runs = _bucket([x["piece"] for x in rows], np.array([x["n"] for x in rows], dtype=np.int64), rank, length, keep_first)
        out = [(rows[s]["anchor"], rows[s]["content"], rows[s]["later"], a, m) for s, a, m in runs]
        cols = list(zip(*out, strict=True)) or [[]] * 5
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["anchor", "content", "later", "at", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = 0
        for batch in batches:
            for x in batch.to_pylist():
                if size > SORT_BYTES // 4 and x["bucket"] != held[-1]["bucket"]:
                    yield flush(held)
                    held, size = [], 0
                held.append(x)
                size += x["n"] * 8 + len(x["piece"])
        if held:
            yield flush(held)

    return run


_CUT = "bucket long, anchor long, content long, later int, doc_id long, k1 long, start long, n int, piece binary"


def _cut(length: int):
    """The segments' bytes, by anchor."""
    names = [x.split()[0] for x in _CUT.split(", ")]
    types = [pa.int64()] * 3 + [pa.int32()] + [pa.int64()] * 3 + [pa.int32(), pa.binary()]

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 0, 4 << 20):
                out: list[tuple] = []
                size = 0
                for text, wanted in zip(utf8(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                    for x in wanted:
                        segment = (x["anchor"], x["content"], x["later"], x["doc_id"], x["k1"])
                        a, n = x["start"], x["n"]
                        out.append((x["anchor"], *segment, a, n, text[a : a + n + length - 1]))
                        size += n + length
                        if size > 8 << 20:
                            yield batch_of(out)
                            out, size = [], 0
                if out:
                    yield batch_of(out)

    return run


_HOT = "anchor long, content long, later int, doc_id long, k1 long, start long, at int, copies long, f1 long, f2 long"


def _windows(length: int):
    """Of hot anchors' segments, every window with a 128-bit fingerprint."""
    names = [x.split()[0] for x in _HOT.split(", ")]
    types = [pa.int64()] * 2 + [pa.int32()] + [pa.int64()] * 3 + [pa.int32()] + [pa.int64()] * 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 0, 4 << 20):
                out: list[tuple] = []
                for text, wanted in zip(utf8(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                    for x in wanted:
                        for i in range(x["n"]):
                            fp = xxhash.xxh3_128_intdigest(text[x["start"] + i : x["start"] + i + length])
                            out.append((x["anchor"], x["content"], x["later"], x["doc_id"], x["k1"], x["start"] + i, i, x["copies"], (fp & (2**64 - 1)) - 2**63, (fp >> 64) - 2**63))
                        if len(out) > 20_000:
                            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                            out = []
                if out:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return run


def _finish(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(utf8(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                merged: list[list[int]] = []
                for a, n in sorted((x["start"], x["n"]) for x in spans or ()):
                    b = a + n - 1 + length
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                kept, at = hashlib.sha256(), 0
                for a, b in merged:
                    kept.update(text[at:a])
                    at = b
                kept.update(text[at:])
                rows.append((len(text), sum(b - a for a, b in merged), len(merged), kept.hexdigest(), merged))
            cols = list(zip(*rows, strict=True)) or [[], [], [], [], []]
            yield pa.record_batch([batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.list_(pa.list_(pa.int64())))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return run


def repeated_spans(docs: DataFrame, length: int = 400, keep_first: bool = True, id_col: str = "doc_id", text_col: str = "text", hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (byte ranges [from, to) to remove)."""
    if length < 3:
        raise ValueError("length must be at least 3")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # a row is known by 128 bits of its id and text; rows equal in both share their spans
    keyed = base.withColumn("k1", F.xxhash64(F.lit(1), "doc_id", "text")).withColumn("k2", F.xxhash64(F.lit(2), "doc_id", "text"))
    long_enough = keyed.select("doc_id", "k1", "k2", "text").where(F.octet_length("text") >= length)
    found = stage(long_enough.mapInArrow(_extract(length), _SEGMENT), "segments")

    place = F.struct("doc_id", "start", "k1", "k2", "n")
    classes = found.groupBy("anchor", "content").agg(F.count("*").alias("copies"), F.min(place).alias("first"), F.max(place).alias("last"))
    anchors = classes.groupBy("anchor").agg(F.sum("copies").alias("total"), F.count("*").alias("kinds")).where("total > 1")
    state = stage(classes.join(anchors, "anchor").withColumn("hot", F.col("kinds") > hot_segments), "classes")

    # of equal segments the first and the last go to the suffix arrays; the others share the last one's verdict
    two = F.when(F.col("copies") > 1, F.array("first", "last")).otherwise(F.array("first"))
    each = state.select("anchor", "content", "copies", "hot", F.posexplode(two).alias("later", "x"))
    cells = F.struct("anchor", "content", "copies", "later", F.col("x.doc_id").alias("doc_id"), F.col("x.k1").alias("k1"), F.col("x.start").alias("start"), F.col("x.n").alias("n"))
    texts = keyed.where(F.octet_length("text") >= length).select("k1", "k2", "text")

    def cut(hot: bool) -> DataFrame:
        wanted = each.where(F.col("hot") == hot).groupBy(F.col("x.k1").alias("k1"), F.col("x.k2").alias("k2")).agg(F.collect_list(cells).alias("wanted"))
        return texts.join(wanted, ["k1", "k2"]).select("text", "wanted")

    pieces = cut(False).mapInArrow(_cut(length), _CUT)
    runs = pieces.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_sort_buckets(length, keep_first), _RUNS)
    if not state.where("hot").isEmpty():
        windows = stage(cut(True).mapInArrow(_windows(length), _HOT), "windows")
        own = F.struct("doc_id", "start", "k1")
        # a class's last segment stands for all copies but the first
        weight = F.when(F.col("later") == 1, F.col("copies") - 1).otherwise(1)
        counted = windows.groupBy("f1", "f2").agg(F.sum(weight).alias("c"), F.min(own).alias("top")).where("c > 1")
        again = windows.join(counted, ["f1", "f2"])
        if keep_first:
            again = again.where("not (doc_id <=> top.doc_id and start = top.start and k1 = top.k1)")
        runs = runs.unionByName(again.select("anchor", "content", "later", "at", F.lit(1).alias("n")))
    runs = stage(runs, "runs")
    copies = found.join(state.select("anchor", "content", "first"), ["anchor", "content"])
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("start") == F.col("first.start")) & (F.col("k1") == F.col("first.k1"))
    placed = copies.select("anchor", "content", "k1", "k2", "start", F.when(is_first, 0).otherwise(1).alias("later"))
    spans = placed.join(runs, ["anchor", "content", "later"]).select("k1", "k2", (F.col("start") + F.col("at")).alias("start"), "n")
    by_row = stage(spans.distinct().groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "n")).alias("spans")), "spans")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>"
    return keyed.join(by_row, ["k1", "k2"], "left").select("doc_id", "text", "spans").mapInArrow(_finish(length), schema)


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text, spans in zip(utf8(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            out, at = [], 0
            for a, b in spans or ():
                out.append(text[at:a])
                at = b
            texts.append(b"".join([*out, text[at:]]).decode("utf-8", "replace"))
        yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return repeated_spans(docs, 400, keep_first=False).drop("spans")


def dedup_sql(length: int = 400) -> str:
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (
  SELECT rid, unnest(range(0, octet_length(b) - {length} + 1)) AS i,
    unnest(list_transform(range(0, octet_length(b) - {length} + 1), lambda i: md5(b[i + 1 : i + {length}]))) AS h
  FROM d WHERE octet_length(b) >= {length}
), r AS (SELECT rid, i FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
e AS (SELECT *, i - lag(i) OVER (PARTITION BY rid ORDER BY i) > {length} AS apart FROM r),
g AS (SELECT *, count(*) FILTER (apart) OVER (PARTITION BY rid ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM e),
s AS (SELECT rid, run, min(i) AS a, max(i) + {length} AS z FROM g GROUP BY rid, run),
k AS (SELECT rid, a, z, coalesce(lag(z) OVER (PARTITION BY rid ORDER BY a), 0) AS before FROM s),
t AS (
  SELECT k.rid, count(*) AS n_spans, sum(z - a) AS n_removed, max(z) AS z, string_agg(hex(b[before + 1 : a]), '' ORDER BY a) AS kept
  FROM k JOIN d USING (rid) GROUP BY k.rid
)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  CASE WHEN n_spans IS NULL THEN sha256(b) ELSE sha256(unhex(kept || hex(b[z + 1 : octet_length(b)]))) END AS kept_sha256
FROM d LEFT JOIN t USING (rid)
"""


OP2_SQL = dedup_sql()
