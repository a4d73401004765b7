"""Exact Jaccard join on word shingles by universe partition.

Two sets with Jaccard similarity t or more differ in at most
H = floor((1-t)/(1+t) * (|r|+|s|)) shingles. The shingles' universe is split by
hash into segments, by size band: with m0 segments compared exactly and m1 within
one deletion, m0 + 2*m1 > H, two such sets agree on some exact segment, or differ
by one shingle at most on some other. A set's signatures are therefore its exact
segments' hashes, and for the others the segment's hash and those with one shingle
left out. Of exact segments there may be more than needed; a set then writes only
those of at least L shingles, L being the largest for which enough are left. Nothing
is lost: of two linked sets the one with the larger L has an agreeing segment of at
least L shingles, and the other writes it too. So empty segments, on which strangers
meet, are hardly ever written. How many segments are of which kind is chosen for each
band by cost: signatures written, and the expected number of strangers that meet by
chance, which grows with the number of documents. Sets index under their own band,
and probe every further band that can hold partners.

1. Documents become set fingerprints (equal sets are one node, so copies never meet
   in pairs) and signatures, packed and dealt by signature: a task groups the
   signatures of its range. Signatures that many nodes of one batch share are
   combined before they are dealt.
2. Within a signature every node is a candidate partner of the smallest one.
   Candidates are thinned by parity sketches: bit j of a node's sketch is the parity
   of its shingles with hash j, so the bits in which two sketches differ are at most
   the shingles in which the sets differ. No linked pair is lost, strangers are.
3. Of the candidates left, each node is verified with the nearest by sketch, by the
   exact intersection of both texts' shingles. A text is sent once, to its partner.
4. Candidates whose nodes the verified links do not connect yet are taken up again in
   rounds: the others of step 2, and the pairs of a signature that lie in different
   components, compared by sketch in blocks - never pairs within a component. A pair
   that shares many large signatures is made in the first of them only, the one of most
   nodes: a node's rows say in which it was before. A round verifies each node's
   nearest ones; the last round, when no link was found, all that are left. The
   components of all verified links are the classes.

Nodes are 64-bit fingerprints of sets of 64-bit shingle hashes; rows are known by
128 bits of id and text.

Defined cases: null texts and texts without words have empty sets and are linked
with nothing, not even each other; fewer words than a shingle make one shingle of
the whole sequence; documents with equal sets are linked; ids may be repeated or
null (component_id ignores nulls, and is null where all are); an empty table gives
no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import ctypes
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .staging import release, stage
from .textops import SQL_LOWER, fresh, mix64, slices, space_words, utf8

SHINGLE = 3
PERCENT = 90
BAND = 1.25
#: Nodes of a signature that are compared with as many others in one task.
BLOCK = 1024
#: Pairs compared at once; a cell of more than CELL pairs is compared by itself; rows of cells held at least.
PAIRS, CELL, ROWS = 1 << 18, 1 << 14, 1 << 15
#: Texts that one task's signatures come from, in bytes.
PART_BYTES = 16 << 20
#: Texts whose signatures are packed together, in bytes.
BATCH_BYTES = 24 << 20
#: Nodes of a batch that share a signature, from which on they are combined.
HOT = 16
#: Earlier signatures, of more than SMALL nodes, that a node's row names at most; a pair of others may be made more than once.
EARLIER, SMALL = 16, 16
#: Partners that meet at one place.
PLACE = 512
#: Bits of the filter for the rows whose texts are wanted: a key, a piece (of bitmap_construct_agg), at most.
KEY_BITS, PIECE_BITS, MOST_BITS = 16, 32_768, 1 << 28
#: Candidates of a node that a round verifies.
WIDTH = 2
#: Chance partners weigh as much as this many signatures.
CHANCE_WEIGHT = 100.0
#: How likely strangers are taken to share a shingle, for the costs alone.
SHARED = 1e-4
#: Allocations tried for a band: numbers of one-deletion segments, and spare exact segments by share.
STEPS, SPARE = 24, (0.05, 0.1, 0.2, 0.4)
#: Different words, and sets, that a task remembers.
MEMORY = 500_000

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_SALT = np.uint64(0xA5A5A5A5A5A5A5A5)


_Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _trim() -> None:
    """Gives free memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def _lean(task: _Task) -> _Task:
    """The task, holding no free memory after its end, as its worker lives on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        _trim()

    return run


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMORY:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: bytes, hashes: _Hashes, n: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles."""
    tokens = space_words(text)
    if not tokens:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, tokens), np.uint64, len(tokens))
    width = min(n, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for j in range(width):
        out = mix64(out * _GOLD + h[j : len(h) - width + 1 + j])
    return np.unique(out)


def most_different(percent: int, sizes: int) -> int:
    """In how many shingles two linked sets of ``sizes`` shingles together can differ."""
    return sizes - 2 * -(-percent * sizes // (100 + percent))


def _difference(percent: int, upper: int) -> int:
    """In how many shingles two linked sets of at most ``upper`` can differ."""
    return (100 - percent) * 2 * upper // (100 + percent)


def _chance(m0: int, m1: int, need: int, spare: int, mean: float, documents: int) -> float:
    """Strangers that a set is expected to meet."""
    if m0 + m1 <= 1:
        return 0.0
    bare = m0 * math.exp(-mean)  # empty exact segments of a set
    short = 0.0
    if need and bare > 0:
        short = 0.5 * math.erfc((spare + 0.5 - bare) / math.sqrt(2 * bare))
    exact = SHARED * m0 * (mean * math.exp(-mean)) ** 2
    deleted = m1 * ((1 + mean) * math.exp(-mean)) ** 2
    return documents * (short**2 + exact + deleted)


def plan_bands(percent: int, documents: int, largest: int):
    """For each band: (largest size, exact segments, one-deletion segments)."""
    bands, upper = [], 1
    while True:
        h = _difference(percent, upper)
        best = None
        for m1 in sorted({round((h + 2) // 2 * i / STEPS) for i in range(STEPS + 1)}):
            need = max(0, h + 1 - 2 * m1)
            spares = sorted({0, 1, 2, *(math.ceil(need * x) for x in SPARE)}) if need else [0]
            for spare in spares:
                m0 = need + spare
                m = m0 + m1
                chance = _chance(m0, m1, need, spare, upper / m / BAND, documents)
                cost = need + m1 * (1 + upper / m) + CHANCE_WEIGHT * chance
                if best is None or cost < best[0]:
                    best = (cost, m0, m1)
        bands.append((upper, best[1], best[2]))
        if upper >= largest:
            return bands
        upper = max(upper + 1, int(upper * BAND))


def signatures(s: np.ndarray, bands, percent: int) -> np.ndarray:
    """A set's signatures under its own band and all later ones that can hold partners."""
    own = int(np.searchsorted([b[0] for b in bands], len(s)))
    out = []
    spot, token = mix64(s ^ _SALT) >> np.uint64(32), mix64(s + _GOLD)
    for b in range(own, len(bands)):
        # a partner in band b has more shingles than the band before holds
        if b > own and len(s) * 100 < percent * (bands[b - 1][0] + 1):
            break
        upper, m0, m1 = bands[b]
        m = m0 + m1
        part = (spot * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        total = np.zeros(m, np.uint64)
        np.add.at(total, part, token)
        tag = (np.uint64(b) << np.uint64(32)) + np.arange(m, dtype=np.uint64)
        whole = mix64(total * _GOLD + mix64(tag))
        need = max(0, _difference(percent, upper) + 1 - 2 * m1)
        if need:
            size = np.bincount(part, minlength=m)[:m0]
            out.append(whole[:m0][size >= np.partition(size, m0 - need)[m0 - need]])
        out.append(whole[m0:])
        if m1:
            deletable = part >= m0
            p = part[deletable]
            out.append(mix64((total[p] - token[deletable]) * _GOLD + mix64(tag[p])))
    return np.unique(np.concatenate(out))


def fingerprint(s: np.ndarray) -> int:
    return int(np.bitwise_xor.reduce(mix64(s * _GOLD)).view(np.int64) ^ np.int64(len(s))) if len(s) else 0


def sketch(s: np.ndarray) -> bytes:
    """Parities of the shingles by hash: the least power of two of bits that is not below the set's size."""
    bits = max(64, 1 << (len(s) - 1).bit_length())
    spot = (mix64(s + _SALT) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(spot, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def sketch_distance(a: bytes, b: bytes) -> int:
    """At most in how many shingles the sets differ; the larger sketch is folded to the smaller one's size."""
    if len(a) < len(b):
        a, b = b, a
    x, size = int.from_bytes(a, "little"), len(a) * 8
    while size > len(b) * 8:
        size //= 2
        x = (x >> size) ^ (x & ((1 << size) - 1))
    return (x ^ int.from_bytes(b, "little")).bit_count()


def _distance(a: tuple[int, bytes], b: tuple[int, bytes], percent: int) -> int | None:
    """A lower bound of the shingles in which two sets, given by (size, sketch), differ; None if they cannot be linked."""
    if 100 * min(a[0], b[0]) < percent * max(a[0], b[0]):
        return None
    least = sketch_distance(a[1], b[1])
    return least if least <= most_different(percent, a[0] + b[0]) else None


# ---- signatures: packed, dealt by range, grouped ----

_REP = np.uint32(1 << 31)
_DOC, _BLOB, _SHARED = 0, 1, 2
_DEALT = "part int, kind int, doc_id long, k1 long, k2 long, n long, node long, body binary"


def pack(sig: np.ndarray, owner: np.ndarray, nodes: np.ndarray) -> bytes:
    """Sorted signatures and their owners (index of the node, high bit: stands for more) as bytes."""
    used, index = np.unique(owner & ~_REP, return_inverse=True)
    index = index.astype(np.uint32) | (owner & _REP)
    step = np.diff(sig, prepend=np.uint64(0))
    planes = [step.view(np.uint8).reshape(-1, 8).T.tobytes(), index.view(np.uint8).reshape(-1, 4).T.tobytes()]
    head = np.array([len(sig), len(used)], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(b"".join([head, nodes[used].tobytes(), *planes]))


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures, nodes, and whether the node stands for more."""
    raw = zstandard.ZstdDecompressor().decompress(data)
    n, m = np.frombuffer(raw, np.int64, 2)
    nodes = np.frombuffer(raw, np.int64, m, 16)
    at = 16 + 8 * int(m)
    step = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, at).reshape(8, -1).T).view(np.uint64).ravel()
    index = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n, at + 8 * int(n)).reshape(4, -1).T).view(np.uint32).ravel()
    return np.cumsum(step, dtype=np.uint64), nodes[index & ~_REP], (index & _REP) != 0


def _rows(columns: list[list], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    parts = [c.split() for c in schema.split(", ")]
    return pa.record_batch([pa.array(v, kinds[t]) for v, (_, t) in zip(columns, parts, strict=True)], names=[n for n, _ in parts])


def _groups(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    cut = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1], [True]])) if len(sig) else np.zeros(1, np.int64)
    return cut[:-1], np.diff(cut)


def _combine(sig: np.ndarray, owner: np.ndarray, nodes: np.ndarray):
    """Signatures of a batch in order; those of HOT nodes or more are left to their smallest node, and given apart.

    ``nodes`` are in order, and owners (their indices) too.
    """
    order = np.argsort(sig, kind="stable")
    sig, owner = sig[order], owner[order]
    del order
    start, length = _groups(sig)
    hot = length >= HOT
    if not hot.any():
        return sig, owner, []
    shared = [(sig[a], nodes[owner[a : a + n]]) for a, n in zip(start[hot], length[hot], strict=True)]
    keep = ~np.repeat(hot, length)
    first = start[hot]
    keep[first] = True
    owner[first] |= _REP
    return sig[keep], owner[keep], shared


def _extract(bands, percent: int, n: int, parts: int):
    def packed(held: list[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        held.sort(key=lambda x: x[0])
        numbers = np.array([node for node, _ in held], np.int64)
        owner = np.repeat(np.arange(len(held), dtype=np.uint32), [len(s) for _, s in held])
        sig = np.concatenate([s for _, s in held])
        held.clear()
        sig, owner, shared = _combine(sig, owner, numbers)
        part = ((sig >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        cut = np.searchsorted(part, np.arange(parts + 1))
        rows = [(p, _BLOB, pack(sig[a:b], owner[a:b], numbers)) for p, (a, b) in enumerate(zip(cut, cut[1:], strict=False)) if a < b]
        rows += [(int(s % np.uint64(parts)), _SHARED, np.concatenate([[s.view(np.int64)], m]).tobytes()) for s, m in shared]
        none = [None] * len(rows)
        yield _rows([[r[0] for r in rows], [r[1] for r in rows], none, none, none, none, none, [r[2] for r in rows]], _DEALT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        written: set[int] = set()
        held: list[tuple[int, np.ndarray]] = []
        size = turn = 0
        for whole in batches:
            for batch in slices(whole, 3, 4 << 20):
                texts = utf8(batch.column(3))
                sets = [shingle_set(t, hashes, n) for t in texts]
                nodes = [fingerprint(s) for s in sets]
                bodies: list[bytes | None] = []
                for s, node in zip(sets, nodes, strict=True):
                    if len(written) > MEMORY:
                        written.clear()
                    fresh_node = len(s) and node not in written
                    bodies.append(sketch(s) if fresh_node else None)
                    if fresh_node:
                        written.add(node)
                        held.append((node, signatures(s, bands, percent)))
                        size += 8 * len(s)
                places = [(turn + i) % parts for i in range(len(texts))]
                turn += len(texts)
                columns = [batch.column(j).to_pylist() for j in range(3)]
                yield _rows([places, [_DOC] * len(texts), *columns, [len(s) for s in sets], nodes, bodies], _DEALT)
                if size > BATCH_BYTES:
                    yield from packed(held)
                    size = 0
        hashes.clear()
        written.clear()
        if held:
            yield from packed(held)

    return run


_MARKED = "kind int, doc_id long, k1 long, k2 long, n long, node long, body binary"
_TIE, _MEMBER = 1, 2


def _group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents pass; of signatures, ties (n: node, node: the smallest), and the members of those with more than two nodes."""

    def out(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        none = [None] * len(a)
        return _rows([[kind] * len(a), none, none, none, a, b, none], _MARKED)

    def ties(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        pairs = np.unique(np.stack([a, b], 1)[a != b], axis=0)
        return out(_TIE, pairs[:, 0], pairs[:, 1])

    blobs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for batch in batches:
        kinds = batch.column("kind").to_numpy(zero_copy_only=False)
        own = pa.array(kinds == _DOC)
        docs = batch.filter(own).drop_columns(["part"])
        if docs.num_rows:
            yield docs
        for kind, body in zip(kinds, batch.column("body").to_pylist(), strict=True):
            if kind == _BLOB:
                blobs.append(unpack(body))
            elif kind == _SHARED:
                sig, *members = np.frombuffer(body, np.int64)
                members = np.array(members)
                yield ties(members, np.full(len(members), members[0]))
                yield out(_MEMBER, np.full(len(members), sig), members)
    if not blobs:
        return
    sig, node, rep = (np.concatenate([b[j] for b in blobs]) for j in range(3))
    del blobs
    order = np.argsort(sig, kind="stable")
    sig, node, rep = sig[order], node[order], rep[order]
    _, length = _groups(sig)
    many = np.repeat(length, length) > 1  # most signatures are one node's
    sig, node, rep = sig[many], node[many], rep[many]
    order = np.lexsort((~rep, node, sig))
    sig, node, rep = sig[order], node[order], rep[order]
    again = np.zeros(len(sig), bool)
    again[1:] = (sig[1:] == sig[:-1]) & (node[1:] == node[:-1])
    sig, node, rep = sig[~again], node[~again], rep[~again]
    start, length = _groups(sig)
    if not len(sig):
        return
    yield ties(node, np.repeat(node[start], length))
    open_ = (length > 2) | ((length > 1) & (np.add.reduceat(rep.astype(np.int64), start) > 0))
    keep = np.repeat(open_, length)
    yield out(_MEMBER, sig[keep].view(np.int64), node[keep])


# ---- candidates ----


_PAIR = "a long, b long, distance long"


def _thin(percent: int):
    """(a, b, least distance) of the pairs whose sketches do not rule a link out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb, sa, sb = (batch.column(j).to_pylist() for j in range(6))
            found = [_distance((x, s), (y, t), percent) for x, y, s, t in zip(na, nb, sa, sb, strict=True)]
            keep = [i for i, d in enumerate(found) if d is not None]
            yield _rows([[a[i] for i in keep], [b[i] for i in keep], [found[i] for i in keep]], _PAIR)

    return run


def _thinned(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb")
    return met.mapInArrow(_lean(_thin(percent)), _PAIR)


def _words(bodies: list[bytes]) -> np.ndarray:
    """Sketches of one length as rows of 64-bit words."""
    return np.frombuffer(b"".join(bodies), np.uint64).reshape(len(bodies), -1)


def _folded(x: np.ndarray, words: int) -> np.ndarray:
    while x.shape[1] > words:
        x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
    return x


def _fits(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(n, m) >= percent * np.maximum(n, m)


def _most(total: np.ndarray, percent: int) -> np.ndarray:
    """``most_different`` of arrays."""
    return total - 2 * -(-percent * total // (100 + percent))


class _Rows:
    """Rows of cells in order of their cells: cell, side, node, root, n, earlier signatures, and sketches by length."""

    def __init__(self, table: pa.Table, cell: np.ndarray):
        self.cell = cell
        self.side, self.node, self.root, self.n = (table.column(x).to_numpy() for x in ("side", "node", "root", "n"))
        bodies = table.column("sketch").to_pylist()
        length = np.array([len(x) for x in bodies], np.int64)
        self.words, self.spot = length // 8, np.zeros(len(bodies), np.int64)
        self.matrix = {}
        for w in np.unique(self.words).tolist():
            at = np.flatnonzero(self.words == w)
            self.spot[at] = np.arange(len(at))
            self.matrix[w] = _words([bodies[i] for i in at])
        self.listed = np.zeros(len(bodies), np.int64)
        if "before" in table.column_names:
            column = table.column("before").combine_chunks()
            self.listed = column.value_lengths().to_numpy()
            self.first = np.cumsum(self.listed) - self.listed
            codes, self.code = np.unique(column.flatten().to_numpy(), return_inverse=True)
            self.codes = len(codes)
            self.named = np.sort(np.repeat(np.arange(len(bodies)), self.listed) * self.codes + self.code)

    def made(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the pairs of rows share an earlier signature, where they are made."""
        out, long = np.zeros(len(a), bool), self.listed[a] > self.listed[b]
        a, b = np.where(long, b, a), np.where(long, a, b)
        both = np.flatnonzero(self.listed[a])
        if not len(both):
            return out
        for at in np.array_split(both, -(-int(self.listed[a[both]].sum()) // PAIRS)):
            n = self.listed[a[at]]
            entry = np.repeat(self.first[a[at]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            asked = np.repeat(b[at], n) * self.codes + self.code[entry]
            there = np.minimum(np.searchsorted(self.named, asked), len(self.named) - 1)
            out[np.repeat(at, n)[self.named[there] == asked]] = True
        return out

    def once(self, a: np.ndarray, b: np.ndarray, least: np.ndarray, both: bool) -> np.ndarray:
        """(cell, node, partner, distance) of the pairs of rows that are made here; ``both``: from the side of either minor."""
        keep = ~self.made(a, b)
        if not both:
            keep &= (self.side[b] != 2) | (self.node[a] > self.node[b])
        a, b = a[keep], b[keep]
        return np.stack([self.cell[a], self.node[a], self.node[b], least[keep]], 1)

    def near(self, a: np.ndarray, b: np.ndarray, percent: int, both: bool) -> np.ndarray:
        """(cell, node, partner, distance) of the pairs of rows that are left, for single pairs."""
        keep = (self.root[a] != self.root[b]) & (self.node[a] != self.node[b]) & _fits(self.n[a], self.n[b], percent)
        a, b = a[keep], b[keep]
        least = np.zeros(len(a), np.int64)
        kind = self.words[a] * (1 << 32) + self.words[b]
        for k in np.unique(kind).tolist():
            v, w = k >> 32, k & 0xFFFFFFFF
            x, y = _folded(self.matrix[v], min(v, w)), _folded(self.matrix[w], min(v, w))
            at = np.flatnonzero(kind == k)
            for part in np.array_split(at, -(-len(at) * min(v, w) // PAIRS)):
                least[part] = np.bitwise_count(x[self.spot[a[part]]] ^ y[self.spot[b[part]]]).sum(1, dtype=np.int64)
        keep = least <= _most(self.n[a] + self.n[b], percent)
        return self.once(a[keep], b[keep], least[keep], both)

    def blocks(self, a: np.ndarray, b: np.ndarray, percent: int, both: bool) -> Iterator[np.ndarray]:
        """The same for all rows ``a`` of a cell with all rows ``b``, in blocks of PAIRS."""
        for v in np.unique(self.words[a]).tolist():
            for w in np.unique(self.words[b]).tolist():
                p, q = a[self.words[a] == v], b[self.words[b] == w]
                p, q = p[np.argsort(self.n[p], kind="stable")], q[np.argsort(self.n[q], kind="stable")]
                size, size2 = self.n[p], self.n[q]
                words = min(v, w)
                x, y = _folded(self.matrix[v][self.spot[p]], words), _folded(self.matrix[w][self.spot[q]], words)
                at = 0
                while at < len(p):
                    lo = int(np.searchsorted(size2, -(-percent * size[at] // 100)))
                    # so many rows that the block stays small, whatever the partners' number
                    upto = at + max(1, PAIRS // max(1, int(np.searchsorted(size2, 100 * size[at] // percent, "right")) - lo))
                    upto = min(len(p), upto)
                    hi = int(np.searchsorted(size2, 100 * size[upto - 1] // percent, "right"))
                    for start in range(lo, hi, PAIRS):
                        rows, cols = slice(at, upto), slice(start, min(hi, start + PAIRS))
                        least = np.zeros((upto - at, cols.stop - start), np.int64)
                        for k in range(words):
                            least += np.bitwise_count(x[rows, k, None] ^ y[None, cols, k])
                        fit = least <= _most(size[rows, None] + size2[None, cols], percent)
                        fit &= _fits(size[rows, None], size2[None, cols], percent)
                        fit &= self.root[p][rows, None] != self.root[q][None, cols]
                        fit &= self.node[p][rows, None] != self.node[q][None, cols]
                        i, j = np.nonzero(fit)
                        yield self.once(p[at + i], q[start + j], least[i, j], both)
                    at = upto


def _nearest_rows(rows: np.ndarray, width: int | None) -> np.ndarray:
    """Of rows (cell, node, partner, distance) the ``width`` nearest of a node in its cell."""
    rows = np.unique(rows, axis=0)
    if width is None or not len(rows):
        return rows
    rows = rows[np.lexsort((rows[:, 2], rows[:, 3], rows[:, 1], rows[:, 0]))]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    start = np.flatnonzero(first)
    return rows[np.arange(len(rows)) - np.repeat(start, np.diff(start, append=len(rows))) < width]


def _cells(percent: int, width: int | None):
    """Pairs (larger node first) of different roots in the cells of a signature, whose sketches do not rule a link out.

    Of a node's partners in a cell the ``width`` nearest by sketch; None: all. A round
    that asks for a width is never the last one: ``forest`` goes on with None. Side 1
    has a signature's minor nodes, the others all of its nodes, 2 the minor ones.
    """
    both = width is not None

    def pairs(rows: np.ndarray) -> pa.RecordBatch:
        a, b, d = rows[:, 1], rows[:, 2], rows[:, 3]
        found = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b), d], 1), axis=0)
        return _rows([found[:, 0], found[:, 1], found[:, 2]], _PAIR)

    def compare(table: pa.Table, cell: np.ndarray) -> Iterator[pa.RecordBatch]:
        rows = _Rows(table, cell)
        many = int(cell[-1]) + 1
        minor, other = np.flatnonzero(rows.side == 1), np.flatnonzero(rows.side != 1)
        minors, others = (np.bincount(cell[x], minlength=many) for x in (minor, other))
        meet = minors * others
        first, first_minor = np.cumsum(others) - others, np.cumsum(minors) - minors
        for c in np.flatnonzero(meet > CELL).tolist():
            found = rows.blocks(minor[first_minor[c] : first_minor[c] + minors[c]], other[first[c] : first[c] + others[c]], percent, both)
            held = [_nearest_rows(x, width) for x in found]
            if held:
                yield pairs(_nearest_rows(np.concatenate(held), width))
        small = minor[(meet <= CELL)[cell[minor]]]
        count = others[cell[small]]
        turn = (np.cumsum(count) - count) // PAIRS  # minors whose pairs are made together; a cell may be cut
        turn = np.maximum.reduceat(turn, np.flatnonzero(np.diff(cell[small], prepend=-1)))[np.cumsum(np.diff(cell[small], prepend=-1) != 0) - 1] if len(small) else turn
        for t in np.unique(turn).tolist():
            at, n = small[turn == t], count[turn == t]
            a = np.repeat(at, n)
            b = other[np.repeat(first[cell[at]] - np.cumsum(n) + n, n) + np.arange(len(a))]
            yield pairs(_nearest_rows(rows.near(a, b, percent, both), width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def cells(rest: bool) -> Iterator[pa.RecordBatch]:
            """Compares the cells held that are known to be whole; the others stay."""
            nonlocal held, size
            table = pa.Table.from_batches(held).combine_chunks()
            keys = np.stack([table.column(x).to_numpy() for x in ("sig", "i", "j")], 1)
            cell = np.concatenate([[0], np.cumsum((keys[1:] != keys[:-1]).any(1))])
            end = len(cell) if rest else int(np.searchsorted(cell, cell[-1]))
            if end:
                yield from compare(table.slice(0, end), cell[:end])
            held, size = table.slice(end).to_batches(), len(cell) - end

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= ROWS:
                yield from cells(False)
        if size:
            yield from cells(True)

    return run


def _across(members: DataFrame, nodes: DataFrame, roots: DataFrame, percent: int, block: int, width: int | None) -> DataFrame:
    """Candidates within signatures, between nodes of different roots.

    The nodes of a signature that are not of its most frequent root meet all of its
    nodes, in cells of ``block`` by ``block``; those of that root never meet each other.
    Two nodes of different roots are made a pair in the first signature that both have,
    in order of size, the largest first: what they have before it is not in common.
    Signatures of up to SMALL nodes make few pairs, and are not compared for that.
    """
    known = members.join(roots, "node")
    counts = known.groupBy("sig", "root").agg(F.count("*").alias("c"))
    several = [F.sum("c").alias("g"), F.max("c").alias("top"), F.max_by("root", "c").alias("main"), F.count("*").alias("roots")]
    ni, nj = F.ceil(F.col("g") / block), F.ceil((F.col("g") - F.col("top")) / block)
    turn = F.struct((-F.col("g")).alias("less"), "sig")
    groups = counts.groupBy("sig").agg(*several).where("roots > 1").select("sig", "main", "g", ni.alias("ni"), nj.alias("nj"), turn.alias("turn"))
    turns = F.slice(F.sort_array(F.collect_set("turn")), 1, EARLIER).alias("turns")
    large = known.join(groups.where(F.col("g") > SMALL).select("sig", "turn"), "sig").groupBy("node").agg(turns)
    wanted = known.join(groups.drop("g"), "sig").join(nodes, "node").join(large, "node", "left")
    before = F.filter("turns", lambda x: x < F.col("turn")).getField("sig")
    wanted = wanted.withColumn("before", F.coalesce(before, F.array().cast("array<bigint>")))
    spot = lambda seed, wide: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(wide))
    upto = lambda wide: F.sequence(F.lit(0).cast("long"), F.col(wide) - 1)
    cell = lambda side, i, j: F.struct(side.alias("side"), i.alias("i"), j.alias("j"))
    other = F.when(F.col("root") == F.col("main"), 0).otherwise(2)
    rows = F.transform(upto("nj"), lambda j: cell(other, spot(1, "ni"), j))
    minors = F.when(F.col("root") != F.col("main"), F.transform(upto("ni"), lambda i: cell(F.lit(1), i, spot(2, "nj"))))
    nothing = F.array().cast("array<struct<side:int,i:bigint,j:bigint>>")
    dealt = wanted.select("sig", "node", "root", "n", "sketch", "before", F.explode(F.concat(rows, F.coalesce(minors, nothing))).alias("at"))
    dealt = dealt.select("sig", "at.i", "at.j", "at.side", "node", "root", "n", "sketch", "before")
    met = dealt.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j")
    return met.mapInArrow(_lean(_cells(percent, width)), _PAIR)


def _nearest(pairs: DataFrame, width: int) -> DataFrame:
    """Of the pairs of every node, on either side, the ``width`` nearest."""
    both = [F.struct(F.col(x).alias("own"), "a", "b", "distance") for x in ("a", "b")]
    rank = F.row_number().over(Window.partitionBy("own").orderBy("distance", "a", "b"))
    return pairs.select(F.inline(F.array(*both))).withColumn("r", rank).where(F.col("r") <= width).select("a", "b", "distance").distinct()


# ---- verification ----

_LINK = "a long, b long, shared long, either long"


def _verify(percent: int, n: int):
    """Rows (place, salt, order, node, text), sorted: a place's own text (order 0) comes before its visitors'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        place = host = last = None
        for whole in batches:
            for batch in slices(whole, 4, 4 << 20):
                found = []
                columns = [batch.column(j).to_pylist() for j in range(4)]
                for hub, salt, order, node, text in zip(*columns, utf8(batch.column(4)), strict=True):
                    if (hub, salt, node) == last:  # rows equal in id and text
                        continue
                    last = (hub, salt, node)
                    own = shingle_set(text, hashes, n)
                    if order == 0:
                        place, host = (hub, salt), own
                        continue
                    if place != (hub, salt):
                        raise RuntimeError("a visitor without its host")
                    small, large = (own, host) if len(own) < len(host) else (host, own)
                    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                    shared = int((large[at] == small).sum())
                    either = len(own) + len(host) - shared
                    if 100 * shared >= percent * either:
                        found.append((node, hub, shared, either))
                yield _rows([[f[j] for f in found] for j in range(4)], _LINK)

    return run


def _only(rows: DataFrame, keys: DataFrame, many: int) -> DataFrame:
    """Rows (k1, ...) whose k1 may be among the ``many`` keys: none of those is lost, of others few pass.

    A bitmap of KEY_BITS bits a key, at most MOST_BITS in all, is broadcast in pieces,
    so that the rows of other keys are dropped before a join moves them.
    """
    bits = min(MOST_BITS, max(PIECE_BITS, KEY_BITS * many))
    spot = F.pmod(F.xxhash64(F.lit(3), "k1"), F.lit(bits))
    piece, at = F.floor(spot / PIECE_BITS).alias("piece"), (spot % PIECE_BITS).alias("at")
    built = keys.select(piece, at).groupBy("piece").agg(F.bitmap_construct_agg("at").alias("bitmap"))
    told = rows.select("*", piece, at).join(F.broadcast(built), "piece")
    byte = "cast(conv(hex(substring(bitmap, cast(at div 8 as int) + 1, 1)), 16, 10) as int)"
    return told.where(F.expr(f"shiftright({byte}, cast(at % 8 as int)) & 1 = 1")).select(*rows.columns)


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, percent: int, shingle: int) -> DataFrame:
    """The links among (a, b): a's text visits b's; a host of many visitors has places for PLACE of them each."""
    hosts = pairs.groupBy("b").agg(F.ceil(F.count("*") / PLACE).alias("salts"))
    visits = pairs.join(hosts, "b").select(F.col("a").alias("node"), F.col("b").alias("hub"), F.pmod(F.xxhash64("a"), F.col("salts")).alias("salt"), F.lit(1).alias("turn"))
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))
    stays = hosts.select(F.col("b").alias("node"), F.col("b").alias("hub"), salts.alias("salt"), F.lit(0).alias("turn"))
    wanted = visits.unionByName(stays).join(nodes.select("node", "k1", "k2"), "node")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    asked = _only(texts, nodes.select("node", "k1").join(ends, "node"), 2 * pairs.count())
    carried = asked.join(wanted, ["k1", "k2"]).select("hub", "salt", "turn", "node", "text")
    met = carried.repartition("hub", "salt")
    return met.sortWithinPartitions("hub", "salt", "turn", "node").mapInArrow(_lean(_verify(percent, shingle)), _LINK)


# ---- the join ----


class _Join:
    """Documents (doc_id, k1, k2, n, node), nodes (node, k1, k2, n, sketch), thinned ties and the members of signatures."""

    def __init__(self, docs: DataFrame, percent: int, shingle: int, block: int, id_col: str, text_col: str):
        self.percent, self.shingle, self.block = percent, shingle, block
        base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        rows = base.select("doc_id", *row_key("doc_id", "text"), "text")
        sizes = rows.agg(F.count("*"), F.coalesce(F.max(F.octet_length("text")), F.lit(0)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)))
        total, longest, size = sizes.first()
        bands = plan_bands(percent, total, longest // 2 + 1)
        parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
        dealt = rows.mapInArrow(_lean(_extract(bands, percent, shingle, parts)), _DEALT).repartitionById(parts, F.col("part"))
        marked = stage(dealt.mapInArrow(_lean(_group), _MARKED), "marked")
        self.texts = rows.select("k1", "k2", "text")
        self.docs = marked.where(F.col("kind") == _DOC).select("doc_id", "k1", "k2", F.col("n").alias("n_shingles"), "node")
        self.members = marked.where(F.col("kind") == _MEMBER).select(F.col("n").alias("sig"), "node")
        one = F.min(F.struct("k1", "k2")).alias("k")
        nodes = marked.where((F.col("kind") == _DOC) & (F.col("n") > 0)).groupBy("node").agg(one, F.max("n").alias("n"), F.max("body").alias("sketch"))
        self.nodes = stage(nodes.select("node", "k.k1", "k.k2", "n", "sketch"), "nodes")
        ties = marked.where(F.col("kind") == _TIE).select(F.col("n").alias("a"), F.col("node").alias("b")).distinct()
        self.ties = stage(_thinned(ties, self.sketches, percent), "ties")
        release(docs.sparkSession)

    @property
    def sketches(self) -> DataFrame:
        return self.nodes.select("node", "n", "sketch")

    def verified(self, pairs: DataFrame) -> DataFrame:
        return stage(_verified(pairs, self.nodes, self.texts, self.percent, self.shingle), "links")

    def candidates(self, roots: DataFrame, width: int | None) -> DataFrame:
        """a, b, distance: what the sketches leave between nodes of different roots."""
        of = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}"))
        apart = self.ties.join(of("a"), "a").join(of("b"), "b").where("ra <> rb").select("a", "b", "distance")
        return apart.unionByName(_across(self.members, self.sketches, roots, self.percent, self.block, width)).distinct()

    def forest(self) -> DataFrame:
        """node, root for every node with words: links enough to connect what is linked.

        Every round verifies, for each node, its nearest candidates of other components,
        and joins the components that links connect, so that of a group of near copies
        about as many pairs are verified as it has nodes. When a round finds no link,
        all candidates that are left are verified.
        """
        nearest = F.min(F.struct("distance", "b")).alias("x")
        tried = stage(self.ties.groupBy("a").agg(nearest).select("a", F.col("x.b").alias("b")), "tried")
        found = components(self.verified(tried).select("a", "b"))
        roots = stage(self._over(self.nodes.select("node", F.col("node").alias("root")), found), "roots")
        width: int | None = WIDTH
        while True:
            left = self.candidates(roots, width).join(tried, ["a", "b"], "left_anti")
            pairs = stage((_nearest(left, width) if width else left).select("a", "b"), "tried")
            if pairs.isEmpty():
                if width is None:
                    break
                width = None  # the nearest were tried, further ones were not
                continue
            links = self.verified(pairs)
            of = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}"))  # noqa: B023, E731
            joins = links.join(of("a"), "a").join(of("b"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
            found = components(joins)
            if width is None:
                return self._over(roots, found)
            if found.isEmpty():
                width = None
            else:
                roots = stage(self._over(roots, found), "roots")
            tried = tried.unionByName(pairs)
            release(self.docs.sparkSession)
        return roots

    @staticmethod
    def _over(roots: DataFrame, found: DataFrame) -> DataFrame:
        """Roots after some of them have got roots themselves."""
        later = found.select(F.col("node").alias("root"), F.col("root").alias("later"))
        return roots.join(later, "root", "left").select("node", F.coalesce("later", "root").alias("root"))

    def links(self) -> DataFrame:
        """Every link between nodes."""
        alone = self.nodes.select("node", F.col("node").alias("root"))
        return self.verified(stage(self.candidates(alone, None).select("a", "b").distinct(), "pairs"))


def _join(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> _Join:
    if not 1 <= percent <= 100:
        raise ValueError("percent must be from 1 to 100")
    return _Join(docs, percent, shingle, block, id_col, text_col)


def jaccard_components(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id."""
    join = _join(docs, **options)
    ids = join.docs.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("low")).join(join.forest(), "node")
    lowest = ids.groupBy("root").agg(F.min("low").alias("component_id"))
    named = ids.join(lowest, "root").select("node", "component_id")
    with_words = join.docs.where("n_shingles > 0").join(named, "node").select("doc_id", "n_shingles", "component_id")
    alone = join.docs.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return with_words.unionByName(alone)


def jaccard_links(docs: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """The links themselves: (pairs of linked nodes: a, b, similarity; documents: doc_id, n_shingles, node, n_links).

    A node stands for all documents of one set of shingles, so copies make no pairs.
    n_links counts the other documents that a document is linked with: those of its
    own node and of the nodes linked with it. Documents without words have no node.
    """
    join = _join(docs, **options)
    found = join.links()
    pairs = stage(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("shared") / F.col("either")).alias("similarity")), "pairs")
    held = join.docs.where("n_shingles > 0").groupBy("node").agg(F.count("*").alias("held"))
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    beside = both.join(held.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("held").alias("beside"))
    counted = held.join(beside, "node", "left").select("node", (F.col("held") - 1 + F.coalesce("beside", F.lit(0))).alias("n_links"))
    rows = join.docs.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("node")).alias("node"))
    return pairs, rows.join(counted, "node", "left").select("doc_id", "n_shingles", "node", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each group, and all without words, with all their columns.

    The one of the smallest id stays, nulls last; of rows equal in id, the first by
    a hash of the text; of rows equal in id and text, any one.
    """
    join = _join(docs, id_col=id_col, text_col=text_col, **options)
    # a group is known by its root: ids may be null, or shared by documents of other groups
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")).alias("first")
    with_words = join.docs.where("n_shingles > 0").select("doc_id", "k1", "k2", "node")
    chosen = with_words.join(join.forest(), "node").groupBy("root").agg(first)
    k1, k2, alone, row = fresh(docs, "k1", "k2", "alone", "row")
    empty = join.docs.where("n_shingles = 0").select(F.col("k1").alias(k1), F.col("k2").alias(k2)).distinct().withColumn(alone, F.lit(True))
    kept = chosen.select(F.col("first.k1").alias(k1), F.col("first.k2").alias(k2), F.lit(False).alias(alone))
    a, b = row_key(id_col, text_col)
    keyed = docs.withColumns({k1: a, k2: b}).join(empty.unionByName(kept), [k1, k2])
    # rows equal in id and text: one a group, and such rows are counted, not gathered
    several = keyed.where(~F.col(alone)).groupBy(k1, k2).agg(F.count("*").alias(row)).where(F.col(row) > 1)
    plain = keyed.join(several.select(k1, k2), [k1, k2], "left_anti")
    repeated = keyed.join(several.select(k1, k2), [k1, k2], "left_semi").dropDuplicates([k1, k2])
    return plain.unionByName(repeated).select(*[F.col(f"`{c}`") for c in docs.columns])


def row_key(id_col: str, text_col: str) -> list:
    """k1, k2: 128 bits that know a row by its id and text."""
    of = lambda seed: F.xxhash64(F.lit(seed), F.col(id_col).cast("long"), F.col(text_col))
    return [of(1).alias("k1"), of(2).alias("k2")]


def op6_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP6_SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({SQL_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT rid, doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: array_to_string(w[i : i + 2], ' '))) AS s FROM d WHERE len(w) > 0),
x AS (SELECT rid, unnest(s) AS t FROM g),
n AS (SELECT rid, doc_id, len(s) AS n FROM g),
o AS (SELECT a.rid AS r1, b.rid AS r2, count(*) AS shared FROM x a JOIN x b ON a.t = b.t AND a.rid < b.rid GROUP BY ALL),
e AS (SELECT r1, r2 FROM o JOIN n p ON p.rid = r1 JOIN n q ON q.rid = r2 WHERE 100 * shared >= {PERCENT} * (p.n + q.n - shared)),
u AS (SELECT r1 AS a, r2 AS b FROM e UNION SELECT r2, r1 FROM e),
reach(a, b) AS (SELECT rid, rid FROM n UNION SELECT reach.a, u.b FROM reach JOIN u ON reach.b = u.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CASE WHEN n.n IS NULL THEN d.doc_id ELSE m.low END AS component_id
FROM d LEFT JOIN n USING (rid) LEFT JOIN (SELECT a AS rid, min(doc_id) AS low FROM reach JOIN n ON n.rid = reach.b GROUP BY a) m USING (rid)
"""
