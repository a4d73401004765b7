"""Benchmark decontamination with a distributed positional inverted index.

1. The training texts are tokenised once. Documents are laid end to end into ranges
   of about RANGE_WORDS words, and for every range the postings of all its tokens are
   stored in the shared folder, columnar: token hashes in order, how often each
   occurs, and the places of each, sorted by token. A posting list is cut by document
   ranges, so the list of a frequent token is never gathered, and the index knows
   nothing of the test set: any number of look-ups may follow.
2. The test windows - ``window`` consecutive words of an item, or all of a shorter one,
   each different one once - are looked up in every range. The lists of their tokens
   are cut out by binary search; windows that lack a token are done. For the others,
   the list of the token that is rarest in the range, less its offset in the window,
   gives the candidate starts, and these are intersected with the offset-adjusted
   lists of the other tokens, from rare to frequent. What is left after the last
   token are exact phrase matches. Candidates are unfolded so many at a time, so the
   memory does not grow with the product of windows and list lengths.
3. ``proximity`` intersects the same lists for places from which all tokens of a set
   stand within a span.

The test set is small by nature, but its size is checked: above ``most_words`` words
it is cut into blocks that are looked up one after another against the same index, so
what goes to the tasks is bounded whatever its size.

Defined cases: null texts have no words; items without words or with a null text
have no windows; items with a null id mark words but are not listed; repeated item
ids count once; ids of documents may be null or repeated (each row is judged for
itself); empty tables give no rows, or no hits; other columns are ignored, whatever
their names. Tokens are known by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import stage
from .textops import SQL_LOWER, WORD_RE, fresh, slices, utf8, words

WINDOW = 10
#: Words of a document range; a longer document is a range of its own.
RANGE_WORDS = 1 << 16
#: Words of test items that one pass looks up: their windows take some tens of MB.
MOST_WORDS = 400_000
#: Candidate starts that are unfolded at a time.
CANDIDATES = 1 << 20
#: Different words that a task remembers.
MEMORY = 500_000

_INDEX = (
    "shard string, doc_ids array<long>, k1 array<long>, k2 array<long>, n_words array<long>, "
    "tokens binary, counts binary, places binary"
)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMORY:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _place_type(n: int) -> type:
    return np.uint16 if n <= 1 << 16 else np.uint32


def _postings(hashes: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Tokens in order, their counts, and the places of each."""
    order = np.argsort(hashes, kind="stable")
    tokens, counts = np.unique(hashes, return_counts=True)
    return tokens.tobytes(), counts.astype(np.int32).tobytes(), order.astype(_place_type(len(hashes))).tobytes()


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memory = _Hashes()
    held: list[tuple] = []
    size = 0
    lists, blobs = pa.list_(pa.int64()), pa.binary()

    def flush() -> pa.RecordBatch:
        tokens = np.concatenate([h for *_, h in held])
        columns = [[uuid.uuid4().hex], *[[[x[j] for x in held]] for j in range(3)], [[len(h) for *_, h in held]], *[[b] for b in _postings(tokens)]]
        types = [pa.string(), lists, lists, lists, lists, blobs, blobs, blobs]
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in _INDEX.split(", ")])

    for whole in batches:
        for batch in slices(whole, 3, 8 << 20):
            ids = [batch.column(j).to_pylist() for j in range(3)]
            for doc_id, k1, k2, text in zip(*ids, utf8(batch.column(3)), strict=True):
                found = words(text)
                if held and size + len(found) > RANGE_WORDS:
                    yield flush()
                    held, size = [], 0
                held.append((doc_id, k1, k2, np.fromiter(map(memory.__getitem__, found), np.uint64, len(found))))
                size += len(found)
    if held:
        yield flush()


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index: a row per document range with its documents and the postings of all their tokens."""
    keys = [F.xxhash64(F.lit(seed), F.col(id_col).cast("long"), F.col(text_col)).alias(f"k{seed}") for seed in (1, 2)]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *keys, F.col(text_col).alias("text"))
    # small row groups: a reader holds one at a time
    return stage(rows.mapInArrow(_index, _INDEX), "postings", {"parquet.block.size": 16 << 20, "compression": "zstd"})


class _Range:
    """A document range of the index, opened for look-ups."""

    def __init__(self, row: dict):
        self.shard, self.n_words = row["shard"], np.array(row["n_words"], dtype=np.int64)
        self.documents = list(zip(row["doc_ids"], row["k1"], row["k2"], strict=True))
        self.first = np.cumsum(self.n_words) - self.n_words
        self.total = int(self.n_words.sum())
        self.tokens = np.frombuffer(row["tokens"], np.uint64)
        self.counts = np.frombuffer(row["counts"], np.int32).astype(np.int64)
        self.places = np.frombuffer(row["places"], _place_type(self.total))
        self.starts = np.cumsum(self.counts) - self.counts

    def lists(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The postings of some tokens (in order): keys number << 40 | place, and how many each token has."""
        if not len(self.tokens):
            return np.empty(0, np.int64), np.zeros(len(wanted), np.int64)
        at = np.minimum(np.searchsorted(self.tokens, wanted), len(self.tokens) - 1)
        n = np.where(self.tokens[at] == wanted, self.counts[at], 0)
        number = np.repeat(np.arange(len(wanted)), n)
        entry = np.arange(len(number)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.starts[at], n)
        return (number << 40) | self.places[entry].astype(np.int64), n

    def owner(self, place: np.ndarray) -> np.ndarray:
        """The document that holds each place."""
        return np.searchsorted(self.first + self.n_words, place, side="right")


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[_Range]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield _Range(batch.slice(i, 1).to_pylist()[0])


def phrase_matches(key: np.ndarray, n: np.ndarray, windows: np.ndarray, candidates: int = CANDIDATES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(window, place) of every exact occurrence; windows are rows of token numbers, -1 beyond a short one's end.

    key and n: the tokens' postings as ``_Range.lists`` gives them.
    """
    begin = np.cumsum(n) - n
    here = np.flatnonzero(((windows < 0) | (n[np.maximum(windows, 0)] > 0)).all(1))
    if not len(here):
        return
    rows = windows[here]
    often = np.where(rows >= 0, n[np.maximum(rows, 0)], np.iinfo(np.int64).max)
    order = np.argsort(often, axis=1, kind="stable")  # from rare to frequent, what is beyond the end last
    rare = rows[np.arange(len(rows)), order[:, 0]]
    upto = np.cumsum(n[rare])
    total = int(upto[-1])
    for low in range(0, total, candidates):
        # candidates low to high: entries of the windows' rarest lists, laid end to end
        flat = np.arange(low, min(low + candidates, total))
        window = np.searchsorted(upto, flat, side="right")
        entry = flat - (upto[window] - n[rare[window]]) + begin[rare[window]]
        start = (key[entry] & ((1 << 40) - 1)) - order[window, 0]
        keep = start >= 0
        window, start = window[keep], start[keep]
        for j in range(1, rows.shape[1]):
            if not len(window):
                break
            offset = order[window, j]
            token = rows[window, offset]
            wanted = (token << 40) | (start + offset)
            at = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
            keep = (token < 0) | (key[at] == wanted)
            window, start = window[keep], start[keep]
        if len(window):
            yield here[window], start


def windows_of(items: list[tuple], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different windows as rows of token numbers, the tokens, and pairs of (window, item)."""
    rows, owner = [], []
    memory = _Hashes()
    for i, (_, text) in enumerate(items):
        found = [memory[w] for w in words((text or "").encode())]
        for a in range(max(1, len(found) - window + 1) if found else 0):
            part = found[a : a + window]
            rows.append(part + [0] * (window - len(part)) + [len(part)])
            owner.append(i)
    if not rows:
        return np.empty((0, window), np.int64), np.empty(0, np.uint64), np.empty((0, 2), np.int64)
    kinds, which = np.unique(np.array(rows, dtype=np.uint64), axis=0, return_inverse=True)
    inside = np.arange(window) < kinds[:, -1:].astype(np.int64)
    tokens = np.unique(kinds[:, :-1][inside])
    numbers = np.where(inside, np.searchsorted(tokens, kinds[:, :-1]), -1)
    return numbers.astype(np.int64), tokens, np.unique(np.stack([which.ravel(), np.array(owner)], 1), axis=0)


_HITS = "shard string, at int, doc_id long, k1 long, k2 long, n_words long, mask binary, items array<string>"


def _lookup(windows: np.ndarray, tokens: np.ndarray, owners: np.ndarray, names: list[str | None]):
    lengths = (windows >= 0).sum(1)
    first_owner = np.searchsorted(owners[:, 0], np.arange(len(windows) + 1))

    def one(own: _Range) -> list[tuple]:
        edge = np.zeros(own.total + 1, np.int32)
        pairs: set[tuple[int, int]] = set()
        for window, start in phrase_matches(*own.lists(tokens), windows):
            stop = start + lengths[window]
            doc = own.owner(start)
            inside = (doc < len(own.first)) & (doc == own.owner(stop - 1))
            window, start, stop, doc = window[inside], start[inside], stop[inside], doc[inside]
            np.add.at(edge, start, 1)
            np.add.at(edge, stop, -1)
            for w, d in np.unique(np.stack([window, doc], 1), axis=0):
                pairs.update((int(d), int(i)) for i in owners[first_owner[w] : first_owner[w + 1], 1])
        hit = np.cumsum(edge[:-1]) > 0
        found: dict[int, list[str]] = {}
        for d, i in sorted(pairs):
            found.setdefault(d, []).extend([names[i]] if names[i] is not None else [])
        out = []
        for d, (document, a, n) in enumerate(zip(own.documents, own.first, own.n_words, strict=True)):
            mask = np.packbits(hit[a : a + n]).tobytes() if d in found else None
            out.append((own.shard, d, *document, int(n), mask, found.get(d)))
        return out

    types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _open(batches):
            columns = zip(*one(own), strict=True)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in _HITS.split(", ")])

    return run


_RESULT = "doc_id long, k1 long, k2 long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>"


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for n, masks, items in zip(*(batch.column(x).to_pylist() for x in ("n_words", "masks", "items")), strict=True):
            bits = np.zeros((n + 7) // 8, np.uint8)
            for m in masks:
                if m:
                    bits |= np.frombuffer(m, np.uint8)
            n_hit = int(np.unpackbits(bits)[:n].sum())
            found = sorted({i for x in items for i in x or ()})
            rows.append((n, n_hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), n_hit > 0, found))
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.string())]
        ids = [batch.column(x) for x in ("doc_id", "k1", "k2")]
        yield pa.record_batch([*ids, *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names=[x.split()[0] for x in _RESULT.split(", ")])


def _single(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Hits of the only block, in the shape of merged ones."""
    masks = pa.array([[x] for x in batch.column("mask").to_pylist()], pa.list_(pa.binary()))
    items = pa.array([[x] for x in batch.column("items").to_pylist()], pa.list_(pa.list_(pa.string())))
    names = ["doc_id", "k1", "k2", "n_words"]
    return pa.record_batch([*[batch.column(n) for n in names], masks, items], names=[*names, "masks", "items"])


def look_up(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_words: int = MOST_WORDS, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Per document of an index: doc_id, k1, k2 (of its id and text), n_words, n_hit, n_items, items_sha256, contaminated, items."""
    tests = benchmark.select(F.col(item_col).cast("string").alias("item"), F.coalesce(text_col, F.lit("")).alias("text"))
    pieces = F.split("text", "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
    total = tests.agg(F.coalesce(F.sum(F.size(pieces)), F.lit(0))).first()[0]
    blocks = max(1, -(-int(total) // most_words))
    parts: list[DataFrame] = []
    for b in range(blocks):
        own = tests if blocks == 1 else tests.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        items = [(r["item"], r["text"]) for r in own.collect()]  # about most_words words, by the blocks
        look = _lookup(*windows_of(items, window), [i for i, _ in items])
        if blocks == 1:
            return index.mapInArrow(lambda batches, look=look: _finish(map(_single, look(batches))), _RESULT)
        parts.append(stage(index.mapInArrow(look, _HITS), "hits"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    same = [F.first(c).alias(c) for c in ("doc_id", "k1", "k2", "n_words")]
    merged = every.groupBy("shard", "at").agg(*same, F.collect_list("mask").alias("masks"), F.collect_list("items").alias("items"))
    return merged.select("doc_id", "k1", "k2", "n_words", "masks", "items").mapInArrow(_finish, _RESULT)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_words: int = MOST_WORDS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items."""
    found = look_up(build_index(docs, id_col, text_col), benchmark, window, most_words, item_col)
    return found.drop("k1", "k2")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that hold no window of a test item, with all their columns; each row is judged for itself."""
    found = look_up(build_index(docs, id_col, text_col), benchmark, **options)
    # staged, so that its size is known when the join is planned
    bad = stage(found.where("contaminated").select("k1", "k2").distinct(), "contaminated")
    k1, k2 = fresh(docs, "k1", "k2")
    key = lambda seed: F.xxhash64(F.lit(seed), F.col(id_col).cast("long"), F.col(text_col))
    keyed = docs.withColumns({k1: key(1), k2: key(2)})
    gone = bad.select(F.col("k1").alias(k1), F.col("k2").alias(k2))
    return keyed.join(gone, [k1, k2], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def proximity(docs: DataFrame, terms: list[str], span: int, id_col: str = "doc_id", text_col: str = "text", index: DataFrame | None = None) -> DataFrame:
    """doc_id and start of every place of a term from which all of the terms stand within ``span`` words.

    By the index of all postings (built here, unless one is given), from the rarest
    term's list to the most frequent one's. Without terms there are no places.
    """
    wanted = np.array(sorted({xxhash.xxh3_64_intdigest(w) for t in terms for w in words(t.encode())}), dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _open(batches):
            key, n = own.lists(wanted)
            if not len(wanted) or not n.all():
                continue
            cut = np.cumsum(n) - n
            lists = [key[a : a + m] & ((1 << 40) - 1) for a, m in zip(cut, n, strict=True)]
            place = np.sort(np.concatenate(lists))
            doc = own.owner(place)
            stop = np.minimum(place + span, (own.first + own.n_words)[doc])
            for one in sorted(lists, key=len):
                i = np.searchsorted(one, place)
                good = (i < len(one)) & (one[np.minimum(i, len(one) - 1)] < stop)
                place, doc, stop = place[good], doc[good], stop[good]
            ids = [own.documents[d][0] for d in doc]
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(place - own.first[doc], pa.int64())], names=["doc_id", "start"])

    return (index if index is not None else build_index(docs, id_col, text_col)).mapInArrow(run, "doc_id long, start long")


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return decontaminate(docs, items).drop("items")


def windows_sql(table: str = "documents", window: int = WINDOW) -> str:
    """CTEs that end in hit_doc(rid, n_words, n_hit, ids) for the rows of a table with rid and text."""
    return f"""hit_w AS (SELECT rid, regexp_extract_all({SQL_LOWER}, '{WORD_RE}') AS w FROM {table}),
hit_b AS (SELECT row_number() OVER () AS bid, item_id, regexp_extract_all({SQL_LOWER}, '{WORD_RE}') AS w FROM benchmark),
hit_g AS (
  SELECT DISTINCT item_id, least(len(w), {window}) AS n, array_to_string(w[i : i + least(len(w), {window}) - 1], ' ') AS gram
  FROM (SELECT *, unnest(range(1, greatest(len(w) - {window} + 1, 1) + 1)) AS i FROM hit_b WHERE len(w) > 0)
), hit_n AS (SELECT DISTINCT n FROM hit_g),
hit_d AS (
  SELECT rid, i, n, array_to_string(w[i : i + n - 1], ' ') AS gram
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM hit_w, hit_n WHERE len(w) >= n)
), hit_m AS (SELECT rid, i, d.n, item_id FROM hit_d d JOIN hit_g g ON d.gram = g.gram AND d.n = g.n),
hit_p AS (SELECT rid, count(*) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT rid, i, n FROM hit_m)) GROUP BY rid),
hit_i AS (SELECT rid, list_sort(list(DISTINCT CAST(item_id AS VARCHAR)) FILTER (item_id IS NOT NULL)) AS ids FROM hit_m GROUP BY rid),
hit_doc AS (SELECT rid, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(ids, []) AS ids FROM hit_w LEFT JOIN hit_p USING (rid) LEFT JOIN hit_i USING (rid))"""


OP5_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
{windows_sql("d")}
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_hit AS BIGINT) AS n_hit, CAST(len(ids) AS BIGINT) AS n_items,
  sha256(array_to_string(ids, ',')) AS items_sha256, n_hit > 0 AS contaminated
FROM d JOIN hit_doc USING (rid)
"""
