"""Quality classification by histogram gradient-boosted trees.

Document statistics (lengths, character classes, repetition, spread of words and
bytes) are quantised into histogram bins; trees are grown level by level on
gradient and hessian histograms of the logistic loss. The trees are flattened into
arrays - feature, threshold, left child, value - and a batch is scored by moving
all its rows down one level at a time.

Training: labelled rows whose crc32(doc_id as text) mod 5 is not 0, at most
``most_rows`` of them (in the order of a hash, so that the sample is the same on any
cluster); their statistics alone reach the driver, 8 bytes each. The model, some
hundred kB whatever the corpus, goes to the tasks. Statistics are of whole texts.

Defined cases: a null or empty text has zero statistics and gets the model's score
for these; labels that are null or whose document is missing are not learned from;
rows with the same id count each; without usable labels every score is the prior
0.5; labels of one class give a constant score; ids may be null (not held out); an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .textops import fresh, slices, utf8

MOST_ROWS = 20_000
BINS = 64
TREES, DEPTH, RATE, LEAF_ROWS, L2 = 80, 4, 0.15, 20, 1.0

_CLASS = np.zeros(256, np.int64)  # 0 other controls
for _lo, _hi, _c in ((97, 122, 1), (65, 90, 2), (48, 57, 3), (128, 255, 4), (32, 32, 5), (10, 10, 6)):
    _CLASS[_lo : _hi + 1] = _c
for _b in b".,;:!?'\"()-":
    _CLASS[_b] = 7
for _b in b"#$%&*+/<=>@[\\]^_`{|}~":
    _CLASS[_b] = 8
_SYMBOLS = b"!#$%&*|<>@=_"
N_FEATURES = 28


def statistics(text: bytes) -> np.ndarray:
    """The statistics of a text, N_FEATURES numbers."""
    out = np.zeros(N_FEATURES)
    n = len(text)
    if not n:
        return out
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    kinds = np.bincount(_CLASS, weights=counts, minlength=9)
    tokens = text.split()
    k = max(1, len(tokens))
    lines = text.split(b"\n")
    distinct = set(tokens)
    share = counts[counts > 0] / n
    out[:9] = kinds / n
    out[9] = np.log1p(n)
    out[10] = np.log1p(len(tokens))
    out[11] = n / k
    out[12] = len(distinct) / k
    out[13] = len(distinct) / np.sqrt(k)
    out[14] = -(share * np.log(share)).sum()
    out[15] = np.log1p(len(lines))
    out[16] = k / len(lines)
    out[17] = len(set(lines)) / len(lines)
    out[18] = (kinds[2] + 1) / (kinds[1] + kinds[2] + 1)
    out[19] = counts[46] / k
    out[20] = len({t.lower() for t in distinct}) / max(1, len(distinct))
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    out[21] = lengths.std() if len(tokens) else 0
    out[22] = (lengths <= 3).mean() if len(tokens) else 0
    out[23] = (lengths >= 12).mean() if len(tokens) else 0
    odd = [counts[b] for b in _SYMBOLS]
    out[24] = sum(odd) / k
    out[25] = counts[124] / k
    out[26] = counts[33] / k
    out[27] = max(odd) / k
    return out


def bin_edges(x: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    return [np.unique(np.quantile(col, np.linspace(0, 1, bins + 1)[1:-1])) if len(col) else np.empty(0) for col in x.T]


class Model:
    """Boosted trees as arrays of complete binary trees: feature, threshold and value by node."""

    def __init__(self, base: float, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray, depth: int):
        self.base, self.feature, self.threshold, self.value, self.depth = base, feature, threshold, value, depth

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1, for rows of statistics."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            total += v[node]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Model:
    """Histogram gradient boosting on the logistic loss."""
    n, m = x.shape
    inner, every = 2**depth - 1, 2 ** (depth + 1) - 1
    if not n or y.min() == y.max():
        prior = 0.5 if not n else (y.sum() + 1) / (n + 2)
        return Model(float(np.log(prior / (1 - prior))), np.zeros((0, every), np.int64), np.zeros((0, every)), np.zeros((0, every)), depth)
    edges = bin_edges(x)
    binned = np.stack([np.searchsorted(e, col, side="left") for e, col in zip(edges, x.T, strict=True)], 1)
    width = max(len(e) for e in edges) + 1
    offset = np.arange(m) * width
    p = y.mean()
    base = float(np.log(p / (1 - p)))
    margin = np.full(n, base)
    model = Model(base, np.zeros((trees, every), np.int64), np.full((trees, every), np.inf), np.zeros((trees, every)), depth)
    for t in range(trees):
        prob = 1 / (1 + np.exp(-margin))
        g, h = prob - y, prob * (1 - prob)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            slot = ((node - first)[:, None] * (m * width) + offset + binned).ravel()
            shape = (count, m, width)
            size = count * m * width
            gs, hs, ns = (np.bincount(slot, weights=np.repeat(w, m), minlength=size).reshape(shape).cumsum(2) for w in (g, h, np.ones(n)))
            gt, ht, nt = gs[:, :1, -1:], hs[:, :1, -1:], ns[:, :1, -1:]
            gain = gs**2 / (hs + L2) + (gt - gs) ** 2 / (ht - hs + L2) - gt**2 / (ht + L2)
            gain[(ns < LEAF_ROWS) | (nt - ns < LEAF_ROWS)] = 0
            best = gain.reshape(count, -1).argmax(1)
            for j in range(count):
                f, b = divmod(int(best[j]), width)
                if gain[j, f, b] > 1e-6 and b < len(edges[f]):
                    model.feature[t, first + j], model.threshold[t, first + j] = f, edges[f][b]
            f = model.feature[t, node]
            node = 2 * node + 1 + (x[np.arange(n), f] > model.threshold[t, node])
        leaf_g, leaf_h = (np.bincount(node - inner, weights=w, minlength=inner + 1) for w in (g, h))
        model.value[t, inner:] = -rate * leaf_g / (leaf_h + L2)
        margin += model.value[t, node]
    return model


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [statistics(t).tolist() for t in utf8(batch.column(0))]
        yield pa.record_batch([pa.array(rows, pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])


def fold(column) -> object:
    """crc32 of the id as text, mod 5."""
    return F.crc32(column.cast("string").cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Model:
    """The model from the labelled rows that are not held out, at most ``most_rows`` of them."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("y")).where(fold(F.col("doc_id")) != 0).where("y in (0, 1)")
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(most_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "y")  # at most most_rows ids
    # rows of a repeated id count each, up to the same bound
    found = texts.mapInArrow(_features, "x array<double>, y int").orderBy(F.xxhash64("x", "y"), "x", "y")
    rows = found.limit(most_rows).collect()
    order = sorted((tuple(r["x"]), r["y"]) for r in rows)
    x = np.array([r[0] for r in order]).reshape(-1, N_FEATURES)
    return fit(x, np.array([r[1] for r in order], dtype=float))


def _score(model: Model, names: list[str | None], text_at: int, out: str = "score"):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_at, 8 << 20):
                x = np.array([statistics(t) for t in utf8(batch.column(text_at))]).reshape(-1, N_FEATURES)
                yield pa.record_batch([*[c for j, c in enumerate(batch.columns) if names[j] is not None], pa.array(model.scores(x))], names=[*[n for n in names if n is not None], out])

    return run


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most_rows: int = MOST_ROWS) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    model = train(docs, labels, most_rows)
    rows = docs.select("doc_id", "text")
    scored = rows.mapInArrow(_score(model, ["doc_id", None], 1), f"doc_id {dict(rows.dtypes)['doc_id']}, score double")
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most_rows: int = MOST_ROWS) -> DataFrame:
    """The documents the classifier does not reject, with all their columns."""
    model = train(docs, labels, most_rows)
    (score,) = fresh(docs, "score")
    schema = StructType([*docs.schema.fields, StructField(score, DoubleType())])
    scored = docs.mapInArrow(_score(model, docs.columns, docs.columns.index("text"), score), schema)
    return scored.where(F.col(score) >= threshold).drop(score)


def op10_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return classify(docs, labels)
