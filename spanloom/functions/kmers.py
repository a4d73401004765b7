"""K-mer analytics: equivalence classes, generalised counts, similarity, relations."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dna import BASES, GAPPED, NUCLEOTIDES, complement, matching


@dataclass(frozen=True)
class Equivalence:
    """Lengths n to m, which variants are one class, and the alphabet of the patterns."""

    n: int
    m: int
    complement: bool = False
    reverse: bool = False
    revcomp: bool = False
    max_ambiguous: tuple[int, ...] = ()
    alphabet: str = field(default=NUCLEOTIDES)

    def ambiguous(self, k: int) -> int:
        """Ambiguous letters allowed at length k; -1: any number."""
        if not self.max_ambiguous:
            return -1
        return self.max_ambiguous[0] if len(self.max_ambiguous) == 1 else self.max_ambiguous[k - self.n]


def _complement(s: str) -> str:
    flip = {"a": "t", "c": "g", "g": "c", "t": "a"}
    back = {"".join(sorted(v)): k for k, v in BASES.items()}
    return "".join(back["".join(sorted(flip[b] for b in BASES[x]))] for x in s)


def kmer_id(kmer: str, alphabet: str) -> int:
    out = 0
    for x in kmer:
        out = out * len(alphabet) + alphabet.index(x)
    return out


def variants(kmer: str, eq: Equivalence) -> list[str]:
    out = [kmer]
    if eq.complement:
        out.append(_complement(kmer))
    if eq.reverse:
        out.append(kmer[::-1])
    if eq.revcomp:
        out.append(_complement(kmer)[::-1])
    return out


def class_of(kmer: str, eq: Equivalence) -> tuple[int, int, list[str]]:
    """k, class id and elements: the variant with the smallest id, then its own variants."""
    first = min(variants(kmer.lower(), eq), key=lambda x: kmer_id(x, eq.alphabet))
    return len(kmer), kmer_id(first, eq.alphabet), list(dict.fromkeys(variants(first, eq)))


def _id(kmer: Column, alphabet: str) -> Column:
    letters = F.filter(F.split(kmer, ""), lambda x: x != "")
    return F.aggregate(letters, F.lit(0).cast("long"), lambda a, x: a * len(alphabet) + F.position(x, F.lit(alphabet)) - 1)


def canonical(kmer: Column, eq: Equivalence) -> Column:
    """struct(id, kmer) of a k-mer's class, in the engine."""
    forms = [kmer]
    if eq.complement:
        forms.append(complement(kmer))
    if eq.reverse:
        forms.append(F.reverse(kmer))
    if eq.revcomp:
        forms.append(F.reverse(complement(kmer)))
    return F.array_min(F.array(*[F.struct(_id(f, eq.alphabet).alias("id"), f.alias("kmer")) for f in forms]))


def _generalise(kmer: Column, k: int, alphabet: str) -> Column:
    """All patterns of the alphabet that stand for the k-mer; no wildcard at either end."""
    table = {x: [y for y in matching(x, alphabet)] for x in NUCLEOTIDES}
    inner = F.create_map(*[v for x, ys in table.items() for v in (F.lit(x), F.array(*[F.lit(y) for y in ys]))])
    outer = F.create_map(*[v for x, ys in table.items() for v in (F.lit(x), F.array(*[F.lit(y) for y in ys if y != "n"]))])
    out = F.array(F.lit(""))
    for i in range(k):
        choices = (outer if i in (0, k - 1) else inner)[F.substring(kmer, i + 1, 1)]
        out = _extend(out, choices)
    return out


def _extend(prefixes: Column, choices: Column) -> Column:
    return F.flatten(F.transform(prefixes, lambda p: F.transform(choices, lambda c: F.concat(p, c))))


#: Letters of a sequence that are counted at a time.
PIECE = 1 << 18
#: The longest k-mer whose code fits a 64-bit number.
LONGEST_CODE = 31

_CODE = np.full(256, 4, np.uint8)
for _i, _x in enumerate(NUCLEOTIDES):
    _CODE[[ord(_x), ord(_x.upper())]] = _i
_LETTER = np.frombuffer(NUCLEOTIDES.encode(), np.uint8)


def _distinct(codes: np.ndarray, k: int) -> tuple[list[str], np.ndarray]:
    """The k-mers of acgt in a piece and how often each occurs; codes roll along, so the work is linear."""
    n = len(codes) - k + 1
    if n <= 0:
        return [], np.empty(0, np.int64)
    bad = np.concatenate([[0], np.cumsum(codes > 3)])
    good = bad[k:] == bad[:-k]
    if k > LONGEST_CODE:
        rows = np.lib.stride_tricks.sliding_window_view(codes, k)[good]
        kinds, counts = np.unique(_LETTER[rows].view(f"S{k}").ravel(), return_counts=True)
        return [x.decode() for x in kinds], counts
    rolled = np.zeros(n, np.uint64)
    for j in range(k):
        rolled = (rolled << np.uint64(2)) | (codes[j : j + n] & 3).astype(np.uint64)
    kinds, counts = np.unique(rolled[good], return_counts=True)
    shifts = np.arange(2 * (k - 1), -1, -2, dtype=np.uint64)
    letters = _LETTER[((kinds[:, None] >> shifts) & np.uint64(3)).astype(np.uint8)]
    return [x.decode() for x in np.ascontiguousarray(letters).view(f"S{k}").ravel()], counts


def _exact(low: int, high: int):
    """Batches of (id, sequence) to (id, k, gram, n), by pieces of bounded length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            ks: list[int] = []
            grams: list[str] = []
            counts: list[np.ndarray] = []

            def flush(batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                total = np.concatenate(counts) if counts else np.empty(0, np.int64)
                out = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(ks, pa.int32()), pa.array(grams, pa.string()), pa.array(total, pa.int64())]
                return pa.record_batch(out, names=["id", "k", "gram", "n"])

            for i, text in enumerate(batch.column(1).to_pylist()):
                codes = _CODE[np.frombuffer((text or "").encode(), np.uint8)]
                for at in range(0, max(1, len(codes)), PIECE):
                    for k in range(low, high + 1):
                        found, n = _distinct(codes[at : at + PIECE + k - 1], k)
                        rows += [i] * len(found)
                        ks += [k] * len(found)
                        grams += found
                        counts.append(n)
                if len(rows) > 200_000:
                    yield flush()
                    rows, ks, grams, counts = [], [], [], []
            if rows:
                yield flush()

    return run


def count_kmers(sequences: DataFrame, eq: Equivalence, id_col: str = "seqname", patterns: list[str] | None = None, presence: bool = False) -> DataFrame:
    """id, k, class_id, kmer, n: occurrences of every class; patterns: of those classes only; presence: n is 1.

    K-mers are counted exactly first, in numpy and then with map-side combination;
    only the distinct ones of all sequences are generalised to their classes. K-mers
    with other letters than acgt count for nothing.
    """
    rows = sequences.select(F.col(id_col).alias("id"), F.col("sequence").cast("string").alias("sequence"))
    kind = dict(rows.dtypes)["id"]
    counted = rows.mapInArrow(_exact(eq.n, eq.m), f"id {kind}, k int, gram string, n long")
    exact = counted.groupBy("id", "k", "gram").agg(F.sum("n").alias("n"))
    grams = counted.select("k", "gram").distinct()
    parts = []
    for k in range(eq.n, eq.m + 1):
        forms = F.array_distinct(F.transform(_generalise(F.col("gram"), k, eq.alphabet), lambda p: canonical(p, eq)))
        parts.append(grams.where(F.col("k") == k).select("k", "gram", F.explode(forms).alias("c")))
    classes = reduce(DataFrame.unionByName, parts).select("k", "gram", F.col("c.id").alias("class_id"), F.col("c.kmer").alias("kmer"))
    out = exact.join(classes, ["k", "gram"]).groupBy("id", "k", "class_id", "kmer").agg(F.sum("n").alias("n"))
    if any(a >= 0 for a in eq.max_ambiguous):
        most = F.create_map(*[v for k in range(eq.n, eq.m + 1) for v in (F.lit(k), F.lit(eq.ambiguous(k)))])
        out = out.where((most[F.col("k")] < 0) | (F.length(F.regexp_replace("kmer", "[acgt]", "")) <= most[F.col("k")]))
    if patterns is not None:
        known = sequences.sparkSession.createDataFrame([class_of(p, eq)[:2] for p in patterns], "k int, class_id long").distinct()
        out = out.join(known, ["k", "class_id"], "left_semi")
    return out.withColumn("n", F.lit(1).cast("long")) if presence else out


def catalogue(counts: DataFrame) -> DataFrame:
    """The distinct classes, in order."""
    return counts.select("k", "class_id", "kmer").distinct().orderBy("k", "class_id")


def dense(counts: DataFrame) -> DataFrame:
    """id and counts: every class of the catalogue in order, 0 where a sequence lacks it."""
    listed = catalogue(counts).agg(F.array_sort(F.collect_list(F.struct("k", "class_id"))).alias("all"))
    own = counts.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "k", "class_id"), "n"))).alias("m"))
    both = own.crossJoin(F.broadcast(listed))  # one row
    return both.select("id", F.transform("all", lambda c: F.coalesce(F.element_at("m", F.concat_ws(":", c["k"], c["class_id"])), F.lit(0))).alias("counts"))


def sparse_text(counts: DataFrame) -> DataFrame:
    """id and text: name=count of the classes it has, in order."""
    x = F.array_sort(F.collect_list(F.struct("k", "class_id", F.concat_ws("=", "kmer", "n").alias("t"))))
    return counts.groupBy("id").agg(F.array_join(F.transform(x, lambda v: v["t"]), ",").alias("text"))


def human_text(counts: DataFrame) -> DataFrame:
    """id and text: name=count of every class of the catalogue, in order, 0 where a sequence lacks it."""
    names = catalogue(counts).agg(F.array_sort(F.collect_list(F.struct("k", "class_id", "kmer"))).alias("names"))
    both = dense(counts).crossJoin(F.broadcast(names))  # one row
    cells = F.zip_with("names", "counts", lambda c, n: F.concat_ws("=", c["kmer"], n))
    return both.select("id", F.array_join(cells, ",").alias("text"))


def sequence_similarity(reference: DataFrame, sequences: DataFrame, eq: Equivalence, width: int, step: int = -1, measure: str = "cosine", binary: bool = False) -> DataFrame:
    """row_id, similarities: of windows as wide as the reference, every ``step`` bases (-1: a tenth of the width).

    A sequence that is not longer than the reference has none; a window without any
    class in common has 0 or, for the cosine of nothing, NaN.
    """
    step = max(1, width // 10) if step == -1 else step
    last = F.length("sequence") - width - step
    starts = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(step))).otherwise(F.array().cast("array<int>"))
    cut = sequences.select("row_id", "sequence", F.explode(starts).alias("at"))
    each = cut.select(F.struct("row_id", "at").alias("seqname"), F.expr(f"substring(sequence, at + 1, {width})").alias("sequence"))
    own = count_kmers(reference.select(F.lit("reference").alias("seqname"), "sequence"), eq, presence=binary)
    found = similarity(own.select("k", "class_id", "n"), count_kmers(each, eq, presence=binary), measure)
    every = each.select(F.col("seqname").alias("id")).join(found, "id", "left").withColumn("value", F.coalesce("value", F.lit(float("nan") if measure == "cosine" else 0.0)))
    listed = every.groupBy(F.col("id.row_id").alias("row_id")).agg(F.array_sort(F.collect_list(F.struct("id.at", "value"))).alias("x"))
    return listed.select("row_id", F.transform("x", lambda v: v["value"]).alias("similarities"))


def matches(a: str, b: str) -> bool:
    """Whether a occurs in the longer b at some offset with its bases containing b's."""
    for off in range(len(b) - len(a) + 1):
        if all(set(BASES[b[off + i]]) <= set(BASES[x]) for i, x in enumerate(a)):
            return True
    return False


def count_ambiguous(kmer: str) -> int:
    return sum(len(BASES[x]) > 1 for x in kmer)


def count_wildcard(kmer: str) -> int:
    return kmer.count("n")


def iterate(k: int, alphabet: str = NUCLEOTIDES, max_ambiguous: int = -1, infix: str = "", at: int = 0):
    """All k-mers in order (no wildcard at the ends), with a fixed infix if given."""
    free = k - len(infix)
    for letters in product(alphabet, repeat=free):
        s = "".join(letters[:at]) + infix + "".join(letters[at:])
        if s[0] == "n" or s[-1] == "n":
            continue
        if max_ambiguous < 0 or count_ambiguous(s) <= max_ambiguous:
            yield s


def instantiate(kmer: str, alphabet: str = GAPPED, partial: bool = False):
    """All k-mers whose letters an ambiguous one stands for; partial: with letters that stay ambiguous, too."""
    choices = []
    for x in kmer:
        base = [y for y in NUCLEOTIDES if y in BASES[x]]
        choices.append([*base, x] if partial and len(BASES[x]) > 1 else base)
    for letters in product(*choices):
        yield "".join(letters)


def similarity(reference: DataFrame, other: DataFrame, measure: str = "cosine") -> DataFrame:
    """id, value: similarity of each of other's count vectors with the reference's (k, class_id, n).

    Products are floating point: those of two norms leave the range of a long at a few
    hundred MB of sequences. Up to 2^53 they are exact.
    """
    other = other.withColumn("n", F.col("n").cast("double"))
    ref = reference.groupBy("k", "class_id").agg(F.sum("n").cast("double").alias("r"))
    norms = ref.agg(F.sum(F.col("r") * F.col("r")).alias("rr"), F.count("*").alias("rn"))
    both = other.join(ref, ["k", "class_id"], "left").groupBy("id").agg(F.sum(F.col("n") * F.coalesce("r", F.lit(0.0))).alias("d"), F.sum(F.col("n") * F.col("n")).alias("nn")).crossJoin(F.broadcast(norms))  # one row
    value = {"cosine": F.col("d") / F.sqrt(F.col("nn") * F.col("rr")), "tanimoto": F.col("d") / (F.col("nn") + F.col("rr") - F.col("d")), "dot-product": F.col("d") / F.col("rn")}
    if measure not in value:
        raise ValueError(f"no measure {measure}")
    return both.select("id", value[measure].alias("value"))


def windows(sequences: DataFrame, width: int, step: int = 0) -> DataFrame:
    """Sliding windows of the sequences as (seqname@start, sequence)."""
    step = step or max(1, width // 10)
    starts = F.when(F.length("sequence") >= width, F.sequence(F.lit(0), F.greatest(F.length("sequence") - width, F.lit(0)), F.lit(step))).otherwise(F.array().cast("array<int>"))
    return sequences.select("seqname", "sequence", F.explode(starts).alias("at")).select(F.concat_ws("@", "seqname", "at").alias("seqname"), F.expr(f"substring(sequence, at + 1, {width})").alias("sequence"))


def _cluster(kmer: str) -> int:
    return sum(1 << i for i, x in enumerate(kmer) if x != "n")


def graph(kmers: list[str]) -> tuple[dict[str, int], list[tuple[str, str]]]:
    """Cluster ids (a bit for each letter that is no wildcard) and relations between neighbouring ranks.

    A pattern is small data: a few thousand k-mers on the driver.
    """
    clusters = {x: _cluster(x) for x in kmers}
    ranks: dict[int, list[str]] = {}
    for x in kmers:
        ranks.setdefault(bin(clusters[x]).count("1") - 1, []).append(x)
    levels = [ranks[r] for r in sorted(ranks)]
    edges = []
    for low, high in zip(levels, levels[1:], strict=False):
        for a in low:
            for b in high:
                if len(a) <= len(b) and any((clusters[a] << s) & ~clusters[b] == 0 for s in range(len(b) - len(a) + 1)) and matches(a, b):
                    edges.append((a, b))
    return clusters, edges
