"""Position weight matrices: scores, scans of regions and sequences, motif files."""

from __future__ import annotations

import math
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..operators.stats import bin_statistic
from .dna import NUCLEOTIDES, encode

Matrix = list[list[float]]  # rows a, c, g, t


def read_matrix(text: str) -> Matrix:
    """Rows of a letter and its values, in any order, of equal width."""
    rows = {}
    for line in text.splitlines():
        parts = line.split()
        if parts:
            rows[parts[0].lower()] = [float(x) for x in parts[1:]]
    if set(rows) != set(NUCLEOTIDES) or len({len(r) for r in rows.values()}) != 1:
        raise ValueError("a matrix has four rows of equal width")
    return [rows[x] for x in NUCLEOTIDES]


def write_table(matrix: Matrix) -> str:
    return "\n".join(x + " " + " ".join(f"{v:f}" for v in row) for x, row in zip(NUCLEOTIDES.upper(), matrix, strict=True)) + "\n"


def write_jaspar(matrix: Matrix, name: str) -> str:
    rows = "\n".join(f"{x} [ " + " ".join(f"{v:f}" for v in row) + " ]" for x, row in zip(NUCLEOTIDES.upper(), matrix, strict=True))
    return f">{name}\n{rows}\n"


def revcomp(matrix: Matrix) -> Matrix:
    return [row[::-1] for row in matrix[::-1]]


def scores(sequence: Column, matrix: Matrix) -> Column:
    """The score at every start; letters other than acgt add nothing; empty if the sequence is too short."""
    width = len(matrix[0])
    columns = [F.array(*[F.lit(float(row[j])) for row in matrix]) for j in range(width)]
    codes = encode(sequence)

    # the codes are bound once, as the only element of an array
    def score_all(c: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(c) - width, F.lit(0)))
        cell = lambda i, j: F.coalesce(F.get(columns[j], F.get(c, i + j)), F.lit(0.0))
        total = lambda i: sum((cell(i, j) for j in range(1, width)), cell(i, 0))
        return F.when(F.size(c) >= width, F.transform(starts, total)).otherwise(F.array().cast("array<double>"))

    return F.element_at(F.transform(F.array(codes), score_all), 1)


def max_score(values: Column) -> Column:
    return F.coalesce(F.array_max(values), F.lit(float("-inf")))


def mean_score(values: Column) -> Column:
    """Log of the mean of the exponentials."""
    top = F.array_max(values)
    total = F.aggregate(F.transform(values, lambda v: F.exp(v)), F.lit(0.0), lambda a, v: a + v)
    return F.when(top.isNull(), F.lit(float("-inf"))).otherwise(F.log(total) - F.log(F.size(values).cast("double")))


_CODES = np.full(256, 4, np.uint8)
for _i, _x in enumerate(NUCLEOTIDES):
    _CODES[[ord(_x), ord(_x.upper())]] = _i


def score_array(sequence: str, matrix: np.ndarray) -> np.ndarray:
    """The score at every start; matrix has a fifth row of zeros for other letters; empty if the sequence is too short."""
    codes = _CODES[np.frombuffer(sequence.encode("ascii", "replace"), np.uint8)]
    n = len(codes) - matrix.shape[1] + 1
    out = np.zeros(max(n, 0))
    for j, column in enumerate(matrix.T if n > 0 else ()):
        out += column[codes[j : j + n]]
    return out


def _padded(matrix: Matrix) -> np.ndarray:
    return np.vstack([np.array(matrix, float), np.zeros(len(matrix[0]))])


def _log_mean(values: np.ndarray) -> float:
    if not len(values):
        return -math.inf
    top = values.max()
    return -math.inf if top == -math.inf else float(top + np.log(np.exp(values - top).mean()))


def _both_strands(sequence: str, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores of the sequence, and of its reverse complement in the order of the starts on it.

    The reverse complement meets the matrix as the sequence meets the reversed and
    complemented matrix, whose scores come from its end.
    """
    turned = np.vstack([matrix[3::-1, ::-1], matrix[4:, ::-1]])
    return score_array(sequence, matrix), score_array(sequence, turned)[::-1]


def region_scores(regions: DataFrame, matrices: list[Matrix], mean: bool = False, both: bool = True, column: str = "bases") -> DataFrame:
    """regions with ``counts``: for each matrix the largest score (mean: the log of the mean of the exponentials).

    Over both strands, or the given one only; -inf where the sequence is shorter than
    the matrix or null. The matrices go to the tasks as arrays, whatever their number.
    """
    tables = [_padded(m) for m in matrices]
    at = regions.columns.index(column)

    def one(text: str, table: np.ndarray) -> float:
        sides = _both_strands(text, table) if both else (score_array(text, table),)
        if mean:
            each = [_log_mean(x) for x in sides]
            return float(np.logaddexp.reduce(each) - math.log(len(each)))
        return float(max(x.max(initial=-math.inf) for x in sides))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[one(t or "", m) for m in tables] for t in batch.column(at).to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(found, pa.list_(pa.float64()))], names=[*batch.schema.names, "counts"])

    plain = regions.drop("counts") if "counts" in regions.columns and column != "counts" else regions
    at = plain.columns.index(column)
    return plain.mapInArrow(run, StructType([*plain.schema.fields, StructField("counts", ArrayType(DoubleType()))]))


def scan_regions(regions: DataFrame, matrices: list[Matrix], mean: bool = False, column: str = "bases") -> DataFrame:
    """regions with ``counts``: a score for each matrix, over both strands."""
    return region_scores(regions, matrices, mean, True, column)


def scan_sequences(sequences: DataFrame, matrix: Matrix, bin_size: int, statistic: str = "max") -> DataFrame:
    """A track of the larger strand score of the starts in a bin, by any bin statistic."""
    table = _padded(matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            for name, text in zip(names, batch.column(1).to_pylist(), strict=True):
                forward, reverse = _both_strands(text or "", table)
                best = np.maximum(forward, reverse[::-1])
                cut = np.arange(0, len(best), bin_size)
                if not len(cut):
                    continue
                moments = [np.add.reduceat(x, cut) for x in (np.ones(len(best)), best, best * best)]
                ends = [f.reduceat(best, cut) for f in (np.minimum, np.maximum)]
                columns = [pa.array([name] * len(cut), pa.string()), pa.array(cut // bin_size, pa.int64()), *[pa.array(x, pa.float64()) for x in (*moments, *ends)]]
                yield pa.record_batch(columns, names=["seqname", "bin", "n", "sum", "sum_sq", "min", "max"])

    rows = sequences.select(F.col("seqname").cast("string").alias("seqname"), "sequence")
    found = rows.mapInArrow(run, "seqname string, bin long, n double, sum double, sum_sq double, min double, max double")
    return found.select("seqname", "bin", bin_statistic(statistic).alias("value"))


def motifs(xml: str, alpha: float = 0.0, log: bool = True, max_evalue: float | None = None) -> list[tuple[str, Matrix]]:
    """(name, matrix) of a MEME or DREME file: probabilities with a pseudocount, or their log odds to the background."""
    root = ET.fromstring(xml)
    background = {x: 0.25 for x in NUCLEOTIDES}
    for node in root.iter("background"):
        background |= {k.lower(): float(v) for k, v in node.attrib.items() if k.lower() in background}
    for node in root.iter("background_frequencies"):
        background |= {v.attrib["letter_id"][-1].lower(): float(v.text) for v in node.iter("value")}
    out = []
    for motif in root.iter("motif"):
        if root.tag.upper() == "MEME" and max_evalue is not None and float(motif.attrib.get("e_value", 0)) > max_evalue:
            continue
        columns = [{k.lower(): float(v) for k, v in p.attrib.items() if k.lower() in NUCLEOTIDES} for p in motif.iter("pos")]
        for array in motif.iter("probabilities"):
            columns = [{v.attrib["letter_id"][-1].lower(): float(v.text) for v in col.iter("value")} for col in array.iter("alphabet_array")]
        matrix = []
        for x in NUCLEOTIDES:
            ppm = [(c[x] + max(alpha, 0)) / (1 + 4 * max(alpha, 0)) for c in columns]
            if not log:
                matrix.append(ppm)
            elif alpha < 0:
                matrix.append([math.log2((c[x] - background[x] * alpha) / background[x]) for c in columns])
            else:
                matrix.append([math.log2(p / background[x]) if p > 0 else float("-inf") for p in ppm])
        out.append((motif.attrib.get("id", motif.attrib.get("name", "")), matrix))
    return out
