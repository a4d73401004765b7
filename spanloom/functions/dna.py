"""DNA scalar functions as Columns, and scans over sequence tables."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Alphabets: letters in code order; fixed values.
NUCLEOTIDES = "acgt"
GAPPED = "acgtn"
AMBIGUOUS = "acgtwsmkrybdhvn"
#: Bases of the ambiguity letters (IUPAC); fixed values.
BASES = {"a": "a", "c": "c", "g": "g", "t": "t", "w": "at", "s": "cg", "m": "ac", "k": "gt", "r": "ag", "y": "ct", "b": "cgt", "d": "agt", "h": "act", "v": "acg", "n": "acgt"}


def _complement_letter(x: str) -> str:
    pair = {"a": "t", "c": "g", "g": "c", "t": "a"}
    want = "".join(sorted(pair[b] for b in BASES[x]))
    return next(k for k, v in BASES.items() if "".join(sorted(v)) == want)


_COMPLEMENT = "".join(map(_complement_letter, AMBIGUOUS))


def matching(letter: str, alphabet: str = GAPPED) -> str:
    """The alphabet's letters that stand for every base of this one."""
    own = set(BASES[letter.lower()])
    return "".join(x for x in alphabet if own <= set(BASES[x]))


def is_ambiguous(letter: str) -> bool:
    return len(BASES[letter.lower()]) > 1


def is_wildcard(letter: str) -> bool:
    return letter.lower() == "n"


def encode(sequence: Column, alphabet: str = NUCLEOTIDES) -> Column:
    """Codes of the letters; -1 for letters that are not of the alphabet."""
    letters = F.filter(F.split(F.lower(sequence), ""), lambda x: x != "")
    return F.transform(letters, lambda x: F.position(x, F.lit(alphabet)) - 1)


def decode(codes: Column, alphabet: str = NUCLEOTIDES) -> Column:
    return F.array_join(F.transform(codes, lambda c: F.substring(F.lit(alphabet), c + 1, F.lit(1))), "")


def complement(sequence: Column) -> Column:
    return F.translate(F.lower(sequence), AMBIGUOUS, _COMPLEMENT)


def reverse_complement(sequence: Column) -> Column:
    return F.reverse(complement(sequence))


def cpg_score(sequence: Column) -> Column:
    """Observed over expected CpG: n_cg * length / (n_c * n_g); 0 without CpG."""
    s = F.lower(sequence)
    n = lambda x: (F.length(s) - F.length(F.replace(s, F.lit(x), F.lit("")))) / F.lit(len(x))
    return F.when(n("cg") > 0, n("cg") * F.length(s) / (n("c") * n("g"))).otherwise(F.lit(0.0))


def _places(pattern: str):
    """Starts and ends of a pattern's matches in each sequence, found in one pass by the regular expression engine."""
    expression = re.compile(pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, starts, stops = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for m in expression.finditer(text or ""):
                    rows.append(i)
                    starts.append(m.start())
                    stops.append(m.end(m.lastindex or 0))
            names = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.record_batch([names, pa.array(starts, pa.int64()), pa.array(stops, pa.int64())], names=["seqname", "from", "to"])

    return run


def _ranges_of(sequences: DataFrame, pattern: str) -> DataFrame:
    rows = sequences.select(F.col("seqname").cast("string").alias("seqname"), F.col("sequence").cast("string").alias("sequence"))
    found = rows.mapInArrow(_places(pattern), "seqname string, `from` long, `to` long")
    return found.withColumn("strand", F.lit("*"))


def scan(sequences: DataFrame, query: str) -> DataFrame:
    """Ranges of all, also overlapping, matches whatever the case; an empty query matches nowhere."""
    if not query:
        return _ranges_of(sequences.limit(0), "x")
    return _ranges_of(sequences, f"(?i)(?=({re.escape(query)}))")


def unresolved(sequences: DataFrame) -> DataFrame:
    """Maximal runs of n."""
    return _ranges_of(sequences, "[nN]+")


def log_add(a: Column, b: Column) -> Column:
    high, low = F.greatest(a, b), F.least(a, b)
    return F.when(high == F.lit(float("-inf")), high).otherwise(high + F.log1p(F.exp(low - high)))


def log_sub(a: Column, b: Column) -> Column:
    return F.when(b == F.lit(float("-inf")), a).otherwise(a + F.log1p(-F.exp(b - a)))


def fields_quoted(line: str, separators: str = " \t;") -> list[str]:
    """Split at separators outside double quotes."""
    return [m for m in re.findall(rf'(?:"[^"]*"|[^{re.escape(separators)}"])+', line)]


def remove_quotes(text: str) -> str:
    return text.replace('"', "")
