"""What the operators mean by a word, in Spark, in DuckDB and in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Words over lower-cased text: runs of a-z, 0-9 and everything beyond ASCII.
WORD_RE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words between ASCII white space.
SPACE_WORD_RE = r"[^\x20\x09-\x0D]+"

_word_table = bytearray(range(256))
for _b in [*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]:
    _word_table[_b] = 0x20
for _u, _l in zip(UPPER.encode(), LOWER.encode(), strict=True):
    _word_table[_u] = _l
WORD_TABLE = bytes(_word_table)

_lower_table = bytearray(range(256))
for _u, _l in zip(UPPER.encode(), LOWER.encode(), strict=True):
    _lower_table[_u] = _l
LOWER_TABLE = bytes(_lower_table)

SQL_LOWER = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"


def ascii_lower(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def words(data: bytes) -> list[bytes]:
    """The words of WORD_RE in lower-cased UTF-8 text."""
    return data.translate(WORD_TABLE).split()


def space_words(data: bytes) -> list[bytes]:
    """The words of SPACE_WORD_RE in lower-cased UTF-8 text."""
    return data.translate(LOWER_TABLE).split()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit words (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def utf8(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """Texts as bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, column: int, most: int):
    """The batch in slices of about ``most`` bytes in the given column, never cutting a row."""
    array = batch.column(column)
    sizes = np.array([0 if x is None else x for x in pc.binary_length(array.cast(pa.binary())).to_pylist()], dtype=np.int64)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)
