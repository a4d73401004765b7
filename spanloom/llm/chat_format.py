r"""Chat formatting by columnar byte assembly.

A turn becomes ``<turn ROLE>\nTEXT</turn>\n``. In roles and texts a backslash is
doubled and the control strings ``<turn `` and ``</turn>`` get a backslash before
their ``<``; a role's line feeds become ``\n``. Both are undone exactly.

Rows are dealt by conversation and sorted by turn. A batch is assembled at once:
segment lengths (headers by role, contents from Arrow's offsets, footers) give
cumulative offsets, and headers and contents are scattered by index arrays into one
preallocated buffer, which becomes the Arrow column's data without another copy.
The loss mask is the character ranges of the assistant's contents.

A conversation is one output value, so its turns are brought together; a task
streams the sorted turns and holds one batch and one conversation at a time.

Defined cases: null texts and roles are empty; turns are ordered by turn (null
first), ties by role and text; repeated rows are turns of their own; a null conv_id
is a conversation; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<turn ", "</turn>"
HEAD_END, FOOT = b">\n", b"</turn>\n"
EXTRA = (-7, r"\### Assistant: </turn> ok")


def escape(column: pa.Array) -> pa.Array:
    out = pc.replace_substring(column, "\\", "\\\\")
    out = pc.replace_substring(out, OPEN, "\\" + OPEN)
    return pc.replace_substring(out, CLOSE, "\\" + CLOSE)


_CODES = {"\\\\": "\\", "\\<": "<", "\\n": "\n"}


def unescape(text: str) -> str:
    return re.sub(r"\\[\\<n]", lambda m: _CODES[m[0]], text)


def _plain(column) -> pa.Array:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pc.fill_null(column.cast(pa.large_string()), "")


def _parts(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string array's bytes and offsets."""
    _, offsets, data = array.buffers()
    off = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    return (np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)), off


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The turns laid end to end: bytes, and where each turn ends."""
    coded = roles.dictionary_encode()
    heads = [b"<turn " + x.encode() + HEAD_END for x in pc.replace_substring(escape(coded.dictionary), "\n", "\\n").to_pylist()]
    index = coded.indices.to_numpy(zero_copy_only=False)
    head_data = np.frombuffer(b"".join(heads), np.uint8)
    head_len = np.array([len(h) for h in heads], np.int64)
    head_at = np.cumsum(head_len) - head_len
    body, off = _parts(escape(texts))
    body_len = np.diff(off)
    own_head = head_len[index] if len(index) else np.empty(0, np.int64)
    size = own_head + body_len + len(FOOT)
    end = np.cumsum(size)
    begin = end - size
    out = np.empty(int(end[-1]) if len(end) else 0, np.uint8)

    def scatter(to: np.ndarray, source: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
        step = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        out[np.repeat(to, length) + step] = source[np.repeat(start, length) + step]

    if len(index):
        scatter(begin, head_data, head_at[index], own_head)
        scatter(begin + own_head, body, off[:-1], body_len)
        foot = np.frombuffer(FOOT, np.uint8)
        out[(end - len(FOOT))[:, None] + np.arange(len(FOOT))] = foot
    return out, end


_OUT = "conv_id long, formatted string, loss array<array<long>>"


def _format(assistant: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv: object = None
        open_text: list[bytes] = []
        loss: list[list[int]] = []
        chars, begun = 0, False
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, roles, texts = batch.column(0).to_pylist(), _plain(batch.column(2)), _plain(batch.column(3))
            data, end = assemble(roles, texts)
            whole = memoryview(data)
            head = pc.utf8_length(pc.replace_substring(escape(roles), "\n", "\\n")).to_numpy(zero_copy_only=False) + len(OPEN) + len(HEAD_END)
            content = pc.utf8_length(escape(texts)).to_numpy(zero_copy_only=False)
            learn = pc.equal(roles, assistant).to_numpy(zero_copy_only=False)
            done: list[tuple] = []
            at = 0
            for i, own in enumerate(ids):
                if begun and own != conv:
                    stop = int(end[i - 1]) if i else 0
                    done.append((conv, b"".join([*open_text, whole[at:stop]]), loss))
                    open_text, loss, chars, at = [], [], 0, stop
                conv, begun = own, True
                if learn[i]:
                    loss.append([chars + int(head[i]), chars + int(head[i] + content[i])])
                chars += int(head[i] + content[i]) + len(FOOT)
            open_text.append(bytes(whole[at:]))
            if done:
                yield _batch(done)
        if begun:
            yield _batch([(conv, b"".join(open_text), loss)])

    def _batch(done: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.binary()).cast(pa.string()), pa.array([x[2] for x in done], pa.list_(pa.list_(pa.int64())))], names=["conv_id", "formatted", "loss"])

    return run


def format_chats(turns: DataFrame, assistant: str = "assistant") -> DataFrame:
    """conv_id, formatted and loss (character ranges of the assistant's contents), from conv_id, turn, role, text."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    dealt = rows.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")
    return dealt.mapInArrow(_format(assistant), _OUT)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            raise ValueError("a turn must begin here")
        head = formatted.index(">\n", at)
        end = head
        while True:  # the next close that no backslash escapes
            end = formatted.index(CLOSE, end)
            back = end
            while formatted[back - 1] == "\\":
                back -= 1
            if (end - back) % 2 == 0 or back < head + 2:
                break
            end += 1
        out.append((unescape(formatted[at + len(OPEN) : head]), unescape(formatted[head + 2 : end])))
        at = end + len(FOOT)
    return out


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, loss in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            turns, masked = hashlib.sha256(), hashlib.sha256()
            found = parse(text)
            for role, body in found:
                turns.update(f"{role}\n{body}\n".encode())
            chars = 0
            for a, b in loss:
                body = unescape(text[a:b])
                chars += len(body)
                masked.update(body.encode())
            rows.append((len(found), turns.hexdigest(), chars, masked.hexdigest(), len(text)))
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.record_batch([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names=[x.split()[0] for x in _DIGEST.split(", ")])


def op7_chat_format(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(EXTRA[0], 0, "user", EXTRA[1]), (EXTRA[0], 1, "assistant", EXTRA[1])], "conv_id long, turn long, role string, text string")
    return format_chats(turns.unionByName(extra)).mapInArrow(_read_back, _DIGEST)


_ESC = r"replace(replace(replace({0}, '\', '\\'), '<turn ', '\<turn '), '</turn>', '\</turn>')"
OP7_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {EXTRA[0]}, 0, 'user', '{EXTRA[1]}' UNION ALL SELECT {EXTRA[0]}, 1, 'assistant', '{EXTRA[1]}'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(16 + length(replace({_ESC.format("role")}, chr(10), '\n')) + length({_ESC.format("text")})) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
