"""Secret scans: patterns, and character Markov models compared by log-likelihood ratio.

Three patterns give the base spans (leftmost, not overlapping within a kind).
Beside them, every long token is scored by two first-order character models, one
of random strings and one of ordinary identifiers: the score is the sum over the
token's neighbouring characters of ln P(next | char, random) - ln P(next | char,
ordinary), in thousandths, so that it is a whole number and the same in any
engine. Tokens with a digit and a score per character of at least ``floor`` become
spans of kind ``markov``. Both models are trained from labelled samples: a table of
(token, label), by default made by rule - digests as random strings, compounds of
common identifier parts as ordinary ones; the sample is bounded by its parameter.

All in DataFrame expressions, within the row; nothing is exchanged but the training
counts, whose table has at most 67 x 67 cells. Positions follow from the lengths of
the matches and of the gaps between them, so a text is cut twice at most.

Defined cases: a null text is empty; a text without matches has zero counts, empty
spans and the digest of the empty string; overlapping spans of different kinds are
all kept; rows with repeated or null ids are scanned each for itself; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .textops import fresh

_KEY = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
#: Kind, pattern, group whose length counts, least length; fixed values.
KINDS = [
    ("assign", f"""({_KEY})["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", "AKIA[A-Z0-9]+", 0, 18),
    ("hex", "[0-9a-f]+", 0, 16),
]
LEAST_TOKEN = 20
TOKEN = f"[A-Za-z0-9+/_=-]{{{LEAST_TOKEN},}}"
FLOOR = 0  # thousandths of a nat for each character; 0: random is the likelier

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SAMPLES = 600

#: Parts of ordinary identifiers.
PARTS = "get set user name list item count index value key data file path time date type state node tree table row column field size length start end first last next prev open close read write load save find search sort filter map reduce group join split merge copy move delete insert update create build parse format print input output error message event handler request response client server session config option default result buffer stream string number integer double boolean array vector matrix test check verify main module package import export public private static final class object function method return version license document paragraph translation information international".split()


def default_samples(n: int = SAMPLES) -> list[tuple[str, int]]:
    """n random strings (label 1) and n ordinary identifiers (label 0), by rule."""
    import base64

    out = []
    for i in range(n):
        digest = hashlib.sha256(f"sample {i}".encode()).digest()
        out.append(([digest.hex()[:40], base64.b64encode(digest).decode()[:40], base64.b32encode(digest).decode()[:32]][i % 3], 1))
        pick = [PARTS[b % len(PARTS)] for b in digest[:4]]
        camel = pick[0] + "".join(p.title() for p in pick[1:])
        out.append(([camel, "_".join(pick), "-".join(pick), "".join(pick), "/".join(pick) + str(digest[5] % 10), "_".join(pick).upper()][i % 6], 0))
    return out


def _ratio(random: dict, random_from: dict, plain: dict, plain_from: dict, pair: str) -> int:
    """ln of the ratio of the two models' smoothed probabilities, in thousandths."""
    v = len(ALPHABET)
    p = (random.get(pair, 0) + 0.5) / (random_from.get(pair[0], 0) + 0.5 * v)
    q = (plain.get(pair, 0) + 0.5) / (plain_from.get(pair[0], 0) + 0.5 * v)
    return round(1000 * math.log(p / q))


def _table(counts: dict[tuple[int, str], int]) -> dict[str, int]:
    pairs = [{p: n for (label, p), n in counts.items() if label == want} for want in (1, 0)]
    sums: list[Counter] = []
    for side in pairs:
        total: Counter = Counter()
        for p, n in side.items():
            total[p[0]] += n
        sums.append(total)
    return {a + b: _ratio(pairs[0], sums[0], pairs[1], sums[1], a + b) for a in ALPHABET for b in ALPHABET}


def train(spark: SparkSession, samples: DataFrame | None = None) -> dict[str, int]:
    """Log-likelihood ratios of character pairs from labelled (token, label) rows: 1 random, 0 ordinary."""
    if samples is None:
        samples = spark.createDataFrame(default_samples(), "token string, label int")
    inside = "^[" + ALPHABET.replace("-", "\\-") + "]{2,}$"
    pairs = F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.substring("token", i, F.lit(2)))
    rows = samples.where(F.col("token").rlike(inside) & F.col("label").isin(0, 1)).select("label", F.explode(pairs).alias("pair"))
    return _table({(r["label"], r["pair"]): r["count"] for r in rows.groupBy("label", "pair").count().collect()})


def _spans(text: Column, pattern: str, group: int, least: int) -> Column:
    """struct(start, end) of the matches whose group has at least ``least`` characters."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    lengths = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    gaps = F.split(text, pattern, -1)
    step = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("out"))

    def add(a: Column, x: Column) -> Column:
        start = a["at"] + F.length(x["g"])
        end = start + F.length(x["m"])
        return F.struct(end.alias("at"), F.when(F.length(x["k"]) >= least, F.concat(a["out"], F.array(F.struct(start.alias("s"), end.alias("e"))))).otherwise(a["out"]).alias("out"))

    zipped = F.filter(F.arrays_zip(gaps.alias("g"), matches.alias("m"), lengths.alias("k")), lambda x: x["m"].isNotNull())
    return F.aggregate(zipped, step, add, lambda a: a["out"])


def find_spans(docs: DataFrame, model: dict[str, int], floor: int = FLOOR, text_col: str = "text") -> tuple[DataFrame, str, str]:
    """docs with two more columns, and their names: the base spans and all spans.

    Spans are structs (s, k, e, kind) in the order of start and kind.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.array().cast("array<struct<s:int,e:int>>")
    gates = ["assign", "access", "hex", "markov"]
    *kinds, table, base, every = fresh(docs, *gates, "model", "base", "every")
    # a cheap test first: most texts have none of a kind
    tests = [text.rlike(f"({_KEY})[\"']?\\x20*[:=]"), text.contains("AKIA"), text.rlike("[0-9a-f]{16}"), text.rlike(TOKEN)]
    each = [F.when(test, _spans(text, pattern, group, least)).otherwise(none) for test, (_, pattern, group, least) in zip(tests, KINDS, strict=False)]

    size = len(ALPHABET)
    flat = F.array(*[F.lit(model[a + b]) for a in ALPHABET for b in ALPHABET])
    tokens = F.when(tests[3], _spans(text, TOKEN, 0, LEAST_TOKEN)).otherwise(none)
    staged = docs.withColumns(dict(zip(kinds, [*each, tokens], strict=True)))
    staged = staged.withColumn(table, F.when(F.size(kinds[3]) > 0, flat))

    def random_like(x: Column) -> Column:
        token = F.substring(text, x["s"] + 1, x["e"] - x["s"])
        code = lambda i: F.position(F.substring(token, i, F.lit(1)), F.lit(ALPHABET)) - 1
        pair = lambda i: F.get(F.col(table), (code(i) * size + code(i + 1)).cast("int"))
        score = F.aggregate(F.sequence(F.lit(1), F.length(token) - 1), F.lit(0), lambda a, i: a + pair(i))
        return _digit_or_more(token) & (score >= floor * (F.length(token) - 1))

    staged = staged.withColumn(kinds[3], F.filter(kinds[3], random_like))
    tagged = [_tag(F.col(c), i, g) for i, (c, g) in enumerate(zip(kinds, gates, strict=True))]
    staged = staged.withColumn(base, F.array_sort(F.concat(*tagged[:3]))).withColumn(every, F.array_sort(F.concat(base, tagged[3])))
    return staged.drop(table, *kinds), base, every


def _digit_or_more(token: Column) -> Column:
    return token.rlike("[0-9]")


def _tag(spans: Column, order: int, kind: str) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(order).alias("k"), x["e"].alias("e"), F.lit(kind).alias("kind")))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def scan(docs: DataFrame, samples: DataFrame | None = None, floor: int = FLOOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    model = train(docs.sparkSession, samples)
    found, base, every = find_spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model, floor)
    found = found.select("doc_id", base, every)  # what follows reads the spans, not the texts
    n = lambda kind: F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    digest = F.sha2(_joined(F.col(base)).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), digest, _joined(F.col(every)).alias("spans"))


def redact(docs: DataFrame, samples: DataFrame | None = None, mark: str = "[SECRET]", floor: int = FLOOR, text_col: str = "text") -> DataFrame:
    """docs with every span's text replaced by ``mark``; overlapping spans are one. Null texts stay null."""
    model = train(docs.sparkSession, samples)
    found, _, every = find_spans(docs, model, floor, text_col)
    text = F.col(text_col)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def cut(a: Column, x: Column) -> Column:
        fresh_part = F.concat(a["out"], F.substring(text, a["at"] + 1, x["s"] - a["at"]), F.lit(mark))
        return F.struct(F.greatest(a["at"], x["e"]).alias("at"), F.when(x["s"] >= a["at"], fresh_part).otherwise(a["out"]).alias("out"))

    cleaned = F.aggregate(every, start, cut, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    replaced = F.when(F.size(every) > 0, cleaned).otherwise(text)
    return found.withColumn(text_col, replaced).select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _counts() -> dict[tuple[int, str], int]:
    out: Counter = Counter()
    for token, label in default_samples():
        for a, b in zip(token, token[1:], strict=False):
            out[label, a + b] += 1
    return out


def spans_sql(text: str, rid: str, source: str) -> str:
    """CTEs that end in secret_all(rid, s, k, e, kind) for the texts of a table."""
    table = _table(_counts())
    llr = ", ".join(str(table[a + b]) for a in ALPHABET for b in ALPHABET)
    parts = []
    for k, (kind, pattern, group, least) in enumerate([*KINDS, ("markov", TOKEN, 0, LEAST_TOKEN)]):
        quoted = pattern.replace("'", "''")
        parts.append(f"""SELECT {rid} AS rid, {k} AS k, '{kind}' AS kind, {least} AS least, regexp_extract_all({text}, '{quoted}', 0) AS m,
          regexp_extract_all({text}, '{quoted}', {group}) AS g, string_split_regex({text}, '{quoted}') AS gap FROM {source}""")
    size = len(ALPHABET)
    return f"""secret_raw AS ({" UNION ALL ".join(parts)}),
secret_at AS (
  SELECT rid, k, kind, unnest(range(1, len(m) + 1)) AS i, m, g, gap, least FROM secret_raw
), secret_span AS (
  SELECT rid, k, kind, m[i] AS token, length(g[i]) >= least AS fits,
    CAST(list_sum(list_transform(gap[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s
  FROM secret_at
), secret_llr AS (SELECT [{llr}] AS w),
secret_all AS (
  SELECT rid, s, k, s + length(token) AS e, kind FROM secret_span, secret_llr
  WHERE fits AND (k < 3 OR (regexp_matches(token, '[0-9]') AND
    list_sum(list_transform(range(1, length(token)), lambda j: w[(instr('{ALPHABET}', token[j]) - 1) * {size} + instr('{ALPHABET}', token[j + 1])])) >= {FLOOR} * (length(token) - 1)))
)"""


OP8_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
{spans_sql("text", "rid", "d")},
secret_sum AS (
  SELECT rid, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS c, count(*) FILTER (k = 2) AS h,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 3) AS base,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS every FROM secret_all GROUP BY rid
)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans
FROM d LEFT JOIN secret_sum USING (rid)
"""
