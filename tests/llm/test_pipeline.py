"""The pipeline against a plain version of every stage, and its stages on odd tables."""

import re

import duckdb
import pandas as pd
import pytest

import corpus_pipeline as p
from spanloom.llm import mixing, quality, secret_scan

SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_quality(rows, model):
    """Rows whose score, tree by tree and node by node, is at least 0.3."""
    import numpy as np

    kept = []
    for r in rows:
        x, total = quality.statistics((r["text"] or "").encode()), model.base
        for f, t, v in zip(model.feature, model.threshold, model.value, strict=True):
            node = 0
            for _ in range(model.depth):
                node = 2 * node + (2 if x[f[node]] > t[node] else 1)
            total += v[node]
        if 1 / (1 + np.exp(-total)) >= 0.3:
            kept.append(r)
    return kept


def plain_dedup(rows, n=5, percent=80):
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (r["text"] or "").translate(LOW))
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    root = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and root[i] != root[j] and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                shared = len(a & b)
                if 100 * shared >= percent * (len(a) + len(b) - shared):
                    old, new = root[i], root[j]
                    root = [new if c == old else c for c in root]
    best = {}
    for i, r in enumerate(rows):
        if sets[i]:
            best[root[i]] = min(best.get(root[i], r["doc_id"]), r["doc_id"])
    return [r for i, r in enumerate(rows) if not sets[i] or best[root[i]] == r["doc_id"]]


def plain_decontamination(rows, items, n=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    windows = set()
    for t in items:
        w = words(t)
        windows |= {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    lengths = {len(x) for x in windows}
    return [r for r in rows if not any(tuple(w[i : i + k]) in windows for w in [words(r["text"])] for k in lengths for i in range(len(w) - k + 1))]


def plain_secrets(rows):
    table = secret_scan._table(secret_scan._counts())
    out = []
    for r in rows:
        text, spans = r["text"], []
        for _, pattern, group, least in secret_scan.KINDS:
            spans += [m.span() for m in re.finditer(pattern, text or "") if len(m.group(group)) >= least]
        for m in re.finditer(secret_scan.TOKEN, text or ""):
            t = m.group()
            if re.search("[0-9]", t) and sum(table[t[i : i + 2]] for i in range(len(t) - 1)) >= 0:
                spans.append(m.span())
        merged = []
        for s, e in sorted(spans):
            if merged and s < merged[-1][1]:
                merged[-1][1] = max(e, merged[-1][1])
            else:
                merged.append([s, e])
        for s, e in reversed(merged):
            text = text[:s] + "[SECRET]" + text[e:]
        out.append(r | {"text": text, "n_chars": None if text is None else len(text)})
    return out


def plain_mixing(rows):
    c = duckdb.connect()
    c.register("documents", pd.DataFrame([{k: r[k] for k in ("doc_id", "source", "text")} for r in rows]))
    return sorted((d, s, t, k) for d, s, _, t, k in c.execute(f"SELECT doc_id, size, source_size, round(target, 6), taken FROM ({mixing.OP4_SQL})").fetchall())


def test_pipeline_equals_the_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = [r.asDict() for r in docs.collect()]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    good = plain_quality(rows, quality.train(docs, labels))
    single = plain_dedup(good)
    clean = plain_decontamination(single, items)
    redacted = plain_secrets(clean)
    assert len(rows) > len(good) > len(single) > len(clean) > 0 and redacted != clean

    for (_, step), before, after in zip(p.STAGES, (rows, good, single, clean), (good, single, clean, redacted), strict=False):
        got = step(spark, spark.createDataFrame([tuple(r.values()) for r in before], docs.schema), SF)
        assert got.columns == docs.columns
        assert sorted(map(repr, (r.asDict() for r in got.collect()))) == sorted(map(repr, after))
    mixed = [(r.doc_id, r["size"], round(r.target, 6), r.taken) for r in p.run(spark, SF).collect()]
    assert sorted(mixed) == plain_mixing(redacted)


ODD = "doc_id long, text string, lang string, source string, n_chars long, score string, k long, found string, row string"


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_odd_tables(spark, stage):
    rows = [(None, None, None, None, None, None, None, None, None), (1, "", None, "s", 0, "x", 1, "f", "r"), (1, "", None, "s", 0, "x", 1, "f", "r"), (None, "a b c d e f g h i j k", "en", None, 21, None, None, None, None)]
    rows += [(7, "long " * 50_000, "en", "s", 250_000, "x", None, None, None)]
    docs = spark.createDataFrame(rows, ODD)
    step = p.STAGES[stage][1]
    out = step(spark, docs, SF)
    assert out.count() <= len(rows)
    assert stage == 4 or out.columns == docs.columns
    assert step(spark, docs.limit(0), SF).count() == 0


CLASH = ["_key", "_k", "_row", "k1", "k2", "alone", "row", "score", "_quality", "every", "base", "hash", "pick"]


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_clashing_columns(spark, stage):
    text = " ".join(f"word{i}" for i in range(30))
    rows = [(1, text, "en", "s", 10, *CLASH), (2, "other " + text[::-1], "en", "s", 10, *CLASH)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH))
    out = p.STAGES[stage][1](spark, docs, SF)
    assert out.columns == docs.columns and all(list(r)[5:] == CLASH for r in out.collect())


def test_decontamination_keeps_clean_rows_of_the_same_id(spark):
    item = next(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if r.text and len(r.text.split()) >= 10)
    rows = [(1, item), (1, "zq zr zs"), (None, "before " + item + " after"), (None, "zq zt"), (None, None), (2, "zq"), (2, "zq")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in p.decontamination_stage(spark, docs, SF).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, [rows[1], *rows[3:]]))


def test_dedup_knows_groups_with_shared_or_null_ids(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(1, a), (2, a + " end"), (1, b), (3, b + " end"), (1, "zq zr zs"), (None, c), (None, c + " end"), (None, d), (5, d + " end"), (1, ""), (1, ""), (None, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in p.dedup_stage(spark, docs, SF).collect()]
    null = [r for r in got if r[0] is None and r[1]]
    assert len(null) == 1 and null[0] in rows[5:7]
    assert sorted(map(repr, [r for r in got if r not in null])) == sorted(map(repr, [rows[0], rows[2], rows[4], rows[8], *rows[9:]]))
