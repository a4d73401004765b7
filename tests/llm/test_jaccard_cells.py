"""The Jaccard join's candidates: cells of many nodes, and partners beyond the nearest."""

import random
import time
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.llm import jaccard_join as j

CELL = pa.schema([("sig", pa.int64()), ("i", pa.int64()), ("j", pa.int64()), ("side", pa.int32()), ("node", pa.int64()), ("root", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary())])


def node(rng, base, size, changed):
    s = base[:size].copy()
    for _ in range(changed):
        s[rng.randrange(size)] = rng.getrandbits(64)
    s = np.unique(s)
    return j.fingerprint(s), j.fingerprint(s) % 6, len(s), j.sketch(s)


def batches(rows, size):
    return iter([pa.RecordBatch.from_pylist([dict(zip(CELL.names, r, strict=True)) for r in rows[i : i + size]], schema=CELL) for i in range(0, len(rows), size)])


def plain_cells(rows, percent, width):
    cells, out = defaultdict(list), set()
    for r in rows:
        cells[r[:3]].append(r[3:])
    for cell in cells.values():
        for _, one, root, n, body in {x[1]: x for x in cell if x[0] == 1}.values():
            near = []
            for _, other, its, m, theirs in {x[1]: x for x in cell if x[0] == 0}.values():
                d = j._distance((n, body), (m, theirs), percent) if its != root and other != one else None
                near += [] if d is None else [(d, other)]
            out |= {(max(one, o), min(one, o), d) for d, o in sorted(near)[:width]}
    return out


@pytest.mark.parametrize("pairs,cell,held", [(7, 0, 1), (50, 30, 10), (1 << 18, 200, 1 << 15), (1 << 18, 1 << 14, 1 << 15)])
def test_cells_equal_the_plain_comparison(monkeypatch, pairs, cell, held):
    for name, value in (("PAIRS", pairs), ("CELL", cell), ("ROWS", held)):
        monkeypatch.setattr(j, name, value)
    rng = random.Random(cell)
    base = np.array([rng.getrandbits(64) for _ in range(300)], np.uint64)
    for percent in (1, 30, 80, 100):
        for width in (None, 1, 3):
            rows = []
            for sig in range(5):
                pool = [node(rng, base, size, rng.randint(0, max(1, size // 8))) for size in rng.choices([1, 5, 64, 65, 128, 150, 300], k=rng.randint(1, 20))]
                for p in [*pool, pool[0]]:
                    rows += [(sig, 0, 0, 0, *p), (sig, 0, 1, 0, *p)] + [(sig, 0, rng.randint(0, 1), 1, *p)] * (p[1] > 0)
            rows.sort(key=lambda r: (r[:3], rng.random()))
            got = {tuple(r) for b in j._cells(percent, width)(batches(rows, 13)) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)}
            assert got == plain_cells(rows, percent, width)


def test_a_large_cell_is_compared_in_blocks():
    rng = random.Random(1)
    base = np.array([rng.getrandbits(64) for _ in range(300)], np.uint64)
    nodes = [(x[0], k, *x[2:]) for k, x in enumerate(node(rng, base, 300, 60) for _ in range(2000))]
    rows = [(1, 0, 0, side, *x) for side in (0, 1) for x in nodes]
    began = time.process_time()
    sum(b.num_rows for b in j._cells(80, 2)(batches(rows, 10_000)))
    assert time.process_time() - began < 4  # 4 million pairs, one by one, take three times as long


def test_partners_beyond_the_nearest_are_tried(spark):
    """Round 1 links others and uses up the nearest; the link of 4 and 3, whose nearest are strangers, is still found."""
    sketches = {4: 0, 1: 1, 2: 2, 3: 0b11111000, 7: 0b11110000, 8: 0b11101000, 10: 0, 11: 1, 12: 3}
    truth = spark.createDataFrame([(4, 3), (12, 11)], "a long, b long")
    nodes = [(k, 0, 0, 64, v.to_bytes(8, "little")) for k, v in sketches.items()]
    join = object.__new__(j._Join)
    join.percent, join.shingle, join.block = 50, 3, 1024
    join.docs = join.nodes = spark.createDataFrame(nodes, "node long, k1 long, k2 long, n long, sketch binary")
    join.members = spark.createDataFrame([(5 if k < 10 else 6, k) for k in sketches], "sig long, node long")
    join.ties = spark.createDataFrame([(k, 1, 1) for k in (2, 3, 4, 7, 8)] + [(11, 10, 1), (12, 10, 2)], "a long, b long, distance long")
    join.ties = join.ties.where("a not in (3, 4)")  # as if the sketches had ruled these out
    join.verified = lambda pairs: pairs.join(truth, ["a", "b"])
    roots = {r.node: r.root for r in join.forest().collect()}
    assert roots[11] == roots[12] and roots[4] == roots[3]
    assert len(set(roots.values())) == len(sketches) - 2


@pytest.mark.parametrize("many", [1, 3000])
def test_texts_of_other_rows_stay_where_they_are(spark, many):
    rows = spark.range(20_000).select((F.col("id") * 7 - 50_000).alias("k1"), F.col("id").cast("string").alias("text"))
    keys = rows.where(f"cast(text as long) < {many}")
    got = {r.k1 for r in j._only(rows, keys.select("k1"), many).collect()}
    assert {r.k1 for r in keys.collect()} <= got and len(got) < many + 20_000 / 8


@pytest.fixture
def apart(spark):
    """Cells in tasks of their own."""
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("block,earlier,small", [(1024, 64, 0), (4, 64, 0), (4, 1, 0), (1024, 64, 16)])
def test_a_pair_of_many_signatures_is_made_once(spark, apart, monkeypatch, block, earlier, small):
    """Of all pairs of different roots that share a signature none is lost, and each is made in one of them."""
    monkeypatch.setattr(j, "EARLIER", earlier)
    monkeypatch.setattr(j, "SMALL", small)
    rng = random.Random(block)
    base = np.array([rng.getrandbits(64) for _ in range(200)], np.uint64)
    nodes = [node(rng, base, size, rng.randint(0, 30)) for size in rng.choices([64, 150, 200], k=40)]
    nodes = [(k, rng.choice([0, 0, 0, 1, k]), *x[2:]) for k, x in enumerate(nodes)]
    members = [(sig, k) for sig in range(30) for k in range(40) if rng.random() < (0.9, 0.5, 0.05)[sig % 3]]
    has = defaultdict(set)
    for sig, k in members:
        has[k].add(sig)
    truth = set()
    for a, r, n, s in nodes:
        for b, r2, m, t in nodes[:a]:
            d = j._distance((n, s), (m, t), 60) if r != r2 and has[a] & has[b] else None
            truth |= set() if d is None else {(a, b, d)}
    tables = spark.createDataFrame(members + members[:50], "sig long, node long"), spark.createDataFrame([(k, n, s) for k, _, n, s in nodes], "node long, n long, sketch binary")
    found = [tuple(r) for r in j._across(*tables, spark.createDataFrame([x[:2] for x in nodes], "node long, root long"), 60, block, None).collect()]
    assert len(truth) > 100 and set(found) == truth
    assert earlier == 1 or len(found) == len(truth) or small and len(found) < len(truth) * 1.5
    near = {tuple(r) for r in j._across(*tables, spark.createDataFrame([x[:2] for x in nodes], "node long, root long"), 60, block, 2).collect()}
    assert near and near <= truth
