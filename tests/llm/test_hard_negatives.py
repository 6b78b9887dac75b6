"""Hard negatives against all pairs in Python's whole numbers."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditlake.llm import hard_negatives
from auditlake.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>, label int, row long, rank int, q string"


def brute(rows, positives=5, negatives=3):
    """Counts of (anchor, positive, rank, negative, positive score, negative score); each row is its own."""
    v = []
    for i, x, label in rows:
        if i is None or label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        v.append((i, label, [math.floor(256 * c) for c in x]))
    out = []
    for n, (i, label, q) in enumerate(v):
        if i % 50:
            continue
        scored = [(-sum(a * b for a, b in zip(q, p)), j, other) for m, (j, other, p) in enumerate(v) if m != n and len(p) == len(q)]
        for s, j, _ in sorted(x for x in scored if x[2] == label)[:positives]:
            fits = sorted(x for x in scored if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s)
            out += [(i, j, rank, other, -s, -t) for rank, (t, other, _) in enumerate(fits[:negatives], 1)]
    return Counter(out)


def mined(df):
    got = hard_negatives.mine_negatives(df, lambda key: key % 50 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return Counter(map(tuple, got.collect()))


def rows_of(seed, n, dims, labels):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, dims))
    x = centres[rng.integers(0, 6, n)] * rng.uniform(0, 1, (n, 1)) + 0.5 * rng.standard_normal((n, dims))
    return [(i, v.tolist(), int(rng.integers(0, labels))) for i, v in enumerate(x)]


@pytest.mark.parametrize(("dims", "n", "labels"), [(1, 300, 2), (3, 400, 3), (24, 700, 5), (130, 300, 2)])
def test_all_pairs(spark, monkeypatch, dims, n, labels):
    monkeypatch.setattr(hard_negatives, "ANCHORS", 4)  # several tiles, lanes and strips
    monkeypatch.setattr(hard_negatives, "LANE_ROWS", (40, 100))
    monkeypatch.setattr(hard_negatives, "FIRST_STRIP", 7)
    rows = rows_of(dims, n, dims, labels)
    want = brute(rows)
    assert mined(spark.createDataFrame([(*r, 1, 2, "q") for r in rows], SCHEMA)) == want and sum(want.values()) > 10


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = rows_of(9, 200, 4, 2)
    rows += [(50, rows[3][1], 1), (50, rows[3][1], 1), (7, rows[3][1], 1), (7, rows[3][1], 1)]  # repeated keys and rows
    rows += [(400 + i, [1.0, 0.5, 0.25, 0.0], i % 2) for i in range(8)]  # ties
    rows += [(None, [1.0] * 4, 1), (450, None, 1), (451, [1.0, None, 1.0, 1.0], 1), (452, [1.0, nan, 1.0, 1.0], 1), (453, [1.0, inf, 1.0, 1.0], 0), (454, [1.0] * 4, None)]
    rows += [(500, [0.0] * 4, 1), (501, [0.0] * 4, 0), (502, [-1.0] * 4, 1), (600, [1.0, 2.0], 1), (601, [1.0, 1.5], 1), (602, [0.5, 1.0], 0)]
    rows += [(650, [], 1), (651, [], 1), (652, [], 0), (700, [5.0] * 7, 3), (750, [0.001, -0.001, 300.0, -3000.0], 1)]
    assert mined(spark.createDataFrame([(*r, 1, 2, "q") for r in rows], SCHEMA)) == brute(rows)
    assert not mined(spark.createDataFrame([], SCHEMA))


def test_long_vectors(spark):
    """Scores up to the largest long are exact; longer vectors take no part."""
    rng = random.Random(5)
    rows = [(i, [rng.choice([1, 0.97, 0.6]) * 5e6, rng.uniform(-1e6, 1e6), rng.uniform(-10, 10)], i % 2) for i in range(120)]
    longer = [(1000, [1e7, 0.0, 0.0], 0), (1001, [1e300, 0.0, 0.0], 1)]
    want = brute(rows)
    assert mined(spark.createDataFrame([(*r, 1, 2, "q") for r in rows + longer], SCHEMA)) == want and max(x[4] for x in want) > 2**59


def test_text_labels(spark):
    rows = rows_of(3, 300, 8, 3)
    df = spark.createDataFrame([(*r, 1, 2, "q") for r in rows], SCHEMA).withColumn("label", F.concat(F.lit("label "), F.col("label")))
    assert mined(df) == brute(rows)


def test_pairs_are_discarded_early():
    rng = np.random.default_rng(1)
    q = np.floor(256 * rng.standard_normal((400, 32)) * np.geomspace(1, 0.01, 32)).astype(np.int32)
    block = hard_negatives.Block(q[:20])
    scores = q[:20].astype(np.int64) @ q.T.astype(np.int64)
    low = np.sort(scores, axis=1)[:, -5]
    a, x, s = block.survivors(q, low, None, np.ones((20, 400), bool))
    assert (s == scores[a, x]).all() and set(zip(*np.nonzero(scores >= low[:, None]))) <= set(zip(a, x)) and len(a) < 300


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in table]
    assert Counter(map(tuple, QUERIES["op12_hard_negatives"](spark, sf).collect())) == brute(rows)
