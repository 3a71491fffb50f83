import hashlib
import math
import random

import duckdb
import numpy as np
from pyspark.sql import types as T

from twintally.llm import codes
from twintally.llm.queries import QUERIES, SQL

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("label", T.IntegerType())])
SMALL = "/root/testdata/sf0.001"


def brute(rows, parts=8, n=16, rounds=6):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ints = [[math.floor(4096 * x) for x in r[1]] for r in kept]
    width = len(ints[0]) // parts
    piece = lambda v, p: v[p * width : (p + 1) * width]
    books = [[list(piece(v, p)) for v in ints[:n]] for p in range(parts)]
    apart = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))
    near = lambda v, p: min((apart(piece(v, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        found = [[near(v, p)[1] for v in ints] for p in range(parts)]
        for p in range(parts):
            for k in range(len(books[p])):
                own = [piece(v, p) for v, e in zip(ints, found[p]) if e == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = [(r[0], "".join(f"{near(v, p)[1]:02x}" for p in range(parts)), sum(near(v, p)[0] for p in range(parts)), r[2]) for r, v in zip(kept, ints)]
    sums = {label: sum(r[2] for r in out if r[3] == label) for _, _, _, label in out}
    return [(*r[:3], sums[r[3]], digest) for r in out]


def test_result_is_that_of_brute_force(spark):
    rng = random.Random(1)
    some = lambda: [round(rng.uniform(-1, 1), rng.choice([0, 1, 6])) for _ in range(16)]
    rows = [(k, some(), rng.choice([0, 1, 1, 1, None])) for k in range(200)]
    rows += [(300, None, 1), (301, [*some()[:-1], None], 1), (302, [*some()[:-1], float("nan")], 1), (303, [*some()[:-1], float("-inf")], None)]
    rows += [rows[5], (7, some(), 2), (None, some(), 2), (None, None, None)]
    table = spark.createDataFrame(rows, VECTORS).selectExpr("*", "'x' AS code", "1 AS id", "2 AS error", "3 AS vector")
    out = codes.compress(table)
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, brute(rows)))


def test_nearest_entries_are_those_of_all_distances():
    rng = np.random.default_rng(2)
    for n, width in [(1, 3), (16, 8), (64, 2), (70, 4), (130, 1), (5, 0)]:
        for spread in (3, 1000, 1 << 27):
            entries, points = (rng.integers(-spread, spread, (k, width)) for k in (n, 300))
            index, best = codes.Codebook(entries).nearest(points)
            every = ((points[:, None] - entries) ** 2).sum(axis=2)
            assert (index == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()


def test_candidates_are_the_entries_in_all_ranges():
    rng = np.random.default_rng(3)
    entries, points = rng.integers(-9, 9, (70, 3)), rng.integers(-9, 9, (50, 3))
    radius = rng.integers(0, 9, 50)
    masks = codes.Codebook(entries).candidates(points, radius)
    found = np.array([[bool(int(m[e // 64]) >> (e % 64) & 1) for e in range(70)] for m in masks])
    assert (found == (abs(points[:, None] - entries) <= radius[:, None, None]).all(axis=2)).all()


def test_few_vectors_odd_lengths_and_large_components(spark):
    rows = [(1, [0.5] * 10, 1), (2, [1e300] * 10, 1), (3, [0.5] * 9, None), (4, [], None), (5, [-1e300] * 10, 1)]
    out = {r["vec_id"]: r for r in codes.compress(spark.createDataFrame(rows, VECTORS)).collect()}
    assert len(out) == 5 and out[3]["code"] is None and out[4]["error"] is None and out[3]["label_error"] is None
    assert out[1]["error"] == out[2]["error"] == out[5]["error"] == 0 and out[1]["label_error"] == 0
    assert codes.compress(spark.createDataFrame([], VECTORS)).collect() == []
    assert [r["code"] for r in codes.compress(spark.createDataFrame([(1, [], 1)], VECTORS)).collect()] == ["00" * 8]


def test_query_is_that_of_its_sql(spark):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SMALL}/embeddings.parquet'")
    expected = connection.execute(SQL["op12_vector_codes"])
    columns = [d[0] for d in expected.description]
    df = QUERIES["op12_vector_codes"](spark, SMALL)
    assert sorted(columns) == sorted(df.columns)
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(expected.fetchall())
