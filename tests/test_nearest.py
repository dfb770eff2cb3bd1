"""Nearest vectors against all comparisons."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.plans import nearest as N


def plain(rows, k):
    want = {}
    for q, label, v in rows:
        if q % 4 == 0:
            own = [(-round(float(np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w))), 6), i) for i, other, w in rows if other == label and i != q]
            want[q] = [i for _, i in sorted(own)[:k]]
    return {(q, place, other) for q, found in want.items() for place, other in enumerate(found, 1)}


@pytest.mark.parametrize("spread,size,block", [(0.05, 10, 4096), (1.0, 10, 7), (0.3, 500, 50)])
def test_nearest(spark, monkeypatch, spread, size, block):
    monkeypatch.setattr(N, "LIST_SIZE", size)
    monkeypatch.setattr(N, "BLOCK", block)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8))
    rows = [(n, n % 3 if n > 5 else 9 + n, (centres[n % 12] + rng.normal(size=8) * spread).round(3).tolist()) for n in range(400)]
    rows += [(500 + n, 0, rows[6][2]) for n in range(12)]  # equal vectors: ties go by id
    frame = spark.createDataFrame(rows, "id long, label int, v array<double>")
    got = N.nearest(frame, frame.where("id % 4 = 0"), 3)
    assert {(r.q, r.place, r.other) for r in got.collect()} == plain(rows, 3)


def test_tight_clusters(spark, monkeypatch):
    """Lists far from a query hold nothing for it, and leaving them out changes nothing."""
    monkeypatch.setattr(N, "LIST_SIZE", 20)
    rng = np.random.default_rng(5)
    centres = np.eye(16)
    rows = [(n, 0, (centres[n % 16] + rng.normal(size=16) * 0.01).tolist()) for n in range(640)]
    frame = spark.createDataFrame(rows, "id long, label int, v array<double>")
    got = N.nearest(frame, frame.where("id % 4 = 0"), 3)
    assert {(r.q, r.place, r.other) for r in got.collect()} == plain(rows, 3)


def test_no_vectors(spark):
    frame = spark.createDataFrame([], "id long, label int, v array<double>")
    assert N.nearest(frame, frame, 3).where(F.lit(True)).count() == 0
