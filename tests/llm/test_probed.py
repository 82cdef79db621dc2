"""Recall of op1 on a table that is really cut into lists."""

from collections import defaultdict

import numpy as np
from keyspan.llm import ann
from pyspark.sql import functions as F


def test_recall_where_lists_are_probed(spark, monkeypatch):
    u = np.random.default_rng(5).normal(size=(4000, 64)).astype(np.float32)
    cut = []
    monkeypatch.setattr(ann, "kmeans", lambda x, lists, seed, real=ann.kmeans: cut.append(lists) or real(x, lists, seed))
    found = ann.nearest(spark.createDataFrame([(i, v) for i, v in enumerate(u.tolist())], "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).collect()
    assert cut[0] > 10
    by = defaultdict(set)
    for r in found:
        by[r["query_id"]].add(r["vec_id"])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    hits = 0
    for i in range(0, 4000, 50):
        scores = u @ u[i]
        scores[i] = -9
        hits += len(by[i] & set(np.argsort(-scores)[:5].tolist()))
    assert hits >= 0.85 * 400, hits
