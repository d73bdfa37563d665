from collections import defaultdict

import numpy as np
import pytest

from adsight.llm import hnsw as H


def slow(rows, every=20, k=20):
    fine = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None
            and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in fine:
        if i % every == 0:
            scored = {(-float(v @ w), j) for j, w in fine if j != i and len(w) == len(v)}
            out[i] = [(j, -s) for s, j in sorted(scored)[:k]]
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows],
                                 "vec_id bigint, embedding array<float>, shard int, members string")


def vectors(n, seed=1, width=16):
    pick = np.random.default_rng(seed)
    centres = pick.normal(size=(8, width))
    return [(i, [float(np.float32(x)) for x in centres[i % 8] + pick.normal(size=width)])
            for i in range(n)]


@pytest.mark.parametrize("shard", [8192, 300])
def test_recall_and_exact_scores(spark, monkeypatch, shard):
    monkeypatch.setattr(H, "SHARD", shard)
    rows = vectors(1500)
    got = defaultdict(list)
    for r in H.neighbours(table(spark, rows)).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    want, hits, all_ = slow(rows), 0, 0
    assert got.keys() == want.keys()
    known = dict(rows)
    for i, best in want.items():
        assert got[i] == sorted(got[i], key=lambda x: (-x[1], x[0]))
        for j, s in got[i]:
            assert s == pytest.approx(float(np.dot(known[i], known[j])), rel=1e-12)
        hits += len({j for j, _ in best} & {j for j, _ in got[i]})
        all_ += len(best)
    assert hits / all_ >= 0.95


def test_awkward_vectors(spark):
    one = [1.0, 0.0, 0.5]
    rows = [(i, one) for i in range(0, 100, 2)] + [
        (1, None), (3, [0.0, 0.0, 0.0]), (5, [1.0, None, 0.0]), (7, [float("nan"), 1.0, 1.0]),
        (9, [float("inf"), 1.0, 1.0]), (11, [-0.0, 0.0, 2.0]), (13, [3.0, 1.0, 1.0]),
        (None, one), (200, [1.0, 2.0]), (201, [5.0, 5.0]), (202, [5.0, 5.0]), (203, []),
        (13, [3.0, 1.0, 1.0]), (20, one)]
    got = defaultdict(list)
    for r in H.neighbours(table(spark, rows)).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], pytest.approx(r["score"])))
    assert got == slow(rows)


def test_few_and_no_vectors(spark):
    assert H.neighbours(table(spark, [])).count() == 0
    assert H.neighbours(table(spark, [(0, [1.0])])).count() == 0
    assert [tuple(r) for r in H.neighbours(table(spark, [(0, [1.0]), (3, [2.0])])).collect()] == [
        (0, 1, 3, 2.0)]
    assert H.neighbours(table(spark, [(1, [1.0]), (3, [2.0])])).count() == 0


def test_flat_arrays_come_back(spark):
    rows = vectors(200)
    index = H.build_index(H.distinct_vectors(table(spark, rows), "vec_id", "embedding", 5)).collect()
    shard = H.Shard(index[0].asDict())
    assert len(index) == 1 and len(shard.vectors) == 200
    assert shard.graph.links[0].max() < 200 and (shard.graph.links[0][:, 0] >= 0).all()
