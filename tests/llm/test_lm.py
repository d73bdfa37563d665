import math
import zlib
from collections import Counter

import pytest

from adsight.llm import backoff_lm as B
from data import awkward, frame


def slow(rows, folds=7, test_fold=2):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % folds == test_fold
    tokens = lambda t: (t or "").encode().lower().split() + [None]
    one, two = Counter(), Counter()
    for i, t in rows:
        if not held(i):
            own = tokens(t)
            one.update(own)
            two.update(zip([None] + own, own))
    n, v = sum(one.values()), len(one)
    unseen = max(1, sum(c == 1 for c in one.values()))
    single = lambda w: (one[w] or unseen) / (n + unseen)
    out = []
    for i, t in rows:
        own = tokens(t)
        total = sum(math.log10((two[u, w] + B.PRIOR * single(w)) / (one[u] + B.PRIOR))
                    for u, w in zip([None] + own, own))
        base = sum(math.log10((one[w] + 1) / (n + v + 1)) for w in own)
        out.append((i, held(i), len(own), sum(one[w] > 0 for w in own), n, base, total))
    return out


@pytest.mark.parametrize("block,part", [(4 << 20, 16 << 20), (300, 2000)])
def test_same_as_brute_force(spark, monkeypatch, block, part):
    monkeypatch.setattr(B, "BLOCK_BYTES", block)
    monkeypatch.setattr(B, "PART_BYTES", part)
    rows = awkward()
    got = sorted((tuple(r) for r in B.score(frame(spark, rows)).collect()), key=str)
    want = sorted(slow(rows), key=str)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want):
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)
    assert any(r[1] for r in got)


def test_probabilities_add_up_to_one():
    block = B.Block([b"a b a c", b"b b"])
    single = block.place(1, block.counts(B.np.ones(2, bool))[1][1].astype(int))
    double = block.place(2, block.counts(B.np.ones(2, bool))[2][1].astype(int))
    model = B.Automaton(block, single, double, int(single.sum()), int((single == 1).sum()))
    unseen = (single == 1).sum() / (single.sum() + (single == 1).sum())
    for state in range(block.words):
        total = sum(10 ** model.arcs.get(state * block.words + w, model.fail[state] + model.root[w])
                    for w in range(block.words))
        assert total + 10 ** model.fail[state] * unseen == pytest.approx(1)


def test_empty_tables_and_nothing_to_learn(spark):
    assert B.score(frame(spark, [])).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = B.score(frame(spark, [(held, "a b")])).first()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (3, 0, 0)
    assert row["base_score"] == 0 and row["score"] == pytest.approx(0)
