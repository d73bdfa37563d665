import random

import pytest

from adsight.llm import decontaminate as D
from data import awkward, frame, text


def grams(words, k=5):
    return [tuple(words[i:i + k]) for i in range(len(words) - k + 1)]


def overlap(a, b):
    both = sum(min(a.count(x), b.count(x)) for x in set(a))
    return 2 * both / (len(a) + len(b)) if a or b else 0


def slow_best(doc, item):
    words, own = doc.lower().split(), item.lower().split()
    k = min(5, len(own))
    found = [overlap(grams(own, k), grams(words[s:s + len(own)], k))
             for s in range(max(1, len(words) - len(own) + 1))]
    return max(found, default=0)


def table(spark, items):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in items],
                                 "item_id bigint, text string, k bigint, own string")


@pytest.mark.parametrize("rows_broadcast", [500_000, 0])
def test_same_as_brute_force(spark, monkeypatch, rows_broadcast):
    monkeypatch.setattr(D, "BROADCAST_ROWS", rows_broadcast)
    pick = random.Random(4)
    items = [(i, text(1000 + i, pick.randint(14, 59), 1)) for i in range(8)]
    items += [(8, items[0][1]), (None, items[1][1]), (20, None), (21, " "), (22, "zwei worte"),
              (23, "a b c a b c a b c a b c a b c")]
    rows = awkward()
    for i in range(40):
        words = items[i % 8][1].split()
        for _ in range(i // 8):
            at = pick.randrange(len(words))
            words[at:at + 1] = pick.choice([[], ["neu"], [words[at], "und"]])
        rows.append((300 + i, text(i, 100) + "\n" + " ".join(words) + " " + text(i + 60, 30)))
    rows += [(400, items[2][1]), (401, "hier Zwei\nworte dort"), (402, "x a b c a b c a b c a b c y"),
             (403, items[3][1].upper())]
    # Halves swapped, sentences moved, shingles repeated: no start lines up with the item.
    for i in range(8):
        own = items[i][1].split()
        half, third = len(own) // 2, len(own) // 3
        rows += [(500 + i, " ".join(own[half:] + own[:half]) + " " + text(700 + i, 40)),
                 (510 + i, text(720 + i, 40) + " " + " ".join(
                     own[third:2 * third] + own[:third] + own[2 * third:])),
                 (520 + i, " ".join(own[:third] * 3 + own[third:]))]
    rows.append((530, " ".join(["a b c"] * 12)))
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in D.leaks(
        frame(spark, rows), table(spark, items)).collect()}
    want = {}
    for i, t in rows:
        for j, item in items:
            if item and item.split():
                value = slow_best(t or "", item)
                if value >= 0.8:
                    want[i, j] = max(value, want.get((i, j), 0))
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)
    assert {j for i, j in got if i == 300} == {0, 8}
    assert sum(500 <= i < 520 for i, _ in got if i) >= 5


def test_clean_documents_and_empty_tables(spark):
    rows, items = awkward(), [(1, text(2000, 30, 1))]
    assert D.leaks(frame(spark, rows), table(spark, items)).count() == 0
    assert D.leaks(frame(spark, []), table(spark, items)).count() == 0
    empty = D.leaks(frame(spark, rows), table(spark, []))
    assert empty.count() == 0 and "similarity" in empty.columns


def test_blocks_find_everything_within_the_radius(spark):
    from pyspark.sql import functions as F
    pick = random.Random(2)
    pairs = []
    for _ in range(300):
        a = pick.getrandbits(64)
        b = a
        for bit in pick.sample(range(64), pick.randint(0, 24)):
            b ^= 1 << bit
        pairs.append((a - (1 << 63), (b - (1 << 63))))
    frame_ = spark.createDataFrame(pairs, "a bigint, b bigint")
    shared = F.size(F.array_intersect(D.blocks(F.col("a"), 24), D.blocks(F.col("b"), 24)))
    assert frame_.filter(shared > 0).count() == 300
