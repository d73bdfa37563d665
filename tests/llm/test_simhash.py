import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from adsight.llm import simhash_dedup as S
from adsight.llm.graph import components
from data import awkward, frame, text


def slow_print(value, k=3):
    words = (value or "").encode().lower().split()
    grams = [words[i:i + k] for i in range(len(words) - k + 1)] if len(words) >= k else (
        [words] if words else [])
    hashes = [xxhash.xxh64(b" ".join(g), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64)
               if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_components(items, near):
    parent = {i: i for i in items}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(items, 2):
        if near(a, b):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in items}


def test_components(spark):
    pick = random.Random(5)
    links = [(pick.randint(0, 300), pick.randint(0, 300)) for _ in range(220)]
    links += [(i, i + 1) for i in range(1000, 1060)] + [(7, 7)]
    got = dict(components(spark.createDataFrame(links, "u bigint, v bigint")).collect())
    nodes = sorted({x for a, b in links if a != b for x in (a, b)})
    edges = {frozenset(x) for x in links}
    assert got == slow_components(nodes, lambda a, b: frozenset((a, b)) in edges)
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_near_duplicates_match_brute_force(spark):
    rows = awkward()
    got = S.near_duplicates(frame(spark, rows)).collect()
    prints = {r: slow_print(r[1]) for r in set(rows)}
    roots = slow_components(sorted(set(prints.values())),
                            lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for (i, _), p in prints.items():
        if i is not None:
            least[roots[p]] = min(i, least.get(roots[p], i))
    want = sorted((str(i), f"{prints[i, t]:016x}", least.get(roots[prints[i, t]])) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in got) == want
    assert S.near_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize("radius", [1, 2])
@pytest.mark.parametrize("listed", [64, 2])
def test_links_keep_components(spark, monkeypatch, radius, listed):
    """Both the listed and the full buckets give the components of all close pairs."""
    monkeypatch.setattr(S, "LISTED", listed)
    pick = random.Random(radius)
    prints = {0, -1, 1 << 62}
    while len(prints) < 300:
        fp = pick.choice(sorted(prints)) if pick.random() < 0.8 else pick.getrandbits(64) - (1 << 63)
        for _ in range(pick.randint(0, 3)):
            fp ^= 1 << pick.randint(0, 62)
        prints.add(fp)
    links = S.near_links(spark.createDataFrame([(p,) for p in prints], "fp bigint"), radius)
    pairs = [tuple(r) for r in links.collect()]
    close = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= radius
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 2 for a, b in pairs)
    joined = {frozenset(p) for p in pairs}
    if radius == 2:
        assert slow_components(sorted(prints), lambda a, b: frozenset((a, b)) in joined) == (
            slow_components(sorted(prints), close))


def test_long_text_is_counted_whole(spark, monkeypatch):
    monkeypatch.setattr(S, "STEP", 7)
    long = text(8, 400)
    changed = long + " " + text(9, 400)
    for value in (long, changed):
        assert S.simhash(value.encode(), 3) % (1 << 64) == slow_print(value)


def test_bitmaps_never_differ_more_than_sets():
    pick = np.random.default_rng(3)
    for size in (1, 5, 60, 900):
        a = pick.integers(-2**62, 2**62, size)
        b = np.concatenate((a[size // 4:], pick.integers(-2**62, 2**62, size // 5)))
        differ = sum((int(x) ^ int(y)).bit_count() if (x ^ y) >= 0 else 64 - (~(int(x) ^ int(y))).bit_count()
                     for x, y in zip(S.parity_map(a), S.parity_map(b)))
        assert differ <= len(set(a.tolist()) ^ set(b.tolist()))


def test_pairs_of_one_large_shingle_group(spark):
    """2000 texts share most shingles; exactly those at the bound are paired, the rest are pruned."""
    pick = np.random.default_rng(5)
    base = pick.integers(0, 2**62, 60)
    own = pick.integers(0, 2**62, (2000, 16))
    sets = [sorted({*base.tolist(), *(own[i].tolist() if i % 400 else own[0, :6].tolist() + [i])})
            for i in range(2000)]
    frame_of = spark.createDataFrame([(bytes([i // 256, i % 256]), s) for i, s in enumerate(sets)],
                                     "key binary, set array<bigint>").withColumn(
        "root", F.lit(None).cast("binary"))
    number = lambda k: k[0] * 256 + k[1]
    got = {(number(r["u"]), number(r["v"])) for r in S._rare_pairs(frame_of, 0.8).collect()}
    close = {(i, j) for i in range(0, 2000, 400) for j in range(i + 400, 2000, 400)}
    assert close <= got and len(got) < 20_000
