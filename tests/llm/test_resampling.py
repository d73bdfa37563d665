import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from adsight.llm import importance_resampling as ir
from data import awkward, frame, text

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(whole):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (whole or "").translate(LOWER))
    return words, [" ".join(words[i:i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10000


def brute_force(rows, target):
    s = Counter(bucket(f) for _, t in rows for f in features(t)[1])
    t = Counter(bucket(f) for x in target for f in features(x)[1])
    every, wanted = sum(s.values()), sum(t.values())
    out = []
    for name, whole in rows:
        words, own = features(whole)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (every + 10000)
                                                / ((s[b] + 1) * (wanted + 10000))))
                     for b in map(bucket, own))
        h = int(hashlib.sha256(f"42:{'' if name is None else name}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([name, len(own), weight, score, None, len(words)])
    fit = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(fit[:5 * len(fit) // 100], 1):
        r[4] = place
    return [tuple(r[:5]) for r in out]


@pytest.mark.parametrize("size", [1, 3000, 1 << 19])
def test_equals_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(ir, "BATCH_BYTES", size)
    rows = awkward() + [(200 + i, text(i, 60)) for i in range(150)] + [
        (400, "Ärger ÉCOLE naïve 12ab_c-d 你好 x" * 9), (401, "a" * 5000), (402, text(3, 60)),
        (403, "don't stop"), (404, "a b c " * 400)]
    target = [text(i, 40) for i in range(5)] + ["", "Zwölf x y"]
    docs = frame(spark, rows).selectExpr("*", "1 as rank", "'x' as place", "2 as words")
    wanted = frame(spark, list(enumerate(target)) + [(99, None)])
    got = ir.resample(docs, wanted)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    have, want = sorted(map(tuple, got.collect()), key=key), sorted(brute_force(rows, target), key=key)
    assert have == want
    assert sum(r[4] is not None for r in have) == 5 * sum(
        len(features(t)[0]) >= 20 for _, t in rows) // 100


def test_ranks_over_many_ranges_with_ties(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(5, text(1, 40))] * 300 + [(i, text(i % 7, 40)) for i in range(300)] + [
            (None, text(2, 40))] * 40
        got = ir.resample(frame(spark, rows).repartition(9), frame(spark, rows[:3]), percent=90)
        ranked = sorted((r for r in got.collect() if r["rank"]), key=lambda r: r["rank"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert [r["rank"] for r in ranked] == list(range(1, 90 * 640 // 100 + 1))
    keys = [(-r["score"], r["doc_id"] is None, r["doc_id"] or 0) for r in ranked]
    assert keys == sorted(keys)


def test_empty_tables(spark):
    full, empty = frame(spark, [(1, text(1))]), frame(spark, [])
    assert ir.resample(empty, full).count() == 0
    only = ir.resample(full, empty).collect()
    assert len(only) == 1 and only[0]["rank"] is None and only[0]["n_features"] == 237


def test_equal_keys_with_other_bytes_get_their_own_slots():
    pick = random.Random(1)
    strings = [bytes(pick.choice(b"ab") for _ in range(pick.randint(1, 40))) for _ in range(900)]
    raw = b"".join(strings)
    lengths = np.array([len(s) for s in strings])
    starts = np.cumsum(lengths) - lengths
    for keys in (np.zeros(900, np.uint64), np.arange(900, dtype=np.uint64) % np.uint64(3),
                 np.array([xxhash.xxh64_intdigest(s) for s in strings], np.uint64)):
        # Equal strings always have equal keys.
        keys = np.array([keys[strings.index(s)] for s in strings], np.uint64)
        table = ir.InternTable(np.frombuffer(raw, np.uint8), 900)
        slots = table.intern(keys, starts, lengths)
        number = {}
        for s, slot in zip(strings, slots.tolist()):
            assert number.setdefault(s, slot) == slot
        assert len(set(number.values())) == len(number)
        want = Counter(strings)
        assert all(table.counts[slot] == want[s] for s, slot in number.items())


def test_hashes_equal_the_libraries():
    pick = np.random.default_rng(1)
    lanes = [pick.integers(0, 1 << 63, 50, np.uint64) * np.uint64(2) for _ in range(3)]
    for n in (1, 2, 3):
        want = [xxhash.xxh64_intdigest(np.array(row, "<u8").tobytes()) for row in zip(*lanes[:n])]
        assert ir.xxh64(lanes[:n]).tolist() == want
    parts = [(pick.bytes(a), pick.bytes(b)) for a in (1, 7, 300) for b in (1, 2, 127, 128, 129, 900)]
    crc = lambda k: np.array([zlib.crc32(p[k]) for p in parts], np.uint32)
    got = ir.joined_crc(crc(0), crc(1), np.array([len(b) for _, b in parts]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in parts]
