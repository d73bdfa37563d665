import random

import pytest

import corpus_pipeline as P
from adsight.llm import simhash_dedup
from data import awkward, frame, text

KINDS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def shingles(value, k=5):
    words = (value or "").encode().lower().split()
    return {tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def test_similar_documents_are_grouped(spark):
    pick = random.Random(7)
    rows = awkward()
    for family in range(12):
        base = text(3000 + family, pick.choice([40, 90, 300, 1200]), 4)
        rows.append((5000 + 100 * family, base))
        for copy in range(1, 9):
            words = base.split(" ")
            for _ in range(max(1, len(words) // 150)):
                words[pick.randrange(len(words))] = f"neu{copy}"
            rows.append((5000 + 100 * family + copy, " ".join(words)))
    kept = simhash_dedup.distinct_documents(frame(spark, rows))
    assert kept.columns == frame(spark, []).columns
    got = sorted((r["doc_id"] for r in kept.collect()), key=lambda i: (i is None, i))
    sets = {i: shingles(t) for i, t in rows if i is not None}
    close = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    want = [i for i in sorted(sets) if i < 5000 and not any(
        close(sets[i], sets[j]) for j in sets if j < i)] + [5000 + 100 * f for f in range(12)]
    # A copy below the bound to every other one of its family stays as well.
    assert set(want) - {9} <= set(got)
    linked = lambda i: any(close(sets[i], sets[j]) for j in sets if j < i)
    assert not [i for i in got if i is not None and i >= 5000 and linked(i)]
    assert simhash_dedup.distinct_documents(frame(spark, [])).count() == 0


def test_pairs_inside_a_family_of_boilerplate(spark):
    """All texts share 85 % of their shingles; each planted pair has a similarity of 0.818."""
    shared = " ".join(f"common{i}" for i in range(174))      # 170 shingles of 200
    rows = []
    for i in range(300):
        both = " ".join(f"pair{i}x{k}" for k in range(10))
        rows += [(2 * i + side, f"{shared} {both} " + " ".join(
            f"own{2 * i + side}x{k}" for k in range(20))) for side in (0, 1)]
    sets = [shingles(t) for _, t in rows[:4]]
    assert len(sets[0]) == 200 and len(sets[0] & sets[1]) == 180 and len(sets[0] & sets[2]) == 170
    kept = simhash_dedup.distinct_documents(frame(spark, rows)).collect()
    assert sorted(r["doc_id"] for r in kept) == [2 * i for i in range(300)]


@pytest.mark.parametrize("share", [0.3, 0.75, 0.88, 0.93])
def test_rare_pairs_hold_every_similar_pair(spark, share):
    pick = random.Random(share)
    pool = [pick.getrandbits(64) - (1 << 63) for _ in range(60)]
    sets = []
    for i in range(150):
        n = pick.randint(20, 60)
        own = set(pool[:int(n * share)]) | {pick.getrandbits(64) - (1 << 63) for _ in range(
            n - int(n * share))}
        sets.append(own if i % 3 else set(pick.sample(sorted(sets[-1]), int(
            len(sets[-1]) * 0.9))) if sets else own)
    rows = [(str(i).encode(), i % 140, sorted(s)) for i, s in enumerate(sets)]
    got = {frozenset((int(r["u"]), int(r["v"]))) for r in simhash_dedup._rare_pairs(
        spark.createDataFrame(rows, "key binary, root bigint, set array<bigint>"), 0.8).collect()}
    want = {frozenset((i, j)) for i, a in enumerate(sets) for j, b in enumerate(sets[:i])
            if i % 140 != j % 140 and len(a & b) >= 0.8 * len(a | b)}
    assert want and want <= got


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, t, "en", f"src{(i or 0) % 3}", len(t or "")) for i, t in awkward()]
    item = text(4000, 40, 1)
    rows += [(600, text(601, 90) + "\n" + item, "en", "src0", 0)]
    spark.createDataFrame(rows, KINDS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(
        f"{path}/benchmark.parquet")
    return path


def test_stages_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == [f.split()[0] for f in KINDS.split(", ")]
        seen[name] = [r["doc_id"] for r in docs.collect()]
        docs = P.staged(docs, name)
    ids = [i for i, t in awkward() if t and any(c.isalpha() for c in t)] + [600]
    assert sorted(map(str, seen["language_id"])) == sorted(map(str, ids))
    assert sorted(map(str, seen["line_dedup"])) == sorted(map(str, ids))
    assert {1, 9, 10, 20, 31} <= set(seen["near_dedup"])
    assert len(seen["near_dedup"]) < len(seen["line_dedup"])
    assert set(seen["near_dedup"]) - set(seen["decontamination"]) == {600}
    packed = P.run(spark, folder)
    assert {r["doc_id"] for r in packed.collect()} == set(seen["decontamination"])


def test_stages_take_empty_tables(spark, folder):
    docs = spark.createDataFrame([], KINDS)
    for _, stage in P.STAGES:
        assert stage(spark, docs, folder).count() == 0
