import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from adsight.llm import token_alignment as ta
from data import awkward, frame, text
from test_token_counts import strange


@pytest.fixture(scope="module")
def libraries():
    first = Tokenizer.from_file(ta.FIRST)
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=ta.SECOND)


def slow(libraries, whole):
    """a ids, b ids, groups, links of one text by comparing all byte ranges; None: no tokens."""
    first, second = libraries
    letters = ta._byte_letters()
    if not whole:
        return None
    a = first.encode(" " + whole, add_special_tokens=False).ids
    b = second.encode(whole)
    a_bytes = [bytes(letters[c] for c in first.id_to_token(i)) for i in a]
    b_bytes = [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i)
               else second.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + whole).encode():
        return None
    spans = []
    for parts in (a_bytes, b_bytes):
        ends = np.cumsum([len(p) for p in parts]).tolist()
        spans.append(list(zip([0] + ends, ends)))
    links = [(i, j, min(e, f) - max(s, t)) for i, (s, e) in enumerate(spans[0])
             for j, (t, f) in enumerate(spans[1]) if s < f and t < e]
    cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
    group = [[sum(c < e for c in cuts) for _, e in own] for own in spans]
    return a, b, group, links, len(cuts)


def shown(a, b, group, count):
    return ";".join(",".join(str(i) for i, g in zip(a, group[0]) if g == k) + "|"
                    + ",".join(str(i) for i, g in zip(b, group[1]) if g == k)
                    for k in range(count))


def rows_of_the_tests():
    return awkward()[:11] + awkward()[13:16] + [(100, "a▁b"), (101, "<|endoftext|> <s> x"), (
        102, "  two  blanks "), (103, " lead"), (104, "x"), (105, "\n"), (106, "naïve 你好 \U0001f600 !")] + [
        (110 + s, strange(s, 60)) for s in range(8)] + [(130, text(3)), (130, text(3))]


def brute_force(libraries, rows):
    found = [slow(libraries, t) for _, t in rows]
    pairs = Counter((f[0][i], f[1][j]) for f in found if f for i, j, _ in f[3])
    top = {}
    for (_, b), n in pairs.items():
        top[b] = max(top.get(b, 0), n)
    out = []
    for (name, _), f in zip(rows, found):
        if f is None:
            out.append((name, 0, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, group, links, count = f
        same = sum(x == y for x in group[0] for y in group[1])
        counts = [(pairs[a[i], b[j]], top[b[j]]) for i, j, _ in links]
        out.append((name, len(a), len(b), count, len(links), same,
                    sum(n == m for n, m in counts), sum(n for n, _ in counts),
                    hashlib.sha256(shown(a, b, group, count).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("hot,block,flush", [(1 << 18, 4 << 20, 1 << 20), (40, 2000, 50), (0, 1, 0)])
def test_align_equals_all_byte_ranges(spark, libraries, monkeypatch, hot, block, flush):
    monkeypatch.setattr(ta, "HOT", hot)
    monkeypatch.setattr(ta, "BLOCK_BYTES", block)
    monkeypatch.setattr(ta, "FLUSH", flush)
    monkeypatch.setattr(ta, "UNITS", 300)
    rows = rows_of_the_tests()
    docs = frame(spark, rows).selectExpr("*", "1 as n_a", "'x' as ids", "'y' as pairs")
    got = ta.align(docs)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_shared", "n_best",
                           "count_sum", "groups_sha256"]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute_force(libraries, rows), key=key)


def test_empty_table(spark):
    assert ta.align(frame(spark, [])).count() == 0
    assert ta.pair_counts(frame(spark, [])).count() == 0
    assert ta.alignments(frame(spark, [])).count() == 0


def test_alignments_and_pair_counts(spark, libraries):
    rows = [r for r in rows_of_the_tests() if r[0] is not None and r[0] not in (9, 130)]
    got = {r["doc_id"]: r for r in ta.alignments(frame(spark, rows)).collect()}
    pairs = Counter()
    for name, whole in rows:
        f, r = slow(libraries, whole), got[name]
        if f is None:
            assert not (r["a_ids"] or r["b_ids"] or r["links"])
            continue
        assert (r["a_ids"], r["b_ids"]) == f[:2]
        assert [r["a_groups"], r["b_groups"]] == f[2]
        assert [tuple(x) for x in r["links"]] == f[3]
        assert [tuple(x) for x in r["shared"]] == [
            (i, j) for i, x in enumerate(f[2][0]) for j, y in enumerate(f[2][1]) if x == y]
        pairs.update((f[1][j], f[0][i]) for i, j, _ in f[3])
    counted = ta.pair_counts(frame(spark, rows)).collect()
    assert {(r["b_id"], r["a_id"]): r["n"] for r in counted} == pairs
    for r in counted:
        assert r["best"] == (r["n"] == max(n for (b, _), n in pairs.items() if b == r["b_id"]))


def test_row_products_equal_dense_ones():
    pick = random.Random(4)
    for _ in range(50):
        n, k, m = (pick.randint(0, 7) for _ in range(3))
        dense = [np.array([[pick.choice([0, 0, 1, 2]) for _ in range(w)] for _ in range(h)],
                          np.int64).reshape(h, w) for h, w in ((n, k), (k, m))]
        a, b = (ta.Csr(ta.running((d > 0).sum(axis=1)), np.nonzero(d)[1], d[np.nonzero(d)],
                       d.shape[1]) for d in dense)
        got, want = a.times(b), dense[0] @ dense[1]
        out = np.zeros((n, m), np.int64)
        out[got.rows(), got.columns] = got.values
        assert (out == want).all()
        back = b.transpose()
        out = np.zeros((m, k), np.int64)
        out[back.rows(), back.columns] = back.values
        assert (out == dense[1].T).all()


def test_a_block_of_new_units_takes_little_memory():
    import tracemalloc

    import pyarrow as pa
    with open(ta.FIRST, encoding="utf-8") as names, open(ta.SECOND, "rb") as model:
        lexicon = ta.Lexicon(ta.Tokenizers(names.read(), model.read()))
    pick = random.Random(8)
    texts = [" ".join("".join(pick.choices("abcdefghij", k=7)) for _ in range(500)).encode()
             for _ in range(525)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(525)), pa.array(texts)], names=["i", "t"])
    tracemalloc.start()
    try:
        told = sum(len(block.pairs()) > 0 for _, block in ta._blocks_of([batch], lexicon))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert told and peak < 350e6, peak


def of_one_process():
    with open(ta.FIRST, encoding="utf-8") as names, open(ta.SECOND, "rb") as model:
        return ta.Lexicon(ta._loaded(names.read(), model.read()))


def test_tasks_of_a_process_share_the_tokenizers():
    assert of_one_process().tokenizers is of_one_process().tokenizers


def test_long_units_are_forgotten_too():
    import tracemalloc

    import pyarrow as pa
    lexicon, pick = of_one_process(), random.Random(9)
    texts = ["".join(chr(pick.randint(0x4E00, 0x9FA5)) for _ in range(1100)).encode()
             for _ in range(1800)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1800)), pa.array(texts)], names=["i", "t"])
    tracemalloc.start()
    try:
        told = sum(len(block.units) for _, block in ta._blocks_of([batch], lexicon))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert told == 1800 and peak < 350e6, peak


def test_a_text_of_new_units_takes_little_memory():
    import tracemalloc
    lexicon, pick = of_one_process(), random.Random(10)
    whole = " ".join("".join(pick.choices("abcdefghij", k=7)) for _ in range(250_000)).encode()
    tracemalloc.start()
    try:
        block = ta.Aligned(lexicon, [whole])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert block.per_text("links")[0] and peak < 400e6, peak


def test_forgetting_changes_nothing(monkeypatch):
    texts = [text(s).encode() for s in range(6)] + [b"", "a\u2581b".encode()]
    whole = ta.Aligned(of_one_process(), texts)
    want = whole.digests(), whole.pairs().tolist(), whole.groups().tolist()
    monkeypatch.setattr(ta, "NEW_BYTES", 50)
    lexicon = of_one_process()
    for _ in range(2):
        again = ta.Aligned(lexicon, texts)
        assert (again.digests(), again.pairs().tolist(), again.groups().tolist()) == want
        lexicon.clear()


@pytest.mark.parametrize("values", [[], [0], [0, 0, 3], [255, 256], [1, 2**63], [2**64 - 1]])
def test_packed_blobs_lose_nothing(values):
    numbers = np.array(values, np.uint64)
    blob = ta._packed(ta.pack_sorted(numbers))
    assert ta.unpack_sorted(ta._planes(blob)).tolist() == values
    small = np.array([v for v in values if v < 2**63], np.int64)
    assert ta.unpack_counts(ta._planes(ta._packed(ta.pack_counts(small)))).tolist() == small.tolist()


def test_stored_blocks_are_small_and_read_in_groups(spark):
    import glob

    import pyarrow.parquet as pq
    docs = frame(spark, [(i, text(i, 400)) for i in range(1700)]).coalesce(1)
    blocks = ta._aligned_blocks(docs, "doc_id", "text", ta.Sent(docs, ta.FIRST, ta.SECOND))
    stored = ta.staged(blocks.unionAll(blocks).coalesce(1), "aligned", 1)
    own = stored.selectExpr("size(ids) as n", "length(at) + length(links) as b",
                            "aggregate(n_links, 0L, (s, x) -> s + x) as k").collect()
    assert sum(r["n"] for r in own) == 3400 and all(r["b"] < 4 * r["k"] for r in own)
    for path in glob.glob(stored.inputFiles()[0].removeprefix("file:")):
        assert pq.ParquetFile(path).num_row_groups == len(own)
