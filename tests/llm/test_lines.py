import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from adsight.llm import line_chunks as L
from data import awkward, frame, text


def slow_chunks(value, divisor, long_words):
    lines = value.split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in lines]
    long = [x.count(" ") >= long_words - 1 for x in lines]
    out, own = [], []
    for i, line in enumerate(lines):
        own.append(line)
        before = h[i - 1] if i else 0
        if ((h[i] + before * 257) % 1000003 % divisor == 0 or long[i] or i == len(lines) - 1
                or long[i + 1]):
            out.append(own)
            own = []
    return out


def slow_clean(rows, divisor, long_words):
    seen, places = {}, defaultdict(list)
    for i, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        for no, lines in enumerate(slow_chunks(t, divisor, long_words) if t is not None else []):
            if len(lines) >= 2 or lines[0].count(" ") >= long_words - 1:
                places["\n".join(lines)].append((i, t, no))
    gone = {p for found in places.values() for p in found[1:]}
    return [(i, t if t is None else "\n".join(
        line for no, lines in enumerate(slow_chunks(t, divisor, long_words))
        if (i, t, no) not in gone for line in lines)) for i, t in rows]


@pytest.mark.parametrize("divisor,long_words", [(4, 50), (2, 20), (1, 1000)])
def test_same_as_brute_force(spark, divisor, long_words):
    shared = text(77, 120, 12)
    rows = [r for r in awkward() if r != (9, text(3))] + [
        (200, text(91, 40) + "\n" + shared), (201, shared + "\n" + text(92, 40)),
        (202, text(93, 20) + "\n" + shared + "\n" + text(94, 30)), (203, "\n\na\n\na\n\n")]
    got = L.remove_repeated(frame(spark, rows), divisor=divisor, long_words=long_words)
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted([(r["doc_id"], r["text"]) for r in got.collect()], key=key) == sorted(
        slow_clean(rows, divisor, long_words), key=key)
    assert got.columns == frame(spark, []).columns + ["removed_chunks"]


def test_shared_passage_goes_and_an_insertion_moves_little(spark):
    shared = "\n".join(f"line {i} of the passage" for i in range(60))
    rows = [(i, text(i, 60, 6) + "\n" + shared + "\n" + text(i + 500, 60, 6)) for i in range(1, 6)]
    got = {r["doc_id"]: r["text"] for r in L.remove_repeated(frame(spark, rows)).collect()}
    assert got[1] == rows[0][1]
    for i, whole in rows[1:]:
        assert got[i].count("of the passage") <= 20
        assert got[i].startswith(text(i, 60, 6)) and got[i].endswith(text(i + 500, 60, 6))


def test_long_repeated_line_goes_and_short_ones_stay(spark):
    line = " ".join(f"w{i}" for i in range(51))
    rows = [(1, "a\n" + line), (2, f"b c d\n{line}\ne f"), (3, "a"), (4, line)]
    got = {r["doc_id"]: r["text"] for r in L.remove_repeated(frame(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: "b c d\ne f", 3: "a", 4: ""}


def test_empty_table(spark):
    assert L.remove_repeated(frame(spark, [])).count() == 0


def test_a_column_named_like_the_count(spark):
    import corpus_pipeline

    shared = "\n".join(text(90 + i, 12, 1) for i in range(9))
    rows = [(1, shared), (2, shared + "\nx"), (3, None)]
    docs = frame(spark, rows).withColumn("removed_chunks", F.lit("own")).withColumn("row", F.lit(7))
    got = L.remove_repeated(docs)
    assert sorted(got.columns) == sorted(docs.columns)
    assert {r["doc_id"]: r["removed_chunks"] > 0 for r in got.collect()} == {
        1: False, 2: True, 3: False}
    kept = corpus_pipeline.line_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    for r in kept.collect():
        assert (r["removed_chunks"], r["row"], r["n_chars"]) == ("own", 7, len(r["text"] or ""))


def test_row_keys_tell_nulls_apart(spark):
    from adsight.llm.common import row_key

    rows = [(None, None), (None, ""), (1, None), (1, ""), (1, "-"), (1, "+"), (11, ""), (None, "1")]
    keys = spark.createDataFrame(rows, "doc_id bigint, text string").select(
        row_key("doc_id", "text").alias("k")).collect()
    assert len({bytes(r["k"]) for r in keys}) == len(rows)
