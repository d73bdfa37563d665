import pytest

from adsight.llm import language_mixture as L
from data import frame

WORDS = {"aa": "kalo mito rena sulo vero taka", "bb": "zwish ghyx thwy grmph yxzz wyq",
         "cc": "éuû âcé ôdé éêû îéu ûôé"}


def sentence(lang, n, start=0):
    words = WORDS[lang].split()
    return " ".join(words[(start + i * 5 + i // 7) % 6] for i in range(n))


def rows():
    return [(i, sentence(lang, 60, i), lang) for i, lang in enumerate(list(WORDS) * 20)]


def table(spark, more=()):
    data = [(i, t, lang, None, 0) for i, t, lang in rows()] + list(more)
    return spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, "
                                       "row bigint")


def test_held_out_rows_are_told_and_mixtures_found(spark):
    mixed = sentence("aa", 64) + " " + sentence("bb", 32)
    more = [(1000, mixed, None, None, 1), (1001, None, "aa", None, 1), (1002, "", "bb", None, 1),
            (1003, "12 %% 3", "bb", None, 1), (None, sentence("cc", 9), None, None, 1),
            (1004, "É", "aa", None, 1), (1005, sentence("bb", 60_000), None, None, 1),
            (1005, sentence("bb", 60_000), None, None, 1)]
    got = {r["doc_id"]: r for r in L.identify(table(spark, more)).collect()}
    for i, _, lang in rows():
        assert got[i]["lang_pred"] == lang and 0.99 < got[i]["score"] <= 1
    assert got[1000]["languages"] == ["aa", "bb"]
    assert got[1000]["shares"] == pytest.approx([2 / 3, 1 / 3], abs=0.1)
    for i in (1001, 1002, 1003):
        assert (got[i]["lang_pred"], got[i]["score"], got[i]["languages"]) == ("und", 0, [])
    assert got[None]["lang_pred"] == "cc" and got[None]["held_out"] is False
    assert got[1004]["lang_pred"] in WORDS
    assert got[1005]["lang_pred"] == "bb"
    import zlib
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
               for i, r in got.items() if i is not None)


def test_without_labels_or_rows(spark):
    assert {r["lang_pred"] for r in L.identify(frame(spark, [(1, "abc"), (2, None)], None)).collect()
            } == {"und"}
    assert L.identify(frame(spark, [])).count() == 0


def test_counts_are_exact(spark):
    total = L.train(table(spark)).groupBy("lang").sum("n").collect()
    want = {}
    for _, text, lang in rows():
        want[lang] = want.get(lang, 0) + len(text)
    assert {r["lang"]: r["sum(n)"] for r in total} == want
