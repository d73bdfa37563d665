import base64
import gzip
import hashlib
import random

import pytest

from adsight.llm import warc_index as W

KINDS = "page_id bigint, url string, html string, first string, size string, seq int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", 1) for r in rows], KINDS)


def awkward():
    rows = [(1, "http://b.example/x", "same"), (5, "https://www.B.example:443/x", "same"),
            (3, "http://a.example/", ""), (4, "http://a.example/", None), (6, None, "ünïcode\r\n\r\nWARC/1.1\r\n"),
            (7, "bad url\r\nX: y", "same"), (8, "http://[::1", "x" * 300_000), (2, "http://b.example/x", "same"),
            (9, "http://b.example/x", "one"), (9, "http://b.example/x", "one"), (None, "n", "same"),
            (10, "h", "one")]
    return rows + [(100 + i, "http://hot.example/", f"p{i % 7}") for i in range(60)]


def slow(rows):
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        first = min((j for j, _, h in rows if (h or "") == (html or "") and j is not None),
                    default=None)
        again = first is not None and i != first
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(),
                    "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("range_rows", [100_000, 5])
def test_round_trip_and_global_order(spark, monkeypatch, range_rows):
    monkeypatch.setattr(W, "RANGE_ROWS", range_rows)
    rows = awkward()
    got = W.capture_histories(pages(spark, rows)).collect()
    assert sorted([(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"],
                    r["refers_to"]) for r in got], key=str) == slow(rows)
    keys = [(r["url_key"], r["captured_at"], r["page_id"] is None, r["page_id"] or 0) for r in got]
    assert keys == sorted(keys)
    assert {r["url_key"] for r in got if r["page_id"] in (1, 5)} == {"example,b)/x"}
    assert W.capture_histories(pages(spark, [])).count() == 0


def test_smaller_payloads_are_not_revisited(spark):
    got = {r["page_id"]: r["record_type"] for r in W.capture_histories(
        pages(spark, awkward()), min_revisit_bytes=4).collect()}
    assert got[4] == "response" and got[10] == "response" and got[5] == "revisit"


def test_archives_can_be_read_as_warc(spark, tmp_path):
    W.write_archives(pages(spark, awkward()), str(tmp_path / "out"))
    seen = 0
    for path in (tmp_path / "out").glob("part-*"):
        content = path.read_bytes()
        whole = gzip.decompress(content)
        for offset, fields, block in W.parse_archive(content):
            assert whole[offset:].startswith(b"WARC/1.1\r\nWARC-Type:")
            assert block in whole and "warc-date" in fields
            seen += 1
    assert seen == len(awkward())
    with pytest.raises(ValueError):
        list(W.parse_archive(gzip.compress(b"no archive\r\n")))


@pytest.mark.parametrize("runs", [0, 1, 2, 3, 7, 8])
def test_loser_tree(runs):
    pick = random.Random(runs)
    parts = [sorted(pick.randint(0, 50) for _ in range(pick.randint(0, 30))) for _ in range(runs)]
    assert list(W.LoserTree([iter(p) for p in parts])) == sorted(sum(parts, []))
