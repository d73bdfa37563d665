import random

import numpy as np
import pytest
import sentencepiece

from adsight.llm import token_counts
from data import awkward, frame, text


@pytest.fixture(scope="module")
def model():
    with open(token_counts.MODEL, "rb") as source:
        return source.read()


def strange(seed, size):
    """Text of awkward units: runs, blanks, CJK, emoji, unknown characters, special strings."""
    pick = random.Random(seed)
    units = ["the ", "a" * 9, " " * 7, "\n\n", "\t", "你好", "é", "é", "▁", "<s>", "</s>",
             "<0x41>", "<unk>", "\U0001f600", "͸", "\x00", "12345", "http://x.y/", "Ünder ",
             "-----", "naïve ", " ", "word", "zq", "　"]
    return "".join(pick.choice(units) for _ in range(size))


@pytest.mark.parametrize("chunk,overlap", [(40, 1), (64, 20), (500, 40), (4000, 96)])
def test_chunks_give_the_ids_of_the_whole(model, chunk, overlap):
    plain = sentencepiece.SentencePieceProcessor(model_proto=model)
    encoder = token_counts.SplicingEncoder(model, chunk, overlap)
    texts = [strange(s, 400) for s in range(30)] + [text(s, 2000, 40) for s in range(4)] + [
        "a" * 3000, " " * 3000, "ab" * 2000, "你" * 3000, "͸" * 900, "=" * 2500, "", "x", " "]
    for whole in texts:
        ids = np.concatenate(list(encoder.parts(whole))).tolist()
        assert ids == plain.encode(whole)
        assert encoder.count(whole) == len(ids)


def test_overlaps_widen_until_a_boundary_is_proven(model):
    encoder = token_counts.SplicingEncoder(model, 100, 20)
    lengths, encode = [], encoder.encode

    def watched(part):
        lengths.append(len(part))
        return encode(part)

    encoder.encode = watched
    whole = "a" * 260 + " b" * 400
    assert encoder.count(whole) == len(encode(whole))
    assert max(lengths) < 600 and len([n for n in lengths if n > 140]) > 1
    lengths.clear()
    assert encoder.count("a" * 1000) == len(encode("a" * 1000)) and max(lengths) == 1000
    lengths.clear()
    prose = text(5, 4000, 50)
    encoder.chunk, encoder.overlap = 200, 60
    encoder.count(prose)
    assert max(lengths) <= 320 and len(lengths) == pytest.approx(len(prose) / 200, abs=2)


def test_proof_needs_every_crossing_piece(model):
    encoder = token_counts.SplicingEncoder(model)
    for whole in (strange(3, 200), text(8, 60)):
        shown = whole.replace(" ", "▁")
        for place in range(1, len(whole)):
            crossing = any(shown[i:j] in encoder.pieces for i in range(place)
                           for j in range(place + 1, len(shown) + 1) if j - i <= 40)
            assert encoder.proven(whole, place) == (not crossing)


def test_table(spark, model):
    plain = sentencepiece.SentencePieceProcessor(model_proto=model)
    rows = awkward() + [(200, strange(77, 5000)), (201, text(6, 9000, 9)), (202, "<s> x </s>")]
    docs = frame(spark, rows).selectExpr("*", "1 as n_tokens", "'x' as n_bytes")
    got = token_counts.token_counts(docs, limit=500, chunk=1000)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = [(i, len((t or "").encode()), len(plain.encode(t or "")),
             len(plain.encode(t or "")) > 500) for i, t in rows]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert token_counts.token_counts(frame(spark, [])).count() == 0


def test_other_models_are_refused():
    from sentencepiece import sentencepiece_model_pb2 as proto

    parsed = proto.ModelProto()
    with open(token_counts.MODEL, "rb") as source:
        parsed.ParseFromString(source.read())
    parsed.normalizer_spec.remove_extra_whitespaces = True
    with pytest.raises(ValueError):
        token_counts.check_model(parsed.SerializeToString())
