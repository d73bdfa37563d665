import pytest
from pyspark.sql import functions as F

from adsight.llm import license_scan as S
from data import awkward, frame, text


@pytest.fixture(scope="module")
def corpus():
    rows = awkward() + [(500 + i, text(700 + i, 120, 6)) for i in range(60)]
    planted = [(family, body) for family, bodies in S.TEMPLATES.items() for body in bodies]
    extra = [(900 + i, text(i, 60, 3) + "\n" + body + "\n\n" + text(i + 90, 60, 3))
             for i, (_, body) in enumerate(planted)]
    extra += [(950, planted[0][1].upper()), (950, planted[0][1].upper()),
              (None, "\n" + planted[0][1])]
    return rows + extra, planted


def test_finds_every_notice_and_no_other(spark, corpus):
    rows, planted = corpus
    got = S.scan(frame(spark, rows)).collect()
    found = {(r["doc_id"], r["paragraph"]): r for r in got if r["confirmed"]}
    for i, (family, body) in enumerate(planted):
        row = found[900 + i, 3]
        assert (row["family"], row["template_similarity"]) == (family, 1.0), body
        assert S.CERTAIN <= row["probability"] <= 1 and row["body"] == body
    assert sum(r["doc_id"] == 950 for r in got) == 2
    assert found[None, 1]["family"] == planted[0][0]
    known = {900 + i for i in range(len(planted))} | {950, None}
    assert {r["doc_id"] for r in got if r["confirmed"]} == known
    assert len(got) <= len(planted) + 5


def test_empty_table(spark):
    assert S.scan(frame(spark, [])).count() == 0


def test_repeated_lines_leave_the_unknown_class_whole(spark, monkeypatch):
    monkeypatch.setattr(S, "NEGATIVES", 10)
    ordinary = text(31, 400, 50)
    rows = [(i, ordinary) for i in range(400)] + [(1000 + i, f"{body} x{i}") for i in range(
        600) for body in S.TEMPLATES["mit"][:1]]
    kept = S.training_rows(frame(spark, rows), "doc_id", "text").filter(
        F.col("family") == S.UNKNOWN)
    assert kept.filter(~F.col("tokens")[0].startswith("unknownword")).distinct().count() == 10


def test_notices_alone_force_no_line_into_a_family(spark):
    notices = frame(spark, [(1, "Released under the MIT License.")])
    model = S.train(notices)
    assert model.families[-1] == S.UNKNOWN
    assert S.scan(frame(spark, [(i, text(i)) for i in range(20)]), model).count() == 0
    assert [r["family"] for r in S.scan(notices, model).collect()] == ["mit"]


@pytest.mark.parametrize("mark", ["", " * "])
def test_wrapped_notices_are_confirmed(spark, mark):
    import textwrap
    long = [(f, b) for f, bodies in S.TEMPLATES.items() for b in bodies if len(b) > 140]
    assert len(long) >= 5
    rows = []
    for i, (_, body) in enumerate(long):
        wrapped = textwrap.wrap(body, 72 - len(mark), break_on_hyphens=False)
        rows.append((i, text(i, 60, 3) + f"\n{mark.rstrip()}\n" + "\n".join(
            mark + line for line in wrapped) + f"\n{mark.rstrip()}\n" + text(i + 90, 60, 3)))
        rows.append((100 + i, text(i, 60, 3) + "\n" + "\n".join(wrapped)))
    rows += [(200 + i, text(300 + i, 120, 6)) for i in range(60)]
    got = [r for r in S.scan(frame(spark, rows)).collect() if r["confirmed"]]
    found = {(r["doc_id"], r["family"]): r for r in got}
    assert {i for i, _ in found} == {i for i, _ in rows if i < 200}
    for i, (family, body) in enumerate(long):
        row = found[i, family]
        assert (row["paragraph"], row["template_similarity"]) == (4, 1.0)
        assert (100 + i, family) in found
        if family != "apache-2.0":      # its first line is a notice by itself
            assert row["body"] == body


def test_score_is_the_models_own(spark):
    from pyspark.sql import functions as F
    vocabulary = S.Vocabulary([5, 77, -9])
    model = S.Model(["a", "b"], vocabulary, [[0.0, 0.5, 1.0, 1.5], [-1.0] * 4], [0.1, 0.2], 2.0)
    row = spark.createDataFrame([([5, 4, -9, 77],), ([],)], "h array<bigint>").select(
        model.logits(F.col("h")).alias("z"),
        model.probabilities(model.logits(F.col("h"))).alias("p")).collect()
    assert row[0]["z"] == pytest.approx([3.0 / 7 + 0.1, -0.8]) and row[1]["z"] == pytest.approx([0.1, -0.8])
    assert sum(row[0]["p"]) == pytest.approx(1)
    import math
    assert row[0]["p"][0] == pytest.approx(1 / (1 + math.exp(-(row[0]["z"][0] + 0.8) / 2)))


@pytest.mark.parametrize("size", [1024, 4])
def test_vocabulary_knows_exactly_its_grams(spark, monkeypatch, size):
    import random

    from pyspark.sql import functions as F
    monkeypatch.setattr(S, "TABLE", size)
    pick = random.Random(size)
    grams = [pick.getrandbits(64) - (1 << 63) for _ in range(300)] + [-(1 << 63), 0]
    vocabulary = S.Vocabulary(grams)
    others = [g ^ 1 << 40 for g in grams[:50]]
    got = spark.createDataFrame([(grams + others,)], "h array<bigint>").select(
        vocabulary.numbers(F.col("h")).alias("n")).first()["n"]
    assert [vocabulary.hashes[n - 1] for n in got] == grams


def plain_paragraphs(rows):
    """(doc_id, paragraph, last, body) of the paragraphs of several lines."""
    import re
    out = []
    for i, whole in rows:
        lines = [re.sub(S.MARKS, "", line, flags=re.ASCII) for line in (whole or "").split("\n")]
        at = 0
        while at < len(lines):
            end = at
            while end < len(lines) and lines[end]:
                end += 1
            if end > at + 1:
                out.append((i, at, end - 1, " ".join(lines[at:end])))
            at = max(end, at + 1)
    return out


@pytest.mark.parametrize("lift", [-1.0, 0.0, 3.0])
def test_bounds_leave_out_no_unit_of_a_family(spark, corpus, lift):
    import random
    pick = random.Random(5)
    known = S.templates(spark).select(F.explode(S.grams(S.terms(F.col("body")))).alias("h"))
    vocabulary = S.Vocabulary([r["h"] for r in known.distinct().collect()])
    families = sorted(S.TEMPLATES) + [S.UNKNOWN]
    weights = [[-1.0 if f != S.UNKNOWN else lift] + [
        pick.gauss(0, 2) for _ in vocabulary.hashes] for f in families]
    model = S.Model(families, vocabulary, weights, [pick.gauss(0, 0.2) for _ in families], 0.5)
    rows = [(i, t) for i, t in corpus[0] if i is not None] + [
        (2000, " * of the\n# the license\n\n--\nof\nthe\n\t\nthe the the"), (2001, "  the \r\nof\n")]
    marks = sorted({h for r in S.templates(spark).select(
        S.triples(S.terms(F.col("body"))).alias("t")).collect() for h in r["t"]})
    docs = frame(spark, rows)
    lines = S.paragraphs(docs, "doc_id", "text").select(
        "doc_id", "paragraph", F.col("paragraph").alias("last"), "body")
    wanted = lines.union(spark.createDataFrame(plain_paragraphs(rows), lines.schema)).select(
        "*", S.grams(S.terms(F.col("body"))).alias("h"), F.array_intersect(
            F.lit(marks), S.triples(S.terms(F.col("body")))).alias("found")).select(
        "*", model.probabilities(model.logits(F.col("h"))).alias("chances")).collect()
    got = S.units(docs, "doc_id", "text", model, F.lit(marks), 3).collect()
    key = lambda r: (r["doc_id"], r["paragraph"], r["last"], r["body"])
    told = {key(r): r for r in got}
    assert set(told) <= {key(r) for r in wanted} and len(got) > 10
    kept = 0
    for r in wanted:
        best = families[r["chances"].index(max(r["chances"]))]
        if best != S.UNKNOWN or (r["last"] > r["paragraph"] and len(r["found"]) >= 3):
            assert told[key(r)]["chances"] == pytest.approx(r["chances"], abs=1e-9)
            assert sorted(told[key(r)]["found"]) == sorted(r["found"])
            kept += 1
    assert kept > 10


def test_words_of_a_unit_are_split_once(spark, monkeypatch):
    vocabulary = S.Vocabulary([5, 77, -9])
    families = sorted(S.TEMPLATES) + [S.UNKNOWN]
    model = S.Model(families, vocabulary, [[0.0, 0.5, 1.0, 1.5]] * 8, [0.1] * 8)
    plans, staged = [], S.staged
    monkeypatch.setattr(S, "staged", lambda f, name: plans.append(
        f._jdf.queryExecution().executedPlan().toString()) or staged(f, name))
    S.scan(frame(spark, awkward()), model)
    assert plans[0].count("split(") == 2    # the lines of a text, the words of a line
