"""Licence paragraphs: a trained n-gram classifier, a calibrated unknown class, templates."""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, Normalizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adsight.plans.stages import staged

TABLE = 1024            # places of each of the two look-up tables of the vocabulary
NEGATIVES = 3000        # paragraphs of the corpus that train the unknown class, at most
VARIANTS = 40           # thinned copies of every template that train its family
PADDING = 3             # grams of no notice added to every paragraph: short ones are less certain
CERTAIN = 0.5           # calibrated probability that a family needs
CONFIRMED = 0.6         # share of a template's word triples that confirms a prediction
TEMPERATURES = (0.1, 0.2, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0)
UNKNOWN = "unknown"

# Public short notices of the licence families.
TEMPLATES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this "
        "file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the "
        "LICENSE file.",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 "
        "International License.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version.",
    ),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction.",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a "
        "copy of the MPL was not distributed with this file, You can obtain one at "
        "https://mozilla.org/MPL/2.0/.",
    ),
}


def _let(value: Column, function) -> Column:
    """Binds a value once for use inside lambdas, where a plain column is evaluated again."""
    return F.transform(F.array(value), function)[0]


def terms(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.array_remove(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), "")


def _runs(tokens: Column, size: int, value) -> Column:
    last = F.size(tokens) - size
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), value)).otherwise(
        F.array().cast("array<bigint>"))


def grams(tokens: Column) -> Column:
    """Hashes of all word 1- and 2-grams of a paragraph."""
    return _let(tokens, lambda t: F.concat(
        F.transform(t, lambda w: F.xxhash64(w)),
        _runs(t, 2, lambda i: F.xxhash64(t[i], t[i + 1]))))


class Vocabulary:
    """Numbers from 1 for the 1- and 2-grams of the notices; every other gram is 0.

    A gram lies at one of two places (cuckoo hashing), so a look-up compares two hashes.
    """

    def __init__(self, hashes: list[int]):
        self.hashes = sorted(set(hashes))
        self.size = TABLE
        while not self._fill():
            self.size *= 2

    def _places(self, h: int) -> tuple[int, int]:
        return h & self.size - 1, (h >> 20) & self.size - 1

    def _fill(self) -> bool:
        self.tables = [[0] * self.size, [0] * self.size]
        for number in range(1, len(self.hashes) + 1):
            side = 0
            for _ in range(200):
                place = self._places(self.hashes[number - 1])[side]
                number, self.tables[side][place] = self.tables[side][place], number
                if not number:
                    break
                side = 1 - side
            else:
                return False
        return True

    def places(self, hashes: Column) -> Column:
        """The number of every gram of an array of gram hashes, 0 for unknown ones."""
        sides = []
        for table in self.tables:
            keys = [self.hashes[n - 1] if n else 0 for n in table]
            sides.append((F.expr(f"array({', '.join(_bigint(k) for k in keys)})"),
                          F.expr(f"array({', '.join(map(str, table))})")))
        (keys_a, ids_a), (keys_b, ids_b) = sides

        def number(h: Column) -> Column:
            a = h.bitwiseAND(F.lit(self.size - 1)).cast("int")
            b = F.shiftright(h, 20).bitwiseAND(F.lit(self.size - 1)).cast("int")
            return F.when(keys_a[a] == h, ids_a[a]).when(keys_b[b] == h, ids_b[b]).otherwise(0)

        return F.transform(hashes, number)

    def numbers(self, hashes: Column) -> Column:
        """The numbers of the known grams of an array of gram hashes."""
        return F.filter(self.places(hashes), lambda n: n > 0)


def _bigint(value: int) -> str:
    return "bigint('-9223372036854775808')" if value == -(1 << 63) else f"{value}L"


def triples(tokens: Column) -> Column:
    """Distinct hashes of all word triples."""
    return _let(tokens, lambda t: F.array_distinct(
        _runs(t, 3, lambda i: F.xxhash64(t[i], t[i + 1], t[i + 2]))))


def paragraphs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, paragraph number, body) of every non-blank line of the whole texts."""
    listed = docs.select(F.col(id_col), F.posexplode(F.split(F.col(text_col), "\n")).alias(
        "paragraph", "body"))
    return listed.filter(F.length(F.trim("body")) > 0)


MARKS = "^[\\s/*#;%!<>|-]+|[\\s*/<>|-]+$"     # of comments, at both ends of a line
NO_MARK = "[^\\s/*#;%!<>|-]"                 # in every line that is more than marks


def templates(spark: SparkSession) -> DataFrame:
    """(family, body) of the fixed notices."""
    return spark.createDataFrame(
        [(family, body) for family, bodies in TEMPLATES.items() for body in bodies],
        "family string, body string")


def training_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(family, body terms): thinned templates, and a bounded sample of other paragraphs.

    The unknown class is learned from the ``NEGATIVES`` distinct paragraphs with the smallest
    hashes among those that share no word triple with any template.
    """
    spark = docs.sparkSession
    known = templates(spark).withColumn("tokens", terms(F.col("body")))
    thin = lambda w, i: F.pmod(F.xxhash64(w, i, F.col("variant")), F.lit(8)) != 0
    positive = known.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1)))
                                ).withColumn("tokens", F.when(
                                    F.col("variant") == 0, F.col("tokens")).otherwise(
                                    F.filter("tokens", thin))).select("family", "tokens")
    of_templates = known.select(F.explode(triples(F.col("tokens"))).alias("h"))
    marks = F.lit([r["h"] for r in of_templates.distinct().collect()])  # of the fixed notices
    bodies = paragraphs(docs, id_col, text_col).select("body").withColumn(
        "order", F.xxhash64("body"))
    # A hash bound that some 8 x NEGATIVES distinct lines pass keeps the sort small, whatever the
    # corpus holds; repeated lines are one before they are sorted. Where too many of them are of
    # notices, the bound is widened.
    lines = bodies.agg(F.approx_count_distinct("order")).first()[0]
    share = 8 * NEGATIVES / max(lines, 1)
    while True:
        bound = min(int(min(share, 1.0) * 2 ** 64) - 2 ** 63, 2 ** 63 - 1)
        negative = staged(bodies.filter(F.col("order") <= bound).distinct().withColumn(
            "tokens", terms(F.col("body"))).filter(
            (F.size("tokens") > 0) & ~F.arrays_overlap(triples(F.col("tokens")), marks)).orderBy(
            "order", "body").limit(NEGATIVES).select("tokens"), "licence_negatives")
        found = negative.count()
        if found >= NEGATIVES or share >= 1:
            break
        share *= 8
    if found < VARIANTS:    # the class is kept: rows of no gram of a notice
        made = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.concat(
            F.lit("unknownword"), i.cast("string"), F.lit("x"), F.col("id").cast("string")))
        negative = negative.union(spark.range(VARIANTS).select(made.alias("tokens")))
    return positive.union(negative.select(F.lit(UNKNOWN).alias("family"), "tokens")).filter(
        F.size("tokens") > 0)


class Model:
    """Vocabulary, weights per family and gram, intercepts, temperature of the probabilities."""

    def __init__(self, families: list[str], vocabulary: Vocabulary, weights: list[list[float]],
                 shifts: list[float], temperature: float = 1.0):
        self.families, self.vocabulary = families, vocabulary
        self.weights, self.shifts, self.temperature = weights, shifts, temperature

    def logits(self, hashes: Column) -> Column:
        """Score of every family: mean weight of the grams of a paragraph, plus its intercept."""
        return _let(hashes, lambda h: self.logits_of(self.vocabulary.numbers(h), F.size(h)))

    def logits_of(self, known: Column, count: Column) -> Column:
        """Scores from the numbers of the known grams and the count of all grams."""
        tables = [F.expr(f"array({', '.join(f'{w:.9f}D' for w in row)})") for row in self.weights]

        def score(known: Column, count: Column, no: int) -> Column:
            total = F.aggregate(known, F.lit(0.0), lambda total, n: total + tables[no][n])
            other = (count + PADDING - F.size(known)) * self.weights[no][0]
            return (total + other) / (count + PADDING) + self.shifts[no]

        def scores(pair: Column) -> Column:
            return F.array(*[score(pair["known"], pair["n"], no) for no in range(len(tables))])

        return _let(F.struct(known.alias("known"), count.alias("n")), scores)

    def lead(self, known: Column, unknown: Column) -> Column:
        """What the scores of some grams lead by at most: no family leads by more, times all grams.

        ``known``: numbers of the known grams; ``unknown``: how many others, padding included.
        Every gram adds the largest lead of a family over the unknown class, intercepts included.
        """
        table = F.expr(f"array({', '.join(f'{x:.9f}D' for x in self.leads())})")
        return F.aggregate(known, unknown * self.leads()[0], lambda total, n: total + table[n])

    def leads(self) -> list[float]:
        """The largest lead of a family over the unknown class, by gram."""
        unknown = self.families.index(UNKNOWN)
        return [max(row[i] - self.weights[unknown][i] + shift - self.shifts[unknown] for no, (
            row, shift) in enumerate(zip(self.weights, self.shifts)) if no != unknown)
            for i in range(len(self.vocabulary.hashes) + 1)]

    def probabilities(self, logits: Column, temperature: float | None = None) -> Column:
        """Softmax of the scores divided by the temperature."""
        heat = temperature or self.temperature
        def soft(z: Column) -> Column:
            top = F.array_max(z)
            powers = F.transform(z, lambda x: F.exp((x - top) / heat))
            return _let(powers, lambda p: F.transform(
                p, lambda x: x / F.aggregate(p, F.lit(0.0), lambda a, y: a + y)))
        return _let(logits, soft)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Multinomial logistic regression over sparse gram shares; temperature from held-out rows.

    The features are the shares of the grams of the notices and of all others together.
    At most ``NEGATIVES`` paragraphs and ``VARIANTS`` copies of each template are fitted, however
    large the corpus is. A fifth of the rows chooses the temperature with the best likelihood.
    """
    families = sorted(TEMPLATES) + [UNKNOWN]
    known = templates(docs.sparkSession).select(F.explode(grams(terms(F.col("body")))).alias("h"))
    vocabulary = Vocabulary([r["h"] for r in known.distinct().collect()])   # fixed notices
    label = F.array_position(F.lit(families), F.col("family")) - 1
    rows = staged(training_rows(docs, id_col, text_col).select(
        label.cast("double").alias("label"), grams(F.col("tokens")).alias("hashes"),
        (F.pmod(F.xxhash64("tokens", F.lit(7)), F.lit(5)) == 0).alias("held")), "licence_rows")
    numbers = rows.withColumn("numbers", vocabulary.numbers(F.col("hashes"))).withColumn(
        "names", F.concat("numbers", F.array_repeat(
            F.lit(0), F.size("hashes") + PADDING - F.size("numbers"))).cast("array<string>"))
    counted = CountVectorizerModel.from_vocabulary(
        [str(i) for i in range(len(vocabulary.hashes) + 1)], "names", "counts")
    vectors = Normalizer(p=1.0, inputCol="counts", outputCol="features").transform(
        counted.transform(numbers.filter(~F.col("held")))).select("label", "features")
    fitted = LogisticRegression(maxIter=50, regParam=1e-4, standardization=False,
                                family="multinomial").fit(staged(vectors, "licence_vectors"))
    matrix, shifts = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
    if len(matrix) != len(families):
        raise ValueError(f"{len(matrix)} of {len(families)} classes were learned")
    model = Model(families, vocabulary, matrix.tolist(), shifts.tolist())
    z = rows.filter("held").select("label", model.logits(F.col("hashes")).alias("z"))
    loss = z.agg(*[F.avg(-F.log(F.greatest(F.lit(1e-12), F.get(
        model.probabilities(F.col("z"), t), F.col("label").cast("int"))))).alias(str(i))
        for i, t in enumerate(TEMPERATURES)]).first()
    best = min((value, i) for i, value in enumerate(loss) if value is not None) if any(
        value is not None for value in loss) else (0, TEMPERATURES.index(1.0))
    model.temperature = TEMPERATURES[best[1]]
    return model


def units(docs: DataFrame, id_col: str, text_col: str, model: Model, marks: Column,
          least: int) -> DataFrame:
    """The non-blank lines, and the paragraphs of several lines, that may be notices.

    Columns: row_key, id, paragraph, last, body, chances of the families, found triples. A paragraph
    is a run of lines that are not blank without their comment marks, joined by blanks; it stands
    from line ``paragraph`` to line ``last``. For a line the two are equal. Left out are units
    for which no family can be the best and, if they have several lines, with fewer than ``least``
    of the triples ``marks``. Words are split and looked up once per line: comment marks hold none,
    so the words of a paragraph are those of its lines. One generator yields all, as columns that
    a filter reads are evaluated again for it.
    """
    lookup, top = model.vocabulary.places, max(model.leads())
    known = lambda places: F.filter(places, lambda n: n > 0)
    none = F.array().cast("array<bigint>")

    def unit(first: Column, last: Column, body: Column, t: Column, single: Column,
             wanted: Column) -> Column:
        """An array of the unit, if it may be a notice. t: its words, single: their numbers."""
        size, several = F.size(t), last > first

        def pairs() -> Column:      # both words of a known pair are known
            return lookup(F.transform(F.filter(
                F.sequence(F.lit(0), size - 2), lambda i: (single[i] > 0) & (single[i + 1] > 0)),
                lambda i: F.xxhash64(t[i], t[i + 1])))

        def known_triples() -> Column:
            return F.array_intersect(marks, F.transform(F.filter(
                F.sequence(F.lit(0), size - 3), lambda i: (single[i] > 0) & (single[i + 1] > 0)
                & (single[i + 2] > 0)), lambda i: F.xxhash64(t[i], t[i + 1], t[i + 2])))

        def judged(words: Column) -> Column:
            count = F.size(words)
            # All pairs of known words at best: as many as words, of the largest lead.
            rest = 2 * size - 1 + PADDING - 2 * count
            hope = model.lead(words, rest) + count * top >= (2 * size + PADDING) * -1e-6
            total = F.greatest(2 * size - 1, F.lit(0))
            leads = lambda w: model.lead(w, total + PADDING - F.size(w)) >= (
                total + PADDING) * -1e-6
            both = F.when(size > 1, F.concat(words, known(pairs()))).otherwise(words)
            possible = F.when(hope, _let(both, leads)).otherwise(F.lit(False))
            return _let(possible, lambda p: told(p, total))

        def told(possible: Column, total: Column) -> Column:
            found = F.when((possible | several) & (size > 2), known_triples()).otherwise(none)
            return _let(found, lambda f: F.when(possible | (several & (F.size(f) >= least)), rows(
                f, total)))

        def rows(f: Column, total: Column) -> Column:
            whole = F.when(size > 1, F.concat(known(single), known(pairs()))).otherwise(
                known(single))
            chances = model.probabilities(model.logits_of(whole, total))
            return F.array(F.struct(
                first.cast("int").alias("paragraph"), last.cast("int").alias("last"),
                body.alias("body"), chances.alias("chances"), f.alias("found")))

        return F.when(wanted, _let(known(single), judged))

    def read(line: Column) -> Column:
        return _let(terms(line), lambda t: F.struct(
            line.alias("line"), F.rlike(line, F.lit(NO_MARK)).alias("full"), t.alias("t"),
            lookup(F.transform(t, lambda w: F.xxhash64(w))).alias("n")))

    def listed(lines: Column) -> Column:
        single = F.transform(lines, lambda l, i: unit(
            i, i, l["line"], l["t"], l["n"], F.length(F.trim(l["line"])) > 0))
        places = F.sequence(F.lit(0), F.size(lines) - 1)
        full = lambda i: F.coalesce(F.get(lines, i)["full"], F.lit(False))
        starts = F.filter(places, lambda i: full(i) & ~full(i - 1))
        ends = F.filter(places, lambda i: full(i) & ~full(i + 1))
        runs = F.filter(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda r: r["b"] > r["a"])
        whole = F.transform(runs, lambda r: _let(
            F.slice(lines, r["a"] + 1, r["b"] - r["a"] + 1), lambda part: _let(F.struct(
                F.flatten(part["t"]).alias("t"), F.flatten(part["n"]).alias("n")), lambda w: unit(
                r["a"], r["b"], F.array_join(F.transform(
                    part["line"], lambda l: F.regexp_replace(l, MARKS, "")), " "),
                w["t"], w["n"], F.lit(True)))))
        return F.flatten(F.filter(F.concat(single, whole), lambda u: u.isNotNull()))

    return docs.select(
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("row_key"), F.col(id_col),
        F.explode(_let(F.transform(F.split(F.col(text_col), "\n"), read), listed)).alias(
            "unit")).select("row_key", id_col, "unit.*")


def scan(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """One row per notice: a non-blank line or a paragraph of several lines of a licence family.

    Columns: id, paragraph (number of its first line, from 0), family, probability,
    template_similarity (largest share of a family template's word triples found in it), confirmed
    (that share reaches ``CONFIRMED``) and body (of a paragraph, its lines without comment marks,
    joined by blanks). A line gives a row when the calibrated probability of its best class
    reaches ``CERTAIN`` and the class is not ``unknown``. A paragraph gives one for its best class
    by the same rule, and for every family that it confirms, as prose before or after a notice
    lowers the probability; unless one of its lines already has a row of the family, confirmed
    if the paragraph's is. Null and empty texts and blank lines give none; repeated rows
    are reported each; null ids are kept; an empty table gives no rows. Everything is built-in
    functions: text is scored where it is read; only the rows found are exchanged.
    """
    model = model or train(docs, id_col, text_col)
    known = templates(docs.sparkSession).select("family", triples(terms(F.col("body"))).alias("t"))
    lists: dict[str, list] = {}
    for row in known.collect():     # the fixed notices
        lists.setdefault(row["family"], []).append(row["t"])
    marks = F.lit(sorted({h for own in lists.values() for t in own for h in t}))
    share = lambda found, own: F.size(F.array_intersect(found, F.lit(own))) / F.lit(float(len(own)))
    near = lambda found: F.array(*[F.struct(
        F.lit(family).alias("family"), F.greatest(F.lit(0.0), *[share(found, t) for t in own]).alias(
            "similarity"), F.get("chances", F.lit(model.families.index(family))).alias("chance"))
        for family, own in sorted(lists.items())])
    # Fewer triples than this confirm no template.
    least = min(math.ceil(CONFIRMED * len(t) - 1e-9) for own in lists.values() for t in own)
    several = F.col("last") > F.col("paragraph")
    scored = units(docs, id_col, text_col, model, marks, least)
    best = F.array_max("chances")
    chosen = scored.select("*", F.when(best >= CERTAIN, F.get(
        F.lit(model.families), (F.array_position("chances", best) - 1).cast("int"))).alias(
        "family")).filter((F.col("family") != UNKNOWN) | (
            several & (F.size("found") >= least)))
    rows = staged(chosen.select(
        "row_key", id_col, "paragraph", "last", "body", "family", F.explode(
            _let(F.col("found"), near)).alias("n")).filter(
        F.coalesce(F.col("n.family") == F.col("family"), F.lit(False))
        | (several & (F.col("n.similarity") >= CONFIRMED))).select(
        "row_key", id_col, "paragraph", "last", F.col("n.family").alias("family"),
        F.col("n.chance").alias("probability"), F.col("n.similarity").alias("template_similarity"),
        (F.col("n.similarity") >= CONFIRMED).alias("confirmed"), "body"), "licence_found")
    lines = rows.filter(~several)
    told = lines.select(F.col("row_key").alias("own"), F.col("family").alias("of"), F.col(
        "paragraph").alias("at"), F.col("confirmed").alias("sure")).distinct()
    new = rows.filter(several).join(told.hint("merge"), [
        F.col("row_key") == F.col("own"), F.col("family") == F.col("of"),
        F.col("at").between(F.col("paragraph"), F.col("last")),
        F.col("sure") | ~F.col("confirmed")], "left_anti")
    return lines.union(new).drop("row_key", "last").select(
        id_col, "paragraph", "family", "probability", "template_similarity", "confirmed", "body")
