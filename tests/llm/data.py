"""Small document tables with every awkward case."""

import random

KINDS = "doc_id bigint, text string, lang string, source string, n_chars bigint, "
CLASHES = "fp bigint, row_key string, block string, value string, id string, h string, c string"


def text(seed, words=80, lines=4):
    """Invented prose: some words are common, every seed is different."""
    pick = random.Random(seed)
    word = lambda: pick.choice("the of and".split()) if pick.random() < 0.3 else "".join(
        pick.choice("ka lo mi ren ta su vel or in".split()) for _ in range(pick.randint(1, 4)))
    rows = [" ".join(word() for _ in range(words // lines)) for _ in range(lines)]
    return "\n".join(rows)


def frame(spark, rows, lang="en"):
    """(doc_id, text) rows as a documents table with extra columns of clashing names."""
    full = [(i, t, lang, f"src{(i or 0) % 3}", len(t or ""), 1, "x", "y", "z", "w", "v", "u")
            for i, t in rows]
    return spark.createDataFrame(full, KINDS + CLASHES)


def awkward():
    """Nulls, empty and blank texts, ties, repeated rows, a very long text, near copies."""
    base = text(1)
    rows = [(1, base), (2, base), (3, base.replace("ka", "ki", 1)), (4, None), (5, ""), (6, " \n\t"),
            (7, "one"), (8, "One two"), (None, base), (9, text(2)), (9, text(2)), (9, text(3)),
            (10, text(4, 30_000, 300)), (11, "\n\n"), (12, "12 34 56"), (None, None)]
    return rows + [(20 + i, text(50 + i)) for i in range(12)]
