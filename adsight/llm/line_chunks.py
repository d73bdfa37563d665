"""Removal of repeated multi-line chunks whose boundaries are defined by their content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adsight.llm.common import row_key
from adsight.plans.stages import staged

DIVISOR = 4         # a boundary follows about every fourth window of lines
MIN_LINES = 2       # shorter chunks are never removed
LONG_WORDS = 50     # a line of so many words is a wrapped paragraph and a chunk of its own


def chunks(text: Column, divisor: int = DIVISOR, long_words: int = LONG_WORDS) -> Column:
    """array<struct<no, lines>>: the consecutive chunks of a text; joined with newlines they give it.

    Every line has a 31-bit hash; a polynomial rolling hash over two neighbouring lines picks the
    boundaries, so an insertion moves only the boundaries beside it. Long lines stand alone.
    """
    step = F.struct(F.split(text, "\n", -1).alias("lines"))
    hashed = lambda s: F.struct(
        s["lines"].alias("lines"),
        F.transform(s["lines"], lambda l: F.conv(F.substring(F.md5(l), 1, 7), 16, 10).cast(
            "bigint")).alias("h"),
        F.transform(s["lines"], lambda l: F.length(l) - F.length(F.replace(l, F.lit(" ")))
                    >= long_words - 1).alias("long"))

    def cut(s: Column) -> Column:
        last = F.size(s["lines"]) - 1
        before = lambda i: F.when(i > 0, s["h"][i - 1]).otherwise(0)
        ends = lambda i: ((s["h"][i] + before(i) * 257) % 1000003 % divisor == 0) | (
            s["long"][i] | (i == last) | F.coalesce(F.get(s["long"], i + 1), F.lit(False)))
        return F.struct(s["lines"].alias("lines"),
                        F.filter(F.sequence(F.lit(0), last), ends).alias("ends"))

    def listed(s: Column) -> Column:
        start = lambda k: F.when(k > 0, s["ends"][k - 1] + 1).otherwise(0)
        return F.transform(s["ends"], lambda e, k: F.struct(
            k.alias("no"), F.slice(s["lines"], start(k) + 1, e - start(k) + 1).alias("lines")))

    # One-element arrays bind an intermediate value once; a plain column would be inlined into
    # the lambda and evaluated for every line.
    bound = F.array(step)
    for function in (hashed, cut, listed):
        bound = F.transform(bound, function)
    return F.when(text.isNotNull(), bound[0])


def _fit(long_words: int, min_lines: int) -> Column:
    """Whether a chunk (column c) may be removed."""
    first = F.col("c.lines")[0]
    spaces = F.length(first) - F.length(F.replace(first, F.lit(" ")))
    return (F.size("c.lines") >= min_lines) | (spaces >= long_words - 1)


def repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    divisor: int = DIVISOR, min_lines: int = MIN_LINES,
                    long_words: int = LONG_WORDS) -> DataFrame:
    """(row_key, no): the chunks to remove, each a repeat of an earlier equal chunk.

    Chunk digests are counted first, without text. Only documents with a digest that occurs twice
    contribute text, which is then grouped by its bytes: the smallest (id, row, chunk) of equal
    texts stays. Counts and smallest places are combined before each shuffle, so a chunk held by
    a third of all rows costs one row per task.
    """
    keyed = docs.select(row_key(id_col, text_col).alias("row_key"), F.col(id_col).alias("id"),
                        F.col(text_col).alias("text"))
    listed = lambda rows: rows.select(
        "row_key", "id", *([] if "wanted" not in rows.columns else ["wanted"]),
        F.explode(chunks(F.col("text"), divisor, long_words)).alias("c")).filter(
        _fit(long_words, min_lines))
    body = F.array_join("c.lines", "\n")
    digests = listed(keyed).select(
        "row_key", F.col("c.no").alias("no"), F.xxhash64(body).alias("digest"))
    shared = digests.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    wanted = staged(digests.join(shared, "digest").groupBy("row_key").agg(
        F.collect_set("no").alias("wanted")), "shared")  # at most the chunks of one document
    # Always a merge join: whether the list would fit a broadcast depends on the corpus.
    texts = listed(keyed.join(wanted.hint("merge"), "row_key")).filter(
        F.array_contains("wanted", F.col("c.no"))).select(
        "row_key", "id", F.col("c.no").alias("no"), body.alias("body"))
    texts = staged(texts.withColumn("place", F.struct(
        F.col("id").isNull().alias("unknown"), "id", "row_key", "no")).drop("id"), "bodies")
    # Stored, so that the join deals both sides by the text and can split a frequent one.
    first = staged(texts.groupBy("body").agg(F.min("place").alias("first"), F.count(
        F.lit(1)).alias("n")).filter("n > 1").drop("n"), "first")
    return texts.join(first, "body").filter(
        (F.col("place.row_key") != F.col("first.row_key")) | (F.col("no") != F.col("first.no"))
    ).select("row_key", "no")


def cut_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             divisor: int = DIVISOR, min_lines: int = MIN_LINES,
             long_words: int = LONG_WORDS) -> DataFrame:
    """(row, removed): every row as a struct, its text without repeats, and how many chunks went.

    A chunk (two or more lines, or one line of ``long_words`` words) that occurs more than once in
    the corpus stays at its first place only: smallest id (null ids last), then chunk number. A
    text without a repeat is unchanged; a null text stays null and an empty one empty. Rows with
    the same id and text count as one document, so an exact repeat of a row is no reason to
    remove anything. An empty table gives no rows.
    """
    gone = staged(repeated_chunks(docs, id_col, text_col, divisor, min_lines, long_words).groupBy(
        "row_key").agg(F.collect_set("no").alias("gone_chunks")), "gone")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                         row_key(id_col, text_col).alias("row_key"))
    joined = packed.join(gone.hint("merge"), "row_key", "left")
    own = F.col(f"row.`{text_col}`")
    kept = F.filter(chunks(own, divisor, long_words),
                    lambda c: ~F.array_contains(F.col("gone_chunks"), c["no"]))
    text = F.when(F.col("gone_chunks").isNull(), own).otherwise(
        F.array_join(F.flatten(F.transform(kept, lambda c: c["lines"])), "\n"))
    return joined.select(
        F.struct(*[(text if c == text_col else F.col(f"row.`{c}`")).alias(c)
                   for c in docs.columns]).alias("row"),
        F.coalesce(F.size("gone_chunks"), F.lit(0)).alias("removed"))


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    divisor: int = DIVISOR, min_lines: int = MIN_LINES,
                    long_words: int = LONG_WORDS) -> DataFrame:
    """All columns of ``docs`` as :func:`cut_rows` leaves them, and ``removed_chunks``.

    A column of that name in ``docs`` is replaced.
    """
    cut = cut_rows(docs, id_col, text_col, divisor, min_lines, long_words)
    kept = [c for c in docs.columns if c != "removed_chunks"]
    return cut.select(*[F.col(f"row.`{c}`") for c in kept], F.col("removed").alias("removed_chunks"))
