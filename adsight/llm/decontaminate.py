"""Benchmark leaks: SimHash of item-sized windows, multi-index Hamming blocks, exact check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adsight.llm.common import row_key, words
from adsight.plans.stages import staged

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 24             # cosine 0.8 gives 13 of 64 bits on average, with a deviation of 3.2
BROADCAST_ROWS = 500_000    # benchmark shingles of 16 bytes; more of them are joined by a shuffle


def _let(value: Column, function) -> Column:
    """Binds a value once for use inside lambdas, where a plain column is evaluated again."""
    return F.transform(F.array(value), function)[0]


def shingle_hashes(tokens: Column, size: int) -> Column:
    """64-bit hashes of all runs of ``size`` words, in order; empty with fewer words."""
    def runs(w: Column) -> Column:
        last = F.size(w) - size
        return F.when(last >= 0, F.transform(
            F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[w[i + k] for k in range(size)]))
        ).otherwise(F.array().cast("array<bigint>"))
    return _let(tokens, runs)


def simhash(hashes: Column) -> Column:
    """64-bit majority fingerprint of an array of hashes."""
    def majority(h: Column) -> Column:
        bit = lambda b: F.when(
            F.size(F.filter(h, lambda x: F.call_function("getbit", x, b) == 1)) * 2 > F.size(h),
            F.call_function("shiftleft", F.lit(1).cast("bigint"), b)).otherwise(
            F.lit(0).cast("bigint"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("bigint"),
                           lambda total, b: total.bitwiseOR(bit(b)))
    return _let(hashes, majority)


def blocks(fingerprint: Column, radius: int) -> Column:
    """radius + 1 disjoint blocks: fingerprints within the radius share at least one unchanged."""
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    parts = []
    for no, (low, high) in enumerate(zip(edges, edges[1:])):
        mask = (1 << high) - (1 << low)
        mask -= (1 << 64) if mask >> 63 else 0
        parts.append(F.struct(F.lit(no).alias("block"),
                              fingerprint.bitwiseAND(F.lit(mask)).alias("value")))
    return F.array(*parts)


def _similarity(a: Column, b: Column) -> Column:
    """Weighted overlap of two arrays of shingles, weights being the numbers of occurrences.

    2 x sum of the smaller weights / sum of all weights; for item-sized windows this is the share
    of the item's shingles that the window has.
    """
    times = lambda xs, h: F.size(F.filter(xs, lambda x: x == h))
    both = F.aggregate(F.array_distinct(a), F.lit(0),
                       lambda total, h: total + F.least(times(a, h), times(b, h)))
    return 2.0 * both / (F.size(a) + F.size(b))


def _items(benchmark: DataFrame, item_col: str, text_col: str, size: int) -> DataFrame:
    """Items with their shingles: size words, all of them where an item is shorter."""
    tokens = words(text_col)
    listed = benchmark.select(row_key(item_col, text_col).alias("item"),
                              F.col(item_col).alias("item_label"), tokens.alias("tokens")).filter(
        F.size("tokens") > 0).distinct()
    cases = F.lit(None).cast("array<bigint>")
    for k in range(1, size + 1):
        fits = (F.size("tokens") == k) if k < size else (F.size("tokens") >= size)
        cases = F.when(fits, shingle_hashes(F.col("tokens"), k)).otherwise(cases)
    return listed.select("item", "item_label", F.size("tokens").alias("n_words"),
                         F.least(F.size("tokens"), F.lit(size)).alias("k"),
                         cases.alias("own")).withColumn("item_fp", simhash(F.col("own")))


def windows(docs: DataFrame, items: DataFrame, id_col: str, text_col: str,
            sizes: list[int], similarity: float) -> DataFrame:
    """(row_key, item, start): all item-sized windows that can reach the similarity, at any start.

    A window reaches it only if enough of its places hold a shingle of the item, in any order. With
    the document's shared places sorted, the windows whose first shared place is the i-th have
    enough of them from a start that follows from the place that many further on: the starts are
    ranges, found without listing any other window.
    """
    grams = items.select("item", "n_words", "k", F.size("own").alias("n_own"),
                         F.explode(F.array_distinct("own")).alias("h"))
    wanted = staged(grams, "item_shingles")
    few = wanted.count() <= BROADCAST_ROWS  # the size is checked before anything is broadcast
    known = F.broadcast(wanted) if few else wanted
    keyed = docs.select(row_key(id_col, text_col).alias("row_key"), words(text_col).alias("w"))
    shared = None
    for k in sizes:
        spread = keyed.select("row_key", F.size("w").alias("n_doc"), F.posexplode(
            shingle_hashes(F.col("w"), k)).alias("pos", "h"))
        own = spread.join(known.filter(F.col("k") == k), "h").select(
            "row_key", "item", "n_own", "n_words", "n_doc", "k", "pos")
        shared = own if shared is None else shared.union(own)
    # Repeated rows of a document share its key, so places are told once.
    placed = shared.groupBy("row_key", "item", "n_own", "n_words", "n_doc", "k").agg(
        F.array_sort(F.collect_set("pos")).alias("places"))
    theirs = F.least("n_own", F.greatest(F.lit(1), F.col("n_doc") - F.col("k") + 1))
    enough = F.greatest(F.lit(1), F.ceil(
        (F.col("n_own") + theirs) * F.lit(similarity / 2) - 1e-9).cast("int"))
    fit = placed.withColumns({
        "enough": enough, "last": F.greatest(F.lit(0), F.col("n_doc") - F.col("n_words"))}).filter(
        F.size("places") >= F.col("enough"))
    place = lambda i: F.try_element_at("places", i)

    def starts(i: Column) -> Column:
        low = F.greatest(F.coalesce(F.when(i > 1, place(i - 1)) + 1, F.lit(0)),
                         place(i + F.col("enough") - 1) - F.col("n_own") + 1)
        high = F.least(place(i), F.col("last"))
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    ranges = F.transform(F.sequence(F.lit(1), F.size("places") - F.col("enough") + 1), starts)
    return fit.select("row_key", "item", F.explode(F.flatten(ranges)).alias("start"))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text_col: str = "text", shingle: int = SHINGLE,
          similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """One row per document and benchmark item found in it, at its best window.

    Columns: row_key, the id, the item id, start (word), n_words, hamming, similarity. Windows of
    the item's length at every start with enough shared shingles get a SimHash; with radius + 1
    blocks every fingerprint within the radius of the item's shares a block and becomes a
    candidate, and candidates count if their weighted shingle similarity reaches the bound.
    Ties go to the smallest start. Items without a word never match; items shorter than the
    shingle are compared as a whole. Null and empty texts match nothing; repeated rows of the
    documents give one row; repeated items with different ids give one each; null ids are kept.
    Either table may be empty. Extra columns are ignored.
    """
    items = staged(_items(benchmark, item_col, item_text_col, shingle), "items")
    sizes = sorted(r["k"] for r in items.select("k").distinct().collect())  # at most ``shingle``
    schema_id, schema_item = docs.schema[id_col], benchmark.schema[item_col]
    spark = docs.sparkSession
    if not sizes:
        kinds = (f"row_key binary, `{id_col}` {schema_id.dataType.simpleString()}, `{item_col}` "
                 f"{schema_item.dataType.simpleString()}, start int, n_words int, hamming int, "
                 "similarity double")
        return spark.createDataFrame([], kinds)
    placed = staged(windows(docs, items, id_col, text_col, sizes, similarity), "windows")
    texts = docs.select(row_key(id_col, text_col).alias("row_key"), F.col(id_col).alias("own_id"),
                        F.col(text_col).alias("own_text"))
    hit = placed.select("row_key").distinct()
    texts = staged(texts.join(hit, "row_key", "left_semi").distinct().select(
        "row_key", "own_id", words("own_text").alias("w")), "hit_texts")
    sized = placed.join(items.select("item", "item_label", "n_words", "k"), "item")
    cut = sized.join(texts, "row_key").withColumn(
        "start", F.greatest(F.lit(0), F.least("start", F.size("w") - F.col("n_words")))).dropDuplicates(
        ["row_key", "item", "start"])
    part = F.slice("w", F.col("start") + 1, F.col("n_words"))
    shingles = F.lit(None).cast("array<bigint>")
    for k in sizes:
        shingles = F.when(F.col("k") == k, shingle_hashes(part, k)).otherwise(shingles)
    seen = staged(cut.select("row_key", "own_id", "item", "item_label", "start", "n_words",
                             shingles.alias("theirs")).withColumn("fp", simhash(F.col("theirs"))),
                  "fingerprints")
    probes = seen.select("row_key", "item", "start", "fp",
                         F.explode(blocks(F.col("fp"), radius)).alias("b")).select(
        "row_key", "item", "start", "fp", "b.block", "b.value")
    index = items.select("item", "item_fp", F.explode(
        blocks(F.col("item_fp"), radius)).alias("b")).select(
        "item", "item_fp", "b.block", "b.value")
    hamming = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    near = probes.join(index, ["item", "block", "value"]).select(
        "row_key", "item", "start", hamming.alias("hamming")).filter(
        F.col("hamming") <= radius).distinct()
    checked = seen.join(near, ["row_key", "item", "start"]).join(
        items.select("item", "own"), "item").withColumn(
        "similarity", _similarity(F.col("own"), F.col("theirs"))).filter(
        F.col("similarity") >= similarity)
    best = checked.groupBy("row_key", "own_id", "item_label").agg(F.max_by(
        F.struct("start", "n_words", "hamming", "similarity"),
        F.struct("similarity", -F.col("start"))).alias("best"))
    return best.select("row_key", F.col("own_id").alias(id_col), F.col("item_label").alias(item_col), "best.*")
