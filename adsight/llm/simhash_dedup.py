"""SimHash near-duplicates with pigeonring candidate filtering."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adsight.llm.graph import components
from adsight.plans.stages import staged

SEED = 42
BITS = 64
STEP = 1 << 15          # shingles whose bits are counted at once
LISTED = 64             # fingerprints of a bucket that are compared in place


def simhash(text: bytes | None, shingle: int) -> int:
    """Signed 64-bit fingerprint of the word shingles of a UTF-8 text; no words give zero."""
    tokens = (text or b"").lower().split()
    if not tokens:
        return 0
    if len(tokens) <= shingle:
        grams, n = iter([b" ".join(tokens)]), 1
    else:
        grams, n = map(b" ".join, zip(*(tokens[i:] for i in range(shingle)))), len(tokens) - shingle + 1
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for start in range(0, n, STEP):
        size = min(STEP, n - start)
        hashes = np.fromiter((digest(g, SEED) for g, _ in zip(grams, range(size))), np.uint64, size)
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = 3) -> DataFrame:
    """(id, fp): the fingerprint of every row's whole text. Null texts count as empty."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType),
                           T.StructField("fp", T.LongType())])

    def scan(batches):
        for batch in batches:
            found = [simhash(t.as_py(), shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())],
                                             names=[id_col, "fp"])

    narrow = docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("text_bytes"))
    return narrow.mapInArrow(scan, schema)


def ring_masks(radius: int) -> list[list[int]]:
    """mask[i][l-1]: the bits of l consecutive segments from segment i on a ring of 2r+1 segments."""
    parts = 2 * radius + 1
    edges = [BITS * i // parts for i in range(parts + 1)]
    own = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(parts)]
    masks = []
    for i in range(parts):
        chain, row = 0, []
        for length in range(parts):
            chain |= own[(i + length) % parts]
            row.append(chain - (1 << BITS) if chain >> (BITS - 1) else chain)
        masks.append(row)
    return masks


def _chain(masks: list[list[int]], radius: int) -> str:
    """SQL: every chain from the slot's segment keeps to its share floor(l*r/m) of differences."""
    parts = len(masks)
    tests = []
    for length in range(3, parts + 1):
        column = ", ".join(f"{masks[i][length - 1]}L" if masks[i][length - 1] != -(1 << 63)
                           else "bigint(-9223372036854775808)" for i in range(parts))
        tests.append(f"bit_count((a ^ b) & array({column})[slot]) <= {length * radius // parts}")
    return " AND ".join(tests)


def near_links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Links (u, v) between distinct fingerprints that join all those within ``radius`` bits.

    ``prints``: distinct ``fp``. The fingerprint is cut into m = 2r+1 segments on a ring. By the
    pigeonring principle two fingerprints within r bits have a segment from which *every* chain of
    l segments differs in at most floor(l*r/m) bits. For l = 2 that is zero, so the equality key
    is two neighbouring segments (about 26 of 64 bits for r = 2), and the longer chains prune the
    bucket before the last one, the whole ring, is the full Hamming check.

    A bucket of up to ``LISTED`` fingerprints is compared in place and emits only true links.
    Fuller buckets (families of near copies) are linked for r <= 2 without comparing pairs: two
    fingerprints within two bits have a common point within one bit of both, so each fingerprint
    names its 65 points and the at most 65 fingerprints of a point form a star.
    """
    masks = ring_masks(radius)
    slots = F.explode(F.array(*[
        F.struct(F.lit(i).alias("slot"), F.col("fp").bitwiseAND(F.lit(masks[i][1])).alias("part"))
        for i in range(len(masks))])).alias("k")
    keyed = prints.select("fp", slots).select("fp", "k.slot", "k.part")
    shared = keyed.groupBy("slot", "part").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    sized = staged(keyed.join(shared, ["slot", "part"]), "buckets")
    pairs = F.expr(
        "flatten(transform(fps, a -> transform(filter(fps, b -> b > a AND "
        f"{_chain(masks, radius)}), b -> struct(a AS u, b AS v))))")
    few = sized.filter(F.col("n") <= LISTED).groupBy("slot", "part").agg(
        F.collect_list("fp").alias("fps")).select(F.explode(pairs).alias("p")).select("p.u", "p.v")
    return few.union(_stars(sized.filter(F.col("n") > LISTED).select("fp").distinct())).distinct()


def _stars(prints: DataFrame) -> DataFrame:
    """Links of fingerprints within two bits of each other through their common points."""
    points = F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")
    near = prints.select("fp", F.explode(points).alias("point"))
    return near.groupBy("point").agg(F.collect_list("fp").alias("fps")).filter(
        F.size("fps") > 1).select(
        F.array_min("fps").alias("u"), F.explode("fps").alias("v")).filter("u != v")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = 3, radius: int = 2) -> DataFrame:
    """Per row: id, ``fp``, ``fingerprint`` (16 hex digits) and ``component_id``.

    Rows are linked when their fingerprints differ in at most ``radius`` (1 or 2) bits;
    ``component_id`` is the smallest id that can be reached, the row's own included. Equal texts
    share a fingerprint and are collapsed first, so a group of any number of copies costs one row.
    Null and empty texts have fingerprint zero and are linked like any other. Repeated ids stay
    as repeated rows; a component with no non-null id has a null ``component_id``. An empty table
    gives an empty result.
    """
    if radius not in (1, 2):
        raise ValueError("the star rule for full buckets holds for a radius of 1 or 2")
    prints = staged(fingerprints(docs, id_col, text_col, shingle), "prints")
    distinct = staged(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "distinct")
    links = near_links(distinct.select("fp"), radius)
    roots = components(links)
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = named.join(smallest, "root").select("fp", "component_id")
    return prints.join(labels, "fp").select(
        id_col, "fp", _hex(F.col("fp")).alias("fingerprint"), "component_id")


def _hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# --- similar documents ----------------------------------------------------------------------
RING = 12           # segments of a ring
FINE = 4            # shingles of a segment on the finer level, about
BUDGET = 14         # differing bits that a segment may have on average
SLOTS = 1 << 20     # counters that order shingles from rare to frequent
MAPS = 8            # 64-bit numbers of a set's parity bitmap


def ring_prints(hashes: np.ndarray) -> list[tuple[int, list[int | None]]]:
    """(level, segments): SimHashes of up to ``RING`` parts of a shingle set, at two part sizes.

    On level v the distinct shingles are dealt to 2^v parts by their hash, so similar sets have
    similar parts and most changes leave some part as it was. Sets of nearly the same size share a
    level. Parts without a shingle are None.
    """
    found = []
    first = max(0, int(np.log2(max(len(hashes), 1) / FINE)))
    dealt = (hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24)
    for level in (first, first + 1):
        part = (dealt & np.uint64((1 << level) - 1)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        order = order[:np.searchsorted(part[order], RING)]
        prints: list[int | None] = [None] * min(RING, 1 << level)
        if len(order):
            own = part[order]
            starts = np.flatnonzero(np.diff(own, prepend=-1))
            bits = np.unpackbits(hashes[order].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            ones = np.add.reduceat(bits.astype(np.int32), starts, axis=0)
            sizes = np.diff(np.append(starts, len(own)))[:, None]
            values = np.packbits(ones * 2 > sizes, axis=1).view(">i8").ravel().tolist()
            for place, value in zip(own[starts].tolist(), values):
                prints[place] = value
        found.append((level, prints))
    return found


def shingle_set(text: bytes | None, shingle: int) -> np.ndarray:
    """Distinct hashes of the word shingles; a shorter text is one shingle."""
    tokens = (text or b"").lower().split()
    if len(tokens) <= shingle:
        grams = [b" ".join(tokens)] if tokens else []
    else:
        grams = map(b" ".join, zip(*(tokens[i:] for i in range(shingle))))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64))


def _marked(docs: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """(row, key, rings): every row with the 128-bit hash of its words and its ring prints."""
    rings = T.ArrayType(T.StructType([T.StructField("level", T.IntegerType()),
                                      T.StructField("prints", T.ArrayType(T.LongType()))]))
    schema = T.StructType([T.StructField("row", T.StructType(docs.schema.fields)),
                           T.StructField("key", T.BinaryType()), T.StructField("rings", rings)])
    kind = pa.list_(pa.struct([("level", pa.int32()), ("prints", pa.list_(pa.int64()))]))

    def scan(batches):
        for batch in batches:
            keys, found = [], []
            for text in batch.column(1):
                text = text.as_py()
                keys.append(xxhash.xxh3_128_digest(b" ".join((text or b"").lower().split())))
                found.append([{"level": v, "prints": p}
                              for v, p in ring_prints(shingle_set(text, shingle))])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.binary()), pa.array(found, kind)],
                names=["row", "key", "rings"])

    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                         F.col(text_col).cast("binary").alias("text_bytes"))
    return packed.mapInArrow(scan, schema)


def _segments(nodes: DataFrame, *columns: str) -> DataFrame:
    """One row per text and segment that has a print."""
    return nodes.select(*columns, F.explode("rings").alias("r")).select(
        *columns, "r.level", F.posexplode("r.prints").alias("segment", "print")).filter(
        "print is not null")


BUCKET = ["level", "segment", "print"]


def _ring_pairs(nodes: DataFrame) -> DataFrame:
    """(u, v): texts that share a segment with its leader, within the budget of the whole ring.

    A leader is picked in every bucket by a hash of bucket and text, so families of any size give
    one pair per text and bucket, with different leaders in different buckets. This joins families
    cheaply; what it does not compare is left to :func:`_open_texts`.
    """
    keyed = _segments(nodes, "key")
    leaders = keyed.groupBy(*BUCKET).agg(
        F.min_by("key", F.xxhash64(*BUCKET, "key")).alias("leader"),
        F.count(F.lit(1)).alias("n")).filter("n > 1")
    pairs = keyed.join(leaders, BUCKET).filter("key != leader").select(
        F.least("key", "leader").alias("u"), F.greatest("key", "leader").alias("v"),
        "level").distinct()
    ring = lambda side: nodes.select(F.col("key").alias(side), F.explode("rings").alias("r")).select(
        side, "r.level", F.col("r.prints").alias(f"{side}_prints"))
    both = pairs.join(ring("u"), ["u", "level"]).join(ring("v"), ["v", "level"])
    gap = F.zip_with("u_prints", "v_prints", lambda a, b: F.coalesce(
        F.bit_count(a.bitwiseXOR(b)), F.when(a.isNull() & b.isNull(), 0).otherwise(BITS // 2)))
    total = F.aggregate(gap, F.lit(0), lambda a, d: a + d)
    return both.filter(total <= F.size("u_prints") * BUDGET).select("u", "v").distinct()


def _open_texts(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(key): texts of the buckets whose texts are not all in one component yet."""
    named = nodes.join(roots.withColumnRenamed("node", "key"), "key", "left").select(
        "key", "rings", F.xxhash64(F.coalesce("root", "key")).alias("root"))
    keyed = _segments(staged(named, "named"), "key", "root")
    mixed = keyed.groupBy(*BUCKET).agg(
        F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high")
    return keyed.join(mixed, BUCKET).select("key").distinct()


MAP_NAMES = [f"m{i}" for i in range(MAPS)]


def parity_map(hashes: np.ndarray) -> np.ndarray:
    """Bitmap of a set: a bit is 1 if an odd number of the hashes fall on it.

    Two sets' maps differ in at most as many bits as the sets in elements.
    """
    bit = (hashes.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)
    odd = np.bincount((bit % np.uint64(64 * MAPS)).astype(np.int64), minlength=64 * MAPS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _rare_rows(sets: DataFrame, similarity: float) -> DataFrame:
    """(key, h, size, place, short, maps): what a similar text shares of each text; exact.

    ``sets``: (key, set of distinct shingle hashes). Prefix filter: with all sets in one
    order of shingles, two similar sets share one of the first ones of both: the shorter one's
    first n - ceil(2t / (1 + t) * n) + 1 (``short``) and the longer one's first n - ceil(t * n) + 1.
    The order is from rare to frequent, by a table of ``SLOTS`` counters (any order is exact), so
    that shared boilerplate comes last. ``m0`` and so on: the set's bitmap, see :func:`parity_map`.
    """
    slot = F.col("h").bitwiseAND(F.lit(SLOTS - 1)).cast("int")
    found = sets.select(F.explode("set").alias("h")).groupBy(slot.alias("slot")).agg(
        F.count(F.lit(1)).alias("n")).toArrow()     # at most SLOTS rows
    often = np.zeros(SLOTS, np.int64)
    often[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    ask, index = similarity, 2 * similarity / (1 + similarity)
    kept = lambda n, share: n - int(np.ceil(share * n - 1e-9)) + 1

    def first(batches):
        for batch in batches:
            keys, hashes, sizes, places, short, maps = [], [], [], [], [], []
            for key, own in zip(*batch.columns):
                own = own.values.to_numpy(zero_copy_only=False)
                counts = often[own & (SLOTS - 1)]
                order = np.lexsort((own, counts))[:kept(len(own), ask)]
                at = np.flatnonzero(counts[order] > 1)      # the others are in no second set
                keys += [key.as_py()] * len(at)
                hashes.append(own[order[at]])
                sizes += [len(own)] * len(at)
                places.append(at)
                short.append(at < kept(len(own), index))
                maps.append(np.tile(parity_map(own), (len(at), 1)))
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.binary()),
                     pa.array(np.concatenate(hashes), pa.int64()), pa.array(sizes, pa.int32()),
                     pa.array(np.concatenate(places), pa.int32()),
                     pa.array(np.concatenate(short), pa.bool_()),
                     *(pa.array(column) for column in np.concatenate(maps).T.copy())],
                    names=["key", "h", "size", "place", "short", *MAP_NAMES])

    return sets.filter(F.size("set") > 0).mapInArrow(
        first, "key binary, h bigint, size int, place int, short boolean, "
        + ", ".join(f"{name} bigint" for name in MAP_NAMES))


def _mixed_rows(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of shingles whose texts are in several components, with each text's ``root``.

    ``root`` is a 64-bit hash of the component, ``main`` that of the shingle's largest one.
    """
    named = rows.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn(
        "root", F.when(F.col("root").isNotNull(), F.xxhash64("root")).otherwise(F.xxhash64("key")))
    main = named.groupBy("h", "root").agg(F.count(F.lit(1)).alias("n"), F.max("short").alias(
        "short")).groupBy("h").agg(F.max_by("root", F.struct("n", "root")).alias("main"),
                                   F.count(F.lit(1)).alias("roots"), F.max("short").alias(
                                       "short")).filter("roots > 1 AND short").drop("roots", "short")
    return staged(named.join(main, "h"), "mixed")


def _side(rows: DataFrame, name: str) -> DataFrame:
    return rows.select("h", *[F.col(c).alias(f"{name}_{c}") for c in (
        "key", "root", "size", "place", *MAP_NAMES)])


def _can_reach(similarity: float) -> Column:
    """Sizes, places and bitmaps leave room for the overlap that the similarity asks of a and b."""
    small, large = (f(F.col("a_size"), F.col("b_size")) for f in (F.least, F.greatest))
    total = F.col("a_size") + F.col("b_size")
    differ = sum((F.bit_count(F.col(f"a_{m}").bitwiseXOR(F.col(f"b_{m}"))) for m in MAP_NAMES),
                 F.lit(0))
    return (F.col("a_root") != F.col("b_root")) & (small >= large * similarity - 1e-9) & (
        F.least(F.col("a_size") - F.col("a_place"), F.col("b_size") - F.col("b_place"))
        >= total * (similarity / (1 + similarity)) - 1e-9) & (
        differ <= total * ((1 - similarity) / (1 + similarity)) + 1e-9)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a_key", "b_key").alias("u"),
                        F.greatest("a_key", "b_key").alias("v")).distinct()


def _rare_pairs(sets: DataFrame, similarity: float) -> DataFrame:
    """(u, v): a superset of all pairs of different components that reach ``similarity``; exact.

    ``sets``: (key, root, set); ``root`` names the component, null for a text without a link.
    The largest component of a shingle is not paired with itself, so a family that is joined
    already costs one pair per stray text; bitmaps keep the others of a family that is alike, but
    below the bound, from being paired.
    """
    rows = staged(_rare_rows(sets.select("key", "set"), similarity), "first")
    mixed = _mixed_rows(rows, sets.select(F.col("key").alias("node"), "root"))
    own, strays = F.col("root") == F.col("main"), F.col("root") != F.col("main")
    both = _can_reach(similarity) & (F.struct("a_size", "a_key") < F.struct("b_size", "b_key"))
    pairs = None
    for shorter, longer in ((strays, F.lit(True)), (own, strays)):
        some = _side(mixed.filter(F.col("short") & shorter), "a").join(
            _side(mixed.filter(longer), "b"), "h").filter(both)
        pairs = some if pairs is None else pairs.union(some)
    return _ordered(pairs)


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` with one row of each group of near duplicates, all columns.

    Two texts are linked when the Jaccard similarity of their sets of word shingles reaches
    ``similarity``; groups are connected by links, and the row with the smallest id stays (null
    ids last; of repeated rows one). The candidates come from SimHashes of parts of the shingle
    set on a ring: similar sets share at least one part's fingerprint (with 12 parts of four
    shingles, all but about 0.2 % at the bound). Each bucket first links its texts to one leader,
    within a budget of differing bits; all texts of buckets that this leaves in several components
    are then searched by an exact prefix filter, whatever the size of the bucket. The similarity
    of a candidate is computed on whole sets. Texts
    with equal words are one node of the graph, whatever their number. Null, empty and blank texts
    are equal. An empty table gives no rows.
    """
    marked = staged(_marked(docs, text_col, shingle).withColumn(
        "row_no", F.monotonically_increasing_id()), "marked")
    nodes = staged(marked.groupBy("key").agg(
        F.first("rings").alias("rings"), F.min("row_no").alias("row_no")), "nodes")

    def sets_of(asked: DataFrame) -> DataFrame:
        """(key, set): the shingle sets of the keys asked."""
        # One row of each text, by its number: a text with very many copies is not gathered. Always
        # merge joins, as what fits a broadcast depends on the corpus.
        read = nodes.join(asked, "key", "left_semi").select("row_no")
        texts = marked.select("row_no", "key", F.col(f"row.`{text_col}`").cast("binary").alias(
            "text_bytes")).join(read.hint("merge"), "row_no", "left_semi").select("key", "text_bytes")
        return staged(texts.mapInArrow(sets, "key binary, set array<bigint>"), "sets")

    def sets(batches):
        for batch in batches:
            found = [shingle_set(t.as_py(), shingle).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["key", "set"])

    def similar(pairs: DataFrame, known: DataFrame) -> DataFrame:
        side = lambda name: known.select(F.col("key").alias(name), F.col("set").alias(f"{name}_set"))
        both = F.size(F.array_intersect("u_set", "v_set"))
        return pairs.join(side("u"), "u").join(side("v"), "v").filter(
            both >= similarity * (F.size("u_set") + F.size("v_set") - both)).select("u", "v")

    pairs = staged(_ring_pairs(nodes), "pairs")
    asked = pairs.select(F.col("u").alias("key")).union(pairs.select("v")).distinct()
    links = staged(similar(pairs, sets_of(asked)), "ring_links")
    roots = components(links)
    left = staged(_open_texts(nodes, roots), "open")
    known = sets_of(left)
    named = known.join(roots.withColumnRenamed("node", "key"), "key", "left")
    rest = staged(_rare_pairs(named, similarity), "rare_pairs")
    roots = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).union(
        similar(rest, known)))
    place = F.struct(F.col(f"row.`{id_col}`").isNull().alias("unknown"),
                     F.col(f"row.`{id_col}`").alias("id"), "row_no")
    least = marked.select("key", place.alias("place")).groupBy("key").agg(
        F.min("place").alias("place"))
    stays = least.join(roots.withColumnRenamed("node", "key"), "key", "left").groupBy(
        F.coalesce("root", "key").alias("root")).agg(F.min("place").alias("place")).select(
        F.col("place.row_no").alias("row_no"))
    return marked.join(stays.hint("merge"), "row_no", "left_semi").select("row.*")
