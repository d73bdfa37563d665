"""Importance resampling towards a target text distribution, over hashed word n-grams."""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adsight.plans.stages import staged

BUCKETS = 10_000
LONGEST = 3             # words of the longest feature
BATCH_BYTES = 1 << 19   # text whose features share one table
WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FREE = -1


class InternTable:
    """Open-addressed table of byte strings: slots of key, first owner, bucket and count.

    A string's key is its XXH64; a slot belongs to it only if the bytes are equal too, otherwise
    the next slot is tried. All strings of a call are placed together, round by round.
    """

    def __init__(self, raw: np.ndarray, most: int):
        self.size = 1 << max(4, (2 * most - 1).bit_length())
        self.keys = np.zeros(self.size, np.uint64)
        self.owners = np.full(self.size, FREE, np.int64)
        self.starts = np.zeros(self.size, np.int64)
        self.lengths = np.zeros(self.size, np.int64)
        self.buckets = np.zeros(self.size, np.int64)
        self.counts = np.zeros(self.size, np.int64)
        # Eight bytes from every place on, as one number.
        padded = np.concatenate((raw, np.zeros(16, np.uint8)))
        self.lanes = np.ndarray((len(raw) + 8,), "<u8", padded, strides=(1,))

    def equal(self, first: np.ndarray, second: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Which stretches of equal length hold the same bytes."""
        same = np.ones(len(first), bool)
        open_, done = np.arange(len(first)), 0
        while len(open_):
            rest = np.minimum(lengths[open_] - done, 8)
            shift = ((8 - rest) * 8).astype(np.uint64)
            differ = (self.lanes[first[open_] + done] ^ self.lanes[second[open_] + done]) << shift
            same[open_[differ != 0]] = False
            done += 8
            open_ = open_[(differ == 0) & (lengths[open_] > done)]
        return same

    def intern(self, keys: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The slot of every string; equal strings get the same one. Counts every occurrence."""
        mask = np.uint64(self.size - 1)
        slots = (keys & mask).astype(np.int64)
        open_ = np.arange(len(keys))
        while len(open_):
            at = slots[open_]
            # Of several strings that want a free slot the last one gets it; all then compare.
            claim, own = (x[self.owners[at] == FREE] for x in (at, open_))
            self.owners[claim] = own
            own = self.owners[claim]
            self.starts[claim], self.lengths[claim] = starts[own], lengths[own]
            self.keys[claim] = keys[own]
            match = (self.keys[at] == keys[open_]) & (self.lengths[at] == lengths[open_])
            some = np.flatnonzero(match & (self.owners[at] != open_))
            match[some] = self.equal(starts[open_[some]], self.starts[at[some]],
                                     lengths[open_[some]])
            open_ = open_[~match]
            slots[open_] = (slots[open_] + 1) & int(mask)
        self.counts += np.bincount(slots, minlength=self.size)
        return slots


# The primes of XXH64 and the reflected polynomial of CRC-32.
PRIMES = [np.uint64(p) for p in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63,
    0x27D4EB2F165667C5)]
POLYNOMIAL = 0xEDB88320


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint64(by) | x >> np.uint64(64 - by)


def xxh64(lanes: list[np.ndarray]) -> np.ndarray:
    """XXH64 of up to three 64-bit numbers, as little-endian bytes, for every row."""
    one, two, three, four, five = PRIMES
    h = np.full(len(lanes[0]), five + np.uint64(8 * len(lanes)), np.uint64)
    for lane in lanes:
        h ^= _turned(lane * two, 31) * one
        h = _turned(h, 27) * one + four
    h = (h ^ h >> np.uint64(33)) * two
    h = (h ^ h >> np.uint64(29)) * three
    return h ^ h >> np.uint64(32)


def _append_tables(most: int) -> np.ndarray:
    """[n, k, byte]: what byte k of a checksum becomes when n more bytes follow."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, step >> 1 ^ np.uint32(POLYNOMIAL), step >> 1).astype(np.uint32)
    tables = np.empty((most + 1, 4, 256), np.uint32)
    for k in range(4):
        tables[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(most):
        tables[n + 1] = tables[n] >> np.uint32(8) ^ step[tables[n] & np.uint32(255)]
    return tables


APPENDED = _append_tables(128)


def joined_crc(first: np.ndarray, second: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 of two strings in sequence from theirs; ``sizes``: bytes of the second ones."""
    out = first
    while (sizes > 0).any():
        step = np.minimum(sizes, len(APPENDED) - 1)
        out = np.bitwise_xor.reduce([
            APPENDED[step, k, out >> np.uint32(8 * k) & np.uint32(255)] for k in range(4)])
        sizes = sizes - step
    return out ^ second


class Features:
    """Word n-grams of a batch of texts: a slot for every occurrence, a bucket for every slot.

    Words are hashed by the library. The key of an n-gram is the XXH64 of its words' hashes, and
    its CRC-32 is joined from theirs, both for all n-grams at once.
    """

    def __init__(self, texts: list[bytes]):
        words = [WORDS.findall(text.lower()) for text in texts]
        self.words = np.array([len(w) for w in words], np.int64)
        flat = [w for own in words for w in own]
        raw = b" ".join(flat)
        lengths = np.fromiter(map(len, flat), np.int64, len(flat))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, flat), np.uint64, len(flat))
        crcs = np.fromiter(map(zlib.crc32, flat), np.uint32, len(flat))
        blank = np.full(len(flat), zlib.crc32(b" "), np.uint32)
        after_blank = joined_crc(blank, crcs, lengths)
        ends = np.cumsum(lengths + 1) - 1
        text = np.repeat(np.arange(len(texts)), self.words)
        starts, stops, owners, keys, sums = [], [], [], [], []
        for n in range(1, LONGEST + 1):
            first = np.arange(max(len(flat) - n + 1, 0))
            first = first[text[first] == text[first + n - 1]]
            last = first + n - 1
            starts.append((ends - lengths)[first])
            stops.append(ends[last])
            owners.append(text[first])
            keys.append(xxh64([hashes[first + k] for k in range(n)]))
            sums.append(crcs if n == 1 else joined_crc(
                whole[first], after_blank[last], lengths[last] + 1))
            # Checksums of the n-grams by their first word, for the next longer ones.
            whole = np.zeros(len(flat), np.uint32)
            whole[first] = sums[-1]
        start, stop = np.concatenate(starts), np.concatenate(stops)
        self.owners = np.concatenate(owners)
        self.table = InternTable(np.frombuffer(raw, np.uint8), len(start))
        self.slots = self.table.intern(np.concatenate(keys), start, stop - start)
        self.used = used = np.flatnonzero(self.table.counts)
        self.table.buckets[used] = np.concatenate(sums)[self.table.owners[used]] % np.uint32(
            BUCKETS)

    def bucket_counts(self) -> np.ndarray:
        """Occurrences in every bucket."""
        out = np.zeros(BUCKETS, np.int64)
        np.add.at(out, self.table.buckets[self.used], self.table.counts[self.used])
        return out

    def per_text(self) -> np.ndarray:
        """Features of every text."""
        return np.bincount(self.owners, minlength=len(self.words))

    def weights(self, gains: np.ndarray) -> np.ndarray:
        """Sum of the gains of every text's features, gathered by the slots of occurrences."""
        out = np.zeros(len(self.words), np.int64)
        np.add.at(out, self.owners, gains[self.table.buckets][self.slots])
        return out


def _batches(batches, column: int):
    """Columns in pieces of about ``BATCH_BYTES`` of text."""
    for batch in batches:
        sizes = np.array(pc.fill_null(pc.binary_length(batch.column(column)), 0))
        cuts = np.cumsum(sizes) // BATCH_BYTES
        edges = [0, *(np.flatnonzero(np.diff(cuts)) + 1).tolist(), batch.num_rows]
        for i, j in zip(edges, edges[1:]):
            if j > i:
                part = batch.slice(i, j - i)
                yield part, [t or b"" for t in part.column(column).to_pylist()]


def bucket_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """bucket and n: how many features of all texts fall into it (empty buckets have no row)."""
    def scan(batches):
        total = np.zeros(BUCKETS, np.int64)
        for _, own in _batches(batches, 0):
            total += Features(own).bucket_counts()
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])],
                                         names=["bucket", "n"])

    return (texts.select(F.col(text_col).cast("binary").alias("text_bytes"))
            .mapInArrow(scan, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")))


def _gains(raw: DataFrame, target: DataFrame, raw_col: str, target_col: str) -> np.ndarray:
    """Gain of every bucket; at most ``BUCKETS`` rows of each side reach the driver."""
    raw_n, target_n = (np.zeros(BUCKETS), np.zeros(BUCKETS))
    for out, texts, column in ((raw_n, raw, raw_col), (target_n, target, target_col)):
        for row in bucket_counts(texts, column).collect():
            out[row["bucket"]] = row["n"]
    every, wanted = float(raw_n.sum()) + BUCKETS, float(target_n.sum()) + BUCKETS
    return np.array([math.floor(1000 * math.log((t + 1) * every / ((s + 1) * wanted)))
                     for s, t in zip(raw_n.tolist(), target_n.tolist())], np.int64)


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             target_col: str = "text", percent: int = 5, least_words: int = 20,
             seed: int = 42) -> DataFrame:
    """Draws ``percent`` of the documents by importance weight with Gumbel noise.

    Features: runs of 1 to 3 words (letters, digits and all beyond ASCII, A-Z lower-cased), hashed
    to buckets. Returns n_features, weight (sum of bucket gains), score and rank of every document;
    rank is null if it is not drawn. Documents under ``least_words`` are never drawn. Null and empty
    texts have no features and weight 0. Ties go to the smaller id, then (equal ids, null ids,
    which come last) in a fixed order; repeated rows are counted and ranked each; the noise of a
    null id is that of an empty id. Empty tables give no rows; an empty target counts no features.

    Two passes over the texts, both without a shuffle of texts or features: per task at most one
    number per bucket is passed on, so no n-gram can be hot. Ranks come from one range exchange of
    narrow rows: a row's rank is its place in its range plus the sizes of the ranges before, one
    number per range.
    """
    spark = docs.sparkSession
    gains = spark.sparkContext.broadcast(_gains(docs, target, text_col, target_col))
    kind = docs.schema[id_col].dataType
    schema = T.StructType([
        T.StructField("id", kind), T.StructField("n_features", T.LongType()),
        T.StructField("weight", T.LongType()), T.StructField("words", T.LongType())])

    def scan(batches):
        for part, texts in _batches(batches, 1):
            features = Features(texts)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(features.per_text()),
                 pa.array(features.weights(gains.value)), pa.array(features.words)],
                names=schema.names)

    weighted = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")
                           ).mapInArrow(scan, schema)
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = staged(weighted.withColumn("score", F.col("weight") + noise).withColumn(
        "fit", F.col("words") >= least_words).withColumn(
        "row", F.monotonically_increasing_id()), "scored")
    order = [F.desc("fit"), F.desc("score"), F.asc_nulls_last("id"), F.asc("row")]
    placed = staged(scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
        "place", F.monotonically_increasing_id()), "placed")
    # The upper part of the place is the number of the range, the lower one the row's place in it.
    ranges = placed.groupBy(F.shiftright("place", 33).alias("range")).agg(
        F.count("*").alias("n"), F.count_if("fit").alias("fit")).orderBy("range").collect()
    drawn = sum(r["fit"] for r in ranges) * percent // 100
    before, rows = 0, []
    for r in ranges:
        rows.append((r["range"], before))
        before += r["n"]
    offsets = spark.createDataFrame(rows, "range bigint, before bigint")
    rank = F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    return (placed.withColumn("range", F.shiftright("place", 33))
            .join(F.broadcast(offsets), "range", "left")
            .select(F.col("id").alias(id_col), "n_features", "weight", "score",
                    F.when(F.col("fit") & (rank <= drawn), rank).alias("rank")))
