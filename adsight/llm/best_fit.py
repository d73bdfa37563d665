"""Conflict-constrained best-fit packing of documents into fixed-size sequences."""

from __future__ import annotations

import bisect
from collections import Counter, defaultdict

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adsight.llm.common import words
from adsight.plans.stages import staged

SHARD = 2000    # pieces that are packed together; bounds the memory of a group


class Bins:
    """Bins ordered by residual space; each carries bitmaps of its sources and clusters."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.residuals: list[int] = []                       # residuals in use, ascending
        self.at: dict[int, dict[int, list[int]]] = {}        # residual -> source bitmap -> bins
        self.clusters: list[int] = []                        # bin -> cluster bitmap
        self.free: list[int] = []                            # bin -> residual

    def place(self, need: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, offset): the tightest bin without the source and cluster bits, else a new one."""
        where = bisect.bisect_left(self.residuals, need)
        while where < len(self.residuals):
            space = self.residuals[where]
            for mask, bins in self.at[space].items():
                if mask & source:
                    continue
                for place, number in enumerate(bins):
                    if not self.clusters[number] & cluster:
                        del bins[place]
                        self._drop(space, mask)
                        return number, self._put(number, space, mask, need, source, cluster)
            where += 1
        self.clusters.append(0)
        self.free.append(self.capacity)
        number = len(self.free) - 1
        return number, self._put(number, self.capacity, 0, need, source, cluster)

    def _drop(self, space: int, mask: int) -> None:
        if not self.at[space][mask]:
            del self.at[space][mask]
            if not self.at[space]:
                del self.at[space]
                self.residuals.pop(bisect.bisect_left(self.residuals, space))

    def _put(self, number, space, mask, need, source, cluster) -> int:
        left = space - need
        if left not in self.at:
            bisect.insort(self.residuals, left)
            self.at[left] = defaultdict(list)
        self.at[left][mask | source].append(number)
        self.clusters[number] |= cluster
        self.free[number] = left
        return self.capacity - space


def pack_shard(lengths, sources, clusters, capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of every piece, in the given order; null sources and clusters never conflict."""
    bit: dict = {}
    seen: dict = {}
    times = Counter(clusters)
    bins, out = Bins(capacity), []
    for length, source, cluster in zip(lengths, sources, clusters):
        mask = 0 if source is None else 1 << bit.setdefault(source, len(bit))
        own = 0
        if cluster is not None and times[cluster] > 1:
            own = 1 << seen.setdefault(cluster, len(seen))
        out.append(bins.place(length, mask, own))
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         source_col: str = "source", cluster_col: str | None = None,
         capacity: int = 2048) -> DataFrame:
    """One row per piece: id, piece, start, length, shard, bin, bin_offset.

    The length of a document is its number of words. Longer ones than ``capacity`` are split into
    full pieces and a rest, losing nothing. A bin never holds two pieces of one source or of one
    cluster of duplicates (``cluster_col``, by default equal word sequences). Longer pieces are
    placed first, each in the tightest compatible bin; ties go by cluster, then in the order of the
    staged rows. Pieces are dealt to shards of about ``SHARD`` by a hash of their row number, never
    by source, cluster or id, so a source (or repeated row) with a third of all rows is spread over
    all shards. Null or empty texts become one
    piece of length 0; null ids and repeated rows are packed like others; an empty table gives no
    rows.
    """
    tokens = words(text_col)
    cluster = F.xxhash64(tokens) if cluster_col is None else F.xxhash64(
        F.col(cluster_col).cast("string"))
    if cluster_col is not None:
        cluster = F.when(F.col(cluster_col).isNotNull(), cluster)
    sized = docs.select(
        F.col(id_col), F.col(source_col).cast("string").alias("own_source"),
        cluster.alias("own_cluster"), F.size(tokens).alias("n_words"))
    cut = F.expr(f"sequence(0, cast(greatest(n_words - 1, 0) div {capacity} as int))")
    pieces = sized.select(
        "*", F.explode(cut).alias("piece")).withColumns({
            "start": F.col("piece") * capacity,
            "length": F.least(F.lit(capacity), F.col("n_words") - F.col("piece") * capacity)})
    pieces = staged(pieces.withColumn("row_no", F.monotonically_increasing_id()), "pieces")
    shards = pieces.count() // SHARD + 1
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("row_no"), F.lit(shards)).cast("int"))
    schema = T.StructType([
        docs.schema[id_col], T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType()),
        T.StructField("shard", T.IntegerType()), T.StructField("bin", T.IntegerType()),
        T.StructField("bin_offset", T.IntegerType())])

    def place(group: pa.Table) -> pa.Table:
        order = pc.sort_indices(group, sort_keys=[
            ("length", "descending"), ("own_cluster", "ascending"), ("row_no", "ascending")])
        group = group.take(order)
        found = pack_shard(*(group[c].to_pylist() for c in ("length", "own_source", "own_cluster")),
                           capacity)
        return group.select([id_col, "piece", "start", "length", "shard"]).append_column(
            "bin", pa.array([b for b, _ in found], pa.int32())).append_column(
            "bin_offset", pa.array([o for _, o in found], pa.int32()))

    return dealt.groupBy("shard").applyInArrow(place, schema)
