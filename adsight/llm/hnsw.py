"""Approximate nearest neighbours: small-world graphs of bounded shards, results merged."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adsight.plans.stages import staged

SHARD = 8192        # distinct vectors of a graph
QUERIES = 4096      # queries that one search task answers on one graph
LINKS = 12          # neighbours of a node on the upper layers; twice as many on the lowest
BUILD_WIDTH = 80    # candidates kept while building
SEARCH_WIDTH = 96   # candidates kept while searching


class Graph:
    """Hierarchical navigable small-world graph in flat arrays.

    ``points`` holds the vectors with one more component that gives all the same length, so that
    the largest inner product with (query, 0) is the smallest distance. ``links[layer]`` is a
    matrix of neighbour numbers, -1 where there is none; ``rank[layer]`` maps a node to its row.
    """

    def __init__(self, points: np.ndarray, links: list[np.ndarray], rank: list[np.ndarray],
                 entry: int):
        self.points, self.links, self.rank, self.entry = points, links, rank, entry
        self.seen, self.mark = np.zeros(len(points), np.int64), 0

    @classmethod
    def build(cls, vectors: np.ndarray, names: np.ndarray) -> Graph:
        """Inserts the vectors in order; a node's top layer follows from a hash of its name."""
        square = np.einsum("ij,ij->i", vectors, vectors)
        points = np.hstack((vectors, np.sqrt(np.maximum(square.max() - square, 0))[:, None]))
        points = np.ascontiguousarray(points, np.float32)
        height = np.array([int(-math.log((xxhash.xxh64_intdigest(str(n)) + 1) / 2.0 ** 64)
                               / math.log(LINKS)) for n in names.tolist()])
        links, rank = [], []
        for layer in range(int(height.max()) + 1):
            members = np.flatnonzero(height >= layer)
            place = np.full(len(points), -1, np.int32)
            place[members] = np.arange(len(members))
            rank.append(place)
            links.append(np.full((len(members), LINKS if layer else 2 * LINKS), -1, np.int32))
        graph = cls(points, links, rank, 0)
        top = int(height[0])
        for node in range(1, len(points)):
            entry = graph.entry
            for layer in range(top, int(height[node]), -1):
                entry = graph._walk(points[node], entry, 1, layer)[0][1]
            for layer in range(min(top, int(height[node])), -1, -1):
                near = sorted(graph._walk(points[node], entry, BUILD_WIDTH, layer), reverse=True)
                entry = near[0][1]
                graph._join(node, np.array([n for _, n in near]), layer)
            if height[node] > top:
                top, graph.entry = int(height[node]), node
        return graph

    def _walk(self, query: np.ndarray, entry: int, width: int, layer: int) -> list:
        """Best ``width`` (nearness, node) reached greedily from the entry, as a heap."""
        self.mark += 1
        links, rank, points, seen = self.links[layer], self.rank[layer], self.points, self.seen
        seen[entry] = self.mark
        first = float(points[entry] @ query)
        open_, best = [(-first, entry)], [(first, entry)]
        while open_:
            near, node = heapq.heappop(open_)
            if len(best) >= width and -near < best[0][0]:
                break
            others = links[rank[node]]
            others = others[others >= 0]
            others = others[seen[others] != self.mark]
            if not len(others):
                continue
            seen[others] = self.mark
            for value, other in zip((points[others] @ query).tolist(), others.tolist()):
                if len(best) < width:
                    heapq.heappush(best, (value, other))
                elif value > best[0][0]:
                    heapq.heapreplace(best, (value, other))
                else:
                    continue
                heapq.heappush(open_, (-value, other))
        return best

    def _spread(self, node: int, near: np.ndarray, most: int) -> list[int]:
        """Neighbours, nearest first, that are nearer to the node than to one chosen before."""
        own = self.points[near] @ self.points[node]
        if len(near) <= most:
            return near.tolist()
        among = self.points[near] @ self.points[near].T
        chosen, left = [], []
        for i in range(len(near)):
            if len(chosen) == most:
                break
            if not chosen or among[i, chosen].max() < own[i]:
                chosen.append(i)
            else:
                left.append(i)
        return near[chosen + left[:most - len(chosen)]].tolist()

    def _join(self, node: int, near: np.ndarray, layer: int) -> None:
        links, rank = self.links[layer], self.rank[layer]
        most = links.shape[1]
        chosen = self._spread(node, near, LINKS)
        links[rank[node], :len(chosen)] = chosen
        for other in chosen:
            row = links[rank[other]]
            free = np.flatnonzero(row < 0)
            if len(free):
                row[free[0]] = node
                continue
            rivals = np.append(row, node)
            rivals = rivals[np.argsort(-(self.points[rivals] @ self.points[other]), kind="stable")]
            kept = self._spread(other, rivals, most)
            row[:] = -1
            row[:len(kept)] = kept

    def search(self, query: np.ndarray, width: int) -> list[int]:
        """The ``width`` nodes found with the largest inner product."""
        query = np.append(query, 0).astype(np.float32)
        entry = self.entry
        for layer in range(len(self.links) - 1, 0, -1):
            entry = self._walk(query, entry, 1, layer)[0][1]
        return [node for _, node in self._walk(query, entry, width, 0)]


def usable(vector: Column) -> Column:
    """Vectors without null or non-finite components and not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return fine & F.exists(vector, lambda x: x != 0)


def distinct_vectors(vectors: DataFrame, id_col: str, vector_col: str, members: int) -> DataFrame:
    """(vector, members, name): equal vectors once, with their smallest ids.

    A search returns at most ``members`` - 1 ids of equal vectors besides the query's own, so no
    answer needs more. The limit is applied before the shuffle too: a vector shared by a third of
    all rows sends that many ids per task.
    """
    first = Window.partitionBy("vector").orderBy("id")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast(
        "array<double>").alias("vector")).filter(F.col("id").isNotNull() & usable(F.col("vector")))
    return rows.distinct().withColumn("place", F.row_number().over(first)).filter(
        F.col("place") <= members).groupBy("vector").agg(
        F.sort_array(F.collect_list("id")).alias("members")).withColumn(
        "name", F.col("members")[0])


INDEX = ("shard bigint, names binary, points binary, members binary, vectors binary, "
         "width int, layers array<binary>, ranks array<binary>, entry int")


def build_index(distinct: DataFrame) -> DataFrame:
    """One row per shard: the graph's flat neighbour arrays, its vectors and their ids.

    Vectors are dealt to shards of about ``SHARD`` by a hash of their name within their number of
    components; vectors of different length never meet.
    """
    sizes = {r["d"]: r["n"] for r in distinct.groupBy(F.size("vector").alias("d")).agg(
        F.count(F.lit(1)).alias("n")).collect()}  # one row per vector length
    shards = {d: -(-n // SHARD) for d, n in sizes.items()}
    if not shards:
        return distinct.sparkSession.createDataFrame([], INDEX)
    spread = F.coalesce(*[F.when(F.size("vector") == d, F.lit(s)) for d, s in shards.items()])
    placed = distinct.withColumn("shard", F.size("vector").cast("bigint") * (1 << 32) + F.pmod(
        F.xxhash64("name"), spread))
    dealt = placed.repartitionByRange(sum(shards.values()), "shard").sortWithinPartitions(
        "shard", "name")

    def row(shard: int, vectors: list, members: list) -> pa.RecordBatch:
        matrix = np.array(vectors, np.float64)
        names = np.array([m[0] for m in members], np.int64)
        graph = Graph.build(matrix, names)
        most = max(map(len, members))
        ids = np.full((len(members), most), -1, np.int64)
        for i, own in enumerate(members):
            ids[i, :len(own)] = own
        counted = np.array([len(m) for m in members], np.int64)
        values = (shard, counted.tobytes(), graph.points.tobytes(), ids.tobytes(), matrix.tobytes(),
                  matrix.shape[1], [x.tobytes() for x in graph.links],
                  [x.tobytes() for x in graph.rank], graph.entry)
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int32(),
                 pa.list_(pa.binary()), pa.list_(pa.binary()), pa.int32())
        return pa.RecordBatch.from_arrays(
            [pa.array([v], k) for v, k in zip(values, kinds)],
            names=[f.split()[0] for f in INDEX.split(", ")])

    def scan(batches):
        shard, vectors, members = None, [], []
        for batch in batches:
            for vector, own, name, place in zip(*(batch.column(c) for c in (
                    "vector", "members", "name", "shard"))):
                if vectors and place.as_py() != shard:
                    yield row(shard, vectors, members)
                    vectors, members = [], []
                shard = place.as_py()
                vectors.append(vector.values.to_numpy())
                members.append(own.as_py())
        if vectors:
            yield row(shard, vectors, members)

    return dealt.mapInArrow(scan, INDEX)


class Shard:
    """A shard's graph, vectors and ids, read from its index row."""

    def __init__(self, row: dict):
        width = row["width"]
        self.vectors = np.frombuffer(row["vectors"]).reshape(-1, width)
        count = len(self.vectors)
        points = np.frombuffer(row["points"], np.float32).reshape(count, width + 1)
        links = [np.frombuffer(x, np.int32).reshape(-1, LINKS if i else 2 * LINKS)
                 for i, x in enumerate(row["layers"])]
        self.graph = Graph(points, links, [np.frombuffer(x, np.int32) for x in row["ranks"]],
                           row["entry"])
        self.counts = np.frombuffer(row["names"], np.int64)
        self.members = np.frombuffer(row["members"], np.int64).reshape(count, -1)

    def nearest(self, name: int, query: np.ndarray, k: int) -> list[tuple[float, int]]:
        found = self.graph.search(query, max(SEARCH_WIDTH, 2 * k))
        scored = [(-float(np.dot(self.vectors[n], query)), int(i)) for n in found
                  for i in self.members[n, :self.counts[n]] if i != name]
        return heapq.nsmallest(k, scored)


def search(index: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """The k nearest of all shards per query: query_id, rank, vec_id, score.

    ``queries``: (query_id, vector). Queries are sent in blocks to every shard of their vector
    length; a task holds one graph at a time and streams its queries. Each shard's answers are cut
    to k before the merge, as the best k of all are among them.
    """
    shards = [r["shard"] for r in index.select("shard").collect()]  # one number per shard
    out = "query_id bigint, vec_id bigint, score double"
    if not shards:
        return queries.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    blocks = queries.count() // QUERIES + 1
    where = index.select("shard", "width")
    asked = queries.withColumn("width", F.size("vector")).join(
        F.broadcast(where), "width").select(  # one narrow row per shard of thousands of vectors
        "shard", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("part"),
        F.lit(1).alias("kind"), "query_id", "vector",
        *[F.lit(None).cast(t).alias(n) for n, t in (f.split(" ", 1) for f in INDEX.split(", ")[1:])])
    held = index.select(
        "shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(
            blocks - 1).cast("bigint"))).alias("part"),
        F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("query_id"),
        F.lit(None).cast("array<double>").alias("vector"),
        *[f.split()[0] for f in INDEX.split(", ")[1:]])
    dealt = held.union(asked.withColumn("part", F.col("part").cast("bigint"))).repartitionByRange(
        len(shards) * blocks, "shard", "part").sortWithinPartitions("shard", "part", "kind")

    def scan(batches):
        shard = None
        for batch in batches:
            found = []
            kinds = batch.column("kind").to_pylist()
            for i, kind in enumerate(kinds):
                if not kind:
                    shard = Shard(batch.slice(i, 1).to_pylist()[0])
                    continue
                name = batch.column("query_id")[i].as_py()
                query = batch.column("vector")[i].values.to_numpy()
                found += [(name, other, -near) for near, other in shard.nearest(name, query, k)]
            columns = list(zip(*found)) if found else [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))],
                names=["query_id", "vec_id", "score"])

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return dealt.mapInArrow(scan, out).withColumn("rank", F.row_number().over(best)).filter(
        F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
               every: int = 20, k: int = 20) -> DataFrame:
    """Searches all vectors whose id is divisible by ``every`` among all others.

    Nearness is the inner product in double precision; ties go to the smaller id. Null ids and
    vectors that are null, zero or hold null or non-finite components take no part. Repeated rows
    count once; an id with several vectors is searched with its first in order. Fewer than k
    candidates are all returned by a shard, as far as its graph reaches them. An empty table gives
    no rows.
    """
    index = staged(build_index(staged(distinct_vectors(vectors, id_col, vector_col, k + 1),
                                      "vectors")), "graphs")
    asked = vectors.select(F.col(id_col).cast("bigint").alias("query_id"), F.col(vector_col).cast(
        "array<double>").alias("vector")).filter(
        (F.col("query_id") % every == 0) & usable(F.col("vector")))
    return search(index, asked.groupBy("query_id").agg(F.min("vector").alias("vector")), k)
