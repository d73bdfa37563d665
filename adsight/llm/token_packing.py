"""Token ids of documents packed into fixed-length sequences by best-fit decreasing."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adsight.llm.token_alignment import ranges_of, running, unit_starts

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published split pattern of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHARD_TOKENS = 2_000_000    # tokens that are packed together; bounds a task's memory
CACHED = 150_000            # units of text whose ids a task remembers
RUN_BYTES = 16_384          # units that are encoded as one text
BATCH_BYTES = 2 << 20       # text that is encoded together


class UnitEncoder:
    """Ids of whole texts from those of their units, which are encoded once and remembered.

    Texts are cut before single blanks between visible ASCII characters; no token of this pattern
    crosses such a place, so the ids of a text are those of its units in sequence. New units that
    begin and end in visible characters are encoded in runs and told apart by their bytes.
    """

    def __init__(self, ranks_file: bytes):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines())}
        self.encode = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks,
                                        special_tokens={}).encode_ordinary
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, number in ranks.items():
            self.sizes[number] = len(token)
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.starts = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _add(self, units: list[bytes]) -> None:
        clean = [len(u) > 1 and u[0] == 32 < u[1] < 127 and 32 < u[-1] < 127 for u in units]
        found, at = [], 0
        while at < len(units):
            end, held = at + 1, len(units[at])
            while clean[end - 1] and end < len(units) and clean[end] and held < RUN_BYTES:
                held += len(units[end])
                end += 1
            found.append(np.array(self.encode(b"".join(units[at:end]).decode()), np.int32))
            at = end
        new = np.concatenate(found)
        ends = np.searchsorted(np.cumsum(self.sizes[new]),
                               np.cumsum([len(u) for u in units]), side="right")
        self.starts = np.concatenate((self.starts, ends + len(self.flat)))
        self.flat = np.concatenate((self.flat, new))

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of every text."""
        ends = running(np.array([len(text) for text in texts], np.int64))
        raw = b"".join(texts)
        cuts = unit_starts(raw, ends)
        known, before = self.known, len(self.known)
        numbers = np.array([known.setdefault(raw[i:j], len(known)) for i, j in zip(
            cuts[:-1].tolist(), cuts[1:].tolist())], np.int64)
        if len(known) > before:
            self._add(list(known)[before:])
        sizes = self.starts[numbers + 1] - self.starts[numbers]
        flat = self.flat[ranges_of(self.starts[numbers], sizes)]
        bounds = running(sizes)[np.searchsorted(cuts, ends)]
        if len(known) > CACHED:
            self.clear()
        return [flat[i:j] for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


class CapacityTree:
    """Segment tree over capacities 0..size: finds the smallest one in use that is large enough."""

    def __init__(self, size: int):
        self.width = 1 << size.bit_length()
        self.count = [0] * (2 * self.width)
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, space: int, number: int) -> None:
        self.bins[space].append(number)
        self._change(space, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(space, bin) of the tightest bin, which is removed; None if no bin has the space."""
        node = need + self.width
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.width:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        space = node - self.width
        self._change(space, -1)
        return space, self.bins[space].pop()

    def _change(self, space: int, by: int) -> None:
        node = space + self.width
        while node:
            self.count[node] += by
            node >>= 1


def pack_lengths(lengths: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Bins of (document, start, length): whole pieces of overlong documents, then best fit.

    Every document is placed completely; longer ones are split at multiples of the capacity.
    """
    bins, rest = [], []
    for number, length in enumerate(lengths):
        full = length // capacity * capacity
        bins += [[(number, start, capacity)] for start in range(0, full, capacity)]
        if length > full or not length:
            rest.append((number, full, length - full))
    tree = CapacityTree(capacity)
    for piece in sorted(rest, key=lambda p: -p[2]):
        found = tree.take(piece[2])
        if found is None:
            bins.append([])
            found = capacity, len(bins) - 1
        bins[found[1]].append(piece)
        tree.add(found[0] - piece[2], found[1])
    return bins


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048,
         vocabulary: str = VOCABULARY, pad_id: int = 0) -> DataFrame:
    """One row per sequence of the packed id matrix.

    ids: ``capacity`` little-endian unsigned numbers (2 bytes if the vocabulary allows, else 4),
    padded with ``pad_id``; n_tokens; cu_seqlens: cumulative segment lengths from 0; position_ids:
    positions that restart at every segment, as 4-byte numbers; doc_ids and starts: the document
    of every segment and its first token there, from which texts can be put together again.

    Each task packs its rows in shards of about ``SHARD_TOKENS`` tokens (one document at least), so
    nothing is shuffled and no key can be hot. Null and empty texts become segments of length 0;
    null ids and repeated rows are packed like others; an empty table gives no rows. The
    vocabulary is read once and sent to the tasks (under a megabyte).
    """
    with open(vocabulary, "rb") as source:
        content = source.read()
    ranks = docs.sparkSession.sparkContext.broadcast(content)
    kind = "<u2" if content.count(b"\n") <= 1 << 16 else "<u4"
    schema = T.StructType([
        T.StructField("shard", T.LongType()), T.StructField("bin", T.IntegerType()),
        T.StructField("n_tokens", T.IntegerType()), T.StructField("ids", T.BinaryType()),
        T.StructField("cu_seqlens", T.ArrayType(T.IntegerType())),
        T.StructField("position_ids", T.BinaryType()),
        T.StructField("doc_ids", T.ArrayType(docs.schema[id_col].dataType)),
        T.StructField("starts", T.ArrayType(T.LongType()))])

    def rows(shard: int, names: list, tokens: list[np.ndarray], id_type) -> pa.RecordBatch:
        out = {f.name: [] for f in schema.fields}
        for number, segments in enumerate(pack_lengths([len(t) for t in tokens], capacity)):
            ends = np.cumsum([0] + [n for _, _, n in segments])
            matrix = np.full(capacity, pad_id, kind)
            places = np.zeros(capacity, "<i4")
            for (doc, start, n), at in zip(segments, ends):
                matrix[at:at + n] = tokens[doc][start:start + n]
                places[at:at + n] = np.arange(n)
            for name, value in zip(out, (
                    shard, number, int(ends[-1]), matrix.tobytes(), ends.tolist(), places.tobytes(),
                    [names[d] for d, _, _ in segments], [s for _, s, _ in segments])):
                out[name].append(value)
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32()),
                 pa.binary(), pa.list_(id_type), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays(
            [pa.array(v, k) for v, k in zip(out.values(), kinds)], names=list(out))

    def scan(batches) -> Iterator[pa.RecordBatch]:
        encoder = UnitEncoder(ranks.value)
        shard = TaskContext.get().partitionId() << 32
        names, tokens, held = [], [], 0
        for batch in batches:
            id_type = batch.schema.field(0).type
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy()
            part = np.cumsum(sizes) // BATCH_BYTES
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
            for first, last in zip(edges, edges[1:]):
                own = batch.slice(first, last - first)
                found = encoder.ids([t or b"" for t in own.column(1).to_pylist()])
                for name, ids in zip(own.column(0).to_pylist(), found):
                    names.append(name)
                    tokens.append(ids)
                    held += len(ids)
                    if held >= SHARD_TOKENS:
                        yield rows(shard, names, tokens, id_type)
                        shard, names, tokens, held = shard + 1, [], [], 0
        if names:
            yield rows(shard, names, tokens, id_type)

    return docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("text_bytes")).mapInArrow(
        scan, schema)
