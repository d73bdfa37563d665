"""Bigram language model as a weighted backoff automaton, scored over whole texts."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adsight.llm.common import fold, pack_counts, pack_sorted, unpack_counts, unpack_sorted
from adsight.plans.stages import staged

BLOCK_BYTES = 2 << 20       # text that is counted and scored together
PART_BYTES = 6 << 20        # text whose n-grams one counting task adds up
END = 0                     # local number of the end token, also the state at a text's start
PRIOR = 20.0                # weight of the shorter context in a longer one's probabilities
END_HASH = xxhash.xxh64_intdigest(b" end")  # no word holds a blank


def _mix(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """64-bit hash of a pair of hashes."""
    mixed = (first ^ (first >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + second
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return mixed ^ (mixed >> np.uint64(29))


class Block:
    """Tokens of a block of texts as local numbers, and its distinct n-grams in hash order."""

    def __init__(self, texts: list[bytes]):
        known: dict[bytes, int] = defaultdict()
        known.default_factory = lambda: len(known) + 1
        self.docs = [[known[w] for w in text.lower().split()] for text in texts]
        self.words = len(known) + 1
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in known), np.uint64, len(known))
        self.hashes = np.concatenate((np.array([END_HASH], np.uint64), hashes))
        self.sizes = np.array([len(d) + 1 for d in self.docs], np.int64)
        flat = np.fromiter((t for d in self.docs for t in (*d, END)), np.int64,
                           int(self.sizes.sum()))
        # Every text ends with the end token, so it also stands before the next one's first word.
        pairs = np.concatenate((np.array([END], np.int64), flat[:-1])) * self.words + flat
        self.flat = flat
        self.pairs, self.pair_at = np.unique(pairs, return_inverse=True)
        self.pair_hashes = _mix(self.hashes[self.pairs // self.words],
                                self.hashes[self.pairs % self.words])

    def counts(self, used: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """n -> (sorted hashes, counts in the used texts), for n = 1 and 2."""
        weight = np.repeat(used, self.sizes)
        out = {}
        for n, hashes, at in ((1, self.hashes, self.flat), (2, self.pair_hashes, self.pair_at)):
            order = np.argsort(hashes)
            out[n] = hashes[order], np.bincount(at, weight, len(hashes))[order]
        return out

    def place(self, n: int, totals: np.ndarray) -> np.ndarray:
        """Totals given in hash order, by local number."""
        hashes = self.hashes if n == 1 else self.pair_hashes
        out = np.zeros(len(hashes), np.int64)
        out[np.argsort(hashes)] = totals
        return out


class Automaton:
    """States are the empty context and every trained word (the end token: a text's start).

    An arc reads a trained bigram with its smoothed probability. Any other word takes the state's
    failure arc to the empty context, at the state's backoff weight, and is read there.
    """

    def __init__(self, block: Block, single: np.ndarray, double: np.ndarray, tokens: int,
                 once: int):
        unseen = max(once, 1)       # all unknown words together: the mass of words seen once
        base = np.where(single > 0, single, unseen) / (tokens + unseen)
        kept = np.flatnonzero(double)
        before, word = block.pairs[kept] // block.words, block.pairs[kept] % block.words
        chance = (double[kept] + PRIOR * base[word]) / (single[before] + PRIOR)
        self.words = block.words
        self.arcs = dict(zip(block.pairs[kept].tolist(), np.log10(chance).tolist()))
        self.root = np.log10(base).tolist()
        self.fail = np.log10(PRIOR / (single + PRIOR)).tolist() + [0.0]
        empty = block.words
        self.next = np.where(single > 0, np.arange(block.words), empty).tolist()

    def score(self, tokens: list[int]) -> float:
        """log10 probability of a text, in one pass from left to right."""
        arcs, fail, root, follow, words = self.arcs, self.fail, self.root, self.next, self.words
        state, total = follow[END], 0.0
        for token in tokens:
            found = arcs.get(state * words + token)
            total += fail[state] + root[token] if found is None else found
            state = follow[token]
        found = arcs.get(state * words + END)
        return total + (fail[state] + root[END] if found is None else found)


def _blocks(docs: DataFrame, id_col: str) -> DataFrame:
    """Texts gathered to blocks as they lie, one row each; written once, so the numbers hold."""
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("bytes", T.LongType()),
        T.StructField("ids", T.ArrayType(docs.schema[id_col].dataType)),
        T.StructField("held", T.ArrayType(T.BooleanType())),
        T.StructField("sizes", T.ArrayType(T.LongType())),
        T.StructField("texts", T.BinaryType())])

    def gather(batches):
        number = TaskContext.get().partitionId() << 32
        rows, held = [], 0

        def block():
            texts = b"".join(r[2] for r in rows)
            return pa.RecordBatch.from_arrays([
                pa.array([number], pa.int64()), pa.array([len(texts)], pa.int64()),
                pa.array([[r[0] for r in rows]], pa.list_(kind)),
                pa.array([[r[1] for r in rows]], pa.list_(pa.bool_())),
                pa.array([[len(r[2]) for r in rows]], pa.list_(pa.int64())),
                pa.array([zstandard.compress(texts, 3)], pa.binary())], names=schema.names)

        for batch in batches:
            kind = batch.schema.field(0).type
            for name, fold_out, text in zip(*batch.columns):
                rows.append((name.as_py(), fold_out.as_py(), text.as_py() or b""))
                held += len(rows[-1][2]) + 8
                if held >= BLOCK_BYTES:
                    yield block()
                    number, rows, held = number + 1, [], 0
        if rows:
            yield block()

    return docs.mapInArrow(gather, schema)


def _texts(row: dict) -> list[bytes]:
    whole = zstandard.decompress(row["texts"]) if row["bytes"] else b""
    ends = np.cumsum([0] + row["sizes"]).tolist()
    return [whole[a:b] for a, b in zip(ends, ends[1:])]


COUNTS = "n int, part int, block bigint, hashes binary, counts binary"
TOTALS = ("block bigint, n int, part int, totals binary, types bigint, once bigint, "
          "tokens bigint")


def _requests(blocks: DataFrame, parts: int) -> DataFrame:
    """Per block, n and range of hashes: the distinct n-grams and their training counts.

    Held-out n-grams come with count zero, to be told the totals too.
    """
    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(_texts(row))
                found = {name: [] for name in ("n", "part", "block", "hashes", "counts")}
                for n, (hashes, counts) in block.counts(~np.array(row["held"], bool)).items():
                    part = ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32))
                    cuts = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
                    for p in np.flatnonzero(np.diff(cuts)).tolist():
                        own = slice(cuts[p], cuts[p + 1])
                        for name, value in zip(found, (n, p, row["block"], pack_sorted(hashes[own]),
                                                       pack_counts(counts[own]))):
                            found[name].append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, t) for v, t in zip(found.values(), (
                        pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))],
                    names=list(found))

    return blocks.mapInArrow(ask, COUNTS)


def _totals(table: pa.Table) -> pa.Table:
    """Corpus totals of the n-grams of one range, told to every block that asked."""
    rows = sorted(table.to_pylist(), key=lambda r: r["block"])
    hashes = [unpack_sorted(r["hashes"]) for r in rows]
    cuts = np.cumsum([len(h) for h in hashes])[:-1]
    _, at = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.bincount(at, np.concatenate([unpack_counts(r["counts"]) for r in rows]))
    n, part, count = rows[0]["n"], rows[0]["part"], len(rows)
    told = [pack_counts(total[own]) for own in np.split(at, cuts)]
    sums = [int((total > 0).sum()), int((total == 1).sum()), int(total.sum())]
    return pa.table({
        "block": pa.array([r["block"] for r in rows] + [-1], pa.int64()),
        "n": pa.array([n] * (count + 1), pa.int32()),
        "part": pa.array([part] * (count + 1), pa.int32()),
        "totals": pa.array(told + [None], pa.binary()),
        **{name: pa.array([None] * count + [value], pa.int64())
           for name, value in zip(("types", "once", "tokens"), sums)}})


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7,
          test_fold: int = 2) -> DataFrame:
    """Scores every whole text with a bigram model of the texts outside the test fold.

    Returns id, held_out, n_tokens (words and one end), n_known, train_tokens, base_score (add-one
    unigrams) and score, both log10. A bigram's probability is (c(u,w) + PRIOR p(w)) / (c(u) +
    PRIOR); p(w) gives all unknown words together the mass of the words seen once. Nothing is
    pruned. Null texts are empty texts: only the end token is scored. Null ids count as training
    rows; repeated rows count and are scored each; an empty table gives no rows.

    Texts are gathered to blocks of ``BLOCK_BYTES`` which are written once. A block sends its
    distinct n-grams, as packed sorted hashes, to the task that adds up their range, and gets the
    totals back: one number per distinct n-gram and block, however frequent it is. So no task
    holds the model; a block's part of the automaton is built beside its texts.
    """
    narrow = docs.select(F.col(id_col), (fold(id_col, folds) == test_fold).alias("held"),
                         F.col(text_col).cast("binary").alias("text_bytes"))
    blocks = staged(_blocks(narrow, id_col), "blocks")
    parts = (blocks.agg(F.sum("bytes")).first()[0] or 0) // PART_BYTES + 1
    totals = staged(_requests(blocks, parts).groupBy("n", "part").applyInArrow(_totals, TOTALS),
                    "totals")
    sums = totals.filter("block = -1 and n = 1").agg(
        F.sum("types"), F.sum("once"), F.sum("tokens")).first()
    types, once, tokens = (value or 0 for value in sums)
    schema = T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType),
        T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("n_known", T.LongType()), T.StructField("train_tokens", T.LongType()),
        T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])

    def traverse(texts: pa.Table, told: pa.Table) -> pa.Table:
        row = texts.to_pylist()[0]
        block = Block(_texts(row))
        rows = sorted(told.to_pylist(), key=lambda r: (r["n"], r["part"]))
        single, double = (block.place(n, np.concatenate(
            [unpack_counts(r["totals"]) for r in rows if r["n"] == n])) for n in (1, 2))
        automaton = Automaton(block, single, double, tokens, once)
        base = np.log10((single + 1) / (tokens + types + 1))
        starts = np.cumsum(block.sizes) - block.sizes
        count = len(row["ids"])
        kind = texts.schema.field("ids").type.value_type
        return pa.table({
            id_col: pa.array(row["ids"], kind), "held_out": pa.array(row["held"], pa.bool_()),
            "n_tokens": pa.array(block.sizes, pa.int64()),
            "n_known": pa.array(np.add.reduceat((single > 0)[block.flat].astype(np.int64), starts)),
            "train_tokens": pa.array([tokens] * count, pa.int64()),
            "base_score": pa.array(np.add.reduceat(base[block.flat], starts)),
            "score": pa.array([automaton.score(d) for d in block.docs], pa.float64())})

    own = totals.filter("block >= 0").select("block", "n", "part", "totals")
    return blocks.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(traverse, schema)
