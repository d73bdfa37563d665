"""Alignment of two tokenizers over the bytes of the same texts, with corpus counts of id pairs."""

from __future__ import annotations

import functools
import hashlib
import itertools
import os

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adsight.llm.common import pack_counts, pack_sorted, unpack_counts, unpack_sorted
from adsight.llm.token_counts import check_model
from adsight.plans.stages import staged

FIRST = public_tokenizers.path("byte_bpe_50k.json")     # tokenizer A
SECOND = public_tokenizers.path("piece_bpe_32k.model")  # tokenizer B
BLOCK_BYTES = 1 << 19   # text that is aligned together
UNITS = 150_000         # units of text whose alignment a task remembers
UNIT_BYTES = 96 << 20   # bytes of all that is remembered of them, about
RUN_BYTES = 16_384      # units that are encoded as one text
NEW_BYTES = 1 << 17     # new units that are aligned together
GROUP = 16              # blocks that a reader of the stored ones holds at once
HOT = 1 << 18           # id pairs at most whose counts are sent to every task
FLUSH = 1 << 20         # id pairs that a counting task adds up before it passes them on


class Csr:
    """A sparse matrix of numbers in compressed rows."""

    def __init__(self, starts: np.ndarray, columns: np.ndarray, values: np.ndarray, width: int):
        self.starts, self.columns, self.values, self.width = starts, columns, values, width

    @classmethod
    def incidence(cls, sizes: np.ndarray) -> Csr:
        """Row i covers the next ``sizes[i]`` columns: a token and its bytes."""
        starts = running(sizes)
        return cls(starts, np.arange(starts[-1]), np.ones(starts[-1], np.int64), int(starts[-1]))

    @classmethod
    def membership(cls, groups: np.ndarray, width: int) -> Csr:
        """Row i has one entry: a token and its group."""
        return cls(np.arange(len(groups) + 1), groups, np.ones(len(groups), np.int64), width)

    def rows(self) -> np.ndarray:
        """Row of every entry."""
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))

    def transpose(self) -> Csr:
        """Rows become columns, by a counting sort over the columns."""
        order = np.argsort(self.columns, kind="stable")
        starts = running(np.bincount(self.columns, minlength=self.width))
        return Csr(starts, self.rows()[order], self.values[order], len(self.starts) - 1)

    def times(self, other: Csr) -> Csr:
        """Row products: a row is the sum of the rows of ``other`` that its entries name.

        All rows are expanded at once; what falls on the same place is added up.
        """
        sizes = np.diff(other.starts)[self.columns]
        taken = ranges_of(other.starts[self.columns], sizes)
        place = np.repeat(self.rows(), sizes) * other.width + other.columns[taken]
        value = np.repeat(self.values, sizes) * other.values[taken]
        order = np.argsort(place, kind="stable")
        place, value = place[order], value[order]
        first = np.flatnonzero(np.diff(place, prepend=-1))
        rows, columns = place[first] // max(other.width, 1), place[first] % max(other.width, 1)
        return Csr(running(np.bincount(rows, minlength=len(self.starts) - 1)), columns,
                   np.add.reduceat(value, first) if len(first) else value, other.width)


def running(sizes: np.ndarray) -> np.ndarray:
    """0 and the running sums."""
    return np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes, dtype=np.int64)))


def ranges_of(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Concatenated ranges start..start + size."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches, exact; empty stretches give 0."""
    return np.diff(running(values)[starts])


class Tokenizers:
    """Both tokenizers: ids of a text, and the bytes of every id."""

    def __init__(self, first: str, second: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_str(first)
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_proto=second)
        letters = _byte_letters()
        names = {i: name for name, i in self.first.get_vocab(with_added_tokens=True).items()}
        first_bytes = [
            bytes(letters[c] for c in names[i]) if all(c in letters for c in names.get(i, "\n"))
            else names.get(i, "").encode() for i in range(max(names) + 1)]
        second_bytes = []
        for i in range(self.second.vocab_size()):
            name = self.second.id_to_piece(i)
            second_bytes.append(bytes([int(name[3:5], 16)]) if self.second.is_byte(i)
                                else name.replace("▁", " ").encode())
        if any(b" " in b.lstrip(b" ") for b in second_bytes):
            raise ValueError("the second vocabulary has pieces across blanks")
        self.bytes = first_bytes, second_bytes
        self.sizes = tuple(np.array([len(b) for b in own], np.int64) for own in self.bytes)
        # Every id as text with what may stand behind it.
        self.shown = [f"{i}{mark}".encode() for mark in ",|;" for i in range(
            max(len(first_bytes), len(second_bytes)))]

    def encode(self, run: bytes) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of a text that begins with a blank; None if either loses a byte of it.

        The second library adds that blank itself.
        """
        text = run.decode()
        both = (self.first.encode_batch_fast([text], add_special_tokens=False)[0].ids,
                self.second.encode(text[1:]))
        if any(b"".join(map(own.__getitem__, ids)) != run for own, ids in zip(self.bytes, both)):
            return None
        return tuple(np.array(ids, np.int64) for ids in both)


@functools.lru_cache(maxsize=1)
def _loaded(first: str, second: bytes) -> Tokenizers:
    """The tokenizers of a Python process, which its tasks share.

    Loaded anew for every task they take more memory with each, as freed memory is not whole.
    """
    return Tokenizers(first, second)


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Grown:
    """Numbers at the end of which others are put, in 32 bits unless said; space is kept."""

    def __init__(self, kind: type = np.int32):
        self.space, self.held = np.empty(1 << 12, kind), 0

    def add(self, values: np.ndarray) -> None:
        end = self.held + len(values)
        if end > len(self.space):
            space = np.empty(max(end, 2 * len(self.space)), self.space.dtype)
            space[:self.held] = self.space[:self.held]
            self.space = space
        self.space[self.held:end] = values
        self.held = end

    def all(self) -> np.ndarray:
        return self.space[:self.held]


class Lexicon:
    """Units of text, encoded and aligned once.

    A text is cut before single blanks between visible ASCII characters. There the first
    tokenizer's pattern starts a new word, and no piece of the second holds a blank behind another
    character, so both always end a token there: encoding, groups and links of a text are those of
    its units in sequence.
    """

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers = tokenizers
        # Per kind: values of all units, and where each unit's begin.
        self.flat = {name: Grown() for name in (
            "a", "b", "a_group", "b_group", "link_a", "link_b", "link_bytes", "shared_a",
            "shared_b")}
        self.starts = {name: Grown(np.int64) for name in ("a", "b", "links", "shared")}
        self.groups, self.whole = Grown(), Grown(bool)
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.digests: list[bytes] = []
        self.text_bytes = 0     # of units and digests
        for values in (*self.flat.values(), *self.starts.values(), self.groups, self.whole):
            values.held = 0
        for starts in self.starts.values():
            starts.add(np.zeros(1, np.int64))

    def full(self) -> bool:
        """Whether more is remembered than should be."""
        return len(self.known) > UNITS or UNIT_BYTES < self.text_bytes + 150 * len(
            self.known) + sum(4 * values.held for values in self.flat.values())

    def numbers(self, units: list[bytes]) -> np.ndarray:
        """Number of every unit; new ones are encoded and aligned together, in pieces."""
        known, before = self.known, len(self.known)
        found = np.array([known.setdefault(unit, len(known)) for unit in units], np.int64)
        new, held = [], 0
        for unit in itertools.islice(known, before, None) if len(known) > before else ():
            new.append(unit)
            held += len(unit)
            if held >= NEW_BYTES:
                self._add(new)
                new, held = [], 0
        if new:
            self._add(new)
        return found

    def _encode(self, units: list[bytes]) -> tuple[np.ndarray, ...]:
        """Ids of all units in sequence, which units are whole, and where their bytes end.

        Units that begin and end in visible characters are encoded in runs, as they would be cut
        from there again. A unit whose bytes differ spoils its text and gets no ids.
        """
        runs, at, whole = [], 0, np.ones(len(units), bool)
        sizes = np.array([len(unit) for unit in units], np.int64)
        clean = [len(u) > 1 and 32 < u[1] < 127 and 32 < u[-1] < 127 for u in units]
        while at < len(units):
            end, held = at + 1, len(units[at])
            while clean[end - 1] and end < len(units) and clean[end] and held < RUN_BYTES:
                held += len(units[end])
                end += 1
            found = self.tokenizers.encode(b"".join(units[at:end]))
            if found is None and end > at + 1:
                for k in range(at, end):
                    found = self.tokenizers.encode(units[k])
                    whole[k] = found is not None
                    runs += [found] if whole[k] else []
            else:
                whole[at:end] = found is not None
                runs += [found] if whole[at] else []
            at = end
        sizes[~whole] = 0
        a, b = (np.concatenate([np.zeros(0, np.int64), *(run[k] for run in runs)])
                for k in (0, 1))
        return a, b, whole, np.cumsum(sizes)

    def _add(self, units: list[bytes]) -> None:
        a, b, whole, unit_ends = self._encode(units)
        a_sizes, b_sizes = self.tokenizers.sizes[0][a], self.tokenizers.sizes[1][b]
        a_ends, b_ends = np.cumsum(a_sizes), np.cumsum(b_sizes)
        a_starts, b_starts = (np.concatenate((np.zeros(1, np.int64), np.searchsorted(
            ends, unit_ends, side="right"))) for ends in (a_ends, b_ends))
        cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
        a_group, b_group = np.searchsorted(cuts, a_ends), np.searchsorted(cuts, b_ends)
        links = Csr.incidence(a_sizes).times(Csr.incidence(b_sizes).transpose())
        shared = Csr.membership(a_group, len(cuts)).times(
            Csr.membership(b_group, len(cuts)).transpose())
        unit_cuts = np.concatenate((np.zeros(1, np.int64), a_ends))[a_starts]
        before = np.searchsorted(cuts, unit_cuts, side="right")     # groups before each unit
        a_unit, b_unit = (np.repeat(np.arange(len(units)), np.diff(s)) for s in
                          (a_starts, b_starts))
        rows = {"links": links.rows(), "shared": shared.rows()}
        new = {"a": a, "b": b, "a_group": a_group - before[a_unit],
               "b_group": b_group - before[b_unit],
               "link_a": rows["links"] - a_starts[a_unit[rows["links"]]],
               "link_b": links.columns - b_starts[b_unit[links.columns]],
               "link_bytes": links.values,
               "shared_a": rows["shared"] - a_starts[a_unit[rows["shared"]]],
               "shared_b": shared.columns - b_starts[b_unit[shared.columns]]}
        for name, values in new.items():
            self.flat[name].add(values)
        for name, starts in (("a", a_starts), ("b", b_starts), ("links", links.starts[a_starts]),
                             ("shared", shared.starts[a_starts])):
            held = self.starts[name]
            held.add(starts[1:] + held.all()[-1])
        self.groups.add(np.diff(before))
        self.whole.add(whole)
        digests = self._shown(a, b, a_group, b_group, a_starts, b_starts)
        self.digests += digests
        self.text_bytes += sum(map(len, units)) + sum(map(len, digests))

    def _shown(self, a, b, a_group, b_group, a_starts, b_starts) -> list[bytes]:
        """Per unit the groups as ``a1,a2|b1;a3|b2,b3;``."""
        place = np.concatenate((
            np.arange(len(a)) + np.searchsorted(b_group, a_group),
            np.arange(len(b)) + np.searchsorted(a_group, b_group, side="right")))
        # The last id of a group is followed by | (first tokenizer) or ; (second).
        marks = [(np.diff(group, append=-1) != 0) * mark
                 for group, mark in ((a_group, 1), (b_group, 2))]
        wide = len(self.tokenizers.shown) // 3
        code = np.zeros(len(place), np.int64)
        code[place] = np.concatenate((a + wide * marks[0], b + wide * marks[1]))
        texts = list(map(self.tokenizers.shown.__getitem__, code.tolist()))
        ends = (a_starts + b_starts).tolist()
        return [b"".join(texts[i:j]) for i, j in zip(ends, ends[1:])]

    def take(self, name: str, units: np.ndarray) -> np.ndarray:
        """Values of one kind over a sequence of units."""
        starts = self.starts[{"l": "links", "s": "shared"}.get(name[0], name[0])].all()
        return self.flat[name].all()[
            ranges_of(starts[units], starts[units + 1] - starts[units])].astype(np.int64)

    def sizes(self, name: str, units: np.ndarray) -> np.ndarray:
        """How many values each unit has."""
        starts = self.starts[name].all()
        return starts[units + 1] - starts[units]


class Aligned:
    """A block of texts as units, without the texts that have no tokens."""

    def __init__(self, lexicon: Lexicon, texts: list[bytes]):
        self.lexicon = lexicon
        full = [b" " + text if text else b"" for text in texts]
        ends = running(np.array([len(text) for text in full], np.int64))
        raw = b"".join(full)
        units = unit_starts(raw, ends)
        numbers = lexicon.numbers([raw[i:j] for i, j in zip(units[:-1].tolist(),
                                                            units[1:].tolist())])
        starts = np.searchsorted(units, ends)   # an empty text begins where the next one does
        spoiled = _sums(~lexicon.whole.all()[numbers], starts) > 0
        kept = np.repeat(~spoiled, np.diff(starts))
        self.units = numbers[kept]
        self.starts = running(_sums(kept, starts))    # where each text's units begin

    def per_text(self, name: str) -> np.ndarray:
        """Tokens, links, or shared-group links of every text."""
        return _sums(self.lexicon.sizes(name, self.units), self.starts)

    def groups(self) -> np.ndarray:
        return _sums(self.lexicon.groups.all()[self.units], self.starts)

    def digests(self) -> list[str]:
        """SHA-256 of every text's groups; empty without tokens."""
        shown = list(map(self.lexicon.digests.__getitem__, self.units.tolist()))
        cuts = self.starts.tolist()
        return [hashlib.sha256(b"".join(shown[i:j])[:-1]).hexdigest() if j > i else ""
                for i, j in zip(cuts, cuts[1:])]

    def pairs(self) -> np.ndarray:
        """Id pairs of all links in order, the second tokenizer's id in the upper half."""
        lexicon, units = self.lexicon, self.units
        sizes = lexicon.sizes("links", units)
        a, b = (np.repeat(lexicon.starts[name].all()[units], sizes) for name in ("a", "b"))
        a += lexicon.take("link_a", units)
        b += lexicon.take("link_b", units)
        pairs = lexicon.flat["b"].all()[b].astype(np.int64)
        pairs <<= 32
        pairs |= lexicon.flat["a"].all()[a]
        return pairs


def unit_starts(raw: bytes, ends: np.ndarray) -> np.ndarray:
    """Starts of the units of concatenated texts, and the end."""
    codes = np.frombuffer(raw, np.uint8)
    seen = (codes > 32) & (codes < 127)
    starts = np.zeros(len(codes) + 1, bool)
    starts[1:-2] = seen[:-2] & (codes[1:-1] == 32) & seen[2:]
    starts[ends] = True
    return np.flatnonzero(starts)


class Sent:
    """Both vocabularies on the driver, sent to the tasks (three megabytes)."""

    def __init__(self, docs: DataFrame, first: str, second: str):
        with open(first, encoding="utf-8") as source:
            names = source.read()
        with open(second, "rb") as source:
            model = source.read()
        check_model(model)
        self.files = docs.sparkSession.sparkContext.broadcast((names, model))

    def lexicon(self) -> Lexicon:
        return Lexicon(_loaded(*self.files.value))


def _blocks_of(batches, lexicon: Lexicon):
    """Ids and aligned texts, about ``BLOCK_BYTES`` of text together."""
    ids, texts, held, kind = [], [], 0, None
    for batch in batches:
        kind = batch.schema.field(0).type
        for name, text in zip(*batch.columns):
            ids.append(name.as_py())
            texts.append(text.as_py() or b"")
            held += len(texts[-1])
            if held >= BLOCK_BYTES:
                yield pa.array(ids, kind), Aligned(lexicon, texts)
                ids, texts, held = [], [], 0
                if lexicon.full():
                    lexicon.clear()
        batch = name = text = None      # not held while the next one is read
    if ids:
        yield pa.array(ids, kind), Aligned(lexicon, texts)


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("text_bytes"))


def alignments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               first: str = FIRST, second: str = SECOND) -> DataFrame:
    """Tokens, groups and links of every whole text.

    a_ids, b_ids: the ids; a_groups, b_groups: the group of each token; links: (a, b, bytes) for
    every two tokens that share bytes, by their places; shared: (a, b) of every two tokens in one
    group. Edge cases as in :func:`align`.
    """
    sent = Sent(docs, first, second)
    lists = {"a_ids": "a", "b_ids": "b", "a_groups": "a_group", "b_groups": "b_group"}
    nested = {"links": ("link_a", "link_b", "link_bytes"), "shared": ("shared_a", "shared_b")}
    field = {"links": "array<struct<a:bigint,b:bigint,bytes:bigint>>",
             "shared": "array<struct<a:bigint,b:bigint>>"}
    kind = docs.schema[id_col].dataType.simpleString()
    schema = ", ".join([f"`{id_col}` {kind}", *(f"{n} array<bigint>" for n in lists),
                        *(f"{n} {field[n]}" for n in nested)])

    def scan(batches):
        for ids, block in _blocks_of(batches, sent.lexicon()):
            lexicon, units = block.lexicon, block.units
            text = np.repeat(np.arange(len(ids)), np.diff(block.starts))
            before = {}     # tokens and groups of the same text before each unit
            for name, own in (("a", lexicon.sizes("a", units)), ("b", lexicon.sizes("b", units)),
                              ("group", lexicon.groups.all()[units])):
                ends = running(own)
                before[name] = ends[:-1] - ends[block.starts[text]]
            columns = [ids]

            def placed(name, sizes):
                shift = before.get({"a_group": "group", "b_group": "group", "link_a": "a",
                                    "link_b": "b", "shared_a": "a", "shared_b": "b"}.get(name))
                values = lexicon.take(name, units)
                return values if shift is None else values + np.repeat(shift, sizes)

            for name in lists.values():
                sizes = lexicon.sizes(name[0], units)
                columns.append(pa.LargeListArray.from_arrays(
                    running(_sums(sizes, block.starts)), placed(name, sizes)).cast(
                        pa.list_(pa.int64())))
            for name, parts in nested.items():
                sizes = lexicon.sizes(name, units)
                values = pa.StructArray.from_arrays(
                    [pa.array(placed(p, sizes)) for p in parts], ["a", "b", "bytes"][:len(parts)])
                columns.append(pa.ListArray.from_arrays(
                    running(_sums(sizes, block.starts)).astype(np.int32), values))
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, *lists, *nested])

    return _narrow(docs, id_col, text_col).mapInArrow(scan, schema)


def _packed(planes: bytes) -> bytes:
    """Eight byte planes without the upper ones that are all zero, after a byte with their number.

    Most numbers of a block have one or two bytes, and its row is held whole by readers.
    """
    size = len(planes) // 8
    used = -(-len(planes.rstrip(b"\0")) // max(size, 1)) or 1
    return bytes([used]) + planes[:used * size]


def _planes(blob: bytes) -> bytes:
    """Inverse of :func:`_packed`."""
    return blob[1:] + bytes((len(blob) - 1) // blob[0] * (8 - blob[0]))


COUNTED = ("n_a", "n_b", "n_groups", "n_links", "n_shared")


def _aligned_blocks(docs: DataFrame, id_col: str, text_col: str, sent: Sent) -> DataFrame:
    """One row per block: what is told of its texts, and its distinct id pairs with their links.

    pairs: sorted and packed; of_text, at, links: how many distinct pairs each text has, their
    numbers among the block's pairs, and the links of each. All are cut by :func:`_packed`.
    """
    schema = T.StructType([
        T.StructField("block", T.LongType()),
        T.StructField("ids", T.ArrayType(docs.schema[id_col].dataType)),
        *(T.StructField(name, T.ArrayType(T.LongType())) for name in COUNTED),
        T.StructField("digests", T.ArrayType(T.StringType())),
        *(T.StructField(name, T.BinaryType()) for name in (
            "pairs", "of_text", "at", "links"))])

    def scan(batches):
        number = TaskContext.get().partitionId() << 32
        for ids, block in _blocks_of(batches, sent.lexicon()):
            counts = [block.per_text("a"), block.per_text("b"), block.groups(),
                      block.per_text("links"), block.per_text("shared")]
            pairs, at = np.unique(block.pairs(), return_inverse=True)
            own = np.repeat(np.arange(len(ids)), counts[3])
            places, links = np.unique(own * max(len(pairs), 1) + at, return_counts=True)
            of_text = np.bincount(places // max(len(pairs), 1), minlength=len(ids))
            yield pa.RecordBatch.from_arrays([
                pa.array([number]), pa.array([ids.to_pylist()], pa.list_(ids.type)),
                *(pa.array([c.tolist()], pa.list_(pa.int64())) for c in counts),
                pa.array([block.digests()], pa.list_(pa.string())),
                *(pa.array([_packed(x)], pa.binary()) for x in (
                    pack_sorted(pairs.astype(np.uint64)), pack_counts(of_text),
                    pack_sorted(places.astype(np.uint64)), pack_counts(links)))],
                names=schema.names)
            number += 1

    return _narrow(docs, id_col, text_col).mapInArrow(scan, schema)


def _rows(batch: pa.RecordBatch):
    """Rows as dictionaries, one after the other, as those of blocks are large."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _pair_counts(blocks: DataFrame) -> DataFrame:
    """Links of every id pair in the corpus, and whether none of its B id's pairs has more."""
    def scan(batches):
        pairs, sums = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def rows():
            return pa.RecordBatch.from_arrays([
                pa.array((pairs >> np.uint64(32)).astype(np.int32)),
                pa.array((pairs & np.uint64(0xFFFFFFFF)).astype(np.int32)), pa.array(sums)],
                names=["b_id", "a_id", "n"])

        for batch in batches:
            for row in _rows(batch):
                known, places = (unpack_sorted(_planes(row[c])) for c in ("pairs", "at"))
                at = (places % np.uint64(max(len(known), 1))).astype(np.int64)
                links = np.zeros(len(known), np.int64)
                np.add.at(links, at, unpack_counts(_planes(row["links"])))
                both = np.concatenate((pairs, known))
                pairs, place = np.unique(both, return_inverse=True)
                merged = np.zeros(len(pairs), np.int64)
                np.add.at(merged, place, np.concatenate((sums, links)))
                sums = merged
                if len(pairs) > FLUSH:
                    yield rows()
                    pairs, sums = pairs[:0], sums[:0]
        yield rows()

    # Rows of one B id are at most as many as tokenizer A has ids, so the window is bounded.
    return (blocks.select("pairs", "at", "links").mapInArrow(scan, "b_id int, a_id int, n bigint")
            .groupBy("b_id", "a_id").agg(F.sum("n").alias("n"))
            .withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b_id"))))


def pair_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                first: str = FIRST, second: str = SECOND) -> DataFrame:
    """b_id, a_id, n (links of the pair in all texts) and best (no pair of this B id has more)."""
    sent = Sent(docs, first, second)
    return _pair_counts(staged(_aligned_blocks(docs, id_col, text_col, sent), "aligned", GROUP))


def _frequent(counts: DataFrame) -> tuple[int, dict[str, np.ndarray]]:
    """The least power of two that at most ``HOT`` pairs reach, and these pairs."""
    sizes = {r["bits"]: r["pairs"] for r in counts.groupBy(
        F.length(F.bin("n")).alias("bits")).agg(F.count("*").alias("pairs")).collect()}
    bits, held = 64, 0
    while bits > 1 and held + sizes.get(bits - 1, 0) <= HOT:
        bits -= 1
        held += sizes.get(bits, 0)
    bound = 1 << (bits - 1) if bits < 64 else (1 << 63) - 1
    rows = counts.filter(F.col("n") >= bound).toArrow()
    pairs = rows["b_id"].to_numpy().astype(np.int64) << 32 | rows["a_id"].to_numpy()
    order = np.argsort(pairs)
    return bound, {"pairs": pairs[order].astype(np.uint64), "n": rows["n"].to_numpy()[order],
                   "best": rows["best"].to_numpy(zero_copy_only=False)[order]}


def _look_up(wanted: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted pair among sorted pairs, and whether it is there."""
    place = np.searchsorted(pairs, wanted)
    place[place == len(pairs)] = 0
    return place, pairs[place] == wanted if len(pairs) else np.zeros(len(wanted), bool)


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          first: str = FIRST, second: str = SECOND) -> DataFrame:
    """Alignment figures of every whole text, with counts of id pairs over all texts.

    n_a, n_b: tokens; n_groups; n_links: pairs of tokens that share bytes; n_shared: pairs of
    tokens in one group; n_best: links whose id pair is the most frequent one of its B id, ties
    included; count_sum: corpus counts of the links' id pairs, added up; groups_sha256. Null and
    empty texts, and texts that a tokenizer does not give back byte by byte (with U+2581), have
    zeros and an empty digest. Null ids and repeated rows are aligned and counted like others; an
    empty table gives no rows; further columns are not read.

    Texts are aligned once, in blocks that are written; what is exchanged afterwards are distinct
    id pairs, one row per pair and task. The counts of the at most ``HOT`` most frequent pairs go
    to every task (17 bytes each); all other pairs of a block are joined with the table of counts.
    """
    sent = Sent(docs, first, second)
    blocks = staged(_aligned_blocks(docs, id_col, text_col, sent), "aligned", GROUP)
    counts = staged(_pair_counts(blocks), "id_pairs")
    bound, frequent = _frequent(counts)
    hot = docs.sparkSession.sparkContext.broadcast(frequent)

    def ask(batches):
        for batch in batches:
            for row in _rows(batch):
                pairs = unpack_sorted(_planes(row["pairs"]))
                pairs = pairs[~_look_up(pairs, hot.value["pairs"])[1]]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(pairs), row["block"], np.int64)),
                    pa.array((pairs >> np.uint64(32)).astype(np.int32)),
                    pa.array((pairs & np.uint64(0xFFFFFFFF)).astype(np.int32))],
                    names=["block", "b_id", "a_id"])

    rare = (blocks.select("block", "pairs").mapInArrow(ask, "block bigint, b_id int, a_id int")
            .join(counts.filter(F.col("n") < bound).hint("merge"), ["b_id", "a_id"]))
    schema = T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType),
        *(T.StructField(name, T.LongType()) for name in (*COUNTED, "n_best", "count_sum")),
        T.StructField("groups_sha256", T.StringType())])

    def tell(texts: pa.Table, told: pa.Table) -> pa.Table:
        row = texts.to_pylist()[0]
        pairs, places = (unpack_sorted(_planes(row[c])) for c in ("pairs", "at"))
        place, known = _look_up(pairs, hot.value["pairs"])
        n, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
        n[known], best[known] = (hot.value[c][place[known]] for c in ("n", "best"))
        at = np.searchsorted(pairs, told["b_id"].to_numpy().astype(np.uint64) << np.uint64(32)
                             | told["a_id"].to_numpy().astype(np.uint64))
        n[at] = told["n"].to_numpy()
        best[at] = told["best"].to_numpy(zero_copy_only=False)
        links, of_text = (unpack_counts(_planes(row[c])) for c in ("links", "of_text"))
        starts = running(of_text)
        at = (places % np.uint64(max(len(pairs), 1))).astype(np.int64)
        return pa.table({
            id_col: pa.array(row["ids"], texts.schema.field("ids").type.value_type),
            **{name: pa.array(row[name], pa.int64()) for name in COUNTED},
            "n_best": _sums(links * best[at], starts), "count_sum": _sums(links * n[at], starts),
            "groups_sha256": pa.array(row["digests"], pa.string())})

    return blocks.groupBy("block").cogroup(rare.groupBy("block")).applyInArrow(tell, schema)
