"""Token counts of texts of any length: overlapping chunks, spliced at proven boundaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODEL = public_tokenizers.path("piece_bpe_32k.model")
CHUNK = 16_384      # characters from seam to seam; longer texts are encoded in chunks
OVERLAP = 96        # characters on both sides of a seam that both chunks hold, before widening


def check_model(model: bytes) -> None:
    """Refuses models for which a boundary cannot be proved from the pieces alone."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    parsed = proto.ModelProto()
    parsed.ParseFromString(model)
    kinds = {piece.type for piece in parsed.pieces}
    normal = parsed.normalizer_spec
    if (parsed.trainer_spec.model_type != proto.TrainerSpec.BPE
            or normal.precompiled_charsmap or normal.remove_extra_whitespaces
            or not normal.escape_whitespaces or not normal.add_dummy_prefix
            or parsed.trainer_spec.treat_whitespace_as_suffix
            or kinds & {proto.ModelProto.SentencePiece.USER_DEFINED,
                        proto.ModelProto.SentencePiece.UNUSED}):
        raise ValueError("only plain BPE models with identity normalisation are supported")


class Span:
    """Ids of text[start:stop] and the text position at the end of each token.

    The library puts a blank in front; for a span inside a text it stands before ``start``. Of a
    character in byte tokens the first one counts for the character, the others for nothing.
    """

    def __init__(self, encoder: SplicingEncoder, text: str, start: int, stop: int):
        self.start, self.stop = start, stop
        self.ids = np.array(encoder.encode(text[start:stop]), np.int32)
        self.ends = np.cumsum(encoder.chars[self.ids]) + (start - 1)

    def until(self, place: int) -> int:
        """Number of tokens that end at or before a boundary."""
        return int(np.searchsorted(self.ends, place, side="right"))


class SplicingEncoder:
    """Encodes long texts in overlapping chunks, with the ids that the library gives for the whole.

    A place is a *proven* boundary if no vocabulary piece occurs in the text across it. Every
    merge of byte-pair encoding makes a vocabulary piece, so none ever crosses the place, whatever
    stands around it: both sides are encoded as if alone. Pieces have at most ``reach`` characters,
    so a chunk that holds ``reach`` characters on both sides of the place shows the boundary too.
    """

    def __init__(self, model: bytes, chunk: int = CHUNK, overlap: int = OVERLAP):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.encode = self.library.encode
        names = [self.library.id_to_piece(i) for i in range(self.library.vocab_size())]
        plain = [not (self.library.is_byte(i) or self.library.is_control(i)
                      or self.library.is_unknown(i)) for i in range(len(names))]
        self.pieces = {name for name, own in zip(names, plain) if own}
        self.reach = max(map(len, self.pieces))
        # Bytes 80 to BF continue a character that an earlier byte token has begun.
        self.chars = np.array([len(name) if own else int(not (
            self.library.is_byte(i) and 0x80 <= int(name[3:5], 16) < 0xC0))
            for i, (name, own) in enumerate(zip(names, plain))], np.int64)
        self.overlap = max(overlap, self.reach)
        self.chunk = max(chunk, 2 * self.overlap)

    def proven(self, text: str, place: int) -> bool:
        """No piece stands in the text across this place."""
        near = text[max(place - self.reach, 0):place + self.reach].replace(" ", "▁")
        middle = min(place, self.reach)
        return not any(near[i:j] in self.pieces for i in range(middle)
                       for j in range(middle + 1, min(len(near), i + self.reach) + 1))

    def boundary(self, text: str, left: Span, right: Span, seam: int, kept: int) -> int | None:
        """The proven boundary behind ``kept``, nearest to the seam, that both spans see whole."""
        shared = np.intersect1d(left.ends, right.ends)
        first = max(kept + 1, right.start + self.reach if right.start else 1)
        last = left.stop - self.reach if left.stop < len(text) else len(text) - 1
        shared = shared[(shared >= first) & (shared <= last)]
        for place in shared[np.argsort(abs(shared - seam), kind="stable")].tolist():
            if self.proven(text, place):
                return place
        return None

    def parts(self, text: str) -> Iterator[np.ndarray]:
        """Ids of the text, part by part; memory holds two chunks."""
        size, kept = len(text), 0
        left = Span(self, text, 0, min(size, self.chunk + self.overlap))
        while left.stop < size:
            seam, width = left.stop - self.overlap, self.overlap
            while True:
                right = Span(self, text, max(seam - width, 0),
                             min(size, seam + self.chunk + width))
                cut = self.boundary(text, left, right, seam, kept)
                if cut is not None:
                    break
                width *= 2
                left = Span(self, text, left.start, min(size, seam + width))
                if left.stop == size:       # no boundary left: the rest is one chunk
                    break
            if left.stop == size:
                break
            yield left.ids[left.until(kept) if kept else 0:left.until(cut)]
            left, kept = right, cut
        yield left.ids[left.until(kept) if kept else 0:]

    def count(self, text: str) -> int:
        """Number of tokens of a whole text."""
        if len(text) <= self.chunk + self.overlap:
            return len(self.encode(text))
        return sum(map(len, self.parts(text)))


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 model: str = MODEL, limit: int = 4096, chunk: int = CHUNK,
                 overlap: int = OVERLAP) -> DataFrame:
    """Bytes and tokens of every whole text, and whether it has more than ``limit`` tokens.

    Counted as the library counts the whole text, without begin and end tokens; strings of special
    tokens are ordinary text. Texts over ``chunk`` characters are encoded in chunks of that size
    which overlap; where no proven common boundary lies in the overlap it is doubled, at last up to
    the whole text. Null and empty texts have no tokens and no bytes; null ids, repeated rows and
    ties are rows like others; an empty table gives no rows; further columns are not read.

    One pass without a shuffle. The model (half a megabyte) is read once and sent to the tasks.
    """
    with open(model, "rb") as source:
        content = source.read()
    check_model(content)
    sent = docs.sparkSession.sparkContext.broadcast(content)
    schema = T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType),
        T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("over_limit", T.BooleanType())])

    def scan(batches):
        encoder = SplicingEncoder(sent.value, chunk, overlap)
        for batch in batches:
            counts = np.fromiter(
                (encoder.count(text.as_py()) if text.is_valid else 0 for text in batch.column(1)),
                np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(counts), pa.array(counts > limit)],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(
        F.col(id_col), F.col(text_col),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes")
    ).mapInArrow(scan, schema)
