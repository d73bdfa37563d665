"""Language identification as a mixture: character n-grams, expectation-maximisation, penalty."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adsight.llm.common import fold

BUCKETS = 1 << 16       # hashed character trigrams of a language model
UNIT = 8                # words whose trigrams form one observation of the mixture
LANGUAGES = 1000        # more learned languages are refused, as the model is sent to all tasks


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Trigram bucket ids of the letters of a text, and the first id of each unit of words."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    codes = np.where(_letters()[codes], codes, 0).astype(np.uint32)
    codes = np.concatenate(([np.uint32(0)], codes, [np.uint32(0)]))
    codes = codes[np.concatenate(([True], (codes[1:] != 0) | (codes[:-1] != 0)))]
    if len(codes) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    mixed = (codes[:-2] * np.uint32(2654435761) ^ codes[1:-1] * np.uint32(2246822519)
             ^ codes[2:] * np.uint32(3266489917))
    mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(2654435761)
    ids = (mixed >> np.uint32(16)).astype(np.int64) % BUCKETS
    word = np.cumsum(codes[:-2] == 0) - 1
    return ids, np.flatnonzero(np.diff(word // UNIT, prepend=-1))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, bucket, n): trigram counts of every language over all rows given.

    Each task adds up its own rows first, so the shuffle carries at most one row per language,
    bucket and task, however common a language is.
    """
    def count(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1)):
                ids, _ = _grams(text.as_py())
                own = totals.setdefault(lang.as_py(), np.zeros(BUCKETS, np.int64))
                own += np.bincount(ids, minlength=BUCKETS) if len(ids) > BUCKETS // 8 else 0
                if len(ids) <= BUCKETS // 8:
                    np.add.at(own, ids, 1)
        for lang, own in totals.items():
            found = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(found), pa.string()), pa.array(found, pa.int32()),
                 pa.array(own[found])], names=["lang", "bucket", "n"])

    rows = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.col(text_col), F.col(lang_col))
    return rows.mapInArrow(count, "lang string, bucket int, n bigint").groupBy(
        "lang", "bucket").agg(F.sum("n").alias("n"))


def _model(counts: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order and their log-likelihood tables; bounded by languages x buckets."""
    langs = [r["lang"] for r in counts.select("lang").distinct().limit(LANGUAGES + 1).collect()]
    if len(langs) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages to learn")
    langs.sort()
    table = np.zeros((len(langs), BUCKETS))
    place = {lang: i for i, lang in enumerate(langs)}
    rows = counts.toPandas()
    table[rows["lang"].map(place).to_numpy(int), rows["bucket"].to_numpy(int)] = rows["n"]
    table = np.log((table + 0.1) / (table.sum(1, keepdims=True) + 0.1 * BUCKETS))
    return langs, table.astype(np.float32)


def _fit(likely: np.ndarray, share: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Expectation-maximisation of the shares of a set of languages over a document's units."""
    n = len(likely)
    for _ in range(rounds):
        total = likely @ share
        new = share * (likely.T @ (1 / total)) / n
        moved = np.abs(new - share).max()
        share = new
        if moved < 1e-4:
            break
    return share, float(np.log(likely @ share).sum())


def mixture(text: str, table: np.ndarray, penalty: float = 1.0) -> np.ndarray | None:
    """Share of every language in one text; None without a letter.

    Languages are removed from the smallest share up as long as the log-likelihood loses less
    than ``penalty`` x log(units) per language (the Bayesian criterion counts half of that for
    each free share; a whole keeps chance matches out).
    """
    ids, starts = _grams(text)
    if not len(ids):
        return None
    fit = np.add.reduceat(table[:, ids], starts, axis=1, dtype=np.float64).T
    likely = np.maximum(np.exp(fit - fit.max(axis=1, keepdims=True)), 1e-300)
    kept = np.arange(len(table))
    share, best = _fit(likely, np.full(len(kept), 1 / len(kept)))
    price = penalty * np.log(len(likely) + 1)
    while len(kept) > 1:
        alive = np.ones(len(kept), bool)
        alive[np.argmin(share)] = False
        alive &= share > 1e-6
        if not alive.any():
            break
        start = share[alive] / share[alive].sum()
        new, value = _fit(likely[:, kept[alive]], start)
        if value < best - price * (~alive).sum():
            break
        kept, share, best = kept[alive], new, value
    full = np.zeros(len(table))
    full[kept] = share
    return full


def predict(docs: DataFrame, counts: DataFrame, text_col: str = "text",
            penalty: float = 1.0) -> DataFrame:
    """All columns of ``docs`` kept as ``row`` (struct) beside lang_pred, score and the mixture.

    lang_pred: the language with the largest share, ``und`` for a null text or one without a
    letter (score 0, empty mixture); also ``und`` where nothing could be learned. ``languages``
    and ``shares`` list the chosen set, largest share first.
    """
    langs, table = _model(counts)
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(table)  # languages x buckets, bounded above
    fields = T.StructType([
        T.StructField("row", T.StructType(docs.schema.fields)),
        T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
        T.StructField("languages", T.ArrayType(T.StringType())),
        T.StructField("shares", T.ArrayType(T.DoubleType()))])

    def label(batches):
        for batch in batches:
            best, score, chosen, shares = [], [], [], []
            for text in batch.column(1):
                text = text.as_py()
                found = mixture(text, model.value, penalty) if text and langs else None
                order = [] if found is None else [
                    int(i) for i in np.argsort(-found, kind="stable") if found[i] > 0]
                best.append(langs[order[0]] if order else "und")
                score.append(min(1.0, float(found[order[0]])) if order else 0.0)
                chosen.append([langs[i] for i in order])
                shares.append([float(found[i]) for i in order])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(best, pa.string()), pa.array(score, pa.float64()),
                 pa.array(chosen, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))],
                names=["row", "lang_pred", "score", "languages", "shares"])

    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                         F.col(text_col).alias("own_text"))
    return packed.mapInArrow(label, fields)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang", folds: int = 3, test_fold: int = 1,
             penalty: float = 1.0) -> DataFrame:
    """Learns from labelled rows outside the test fold and labels every row.

    Returns id, held_out, lang_pred, score, languages, shares. The label, source and id of a row
    are never inputs of its prediction. Rows with a null id are never held out. Repeated rows are
    labelled alike; an empty table gives an empty result; without any label all are ``und``.
    """
    held = fold(id_col, folds) == test_fold
    counts = train(docs.filter(~held), text_col, lang_col)
    narrow = docs.select(F.col(id_col), held.alias("held_out"), F.col(text_col).alias("text"))
    labelled = predict(narrow.select(id_col, "held_out", "text"), counts, "text", penalty)
    return labelled.select(f"row.{id_col}", "row.held_out", "lang_pred", "score", "languages",
                           "shares")
