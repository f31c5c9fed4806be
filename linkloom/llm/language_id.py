"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams on a bounded sample of labelled rows, drawn evenly by a hash of their ids, and
adds the counts of all tasks. The log-probability matrix (languages by buckets, both fixed by
parameters and the label set) is broadcast; texts are then scored whole, a batch at a time, in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDERS = (1, 2, 3)
BUCKETS = 1 << 14
SAMPLE_PER_LANGUAGE = 4000
UNDETERMINED = "und"
#: A letter is what Unicode has in category L: no digit, fraction, circled or Roman numeral.
_LETTER = regex.compile(r"\p{L}")
_SLICE = 1 << 18
_ENTRIES = 1 << 18
_PRIME = np.uint32(0x01000193)


@dataclass(frozen=True)
class LanguageModel:
    """``log_prob`` is buckets by languages; ``prior`` has a log-probability for each language."""

    languages: tuple[str, ...]
    log_prob: np.ndarray
    prior: np.ndarray


def hashed_ngrams(text: str, buckets: int = BUCKETS, orders: tuple[int, ...] = ORDERS) -> Iterator[np.ndarray]:
    """The buckets of all n-grams of the lower-cased text, in slices of bounded length."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    longest = max(orders)
    for at in range(0, len(points), _SLICE):
        part = points[at : at + _SLICE + longest - 1]
        h = np.full(len(part), 0x811C9DC5, np.uint32)
        for n in range(1, longest + 1):
            h = (h[: len(part) - n + 1] ^ part[n - 1 :]) * _PRIME
            if n in orders:
                mixed = h ^ (h >> np.uint32(15)) ^ np.uint32(n * 0x9E37)
                yield (mixed[:_SLICE] % np.uint32(buckets)).astype(np.int32)


def train(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "lang",
    sample_per_language: int = SAMPLE_PER_LANGUAGE,
    buckets: int = BUCKETS,
) -> LanguageModel | None:
    """Fit on about ``sample_per_language`` rows of each label (documented bound); None without rows.

    A row is taken where a hash of its id falls under its label's rate, so the sample is the same on
    every run and no label is sorted or gathered. Rows with a null text, label or id teach nothing.
    """
    rows = docs.filter(F.col(text_col).isNotNull() & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label")
    )
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    languages = tuple(sorted(sizes))
    rates = F.create_map(*[F.lit(v) for k in languages for v in (k, min(1.0, sample_per_language / sizes[k]))])
    share = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.filter(share < rates[F.col("label")]).select("label", "text")
    place = {k: i for i, k in enumerate(languages)}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(place), buckets), np.int64)
        for batch in batches:
            for label, text in zip(batch["label"], batch["text"], strict=True):
                for h in hashed_ngrams(text, buckets):
                    total[place[label]] += np.bincount(h, minlength=buckets)
        row, bucket = np.nonzero(total)
        yield pd.DataFrame({"row": row, "bucket": bucket, "n": total[row, bucket]})

    counts = sample.mapInPandas(count, "row int, bucket int, n long").groupBy("row", "bucket").agg(F.sum("n").alias("n")).toPandas()
    dense = np.zeros((buckets, len(languages)))
    dense[counts["bucket"].to_numpy(), counts["row"].to_numpy()] = counts["n"].to_numpy()
    smooth = dense + 0.5
    prior = np.array([sizes[k] for k in languages], float)
    return LanguageModel(languages, np.log(smooth / smooth.sum(0)), np.log(prior / prior.sum()))


def score_texts(model: LanguageModel, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """The likeliest language of each whole text and its posterior; ``und`` and 0 without a letter.

    The n-grams of many texts are the entries of a sparse matrix, a row a text: their log-probabilities are taken together and
    summed row by row, ``_ENTRIES`` entries at a time, so a long text is scored in parts and short ones in one go.
    """
    totals = np.tile(model.prior, (len(texts), 1))
    lettered = np.array([t is not None and _LETTER.search(t) is not None for t in texts], bool)
    held: list[tuple[int, np.ndarray]] = []

    def add() -> None:
        sizes = np.array([len(h) for _, h in held])
        log_p = model.log_prob.take(np.concatenate([h for _, h in held]), axis=0)
        np.add.at(totals, [i for i, _ in held], np.add.reduceat(log_p, np.cumsum(sizes) - sizes, axis=0))
        held.clear()

    entries = 0
    for i in np.flatnonzero(lettered):
        for h in hashed_ngrams(texts[i], len(model.log_prob)):
            if len(h):
                held.append((i, h))
                entries += len(h)
            if entries >= _ENTRIES:
                add()
                entries = 0
    if held:
        add()
    best = totals.argmax(1)
    sure = 1 / np.exp(totals - totals.max(1, keepdims=True)).sum(1)
    named = [model.languages[b] if ok else UNDETERMINED for b, ok in zip(best, lettered, strict=True)]
    return named, np.where(lettered, sure, 0.0)


def predict(docs: DataFrame, model: LanguageModel | None, text: Column) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score`` (0 to 1) from ``text`` alone. Without a model all are ``und``."""
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UNDETERMINED), "lang_score": F.lit(0.0)})
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def score(texts: pd.Series) -> pd.DataFrame:
        lang, sure = score_texts(held.value, texts.tolist())
        return pd.DataFrame({"lang": lang, "score": sure})

    return (
        docs.withColumn("_language", score(text))
        .withColumns({"lang_pred": F.col("_language.lang"), "lang_score": F.col("_language.score")})
        .drop("_language")
    )


def held_out(doc_id: Column) -> Column:
    """Whether a document is held back from training: crc32 of its id as text leaves 2 of 4; null is held back."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def identify(docs: DataFrame, sample_per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row, learnt from the rows that aren't held out.

    Null texts and texts without a letter get ``und`` and 0. Ties of two languages go to the first by
    code point. Repeated rows each give a row; other columns aren't read; an empty table gives no rows.
    """
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    learn = docs.filter(~held_out(F.col("doc_id")))
    model = train(learn, sample_per_language=sample_per_language)
    return predict(rows, model, F.col("text")).select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))


def keep_identified(docs: DataFrame, least_score: float = 0.5) -> DataFrame:
    """``docs`` without those whose language can't be told: ``und``, or a posterior under ``least_score``.

    Null, empty and letterless texts go; very long ones are scored whole. Repeated rows are each kept or not alike, an
    empty table gives no rows, other columns pass unread and their names can't clash. Without a labelled row all go.
    """
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    columns = docs.columns
    found = predict(docs.select([F.col(c).alias(f"_{i}") for i, c in enumerate(columns)]), model, F.col(f"_{columns.index('text')}"))
    kept = found.filter((F.col("lang_pred") != UNDETERMINED) & (F.col("lang_score") >= least_score))
    return kept.select([F.col(f"_{i}").alias(c) for i, c in enumerate(columns)])
