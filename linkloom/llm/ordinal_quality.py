"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade <= k | text) = sigmoid(threshold_k - w.x) with one weight vector for all grades over hashed
words, and thresholds that stay in order as each is the last plus an exponential. The fit gives the
expected grade and the probability of the tail from a chosen grade on, by which documents are selected.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.scratch import materialise

BUCKETS = 1 << 18
SAMPLE = 9000
GRADES = 3
PREFIXES = (4, 5)
LEAST_SHARE = 0.005
LEAST_TEXTS = 3
#: Tokens that a process remembers before it starts anew; about 7 MB.
TOKENS_HELD = 1 << 15
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_STRIPPED = _MARKS.decode()


@dataclass(frozen=True)
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray


def _slot(kind: bytes, value: bytes) -> int:
    return zlib.crc32(value, zlib.crc32(kind + b"\0")) % BUCKETS


class _Tokens(dict):
    """The place of each token met by this process in two tables: buckets of its word, and its end marks and letter case.

    ``says`` has three buckets a token, those of the lower-cased word and of the word's beginnings
    (``BUCKETS`` for none). ``mark`` numbers the pairs of end marks and case; there are few of these.
    """

    def __init__(self):
        self.says, self.mark = array("i"), array("i")
        self.pairs: dict[tuple[bytes, bytes], int] = {}
        self.pair_slots: list[tuple[int, int]] = []

    def __missing__(self, token: bytes) -> int:
        word = token.decode("utf-8", "replace").lower().strip(_STRIPPED)
        self.says.append(_slot(b"word", word.encode()))
        for n in PREFIXES:
            self.says.append(_slot(b"begin", word[:n].encode()) if len(word) > n else BUCKETS)
        tail = token[len(token.rstrip(_MARKS)) :][:8]
        shape = b"upper" if len(token) > 1 and token.isupper() else b"digit" if token.isdigit() else b"plain"
        pair = self.pairs.get((tail, shape))
        if pair is None:
            pair = self.pairs[tail, shape] = len(self.pair_slots)
            self.pair_slots.append((_slot(b"tail", tail), _slot(b"shape", shape)))
        self.mark.append(pair)
        self[token] = at = len(self)
        return at


_known = _Tokens()
_last = np.zeros(BUCKETS + 1, np.int32)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of a whole text; none for a null or wordless text. A bucket may come twice; its values add up.

    Words and their beginnings count 1 where they occur; end marks and letter case count by their share
    of the words; one bucket tells how far the words repeat.
    """
    global _known
    tokens = Counter((text or "").encode("utf-8", "surrogatepass").split())
    if not tokens:
        return np.empty(0, np.int32), np.empty(0)
    if len(_known) > TOKENS_HELD:
        _known = _Tokens()
    n = len(tokens)
    at = np.fromiter(map(_known.__getitem__, tokens), np.int64, n)
    times = np.fromiter(tokens.values(), np.float64, n)
    total = times.sum()
    says = np.frombuffer(_known.says, np.int32).reshape(-1, 1 + len(PREFIXES))[at].ravel()
    order = np.arange(len(says), dtype=np.int32)
    _last[says] = order
    present = says[_last[says] == order]
    present = present[present < BUCKETS]
    share = np.bincount(np.frombuffer(_known.mark, np.int32)[at], weights=times)
    x: dict[int, float] = {}
    for pair in np.flatnonzero(share).tolist():
        for slot in _known.pair_slots[pair]:
            x[slot] = x.get(slot, 0.0) + 10.0 * share[pair] / total
    repeat = _slot(b"repeat", b"%d" % min(9, int(10 * (1 - n / total))))
    slots = np.concatenate([present, np.fromiter(x, np.int32, len(x)), [repeat]]).astype(np.int32)
    return slots, np.concatenate([np.ones(len(present)), np.fromiter(x.values(), np.float64, len(x)), [5.0]])


def _cumulative(model: OrdinalModel, score: np.ndarray) -> np.ndarray:
    """P(grade <= k) for each score (rows) and threshold."""
    return 1 / (1 + np.exp(np.clip(score[:, None] - model.thresholds[None, :], -500, 500)))


def expected_and_tail(model: OrdinalModel, score: np.ndarray, tail_from: int) -> tuple[np.ndarray, np.ndarray]:
    below = _cumulative(model, score)
    return (1 - below).sum(1), 1 - below[:, tail_from - 1]


def fit(
    at: list[np.ndarray], x: list[np.ndarray], grade: np.ndarray, grades: int = GRADES, rounds: int = 150, rate: float = 0.1, penalty: float = 1e-3,
    weight: np.ndarray | None = None,
) -> OrdinalModel:
    """Maximum likelihood by Adam on the whole sample; fixed start and steps, so the fit is the same each time.

    ``weight`` tells how many rated documents each row stands for; one each without it.
    """
    return fit_flat(np.concatenate(at), np.concatenate(x), np.fromiter(map(len, at), np.int64, len(at)), grade, grades, rounds, rate, penalty, weight)


def fit_flat(
    cols: np.ndarray, val: np.ndarray, lengths: np.ndarray, grade: np.ndarray, grades: int = GRADES, rounds: int = 150, rate: float = 0.1, penalty: float = 1e-3,
    weight: np.ndarray | None = None,
) -> OrdinalModel:
    """``fit`` for rows laid end to end: buckets, values, and how many each row has, none of them zero."""
    cols, starts = cols.astype(np.int64), np.cumsum(lengths) - lengths
    stands = np.ones(len(grade)) if weight is None else weight / weight.mean()
    share = np.array([np.average(grade <= k, weights=stands) for k in range(grades - 1)]).clip(0.01, 0.99)
    first = np.log(share / (1 - share))
    theta = np.concatenate([[first[0]], np.log(np.maximum(np.diff(first), 0.05)), np.zeros(BUCKETS)])
    m, v, n = np.zeros_like(theta), np.zeros_like(theta), len(grade)
    cut = grades - 1
    for step in range(1, rounds + 1):
        thresholds = np.cumsum(np.concatenate([[theta[0]], np.exp(theta[1:cut])]))
        w = theta[cut:]
        score = np.add.reduceat(val * w[cols], starts)
        edge = np.concatenate([[-np.inf], thresholds, [np.inf]])
        cdf = 1 / (1 + np.exp(np.clip(score[:, None] - edge[None, :], -500, 500)))
        pdf = cdf * (1 - cdf)
        i = np.arange(n)
        p = np.maximum(cdf[i, grade + 1] - cdf[i, grade], 1e-12)
        d_score = stands * (pdf[i, grade + 1] - pdf[i, grade]) / p
        d_threshold = np.zeros(cut)
        np.add.at(d_threshold, grade[grade < cut], -(stands * pdf[i, grade + 1] / p)[grade < cut])
        np.add.at(d_threshold, grade[grade > 0] - 1, (stands * pdf[i, grade] / p)[grade > 0])
        after = np.cumsum(d_threshold[::-1])[::-1]
        g = np.concatenate([after * np.concatenate([[1.0], np.exp(theta[1:cut])]), np.bincount(cols, val * np.repeat(d_score, lengths), BUCKETS)]) / n
        g[cut:] += penalty * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8) * min(1.0, 2 * (1 - step / (rounds + 1)))
    thresholds = np.cumsum(np.concatenate([[theta[0]], np.exp(theta[1:cut])]))
    return OrdinalModel(theta[cut:].copy(), thresholds)


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 2 less one for low quality and one for toxicity, so the grades are 0, 1 and 2.

    Rows with a null in any of the three columns rate nothing. Several ratings of a document give the
    lowest.
    """
    grade = F.lit(2) - (F.col("quality") == 0).cast("int") - (F.col("toxic") == 1).cast("int")
    rated = labels.select("doc_id", grade.alias("grade")).filter("doc_id is not null and grade is not null")
    return rated.groupBy("doc_id").agg(F.min("grade").alias("grade"))


def train(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> OrdinalModel | None:
    """Fit on about ``sample`` rated documents (documented bound), a third for each grade where there are so many.

    A row is taken where a hash of its id falls under its grade's rate; so few ids are broadcast. Rows weigh one by their
    grade's rate, so thresholds and probabilities stand for all ratings at every size. Texts become features in their
    own tasks, buckets that occur in too few of the sample's texts to teach anything are left out by a
    count, and what remains of the sample meets on the driver. None without ratings.
    """
    sizes = {r["grade"]: r["n"] for r in ratings.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    rate = {k: min(1.0, sample / GRADES / n) for k, n in sizes.items()}
    rates = F.create_map(*[F.lit(v) for pair in rate.items() for v in pair])
    share = F.pmod(F.xxhash64("doc_id", F.lit("rated")), F.lit(1 << 30)) / float(1 << 30)
    chosen = ratings.filter(share < rates[F.col("grade")]).select(F.col("doc_id").alias("_id"), "grade")
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")

    @F.pandas_udf("at array<int>, x array<float>")
    def sparse(column: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(at, x.astype(np.float32)) for at, x in map(features, column)], columns=["at", "x"])

    rows = materialise(texts.select("_id", "grade", sparse("_text").alias("f")).select("_id", "grade", "f.at", "f.x"), "features")
    seen = rows.filter(F.size("at") > 0).select(F.explode(F.array_distinct("at")).alias("slot")).groupBy("slot").count()
    least = max(LEAST_TEXTS, int(LEAST_SHARE * rows.count()))
    usable = np.zeros(BUCKETS, bool)
    usable[seen.filter(F.col("count") >= least).select("slot").toArrow()["slot"].to_numpy()] = True
    held = docs.sparkSession.sparkContext.broadcast(usable)

    @F.pandas_udf("at array<int>, x array<float>")
    def known(at: pd.Series, x: pd.Series) -> pd.DataFrame:
        kept = [held.value[a] for a in at]
        return pd.DataFrame({"at": [a[k] for a, k in zip(at, kept, strict=True)], "x": [v[k] for v, k in zip(x, kept, strict=True)]})

    rows = rows.filter(F.size("at") > 0).select("_id", "grade", known("at", "x").alias("f")).select("_id", "grade", "f.at", "f.x")
    rows = rows.filter(F.size("at") > 0).toArrow().sort_by([("_id", "ascending"), ("grade", "ascending")]).combine_chunks()
    if not rows.num_rows:
        return None
    grade = rows["grade"].to_numpy().astype(int)
    weight = np.array([1 / rate[g] for g in grade.tolist()])
    lengths = pc.list_value_length(rows["at"]).to_numpy().astype(np.int64)
    cols, val = (pc.list_flatten(rows[c]).to_numpy() for c in ("at", "x"))
    del rows
    return fit_flat(cols, val, lengths, grade, weight=weight)


def rate(docs: DataFrame, model: OrdinalModel | None, text: Column, tail_from: int = GRADES - 1) -> DataFrame:
    """``docs`` with ``expected_grade`` (0 to grades - 1) and ``p_tail``, the probability of ``tail_from`` or more.

    A null or wordless text has no features and takes grade 0 and probability 0. Without a model both
    columns are null.
    """
    if model is None:
        return docs.withColumns({"expected_grade": F.lit(None).cast("double"), "p_tail": F.lit(None).cast("double")})
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("expected double, tail double")
    def score(texts: pd.Series) -> pd.DataFrame:
        weights = held.value.weights
        raw = np.fromiter((x @ weights[at] if len(at) else np.nan for at, x in map(features, texts)), np.float64, len(texts))
        empty = np.isnan(raw)
        expected, tail = expected_and_tail(held.value, np.where(empty, 0.0, raw), tail_from)
        return pd.DataFrame({"expected": np.where(empty, 0.0, expected), "tail": np.where(empty, 0.0, tail)})

    return (
        docs.withColumn("_rating", score(text))
        .withColumns({"expected_grade": F.col("_rating.expected"), "p_tail": F.col("_rating.tail")})
        .drop("_rating")
    )


def rated_documents(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """(doc_id, expected_grade, p_tail, kept) for each row of ``docs``; kept where p_tail reaches ``least``.

    Without ratings every document is kept and has null scores. Repeated rows each give a row, other
    columns aren't read, an empty table gives no rows.
    """
    model = train(docs, graded(labels))
    found = rate(docs.select("doc_id", "text"), model, F.col("text"))
    return found.select("doc_id", "expected_grade", "p_tail", F.coalesce(F.col("p_tail") >= least, F.lit(True)).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """``docs`` without those whose probability of the top grade is under ``least``; all columns kept.

    Null and wordless texts go, unless there are no ratings at all, when every row stays. Very long texts are scored
    whole; repeated rows are judged alike; an empty table gives no rows; names of other columns can't clash.
    """
    model = train(docs, graded(labels))
    columns = docs.columns
    renamed = docs.select([F.col(c).alias(f"_{i}") for i, c in enumerate(columns)])
    kept = rate(renamed, model, F.col(f"_{columns.index('text')}")).filter(F.coalesce(F.col("p_tail") >= least, F.lit(True)))
    return kept.select([F.col(f"_{i}").alias(c) for i, c in enumerate(columns)])
