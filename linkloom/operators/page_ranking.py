"""Pages of chains ranked by an outside judge, in batches of four, so that one bad answer leaves the whole page as it was.

A batch is asked within a task, under a key made of its request; the answers are written before anything reads them. A task that is
tried again asks under the same key, by which a judge answers once. What comes back counts only if the envelope is
whole: every question answered once, with well-formed probabilities.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.operators.judgments import BATCH, Policy, valid_score
from linkloom.scratch import materialise

#: What a page's ranking is called, and why.
RANKED, DETERMINISTIC, UNAVAILABLE, UNCERTAIN = (
    ("ranked", "semantic_suggestion"), ("deterministic", "only_alternative"), ("unavailable", "semantic_unavailable"), ("uncertain", "low_confidence"),
)
MOST_INTEREST, MOST_PAGE, MOST_CRITERION = 160, 20, 500
_ANSWERS = "page string, place long, dimension string, mean double, probabilities array<double>, confidence double, failure string"

_ARROW = pa.schema(
    [("page", pa.string()), ("place", pa.int64()), ("dimension", pa.string()), ("mean", pa.float64()), ("probabilities", pa.list_(pa.float64())), ("confidence", pa.float64()), ("failure", pa.string())]
)


@dataclass(frozen=True)
class Ranking:
    """What is asked, and how the answers weigh."""

    interest: str
    era_weight: float = 0.5
    interest_weight: float = 0.5
    confidence: float = Policy.ranking
    era_levels: tuple[str, ...] = ("none", "some", "much")
    interest_levels: tuple[str, ...] = ("none", "some", "much")
    backwards: bool = False

    def __post_init__(self) -> None:
        weights = (self.era_weight, self.interest_weight)
        levels = (self.era_levels, self.interest_levels)
        if not self.interest.strip() or len(self.interest) > MOST_INTEREST:
            raise ValueError("an interest of 1 to 160 characters is needed")
        if not all(math.isfinite(w) and w >= 0 for w in weights) or not 0 < sum(weights) < math.inf or not 0 <= self.confidence <= 1:
            raise ValueError("weights must not be negative, their sum positive, the confidence from 0 to 1")
        if not all(2 <= len(x) <= 10 and all(s.strip() and len(s) <= MOST_CRITERION for s in x) for x in levels):
            raise ValueError("two to ten criteria of 1 to 500 characters are needed")

    def questions(self, n: int) -> dict:
        """The two questions about each of ``n`` chains."""
        return _questions(self.era_levels, self.interest_levels, n)

    def request(self, chains: list[str]) -> dict:
        """The questions about up to four chains, each a JSON text; backwards the last chain is asked about first."""
        ordered = chains[::-1] if self.backwards else chains
        return {"interest": self.interest, "chains": [json.loads(c) for c in ordered], "questions": self.questions(len(ordered))}

    def key(self, request: dict) -> str:
        """The digest of a request as JSON text with sorted keys; what follows its chains is the same for all requests about as many."""
        chains = json.dumps(request["chains"], sort_keys=True)
        return hashlib.sha256(f'{{"chains": {chains}{_rest(self.interest, tuple(self.era_levels), tuple(self.interest_levels), len(request["chains"]))}'.encode()).hexdigest()


@lru_cache(maxsize=1024)
def _names(i: int) -> tuple[str, str]:
    return f"chain_{i:02d}_era", f"chain_{i:02d}_fit"


def _questions(era: tuple[str, ...], fit: tuple[str, ...], n: int) -> dict:
    return {name: {"type": "score", "criteria": list(levels)} for i in range(n) for name, levels in zip(_names(i), (era, fit), strict=True)}


@lru_cache(maxsize=64)
def _rest(interest: str, era: tuple[str, ...], fit: tuple[str, ...], n: int) -> str:
    return ", " + json.dumps({"interest": interest, "questions": _questions(era, fit, n)}, sort_keys=True)[1:]


@lru_cache(maxsize=1024)
def _level_numbers(keys: tuple[str, ...]) -> tuple[tuple[int, ...], bool] | None:
    """The levels that the keys of probabilities name, and whether they rise; none if a key is no level below 256."""
    if not all(k.isascii() and k.removeprefix("+").isdigit() and int(k) < 256 for k in keys):
        return None
    levels = tuple(int(k) for k in keys)
    return levels, all(x < y for x, y in zip(levels, levels[1:], strict=False))


def _number(x: object) -> float | None:
    return float(x) if isinstance(x, (float, int)) and not isinstance(x, bool) else None


def parse_answer(value: object) -> dict | None:
    """One answer of an envelope; none if any part of it is missing or of another type."""
    if not isinstance(value, dict):
        return None
    kind = value.get("type")
    if kind == "noul":
        p = _number(value.get("noul"))
        return None if p is None else {"kind": kind, "value": p}
    if kind not in ("choice", "score") or not isinstance(value.get("probabilities"), dict):
        return None
    keys, p = tuple(value["probabilities"]), [v if type(v) is float else _number(v) for v in value["probabilities"].values()]
    confidence = _number(value.get("confidence"))
    said = _number(value.get("score")) if kind == "score" else value.get("choice")
    if confidence is None or None in p or said is None or (kind == "choice" and not isinstance(said, str)):
        return None
    if kind == "score":
        named = _level_numbers(keys)
        if named is None:
            return None
        keys, rising = named
        if not rising:
            return {"kind": kind, "value": said, "probabilities": dict(sorted(zip(keys, p, strict=True))), "confidence": confidence}
    return {"kind": kind, "value": said, "probabilities": dict(zip(keys, p, strict=True)), "confidence": confidence}


def parse_envelope(text: str | None) -> dict[str, dict] | None:
    """The answers by question; none at all if the text is no envelope or any answer is malformed."""
    try:
        answers = json.loads(text or "").get("answers")
    except (ValueError, AttributeError, RecursionError):
        return None
    if not isinstance(answers, dict) or not answers:
        return None
    parsed = {k: parse_answer(v) for k, v in answers.items()}
    return None if None in parsed.values() else parsed


def judged(chains: DataFrame, ranking: Ranking, ask: Callable[[str, dict], str] | None) -> DataFrame:
    """(page, place, dimension, mean, probabilities, confidence, failure) of every chain of pages with several, a table.

    ``chains`` is (page, place, chain), places from 0, chains as JSON texts. ``ask`` takes a key and a request and gives an envelope; it is
    sent to the tasks, and whatever it raises means no answer. A batch without a whole answer has one row that names the failure.
    """
    size = Window.partitionBy("page")
    several = chains.withColumn("n", F.count("*").over(size)).filter("n > 1").withColumn("batch", F.floor(F.col("place") / BATCH))
    batches = several.groupBy("page", "batch").agg(F.array_sort(F.collect_list(F.struct("place", "chain"))).alias("own"))

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch["own"]
            texts, places = (held.flatten().field(name).to_pylist() for name in ("chain", "place"))
            out, at = [], 0
            for page, n in zip(batch["page"].to_pylist(), held.value_lengths().to_pylist(), strict=True):
                own, at = range(at, at + n), at + n
                request = ranking.request(texts[own.start : own.stop])
                failure, answers = "unconfigured", None
                asked = request["questions"].keys()
                if ask is not None:
                    try:
                        answers, failure = parse_envelope(ask(ranking.key(request), request)), "malformed"
                    except Exception as e:  # the judge is foreign code
                        failure = type(e).__name__
                if answers is None or answers.keys() != asked or any(a["kind"] != "score" for a in answers.values()):
                    out.append((page, None, None, None, None, None, failure))
                    continue
                for i, c in enumerate(own[::-1] if ranking.backwards else own):
                    for dimension, name in zip(("era", "fit"), _names(i), strict=True):
                        a = answers[name]
                        p = a["probabilities"]
                        whole = next(reversed(p), -1) + 1 == len(p)
                        levels = list(p.values()) if whole else [p.get(k) for k in range(max(p) + 1)]
                        out.append((page, places[c], dimension, a["value"], levels, a["confidence"], None))
            columns = zip(*out, strict=True) if out else [[] for _ in _ARROW]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ARROW.types, strict=True)], schema=_ARROW)

    return materialise(batches.select("page", "own").mapInArrow(call, _ANSWERS), "judged")


def rank_pages(chains: DataFrame, ranking: Ranking, ask: Callable[[str, dict], str] | None = None) -> DataFrame:
    """(page, place, chain, rank, era, fit, score, status, reason): each page by falling score, then place, or as it was.

    A page of one chain is never asked about. If a batch of a page has no whole answer, or a score isn't well-formed, no score of the page
    stands; if one that weighs is held with less than the confidence, none ranks. Pages hold ``MOST_PAGE`` chains at most by contract,
    and pages are told apart by ``page``, a string.
    """
    said = judged(chains, ranking, ask)
    levels = F.when(F.col("dimension") == "era", len(ranking.era_levels)).otherwise(len(ranking.interest_levels))
    total = ranking.era_weight + ranking.interest_weight
    weight = F.when(F.col("dimension") == "era", ranking.era_weight / total).otherwise(ranking.interest_weight / total)
    good = F.col("failure").isNull() & valid_score(F.col("probabilities"), F.col("mean"), levels) & F.col("confidence").between(0.0, 1.0)
    marked = said.withColumns({"good": F.coalesce(good, F.lit(False)), "weight": weight, "part": weight * F.col("mean") / (levels - 1)})
    pages = marked.groupBy("page").agg(F.bool_and("good").alias("whole"), F.bool_or((F.col("weight") > 0) & (F.col("confidence") < ranking.confidence)).alias("doubtful"))
    value = lambda name: F.max(F.when(F.col("dimension") == name, F.col("mean"))).alias(name)
    era_part, fit_part = (F.max(F.when(F.col("dimension") == name, F.col("part"))) for name in ("era", "fit"))
    scored = marked.filter("place is not null").groupBy("page", "place").agg(value("era"), value("fit"), (era_part + fit_part).alias("score"))
    rows = chains.select("page", "place", "chain").join(scored, ["page", "place"], "left").join(pages, "page", "left")
    state = lambda i: F.when(F.col("whole").isNull(), DETERMINISTIC[i]).when(~F.col("whole"), UNAVAILABLE[i]).when(F.col("doubtful"), UNCERTAIN[i]).otherwise(RANKED[i])
    rows = rows.withColumns({"status": state(0), "reason": state(1)})
    told: Column = F.col("status").isin(RANKED[0], UNCERTAIN[0])
    rows = rows.withColumns({"score": F.when(F.col("status") == RANKED[0], F.col("score")), "era": F.when(told, F.col("era")), "fit": F.when(told, F.col("fit"))})
    order = Window.partitionBy("page").orderBy(F.desc_nulls_last("score"), "place")
    return rows.select("page", "place", "chain", F.row_number().over(order).alias("rank"), "era", "fit", "score", "status", "reason")
