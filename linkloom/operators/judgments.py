"""Guarded judgments: an external provider may order or clarify results, never change a fact of the graph.

The provider is any object with ``ask(questions) -> list[Answer]``. Answers are checked against fixed
thresholds before they count; a malformed or doubtful answer leaves the deterministic order in place.
The checks are column expressions over captured answers; the provider's own traffic is out of scope.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_BYTES = 32 * 1024
MOST_QUESTIONS = 8
BATCH = 4


@dataclass(frozen=True)
class Policy:
    """Thresholds of acceptance: of a choice, of a candidate's being meant at all, and of a score."""

    # Fixed values of the calibrated policy.
    probability: float = 0.95
    confidence: float = 0.95
    margin: float = 0.25
    existence: float = 0.5
    ranking: float = 0.25
    sum_slack: float = 0.02
    mean_slack: float = 0.03


@dataclass(frozen=True)
class Question:
    kind: str
    text: str
    options: tuple[str, ...] = ()


@dataclass(frozen=True)
class Answer:
    """Probabilities by option key, or by level for a score; ``failure`` names why there is none."""

    probabilities: dict[str, float] = field(default_factory=dict)
    confidence: float | None = None
    mean: float | None = None
    failure: str | None = None


class Provider(Protocol):
    def ask(self, questions: list[Question]) -> list[Answer]: ...


class Scripted:
    """Gives its answers in turn; the last one again and again."""

    def __init__(self, answers: list[list[Answer]]):
        self.answers, self.calls = list(answers), 0

    def ask(self, questions: list[Question]) -> list[Answer]:
        self.calls += 1
        return self.answers.pop(0) if len(self.answers) > 1 else self.answers[0]


def guarded(provider: Provider | None, questions: list[Question]) -> list[Answer]:
    """The provider's answers; unavailable ones if it is missing, asked too much, fails or answers too few."""
    if provider is None:
        return [Answer(failure="unconfigured")] * len(questions)
    size = sum(len(q.text.encode()) + sum(len(o.encode()) for o in q.options) for q in questions)
    if len(questions) > MOST_QUESTIONS or size > MOST_BYTES:
        return [Answer(failure="payload-too-large")] * len(questions)
    try:
        answers = provider.ask(questions)
    except Exception as e:  # the provider is foreign code: whatever it raises means no answer
        return [Answer(failure=type(e).__name__)] * len(questions)
    return answers if len(answers) == len(questions) else [Answer(failure="malformed")] * len(questions)


def option_keys(options: list[str], backwards: bool = False) -> dict[str, str]:
    """Opaque keys o000, o001, ... for options, whose order the provider can't read meaning into."""
    return {f"o{i:03d}": o for i, o in enumerate(reversed(options) if backwards else options)}


def usable(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & x.between(0.0, 1.0)


def accepted_choice(selected: Column, probabilities: Column, confidence: Column, keys: Column, policy: Policy = Policy()) -> Column:
    """The key that the provider selected, null unless its map of probabilities is well-formed and clear.

    Its keys are the options' exactly, each probability lies in 0 to 1, they sum to one within the slack,
    and the selected key's probability, the confidence and the lead over every other key reach the thresholds.
    """
    p = F.map_values(probabilities)
    own = F.try_element_at(probabilities, selected)
    others = F.map_values(F.map_filter(probabilities, lambda k, _: k != selected))
    lead = own - F.coalesce(F.array_max(others), F.lit(0.0))
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    well = (
        (F.array_sort(F.map_keys(probabilities)) == F.array_sort(keys)) & F.forall(p, usable) & usable(confidence) & (F.abs(total - 1) <= policy.sum_slack)
    )
    clear = (own >= policy.probability) & (confidence >= policy.confidence) & (lead >= policy.margin)
    return F.when(F.coalesce(well & clear, F.lit(False)), selected)


def valid_score(probabilities: Column, mean: Column, levels: Column | int, policy: Policy = Policy()) -> Column:
    """Whether an array of level probabilities is one: of the right length, summing to one, with the mean it claims."""
    total = F.aggregate(probabilities, F.lit(0.0), lambda a, x: a + x)
    weighed = F.aggregate(F.transform(probabilities, lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x)
    return F.coalesce(
        (F.size(probabilities) == levels) & F.forall(probabilities, usable) & (F.abs(total - 1) <= policy.sum_slack) & (F.abs(weighed - mean) <= policy.mean_slack),
        F.lit(False),
    )


def rank_chains(chains: DataFrame, scores: DataFrame, weights: dict[str, float], levels: int = 3) -> DataFrame:
    """``chains`` (place, path) with ``rank``: by weighted score, then place; by place alone if any score is bad.

    ``scores`` is (place, dimension, probabilities, mean). Chains must be of one length; a dimension of
    no weight never blocks; a missing or invalid score of any other restores the whole order.
    """
    needed = [d for d, w in weights.items() if w > 0]
    good = scores.filter(F.col("dimension").isin(needed)).withColumn("ok", valid_score(F.col("probabilities"), F.col("mean"), levels))
    weight = F.create_map(*[F.lit(x) for d in needed for x in (d, float(weights[d]))]) if needed else None
    value = (F.col("mean") / (levels - 1) * weight[F.col("dimension")]) if needed else F.lit(0.0)
    by_chain = good.groupBy("place").agg(F.sum(F.when(F.col("ok"), value)).alias("score"), F.count_if("ok").alias("n"), F.count("*").alias("all"))
    joined = chains.join(by_chain, "place", "left")
    whole = joined.agg(
        F.bool_and(F.coalesce((F.col("n") == len(needed)) & (F.col("all") == len(needed)), F.lit(not needed))).alias("whole"),
        (F.count_distinct(F.size("path")) <= 1).alias("equal"),
    )
    out = joined.join(F.broadcast(whole))
    key = F.when(F.col("whole") & F.col("equal"), -F.coalesce("score", F.lit(0.0))).otherwise(0.0)
    return out.select("place", "path", F.row_number().over(Window.orderBy(key, "place")).alias("rank"))


def threshold_sweep(captures: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, wrong, correct) of taking every answer of that confidence or more, best first.

    Best has the fewest wrong, then most correct, then the highest threshold. ``captures`` is (confidence, correct).
    """
    rows = captures.select(F.explode(F.filter(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: F.col("confidence") >= t)).alias("threshold"), "correct")
    every = captures.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    counts = rows.groupBy("threshold").agg(F.count_if(~F.col("correct")).alias("wrong"), F.count_if("correct").alias("correct"))
    zero = F.lit(0).cast("long")
    return every.join(counts, "threshold", "left").select("threshold", F.coalesce("wrong", zero).alias("wrong"), F.coalesce("correct", zero).alias("correct")).orderBy(
        "wrong", F.desc("correct"), F.desc("threshold")
    )


def experiment_summary(runs: DataFrame) -> DataFrame:
    """Counts and costs by (split, component, variant); a sum is null as soon as one run's figure is unknown."""
    total = lambda c: F.when(F.count(c) == F.count("*"), F.sum(c)).alias(c)
    return runs.groupBy("split", "component", "variant").agg(
        F.count("*").alias("n"), F.count_if("correct").alias("correct"), F.count_if(F.col("automatic") & ~F.col("correct")).alias("false_automatic"),
        F.count_if(~F.col("automatic")).alias("abstained"), total("tokens"), total("cost"), F.median("latency").alias("median_latency"), F.max("latency").alias("max_latency"),
    )


def resolve(candidates: DataFrame, chosen: Callable[[list[str]], str | None] | None = None) -> tuple[str, str | None]:
    """(status, id) for search candidates (id, status): an exact hit stands, an ambiguity may be settled by ``chosen``.

    A choice counts only if it is one of the candidates.
    """
    rows = candidates.select("id", "status").collect()
    if not rows:
        return "no_match", None
    if rows[0]["status"] in ("exact_match",) or len(rows) == 1:
        return "resolved", rows[0]["id"]
    ids = [r["id"] for r in rows]
    pick = chosen(ids) if chosen is not None else None
    return ("resolved", pick) if pick in ids else ("ambiguous", None)


def replay_equal(a: DataFrame, b: DataFrame, key: list[str], values: list[str], slack: float = 1e-12) -> DataFrame:
    """Keys whose values differ by more than ``slack``, or that only one side has. Empty if the replay agrees."""
    x, y = a.select(*key, F.struct(*values).alias("x")), b.select(*key, F.struct(*values).alias("y"))
    differs = F.lit(False)
    for v in values:
        differs = differs | (F.abs(F.col(f"x.{v}") - F.col(f"y.{v}")) > slack) | (F.col(f"x.{v}").isNull() != F.col(f"y.{v}").isNull())
    return x.join(y, key, "full").filter(F.col("x").isNull() | F.col("y").isNull() | F.coalesce(differs, F.lit(False))).select(*key)
