"""URL filtering: rules first, then naive Bayes over segmented host words and path tokens.

Host names run words together. A unigram model over the words of the pages themselves splits them by
Viterbi: the split of highest total log-probability. The words of host and path are hashed into the
buckets of a multinomial naive Bayes model, learnt from the urls that the rules judge.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.scratch import materialise

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
BUCKETS = 1 << 16
_LETTERS = r"\p{L}+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def split_url(url: Column) -> tuple[Column, Column]:
    """The host after the first ``://``, A-Z lower-cased, and the path; both empty for null or without ``://``."""
    form = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.coalesce(F.regexp_extract(url, form, 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(url, form, 2), F.lit(""))
    return F.translate(host, _UPPER, _UPPER.lower()), path


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits a host or a parent of it and begins the path, and its verdict; else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(slash + rest)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def word_counts(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(word, n): every word, a run of letters in lower case, of all pages outside tags, and how often it occurs."""
    text = F.lower(F.regexp_replace(html_col, "(?is)<(script|style)\\b.*?</\\1>|<[^>]*>|&[a-z]+;", " "))
    words = pages.select(F.explode(F.regexp_extract_all(text, F.lit(_LETTERS), 0)).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


class Segmenter:
    """Splits a run of letters into words by Viterbi over unigram log-probabilities.

    ``counts`` has what words occur, ``total`` how many words there are in all. Words may be of any length.
    """

    def __init__(self, counts: dict[str, int], total: int | None = None):
        self.total = (sum(counts.values()) if total is None else total) or 1
        self.log_p = {w: math.log(n / self.total) for w, n in counts.items()}

    def _unknown(self, length: int) -> float:
        """An unknown word: rarer than any known one, and ten times rarer with each letter."""
        return -math.log(self.total) - length * math.log(10)

    def split(self, run: str) -> list[str]:
        """The best split, of equals the one whose last word is longest. A known word beats its letters as an unknown one, so
        only known words' lengths and the best place for an unknown one to begin are tried at each letter."""
        step, lengths = math.log(10), sorted({len(w) for w in self.log_p})
        best, back = [0.0], [0]
        least, start = 0.0, 0  # the best of best[at] + at * step, and the first place that has it
        for end in range(1, len(run) + 1):
            score, at = max(
                [(best[start] + self._unknown(end - start), -start)]
                + [(best[end - n] + self.log_p[w], n - end) for n in lengths if n <= end and (w := run[end - n : end]) in self.log_p]
            )
            best.append(score)
            back.append(-at)
            if score + end * step > least:
                least, start = score + end * step, end
        words, end = [], len(run)
        while end:
            words.append(run[back[end] : end])
            end = back[end]
        return words[::-1]


def split_runs(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """(run, words) for each distinct ``run`` of letters, split by the unigram model of ``counts`` (word, n).

    Only what a run holds is looked up, in joins, so the vocabulary stays a table however large it grows. A word of 2^k letters or
    more, but no 2^(k+1), is met by its first 2^k letters: from each letter of a run the beginnings of 1, 2, 4, ... letters are looked up among
    those, and only the lengths of words found so are looked for. So a run of n letters asks for n log n beginnings.
    """
    total = counts.agg(F.sum("n")).first()[0]
    doubled = lambda size: F.transform(F.sequence(F.lit(0), F.length(F.bin(size)) - 1), lambda k: F.pow(F.lit(2), k).cast("int"))
    begin = lambda word, at: F.xxhash64(F.substring(word, at, F.col("power")), F.col("power"))
    top = F.pow(F.lit(2), F.length(F.bin(F.char_length("word"))) - 1).cast("int")
    begins = counts.withColumn("power", top).select(begin("word", F.lit(1)).alias("h"), F.char_length("word").alias("length")).distinct()
    named = runs.select("run", F.md5("run").alias("key"), F.char_length("run").alias("size"))
    starts = named.select("key", "run", "size", F.explode(F.sequence(F.lit(1), F.col("size"))).alias("start"))
    # the rest of the run first: what begins there is then read from its head
    rests = starts.select("key", "start", "size", F.substring("run", F.col("start"), F.col("size")).alias("rest"))
    asked = rests.select("key", "start", "size", "rest", F.explode(doubled(F.col("size") - F.col("start") + 1)).alias("power"))
    met = asked.select("key", "start", "size", begin("rest", F.lit(1)).alias("h")).join(begins, "h").filter("length <= size - start + 1")
    parts = met.select("key", "start", "length").join(named, "key").select("key", F.substring("run", F.col("start"), F.col("length")).alias("word")).distinct()
    known = parts.join(counts, "word").groupBy("key").agg(F.collect_list(F.struct("word", "n")).alias("known"))

    @F.pandas_udf("array<string>")
    def split(run: pd.Series, words: pd.Series) -> pd.Series:
        made = []
        for r, found in zip(run, words, strict=True):
            made.append(Segmenter({w["word"]: w["n"] for w in found} if found is not None else {}, total or 0).split(r))
        return pd.Series(made, dtype=object)

    return named.join(known, "key", "left").select("run", split("run", "known").alias("words"))


def host_tokens(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """(host, tokens) for each distinct ``host``: the words of its runs of letters, and its numbers, in their order."""
    pieces = hosts.select("host", F.posexplode(F.regexp_extract_all(F.lower("host"), F.lit(rf"{_LETTERS}|\p{{N}}+"), 0)).alias("place", "run"))
    runs = pieces.filter(F.col("run").rlike(_LETTERS)).select("run").distinct()
    split = pieces.join(materialise(split_runs(runs, counts), "runs"), "run", "left")
    own = F.coalesce("words", F.array("run"))
    placed = split.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("place", own.alias("words")))).alias("all"))
    return placed.select("host", F.transform(F.flatten(F.col("all.words")), lambda w: F.concat(F.lit("host:"), w)).alias("tokens"))


def rule_tokens(rules: tuple[tuple[str, str], ...]) -> list[str]:
    """The tokens that rules themselves consist of. A model learnt from what rules judge must not see these."""
    found = set()
    for rule, _ in rules:
        host, _, path = rule.lower().partition("/")
        found |= {f"host:{w}" for w in re.findall(r"[^\W_]+", host)} | {f"path:{w}" for w in re.findall(r"[^\W_]+", path)}
    return sorted(found)


def _buckets(tokens: list[str]) -> np.ndarray:
    return np.fromiter((zlib.crc32(t.encode("utf-8", "surrogatepass")) % BUCKETS for t in tokens), np.int32, len(tokens))


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, p_block, words) for each row of ``pages`` (page_id, url, html).

    The rule's verdict holds where a rule fits; else the model blocks where the probability of ``block``
    is above one half. The model learns from all urls that a rule judges, without the words that rules consist of; where
    these urls have but one verdict, the rest get it, and ``allow`` if no url has any. Null urls have an empty host and path.
    Repeated rows each give a row; other columns aren't read; an empty table gives no rows. Hosts and pages of any
    length are taken whole, and no word of the pages is left out of the unigram model.
    """
    spark = pages.sparkSession
    counts = materialise(word_counts(pages), "words")
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    named = materialise(host_tokens(rows.select("host").distinct(), counts), "hosts")
    of_path = F.transform(F.regexp_extract_all(F.lower("path"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.concat(F.lit("path:"), w))
    rows = rows.join(named, "host", "left").withColumn("words", F.concat(F.coalesce("tokens", F.array().cast("array<string>")), of_path))
    seen = F.array_except("words", F.array(*map(F.lit, rule_tokens(rules)))) if rules else F.col("words")
    rows = materialise(rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("says"), "words", seen.alias("seen")), "urls")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = {"allow": np.zeros(BUCKETS, np.int64), "block": np.zeros(BUCKETS, np.int64)}
        for batch in batches:
            for says, tokens in zip(batch["says"], batch["seen"], strict=True):
                np.add.at(total[says], _buckets(list(tokens)), 1)
        for says, n in total.items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"says": says, "bucket": at, "n": n[at]})

    learn = rows.filter("says is not null")
    urls = {r["says"]: r["n"] for r in learn.groupBy("says").agg(F.count("*").alias("n")).collect()}
    counts = learn.select("says", "seen").mapInPandas(count, "says string, bucket int, n long").groupBy("says", "bucket").agg(F.sum("n").alias("n")).toPandas()
    smooth = {}
    for says in ("allow", "block"):
        own = counts[counts["says"] == says]
        dense = np.full(BUCKETS, 0.5)
        dense[own["bucket"].to_numpy()] += own["n"].to_numpy()
        smooth[says] = np.log(dense / dense.sum())
    allow, block = urls.get("allow", 0), urls.get("block", 0)
    prior = 0.0 if allow and block else (-np.inf if not block else np.inf)
    if allow and block:
        prior = math.log(block / allow)
    odds = spark.sparkContext.broadcast((smooth["block"] - smooth["allow"], prior))

    @F.pandas_udf("double")
    def p_block(tokens: pd.Series) -> pd.Series:
        weight, start = odds.value
        raw = np.array([start + weight[_buckets(list(t))].sum() for t in tokens], float)
        return pd.Series(1 / (1 + np.exp(-np.clip(raw, -700, 700))))

    judged = rows.withColumn("p_block", p_block("seen"))
    said = F.coalesce("says", F.when(F.col("p_block") > 0.5, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", said.alias("verdict"), "p_block", "words")
