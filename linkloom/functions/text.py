"""Names: normal forms, bounded edit distance, variants. Spark has no Unicode decomposition and no
restricted edit distance with swaps, so these are Pandas UDFs over small strings; the rest is built in.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that decomposition leaves whole, suffixes of names.
WHOLE_LETTERS = {"ı": "i", "ł": "l", "ø": "o", "đ": "d", "ð": "d", "ß": "ss"}
#: Suffixes of names.
SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "v")


def normalize_text(text: str | None) -> str:
    """Decomposed, without marks, lower-cased; quotes and dots vanish, other signs part words."""
    out = []
    for c in unicodedata.normalize("NFKD", text or "").lower():
        if unicodedata.combining(c) or c in "'’.":
            continue
        out.append(c if c.isalnum() else " ")
    return " ".join("".join(out).split())


def canonical_text(text: str | None) -> str:
    """The form in which names of different sources are compared."""
    bare = "".join(c for c in unicodedata.normalize("NFKD", text or "") if not unicodedata.combining(c))
    bare = "".join(WHOLE_LETTERS.get(c, c) for c in bare.casefold())
    return " ".join(re.sub(r"[^a-z0-9]+", " ", re.sub(r"[’'-]", "", bare)).split())


def osa_distance(a: str, b: str, most: int) -> int | None:
    """Edits, with swaps of neighbours, between two strings; none if over ``most``. No part is edited twice."""
    if abs(len(a) - len(b)) > most:
        return None
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            cost = min(last[j] + 1, now[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            now.append(cost)
        if min(now) > most:
            return None
        before, last = last, now
    return last[-1] if last[-1] <= most else None


def name_variants(name: str | None) -> list[str]:
    """A canonical name; the same without suffixes; of three words or more also without inner initials, and first and last alone."""
    words = canonical_text(name).split()
    if not words:
        return []
    bare = [w for w in words if w not in SUFFIXES]
    forms = [words, bare] if len(bare) >= 2 else [words]
    if len(bare) >= 3:
        ends = (bare[0], bare[-1])
        kept = [w for w in bare if len(w) > 1 or w in ends]
        forms += [kept, [kept[0], kept[-1]]] if len(kept) >= 2 else []
        forms += [list(ends)] if len(bare) == 3 else []
    return list(dict.fromkeys(" ".join(f) for f in forms))


def normalized(text: Column) -> Column:
    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(normalize_text)

    return of(text)


def canonical(text: Column) -> Column:
    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(canonical_text)

    return of(text)


def variants(text: Column) -> Column:
    @F.pandas_udf("array<string>")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(name_variants)

    return of(text)


def osa(a: Column, b: Column, most: int) -> Column:
    """``osa_distance``; pairs that even twice as many plain edits can't join are told by Spark's own levenshtein."""

    @F.pandas_udf("int")
    def of(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([osa_distance(x, y, most) if x is not None and y is not None else None for x, y in zip(left, right, strict=True)], dtype="Int32")

    return F.when(F.levenshtein(a, b, 2 * most) >= 0, of(a, b))


def one_edit(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b) == 1


def surname(canonical_name: Column) -> Column:
    """The last word that isn't a suffix."""
    words = F.filter(F.split(canonical_name, " "), lambda w: ~w.isin(*SUFFIXES))
    return F.when(F.size(words) > 0, F.element_at(words, -1))


def initial(canonical_name: Column) -> Column:
    return F.substring(canonical_name, 1, 1)


def dates_corroborate(a: Column, b: Column) -> Column:
    """Two birth dates that share the year, or the month and day."""
    return (F.year(a) == F.year(b)) | ((F.month(a) == F.month(b)) & (F.dayofmonth(a) == F.dayofmonth(b)))


def mention_spans(text: Column, most_words: int = 5, most_chars: int = 160) -> Column:
    """Distinct runs of one to five words as they stand in the text, in order of where they begin and of their length."""
    words = F.regexp_extract_all(text, F.lit(r"(?U)\S+\s*"), 0)
    starts = F.when(F.size(words) > 0, F.sequence(F.lit(1), F.size(words))).otherwise(F.array().cast("array<int>"))
    spans = F.flatten(
        F.transform(
            starts,
            lambda i: F.transform(
                F.sequence(F.lit(1), F.least(F.lit(most_words), F.size(words) - i + 1)),
                lambda n: F.regexp_replace(F.array_join(F.slice(words, i, n), ""), r"^[^\p{IsAlphabetic}\p{N}]+|[^\p{IsAlphabetic}\p{N}]+$", ""),
            ),
        )
    )
    return F.array_distinct(F.filter(spans, lambda s: (s != "") & (F.char_length(s) <= most_chars)))


def contains_phrase(text: Column, phrase: Column) -> Column:
    """Whether a phrase stands in a text as whole words."""
    quoted = F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), F.replace(phrase, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![\p{L}\p{N}])"))
    return (phrase != "") & F.regexp_like(text, quoted)


def escape_html(text: Column) -> Column:
    for mark, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(mark), F.lit(code))
    return text


def bounded_text(text: Column, most: int = 500) -> Column:
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def bounded_json(json: Column, most: int = 4096) -> Column:
    size = F.octet_length(json)
    return F.when(size > most, F.concat(F.lit('{"truncated":true,"bytes":'), size.cast("string"), F.lit("}"))).otherwise(json)
