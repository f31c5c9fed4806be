"""Transaction pages: from HTML to dated movements of players between teams.

A Pandas UDF only cuts a page's list into its items; sentences, classes, directions and movements are
window and column expressions over those items.
"""

from __future__ import annotations

import html as entities
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.operators.order import parts_for

PART_PAGES = 1 << 15
ITEM = "li int, paragraph int, item int, kind string, text string, slug string, from_team string, to_team string"
_TAG = re.compile(r"<(/?)([a-zA-Z]+)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<!--.*?-->|<![^>]*>", re.S)
_ATTRIBUTE = re.compile(r"([\w-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_PLAYER = re.compile(r"^/players/[a-z]/([a-z0-9'.]+)\.html")
_COACH = re.compile(r"^/coaches/")

#: The classes of events in order of precedence, with the words that tell them.
EVENT_WORDS = (
    ("trade", ("traded", "in a three-team trade", "trade that sent")),
    ("sale", ("sold", "sale of", "sold the player rights")),
    ("purchase", ("purchased", "bought")),
    ("claim", ("claimed off waivers", "claimed on waivers", "claim")),
    ("waive", ("waived",)),
    ("release", ("released",)),
    ("extension", ("signed an extension", "contract extension")),
    ("resign", ("re-signed", "resigned")),
    ("sign", ("signed",)),
    ("renounce", ("renounced",)),
    ("dispersal", ("selected", "dispersal")),
    ("coach-hire", ("hired",)),
    ("coach-fire", ("fired",)),
)
#: Classes that move a player on or off a roster, and classes that never do.
ROSTER = ("trade", "sale", "purchase", "claim", "waive", "release", "sign", "resign", "dispersal", "contract-expiration")
NON_ROSTER = ("rights-transfer", "draft-pick-reference", "extension", "renounce", "contract-conversion")
#: Patterns of phrases.
_RIGHTS = r"\b(?:player|draft|reserve) rights\b|\bright[s]? to\b"
_EXPIRY = r"\bcontract expires\b"
_NOT_RESIGNED = r"\bnot re[- ]?signed\b"
_TURN = r"\bfor\s*$"
_NOT_SIGNED = r"\bnot (?:re[- ]?signed|sign|signed)\b"
_COACH_SAID = r"\b(?:head|assistant)\s*coach\b"
_LEAGUE = r"\b(?:g[- ]?league|d[- ]?league|development(?:al)? league)\b"
_CONVERTED, _REGULAR, _TWO_WAY = r"\bconverted\b", "regular contract", r"\btwo[- ]way contract\b"
_SOLD = r"\b(?:sold|purchased|bought|renounced)\b"
_LOANED, _ASSIGNED, _RECALLED = r"\b(?:loaned|loan|transferred)\b", r"\bassigned\b", r"\brecalled\b"


def _pieces(page: str):
    """(kind, name, attributes or text) for each tag and run of text of a page."""
    at = 0
    for m in _TAG.finditer(page):
        if m.start() > at:
            yield "text", "", entities.unescape(page[at : m.start()])
        at = m.end()
        if m[2]:
            attributes = {} if m[1] else {a.lower(): entities.unescape(x or y or z) for a, x, y, z in _ATTRIBUTE.findall(m[3])}
            yield ("end" if m[1] else "start"), m[2].lower(), attributes
    if at < len(page):
        yield "text", "", entities.unescape(page[at:])


def list_items(page: str | None, mark: str = "transactions_link") -> list[tuple]:
    """The items of the first list after the element with id ``mark``: dates, texts and links, in order.

    Ends of list entries may be missing; lists inside an entry belong to it.
    """
    out: list[tuple] = []
    active, depth, li, paragraph, in_p, dated, in_date = False, 0, -1, -1, False, False, False
    date, link, link_text = [], None, []

    def add(kind: str, text: str, slug: str | None = None, a: str | None = None, b: str | None = None) -> None:
        if kind == "text" and out and out[-1][3] == "text" and out[-1][:2] == (li, paragraph):
            out[-1] = (*out[-1][:4], out[-1][4] + text, None, None, None)
        else:
            out.append((li, paragraph, len(out), kind, text, slug, a, b))

    for kind, name, value in _pieces(page or ""):
        if not active:
            active = kind == "start" and value.get("id") == mark
            continue
        if kind == "text":
            if in_date:
                date.append(value)
            elif link is not None:
                link_text.append(value)
            elif in_p:
                add("text", value)
        elif name == "ul":
            depth += 1 if kind == "start" else -1
            if depth <= 0 and kind == "end":
                break
        elif name == "li" and kind == "start":
            if depth == 1:
                li, paragraph, in_p, dated, in_date, date, link = li + 1, -1, False, False, False, [], None
            elif in_p:
                add("text", " | ")
        elif li < 0:
            continue
        elif name == "p":
            in_p = kind == "start"
            paragraph += in_p
        elif name == "span":
            if kind == "start" and not dated and not in_p:
                dated = in_date = True
            elif kind == "end" and in_date:
                in_date = False
                out.append((li, -1, len(out), "date", " ".join("".join(date).split()), None, None, None))
        elif name == "a" and in_p:
            if kind == "start":
                link, link_text = value, []
            elif link is not None:
                href, a, b = link.get("href", ""), link.get("data-attr-from"), link.get("data-attr-to")
                player = _PLAYER.match(href)
                role = "player" if player else "coach" if _COACH.match(href) else "team" if a or b or href.startswith("/teams/") else "other"
                add(role, "".join(link_text).strip(), player[1] if player else None, a or None, b or None)
                link = None
    return out


def page_items(pages: DataFrame, mark: str = "transactions_link") -> DataFrame:
    """(page_id, li, date_text, paragraph, item, kind, text, slug, from_team, to_team) of (page_id, html)."""

    @F.pandas_udf(f"array<struct<{ITEM.replace(' int', ':int').replace(' string', ':string')}>>")
    def items(texts: pd.Series) -> pd.Series:
        names = [f.split()[0] for f in ITEM.split(", ")]
        return texts.map(lambda t: [dict(zip(names, row, strict=True)) for row in list_items(t, mark)])

    # a page's items stay in one small task for every window, here and in ``movements``
    parts = parts_for(pages.count(), pages.sparkSession, PART_PAGES)
    rows = pages.select("page_id", F.explode(items("html")).alias("i")).select("page_id", "i.*").repartition(parts, "page_id")
    date = F.first(F.when(F.col("kind") == "date", F.col("text")), ignorenulls=True).over(Window.partitionBy("page_id", "li"))
    return rows.withColumn("date_text", date).filter("kind <> 'date'")


def page_window(page: Column) -> tuple[Column, Column]:
    """The two dates between which a page says it lists transactions."""
    plain = F.regexp_replace(F.regexp_replace(page, r"<[^>]+>", " "), r"\s+", " ")
    form = r"Transactions listed are from\s+(.+?)\s+to\s+([^.]*?)\s*\."
    return F.nullif(F.regexp_extract(plain, form, 1), F.lit("")), F.nullif(F.regexp_extract(plain, form, 2), F.lit(""))


def event_class(text: Column, coach_only: Column | None = None) -> Column:
    """What a sentence reports, by the first rule that fits; words match whole."""
    low = F.lower(text)
    has = lambda p: low.rlike(p)
    of_coach = has(_COACH_SAID) | (coach_only if coach_only is not None else F.lit(False))
    league = has(_LEAGUE)
    out = (
        F.when(has(_EXPIRY), "contract-expiration")
        .when(has(_NOT_SIGNED), "other")
        .when(of_coach & low.contains("fired"), "coach-fire")
        .when(of_coach & low.contains("hired"), "coach-hire")
        .when(of_coach, "coach-other")
        .when(has(_CONVERTED) & low.contains(_REGULAR) & has(_TWO_WAY), "contract-conversion")
        .when(has(_RIGHTS) & has(_SOLD), "rights-transfer")
        .when(league & has(_LOANED), "g-league-loan-or-transfer")
        .when(has(_ASSIGNED), "g-league-assignment")
        .when(has(_RECALLED), "g-league-recall")
    )
    for name, words in EVENT_WORDS:
        out = out.when(has(r"\b(?:" + "|".join(words) + r")\b"), name)
    return out.when(low.contains("waiver"), "claim").otherwise("other")


def event_scope(name: Column) -> Column:
    return (
        F.when(name.isin(*ROSTER), "nba-roster")
        .when(name.startswith("coach-") | name.startswith("g-league-") | name.isin(*NON_ROSTER), "non-roster")
        .otherwise("unresolved")
    )


def movements(items: DataFrame) -> DataFrame:
    """(page_id, li, paragraph, item, slug, name, depart, arrive, scope, action) for each player named.

    In a sentence the nearest team link tells where a player comes from or goes to: one before with a
    from-mark, else one after; one after with a to-mark, else one before. Behind "for" in a trade the
    direction turns. Who travels as a right, or is named as a later pick, isn't moved on a roster; a
    player of the same paragraph who is such a pick stays unresolved.
    """
    by = ["page_id", "li", "paragraph"]
    parts = items.withColumn("parts", F.when(F.col("kind") == "text", F.split("text", r"(?<=[.;])\s+")).otherwise(F.array("text")))
    rows = parts.select(*by, "item", "kind", "slug", "from_team", "to_team", F.posexplode("parts").alias("part", "said"))
    order = Window.partitionBy(*by).orderBy("item", "part")
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"sentence": F.sum((F.col("part") > 0).cast("int")).over(order), "paragraph_text": F.array_join(F.collect_list("said").over(every), "")})
    s = Window.partitionBy(*by, "sentence")
    o = s.orderBy("item", "part")
    before, after, whole = o.rowsBetween(Window.unboundedPreceding, -1), o.rowsBetween(1, Window.unboundedFollowing), s.orderBy("item", "part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    team = F.when((F.col("kind") == "team") & F.coalesce("from_team", "to_team").isNotNull(), F.struct("from_team", "to_team"))
    rows = rows.withColumns(
        {
            "sentence_text": F.array_join(F.collect_list("said").over(whole), ""),
            "prefix": F.array_join(F.collect_list("said").over(before), ""),
            "following": F.when(F.lead("kind").over(o) == "text", F.lead("said").over(o)).otherwise(""),
            "back": F.last(team, ignorenulls=True).over(before),
            "ahead": F.first(team, ignorenulls=True).over(after),
            "sentence_from": F.first(F.when(F.col("kind") == "team", F.col("from_team")), ignorenulls=True).over(whole),
            "sentence_to": F.first(F.when(F.col("kind") == "team", F.col("to_team")), ignorenulls=True).over(whole),
            "turned": F.coalesce(F.max((F.col("kind") == "text") & F.col("said").rlike(_TURN)).over(before), F.lit(False)),
        }
    )
    # an expiry is told behind a semicolon; the clause before it has the player and the team
    expires = F.lower("paragraph_text").rlike(_EXPIRY) & F.lower("sentence_text").rlike(_NOT_RESIGNED)
    action = F.when(expires, "contract-expiration").otherwise(event_class(F.col("sentence_text")))
    last_at = lambda p: F.char_length(F.regexp_extract("prefix", f"(?is)^(.*)(?:{p})", 1))
    as_right = F.col("prefix").rlike(f"(?i){_RIGHTS}") & (~F.col("prefix").rlike(r"(?i)\bfor\b") | (last_at(_RIGHTS) > last_at(r"\bfor\b")))
    later = F.col("following").rlike(r"(?i)\bwas later selected\b")
    action = F.when(later, "draft-pick-reference").when(as_right, "rights-transfer").otherwise(action)
    turned = F.col("turned") & F.coalesce("sentence_from", "sentence_to").isNotNull()
    back_from, back_to = F.col("back.from_team"), F.when(F.col("back.from_team").isNull(), F.col("back.to_team"))
    ahead_to, ahead_from = F.col("ahead.to_team"), F.when(F.col("ahead.to_team").isNull(), F.col("ahead.from_team"))
    legs = rows.filter("kind = 'player'").select(
        *by, "item", "slug", F.col("said").alias("name"), F.when(turned, F.col("sentence_to")).otherwise(F.coalesce(back_from, ahead_from)).alias("depart"),
        F.when(turned, F.col("sentence_from")).otherwise(F.coalesce(ahead_to, back_to)).alias("arrive"), action.alias("action"),
    )
    picked = F.max(F.col("action") == "draft-pick-reference").over(Window.partitionBy(*by, "slug"))
    doubtful = picked & (event_scope(F.col("action")) == "nba-roster")
    legs = legs.withColumn("doubtful", doubtful)
    return legs.select(
        *by, "item", "slug", "name", "depart", "arrive", F.when(F.col("doubtful"), "unresolved").otherwise(event_scope(F.col("action"))).alias("scope"),
        F.when(F.col("doubtful"), "draft-roster-status-unresolved").otherwise(F.col("action")).alias("action"),
    )


_YEAR = r"(19[4-9]\d|20\d\d|2100)"
_LINKS = "to|and|through|thru|until"
_ERA = re.compile(rf"\b(?:from|between)\W+{_YEAR}\W+({_LINKS})\W+{_YEAR}\b|\b{_YEAR}[-–—]{_YEAR}\b|\b{_YEAR}(s)?\b", re.I)


def era_ranges(text: str | None) -> list[tuple[int, int]]:
    """Ranges of years that a text names: from-to, a decade, years joined by a dash, or single years; 1946 to 2100."""
    found: list[tuple[int, int]] = []
    at, text = 0, text or ""
    while m := _ERA.search(text, at):
        at = m.end()
        pairs = [(m[1], m[3])] if m[1] else [(m[4], m[5])] if m[4] else [(m[6], m[6])]
        a, b = int(pairs[0][0]), int(pairs[0][1])
        if m[7]:
            ranges = [(a, a + 9)] if a % 10 == 0 else []
        elif a <= b:
            ranges = [(a, b)]
        else:
            ranges = [(a, a), (b, b)] if m[1] else []
        for r in ranges:
            if r[0] >= 1946 and r not in found:
                found.append(r)
    return found


def eras(text: Column) -> Column:
    @F.pandas_udf("array<struct<first:int,last:int>>")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"first": a, "last": b} for a, b in era_ranges(t)])

    return of(text)
