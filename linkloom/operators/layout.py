"""Places for nodes: lanes by debut, rings by distance with sectors by team, and the view onto them.

Everything is column and window expressions; distances come from the path operators.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.operators.neighbourhood import ring_places
from linkloom.operators.proof_groups import ProofGroups
from linkloom.scratch import materialise

#: Fixed values of the placement.
UNKNOWN_DEBUT, FIRST_YEAR, YEAR_WIDTH, JITTER, LANE_HEIGHT = 1980, 1947, 110.0, 105.0, 5200.0
RINGS = {1: (220.0, 460.0), 2: (620.0, 1020.0), 3: (1300.0, 1900.0)}
GOLDEN = 0.618033988749895
STEP, RING_START, RING_STEP, RING_SIZE = 170.0, 150.0, 100.0, 12
_MOST_HALVINGS = 20
TIERS = (("macro", 0.25, 1.1, 0.13), ("meso", 0.75, 1.8, 0.4), ("micro", None, 2.3, 0.5))


def fnv1a(text: Column) -> Column:
    """The 32-bit FNV-1a hash of a text's UTF-8 bytes, as a long."""
    code = F.hex(F.encode(text, "utf-8"))
    places = F.when(F.length(code) > 0, F.sequence(F.lit(0), F.floor(F.length(code) / 2).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    byte = lambda i: F.conv(F.substring(code, i * 2 + 1, F.lit(2)), 16, 10).cast("long")
    return F.aggregate(places, F.lit(2166136261).cast("long"), lambda h, i: (h.bitwiseXOR(byte(i)) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF)))


def era_lanes(nodes: DataFrame) -> DataFrame:
    """(id, x, y): across by debut year, up and down by a hash of the id. ``nodes`` is (id, debut)."""
    h = fnv1a(F.col("id"))
    rows = nodes.select("id", F.coalesce("debut", F.lit(UNKNOWN_DEBUT)).cast("double").alias("year"), h.alias("h"))
    x = (F.col("year") - FIRST_YEAR) * YEAR_WIDTH + (F.col("h") % 1000) / 1000.0 * JITTER
    lane = (F.floor(F.col("h") / 1000) % 10000) / 10000.0
    return rows.select("id", x.alias("x"), ((lane - 0.5) * LANE_HEIGHT).alias("y"))


def sectors(weighted: DataFrame, focus: str) -> DataFrame:
    """(team, start, end): the angles that the teams of a node's links take up, by their number; the nameless last."""
    own = weighted.filter((F.col("a") == focus) | (F.col("b") == focus))
    counts = own.groupBy(F.coalesce("primary_team", F.lit("")).alias("team")).agg(F.count("*").alias("links"))
    every = Window.partitionBy()
    n = F.count("*").over(every)
    gap = F.least(F.lit(0.055), F.lit(1.0) / n)
    room = F.lit(2.0) * F.pi() - gap * n
    least = F.least(F.lit(0.18), room / (2.0 * n))
    sized = counts.withColumns({"gap": gap, "width": least + (room - least * n) * F.col("links") / F.sum("links").over(every)})
    order = Window.orderBy(F.col("team") == "", "team").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("width") + F.col("gap")).over(order), F.lit(0.0)) - F.pi() / 2
    return sized.withColumn("start", before).select("team", "start", (F.col("start") + F.col("width")).alias("end"))


def focus_groups(weighted: DataFrame, links: DataFrame | ProofGroups, hops: DataFrame, focus: str) -> DataFrame:
    """(id, team): a neighbour's team is its link's; two links away it is that of the first neighbour by id."""
    own = weighted.filter((F.col("a") == focus) | (F.col("b") == focus))
    first = own.select(F.when(F.col("a") == focus, F.col("b")).otherwise(F.col("a")).alias("id"), F.col("primary_team").alias("team"))
    if isinstance(links, ProofGroups):
        # of those who ask a group the first by id speaks for it
        asked = first.withColumnRenamed("id", "node").join(links.asks, "node").groupBy("kind", "grp").agg(F.min(F.struct("node", "team")).alias("via"))
        met = asked.join(links.members, ["kind", "grp"]).groupBy(F.col("other").alias("id")).agg(F.min("via").alias("via"))
        return first.union(met.join(hops.filter("distance = 2").select(F.col("node").alias("id")), "id", "left_semi").select("id", "via.team"))
    second = hops.filter("distance = 2").select(F.col("node").alias("id")).join(links.select(F.col("node").alias("id"), F.col("other").alias("via")), "id")
    inherited = second.join(first.withColumnRenamed("id", "via"), "via").groupBy("id").agg(F.min_by("team", "via").alias("team"))
    return first.union(inherited)


def concentric(nodes: DataFrame, weighted: DataFrame, links: DataFrame | ProofGroups, hops: DataFrame, focus: str) -> DataFrame:
    """(id, ring, x, y): the focus in the middle, others on rings 1, 2 and 3 (all further ones).

    Within a ring nodes stand by team sector; on the first the heaviest links are innermost, on the
    others radii follow the golden ratio. ``nodes`` is (id, debut), ``hops`` (node, distance) up to 2.
    """
    groups = focus_groups(weighted, links, hops, focus)
    placed = nodes.join(hops.withColumnRenamed("node", "id"), "id", "left").join(groups, "id", "left")
    placed = placed.select("id", "debut", F.coalesce("distance", F.lit(3)).alias("ring"), F.coalesce("team", F.lit("~")).alias("team"))
    group = Window.partitionBy("ring", "team")
    ordered = Window.partitionBy("ring").orderBy("team", F.asc_nulls_last("debut"), "id")
    placed = placed.withColumns(
        {
            "k": F.row_number().over(group.orderBy(F.asc_nulls_last("debut"), "id")) - 1, "members": F.count("*").over(group),
            "at": F.row_number().over(ordered) - 1, "ring_size": F.count("*").over(Window.partitionBy("ring")),
        }
    )
    ranks = ring_places(links, weighted, nodes, focus).select("id", ((F.col("place") - 1) / F.greatest(F.col("of") - 1, F.lit(1))).alias("rank"))
    placed = placed.join(ranks, "id", "left").join(F.broadcast(sectors(weighted, focus)), "team", "left")
    spiral = F.col("k") * GOLDEN - F.floor(F.col("k") * GOLDEN)
    bound = lambda i: F.when(F.col("ring") == 1, RINGS[1][i]).when(F.col("ring") == 2, RINGS[2][i]).otherwise(RINGS[3][i])
    inner, outer = bound(0), bound(1)
    radius = F.when(F.col("ring") == 1, inner + F.coalesce("rank", F.lit(0.0)) * (outer - inner)).otherwise(F.sqrt(inner * inner + spiral * (outer * outer - inner * inner)))
    around = 2.0 * F.pi() * F.col("at") / F.col("ring_size")
    within = F.col("start") + (F.col("end") - F.col("start")) * (F.col("k") + 0.5) / F.col("members")
    angle = F.when((F.col("ring") <= 2) & F.col("start").isNotNull(), within).otherwise(around)
    centre = F.col("ring") == 0
    return placed.select("id", "ring", F.when(centre, 0.0).otherwise(radius * F.cos(angle)).alias("x"), F.when(centre, 0.0).otherwise(radius * F.sin(angle)).alias("y"))


def path_rings(nodes: DataFrame, focus: str, path: list[str]) -> DataFrame:
    """(id, x, y): the path in a row, the rest by id in rings of twelve around the focus."""
    at = F.array_position(F.array(*[F.lit(p) for p in path]), F.col("id")) - 1 if path else F.lit(-1)
    on_path = F.coalesce(at >= 0, F.lit(False))
    middle = (path.index(focus) if focus in path else 0) * STEP
    alone = (F.col("id") == focus) & F.lit(not path)
    rest = nodes.select("id").filter(~on_path & ~alone)
    rest = rest.withColumns({"k": F.row_number().over(Window.orderBy("id")) - 1, "n": F.count("*").over(Window.partitionBy())})
    ring = F.floor(F.col("k") / RING_SIZE)
    angle = 2.0 * F.pi() * (F.col("k") % RING_SIZE) / F.least(F.col("n") - ring * RING_SIZE, F.lit(RING_SIZE)) - F.pi() / 2
    radius = RING_START + ring * RING_STEP
    rows = nodes.select("id", at.alias("at")).filter(on_path).select("id", (F.col("at") * STEP).alias("x"), F.lit(0.0).alias("y"))
    lone = nodes.filter(alone).select("id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    return rows.union(lone).union(rest.select("id", (F.lit(middle) + radius * F.cos(angle)).alias("x"), (radius * F.sin(angle)).alias("y")))


def zoom_tier(scale: Column) -> Column:
    return F.when(scale < TIERS[0][1], TIERS[0][0]).when(scale < TIERS[1][1], TIERS[1][0]).otherwise(TIERS[2][0])


def node_radius(tier: Column, degree: Column, landmark: Column) -> Column:
    base, slope = F.lit(TIERS[2][2]), F.lit(TIERS[2][3])
    for name, _, b, s in TIERS[:2]:
        base, slope = F.when(tier == name, b).otherwise(base), F.when(tier == name, s).otherwise(slope)
    return F.least(F.greatest(base + F.log2(1.0 + degree) * slope + F.when(landmark, 1.4).otherwise(0.0), F.lit(1.1)), F.lit(9.0))


def zoom_blend(scale: Column, boundary: float, reduced: bool = False) -> Column:
    if reduced:
        return F.when(scale >= boundary, 1.0).otherwise(0.0)
    t = F.least(F.greatest((scale - boundary) / 0.08, F.lit(0.0)), F.lit(1.0))
    return t * t * (3.0 - 2.0 * t)


def to_screen(x: Column, y: Column, camera: tuple[float, float, float], width: float, height: float) -> tuple[Column, Column]:
    """World to screen for a camera (scale, x, y) and a viewport; the height is stretched to its shape."""
    scale, cx, cy = camera
    stretch = 0.6 * max(width, 1.0) / max(height, 1.0)
    return x * scale + cx, y * (scale * stretch) + cy


def to_world(x: Column, y: Column, camera: tuple[float, float, float], width: float, height: float) -> tuple[Column, Column]:
    scale, cx, cy = camera
    stretch = 0.6 * max(width, 1.0) / max(height, 1.0)
    return (x - cx) / scale, (y - cy) / (scale * stretch)


def nearest_node(points: DataFrame, clicks: DataFrame, reach: float = 80.0) -> DataFrame:
    """(click, id, distance): the nearest point within ``reach`` of each click, of equals the first by id.

    Points and clicks meet in grid cells; a click looks into its own and the eight around. The first cells are so small that a point
    or so lies in each on the whole; a click that finds nothing as near as a cell is wide looks again in cells twice as wide, up to the
    reach. So crowded places cost no more than empty ones. Points of one place are one point, clicks of one place one click.
    """
    p = points.filter("x is not null and y is not null").groupBy("x", "y").agg(F.min("id").alias("id")).select("id", F.col("x").alias("px"), F.col("y").alias("py"))
    p = materialise(p, "points")
    spots = clicks.select("x", "y").filter("x is not null and y is not null").distinct()
    box = p.agg(F.count("*").alias("n"), *[f(c).alias(f"{n}_{c}") for c in ("px", "py") for n, f in (("low", F.min), ("high", F.max))]).first()
    open_ = materialise(spots, "clicks")
    if not box["n"]:
        return clicks.select("click", F.lit(None).cast(points.schema["id"].dataType).alias("id"), F.lit(None).cast("double").alias("distance")).limit(0)
    area = max(box["high_px"] - box["low_px"], 1e-9) * max(box["high_py"] - box["low_py"], 1e-9)
    halvings = min(max(int(math.log2(max(reach / math.sqrt(area / box["n"]), 1.0))), 0), _MOST_HALVINGS)
    found: DataFrame | None = None
    for k in range(halvings, -1, -1):
        wide = reach / 2**k
        best = materialise(_nearest_in(p, open_, wide), "near")
        # what is nearer than a cell is wide can't be beaten from outside the nine cells
        sure = best if k == 0 else best.filter(F.col("distance") < wide * (1 - 1e-9))
        found = sure if found is None else found.union(sure)
        if k:
            open_ = materialise(open_.join(sure, ["x", "y"], "left_anti"), "clicks")
    return clicks.select("click", "x", "y").join(found, ["x", "y"]).groupBy("click").agg(F.min(F.struct("distance", "id")).alias("b")).select("click", "b.id", "b.distance")


def _nearest_in(p: DataFrame, spots: DataFrame, wide: float) -> DataFrame:
    """(x, y, id, distance): for each spot the nearest point within ``wide``, if any, by cells of that width."""
    cell = lambda c: F.floor(F.col(c) / wide)
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    placed = p.withColumns({"gx": cell("px"), "gy": cell("py")})
    asked = spots.select("x", "y", F.explode(around).alias("d")).select("x", "y", (cell("x") + F.col("d.i")).alias("gx"), (cell("y") + F.col("d.j")).alias("gy"))
    met = asked.join(placed, ["gx", "gy"]).withColumn("distance", F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py"))).filter(F.col("distance") <= wide)
    return met.groupBy("x", "y").agg(F.min(F.struct("distance", "id")).alias("b")).select("x", "y", "b.id", "b.distance")


def _cells_of(low: Column, high: Column, cell: float) -> Column:
    return F.sequence(F.floor(low / cell), F.floor(high / cell))


def nearest_edge(segments: DataFrame, clicks: DataFrame, reach: float = 8.0, cell: float = 80.0) -> DataFrame:
    """(click, edge, distance): the nearest line nearer than ``reach`` to each click, of equals the first by edge.

    ``segments`` is (edge, x1, y1, x2, y2), ``clicks`` (click, x, y); rows with nulls take no part. A line is laid over all grid cells that it
    comes within reach of, column by column, and a click looks into its own cell alone; so a line is met where it
    passes, however long it is, and by no click elsewhere. A line of no length is a point.
    """
    able = lambda df: df.dropna()
    s = able(segments.select("edge", *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")]))
    left, right = F.least("x1", "x2"), F.greatest("x1", "x2")
    columns = s.withColumn("gx", F.explode(_cells_of(left - reach, right + reach, cell)))
    # the part of the line over a column and its surroundings, as shares of its length
    wide = F.col("x2") - F.col("x1")
    share = lambda x: F.least(F.greatest(F.when(wide == 0, 0.0).otherwise((x - F.col("x1")) / F.nullif(wide, F.lit(0.0))), F.lit(0.0)), F.lit(1.0))
    a, b = share(F.col("gx") * cell - reach), share((F.col("gx") + 1) * cell + reach)
    at = lambda t: F.col("y1") + t * (F.col("y2") - F.col("y1"))
    ya, yb = F.when(wide == 0, F.col("y1")).otherwise(at(a)), F.when(wide == 0, F.col("y2")).otherwise(at(b))
    laid = columns.withColumn("gy", F.explode(_cells_of(F.least(ya, yb) - reach, F.greatest(ya, yb) + reach, cell)))
    c = able(clicks.select("click", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))
    met = c.withColumns({"gx": F.floor(F.col("x") / cell), "gy": F.floor(F.col("y") / cell)}).join(laid, ["gx", "gy"])
    tall = F.col("y2") - F.col("y1")
    length = wide * wide + tall * tall
    along = ((F.col("x") - F.col("x1")) * wide + (F.col("y") - F.col("y1")) * tall) / F.nullif(length, F.lit(0.0))
    t = F.least(F.greatest(F.coalesce(along, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    away = F.hypot(F.col("x") - F.col("x1") - t * wide, F.col("y") - F.col("y1") - t * tall)
    best = met.select("click", F.struct(away.alias("distance"), "edge").alias("hit")).filter(F.col("hit.distance") < reach)
    return best.groupBy("click").agg(F.min("hit").alias("hit")).select("click", "hit.edge", "hit.distance")
