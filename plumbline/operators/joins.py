"""Spatial joins as equi-joins on grid cells.

A box goes to the grid whose cell is no smaller than the box, so it covers at
most four cells however long it is.  It is also copied up to every coarser grid
that the other side has boxes of.  Two boxes meet on the coarser of their grids:
own with own, or own with a copy from below, never copy with copy, so one large
box costs as many rows as there are small ones, not their square.  The pair is
kept in the one cell that owns the lower left corner of the intersection: each
comes once, without ``distinct``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.sources.staging import Workspace

BOX = ("minx", "miny", "maxx", "maxy")


def large(table: DataFrame) -> DataFrame:
    """``table`` as a side of joins that sort: its size on disk, by which Spark would broadcast it, says little of its rows once they are exploded."""
    return table.hint("merge")


def with_box(segs: DataFrame, grow: float = 0.0) -> DataFrame:
    """Adds the box of x1, y1, x2, y2."""
    return segs.select(
        "*",
        (F.least("x1", "x2") - grow).alias("minx"),
        (F.least("y1", "y2") - grow).alias("miny"),
        (F.greatest("x1", "x2") + grow).alias("maxx"),
        (F.greatest("y1", "y2") + grow).alias("maxy"),
    )


def _level(cell: float) -> Column:
    size = F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny"), F.lit(cell))
    return F.ceil(F.log2(size / cell)).cast("int")


def _levels(table: DataFrame, cell: float) -> list[int]:
    """The grids that occur: at most one per doubling of size."""
    return sorted(r[0] for r in table.select(_level(cell).alias("g")).distinct().collect() if r[0] is not None)


#: How a row takes part in a cell: with its own grid on both sides, or as the coarse or the copied side.
_LEVEL, _COARSE, _COPIED = 0, 1, 2


def _celled(table: DataFrame, tag: str, cell: float, others: list[int], by: tuple[str, ...]) -> DataFrame:
    """``table`` by grid cell and part; the parts of side b are turned over, so that coarse meets copied."""
    coarse, copied = (_COARSE, _COPIED) if tag == "a" else (_COPIED, _COARSE)
    g = F.col("_g")
    place = lambda level, part: F.struct(level.cast("int").alias("g"), F.lit(part).alias("part"))
    places = [F.array(place(g, _LEVEL))]
    if others:
        nowhere = F.array().cast("array<struct<g:int,part:int>>")
        places.append(F.when(g > min(others), F.array(place(g, coarse))).otherwise(nowhere))
        above = F.filter(F.array(*[F.lit(x) for x in others]), lambda x: x > g)
        places.append(F.transform(above, lambda x: place(x, copied)))
    side = lambda lo, hi: F.sequence(
        F.floor(F.col(lo) / (cell * F.pow(F.lit(2.0), F.col("_p.g")))), F.floor(F.col(hi) / (cell * F.pow(F.lit(2.0), F.col("_p.g"))))
    )
    cells = F.flatten(
        F.transform(
            side("minx", "maxx"), lambda cx: F.transform(side("miny", "maxy"), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))
        )
    )
    placed = table.withColumn("_g", _level(cell)).where("_g IS NOT NULL").withColumn("_p", F.explode(F.concat(*places)))
    return placed.withColumn("_c", F.explode(cells)).select(
        F.col("_p.g").alias("_grid"), F.col("_p.part").alias("_part"), F.col("_c.cx").alias("_cx"), F.col("_c.cy").alias("_cy"),
        *[F.col(f"`{c}`").alias(f"_by{k}") for k, c in enumerate(by)],
        *[F.col(f"`{c}`").alias(f"{tag}_{c}") for c in table.columns],
    )


def box_join(a: DataFrame, b: DataFrame, cell: float, on: Column | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of rows whose boxes meet (borders included), columns prefixed ``a_`` and ``b_``, equal in the columns ``by``."""
    levels_a = _levels(a, cell)
    levels_b = levels_a if a is b else _levels(b, cell)
    size = cell * F.pow(F.lit(2.0), F.col("_grid"))
    owner = (F.floor(F.greatest("a_minx", "b_minx") / size) == F.col("_cx")) & (
        F.floor(F.greatest("a_miny", "b_miny") / size) == F.col("_cy")
    )
    meet = (
        (F.col("a_minx") <= F.col("b_maxx"))
        & (F.col("b_minx") <= F.col("a_maxx"))
        & (F.col("a_miny") <= F.col("b_maxy"))
        & (F.col("b_miny") <= F.col("a_maxy"))
    )
    keys = ["_grid", "_part", "_cx", "_cy", *[f"_by{k}" for k in range(len(by))]]
    pairs = _celled(a, "a", cell, levels_b, by).join(large(_celled(b, "b", cell, levels_a, by)), keys)
    out = pairs.where(owner & meet).drop(*keys)
    return out if on is None else out.where(on)


def spread_boxes(a: DataFrame, b: DataFrame, cell: float) -> DataFrame:
    """(a_id, b_id) of rows (id, box) whose boxes meet; equal boxes of ``a`` meet ``b`` once, and the pairs are spread over them."""
    work = Workspace(a.sparkSession, "boxes")
    once = work.stage(a.groupBy(*BOX).agg(F.min("id").alias("id")), "once")
    held = once.withColumnsRenamed({"id": "_once"} | {c: f"_{c}" for c in BOX})
    same = [F.col(c) == F.col(f"_{c}") for c in BOX]
    members = work.stage(a.join(large(held), same).select("_once", "id"), "members")
    found = box_join(once, b, cell).select(F.col("a_id").alias("_once"), "b_id")
    return found.join(large(members), "_once").select(F.col("id").alias("a_id"), "b_id")


def radius_pairs(points: DataFrame, r: float) -> DataFrame:
    """(a_id, b_id, d2) of points (id, x, y) at distance r or less, a_id < b_id, each once.

    Cells are r wide; each point looks into its own cell and four of the eight
    neighbours, so a pair meets in exactly one of them.
    """
    base = points.select("id", "x", "y", F.floor(F.col("x") / r).alias("cx"), F.floor(F.col("y") / r).alias("cy"))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (1, 0), (-1, 1), (0, 1), (1, 1))])
    b = base.select("*", F.inline(steps)).select(
        F.col("id").alias("q_id"), F.col("x").alias("qx"), F.col("y").alias("qy"), (F.col("cx") + F.col("i")).alias("cx"),
        (F.col("cy") + F.col("j")).alias("cy"), ((F.col("i") == 0) & (F.col("j") == 0)).alias("own"),
    )
    d2 = F.pow(F.col("x") - F.col("qx"), 2) + F.pow(F.col("y") - F.col("qy"), 2)
    once = F.when(F.col("own"), F.col("id") < F.col("q_id")).otherwise(F.col("id") != F.col("q_id"))
    return (
        base.join(large(b), ["cx", "cy"])
        .where((d2 <= r * r) & once)
        .select(F.least("id", "q_id").alias("a_id"), F.greatest("id", "q_id").alias("b_id"), d2.alias("d2"))
    )


def nearest(points: DataFrame, k: int, start: float, queries: DataFrame | None = None) -> DataFrame:
    """(id, n_id, d2, rank): the k nearest other points of each query point (all points if none are given), ties by id.

    The radius doubles for the points that have not found k yet, so dense regions
    are settled in the first rounds and never searched again.
    """
    box = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count(F.lit(1))).first()
    if not box[4]:
        return points.select("id", F.col("id").alias("n_id"), F.lit(0.0).alias("d2"), F.lit(0).alias("rank")).limit(0)
    span = max(box[1] - box[0], box[3] - box[2], start)
    left, r, out = points if queries is None else queries, start, None
    order = Window.partitionBy("id").orderBy("d2", "n_id")
    work = Workspace(points.sparkSession, "nearest")
    while True:
        near = [F.col(c) for c in ("x", "y")]
        a = left.select("id", *near, (near[0] - r / 2).alias("minx"), (near[1] - r / 2).alias("miny"), (near[0] + r / 2).alias("maxx"), (near[1] + r / 2).alias("maxy"))
        b = points.select("id", *near, (near[0] - r / 2).alias("minx"), (near[1] - r / 2).alias("miny"), (near[0] + r / 2).alias("maxx"), (near[1] + r / 2).alias("maxy"))
        d2 = F.pow(F.col("a_x") - F.col("b_x"), 2) + F.pow(F.col("a_y") - F.col("b_y"), 2)
        got = (
            box_join(a, b, r, F.col("a_id") != F.col("b_id"))
            .select(F.col("a_id").alias("id"), F.col("b_id").alias("n_id"), d2.alias("d2"))
            .where(F.col("d2") <= r * r)
            .withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= k)
        )
        got = work.stage(got, "near")  # later rounds read it; unstaged, each round would compute all before it twice
        full = got.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select("id")
        last = r > 1.5 * span
        part = got if last else got.join(full, "id", "left_semi")
        out = part if out is None else out.unionByName(part)
        if last:
            return out
        left, r = work.stage(left.join(full, "id", "left_anti"), "left"), r * 2
        if left.isEmpty():
            return out


def snap(x: Column, tol: float) -> Column:
    """Integer key of a coordinate: equal keys lie within one tolerance."""
    return F.floor(x / tol + 0.5)


def hits(tol: float = 1e-6) -> Column:
    """Points that segments a and b (columns a_x1 .. b_y2) share.

    A proper crossing gives one point.  An end within tol of the other segment
    gives that end, which covers touches and colinear overlaps.
    """
    c = F.col

    def side(p: str, q: str, px: str, py: str) -> Column:
        return (c(f"{p}_x2") - c(f"{p}_x1")) * (c(py) - c(f"{p}_y1")) - (c(px) - c(f"{p}_x1")) * (c(f"{p}_y2") - c(f"{p}_y1"))

    d1, d2 = side("b", "a", "a_x1", "a_y1"), side("b", "a", "a_x2", "a_y2")
    d3, d4 = side("a", "b", "b_x1", "b_y1"), side("a", "b", "b_x2", "b_y2")
    t = d1 / (d1 - d2)
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    none = F.lit(None).cast("struct<x:double,y:double>")
    proper = F.when(
        (d1 * d2 < 0) & (d3 * d4 < 0),
        point(c("a_x1") + t * (c("a_x2") - c("a_x1")), c("a_y1") + t * (c("a_y2") - c("a_y1"))),
    ).otherwise(none)

    def end(d: Column, s: str, e: str, k: int) -> Column:
        x, y = c(f"{e}_x{k}"), c(f"{e}_y{k}")
        len2 = F.pow(c(f"{s}_x2") - c(f"{s}_x1"), 2) + F.pow(c(f"{s}_y2") - c(f"{s}_y1"), 2)
        inside = x.between(F.least(f"{s}_x1", f"{s}_x2") - tol, F.greatest(f"{s}_x1", f"{s}_x2") + tol) & y.between(
            F.least(f"{s}_y1", f"{s}_y2") - tol, F.greatest(f"{s}_y1", f"{s}_y2") + tol
        )
        return F.when((d * d <= tol * tol * len2) & inside, point(x, y)).otherwise(none)

    found = F.array(proper, end(d1, "b", "a", 1), end(d2, "b", "a", 2), end(d3, "a", "b", 1), end(d4, "a", "b", 2))
    return F.array_distinct(F.filter(found, lambda p: p.isNotNull()))


def crossings(segs: DataFrame, cell: float = 8.0, tol: float = 1e-6) -> DataFrame:
    """(a_id, b_id, x, y) of points that segments (id, x1, y1, x2, y2) of different curves share, a_id < b_id.

    Points that are ends of both curves' segments are left out: there the curves join.
    """
    boxed = with_box(segs.select("id", "x1", "y1", "x2", "y2"), grow=tol)
    pairs = box_join(boxed, boxed, cell, F.col("a_id") < F.col("b_id"))
    at_end = lambda s: F.greatest(
        *[
            ((F.abs(F.col("p.x") - F.col(f"{s}_x{k}")) <= tol) & (F.abs(F.col("p.y") - F.col(f"{s}_y{k}")) <= tol)).cast("int")
            for k in (1, 2)
        ]
    )
    return (
        pairs.withColumn("p", F.explode(hits(tol)))
        .where((at_end("a") == 0) | (at_end("b") == 0))
        .select("a_id", "b_id", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))
        .distinct()
    )


def self_crossings(segs: DataFrame, cell: float = 8.0, tol: float = 1e-6) -> DataFrame:
    """(id, x, y) where segments of one curve meet other than at shared ends of neighbours."""
    cols = ["id", "seg", "x1", "y1", "x2", "y2"]
    last = segs.groupBy("id").agg(F.max("seg").alias("last"))
    boxed = with_box(segs.select(*cols).join(last, "id"), grow=tol)
    pairs = box_join(boxed, boxed, cell, (F.col("a_id") == F.col("b_id")) & (F.col("a_seg") < F.col("b_seg")))
    apart = F.col("b_seg") - F.col("a_seg")
    joint = (
        F.when(apart == 1, (F.abs(F.col("p.x") - F.col("a_x2")) <= tol) & (F.abs(F.col("p.y") - F.col("a_y2")) <= tol))
        .when(
            (F.col("a_seg") == 0) & (F.col("b_seg") == F.col("a_last")),
            (F.abs(F.col("p.x") - F.col("a_x1")) <= tol) & (F.abs(F.col("p.y") - F.col("a_y1")) <= tol),
        )
        .otherwise(False)
    )
    return (
        pairs.withColumn("p", F.explode(hits(tol)))
        .where(~joint)
        .select(F.col("a_id").alias("id"), F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))
        .distinct()
    )
