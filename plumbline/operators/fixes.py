"""Fixes of checks that look at pairs of entities: lines and rings in, lines and rings out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import geometry as g
from plumbline.functions import tiles as tiles_of
from plumbline.operators import checks, graph, joins
from plumbline.sources.staging import Workspace


def break_until_clean(lines: DataFrame, cell: float = 8.0) -> DataFrame:
    """(id, piece, x1, y1, x2, y2): lines cut where others cross them, again until no crossing is left or their number stays.

    ``id`` is the line that a piece was cut from; pieces are in order along it.
    """
    work = Workspace(lines.sparkSession, "break")
    number = lambda cut: work.stage(cut.withColumn("id", F.monotonically_increasing_id()), "lines")
    now = number(lines.select(F.col("id").alias("source"), "x1", "y1", "x2", "y2"))
    before = None
    while True:
        met = work.stage(joins.crossings(now, cell), "met")
        count = met.count()
        if not count or count == before:
            work.drop(met)
            break
        before = count
        cuts = met.select(F.explode(F.array("a_id", "b_id")).alias("id"), "x", "y")
        pieces = checks.split_lines(now, cuts).select("id", "x1", "y1", "x2", "y2")
        sources = now.select(F.col("id"), "source")
        cut = number(pieces.join(joins.large(sources), "id").select("source", "x1", "y1", "x2", "y2"))
        work.drop(met, now)
        now = cut
    own = lines.select("id", F.col("x1").alias("ox"), F.col("y1").alias("oy"))
    far = F.pow(F.col("x1") - F.col("ox"), 2) + F.pow(F.col("y1") - F.col("oy"), 2)
    pieces = now.select(F.col("source").alias("id"), "x1", "y1", "x2", "y2").join(own, "id")
    by = pieces.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(far.alias("d"), "x1", "y1", "x2", "y2"))).alias("ps"))
    return by.select("id", F.posexplode("ps").alias("piece", "p")).select("id", "piece", "p.x1", "p.y1", "p.x2", "p.y2")


#: Lines of a tile, on average, when lines are short; rounds that a tile goes through with what lies around it.
TILE_LINES, TILE_ROUNDS = 30_000, 3


def pieces_when_clean(lines: DataFrame, cell: float = 8.0) -> DataFrame:
    """(id, n_pieces): pieces of each line that ``break_until_clean`` leaves.

    A tile has the lines that begin in it and all within as many lengths of the
    longest as there are rounds, so the former are cut there as they would be among
    all; neither crossings nor pieces are written.  Lines as long as the drawing, or
    more rounds, take the way of ``break_until_clean``.
    """
    work = Workspace(lines.sparkSession, "tiles")
    c = F.col
    somewhere = F.coalesce(F.abs(c("x1") + c("y1") + c("x2") + c("y2")) < float("inf"), F.lit(False))
    every, nowhere, lines = lines, lines.where(~somewhere & c("id").isNotNull()), lines.where(somewhere)  # the former meets nothing
    low, high = (lambda k: F.least(f"{k}1", f"{k}2")), (lambda k: F.greatest(f"{k}1", f"{k}2"))
    size = F.greatest(high("x") - low("x"), high("y") - low("y"))
    n, x0, y0, x1, y1, long = lines.agg(
        F.count(F.lit(1)), F.min(low("x")), F.min(low("y")), F.max(high("x")), F.max(high("y")), F.max(size)
    ).first()
    whole = lambda: break_until_clean(every, cell).groupBy("id").agg(F.count(F.lit(1)).alias("n_pieces"))
    if not n:
        return whole()
    long += 1e-3
    area = (x1 - x0 + long) * (y1 - y0 + long)
    side = max((area * TILE_LINES / n) ** 0.5, 8 * long)
    if n * min(area, (side + 2 * TILE_ROUNDS * long) ** 2) / area > 20 * TILE_LINES:
        return whole()
    at = lambda x: F.floor(x / side)
    tiles = [F.sequence(at(low(k) - TILE_ROUNDS * long), at(high(k) + TILE_ROUNDS * long)) for k in "xy"]
    spread = lines.select("id", "x1", "y1", "x2", "y2", at(low("x")).alias("ox"), at(low("y")).alias("oy"), tiles[1].alias("ys"), F.explode(tiles[0]).alias("tx"))
    spread = spread.withColumn("ty", F.explode("ys")).select("tx", "ty", ((c("tx") == c("ox")) & (c("ty") == c("oy"))).alias("owned"), "id", "x1", "y1", "x2", "y2")
    kinds = "id long, owned boolean, " + ", ".join(f"n{k} long" for k in range(TILE_ROUNDS))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        owned = table.column("owned").to_numpy()
        if not owned.any():
            return pa.table({f: pa.array([], t) for f, t in fields})
        met, pieces = tiles_of.rounds(tuple(table.column(k).to_numpy() for k in ("x1", "y1", "x2", "y2")), owned, TILE_ROUNDS)
        ids = np.append(table.column("id").to_numpy()[owned], 0)
        rows = [ids, np.append(np.ones(owned.sum(), bool), False), *[np.append(p[owned], m) for p, m in zip(pieces, met, strict=True)]]
        return pa.table({f: pa.array(r, t) for (f, t), r in zip(fields, rows, strict=True)})

    fields = [("id", pa.int64()), ("owned", pa.bool_()), *[(f"n{k}", pa.int64()) for k in range(TILE_ROUNDS)]]
    found = work.stage(spread.groupBy("tx", "ty").applyInArrow(run, kinds), "found")
    met = found.where("NOT owned").agg(*[F.coalesce(F.sum(f"n{k}"), F.lit(0)) for k in range(TILE_ROUNDS)]).first()
    for k in range(TILE_ROUNDS):
        if not met[k] or (k and met[k] == met[k - 1]):
            return found.where("owned").union(nowhere.select("id", F.lit(True), *[F.lit(1)] * TILE_ROUNDS)).groupBy("id").agg(F.sum(f"n{k}").alias("n_pieces"))
    return whole()


def extend_undershoots(lines: DataFrame, reach: float = 2.0, cell: float = 8.0) -> DataFrame:
    """(id, piece, x1, y1, x2, y2): dangling ends moved onto the line they nearly meet, which is split there."""
    work = Workspace(lines.sparkSession, "undershoots")
    found = work.stage(graph.undershoots(lines, reach, cell), "found")
    moved = checks.extend_lines(lines, found)
    return checks.split_lines(moved, found.select(F.col("target").alias("id"), "x", "y").distinct())


def apparent_ends(lines: DataFrame, reach: float = 2.0) -> DataFrame:
    """(id, end, x, y): where each end of apparent intersections goes: to the nearest, then to that of the least line; staged."""
    found = graph._apparent(lines, reach)
    far = lambda s: F.round(F.pow(F.col("x") - F.col(f"{s}_x"), 2) + F.pow(F.col("y") - F.col(f"{s}_y"), 2), 6)
    one = lambda s, o: F.struct(
        F.col(f"{s}_id").alias("id"), F.col(f"{s}_end").alias("end"), F.struct(far(s).alias("far"), F.col(f"{o}_id").alias("other"), "x", "y").alias("p")
    )
    each = found.select(F.inline(F.array(one("a", "b"), one("b", "a"))))
    best = each.groupBy("id", "end").agg(F.min("p").alias("p")).select("id", "end", "p.x", "p.y")
    return Workspace(lines.sparkSession, "apparent").stage(best, "best")


def meet_apparent(lines: DataFrame, reach: float = 2.0, best: DataFrame | None = None) -> DataFrame:
    """Both ends of each apparent intersection moved to it; an end that has several takes the nearest, then the least.

    ``best`` holds the ``apparent_ends`` if they are known already.
    """
    return checks.extend_lines(lines, apparent_ends(lines, reach) if best is None else best)


def insert_vertices(rings: DataFrame, points: DataFrame) -> DataFrame:
    """Rings with points (id, x, y) of their border made vertices, each on the first edge that it lies on."""
    by = points.groupBy("id").agg(F.collect_set(F.struct("x", "y")).alias("_ps"))
    v = F.col("vertices")
    none = F.array().cast("array<struct<x:double,y:double>>")

    def edge(i):
        a, b = F.get(v, i), g._next(v, i)
        size = F.pow(b["x"] - a["x"], 2) + F.pow(b["y"] - a["y"], 2)
        place = lambda p: ((p["x"] - a["x"]) * (b["x"] - a["x"]) + (p["y"] - a["y"]) * (b["y"] - a["y"])) / F.when(size > 0, size)
        off = lambda p: F.abs(g.cross(a["x"], a["y"], b["x"], b["y"], p["x"], p["y"]))
        on = F.filter("_held", lambda p: (off(p) <= 1e-6 * F.sqrt(size)) & (place(p) > 0) & (place(p) < 1))
        vertex = lambda t: F.struct(t["p"]["x"].alias("x"), t["p"]["y"].alias("y"), F.lit(0.0).alias("bulge"))
        return F.concat(F.array(a), F.transform(F.array_sort(F.transform(on, lambda p: F.struct(place(p).alias("t"), p.alias("p")))), vertex))

    held = rings.join(by, "id", "left").withColumn("_held", F.coalesce("_ps", none))
    return held.withColumn("vertices", F.flatten(F.transform(g._steps(v, True), edge))).select(*rings.columns)


def move_to_anchors(points: DataFrame, tol: float = 0.005) -> DataFrame:
    """Points (id, x, y) near others moved to the place of their anchor."""
    anchors = checks.near_vertices(points, tol)
    places = points.select(F.col("id").alias("anchor"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    moved = anchors.join(places, "anchor").select("id", "_x", "_y")
    return points.join(moved, "id", "left").select("id", F.coalesce("_x", "x").alias("x"), F.coalesce("_y", "y").alias("y"))
