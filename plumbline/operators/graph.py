"""Graphs over curves: components, dangling ends, dangling chains."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.joins import large, snap
from plumbline.sources.staging import Workspace


#: Edges, or lines, that one task takes at the end of rounds: 16 bytes an edge, 40 a line, whatever the input's size.
ONE_TASK = 2_000_000


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the least node of the component of each) of edges."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    p, q = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(p):
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (root[root] != root).any():
            root = root[root]
        p, q = root[p], root[q]
        p, q = p[p != q], q[p != q]
    return nodes, nodes[root]


def _columns(batches: Iterator[pa.RecordBatch], *names: str) -> list[np.ndarray]:
    held = [[batch.column(c).to_numpy(zero_copy_only=False) for c in names] for batch in batches]
    return [np.concatenate([h[k] for h in held]) if held else np.empty(0, np.int64) for k in range(len(names))]


def _merged_at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    nodes, into = _roots(*_columns(batches, "a", "b"))
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(into)], names=["id", "into"])


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) of nodes (id) under edges (a, b); the component is its least id.

    Each round merges every node into the one of least rank among itself and its
    neighbours, by ranks that are drawn anew.  That leaves a fixed share of the nodes
    at most, whatever the graph looks like, and the edges between them: stars
    and long chains too shrink in logarithmically many rounds.  The last
    ``ONE_TASK`` edges are merged by one task.  Ids that are no longs are numbered first.
    """
    work = Workspace(nodes.sparkSession, "components")
    if nodes.schema["id"].dataType.typeName() != "long":
        return _numbered_components(nodes, edges, work)
    left = work.stage(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    now = nodes.select("id", F.col("id").alias("least")).distinct()
    rounds: list[DataFrame] = []  # (id, least, into): what each node stands for and was merged into
    while size := left.count():
        if size <= ONE_TASK:
            into = left.coalesce(1).mapInArrow(_merged_at_once, "id long, into long")
            merged = work.stage(now.join(large(into), "id", "left"), "merged")
            nxt = left.limit(0)
        else:
            merged, nxt = _round(left, now, len(rounds), work)
            work.drop(left)
        left, now = nxt, merged.where("into IS NOT NULL").groupBy(F.col("into").alias("id")).agg(F.min("least").alias("least"))
        rounds.append(merged)
    out = now.select("id", F.col("least").alias("component"))
    for merged in reversed(rounds):
        later = out.select(F.col("id").alias("into"), "component")
        out = merged.join(large(later), "into", "left").select("id", F.coalesce("component", "least").alias("component"))
    out = work.stage(out, "components")
    work.drop(*rounds)
    return out


def _round(left: DataFrame, now: DataFrame, seed: int, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """(what each node was merged into, the edges that are left)."""
    rank = lambda c: F.xxhash64(c, F.lit(seed))
    around = left.select(F.inline(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))))
    best = around.groupBy("u").agg(F.min_by("v", rank("v")).alias("v"))
    into = best.select(F.col("u").alias("id"), F.when(rank("v") < rank("u"), F.col("v")).otherwise(F.col("u")).alias("into"))
    merged = work.stage(now.join(large(into), "id", "left"), "merged")
    to = lambda c: large(merged.where("into IS NOT NULL").select(F.col("id").alias(c), F.col("into").alias(f"to_{c}")))
    pairs = left.join(to("a"), "a").join(to("b"), "b").where("to_a <> to_b")
    return merged, work.stage(pairs.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "edges")


def _numbered_components(nodes: DataFrame, edges: DataFrame, work: Workspace) -> DataFrame:
    every = work.stage(nodes.select("id").distinct(), "nodes")
    every = work.stage(every.select("id", F.monotonically_increasing_id().alias("n")), "numbered")
    at = lambda c: large(every.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}")))
    pairs = edges.join(at("a"), "a").join(at("b"), "b").select(F.col("n_a").alias("a"), F.col("n_b").alias("b"))
    found = every.join(large(components(every.select(F.col("n").alias("id")), pairs).withColumnRenamed("id", "n")), "n")
    found = work.stage(found.select("id", F.col("component").alias("_c")), "found")
    return found.join(large(found.groupBy("_c").agg(F.min("id").alias("component"))), "_c").select("id", "component")


def ends(lines: DataFrame, tol: float) -> DataFrame:
    """Both ends of each line (id, x1, y1, x2, y2): id, end, x, y, the other end, and the snap key."""
    one = lambda e, a, b: F.struct(
        F.lit(e).alias("end"), F.col(f"x{a}").alias("x"), F.col(f"y{a}").alias("y"), F.col(f"x{b}").alias("ox"), F.col(f"y{b}").alias("oy")
    )
    out = lines.select("id", F.inline(F.array(one(0, 1, 2), one(1, 2, 1))))
    return out.select("*", snap(F.col("x"), tol).alias("kx"), snap(F.col("y"), tol).alias("ky"))


def dangling_ends(lines: DataFrame, tol: float = 5e-5) -> DataFrame:
    """Ends of lines with two distinct ends at which no other curve ends."""
    every = ends(lines, tol)
    alone = every.groupBy("kx", "ky").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo = hi").select("kx", "ky")
    return every.where("x <> ox OR y <> oy").join(large(alone), ["kx", "ky"], "left_semi").select("id", "end", "x", "y", "ox", "oy")


def _peel(left: DataFrame, tol: float, work: Workspace) -> tuple[DataFrame | None, DataFrame]:
    """(dangling paths or none, the rest) of lines."""
    at = ends(left, tol).select("id", "kx", "ky")
    nodes = at.groupBy("kx", "ky").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("a"), F.max("id").alias("b"))
    nodes = work.stage(nodes.where("n <= 2"), "nodes")
    lone = nodes.where("n = 1").select(F.col("a").alias("id"))
    if lone.isEmpty():
        return None, left
    paths = components(left.select("id"), nodes.where("n = 2 AND a <> b").select("a", "b"))
    loose = paths.join(paths.join(lone, "id").select("component").distinct(), "component", "left_semi").select("id")
    loose = work.stage(loose, "loose")
    return work.stage(left.join(loose, "id", "left_semi"), "off"), work.stage(left.join(loose, "id", "left_anti"), "left")


def _pruned_at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ids of lines (id, their nodes ax, ay, bx, by) left when all dangling chains are gone.

    A node holds its degree and the XOR of its lines, so a node of degree one names its line.
    """
    ids, ax, ay, bx, by = _columns(batches, "id", "ax", "ay", "bx", "by")
    places = np.stack([np.concatenate([ax, bx]), np.concatenate([ay, by])], axis=1)
    order = np.lexsort((places[:, 1], places[:, 0]))
    new = np.ones(len(order), bool)
    new[1:] = (places[order[1:]] != places[order[:-1]]).any(axis=1)
    at = np.empty(len(order), np.int64)
    at[order] = np.cumsum(new) - 1
    a, b = at[: len(ids)], at[len(ids) :]
    degree = np.bincount(at, minlength=1)
    held = np.zeros(len(degree), np.int64)
    np.bitwise_xor.at(held, a, np.arange(len(ids)))
    np.bitwise_xor.at(held, b, np.arange(len(ids)))
    kept = np.ones(len(ids), bool)
    tips = np.flatnonzero(degree == 1)
    while len(tips):
        off = np.unique(held[tips])
        kept[off] = False
        for end in (a[off], b[off]):
            np.subtract.at(degree, end, 1)
            np.bitwise_xor.at(held, end, off)
        tips = np.unique(np.concatenate([a[off], b[off]]))
        tips = tips[degree[tips] == 1]
    yield pa.RecordBatch.from_arrays([pa.array(ids[kept])], names=["id"])


def core(lines: DataFrame, tol: float = 5e-5) -> DataFrame:
    """The lines (id, long, and more) left when all dangling chains are gone.

    A round takes off all lines with a dangling end; if they were few, the next
    takes off whole dangling paths.  ``ONE_TASK`` lines are left to one task.
    """
    work = Workspace(lines.sparkSession, "core")
    left = work.stage(lines.where("x1 <> x2 OR y1 <> y2"), "left")
    size, whole = left.count(), False
    while size > ONE_TASK:
        if whole:
            off, nxt = _peel(left, tol, work)
            if off is None:
                return left
        else:
            at = ends(left, tol).groupBy("kx", "ky").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).where("n = 1")
            nxt = work.stage(left.join(large(at.select("id").distinct()), "id", "left_anti"), "left")
        now = nxt.count()
        if nxt is not left:
            work.drop(left)
        left, size, whole = nxt, now, now > 0.9 * size
    key = lambda x: snap(F.col(x), tol)
    nodes = left.select("id", key("x1").alias("ax"), key("y1").alias("ay"), key("x2").alias("bx"), key("y2").alias("by"))
    kept = nodes.coalesce(1).mapInArrow(_pruned_at_once, "id long")
    out = work.stage(left.join(large(kept), "id", "left_semi"), "core")
    work.drop(left)
    return out


def meetings(segs: DataFrame, cell: float = 8.0) -> DataFrame:
    """(a_id, b_id, x, y): points that lines share, a_id < b_id; staged, for cuts and components both read them."""
    from plumbline.operators.joins import box_join, hits, with_box

    boxed = with_box(segs.select("id", "x1", "y1", "x2", "y2"), grow=1e-6)
    met = box_join(boxed, boxed, cell, F.col("a_id") < F.col("b_id")).withColumn("p", F.explode(hits()))
    met = met.select("a_id", "b_id", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))
    return Workspace(segs.sparkSession, "meetings").stage(met, "met")


def noded(segs: DataFrame, cell: float = 8.0, met: DataFrame | None = None) -> DataFrame:
    """(id, source, x1, y1, x2, y2): distinct undirected pieces of lines cut wherever they meet; ids are numbers of no meaning.

    ``met`` holds the ``meetings`` of the lines if they are known already.
    """
    from plumbline.operators import checks

    work = Workspace(segs.sparkSession, "noded")
    found = meetings(segs, cell) if met is None else met
    cuts = found.select(F.explode(F.array("a_id", "b_id")).alias("id"), "x", "y").distinct()
    c = F.col
    x, y = (lambda k: F.round(f"x{k}", 6)), (lambda k: F.round(f"y{k}", 6))
    turned = (x(1) > x(2)) | ((x(1) == x(2)) & (y(1) > y(2)))
    one = lambda f, k, o: F.when(turned, f(o)).otherwise(f(k)).alias(f"{'x' if f is x else 'y'}{k}")
    pieces = checks.split_lines(segs, cuts).select("id", one(x, 1, 2), one(y, 1, 2), one(x, 2, 1), one(y, 2, 1))
    once = pieces.where("x1 <> x2 OR y1 <> y2").groupBy("x1", "y1", "x2", "y2").agg(F.min("id").alias("source"))
    once = work.stage(once, "pieces")
    out = work.stage(once.select(F.monotonically_increasing_id().alias("id"), "source", c("x1"), c("y1"), c("x2"), c("y2")), "noded")
    work.drop(once, *([found] if met is None else []))
    return out


def _core_faces(segs: DataFrame, cell: float, met: DataFrame | None = None) -> DataFrame:
    """Faces of lines without their dangling ends; each staged table goes when the next has been written."""
    work = Workspace(segs.sparkSession, "core")
    pieces = noded(segs, cell, met)
    kept = core(pieces)
    work.drop(pieces)
    out = faces(kept)
    work.drop(kept)
    return out


def faces(pieces: DataFrame, by: tuple[str, ...] = ("source",), apart: tuple[str, ...] = ()) -> DataFrame:
    """(edge, forward, by, x, y, tx, ty, face): the directed edges of noded pieces (id: long) with the cycle that lies to their left.

    At the end of an edge the next one is the first to its right, found by a
    window over the edges that leave that node; cycles are the components of that
    relation.  A cycle is named by its least directed edge, 2 id + forward.  Pieces
    that differ in the columns ``apart``, some of ``by``, have no node in common.
    """
    work = Workspace(pieces.sparkSession, "faces")
    c = F.col
    way = lambda f, a, b: F.struct(F.lit(f).alias("forward"), c(f"x{a}").alias("x"), c(f"y{a}").alias("y"), c(f"x{b}").alias("tx"), c(f"y{b}").alias("ty"))
    both = pieces.select(c("id").alias("edge"), *by, F.inline(F.array(way(True, 1, 2), way(False, 2, 1))))
    named = lambda forward: c("edge") * 2 + forward.cast("long")
    both = work.stage(both.withColumns({"angle": F.atan2(c("ty") - c("y"), c("tx") - c("x")), "me": named(c("forward"))}), "directed")
    around = Window.partitionBy(*apart, "x", "y").orderBy("angle")
    whole = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    steps = both.select(named(~c("forward")).alias("a"), F.coalesce(F.lag("me").over(around), F.last("me").over(whole)).alias("b"))
    cycles = components(both.select(c("me").alias("id")), steps)
    return both.drop("angle").join(large(cycles.select(c("id").alias("me"), c("component").alias("face"))), "me").drop("me")


def bounded_faces(segs: DataFrame, cell: float = 8.0, met: DataFrame | None = None) -> DataFrame:
    """(face, source, area, n_vertices) of the bounded faces of lines, dangling ends left out; source is the least line of a face."""
    f = _core_faces(segs, cell, met)
    size = F.sum(F.col("x") * F.col("ty") - F.col("tx") * F.col("y")) / 2
    out = f.groupBy("face").agg(F.round(size, 6).alias("area"), F.count(F.lit(1)).cast("int").alias("n_vertices"), F.min("source").alias("source"))
    return out.where("area > 0").select("face", "source", "area", "n_vertices")


def in_loops(segs: DataFrame, cell: float = 8.0) -> DataFrame:
    """(id) of lines with a piece in some loop: one that has different cycles on its two sides."""
    f = _core_faces(segs, cell)
    sides = f.groupBy("edge").agg(F.min("face").alias("l"), F.max("face").alias("r"), F.min("source").alias("id"))
    return sides.where("l <> r").select("id").distinct()


def snap_clusters(lines: DataFrame, tol: float = 2.0) -> DataFrame:
    """(id, end, cluster, x, y): dangling ends within tol of others, and the middle of their cluster's box.

    The cluster is its least end, as 2 id + end.
    """
    from plumbline.operators.joins import radius_pairs

    work = Workspace(lines.sparkSession, "snap")
    tips = work.stage(dangling_ends(lines).select((F.col("id") * 2 + F.col("end")).alias("pid"), "id", "end", "x", "y"), "tips")
    pairs = radius_pairs(tips.select(F.col("pid").alias("id"), "x", "y"), tol).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    pairs = work.stage(pairs, "pairs")
    nodes = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    named = work.stage(tips.join(large(components(nodes, pairs).select(F.col("id").alias("pid"), F.col("component").alias("cluster"))), "pid"), "named")
    middle = lambda c: F.round((F.min(c) + F.max(c)) / 2, 6).alias(c)
    return named.select("id", "end", "cluster").join(large(named.groupBy("cluster").agg(middle("x"), middle("y"))), "cluster").select("id", "end", "cluster", "x", "y")


def dangling_chains(lines: DataFrame, most: float, tol: float = 5e-5) -> DataFrame:
    """(id, chain, chain_length) of curves peeled from degree-one nodes, chains of length ``most`` or less.

    Each round removes whole paths: curves joined at nodes of degree two, of which
    one node has degree one.  So a path of any length takes one round, and a tree
    as many as the logarithm of its size; what is left are loops and the curves
    between them.
    """
    work = Workspace(lines.sparkSession, "chains")
    left = work.stage(lines.where("x1 <> x2 OR y1 <> y2").select("id", "x1", "y1", "x2", "y2"), "left")
    peeled = None
    while True:
        off, left = _peel(left, tol, work)
        if off is None:
            break
        peeled = off if peeled is None else peeled.union(off)
    if peeled is None:
        return lines.select("id", F.col("id").alias("chain"), F.lit(0.0).alias("chain_length")).limit(0)
    at = ends(peeled, tol)
    hub = at.groupBy("kx", "ky").agg(F.min("id").alias("a"))
    edges = at.join(hub, ["kx", "ky"]).where("a <> id").select("a", F.col("id").alias("b"))
    comp = components(peeled.select("id"), edges)
    size = F.sqrt(F.pow(F.col("x2") - F.col("x1"), 2) + F.pow(F.col("y2") - F.col("y1"), 2))
    with_length = peeled.select("id", size.alias("len")).join(comp, "id")
    total = with_length.groupBy("component").agg(F.round(F.sum("len"), 6).alias("chain_length")).where(F.col("chain_length") <= most)
    return with_length.join(total, "component").select("id", F.col("component").alias("chain"), "chain_length")


def _ahead(px, py, dx, dy, ax, ay, bx, by):
    """Parameter along the ray p + t d at which it meets the carrier of a-b, and the position on a-b; null if parallel."""
    den = dx * (by - ay) - dy * (bx - ax)
    t = F.when(den != 0, ((ax - px) * (by - ay) - (ay - py) * (bx - ax)) / den)
    u = F.when(den != 0, ((ax - px) * dy - (ay - py) * dx) / den)
    return t, u


def undershoots(lines: DataFrame, reach: float = 2.0, cell: float = 8.0) -> DataFrame:
    """(id, end, target, x, y, dist): per dangling end the nearest line that it would meet within reach, ahead."""
    from plumbline.operators.joins import box_join, with_box

    tips = dangling_ends(lines).select(
        "*", (F.col("x") - reach).alias("minx"), (F.col("y") - reach).alias("miny"), (F.col("x") + reach).alias("maxx"), (F.col("y") + reach).alias("maxy")
    )
    pairs = box_join(tips, with_box(lines.select("id", "x1", "y1", "x2", "y2")), cell, F.col("a_id") != F.col("b_id"))
    c = F.col
    dx, dy = c("a_x") - c("a_ox"), c("a_y") - c("a_oy")
    t, u = _ahead(c("a_x"), c("a_y"), dx, dy, c("b_x1"), c("b_y1"), c("b_x2"), c("b_y2"))
    dist = t * F.sqrt(dx * dx + dy * dy)
    best = F.min_by(
        F.struct(c("b_id").alias("target"), F.round(c("a_x") + c("t") * dx, 6).alias("x"), F.round(c("a_y") + c("t") * dy, 6).alias("y"), c("dist")),
        F.struct("dist", "b_id"),
    )
    return (
        pairs.withColumns({"t": t, "u": u, "dist": F.round(dist, 6)})
        .where((c("t") > 0) & (c("dist") <= reach) & c("u").between(0, 1))
        .groupBy(c("a_id").alias("id"), c("a_end").alias("end"))
        .agg(best.alias("b"))
        .select("id", "end", "b.*")
    )


def apparent_intersections(lines: DataFrame, reach: float = 2.0) -> DataFrame:
    """(a_id, a_end, b_id, b_end, x, y): dangling ends whose carriers meet ahead of both within reach."""
    return _apparent(lines, reach).select("a_id", "a_end", "b_id", "b_end", "x", "y")


def _apparent(lines: DataFrame, reach: float) -> DataFrame:
    """Apparent intersections with the ends a_x, a_y and b_x, b_y that they lie ahead of.

    The stretches of reach ahead of ends meet on a grid, with all that tells whether
    they cross, so pairs of ends that are merely near go through no shuffle.
    """
    work = Workspace(lines.sparkSession, "apparent")
    tips = work.stage(dangling_ends(lines), "tips")
    c = F.col
    slack = 1e-6  # distances are compared after rounding

    def box(s: str, axis: str) -> tuple[Column, Column]:
        p, dx, dy = c(f"{s}{axis}"), c(f"{s}x") - c(f"{s}ox"), c(f"{s}y") - c(f"{s}oy")
        q = p + (p - c(f"{s}o{axis}")) / F.sqrt(dx * dx + dy * dy) * (reach + slack)
        return F.least(p, q) - slack, F.greatest(p, q) + slack

    at = lambda x: F.floor(x / reach)
    cells = [F.sequence(*[at(x) for x in box("", axis)]) for axis in "xy"]
    placed = tips.withColumn("cx", F.explode(cells[0])).withColumn("cy", F.explode(cells[1]))
    side = lambda s: placed.select("cx", "cy", *[c(x).alias(f"{s}_{x}") for x in ("id", "end", "x", "y", "ox", "oy")])
    # of the cells that two stretches share, the pair is kept in that of the lower left corner of their common box
    own = [at(F.greatest(box("a_", axis)[0], box("b_", axis)[0])) == c(f"c{axis}") for axis in "xy"]
    d2 = F.pow(c("a_x") - c("b_x"), 2) + F.pow(c("a_y") - c("b_y"), 2)
    both = side("a").join(large(side("b")), ["cx", "cy"]).where((c("a_id") < c("b_id")) & (d2 <= 4 * reach * reach) & own[0] & own[1])
    adx, ady, bdx, bdy = c("a_x") - c("a_ox"), c("a_y") - c("a_oy"), c("b_x") - c("b_ox"), c("b_y") - c("b_oy")
    t, _ = _ahead(c("a_x"), c("a_y"), adx, ady, c("b_ox"), c("b_oy"), c("b_x"), c("b_y"))
    s, _ = _ahead(c("b_x"), c("b_y"), bdx, bdy, c("a_ox"), c("a_oy"), c("a_x"), c("a_y"))
    ahead = lambda k, dx, dy: (k > 0) & (F.round(k * F.sqrt(dx * dx + dy * dy), 6) <= reach)
    return both.where(ahead(t, adx, ady) & ahead(s, bdx, bdy)).select(
        "a_id", "a_end", "b_id", "b_end", F.round(c("a_x") + t * adx, 6).alias("x"), F.round(c("a_y") + t * ady, 6).alias("y"),
        "a_x", "a_y", "b_x", "b_y",
    )
