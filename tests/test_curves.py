"""Curves cut and merged, faces by joins, arcs, scopes, fixes, and joins beside one large box."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_geometry import SQUARE, entity, ids, lines, square, table

from plumbline.functions import arcs, units
from plumbline.functions import geometry as g
from plumbline.functions import kernels as k
from plumbline.operators import checks, curves, fixes, floorplan, graph, joins, polygons
from plumbline.sources import entities as scopes
from plumbline.sources import views
from plumbline.streaming import recheck


def test_a_title_frame_costs_rows_not_their_square(spark):
    rng = random.Random(1)
    short = [(x, y, x + rng.uniform(-2, 2), y + rng.uniform(-2, 2)) for x, y in ((rng.uniform(0, 400), rng.uniform(0, 400)) for _ in range(1500))]
    segs = lines(spark, *short, (-10, 200.5, 410, 200.5))
    boxed = joins.with_box(segs)
    levels = joins._levels(boxed, 8.0)
    a, b = joins._celled(boxed, "a", 8.0, levels, ()), joins._celled(boxed, "b", 8.0, levels, ())
    met = a.join(b, ["_grid", "_part", "_cx", "_cy"])
    coarse = met.where("_part > 0").count()
    assert coarse <= 6 * len(short)  # the copies of short boxes meet the frame, not each other
    got = {(r.a_id, r.b_id) for r in joins.crossings(segs).collect()}

    def cross(p, q):
        side = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (c[0] - a[0]) * (b[1] - a[1])
        a, b, c, d = p[:2], p[2:], q[:2], q[2:]
        return side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0

    every = [*short, (-10, 200.5, 410, 200.5)]
    assert got == {(i, j) for i in range(len(every)) for j in range(i + 1, len(every)) if cross(every[i], every[j])}


def test_faces_by_joins_equal_the_kernel(spark):
    rng = random.Random(3)
    rows = [tuple(rng.randint(0, 40) / 4 for _ in range(4)) for _ in range(45)] + [(1, 1, 1, 1)]
    found, _ = k.polygonize([((a, b), (c, d)) for a, b, c, d in rows if (a, b) != (c, d)])
    got = graph.bounded_faces(lines(spark, *rows)).collect()
    real = lambda areas: sorted(a for a in areas if a > 0.01)  # noqa: E731  crossings are rounded, so slivers differ
    assert real(r.area for r in got) == pytest.approx(real(k.area(f[0]) for f in found), abs=1e-4)
    bridge = [(0, 0, 2, 0), (2, 0, 1, 2), (1, 2, 0, 0), (2, 0, 5, 0), (5, 0, 7, 0), (7, 0, 6, 2), (6, 2, 5, 0), (7, 0, 9, 0)]
    assert ids(graph.in_loops(lines(spark, *bridge))) == [0, 1, 2, 4, 5, 6]


def test_chains_of_a_long_path_take_few_rounds(spark):
    path = [(i, 0, i + 1, 0) for i in range(120)] + [(300, 0, 302, 0), (302, 0, 301, 2), (301, 2, 300, 0), (302, 0, 310, 0)]
    got = {r.id: r.chain_length for r in graph.dangling_chains(lines(spark, *path), 200.0).collect()}
    assert got == {i: 120.0 for i in range(120)} | {123: 8.0}


def test_split_curves(spark):
    zig = table(spark, entity(1, [(0, 0), (4, 0), (4, 4)]), entity(2, SQUARE, True), entity(3, [(0, 0), (2, 0), (2, 2), (1, 2), (1, -1)]), entity(4, [(9, 9)]))
    points = spark.createDataFrame([(1, 1.0, 0.0), (1, 4.0, 0.0), (1, 0.0, 0.0), (2, 0.5, 0.0), (2, 1.0, 0.5), (3, 1.0, 0.0)], "id long, x double, y double")
    out = {}
    for r in curves.split_curves(zig, points).collect():
        out.setdefault(r.id, {})[r.piece] = [(v.x, v.y) for v in r.vertices]
    assert out[1] == {0: [(0, 0), (1, 0)], 1: [(1, 0), (4, 0)], 2: [(4, 0), (4, 4)]}
    assert out[2] == {0: [(0.5, 0), (1, 0), (1, 0.5)], 1: [(1, 0.5), (1, 1), (0, 1), (0, 0), (0.5, 0)]}
    assert out[3] == {0: [(0, 0), (1, 0)], 1: [(1, 0), (2, 0), (2, 2), (1, 2), (1, 0)], 2: [(1, 0), (1, -1)]} and 4 not in out
    again = curves.split_self_crossings(zig.where("id = 3")).collect()
    assert len(again) == 3 and sum(1 for _ in again) == 3
    crossed = table(spark, entity(1, [(0, 0), (4, 0), (4, 4)]), entity(2, [(2, -1), (2, 1), (5, 1)]))
    assert Counter(r.id for r in curves.break_crossings(crossed).collect()) == {1: 3, 2: 3}


def test_extend_and_merge(spark):
    e = table(spark, entity(1, [(0, 0), (1, 0), (2, 1)]), entity(2, SQUARE, True))
    found = spark.createDataFrame([(1, 0, -1.0, 0.0), (1, 1, 3.0, 2.0), (2, 0, 9.0, 9.0)], "id long, end int, x double, y double")
    got = {r.id: [(v.x, v.y) for v in r.vertices] for r in curves.extend_curves(e, found).collect()}
    assert got[1] == [(-1, 0), (1, 0), (3, 2)] and got[2] == [tuple(map(float, p)) for p in SQUARE]
    parts = table(
        spark, entity(1, [(1, 0), (0, 0)]), entity(2, [(1, 0), (2, 0), (2, 1)]), entity(3, [(5, 5), (2, 1)]),
        entity(4, [(9, 0), (10, 0)]), entity(5, [(10, 0), (10, 1), (9, 0)]), entity(6, [(5, 5), (6, 6)]), entity(7, [(5, 5), (4, 6)]),
    )
    out = {r.id: (r.n_merged, r.closed, [(v.x, v.y) for v in r.vertices]) for r in curves.merge_curves(parts).collect()}
    assert out[1][:2] == (3, False) and out[1][2] in ([(0, 0), (1, 0), (2, 0), (2, 1), (5, 5)], [(5, 5), (2, 1), (2, 0), (1, 0), (0, 0)])
    assert out[4][:2] == (2, True) and sorted(out[4][2]) == [(9, 0), (10, 0), (10, 1)] and {6, 7} <= set(out)


def test_trim_by_ring_keeps_all_length(spark):
    rng = random.Random(5)
    rows = [tuple(rng.uniform(-3, 13) for _ in range(4)) for _ in range(120)]
    ring = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (5.0, 3.0), (0.0, 10.0)]
    size = lambda df: df.select(F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))).first()[0]
    own = lines(spark, *rows)
    inside, outside = curves.trim_by_ring(own, ring), curves.trim_by_ring(own, ring, inside=False)
    assert size(inside) + size(outside) == pytest.approx(size(own), abs=1e-3)
    for r in inside.collect():
        x, y = (r.x1 + r.x2) / 2, (r.y1 + r.y2) / 2
        assert k.winding((x, y), ring) != 0


def test_lines_without_length(spark):
    own = lines(spark, (0, 0, 4, 0), (2, 0, 2, 0), (2, -1, 2, 1), (3, 0, 3, 0))
    assert checks.split_lines(own, spark.createDataFrame([(1, 2.0, 0.0)], "id long, x double, y double")).where("id = 1").count() == 1
    assert graph.bounded_faces(own).count() == 0 and checks.trim_lines(own, (0, 0, 1, 1)).count() >= 1
    pieces = fixes.break_until_clean(own).collect()
    assert Counter(r.id for r in pieces)[0] == 3
    for fn in (graph.dangling_ends, graph.undershoots, graph.apparent_intersections, graph.snap_clusters):
        fn(own).collect()


def test_fixes_of_pairs(spark):
    short = lines(spark, (0, 0, 9, 0), (10, -5, 10, 5))
    got = sorted((r.id, r.piece, r.x1, r.y1, r.x2, r.y2) for r in fixes.extend_undershoots(short).collect())
    assert got == [(0, 0, 0, 0, 10, 0), (1, 0, 10, -5, 10, 0), (1, 1, 10, 0, 10, 5)]
    corner = lines(spark, (0, 0, 9, 0), (10, 5, 10, 1))
    assert sorted((r.id, r.x2, r.y2) for r in fixes.meet_apparent(corner).collect()) == [(0, 10, 0), (1, 10, 0)]
    near = lines(spark, (0, 0, 5, 0), (5, 1, 9, 9))
    found = graph.snap_clusters(near, 1.5)
    assert {(r.id, r.end, r.x, r.y) for r in found.collect()} == {(0, 1, 5.0, 0.5), (1, 0, 5.0, 0.5)}
    rings = table(spark, entity(1, square(0, 0, 4), True), entity(2, square(4, 1, 2), True))
    full = fixes.insert_vertices(rings, checks.missing_vertices(rings))
    assert checks.missing_vertices(full).count() == 0 and {r.id: len(r.vertices) for r in full.collect()} == {1: 6, 2: 4}
    dots = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.004, 0.0), (3, 0.008, 0.0), (4, 5.0, 5.0), (5, 0.004, 0.0)], "id long, x double, y double")
    assert {r.id: r.x for r in fixes.move_to_anchors(dots).collect()} == {1: 0.0, 2: 0.0, 3: 0.0, 4: 5.0, 5: 0.0}


def test_arcs_and_positions(spark):
    e = table(spark, entity(1, [(0, 0, 1), (2, 0)]), entity(2, square(0, 0, 4), True))
    v, c = F.col("vertices"), F.col("closed")
    flat = e.select("id", arcs.tessellated(v, c, 15.0, 6).alias("t")).collect()
    half = {r.id: [(p.x, p.y) for p in r.t] for r in flat}[1]
    assert len(half) == 13 and half[6] == (1.0, -1.0) and all(math.hypot(x - 1, y) == pytest.approx(1, abs=1e-5) for x, y in half)
    r = e.where("id = 1").select(arcs.arc(v[0], v[1], v[0]["bulge"]).alias("a")).first().a
    assert (r.angle, r.radius, r.cx, r.area) == pytest.approx((math.pi, 1, 1, math.pi / 2)) and r.my == pytest.approx(-4 / (3 * math.pi))
    near = e.where("id = 2").select(arcs.closest(F.lit(5.0), F.lit(1.0), v, c).alias("n"), arcs.point_at(v, F.lit(1.25)).alias("p")).first()
    assert (near.n.d2, near.n.param, near.n.x, near.n.y) == (1.0, 1.25, 4.0, 1.0) and tuple(near.p) == (4.0, 1.0)
    round_ = e.where("id = 2").select(arcs.filleted(v, c, 1.0).alias("f")).select(F.size("f").alias("n"), g.bulge_area(F.col("f")).alias("a")).first()
    assert round_.n == 8 and round_.a == pytest.approx(16 - 4 + math.pi)
    assert e.where("id = 2").select(arcs.convexity(v).alias("c")).first().c == 1


def test_scopes_and_extra_data(spark):
    layers = spark.createDataFrame([(0, "A", False, False), (1, "B", True, False)], "layer_id long, layer string, is_off boolean, is_frozen boolean")
    e = table(spark, entity(1, SQUARE, True), entity(2, SQUARE, kind="LINE"), entity(3, SQUARE)).withColumn("layer_id", F.when(F.col("id") == 3, 1).otherwise(0))
    assert ids(scopes.visible(e, layers)) == [1] and ids(scopes.visible(e, layers, None)) == [1, 2] and ids(scopes.by_layers(e, layers, "B")) == []
    assert ids(scopes.scope(e, layers, e.where("id > 1"), fixed=e.where("id = 2"))) == [3]
    d = spark.createDataFrame([(1, {"SOUTH": ["300000"]}), (2, None)], "id long, x map<string,array<string>>")
    out = d.select("id", scopes.is_parcel(F.col("x")).alias("p"), scopes.is_island(scopes.with_flag(F.col("x"), "SOUTH", F.array(F.lit("340099")))).alias("i"))
    assert {r.id: (r.p, r.i) for r in out.collect()} == {1: (True, True), 2: (False, True)}
    assert scopes.wkt is not None and e.where("id = 1").select(scopes.wkt(F.col("vertices"), F.col("closed"), 0).alias("w")).first().w == "POLYGON ((0 0, 1 0, 1 1, 0 1, 0 0))"


def test_windows_start_again_after_a_group(spark):
    seven = [(0, 20 * i, 100, 20 * i) for i in range(5)] + [(0, 300 + 20 * i, 100, 300 + 20 * i) for i in range(3)]
    got = sorted((r.off, r.n_lines) for r in floorplan.window_groups(lines(spark, *seven)).collect())
    assert got == [(0.0, 5), (300.0, 3)]
    wide = [(0, 0, 100, 0), (0, 400, 100, 400), (0, 420, 100, 420), (0, 440, 100, 440)]  # the first gap decides
    assert floorplan.window_groups(lines(spark, *wide)).count() == 0


def test_nested_rings(spark):
    e = table(spark, entity(1, square(0, 0, 10), True), entity(2, square(1, 1, 8), True), entity(3, square(2, 2, 6), True), entity(4, square(1, 1, 8), True))
    assert {r.id: r.net_area for r in polygons.net_areas(e.where("id < 4")).collect()} == {1: 36.0, 2: 28.0, 3: 36.0}
    assert {r.id: (r.parent, r.depth) for r in polygons.depths(e).collect()} == {1: (None, 0), 2: (1, 1), 4: (2, 2), 3: (4, 3)}
    assert polygons.annotation_overlaps(e).count() == 0


def test_kernels_of_shapes():
    a, b = [(0, 0), (0, 0.25), (2.5, 0), (0.75, 2.25)], [(0, 0), (0, 0), (1.25, 2)]
    both, diff = (k.boolean([a], [b], op)[0] for op in ("intersection", "difference"))
    assert both + diff == pytest.approx(k.boolean([a], [a], "union")[0], abs=1e-8)  # crossings are not moved to the lattice
    assert k.min_width_rectangle([(0, 0), (4, 0), (4, 1), (0, 1)]) == (1.0, 4.0)
    disc = k.area(k.disc(1.0, 8))
    assert k.buffer(square(0.0, 0.0, 4.0), True, 1.0, 8)[0] == pytest.approx(16 + 16 + disc)
    assert k.buffer([(0.0, 0.0), (5.0, 0.0)], False, 1.0, 8)[0] == pytest.approx(10 + disc, abs=1e-4)
    notch = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0)]
    assert k.area(notch) < k.buffer(notch, True, 0.25, 4)[0] < k.buffer(k.hull(notch), True, 0.25, 4)[0]
    assert k.area(k.minkowski(SQUARE, SQUARE)) == pytest.approx(4) and k.clean([(0, 0), (2, 2), (2, 0), (0, 2)])[0] == pytest.approx(2)
    assert k.ring_faults(SQUARE) == [] and k.ring_faults([(0, 0), (2, 2), (2, 0), (0, 2)]) == ["crossing", "flat"] and k.ring_faults([(0, 0), (1, 1)]) == ["few"]
    assert k.curve_dangles([(0, 0), (2, 0), (2, 2), (1, 2), (1, -1)], False) == 2 and k.curve_dangles(SQUARE, True) == 0


def test_all_units_and_terms(spark):
    c = lambda q, s, t, h=24.0: units.factor(q, s, h) / units.factor(q, t, h)
    assert c("speed", "inch_per_hour", "centimeter_per_minute") == pytest.approx(2.54 / 60, rel=1e-6) and c("cost_rate", "per_day", "per_hour", 8.0) == 1 / 8
    assert c("energy_rate", "joule_per_minute", "joule_per_second") == 1 / 60 and c("volume", "cubic_foot", "cubic_inch") == pytest.approx(1728)
    assert spark.range(1).select(units.terms(F.lit("a + 2*b-")).alias("t")).first().t == ["a", "2", "b"]


def test_recheck_writes_each_batch_once(spark, tmp_path):
    e = table(spark, entity(1, [(0, 0), (0.1, 0)]), entity(2, SQUARE, True))
    e.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in")
    for _ in range(2):
        q = recheck.recheck(stream, f"{tmp_path}/out", f"{tmp_path}/state")
        q.processAllAvailable()
        q.stop()
    found = {(r.action_type, r.id) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert found == {("EraseShort", 1), ("UnclosedPolygon", 1), ("AntiClockwisePolygon", 2)} and spark.read.parquet(f"{tmp_path}/out").count() == 3


def test_related_findings(spark):
    rows = [("A", 1, [1, 2]), ("B", 2, [2]), ("A", 3, [1, 1]), ("C", 4, [9])]
    out = checks.related(spark.createDataFrame(rows, "action_type string, id long, source_ids array<long>")).collect()
    assert {tuple(r) for r in out} == {("A", 1, "A", 3), ("A", 1, "B", 2)}


def test_clean_stops_when_nothing_changes(spark):
    e = table(spark, *[entity(i, [(0, 0), (0.01, 0), (0.02, 0), (5, 0), (5, i)], elevation=1.0) for i in range(1, 4)])
    out = checks.clean(e, tuple(a.name for a in checks.ACTIONS))
    assert checks.elevated(out).count() == 0 and checks.duplicate_vertex(out).count() == 0
    assert views.vertices(out).count() > 0
