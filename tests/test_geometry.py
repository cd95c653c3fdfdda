"""Row checks, joins, graphs and kernels on hand-made cases: one positive, one negative, one at the tolerance."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.functions import geometry as g
from plumbline.functions import kernels as k
from plumbline.functions import units
from plumbline.operators import checks, floorplan, graph, joins, polygons
from plumbline.sources import survey, views

ENTITY = "id long, layer_id long, kind string, closed boolean, elevation double, vertices array<struct<x:double,y:double,bulge:double>>"
SQUARE = [(0, 0), (1, 0), (1, 1), (0, 1)]


def entity(i, points, closed=False, elevation=0.0, kind="POLYLINE"):
    return (i, 0, kind, closed, elevation, [(float(p[0]), float(p[1]), float(p[2]) if len(p) > 2 else 0.0) for p in points])


def table(spark, *rows):
    return spark.createDataFrame(list(rows), ENTITY)


def ids(df, col="id"):
    return sorted(r[col] for r in df.collect())


def lines(spark, *rows):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "id long, x1 double, y1 double, x2 double, y2 double")


def square(x, y, s):
    return [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]


def test_length_and_area_checks(spark):
    e = table(
        spark, entity(1, [(0, 0), (0, 0)]), entity(2, [(0, 0), (1, 0)]), entity(3, [(0, 0), (0.2, 0)]), entity(4, [(0, 0), (0.1, 0)]),
        entity(5, square(0, 0, 0.1), True), entity(6, SQUARE, True), entity(7, square(0, 0, 0.1)), entity(8, [(0, 0), (1, 0), (0, 0)], True),
        entity(9, [(5, 5)]),
    )
    assert ids(checks.zero_length(e)) == [1, 9]
    assert ids(checks.short(e)) == [1, 3, 4, 9]
    assert ids(checks.small_polygon(e)) == [5, 8]
    assert ids(checks.zero_area(e)) == [1, 8]
    assert ids(checks.unclosed(e)) == [1, 2, 3, 4, 7, 9]


def test_ring_checks(spark):
    needle = [(0, 0), (100, 1), (100, -1)]
    five = [(0, 0), (10, 0), (10 * math.cos(math.radians(5)), 10 * math.sin(math.radians(5)))]
    e = table(
        spark, entity(1, needle, True), entity(2, SQUARE, True), entity(3, SQUARE[::-1], True), entity(4, five, True),
        entity(5, [(0, 0), (0.01, 0), (1, 1)]), entity(6, [(0, 0), (1, 0), (0.01, 0)]), entity(7, [(0, 0, 1), (1, 0)]), entity(8, [(0, 0, 1e-6), (1, 0)]),
        entity(9, SQUARE, True, 3.0),
    )
    assert ids(checks.sharp_corner(e, 5.0000001)) == [1, 4]
    assert 3 not in ids(checks.anticlockwise(e)) and 2 in ids(checks.anticlockwise(e))
    assert ids(checks.duplicate_vertex(e)) == [5, 6]
    assert ids(checks.arc_segment(e)) == [7] and ids(checks.elevated(e)) == [9]


def test_fixes_leave_nothing_to_find(spark):
    e = table(
        spark, entity(1, [(0, 0), (0.01, 0), (1, 1), (2, 0)]), entity(2, SQUARE, True, 2.0), entity(3, [(0, 0, 1), (4, 0), (4, 4)], True),
        entity(4, [(0, 0), (0.1, 0)]), entity(5, [(0, 0), (1, 0), (1, 1), (0.01, 0.01)], True),
    )
    names = ("NoneZeroElevation", "ArcSegment", "DuplicateVertexPline", "EraseShort", "AntiClockwisePolygon")
    out = checks.clean(e, names)
    assert checks.run_checks(out, names).count() == 0 and ids(out) == [1, 2, 3, 5]
    assert {r.id: len(r.vertices) for r in out.collect()} == {1: 3, 2: 4, 3: 3, 5: 3}


def test_reverse_keeps_arcs(spark):
    e = table(spark, entity(1, [(0, 0, 0.5), (2, 0), (2, 2, -0.2), (0, 2)], True))
    area = lambda df: df.select(g.bulge_area(F.col("vertices")).alias("a")).first().a
    assert area(checks.reverse(e, e)) == pytest.approx(-area(e))
    half = table(spark, entity(1, [(0, 0, 1), (2, 0, 1)], True))
    assert abs(area(half)) == pytest.approx(math.pi)
    assert half.select(g.arc_length(F.col("vertices"), True).alias("l")).first().l == pytest.approx(2 * math.pi)


def test_crossings_and_touches(spark):
    seg = lines(spark, (0, 0, 2, 2), (0, 2, 2, 0), (10, 0, 12, 0), (10, 1, 12, 1), (20, 0, 22, 0), (22, 0, 22, 2), (30, 0, 34, 0), (32, 0, 32, 3), (40, 0, 44, 0), (42, 0, 46, 0))
    got = sorted((r.a_id, r.b_id, r.x, r.y) for r in joins.crossings(seg).collect())
    assert got == [(0, 1, 1.0, 1.0), (6, 7, 32.0, 0.0), (8, 9, 42.0, 0.0), (8, 9, 44.0, 0.0)]


def test_long_segments_meet_short_ones(spark):
    """Boxes of very different sizes meet on the coarser grid, once."""
    rng = random.Random(1)
    rows = [(0, 0, 4000, 4000), (0, 4000, 4000, 0)] + [(x := rng.uniform(0, 4000), y := rng.uniform(0, 4000), x + rng.uniform(-5, 5), y + rng.uniform(-5, 5)) for _ in range(300)]
    seg = joins.with_box(lines(spark, *rows))
    got = [(r.a_id, r.b_id) for r in joins.box_join(seg, seg, 1.0, F.col("a_id") < F.col("b_id")).collect()]
    box = {r.id: r for r in seg.collect()}
    expect = {
        (a, b) for a in box for b in box if a < b and box[a].minx <= box[b].maxx and box[b].minx <= box[a].maxx and box[a].miny <= box[b].maxy and box[b].miny <= box[a].maxy
    }
    assert len(got) == len(set(got)) and set(got) == expect


def test_nearest_matches_brute_force(spark):
    rng = random.Random(2)
    pts = [(i, rng.uniform(0, 50), rng.uniform(0, 50)) for i in range(60)] + [(99, 500.0, 500.0)]
    df = spark.createDataFrame(pts, "id long, x double, y double")
    got = {(r.id, r["rank"]): r.n_id for r in joins.nearest(df, 2, 2.0).collect()}
    for i, x, y in pts:
        order = sorted((((x - u) ** 2 + (y - v) ** 2), j) for j, u, v in pts if j != i)
        assert (got[i, 1], got[i, 2]) == (order[0][1], order[1][1])


def test_duplicates(spark):
    e = table(spark, entity(1, [(0, 0), (1, 0)]), entity(2, [(1, 0), (0, 0)]), entity(3, [(0, 0), (0.5, 0), (1, 0)]), entity(4, [(1, 1), (2, 1)]))
    pairs = checks.duplicate_entity(e)
    assert [(r.a_id, r.b_id) for r in pairs.collect()] == [(1, 2)]
    assert [(r.id, r.survivor) for r in checks.survivors(e, pairs).collect()] == [(2, 1)]
    rings = table(spark, entity(1, SQUARE, True), entity(2, [(1, 1), (1, 0), (0, 0), (0, 1)], True), entity(3, square(0, 0, 2), True))
    assert [(r.a_id, r.b_id) for r in polygons.duplicates(rings).collect()] == [(1, 2)]


def test_duplicates_of_many_vertices(spark):
    long = [(i, 0.0) for i in range(5000)]
    e = table(spark, entity(1, long), entity(2, [(9000.0, 9.0), (9001.0, 9.0)]), entity(7, long))
    pairs = checks.duplicate_entity(e)
    assert [tuple(r) for r in pairs.collect()] == [(1, 7)]
    assert [tuple(r) for r in checks.survivors(e, pairs).collect()] == [(7, 1)]


def test_dangling_undershoot_apparent(spark):
    seg = lines(spark, (0, 0, 9, 0), (10, -5, 10, 5), (10, 5, 15, 5), (20, 0, 21, 0), (22, 2, 22, 1), (30, 0, 38, 0), (40, -5, 40, 5))
    ends = {(r.id, r.end) for r in graph.dangling_ends(seg).collect()}
    assert (1, 1) not in ends and (0, 1) in ends and (2, 1) in ends
    under = {(r.id, r.end): (r.target, r.x, r.dist) for r in graph.undershoots(seg, 2.0).collect()}
    assert under[0, 1] == (1, 10.0, 1.0) and under[5, 1] == (6, 40.0, 2.0)
    app = {(r.a_id, r.b_id): (r.x, r.y) for r in graph.apparent_intersections(seg, 2.0).collect()}
    assert app[3, 4] == (22.0, 0.0)


def test_dangling_chains(spark):
    loop = [(0, 0, 1, 0), (1, 0, 1, 1), (1, 1, 0, 0)]
    tail = [(1, 1, 2, 2), (2, 2, 3, 2)]
    far = [(50, 50, 150, 50)]
    out = {r.id: (r.chain, r.chain_length) for r in graph.dangling_chains(lines(spark, *loop, *tail, *far), 50.0).collect()}
    assert set(out) == {3, 4} and out[3][0] == out[4][0] == 3 and out[3][1] == pytest.approx(1 + math.sqrt(2), abs=1e-5)


def test_components_of_a_long_chain(spark):
    nodes = spark.range(200)
    edges = spark.createDataFrame([(i, i + 1) for i in range(149)], "a long, b long")
    out = {r.id: r.component for r in graph.components(nodes, edges).collect()}
    assert all(out[i] == 0 for i in range(150)) and all(out[i] == i for i in range(150, 200))


def test_near_vertices_chain(spark):
    pts = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.004, 0.0), (3, 0.008, 0.0), (4, 1.0, 0.0), (5, 1.0, 0.0)], "id long, x double, y double")
    assert {(r.id, r.anchor) for r in checks.near_vertices(pts).collect()} == {(1, 1), (2, 1), (3, 1)}


def test_missing_vertex_and_crotch(spark):
    e = table(spark, entity(1, square(0, 0, 4), True), entity(2, [(4, 1), (6, 1), (6, 3), (4, 3)], True))
    assert {(r.id, r.x, r.y) for r in checks.missing_vertices(e).collect()} == {(1, 4.0, 1.0), (1, 4.0, 3.0)}
    shared = table(spark, entity(1, [(0, 0), (2, 0), (2, 2), (0, 2)], True), entity(2, [(2, 0), (4, 0), (4, 2), (2, 2)], True))
    assert {(r.id, r.x, r.y) for r in checks.crotch_points(shared).collect()} == {(i, 2.0, y) for i in (1, 2) for y in (0.0, 2.0)}


def test_polygon_relations(spark):
    e = table(spark, entity(1, square(0, 0, 4), True), entity(2, square(3, 3, 4), True), entity(3, square(1, 1, 1), True), entity(4, square(4, -4, 4), True), entity(5, [(1.5, -1), (2.5, -1), (2.5, 5), (1.5, 5)], True))
    over = {(r.a_id, r.b_id): r.area for r in polygons.overlaps(e).collect()}
    assert over == {(1, 2): 1.0, (1, 3): 1.0, (1, 5): 4.0, (3, 5): 0.5}
    assert {(r.outer, r.inner) for r in polygons.includes(e).collect()} == {(1, 3)}
    gap = table(spark, entity(1, square(0, 0, 4), True), entity(2, square(4.1, 0, 4), True), entity(3, square(0, 4, 4), True))
    assert {(r.a_id, r.b_id) for r in polygons.gaps(gap, 0.2).collect()} == {(1, 2)}


def test_regions_and_holes(spark):
    block = [(x, y) for x in range(3) for y in range(3) if (x, y) != (1, 1)]
    rows = [entity(i, square(x, y, 1), True) for i, (x, y) in enumerate(block)]
    rows += [entity(20, square(10, 0, 1), True), entity(21, square(11, 1, 1), True)]  # share a corner only
    out = {r.component: r for r in polygons.region_contours(table(spark, *rows)).collect()}
    assert set(out) == {0, 20, 21} and out[0].n_holes == 1 and out[0].hole_area == 1.0 and out[0].area == 8.0
    full = [entity(i, square(x, y, 1), True) for i, (x, y) in enumerate([(x, y) for x in range(3) for y in range(3)])]
    assert [r.n_holes for r in polygons.region_contours(table(spark, *full)).collect()] == [0]


def test_islands(spark):
    e = table(spark, entity(1, square(0, 0, 10), True), entity(2, square(1, 1, 1), True), entity(3, square(5, 5, 1), True), entity(4, square(5, 5, 1), True))
    flags = spark.createDataFrame([(1, "parcel"), (2, "island")], "id long, flag string")
    groups = spark.createDataFrame([(7, 1), (7, 2)], "group_id long, id long")
    assert ids(polygons.islands(e, groups, flags)) == [3, 4]


def test_split_extend_trim(spark):
    seg = lines(spark, (0, 0, 10, 0))
    cuts = spark.createDataFrame([(0, 4.0, 0.0), (0, 2.0, 0.0), (0, 0.0, 0.0)], "id long, x double, y double")
    assert [(r.piece, r.x1, r.x2) for r in checks.split_lines(seg, cuts).orderBy("piece").collect()] == [(0, 0.0, 2.0), (1, 2.0, 4.0), (2, 4.0, 10.0)]
    inside = checks.trim_lines(lines(spark, (-5, 1, 5, 1), (0, 9, 1, 9)), (0, 0, 3, 3)).collect()
    assert [(r.id, r.x1, r.x2) for r in inside] == [(0, 0.0, 3.0)]
    outside = checks.trim_lines(lines(spark, (-5, 1, 5, 1), (0, 9, 1, 9)), (0, 0, 3, 3), inside=False).collect()
    assert sorted((r.id, r.x1, r.x2) for r in outside) == [(0, -5.0, 0.0), (0, 3.0, 5.0), (1, 0.0, 1.0)]


def test_trim_query_keeps_the_parts_of_crossing_segments(spark, monkeypatch):
    from plumbline.plans import queries

    rng = random.Random(4)
    rows = [tuple(rng.uniform(0, 2000) for _ in range(4)) for _ in range(300)]
    rows += [(0, 1000, 2000, 1000), (500, 0, 500, 2000), (600, 600, 700, 700), (0, 0, 400, 400), (0, 1000, 1000, 0), (900, 900, 900, 900)]
    monkeypatch.setattr(queries, "_segs", lambda *_: lines(spark, *rows))
    got = {r.id: (r.x1, r.y1, r.x2, r.y2) for r in queries.QUERIES["trim_parts_by_extents"](spark, "").collect()}

    def clipped(x1, y1, x2, y2):
        """The part between the outermost of the ends and border crossings that lie in the box."""
        ts = [0.0, 1.0]
        for a, b in ((x1, x2), (y1, y2)):
            ts += [(m - a) / (b - a) for m in (500, 1500) if a != b]
        at = lambda t: (x1 + t * (x2 - x1), y1 + t * (y2 - y1))
        held = [t for t in ts if 0 <= t <= 1 and all(500 - 1e-9 <= v <= 1500 + 1e-9 for v in at(t))]
        return (*at(min(held)), *at(max(held))) if held and min(held) < max(held) - 1e-12 and (x1, y1) != (x2, y2) else None

    expect = {i: c for i, r in enumerate(rows) if (c := clipped(*r))}
    assert set(got) == set(expect) and {300, 301} <= set(got)
    assert all(got[i] == pytest.approx(expect[i], abs=1e-5) for i in got)


def test_a_window_of_six_lines_is_cut_after_the_fifth(spark):
    six = [(0, 20 * k, 100, 20 * k) for k in range(6)]
    got = floorplan.window_groups(lines(spark, *six)).collect()
    assert [(r.first_id, r.n_lines, r.lo, r.hi, r.off) for r in got] == [(0, 5, 0.0, 100.0, 0.0)]


def test_windows_and_walls(spark):
    rows = [(0, y, 100, y) for y in (0, 50, 100)] + [(0, 1000, 100, 1000), (200, 0, 200, 80)]
    got = floorplan.window_groups(lines(spark, *rows)).collect()
    assert [(r.first_id, r.n_lines) for r in got] == [(0, 3)]
    walls = floorplan.nearest_walls(floorplan.wall_candidates(lines(spark, (0, 0, 100, 0)), spark.createDataFrame([(7, 0.0, 200.0, 90.0, 200.0), (8, 100.0, 300.0, 0.0, 300.0), (9, 0.0, 600.0, 50.0, 600.0)], "id long, x1 double, y1 double, x2 double, y2 double")))
    assert [(r.id, r.inner_id, r.dist) for r in walls.collect()] == [(0, 7, 200.0)]


def test_contour_of_crossing_lines(spark):
    got = floorplan.apartment_contour(lines(spark, (-1, 0, 5, 0), (-1, 4, 5, 4), (0, -1, 0, 5), (4, -1, 4, 5), (-1, 0, 5, 0))).collect()
    assert [(r.area, r.n_vertices) for r in got] == [(16.0, 4)]


def test_title_frame(spark):
    c = table(spark, entity(1, square(0, 0, 100), True), entity(2, square(10, 30, 50), True))
    texts = spark.createDataFrame([(float(i * 10 + 5), 5.0) for i in range(5)], "x double, y double")
    assert ids(floorplan.title_frame(c, texts)) == [1] and floorplan.title_frame(c, texts.limit(4)).count() == 0


def test_survey_points(spark, tmp_path):
    text = ["P1,K1,10.5,20.25", "P2,,1,2", "P3,K3,1,2,99", "P4,K4,abc,2", "P5,K5,1", ""]
    (tmp_path / "p.txt").write_text("\n".join(text))
    got = {(r.name, r.code, r.x, r.y) for r in survey.parse(survey.read_lines(spark, str(tmp_path / "p.txt"))).collect()}
    assert got == {("P1", "K1", 20.25, 10.5), ("P2", "", 2.0, 1.0), ("P3", "K3", 2.0, 1.0)}


def test_units(spark):
    df = spark.createDataFrame([(1.0, "yard", "meter"), (1.0, "kilometer", "decimeter"), (2.0, "x", "meter")], "value double, source string, target string")
    got = [r.converted for r in units.convert_rows(df, "length").orderBy("value", "source").collect()]
    assert got[0] == 10000.0 and got[1] == pytest.approx(0.9144, abs=1e-5) and got[2] is None
    assert spark.range(1).select(units.convert(F.lit(2.0), "time", "day", "hour", 8.0).alias("h")).first().h == 16.0


def test_empty_tables(spark):
    e = table(spark)
    assert checks.run_checks(e).count() == 0 and joins.crossings(views.segments(e)).count() == 0
    assert polygons.overlaps(e).count() == 0 and polygons.regions(e).count() == 0


# --- kernels ---


def test_boolean_of_squares():
    a, b = square(0.0, 0.0, 2.0), square(1.0, 1.0, 2.0)
    assert [round(k.boolean([a], [b], op)[0], 9) for op in ("intersection", "union", "difference", "xor")] == [1.0, 7.0, 3.0, 6.0]
    inner = square(0.5, 0.5, 1.0)
    size, rings = k.boolean([a], [inner], "difference")
    assert size == pytest.approx(3) and sorted(round(k.area(r), 6) for r in rings) == [-1.0, 4.0]


coords = st.tuples(st.integers(0, 12), st.integers(0, 12)).map(lambda p: (p[0] / 4, p[1] / 4))


@settings(max_examples=120, deadline=None)
@given(st.lists(coords, min_size=3, max_size=7), st.lists(coords, min_size=3, max_size=7))
def test_areas_are_conserved(a, b):
    both, one, two, diff = (k.boolean([a], [b], op)[0] for op in ("intersection", "union", "xor", "difference"))
    whole = k.boolean([a], [a], "union")[0]
    assert both + diff == pytest.approx(whole, abs=1e-6) and both + two == pytest.approx(one, abs=1e-6)


@settings(max_examples=100, deadline=None)
@given(st.lists(coords, min_size=3, max_size=30))
def test_hull_and_rectangle_hold_all_points(points):
    h = k.hull(points)
    if len(h) >= 3:
        assert all(k.side(a, b, p) >= -1e-9 for a, b in k.edges_of(h) for p in points)
        size, _ = k.min_rectangle(points)
        xs, ys = zip(*points, strict=True)
        assert k.area(h) - 1e-9 <= size <= (max(xs) - min(xs)) * (max(ys) - min(ys)) + 1e-9


@settings(max_examples=100, deadline=None)
@given(st.lists(coords, min_size=2, max_size=25), st.floats(0.01, 2))
def test_simplified_lines_stay_near(points, tol):
    kept = k.simplify(points, tol)
    assert kept[0] == points[0] and kept[-1] == points[-1] and set(kept) <= set(points)


def test_polygonize_and_split():
    found, dangles = k.polygonize([((0, 0), (4, 0)), ((4, 0), (4, 4)), ((4, 4), (0, 4)), ((0, 4), (0, 0)), ((2, -1), (2, 5))])
    assert sorted(k.face_area(f) for f in found) == [8.0, 8.0] and len(dangles) == 2
    assert sorted(k.area(r) for r in k.split_by_line(square(0.0, 0.0, 4.0), (1.0, -1.0), (1.0, 5.0))) == [4.0, 12.0]
    assert sum(k.area(r) for r in k.offset(square(0.0, 0.0, 4.0), 1.0)) == pytest.approx(36)
    assert k.offset(square(0.0, 0.0, 1.0), -1.0) == [] and sum(k.area(r) for r in k.offset(square(0.0, 0.0, 4.0), -1.0)) == pytest.approx(4)
