"""Larger tables: copies of geometry, ids that clash, joins that must not be broadcast."""

import random
import time

import pytest
from pyspark.sql import functions as F

from plumbline.functions import kernels as k
from plumbline.operators import checks, curves, fixes, floorplan, graph, joins, polygons
from plumbline.plans import more, queries
from plumbline.sources.staging import Workspace
from test_geometry import entity, lines, square, table


def test_parts_of_equal_lines_stay_with_their_own_curve(spark, monkeypatch):
    rows = [(0, 0, 1, 0)] * 3 + [(1, 0, 1, 0), (5, 5, 6, 5), (6, 5, 7, 5), (7, 5, 7, 5), (9, 9, 9, 9)]
    own = lines(spark, *rows).withColumn("layer_id", F.lit(0).cast("long"))
    monkeypatch.setattr(more, "view", lambda *_: own)
    monkeypatch.setattr(more, "_segs", lambda *_: own.drop("layer_id"))
    got = {r.part: r.id for r in more.merge_connected(spark, "").collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7}


def test_copies_whose_ids_clash_with_others(spark, monkeypatch):
    own = table(spark, *[entity(i, square(x, 0, 1), True) for i, x in ((5, 0), (1000005, 3), (7, 3))])
    monkeypatch.setattr(more, "_parcels", lambda *_: own)
    got = sorted(tuple(r) for r in more.polygon_duplicate_survivors(spark, "").collect())
    assert got == [(5, 5), (7, 7), (1000005, 5), (1000005, 7), (2000005, 7)]


def test_large_sides_are_not_broadcast(spark):
    points = spark.range(50).select("id", F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"))
    boxes = points.selectExpr("id", "x AS minx", "y AS miny", "x AS maxx", "y AS maxy")
    segs = lines(spark, (0, 0, 1, 0), (3, 0, 4, 0))
    for made in (joins.radius_pairs(points, 1.0), joins.box_join(boxes, boxes, 4.0), graph.dangling_ends(segs), graph.apparent_intersections(segs)):
        assert "BroadcastHashJoin" not in made._jdf.queryExecution().toString()


def test_relations_of_copies_equal_those_of_single_rings(spark):
    rng = random.Random(8)
    spots = [(rng.randint(0, 24) / 4, rng.randint(0, 24) / 4, rng.choice((0.25, 1, 2, 5))) for _ in range(14)] * 3
    boxes = {i: (x, y, x + s, y + s) for i, (x, y, s) in enumerate(spots)}
    e = table(spark, *[entity(i, square(x, y, s), True) for i, (x, y, s) in enumerate(spots)])
    size = {i: (b[2] - b[0]) * (b[3] - b[1]) for i, b in boxes.items()}
    lap = lambda p, q: (min(p[2], q[2]) - max(p[0], q[0]), min(p[3], q[3]) - max(p[1], q[1]))
    both = {(i, j): lap(boxes[i], boxes[j]) for i in boxes for j in boxes if i != j}
    area = {(i, j): w * h for (i, j), (w, h) in both.items() if i < j and w > 0 and h > 0}
    holds = {(i, j) for i, j in both if all(boxes[i][k] <= boxes[j][k] for k in (0, 1)) and all(boxes[i][k] >= boxes[j][k] for k in (2, 3))}
    assert {(r.a_id, r.b_id): r.area for r in polygons.overlaps(e).collect()} == area
    assert sorted(tuple(r) for r in polygons.includes(e).collect()) == sorted(holds)
    apart = {p: a for p, a in area.items() if p not in holds and p[::-1] not in holds}
    assert {(r.a_id, r.b_id): r.area for r in polygons.annotation_overlaps(e).collect()} == apart
    ranked = {(i, j) for i, j in holds if (-size[i], i) < (-size[j], j)}
    direct = {(i, j) for i, j in ranked if not any((i, m) in ranked and (m, j) in ranked for m in boxes)}
    assert sorted(tuple(r) for r in polygons.direct_includes(e).collect()) == sorted(direct)
    around = {j: [i for i, t in ranked if t == j] for j in boxes}
    tree = {j: (min(up, key=lambda i: (size[i], -i)) if up else None, len(up)) for j, up in around.items()}
    assert {r.id: (r.parent, r.depth) for r in polygons.depths(e).collect()} == tree
    none = spark.createDataFrame([], "id long, flag string"), spark.createDataFrame([], "group_id long, id long")
    inner = {j: min(i for i, t in holds if t == j and size[i] > size[j]) for j in boxes if any(t == j and size[i] > size[j] for i, t in holds)}
    assert {r.id: r.outer for r in polygons.islands(e, none[1], none[0]).collect()} == inner
    near = {(i, j) for (i, j), (w, h) in both.items() if w >= 0 and h >= 0 and (w > 0 or h > 0)}
    comp = {i: i for i in boxes}
    while any(comp[i] > comp[j] for i, j in near):
        comp = {i: min([comp[i], *(comp[j] for a, j in near if a == i)]) for i in boxes}
    assert {r.id: r.component for r in polygons.regions(e).collect()} == comp
    assert sum(r.n_rings for r in polygons.region_contours(e).collect()) == len(boxes)
    missing = {(r.id, r.x, r.y) for r in checks.missing_vertices(e).collect()}
    full = {r.id: {(v.x, v.y) for v in r.vertices} for r in checks.with_missing_vertices(e).collect()}
    assert missing and all(full[i] == {p[:2] for p in square(*spots[i])} | {(x, y) for j, x, y in missing if j == i} for i in boxes)
    thin = table(spark, *[entity(i, [(x, 0), (x + 0.1, 0), (x + 0.1, 3), (x, 3)], True) for i, x in enumerate((0, 0, 0.2, 0.2))])
    again = table(spark, *[entity(i, [(x, 0), (x + 0.1, 0), (x + 0.1, 3), (x, 3)], True) for i, x in enumerate((0, 0.2))])
    single = {(r.a_id, r.b_id): r.n_segments for r in polygons.gaps(again, 0.15).collect()}
    copied = {(r.a_id, r.b_id): r.n_segments for r in polygons.gaps(thin, 0.15).collect()}
    assert copied == {(0, 1): 2, (2, 3): 2} | {(i, j): single[0, 1] for i in (0, 1) for j in (2, 3)}


def test_a_pair_of_shapes_is_looked_at_once(spark):
    held, members = polygons.shapes(polygons.rings(table(spark, *[entity(i, square(i % 2, 0, 2), True) for i in range(60)])), Workspace(spark, "t"))
    assert [(r.id, r.n) for r in held.orderBy("id").collect()] == [(0, 30), (1, 30)] and members.count() == 60
    assert polygons._overlapping(held, 32.0, "intersection").count() == 3


def test_walls_of_copies_and_boxes_with_points(spark):
    rows = [(0, y, 10, y) for y in (0, 0, 1, 1, 3)] + [(2, 0.5, 4, 0.5)]
    segs = lines(spark, *rows)
    plain = sorted(tuple(r) for r in floorplan.nearest_walls(floorplan.wall_candidates(segs, segs, 2.5)).select("id", "inner_id", "dist", "overlap").collect())
    assert sorted(tuple(r) for r in floorplan.walls(segs, segs, 2.5).collect()) == plain and len(plain) == 6
    boxes = spark.createDataFrame([(i, 0.0, 0.0, 2.0, 2.0) for i in range(20)] + [(20, 1.0, 1.0, 5.0, 5.0)], "id long, minx double, miny double, maxx double, maxy double")
    dots = boxes.selectExpr("id", "id / 10 AS minx", "id / 10 AS miny", "id / 10 AS maxx", "id / 10 AS maxy")
    expect = sorted((i, j) for i in range(21) for j in range(21) if (j <= 20 if i < 20 else j >= 10))
    found = joins.spread_boxes(boxes, dots, 4.0)
    assert sorted(tuple(r) for r in found.collect()) == expect


def test_wall_candidates_are_all_pairs_within_the_width(spark, tmp_path):
    rows = [(0, y, 10, y) for y in (0, 0, 1, 1, 3)] + [(2, 0.5, 4, 0.5)]
    segs, twin = lines(spark, *rows), lines(spark, *rows)
    plain = sorted(tuple(r) for r in floorplan.wall_candidates(segs, segs, 2.5).select("id", "inner_id", "dist", "overlap").collect())
    for other in (segs, twin):
        assert sorted(tuple(r) for r in floorplan.wall_pairs(segs, other, 2.5).collect()) == plain and len(plain) == 20
    spark.createDataFrame([(i,) for i in (1, 2, 201, 4001)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    side = lambda k: (k * 7919 % 4000, k * 6151 % 4000, k * 7919 % 4000 + 4 + k * 37 % 60, k * 6151 % 4000 + 4 + k * 53 % 60)
    boxes = {k: [v / 4 for v in side(k)] for k in (1, 2, 201, 4001)}
    sides = [(k * 8 + s, s % 2, *v) for k, (x, y, xx, yy) in boxes.items() for s, v in enumerate([(y, x, xx), (xx, y, yy), (yy, x, xx), (x, y, yy)])]
    want = sorted((a[0], b[0]) for a in sides for b in sides if a[1] == b[1] and 0 < abs(a[2] - b[2]) < 2 and min(a[4], b[4]) > max(a[3], b[3]))
    assert sorted((r.id, r.inner_id) for r in queries.QUERIES["wall_candidates"](spark, str(tmp_path)).collect()) == want


def test_last_edges_are_merged_at_once(spark, monkeypatch):
    staged, stage = [], Workspace.stage
    monkeypatch.setattr(Workspace, "stage", lambda self, df, label: staged.append(label) or stage(self, df, label))
    rng = random.Random(5)
    path = [(i, i + 1) for i in range(0, 300)] + [(400 + i, 400 + rng.randint(0, 99)) for i in range(100)]
    nodes = spark.createDataFrame([(i,) for i in range(520)], "id long")
    edges = spark.createDataFrame(path, "a long, b long")
    got = {tuple(r) for r in graph.components(nodes, edges).collect()}
    assert len(staged) <= 3 and {c for i, c in got if i <= 300} == {0} and len(got) == 520
    pair = lambda c: F.struct(F.lit("k").alias("k"), F.col(c).alias("v")).alias(c)
    named = graph.components(nodes.select(pair("id")), edges.select(pair("a"), pair("b"))).selectExpr("id.v", "component.v AS c")
    assert {tuple(r) for r in named.collect()} == got
    monkeypatch.setattr(graph, "ONE_TASK", 3)
    assert {tuple(r) for r in graph.components(nodes, edges).collect()} == got


@pytest.mark.parametrize("most", [6, 2_000_000])
def test_faces_of_rounds_and_of_one_task_equal_the_kernel(spark, monkeypatch, most):
    staged, stage = [], Workspace.stage
    monkeypatch.setattr(Workspace, "stage", lambda self, df, label: staged.append(label) or stage(self, df, label))
    monkeypatch.setattr(graph, "ONE_TASK", most)
    rng = random.Random(4)
    rows = [tuple(rng.randint(0, 6) for _ in range(4)) for _ in range(9)] + [(20, 0, 24, 0), (24, 0, 22, 3), (22, 3, 20, 0), (24, 0, 30, 0), (30, 0, 31, 4)]
    rows += [(30 + i, 10, 31 + i, 10 + i % 2) for i in range(12)]
    found, _ = k.polygonize([((a, b), (c, d)) for a, b, c, d in rows if (a, b) != (c, d)])
    want = sorted((round(k.area(f[0]), 3), len(f[0])) for f in found if k.area(f[0]) > 0.01)
    got = graph.bounded_faces(lines(spark, *rows)).collect()
    assert sorted((round(r.area, 3), r.n_vertices) for r in got if r.area > 0.01) == want
    assert most == 6 or len(staged) <= 9


def test_curves_are_cut_by_rows_of_points(spark):
    comb = [(i + 0.5, -1, i + 0.5, 1) for i in range(40)]
    own = table(spark, entity(900, [(0, 0), (40, 0), (40, 5)]), *[entity(i, [(a, b), (c, d)]) for i, (a, b, c, d) in enumerate(comb)])
    out = curves.break_crossings(own)
    pieces = {}
    for r in out.collect():
        pieces.setdefault(r.id, {})[r.piece] = [(v.x, v.y) for v in r.vertices]
    stops = [(0.0, 0.0), *[(i + 0.5, 0.0) for i in range(40)]]
    assert [pieces[900][i] for i in range(41)] == [*([a, b] for a, b in zip(stops, stops[1:])), [(39.5, 0.0), (40.0, 0.0), (40.0, 5.0)]]
    assert all(len(pieces[i]) == 2 for i in range(40))
    assert "flatten(" not in out._jdf.queryExecution().toString()  # segments by points are rows, not arrays in a row


def test_tables_of_earlier_rounds_are_dropped(spark, monkeypatch):
    kept, stage, drop = [], Workspace.stage, Workspace.drop
    monkeypatch.setattr(Workspace, "stage", lambda self, df, label: kept.append(label) or stage(self, df, label))
    monkeypatch.setattr(Workspace, "drop", lambda self, *tables: [kept.pop() for _ in tables] and drop(self, *tables))
    rows = [(0, i, 9, i) for i in range(1, 5)] + [(i, 0, i, 9) for i in range(1, 5)]
    out = fixes.break_until_clean(lines(spark, *rows))
    assert len(kept) == 1
    got = {}
    for r in out.collect():
        got.setdefault(r.id, {})[r.piece] = (r.x1, r.y1, r.x2, r.y2)
    assert [got[0][i] for i in range(5)] == [(0, 1, 1, 1), (1, 1, 2, 1), (2, 1, 3, 1), (3, 1, 4, 1), (4, 1, 9, 1)]
    assert {i: len(p) for i, p in got.items()} == dict.fromkeys(range(8), 5)


def test_polygonized_looks_for_meetings_once(spark, monkeypatch):
    calls, box_join = [], joins.box_join
    monkeypatch.setattr(joins, "box_join", lambda *args, **kw: calls.append(1) or box_join(*args, **kw))
    monkeypatch.setattr(polygons, "box_join", joins.box_join)
    rows = [(-1, 0, 5, 0), (-1, 4, 5, 4), (0, -1, 0, 5), (4, -1, 4, 5), (20, 0, 22, 0), (22, 0, 22, 2), (22, 2, 20, 0)]
    got = sorted(tuple(r) for r in polygons.polygonized(lines(spark, *rows)).collect())
    assert got == [(0, 16.0, 4), (4, 2.0, 3)] and len(calls) == 1


def test_contours_of_large_regions_equal_the_kernel_and_are_not_one_task(spark):
    rng = random.Random(11)
    rows = [entity(i, square(rng.randint(0, 60), rng.randint(0, 60), rng.randint(2, 9)), True) for i in range(60)]
    # a frame with a ring inside that touches nothing, one in its hole, and one that meets the frame in a point
    frame = [(100, 0), (140, 0), (140, 40), (100, 40), (100, 0), (110, 10), (110, 30), (130, 30), (130, 10), (110, 10)]
    rows += [entity(100, frame, True), entity(101, square(102, 2, 5), True), entity(102, square(115, 15, 5), True), entity(103, square(140, 40, 5), True)]
    # skew ones, both ways round, and one without area
    skew = [[(200 + rng.random() * 40, rng.random() * 40) for _ in range(3)] for _ in range(14)]
    rows += [entity(200 + i, ring, True) for i, ring in enumerate(skew)] + [entity(300, [(400, 0), (410, 0), (405, 0)], True)]
    e = table(spark, *rows)
    found = polygons.region_contours(e)
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString()
    got = {r.component: r for r in found.collect()}
    held = {r.id: [(p.x, p.y) for p in r.ring] for r in polygons.rings(e).collect()}
    regions = {}
    for r in polygons.regions(e).collect():
        regions.setdefault(r.component, []).append(held[r.id])
    assert set(got) == set(regions) and max(map(len, regions.values())) >= 10
    for c, rings in regions.items():
        size, parts, empty = k.union(rings)
        outer = max((q for q in parts if k.area(q) > 0), key=k.area, default=[])
        holes = [k.face_area(f) for f in empty if k.face_area(f) >= polygons.SLIVER]
        r = got[c]
        assert (r.n_rings, r.n_holes) == (len(rings), len(holes)), c
        assert abs(r.area - size) < 1e-5 and abs(r.hole_area - sum(holes)) < 1e-5, c
        assert [(p.x, p.y) for p in r.contour] == outer, c


def test_pieces_of_contours_are_numbered_in_the_order_of_their_ids(spark, monkeypatch):
    seen, polygonized = [], polygons.polygonized
    monkeypatch.setattr(polygons, "polygonized", lambda segs, cell: seen.append(segs) or polygonized(segs, cell))
    rows = [(x - 1, y, x + 5, y) for x, y in ((20, 0), (20, 4), (0, 0), (0, 4))] + [(x, -1, x, 5) for x in (20, 24, 0, 4)]
    got = sorted((r.component.id, r.component.piece, r.area, r.n_vertices) for r in floorplan.apartment_contour(lines(spark, *rows)).collect())
    assert got == [(0, 0, 16.0, 4), (2, 0, 16.0, 4)] and seen[0].schema["id"].dataType.typeName() == "long"


def test_the_contour_query_joins_undershoots(spark, monkeypatch):
    rows = [(0, 0, 10, 0), (10, -1, 10, 11), (9, 10, 0, 10), (0, 11, 0, -1)]  # the third stops short of the second
    monkeypatch.setattr(queries, "_segs", lambda *_: lines(spark, *rows))
    assert [(r.area, r.n_vertices) for r in queries.QUERIES["apartment_contour"](spark, "").collect()] == [(100.0, 4)]


def test_apparent_intersections_of_pairs_of_ends_that_are_only_near_are_not_shuffled(spark):
    rng = random.Random(7)
    rows = [(x := rng.randint(0, 60) / 4, y := rng.randint(0, 60) / 4, x + rng.randint(-9, 9) / 4, y + rng.randint(-9, 9) / 4) for _ in range(60)]
    made = graph.apparent_intersections(lines(spark, *rows))
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1
    counts = [sum((rows[j][0:2] == p) + (rows[j][2:4] == p) for j in range(60)) for r in rows for p in (r[0:2], r[2:4])]
    tips = [(i, e, *r[2 * e : 2 * e + 2], *r[2 - 2 * e : 4 - 2 * e]) for i, r in enumerate(rows) for e in (0, 1) if counts[2 * i + e] == 1 and r[0:2] != r[2:4]]
    want, ends = [], {}
    for i, e, ax, ay, aox, aoy in tips:
        for j, f, bx, by, box, boy in tips:
            adx, ady, bdx, bdy = ax - aox, ay - aoy, bx - box, by - boy
            den = adx * bdy - ady * bdx
            if i >= j or not den or (ax - bx) ** 2 + (ay - by) ** 2 > 16:
                continue
            t, s = ((box - ax) * bdy - (boy - ay) * bdx) / den, ((aox - bx) * ady - (aoy - by) * adx) / -den
            if t > 0 and s > 0 and round(t * (adx**2 + ady**2) ** 0.5, 6) <= 2 and round(s * (bdx**2 + bdy**2) ** 0.5, 6) <= 2:
                x, y = ax + t * adx, ay + t * ady
                want.append((i, e, j, f, round(x, 4), round(y, 4)))
                for key, other, px, py in (((i, e), j, ax, ay), ((j, f), i, bx, by)):
                    ends.setdefault(key, []).append((round((x - px) ** 2 + (y - py) ** 2, 5), other, round(x, 4), round(y, 4)))
    got = sorted((r.a_id, r.a_end, r.b_id, r.b_end, round(r.x, 4), round(r.y, 4)) for r in made.collect())
    assert got == sorted(want) and len(want) > 9
    best = {k: min(v)[2:] for k, v in ends.items()}
    found = fixes.apparent_ends(lines(spark, *rows))
    assert {(r.id, r.end): (round(r.x, 4), round(r.y, 4)) for r in found.collect()} == best and any(len(v) > 1 for v in ends.values())


def test_shuffle_files_of_staged_tables_go(spark):
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    sums = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("s"))
    before = files()
    held = Workspace(spark, "t").stage(sums, "sums")
    until = time.time() + 20
    while files() > before and time.time() < until:
        time.sleep(0.1)
    assert files() <= before and held.count() == 7


@pytest.mark.parametrize("long", [False, True])
def test_pieces_are_counted_by_tile_as_by_rounds(spark, monkeypatch, long):
    rng = random.Random(11)
    at = lambda: rng.randint(0, 160) / 4
    rows = [(x := at(), y := at(), x + rng.randint(-12, 12) / 4, y + rng.randint(-12, 12) / 4) for _ in range(250)]
    rows += [(5, 5, 7, 5), (6, 5, 8, 5), (6, 5, 6, 5), (6, 5, 6, 7), (5, 5, 7, 5), (5, 5, 7, 5.0000005), (20, 5, 20.0000001, 9), (20, 6, 20, 11), (19, 7, 21, 7)]
    rows += [(-1, -1, 41, 40)] if long else []
    own = lines(spark, *rows).unionByName(spark.createDataFrame([(900, None, 1.0, 1.0, 1.0)], "id long, x1 double, y1 double, x2 double, y2 double"))
    want = {r.id: r.n for r in fixes.break_until_clean(own).groupBy("id").agg(F.count(F.lit(1)).alias("n")).collect()}
    monkeypatch.setattr(fixes, "TILE_LINES", 2 if long else 20)
    staged, stage = [], Workspace.stage
    monkeypatch.setattr(Workspace, "stage", lambda self, df, label: staged.append(label) or stage(self, df, label))
    got = {r.id: r.n_pieces for r in fixes.pieces_when_clean(own).collect()}
    assert got == want and len(got) == len(rows) + 1 and max(got.values()) > 3
    assert (staged == ["found"]) != long  # without long lines nothing but the counts is written


def test_tables_behind_faces_go_once_read(spark, monkeypatch):
    made, gone, stage, drop = [], [], Workspace.stage, Workspace.drop
    monkeypatch.setattr(Workspace, "stage", lambda self, df, label: made.append(label) or stage(self, df, label))
    monkeypatch.setattr(Workspace, "drop", lambda self, *tables: gone.extend(t._staged_at.rsplit("-", 1)[1] for t in tables) or drop(self, *tables))
    square_ = lines(spark, (0, 0, 4, 0), (4, 0, 4, 4), (4, 4, 0, 4), (0, 4, 0, 0), (4, 4, 6, 6))
    assert sorted(r.id for r in graph.in_loops(square_).collect()) == [0, 1, 2, 3]
    assert {"met", "pieces", "noded", "left", "core"} <= set(gone) & set(made)
    assert [(r.area, r.n_vertices) for r in polygons.polygonized(square_).collect()] == [(16.0, 4)] and gone.count("met") == 2
