"""Queries over the driver's tables, one per operator, and their brute-force SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import geometry as g
from plumbline.functions import units
from plumbline.operators import checks, floorplan, graph, joins, polygons
from plumbline.sources import survey, views
from plumbline.sources.views import oracle_prelude, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, needs: tuple[str, ...] = (), ctes: str = "") -> Callable[[Query], Query]:
    """Registers a query; its oracle is ``sql`` over the needed views and further table expressions."""

    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            parts = [oracle_prelude(*needs)] if needs else []
            if ctes:
                parts.append(ctes if parts else f"WITH RECURSIVE {ctes}")
            ORACLES[name] = ",\n".join(parts) + "\n" + sql
        return fn

    return keep


# --- scans, sources ---------------------------------------------------------------


@query(
    "scan_visible_layers",
    "SELECT s.id, s.layer_id, l.layer FROM v_segments s JOIN v_layers l USING (layer_id) WHERE NOT is_off AND NOT is_frozen",
    ("v_segments", "v_layers"),
)
def scan_visible_layers(spark, d):
    seen = view(spark, d, "v_layers").where("NOT is_off AND NOT is_frozen").select("layer_id", "layer")
    return view(spark, d, "v_segments").select("id", "layer_id").join(seen, "layer_id").select("id", "layer_id", "layer")


@query(
    "scan_by_layer_names",
    "SELECT s.id, l.layer FROM v_segments s JOIN v_layers l USING (layer_id) WHERE NOT is_off AND NOT is_frozen AND layer IN (SELECT n_name FROM nation WHERE n_nationkey IN (1, 2, 3, 8))",
    ("v_segments", "v_layers"),
)
def scan_by_layer_names(spark, d):
    names = spark.read.parquet(f"{d}/nation.parquet").where("n_nationkey IN (1, 2, 3, 8)").select(F.col("n_name").alias("layer"))
    seen = view(spark, d, "v_layers").where("NOT is_off AND NOT is_frozen").join(names, "layer", "left_semi").select("layer_id", "layer")
    return view(spark, d, "v_segments").select("id", "layer_id").join(seen, "layer_id").select("id", "layer")


_POINTS = """parsed AS (SELECT line_no, string_split(line, ',') AS f FROM v_spread_lines),
pts AS (SELECT line_no, f[1] AS name, f[2] AS code, TRY_CAST(f[4] AS DOUBLE) AS x, TRY_CAST(f[3] AS DOUBLE) AS y FROM parsed WHERE len(f) >= 4)"""


@query("survey_points_parse", "SELECT * FROM pts WHERE x IS NOT NULL AND y IS NOT NULL", ("v_spread_lines",), _POINTS)
def survey_points_parse(spark, d):
    return survey.parse(view(spark, d, "v_spread_lines"))


@query(
    "survey_points_annotate",
    "SELECT *, name AS label, x + 0.25 * 0.5 AS label_x, y - 0.375 * 0.5 AS label_y, CAST(0.5 AS DOUBLE) AS height FROM pts WHERE x IS NOT NULL AND y IS NOT NULL",
    ("v_spread_lines",),
    _POINTS,
)
def survey_points_annotate(spark, d):
    return survey.annotate(survey.parse(view(spark, d, "v_spread_lines")), "name", 500.0)


# --- row checks ---------------------------------------------------------------------

_RINGS = """ring AS (
  SELECT v.id, v.pos, v.x, v.y, v.bulge, c.closed, c.n, c.elevation,
    lead(v.x, 1, first_x) OVER w AS nx, lead(v.y, 1, first_y) OVER w AS ny, lag(v.x, 1, last_x) OVER w AS px, lag(v.y, 1, last_y) OVER w AS py
  FROM (SELECT *, first_value(x) OVER f AS first_x, first_value(y) OVER f AS first_y, last_value(x) OVER f AS last_x, last_value(y) OVER f AS last_y
        FROM v_vertices WINDOW f AS (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) v
  JOIN v_curves c USING (id) WINDOW w AS (PARTITION BY v.id ORDER BY v.pos)
), edge AS (
  SELECT *, (nx - x) * (nx - x) + (ny - y) * (ny - y) AS chord2 FROM ring
), seg AS (
  SELECT *, CASE WHEN abs(bulge) < 1e-6 THEN sqrt(chord2) ELSE sqrt(chord2) * (1 + bulge * bulge) * atan(abs(bulge)) / abs(bulge) END AS len,
    CASE WHEN abs(bulge) < 1e-6 THEN 0.0 ELSE chord2 * pow(1 + bulge * bulge, 2) / (16 * bulge * bulge) * (4 * atan(bulge) - sin(4 * atan(bulge))) / 2 END AS cap
  FROM edge
), curve AS (
  SELECT id, closed, n, elevation, sum(x * ny - nx * y) / 2 AS shoelace, sum(x * ny - nx * y) / 2 + sum(cap) AS area,
    sum(CASE WHEN pos < n - 1 OR closed THEN len ELSE 0 END) AS len,
    max(CASE WHEN pos = 0 THEN px = x AND py = y END) AS joined, min(chord2) AS near2, sum((abs(bulge) > 1e-5)::INT) AS arcs
  FROM seg GROUP BY ALL
)"""
_CURVE = ("v_curves", "v_vertices")


def _curves(spark, d):
    return views.curves(spark, d)


def _row_check(name: str, fn, sql: str) -> None:
    query(name, sql, _CURVE, _RINGS)(lambda spark, d: fn(_curves(spark, d)))


@query(
    "check_zero_length",
    "SELECT id, 0.0::DOUBLE AS measure FROM v_segments WHERE x1 = x2 AND y1 = y2",
    ("v_segments",),
)
def check_zero_length(spark, d):
    return checks.zero_length(views.lines_as_entities(view(spark, d, "v_segments")))


@query(
    "check_short",
    "SELECT id, round(sqrt((x2-x1)*(x2-x1) + (y2-y1)*(y2-y1)), 6) AS measure FROM v_segments WHERE (x2-x1)*(x2-x1) + (y2-y1)*(y2-y1) <= 0.25",
    ("v_segments",),
)
def check_short(spark, d):
    return checks.short(views.lines_as_entities(view(spark, d, "v_segments")), 0.5)


_row_check("check_zero_area", checks.zero_area, "SELECT id, round(abs(area), 6) AS measure FROM curve WHERE (closed OR joined) AND abs(area) <= 1e-5")
_row_check(
    "check_small_polygon",
    lambda e: checks.small_polygon(e, 2.0),
    "SELECT id, round(abs(area), 6) AS measure FROM curve WHERE closed AND abs(area) < 2.0 AND abs(abs(area) - 2.0) > 1e-6",
)
_row_check("check_unclosed", checks.unclosed, "SELECT id, n::DOUBLE AS measure FROM curve WHERE NOT closed")
_row_check("check_elevation", checks.elevated, "SELECT id, elevation::DOUBLE AS measure FROM curve WHERE elevation <> 0")
_row_check("check_arc_segment", checks.arc_segment, "SELECT id, arcs::DOUBLE AS measure FROM curve WHERE arcs > 0")
_row_check("check_anticlockwise", checks.anticlockwise, "SELECT id, round(shoelace, 6) AS measure FROM curve WHERE closed AND shoelace >= 0")
_row_check("check_duplicate_vertex", checks.duplicate_vertex, "SELECT id, n::DOUBLE AS measure FROM curve WHERE near2 <= 0.0025")
_row_check(
    "check_sharp_corner",
    lambda e: checks.sharp_corner(e, 20.0),
    """SELECT id, count(*)::DOUBLE AS measure FROM (
         SELECT id, (px-x)*(nx-x) + (py-y)*(ny-y) AS dot, (px-x)*(px-x) + (py-y)*(py-y) AS uu, (nx-x)*(nx-x) + (ny-y)*(ny-y) AS ww FROM ring WHERE closed)
       WHERE uu > 0 AND ww > 0 AND dot > 0 AND dot * dot >= pow(cos(radians(20)), 2) * uu * ww GROUP BY id""",
)
_row_check(
    "area_length",
    lambda e: e.select("id", F.round(g.arc_length(F.col("vertices"), F.col("closed")), 6).alias("length"), F.round(g.bulge_area(F.col("vertices")), 6).alias("area")),
    "SELECT id, round(len, 6) AS length, round(area, 6) AS area FROM curve",
)
_row_check(
    "extents",
    lambda e: e.select("id", g.extents(F.col("vertices")).alias("e")).select("id", "e.*"),
    "SELECT id, min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy FROM v_vertices GROUP BY id",
)
_row_check(
    "rectangle_like",
    lambda e: e.where(g.rectangle_like(F.col("vertices"), 0.6)).select("id"),
    """SELECT id FROM curve JOIN (SELECT id, (max(x) - min(x)) * (max(y) - min(y)) AS box FROM v_vertices GROUP BY id) USING (id)
       WHERE box > 0 AND abs(shoelace) >= 0.6 * box""",
)
_row_check(
    "centroids",
    lambda e: e.where("closed").select("id", g.centroid(F.col("vertices")).alias("c")).select("id", F.round("c.x", 4).alias("x"), F.round("c.y", 4).alias("y")),
    """SELECT id, round(CASE WHEN abs(s) > 1e-6 THEN mx / (6 * s) ELSE ax END, 4) AS x, round(CASE WHEN abs(s) > 1e-6 THEN my / (6 * s) ELSE ay END, 4) AS y
       FROM (SELECT id, sum(x * ny - nx * y) / 2 AS s, sum((x + nx) * (x * ny - nx * y)) AS mx, sum((y + ny) * (x * ny - nx * y)) AS my, avg(x) AS ax, avg(y) AS ay
             FROM ring WHERE closed GROUP BY id)""",
)
_row_check("vertices_explode", views.vertices, "SELECT id, pos, x, y, bulge::DOUBLE AS bulge FROM v_vertices")
_SEGS = """segs AS (SELECT id, pos AS seg, x AS x1, y AS y1, nx AS x2, ny AS y2, n FROM ring
  WHERE pos < n - 1 OR (closed AND (x <> nx OR y <> ny)))"""
query("segments_explode", "SELECT id, seg, x1, y1, x2, y2 FROM segs", _CURVE, f"{_RINGS},\n{_SEGS}")(
    lambda spark, d: views.segments(_curves(spark, d))
)


# --- spatial joins ------------------------------------------------------------------------


@query(
    "near_vertex_pairs",
    "SELECT a.id AS a_id, b.id AS b_id, (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) AS d2 FROM v_points a JOIN v_points b ON a.id < b.id AND abs(a.x-b.x) <= 1 AND abs(a.y-b.y) <= 1 WHERE (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) <= 1",
    ("v_points",),
)
def near_vertex_pairs(spark, d):
    return joins.radius_pairs(view(spark, d, "v_points"), 1.0)


@query(
    "box_range_vertices",
    "SELECT p.id AS parcel, v.id AS point FROM v_parcels p JOIN v_points v ON v.x BETWEEN p.minx AND p.maxx AND v.y BETWEEN p.miny AND p.maxy",
    ("v_parcels", "v_points"),
)
def box_range_vertices(spark, d):
    points = view(spark, d, "v_points").selectExpr("id", "x AS minx", "y AS miny", "x AS maxx", "y AS maxy")
    return joins.spread_boxes(view(spark, d, "v_parcels"), points, 16.0).select(F.col("a_id").alias("parcel"), F.col("b_id").alias("point"))


@query(
    "knn_vertices",
    """SELECT id, n_id, d2, rank::INT AS rank FROM (
         SELECT a.id, b.id AS n_id, (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) AS d2,
           row_number() OVER (PARTITION BY a.id ORDER BY (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y), b.id) AS rank
         FROM (SELECT * FROM v_points WHERE id % 100 = 0) a JOIN v_points b ON a.id <> b.id) WHERE rank <= 3 ORDER BY id""",
    ("v_points",),
)
def knn_vertices(spark, d):
    """Three nearest of every hundredth point, against all points."""
    points = view(spark, d, "v_points")
    return joins.nearest(points, 3, 8.0, points.where("id % 100 = 0"))


_HIT = """((a.x2-a.x1)*(b.y1-a.y1) - (b.x1-a.x1)*(a.y2-a.y1)) * ((a.x2-a.x1)*(b.y2-a.y1) - (b.x2-a.x1)*(a.y2-a.y1)) < 0
  AND ((b.x2-b.x1)*(a.y1-b.y1) - (a.x1-b.x1)*(b.y2-b.y1)) * ((b.x2-b.x1)*(a.y2-b.y1) - (a.x2-b.x1)*(b.y2-b.y1)) < 0"""
_MEET = """least(a.x1,a.x2) <= greatest(b.x1,b.x2) AND least(b.x1,b.x2) <= greatest(a.x1,a.x2)
  AND least(a.y1,a.y2) <= greatest(b.y1,b.y2) AND least(b.y1,b.y2) <= greatest(a.y1,a.y2)"""


@query(
    "crossing_pairs",
    f"SELECT a.id AS a_id, b.id AS b_id FROM v_segments a JOIN v_segments b ON a.id < b.id AND {_MEET} AND {_HIT}",
    ("v_segments",),
)
def crossing_pairs(spark, d):
    """Proper crossings."""
    segs = joins.with_box(view(spark, d, "v_segments").select("id", "x1", "y1", "x2", "y2"))
    side = lambda p, q, k: (F.col(f"{p}_x2") - F.col(f"{p}_x1")) * (F.col(f"{q}_y{k}") - F.col(f"{p}_y1")) - (
        F.col(f"{q}_x{k}") - F.col(f"{p}_x1")
    ) * (F.col(f"{p}_y2") - F.col(f"{p}_y1"))
    proper = (side("a", "b", 1) * side("a", "b", 2) < 0) & (side("b", "a", 1) * side("b", "a", 2) < 0)
    return joins.box_join(segs, segs, 8.0, (F.col("a_id") < F.col("b_id")) & proper).select("a_id", "b_id")


def _hit_ctes(source: str, same: bool) -> str:
    """Points that segments share, by brute force; ``same`` pairs the segments of one curve."""
    on = "a.id = b.id AND a.seg < b.seg" if same else "a.id < b.id"
    extra = ", a.seg AS sa, b.seg AS sb, a.n AS n" if same else ""
    return f"""pairs AS (
  SELECT a.id AS ia, b.id AS ib, a.x1 AS ax1, a.y1 AS ay1, a.x2 AS ax2, a.y2 AS ay2, b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2, b.y2 AS by2{extra},
    (b.x2-b.x1)*(a.y1-b.y1) - (a.x1-b.x1)*(b.y2-b.y1) AS d1, (b.x2-b.x1)*(a.y2-b.y1) - (a.x2-b.x1)*(b.y2-b.y1) AS d2,
    (a.x2-a.x1)*(b.y1-a.y1) - (b.x1-a.x1)*(a.y2-a.y1) AS d3, (a.x2-a.x1)*(b.y2-a.y1) - (b.x2-a.x1)*(a.y2-a.y1) AS d4
  FROM {source} a JOIN {source} b ON {on} AND {_MEET}
), shared AS (
  SELECT *, ax1 + d1 / (d1 - d2) * (ax2 - ax1) AS x, ay1 + d1 / (d1 - d2) * (ay2 - ay1) AS y FROM pairs WHERE d1 * d2 < 0 AND d3 * d4 < 0
  UNION ALL SELECT *, ax1, ay1 FROM pairs WHERE d1 = 0 AND ax1 BETWEEN least(bx1,bx2) AND greatest(bx1,bx2) AND ay1 BETWEEN least(by1,by2) AND greatest(by1,by2)
  UNION ALL SELECT *, ax2, ay2 FROM pairs WHERE d2 = 0 AND ax2 BETWEEN least(bx1,bx2) AND greatest(bx1,bx2) AND ay2 BETWEEN least(by1,by2) AND greatest(by1,by2)
  UNION ALL SELECT *, bx1, by1 FROM pairs WHERE d3 = 0 AND bx1 BETWEEN least(ax1,ax2) AND greatest(ax1,ax2) AND by1 BETWEEN least(ay1,ay2) AND greatest(ay1,ay2)
  UNION ALL SELECT *, bx2, by2 FROM pairs WHERE d4 = 0 AND bx2 BETWEEN least(ax1,ax2) AND greatest(ax1,ax2) AND by2 BETWEEN least(ay1,ay2) AND greatest(ay1,ay2)
)"""


_CROSS = (
    _hit_ctes("v_segments", False)
    + """, crossed AS (SELECT DISTINCT ia, ib, round(x, 6) AS x, round(y, 6) AS y FROM shared
  WHERE NOT (((x = ax1 AND y = ay1) OR (x = ax2 AND y = ay2)) AND ((x = bx1 AND y = by1) OR (x = bx2 AND y = by2))))"""
)


def _segs(spark, d):
    return view(spark, d, "v_segments").select("id", "x1", "y1", "x2", "y2")


@query("crossing_points", "SELECT ia AS a_id, ib AS b_id, x, y FROM crossed", ("v_segments",), _CROSS)
def crossing_points(spark, d):
    return joins.crossings(_segs(spark, d))


@query(
    "crossing_points_per_entity",
    """SELECT id, count(*) AS n_points, count(DISTINCT other) AS n_others, min(x) AS min_x, max(y) AS max_y FROM (
         SELECT id, x, y, min(other) AS other FROM (SELECT ia AS id, ib AS other, x, y FROM crossed UNION ALL SELECT ib, ia, x, y FROM crossed) GROUP BY ALL HAVING true)
       GROUP BY id""",
    ("v_segments",),
    _CROSS,
)
def crossing_points_per_entity(spark, d):
    c = joins.crossings(_segs(spark, d))
    both = c.select(F.col("a_id").alias("id"), F.col("b_id").alias("other"), "x", "y").union(c.select("b_id", "a_id", "x", "y"))
    per = both.groupBy("id", "x", "y").agg(F.min("other").alias("other"))
    return per.groupBy("id").agg(
        F.count(F.lit(1)).alias("n_points"), F.countDistinct("other").alias("n_others"), F.min("x").alias("min_x"), F.max("y").alias("max_y")
    )


@query(
    "self_intersections",
    """SELECT DISTINCT ia AS id, round(x, 6) AS x, round(y, 6) AS y FROM shared JOIN (SELECT id, max(seg) AS last FROM segs GROUP BY id) l ON l.id = ia
       WHERE NOT ((sb - sa = 1 AND x = ax2 AND y = ay2) OR (sb - sa <> 1 AND sa = 0 AND sb = last AND x = ax1 AND y = ay1))""",
    _CURVE,
    f"{_RINGS},\n{_SEGS},\n" + _hit_ctes("segs", True),
)
def self_intersections(spark, d):
    return joins.self_crossings(views.segments(_curves(spark, d)))


# --- duplicates -----------------------------------------------------------------------------

_DUPS = """copies AS (SELECT id, pos, x, y FROM v_vertices UNION ALL
  SELECT c.id + 1000000, c.n - 1 - v.pos, v.x, v.y FROM v_vertices v JOIN v_curves c USING (id) WHERE c.id % 4 = 0),
sizes AS (SELECT id, count(*) AS n FROM copies GROUP BY id),
near AS (SELECT a.id AS a_id, b.id AS b_id, count(DISTINCT a.pos) AS ma, count(DISTINCT b.pos) AS mb
  FROM copies a JOIN copies b ON a.id < b.id AND a.x = b.x AND a.y = b.y GROUP BY ALL),
dups AS (SELECT a_id, b_id FROM near JOIN sizes s ON s.id = a_id JOIN sizes t ON t.id = b_id WHERE ma = s.n AND mb = t.n)"""


def _with_copies(spark, d):
    """Every fourth curve a second time, reversed."""
    e = _curves(spark, d)
    again = e.where("id % 4 = 0").withColumns({"id": F.col("id") + 1000000, "vertices": F.reverse("vertices")})
    return e.unionByName(again)


@query("duplicate_entities", "SELECT a_id, b_id FROM dups", _CURVE, _DUPS)
def duplicate_entities(spark, d):
    return checks.duplicate_entity(_with_copies(spark, d))


_REACH = "reach AS (SELECT a_id AS id, b_id AS other FROM {0} UNION SELECT b_id, a_id FROM {0} UNION SELECT r.id, e.other FROM reach r JOIN (SELECT a_id AS id, b_id AS other FROM {0} UNION SELECT b_id, a_id FROM {0}) e ON r.other = e.id)"


@query(
    "duplicate_survivors",
    "SELECT id, least(min(other), id) AS survivor FROM reach GROUP BY id HAVING min(other) < id",
    _CURVE,
    _DUPS + ", " + _REACH.format("dups"),
)
def duplicate_survivors(spark, d):
    e = _with_copies(spark, d)
    return checks.survivors(e, checks.duplicate_entity(e))


@query(
    "vertex_clusters",
    "SELECT id, least(min(other), id) AS anchor FROM reach GROUP BY id",
    ("v_points",),
    "close AS MATERIALIZED (SELECT a.id AS a_id, b.id AS b_id FROM v_points a JOIN v_points b ON a.id < b.id AND abs(a.x-b.x) <= 2 AND abs(a.y-b.y) <= 2 WHERE (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) BETWEEN 1e-9 AND 4), "
    + _REACH.format("close"),
)
def vertex_clusters(spark, d):
    return checks.near_vertices(view(spark, d, "v_points").select("id", "x", "y"), 2.0)


# --- dangling -----------------------------------------------------------------------------------

_ENDS = """tips AS (SELECT id, 0 AS "end", x1 AS x, y1 AS y, x2 AS ox, y2 AS oy FROM v_segments UNION ALL SELECT id, 1, x2, y2, x1, y1 FROM v_segments),
dang AS (SELECT t.* FROM tips t WHERE (x <> ox OR y <> oy) AND (x, y) IN (SELECT (x, y) FROM tips GROUP BY x, y HAVING count(DISTINCT id) = 1))"""


@query("dangling_vertices", 'SELECT id, "end", x, y, ox, oy FROM dang', ("v_segments",), _ENDS)
def dangling_vertices(spark, d):
    return graph.dangling_ends(_segs(spark, d))


@query(
    "undershoots",
    """SELECT id, "end", target, x, y, dist FROM (SELECT *, row_number() OVER (PARTITION BY id, "end" ORDER BY dist, target) AS r FROM (
         SELECT id, "end", target, round(px + t * dx, 6) AS x, round(py + t * dy, 6) AS y, round(t * sqrt(dx*dx + dy*dy), 6) AS dist FROM (
           SELECT *, ((ax-px)*(by_-ay) - (ay-py)*(bx-ax)) / den AS t, ((ax-px)*dy - (ay-py)*dx) / den AS u FROM (
             SELECT p.id, p."end", s.id AS target, p.x AS px, p.y AS py, p.x - p.ox AS dx, p.y - p.oy AS dy, s.x1 AS ax, s.y1 AS ay, s.x2 AS bx, s.y2 AS by_,
               (p.x - p.ox) * (s.y2 - s.y1) - (p.y - p.oy) * (s.x2 - s.x1) AS den
             FROM dang p JOIN v_segments s ON p.id <> s.id AND least(s.x1, s.x2) <= p.x + 2 AND greatest(s.x1, s.x2) >= p.x - 2
               AND least(s.y1, s.y2) <= p.y + 2 AND greatest(s.y1, s.y2) >= p.y - 2) WHERE den <> 0)
         WHERE t > 0 AND u BETWEEN 0 AND 1) WHERE dist <= 2) WHERE r = 1""",
    ("v_segments",),
    _ENDS,
)
def undershoots(spark, d):
    return graph.undershoots(_segs(spark, d), 2.0)


@query(
    "apparent_intersections",
    """SELECT a_id, a_end, b_id, b_end, round(ax + t * adx, 6) AS x, round(ay + t * ady, 6) AS y FROM (
         SELECT *, ((box - ax)*bdy - (boy - ay)*bdx) / (adx*bdy - ady*bdx) AS t, ((aox - bx)*ady - (aoy - by_)*adx) / (bdx*ady - bdy*adx) AS s FROM (
           SELECT a.id AS a_id, a."end" AS a_end, b.id AS b_id, b."end" AS b_end, a.x AS ax, a.y AS ay, a.ox AS aox, a.oy AS aoy, b.x AS bx, b.y AS by_, b.ox AS box, b.oy AS boy,
             a.x - a.ox AS adx, a.y - a.oy AS ady, b.x - b.ox AS bdx, b.y - b.oy AS bdy
           FROM dang a JOIN dang b ON a.id < b.id AND abs(a.x - b.x) <= 4 AND abs(a.y - b.y) <= 4 AND (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) <= 16)
         WHERE adx*bdy - ady*bdx <> 0)
       WHERE t > 0 AND s > 0 AND round(t * sqrt(adx*adx + ady*ady), 6) <= 2 AND round(s * sqrt(bdx*bdx + bdy*bdy), 6) <= 2""",
    ("v_segments",),
    _ENDS,
)
def apparent_intersections(spark, d):
    return graph.apparent_intersections(_segs(spark, d), 2.0)


@query(
    "dangling_chains",
    """SELECT p.id, p.chain, round(sum(q.len), 6) AS chain_length FROM chained p JOIN chained q USING (chain) GROUP BY p.id, p.chain HAVING round(sum(q.len), 6) <= 50""",
    ("v_segments",),
    """line AS MATERIALIZED (SELECT id, x1, y1, x2, y2, sqrt((x2-x1)*(x2-x1) + (y2-y1)*(y2-y1)) AS len FROM v_segments WHERE x1 <> x2 OR y1 <> y2),
tip AS MATERIALIZED (SELECT id, x1 AS x, y1 AS y FROM line UNION ALL SELECT id, x2, y2 FROM line),
gone(id, step) USING KEY (id) AS (SELECT DISTINCT t.id, 0 FROM tip t WHERE (SELECT count(*) FROM tip u WHERE u.x = t.x AND u.y = t.y) = 1 UNION
  (SELECT DISTINCT t.id, g.step + 1 FROM tip t JOIN tip v ON v.x = t.x AND v.y = t.y AND v.id <> t.id JOIN gone g ON g.id = v.id
   WHERE t.id NOT IN (SELECT id FROM recurring.gone) AND (SELECT count(*) FROM tip u WHERE u.x = t.x AND u.y = t.y AND u.id NOT IN (SELECT id FROM recurring.gone)) = 1)),
met AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM tip a JOIN tip b ON a.x = b.x AND a.y = b.y AND a.id <> b.id WHERE a.id IN (SELECT id FROM gone) AND b.id IN (SELECT id FROM gone)),
part(id, chain) USING KEY (id) AS (SELECT id, id FROM gone UNION (SELECT m.b, min(p.chain) FROM part p JOIN met m ON m.a = p.id JOIN recurring.part o ON o.id = m.b WHERE p.chain < o.chain GROUP BY m.b)),
chained AS (SELECT p.id, p.chain, l.len FROM part p JOIN line l USING (id))""",
)
def dangling_chains(spark, d):
    return graph.dangling_chains(_segs(spark, d), 50.0)


# --- polygons ---------------------------------------------------------------------------------------


def _parcels(spark, d):
    return views.parcels_as_entities(view(spark, d, "v_parcels"))


_LAP = """laps AS (SELECT a.id AS a_id, b.id AS b_id, (least(a.maxx, b.maxx) - greatest(a.minx, b.minx)) * (least(a.maxy, b.maxy) - greatest(a.miny, b.miny)) AS area,
  a.minx <= b.minx AND a.miny <= b.miny AND a.maxx >= b.maxx AND a.maxy >= b.maxy AS holds,
  (a.maxx - a.minx) * (a.maxy - a.miny) AS area_a, (b.maxx - b.minx) * (b.maxy - b.miny) AS area_b
  FROM v_parcels a JOIN v_parcels b ON a.id <> b.id AND a.minx <= b.maxx AND b.minx <= a.maxx AND a.miny <= b.maxy AND b.miny <= a.maxy)"""


@query(
    "polygon_overlap",
    "SELECT a_id, b_id, round(area, 6) AS area, 1 AS parts FROM laps WHERE a_id < b_id AND area > 0.001",
    ("v_parcels",),
    _LAP,
)
def polygon_overlap(spark, d):
    return polygons.overlaps(_parcels(spark, d))


@query(
    "polygon_union_area",
    "SELECT a_id, b_id, round(area_a + area_b - area, 6) AS area FROM laps WHERE a_id < b_id AND area > 0.001",
    ("v_parcels",),
    _LAP,
)
def polygon_union_area(spark, d):
    return polygons.overlaps(_parcels(spark, d), operation="union").select("a_id", "b_id", "area")


@query("polygon_include", "SELECT a_id AS outer, b_id AS inner FROM laps WHERE holds", ("v_parcels",), _LAP)
def polygon_include(spark, d):
    return polygons.includes(_parcels(spark, d))


@query(
    "polygon_duplicate",
    """SELECT p.a_id, c.id AS b_id FROM twice c JOIN (SELECT minx, miny, maxx, maxy, min(id) AS a_id FROM twice GROUP BY ALL HAVING count(*) > 1) p
       ON c.minx = p.minx AND c.miny = p.miny AND c.maxx = p.maxx AND c.maxy = p.maxy AND c.id <> p.a_id""",
    ("v_parcels",),
    "twice AS (SELECT * FROM v_parcels UNION ALL SELECT id + 1000000, minx, miny, maxx, maxy FROM v_parcels WHERE id % 5 = 0)",
)
def polygon_duplicate(spark, d):
    """Every fifth parcel a second time, reversed and begun elsewhere."""
    e = _parcels(spark, d)
    ring = F.reverse("vertices")
    again = e.where("id % 5 = 0").withColumns({"id": F.col("id") + 1000000, "vertices": F.concat(F.slice(ring, 3, 2), F.slice(ring, 1, 2))})
    return polygons.duplicates(e.unionByName(again))


@query(
    "polygon_island",
    "SELECT b_id AS id, min(a_id) AS outer FROM laps WHERE holds AND area_a <> area_b AND b_id % 3 <> 0 AND b_id % 7 <> 1 GROUP BY b_id",
    ("v_parcels",),
    _LAP,
)
def polygon_island(spark, d):
    """Every third parcel is flagged; every seventh is an island grouped with one."""
    e = _parcels(spark, d)
    flags = e.where("id % 3 = 0").select("id", F.lit("parcel").alias("flag")).union(e.where("id % 7 = 1 AND id % 3 <> 0").select("id", F.lit("island")))
    groups = e.where("id % 7 = 1 AND id % 3 <> 0").select(F.col("id").alias("group_id"), "id")
    groups = groups.union(groups.select("group_id", F.lit(3).cast("long")))
    return polygons.islands(e, groups, flags)


@query(
    "polygon_gap",
    """SELECT a_id, b_id, count(*) AS n_segments FROM (
         SELECT a.id AS a_id, b.id AS b_id FROM side a JOIN side b ON a.id < b.id AND a.vert = b.vert AND a.off <> b.off AND abs(a.off - b.off) <= 0.25
           AND least(a.hi, b.hi) > greatest(a.lo, b.lo)) GROUP BY ALL""",
    ("v_parcels",),
    """side AS (SELECT id, true AS vert, minx AS off, miny AS lo, maxy AS hi FROM v_parcels UNION ALL SELECT id, true, maxx, miny, maxy FROM v_parcels
  UNION ALL SELECT id, false, miny, minx, maxx FROM v_parcels UNION ALL SELECT id, false, maxy, minx, maxx FROM v_parcels)""",
)
def polygon_gap(spark, d):
    return polygons.gaps(_parcels(spark, d), 0.25)


_DIRECT = _LAP + """, held AS (SELECT a_id, b_id, area_b FROM laps WHERE holds AND (area_a > area_b OR (area_a = area_b AND a_id < b_id))),
direct AS (SELECT * FROM held h WHERE NOT EXISTS (SELECT 1 FROM held x JOIN held y ON x.b_id = y.a_id WHERE x.a_id = h.a_id AND y.b_id = h.b_id))"""


@query(
    "net_area_with_holes",
    """SELECT o.id, round(any_value((o.maxx - o.minx) * (o.maxy - o.miny)) - coalesce(sum(i.area_b), 0), 6) AS net_area, count(i.b_id) AS n_holes
       FROM v_parcels o LEFT JOIN direct i ON i.a_id = o.id GROUP BY o.id""",
    ("v_parcels",),
    _DIRECT,
)
def net_area_with_holes(spark, d):
    """Area less the rings held directly; what these hold in turn is theirs."""
    return polygons.net_areas(_parcels(spark, d))


@query(
    "group_members",
    "SELECT a.c_custkey AS id, b.c_custkey AS member FROM customer a JOIN customer b ON a.c_custkey // 10 = b.c_custkey // 10 AND a.c_custkey <> b.c_custkey AND a.c_custkey % 10 = 0",
)
def group_members(spark, d):
    """Two hops: entity to group, group to its other members."""
    groups = _curves(spark, d).select(F.floor(F.col("id") / 10).cast("long").alias("group_id"), "id")
    lead = groups.where("id % 10 = 0")
    other = groups.withColumnRenamed("id", "member")
    return lead.join(other, "group_id").where("id <> member").select("id", "member")


@query(
    "missing_vertices",
    """SELECT DISTINCT id, x, y FROM (
         SELECT a.id, b.x, b.y FROM v_parcels a JOIN corner b ON a.id <> b.id AND b.x BETWEEN a.minx AND a.maxx AND b.y BETWEEN a.miny AND a.maxy
           AND (b.x IN (a.minx, a.maxx) OR b.y IN (a.miny, a.maxy))
         UNION ALL SELECT a.id, a.off, b.off FROM side a JOIN side b ON a.id <> b.id AND a.vert AND NOT b.vert AND a.off BETWEEN b.lo AND b.hi AND b.off BETWEEN a.lo AND a.hi
         UNION ALL SELECT b.id, a.off, b.off FROM side a JOIN side b ON a.id <> b.id AND a.vert AND NOT b.vert AND a.off BETWEEN b.lo AND b.hi AND b.off BETWEEN a.lo AND a.hi
       ) p WHERE NOT EXISTS (SELECT 1 FROM corner c WHERE c.id = p.id AND c.x = p.x AND c.y = p.y)""",
    ("v_parcels",),
    """corner AS (SELECT id, minx AS x, miny AS y FROM v_parcels UNION ALL SELECT id, maxx, miny FROM v_parcels UNION ALL SELECT id, maxx, maxy FROM v_parcels UNION ALL SELECT id, minx, maxy FROM v_parcels),
side AS (SELECT id, true AS vert, minx AS off, miny AS lo, maxy AS hi FROM v_parcels UNION ALL SELECT id, true, maxx, miny, maxy FROM v_parcels
  UNION ALL SELECT id, false, miny, minx, maxx FROM v_parcels UNION ALL SELECT id, false, maxy, minx, maxx FROM v_parcels)""",
)
def missing_vertices(spark, d):
    return checks.missing_vertices(_parcels(spark, d), 16.0)


@query(
    "crotch_points",
    """SELECT DISTINCT a.id, b.id AS other, a.x, a.y FROM turn a JOIN (SELECT DISTINCT id, x, y FROM turn) b ON a.x = b.x AND a.y = b.y AND a.id <> b.id
       WHERE NOT EXISTS (SELECT 1 FROM turn c WHERE c.id = b.id AND c.x = a.px AND c.y = a.py) OR NOT EXISTS (SELECT 1 FROM turn c WHERE c.id = b.id AND c.x = a.nx AND c.y = a.ny)""",
    (*_CURVE, "v_parcels"),
    _DUPS
    + """, corners AS (SELECT p.id, p.pos, p.x, p.y FROM copies p JOIN v_curves c ON c.id = p.id % 1000000 WHERE closed
  UNION ALL SELECT id + 5000000, k, CASE WHEN k IN (0, 3) THEN minx ELSE maxx END, CASE WHEN k < 2 THEN miny ELSE maxy END FROM v_parcels CROSS JOIN range(4) r(k)),
turn AS (SELECT *, coalesce(lag(x) OVER w, last_value(x) OVER f) AS px, coalesce(lag(y) OVER w, last_value(y) OVER f) AS py, coalesce(lead(x) OVER w, first_value(x) OVER f) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER f) AS ny
  FROM corners WINDOW w AS (PARTITION BY id ORDER BY pos), f AS (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))""",
)
def crotch_points(spark, d):
    return checks.crotch_points(_with_copies(spark, d).unionByName(_parcels(spark, d).withColumn("id", F.col("id") + 5000000)))


_REGIONS = """near AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM v_parcels a JOIN v_parcels b ON a.id <> b.id AND a.minx <= b.maxx AND b.minx <= a.maxx AND a.miny <= b.maxy AND b.miny <= a.maxy
  AND (least(a.maxx, b.maxx) > greatest(a.minx, b.minx) OR least(a.maxy, b.maxy) > greatest(a.miny, b.miny))),
region(id, component) USING KEY (id) AS (SELECT id, id FROM v_parcels UNION
  (SELECT near.b, min(r.component) FROM region r JOIN near ON r.id = near.a JOIN recurring.region o ON o.id = near.b WHERE r.component < o.component GROUP BY near.b))"""


@query("connected_regions", "SELECT id, component FROM region", ("v_parcels",), _REGIONS)
def connected_regions(spark, d):
    return polygons.regions(_parcels(spark, d))


@query("partition_contours")
def partition_contours(spark, d):
    return polygons.region_contours(_parcels(spark, d)).select("component", "n_rings", "area", F.size("contour").alias("n_vertices"), "n_holes", "hole_area")


@query("polygonize")
def polygonize(spark, d):
    return polygons.polygonized(_segs(spark, d))


_HULL = """spot AS (SELECT DISTINCT id, x, y FROM v_vertices),
side AS (SELECT p.id, p.x AS ax, p.y AS ay, q.x AS bx, q.y AS by_ FROM spot p JOIN spot q ON p.id = q.id AND (p.x <> q.x OR p.y <> q.y)
  WHERE NOT EXISTS (SELECT 1 FROM spot r WHERE r.id = p.id AND ((q.x-p.x)*(r.y-p.y) - (r.x-p.x)*(q.y-p.y) < 0
    OR ((q.x-p.x)*(r.y-p.y) - (r.x-p.x)*(q.y-p.y) = 0 AND ((r.x-p.x)*(q.x-p.x) + (r.y-p.y)*(q.y-p.y) < 0 OR (r.x-q.x)*(p.x-q.x) + (r.y-q.y)*(p.y-q.y) < 0))))),
hull AS (SELECT id, count(*) AS n, sum(ax * by_ - bx * ay) / 2 AS area FROM side GROUP BY id)"""


@query(
    "convex_hull",
    "SELECT s.id, coalesce(any_value(h.n), 1)::INT AS n_hull, round(abs(coalesce(any_value(h.area), 0)), 6) AS hull_area FROM spot s LEFT JOIN hull h USING (id) GROUP BY s.id",
    _CURVE,
    _HULL,
)
def convex_hull(spark, d):
    return polygons.hulls(_curves(spark, d))


@query(
    "min_rectangle",
    """SELECT id, round(coalesce(min(rect), 0), 6) AS rect_area FROM (SELECT DISTINCT id FROM spot) LEFT JOIN (
         SELECT s.id, s.ax, s.ay, s.bx, (max((p.x-ax)*(bx-ax) + (p.y-ay)*(by_-ay)) - min((p.x-ax)*(bx-ax) + (p.y-ay)*(by_-ay)))
             * (max((p.y-ay)*(bx-ax) - (p.x-ax)*(by_-ay)) - min((p.y-ay)*(bx-ax) - (p.x-ax)*(by_-ay))) / ((bx-ax)*(bx-ax) + (by_-ay)*(by_-ay)) AS rect
         FROM side s JOIN hull h ON h.id = s.id AND h.n >= 3 JOIN spot p ON p.id = s.id GROUP BY s.id, ax, ay, bx, by_) USING (id) GROUP BY id""",
    _CURVE,
    _HULL,
)
def min_rectangle(spark, d):
    return polygons.min_rectangles(_curves(spark, d))


@query(
    "simplify",
    """SELECT c.id, c.n AS n_before, (SELECT count(DISTINCT k) FROM (SELECT i AS k FROM chord s WHERE s.id = c.id UNION ALL SELECT j FROM chord s WHERE s.id = c.id))::INT AS n_after FROM v_curves c""",
    _CURVE,
    """away AS MATERIALIZED (SELECT a.id, a.pos AS i, b.pos AS j, p.pos AS k, CASE WHEN a.x = b.x AND a.y = b.y THEN sqrt(pow(p.x-a.x, 2) + pow(p.y-a.y, 2))
    ELSE abs((b.x-a.x)*(p.y-a.y) - (p.x-a.x)*(b.y-a.y)) / sqrt(pow(b.x-a.x, 2) + pow(b.y-a.y, 2)) END AS d
  FROM v_vertices a JOIN v_vertices b ON a.id = b.id AND a.pos < b.pos JOIN v_vertices p ON p.id = a.id AND p.pos > a.pos AND p.pos < b.pos),
furthest AS MATERIALIZED (SELECT id, i, j, k FROM (SELECT *, row_number() OVER (PARTITION BY id, i, j ORDER BY d DESC, k) AS r FROM away) WHERE r = 1 AND d > 1.0),
chord(id, i, j) AS (SELECT id, 0, n - 1 FROM v_curves UNION ALL SELECT f.id, unnest([f.i, f.k]), unnest([f.k, f.j]) FROM chord c JOIN furthest f ON f.id = c.id AND f.i = c.i AND f.j = c.j)""",
)
def simplify(spark, d):
    return polygons.simplified(_curves(spark, d), 1.0)


@query(
    "polygon_offset",
    "SELECT id, round((maxx - minx + 1) * (maxy - miny + 1), 6) AS grown_area FROM v_parcels",
    ("v_parcels",),
)
def polygon_offset(spark, d):
    return polygons.offsets(_parcels(spark, d), 0.5)


# --- constructors, fixes -------------------------------------------------------------------------------


@query(
    "split_at_points",
    """SELECT * FROM (
         SELECT id, (row_number() OVER w - 1)::INT AS piece, round(x, 6) AS x1, round(y, 6) AS y1, round(lead(x) OVER w, 6) AS x2, round(lead(y) OVER w, 6) AS y2
         FROM stops WINDOW w AS (PARTITION BY id ORDER BY t)) WHERE x2 IS NOT NULL""",
    ("v_segments",),
    _CROSS
    + """, cuts AS (SELECT DISTINCT id, x, y FROM (SELECT ia AS id, x, y FROM crossed UNION ALL SELECT ib, x, y FROM crossed)),
placed AS (SELECT s.id, c.x, c.y, ((c.x - x1) * (x2 - x1) + (c.y - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS t
  FROM cuts c JOIN v_segments s USING (id) WHERE x1 <> x2 OR y1 <> y2),
stops AS (SELECT id, x, y, t FROM placed WHERE t > 1e-6 AND t < 1 - 1e-6 UNION ALL SELECT id, x1, y1, 0 FROM v_segments UNION ALL SELECT id, x2, y2, 1 FROM v_segments)""",
)
def split_at_points(spark, d):
    """Break crossings: every segment cut where others cross it."""
    segs = _segs(spark, d)
    c = joins.crossings(segs)
    cuts = c.select(F.explode(F.array("a_id", "b_id")).alias("id"), "x", "y").distinct()
    out = checks.split_lines(segs, cuts)
    return out.select("id", "piece", *[F.round(k, 6).alias(k) for k in ("x1", "y1", "x2", "y2")])


@query(
    "extend_undershoots",
    f"""SELECT s.id, coalesce(a.x, s.x1) AS x1, coalesce(a.y, s.y1) AS y1, coalesce(b.x, s.x2) AS x2, coalesce(b.y, s.y2) AS y2 FROM v_segments s
       LEFT JOIN ({ORACLES["undershoots"][ORACLES["undershoots"].index('SELECT id, "end", target'):]}) a ON a.id = s.id AND a."end" = 0
       LEFT JOIN ({ORACLES["undershoots"][ORACLES["undershoots"].index('SELECT id, "end", target'):]}) b ON b.id = s.id AND b."end" = 1""",
    ("v_segments",),
    _ENDS,
)
def extend_undershoots(spark, d):
    segs = _segs(spark, d)
    return checks.extend_lines(segs, graph.undershoots(segs, 2.0))


_CLIP = """slab AS (SELECT *, x2 - x1 AS dx, y2 - y1 AS dy FROM v_segments WHERE x1 <> x2 OR y1 <> y2),
lim AS (SELECT *, CASE WHEN dx <> 0 THEN least((500 - x1) / dx, (1500 - x1) / dx) WHEN x1 BETWEEN 500 AND 1500 THEN 0 ELSE 2 END AS ax,
  CASE WHEN dx <> 0 THEN greatest((500 - x1) / dx, (1500 - x1) / dx) WHEN x1 BETWEEN 500 AND 1500 THEN 1 ELSE -1 END AS bx,
  CASE WHEN dy <> 0 THEN least((500 - y1) / dy, (1500 - y1) / dy) WHEN y1 BETWEEN 500 AND 1500 THEN 0 ELSE 2 END AS ay,
  CASE WHEN dy <> 0 THEN greatest((500 - y1) / dy, (1500 - y1) / dy) WHEN y1 BETWEEN 500 AND 1500 THEN 1 ELSE -1 END AS by_ FROM slab),
span AS (SELECT *, greatest(ax, ay, 0) AS t0, least(bx, by_, 1) AS t1 FROM lim)"""
_PART = "SELECT id, round(x1 + {0} * dx, 6) AS x1, round(y1 + {0} * dy, 6) AS y1, round(x1 + {1} * dx, 6) AS x2, round(y1 + {1} * dy, 6) AS y2 FROM span WHERE {2}"


def _trimmed(spark, d, inside):
    return checks.trim_lines(_segs(spark, d).where("x1 <> x2 OR y1 <> y2"), (500.0, 500.0, 1500.0, 1500.0), inside)


@query("trim_parts_by_extents", _PART.format("t0", "t1", "t0 < t1"), ("v_segments",), _CLIP)
def trim_parts_by_extents(spark, d):
    """Parts inside a box of all segments; those that cross the border are cut at it."""
    return _trimmed(spark, d, True)


@query(
    "trim_parts_outside_extents",
    " UNION ALL ".join([_PART.format("0", "1", "t0 >= t1"), _PART.format("0", "t0", "t0 < t1 AND t0 > 0"), _PART.format("t1", "1", "t0 < t1 AND t1 < 1")]),
    ("v_segments",),
    _CLIP,
)
def trim_parts_outside_extents(spark, d):
    return _trimmed(spark, d, False)


@query(
    "affine_array",
    "SELECT id, k::INT AS copy, pos, -y + 10.0 * k AS x, x + 5.0 * k AS y FROM v_vertices CROSS JOIN range(3) r(k)",
    _CURVE,
)
def affine_array(spark, d):
    """Three copies, each turned by a right angle and moved on."""
    e = _curves(spark, d).select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("copy"))
    turned = e.withColumn("vertices", g.affine(F.col("vertices"), 0.0, -1.0, 1.0, 0.0, 10.0 * F.col("copy"), 5.0 * F.col("copy")))
    return turned.select("id", "copy", F.posexplode("vertices").alias("pos", "v")).select("id", "copy", "pos", "v.x", "v.y")


@query("fix_erase_short", "SELECT id FROM v_segments WHERE (x2-x1)*(x2-x1) + (y2-y1)*(y2-y1) > 0.25", ("v_segments",))
def fix_erase_short(spark, d):
    e = views.lines_as_entities(view(spark, d, "v_segments"))
    return checks.erase(e, checks.short(e, 0.5)).select("id")


@query("fix_anticlockwise", "SELECT id, round(-abs(shoelace), 6) + 0.0 AS area FROM curve WHERE closed", _CURVE, _RINGS)
def fix_anticlockwise(spark, d):
    """Closed curves after the fix: none runs anticlockwise."""
    e = _curves(spark, d)
    return checks.reverse(e, checks.anticlockwise(e)).where("closed").select("id", (F.round(g.signed_area(F.col("vertices")), 6) + 0.0).alias("area"))


@query(
    "finding_counts",
    """SELECT action_type, count(*) AS n FROM (
         SELECT 'UnclosedPolygon' AS action_type FROM curve WHERE NOT closed UNION ALL SELECT 'NoneZeroElevation' FROM curve WHERE elevation <> 0
         UNION ALL SELECT 'ArcSegment' FROM curve WHERE arcs > 0 UNION ALL SELECT 'AntiClockwisePolygon' FROM curve WHERE closed AND shoelace >= 0) GROUP BY ALL""",
    _CURVE,
    _RINGS,
)
def finding_counts(spark, d):
    found = checks.run_checks(_curves(spark, d), ("UnclosedPolygon", "NoneZeroElevation", "ArcSegment", "AntiClockwisePolygon"))
    return found.groupBy("action_type").agg(F.count(F.lit(1)).alias("n"))


@query("clean_sequence")
def clean_sequence(spark, d):
    names = ("NoneZeroElevation", "ArcSegment", "DuplicateVertexPline", "ZeroAreaLoop", "ZeroLength", "EraseShort", "AntiClockwisePolygon")
    out = checks.clean(_curves(spark, d), names)
    return out.select("id", "closed", "elevation", F.size("vertices").alias("n_vertices"), F.round(g.signed_area(F.col("vertices")), 6).alias("area"))


# --- floor plan, units -----------------------------------------------------------------------------------


@query("window_groups")
def window_groups(spark, d):
    return floorplan.window_groups(views.segments(_parcels(spark, d)))


@query(
    "wall_candidates",
    """SELECT a.sid AS id, b.sid AS inner_id, abs(a.off - b.off) AS dist, least(a.hi, b.hi) - greatest(a.lo, b.lo) AS overlap
         FROM side a JOIN side b ON a.sid <> b.sid AND a.vert = b.vert AND a.off <> b.off AND abs(a.off - b.off) < 2 AND least(a.hi, b.hi) > greatest(a.lo, b.lo)""",
    ("v_parcels",),
    """side AS (SELECT id * 8 + 3 AS sid, true AS vert, minx AS off, miny AS lo, maxy AS hi FROM v_parcels UNION ALL SELECT id * 8 + 1, true, maxx, miny, maxy FROM v_parcels
  UNION ALL SELECT id * 8, false, miny, minx, maxx FROM v_parcels UNION ALL SELECT id * 8 + 2, false, maxy, minx, maxx FROM v_parcels)""",
)
def wall_candidates(spark, d):
    segs = views.segments(_parcels(spark, d)).withColumn("id", F.col("id") * 8 + F.col("seg"))
    return floorplan.wall_pairs(segs, segs, 2.0)


@query("apartment_contour")
def apartment_contour(spark, d):
    """Undershoots of the same lines are looked for as far as in ``undershoots``; within the drawing's 0.001 there are none on their lattice."""
    return floorplan.apartment_contour(_segs(spark, d), 2.0)


@query(
    "unit_convert",
    "SELECT p_partkey AS id, round(p_size::DOUBLE * 3.2808398950131::DOUBLE, 6) AS feet, round(p_size::DOUBLE * 1000, 6) AS millimeters, round(p_size / 3.6, 6) AS mps FROM part",
)
def unit_convert(spark, d):
    size = F.col("p_size").cast("double")
    return spark.read.parquet(f"{d}/part.parquet").select(
        F.col("p_partkey").alias("id"),
        F.round(units.convert(size, "length", "meter", "foot"), 6).alias("feet"),
        F.round(units.convert(size, "length", "meter", "millimeter"), 6).alias("millimeters"),
        F.round(units.convert(size, "speed", "kilometer_per_hour", "meter_per_second"), 6).alias("mps"),
    )
