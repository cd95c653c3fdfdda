"""Geometry views over the driver's tables, in SQL that Spark and DuckDB both run.

Coordinates lie on a quarter-unit lattice, so sums and products are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VIEWS = {
    "v_points": """SELECT event_id AS id,
  CAST((event_id*7919 + user_id*104729) % 4000 AS DOUBLE)/4 AS x, CAST((event_id*6151 + user_id*31) % 4000 AS DOUBLE)/4 AS y
FROM events""",
    "v_segments": """SELECT o_orderkey AS id, CAST(o_custkey % 25 AS BIGINT) AS layer_id,
  CAST((o_orderkey*7919) % 8000 AS DOUBLE)/4 AS x1, CAST((o_custkey*6151 + o_orderkey*13) % 8000 AS DOUBLE)/4 AS y1,
  CAST((o_orderkey*7919) % 8000 + (o_orderkey*37) % 41 - 20 AS DOUBLE)/4 AS x2,
  CAST((o_custkey*6151 + o_orderkey*13) % 8000 + (o_custkey*53) % 41 - 20 AS DOUBLE)/4 AS y2
FROM orders""",
    "v_parcels": """SELECT p_partkey AS id,
  CAST((p_partkey*7919) % 4000 AS DOUBLE)/4 AS minx, CAST((p_partkey*6151) % 4000 AS DOUBLE)/4 AS miny,
  CAST((p_partkey*7919) % 4000 + 4 + (p_partkey*37) % 60 + CASE WHEN p_partkey % 20 = 0 THEN 400 ELSE 0 END AS DOUBLE)/4 AS maxx,
  CAST((p_partkey*6151) % 4000 + 4 + (p_partkey*53) % 60 + CASE WHEN p_partkey % 20 = 0 THEN 400 ELSE 0 END AS DOUBLE)/4 AS maxy
FROM part""",
    "v_layers": """SELECT CAST(n_nationkey AS BIGINT) AS layer_id, n_name AS layer,
  n_nationkey % 5 = 0 AS is_off, n_nationkey % 7 = 0 AS is_frozen FROM nation""",
    "v_spread_lines": """SELECT s_suppkey AS line_no,
  CASE WHEN s_suppkey % 10 = 0 THEN s_name
       WHEN s_suppkey % 7 = 0 THEN concat(s_name, ',C', CAST(s_suppkey % 4 AS VARCHAR(10)), ',bad,1.5')
       ELSE concat(s_name, ',C', CAST(s_suppkey % 4 AS VARCHAR(10)), ',',
            CAST(s_suppkey*3 % 500 AS VARCHAR(10)), '.25,', CAST(s_suppkey*7 % 500 AS VARCHAR(10)), '.5') END AS line
FROM supplier""",
    # polylines of three to six vertices: every tenth repeats its first vertex, every third is closed
    "v_curves": """SELECT c_custkey AS id, CAST(c_custkey % 25 AS BIGINT) AS layer_id, c_custkey % 3 = 0 AS closed,
  CAST(3 + c_custkey % 4 AS INT) AS n, CASE WHEN c_custkey % 9 = 0 THEN 2.5 ELSE 0.0 END AS elevation FROM customer""",
    "v_vertices": """SELECT c.id, CAST(k.k AS INT) AS pos,
  CAST((c.id*7919) % 4000 + (CASE WHEN c.id % 25 = 0 THEN 0 ELSE (c.id*37 + v.v*v.v*(c.id % 13 + 1)*5) % 61 - 30 END) AS DOUBLE)/4 AS x,
  CAST((c.id*6151) % 4000 + (c.id*53 + v.v*(c.id % 17 + 2)*7) % 53 - 26 AS DOUBLE)/4 AS y,
  CASE WHEN c.id % 7 = 0 AND k.k = 1 THEN 1.0 ELSE 0.0 END AS bulge
FROM v_curves c JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5) k
  ON k.k < c.n
CROSS JOIN LATERAL (SELECT CASE WHEN c.id % 10 = 0 AND k.k = 1 THEN 0 ELSE k.k END AS v) v""",
}
BASE = {
    "v_points": "events", "v_segments": "orders", "v_parcels": "part", "v_layers": "nation", "v_spread_lines": "supplier",
    "v_curves": "customer",
}


def oracle_prelude(*names: str) -> str:
    """The views as common table expressions."""
    wanted = [n for n in VIEWS if n in names or (n == "v_curves" and "v_vertices" in names)]
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in wanted)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "v_vertices":
        return vertices(curves(spark, sf_dir))
    table = BASE[name]
    source = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spark.sql(VIEWS[name].replace(f"FROM {table}", "FROM {t}").replace("VARCHAR(10)", "STRING"), t=source)


def curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities (id, layer_id, kind, closed, elevation, vertices): the vertices of v_vertices as an array, no shuffle."""
    c = view(spark, sf_dir, "v_curves")
    k = lambda k: F.when((F.col("id") % 10 == 0) & (k == 1), F.lit(0)).otherwise(k)
    ident = F.col("id")

    def vertex(pos):
        v = k(pos)
        dx = F.when(ident % 25 == 0, F.lit(0)).otherwise((ident * 37 + v * v * (ident % 13 + 1) * 5) % 61 - 30)
        dy = (ident * 53 + v * (ident % 17 + 2) * 7) % 53 - 26
        return F.struct(
            (((ident * 7919) % 4000 + dx).cast("double") / 4).alias("x"),
            (((ident * 6151) % 4000 + dy).cast("double") / 4).alias("y"),
            F.when((ident % 7 == 0) & (pos == 1), 1.0).otherwise(0.0).alias("bulge"),
        )

    return c.select(
        "id", "layer_id", F.lit("POLYLINE").alias("kind"), "closed", F.col("elevation").cast("double").alias("elevation"),
        F.transform(F.sequence(F.lit(0), F.col("n") - 1), vertex).alias("vertices"),
    )


def vertices(entities: DataFrame) -> DataFrame:
    """One row per vertex: id, pos, x, y, bulge."""
    return entities.select("id", F.posexplode("vertices").alias("pos", "v")).select("id", "pos", "v.x", "v.y", "v.bulge")


def segments(entities: DataFrame) -> DataFrame:
    """One row per straight segment: id, seg, x1, y1, x2, y2; a closed curve has its closing segment too.

    The closing segment is left out where the ends coincide.
    """
    n = F.size("vertices")
    last = F.when(F.col("closed") & (F.col("vertices")[0] != F.element_at("vertices", -1)), n - 1).otherwise(n - 2)
    seg = lambda i: F.struct(
        i.alias("seg"),
        F.get("vertices", i).alias("a"),
        F.get("vertices", F.when(i == n - 1, F.lit(0)).otherwise(i + 1)).alias("b"),
    )
    return (
        entities.where(n >= 2)
        .select("id", F.explode(F.transform(F.sequence(F.lit(0), last), seg)).alias("s"))
        .select("id", "s.seg", F.col("s.a.x").alias("x1"), F.col("s.a.y").alias("y1"), F.col("s.b.x").alias("x2"), F.col("s.b.y").alias("y2"))
    )


def lines_as_entities(lines: DataFrame) -> DataFrame:
    """Entities of kind LINE from rows of id, layer_id, x1, y1, x2, y2."""
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"), F.lit(0.0).alias("bulge"))
    return lines.select(
        "id", "layer_id", F.lit("LINE").alias("kind"), F.lit(False).alias("closed"), F.lit(0.0).alias("elevation"),
        F.array(point("x1", "y1"), point("x2", "y2")).alias("vertices"),
    )


def parcels_as_entities(parcels: DataFrame) -> DataFrame:
    """Closed rings, counter-clockwise from the lower left corner, from rows of id and box."""
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"), F.lit(0.0).alias("bulge"))
    ring = F.array(point("minx", "miny"), point("maxx", "miny"), point("maxx", "maxy"), point("minx", "maxy"))
    return parcels.select(
        "id", F.lit(0).cast("long").alias("layer_id"), F.lit("POLYLINE").alias("kind"), F.lit(True).alias("closed"),
        F.lit(0.0).alias("elevation"), ring.alias("vertices"),
    )
