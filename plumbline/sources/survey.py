"""Survey-point text: ``name,code,y,x`` per line, no header, no quoting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Offset and height of an annotation at scale 1.
OFFSET_X, OFFSET_Y, HEIGHT = 0.25, -0.375, 1.0


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "line")


def parse(lines: DataFrame) -> DataFrame:
    """name, code, x, y of lines with four fields or more and numeric coordinates; the third field is y.

    Other columns of ``lines`` are kept.
    """
    f = F.split("line", ",")
    number = lambda k: F.expr(f"try_cast(split(line, ',')[{k}] AS DOUBLE)")
    return (
        lines.where(F.size(f) >= 4)
        .select(*[c for c in lines.columns if c != "line"], f[0].alias("name"), f[1].alias("code"), number(3).alias("x"), number(2).alias("y"))
        .where("x IS NOT NULL AND y IS NOT NULL")
    )


def annotate(points: DataFrame, show: str = "name", map_scale: float = 1000.0) -> DataFrame:
    """Points plus the text beside them: ``label`` (name or code; none for 'none'), its place and height."""
    s = map_scale / 1000
    label = F.col(show) if show in ("name", "code") else F.lit(None).cast("string")
    return points.select(
        "*", label.alias("label"), (F.col("x") + OFFSET_X * s).alias("label_x"), (F.col("y") + OFFSET_Y * s).alias("label_y"), F.lit(HEIGHT * s).alias("height")
    )
