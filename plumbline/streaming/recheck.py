"""Row checks over a stream of entities: each micro-batch is checked as it comes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from plumbline.operators import checks

#: Checks that look at one entity at a time hold for any split of the input.
ROW_CHECKS = (
    "NoneZeroElevation", "ArcSegment", "DuplicateVertexPline", "ZeroAreaLoop", "ZeroLength", "EraseShort", "UnclosedPolygon",
    "SmallPolygon", "AntiClockwisePolygon", "SharpCornerPolygon",
)


def recheck(stream: DataFrame, sink: str, checkpoint: str, names: tuple[str, ...] = ROW_CHECKS) -> StreamingQuery:
    """Writes the findings of each micro-batch as Parquet, once per batch number."""

    def one(batch: DataFrame, number: int) -> None:
        checks.run_checks(batch, names).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()
