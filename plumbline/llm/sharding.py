"""Minimax contiguous sharding of atomic groups.

Groups of equal texts lie in the order of their SHA-256, so a shard is an
interval of keys.  The smallest feasible capacity is binary-searched over a
digest of key-prefix cells, checked greedily.  For the capacities still possible
each cut has a first and a last place it may fall; only cells between those are
split, by one hex digit a round.  A place is as wide as the cells around it, so
the number of cells that a round splits follows the square of the number of
shards and not the number of groups.  The driver holds cells, never groups, and
a row's shard is a comparison of its key with the cuts: no join, no shuffle.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.staging import Workspace

ROW_BYTES = 16
FIRST_DIGITS = 3
BUCKET_ROWS = 50_000
#: A cell above this share of the least capacity is split before places of cuts are worked out.
COARSE = 64


@dataclass(frozen=True)
class Cell:
    """The groups whose keys begin with ``prefix``; ``atomic`` if that is one group."""

    prefix: str
    size: int
    atomic: bool


def _reach(ends: list[int], cells: list[Cell], at: int, capacity: int, fluid: bool) -> int:
    """Where the shard that begins at offset ``at`` ends: whole cells only, or cells of several groups poured like water."""
    goal = at + capacity
    if goal >= ends[-1]:
        return ends[-1]
    k = bisect_right(ends, goal)
    return goal if fluid and not cells[k].atomic else max(at, ends[k - 1] if k else 0)


def greedy_shards(cells: list[Cell], ends: list[int], capacity: int, shards: int, fluid: bool = False) -> int:
    """Shards that a left-to-right packing needs, or more than ``shards`` as soon as that is sure."""
    at, n = 0, 0
    while at < ends[-1]:
        to = _reach(ends, cells, at, capacity, fluid)
        if n == shards or to == at:
            return shards + 1
        at, n = to, n + 1
    return n


def smallest(feasible, lo: int, hi: int) -> int:
    """Smallest capacity in [lo, hi] that is feasible; hi must be."""
    while lo < hi:
        mid = (lo + hi) // 2
        if feasible(mid):
            hi = mid
        else:
            lo = mid + 1
    return lo


def bounds(cells: list[Cell], shards: int) -> tuple[int, int]:
    """The smallest capacity lies between these; they meet once the digest is fine enough."""
    ends = list(accumulate(c.size for c in cells))
    lo = smallest(lambda x: greedy_shards(cells, ends, x, shards, fluid=True) <= shards, -(-ends[-1] // shards), ends[-1])
    hi = smallest(lambda x: greedy_shards(cells, ends, x, shards) <= shards, lo, ends[-1])
    return lo, hi


def undecided(cells: list[Cell], shards: int, lo: int, hi: int) -> list[tuple[int, int]]:
    """Runs of cells (first, last) in which a cut may fall for some capacity in [lo, hi].

    Whole cells packed to the least capacity give the first place of each cut,
    poured cells packed to the largest give the last.  Cells that are large for a
    shard, of which there are few, leave these places far apart and go first.
    """
    large = [k for k, c in enumerate(cells) if not c.atomic and COARSE * c.size > lo]
    if large:
        held = set(large)
        first, last = [k for k in large if k - 1 not in held], [k for k in large if k + 1 not in held]
        return list(zip(first, last, strict=True))
    ends = list(accumulate(c.size for c in cells))
    low, high, runs = 0, 0, []
    for _ in range(shards):
        low, high = _reach(ends, cells, low, lo, False), _reach(ends, cells, high, hi, True)
        a, b = bisect_right(ends, low), min(bisect_left(ends, high), len(cells) - 1)
        if a <= b:
            if runs and a <= runs[-1][1] + 1:
                runs[-1] = (runs[-1][0], max(b, runs[-1][1]))
            else:
                runs.append((a, b))
    return [(a, b) for a, b in runs if not all(c.atomic for c in cells[a : b + 1])]


def balanced_cuts(sizes: list[int], shards: int, capacity: int) -> list[int]:
    """First cell of shards 1..: near-equal sizes, none above the capacity."""
    ends = [0, *accumulate(sizes)]
    n, latest = len(sizes), [len(sizes)] * (shards + 1)
    for k in range(shards - 1, -1, -1):  # earliest start from which the rest fits
        at = latest[k + 1]
        while at > 0 and ends[latest[k + 1]] - ends[at - 1] <= capacity:
            at -= 1
        latest[k] = at
    cuts, at = [], 0
    for k in range(1, shards):
        target = ends[at] + (ends[n] - ends[at]) / (shards - k + 1)
        far = bisect_right(ends, ends[at] + capacity) - 1
        best = bisect_right(ends, target) - 1
        if best < n and ends[best + 1] - target < target - ends[best]:
            best += 1
        at = max(at, min(max(best, latest[k]), far, n))
        cuts.append(at)
    return cuts


def text_key(text: Column) -> Column:
    """Equal texts and only they share a key; rows without a text are one group, which comes first."""
    return F.coalesce(F.sha2(text, 256), F.lit(""))


def _digest(keyed: DataFrame, cell: Column) -> list[Cell]:
    rows = (
        keyed.groupBy(cell.alias("prefix"))
        .agg(F.sum("size").alias("size"), (F.min("hash") == F.max("hash")).alias("atomic"))
        .where(F.col("prefix").isNotNull())
        .collect()
    )
    return [Cell(r.prefix, r.size, r.atomic) for r in rows]


def _finer(keyed: DataFrame, cells: list[Cell], runs: list[tuple[int, int]]) -> list[Cell]:
    """The digest with the cells of each run replaced by cells of one digit more, in one job.

    Cells go to the rows as a table: a condition per run makes an expression as deep as there are runs.
    """
    finer, gone = [], set()
    for a, b in runs:
        split = [k for k in range(a, b + 1) if not cells[k].atomic]
        digits = max(len(cells[k].prefix) for k in split) + 1
        finer += [(cells[k].prefix, digits) for k in split]
        gone |= set(split)
    named = F.broadcast(keyed.sparkSession.createDataFrame(finer, "prefix string, digits int"))
    lengths = sorted({len(prefix) for prefix, _ in finer})
    starts = F.explode(F.array(*[F.substring("key", 1, n) for n in lengths]))  # a key begins with one cell's prefix at most
    inside = keyed.where("key <> ''").select("key", "hash", "size", starts.alias("prefix")).join(named, "prefix").drop("prefix")
    kept = [c for k, c in enumerate(cells) if k not in gone]
    return sorted(kept + _digest(inside, F.expr("substring(key, 1, digits)")), key=lambda c: c.prefix)


def plan_cuts(keyed: DataFrame, shards: int) -> tuple[int, list[str]]:
    """(smallest capacity, key prefixes at which shards 1, 2, ... begin) for rows of key, its hash, and size."""
    cells = sorted(_digest(keyed, F.substring("key", 1, FIRST_DIGITS)), key=lambda c: c.prefix)
    if not cells:
        return 0, []
    while True:
        lo, hi = bounds(cells, shards)
        if lo == hi:
            break
        cells = _finer(keyed, cells, undecided(cells, shards, lo, hi))
    cuts = balanced_cuts([c.size for c in cells], shards, lo)
    beyond = "g"  # after every hex digit: an empty shard
    return lo, [cells[k].prefix if k < len(cells) else beyond for k in cuts]


def shard_by_bytes(
    docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", work: Workspace | None = None
) -> DataFrame:
    """Deals rows into contiguous shards of equal-text groups with the least possible largest shard.

    Returns id, size, text_crc32, shard, slot (gapless from 0 in each shard,
    ordered by bucket of the id, then id) and the shard capacity.  A null text
    has size 16, CRC 0, and forms one group with other nulls; an empty text is a
    group of its own.  Null ids are dealt as well.  Repeated rows each get a
    slot; ties of one id are broken by CRC and size.  A text above the capacity
    of an even deal makes a shard of its own size.  An empty table gives an empty
    result.  Other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    work = work or Workspace(spark, "shard")
    text = F.col(text_col)
    keyed = work.stage(
        docs.select(
            F.col(id_col).alias("id"),
            (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(ROW_BYTES)).alias("size"),
            F.crc32(F.coalesce(text, F.lit(""))).alias("crc"),
            text_key(text).alias("key"),
        ).withColumn("hash", F.xxhash64("key")),
        "keyed",
    )
    capacity, cuts = plan_cuts(keyed, shards)
    shard = F.lit(0)
    for prefix in cuts:
        shard = shard + (F.col("key") >= F.lit(prefix)).cast("int")
    buckets = max(8, -(-keyed.count() // (shards * BUCKET_ROWS)))
    dealt = keyed.select(
        "id", "size", "crc", shard.alias("shard"), F.pmod(F.xxhash64("id"), F.lit(buckets)).alias("bucket")
    )
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        dealt.groupBy("shard", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    inside = Window.partitionBy("shard", "bucket").orderBy("id", "crc", "size")
    return (
        dealt.withColumn("rank", F.row_number().over(inside) - 1)
        .join(offsets, ["shard", "bucket"])
        .select(
            F.col("id").alias(id_col),
            "size",
            F.col("crc").alias("text_crc32"),
            "shard",
            (F.col("offset") + F.col("rank")).cast("long").alias("slot"),
            F.lit(capacity).cast("long").alias("capacity"),
        )
    )


def op1_shard_minimax(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard_by_bytes(docs, 40).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "capacity",
    )
