"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact check.

For each item a document has windows of as many words.  Windows that hold no
shingle of any item cannot be similar to one, so windows begin where an item's
shingle occurs, and are compared with the items that have that shingle.  That
loses nothing: a similar window moved right to its first such shingle (or to the
end of the text) holds the same ones or more.

A window's 64-bit SimHash is cut into RADIUS + 1 blocks.  Two fingerprints within
RADIUS bits agree in at least one block, so joining on (item, block number,
block value) finds all of them; the item in the key keeps the blocks, which are
short, from meeting every item of the benchmark.  Shingles count with the number
of their occurrence, so the weighted similarity of two windows is the similarity
of two sets, which both the fingerprint and the exact check then see.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PERCENT = 75
BITS = 64
#: Similarity 0.75 means 11 expected differing bits, deviation 3: this is four above.
RADIUS = 23
SHINGLE = 5
#: Benchmarks of so many shingles at most have their tables broadcast (about 20 MB); larger ones are joined by shuffle.
BLOCK_SHINGLES = 100_000
SPACE = r"[\x20\x09-\x0D]+"


def _blocks() -> list[tuple[int, int]]:
    """(offset, width) of the RADIUS + 1 blocks."""
    n = RADIUS + 1
    cuts = [k * BITS // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


BLOCKS = _blocks()


def shingles(text: Column) -> Column:
    """64-bit hashes of the five-word shingles in order, words in lower case; none below five words."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE), lambda w: w != "")

    def run(w: Column) -> Column:
        five = lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(-1, SHINGLE - 1)])
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - (SHINGLE - 1), F.lit(1)))
        return F.when(F.size(w) >= SHINGLE, F.transform(starts, five)).otherwise(F.array().cast("array<bigint>"))

    return F.transform(F.array(words), run)[0]


def numbered(hashes: Column) -> Column:
    """The multiset as a set: the second and later occurrences of a shingle hashed with their number."""

    def place(h: Column, i: Column) -> Column:
        before = F.size(F.filter(F.slice(hashes, F.lit(1), i), lambda x: x == h))
        return F.when(before == 0, h).otherwise(F.xxhash64(h, before))

    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), hashes).otherwise(F.transform(hashes, place))


def simhash(hashes: Column) -> Column:
    """Bit k is set iff more than half of the shingles, by weight, have it set."""
    ones = lambda k: F.aggregate(hashes, F.lit(0), lambda acc, h: acc + F.getbit(h, k).cast("int"))
    bits = F.sequence(F.lit(0), F.lit(BITS - 1))
    mark = F.aggregate(
        bits,
        F.lit(0).cast("bigint"),
        lambda acc, k: F.when(2 * ones(k) > F.size(hashes), acc.bitwiseOR(_power(k))).otherwise(acc),
    )
    return F.coalesce(mark, F.lit(0).cast("bigint"))  # known not to be null: no filter evaluates it again


def _power(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), k)


def _block(fingerprint: Column, number: int) -> Column:
    at, width = BLOCKS[number]
    return F.shiftrightunsigned(fingerprint, at).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))


def block_keys(fingerprint: Column) -> Column:
    return F.array(
        *[F.struct(F.lit(k).alias("block"), _block(fingerprint, k).alias("value")) for k in range(len(BLOCKS))]
    )


def _search(docs: DataFrame, items: DataFrame, percent: int, small: bool) -> DataFrame:
    """Similar (id, item, window) of documents (id, hashes) and items (no, item, size, marks, mark).

    The tables of a small benchmark are broadcast.  With a larger one the
    positions of shingles are shuffled, narrow, to meet the items' shingles, and
    only the documents that share one are shuffled after them.
    """
    sent = F.broadcast if small else (lambda table: table)
    held = items.select("no", "size", F.explode(F.array_distinct("hashes")).alias("hash"))
    by_hash = held.groupBy("hash", "size").agg(F.collect_set("no").alias("nos"))
    if small:  # sizes of one shingle together: a document's row is copied once per position
        sizes = by_hash.groupBy("hash").agg(F.collect_list(F.struct("size", "nos")).alias("sizes"))
        hits = docs.select("id", "hashes", F.posexplode("hashes").alias("at", "hash")).join(F.broadcast(sizes), "hash")
        hits = hits.select("id", "hashes", "at", F.inline("sizes"))
    else:
        key = F.xxhash64("id", "hashes")
        spots = docs.select(key.alias("doc"), F.posexplode("hashes").alias("at", "hash")).distinct()
        near = spots.join(by_hash, "hash").select("doc", "at", "size", "nos")
        keyed_docs = docs.withColumn("doc", key).join(near.select("doc").distinct(), "doc", "left_semi").dropDuplicates(["doc"])
        hits = near.join(keyed_docs, "doc").select("id", "hashes", "at", "size", "nos")
    span = F.col("size") - (SHINGLE - 1)
    start = F.greatest(F.least(F.col("at"), F.size("hashes") - span), F.lit(0))
    windows = hits.select(
        "id", "size", "nos", start.alias("start"), numbered(F.slice("hashes", start + 1, span)).alias("window")
    ).withColumn("mark", simhash(F.col("window")))
    keyed = windows.select("id", "size", "start", "window", "mark", F.explode("nos").alias("no")).select(
        "*", F.inline(block_keys(F.col("mark")))
    )
    index = items.select(
        "no", "item", F.col("marks").alias("item_marks"), F.col("mark").alias("item_mark"), F.inline(block_keys(F.col("mark")))
    )
    apart = F.col("mark").bitwiseXOR(F.col("item_mark"))
    first = F.coalesce(*[F.when(_block(apart, k) == 0, F.lit(k)) for k in range(len(BLOCKS))])
    near = (
        keyed.join(sent(index), ["no", "block", "value"])
        .where((F.bit_count(apart) <= RADIUS) & (first == F.col("block")))
        .withColumn("common", F.size(F.array_intersect("window", "item_marks")))
        .withColumn("union", F.size("window") + F.size("item_marks") - F.col("common"))
        .where(100 * F.col("common") >= percent * F.col("union"))
    )
    found = F.struct((F.col("common") / F.col("union")).alias("similarity"), (-F.col("start")).alias("back"))
    return (
        near.groupBy("id", "item")
        .agg(F.max(found).alias("best"), F.max("size").alias("n_words"))
        .select(
            "id",
            "item",
            F.round("best.similarity", 6).alias("similarity"),
            (-F.col("best.back")).alias("start_word"),
            F.col("n_words"),
        )
    )


def contaminated(
    docs: DataFrame,
    bench: DataFrame,
    percent: int = PERCENT,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(id, item, similarity, start_word, n_words) of each document and item with a similar window.

    The best window is given, the first of equals.  A document shorter than the
    item is one window.  Texts and items that are null, empty or under five words
    hold no shingle and match nothing; texts of any length are searched whole.
    Repeated rows of an id count as one document, rows without an id as one
    without; items that share an id are each searched, the best one given.
    Empty tables give an empty result; other columns are not read.  What is
    broadcast has a checked size: see ``BLOCK_SHINGLES``.
    """
    hashed = (
        bench.select(F.col(f"`{item_col}`").alias("item"), shingles(F.col(f"`{item_text}`")).alias("hashes"))
        .where(F.size("hashes") > 0)
        .select("item", "hashes", (F.size("hashes") + SHINGLE - 1).alias("size"), numbered(F.col("hashes")).alias("marks"))
        .withColumns({"mark": simhash(F.col("marks")), "no": F.xxhash64("item", "hashes")})
        .dropDuplicates(["no"])
    )
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), shingles(F.col(f"`{text_col}`")).alias("hashes"))
    total = hashed.agg(F.sum(F.size("hashes"))).first()[0] or 0
    out = _search(texts, hashed, percent, total <= BLOCK_SHINGLES)
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "similarity", "start_word", "n_words")


def drop_contaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without a window similar to an item, columns as they are, whatever their names.

    All rows of an id go if one of them holds such a window.  A null, empty or
    short text holds none, so its row stays, as do all rows where either table is
    empty.
    """
    dirty = contaminated(docs, bench, id_col=id_col, text_col=text_col).select(F.col(id_col).alias("id")).distinct()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.join(dirty, rows["id"].eqNullSafe(dirty["id"]), "left_anti").select("row.*")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(
        spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    )


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark
), ds AS (
  SELECT doc_id, len(w) AS n, list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) AS s FROM d WHERE len(w) >= 5
), bs AS (
  SELECT item_id, len(w) AS n, list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) AS s FROM b WHERE len(w) >= 5
), du AS (SELECT doc_id, unnest(s) AS g, unnest(range(0, len(s))) AS at FROM ds),
bu AS (SELECT item_id, n, unnest(s) AS g FROM bs),
starts AS (
  SELECT DISTINCT du.doc_id, bu.item_id, greatest(least(du.at, len(ds.s) - (bu.n - 4)), 0) AS start
  FROM du JOIN bu USING (g) JOIN ds USING (doc_id)
), wins AS (
  SELECT doc_id, item_id, start, ds.s[start + 1 : start + bs.n - 4] AS win, bs.s AS item, bs.n AS n_words
  FROM starts JOIN ds USING (doc_id) JOIN bs USING (item_id)
), a AS (SELECT doc_id, item_id, start, g, count(*) AS c FROM (SELECT doc_id, item_id, start, unnest(win) AS g FROM wins) GROUP BY ALL),
e AS (SELECT item_id, g, count(*) AS c FROM bu GROUP BY ALL),
common AS (SELECT doc_id, item_id, start, sum(least(a.c, e.c)) AS common FROM a JOIN e USING (item_id, g) GROUP BY ALL),
scored AS (
  SELECT doc_id, item_id, start, n_words, common, len(win) + len(item) - common AS u FROM common JOIN wins USING (doc_id, item_id, start)
), best AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY common / u DESC, start) AS r FROM scored WHERE 100 * common >= 75 * u
)
SELECT doc_id, item_id, round(common / u, 6) AS similarity, start::INT AS start_word, n_words::INT AS n_words FROM best WHERE r = 1
"""
