"""URL filters: dated list entries as validity intervals, joined as of each capture's fetch time.

An entry adds or removes a key (a host, a parent domain, or a host with leading
path segments) from a date on.  The entries of a key become intervals, which are
cut at month borders; a capture looks up the month of its fetch time for each of
its keys.  The join is an equi-join on (key, month) with the exact interval as
residual, so a host with a third of all captures splits like any skewed key and
a long history costs only its one month.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and trailing dot; empty where there is none."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(F.regexp_replace(raw, r"\.$", ""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def url_keys(url: Column, labels_most: int | None = None, parts_most: int | None = None) -> Column:
    """Distinct keys under which a list may hold the URL: host, parents down to two labels, host with path segments.

    Keys of more labels or path segments than the most that the list holds, if given, are left out.
    """
    labels = F.split(host_of(url), r"\.")
    n = F.size(labels)
    last = F.greatest(n - 2, F.lit(0))
    first = F.lit(0) if labels_most is None else F.least(F.greatest(n - labels_most, F.lit(0)), last)
    hosts = F.transform(
        F.sequence(first, last),
        lambda k: F.array_join(F.slice(labels, k + 1, n), "."),
    )
    parts = F.filter(F.split(path_of(url), "/"), lambda p: p != "")
    depth = F.size(parts) if parts_most is None else F.least(F.size(parts), F.lit(parts_most))
    paths = F.transform(
        F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>")),
        lambda k: F.concat(host_of(url), F.lit("/"), F.array_join(F.slice(parts, F.lit(1), k), "/")),
    )
    return F.array_distinct(F.filter(F.concat(hosts, paths), lambda k: k != ""))


def validity(entries: DataFrame) -> DataFrame:
    """(key, category, valid_from, valid_to) of entries (key, at, action, category).

    An ``add`` holds until the next entry of its key and category, or the next
    ``remove`` of the key without a category; at one time a remove comes before
    an add.  ``valid_to`` is null while it holds.
    """
    rank = F.when(F.col("action") == "add", 1).otherwise(0)
    own = F.lead("at").over(Window.partitionBy("key", "category").orderBy("at", "rank"))
    later = Window.partitionBy("key").orderBy("at", "rank").rowsBetween(1, Window.unboundedFollowing)
    every = F.min(F.when((F.col("action") == "remove") & (F.col("category") == ""), F.col("at"))).over(later)
    return (
        entries.where("key IS NOT NULL AND at IS NOT NULL AND action IN ('add', 'remove')")
        .select("key", "at", "action", F.coalesce("category", F.lit("")).alias("category"), rank.alias("rank"))
        .withColumn("valid_to", F.least(own, every))
        .where("action = 'add' AND (valid_to IS NULL OR valid_to > at)")
        .select("key", "category", F.col("at").alias("valid_from"), "valid_to")
    )


def _month(at: Column) -> Column:
    return (F.year(at) * 12 + F.month(at) - 1).cast("int")


def filter_captures(captures: DataFrame, entries: DataFrame, id_col: str = "page_id") -> DataFrame:
    """One row per capture: id, fetched_at, blocked, matched_key, category, n_active.

    ``captures`` has id, url and fetched_at.  The matched key is the longest that
    is active, the first of equals.  A capture without URL or time is not
    blocked.  Repeated captures are judged alike, and each is returned.  Empty
    tables on either side give no blocks or no rows.
    """
    seen = captures.select(F.col(id_col).alias("id"), "url", "fetched_at")
    horizon = seen.agg(F.max(_month(F.col("fetched_at")))).first()[0]
    pieces = F.split("key", "/")
    deepest = entries.agg(F.max(F.size(F.split(pieces[0], r"\."))), F.max(F.when(F.col("key").isNotNull(), F.size(pieces) - 1))).first()
    labels_most, parts_most = (x or 0 for x in deepest)
    intervals = validity(entries).withColumn(
        "month",
        F.explode(
            F.expr("sequence(0, 0)") if horizon is None else F.when(
                _month(F.col("valid_from")) <= horizon,
                F.sequence(
                    _month(F.col("valid_from")),
                    F.greatest(
                        _month(F.col("valid_from")), F.least(F.coalesce(_month(F.col("valid_to")), F.lit(horizon)), F.lit(horizon))
                    ),
                ),
            )
        ),
    )
    keyed = seen.where("url IS NOT NULL AND fetched_at IS NOT NULL").select(
        "id", "url", "fetched_at", _month(F.col("fetched_at")).alias("month"), F.explode(url_keys(F.col("url"), labels_most, parts_most)).alias("key")
    )
    active = keyed.join(intervals, ["key", "month"]).where(
        "valid_from <= fetched_at AND (valid_to IS NULL OR fetched_at < valid_to)"
    )
    best = F.struct((-F.char_length("key")).alias("short"), "key", "category")
    verdict = (
        active.dropDuplicates(["id", "url", "fetched_at", "key", "category"])
        .groupBy("id", "url", "fetched_at")
        .agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("n_active"))
        .select(F.col("id").alias("v_id"), F.col("url").alias("v_url"), F.col("fetched_at").alias("v_at"), "best", "n_active")
    )
    same = seen["id"].eqNullSafe(F.col("v_id")) & (seen["url"] == F.col("v_url")) & (seen["fetched_at"] == F.col("v_at"))
    return seen.join(verdict, same, "left").select(
        F.col("id").alias(id_col),
        "fetched_at",
        F.col("best").isNotNull().alias("blocked"),
        F.col("best.key").alias("matched_key"),
        F.col("best.category").alias("category"),
        F.coalesce("n_active", F.lit(0)).alias("n_active"),
    )


def sample_captures(pages: DataFrame) -> DataFrame:
    """Pages with a fetch time that follows from their id (the table has none)."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), ((F.col("page_id") * 7919) % 365).cast("int"))
    return pages.select("page_id", "url", day.cast("timestamp_ntz").alias("fetched_at"))


def sample_entries(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts and first path segments of the pages, by digits of the key's MD5."""
    host = host_of(F.col("url"))
    segment = F.filter(F.split(path_of(F.col("url")), "/"), lambda p: p != "")
    keys = pages.select(F.explode(F.array(host, F.concat(host, F.lit("/"), F.coalesce(F.get(segment, F.lit(0)), F.lit("")))))
                        .alias("key")).where("key <> '' AND key NOT LIKE '%/'").distinct()
    x = F.conv(F.substring(F.md5("key"), 1, 7), 16, 10).cast("long")
    at = lambda d: F.date_add(F.lit("2024-01-01").cast("date"), (x % 200 + d).cast("int")).cast("timestamp_ntz")
    entry = lambda d, action: F.struct(at(d).alias("at"), F.lit(action).alias("action"))
    listed = F.array(entry(0, "add"), entry(60, "remove"), entry(120, "add"))
    category = F.when(x % 2 == 0, "spam").otherwise("adult")
    return keys.where(x % 5 < 2).select("key", category.alias("category"), F.inline(listed))


def op4_url_list_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return filter_captures(sample_captures(pages), sample_entries(pages))


OP4_SQL = r"""
WITH parsed AS (
  SELECT page_id, url, (DATE '2024-01-01' + CAST((page_id * 7919) % 365 AS INT))::TIMESTAMP AS fetched_at,
    lower(regexp_replace(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '\.$', '')) AS host,
    regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS path
  FROM pages
), seen AS (
  SELECT *, string_split(host, '.') AS labels, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM parsed
), listed AS (
  SELECT DISTINCT key FROM (
    SELECT host AS key FROM seen WHERE host <> '' UNION ALL SELECT host || '/' || parts[1] FROM seen WHERE host <> '' AND len(parts) > 0)
), x AS (SELECT key, ('0x' || substr(md5(key), 1, 7))::BIGINT AS x FROM listed),
valid AS (
  SELECT key, CASE WHEN x % 2 = 0 THEN 'spam' ELSE 'adult' END AS category,
    (DATE '2024-01-01' + CAST(x % 200 AS INT))::TIMESTAMP AS f1, (DATE '2024-01-01' + CAST(x % 200 + 60 AS INT))::TIMESTAMP AS t1,
    (DATE '2024-01-01' + CAST(x % 200 + 120 AS INT))::TIMESTAMP AS f2
  FROM x WHERE x % 5 < 2
), keyed AS (
  SELECT page_id, url, fetched_at, unnest(list_distinct(list_filter(
    list_concat(list_transform(range(0, greatest(least(len(labels) - 2, 3), 0) + 1), lambda k: array_to_string(labels[k + 1:], '.')),
                list_transform(range(1, least(len(parts), 2) + 1), lambda k: host || '/' || array_to_string(parts[1:k], '/'))),
    lambda k: k <> ''))) AS key
  FROM (SELECT DISTINCT page_id, url, fetched_at, host, labels, parts FROM seen)
), best AS (
  SELECT page_id, url, fetched_at, count(*) AS n_active, min({'short': -length(key), 'key': key, 'category': category}) AS best
  FROM keyed JOIN valid USING (key) WHERE (fetched_at >= f1 AND fetched_at < t1) OR fetched_at >= f2 GROUP BY ALL
)
SELECT s.page_id, s.fetched_at, best IS NOT NULL AS blocked, best.key AS matched_key, best.category AS category, coalesce(n_active, 0) AS n_active
FROM seen s LEFT JOIN best b ON s.page_id = b.page_id AND s.url = b.url AND s.fetched_at = b.fetched_at
"""
