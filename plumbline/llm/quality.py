"""Quality rules: measures per text, and thresholds that follow each language and source.

Thresholds come from KLL sketches, which merge: a group's sketch serves the
group, the merged sketches of a language serve its small groups, and the merge
of all serves small languages.  A measure is a ratio of counts, in millionths;
its fences lie so many quartile ranges outside its group's quartiles, and wider
for texts with less to count than the group's median text, as the noise of a
mean is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.staging import Workspace

SPACE = r"[\x20\x09-\x0D]+"
SKETCH_K = 4096
BROADCAST_GROUPS = 20_000
MILLION = 1_000_000
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Measure:
    """A ratio in millionths, kept while it lies within the fences around its group's quartiles.

    ``spread`` is the distance from a quartile to its fence in quartile ranges, at
    least ``slack``: where half a group's values are equal the range is zero.
    """

    name: str
    num: str
    den: str
    spread: int
    slack: int
    low: bool = False


# Fences in multiples of the quartile range, and the least distance in millionths.
MEASURES = (
    Measure("word_len", "word_chars", "n_words", 5, MILLION // 2, low=True),
    Measure("symbols", "n_symbols", "word_chars", 5, 20_000),
    Measure("dup_lines", "n_dup_lines", "n_lines", 5, 350_000),
)
COUNTS = tuple(dict.fromkeys(m.den for m in MEASURES))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def _windows(words: Column) -> Column:
    """Hash of the five words from each position on that has them."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - 4, F.lit(1)))
    five = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(-1, 4)])
    return F.when(F.size(words) >= 5, F.transform(starts, five)).otherwise(F.array().cast("array<bigint>"))


def _repeat_words(hashes: Column) -> Column:
    """Words inside windows that occur twice or more: the union of their stretches of five."""
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(ranked: Column) -> Column:
        same = lambda s, k, d: F.coalesce(F.get(ranked, k + d)["h"] == s["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(ranked, lambda s, k: same(s, k, -1) | same(s, k, 1)), lambda s: s["i"]))

    spots = _bind(placed, repeated)
    covered = F.aggregate(
        spots,
        F.struct(F.lit(0).alias("n"), F.lit(-5).alias("last")),
        lambda acc, p: F.struct((acc["n"] + F.least(p - acc["last"], F.lit(5))).alias("n"), p.alias("last")),
    )["n"]
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(covered)


def _bind(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, however often ``then`` uses it."""
    return F.transform(F.array(value), then)[0]


def counts(text: Column) -> Column:
    """The base counts and n_lines as one struct; stage it before taking fields from it."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def with_lines(words: Column, lines: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            _bind(_windows(words), _repeat_words).cast("long").alias("n_repeat_words"),
            F.size(lines).cast("long").alias("n_lines"),
        )

    return _bind(_words(text), lambda words: _bind(lines, lambda held: with_lines(words, held)))


def base_failed() -> Column:
    n = F.col("q.n_words")
    return (n < 10) | (100 * F.col("q.n_repeat_words") > 20 * n)


def _value(m: Measure) -> Column:
    return F.when(F.col(f"q.{m.den}") > 0, F.floor(F.col(f"q.{m.num}") * MILLION / F.col(f"q.{m.den}"))).otherwise(0).cast("long")


def thresholds(measured: DataFrame, least_rows: int) -> DataFrame:
    """(lang, source, limit) from rows (lang, source, q) that pass the base rules.

    ``limit`` has, per measure, its quartiles, the distance to the fences and the
    median of its denominator.  Rows pre-aggregate into sketches before the
    shuffle, so a source with a third of all rows costs one sketch per task.
    """
    names = [m.name for m in MEASURES] + list(COUNTS)
    good = measured.where(~base_failed()).select(
        "lang", "source", *[_value(m).alias(m.name) for m in MEASURES], *[F.col(f"q.{c}").alias(c) for c in COUNTS]
    )
    group = good.groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("n"), *[F.kll_sketch_agg_bigint(F.col(c), F.lit(SKETCH_K)).alias(c) for c in names]
    )
    merged = [F.sum("n").alias("n"), *[F.kll_merge_agg_bigint(F.col(c)).alias(c) for c in names]]
    lang = group.groupBy("lang").agg(*merged)
    every = lang.agg(*merged)

    def fences(table: DataFrame, tag: str, *keys: str) -> DataFrame:
        at = lambda c, r: F.kll_sketch_get_quantile_bigint(F.col(c), F.lit(r))
        out = []
        for m in MEASURES:
            q1, q3 = at(m.name, 0.25), at(m.name, 0.75)
            reach = F.greatest((q3 - q1) * m.spread, F.lit(m.slack))
            out.append(F.struct(q1.alias("q1"), q3.alias("q3"), reach.alias("reach"), at(m.den, 0.5).alias("mid")).alias(m.name))
        return table.where(F.col("n") > 0).select(*keys, F.col("n").alias(f"{tag}_n"), F.struct(*out).alias(tag))

    rows = (
        fences(group, "own", "lang", "source")
        .join(fences(lang, "wider", "lang"), "lang", "left")
        .withColumn("one", F.lit(1))
        .join(fences(every, "all").withColumn("one", F.lit(1)), "one", "left")
    )
    limit = F.when(F.col("own_n") >= least_rows, F.col("own")).when(F.col("wider_n") >= least_rows, F.col("wider")).otherwise(F.col("all"))
    return rows.select("lang", "source", limit.alias("limit"))


def _small(limits: DataFrame) -> DataFrame:
    """Limits to be broadcast if counted few; else Spark joins them by shuffle, splitting hot groups."""
    return F.broadcast(limits) if limits.count() <= BROADCAST_GROUPS else limits


def _measured(docs: DataFrame, columns: list[str], text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """(row, lang, source, q): the columns kept as one struct, so that no name of theirs clashes with one of ours."""
    key = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"),
        key(lang_col).alias("lang"), key(source_col).alias("source"), counts(F.col(f"`{text_col}`")).alias("q"),
    )


def _judged(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """``measured`` plus failed and kept; a row whose group has no limit fails the base, as all its group does."""
    inside = F.lit(True)
    for m in MEASURES:
        limit = F.col(f"limit.{m.name}")
        # a text with less to count than the median text is allowed the noise that comes with it
        reach = limit["reach"] * F.sqrt(F.greatest(limit["mid"] / F.greatest(F.col(f"q.{m.den}"), F.lit(1)), F.lit(1.0)))
        inside = inside & F.coalesce(_value(m) <= limit["q3"] + reach, F.lit(True))
        if m.low:
            inside = inside & F.coalesce(_value(m) >= limit["q1"] - reach, F.lit(True))
    failed = base_failed()
    return measured.join(limits, ["lang", "source"], "left").select("row", "q", failed.alias("failed"), (~failed & inside).alias("kept"))


def assess(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    least_rows: int = 100,
    work: Workspace | None = None,
) -> DataFrame:
    """One row per input row: id, the base counts, base_failed, kept and n_lines.

    The counts are staged as a narrow table, so texts are read once.  A group of
    language and source has fences of its own from ``least_rows`` rows that pass
    the base rules on; below that its language's serve it, and below that all
    rows' do, for the quartiles of a few rows are noise.  A null text is empty
    and fails the base.  Null languages and sources are groups of their own.
    Texts of any length are counted whole.  Repeated rows are judged alike; an
    empty table gives an empty result; other columns are not read.
    """
    work = work or Workspace(docs.sparkSession, "quality")
    measured = work.stage(_measured(docs, [id_col], text_col, lang_col, source_col), "measured")
    limits = work.stage(thresholds(measured, least_rows), "limits")
    return _judged(measured, _small(limits)).select(
        F.col("row")[id_col].alias(id_col),
        *[F.col(f"q.{c}").alias(c) for c in BASE],
        F.col("failed").alias("base_failed"),
        "kept",
        F.col("q.n_lines").alias("n_lines"),
    )


def keep_good(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    least_rows: int = 100,
    work: Workspace | None = None,
) -> DataFrame:
    """The rows of ``docs`` that ``assess`` keeps, with their columns as they are, whatever their names.

    A null or empty text fails the base rules and goes; repeated rows stay or go
    together; an empty table gives an empty result.
    """
    work = work or Workspace(docs.sparkSession, "quality")
    measured = work.stage(_measured(docs, docs.columns, text_col, lang_col, source_col), "measured")
    limits = work.stage(thresholds(measured, least_rows), "limits")
    return _judged(measured, _small(limits)).where("kept").select("row.*")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(spark.read.parquet(f"{sf_dir}/documents.parquet"))
