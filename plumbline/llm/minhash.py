"""MinHash near-duplicates: banding, signature check, exact confirmation, components.

Texts with equal shingle sets are one class from the start, so thousands of
copies cost one row each and no pair.  Classes that share a band form a bucket.
Each bucket first compares its members with its least member only.  Then, while
a bucket still holds several components, one member of each is compared with one
of the largest, in turns with other members.  At last the members of the buckets
that still hold several components meet in a set-similarity join by prefix
filter, which finds every similar pair among them whatever its bands, so no link
between classes that share a band is lost, and no bucket is paired out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.components import connected_components
from plumbline.llm.staging import Workspace
from plumbline.llm.words import mix, shingle_set

PERCENT = 75
ROWS, BANDS = 4, 32
HASHES = ROWS * BANDS
#: Signatures that agree by so much less than a link must are no candidates: 6 deviations.
DOUBT = 0.23
#: Natural logarithm of the ratio of one size class to the next.
_STEP = 0.1
#: Rounds that compare single members of components before all that is left is compared.
TURNS = 2
_rng = np.random.default_rng(0xBAD5EED)
_MUL = _rng.integers(1, 1 << 63, (HASHES, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, (HASHES, 1), dtype=np.uint64)
_BAND = _rng.integers(1, 1 << 63, (1, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_COLUMNS = 256
#: Texts, or pairs of sets, that a Python worker takes at once: ten thousand are over 100 MB on both sides.
TEXTS = 1000


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minima of HASHES universal (multiply-add) hashes, upper 32 bits."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), _COLUMNS):
        values = _MUL * shingles[at : at + _COLUMNS]
        values += _ADD
        np.minimum(least, values.min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    keys = (rows * _BAND).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
    return mix(mix(keys) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def common_size(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    return int(np.count_nonzero(both[1:] == both[:-1]))


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether the Jaccard similarity of two sorted sets is at least percent / 100, exactly."""
    common = common_size(a, b)
    return bool(len(a)) and bool(len(b)) and 100 * common >= percent * (len(a) + len(b) - common)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of TEXTS rows, so that what is held of them at once stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            yield batch.slice(at, TEXTS)


def _profiles(texts: DataFrame) -> DataFrame:
    """(id, n, set_key, bands) of (id, text as binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            n, key, bands, ends = [], [], [], [0]
            for text in batch.column(1):
                s = shingle_set(text.as_py() or b"")
                n.append(len(s))
                key.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                if len(s):
                    bands.append(band_keys(signature(s)))
                ends.append(len(bands) * BANDS)
            flat = pa.array(np.concatenate(bands) if bands else np.empty(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), lists], names=["id", "n", "set_key", "bands"]
            )

    return texts.mapInArrow(run, "id long, n long, set_key binary, bands array<long>")


def _sets(texts: DataFrame) -> DataFrame:
    """(id, sig, set) of (id, text as binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sets = [shingle_set(t.as_py() or b"") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([signature(s).tobytes() for s in sets], pa.binary()),
                    pa.array([s.tobytes() for s in sets], pa.binary()),
                ],
                names=["id", "sig", "set"],
            )

    return texts.mapInArrow(run, "id long, sig binary, set binary")


def _compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of those pairs (a, b) that are links: signatures are checked first, then the full sets decide."""
    least = int(HASHES * max(percent / 100 - DOUBT, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for sig_a, set_a, sig_b, set_b in zip(*(batch.column(k) for k in range(2, 6)), strict=True):
                x, y = (np.frombuffer(s.as_buffer(), np.uint32) for s in (sig_a, sig_b))
                if int(np.count_nonzero(x == y)) >= least:
                    x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (set_a, set_b))
                    linked.append(similar(x, y, percent))
                else:
                    linked.append(False)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(linked, pa.bool_()))

    left = sets.select(F.col("id").alias("a"), F.col("sig").alias("sig_a"), F.col("set").alias("set_a"))
    right = sets.select(F.col("id").alias("b"), F.col("sig").alias("sig_b"), F.col("set").alias("set_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "sig_a", "set_a", "sig_b", "set_b")
    return both.mapInArrow(run, "a long, b long")


def _parts(members: DataFrame, links: DataFrame, turn: int) -> DataFrame:
    """(key, component, rep, major): the components of each bucket that has several, each by one member.

    The member changes with the turn; ``major`` is the member of the bucket's largest component.
    """
    placed = members.join(links, members["rep"] == links["node"], "left").select(
        "key", "rep", F.coalesce("component", "rep").alias("component")
    )
    parts = placed.groupBy("key", "component").agg(
        F.count(F.lit(1)).alias("c"), F.min_by("rep", F.xxhash64("rep", "key", F.lit(turn))).alias("rep")
    )
    heads = (
        parts.groupBy("key")
        .agg(F.max(F.struct("c", (-F.col("component")).alias("o"), "rep")).alias("top"), F.count(F.lit(1)).alias("k"))
        .where("k > 1")
        .select("key", F.col("top.rep").alias("major"), (-F.col("top.o")).alias("main"))
    )
    return parts.join(heads, "key").select("key", "component", "rep", "major", "main")


def _contested(members: DataFrame, links: DataFrame) -> DataFrame:
    """(rep, n, component, outside): members of buckets that still hold several components.

    ``outside`` marks those that lie outside the main component of such a bucket.
    """
    mixed = _parts(members, links, 0).select("key", "main").distinct()
    placed = members.join(mixed, "key").join(links, members["rep"] == links["node"], "left")
    named = placed.select("rep", "n", F.coalesce("component", "rep").alias("component"), "main")
    return named.groupBy("rep", "n", "component").agg(F.max(F.col("component") != F.col("main")).alias("outside"))


def _rare_first(contested: DataFrame, sets: DataFrame) -> DataFrame:
    """``contested`` plus ``rare``: the shingles that others have as well, in one order for all, rarest first.

    Shingles of one member only come before those and are left out: they take up
    the first ``n - size(rare)`` places.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rep, held in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens = np.frombuffer(held.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(tokens), rep)), pa.array(tokens)], names=["rep", "token"])

    held = sets.join(contested.select(F.col("rep").alias("id")), "id", "left_semi").select("id", "set")
    tokens = held.mapInArrow(run, "rep long, token long")
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    rare = tokens.join(shared, "token").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("rare"))
    return contested.join(rare.select("rep", F.col("rare.token").alias("rare")), "rep")


def _untested(ranked: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs of contested members in different components that may be similar, one of each outside.

    A similar pair shares at least percent / (100 + percent) of the sum of its
    sizes, so with all sets in one order the first shared shingle comes early on
    both sides: where it has place i in a set of n and place j in one of m, at
    most min(n - i, m - j) are shared.  Members meet on such early shingles alone
    (prefix filter), which are the rare ones: what a family has in common, its
    frequent shingles, brings only those of its members together that differ
    little.  No similar pair is lost.  Sizes are dealt into classes, for the prefix is shorter against
    larger partners.
    """
    p, whole = percent, 100 + percent
    size_class = lambda n: F.floor(F.log(n.cast("double")) / _STEP).cast("int")
    shared = lambda n, m: F.ceil(p * (n + m) / whole)
    early = lambda upto: F.slice("rare", 1, F.greatest(upto - F.col("first"), F.lit(0)).cast("int"))
    n, first = F.col("n"), (F.col("n") - F.size("rare")).alias("first")
    smallest, largest = F.ceil(p * n / 100), F.floor(100 * n / p)
    y = ranked.select("rep", "n", "component", first, "rare").select(
        F.col("rep").alias("y"), F.col("n").alias("m"), F.col("component").alias("cy"), size_class(n).alias("size"), "first",
        F.posexplode(early(n - smallest + 1)).alias("j", "token"),
    )
    least = F.greatest(smallest, F.floor(F.exp(F.col("size") * _STEP)) - 1)
    x = (
        ranked.where("outside")
        .select("rep", "n", "component", first, "rare", F.explode(F.sequence(size_class(smallest), size_class(largest))).alias("size"))
        .select(
            F.col("rep").alias("x"), "n", F.col("component").alias("cx"), "size", F.col("first").alias("first_x"),
            F.posexplode(early(n - shared(n, least) + 1)).alias("i", "token"),
        )
    )
    reach = F.least(F.col("n") - F.col("first_x") - F.col("i"), F.col("m") - F.col("first") - F.col("j"))
    met = x.join(y, ["token", "size"]).where((F.col("cx") != F.col("cy")) & (whole * reach >= p * (F.col("n") + F.col("m"))))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, work: Workspace | None = None
) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    The component is the least id reachable over links of similarity percent/100
    or more; kept marks that id.  A null, empty or blank text has no shingles and
    is linked with nothing.  A text of fewer than five words is one shingle.
    Rows with equal texts share a component whatever their number; rows that
    share an id but not the text are judged each by its own text.  Rows without
    an id are kept, with a null component.  An empty table gives an empty result;
    other columns are not read.
    """
    work = work or Workspace(docs.sparkSession, "minhash")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    profiles = work.stage(_profiles(texts), "profiles", TEXTS)
    full = profiles.where("n > 0 AND id IS NOT NULL")
    classes = work.stage(full.groupBy("set_key").agg(F.min("id").alias("rep")), "classes")
    reps = full.join(classes, "set_key").where("id = rep")
    banded = reps.select("rep", "n", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("rep").alias("leader"), F.max("rep").alias("last")).where("leader < last")
    members = work.stage(banded.join(buckets.select("key", "leader"), "key").select("key", "rep", "n", "leader"), "members")
    ids = members.select(F.col("rep").alias("id")).distinct()
    sets = work.stage(_sets(texts.join(ids, "id", "left_semi")), "sets", TEXTS)
    tried = work.stage(
        members.where("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct(), "tried"
    )
    edges = work.stage(_compared(tried, sets, percent), "links", TEXTS)
    links = connected_components(edges, work)
    for turn in range(TURNS + 1):
        if turn < TURNS:  # one member of each component against one of the bucket's largest
            parts = _parts(members, links, turn + 1).where("component <> main")
            pairs = parts.select(F.least("rep", "major").alias("a"), F.greatest("rep", "major").alias("b")).distinct()
        else:
            contested = work.stage(_contested(members, links), "contested")
            pairs = _untested(work.stage(_rare_first(contested, sets), "ranked", TEXTS), percent)
        pairs = work.stage(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        more = work.stage(_compared(pairs, sets, percent), "links", TEXTS)
        tried = tried.union(pairs)
        if not more.isEmpty():
            edges = edges.union(more)
            links = connected_components(edges, work)
    work.drop(sets, members)
    found = profiles.join(classes, "set_key", "left").select(
        "id", "n", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("rep")).otherwise(F.col("id")).alias("rep")
    )
    component = F.coalesce("component", "rep")
    return found.join(links, found["rep"] == links["node"], "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, work: Workspace | None = None
) -> DataFrame:
    """The rows of ``docs`` that stay: one of each component, repeated rows once, columns as they are."""
    verdict = near_duplicates(docs, id_col, text_col, percent, work)
    keep = verdict.where("kept AND `%s` IS NOT NULL" % id_col).select(id_col).distinct()
    named = docs.where(F.col(id_col).isNotNull()).join(keep, id_col, "left_semi").select(*[f"`{c}`" for c in docs.columns])
    return named.dropDuplicates([id_col, text_col]).unionByName(docs.where(F.col(id_col).isNull()))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
