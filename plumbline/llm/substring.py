"""Substring dedup by compact windows.

Each text is a sequence of five-word shingles.  For one hash function the
Cartesian tree over the shingles' hashes splits all subsequences of at least
LEAST shingles into compact windows (l, c, r): those that begin in [l, c] and end
in [c, r] share the minimum at c.  There are about 2 n / LEAST windows of n
shingles.  Windows with equal minima in different documents may hold the same
passage.  Per pair of documents an interval join keeps the stretches that
windows of enough hash functions cover; the shingles there are then compared.

Windows of one minimum are linked to one representative each, first within a
batch of documents, then across batches, so a passage in a third of all
documents costs a row per document, never a pair per pair.

A representative may lack the passage, and two documents may share one without
minima in common.  So all documents are looked at once more, by anchors: shingles
whose least word hash is that of their first or last word.  Any GAP shingles in a
row hold one, and whether a shingle is one depends on it alone, so both sides of
a passage choose the same.  A passage is a run of LEAST shingles on either side,
SHARED of which occur in the other run.  A run that holds more than
LEAST - SHARED anchors of no other document is none, and of the others the
LEAST - SHARED + 1 rarest places (its leads; fewer by those anchors that only it
has) hold the rarest anchor that both runs have.  Runs meet on equal leads: first
one of each class with one of the largest, in turns, then all that are still in
different classes.  A line that thousands have brings none of them together, for
it is never a run's rarest part; no link between classes is lost.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.components import connected_components
from plumbline.llm.staging import Workspace
from plumbline.llm.words import SHINGLE, mix, shingle_sequence, word_hashes

WORDS = 50
LEAST = WORDS - SHINGLE + 1
HASHES = 5
ENOUGH = 2
#: Of LEAST shingles so many must be shared: a Jaccard similarity of 0.75.
SHARED = -(-6 * LEAST // 7)
#: Of so many shingles of a shared run one at least is shared.
RARE = LEAST - SHARED + 1
#: Of so many shingles in a row one at least is an anchor.
GAP = SHINGLE - 1
#: Rounds that compare single members of classes before all that is left is compared.
TURNS = 2
_CHUNK = 200_000
_FLUSH = 500_000
#: Windows of a text looked at together.
_ROWS = 20_000
#: Documents whose windows are linked before they are dealt.
DOCS = 2_000
_rng = np.random.default_rng(0xC0FFEE)
_MUL = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)



def compact_windows(values: np.ndarray, least: int = LEAST, ties: bool | np.ndarray = True) -> list[tuple[int, int, int]]:
    """(l, c, r) of the Cartesian tree's nodes whose range has at least ``least`` entries.

    Of equal minima the middle one is the node, else the tree of a periodic text
    is a path.  ``ties`` says that values may repeat, or which ones do.
    """
    ties = np.full(len(values), ties) if isinstance(ties, bool) else ties
    out, stack = [], [(0, len(values))]
    while stack:
        lo, hi = stack.pop()
        if hi - lo < least:
            continue
        part = values[lo:hi]
        c = lo + int(part.argmin())
        if ties[c]:
            spots = np.flatnonzero(part == values[c])
            c = lo + int(spots[len(spots) // 2])
        out.append((lo, c, hi - 1))
        stack += [(lo, c), (c + 1, hi)]
    return out


def _star(key: np.ndarray) -> np.ndarray:
    """For rows sorted by key: the row number of the first of each key."""
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))


def packed(cols: list[np.ndarray]) -> bytes:
    """Columns of longs: their number, then of each the least value and the bytes of what exceeds it, plane by plane."""
    parts = [struct.pack("<q", len(cols[0]))]
    for col in cols:
        low = col.min()
        rest = (col - low).view(np.uint64)
        width = (int(rest.max()).bit_length() + 7) // 8
        parts += [struct.pack("<qB", low, width), rest.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()]
    return b"".join(parts)


def unpacked(blob: bytes) -> list[np.ndarray]:
    (n,), at, out = struct.unpack_from("<q", blob), 8, []
    while at < len(blob):
        low, width = struct.unpack_from("<qB", blob, at)
        rest = np.zeros((n, 8), np.uint8)
        rest[:, :width] = np.frombuffer(blob, np.uint8, n * width, at + 9).reshape(width, n).T
        out.append(rest.view(np.int64).ravel() + low)
        at += 9 + n * width
    return out


PACKED = "bucket int, rows binary"


def _dealt(parts: Iterator[tuple[np.ndarray, list[np.ndarray]]], bits: int) -> Iterator[pa.RecordBatch]:
    """Rows of (64-bit places, columns of longs), packed by the upper ``bits`` of their place."""

    def flush(held: list[tuple[np.ndarray, list[np.ndarray]]]) -> pa.RecordBatch:
        place = np.concatenate([p for p, _ in held])
        order = np.argsort(place)
        bucket = (place[order] >> np.uint64(64 - bits)).astype(np.int32)
        cols = [np.concatenate(c)[order] for c in zip(*(c for _, c in held), strict=True)]
        ends = np.flatnonzero(np.diff(bucket, append=-1)) + 1
        blobs = [packed([c[x:y] for c in cols]) for x, y in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[ends - 1]), pa.array(blobs, pa.binary())], names=["bucket", "rows"])

    kinds: dict[int, list[tuple[np.ndarray, list[np.ndarray]]]] = {}
    for place, cols in parts:
        if len(place):
            held = kinds.setdefault(len(cols), [])
            held.append((place, cols))
            if sum(len(p) for p, _ in held) >= _FLUSH:
                yield flush(kinds.pop(len(cols)))
    for held in kinds.values():
        yield flush(held)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of each bucket of packed rows that are sorted by bucket; rows with more columns apart from those with fewer."""

    def whole(held: list[list[np.ndarray]]) -> Iterator[list[np.ndarray]]:
        for kind in {len(cols) for cols in held}:
            yield [np.concatenate(c) for c in zip(*(cols for cols in held if len(cols) == kind), strict=True)]

    held, now = [], None
    for batch in batches:
        for bucket, rows in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if held and bucket != now:
                yield from whole(held)
                held = []
            now = bucket
            held.append(unpacked(rows.as_buffer()))
    if held:
        yield from whole(held)


def _gathered(rows: DataFrame) -> DataFrame:
    return rows.repartition("bucket").sortWithinPartitions("bucket")


def _windows(texts: DataFrame, bits: int) -> DataFrame:
    """Packed windows (key, doc, l, r) of (id, text as binary).

    Among DOCS documents all but the first of a key carry that one's (doc, l, r)
    too, and are dealt by document: a key that many have is not one bucket's.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
        for batch in (b.slice(k, DOCS) for b in batches for k in range(0, b.num_rows, DOCS)):
            keys, docs, spans = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = shingle_sequence(word_hashes(text.as_py() or b""))
                if len(s) < LEAST:
                    continue
                _, place, times = np.unique(s, return_inverse=True, return_counts=True)
                ties = times[place] > 1 if len(times) < len(s) else False
                for j in range(HASHES):
                    values = s * _MUL[j] + _ADD[j]
                    spans.append(np.array(compact_windows(values, ties=ties)))
                    keys.append((mix(values[spans[-1][:, 1]]) & ~np.uint64(7)) | np.uint64(j))
                    docs.append(np.full(len(spans[-1]), doc, np.int64))
            if not keys:
                continue
            key, doc, span = np.concatenate(keys), np.concatenate(docs), np.concatenate(spans)
            order = np.lexsort((span[:, 0], doc, key))
            key, own = key[order], [doc[order], span[order, 0], span[order, 2]]
            head = _star(key)
            first = head == np.arange(len(key))
            yield key[first], [key[first].view(np.int64), *(c[first] for c in own)]
            rest = np.flatnonzero(~first)
            place = mix(own[0][rest].view(np.uint64) + own[1][rest].view(np.uint64))
            yield place, [key[rest].view(np.int64), *(c[rest] for c in own), *(c[head[rest]] for c in own)]

    return texts.mapInArrow(lambda batches: _dealt(found(batches), bits), PACKED)


EDGE = [("doc", pa.int64()), ("l", pa.int32()), ("r", pa.int32()), ("rdoc", pa.int64()), ("rl", pa.int32()), ("rr", pa.int32()), ("hash", pa.int32())]


def _edges(windows: DataFrame) -> DataFrame:
    """Each window beside the representative of its key, where that is another document's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in _buckets(batches):
            key, own = cols[0], cols[1:4]
            if len(cols) > 4:
                other = cols[4:]
            else:
                order = np.lexsort((own[1], own[0], key))
                key, own = key[order], [c[order] for c in own]
                head = _star(key)
                other = [c[head] for c in own]
            rows = own[0] != other[0]
            if rows.any():
                out = [c[rows] for c in (*own, *other, key & 7)]
                yield pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, (_, t) in zip(out, EDGE, strict=True)], names=[n for n, _ in EDGE])

    return _gathered(windows).mapInArrow(run, "doc long, l int, r int, rdoc long, rl int, rr int, hash int")


def covered(spans: list[tuple[int, int, int]], enough: int = ENOUGH, least: int = LEAST) -> list[tuple[int, int]]:
    """Stretches [a, b] of ``least`` positions or more that spans (hash, l, r) of enough hashes cover throughout."""
    by_hash: dict[int, list[tuple[int, int]]] = {}
    for j, lo, hi in spans:
        by_hash.setdefault(j, []).append((lo, hi))
    events = []
    for parts in by_hash.values():
        end = -1
        for lo, hi in sorted(parts):  # union per hash: a hash counts once
            lo = max(lo, end + 1)
            if hi >= lo:
                events += [(lo, 1), (hi + 1, -1)]
                end = hi
    out, depth, begin = [], 0, 0
    events.sort(key=lambda e: (e[0], -e[1]))
    for at, step in events:
        if depth < enough <= depth + step:
            begin = at
        elif depth >= enough > depth + step and at - begin >= least:
            out.append((begin, at - 1))
        depth += step
    return out


def _classes(found: DataFrame, work: Workspace) -> DataFrame:
    """(node, component) of documents linked by verified passages."""
    return connected_components(found.select(F.col("doc").alias("a"), F.col("other").alias("b")).distinct(), work)


def _classed(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """``rows`` plus the class of their document, itself where it has no link."""
    named = classes.select(F.col("node").alias("doc"), "component")
    return rows.join(named, "doc", "left").withColumn("class", F.coalesce("component", "doc")).drop("component")


def _mixed(rows: DataFrame) -> DataFrame:
    """The ``rows`` (key, class, ..) of keys that several classes have."""
    keys = rows.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo < hi").select("key")
    return rows.join(keys, "key", "left_semi")


def anchor_places(words: np.ndarray) -> np.ndarray:
    """Places of the shingles whose least word is the first or the last one."""
    m = len(words) - SHINGLE + 1
    if m < 1:
        return np.empty(0, np.int64)
    least = words[:m].copy()
    for k in range(1, SHINGLE):
        np.minimum(least, words[k : k + m], out=least)
    return np.flatnonzero((least == words[:m]) | (least == words[SHINGLE - 1 :]))


def _anchors(texts: DataFrame, bits: int) -> DataFrame:
    """Packed (shingle, doc, at): the anchors of every text.

    48 bits of the shingle tell it well enough to meet on; ``at`` is 23 bits of
    the text's hash, the place, and the anchor's number modulo 256.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
        for batch in batches:
            for doc, text, copy in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                words = word_hashes(text.as_py() or b"")
                if len(words) < WORDS:
                    continue
                pos = anchor_places(words)
                place = shingle_sequence(words)[pos]
                at = (copy & 0x7FFFFF) << 40 | pos << 8 | np.arange(len(pos)) & 255
                yield place, [(place >> np.uint64(16)).view(np.int64), np.full(len(pos), doc, np.int64), at]

    return texts.select("id", "text", F.xxhash64("text")).mapInArrow(lambda batches: _dealt(found(batches), bits), PACKED)


def _shared(anchors: DataFrame, bits: int) -> DataFrame:
    """Packed (doc, at, df, shingle) of the anchors that several documents have; ``df`` counts them."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
        for shingle, doc, at in _buckets(batches):
            order = np.argsort(shingle)
            shingle, doc, at = shingle[order], doc[order], at[order]
            heads = np.flatnonzero(np.diff(shingle, prepend=-1))
            sizes = np.diff(np.append(heads, len(shingle)))
            several = np.minimum.reduceat(doc, heads) != np.maximum.reduceat(doc, heads)
            rows = np.repeat(several, sizes)
            held = [doc[rows], at[rows], np.repeat(sizes, sizes)[rows], shingle[rows]]
            yield mix(held[0].view(np.uint64)), held

    return _gathered(anchors).mapInArrow(lambda batches: _dealt(found(batches), bits), PACKED)


def _leads(shared: DataFrame) -> DataFrame:
    """(doc, copy, a, b, key): the leads of every live stretch [a, b], each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, at, df, shingle in _buckets(batches):
            order = np.lexsort((at, doc))
            doc, at, df, shingle = doc[order], at[order], df[order], shingle[order]
            new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (at[1:] != at[:-1])))  # repeated rows
            doc, at, df, shingle = doc[new], at[new], df[new], shingle[new]
            text, pos, number = at >> 40, at >> 8 & 0xFFFFFFFF, at & 255
            starts = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (text[1:] != text[:-1]))))
            parts = []
            for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(doc)], strict=True):
                for a, b, leads in live_runs(pos[lo:hi], df[lo:hi], shingle[lo:hi], number[lo:hi], GAP):
                    keys = np.unique(shingle[lo + leads])
                    parts.append([*(np.full(len(keys), x) for x in (doc[lo], text[lo], a, b)), keys])
            if parts:
                cols = [np.concatenate(c) for c in zip(*parts, strict=True)]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c).cast(k) for c, k in zip(cols, kinds, strict=True)], names=["doc", "copy", "a", "b", "key"]
                )

    return _gathered(shared).mapInArrow(run, "doc long, copy long, a int, b int, key long")


def _fewest(gap: int) -> int:
    """The least number of shared places of a passage, where any ``gap`` shingles in a row hold one: RARE - 1 missing ones part it."""
    return -(-(SHARED - RARE * (gap - 1)) // gap)


def live_runs(
    pos: np.ndarray, df: np.ndarray, shingle: np.ndarray, number: np.ndarray | None = None, gap: int = 1
) -> list[tuple[int, int, np.ndarray]]:
    """(a, b, leads): stretches of runs of LEAST places that another text may hold, and the rows of ``pos`` on which they may meet.

    ``pos`` is sorted and holds the places of shingles that others have, ``df``
    how many have them.  All shingles of the text may be there, or only its
    anchors, of which any ``gap`` places in a row hold one; ``number`` counts the
    anchors modulo 256, those of no other text too.  A run is live if at most LEAST - SHARED
    are known to be missing from others.  Of each run the leads are the rarest, so
    many that they and the missing ones make RARE.
    """
    if len(pos) < _fewest(gap):
        return []
    number = pos if number is None else number
    # a window's rows change only where a place enters or leaves it
    starts = np.unique(np.maximum(np.concatenate((pos, pos - LEAST + 1, pos + 1, pos - LEAST)), 0))
    lo, hi = np.searchsorted(pos, starts), np.searchsorted(pos, starts + LEAST)
    starts, lo, hi = (x[hi > lo] for x in (starts, lo, hi))
    n = hi - lo
    # the fewest missing ones over all starts with these rows: those at the ends are known by their gaps alone
    missing = (number[hi - 1] - number[lo] & 255) + 1 - n
    missing += np.maximum(LEAST - (pos[hi - 1] - pos[lo] + 1) - (gap - 1), 0) // gap
    live = (missing < RARE) & (n >= _fewest(gap))
    if not live.any():
        return []
    starts, lo, n, missing = (x[live] for x in (starts, lo, n, missing))
    order = np.lexsort((shingle, df))
    rank = np.empty(len(pos), np.int64)
    rank[order] = np.arange(len(pos))
    lead = np.zeros(len(pos), bool)
    for k in range(0, len(starts), _ROWS):
        some = slice(k, k + _ROWS)
        cells = lo[some, None] + np.arange(int(n[some].max()))
        inside = np.arange(cells.shape[1]) < n[some, None]
        ranks = np.where(inside, rank[np.minimum(cells, len(pos) - 1)], len(pos))
        last = np.minimum(RARE - missing[some], n[some]) - 1
        chosen = ranks <= np.take_along_axis(np.sort(ranks, axis=1), last[:, None], axis=1)
        lead[cells[chosen & inside]] = True
    out = []
    for part in np.split(np.arange(len(starts)), np.flatnonzero(np.diff(starts) > LEAST) + 1):
        a, b = int(starts[part[0]]), int(starts[part[-1]]) + LEAST - 1
        x, y = np.searchsorted(pos, (a, b + 1))
        out.append((a, b, x + np.flatnonzero(lead[x:y])))
    return out


def _named(leads: DataFrame, texts: DataFrame) -> DataFrame:
    """``leads`` plus ``content``, which equal stretches have in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, copy, text, spans in zip(*(batch.column(k).to_pylist() for k in range(2)), batch.column(2), batch.column(3).to_pylist(), strict=True):
                s = shingle_sequence(word_hashes(text.as_py() or b""))
                for x in spans:
                    held = hashlib.blake2b(s[max(x["a"], 0) : x["b"] + 1].tobytes(), digest_size=8).digest()
                    rows.append((doc, copy, x["a"], x["b"], int.from_bytes(held, "little", signed=True)))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc", "copy", "a", "b", "content"]
            )

    spans = leads.groupBy(F.col("doc").alias("id"), "copy").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    own = texts.select("id", F.xxhash64("text").bitwiseAND(F.lit(0x7FFFFF)).alias("copy"), "text")
    held = own.join(spans, ["id", "copy"]).select("id", "copy", "text", "spans")
    return leads.join(held.mapInArrow(run, "doc long, copy long, a int, b int, content long").distinct(), ["doc", "copy", "a", "b"])


def _unsettled(spots: DataFrame, classes: DataFrame, turn: int) -> DataFrame:
    """Candidates: stretches of documents of different classes that have a lead in common.

    One of each class meets one of the largest, or in the last turn every one all
    others.  Of equal stretches of a class one stands for all.
    """
    once = _classed(spots, classes).groupBy("key", "class", "content").agg(F.min(F.struct("doc", "a", "b")).alias("w"))
    named = _mixed(once)
    if turn < TURNS:
        parts = named.groupBy("key", "class").agg(
            F.count(F.lit(1)).alias("n"), F.min_by("w", F.xxhash64("w", F.lit(turn))).alias("w")
        )
        heads = parts.groupBy("key").agg(F.max(F.struct("n", "class", "w")).alias("top"))
        met = parts.join(heads, "key").where(F.col("class") != F.col("top.class")).select("w", F.col("top.w").alias("v"))
    else:
        x, y = named.alias("x"), named.alias("y")
        met = x.join(y, F.col("x.key") == F.col("y.key")).where("x.class < y.class").select("x.w", F.col("y.w").alias("v"))
    turned = F.col("w.doc") < F.col("v.doc")
    side = lambda one, two: F.when(turned, F.col(one)).otherwise(F.col(two))
    return met.select(
        *[side(f"w.{c}", f"v.{c}").alias(c) for c in ("doc", "a", "b")],
        *[side(f"v.{c}", f"w.{c}").alias(f"r{c}") for c in ("doc", "a", "b")],
    ).distinct()


def _candidates(edges: DataFrame) -> DataFrame:
    """(doc, a, b, rdoc, ra, rb): stretches on both sides that enough hashes cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, rdoc, links in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                for a, b in covered([(x["hash"], x["l"], x["r"]) for x in links]):
                    near = [x for x in links if x["l"] <= b and x["r"] >= a]
                    for ra, rb in covered([(x["hash"], x["rl"], x["rr"]) for x in near]):
                        rows.append((doc, a, b, rdoc, ra, rb))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int32(), pa.int32()] * 2
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc", "a", "b", "rdoc", "ra", "rb"]
            )

    pairs = edges.groupBy("doc", "rdoc").agg(F.collect_list(F.struct("hash", "l", "r", "rl", "rr")).alias("links"))
    enough = pairs.where(F.size(F.array_distinct(F.transform("links", lambda x: x["hash"]))) >= ENOUGH)
    return enough.mapInArrow(run, "doc long, a int, b int, rdoc long, ra int, rb int")


def shared_stretches(mine: np.ndarray, other: np.ndarray) -> list[tuple[int, int]]:
    """Stretches [a, b] of ``mine``: unions of runs of LEAST shingles, SHARED of which occur in ``other``.

    Runs begin and end with a shared shingle, so a stretch does not reach past the passage.
    """
    hit = np.isin(mine, other)
    if len(mine) < LEAST:
        return []
    total = np.concatenate(([0], np.cumsum(hit)))
    good = np.flatnonzero(total[LEAST:] - total[:-LEAST] >= SHARED)
    if not len(good):
        return []
    breaks = np.flatnonzero(np.diff(good) > LEAST)
    out = []
    for run in np.split(good, breaks + 1):
        a, b = int(run[0]), int(run[-1]) + LEAST - 1
        spots = np.flatnonzero(hit[a : b + 1])
        out.append((a + int(spots[0]), a + int(spots[-1])))
    return out


def _verified(candidates: DataFrame, texts: DataFrame, work: Workspace) -> DataFrame:
    """(doc, start, stop, other, ostart): passages in words, end exclusive, on both sides of each candidate, and where the other's begins."""
    ids = candidates.select(F.col("doc").alias("id")).union(candidates.select("rdoc")).distinct()

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs = [(shingle_sequence(word_hashes(t.as_py() or b"")) >> np.uint64(32)).astype(np.uint32) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([s.tobytes() for s in seqs], pa.binary())], names=["id", "seq"]
            )

    held = work.stage(texts.join(ids, "id", "left_semi").mapInArrow(sequences, "id long, seq binary"), "sequences")
    cut = lambda a, b: F.substring("seq", 4 * F.col(a) + 1, 4 * (F.col(b) - F.col(a) + 1))
    # a candidate covers what its hashes do, which may end before the passage: a run more on either side is compared
    wide = lambda c: F.greatest(F.col(c) - LEAST, F.lit(0))
    both = (
        candidates.select("doc", wide("a").alias("a"), (F.col("b") + LEAST).alias("b"), "rdoc", wide("ra").alias("ra"), (F.col("rb") + LEAST).alias("rb"))
        .distinct()
        .join(held.withColumnRenamed("id", "rdoc"), "rdoc")
        .withColumn("theirs", cut("ra", "rb"))
        .drop("seq")
        .join(held.withColumnRenamed("id", "doc"), "doc")
        .select("doc", "a", cut("a", "b").alias("mine"), "rdoc", "ra", "theirs")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            doc, a, _, rdoc, ra, _ = (c.to_pylist() if c.type != pa.binary() else None for c in batch.columns)
            for k in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[k].as_buffer(), np.uint32) for c in (2, 5))
                one, two = shared_stretches(x, y), shared_stretches(y, x)
                if one and two:
                    facing = len(one) == len(two)
                    rows += [(doc[k], a[k] + s, a[k] + e + SHINGLE, rdoc[k], ra[k] + two[i * facing][0]) for i, (s, e) in enumerate(one)]
                    rows += [(rdoc[k], ra[k] + s, ra[k] + e + SHINGLE, doc[k], a[k] + one[i * facing][0]) for i, (s, e) in enumerate(two)]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc", "start", "stop", "other", "ostart"]
            )

    return both.mapInArrow(compare, "doc long, start int, stop int, other long, ostart int")


def repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", work: Workspace | None = None
) -> DataFrame:
    """One row per document that shares a passage of WORDS words or more with another document.

    Columns: id, class_id (least id reachable over shared passages), n_passages,
    n_words in them, passages as word spans ``start:stop`` (stop exclusive) in
    order, and partner, the least document that one of them was matched with.
    Every passage is confirmed on its shingles.  Classes are whole; between
    documents that are in one class already a further passage is reported only if
    a representative of its windows holds it.  Texts that are null or shorter
    have none; a passage repeated within one document only is not reported; rows
    that share an id are one document; rows without an id are left out.  An empty
    table gives an empty result; other columns are not read.
    """
    work = work or Workspace(docs.sparkSession, "substring")
    texts = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text")
    ).where("id IS NOT NULL")
    # so many buckets that each holds about five hundred to a thousand documents' rows
    bits = min(max(texts.count() // 1000, 1 << 6).bit_length(), 15)
    edges = work.stage(_edges(_windows(texts, bits)), "edges")
    candidates = work.stage(_candidates(edges), "candidates")
    found = work.stage(_verified(candidates, texts, work), "found")
    work.drop(edges)
    tried = candidates
    classes = _classes(found, work)
    leads = work.stage(_leads(_shared(_anchors(texts, bits), bits)), "leads")
    open_leads = work.stage(_mixed(_classed(leads, classes)).drop("class"), "open")
    work.drop(leads)
    spots = work.stage(_named(open_leads, texts).drop("copy"), "spots")
    work.drop(open_leads)
    for turn in range(TURNS + 1):
        more = work.stage(_unsettled(spots, classes, turn).join(tried, tried.columns, "left_anti"), "candidates")
        if not more.isEmpty():
            found = found.union(work.stage(_verified(more, texts, work), "found"))
            tried = tried.union(more)
            classes = _classes(found, work)
    # a representative meets many partners in the same span: spans are made distinct before they meet
    spans = found.groupBy("doc", "start", "stop").agg(F.min("other").alias("other"))
    merged = spans.groupBy("doc").agg(
        F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"), F.min("other").alias("partner")
    )
    empty = F.array().cast("array<struct<start:int,stop:int>>")
    joined = F.aggregate(
        "spans",
        empty,
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (s["start"] <= F.element_at(acc, -1)["stop"]),
            F.concat(
                F.slice(acc, F.lit(1), F.size(acc) - 1),
                F.array(
                    F.struct(
                        F.element_at(acc, -1)["start"].alias("start"),
                        F.greatest(F.element_at(acc, -1)["stop"], s["stop"]).alias("stop"),
                    )
                ),
            ),
        ).otherwise(F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["stop"].alias("stop"))))),
    )
    return (
        merged.withColumn("spans", joined)
        .join(classes, merged["doc"] == classes["node"])
        .select(
            F.col("doc").alias(id_col),
            F.col("component").alias("class_id"),
            F.size("spans").cast("long").alias("n_passages"),
            F.aggregate("spans", F.lit(0), lambda n, s: n + s["stop"] - s["start"]).cast("long").alias("n_words"),
            F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["stop"])), ",").alias("passages"),
            "partner",
        )
    )


def op5_substring_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
