"""Secret scans: strong credential spans, and weak parts linked by an interval join within scopes.

A strong span is one that a rule alone proves: an assignment, an access
identifier or a long hex run.  A weak part (a bare 40-character key, an
endpoint) means nothing alone.  It is reported only when its scope - the
reach of characters around an access identifier, cut at blank lines - also
holds the complementary parts.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The patterns of the strong kinds.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # the greedy run of 20 characters or more
HEX = re.compile(r"[0-9a-f]{24,}")
# The patterns of the weak kinds.
BARE = re.compile(r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])")
ENDPOINT = re.compile(
    r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?|arn:aws:[A-Za-z0-9:/_.*-]+|(?<![a-z0-9.-])[a-z0-9.-]+\.amazonaws\.com|(?:us|eu|ap|sa|ca)-[a-z]+-[0-9]\b"
)
KINDS = ("assign", "access", "hex", "secret", "endpoint")
REACH = 400
BLANK = re.compile(r"\n[\x20\t\r]*\n")

Span = tuple[int, int, str]  # start and end in code points, kind


def strong_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping spans of each strong kind."""
    out: list[Span] = []
    if ":" in text or "=" in text:
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


def linked_spans(text: str, strong: list[Span], reach: int = REACH) -> list[Span]:
    """Weak parts whose interval meets the scope of an access identifier.

    A bare key needs an access identifier in reach; an endpoint needs both an
    identifier and a secret part (bare key, assignment or hex run) in the scope
    of that identifier.  Scopes are intervals sorted by start, and each part
    looks its scopes up by position: a sort-merge interval join.
    """
    access = sorted(s for s in strong if s[2] == "access")
    if not access:
        return []
    walls = [m.start() for m in BLANK.finditer(text)]
    taken = sorted((s, e) for s, e, _ in strong)
    starts, furthest = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))

    def covered(a: int, b: int) -> bool:
        """Whether a strong span overlaps [a, b): of those begun before b, one ends after a."""
        k = bisect_left(starts, b)
        return k > 0 and furthest[k - 1] > a

    scopes = []
    for s, e, _ in access:
        k = bisect_left(walls, s)
        lo = max(s - reach, walls[k - 1] if k else 0)
        hi = min(e + reach, walls[k] if k < len(walls) else len(text))
        scopes.append((lo, hi))
    found = [
        (m.start(), m.end(), kind)
        for kind, pattern in (("secret", BARE), ("endpoint", ENDPOINT))
        for m in pattern.finditer(text)
        if not covered(*m.span())
    ]
    lows, highs = sorted(lo for lo, _ in scopes), sorted(hi for _, hi in scopes)

    def scopes_over(a: int, b: int) -> int:
        """How many scopes hold [a, b): begun by a, not ended before b."""
        return bisect_left(lows, a + 1) - bisect_left(highs, b)

    parts = sorted([(s, e) for s, e, k in found if k == "secret"] + [(s, e) for s, e, k in strong if k in ("assign", "hex")])
    begins = [s for s, _ in parts]
    nearest = list(accumulate((e for _, e in reversed(parts)), min))[::-1]  # least end of the parts from each on
    full = []  # scopes with a secret part
    for lo, hi in scopes:
        k = bisect_left(begins, lo)
        if k < len(parts) and nearest[k] <= hi:
            full.append((lo, hi))
    full_lows, full_highs = sorted(lo for lo, _ in full), sorted(hi for _, hi in full)
    out = []
    for s, e, kind in found:
        if kind == "secret" and scopes_over(s, e) > 0:
            out.append((s, e, kind))
        elif kind == "endpoint" and bisect_left(full_lows, s + 1) - bisect_left(full_highs, e) > 0:
            out.append((s, e, kind))
    return out


def scan(text: str | None, reach: int = REACH) -> tuple[list[Span], list[Span]]:
    """(strong spans, all spans), each by start, then kind as listed."""
    if not text:
        return [], []
    strong = strong_spans(text)
    order = {k: n for n, k in enumerate(KINDS)}
    place = lambda s: (s[0], order[s[2]], s[1])
    return sorted(strong, key=place), sorted(strong + linked_spans(text, strong, reach), key=place)


def redact(text: str | None, reach: int = REACH) -> str | None:
    """The text with every reported span, overlaps merged, replaced by ``[SECRET]``."""
    spans = scan(text, reach)[1]
    if not spans:
        return text
    out, at = [], 0
    for s, e, _ in spans:
        if s >= at:
            out += [text[at:s], "[SECRET]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """One row per input row: id, counts per strong kind, digest of the strong spans, all spans.

    Map-only: each text is scanned whole where it lies.  A null or empty text has
    no spans (digest of the empty string); repeated rows and null ids are kept;
    other columns are not read; an empty table gives an empty result.
    """
    schema = docs.select(id_col).schema.add("n_assign", "long").add("n_access", "long").add("n_hex", "long")
    schema = schema.add("base_sha256", "string").add("spans", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for value in batch.column(1):
                base, spans = scan(value.as_py(), reach)
                for k, kind in enumerate(KINDS[:3]):
                    cols[k].append(sum(s[2] == kind for s in base))
                cols[3].append(hashlib.sha256(_joined(base).encode()).hexdigest())
                cols[4].append(_joined(spans))
            types = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=schema.names
            )

    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)


def redact_documents(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars", reach: int = REACH) -> DataFrame:
    """``docs`` with every reported span replaced; all rows and columns stay, ``chars_col`` follows where it exists.

    A null text stays null and an empty one empty; a text without spans is not
    touched, nor its ``chars_col``.  Texts are redacted whole, whatever their
    length, and repeated rows alike.  An empty table gives an empty result; other
    columns pass through whatever their names.
    """
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [redact(v.as_py(), reach) for v in batch.column(names.index(text_col))]
            cols = list(batch.columns)
            cols[names.index(text_col)] = pa.array(texts, batch.column(names.index(text_col)).type)
            if chars_col in names:
                at = names.index(chars_col)
                old, new = batch.column(names.index(text_col)), cols[names.index(text_col)]
                lengths = [
                    n if a == b else len(b or "")
                    for n, a, b in zip(cols[at].to_pylist(), old.to_pylist(), new.to_pylist(), strict=True)
                ]
                cols[at] = pa.array(lengths, cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.mapInArrow(run, docs.schema)


def op2_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
