"""Byte-level BPE by prefix dynamic programming.

For each prefix of a piece exactly one token can be the last one of its
encoding.  The table of those last tokens is the encoding of every prefix at
once, so bytes can be appended without re-encoding, and an edit re-runs the
table only until it agrees with the old one again.

Token ``b`` may follow ``a`` iff no merge ever crosses the border between them.
At the border stand, in turn, the parts on the right flank of ``a`` and those on
the left flank of ``b``; each part lives from the rank that makes it to the
rank that absorbs it.  A crossing merge happens iff two parts are alive
together and their joint rank comes before either is absorbed.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NEVER = 1 << 62
assert sys.byteorder == "little" and array("I").itemsize == 4
# Fixed value: Unicode White_Space, which the split pattern's \s stands for.
WHITE = r"\t-\r\x20\x85\xa0  -     　"
#: Of each memo and generation: 2 x 2 x so many words and pieces are some 120 MB, which a worker keeps for later stages.
MEMO_ENTRIES = 250_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PrefixBpe:
    """Encoder over a rank table; memory beyond the table is bounded."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.vocab: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.vocab[rank] = token
        self.longest = max(map(len, ranks), default=1)
        self._tails = {t[k:]: -1 for t in ranks for k in range(1, len(t))} | ranks
        self._parts: dict[bytes, tuple[bytes, bytes] | None] = {}
        self._right: dict[bytes, list[tuple[bytes, int, int]]] = {}
        self._left: dict[bytes, list[tuple[bytes, int, int]]] = {}
        self._follows: defaultdict[int, dict[int, bool]] = defaultdict(dict)
        self._n_follows = 0

    def parts(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two tokens whose merge makes this one; None for bytes and for tokens no merge reaches."""
        if token not in self._parts:
            limit, found = self.ranks[token], None
            for k in range(1, len(token)):
                a, b = token[:k], token[k:]
                if self._made_before(a, limit) and self._made_before(b, limit) and not self._crossed(a, b, limit):
                    found = (a, b)
                    break
            self._parts[token] = found
        return self._parts[token]

    def _made_before(self, part: bytes, limit: int) -> bool:
        rank = self.ranks.get(part)
        return rank is not None and (len(part) == 1 or rank < limit and self.parts(part) is not None)

    def _flank(self, token: bytes, side: int, seen: dict) -> list[tuple[bytes, int, int]]:
        """(part, made at, absorbed at) down one side of the token's merge tree."""
        if token not in seen:
            out, now, death = [], token, _NEVER
            while True:
                halves = self.parts(now) if len(now) > 1 else None
                birth = self.ranks[now] if halves else -1
                out.append((now, birth, death))
                if not halves:
                    break
                now, death = halves[side], birth
            seen[token] = out
        return seen[token]

    def _crossed(self, a: bytes, b: bytes, limit: int) -> bool:
        """Whether a merge of a rank below the limit crosses the border between the two tokens."""
        ranks, left = self.ranks, self._flank(b, 0, self._left)
        for x, born_x, dead_x in self._flank(a, 1, self._right):
            for y, born_y, dead_y in left:
                # of equal ranks the leftmost merges first
                if born_x <= dead_y and born_y < dead_x:
                    joint = ranks.get(x + y)
                    if joint is not None and joint < limit and joint < dead_x and joint <= dead_y:
                        return True
        return False

    def follows(self, a: int, b: int) -> bool:
        """Whether (a, b) is the encoding of their joint bytes."""
        known = self._follows[a].get(b)
        if known is None:
            known = self.reachable(b) and not self._crossed(self.vocab[a], self.vocab[b], _NEVER)
            self._n_follows += 1
            if self._n_follows > 4 * MEMO_ENTRIES:
                self._follows.clear()
                self._n_follows = 0
            self._follows[a][b] = known
        return known

    def reachable(self, token: int) -> bool:
        data = self.vocab[token]
        return len(data) == 1 or self.parts(data) is not None

    def _table(self, piece: bytes, last: list[int] | None = None, stop=None) -> list[int]:
        """Extends the table of last tokens over the bytes of ``piece`` that it does not cover yet."""
        last = [] if last is None else last
        tails, allowed = self._tails, self._follows
        for i in range(len(last) + 1, len(piece) + 1):
            for j in range(i - 1, -1, -1):
                token = tails.get(piece[j:i])
                if token is None:  # no token ends in these bytes, nor in more
                    break
                if token >= 0:
                    if j:
                        known = allowed[last[j - 1]].get(token)
                        if known is None:
                            known = self.follows(last[j - 1], token)
                    else:
                        known = self.reachable(token)
                    if known:  # the only one: no need to look further
                        last.append(token)
                        break
            if stop is not None and stop(last):
                break
        return last

    def _walk(self, last: list[int]) -> list[int]:
        out, at = [], len(last)
        while at > 0:
            out.append(last[at - 1])
            at -= len(self.vocab[last[at - 1]])
        return out[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece; a piece that is itself a token is that token."""
        rank = self.ranks.get(piece)
        return [rank] if rank is not None else self._walk(self._table(piece))

    def decode(self, ids) -> bytes:
        vocab = self.vocab
        return b"".join([vocab[i] for i in ids])


class PrefixText:
    """One piece under edit: its bytes and the last token of every prefix."""

    def __init__(self, bpe: PrefixBpe, data: bytes = b""):
        self.bpe, self.data, self.last = bpe, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        """Exact: the table of the old bytes stays as it is."""
        self.data += more
        self.last = self.bpe._table(self.data, self.last)

    def prefix_ids(self, n: int) -> list[int]:
        """The encoding of the first n bytes."""
        return self.bpe._walk(self.last[:n])

    def splice(self, start: int, end: int, new: bytes) -> int:
        """Replaces bytes [start, end); returns how many table entries were computed anew.

        An entry depends on the bytes and entries at most one longest token
        back, so once that many entries in a row agree with the old table, the
        rest of it is valid.
        """
        old, shift = self.last, len(new) - (end - start)
        self.data = self.data[:start] + new + self.data[end:]
        safe, span = start + len(new), self.bpe.longest
        agree = 0

        def stop(last: list[int]) -> bool:
            nonlocal agree
            i = len(last) - 1
            agree = agree + 1 if i >= safe and old[i - shift] == last[i] else 0
            return agree >= span

        last = self.bpe._table(self.data, old[:start], stop=stop)
        done = len(last) - start
        self.last = last + old[len(last) - shift :]
        return done


class TextEncoder:
    """Encodes texts piece by piece; memos of two generations bound the memory."""

    def __init__(self, bpe: PrefixBpe, pattern: str):
        self.bpe = bpe
        spaced = pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]")
        self.split = regex.compile(spaced).findall
        # a space next to other white space: the text cannot be cut there
        self.wide = re.compile(f" [{WHITE}]|[{WHITE}] ").search
        self._pieces: list[dict[str, bytes]] = [{}, {}]
        self._words: list[dict[str, bytes]] = [{}, {}]

    def _pack(self, text: str) -> bytes:
        pieces = self.split(text)
        if len(pieces) == 1 and len(text) <= 64:  # the word's memo holds it
            return array("I", self.bpe.encode_piece(text.encode())).tobytes()
        out = []
        now, old = self._pieces
        for piece in pieces:
            ids = now.get(piece)
            if ids is None:
                ids = old.get(piece) or array("I", self.bpe.encode_piece(piece.encode())).tobytes()
                if len(piece) <= 64:
                    now[piece] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        for memo in (self._pieces, self._words):
            if len(memo[0]) > MEMO_ENTRIES:
                memo[:] = [{}, memo[0]]
        if self.wide(text):
            return self._pack(text)
        # no piece reaches over a lone space; it begins the next piece
        head, *words = text.split(" ")
        now, old = self._words
        out = [self._pack(head)]
        for word in words:
            ids = now.get(word)
            if ids is None:
                ids = old.get(word) or self._pack(" " + word)
                if len(word) <= 64:
                    now[word] = ids
            out.append(ids)
        return b"".join(out)


_encoders: dict[tuple[str, str], TextEncoder] = {}


def encoder(path: str, pattern: str) -> TextEncoder:
    """One encoder per worker process, kept from task to task."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = TextEncoder(PrefixBpe(load_ranks(path)), pattern)
    return _encoders[path, pattern]


def encode_documents(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """One row per input row: id, n_tokens, digest of the ids, digest of the bytes decoded from them.

    Map-only.  A null text is empty (0 tokens, digests of nothing); an empty
    table gives an empty result; repeated rows and null ids are kept; other
    columns are not read.  ``with_ids`` adds the ids as a binary column.
    """
    schema = docs.select(id_col).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if with_ids:
        schema = schema.add("ids", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            n, ids_sha, text_sha, kept = [], [], [], []
            for value in batch.column(1):
                ids = enc.encode(value.as_py() or "")
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(enc.bpe.decode(np.frombuffer(ids, "<u4").tolist())).hexdigest())
                if with_ids:
                    kept.append(ids)
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(kept, pa.binary())] * with_ids, names=schema.names)

    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.PATTERN)
