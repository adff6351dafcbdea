"""Byte-level BPE by prefix dynamic programming.

For every prefix of a byte string the BPE encoding has exactly one last token. Storing that token
for each prefix is enough to append bytes, to cut the end off, and to re-encode around an edit: a
token may end a prefix iff it is compatible with the token that ends the prefix before it.

Two adjacent tokens are compatible when the merges that build them never get the chance to merge
across their border; this is decided by undoing their merges, latest first (`Merges.joins`).

Null texts are empty texts: no tokens, empty bytes. Ties cannot occur (ranks are unique).
Repeated rows and extra columns pass through unchanged.
"""

from __future__ import annotations

import base64
import re
from itertools import islice
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidelog.llm.common import extended, map_batches, worker_cache

#: Distinct pieces that one Python worker remembers; beyond it the memory starts anew.
CACHE_PIECES = 300_000
#: Pieces of one text handled at a time, which bounds memory for very long texts.
BLOCK_PIECES = 200_000
NO_SPLIT = -1


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Merges:
    """Merge knowledge of a rank table: how tokens split, and which pairs may stand side by side."""

    def __init__(self, ranks: dict[bytes, int], splits: tuple[np.ndarray, np.ndarray] | None = None):
        self.ranks = ranks
        size = max(ranks.values()) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self._known: dict[int, bool] = {}
        if splits is None:
            self.left, self.right = [NO_SPLIT] * size, [NO_SPLIT] * size
            self._find_splits()
        else:
            self.left, self.right = splits[0].tolist(), splits[1].tolist()
        #: Tokens that merging can reach; others only stand for a whole piece.
        self.reachable = {t: r for t, r in ranks.items() if len(t) == 1 or self.left[r] != NO_SPLIT}
        self.longest = max(map(len, self.reachable))
        #: Every suffix of a reachable token, with the token's id if it is one itself, else NO_SPLIT.
        self.endings = {t[i:]: NO_SPLIT for t in self.reachable for i in range(len(t))} | self.reachable

    def _find_splits(self) -> None:
        for rank, token in sorted((r, t) for t, r in self.ranks.items() if len(t) > 1):
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is None or b is None or not (self._made(a, rank) and self._made(b, rank)):
                    continue
                if self._compatible(a, b, rank):
                    self.left[rank], self.right[rank] = a, b
                    break

    def _made(self, token: int, before: int) -> bool:
        """Whether merges below the rank can produce the token."""
        return len(self.bytes_of[token]) == 1 or (token < before and self.left[token] != NO_SPLIT)

    def _compatible(self, a: int, b: int, limit: int) -> bool:
        """Whether no merge of rank below `limit` crosses the border of a and b while they are being built."""
        ranks, of = self.ranks, self.bytes_of
        while True:
            across = ranks.get(of[a] + of[b])
            if across is not None and across < limit:
                return False
            age_a = a if self.left[a] != NO_SPLIT else -1
            age_b = b if self.left[b] != NO_SPLIT else -1
            if age_a < 0 and age_b < 0:
                return True
            if age_a > age_b:  # a was finished last: before that, its right part touched b
                limit, a = a, self.right[a]
            else:  # b was; equal ranks merge from the left, so b is the later of twins
                limit, b = b + 1, self.left[b]

    def joins(self, a: int, b: int) -> bool:
        """Whether the encoding of both tokens' bytes is the two tokens."""
        if len(self._known) > 1_000_000:
            self._known.clear()
        known = self._known[a << 32 | b] = self._compatible(a, b, 1 << 60)
        return known

    def extend(self, data: bytes, last: list[int], start: int, stop: int) -> None:
        """Append to `last` the unique valid last token of each prefix of start..stop-1 bytes."""
        endings, known, joins = self.endings.get, self._known.get, self.joins
        for end in range(start, stop):
            at = end - 1
            while at >= 0:
                t = endings(data[at:end])
                if t is None:  # longer strings end no token either
                    raise ValueError(f"no token ends the first {end} bytes")
                if t >= 0:
                    if not at:
                        break
                    a = last[at - 1]
                    fits = known(a << 32 | t)
                    if joins(a, t) if fits is None else fits:
                        break
                at -= 1
            last.append(t)

    def encode(self, data: bytes) -> list[int]:
        last: list[int] = []
        self.extend(data, last, 1, len(data) + 1)
        return self.walk_back(last)

    def walk_back(self, last: list[int]) -> list[int]:
        out, i, of = [], len(last), self.bytes_of
        while i:
            out.append(t := last[i - 1])
            i -= len(of[t])
        out.reverse()
        return out

    def splits(self) -> tuple[np.ndarray, np.ndarray]:
        return np.array(self.left, np.int32), np.array(self.right, np.int32)


class PrefixEncoding:
    """The encoding of a byte string that can grow, shrink and be edited.

    last[i] is the unique valid last token of the first i + 1 bytes.
    """

    def __init__(self, merges: Merges, data: bytes = b""):
        self.merges, self.data, self.last = merges, b"", []
        self.append(data)

    def append(self, more: bytes) -> PrefixEncoding:
        """Exact encoding of the longer string; the tokens of earlier prefixes stay as they are."""
        at = len(self.data)
        self.data += more
        self.merges.extend(self.data, self.last, at + 1, len(self.data) + 1)
        return self

    def truncate(self, size: int) -> PrefixEncoding:
        self.data, self.last = self.data[:size], self.last[:size]
        return self

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Put `new` in place of bytes start..end. Returns how many prefixes were worked out again.

        Behind the edit, once the last tokens of as many prefixes as the longest token has bytes
        agree with those from before, all later ones do, and are kept.
        """
        old_last, shift = self.last, len(new) - (end - start)
        tail = self.data[end:]
        self.data = self.data[:start] + new + tail
        self.last = old_last[:start]
        window, agree, done = self.merges.longest, 0, 0
        for i in range(start + 1, len(self.data) + 1):
            self.merges.extend(self.data, self.last, i, i + 1)
            t = self.last[-1]
            done += 1
            size = len(self.merges.bytes_of[t])
            inside = i - size >= start + len(new)  # the token lies behind the edit
            agree = agree + 1 if inside and old_last[i - 1 - shift] == t else 0
            if agree >= window:
                self.last += old_last[i - shift :]
                break
        return done

    def tokens(self) -> list[int]:
        return self.merges.walk_back(self.last)


#: Below this code point the standard library's engine splits texts, with the same classes and at twice the speed.
LATIN_END = 0x250


def latin_pattern(pattern: str) -> re.Pattern | None:
    """The same pattern for texts below LATIN_END, its classes spelled out; None if it has other classes than these."""
    members = {
        k: "".join(re.escape(chr(c)) for c in range(LATIN_END) if regex.fullmatch(k, chr(c))) for k in (r"\p{L}", r"\p{N}", r"\s")
    }
    out, inside = "", False
    for part in regex.findall(r"\\p\{\w+\}|\\.|.", pattern, regex.DOTALL):
        if part in members:
            out += members[part] if inside else f"[{members[part]}]"
        elif part == r"\S" and not inside:
            out += f"[^{members[chr(92) + 's']}]"
        elif part[0] == "\\" and part[1:2].isalnum():
            return None
        else:
            inside = part == "[" or (inside and part != "]")
            out += part
    return re.compile(out)


class Splitter:
    """Pieces of a text: the matches of the pattern."""

    def __init__(self, pattern: str):
        self.any, self.latin = regex.compile(pattern), latin_pattern(pattern)
        self.beyond = re.compile(f"[^\0-{chr(LATIN_END - 1)}]")

    def _engine(self, text: str):
        return self.latin if self.latin and not self.beyond.search(text) else self.any

    def findall(self, text: str) -> list[str]:
        return self._engine(text).findall(text)

    def blocks(self, text: str, size: int = BLOCK_PIECES):
        """Lists of pieces; those of a very long text come a block at a time."""
        if len(text) < 4 * size:
            yield self.findall(text)
            return
        found = self._engine(text).finditer(text)
        while block := [m[0] for m in islice(found, size)]:
            yield block


class _Pieces(dict):
    """piece -> its ids, packed little-endian."""

    def __init__(self, merges: Merges):
        super().__init__()
        self.merges = merges

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_PIECES:
            self.clear()
        data = piece.encode("utf-8")
        whole = self.merges.ranks.get(data)
        ids = [whole] if whole is not None else self.merges.encode(data)
        packed = pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 64:
            self[piece] = packed
        return packed


class TextCodec:
    """Whole texts: each match of the pattern is encoded on its own."""

    def __init__(self, merges: Merges, pattern: str):
        self.merges = merges
        self.splitter = Splitter(pattern)
        self.pieces = _Pieces(merges)

    def encode(self, text: str | None) -> bytes:
        """ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        known = self.pieces
        return b"".join([b"".join([known[p] for p in block]) for block in self.splitter.blocks(text)])


def decode_ids(bytes_of: list[bytes], packed: bytes | None) -> bytes:
    """The bytes that packed ids stand for."""
    if not packed:
        return b""
    return b"".join([bytes_of[i] for i in np.frombuffer(packed, "<u4").tolist()])


def _codec(shared, pattern: str) -> TextCodec:
    """One codec per worker process and rank table, kept between tasks."""
    tokens, left, right = shared.value
    codecs, key = worker_cache("bpe"), (id(tokens), pattern)  # the worker keeps one value for each broadcast
    if key not in codecs:
        codecs.clear()
        ranks = {t: i for i, t in enumerate(tokens) if t}
        codecs[key] = TextCodec(Merges(ranks, (left, right)), pattern)
    return codecs[key]


class BpeModel:
    """A rank table made ready on the driver and shared with the executors (its size is the vocabulary's)."""

    def __init__(self, spark, rank_path: str, pattern: str):
        merges = Merges(read_ranks(rank_path))
        self.pattern = pattern
        self.shared = spark.sparkContext.broadcast((merges.bytes_of, *merges.splits()))


def bpe_encode(df: DataFrame, model: BpeModel, text: str = "text", ids: str = "ids", count: str = "n_tokens", decoded: str | None = None) -> DataFrame:
    """df with the packed ids (binary) and their number (long) of each whole text, and on demand the bytes that the ids
    decode to; columns of those names are replaced."""
    added = [ids, count, *([decoded] if decoded else [])]
    kept = [c for c in df.columns if c not in added]
    df = df.select(*(f"`{c}`" for c in kept))
    shared, pattern = model.shared, model.pattern

    def run(batches):
        codec = _codec(shared, pattern)
        for b in batches:
            packed = [codec.encode(t) for t in b.column(kept.index(text)).to_pylist()]
            out = [pa.array(packed, pa.binary()), pa.array([len(p) // 4 for p in packed], pa.int64())]
            if decoded:
                out.append(pa.array([decode_ids(codec.merges.bytes_of, p) for p in packed], pa.binary()))
            yield pa.RecordBatch.from_arrays([*b.columns, *out], names=[*kept, *added])

    kinds = [(ids, "binary"), (count, "long"), *([(decoded, "binary")] if decoded else [])]
    return map_batches(df, run, extended(df.schema, *kinds), cache="bpe")


def bpe_decode(df: DataFrame, model: BpeModel, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with the bytes that the packed ids stand for."""
    kept = [c for c in df.columns if c != decoded]
    df = df.select(*(f"`{c}`" for c in kept))
    shared = model.shared

    def run(batches):
        bytes_of = shared.value[0]
        for b in batches:
            out = [decode_ids(bytes_of, p) for p in b.column(kept.index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], names=[*kept, decoded])

    return map_batches(df, run, extended(df.schema, (decoded, "binary")), cache="bpe")
