"""Benchmark decontamination: an FM-index of each training shard, searched for benchmark phrases.

A phrase is a window of consecutive benchmark words (an item with fewer is one phrase). A shard is what a
task gets at once, some MB of whole documents; all its words are indexed, each document as a segment (of a document
of more than SHARD_WORDS words, pieces that overlap by a window). All phrases are searched backwards at once through wavelet
ranks, found rows are located by sampled positions, and their spans merged.

The benchmark is read in blocks of bounded size, dealt by items' id and text, each broadcast on its own. A shard is indexed once and
then searched for one block after the other; where there are more than KEPT_BLOCKS, a worker holds one at a time. So a benchmark of any size works in one pass without a shuffle.

Null texts have no words. Items without words have no phrase; items with a null id mark words but add
no id. An item that comes twice counts once. An empty benchmark finds nothing. Repeated and null
document ids are no problem: rows never meet.
"""

from __future__ import annotations

import re
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidelog.llm.common import extended, map_batches
from tidelog.llm.fm_index import FmIndex

WINDOW = 10
#: Symbols in one index; longer segments are cut with an overlap of a window.
SHARD_WORDS = 2_000_000
#: Benchmark bytes held (and broadcast) at a time.
BENCHMARK_BLOCK = 16 << 20
#: Blocks that a worker keeps open.
KEPT_BLOCKS = 2
#: Documents of more bytes are split into words a block at a time.
BLOCK_BYTES, BLOCK_WORDS = 8 << 20, 500_000

_IN_WORD = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_TO_SPACE = bytes(b if b in _IN_WORD else 0x20 for b in range(256))
_WORD = re.compile(rb"[^ ]+")


def _spaced(text: str | None) -> bytes:
    """The text's bytes with A-Z in lower case and a space for each byte that is in no word; no byte moves."""
    return (text or "").encode("utf-8").lower().translate(_TO_SPACE)


def words_of(text: str | None) -> list[bytes]:
    return _spaced(text).split()


class Phrases:
    """The distinct windows of a block of items, as rows of word symbols set to the right."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        self.symbols: dict[bytes, int] = {}
        self.ids: list[object] = []
        number: dict[tuple[int, ...], int] = {}
        owners: list[set[int]] = []
        place: dict[object, int] = {}
        for item_id, text in items:
            words = [self.symbols.setdefault(w, len(self.symbols) + 1) for w in words_of(text)]
            owner = -1
            if item_id is not None:
                owner = place.setdefault(item_id, len(self.ids))
                if owner == len(self.ids):
                    self.ids.append(item_id)
            for i in range(max(1, len(words) - window + 1) if words else 0):
                p = number.setdefault(tuple(words[i : i + window]), len(number))
                if p == len(owners):
                    owners.append(set())
                if owner >= 0:
                    owners[p].add(owner)
        self.rows = np.zeros((len(number), window), np.int32)
        self.sizes = np.fromiter(map(len, number), np.int64, len(number))
        for words, p in number.items():
            self.rows[p, window - len(words) :] = words
        self.owner_of = np.array([o for s in owners for o in sorted(s)], np.int64)
        self.owner_at = np.concatenate(([0], np.cumsum([len(s) for s in owners], dtype=np.int64)))


class _Vocabulary(dict):
    """Words in the order in which they are met, from 1 on."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self) + 1
        return number


def _symbols(text: str | None, known: _Vocabulary) -> np.ndarray:
    data, get = _spaced(text), known.__getitem__
    if len(data) <= BLOCK_BYTES:
        words = data.split()
        return np.fromiter(map(get, words), np.int32, len(words))
    found, parts = _WORD.finditer(data), []
    while words := [m[0] for m in islice(found, BLOCK_WORDS)]:
        parts.append(np.fromiter(map(get, words), np.int32, len(words)))
    return np.concatenate(parts) if parts else np.zeros(0, np.int32)


class Shard:
    """FM-indexes of all words of some texts."""

    def __init__(self, texts: list[str | None], window: int):
        self.words = _Vocabulary()
        each = [_symbols(t, self.words) for t in texts]
        self.counts = [len(s) for s in each]
        self.starts = np.concatenate(([0], np.cumsum(np.array(self.counts, np.int64) + 1)))
        overlap = window - 1
        pieces = [(i, a, min(len(s), a + SHARD_WORDS)) for i, s in enumerate(each) if len(s) for a in range(0, max(1, len(s) - overlap), max(1, SHARD_WORDS - overlap))]
        #: (index, place among all words of each of its symbols, its symbols' numbers among those of the shard)
        self.indexes: list[tuple[FmIndex, np.ndarray, np.ndarray]] = []
        group, size = [], 0
        for piece in pieces:
            if group and size + piece[2] - piece[1] >= SHARD_WORDS:
                self._add(each, group)
                group, size = [], 0
            group.append(piece)
            size += piece[2] - piece[1] + 1
        if group:
            self._add(each, group)

    def _add(self, each: list[np.ndarray], group: list[tuple[int, int, int]]) -> None:
        gap = np.zeros(1, np.int32)
        text = np.concatenate([x for i, a, b in group for x in (each[i][a:b], gap)])
        origin = np.concatenate([np.arange(self.starts[i] + a, self.starts[i] + b + 1) for i, a, b in group])
        used = np.unique(text) if len(self.indexes) or len(self.words) >= len(text) else np.arange(len(self.words) + 1)
        dense = np.zeros(len(self.words) + 1, np.int64)
        dense[used] = np.arange(len(used))
        self.indexes.append((FmIndex(dense[text]), origin, dense))

    def find(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, position among all words) of every occurrence."""
        number = np.array([0, *(self.words.get(w, -1) for w in phrases.symbols)], np.int64)
        which, where = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for index, origin, dense in self.indexes:
            rows = number[phrases.rows]
            rows = np.where(rows > 0, dense[np.maximum(rows, 0)], rows)
            rows[(rows <= 0) & (phrases.rows > 0)] = index.size  # no word of this index
            low, high = index.search(rows, phrases.sizes)
            count = np.maximum(high - low, 0)
            p = np.repeat(np.arange(len(count)), count)
            row = np.arange(len(p)) + np.repeat(low - (np.cumsum(count) - count), count)
            which.append(p)
            where.append(origin[index.locate(row)])
        p, w = np.concatenate(which), np.concatenate(where)
        both = np.unique(np.stack((w, p)), axis=1) if len(p) else np.zeros((2, 0), np.int64)  # overlaps find some twice
        return both[1], both[0]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _findings(shard: Shard, phrases: Phrases) -> dict[int, tuple[list, set]]:
    """For the texts with occurrences, their spans and the places of their items."""
    found: dict[int, tuple[list, set]] = {}
    p, where = shard.find(phrases)
    docs = np.searchsorted(shard.starts, where, side="right") - 1
    for d, k, a in zip(docs.tolist(), p.tolist(), (where - shard.starts[docs]).tolist(), strict=True):
        spans, items = found.setdefault(d, ([], set()))
        stop = a + int(phrases.sizes[k])
        if spans and a <= spans[-1][1]:  # occurrences come in order of their start
            spans[-1] = (spans[-1][0], max(stop, spans[-1][1]))
        else:
            spans.append((a, stop))
        items.update(phrases.owner_of[phrases.owner_at[k] : phrases.owner_at[k + 1]].tolist())
    return found


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the bytes from the first to the last word of each span (spans in order, apart)."""
    data, out, kept = text.encode("utf-8"), [], 0
    todo = iter(spans)
    span = next(todo, None)
    for i, m in enumerate(_WORD.finditer(_spaced(text))):
        if span is None:
            break
        if i == span[0]:
            out.append(data[kept : m.start()])
        if i == span[1] - 1:
            kept, span = m.end(), next(todo, None)
    return b"".join([*out, data[kept:]]).decode("utf-8")


SPANS = "array<struct<start:bigint,stop:bigint>>"


def find_phrases(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, cut: bool = False) -> DataFrame:
    """docs with n_words, spans (word numbers, merged) and items (ids of the items found), replacing columns of those names.

    cut: the spans are taken out of the text (n_words and spans are of the text as it was).
    """
    spark = docs.sparkSession
    own = [c for c in docs.columns if c not in ("n_words", "spans", "items")]
    kind = benchmark.schema[item_id].dataType
    arrow_kind = to_arrow_type(kind)
    items = benchmark.select(F.col(f"`{item_id}`").alias("i"), F.col(f"`{item_text}`").alias("t"))
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = int(size // BENCHMARK_BLOCK) + 1
    at = own.index(text)
    names = [*own, "n_words", "spans", "items"]
    shared = []
    for block in range(blocks):
        mine = items if blocks == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block)
        rows = mine.groupBy("i", "t").count().collect()  # an item that comes often is sent once
        shared.append(spark.sparkContext.broadcast(Phrases([(r.i, r.t) for r in rows], window)))

    def run(batches):
        for b in batches:
            shard = Shard(b.column(at).to_pylist(), window)
            n = b.num_rows
            spans, ids = [[] for _ in range(n)], [[] for _ in range(n)]
            for block in shared:
                phrases = block.value
                for d, (new, owners) in _findings(shard, phrases).items():
                    spans[d] = _merged(spans[d] + new)
                    ids[d] += [i for i in (phrases.ids[o] for o in sorted(owners)) if i not in ids[d]]
                if len(shared) > KEPT_BLOCKS:
                    del phrases
                    block.__dict__.pop("_value", None)  # it is read again where it is asked for
            columns = list(b.columns)
            if cut:
                texts = columns[at].to_pylist()
                columns[at] = pa.array([without_spans(t, s) if t and s else t for t, s in zip(texts, spans, strict=True)], columns[at].type)
            yield pa.RecordBatch.from_arrays(
                [
                    *columns,
                    pa.array(shard.counts, pa.int64()),
                    pa.array([[{"start": x, "stop": y} for x, y in s] for s in spans], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                    pa.array(ids, pa.list_(arrow_kind)),
                ],
                names=names,
            )

    docs = docs.select(*(F.col(f"`{c}`") for c in own))
    return map_batches(docs, run, extended(docs.schema, ("n_words", "bigint"), ("spans", SPANS), ("items", f"array<{kind.simpleString()}>")))
