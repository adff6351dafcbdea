"""Token-id output: documents tokenized with the tokenizers library, kept as rANS-coded blocks.

The file format is a table of independent blocks in the shared folder. A row has the number of ids
before it (`start`), the ids and sizes of its documents (whole documents, in order of their id), and
a payload of `rans.encode_blocks`, all coded with one frequency table that was counted over all ids
(`frequencies`, stored beside the blocks). Any block can be decoded alone; in it, any segment.

Documents are in ascending order of their id, null ids first; equal ids are ordered by a
hash of their text. Null
texts are empty. Every document is closed by the end id, so none is without ids.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from operator import lt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidelog.llm import rans
from tidelog.llm.bpe import Splitter
from tidelog.llm.common import map_batches, new_path, only, remove, worker_cache
from tidelog.llm.pieces import CLOSE, MARKS, PATTERN, Runs

#: Ids after which a block is closed (a document is never cut), and ids that are coded side by side.
BLOCK_IDS, GROUP_IDS = 65_536, 3_000_000
GROUP_BLOCKS = 48
CACHE_PIECES = 1_200_000
#: Characters (bytes) of text split at a time, and pieces that are handed to the library at once.
GROUP_CHARS, JOINED = 4_000_000, 2000
#: GPT-2's pattern always ends a piece here.
SURE = re.compile(r"\S(?=[ \n])")


class LibraryCodec:
    """Whole texts by the tokenizers library, which sees each distinct piece of its split once.

    The library encodes the pieces of its pattern independently. Texts are split many at a time, and what of their
    distinct pieces was not seen lately is handed to the library as pieces; how many bytes each token spells tells
    which of the ids are whose.

    Added tokens are cut out of a text first, as the library does; their strings never reach the pieces.
    """

    def __init__(self, path: str, pattern: str, more: int = 0):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        added = self.library.get_added_tokens_decoder()
        self.added = {t.content: i for i, t in added.items()}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.cut = re.compile(f"({'|'.join(map(re.escape, longest_first))})") if added else None
        #: Tokens that also claim what is around them are left to the library, with the whole text.
        greedy = any(t.single_word or t.lstrip or t.rstrip for t in added.values())
        self.whole = Tokenizer.from_file(path) if greedy else None
        self.library.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)  # pieces are split already
        vocabulary = self.library.get_vocab()
        self.size = max(max(vocabulary.values()), more) + 1
        self.kind = id_type(self.size)
        self.bytes_in = np.zeros(self.size, np.int64)  # byte-level tokens spell a byte with one character
        for token, i in vocabulary.items():
            self.bytes_in[i] = len(token)
        self.splitter = Splitter(pattern)
        self.runs = Runs() if pattern == PATTERN else None
        #: Added tokens that may stand among other bytes as a byte of their own, which UTF-8 doesn't have.
        self.marks: dict[bytes, bytes] = {}
        if self.runs and added and not greedy and len(added) <= len(MARKS):
            self.marks = {a.encode(): bytes([m]) for a, m in zip(longest_first, MARKS, strict=False)}
            self.marked = re.compile(b"|".join(map(re.escape, self.marks)))
        self.closed = {m: np.array([self.added[a.decode()]], self.kind).tobytes() for a, m in self.marks.items()}
        self.known: dict[bytes, bytes] = {}

    def _learn(self, pieces: list[bytes]) -> None:
        width = self.kind.itemsize
        for i in range(0, len(pieces), JOINED):
            group = pieces[i : i + JOINED]
            e = self.library.encode_batch_fast([[p.decode() for p in group]], is_pretokenized=True, add_special_tokens=False)[0]
            ids = np.array(e.ids, self.kind)
            reach = np.cumsum(self.bytes_in[ids])
            ends = np.cumsum(np.fromiter(map(len, group), np.int64, len(group)))
            cuts = np.searchsorted(reach, ends) + 1
            if (reach[cuts - 1] != ends).any():
                raise ValueError("the library's tokens don't spell the pieces")
            data, cuts = ids.tobytes(), (width * cuts).tolist()
            self.known.update(zip(group, [data[i:j] for i, j in zip([0, *cuts], cuts, strict=False)], strict=True))

    def _ids(self, data: np.ndarray, starts: np.ndarray, close: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces that start at `starts`, those of CLOSE being `close`; and how many ids each closed text has.

        Pieces of one of MARKS are added tokens.
        """
        offsets = np.append(starts, len(data)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        distinct = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) > CACHE_PIECES:
            self.known.clear()
        self.known.update(self.closed)
        self.known[CLOSE] = close
        get = self.known.get
        found = list(map(get, distinct))
        if gaps := [i for i, x in enumerate(found) if x is None]:
            self._learn([distinct[i] for i in gaps])
            for i in gaps:
                found[i] = get(distinct[i])
        pool = np.frombuffer(b"".join(found), self.kind)
        sizes = np.fromiter(map(len, found), np.int32, len(found)) // self.kind.itemsize
        first = np.cumsum(sizes, dtype=np.int32) - sizes
        codes = pieces.indices.to_numpy()
        each = sizes[codes]
        reach = np.cumsum(each, dtype=np.int32)
        total = int(reach[-1]) if len(reach) else 0
        ids = pool[np.repeat(first[codes] - reach + each, each) + np.arange(total, dtype=np.int32)]
        return ids, np.diff(reach[data[starts] == CLOSE[0]], prepend=0)

    def _of_lists(self, lists: list[list[str]], close: bytes) -> tuple[np.ndarray, np.ndarray]:
        data, sizes = [], []
        for pieces in lists:
            text = "".join(pieces)
            data += [text.encode(), CLOSE]
            sizes += map(len, pieces if text.isascii() else map(str.encode, pieces))
            sizes.append(1)
        ends = np.cumsum(np.array(sizes, np.int64))
        return self._ids(np.frombuffer(b"".join(data), np.uint8), ends - np.array(sizes, np.int64), close)

    def _group(self, texts: list, close: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Of texts as `_ready` returns them."""
        if not self.runs:
            return self._of_lists([self.splitter.findall(t) for t in texts], close)
        data = np.frombuffer(b"".join([x for t in texts for x in (t, CLOSE)]), np.uint8)
        return self._ids(data, self.runs.starts(data), close)

    def _ready(self, text: str, odd: bool = False) -> bytes | str:
        """What a group holds of a text, `odd` if it holds added tokens: its bytes, these as marks; without `runs`, itself."""
        if not self.runs:
            return text
        return self.marked.sub(lambda m: self.marks[m[0]], text.encode()) if odd else text.encode()

    def _long(self, text: str) -> list[np.ndarray]:
        """Ids of a text of more than GROUP_CHARS, cut where a piece surely ends; where there is no such place, its pieces are matched a block at a time."""
        out, at = [], 0
        while at < len(text):
            cut = SURE.search(text, at + GROUP_CHARS // 2) if self.runs else None
            part = text[at : cut.end() if cut else None]
            at += len(part)
            if self.runs and len(part) <= GROUP_CHARS:
                out.append(self._group([self._ready(part)], b"")[0])
            else:
                out += [self._of_lists([block], b"")[0] for block in self.splitter.blocks(part, max(1, GROUP_CHARS // 16))]
        return out

    def _around_added(self, text: str) -> np.ndarray:
        """Ids of a text that holds added tokens."""
        if self.whole:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.kind)
        parts = self.cut.split(text)
        between = iter(self.encode(parts[::2]))
        return np.frombuffer(b"".join(next(between) if i % 2 == 0 else np.array([self.added[p]], self.kind).tobytes() for i, p in enumerate(parts)), self.kind)

    def flat(self, texts: list[str | None], close: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """Ids (of type `kind`) of all texts, one behind the other, each text followed by the packed ids `close`; and how many each has."""
        out: list[tuple[np.ndarray, np.ndarray]] = []
        group: list[str] = []
        size, added = 0, list(self.added)
        end = np.frombuffer(close, self.kind)
        for text in texts:
            text = text or ""
            odd = any(a in text for a in added)
            if (odd and not self.marks) or len(text) > GROUP_CHARS:
                out.append(self._group(group, close))
                group, size = [], 0
                ids = np.concatenate([*([self._around_added(text)] if odd else self._long(text)), end])
                out.append((ids, np.array([len(ids)], np.int32)))
                continue
            group.append(self._ready(text, odd))
            size += len(group[-1])
            if size > GROUP_CHARS:
                out.append(self._group(group, close))
                group, size = [], 0
        out.append(self._group(group, close))
        return np.concatenate([ids for ids, _ in out]), np.concatenate([n for _, n in out]).astype(np.int64)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids (of type `kind`) of each text."""
        ids, sizes = self.flat(texts)
        data, ends = ids.tobytes(), (self.kind.itemsize * np.cumsum(sizes)).tolist()
        return [data[i:j] for i, j in zip([0, *ends], ends, strict=False)]


def id_type(size: int) -> np.dtype:
    """The narrowest little-endian type for ids below `size`."""
    return np.dtype("<u2" if size <= 1 << 16 else "<u4")


def _codec(path: str, pattern: str, end_id: int) -> LibraryCodec:
    codecs, key = worker_cache("token_file"), (path, pattern, end_id)
    if key not in codecs:
        codecs.clear()
        codecs[key] = LibraryCodec(*key)
    return codecs[key]


def _write(df: DataFrame, path: str, codec: str) -> DataFrame:
    """Write a table and let the shuffle files that led to it go at once."""
    spark = df.sparkSession
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


#: In the table of packed ids, `at` of the row that holds a part's counts instead of a document, and of one
#: that says that a part's ids weren't in order after all.
COUNTS, UNORDERED = -1, -2


def apart(ranges: list[tuple[object, object, int]]) -> bool:
    """Whether parts (least id, largest id, rows without an id) are ranges of ids that don't touch."""
    if any(missing for _, _, missing in ranges):
        return False
    ranges = sorted(r[:2] for r in ranges)
    return all(a[1] < b[0] for a, b in zip(ranges, ranges[1:], strict=False))


def _ranges(rows: DataFrame, part) -> list[tuple[object, object, int]]:
    """What `apart` needs to know of each part; a row for each reaches the driver."""
    missing = F.count_if(F.col("id").isNull())
    return [tuple(r)[1:] for r in rows.groupBy(part.alias("part")).agg(F.min("id"), F.max("id"), missing).collect()]


def tokenized(docs: DataFrame, path: str, pattern: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", ordered: bool = False) -> DataFrame:
    """(part, at, id, ids): packed ids of each text and the end id, in ranges of ascending id; `at` ids of its part come before.

    ordered: the partitions of docs are such ranges already and in order, so neither shuffle nor sort is needed; a part
    for which that isn't so gets a row of `at` = UNORDERED.

    Each part that isn't empty ends with a row of `at` = COUNTS: ids has how often each id occurs in the part, as 64-bit integers.
    """
    docs = only(docs, id_col, text_col).toDF("id", "text")
    tie = F.xxhash64("text")  # so that rows of one id can part, and the sample that sets the ranges stays small
    ranged = docs if ordered else docs.repartitionByRange(F.col("id"), tie).sortWithinPartitions("id", tie)
    ranged = ranged.withColumn("part", F.spark_partition_id())

    names = ["part", "at", "id", "n", "ids", "counts"]

    def run(batches):
        codec, at, part = _codec(path, pattern, end_id), 0, None
        end, width = np.array([end_id], codec.kind).tobytes(), codec.kind.itemsize
        counts = np.zeros(codec.size, np.int64)
        last, fine = None, True
        for b in batches:
            if ordered and b.num_rows:
                found = b.column(0).to_pylist()
                fine = fine and (last is None or last < found[0]) and all(map(lt, found, found[1:]))
                last = found[-1]
            ids, sizes = codec.flat(b.column(1).to_pylist(), end)
            ends = np.cumsum(sizes)
            offsets = np.concatenate(([0], width * ends))
            if offsets[-1] >= 1 << 31:
                raise ValueError("the ids of a batch don't fit a column")
            column = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(ids)])
            before = at + ends - sizes
            at += len(ids)
            for i in range(0, len(ids), 1 << 20):
                counts += np.bincount(ids[i : i + (1 << 20)], minlength=codec.size)
            part = b.column(2)[:1] if b.num_rows else part
            kind = b.column(0).type
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array(before), b.column(0), pa.array(sizes), column, pa.nulls(b.num_rows, pa.binary())], names=names)
        if part is not None:
            for at, data in ((COUNTS, counts.astype("<i8").tobytes()), *([] if fine else [(UNORDERED, b"")])):
                own = [part, pa.array([at], pa.int64()), pa.nulls(1, kind), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([data], pa.binary())]
                yield pa.RecordBatch.from_arrays(own, names=names)

    return map_batches(ranged, run, f"part int, at long, id {docs.schema[0].dataType.simpleString()}, n long, ids binary, counts binary", cache="token_file")


def count_ids(tokens: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs in all parts; what reaches the driver is bounded by the vocabulary."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            for p in b.column(0).to_pylist():
                total += np.frombuffer(p, "<i8")
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["token", "n"])

    own = tokens.where(F.col("at") == COUNTS).select("counts")
    rows = map_batches(own, run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(size, np.int64)
    counts[rows.column("token").to_numpy()] = rows.column("n").to_numpy()
    return counts


BLOCKS = "start bigint, doc_ids array<{kind}>, sizes array<bigint>, payload binary"


def _blocks(rows: Iterator[tuple[int, object, bytes]], freq: np.ndarray, kind, packing: np.dtype) -> Iterator[pa.RecordBatch]:
    """Rows (start, id, packed ids) in order to batches of coded blocks."""
    table = rans.FrequencyTable(freq)
    done: list[tuple[int, list, list, np.ndarray]] = []
    held = 0

    def batch():
        payloads = rans.encode_blocks([x[3] for x in done], table)
        columns = [[x[i] for x in done] for i in range(3)]
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.list_(kind)), pa.array(columns[2], pa.list_(pa.int64())), pa.array(payloads, pa.binary())],
            names=["start", "doc_ids", "sizes", "payload"],
        )

    start, following, ids, sizes, parts, size = 0, None, [], [], [], 0

    def close():
        nonlocal ids, sizes, parts, held, size
        if ids:
            done.append((start, ids, sizes, np.frombuffer(b"".join(parts), packing)))
            held += size
            ids, sizes, parts, size = [], [], [], 0

    for at, doc, packed in rows:
        if at != following or size >= BLOCK_IDS:
            close()
            if held >= GROUP_IDS:
                yield batch()
                done.clear()
                held = 0
            start = at
        ids.append(doc)
        sizes.append(len(packed) // packing.itemsize)
        parts.append(packed)
        size += sizes[-1]
        following = at + sizes[-1]
    close()
    if done:
        yield batch()


def write_tokens(docs: DataFrame, out: str, path: str, pattern: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Write the documents' ids below the folder `out`; returns it."""
    spark = docs.sparkSession
    # Tables are often kept in order of their ids; then the partitions of a scan are used as they are. What
    # came of it is looked at again in the ids that were written.
    scanned = only(docs, id_col).toDF("id")
    ordered = "Exchange" not in scanned._jdf.queryExecution().toString() and apart(_ranges(scanned, F.spark_partition_id()))
    while True:
        work = new_path(spark, "tokens")
        tokens = _write(tokenized(docs, path, pattern, end_id, id_col, text_col, ordered), work, "lz4_raw")
        if not ordered or (apart(_ranges(tokens.where(F.col("at") >= 0), F.col("part"))) and not tokens.where(F.col("at") == UNORDERED).count()):
            break
        remove(spark, work)
        ordered = False
    size = LibraryCodec(path, pattern, end_id).size
    packing = id_type(size)
    table = rans.FrequencyTable.from_counts(count_ids(tokens, size))
    documents = tokens.where(F.col("at") >= 0)
    ends = documents.groupBy("part").agg(F.max(F.col("at") + F.col("n")).alias("n"), F.min("id").alias("least"))
    before, total = {}, 0  # a number for each partition
    for r in ends.orderBy("least" if ordered else "part").collect():
        before[r.part], total = total, total + r.n
    kind = tokens.schema["id"].dataType
    arrow_kind = to_arrow_type(kind)
    freq = spark.sparkContext.broadcast(table.freq.astype(np.uint32))

    def run(batches):
        def rows():
            for b in batches:
                for part, at, doc, packed in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    yield before[part] + at, doc, packed

        yield from _blocks(rows(), freq.value, arrow_kind, packing)

    blocks = map_batches(documents.select("part", "at", "id", "ids"), run, BLOCKS.format(kind=kind.simpleString()))
    blocks.write.option("compression", "uncompressed").parquet(f"{out}/blocks")
    spark.createDataFrame([(bytes(table.freq.astype("<u4").tobytes()),)], "frequencies binary").coalesce(1).write.parquet(f"{out}/frequencies")
    remove(spark, work)
    return out


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(id, start, ids as 32-bit integers) of each document, decoded from the files, each block on its own."""
    freq = spark.sparkContext.broadcast(np.frombuffer(bytes(spark.read.parquet(f"{folder}/frequencies").first()[0]), "<u4"))
    blocks = spark.read.parquet(f"{folder}/blocks")

    def run(batches):
        table = rans.FrequencyTable(freq.value)
        for b in batches:
            for i in range(0, b.num_rows, GROUP_BLOCKS):
                c = [x.to_pylist() for x in b.slice(i, GROUP_BLOCKS).columns]
                for start, names, sizes, found in zip(*c[:3], rans.decode_blocks(c.pop(), table), strict=True):
                    ends = start + np.cumsum(np.array(sizes, np.int64))
                    offsets = 4 * np.concatenate(([0], ends - start))
                    if offsets[-1] >= 1 << 31:
                        raise ValueError("the ids of a block don't fit a column")
                    ids = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(found.astype("<u4"))])
                    yield pa.RecordBatch.from_arrays([pa.array(names, b.column(1).type.value_type), pa.array(ends - sizes), ids], names=["id", "start", "ids"])

    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    return map_batches(blocks, run, f"id {kind}, start bigint, ids binary", rows=GROUP_BLOCKS)


